"""Score merge: last-wins upsert, soft-label join, counters.

Everything keys on ``global_idx``.  After ``latest_by_index`` it is unique on
the score side, so the pair ⋈ score join has no hot key; AQE picks broadcast
for a small score table and sort-merge otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MIN_PROB_MASS
from ..functions.parse import keep_mass
from ..functions.text import label_int


def valid_scores(parsed: DataFrame) -> DataFrame:
    """Rows of a tolerant scan that parsed (status ok)."""
    return parsed.where(F.col("status") == "ok")


def latest_by_index(scores: DataFrame, order: Sequence[str] = ("file_ord", "line_idx"),
                    index: str = "global_idx", payload: Sequence[str] | None = None) -> DataFrame:
    """One row per index: the last by ``order`` wins.

    ``max_by`` is a partial aggregate, so duplicates collapse map-side before
    the shuffle; a hot index costs one row per map task.  ``payload`` names
    the columns to keep (default: all).  Name them: fields inside the
    aggregate's struct are not pruned later, so a wide payload (e.g. the
    output text) would travel through the shuffle for nothing.
    """
    if payload is None:
        payload = [c for c in scores.columns if c != index and c not in order]
    payload = list(order) + [c for c in payload if c not in order]
    best = F.max_by(F.struct(*[F.col(c) for c in payload]), F.struct(*[F.col(c) for c in order]))
    return scores.groupBy(index).agg(best.alias("__row")).select(index, "__row.*")


def index_range(scores: DataFrame, index: str = "global_idx") -> DataFrame:
    """Valid record count and the index range."""
    return scores.agg(F.count(F.lit(1)).alias("num_records"),
                      F.min(index).alias("min_idx"), F.max(index).alias("max_idx"))


def union_shards(shards: Sequence[DataFrame], check_unique: str | None = None) -> DataFrame:
    """UNION ALL of shard tables, duplicates kept (H1).  With ``check_unique``
    (an index column) a duplicate raises when the rows are read."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    if check_unique is None:
        return out
    repeated = duplicate_indexes(out, check_unique).select(check_unique, F.lit(True).alias("__twice"))
    told = F.raise_error(F.concat(F.lit("index in two shards: "), F.col(check_unique).cast("string")))
    kept = F.when(F.col("__twice"), told.cast(out.schema[check_unique].dataType)).otherwise(F.col(check_unique))
    return out.join(repeated, check_unique, "left").withColumn(check_unique, kept).select(*out.columns)


def duplicate_indexes(df: DataFrame, index: str = "global_idx") -> DataFrame:
    """Indexes that occur more than once after a union (the H1 duplicate check)."""
    return df.groupBy(index).count().where(F.col("count") > 1)


def merge_status(pairs: DataFrame, scores: DataFrame, filter_invalid: bool = False,
                 min_mass: float = MIN_PROB_MASS, bounded: bool = False) -> DataFrame:
    """Pairs with their score and a status.

    Status precedence: no score -> ``missing``; blank pair line -> ``skipped``;
    low mass (when ``filter_invalid``) -> ``skipped``; else ``written``.
    ``bounded`` restricts the pair scan to the scored index range (D2): two
    scalar subqueries, evaluated once, pushed as a range filter.
    """
    s = scores.select("global_idx", F.col("probs").alias("__probs"))
    if bounded:
        rng = scores.agg(F.min("global_idx").alias("lo"), F.max("global_idx").alias("hi"))
        pairs = pairs.where((F.col("global_idx") >= rng.select("lo").scalar()) &
                            (F.col("global_idx") <= rng.select("hi").scalar()))
    j = pairs.join(s, "global_idx", "left")
    blank = F.col("is_blank") if "is_blank" in pairs.columns else F.lit(False)
    status = (F.when(F.col("__probs").isNull(), F.lit("missing"))
              .when(blank, F.lit("skipped")))
    if filter_invalid:
        status = status.when(~keep_mass("__probs", min_mass), F.lit("skipped"))
    return j.withColumn("status", status.otherwise(F.lit("written")))


def merge_soft_labels(pairs: DataFrame, scores: DataFrame, filter_invalid: bool = False,
                      min_mass: float = MIN_PROB_MASS, bounded: bool = False,
                      as_json: bool = True, keep: Sequence[str] = ("query", "title", "passage")) -> DataFrame:
    """Soft-label table: written pairs with their teacher distribution.

    Columns ``global_idx``, those of ``keep``, ``label, teacher_probs``; label
    is ``int(label)``, 0 without a label column, and a null label raises; ``teacher_probs`` is JSON text
    (``as_json``) or the map.
    """
    m = merge_status(pairs, scores, filter_invalid, min_mass, bounded)
    w = m.where(F.col("status") == "written")
    probs = F.to_json("__probs") if as_json else F.col("__probs")
    return w.select("global_idx", *keep,
                    (label_int("label") if "label" in pairs.columns else F.lit(0)).alias("label"),
                    probs.alias("teacher_probs"))


def merge_stats(pairs: DataFrame, scores: DataFrame, filter_invalid: bool = False,
                min_mass: float = MIN_PROB_MASS) -> DataFrame:
    """Counters written / skipped / missing."""
    return merge_status(pairs, scores, filter_invalid, min_mass).groupBy("status").count()


def missing_pairs(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Pair rows without a score (D4): a left anti join on the index."""
    return pairs.join(scores.select("global_idx"), "global_idx", "left_anti")


def drop_low_mass(scores: DataFrame, min_mass: float = MIN_PROB_MASS,
                  probs: str = "probs") -> DataFrame:
    """Keep distributions whose probabilities sum to at least ``min_mass``."""
    return scores.where(keep_mass(probs, min_mass))
