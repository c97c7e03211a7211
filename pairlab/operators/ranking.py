"""Ranking quality: NDCG per query and its summaries.

Plan shape (per ``ndcg_per_query``) — two branches over the same input,
joined on the query key once each is down to one row per query:

* DCG, actual and ideal: every row is emitted once per side (side 0 ordered
  by score desc, side 1 by label desc) and ranked by one
  ``row_number() over (partition by key, side order by ...)`` filtered
  ``<= K``.  Catalyst turns this into a *partial* WindowGroupLimit before the
  exchange and a final one after it, so each map task ships at most 2K rows
  per query: a hot query key holding a third of all rows costs
  2K x (map tasks) rows in one reducer, never the whole group.
* document count and first appearance: a plain partial/final hash aggregate.

No query's rows are ever collected into a list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import NDCG_CDF_THRESHOLDS, NDCG_KS, WORST_QUERIES_N
from ..functions.dist import dcg_term


def _bad_score(score: str) -> Column:
    """NaN/null scores sort last (``argsort(-x)`` puts NaN at the end)."""
    s = F.col(score)
    return (s.isNull() | F.isnan(s)).cast("int")


def rank_order(score: str, tie: Sequence[str]) -> list[Column]:
    """Order of documents within a query: score desc, NaN last, then ``tie`` asc (F1)."""
    return [_bad_score(score), F.col(score).desc()] + [F.col(c).asc() for c in tie]


def ideal_order(rel: str, tie: Sequence[str]) -> list[Column]:
    """Ideal order: label desc, then ``tie`` asc (F2)."""
    return [F.col(rel).desc()] + [F.col(c).asc() for c in tie]


def top_k_per_query(df: DataFrame, k: int, qid: str = "qid", score: str = "score",
                    tie: Sequence[str] = ("global_idx",), by: Sequence[str] = (),
                    rank_col: str = "rank") -> DataFrame:
    """Top-k documents per query by score with a 1-based rank."""
    keys = list(by) + [qid]
    w = Window.partitionBy(*keys).orderBy(*rank_order(score, tie))
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def _dcg_sides(df: DataFrame, keys: list[str], rel: str, score: str, tie: Sequence[str],
               ks: Sequence[int]) -> DataFrame:
    """Actual and ideal DCG@k per query from one ranked pass.

    Each row is emitted twice: side 0 ordered by score (NaN last), side 1 by
    label.  One ``row_number`` window over ``(keys, side)`` ranks both, and its
    ``<= K`` filter becomes a partial WindowGroupLimit below the single
    exchange.
    """
    kmax = max(ks)
    sides = F.array(
        F.struct(F.lit(0).alias("__side"), _bad_score(score).alias("__k1"),
                 F.col(score).cast("double").alias("__k2")),
        F.struct(F.lit(1).alias("__side"), F.lit(0).alias("__k1"),
                 F.col(rel).cast("double").alias("__k2")))
    both = df.select(*keys, rel, *tie, F.inline(sides))
    # the query first: a sort compares by its first column, which groups of queries hardly tell apart
    w = Window.partitionBy(*reversed(keys), "__side").orderBy(
        F.col("__k1").asc(), F.col("__k2").desc(), *[F.col(c).asc() for c in tie])
    ranked = both.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= kmax)
    term = dcg_term(F.col(rel).cast("double"), F.col("__r"))
    aggs = []
    for k in ks:
        for side, prefix in ((0, "__dcg"), (1, "__idcg")):
            hit = (F.col("__side") == side) & (F.col("__r") <= k)
            aggs.append(F.sum(F.when(hit, term).otherwise(F.lit(0.0))).alias(f"{prefix}{k}"))
    return ranked.groupBy(*keys).agg(*aggs)


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` where NULL matches NULL (a null query key is a group)."""
    r = right.select(*[F.col(k).alias(f"__rk_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in reversed(keys):  # the query first, as in the ranks' sort
        e = F.col(k).eqNullSafe(F.col(f"__rk_{k}"))
        cond = e if cond is None else cond & e
    return left.join(r, cond, "inner").drop(*[f"__rk_{k}" for k in keys])


def ndcg_per_query(df: DataFrame, qid: str = "qid", rel: str = "rel", score: str = "score",
                   ks: Sequence[int] = NDCG_KS, tie: Sequence[str] = ("global_idx",),
                   by: Sequence[str] = ()) -> DataFrame:
    """NDCG@k for every query.

    Output: ``by..., qid, num_docs, first_key, ndcg{k}...``; ``first_key`` is the
    smallest tie key of the query (its first appearance, F5).  A query whose
    ideal DCG is 0 scores 0.0 (T14).
    """
    keys = list(by) + [qid]
    base = df.select(*keys, rel, score, *tie)
    dcg = _dcg_sides(base, keys, rel, score, tie, ks)
    first = F.struct(*[F.col(c) for c in tie]) if len(tie) > 1 else F.col(tie[0])
    counts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_docs"),
                                     F.min(first).alias("first_key"))
    return _join_null_safe(counts, dcg, keys).select(*keys, "num_docs", "first_key", *_ndcg(ks))


def _ndcg(ks: Sequence[int]) -> list[Column]:
    return [F.when(F.col(f"__idcg{k}") == 0, F.lit(0.0)).otherwise(F.col(f"__dcg{k}") / F.col(f"__idcg{k}"))
            .alias(f"ndcg{k}") for k in ks]


def ndcg_values(df: DataFrame, qid: str = "qid", rel: str = "rel", score: str = "score",
                ks: Sequence[int] = NDCG_KS, tie: Sequence[str] = ("global_idx",),
                by: Sequence[str] = ()) -> DataFrame:
    """``ndcg_per_query`` without ``num_docs`` and ``first_key``: the ranked branch
    alone, which has every query, and no join."""
    keys = list(by) + [qid]
    return _dcg_sides(df.select(*keys, rel, score, *tie), keys, rel, score, tie, ks).select(*keys, *_ndcg(ks))


def ndcg_summary(per_query: DataFrame, ks: Sequence[int] = NDCG_KS,
                 by: Sequence[str] = ()) -> DataFrame:
    """Mean and population std of per-query NDCG, zero-ideal queries included."""
    aggs = [F.count(F.lit(1)).alias("num_queries"),
            F.sum("num_docs").alias("num_docs")]
    for k in ks:
        aggs += [F.avg(f"ndcg{k}").alias(f"ndcg{k}_mean"),
                 F.stddev_pop(f"ndcg{k}").alias(f"ndcg{k}_std")]
    return per_query.groupBy(*by).agg(*aggs)


def corpus_stats(per_query: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """#queries, #documents and documents per query min/max/mean."""
    return per_query.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_queries"),
        F.sum("num_docs").alias("num_docs"),
        F.min("num_docs").alias("min_docs"),
        F.max("num_docs").alias("max_docs"),
        F.avg("num_docs").alias("mean_docs"))


def ndcg_cdf(per_query: DataFrame, col: str = "ndcg10",
             thresholds: Sequence[float] = NDCG_CDF_THRESHOLDS,
             by: Sequence[str] = ()) -> DataFrame:
    """Count and percentage of queries with NDCG <= t for each threshold.

    One aggregate pass computes every threshold; ``stack`` turns the wide row
    into one row per threshold.  No cross join with a threshold table.
    """
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, t in enumerate(thresholds):
        aggs.append(F.sum(F.when(F.col(col) <= F.lit(float(t)), 1).otherwise(0))
                    .alias(f"__c{i}"))
    wide = per_query.groupBy(*by).agg(*aggs)
    pairs = ", ".join(f"CAST({float(t)!r} AS DOUBLE), __c{i}" for i, t in enumerate(thresholds))
    long = wide.select(*by, "__n", F.expr(f"stack({len(thresholds)}, {pairs}) AS (threshold, n_le)"))
    return long.select(*by, "threshold", F.col("n_le").cast("long").alias("n_le"),
                       F.col("__n").alias("num_queries"),
                       (F.col("n_le") * F.lit(100.0) / F.col("__n")).alias("pct_le"))


def worst_queries(per_query: DataFrame, n: int = WORST_QUERIES_N, col: str = "ndcg10",
                  qid: str = "qid") -> DataFrame:
    """The n queries with the lowest NDCG@10, ties by first appearance.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
    n rows, so nothing large reaches the driver.
    """
    return per_query.orderBy(F.col(col).asc(), F.col("first_key").asc(),
                             F.col(qid).asc()).limit(n)
