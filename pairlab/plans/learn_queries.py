"""Registered queries: fitted scorers, bring-your-own scoring, resume (V3, V4).

Iterative model fitting has no SQL form: ``fit_*_score`` are rows-only checks,
and ``fit_*_check`` states in SQL what holds of any proper fit.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.parse import prob_vector
from ..operators import learn, merge, shards
from ..session import materialized
from . import fixtures as fx
from .merge_queries import _MERGE_CTES, _ok
from .registry import r6, register

NL = 4


def _score_cols(df):
    return df.select("global_idx", *[r6(F.try_element_at("probs", F.lit(str(i))), f"p{i}")
                                     for i in range(NL)],
                     "output_text", r6("weighted_score"))


def _counted_pairs(spark, sf_dir):
    """The text pairs as token counts, read by the fit, the scoring and the truth."""
    return learn.token_counts(fx.pairs_text(spark, sf_dir), ("global_idx", "label"))


def _soft(spark, sf_dir, pairs):
    """Written pairs with their teacher distribution, as a saved table."""
    scores = merge.latest_by_index(_ok(spark, sf_dir), payload=("probs",))
    return materialized(merge.merge_soft_labels(pairs, scores, filter_invalid=True, as_json=False, keep=learn.COUNTS), "soft")


@register("fit_hard_score")
def q_fit_hard_score(spark, sf_dir):
    pairs = _counted_pairs(spark, sf_dir)
    model = learn.fit_hard(pairs, NL)
    return _score_cols(learn.score_pairs(model, pairs, NL))


@register("fit_soft_score")
def q_fit_soft_score(spark, sf_dir):
    pairs = _counted_pairs(spark, sf_dir)
    soft = _soft(spark, sf_dir, pairs)
    model = learn.fit_soft(soft, NL, kind="fkl")
    return _score_cols(learn.score_pairs(model, pairs, NL))


def _overlap_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """A tiny scorer: share of query words found in the document."""
    def share(query: str, passage: str) -> float:
        words, found = query.lower().split(), set(passage.lower().split())  # of one pair at a time
        return sum(w in found for w in words) / max(len(words), 1)
    frac = [share(q, d) for q, d in zip(batch["query"].fillna(""), batch["passage"].fillna(""))]
    return pd.DataFrame({"global_idx": batch["global_idx"], "score": frac})


_WS_SQL = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


@register("score_with", sql=f"""WITH v AS ({fx.V3_SQL}),
w AS (SELECT global_idx,
  CASE WHEN trim(lower(query), {_WS_SQL}) = '' THEN []
       ELSE regexp_split_to_array(trim(lower(query), {_WS_SQL}), '[\t\n\x0b\x0c\r ]+') END AS qw,
  CASE WHEN trim(lower(passage), {_WS_SQL}) = '' THEN []
       ELSE regexp_split_to_array(trim(lower(passage), {_WS_SQL}), '[\t\n\x0b\x0c\r ]+') END AS dw
  FROM v)
SELECT global_idx, len(list_filter(qw, lambda x: list_contains(dw, x))) / greatest(len(qw), 1) AS score
FROM w""")
def q_score_with(spark, sf_dir):
    pairs = fx.pairs_text(spark, sf_dir).select("global_idx", "query", "passage")
    return learn.score_with(pairs, _overlap_scorer, "global_idx long, score double")


def _check(spark, sf_dir, scored, truth):
    """What SQL can state of a fit: every pair is scored once, probabilities sum
    to 1, and the scores' cross-entropy with the labels is below the label prior's."""
    p = F.array(*[F.greatest(F.try_element_at("probs", F.lit(str(i))), F.lit(1e-12)) for i in range(NL)])
    rows = scored.select("global_idx", p.alias("p")).join(truth.select("global_idx", "w"), "global_idx", "left")
    loss = -sum((F.get("w", i) * F.ln(F.get("p", i)) for i in range(NL)), F.lit(0.0))
    out = rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("global_idx").alias("pairs"),
                   F.round(F.min(F.aggregate("p", F.lit(0.0), lambda a, x: a + x)), 6).alias("least_mass"),
                   F.round(F.max(F.aggregate("p", F.lit(0.0), lambda a, x: a + x)), 6).alias("most_mass"),
                   F.avg(loss).alias("loss"), *[F.avg(F.get("w", i)).alias(f"w{i}") for i in range(NL)])
    prior = -sum((F.col(f"w{i}") * F.ln(F.greatest(F.col(f"w{i}"), F.lit(1e-12))) for i in range(NL)), F.lit(0.0))
    return out.select("rows", "pairs", "least_mass", "most_mass", (F.col("loss") < prior).alias("beats_prior"))


_CHECK_SQL = """SELECT count(*) AS rows, count(DISTINCT doc_id) AS pairs,
  CAST(1.0 AS DOUBLE) AS least_mass, CAST(1.0 AS DOUBLE) AS most_mass, TRUE AS beats_prior FROM documents"""


@register("fit_hard_check", sql=_CHECK_SQL)
def q_fit_hard_check(spark, sf_dir):
    pairs = _counted_pairs(spark, sf_dir)
    truth = pairs.select("global_idx", F.array(*[(F.col("label") == i).cast("double") for i in range(NL)]).alias("w"))
    return _check(spark, sf_dir, learn.score_pairs(learn.fit_hard(pairs, NL), pairs, NL), truth)


@register("fit_soft_check", sql=_CHECK_SQL)
def q_fit_soft_check(spark, sf_dir):
    pairs = _counted_pairs(spark, sf_dir)
    soft = _soft(spark, sf_dir, pairs)
    truth = soft.select("global_idx", prob_vector("teacher_probs", NL).alias("w"))
    return _check(spark, sf_dir, learn.score_pairs(learn.fit_soft(soft, NL, kind="fkl"), pairs, NL), truth)


def _divergence_check(spark, sf_dir, kind):
    """A fit by ``kind``: every pair is scored once, and its mean divergence is
    below the constant prior's and below that of a fit by forward KL."""
    pairs = _counted_pairs(spark, sf_dir)
    soft = _soft(spark, sf_dir, pairs)
    truth = soft.select("global_idx", prob_vector("teacher_probs", NL, "zero").alias("t"))
    other = learn.fit_soft(soft, NL, kind="fkl")
    models = [learn.fit_soft(soft, NL, kind=kind, start=other), other]
    sides = [learn.score_pairs(m, pairs, NL).select("global_idx", prob_vector("probs", NL, "zero").alias(name))
             for m, name in zip(models, ("own", "other"))]
    rows = sides[0].join(sides[1], "global_idx").join(truth, "global_idx", "left")
    rows = rows.withColumn("prior", truth.agg(F.array(*[F.avg(F.get("t", i)) for i in range(NL)])).scalar())
    own, other, prior = (F.avg(F.when(F.col("t").isNotNull(), dist.divergence("t", s, NL, kind)))
                         for s in ("own", "other", "prior"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("global_idx").alias("pairs"),
                    F.count("t").alias("taught"), (own < prior).alias("beats_prior"), (own < other).alias("beats_fkl"))


_DIVERGENCE_CHECK_SQL = f"""WITH {_MERGE_CTES}
SELECT count(*) AS rows, count(DISTINCT global_idx) AS pairs, count(*) FILTER (status = 'written') AS taught,
  TRUE AS beats_prior, TRUE AS beats_fkl FROM m"""


@register("fit_jsd_check", sql=_DIVERGENCE_CHECK_SQL)
def q_fit_jsd_check(spark, sf_dir):
    return _divergence_check(spark, sf_dir, "jsd")


@register("fit_rkl_check", sql=_DIVERGENCE_CHECK_SQL)
def q_fit_rkl_check(spark, sf_dir):
    return _divergence_check(spark, sf_dir, "rkl")


def _length_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """A deterministic scorer: the share of a document's length in 1000 characters."""
    p = batch["passage"].fillna("").str.len().clip(upper=1000) / 1000
    return pd.DataFrame({"global_idx": batch["global_idx"], "output_text": batch["docid"], "weighted_score": p})


@register("resume_scores", sql=f"""WITH v AS ({fx.V3_SQL})
SELECT global_idx, docid AS output_text, ROUND(least(length(passage), 1000) / 1000.0, 6) AS weighted_score,
  global_idx % {fx.WORLD_SIZE} NOT IN ({", ".join(map(str, fx.MISSING_RANKS))}) AS was_there FROM v""")
def q_resume_scores(spark, sf_dir):
    """Scores exist for shards other than 2 and 5; resume fills those in."""
    schema = "global_idx long, output_text string, weighted_score double"
    pairs = fx.pairs_text(spark, sf_dir)
    sharded = shards.with_shard(pairs, fx.WORLD_SIZE)
    have = sharded.where(~F.col("rank").isin(*fx.MISSING_RANKS)).drop("rank")
    existing = learn.score_with(have, _length_scorer, schema).withColumn("was_there", F.lit(True))
    present = shards.present_ranks(shards.with_shard(existing, fx.WORLD_SIZE))
    missing = shards.missing_ranks(spark, present, fx.WORLD_SIZE)

    def scorer(p):
        return learn.score_with(p, _length_scorer, schema).withColumn("was_there", F.lit(False))
    out = learn.resume_scores(pairs, existing, scorer, world_size=fx.WORLD_SIZE, missing_ranks=missing)
    return out.select("global_idx", "output_text", r6("weighted_score"), "was_there")
