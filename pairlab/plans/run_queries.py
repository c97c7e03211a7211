"""Registered queries: multi-run evaluation, grid, result-store skip, names (V1, V2, V5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.parse import run_name, split_spec, teacher_name, teacher_size
from ..operators import incremental, runs, sharpness
from ..session import ensure_checkpoint_dir
from . import fixtures as fx
from .metric_queries import _bins_sql
from .registry import r6, register

KEY = list(fx.LI_KEY)
KEY_SQL = fx.LI_KEY_SQL
DATASETS = ("F", "O", "P")
_DS_SQL = ", ".join(f"('{d}')" for d in DATASETS)


def _scores(spark, sf_dir):
    p = fx.probs(spark, sf_dir, 2)
    return p.select("run", "dataset", *KEY, F.col("t").alias("probs"))


def _pairs(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("dataset"), *KEY,
                     F.col("l_partkey").alias("qid"),
                     (F.col("l_linenumber") % 4).cast("double").alias("rel"))


def _expected(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    return runs.evaluation_grid(li.select(F.col("l_returnflag").alias("run")), DATASETS)


_LB_SQL = f"""WITH p AS ({fx.probs_sql(2)}),
j AS (SELECT run, dataset, {KEY_SQL}, l_partkey AS qid, CAST(l_linenumber % 4 AS DOUBLE) AS rel,
        (t[1] * 0.0 + t[2] * 1.0) / 1.0 AS score,
        t[1] / (t[1] + t[2]) AS q0, t[2] / (t[1] + t[2]) AS q1 FROM p),
a AS (SELECT run, dataset, qid, rel, row_number() OVER (PARTITION BY run, dataset, qid ORDER BY
        CASE WHEN score IS NULL OR isnan(score) THEN 1 ELSE 0 END, score DESC, {KEY_SQL}) AS r FROM j),
i AS (SELECT run, dataset, qid, rel, row_number() OVER (PARTITION BY run, dataset, qid
        ORDER BY rel DESC, {KEY_SQL}) AS r FROM j),
ad AS (SELECT run, dataset, qid,
        SUM(CASE WHEN r <= 5 THEN (pow(2.0, rel) - 1) / log2(r + 1) ELSE 0 END) AS d5,
        SUM(CASE WHEN r <= 10 THEN (pow(2.0, rel) - 1) / log2(r + 1) ELSE 0 END) AS d10
      FROM a WHERE r <= 10 GROUP BY run, dataset, qid),
id AS (SELECT run, dataset, qid,
        SUM(CASE WHEN r <= 5 THEN (pow(2.0, rel) - 1) / log2(r + 1) ELSE 0 END) AS d5,
        SUM(CASE WHEN r <= 10 THEN (pow(2.0, rel) - 1) / log2(r + 1) ELSE 0 END) AS d10
      FROM i WHERE r <= 10 GROUP BY run, dataset, qid),
pq AS (SELECT ad.run, ad.dataset, ad.qid,
        CASE WHEN id.d5 = 0 THEN 0.0 ELSE ad.d5 / id.d5 END AS n5,
        CASE WHEN id.d10 = 0 THEN 0.0 ELSE ad.d10 / id.d10 END AS n10
      FROM ad JOIN id ON ad.run = id.run AND ad.dataset = id.dataset AND ad.qid = id.qid),
nd AS (SELECT run, dataset, count(*) AS num_queries, avg(n5) AS ndcg5, avg(n10) AS ndcg10
       FROM pq GROUP BY run, dataset),
rw AS (SELECT run, dataset, score, rel / 3.0 AS lab, {_bins_sql('score')} AS bin,
        -(least(greatest(q0, 1e-12), 1.0) * ln(least(greatest(q0, 1e-12), 1.0))
          + least(greatest(q1, 1e-12), 1.0) * ln(least(greatest(q1, 1e-12), 1.0))) AS ent,
        greatest(q0, q1) AS mx,
        ln(least(greatest(q0, 1e-12), 1.0)) / 2.0 AS z0, ln(least(greatest(q1, 1e-12), 1.0)) / 2.0 AS z1,
        ln(least(greatest(q1, 1e-12), 1.0)) - ln(least(greatest(q0, 1e-12), 1.0)) AS mg FROM j),
rs AS (SELECT *, exp(z0 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))) AS s0,
        exp(z1 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))) AS s1 FROM rw),
rt AS (SELECT *, -(least(greatest(s0, 1e-12), 1.0) * ln(least(greatest(s0, 1e-12), 1.0))
        + least(greatest(s1, 1e-12), 1.0) * ln(least(greatest(s1, 1e-12), 1.0))) AS sent FROM rs),
bins AS (SELECT run, dataset, bin, count(*) AS n, avg(score) AS conf, avg(lab) AS acc FROM rt GROUP BY run, dataset, bin),
ec AS (SELECT run, dataset, CAST(sum(n) AS BIGINT) AS num_samples,
        sum(CASE WHEN bin IS NOT NULL THEN n * abs(conf - acc) ELSE 0 END) / sum(n) AS ece FROM bins GROUP BY run, dataset),
po AS (SELECT run, dataset, avg(ent) AS mean_entropy, avg(mx) AS mean_maxprob,
        avg(sent) - avg(ent) AS temp_sensitivity, avg(mg) AS mean_margin, var_pop(mg) AS var_margin
       FROM rt GROUP BY run, dataset),
res AS (SELECT nd.*, ec.num_samples, ec.ece, po.mean_entropy, po.mean_maxprob, po.temp_sensitivity,
        po.mean_margin, po.var_margin FROM nd JOIN ec USING (run, dataset) JOIN po USING (run, dataset)),
runs AS (SELECT DISTINCT l_returnflag AS run FROM lineitem),
ds(dataset) AS (VALUES {_DS_SQL}),
expct AS (SELECT run, dataset FROM runs, ds)"""


@register("leaderboard", sql=_LB_SQL + """
SELECT COALESCE(res.run, expct.run) AS run, COALESCE(res.dataset, expct.dataset) AS dataset,
  res.num_queries, ROUND(res.ndcg5, 6) AS ndcg5, ROUND(res.ndcg10, 6) AS ndcg10,
  res.num_samples, ROUND(res.ece, 6) AS ece, ROUND(res.mean_entropy, 6) AS mean_entropy,
  ROUND(res.mean_maxprob, 6) AS mean_maxprob, ROUND(res.temp_sensitivity, 6) AS temp_sensitivity,
  ROUND(res.mean_margin, 6) AS mean_margin, ROUND(res.var_margin, 6) AS var_margin,
  CASE WHEN res.run IS NULL THEN 'no scores' END AS error
FROM res FULL OUTER JOIN expct ON res.run = expct.run AND res.dataset = expct.dataset""")
def q_leaderboard(spark, sf_dir):
    lb = runs.evaluate_runs(_scores(spark, sf_dir), _pairs(spark, sf_dir),
                            join_keys=("run", "dataset", *KEY), expected=_expected(spark, sf_dir),
                            num_labels=2, label_max=3, tie=KEY)
    return lb.select("run", "dataset", "num_queries", r6("ndcg5"), r6("ndcg10"), "num_samples",
                     r6("ece"), r6("mean_entropy"), r6("mean_maxprob"), r6("temp_sensitivity"),
                     r6("mean_margin"), r6("var_margin"), "error")


_PARTIAL_SQL = _LB_SQL.replace(
    f"WITH p AS ({fx.probs_sql(2)})", f"""WITH p AS (SELECT * REPLACE (
      CASE WHEN l_orderkey % 7 = 0 THEN [0.0, 1.0] ELSE t END AS t) FROM ({fx.probs_sql(2)})
      WHERE l_returnflag_skip = 0)""").replace(
    "WHERE l_returnflag_skip = 0", "WHERE NOT (run = 'R' AND l_orderkey % 10 = 0)")


@register("leaderboard_partial", sql=_PARTIAL_SQL + """,
np AS (SELECT l_returnflag AS run, l_linestatus AS dataset, count(*) AS np,
         count(*) FILTER (NOT (l_returnflag = 'R' AND l_orderkey % 10 = 0)) AS ns
       FROM lineitem GROUP BY ALL)
SELECT COALESCE(np.run, expct.run) AS run, COALESCE(np.dataset, expct.dataset) AS dataset, res.num_samples,
  CASE WHEN ns = np THEN ROUND(res.ndcg10, 6) END AS ndcg10, CASE WHEN ns = np THEN ROUND(res.ece, 6) END AS ece,
  CASE WHEN ns = np THEN ROUND(res.mean_margin, 6) END AS mean_margin,
  CASE WHEN ns = np THEN ROUND(res.var_margin, 6) END AS var_margin,
  CASE WHEN res.run IS NULL THEN 'no scores' WHEN ns <> np
       THEN 'rows differ: ' || ns || ' scores, ' || np || ' pairs, ' || res.num_samples || ' matched' END AS error
FROM expct FULL OUTER JOIN np ON np.run = expct.run AND np.dataset = expct.dataset
LEFT JOIN res ON res.run = np.run AND res.dataset = np.dataset""")
def q_leaderboard_partial(spark, sf_dir):
    """Zero probabilities in every run, and one run that lacks a tenth of its scores."""
    p = _scores(spark, sf_dir).where(~((F.col("run") == "R") & (F.col("l_orderkey") % 10 == 0)))
    zero = F.array(F.lit(0.0), F.lit(1.0))
    p = p.withColumn("probs", F.when(F.col("l_orderkey") % 7 == 0, zero).otherwise(F.col("probs")))
    lb = runs.evaluate_runs(p, _pairs(spark, sf_dir), join_keys=("run", "dataset", *KEY), expected=_expected(spark, sf_dir),
                            num_labels=2, label_max=3, tie=KEY)
    return lb.select("run", "dataset", "num_samples", r6("ndcg10"), r6("ece"), r6("mean_margin"), r6("var_margin"), "error")


_INCREMENTAL_SQL = _LB_SQL.replace("SELECT *, exp(z0", "SELECT rw.*, exp(z0") + f""",
d AS (SELECT run, dataset, least(greatest(t[1], 1e-8), 1 - 1e-8) AS a0, least(greatest(t[2], 1e-8), 1 - 1e-8) AS a1,
        least(greatest(s[1], 1e-8), 1 - 1e-8) AS b0, least(greatest(s[2], 1e-8), 1 - 1e-8) AS b1 FROM p),
l AS (SELECT run, dataset, avg(a0 * (ln(a0) - ln(b0)) + a1 * (ln(a1) - ln(b1))) AS rkl,
        avg(b0 * (ln(b0) - ln(a0)) + b1 * (ln(b1) - ln(a1))) AS fkl FROM d GROUP BY run, dataset)
SELECT ec.run, ec.dataset, ec.num_samples, ROUND(ec.ece, 6) AS ece, ROUND(mean_entropy, 6) AS mean_entropy,
  ROUND(temp_sensitivity, 6) AS temp_sensitivity, ROUND(mean_margin, 6) AS mean_margin, ROUND(var_margin, 6) AS var_margin,
  ROUND(fkl, 6) AS loss_fkl, ROUND(rkl, 6) AS loss_rkl, CAST({fx.WORLD_SIZE} AS BIGINT) AS shards, CAST(0 AS BIGINT) AS unseen
FROM ec JOIN po USING (run, dataset) JOIN l USING (run, dataset)"""


@register("incremental_report", sql=_INCREMENTAL_SQL)
def q_incremental(spark, sf_dir):
    """Shards of scores come in two lots, the second one first; one shard comes
    again after it was scored wrongly.  The report is that of all rows."""
    p = fx.probs(spark, sf_dir, 2).withColumn("shard", (F.col("l_orderkey") % fx.WORLD_SIZE).cast("int"))
    p = p.withColumn("rel", (F.col("l_linenumber") % 4).cast("double")).withColumn("score", F.get("t", 1))
    store = f"{ensure_checkpoint_dir(spark)}/states-{uuid.uuid4().hex}"
    how = {"score": "score", "label": "rel", "probs": "t", "num_labels": 2, "label_max": 3, "teacher": "s"}
    incremental.add_shards(p.where("shard >= 3"), store, **how)
    wrong = p.where("shard = 1").withColumn("t", F.reverse("t"))
    incremental.add_shards(wrong, store, **how)
    incremental.add_shards(p.where("shard < 3"), store, **how)
    left = incremental.unseen_shards(p.select("run", "dataset", "shard").distinct(), store).count()
    states = incremental.read_states(spark, store)
    shards = states.groupBy("run", "dataset").agg(F.countDistinct("shard").alias("shards"))
    out = incremental.state_report(states).join(shards, ["run", "dataset"])
    return out.select("run", "dataset", "num_samples", r6("ece"), r6("mean_entropy"), r6("temp_sensitivity"), r6("mean_margin"),
                      r6("var_margin"), r6("loss_fkl"), r6("loss_rkl"), "shards", F.lit(left).cast("long").alias("unseen"))


@register("pending_grid", sql=f"""WITH runs AS (SELECT DISTINCT l_returnflag AS run FROM lineitem),
ds(dataset) AS (VALUES {_DS_SQL}),
grid AS (SELECT run, dataset FROM runs, ds),
done AS (SELECT DISTINCT l_returnflag AS run, l_linestatus AS dataset FROM lineitem WHERE l_returnflag = 'R'),
avail AS (SELECT DISTINCT l_linestatus AS dataset FROM lineitem)
SELECT run, dataset FROM grid
WHERE (run, dataset) NOT IN (SELECT (run, dataset) FROM done)
  AND dataset IN (SELECT dataset FROM avail)""")
def q_pending_grid(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    grid = runs.evaluation_grid(li.select(F.col("l_returnflag").alias("run")), DATASETS)
    done = li.where(F.col("l_returnflag") == "R").select(
        F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("dataset"))
    avail = li.select(F.col("l_linestatus").alias("dataset"))
    return runs.pending(grid, done, avail)


def _paths(li):
    path = F.concat(F.lit("/ckpt/"), F.lower("l_returnflag"), F.lit("7b_distill/checkpoint-"),
                    ((F.col("l_orderkey") % 8) * 100).cast("string"))
    spec = F.concat(F.lit("ds"), F.col("l_linestatus"), F.lit(":/data/"), F.col("l_linestatus"),
                    F.lit("/test.jsonl"))
    return li.select(path.alias("path"), spec.alias("spec")).distinct()


@register("name_tags", sql="""WITH p AS (SELECT DISTINCT
  '/ckpt/' || lower(l_returnflag) || '7b_distill/checkpoint-' || CAST((l_orderkey % 8) * 100 AS VARCHAR) AS path,
  'ds' || l_linestatus || ':/data/' || l_linestatus || '/test.jsonl' AS spec FROM lineitem),
n AS (SELECT path, spec, string_split(path, '/') AS parts FROM p)
SELECT path, spec, parts[-1] AS run_name,
  CASE WHEN len(parts) >= 2 AND parts[-2] <> '' THEN parts[-2] ELSE parts[-1] END AS teacher,
  upper(split_part(CASE WHEN len(parts) >= 2 AND parts[-2] <> '' THEN parts[-2] ELSE parts[-1] END, '_', 1)) AS teacher_size,
  regexp_extract(spec, '^([^:]*):(.*)$', 1) AS spec_tag, regexp_extract(spec, '^([^:]*):(.*)$', 2) AS spec_path
FROM n""")
def q_name_tags(spark, sf_dir):
    p = _paths(fx.table(spark, sf_dir, "lineitem"))
    tag, path = split_spec("spec")
    return p.select("path", "spec", run_name("path").alias("run_name"),
                    teacher_name("path").alias("teacher"),
                    teacher_size(teacher_name("path")).alias("teacher_size"),
                    tag.alias("spec_tag"), path.alias("spec_path"))


@register("polarization_trend", sql=f"""WITH p AS ({fx.probs_sql(2)}),
q AS (SELECT run, t[1] / (t[1] + t[2]) AS q0, t[2] / (t[1] + t[2]) AS q1 FROM p),
r AS (SELECT run,
  avg(-(least(greatest(q0, 1e-12), 1.0) * ln(least(greatest(q0, 1e-12), 1.0))
       + least(greatest(q1, 1e-12), 1.0) * ln(least(greatest(q1, 1e-12), 1.0)))) AS mean_entropy,
  avg(ln(q1) - ln(q0)) AS mean_margin, var_pop(ln(q1) - ln(q0)) AS var_margin
  FROM q GROUP BY run),
s AS (SELECT *, CASE WHEN lag(run) OVER (ORDER BY run) IS NULL THEN NULL ELSE COALESCE(
  mean_entropy < lag(mean_entropy) OVER (ORDER BY run) AND mean_margin > lag(mean_margin) OVER (ORDER BY run)
  AND var_margin > lag(var_margin) OVER (ORDER BY run), false) END AS sharper FROM r)
SELECT run AS teacher_size, ROUND(mean_entropy, 6) AS mean_entropy, ROUND(mean_margin, 6) AS mean_margin,
  ROUND(var_margin, 6) AS var_margin, sharper,
  COALESCE(min(CAST(sharper AS INTEGER)) OVER () = 1, true) AS trend_holds FROM s""")
def q_polarization_trend(spark, sf_dir):
    rep = sharpness.polarization(fx.probs(spark, sf_dir, 2), "t", 2, by=("run",)) \
        .withColumnRenamed("run", "teacher_size")
    tr = sharpness.polarization_trend(rep, "teacher_size")
    return tr.select("teacher_size", r6("mean_entropy"), r6("mean_margin"), r6("var_margin"),
                     "sharper", "trend_holds")
