import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlab.functions.dist import divergence
from pairlab.operators import evaluate, fullrank, incremental, runs


def scored(spark, n=600, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        p, t = draw.random(), draw.random()
        probs = [0.0, 0.0] if i % 50 == 7 else None if i % 50 == 9 else [1 - p, p]
        rows.append((draw.choice("ab"), draw.choice(["x", "y"]), i % 5, i, float(draw.randrange(2)), p if i % 40 else float("nan"),
                     probs, None if i % 30 == 1 else [1 - t, t]))
    return spark.createDataFrame(rows, "run string, dataset string, shard int, global_idx long, rel double, score double, "
                                       "probs array<double>, teacher array<double>").repartition(7)


HOW = {"score": "score", "label": "rel", "probs": "probs", "num_labels": 2, "teacher": "teacher"}


def table(df):
    return {(r["run"], r["dataset"]): r for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for c in a[k].asDict():
            x, y = a[k][c], b[k][c]
            assert x == y or abs(x - y) < 1e-9, (k, c, x, y)


def test_report_equals_one_pass_in_any_order(spark, tmp_path):
    df, path = scored(spark), str(tmp_path / "store")
    whole = table(incremental.state_report(incremental.evaluation_states(df, **HOW)))
    available = df.select("run", "dataset", "shard").distinct()
    assert incremental.unseen_shards(available, path).count() == available.count()
    incremental.add_shards(df.where("shard = 3"), path, **HOW)
    incremental.add_shards(df.where("shard = 0").withColumn("score", F.lit(0.9)), path, **HOW)  # scored wrongly
    left = {tuple(r) for r in incremental.unseen_shards(available, path).collect()}
    assert left == {tuple(r) for r in available.where("shard NOT IN (0, 3)").collect()}
    for s in (4, 0, 2, 1):
        incremental.add_shards(df.where(F.col("shard") == s), path, **HOW)
    states = incremental.read_states(spark, path)
    same(table(incremental.state_report(states)), whole)
    # merging in steps changes nothing
    half = incremental.merge_states(states.where("shard < 2")).unionByName(incremental.merge_states(states.where("shard >= 2")))
    same(table(incremental.state_report(half)), whole)


def test_report_matches_plain_formulas(spark):
    df = scored(spark)
    got = table(incremental.state_report(incremental.evaluation_states(df, **HOW)))
    losses = df.where("probs IS NOT NULL AND teacher IS NOT NULL").groupBy("run", "dataset").agg(
        *[F.avg(divergence("teacher", "probs", 2, k)).alias(k) for k in ("jsd", "fkl", "rkl", "hard")])
    for k, r in table(losses).items():
        for kind in ("jsd", "fkl", "rkl", "hard"):
            assert abs(got[k][f"loss_{kind}"] - r[kind]) < 1e-9
    rows = {}
    for r in df.collect():
        rows.setdefault((r["run"], r["dataset"]), []).append(r)
    for k, group in rows.items():
        margins = [np.log(min(max(p[1], 1e-12), 1)) - np.log(min(max(p[0], 1e-12), 1)) for p in (r["probs"] for r in group) if p and sum(p)]
        assert got[k]["num_samples"] == len(group) and got[k]["num_without_mass"] == len(group) - len(margins)
        assert abs(got[k]["mean_margin"] - np.mean(margins)) < 1e-9 and abs(got[k]["var_margin"] - np.var(margins)) < 1e-9


def test_empty_store_and_no_rows(spark, tmp_path):
    none = scored(spark).limit(0)
    assert incremental.state_report(incremental.evaluation_states(none, **HOW)).count() == 0
    incremental.add_shards(none, str(tmp_path / "s"), **HOW)
    assert incremental.unseen_shards(scored(spark).select("run", "dataset", "shard").distinct(), str(tmp_path / "s")).count() > 0


def test_unmatched_scores_are_counted_from_the_join(spark):
    df = scored(spark).drop("shard", "teacher").where("run = 'a'").withColumn("probs", F.array(F.lit(0.4), F.lit(0.6)))
    pairs = df.where("global_idx % 10 <> 0").select("dataset", "global_idx", F.lit("q").alias("qid"), "rel").distinct()
    board = table(runs.evaluate_runs(df.drop("rel"), pairs, num_labels=2))
    assert all(r["error"].startswith("rows differ") and r["ndcg10"] is None for r in board.values())


@pytest.mark.parametrize("parts", [1, 9])
def test_full_rank_of_hot_and_null_queries(spark, parts):
    draw = random.Random(2)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"q{i % 40}", i, draw.choice([0.5, 1.0, float("nan"), None, draw.random()]))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "qid string, global_idx long, score double").repartition(parts)
    want = {}
    for q in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == q]
        bad = [r for r in mine if r[2] is None or r[2] != r[2]]
        good = sorted((r for r in mine if r not in bad), key=lambda r: (-r[2], r[1]))
        # null and NaN: last; among them by score descending (NaN first), then index
        bad.sort(key=lambda r: (r[2] is None, r[1]))
        want |= {r[1]: k for k, r in enumerate([*good, *bad], 1)}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = fullrank.full_rank(df)
        assert {r["global_idx"]: r["rank"] for r in out.collect()} == want
        ranges = df.repartitionByRange("qid", F.isnan("score"), F.col("score").desc(), "global_idx").rdd.glom().map(len).collect()
        assert max(ranges) < 600  # the hot query, 61 % of the rows, is in many ranges
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert fullrank.full_rank(df.limit(0)).count() == 0


def test_rounding_is_pythons(spark):
    draw = np.random.default_rng(4)
    n = 200_000
    near = (draw.integers(-10**6, 10**6, n) + 0.5) / 10.0 ** draw.integers(0, 8, n)  # decimals that end in 5
    x = np.concatenate([near, np.nextafter(near, np.inf), draw.normal(size=n), draw.normal(size=n) * 10.0 ** draw.integers(-9, 18, n),
                        np.frombuffer(draw.bytes(8 * n)), [0.0, -0.0, 0.5, 1.5, 2.5, -0.5, 2.675, 1.005, np.inf, -np.inf, 2.0**52 + 1, -1e-300]])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    out = df.select("x", *[evaluate.round_py("x", dp).alias(f"r{dp}") for dp in (0, 4, 6)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    got = out.toPandas()
    for dp in (0, 4, 6):
        want = np.array([round(v, dp) if np.isfinite(v) else v for v in got["x"].tolist()])
        have = got[f"r{dp}"].to_numpy()
        same_bits = (want == have) & (np.signbit(want) == np.signbit(have)) | np.isnan(want) & np.isnan(have)
        assert same_bits.all(), [(v, a, b) for v, a, b in zip(got["x"][~same_bits], want[~same_bits], have[~same_bits])][:5]
    assert spark.createDataFrame([(None,)], "x double").select(evaluate.round_py("x", 4).alias("r")).first()["r"] is None
