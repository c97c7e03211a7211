"""Smaller operators: bounded merge, report rounding, count check, sharding, batching."""

import pytest
from pyspark.sql import functions as F

from pairlab.operators import merge, shards
from pairlab.operators.evaluate import assert_same_count, join_scores, round_py


def test_bounded_merge_equals_unbounded(spark):
    pairs = spark.range(100).select(F.col("id").alias("global_idx"),
                                    F.concat(F.lit("q"), F.col("id").cast("string")).alias("query"),
                                    F.lit("t").alias("title"), F.lit("p").alias("passage"),
                                    (F.col("id") % 4).cast("string").alias("label"))
    scores = spark.range(20, 60).select(F.col("id").alias("global_idx"),
                                        F.create_map(F.lit("0"), F.lit(0.25), F.lit("1"), F.lit(0.75)).alias("probs"))
    a = merge.merge_soft_labels(pairs, scores, bounded=False).orderBy("global_idx").collect()
    b = merge.merge_soft_labels(pairs, scores, bounded=True).orderBy("global_idx").collect()
    assert a == b and len(a) == 40
    assert a[0]["teacher_probs"] == '{"0":0.25,"1":0.75}'
    miss = merge.missing_pairs(pairs, scores).count()
    assert miss == 60


def test_round_py_matches_python(spark):
    vals = [0.12345, 1.00005, 2.675, 0.125, -0.5, 1e-10, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(round_py("x", 4)).collect()]
    assert got == [None if v is None else round(v, 4) for v in vals]


def test_count_check_and_positional_join(spark):
    a = spark.range(5).withColumnRenamed("id", "global_idx")
    b = spark.range(5).select(F.col("id").alias("global_idx"), (F.col("id") * 2).alias("s"))
    assert assert_same_count(a, b) == 5
    assert join_scores(a, b).count() == 5
    with pytest.raises(ValueError):
        assert_same_count(a, b.where("global_idx < 3"))


def test_contiguous_and_strided_shards(spark):
    df = spark.range(10).withColumnRenamed("id", "global_idx")
    strided = [r["rank"] for r in shards.with_shard(df, 3).orderBy("global_idx").collect()]
    assert strided == [i % 3 for i in range(10)]
    contig = [r["rank"] for r in shards.with_shard(df, 3, "contiguous").orderBy("global_idx").collect()]
    assert contig == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]
    batches = [r["batch"] for r in shards.with_batch(df, 4).orderBy("global_idx").collect()]
    assert batches == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_seeded_shuffle_independent_of_partitioning(spark):
    df = spark.range(200).withColumnRenamed("id", "global_idx")
    a = [r[0] for r in shards.seeded_shuffle(df, 7, "global_idx").collect()]
    b = [r[0] for r in shards.seeded_shuffle(df.repartition(11), 7, "global_idx").collect()]
    c = [r[0] for r in shards.seeded_shuffle(df, 8, "global_idx").collect()]
    assert a == b and a != c and sorted(a) == list(range(200))


def test_union_and_duplicates(spark):
    s1 = spark.createDataFrame([(0, 0.1), (1, 0.2)], "global_idx long, w double")
    s2 = spark.createDataFrame([(1, 0.3)], "global_idx long, w double")
    u = merge.union_shards([s1, s2])
    assert u.count() == 3
    assert [r["global_idx"] for r in merge.duplicate_indexes(u).collect()] == [1]


def test_result_store_skips_done(spark, tmp_path):
    from pairlab.operators import runs
    store = str(tmp_path / "store")
    grid = runs.evaluation_grid(spark.createDataFrame([("r1",), ("r2",)], "run string"), ["d1", "d2"])
    assert runs.pending(grid, runs.done_combinations(spark, store)).count() == 4
    res = spark.createDataFrame([("r1", "d1", 0.5), ("r2", "d1", 0.6)], "run string, dataset string, ndcg10 double")
    runs.write_results(res, store)
    pend = sorted(tuple(r) for r in runs.pending(grid, runs.done_combinations(spark, store)).collect())
    assert pend == [("r1", "d2"), ("r2", "d2")]
    runs.write_results(spark.createDataFrame([("r1", "d1", 0.9)], "run string, dataset string, ndcg10 double"), store)
    back = {(r["run"], r["dataset"]): r["ndcg10"] for r in spark.read.parquet(store).collect()}
    assert back == {("r1", "d1"): 0.9, ("r2", "d1"): 0.6}
