import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pairlab.operators import coverage, merge, pairstore


def indexes(spark, values):
    return spark.createDataFrame([(v,) for v in values], "global_idx long").repartition(5)


def test_gaps_duplicates_and_resume_set(spark):
    draw = random.Random(1)
    total = 3 * coverage.BUCKET + 1234
    have = [i for i in range(total) if i // coverage.BUCKET != 1 and draw.random() < 0.97]
    scores = indexes(spark, have + have[:50] + [None])
    cover = coverage.coverage(scores)
    s = coverage.coverage_summary(cover).first()
    assert (s["num_records"], s["num_indexes"], s["num_duplicates"]) == (len(have) + 50, len(have), 50)
    assert (s["min_idx"], s["max_idx"]) == (have[0], have[-1])
    missing = sorted(set(range(total)) - set(have))
    runs = sorted(tuple(r) for r in coverage.index_gaps(cover, total).collect())
    assert [i for a, b in runs for i in range(a, b + 1)] == missing
    assert all(b + 1 != c or c % coverage.BUCKET == 0 for (_, b), (c, _) in zip(runs, runs[1:]))
    pairs = spark.range(total).withColumnRenamed("id", "global_idx").unionByName(indexes(spark, [None, total + 9]))
    want = sorted(missing + [total + 9])
    for limit in (coverage.BROADCAST_BYTES, 0):
        got = coverage.uncovered_rows(pairs, cover, broadcast_bytes=limit)
        assert got.columns == ["global_idx"]
        assert sorted((r[0] for r in got.collect()), key=lambda x: (x is None, x)) == [*want, None]
    anti = pairs.join(scores, "global_idx", "left_anti")
    assert anti.count() == len(want) + 1
    both = coverage.merge_coverage(coverage.coverage(scores.where("global_idx < 40000")), coverage.coverage(scores.where("global_idx >= 40000")))
    assert coverage.coverage_summary(both).first() == s


def test_empty_coverage(spark):
    none = coverage.coverage(indexes(spark, []))
    assert coverage.coverage_summary(none).first()["num_records"] == 0
    assert [tuple(r) for r in coverage.index_gaps(none, 10).collect()] == [(0, 9)]
    assert coverage.index_gaps(none, 0).count() == 0
    assert coverage.uncovered_rows(spark.range(3).withColumnRenamed("id", "global_idx"), none).count() == 3


def test_merge_reads_the_store_without_an_exchange(spark, tmp_path):
    pairs = spark.range(200_000).select(F.col("id").alias("global_idx"), F.sha2(F.col("id").cast("string"), 256).alias("query"))
    store = pairstore.write_pair_store(pairs, str(tmp_path / "store"), "store_of_pairs", 4, row_group_bytes=1 << 19)
    try:
        scores = pairs.where("global_idx BETWEEN 120000 AND 125000").select(
            "global_idx", F.create_map(F.lit("0"), F.lit(0.4), F.lit("1"), F.lit(0.6)).alias("probs"))
        # scores as files, so that nothing of the plan is known beforehand
        scores.write.parquet(str(tmp_path / "scores"))
        scores = spark.read.parquet(str(tmp_path / "scores"))
        out = pairstore.merge_with_store(store, scores)
        plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1, plan
        want = {r[0]: r[1] for r in merge.merge_status(pairs, scores).groupBy("status").count().collect()}
        assert {r[0]: r[1] for r in out.groupBy("status").count().collect()} == want
        files = glob.glob(str(tmp_path / "store" / "*.parquet"))
        ranges = [(g.column(0).statistics.min, g.column(0).statistics.max) for f in files
                  for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
        hit = [r for r in ranges if r[0] <= 125000 and r[1] >= 120000]
        assert len(files) == 4 and len(hit) < len(ranges)
        bounded = pairstore.merge_with_store(store, scores, bounded=True)
        assert {r[0]: r[1] for r in bounded.groupBy("status").count().collect()} == {"written": 5001}
        assert "GreaterThanOrEqual(global_idx,120000)" in bounded._jdf.queryExecution().sparkPlan().toString()
        assert pairstore.merge_with_store(store, scores.limit(0), bounded=True).count() == 0
        spark.sql("DROP TABLE store_of_pairs")
        again = pairstore.open_pair_store(spark, str(tmp_path / "store"), "store_of_pairs", 4)
        assert again.count() == 200_000
        plan = pairstore.merge_with_store(again, scores)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.sql("DROP TABLE IF EXISTS store_of_pairs")
