import re

from pyspark.sql import functions as F

from pairlab.operators import ranking, runs


def rows_of(spark, n=300):
    rows = [(f"r{i % 2}", None if i % 11 == 0 else f"d{i % 3}", i, None if i % 7 == 0 else i % 5, float(i % 4), ((i * 37) % 100) / 100) for i in range(n)]
    df = spark.createDataFrame(rows, "run string, dataset string, global_idx long, qid int, rel double, s double")
    return df.withColumn("score", F.when(F.col("s") < 0.9, F.col("s"))).withColumn("probs", F.expr("array(1 - s, s)"))


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_values_are_those_with_counts_and_need_no_join(spark):
    df, keys = rows_of(spark), ["run", "dataset", "qid"]
    many = ranking.ndcg_per_query(df, by=keys[:2])
    alone = ranking.ndcg_values(df, by=keys[:2])
    cols = [*keys, *[c for c in many.columns if c.startswith("ndcg")]]
    assert alone.columns == cols
    got, want = (sorted(map(repr, d.select(cols).collect())) for d in (alone, many))
    assert got == want and len(got) == df.select(keys).distinct().count()
    assert "Join" not in plan(alone) and plan(alone).count("FileScan") + plan(alone).count("Scan ExistingRDD") == 1


def test_sorts_begin_with_the_column_that_tells_rows_apart(spark):
    df = rows_of(spark)
    ranks = re.findall(r"Window \[row_number\(\) .*?\], \[(\w+)#", plan(ranking.ndcg_values(df, by=("run", "dataset"))))
    assert ranks == ["qid"]
    pairs = df.select("dataset", "global_idx", "qid", "rel").hint("merge")
    board = runs.evaluate_runs(df.drop("qid", "rel"), pairs, materialize=False)
    joins = re.findall(r"SortMergeJoin \[(\w+)#", plan(board))
    assert joins and set(joins) <= {"global_idx", "run", "dataset"} and "global_idx" in joins
    assert not re.search(r"SortMergeJoin \[dataset#\d+L?, global_idx", plan(board))
