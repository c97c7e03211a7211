"""Edge cases of files, metrics and jobs: what must raise, and what must not vanish."""

import json

import pytest
from pyspark.sql import functions as F

from pairlab import jobs
from pairlab.functions import dist
from pairlab.operators import evaluate, learn, merge, runs, sharpness
from pairlab.sources.lines import given_order, read_indexed
from pairlab.sources.pairs import read_parquet_tree
from pairlab.sources.scores import read_score_shards, read_scores, read_scores_tolerant, write_scores

HEADER = "global_idx\tall_digit_scores\toutput_texts\tweighted_scores\n"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def executed_scans(df):
    """File scans in the final adaptive plan, each exchange counted once."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0].count("FileScan")


def test_index_beyond_64_bits_is_bad_not_fatal(spark, tmp_path):
    path = write(tmp_path / "s.tsv", HEADER + "99999999999999999999\t{'0': 1.0}\tx\t1\n1\t{'0': 1.0}\tx\t1\n")
    got = {r["line_idx"]: r["status"] for r in read_scores_tolerant(spark, path).collect()}
    assert got == {1: "bad_index", 2: "ok"}


def test_columns_are_found_by_header(spark, tmp_path):
    three = write(tmp_path / "c.tsv", "global_idx\tall_digit_scores\tweighted_scores\n0\t\"{\"\"0\"\": 0.25}\"\t0.75\n")
    turned = write(tmp_path / "t.tsv", "weighted_scores\toutput_texts\tglobal_idx\tall_digit_scores\n0.5\tyes\t1\t{'0': 0.5}\n")
    rows = {r["global_idx"]: r for r in read_scores(spark, [three, turned]).collect()}
    assert rows[0]["weighted_scores"] == 0.75 and rows[0]["output_texts"] is None
    assert rows[1]["weighted_scores"] == 0.5 and rows[1]["output_texts"] == "yes"
    bad = write(tmp_path / "b.tsv", "all_digit_scores\tweighted_scores\n{}\t1\n")
    with pytest.raises(ValueError):
        read_scores(spark, bad)
    with pytest.raises(Exception):
        read_scores(spark, write(tmp_path / "n.tsv", HEADER + "0\t{'0': 1.0}\tx\tbad\n")).collect()


def test_small_and_quoted_shards(spark, tmp_path):
    prefix = str(tmp_path / "res.tsv")
    write(tmp_path / "res.tsv.rank0.tmp", HEADER + "0\t{'0': 1.0}\t\"two\nlines\"\t1\n")  # under 100 bytes
    write(tmp_path / "res.tsv.rank1.tmp", HEADER)
    rows = read_score_shards(spark, prefix, 2).collect()
    assert [(r["global_idx"], r["output_texts"], r["rank"]) for r in rows] == [(0, "two\nlines", 0)]
    missing = jobs.merge_shards(spark, prefix, 2, str(tmp_path / "out"))
    assert [r["rank"] for r in missing.collect()] == [1]


def test_few_scans_per_file_set(spark, tmp_path):
    path = write(tmp_path / "s.tsv", HEADER + "".join(f"{i}\t{{'0': 1.0}}\tx\t1\n" for i in range(50)))
    assert executed_scans(read_indexed(spark, [path, path])) <= 2
    assert executed_scans(read_scores_tolerant(spark, path)) <= 2


def test_given_order_of_paths(spark):
    files = ["file:///d/b.tsv", "file:/d/a%20b.tsv", "hdfs://h:9/d/sub/x", "file:///d/bb.tsv"]
    df = spark.createDataFrame([(f,) for f in files], "p string")
    got = [r[0] for r in df.select(given_order(F.col("p"), ["/d/a b.tsv", "hdfs://h:9/d/sub", "/d/b.tsv"])).collect()]
    assert got == [2, 0, 1, 3]


def test_parquet_tree_by_uri(spark, tmp_path):
    spark.range(3).selectExpr("id", "'q' AS query").write.parquet(str(tmp_path / "tree" / "in" / "deep"))
    assert read_parquet_tree(spark, f"file://{tmp_path}/tree", ["query"]).count() == 3
    assert read_parquet_tree(spark, str(tmp_path / "tree" / "in" / "deep")).count() == 3


def test_null_label_raises_and_absent_label_is_zero(spark, tmp_path):
    scores = write(tmp_path / "s.tsv", HEADER + "0\t{'0': 1.0}\tx\t1\n1\t{'0': 1.0}\tx\t1\n")
    absent = write(tmp_path / "a.jsonl", '{"query": "q"}\n{"query": "r", "label": 2}\n')
    jobs.merge_to_soft_labels(spark, absent, scores, str(tmp_path / "soft"))
    got = spark.read.parquet(str(tmp_path / "soft")).collect()
    assert [(r["query"], r["label"], r["title"]) for r in got] == [("q", 0, ""), ("r", 2, "")]
    null = write(tmp_path / "n.jsonl", '{"query": "q", "label": null}\n{"query": "r", "label": 2}\n')
    with pytest.raises(Exception, match="null label"):
        jobs.merge_to_soft_labels(spark, null, scores, str(tmp_path / "soft2"))


def test_evaluation_columns_raise(spark):
    df = spark.createDataFrame([("q", None, "0.5")], "qid string, label string, s string")
    with pytest.raises(Exception, match="null label"):
        evaluate.eval_columns(df, "qid", "label", "s").collect()
    with pytest.raises(Exception):
        evaluate.eval_columns(df.withColumn("label", F.lit("1")).withColumn("s", F.lit("bad")), "qid", "label", "s").collect()


def test_ndcg_job_reads_its_own_scores(spark, tmp_path):
    n = 40
    write(tmp_path / "d.jsonl", "".join(json.dumps({"qid": i % 4, "label": i % 3}) + "\n" for i in range(n)))
    scores = spark.range(n).select(F.col("id").alias("global_idx"), F.create_map(F.lit("0"), F.lit(1.0)).alias("probs"),
                                   F.lit('a "tab\t').alias("output_text"), (F.col("id") / n).alias("weighted_score"))
    write_scores(scores.repartition(4), str(tmp_path / "scores"))
    tables = jobs.ndcg_tables(spark, str(tmp_path / "scores"), str(tmp_path / "d.jsonl"))
    assert tables["summary"].first()["num_queries"] == 4
    write_scores(scores.limit(n - 1), str(tmp_path / "short"))
    with pytest.raises(ValueError, match="rows differ"):
        jobs.ndcg_tables(spark, str(tmp_path / "short"), str(tmp_path / "d.jsonl"))


def test_zero_probabilities_stay_finite(spark):
    df = spark.createDataFrame([([0.0, 1.0],), ([0.5, 0.5],)], "p array<double>")
    r = sharpness.polarization(df, "p", 2).first()
    assert r["num_samples"] == 2 and r["mean_margin"] > 10
    hard = dist.divergence(F.array(F.lit(1.0), F.lit(0.0)), F.col("p"), 2, "hard")
    assert all(row[0] is not None for row in df.select(hard).collect())


def test_run_without_mass_and_with_missing_rows(spark):
    schema = "run string, dataset string, global_idx long, probs array<double>"
    scores = spark.createDataFrame([("a", "d", 0, [0.0, 0.0]), ("a", "d", 1, [0.4, 0.6]), ("b", "d", 0, [0.4, 0.6])], schema)
    pairs = spark.createDataFrame([("d", 0, "q", 1.0), ("d", 1, "q", 0.0)], "dataset string, global_idx long, qid string, rel double")
    board = {r["run"]: r for r in runs.evaluate_runs(scores, pairs).collect()}
    assert board["a"]["error"] == "1 rows without probability mass" and board["a"]["mean_maxprob"] == pytest.approx(0.6)
    assert board["b"]["error"] == "rows differ: 1 scores, 2 pairs, 1 matched" and board["b"]["ece"] is None


def test_trend_orders_sizes_by_number(spark):
    rows = [("32B", 0.1, 3.0, 3.0), ("7B", 0.2, 2.0, 2.0), ("560M", 0.3, 1.0, 1.0)]
    rep = spark.createDataFrame(rows, "teacher_size string, mean_entropy double, mean_margin double, var_margin double")
    assert all(r["trend_holds"] for r in sharpness.polarization_trend(rep).collect())


def test_union_check_unique(spark):
    a, b = spark.range(3).toDF("global_idx"), spark.range(2, 4).toDF("global_idx")
    assert merge.union_shards([a, b]).count() == 5
    with pytest.raises(Exception, match="index in two shards: 2"):
        merge.union_shards([a, b], check_unique="global_idx").collect()
    assert merge.union_shards([a, b.where("global_idx > 2")], check_unique="global_idx").count() == 4


def test_tokens_of_every_script(spark):
    df = spark.createDataFrame([("北京 天气", "北京", ""), ("über café", "über", "x")], "query string, title string, passage string")
    assert [r[0] for r in learn.pair_features(df).select("__overlap").collect()] == [0.5, 0.5]


def test_run_polarization_and_resume_jobs(spark, tmp_path):
    n = 12
    pairs = write(tmp_path / "d.jsonl", "".join(json.dumps({"qid": str(i % 3), "query": "q", "label": i % 2}) + "\n" for i in range(n)))

    def score_file(name, shift):
        body = "".join(f"{i}\t{{'0': {1 - (i + shift) % 10 / 10:.1f}, '1': {(i + shift) % 10 / 10:.1f}}}\tx\t0.5\n" for i in range(n))
        return write(tmp_path / name, HEADER + body)
    a, b = score_file("a.tsv", 1), score_file("b.tsv", 4)
    board = jobs.run_report(spark, {("a", "d"): a, ("b", "d"): b}, {"d": pairs}, str(tmp_path / "runs")).collect()
    assert [(r["run"], r["num_samples"], r["error"], r["data_path"]) for r in board] == [("a", n, None, pairs), ("b", n, None, pairs)]
    trend = jobs.polarization_report(spark, {"/c/7B_x/ck-1": a, "/c/32B_x/ck-1": b}, str(tmp_path / "pol"))
    assert {r["teacher_size"] for r in trend.collect()} == {"7B", "32B"}

    prefix = str(tmp_path / "sh.tsv")
    write(tmp_path / "sh.tsv.rank0.tmp", HEADER + "".join(f"{i}\t{{'0': 1.0}}\told\t0.5\n" for i in range(0, n, 2)))

    def scorer(p):
        return p.select("global_idx", F.create_map(F.lit("0"), F.lit(1.0)).alias("probs"), F.lit("new").alias("output_text"),
                        F.lit(0.25).alias("weighted_score"))
    missing = jobs.resume(spark, pairs, prefix, 2, str(tmp_path / "whole"), scorer)
    assert [r["rank"] for r in missing.collect()] == [1]
    whole = {r["global_idx"]: r["output_texts"] for r in read_scores(spark, str(tmp_path / "whole")).collect()}
    assert whole == {i: "old" if i % 2 == 0 else "new" for i in range(n)}
