"""File sources and sinks: positional numbering, tolerant parsing, round trips, jobs."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab import jobs
from pairlab.operators import merge, shards
from pairlab.sources.lines import read_indexed
from pairlab.sources.pairs import detect_keys, read_pairs, read_parquet_tree
from pairlab.sources.scores import (read_score_shards, read_scores, read_scores_tolerant,
                                    shard_files, write_scores)
from pairlab.sources.sinks import write_jsonl, write_soft_labels
from pairlab.functions.parse import decode_probs
from tests import reference_impl as ref


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_read_indexed_many_splits(spark, tmp_path):
    lines = []
    for i in range(5000):
        lines.append("" if i % 97 == 5 else f"line {i} " + "x" * (i % 50))
    a = write(tmp_path / "a.txt", "\n".join(lines[:3000]) + "\n")
    b = write(tmp_path / "b.txt", "\n".join(lines[3000:]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")   # force many splits
    try:
        phys = {r["global_idx"]: r["line"] for r in read_indexed(spark, [str(a), str(b)]).collect()}
        dense = {r["global_idx"]: r["line"] for r in read_indexed(spark, [str(a), str(b)], "dense").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert phys == dict(enumerate(lines))
    assert dense == dict(enumerate([x for x in lines if x.strip()]))


def test_read_pairs_blank_lines_and_absent_keys(spark, tmp_path):
    p = write(tmp_path / "p.jsonl",
              '{"qid": "1", "query": "q", "title": "t", "passage": "p", "label": 2.7}\n'
              '\n'
              '{"qid": "1", "query": "q2", "title": null, "label": "3"}\n')
    phys = read_pairs(spark, str(p), numbering="physical", absent_as_empty=("passage", "title"))
    rows = {r["global_idx"]: r for r in phys.collect()}
    assert rows[1]["is_blank"] and rows[2]["passage"] == "" and rows[2]["title"] is None
    dense = read_pairs(spark, str(p)).collect()
    assert sorted(r["global_idx"] for r in dense) == [0, 1]
    with pytest.raises(Exception):
        read_pairs(spark, str(p), on_blank="fail").collect()
    assert detect_keys(phys) == ("qid", "label")
    with pytest.raises(ValueError):
        detect_keys(phys.select("query"), label_key=None)


SCORE_FILE_1 = (
    "global_idx\tall_digit_scores\toutput_texts\tweighted_scores\n"
    "0\t{'0': 0.2, '1': 0.8}\t1\t0.8\n"
    "\n"
    "1\t{'0': 0.9, '1': 0.1}\t0\t0.1\n"
    "x2\t{'0': 0.5, '1': 0.5}\t0\t0.5\n"
    "3\t[0.5, 0.5]\t0\t0.5\n"
    "4\n"
    "5\t{'0': 0.5, '1': 0.45}\t0\t0.45\n")
SCORE_FILE_2 = (   # columns in another order; re-scores row 1
    "weighted_scores\tglobal_idx\tall_digit_scores\n"
    "0.3\t1\t{\"0\": 0.7, \"1\": 0.3}\n")


def test_tolerant_scan_and_upsert(spark, tmp_path):
    f1 = write(tmp_path / "s1.tsv", SCORE_FILE_1)
    f2 = write(tmp_path / "s2.tsv", SCORE_FILE_2)
    parsed = read_scores_tolerant(spark, [str(f1), str(f2)])
    reasons = {r["status"]: r["count"] for r in parsed.groupBy("status").count().collect()}
    assert reasons == {"ok": 4, "blank": 1, "bad_index": 1, "bad_probs": 1, "too_few_columns": 1}
    latest = {r["global_idx"]: dict(r["probs"])
              for r in merge.latest_by_index(merge.valid_scores(parsed)).collect()}
    assert latest == {0: {"0": 0.2, "1": 0.8}, 1: {"0": 0.7, "1": 0.3}, 5: {"0": 0.5, "1": 0.45}}
    rng = merge.index_range(merge.latest_by_index(merge.valid_scores(parsed))).first()
    assert tuple(rng) == (3, 0, 5)


def test_score_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(2, {"0": 0.25, "1": 0.75}, "1", 0.75), (0, {"0": 1e-05, "1": 0.99999}, "a\"b", 0.99999)],
        "global_idx long, probs map<string,double>, output_text string, weighted_score double")
    out = str(tmp_path / "scores")
    write_scores(df, out)
    files = sorted(os.path.join(out, f) for f in os.listdir(out) if f.endswith(".csv"))
    strict = {r["global_idx"]: dict(r["probs"]) for r in read_scores(spark, files).collect()}
    assert strict == {2: {"0": 0.25, "1": 0.75}, 0: {"0": 1e-05, "1": 0.99999}}
    tol = read_scores_tolerant(spark, files).where("status = 'ok'")
    assert {r["global_idx"] for r in tol.collect()} == {0, 2}


def test_soft_label_and_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("q", "t", "p", 2, {"0": 0.4, "1": 0.6})],
                               "query string, title string, passage string, label int, "
                               "teacher_probs map<string,double>")
    out = str(tmp_path / "soft")
    write_soft_labels(df, out)
    back = spark.read.parquet(out)
    assert [f.name for f in back.schema.fields] == ["query", "title", "passage", "label", "teacher_probs"]
    assert dict(back.select(decode_probs(back, "teacher_probs")).first()[0]) == {"0": 0.4, "1": 0.6}
    jl = str(tmp_path / "jl")
    write_jsonl(df.select("query", "title", "passage", F.col("label").cast("string").alias("label")), jl)
    files = [os.path.join(jl, f) for f in os.listdir(jl) if f.endswith(".json")]
    assert read_pairs(spark, files).first()["query"] == "q"


def test_shards_discovery_and_resume(spark, tmp_path):
    prefix = str(tmp_path / "res.tsv")
    header = "global_idx\tall_digit_scores\toutput_texts\tweighted_scores\n"
    body = {r: "".join(f"{i}\t{{'0': 0.5, '1': 0.5}}\t0\t0.5\n" for i in range(r, 40, 4))
            for r in range(4)}
    write(f"{prefix}.rank0.tmp", header + body[0])
    write(f"{prefix}.rank1.tmp", header + body[1])
    write(f"{prefix}.rank2.tmp", header[:20])            # too small: counts as missing
    meta = {r["rank"]: r["present"] for r in shard_files(spark, prefix, 4).collect()}
    assert meta == {0: True, 1: True, 2: False}
    assert {r["rank"]: r["present"] for r in shard_files(spark, prefix, 4, min_bytes=10**6).collect()} == {0: False, 1: False, 2: False}
    rows = read_score_shards(spark, prefix, 4)
    assert {r["rank"]: r["count"] for r in shards.shard_counts(rows).collect()} == {0: 10, 1: 10}
    missing = shards.missing_ranks(spark, shards.present_ranks(rows), 4)
    assert sorted(r["rank"] for r in missing.collect()) == [2, 3]
    pairs = spark.range(40).withColumnRenamed("id", "global_idx")
    todo = shards.pairs_to_rescore(pairs, missing, 4)
    assert sorted(r[0] for r in todo.collect()) == [i for i in range(40) if i % 4 in (2, 3)]
    tol = read_score_shards(spark, prefix, 4, tolerant=True).where("status = 'ok'")
    assert tol.count() == 20
    out = str(tmp_path / "merged")
    m = jobs.merge_shards(spark, prefix, 4, out)
    assert sorted(r["rank"] for r in m.collect()) == [2, 3]


def test_merge_job_matches_python(spark, tmp_path):
    pairs = ['{"query": "q%d", "title": "t", "passage": "p", "label": %d}' % (i, i % 4) for i in range(12)]
    pairs[3] = ""
    jp = write(tmp_path / "pairs.jsonl", "\n".join(pairs) + "\n")
    header = "global_idx\tall_digit_scores\toutput_texts\tweighted_scores\n"
    lines = [f"{i}\t{{'0': {0.1 * (i % 5):.1f}, '1': {1 - 0.1 * (i % 5):.1f}}}\t0\t0.5" for i in range(0, 12, 1)
             if i not in (7,)]
    lines.append("5\t{'0': 0.3, '1': 0.3}\t0\t0.5")      # later duplicate, low mass
    tp = write(tmp_path / "scores.tsv", header + "\n".join(lines) + "\n")
    out = str(tmp_path / "soft")
    stats = {k: v for k, v in
             jobs.merge_to_soft_labels(spark, str(jp), str(tp), out, filter_invalid=True).items() if v}
    # python model of the merge
    idx = {}
    for ln in lines:
        a, b = ln.split("\t")[:2]
        idx[int(a)] = eval(b)  # noqa: S307 - trusted test literal
    written, skipped, missing = [], 0, 0
    for i, ln in enumerate(pairs):
        if i not in idx:
            missing += 1
            continue
        if not ln.strip() or sum(idx[i].values()) < 0.99:
            skipped += 1
            continue
        written.append(i)
    assert stats == {k: v for k, v in {"written": len(written), "skipped": skipped,
                                       "missing": missing}.items() if v}
    got = spark.read.parquet(out)
    assert sorted(r["query"] for r in got.collect()) == sorted(f"q{i}" for i in written)


def test_ndcg_job_matches_numpy(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 60
    data = [{"qid": f"Ｑ{i % 6}", "label": int(rng.integers(0, 4))} for i in range(n)]
    scores = [float(rng.integers(0, 5)) / 4 for _ in range(n)]
    jp = write(tmp_path / "d.jsonl", "\n".join(json.dumps(d, ensure_ascii=False) for d in data) + "\n\n")
    tp = write(tmp_path / "i.tsv", "global_idx\tall_digit_scores\tweighted_scores\n" +
               "".join(f"{i}\t{{}}\t{s}\n" for i, s in enumerate(scores)))
    t = jobs.ndcg_tables(spark, str(tp), str(jp))
    per_q = {r["qid"]: r["ndcg10"] for r in t["per_query"].collect()}
    groups = {}
    for i, (d, s) in enumerate(zip(data, scores)):
        groups.setdefault(f"q{i % 6}", []).append((i, d["label"], s))
    for q, items in groups.items():
        idx, rels, sc = zip(*items)
        assert per_q[q] == pytest.approx(ref.ndcg(list(rels), list(sc), list(idx), 10))
    assert t["summary"].first()["num_queries"] == 6
    out = str(tmp_path / "report")
    jobs.ndcg_report(spark, str(tp), str(jp), out)
    summ = spark.read.json(f"{out}/summary").first()
    want = round(float(np.mean([ref.ndcg([x[1] for x in it], [x[2] for x in it], [x[0] for x in it], 10)
                                for it in groups.values()])), 4)
    assert summ["ndcg10_mean"] == want


def test_parquet_tree(spark, tmp_path):
    nested = tmp_path / "tree" / "part=1"
    nested.mkdir(parents=True)
    spark.createDataFrame([("q", "t", "p", 1)], "query string, title string, passage string, x int") \
        .write.parquet(str(nested / "f"))
    got = read_parquet_tree(spark, str(tmp_path / "tree"), columns=["query", "passage"])
    assert got.columns == ["query", "passage"] and got.count() == 1
    with pytest.raises(FileNotFoundError):
        read_parquet_tree(spark, str(tmp_path / "empty_missing"))


def test_extract_job(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    spark.createDataFrame([("q1", "t1", "p1", 3), ("", None, "p2", 4)],
                          "query string, title string, passage string, other int") \
        .coalesce(1).write.parquet(str(src / "a.parquet"))
    out = str(tmp_path / "out")
    counts = jobs.extract_to_jsonl(spark, str(src), out)
    per_file = counts.collect()
    assert [r["count"] for r in per_file if r["file_name"]] == [2]
    assert [r["count"] for r in per_file if r["file_name"] is None] == [2]
    files = [os.path.join(out, f) for f in os.listdir(out) if f.endswith(".json")]
    rows = [json.loads(line) for f in files for line in open(f, encoding="utf-8") if line.strip()]
    assert sorted(tuple(r.values()) for r in rows) == [("", "", "p2"), ("q1", "t1", "p1")]


def test_quoted_multiline_text_t17(spark, tmp_path):
    f = write(tmp_path / "m.tsv",
              "global_idx\tall_digit_scores\toutput_texts\tweighted_scores\n"
              "0\t{'0': 0.4, '1': 0.6}\t\"first\nsecond\"\t0.6\n"
              "1\t{'0': 0.7, '1': 0.3}\tplain\t0.3\n")
    tol = read_scores_tolerant(spark, str(f))
    status = {r["line_idx"]: (r["status"], r["global_idx"]) for r in tol.collect()}
    assert status == {1: ("ok", 0), 2: ("bad_index", None), 3: ("ok", 1)}
    strict = read_scores(spark, str(f)).orderBy("global_idx").collect()
    assert [r["output_texts"] for r in strict] == ["first\nsecond", "plain"]
