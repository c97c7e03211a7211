import math
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from pairlab.llm import quality
from pairlab.llm.common import table
from tests.conftest import SF001
from tests.llm.cases import no_docs, odd_docs


def word_hashes(text):
    return [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def grams(hashes):
    """Buckets of words, then of (word, word before), chained as Spark chains its hash columns."""
    out = [h % quality.BUCKETS for h in hashes]
    for before, h in zip([None, *hashes], hashes):
        seed = xxhash.xxh64(struct.pack("<Q", h), seed=42).intdigest()
        out.append((seed if before is None else xxhash.xxh64(struct.pack("<Q", before), seed=seed).intdigest()) % quality.BUCKETS)
    return out


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set()
    covered = {i + k for i, w in enumerate(windows) if w in many for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def counts_of(rows):
    return [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows]


def test_counts_and_scores_match_brute_force(spark):
    docs, labels = table(spark, SF001, "documents"), table(spark, SF001, "labels")
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == docs.count()
    texts = [r["row"]["text"] for r in rows]
    assert counts_of(rows) == [by_hand(t) for t in texts]
    trusted = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["toxic"] == 0}
    corpus, good = [0] * quality.BUCKETS, [0] * quality.BUCKETS
    all_grams = [grams(word_hashes(t)) for t in texts]
    for r, g in zip(rows, all_grams):
        for b in g:
            corpus[b] += 1
            good[b] += r["row"]["doc_id"] in trusted
    share = sum(good) / sum(corpus)
    weight = [round(quality.SCALE * math.log((g + 20) / (c * share + 20))) for g, c in zip(good, corpus)]
    for r, g in zip(rows, all_grams):
        score = sum(weight[b] for b in g) / (quality.SCALE * len(g)) if g else 0.0
        assert r["score"] == pytest.approx(score, abs=1e-9)
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and score >= quality.THRESHOLD)


def test_labelled_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.judge(table(spark, sf, "documents"), table(spark, sf, "labels")).filter("NOT base_failed").select(
        F.col("row.doc_id").alias("doc_id"), "kept").join(table(spark, sf, "labels"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert all(good) and len(good) > 100 and sum(junk) <= 0.05 * len(junk)


def test_a_filter_on_the_verdict_keeps_the_plan_small(spark):
    docs, labels = table(spark, SF001, "documents"), table(spark, SF001, "labels")
    kept = quality.judge(docs, labels).filter("kept").select("row.*")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert kept.columns == docs.columns and plan.count("split(") <= 2 and "from_json" not in plan
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_and_empty_tables(spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.judge(odd_docs(spark), labels).collect()
    assert len(rows) == 12
    short = [r for r in rows if r["n_words"] < 3000]
    assert counts_of(short) == [by_hand(r["row"]["text"]) for r in short] and all(r["base_failed"] for r in short)
    assert quality.judge(no_docs(spark), labels).count() == 0
    none = quality.judge(table(spark, SF001, "documents"), labels.limit(0)).agg(F.min("score"), F.max("score")).first()
    assert tuple(none) == (0.0, 0.0)


def test_repeats_at_every_place(spark):
    texts = ["a b c a b c", "a a a a a", "x a b c y a b c z", "a b c d a b c d a b", "a b", "a b c", "q " + "u v w " * 40]
    rows = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                         spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert counts_of(rows) == [by_hand(r["row"]["text"]) for r in rows]
