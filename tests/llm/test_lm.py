import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.llm import lm, substring
from pairlab.llm.common import table
from tests.conftest import SF001
from tests.llm.cases import no_docs, odd_docs


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def check_base(rows, docs):
    counts = Counter()
    for i, t in docs:
        if zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in docs:
        w = tokens(t)
        held = zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
        want.append((i is None, i or 0, held, len(w), sum(x in counts for x in w), n,
                     round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
            round(r["base_score"], 6)) for r in rows]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("chunk_bytes", [1 << 15, 1 << 24])
def test_base_score_matches_brute_force(spark, chunk_bytes):
    docs = table(spark, SF001, "documents")
    rows = lm.score_texts(docs, chunk_bytes=chunk_bytes).collect()
    check_base(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_model_beats_base_on_held_out_texts(spark):
    rows = lm.score_texts(table(spark, "/root/testdata/sf0.01", "documents")).filter("held_out").agg(
        F.sum("score").alias("model"), F.sum("base_score").alias("base")).first()
    assert rows["model"] > rows["base"]


def test_filter_counts(spark):
    draw = np.random.default_rng(2)
    keys = draw.integers(0, 1 << 62, 20_000).astype(np.uint64)
    counts = np.minimum(draw.zipf(1.5, len(keys)), 1 << 20)
    data, bits = lm.build_segment(lm.word_items(keys), counts, most_bits=1 << 30)
    bloom = lm.Filter([(0, data.tobytes(), bits)], 1)
    zero = np.zeros(len(keys), np.int64)
    got = bloom.counts(lm.word_items(keys), zero)
    exact = lm.level_value(lm.levels(counts))
    assert (got >= exact).all() and (got == exact).mean() > 0.95  # never below, seldom above
    other = bloom.counts(lm.word_items(keys ^ np.uint64(1 << 63)), zero)
    assert (other > 0).mean() < 0.05


def test_a_full_segment_keeps_the_most_frequent():
    keys = np.arange(1, 10_001, dtype=np.uint64)
    counts = np.where(keys <= 100, 50, 1)
    data, bits = lm.build_segment(lm.word_items(keys), counts, most_bits=8192)
    bloom = lm.Filter([(0, data.tobytes(), bits)], 1)
    got = bloom.counts(lm.word_items(keys), np.zeros(len(keys), np.int64))
    assert bits <= 8192 and (got[:100] >= 32).all() and (got[100:] > 0).mean() < 0.1


def test_a_bounded_segment_is_filled_up():
    keys = np.arange(1, 10_001, dtype=np.uint64)
    counts = np.where(keys <= 100, 50, 1)
    data, bits = lm.build_segment(lm.word_items(keys), counts, most_bits=8192)
    got = lm.Filter([(0, data.tobytes(), bits)], 1).counts(lm.word_items(keys), np.zeros(len(keys), np.int64))
    assert bits == 8192 and (got[100:] > 0).sum() >= 1024 - 600  # the other entries go to n-grams seen once


def test_scores_hold_every_ngram_in_any_batches(spark, monkeypatch):
    docs = table(spark, SF001, "documents")
    texts = [(r["doc_id"], tokens(r["text"])) for r in docs.collect()]
    monkeypatch.setattr(substring, "BUCKET_BYTES", 1 << 16)
    runs = [{r["doc_id"]: r["score"] for r in lm.score_texts(docs, chunk_bytes=1 << 16, batch_bytes=size).collect()}
            for size in (1 << 30, 1 << 17, 1)]
    got = runs[0]
    assert runs[1] == got and runs[2] == got
    words, pairs = Counter(), Counter()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            words.update(t)
            pairs.update(zip(["", *t], t))
    n_texts, all_ = words[None], sum(words.values()) + len(words) + 1

    def count(c):
        return float(lm.level_value(lm.levels(np.array([c])))[0])

    def score(t):
        total = 0.0
        for u, w in zip(["", *t], t):
            before = count(n_texts if u == "" else words[u])
            total += math.log10((min(count(pairs[u, w]), before) + lm.MU * (count(words[w]) + 1) / all_) / (before + lm.MU))
        return total
    off = np.array([abs(got[i] - score(t)) / len(t) for i, t in texts])
    assert np.median(off) < 0.02 and off.mean() < 0.05  # only what the filter overstates


def test_batches_are_bounded():
    sizes = [(3, 5), (1, 4), (2, 6), (9, 50), (10, 1)]
    assert lm.batches_of(sizes, 10) == [[1, 2], [3], [9], [10]] and lm.batches_of([], 10) == []


def test_texts_that_occur_twice_score_higher(spark):
    docs = table(spark, SF001, "documents").select("doc_id", "text").filter("length(text) > 400")
    twice = docs.filter("doc_id % 10 = 0")
    once, more = ({r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score_texts(d, held_out=F.lit(False)).collect()}
                  for d in (docs, docs.unionByName(twice.withColumn("doc_id", F.col("doc_id") + 1_000_000))))
    rise = {i: more[i] - once[i] for i in once}
    marked = [v for i, v in rise.items() if i % 10 == 0]
    others = [v for i, v in rise.items() if i % 10]
    assert np.median(marked) > 0.05 and abs(np.median(others)) < 0.02
    assert np.mean([m > np.quantile(others, 0.9) for m in marked]) > 0.8


def test_seen_pairs_score_higher(spark):
    train = [(i, "red fox runs fast") for i in range(40)] + [(100, "red fox runs fast"), (101, "fast runs fox red")]
    docs = spark.createDataFrame(train, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score_texts(docs, held_out=F.col("doc_id") >= 100).collect()}
    assert got[100]["base_score"] == pytest.approx(got[101]["base_score"]) and got[100]["score"] > got[101]["score"]


def test_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    check_base(lm.score_texts(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert lm.score_texts(no_docs(spark)).count() == 0
    none = lm.score_texts(docs, held_out=F.lit(True)).collect()
    assert len(none) == 12 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] <= 0 for r in none)
