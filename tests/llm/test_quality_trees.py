import random
import zlib
from collections import Counter
from math import log1p, log2

import numpy as np
from pyspark.sql import functions as F

from pairlab.llm import quality_trees as qt
from pairlab.llm import queries
from pairlab.llm.common import table
from tests.conftest import SF001
from tests.llm.cases import LONG, no_docs, odd_docs

SF01 = "/root/testdata/sf0.01"


def by_hand(text):
    """The statistics, word by word."""
    raw = (text or "").encode()
    words = raw.split()
    n, k = max(len(raw), 1), max(len(words), 1)
    letters = [b for b in raw if bytes([b]).isalpha()]
    capital = [b for b in raw if 65 <= b <= 90]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = list(zip(words, words[1:], words[2:]))
    often, found = Counter(words), Counter(triples)

    def share(kind):
        return sum(b in kind for b in raw) / n

    def of_words(test):
        return sum(map(test, words)) / k

    def all_capitals(w):
        a = [b for b in w if bytes([b]).isalpha()]
        return len(a) > 1 and all(65 <= b <= 90 for b in a)
    return [log1p(len(raw)), log1p(len(words)), sum(map(len, words)) / k, share(b"0123456789"), len(capital) / max(len(letters), 1),
            share(qt.SYMBOLS), share(qt.SENTENCE) * n / k, share(qt.COMMAS) * n / k, share(b"!") * n / k,
            sum(b > 127 for b in raw) / n, sum(b in b"aeiouAEIOU" for b in raw) / max(len(letters), 1), share(b" \t\n\x0b\x0c\r"),
            -sum(c / n * log2(c / n) for c in Counter(raw).values()), of_words(lambda w: len(w) <= 2), of_words(lambda w: len(w) >= 15),
            of_words(lambda w: 65 <= w[0] <= 90), of_words(all_capitals), of_words(lambda w: any(48 <= b <= 57 for b in w)),
            of_words(lambda w: w[-1] in qt.SENTENCE), of_words(lambda w: w[-1] in qt.SYMBOLS), log1p(max(map(len, words), default=0)),
            len(often) / k, max(often.values(), default=0) / k, sum(c for c in found.values() if c > 1) / k,
            log1p(len(words) / max(len(lines), 1)), (len(lines) - len(set(lines))) / max(len(lines), 1)]


TEXTS = ["", None, " \n", "a", "The cat. The cat. THE CAT!! a1 b2\nthe cat\nthe cat\n\n", "é北😀 x# $5 ABC\tD", "x" * 1000, LONG,
         "one two three one two three one two three", "\0 \x7f ~~ =="]


def test_statistics_match_a_plain_version(monkeypatch):
    draw = random.Random(3)
    texts = TEXTS + ["".join(draw.choices("aAbé1.!# \n", k=draw.randrange(400))) for _ in range(200)]
    want = np.array([by_hand(t) for t in texts], np.float32)
    assert want.shape[1] == len(qt.STATISTICS)
    assert np.allclose(qt.statistics(texts), want, atol=1e-5)
    for name, size in (("PART", 16), ("BLOCK_PARTS", 3), ("GROUP", 100)):
        monkeypatch.setattr(qt, name, size)
    assert np.allclose(qt.statistics(texts), want, atol=1e-5)
    assert qt.statistics([]).shape == (0, len(qt.STATISTICS))


def test_flat_forest_is_the_trees_walked_one_by_one():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 6)).astype(np.float32)
    x[:, 2] = np.round(x[:, 2])  # ties
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] >= 1) | (draw.random(3000) < 0.05)).astype(float)
    forest = qt.fit_forest(x[:2000], y[:2000], trees=30)
    p = forest.scores(x)
    for i in range(0, 3000, 97):
        total = forest.base
        for t in range(30):
            node = 0
            while 2 * node + 1 < forest.value.shape[1]:
                node = 2 * node + 1 + int(x[i, forest.statistic[t, node]] > forest.threshold[t, node])
            total += forest.value[t, node]
        assert abs(1 / (1 + np.exp(-total)) - p[i]) < 1e-12
    assert ((p[2000:] > 0.5) == y[2000:]).mean() > 0.9
    losses = [-np.mean(np.where(y[:2000] > 0, np.log(q), np.log1p(-q)))
              for q in (qt.fit_forest(x[:2000], y[:2000], trees=k).scores(x[:2000]) for k in (0, 5, 30))]
    assert losses == sorted(losses, reverse=True)


def test_a_split_is_the_best_of_all():
    draw = np.random.default_rng(2)
    x, y = draw.normal(size=(500, 3)).astype(np.float32), draw.integers(0, 2, 500).astype(float)
    forest = qt.fit_forest(x, y, trees=1, depth=1)
    p = 1 / (1 + np.exp(-forest.base))
    g, h = y - p, np.full(500, p * (1 - p))

    def gain(feature, cut):
        left = x[:, feature] <= cut
        if min(left.sum(), (~left).sum()) < qt.LEAF_ROWS:
            return 0.0
        return sum(g[s].sum() ** 2 / (h[s].sum() + qt.RIDGE) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + qt.RIDGE)
    best = max(gain(f, c) for f, e in enumerate(qt.bin_edges(x)) for c in e)
    assert np.isclose(gain(forest.statistic[0, 0], forest.threshold[0, 0]), best)


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in queries.op13_score_quality(spark, SF01).collect()}
    docs = table(spark, SF01, "documents")
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in table(spark, SF01, "labels").collect()}
    asked = [(rows[i]["predicted"], q) for i, q in truth.items() if rows[i]["held_out"]]
    assert len(asked) > 50 and sum(a == q for a, q in asked) / len(asked) > 0.95
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels = table(spark, SF001, "documents"), table(spark, SF001, "labels")
    turned = labels.withColumn("quality", F.when(qt.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one = qt.fit(docs, labels)
    two = qt.fit(docs.drop("lang", "source").repartition(5), turned.drop("toxic").repartition(3))
    assert len(one.value) and all((getattr(one, k) == getattr(two, k)).all() for k in ("statistic", "threshold", "value"))
    a, b = (sorted((r["doc_id"], r["score"]) for r in qt.score(d, one).select("row.doc_id", "score").collect())
            for d in (docs, docs.repartition(7).withColumn("score", F.lit("x"))))
    assert a == b


def test_bound_on_learned_rows(spark):
    docs, labels = table(spark, SF001, "documents"), table(spark, SF001, "labels")
    train = qt.labelled(docs.union(docs), labels.union(labels), 40)
    assert train.count() == 40 and train.select("doc_id").distinct().count() == 40
    assert train.filter(qt.is_held_out(F.col("doc_id"))).count() == 0


def test_odd_and_empty_tables(spark):
    labels = spark.createDataFrame([(0, 1), (4, 0), (5, None), (None, 1), (6, 1), (6, 0), (99, 0)], "doc_id long, quality int")
    forest = qt.fit(odd_docs(spark), labels)
    rows = qt.score(odd_docs(spark), forest).collect()
    assert {r["row"]["rank"] for r in rows} == set(range(12)) and all(0 < r["score"] < 1 for r in rows)
    assert len({r["score"] for r in rows if not (r["row"]["text"] or "").strip()}) >= 1
    assert qt.score(no_docs(spark), forest).count() == 0
    none = qt.fit(no_docs(spark), labels.limit(0))
    assert {r["score"] for r in qt.score(odd_docs(spark), none).collect()} == {0.5}
