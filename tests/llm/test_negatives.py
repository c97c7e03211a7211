import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlab.llm import negatives, queries
from pairlab.llm.common import table
from tests.conftest import SF001

NO_ID = negatives.NO_ID
ROWS = "id long, label int, vec array<double>"


def by_hand(rows, positives=5, negatives_=10, least=30, most=90, every=100):
    """All scores of all anchors in whole numbers."""
    kept = []
    for i, label, vec in rows:
        if label is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        kept.append((NO_ID if i is None else i, label,
                     [int(max(-1e100, min(1e100, np.floor(256.0 * x)))) for x in vec]))
    out = []
    for a in sorted({(i, label, tuple(v)) for i, label, v in kept if i != NO_ID and i % every == 0}):
        scored = [(min(max(sum(x * y for x, y in zip(a[2], v)), -1 << 63), (1 << 63) - 1), i, label) for i, label, v in kept]
        order = sorted(scored, key=lambda r: (-r[0], r[1]))
        for p, pid, _ in [r for r in order if r[2] == a[1] and r[1] != a[0]][:positives]:
            fit = [r for r in order if r[2] != a[1] and least * p <= 100 * r[0] <= most * p][:negatives_]
            out += [(a[0], None if pid == NO_ID else pid, k, None if n == NO_ID else n, p, s)
                    for k, (s, n, _) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, ROWS).withColumn("score", F.lit("x")).withColumn("n", F.lit(1)).repartition(5)
    got = negatives.hard_negatives(df, F.col("id") % options.pop("every", 100) == 0, **options)
    return sorted([tuple(r) for r in got.collect()], key=repr)


def some_rows(n, dims, seed, clusters=6, hot=0):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(clusters, dims))
    rows = []
    for i in range(n):
        v = centre[draw.integers(clusters)] + draw.normal(size=dims) * draw.choice([0.1, 1.0])
        v /= np.linalg.norm(v)
        rows.append((i, int(draw.integers(4)), [float(x) for x in (centre[0] / 9 if i < hot else v)]))
    return rows


@pytest.mark.parametrize("dims", [3, 64, 100])
def test_same_as_a_full_search(spark, dims):
    rows = some_rows(700, dims, dims)
    want = by_hand(rows)
    assert want and mined(spark, rows) == want


def test_batches_and_hot_vectors(spark, monkeypatch):
    rows = some_rows(600, 20, 4, hot=250)  # equal scores: the smaller id comes first
    want = by_hand(rows, every=40)
    assert want and mined(spark, rows, every=40, batch=4) == want
    monkeypatch.setattr(negatives, "BLOCK", 50)
    monkeypatch.setattr(negatives, "ROWS", 90)
    assert mined(spark, rows, every=40, batch=16) == want


def test_intervals_hold_every_score():
    draw = np.random.default_rng(8)
    for dims in (5, 64, 130):
        vecs = np.floor(draw.normal(size=(300, dims)) * draw.choice([1, 40, 3000], size=(300, 1)))
        words, along, left = negatives.code(vecs)
        rows = pa.table({"id": pa.array(range(300), pa.int64()), "label": pa.array([0] * 300, pa.int64()), "vec": vecs.tolist(),
                         "norm": np.linalg.norm(vecs, axis=1), "codes": [w.tobytes() for w in words],
                         "along": along.tolist(), "left": left.tolist()})
        coded = negatives._Coded(rows)
        q = coded.part(slice(0, 20))
        exact = q.vec @ coded.vec.T
        assert np.allclose(negatives.rotated(q.vec) @ negatives.rotated(coded.vec).T, exact, atol=1e-6 * np.abs(exact).max())
        spread = []
        whole = np.full((20, 1), negatives.LEAST), np.full((20, 1), negatives.MOST)
        search = negatives.Search(q, True, 1, *whole)
        a, estimate, off = np.arange(20)[:, None], 0.0, 0.0
        for level in range(negatives.LEVELS):
            counts = sum(np.bitwise_count(search.planes[:, None, j] & coded.words[None, :, level]).sum(axis=2, dtype=np.int64) << j
                         for j in range(negatives.PLANES))
            dot = search._along_signs(a, counts, coded.ones[None, :, level])
            estimate = estimate + coded.along[None, :, level] * dot
            width = search._width(a, dot, coded.along[None, :, level], coded.left[None, :, level], coded.norm[None, :], off,
                                  coded.words.shape[2] * 64)
            off = off + np.abs(coded.along[None, :, level]) * search.off[a]
            assert (np.abs(exact - estimate) <= width).all()
            spread.append(float((width / (q.norm[:, None] * coded.norm[None, :] + 1e-9)).mean()))
        assert spread == sorted(spread, reverse=True) and spread[-1] < 0.3 < spread[0] < 0.75


def test_odd_rows(spark):
    rows = some_rows(250, 9, 6)
    rows += [(300, None, [1.0] * 9), (400, 1, None), (500, 1, [1.0, None]), (600, 1, [float("nan")]), (700, 1, [float("-inf")]),
             (800, 2, []), (900, 2, [0.5]), (None, 1, [0.3] * 9), (None, 2, [0.3] * 9), (1000, 0, [1e30, -1e30] + [0.0] * 7),
             (1001, 0, [1e300] * 9), (1003, 1, [-1e25, 1e-300] + [0.0] * 7), (1100, 3, [3e7] * 9), (1101, 3, [3e7] * 8 + [7.0])]
    rows += [rows[100], rows[100], rows[150], rows[150], (200, 2, [0.25] * 9), (200, 2, [-0.25] * 9)]
    dims = max(len(r[2] or []) for r in rows)
    want = by_hand([(i, label, v + [0.0] * (dims - len(v)) if v is not None else v) for i, label, v in rows], every=50)
    assert mined(spark, rows, every=50) == want


def test_few_rows_and_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0])]) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 2, [0.5])]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5])]) == [(0, 1, 1, 2, 65536, 32768)]


def test_query_has_every_anchor(spark):
    rows = queries.op12_mine_negatives(spark, SF001).collect()
    moved = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"])
             for r in table(spark, SF001, "embeddings").collect()]
    assert sorted([tuple(r) for r in rows], key=repr) == by_hand(moved)
