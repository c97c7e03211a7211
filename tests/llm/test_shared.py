import random

import numpy as np
from pyspark.sql import functions as F

from pairlab.llm.common import from_planes, hashed_words, numbered, planes, saved
from pairlab.llm.graph import connected_components
from pairlab.session import scratch_scope
from tests.llm.cases import LONG


def test_hashed_words_match_split():
    texts = ["a bb a", None, "", " \t x", "é y z", "q" * 400_000 + " tail", LONG]
    hashes, counts = hashed_words(texts, block=1 << 12)
    words = [w for t in texts for w in (t or "").encode().split()]
    assert counts.tolist() == [len((t or "").encode().split()) for t in texts]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes.tolist()))
    assert len(set(seen.values())) == len(seen)
    assert hashed_words(["A b"], lower=True)[0].tolist() == hashed_words(["a", "B"], lower=True)[0].tolist()


def test_planes_round_trip():
    for dtype in (np.uint32, np.uint64, np.int64):
        a = np.arange(100, dtype=dtype) * 77
        assert (from_planes(planes(a), dtype) == a).all() and len(from_planes(planes(a[:0]), dtype)) == 0


def test_numbered_is_a_global_order(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k").repartition(7)
    assert all(r["n"] == r["k"] for r in numbered(df, F.col("k").asc()).collect())


def test_components_match_union_find(spark):
    draw = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    edges += [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(60)] + [(500, 500)]
    root = list(range(600))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_saved_tables_follow_the_scope(spark):
    with scratch_scope(spark) as path:
        scope = path.rsplit("/", 1)[1]
        assert all(scope in f for f in saved(spark.range(5)).inputFiles())
    assert scope not in saved(spark.range(5)).inputFiles()[0]
