import random

import pytest

from pairlab.llm import substring
from pairlab.llm.common import table
from tests.conftest import SF001
from tests.llm.cases import no_docs, odd_docs


def by_hand(rows, window=20):
    """``rows`` of (id, text) to sorted (id, words, removed, kept)."""
    first = {}
    place = [((i is None, i or 0), (t or "").encode().split()) for i, t in rows]
    for i, w in place:
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, ((True, 1 << 62), 0)), (i, s))
    out = []
    for (i, w), (doc_id, _) in zip(place, rows):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (i, s):
                gone.update(range(s, s + window))
        out.append((doc_id, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def check(spark, rows, **settings):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]))
           for r in substring.remove_repeats(df.repartition(3), **settings).collect()]
    assert sorted(got, key=repr) == by_hand(rows)
    return got


def random_docs(seed, n=60):
    """Shared passages at every alignment and length around the window, runs and self-repeats."""
    draw = random.Random(seed)
    passages = [[f"p{k}_{i}" for i in range(draw.choice((18, 19, 20, 21, 25, 40, 70)))] for k in range(12)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(draw.randrange(0, 6)):
            w += [f"u{draw.randrange(10**9)}" for _ in range(draw.randrange(0, 15))]
            p = draw.choice(passages)
            w += p[draw.randrange(3):len(p) - draw.randrange(3)]
        if i % 11 == 0:
            w += ["same"] * 45
        rows.append((i * 7 % 61, " \n".join(w)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    check(spark, random_docs(seed), chunk_bytes=1 << 11)


def test_one_chunk_and_many_give_the_same(spark):
    rows = random_docs(9)
    assert sorted(check(spark, rows)) == sorted(check(spark, rows, chunk_bytes=500))


def test_passage_in_most_documents(spark):
    passage = " ".join(f"lic{i}" for i in range(60))
    got = check(spark, [(i, f"a{i} b{i} {passage} c{i}") for i in range(400)], chunk_bytes=1 << 12)
    assert sum(r[2] == 60 for r in got) == 399


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF001, "documents").collect()]
    assert sum(r[2] for r in check(spark, rows, chunk_bytes=1 << 16)) > 0


def test_odd_and_empty_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs(spark).collect()]
    check(spark, rows)
    twenty = " ".join(f"w{i}" for i in range(20))
    check(spark, [(1, twenty), (1, twenty), (None, twenty), (None, twenty), (2, twenty + " " + twenty)])
    assert substring.remove_repeats(no_docs(spark)).count() == 0
