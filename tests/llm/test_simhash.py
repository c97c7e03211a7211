import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairlab.llm import simhash
from pairlab.llm.common import table
from tests.conftest import SF001
from tests.llm.cases import no_docs, odd_docs


def by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(codes, distance=3):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1:] ^ codes[i]) <= distance) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(codes))]


def clustered(n_random=1500, n_near=400, seed=1):
    draw = random.Random(seed)
    codes = {draw.getrandbits(64) for _ in range(n_random)}
    centre = draw.getrandbits(64)
    codes |= {centre ^ sum(1 << b for b in draw.sample(range(64), draw.choice((1, 2, 3)))) for _ in range(n_near)}
    walk = draw.getrandbits(64)
    for _ in range(40):  # a chain whose ends are far apart
        walk ^= sum(1 << b for b in draw.sample(range(64), 3))
        codes.add(walk)
    return np.array(sorted(codes | {0, (1 << 64) - 1}), np.uint64)


def gray_sorted(codes, n_groups):
    codes = np.unique(codes)
    group = (codes % np.uint64(n_groups)).astype(np.int64)
    order = np.lexsort((simhash.gray_rank(codes), group))
    return codes[order], group[order]


def test_fingerprints_match_brute_force(spark):
    texts = ["A b", "", None, " \t", "É É É e", "x y z x y z"] + [
        r["text"] for r in table(spark, SF001, "documents").limit(40).collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["f"] for r in simhash.with_fingerprint(df).select("row.doc_id", simhash.hex_digits(F.col("fp")).alias("f")).collect()}
    assert got == {i: f"{by_hand(t):016x}" for i, t in enumerate(texts)}


@pytest.mark.parametrize("blocks,group_rows", [(4, 20_000), (4, 50), (5, 20_000), (6, 100)])
def test_links_connect_what_brute_force_connects(spark, blocks, group_rows):
    codes = clustered()
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    links = simhash.near_links(df, group_rows=group_rows, blocks=blocks).collect()
    at = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    assert all(int(np.bitwise_count(codes[at[r["a"]]] ^ codes[at[r["b"]]])) <= 3 for r in links)
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for r in links:
        a, b = sorted((find(at[r["a"]]), find(at[r["b"]])))
        root[b] = a
    assert [find(i) for i in range(len(codes))] == groups(codes)


def test_groups_cut_by_flushes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FLUSH_ROWS", 64)
    codes = clustered(300, 100, seed=4)
    rows = [(i, int(c)) for i, c in enumerate(codes.view(np.int64))]
    df = spark.createDataFrame(rows, "doc_id long, fp long").coalesce(1)
    got = {r["fp"]: r["component_id"] for r in simhash.components(df).collect()}
    want = groups(codes)
    assert got == {fp: want[i] for i, fp in rows}


def test_gray_order_has_one_bit_steps():
    x = np.arange(1 << 10, dtype=np.uint64)
    by_rank = x[np.argsort(simhash.gray_rank(x))]
    assert (np.bitwise_count(by_rank[1:] ^ by_rank[:-1]) == 1).all()


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_tree_nodes_hold_what_their_codes_share(fan):
    codes, group = gray_sorted(np.concatenate([clustered(300, 150, seed=s) for s in (2, 3)]), 5)
    tree = simhash.gray_tree(codes, group, fan)
    below = [[i] for i in range(len(codes))]
    for level in tree[1:]:
        below = [sum((below[k] for k in level.kids[a:b]), []) for a, b in zip(level.begin, level.begin[1:])]
        assert sorted(sum(below, [])) == list(range(len(codes)))
        for node, held in enumerate(below):
            assert len(set(group[held])) == 1
            low, high = np.bitwise_and.reduce(codes[held]), np.bitwise_or.reduce(codes[held])
            assert level.shared[node] == ~(low ^ high) and level.pattern[node] == low
        assert len(set(zip(level.group, level.pattern, level.shared))) == len(level.group)  # equal ones are merged
    assert len(tree[-1].group) == len(set(group))


def test_tree_merges_equal_patterns():
    # runs (0, 1), (3, 2) ... in Gray order; the same low bits under the same free high bits meet
    codes, group = gray_sorted(np.array([a << 40 | b for a in range(4) for b in range(4)], np.uint64), 1)
    sizes = [len(level.group) for level in simhash.gray_tree(codes, group, 2)]
    assert sizes[0] == 16 and sizes[-1] == 1
    wide = np.array([0b0000, 0b0011, 0b0001, 0b0010], np.uint64)  # not in Gray order: both runs share nothing of two bits
    assert [len(level.group) for level in simhash.gray_tree(wide, np.zeros(4, np.int64), 2)] == [4, 1]


@pytest.mark.parametrize("distance", [0, 1, 3, 6])
def test_tree_join_finds_every_pair_once(monkeypatch, distance):
    monkeypatch.setattr(simhash, "PAIRS", 64)
    codes, group = gray_sorted(clustered(300, 200, seed=7), 3)
    got = [tuple(sorted(p)) for a, b in simhash.linked_pairs(codes, group, distance) for p in zip(a.tolist(), b.tolist())]
    near = (np.bitwise_count(codes[:, None] ^ codes) <= distance) & (group[:, None] == group)
    assert sorted(got) == [(i, j) for i, j in np.argwhere(near).tolist() if i < j]


def test_table_groups(spark):
    rows = simhash.near_duplicates(table(spark, SF001, "documents")).collect()
    docs = {r["doc_id"]: by_hand(r["text"]) for r in table(spark, SF001, "documents").collect()}
    ids = sorted(docs)
    root = groups(np.array([docs[i] for i in ids], np.uint64))
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: ids[root[k]] for k, i in enumerate(ids)}


def test_one_of_each(spark):
    kept = simhash.one_of_each(odd_docs(spark))
    rows = kept.collect()
    assert kept.columns == odd_docs(spark).columns
    # five texts of the six-word kind, five without words, and near long ones: one row each
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows)[:2] == [(False, 0), (False, 1)]
    assert len([r for r in rows if r["text"] and r["text"].startswith("one two")]) == 1
    assert simhash.one_of_each(no_docs(spark)).count() == 0
    same = spark.createDataFrame([(3, "p q r s")] * 9, "doc_id long, text string")
    assert simhash.one_of_each(same).count() == 1


def test_odd_and_empty_tables(spark):
    rows = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(rows) == 12 and all(r["component_id"] is not None for r in rows)
    assert simhash.near_duplicates(no_docs(spark)).count() == 0
    lone = spark.createDataFrame([(None, "p q r")], "doc_id long, text string")
    assert simhash.near_duplicates(lone).first()["component_id"] is None
