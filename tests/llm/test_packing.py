import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairlab.llm import packing
from pairlab.llm.common import table, tokenizer_path
from tests.conftest import SF001
from tests.llm.cases import no_docs, odd_docs


def ids_of(text):
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def valid(rows, capacity=packing.CAPACITY):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_pieces_hold_the_tokenizers_ids(spark):
    docs = table(spark, SF001, "documents").select("doc_id", "text").limit(60).union(spark.createDataFrame(
        [(-1, "a <|endoftext|> b"), (-2, "x" * 5000 + " 北京" * 3000), (-3, "")], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {}
    for r in packing.pieces_of(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids, pieces = ids_of(text), sorted(got[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["start"] for r in pieces] == list(np.cumsum([0] + [r["length"] for r in pieces])[:-1])
        assert sum(r["length"] for r in pieces) == len(ids) and all(r["length"] == 2048 for r in pieces[1:])
        for r in pieces:
            part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())


def test_long_runs_of_blanks(spark):
    texts = ["a" + " " * 1_000_000 + "b", "\n" * 3_000_000, " \n\t\r" * 300_000 + "end", "\u00a0\u2003" * 600_000,
             " " * packing.BLANK_RUN, "x" + " " * (packing.BLANK_RUN - 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in packing.pieces_of(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts):
        ids = ids_of(text)
        assert sum(r["length"] for r in got[i]) == len(ids)
        for r in got[i]:
            part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())


def test_whole_table_is_packed_tightly(spark):
    rows = packing.pack(table(spark, SF001, "documents")).collect()
    bins = valid(rows)
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)
    assert len(bins) == -(-sum(r["length"] for r in rows) // 2048)


def test_local_search_empties_bins():
    # best fit opens a third bin for 5 + 5; exchanging 6 and 5 + ... leaves room
    bins = {(7, 2): 4, (6, 3): 4, (4,): 4}
    before = sum(bins.values())
    after = packing.local_search(bins, capacity=10)

    def items(b):
        out = {}
        for pattern, n in b.items():
            for x in pattern:
                out[x] = out.get(x, 0) + n
        return out

    def squares(b):
        return sum(n * sum(p) ** 2 for p, n in b.items())
    assert items(after) == items(bins) and all(sum(p) <= 10 for p in after)
    assert squares(after) > squares(bins) and sum(after.values()) < before


@pytest.mark.parametrize("low, high", [(150, 300), (100, 230)])
def test_search_leaves_no_exchange(low, high):
    lengths, n = np.unique(np.random.default_rng(1).integers(low, high + 1, 5000), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist()))
    greedy = packing.best_fit(counts, 512)
    bins = packing.local_search(greedy, 512)
    used = {}
    for pattern, k in bins.items():
        for x in pattern:
            used[x] = used.get(x, 0) + k
    assert used == counts and sum(bins.values()) < 0.99 * sum(greedy.values())
    open_ = [p for p in bins if sum(p) < 512]
    for a in open_:
        gives = {*a, *(a[i] + a[j] for i in range(len(a)) for j in range(i))}
        for b in open_:
            if sum(b) >= sum(a) and (a != b or bins[a] > 1):
                room = 512 - sum(b)
                assert not any(0 < x <= room for x in a)
                assert not any(0 < x - y <= room for x in gives for y in b)


@pytest.mark.parametrize("seed", range(3))
def test_plan_is_near_the_bound(seed):
    draw = np.random.default_rng(seed)
    lengths, n = np.unique(draw.integers(1, 700, 5000), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist()))
    bins = packing.local_search(packing.best_fit(counts))
    used = {}
    for pattern, k in bins.items():
        for x in pattern:
            used[x] = used.get(x, 0) + k
    assert used == counts
    assert sum(bins.values()) <= -(-sum(k * c for k, c in counts.items()) // 2048) + 1


def test_a_length_shared_by_most_pieces(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    bins = valid(packing.pack(docs).collect())
    assert len(bins) == -(-3000 * len(ids_of("same text")) // 2048)


def test_odd_and_empty_tables(spark):
    rows = packing.pack(odd_docs(spark)).collect()
    valid(rows)
    assert sum(r["piece"] == 0 for r in rows) == 12
    assert sum(r["length"] == 1 for r in rows if r["piece"] == 0) == 3
    assert packing.pack(no_docs(spark)).count() == 0
