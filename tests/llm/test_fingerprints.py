import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlab.llm import fingerprints as fp
from pairlab.llm.common import table
from tests.conftest import SF001
from tests.llm.cases import no_docs, odd_docs

GEAR = fp._gear()


def chunks(text):
    return fp.chunk_set(text, GEAR)


def slow_ends(raw):
    """The cuts byte by byte, with the hash over the last 32 bytes of the text."""
    def h(i):
        return sum(int(GEAR[raw[i - j]]) << j for j in range(min(32, i + 1))) & 0xFFFFFFFF
    ends, start = [], 0
    while len(raw) - start > fp.LEAST:
        end = min(start + fp.MOST, len(raw))
        for i in range(start + fp.LEAST - 1, end - 1):
            bits = fp.HARD_BITS if i + 1 < start + fp.NORMAL else fp.EASY_BITS
            if h(i) >> (32 - bits) == 0:
                end = i + 1
                break
        ends.append(end)
        start = end
    return ends + [len(raw)] * (start < len(raw))


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdeéfgh", k=draw.randrange(1, 9))) for _ in range(n))


@pytest.mark.parametrize("text", ["", "x", "short", "a" * 700, prose(1, 400), "北京😀" * 60])
def test_cuts_match_a_slow_version(text):
    raw = text.encode()
    assert fp.chunk_ends(np.frombuffer(raw, np.uint8), GEAR) == slow_ends(raw)


def test_insertions_leave_far_chunks_alone():
    text = prose(2, 3000)
    for place in (0, len(text) // 2, len(text) - 5):
        edited = text[:place] + "INSERTED " + text[place:]
        assert fp.likeness(chunks(text), chunks(edited)) > 0.97
    assert fp.likeness(chunks(text), chunks(prose(3, 3000))) < 0.05
    whole, part = chunks(text), chunks(text[:len(text) // 3])
    assert fp.likeness(part, whole) > 0.95 and 0.25 < fp.likeness(whole, part) < 0.4
    assert fp.parse(fp.fingerprint(whole)) == whole


def by_hand(rows):
    """Rows by descending id (null last), ties by the order of the results; edited texts of each."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = chunks(text), chunks(edited), chunks(after)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.fingerprint(a), fp.fingerprint(b),
                    fp.likeness(a, b), fp.likeness(a, c)))
    return out


@pytest.mark.parametrize("part_bytes", [1 << 14, 1 << 30])
def test_table_matches_brute_force(spark, part_bytes):
    docs = table(spark, SF001, "documents")
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = fp.edited_neighbours(docs, part_bytes=part_bytes).collect()
    assert sorted(map(tuple, got)) == sorted(by_hand(rows))
    near = [r for r in got if r["n_chars"] > 500]
    assert sum(r["near_edited"] > r["near_next"] for r in near) > 0.95 * len(near)


def test_odd_and_empty_tables(spark):
    for part_bytes in (1 << 12, 1 << 30):
        got = fp.edited_neighbours(odd_docs(spark), part_bytes=part_bytes).collect()
        assert len(got) == 12 and sorted(r["n_chars"] for r in got)[:4] == [0, 0, 0, 1]
        first = next(r for r in got if r["doc_id"] == 8)
        long, text = chunks("x"), odd_docs(spark).filter("doc_id = 7").first()["text"]
        assert first["near_edited"] > 0.4 and long and first["fingerprint"] != fp.fingerprint(chunks(text))
        assert len({r["fingerprint"] for r in got if r["n_chars"] == 0}) == 1
    lone = fp.edited_neighbours(odd_docs(spark).filter("doc_id = 5")).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1.0
    assert fp.edited_neighbours(no_docs(spark)).count() == 0


def test_ranges_start_at_their_heads(spark):
    draw = random.Random(6)
    rows = [(draw.choice([None, 7, 7, draw.randrange(-500, 500), -2**63, 2**63 - 1]), f"t {k % 90}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    heads = fp.range_heads(docs, 20)
    assert 10 < len(heads) <= 20 and heads == sorted(set(heads))
    keys = [fp._place(r["k"]["none"], r["k"]["down"], r["k"]["tag"]) for r in
            docs.withColumn("tag", F.xxhash64("text")).select(fp._key().alias("k")).collect()]
    assert heads[0] == min(keys) and set(heads) <= set(keys)
    none, down, tag = map(pd.Series, zip(*keys))
    got = next(fp._ranges_of(heads)(iter([(none, down, tag)])))
    for key, parts in zip(keys, got):
        part = sum(h <= key for h in heads) - 1
        assert parts == ([part, (part - 1) % len(heads)] if key in heads else [part])
    assert fp.range_heads(docs.limit(0), 1) == []


def test_equal_and_null_ids_in_many_ranges(spark):
    rows = [(draw_id, f"{'same' if k % 3 else k} words of text {k % 40}") for k in range(300) for draw_id in (None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, hashed[r[1]]))
    got = fp.edited_neighbours(docs, part_bytes=500).collect()
    assert len(fp.range_heads(docs, 30)) > 15
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, by_hand(ordered)))


def test_fingerprint_column(spark):
    rows = fp.with_fingerprint(odd_docs(spark)).collect()
    assert [r["fingerprint"] for r in rows] == [fp.fingerprint(chunks(r["row"]["text"])) for r in rows]
