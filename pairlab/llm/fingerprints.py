"""Document fingerprints from content-defined chunks (operator 4).

A gear hash rolls over the UTF-8 bytes; a chunk ends where its high bits are
zero.  Cutting is normalised: below ``NORMAL`` bytes more bits must be zero,
beyond it fewer, so chunk lengths gather around ``NORMAL`` (at least ``LEAST``,
at most ``MOST``).  A boundary depends on the last 32 bytes and on the chunk's
start only, so after an insertion the cuts soon fall in step again and the
chunks behind it keep their digests.

A fingerprint is the set of a text's chunks, written as 12 hexadecimal digits
of digest and 3 of length per chunk, sorted.  Likeness is containment weighted
by length: the bytes of shared chunks over all bytes of the left set.

Defined results: a null or empty text has an empty fingerprint, contained fully
in an empty one and not at all in another; equal texts have equal fingerprints;
in ``edited_neighbours`` rows go by descending id, nulls last, ties by text
hash, and the last is followed by the first; a lone row follows itself; an
empty table gives an empty result.  Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, saved, text_size

LEAST, NORMAL, MOST = 12, 32, 128
HARD_BITS, EASY_BITS = 7, 3
PART_BYTES = 8 << 20  # text of one range, streamed through a task
MAX_PARTS = 100_000  # ranges at most, as each has a key on the driver; beyond 800 GB ranges grow
DIGITS = 15  # of one chunk


def _gear() -> np.ndarray:
    return (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The rolling gear hash after each byte: ``sum(gear[byte j back] << j)`` over 32 bytes.

    Doubles the window five times, so it needs no loop over bytes.
    """
    h = gear[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def chunk_ends(data: np.ndarray, gear: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hashes(data, gear)
    top = h >> np.uint32(32 - HARD_BITS)
    easy = np.flatnonzero(top < (1 << (HARD_BITS - EASY_BITS)))
    hard = (top[easy] == 0).tolist()
    easy = (easy + 1).tolist()  # a chunk ends after its boundary byte
    ends, start, k, many = [], 0, 0, len(easy)
    while n - start > LEAST:
        limit, normal, least = min(start + MOST, n), start + NORMAL, start + LEAST
        end = limit
        while k < many and easy[k] < least:
            k += 1
        while k < many and easy[k] < limit:
            if easy[k] >= normal or hard[k]:
                end = easy[k]
                break
            k += 1
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunk_set(text: str | None, gear: np.ndarray) -> dict[str, int]:
    """Digest-and-length of each distinct chunk, and its length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out, start = {}, 0
    for end in chunk_ends(np.frombuffer(raw, np.uint8), gear):
        digest = hashlib.blake2b(raw[start:end], digest_size=6).hexdigest()
        out[f"{digest}{end - start:03x}"] = end - start
        start = end
    return out


def fingerprint(chunks: dict[str, int]) -> str:
    return "".join(sorted(chunks))


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """How much of ``a`` (by length) is in ``b``."""
    if not a:
        return 0.0 if b else 1.0
    return sum(n for c, n in a.items() if c in b) / sum(a.values())


def parse(fingerprint_: str) -> dict[str, int]:
    cuts = (fingerprint_[i:i + DIGITS] for i in range(0, len(fingerprint_), DIGITS))
    return {c: int(c[-3:], 16) for c in cuts}


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row, fingerprint`` per row of ``docs``; ``row`` is the row itself."""
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        gear = _gear()
        for texts in batches:
            yield pd.Series([fingerprint(chunk_set(t, gear)) for t in texts])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.pandas_udf(of, "string")(F.col(text)).alias("fingerprint"))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by part and place to results; each row's successor is the next row of its part."""
    gear = _gear()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last = None  # part, id, text, chunks, whether it is another part's first row
    for batch in batches:
        rows = []
        for part, doc_id, text, follows in zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(),
                                               batch["text"], batch["follows"].to_pylist()):
            text = text.as_py() or ""
            chunks = chunk_set(text, gear)
            if last and last[0] == part and not last[4]:
                edited = _edited(last[2], text)
                edits = chunk_set(edited, gear)
                rows.append((last[1], len(last[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                             fingerprint(last[3]), fingerprint(edits), likeness(last[3], edits), likeness(last[3], chunks)))
            last = (part, doc_id, text, chunks, follows)
        cols = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _key(doc_id: str = "doc_id", tag: str = "tag") -> Column:
    """What rows are ranged by: descending id, null last, then the text's hash; smallest first."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.bitwise_not(doc_id).alias("down"), F.col(tag).alias("tag"))


def range_heads(docs: DataFrame, ranges: int) -> list[tuple]:
    """The first key of each of about ``ranges`` ranges of rows, in order.

    Only keys are shuffled, by Spark's range partitioning, whose bounds are sampled.
    """
    keys = saved(docs.select("doc_id", F.xxhash64("text").alias("tag")))
    ranged = keys.select(_key().alias("key")).repartitionByRange(ranges, "key")
    firsts = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key"))
    return sorted(_place(r["key"]["none"], r["key"]["down"], r["key"]["tag"]) for r in firsts.collect())


def _place(none: bool, down: int | None, tag: int) -> tuple:
    return none, 0 if none else down, tag


def _ranges_of(heads: list[tuple]):
    """The range of each key; for a range's first key also the range before it, which it closes."""
    def of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for none, down, tag in batches:
            out = []
            for key in zip(none.tolist(), down.tolist(), tag.tolist()):
                key = _place(*key)
                part = max(bisect_right(heads, key) - 1, 0)
                out.append([part, (part or len(heads)) - 1] if key == heads[part] else [part])
            yield pd.Series(out)
    return of


def edited_neighbours(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Each text's fingerprint, and how like it is to its edited text's and its successor's.

    The edited text ends in the successor's beginning.  Rows are cut into ranges
    of descending id and text hash and sorted within; the first row of a range
    also closes the range before it, so every successor is at hand after one
    shuffle of the texts.  Equal or null ids are told apart by their texts.
    """
    rows, size = text_size(docs)
    heads = range_heads(docs, max(1, min(rows, MAX_PARTS, -(-size // part_bytes))))
    key = _key()
    ranges = F.pandas_udf(_ranges_of(heads), "array<int>")(key["none"], F.coalesce(key["down"], F.lit(0)), F.col("tag"))
    tagged = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    placed = tagged.withColumn("ranges", ranges).select("doc_id", "text", "tag", F.posexplode("ranges").alias("follows", "part"))
    dealt = placed.repartitionById(max(len(heads), 1), "part")
    ordered = dealt.sortWithinPartitions("part", "follows", F.col("doc_id").desc_nulls_last(), "tag")
    return ordered.select("part", "doc_id", "text", F.col("follows").cast("boolean").alias("follows")).mapInArrow(
        _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                  "near_edited double, near_next double")
