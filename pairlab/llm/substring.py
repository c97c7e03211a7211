"""Substring dedup with fixed-block anchors (operator 10).

A repeat of ``WINDOW`` words holds a whole block of ``BLOCK`` words wherever the
blocks of its first occurrence lie, as long as ``WINDOW >= 2 * BLOCK - 1``.  So:

1. *Index and probe.*  Every document's non-overlapping blocks (words 0-9,
   10-19, ...) are the index, and every rolling window of ``BLOCK`` words is a
   probe.  A probe hits where an equal block lies elsewhere.
2. *Extend.*  Each hit is extended to all ``WINDOW``-word windows around it.
   Their digests meet, and a window whose digest starts earlier is a repeat.
   Runs of such windows are the maximal exact repeats; their words go.

Documents are dealt into *chunks* of about ``CHUNK_BYTES``.  A chunk sends each
different probe once, as 4 bytes in a packed array per bucket of the hash space,
and gets one bit back; step 2 sends 8-byte digests with the chunk's earliest
place in the same way.  So a passage that a third of all documents share sends
one entry a chunk, not one a document, and no pair of documents is ever formed.
In step 1 a false hit costs time only; in step 2 a digest is 64 bits beside the
bucket's bits, from an independent mix of the words' 64-bit hashes.

Order is (id, start); ids that are null come last.  Defined results: null and
blank texts have no words; equal ids are one document, so rows that repeat an
id and a text remove nothing from each other; texts of any length are hashed
whole; an empty table gives an empty result.  Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .common import from_planes, hashed_words, mix64, planes, powers, text_size

WINDOW, BLOCK = 20, 10
CHUNK_BYTES = 6 << 20
BUCKET_BYTES, TASK_BYTES = 8 << 20, 16 << 20  # of keys: in a bucket, which is one group, and in a task
KEY_BYTES = 1.0  # of probes or digests that a byte of text sends, about
NULL_ID = np.iinfo(np.int64).max

PACKED = "chunk long, bucket long, keys binary, flags binary"
PLACED = "chunk long, bucket long, keys binary, ids binary, starts binary"


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, int]:
    """``docs`` with a chunk number, dealt by it, the number of chunks, and the bytes of text."""
    rows, size = text_size(docs)
    n = max(1, min(rows, -(-size // chunk_bytes)))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))
    return dealt.repartition(n, "chunk"), n, size


def bucket_count(key_bytes: float) -> int:
    """Buckets of the hash space for so many bytes of keys."""
    return max(1, -(-int(key_bytes) // BUCKET_BYTES))


def by_bucket(packets: DataFrame, key_bytes: float) -> GroupedData:
    """Packets grouped by bucket, in partitions of about ``TASK_BYTES``, whatever the session's default is."""
    return packets.repartition(max(1, -(-int(key_bytes) // TASK_BYTES)), "bucket").groupBy("bucket")


class _Words:
    """The words of a chunk: hashes in document order, and where documents begin."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("doc_id", "ascending")])  # nulls last
        self.doc_ids, self.texts = rows["doc_id"], rows["text"]
        self.hashes, self.counts = hashed_words(self.texts.to_pylist())
        self.first = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.place = np.arange(len(self.hashes)) - self.first[self.doc]  # of a word in its document
        self.ids = self.doc_ids.combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False)

    def rolling(self, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which n words of one document start, and their joint hashes."""
        size = len(self.hashes)
        if size < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = powers(size + 1, base)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes * up[:size], dtype=np.uint64)))
        at = np.flatnonzero(self.place[n - 1:] >= n - 1)
        return at, mix64((total[at + n] - total[at]) * down[at])


_PROBE, _DIGEST, _SECOND = 0xD1342543DE82EF95, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def bucketed(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket numbers from the high half of a hash; the low half stays free for the entry."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _probes(words: _Words, buckets: int):
    """The chunk's different probes in (bucket, 4-byte entry) order.

    Returns positions, the order that sorts them, the starts of equal runs, and
    each run's bucket and entry.
    """
    at, key = words.rolling(BLOCK, _PROBE)
    long_enough = words.counts[words.doc[at]] >= WINDOW
    at, key = at[long_enough], key[long_enough]
    bucket = bucketed(key, buckets)
    packed = (bucket << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
    order = np.argsort(packed, kind="stable")
    ranked = packed[order]
    run = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
    return at, order, run, (ranked[run] >> np.uint64(32)).astype(np.int64), ranked[run].astype(np.uint32)


def bucket_slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each bucket of a sorted array with its range."""
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    for a, b in zip(cut, [*cut[1:], len(bucket)]):
        yield int(bucket[a]), int(a), int(b)


def _send_probes(buckets: int):
    def send(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        words = _Words(rows)
        at, order, run, bucket, entry = _probes(words, buckets)
        size = np.diff(np.append(run, len(order)))
        is_block = (words.place[at[order]] % BLOCK == 0).astype(np.uint8)
        block = np.maximum.reduceat(is_block, run) if len(run) else is_block
        out = [(key[0].as_py(), n, planes(entry[a:b]),
                np.packbits(np.stack([block[a:b], size[a:b] > 1])).tobytes()) for n, a, b in bucket_slices(bucket)]
        return _table(out, ("chunk", "bucket", "keys", "flags"), 2)
    return send


def _table(rows: list[tuple], names: tuple[str, ...], n_long: int) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(names)
    types = [pa.int64()] * n_long + [pa.binary()] * (len(names) - n_long)
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=list(names))


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts all keys, and the starts of its equal runs."""
    all_keys = np.concatenate(keys)
    order = np.argsort(all_keys, kind="stable")
    ranked = all_keys[order]
    return order, np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))


def _resolve_probes(rows: pa.Table) -> pa.Table:
    """A bucket: an entry is hit if its key is a block somewhere and lies in two places."""
    keys = [from_planes(k, np.uint32) for k in rows["keys"].to_pylist()]
    flags = [np.unpackbits(np.frombuffer(f, np.uint8))[:2 * len(k)].reshape(2, -1)
             for f, k in zip(rows["flags"].to_pylist(), keys)]
    order, run = _groups(keys)
    block, twice = np.concatenate(flags, axis=1)[:, order]
    many = np.diff(np.append(run, len(order)))
    hit = (np.maximum.reduceat(block, run) > 0) & ((many > 1) | (np.maximum.reduceat(twice, run) > 0))
    flat = np.empty(len(order), np.uint8)
    flat[order] = np.repeat(hit, many)
    ends = np.cumsum([len(k) for k in keys])
    out = [(chunk, bucket, np.packbits(bits).tobytes(), None)
           for chunk, bucket, bits in zip(rows["chunk"].to_pylist(), rows["bucket"].to_pylist(),
                                          np.split(flat, ends[:-1])) if bits.any()]
    return _table(out, ("chunk", "bucket", "keys", "flags"), 2)


def _send_windows(buckets: int):
    def send(key: tuple[pa.Scalar, ...], rows: pa.Table, hits: pa.Table) -> pa.Table:
        if not len(rows) or not len(hits):
            return _table([], ("chunk", "bucket", "keys", "ids", "starts"), 2)
        words = _Words(rows)
        at, order, run, bucket, _ = _probes(words, buckets)
        bits = dict(zip(hits["bucket"].to_pylist(), hits["keys"].to_pylist()))
        hit = np.zeros(len(run), bool)
        for n, a, b in bucket_slices(bucket):
            if n in bits:
                hit[a:b] = np.unpackbits(np.frombuffer(bits[n], np.uint8))[:b - a]
        struck = np.zeros(len(words.hashes) + 1, np.int64)
        struck[at[order[np.repeat(hit, np.diff(np.append(run, len(order))))]] + 1] = 1
        struck = np.cumsum(struck)
        start, digest = words.rolling(WINDOW, _DIGEST)
        # windows that hold a whole struck probe
        near = struck[start + WINDOW - BLOCK + 1] > struck[start]
        start, digest = start[near], digest[near]
        bucket = bucketed(words.rolling(WINDOW, _SECOND)[1][near], buckets)
        order = np.lexsort((start, digest, bucket))  # documents are in id order, so the first of a run is earliest
        start, digest, bucket = start[order], digest[order], bucket[order]
        new = np.concatenate(([True], (digest[1:] != digest[:-1]) | (bucket[1:] != bucket[:-1]))) if len(start) else []
        start, digest, bucket = start[new], digest[new], bucket[new]
        ids, places = words.ids[words.doc[start]], words.place[start].astype(np.int64)
        out = [(key[0].as_py(), n, planes(digest[a:b]), planes(ids[a:b]), planes(places[a:b]))
               for n, a, b in bucket_slices(bucket)]
        return _table(out, ("chunk", "bucket", "keys", "ids", "starts"), 2)
    return send


def _resolve_windows(rows: pa.Table) -> pa.Table:
    """A bucket: for each entry whose digest lies in two chunks or more, the digest's earliest place."""
    cols = {c: [from_planes(x, t) for x in rows[c].to_pylist()]
            for c, t in (("keys", np.uint64), ("ids", np.int64), ("starts", np.int64))}
    keys, ids, starts = (np.concatenate(cols[c]) for c in ("keys", "ids", "starts"))
    order = np.lexsort((starts, ids, keys))
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    run = np.flatnonzero(new)
    first = order[run][np.cumsum(new) - 1]  # the earliest entry of each one's run
    where = np.empty(len(order), np.int64)
    where[order] = first
    shared = np.empty(len(order), bool)
    shared[order] = np.repeat(np.diff(np.append(run, len(order))) > 1, np.diff(np.append(run, len(order))))
    out, a = [], 0
    for chunk, bucket, k in zip(rows["chunk"].to_pylist(), rows["bucket"].to_pylist(), cols["keys"]):
        mine = np.flatnonzero(shared[a:a + len(k)]) + a
        if len(mine):
            out.append((chunk, bucket, planes(keys[mine]), planes(ids[where[mine]]), planes(starts[where[mine]])))
        a += len(k)
    return _table(out, ("chunk", "bucket", "keys", "ids", "starts"), 2)


def _finish(buckets: int):
    def finish(key: tuple[pa.Scalar, ...], rows: pa.Table, found: pa.Table) -> pa.Table:
        words = _Words(rows)
        covered = np.zeros(len(words.hashes) + 1, np.int64)
        start, digest = words.rolling(WINDOW, _DIGEST)
        if len(start):
            bucket = bucketed(words.rolling(WINDOW, _SECOND)[1], buckets)
            ids, places = words.ids[words.doc[start]], words.place[start]
            order = np.lexsort((start, digest, bucket))
            new = np.concatenate(([True], (digest[order][1:] != digest[order][:-1])
                                  | (bucket[order][1:] != bucket[order][:-1])))
            run = np.flatnonzero(new)
            # the earliest place of each window: here, unless a bucket names an earlier one
            first_id, first_place = ids[order[run]].copy(), places[order[run]].astype(np.int64)
            mine = dict(zip(found["bucket"].to_pylist(), zip(*(found[c].to_pylist() for c in ("keys", "ids", "starts")))))
            for n, a, b in bucket_slices(bucket[order[run]].astype(np.int64)):
                if n in mine:
                    k, i, s = (from_planes(x, t) for x, t in zip(mine[n], (np.uint64, np.int64, np.int64)))
                    at = a + np.searchsorted(digest[order[run[a:b]]], k)
                    first_id[at], first_place[at] = i, s
            nth = np.cumsum(new) - 1
            later = np.empty(len(order), bool)
            later[order] = (ids[order] > first_id[nth]) | ((ids[order] == first_id[nth]) & (places[order] > first_place[nth]))
            np.add.at(covered, start[later], 1)
            np.add.at(covered, start[later] + WINDOW, -1)
        removed = np.cumsum(covered)[:-1] > 0
        n_removed = np.zeros(len(words.counts), np.int64)
        np.add.at(n_removed, words.doc[removed], 1)
        digests = []
        for i, text in enumerate(words.texts):
            kept = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            if n_removed[i]:
                gone = removed[words.first[i]:words.first[i] + len(kept)]
                kept = [w for w, g in zip(kept, gone.tolist()) if not g]
            digests.append(b" ".join(kept))
        return pa.table({"doc_id": words.doc_ids, "n_words": pa.array(words.counts, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(digests, pa.binary())})
    return finish


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (UTF-8: kept words, one space between) per row of ``docs``."""
    dealt, n, size = chunked(docs.select("doc_id", "text"), chunk_bytes)
    key_bytes = size * KEY_BYTES
    buckets = bucket_count(key_bytes)
    hits = by_bucket(dealt.groupBy("chunk").applyInArrow(_send_probes(buckets), PACKED), key_bytes).applyInArrow(_resolve_probes, PACKED)
    windows = dealt.groupBy("chunk").cogroup(hits.repartition(n, "chunk").groupBy("chunk")).applyInArrow(_send_windows(buckets), PLACED)
    firsts = by_bucket(windows, key_bytes).applyInArrow(_resolve_windows, PLACED)
    return dealt.groupBy("chunk").cogroup(firsts.repartition(n, "chunk").groupBy("chunk")).applyInArrow(
        _finish(buckets), "doc_id long, n_words long, n_removed long, kept binary")
