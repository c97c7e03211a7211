"""Language-model scoring from a log-frequency Bloom filter (operator 6).

A bigram model with Dirichlet smoothing: ``p(w | u) = (c(u, w) + MU * p(w)) /
(c(u) + MU)`` and ``p(w) = (c(w) + 1) / (N + V + 1)``.  All counts ``c`` of the
model come from a Bloom filter that holds, for an n-gram of count c, one entry
for each level 1 .. 1 + floor(log2 c).  Asking for levels until one is missing
gives the quantised count; the filter can only overstate it.

The filter is made of one segment per bucket of the hash space, with
``LEVEL_BITS`` bits for each entry; every n-gram of the training documents is
held.  Segments are broadcast in batches of at most ``BATCH_BYTES`` (measured; a
larger segment is a batch of its own) and probed by the workers that hold the
documents.  One batch is probed while scoring.  Where there are more, the
documents' n-grams are written once, parted by batch, each batch is broadcast in
turn, answers its own part and is released, and scoring reads the answers.  The
scores are the same for any batch size.

Counting and the exact base score share one exchange: documents are dealt into
chunks; a chunk sends each of its different n-grams once, in packed arrays per
bucket, with its count in training documents, and gets the words' corpus counts
back in the same order.  An n-gram that every document holds sends one entry a
chunk.  There are as many buckets as keep ``BUCKET_BYTES`` of n-grams in each.

Words are told apart by a 64-bit hash, word pairs in the filter by their bucket
and 32 more bits.  Defined results: a null or blank text has the end token
only; a null id counts as the empty text and is trained on; repeated rows count
each; with no training rows N and V are 0 and every probability is uniform; an
empty table gives an empty result.  Extra columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MASK64, from_planes, hashed_words, mix64, planes, saved, scratch_dir
from .substring import bucket_count, bucket_slices, bucketed, by_bucket, chunked

MU = 300.0
BATCH_BYTES = 128 << 20  # of segments that are broadcast together
PROBES, LEVEL_BITS = 4, 8  # a false entry in about 2.5 % of the cases
FOLDS, HELD_OUT = 7, 2
KEY_BYTES = 1.1  # of n-grams that a byte of text sends, about

MOST_BITS = (1 << 32) - 1  # that a 32-bit hash can address; a segment with more entries is denser
END, START = np.uint64(0x5E2D58D8B3BCDEE8), np.uint64(0x1B873593CC9E2D51)  # beside any word's hash
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
PACKED = "chunk long, bucket long, words binary, word_counts binary, pairs binary, pair_counts binary"
RESOLVED = ("chunk long, bucket long, counts binary, segment binary, bits long, tokens long, types long, texts long")
LEVELS = "chunk long, bucket long, word_levels binary, pair_levels binary"


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


class _Tokens:
    """The tokens of a chunk: word hashes with an end token after each document."""

    def __init__(self, rows: pa.Table):
        hashes, counts = hashed_words(rows["text"].to_pylist(), lower=True)
        self.counts = counts + 1
        last = np.cumsum(self.counts) - 1
        self.hashes = np.empty(len(hashes) + len(counts), np.uint64)
        is_word = np.ones(len(self.hashes), bool)
        is_word[last] = False
        self.hashes[is_word], self.hashes[last] = hashes, END
        self.doc = np.repeat(np.arange(len(counts)), self.counts)
        before = np.empty_like(self.hashes)
        before[1:] = self.hashes[:-1]
        before[last - self.counts + 1] = START
        self.before = before
        self.pair = mix64(before * np.uint64(_ODD[0]) + self.hashes)

    def of_docs(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=values, minlength=len(self.counts))


def _sorted_words(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words in (bucket, hash) order, each one's bucket, and each token's place among them."""
    # buckets follow the high bits, so the order of hashes is that of buckets too
    different, place = np.unique(hashes, return_inverse=True)
    return different, bucketed(different, buckets).astype(np.int64), place


def _sorted_pairs(pair: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs' entries in (bucket, entry) order, each one's bucket, and each token's place among them."""
    packed, place = np.unique((bucketed(pair, buckets) << np.uint64(32)) | pair_items(pair), return_inverse=True)
    return packed.astype(np.uint32), (packed >> np.uint64(32)).astype(np.int64), place


def _send(buckets: int):
    def send(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        tokens = _Tokens(rows)
        trained = ~rows["held_out"].to_numpy()[tokens.doc]
        words, word_bucket, place = _sorted_words(tokens.hashes, buckets)
        word_counts = np.bincount(place[trained], minlength=len(words)).astype(np.uint32)
        pairs, pair_bucket, place = _sorted_pairs(tokens.pair, buckets)
        pair_counts = np.bincount(place[trained], minlength=len(pairs)).astype(np.uint32)
        of_pairs = {n: (a, b) for n, a, b in bucket_slices(pair_bucket)}
        out = []
        of_words = {n: (a, b) for n, a, b in bucket_slices(word_bucket)}
        for n in sorted(of_words.keys() | of_pairs.keys()):
            a, b = of_words.get(n, (0, 0))
            c, d = of_pairs.get(n, (0, 0))
            out.append((key[0].as_py(), n, planes(words[a:b]), planes(word_counts[a:b]),
                        planes(pairs[c:d]), planes(pair_counts[c:d])))
        cols = list(zip(*out)) or [()] * 6
        types = [pa.int64()] * 2 + [pa.binary()] * 4
        return pa.table([pa.array(x, t) for x, t in zip(cols, types)],
                        names=["chunk", "bucket", "words", "word_counts", "pairs", "pair_counts"])
    return send


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, their summed counts, and each entry's place among them."""
    different, place = np.unique(np.concatenate(keys), return_inverse=True)
    return different, np.bincount(place, weights=np.concatenate(counts), minlength=len(different)).astype(np.int64), place


def levels(counts: np.ndarray) -> np.ndarray:
    """The quantised count: 0 for none, else 1 + floor(log2 count)."""
    return np.where(counts > 0, np.frexp(counts.astype(np.float64))[1], 0)


def level_value(level: np.ndarray) -> np.ndarray:
    """The middle of a level's counts."""
    return np.where(level > 0, (np.exp2(level - 1.0) + np.exp2(level) - 1) / 2, 0.0)


def _bit(items: np.ndarray, level: int, probe: int, bits) -> np.ndarray:
    h = mix64(items + np.uint64((level * _ODD[1] + probe * _ODD[2]) & MASK64))
    return ((h >> np.uint64(32)) * bits) >> np.uint64(32)


def word_items(hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes ^ np.uint64(_ODD[2]))


def pair_items(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64(0xFFFFFFFF)


def build_segment(items: np.ndarray, counts: np.ndarray, most_bits: int | None = None) -> tuple[np.ndarray, int]:
    """The bytes of a segment and its number of bits.

    All items are held.  Only a caller that gives ``most_bits`` bounds the
    segment: it holds the most frequent then, equal counts in hash order, as
    many as fit.
    """
    level = levels(counts)
    if most_bits is not None:
        ranked = np.lexsort((mix64(items), -counts))
        level[ranked[np.cumsum(level[ranked]) > most_bits // LEVEL_BITS]] = 0
    bits = max(64, int(level.sum()) * LEVEL_BITS)
    bits = min(bits, MOST_BITS if most_bits is None else most_bits)
    marks = np.zeros(-(-bits // 8) * 8, np.uint8)
    for j in range(1, int(level.max(initial=0)) + 1):
        kept = items[level >= j]
        for probe in range(PROBES):
            marks[_bit(kept, j, probe, np.uint64(bits))] = 1
    return np.packbits(marks, bitorder="little"), bits


def _resolve(rows: pa.Table) -> pa.Table:
    """A bucket: its segment and corpus totals in a row without a chunk, and the words' totals for each chunk in the order it asked."""
    word_keys, pair_keys, word_counts, pair_counts = (
        [from_planes(x, t) for x in rows[c].to_pylist()]
        for c, t in (("words", np.uint64), ("pairs", np.uint32), ("word_counts", np.uint32), ("pair_counts", np.uint32)))
    words, totals, word_place = _summed(word_keys, word_counts)
    pairs, pair_totals, _ = _summed(pair_keys, pair_counts)
    items = np.concatenate([word_items(words), pairs.astype(np.uint64)])
    segment, bits = build_segment(items, np.concatenate([totals, pair_totals]))
    bucket = rows["bucket"][0].as_py()
    back = zip(rows["chunk"].to_pylist(), np.split(totals[word_place], np.cumsum([len(k) for k in word_keys])[:-1]))
    end = totals[words == END]
    out = [(None, bucket, None, segment.tobytes(), bits, int(totals.sum()), int((totals > 0).sum()), int(end[0]) if len(end) else 0)]
    out += [(chunk, bucket, planes(c), None, None, None, None, None) for chunk, c in back]
    types = [pa.int64()] * 2 + [pa.binary()] * 2 + [pa.int64()] * 4
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out), types)],
                    names=["chunk", "bucket", "counts", "segment", "bits", "tokens", "types", "texts"])


class Filter:
    """Segments side by side, of some buckets."""

    def __init__(self, segments: list[tuple[int, bytes, int]], buckets: int):
        self.bits = np.full(buckets, 1, np.uint64)
        self.first = np.zeros(buckets, np.uint64)
        at = 1  # an empty byte in front, for buckets without a segment
        for bucket, raw, bits in segments:
            self.bits[bucket], self.first[bucket] = bits, 8 * at
            at += len(raw)
        self.data = np.frombuffer(b"".join([b"\0", *(raw for _, raw, _ in segments)]), np.uint8)

    def counts(self, items: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Quantised counts."""
        return level_value(self.levels(items, bucket))

    def levels(self, items: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Levels: probe one after the other while all bits are set."""
        bits, first = self.bits[bucket], self.first[bucket]
        level = np.zeros(len(items), np.int64)
        open_, j = np.arange(len(items)), 1
        while len(open_):
            for probe in range(PROBES):
                at = first[open_] + _bit(items[open_], j, probe, bits[open_])
                open_ = open_[(self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            level[open_] = j
            j += 1
            if j > 63:
                break
        return level


def _answered(filter_):
    """Levels of the n-grams of packets (chunk, bucket, words, pairs) in the broadcast batch."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = filter_.value
        for batch in batches:
            out = []
            for chunk, bucket, words, pairs in zip(*(batch[c].to_pylist() for c in ("chunk", "bucket", "words", "pairs"))):
                asked = word_items(from_planes(words, np.uint64)), from_planes(pairs, np.uint32).astype(np.uint64)
                out.append((chunk, bucket, *(bloom.levels(x, np.full(len(x), bucket)).astype(np.uint8).tobytes() for x in asked)))
            cols = list(zip(*out)) or [()] * 4
            types = [pa.int64()] * 2 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["chunk", "bucket", "word_levels", "pair_levels"])
    return probe


def _score(buckets: int, n_tokens: int, n_types: int, n_texts: int, mu: float, filter_):
    def score(key: tuple[pa.Scalar, ...], rows: pa.Table, found: pa.Table) -> pa.Table:
        tokens = _Tokens(rows)
        words, word_bucket, place = _sorted_words(tokens.hashes, buckets)
        pairs, pair_bucket, pair_place = _sorted_pairs(tokens.pair, buckets)
        exact, word_level, pair_level = (np.zeros(len(x), np.int64) for x in (words, words, pairs))
        if filter_ is not None:
            word_level = filter_.value.levels(word_items(words), word_bucket)
            pair_level = filter_.value.levels(pairs.astype(np.uint64), pair_bucket)
        of_words = {n: (a, b) for n, a, b in bucket_slices(word_bucket)}
        of_pairs = {n: (a, b) for n, a, b in bucket_slices(pair_bucket)}
        for n, counts, of_word, of_pair in zip(*(found[c].to_pylist() for c in ("bucket", "counts", "word_levels", "pair_levels"))):
            (a, b), (c, d) = of_words.get(n, (0, 0)), of_pairs.get(n, (0, 0))
            if counts is not None:
                exact[a:b] = from_planes(counts, np.int64)
            else:
                word_level[a:b], pair_level[c:d] = np.frombuffer(of_word, np.uint8), np.frombuffer(of_pair, np.uint8)
        of_token = exact[place]
        all_ = n_tokens + n_types + 1
        word_count, pair_count = level_value(word_level)[place], level_value(pair_level)[pair_place]
        before = np.empty_like(word_count)
        before[1:] = word_count[:-1]
        before[tokens.before == START] = level_value(levels(np.array([n_texts])))[0]
        p = (np.minimum(pair_count, before) + mu * (word_count + 1) / all_) / (before + mu)
        n = len(tokens.counts)
        return pa.table({
            "doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": pa.array(tokens.counts, pa.int64()),
            "n_known": pa.array(tokens.of_docs(of_token > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, n_tokens, np.int64)),
            "base_score": pa.array(tokens.of_docs(np.log10((of_token + 1) / all_))),
            "score": pa.array(tokens.of_docs(np.log10(p)))})
    return score


def batches_of(sizes: list[tuple[int, int]], limit: int) -> list[list[int]]:
    """Buckets of ``(bucket, bytes)``, in order, in batches of at most ``limit`` bytes (one bucket at least)."""
    out, room = [], 0
    for bucket, size in sorted(sizes):
        if not out or size > room:
            out.append([])
            room = limit
        out[-1].append(bucket)
        room -= size
    return out


def score_texts(docs: DataFrame, held_out: Column | None = None, mu: float = MU, batch_bytes: int = BATCH_BYTES,
                **chunks) -> DataFrame:
    """Base and model score of every ``docs (doc_id, text)``, trained on those not held out.

    The filter of one batch passes through the driver; batches, not the corpus,
    bound it.
    """
    spark = docs.sparkSession
    held = is_held_out(F.col("doc_id")) if held_out is None else held_out
    dealt, n, size = chunked(docs.select("doc_id", "text", held.alias("held_out")), **chunks)
    buckets = bucket_count(size * KEY_BYTES)
    counted = dealt.groupBy("chunk").applyInArrow(_send(buckets), PACKED)
    resolved = saved(by_bucket(counted, size * KEY_BYTES).applyInArrow(_resolve, RESOLVED))
    segments = resolved.filter("chunk IS NULL").select("bucket", "segment", "bits")
    total = resolved.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "texts"))).first()
    batches = batches_of([tuple(r) for r in segments.select("bucket", F.octet_length("segment")).collect()], batch_bytes)

    def sent(batch: list[int]):
        got = segments.filter(F.col("bucket").between(batch[0], batch[-1])).toArrow()
        return spark.sparkContext.broadcast(Filter(list(zip(*(got[c].to_pylist() for c in ("bucket", "segment", "bits")))), buckets))
    none = F.lit(None).cast("binary")
    found = resolved.filter("chunk IS NOT NULL").select("chunk", "bucket", "counts", none.alias("word_levels"), none.alias("pair_levels"))
    inline = None
    if len(batches) == 1:
        inline = sent(batches[0])
    elif batches:
        ends = F.array(*[F.lit(b[-1]) for b in batches])
        which = F.size(F.filter(ends, lambda e: e < F.col("bucket")))
        asked = f"{scratch_dir(spark)}/ngrams-{uuid.uuid4().hex}"
        counted.select("chunk", "bucket", "words", "pairs", which.alias("batch")).write.partitionBy("batch").parquet(asked)
        for k, batch in enumerate(batches):
            filter_ = sent(batch)
            part = spark.read.schema("chunk long, bucket long, words binary, pairs binary").parquet(f"{asked}/batch={k}")
            levels_ = saved(part.mapInArrow(_answered(filter_), LEVELS))
            filter_.unpersist()
            found = found.unionByName(levels_.withColumn("counts", none))
    return dealt.groupBy("chunk").cogroup(found.repartition(n, "chunk").groupBy("chunk")).applyInArrow(
        _score(buckets, total["tokens"], total["types"], total["texts"], mu, inline),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
