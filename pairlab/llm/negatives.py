"""Hard-negative mining over rotated one-bit codes (operator 12).

For each anchor row the rows with its label nearest to it are its positives; for
each of these the nearest rows of another label whose score lies in a window of
shares of the positive's score are its hard negatives.  A score is the integer
inner product of ``floor(SCALE * x)``.

Rows are rotated by a fixed orthogonal transform and coded in one bit a
dimension: the signs of the rotated vector.  Beside a code lie its alignment (the
vector's component along the code) and the norm of what the code leaves over.
That residual is coded in the same way, ``LEVELS`` times in all, so that each
level's residual has about 0.6 of the one before.  A search asks all pairs of
anchors and rows in blocks: the popcounts of the code with the bit planes of the
rotated anchor give an estimate of the score, and Cauchy-Schwarz on the residual
(less its part along the code, which is known to be none) bounds what the
estimate can be off by.  A pair whose interval lies outside all windows, or below
the best scores found for them, is dropped; the others go to the next level, and
the survivors of the last are scored with integers.  The bounds hold always, so
the results are those of a full search.

Anchors are broadcast in batches of at most ``BATCH`` rows and ``BATCH_BYTES``
bytes, each of which passes over the rows once for positives and once for
negatives.  A batch first searches its own rows, so that later tasks start with
a score to beat and send little more than what counts in the end.  A task keeps
a fixed number of rows for each anchor, however many rows are equal.

Defined results: rows with a null label, a null vector or a null or non-finite
component take no part; vectors are filled up with zeros to the longest one's
length (an empty vector is all zeros); components beyond ``LARGEST`` count as
that, and scores beyond 64 bits are cut to that range.  Repeated rows take part as often as they are there, but an anchor row
that repeats exactly is mined once; rows with the anchor's own id are not its
positives.  A null id is no anchor and sorts behind all others; equal scores go
by id.  A positive score of 0 or less has windows like any other (nothing, or
zero only).  An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MASK64, mix64, numbered, saved

SCALE = 256
LEVELS, PLANES = 4, 8
BATCH, BATCH_BYTES = 16_384, 64 << 20  # of anchors
ROWS = 8_192  # rows of the table a search task takes
BLOCK = 1 << 19  # pairs that are looked at together
NO_ID = (1 << 63) - 1
LEAST, MOST = -(1 << 63), (1 << 63) - 1
EXACT = float(1 << 53)  # below it sums of doubles with integer values are exact
LARGEST = 1e100  # of a component

CODED = ("id long, label long, vec array<double>, norm double, codes binary, along array<double>, left array<double>")


# ---- codes

def _hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, without scaling."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def rotated(vecs: np.ndarray) -> np.ndarray:
    """Rows in a rotated frame: three rounds of random signs and a Hadamard transform, which keep inner products.

    The frame has the next power of two of the dimensions, at least 64.
    """
    n = max(64, 1 << max(0, vecs.shape[1] - 1).bit_length())
    x = np.zeros((len(vecs), n))
    x[:, :vecs.shape[1]] = vecs
    for k in range(3):
        signs = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & MASK64)) & np.uint64(1)
        x = _hadamard(x * (1.0 - 2.0 * signs.astype(np.float64)))
        x /= np.sqrt(n)
    return x


def code(vecs: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, levels, 64-bit words), components along the sign vectors and residual norms (rows, levels)."""
    rest = rotated(vecs)
    n = rest.shape[1]
    words, along, left = [], [], []
    for _ in range(levels):
        bits = rest >= 0
        signs = np.where(bits, 1.0, -1.0)
        a = (rest * signs).sum(axis=1) / n
        rest = rest - a[:, None] * signs
        words.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
        along.append(a)
        left.append(np.linalg.norm(rest, axis=1))
    return np.stack(words, axis=1), np.stack(along, axis=1), np.stack(left, axis=1)


def _coder(levels: int):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch["vec"]
            n = len(vec)
            vecs = vec.flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1))
            words, along, left = code(vecs, levels)
            lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (along, left)]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["label"], vec, pa.array(np.linalg.norm(vecs, axis=1)),
                 pa.array([w.tobytes() for w in words], pa.binary()), *lists],
                names=["id", "label", "vec", "norm", "codes", "along", "left"])
    return coded


def coded_rows(rows: DataFrame, scale: int = SCALE, levels: int = LEVELS) -> DataFrame:
    """The table of codes of ``rows (id, label, vec)``, saved; rows that take no part are left out."""
    whole = F.transform("vec", lambda x: x.cast("double"))
    bad = F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.filter(F.col("label").isNotNull() & F.col("vec").isNotNull()).filter(~F.coalesce(bad, F.lit(False)))
    dims = max(1, kept.agg(F.max(F.size("vec"))).first()[0] or 1)
    top = F.lit(LARGEST)
    scaled = F.transform(whole, lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double"))
                         .otherwise(F.greatest(-top, F.least(top, x * scale))))
    full = F.concat(scaled, F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("vec")))
    return saved(kept.select(F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"),
                             F.col("label").cast("long").alias("label"), full.alias("vec"))
                 .mapInArrow(_coder(levels), CODED))


class _Coded:
    """The columns of a table of codes as arrays."""

    def __init__(self, rows: pa.RecordBatch | pa.Table):
        n = rows.num_rows

        def matrix(name: str) -> np.ndarray:
            col = rows[name].combine_chunks() if isinstance(rows, pa.Table) else rows[name]
            return col.flatten().to_numpy().reshape(n, -1)
        self.id, self.label, self.norm = (rows[c].to_numpy() for c in ("id", "label", "norm"))
        self.vec, self.along, self.left = matrix("vec"), matrix("along"), matrix("left")
        words = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint64)
        self.words = words.reshape(n, self.along.shape[1], -1)
        self.ones = np.bitwise_count(self.words).sum(axis=2, dtype=np.int64)

    def part(self, at: slice) -> _Coded:
        other = object.__new__(_Coded)
        other.__dict__ = {k: v[at] for k, v in self.__dict__.items()}
        return other


# ---- the search for one batch of anchors

def anchor_planes(vecs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bit planes (anchors, planes, words) of rotated anchors, step, sum of the coded numbers and total error of the coding."""
    x = rotated(vecs)
    top = 1 << (PLANES - 1)
    step = np.abs(x).max(axis=1, initial=0.0) / (top - 1)
    step[step == 0] = 1.0
    number = np.rint(x / step[:, None])
    off = np.abs(x - number * step[:, None]).sum(axis=1)
    shifted = number.astype(np.int64) + top
    planes = [np.packbits((shifted >> j & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for j in range(PLANES)]
    return np.stack(planes, axis=1), step, number.sum(axis=1), off


def integer_scores(a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of integers; ``bound`` is the product of their norms."""
    score = np.empty(len(a), np.int64)
    small = bound < EXACT
    score[small] = np.einsum("ij,ij->i", a[small], b[small]).astype(np.int64)
    for i in np.flatnonzero(~small):
        score[i] = min(max(sum(int(x) * int(y) for x, y in zip(a[i], b[i])), LEAST), MOST)
    return score


class Search:
    """Anchors with windows of scores, and the best rows found for each window so far.

    ``low`` and ``high`` (anchors, windows) are the windows' ends; a window
    beyond an anchor's own ones has its low end above its high end.  ``floor``
    is a score that the window's ``k`` best are known to reach.
    """

    def __init__(self, anchors: _Coded, same_label: bool, k: int, low: np.ndarray, high: np.ndarray,
                 floor: np.ndarray | None = None):
        self.anchors, self.same_label = anchors, same_label
        self.low, self.high = low, high
        self.need = low if floor is None else np.maximum(low, floor)
        self.planes, self.step, self.sums, self.off = anchor_planes(anchors.vec)
        self.score = np.full((*low.shape, k), LEAST, np.int64)
        self.id = np.full((*low.shape, k), NO_ID, np.int64)
        self.filled = np.zeros(low.shape, np.int64)

    def _along_signs(self, a, counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Inner products of coded anchors with sign vectors, from the numbers under the set bits."""
        return self.step[a] * (2.0 * (counts - (1 << (PLANES - 1)) * ones) - self.sums[a])

    def _outside(self, a, estimate: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Whether no window of the anchors ``a`` can take a score so close to the estimate."""
        least, most = (np.clip(x, float(LEAST), float(MOST)) for x in (estimate - width, estimate + width))
        out = np.ones(estimate.shape, bool)
        for w in range(self.low.shape[1]):
            out &= (most < self.need[a, w]) | (least > self.high[a, w])
        return out

    def look(self, rows: _Coded) -> None:
        """Take ``rows`` into account."""
        height = max(1, BLOCK // max(1, len(rows.id)))
        for first in range(0, len(self.anchors.id), height):
            self._block(np.arange(first, min(first + height, len(self.anchors.id))), rows)

    def _block(self, at: np.ndarray, rows: _Coded) -> None:
        q, size = self.anchors, rows.words.shape[1] and rows.words.shape[2] * 64
        # the first level, for all pairs
        counts = np.zeros((len(at), len(rows.id)), np.int64)
        for j in range(PLANES):
            for w in range(rows.words.shape[2]):
                counts += np.bitwise_count(self.planes[at, j, w][:, None] & rows.words[None, :, 0, w]).astype(np.int64) << j
        a = at[:, None]
        dot = self._along_signs(a, counts, rows.ones[None, :, 0])
        estimate = rows.along[None, :, 0] * dot
        width = self._width(a, dot, rows.along[None, :, 0], rows.left[None, :, 0], rows.norm[None, :], 0.0, size)
        same = q.label[at][:, None] == rows.label[None, :]
        out = (~same | (q.id[at][:, None] == rows.id[None, :])) if self.same_label else same
        ai, ri = np.nonzero(~(out | self._outside(a, estimate, width)))
        estimate, off = estimate[ai, ri], np.abs(rows.along[ri, 0]) * self.off[at[ai]]
        ai = at[ai]
        for level in range(1, rows.words.shape[1]):
            if not len(ai):
                return
            counts = np.zeros(len(ai), np.int64)
            for j in range(PLANES):
                counts += np.bitwise_count(self.planes[ai, j] & rows.words[ri, level]).sum(axis=1, dtype=np.int64) << j
            along = rows.along[ri, level]
            dot = self._along_signs(ai, counts, rows.ones[ri, level])
            estimate = estimate + along * dot
            width = self._width(ai, dot, along, rows.left[ri, level], rows.norm[ri], off, size)
            off = off + np.abs(along) * self.off[ai]
            kept = ~self._outside(ai, estimate, width)
            ai, ri, estimate, off = ai[kept], ri[kept], estimate[kept], off[kept]
        if len(ai):
            self._keep(ai, integer_scores(q.vec[ai], rows.vec[ri], q.norm[ai] * rows.norm[ri]), rows.id[ri])

    def _width(self, a, dot, along, left, norm, off, size) -> np.ndarray:
        """How far the score can be from the estimate.

        The residual is orthogonal to the code, so only the part of the anchor
        that is orthogonal to it counts; ``off`` is what coding the anchor has
        added at earlier levels, and rounding has a margin.
        """
        known = np.maximum(np.abs(dot) - self.off[a], 0.0) ** 2 / size
        rest = np.sqrt(np.maximum(self.anchors.norm[a] ** 2 - known, 0.0))
        return left * rest + off + np.abs(along) * self.off[a] + 1e-9 * self.anchors.norm[a] * norm + 1e-9

    def _keep(self, a: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        """Keep the best ``k`` of each window by score, then id."""
        windows, k = self.low.shape[1], self.score.shape[2]
        for w in range(windows):
            fits = (score >= self.need[a, w]) & (score <= self.high[a, w])
            if not fits.any():
                continue
            touched, place = np.unique(a[fits], return_inverse=True)
            there = np.arange(k)[None, :] < self.filled[touched, w][:, None]
            old, col = np.nonzero(there)
            of = np.concatenate((old, place))
            s = np.concatenate((self.score[touched[old], w, col], score[fits]))
            i = np.concatenate((self.id[touched[old], w, col], id_[fits]))
            order = np.lexsort((i, ~s, of))  # ~s falls as s rises and cannot overflow
            of, s, i = of[order], s[order], i[order]
            nth = np.arange(len(of)) - np.searchsorted(of, of)
            best = nth < k
            self.score[touched[of[best]], w, nth[best]] = s[best]
            self.id[touched[of[best]], w, nth[best]] = i[best]
            self.filled[touched, w] = np.bincount(of[best], minlength=len(touched))
            full = touched[self.filled[touched, w] == k]
            self.need[full, w] = np.maximum(self.need[full, w], self.score[full, w, k - 1])

    def found(self) -> pa.RecordBatch:
        there = np.arange(self.score.shape[2]) < self.filled[:, :, None]
        n, window, nth = np.nonzero(there)
        return pa.RecordBatch.from_arrays(
            [pa.array(n), pa.array(window), pa.array(self.score[n, window, nth]), pa.array(self.id[n, window, nth])],
            names=["n", "window", "score", "id"])


FOUND = "n long, window long, score long, id long"


def _searched(table: DataFrame, shared, same_label: bool, k: int) -> DataFrame:
    """The best ``k`` rows of ``table`` for each anchor and window of the broadcast batch."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, low, high, floor = shared.value
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                anchors = _Coded(pa.ipc.open_stream(raw).read_all())
                state = Search(anchors, same_label, k, low.copy(), high, floor)
            rows = _Coded(batch)
            # few rows at first: their scores spare the later ones a look
            edges = [0, *(e for e in (128, 1024) if e < batch.num_rows), *range(4096, batch.num_rows, 4096), batch.num_rows]
            for x, y in zip(edges, edges[1:]):
                state.look(rows.part(slice(x, y)))
        if state is not None:
            yield state.found()
    best = table.mapInArrow(search, FOUND)
    order = W.partitionBy("n", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _wire(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _mine(table: DataFrame, batch: DataFrame, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    """The mined rows of one batch of anchors (``n`` and the columns of codes), saved.

    The batch, its floors and its positives pass through the driver; all are
    bounded by the batch's size.
    """
    spark = table.sparkSession
    anchors = batch.orderBy("n").toArrow()
    raw, size = _wire(anchors.drop(["n"])), anchors.num_rows

    def top(same_label: bool, k: int, low: np.ndarray, high: np.ndarray) -> DataFrame:
        first = spark.sparkContext.broadcast((raw, low, high, None))
        floor = np.full(low.shape, LEAST, np.int64)
        for r in _searched(batch, first, same_label, k).filter(F.col("rank") == k).collect():
            floor[r["n"], r["window"]] = r["score"]
        second = spark.sparkContext.broadcast((raw, low, high, floor))
        best = saved(_searched(table, second, same_label, k))
        first.unpersist()
        second.unpersist()
        return best

    shape = (size, 1)
    best = top(True, positives, np.full(shape, LEAST, np.int64), np.full(shape, MOST, np.int64))
    # one window for each different positive score: least * p <= 100 * score <= most * p
    scores: list[list[int]] = [[] for _ in range(size)]
    for r in best.select("n", "score").distinct().collect():
        scores[r["n"]].append(r["score"])
    low = np.full((size, max(1, positives)), MOST, np.int64)
    high, scored = np.full(low.shape, LEAST, np.int64), np.zeros(low.shape, np.int64)
    for n, values in enumerate(scores):
        for w, p in enumerate(sorted(values, reverse=True)):
            low[n, w], high[n, w], scored[n, w] = _clipped(-(-least * p // 100)), _clipped(most * p // 100), p
    found = top(False, negatives, low, high)
    ids = spark.createDataFrame([(n, w, i, int(p)) for n, i in enumerate(anchors["id"].to_pylist())
                                 for w, p in enumerate(scored[n, :len(scores[n])])],
                                "n long, window long, anchor_id long, positive_score long")
    windows = ids.join(best.select("n", F.col("score").alias("positive_score"), F.col("id").alias("positive_id")),
                       ["n", "positive_score"])
    hard = found.select("n", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return saved(windows.join(hard, ["n", "window"]).select(
        "anchor_id", _id("positive_id"), "rank", _id("negative_id"), "positive_score", "negative_score"))


def _clipped(x: int) -> int:
    return min(max(x, LEAST), MOST)


def _id(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10,
                   least: int = 30, most: int = 90, batch: int = BATCH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``id, label, vec``; ``anchor`` is a condition on ``id``; a
    negative's score is between ``least`` and ``most`` hundredths of the
    positive's.
    """
    spark = rows.sparkSession
    table = coded_rows(rows)
    count, size = table.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    anchors = table.filter(anchor & (F.col("id") != NO_ID)).dropDuplicates(["id", "label", "vec"])
    anchors = numbered(anchors, F.col("id"), F.col("label"), F.xxhash64("vec"), F.col("vec"))
    n = anchors.count()
    per = max(1, min(batch, BATCH_BYTES // (64 + 16 * (size or 1))))
    dealt = table.repartition(max(1, -(-count // ROWS)))
    dealt = saved(dealt) if n else dealt
    out = [_mine(dealt, anchors.filter((F.col("n") >= first) & (F.col("n") < first + per)).withColumn("n", F.col("n") - first),
                 positives, negatives, least, most) for first in range(0, n, per)]
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
