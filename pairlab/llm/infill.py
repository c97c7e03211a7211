"""Fill-in-middle transformation over a learned rank index (operator 11).

A cut is given as a rank, the number of units before it, but made at a byte
offset.  The offsets of all unit boundaries of an Arrow batch, the texts one
after the other, form a sorted list that is indexed by rank: piecewise-linear
segments are fitted so that each predicts its offsets to within ``ERROR`` bytes,
and the residual of each is stored in one byte.  A cut's offset is its segment's
prediction corrected by the residual, hence exact.  Boundaries are read in blocks
of ``BLOCK`` bytes, whatever lengths the texts have, so a batch's index takes
about a byte a unit.  Where a text's characters have one width a block is one
segment.

The two cuts, the form and its order come from a hash of the id: equal ids get
equal draws, on any run and partitioning.  Sentinels stay unambiguous, as a text
that contains one is left plain, and none can arise across a cut: each begins
and ends with a character that it holds nowhere else.

Units are code points, or the matches of a pattern (``unit``), left to right;
what lies between two matches belongs to the later one, what follows the last
to the last.  Defined results: a null or empty text is plain, with no units; a
null id draws like an id without digits; equal rows get equal results; a text
without a match is plain; an empty table gives an empty result.  Texts are
handled whole at any length; other columns are kept in ``row`` and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100 draws: plain from the first, spm below the second
ERROR = 120  # bytes by which a segment's prediction may be off
BLOCK = 1 << 20


def fit_segments(offsets: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First ranks, first offsets and slopes of segments that predict ``offsets[rank]`` to within ``error``.

    Greedy: a segment starts at its first point and takes points while one slope
    serves all of them; the bounds of that slope are running extremes over a
    window that doubles until they cross.
    """
    firsts, bases, slopes = [], [], []
    at, n, width = 0, len(offsets), 256
    while at < n:
        while True:
            y = offsets[at + 1:at + width] - offsets[at]
            x = np.arange(1, len(y) + 1)
            low, high = np.maximum.accumulate((y - error) / x), np.minimum.accumulate((y + error) / x)
            apart = low > high
            if apart.any() or at + width >= n:
                break
            width *= 2
        taken = int(apart.argmax()) if apart.any() else len(y)
        firsts.append(at)
        bases.append(offsets[at])
        slopes.append((low[taken - 1] + high[taken - 1]) / 2 if taken else 0.0)
        at += taken + 1
        width = max(256, min(width, 2 * taken))
    return np.array(firsts, np.int64), np.array(bases, np.int64), np.array(slopes, np.float64)


class RankIndex:
    """Boundary offsets by rank, added in ascending blocks."""

    def __init__(self, error: int = ERROR):
        assert 0 < error < 127  # residuals fit in a byte, also when rounded
        self.error, self.size = error, 0
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._residuals: list[np.ndarray] = []

    def add(self, offsets: np.ndarray) -> None:
        if not len(offsets):
            return
        firsts, bases, slopes = fit_segments(offsets, self.error)
        rank = np.arange(len(offsets))
        of = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(offsets))))
        residual = offsets - self._predicted(rank, firsts[of], bases[of], slopes[of])
        assert np.abs(residual).max() <= self.error + 1
        self._parts.append((firsts + self.size, bases, slopes))
        self._residuals.append(residual.astype(np.int8))
        self.size += len(offsets)

    @staticmethod
    def _predicted(rank, firsts, bases, slopes) -> np.ndarray:
        return bases + np.rint(slopes * (rank - firsts)).astype(np.int64)

    def close(self) -> RankIndex:
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.firsts, self.bases, self.slopes = (np.concatenate(x) for x in zip(empty, *self._parts))
        self.residuals = np.concatenate([np.zeros(0, np.int8), *self._residuals])
        self._parts, self._residuals = [], []
        return self

    def offsets(self, rank: np.ndarray) -> np.ndarray:
        """The offsets of boundaries, predicted by their segments and corrected."""
        s = np.searchsorted(self.firsts, rank, side="right") - 1
        return self._predicted(rank, self.firsts[s], self.bases[s], self.slopes[s]) + self.residuals[rank]


def _code_points(data: np.ndarray, ends: np.ndarray, index: RankIndex) -> np.ndarray:
    """Add the starts of all code points in ``data``; code points before each of ``ends``."""
    before = np.zeros(len(ends), np.int64)
    for at in range(0, len(data), BLOCK):
        starts = at + np.flatnonzero((data[at:at + BLOCK] & 0xC0) != 0x80)
        inside = (ends > at) & (ends <= at + BLOCK)
        before[inside] = index.size + np.searchsorted(starts, ends[inside])
        index.add(starts)
    return before


def _matches(pattern, texts: list[str], ends: np.ndarray, index: RankIndex) -> np.ndarray:
    """Add the starts of all units, a text's first one at its start; units before each text's end."""
    before, at = np.zeros(len(ends), np.int64), 0
    for k, text in enumerate(texts):
        units, done, here = [], 0, at
        for m in pattern.finditer(text):
            if m.end() > m.start():
                units.append(here)
                here += len(text[done:m.end()].encode("utf-8", "surrogatepass"))
                done = m.end()
        index.add(np.array(units, np.int64))
        before[k], at = index.size, int(ends[k])
    return before


def _joined(data: memoryview, rows: list[tuple[bytes | tuple[int, int], ...]]) -> pa.Array:
    """Strings from literal pieces and byte ranges of ``data``."""
    return pa.array([b"".join(p if isinstance(p, bytes) else data[p[0]:p[1]] for p in row) for row in rows],
                    pa.binary()).cast(pa.string(), safe=False)


def _transformed(unit: str | None):
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        pattern = re.compile(unit) if unit else None
        for batch in batches:
            raw = batch["_text"].cast(pa.large_binary()).fill_null(b"")
            n_rows = len(raw)
            edges = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + n_rows + 1] if n_rows else np.zeros(1, np.int64)
            whole = memoryview(raw.buffers()[2] or b"")[int(edges[0]):int(edges[-1])]
            ends = edges[1:] - edges[0]
            index = RankIndex()
            if pattern:
                before = _matches(pattern, [t.decode("utf-8", "surrogatepass") for t in raw.to_pylist()], ends, index)
            else:
                before = _code_points(np.frombuffer(whole, np.uint8), ends, index)
            first = np.concatenate((np.zeros(1, np.int64), before[:-1])) if n_rows else before
            starts = np.concatenate((np.zeros(1, np.int64), ends[:-1])) if n_rows else ends
            index.add(np.array([len(whole)], np.int64))  # the boundary behind all units
            index.close()
            n = before - first
            h1, h2, h3, h4 = (batch[c].to_numpy() for c in ("_h1", "_h2", "_h3", "_h4"))
            a, b = h1 % (n + 1), h2 % (n + 1)
            low, high = np.minimum(a, b), np.maximum(a, b)
            plain = batch["_plain"].to_numpy(zero_copy_only=False) | (n == 0) | (h3 % 100 >= PLAIN_FROM)
            spm = ~plain & (h4 % 100 < SPM_BELOW)
            # the rank of a text's end is that of the next text's first unit, which may lie behind blank texts
            cuts = [np.where(c == n, ends, index.offsets(first + np.minimum(c, np.maximum(n - 1, 0)))) for c in (low, high)]
            rows = []
            for i, (x, u, v, y) in enumerate(zip(starts.tolist(), cuts[0].tolist(), cuts[1].tolist(), ends.tolist())):
                rows.append(((x, y),) if plain[i] else (s, (v, y), p, (x, u), m, (u, v)) if spm[i]
                            else (p, (x, u), s, (v, y), m, (u, v)))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(n), pa.array(form, pa.string()), pa.array(low, mask=plain),
                 pa.array(high - low, mask=plain), _joined(whole, rows)],
                names=["row", "n", "form", "prefix_chars", "middle_chars", "output"])
    return transform


def draws(doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the id's hash."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, unit: str | None = None) -> DataFrame:
    """``row, n, form, prefix_chars, middle_chars, output`` per row of ``docs``; ``row`` is the row itself.

    ``n`` and the two lengths count units; the lengths are null where the form
    is plain.
    """
    text = F.coalesce("text", F.lit(""))
    holds = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, text.alias("_text"), holds.alias("_plain"),
                       *[h.alias(f"_h{k}") for k, h in enumerate(draws(F.col("doc_id")), 1)])
    out = T.StructType([rows.schema["row"]]).add("n", "long").add("form", "string").add("prefix_chars", "long")
    return rows.mapInArrow(_transformed(unit), out.add("middle_chars", "long").add("output", "string"))


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from an output and its form."""
    def after(x: str, y: str | None = None) -> Column:
        rest = F.split_part(output, F.lit(x), F.lit(2))
        return F.split_part(rest, F.lit(y), F.lit(1)) if y else rest
    return (F.when(form == "psm", F.concat(after(PREFIX, SUFFIX), after(MIDDLE), after(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(after(PREFIX, MIDDLE), after(MIDDLE), after(SUFFIX, PREFIX)))
            .otherwise(output))
