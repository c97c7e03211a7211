"""Best-fit packing with swap-based local search (operator 1).

Documents of equal token count are interchangeable, so a packing is planned on
counts per length: a *pattern* is a multiset of lengths that share a bin, with
the number of bins that look so.  The plan starts from best fit (each bin takes
the largest lengths that still fit) and is improved by a local search over the
underfull patterns: a document moves, one is exchanged for one, or two for one,
whenever that raises the sum of squared fills; a move is made for as many bin
pairs as the two patterns have.  Fuller bins grow, emptier ones shrink until
they are empty and their sequence is saved.  All pairs of underfull patterns are
tried, and the search ends when none has an exchange left.

The plan's input is one counter per length (``capacity`` numbers), whatever the
corpus holds.  Everything that grows with the corpus is distributed: texts are
tokenised where they lie, pieces are ranked inside their length (in salted
groups, so that a length which a third of all pieces share has no task of its
own), and each piece finds its bin from its rank.

Defined results: a null or empty text is one piece holding only the end id;
longer documents are cut into full pieces with a shorter first one; runs of
blanks of any length have the tokenizer's ids like other text; repeated rows are
packed once each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, tiktoken_encoding, tokenizer_path

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"
BLANK_RUN = 1 << 16  # blanks in a row; several times as many overflow the regex stack of tiktoken
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SALT_ROWS = 1_000  # pieces of one length that are ranked together


def _tokenised(ranks: str, whole: str, capacity: int):
    """Documents to pieces.

    The ids are those of the ``tokenizers`` file ``whole``.  ``ranks`` holds the
    same vocabulary and merges for tiktoken, which yields the same ids about
    four times faster.  The former takes the texts with the special token's
    string, which it gives one id, and those with more than ``BLANK_RUN`` blanks
    in a row, on which the latter can run out of stack.
    """
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        from tokenizers import Tokenizer

        fast, full = tiktoken_encoding(ranks), None
        blanks = re.compile(r"\s{%d}" % BLANK_RUN)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = text.as_py() or ""
                if SPECIAL in text or len(text) >= BLANK_RUN and blanks.search(text):
                    full = full or Tokenizer.from_file(whole)
                    ids = full.encode(text, add_special_tokens=False).ids
                else:
                    ids = fast.encode_ordinary(text)
                ids.append(END_ID)
                raw = memoryview(np.array(ids, "<u4").tobytes())
                pieces = -(-len(ids) // capacity)
                start, end = 0, len(ids) - (pieces - 1) * capacity
                for piece in range(pieces):
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(raw[4 * start:4 * end])))
                    start, end = end, end + capacity
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return tokenise


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, ranks: str | None = None,
              whole: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document."""
    tokenise = _tokenised(ranks or tokenizer_path("byte_bpe_50k.tiktoken"),
                          whole or tokenizer_path("byte_bpe_50k.json"), capacity)
    return docs.select("doc_id", "text").mapInArrow(tokenise, PIECES)


Pattern = tuple[int, ...]  # lengths in one bin, descending


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> dict[Pattern, int]:
    """Patterns and their numbers of bins: each bin takes the largest lengths that fit."""
    left = {n: c for n, c in counts.items() if c > 0}
    sizes = sorted(left, reverse=True)
    bins: dict[Pattern, int] = {}
    while sizes:
        room, pattern, used = capacity, [], {}
        for n in sizes:
            take = min(room // n, left[n]) if n <= room else 0
            if take:
                pattern += [n] * take
                used[n] = take
                room -= n * take
                if room < sizes[-1]:
                    break
        times = min(left[n] // u for n, u in used.items())
        bins[tuple(pattern)] = bins.get(tuple(pattern), 0) + times
        for n, u in used.items():
            left[n] -= u * times
        if any(not left[n] for n in used):
            sizes = [n for n in sizes if left[n]]
    return bins


class _Partners:
    """What the underfull patterns can take: an entry for each length that one may give back, and one for none.

    Entries lie in the order in which patterns came up, so that a pattern which
    found no exchange asks only those that came up after its last look.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.patterns: list[Pattern] = []  # by number; a pattern that comes up again has a new one
        self.number: dict[Pattern, int] = {}
        self.size = 0
        # an entry's pattern number, length given back, fill of the pattern (-1: gone), place in ``_gives``
        self.entries = np.zeros((4, 1024), np.int64)

    def add(self, p: Pattern) -> None:
        self.remove(p)
        back = [0, *sorted(set(p))]
        if self.size + len(back) > self.entries.shape[1]:
            there = self.entries[:, :self.size][:, self.entries[2, :self.size] >= 0]
            self.size = there.shape[1]
            self.entries = np.concatenate([there, np.zeros((4, self.size + len(back) + 1024), np.int64)], axis=1)
        fill, end = sum(p), self.size + len(back)
        new = self.entries[:, self.size:end]
        new[0], new[1], new[2] = len(self.patterns), back, fill
        new[3] = self.capacity - fill + new[1]
        new[3, 1:] += self.capacity + 1
        self.number[p] = len(self.patterns)
        self.patterns.append(p)
        self.size = end

    def _range(self, number: int) -> slice:
        return slice(*np.searchsorted(self.entries[0, :self.size], (number, number + 1)))

    def remove(self, p: Pattern) -> None:
        if (n := self.number.pop(p, None)) is not None:
            self.entries[2, self._range(n)] = -1

    def best(self, a: Pattern, alone: bool, since: int, until: int) -> tuple[int, int, Pattern] | None:
        """The exchange from ``a`` that fills a pattern at least as full most.

        The tokens gained, the length given back (0: none) and the pattern;
        equal gains go to the fuller pattern, then to the larger one.  ``alone``
        says that there is one bin of ``a``, which has no partner in itself.
        Only patterns numbered ``since`` to before ``until`` are asked.
        """
        start, end = np.searchsorted(self.entries[0, :self.size], (since, until))
        number, back, fill, place = self.entries[:, start:end]
        gain = np.where(fill >= sum(a), _gives(a, self.capacity)[place] - back, 0)
        if alone:
            gain[number == self.number[a]] = 0
        if not len(gain) or (most := int(gain.max())) <= 0:
            return None
        ties = np.flatnonzero(gain == most)
        ties = ties[fill[ties] == fill[ties].max()]
        i = max(ties, key=lambda t: (self.patterns[number[t]], -back[t]))
        return most, int(back[i]), self.patterns[number[i]]


def _gives(a: Pattern, capacity: int) -> np.ndarray:
    """The most tokens that ``a`` can give for each room: 0 .. capacity with one length, then with one or two."""
    ones = np.unique(a)
    twos = (ones[:, None] + ones)[~np.eye(len(ones), dtype=bool) | (np.array([a.count(n) for n in ones]) > 1)]
    most = np.zeros((2, capacity + 1), np.int64)
    most[:, ones] = ones
    most[1, twos[twos <= capacity]] = twos[twos <= capacity]
    return np.maximum.accumulate(most, axis=1).ravel()


def _lengths(a: Pattern, size: int, two: bool) -> Pattern:
    """The length, or the two where ``two`` allows, of ``a`` that make up ``size``."""
    if size in a:
        return (size,)
    assert two
    return next((x, size - x) for x in a if size - x in a and (2 * x != size or a.count(x) > 1))


def _changed(p: Pattern, out: Pattern, into: Pattern) -> Pattern:
    items = list(p)
    for n in out:
        items.remove(n)
    return tuple(sorted([*items, *into], reverse=True))


def local_search(bins: dict[Pattern, int], capacity: int = CAPACITY) -> dict[Pattern, int]:
    """Raise the squared fill of underfull bins by exchanges until there is none left.

    In each round every underfull pattern, the emptiest first, makes the
    exchanges with the largest gain among all underfull patterns that are at
    least as full; patterns made in a round take part from the next one on.  An
    exchange takes tokens from the emptier to the fuller bin, so the sum of
    squares rises with each and the search ends, after a round without any.
    """
    bins = dict(bins)
    partners = _Partners(capacity)
    looked: dict[Pattern, int] = {}  # no pattern numbered below this has an exchange for the pattern

    def change(p: Pattern, times: int) -> None:
        had = bins.pop(p, 0)
        if had + times:
            bins[p] = had + times
        if not had + times:
            partners.remove(p)
        elif sum(p) < capacity and (not had or had == 1 < had + times):  # two bins can be each other's partner
            partners.add(p)

    for p in sorted(bins):
        if sum(p) < capacity:
            partners.add(p)
    moved = True
    while moved:
        moved = False
        now = len(partners.patterns)
        for a in sorted(partners.number, key=lambda p: (sum(p), p)):
            while a in bins:
                found = partners.best(a, bins[a] == 1, looked.get(a, 0), now)
                if not found:
                    looked[a] = now
                    break
                gain, back, b = found
                given, taken = _lengths(a, gain + back, back > 0), (back,) * (back > 0)
                times = bins[a] // 2 if a == b else min(bins[a], bins[b])
                for old, new in ((a, _changed(a, given, taken)), (b, _changed(b, taken, given))):
                    change(old, -times)
                    if new:
                        change(new, times)
                moved = True
    return bins


def _slots(bins: dict[Pattern, int]) -> np.ndarray:
    """Rows ``length, first rank, per bin, first sequence, offset`` sorted by length and rank."""
    rows, ranks, sequence = [], {}, 0
    for pattern in sorted(bins):
        offset = 0
        for n in sorted(set(pattern), reverse=True):
            per = pattern.count(n)
            rows.append((n, ranks.get(n, 0), per, sequence, offset))
            ranks[n] = ranks.get(n, 0) + per * bins[pattern]
            offset += per * n
        sequence += bins[pattern]
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(slots: np.ndarray):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.int64(1) << 50  # above any rank
        keys = slots[:, 0] * shift + slots[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            s = slots[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            bin_, nth = np.divmod(rank - s[:, 1], s[:, 2])
            cols = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(s[:, 3] + bin_), pa.array(s[:, 4] + nth * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return place


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of ``docs (doc_id, text)`` with its ``sequence_id`` and ``offset``."""
    pieces = saved(pieces_of(docs, capacity))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    slots = _slots(local_search(best_fit(counts, capacity), capacity))
    # a constant: a length with many pieces has as many salts as it needs
    salts = F.from_json(F.lit(str([-(-counts.get(n, 0) // SALT_ROWS) for n in range(capacity + 1)])), "array<int>")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.get(salts, F.col("length").cast("int"))))
    before = salted.groupBy("length", "salt").count().select(
        "length", "salt", (F.sum("count").over(W.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order)).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32",
                           (F.col("before") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(_placed(slots), PIECES + ", sequence_id long, offset long")
