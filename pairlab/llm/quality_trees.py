"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 13).

Statistics of a text (``STATISTICS``: sizes, shares of kinds of characters and
words, repetition, entropy) are computed with numpy over the bytes of many texts
at a time.  They are the only inputs of a score: ids, languages, sources and
labels are not looked at.

The trees are fitted with logistic loss on at most ``rows`` labelled documents
(``TRAIN_ROWS``), taken in the order of a hash of their ids, so that the model
fits in one process and broadcasts; their statistics are cut into ``BINS`` bins at
their quantiles, and each level of a tree is grown from one histogram of gradients
per node, statistic and bin.  The forest is flattened into arrays (statistic,
threshold, value; node i has the children 2i + 1 and 2i + 2), and a batch of
texts walks all trees at once, one level a step.

Defined results: a null or empty text has statistics of 0 and a score like any
other; a document is held out by its id alone, a null id like an empty string;
documents with several labels count with the mean, rounded half up; null labels
and labels without a document are left out; repeated documents of one id are
learned from once where their statistics are equal, and each is scored; without
a label of either kind the score is the same for all; an empty table gives an
empty result.  Texts are read whole; a long one goes through in parts that end
between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_words

TRAIN_ROWS = 40_000  # labelled documents that are learned from at most
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
BINS, DEPTH, TREES, RATE = 64, 4, 60, 0.15
LEAF_ROWS, RIDGE = 10, 1.0
PART = 1 << 18  # code points of a text that are looked at together
BLOCK_BYTES, BLOCK_PARTS = 1 << 20, 1024
GROUP = 1 << 22

SYMBOLS, SENTENCE, COMMAS = b"#*$%&|<>@^~\\{}[]=+_", b".!?", b",;:"
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "digits", "capitals", "symbols", "sentence_marks", "commas", "exclamations",
    "other_bytes", "vowels", "blanks", "entropy", "short_words", "long_words", "capital_words", "all_capital_words",
    "number_words", "words_with_sentence_end", "words_with_symbol_end", "longest_word", "distinct_words", "commonest_word",
    "repeated_triples", "words_a_line", "repeated_lines")


def _class(letters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(letters)] = True
    return out


_DIGIT, _UPPER = _class(b"0123456789"), _class(bytes(range(65, 91)))
_LETTER, _VOWEL = _class(bytes([*range(65, 91), *range(97, 123)])), _class(b"aeiouAEIOU")
_BLANK, _OTHER = _class(b" \t\n\x0b\x0c\r"), _class(bytes(range(128, 256)))
_CLASSES = np.stack([_DIGIT, _UPPER, _class(SYMBOLS), _class(SENTENCE), _class(COMMAS), _class(b"!"), _OTHER, _VOWEL, _LETTER,
                     _BLANK], axis=1).astype(np.float64)


def _parts(text: str) -> list[str]:
    """A text cut after blanks into parts of about ``PART`` code points."""
    import re

    blank, out, at = re.compile(r"[ \t-\r]"), [], 0
    while len(text) - at > PART and (m := blank.search(text, at + PART)):
        out.append(text[at:m.end()])
        at = m.end()
    return [*out, text[at:]]


def _word_counts(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte histograms (parts, 256) and sums over the words of each part (parts, 9)."""
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    bounds = np.cumsum([0] + [len(r) + 1 for r in raws])
    part = np.repeat(np.arange(len(raws)), np.diff(bounds))
    histogram = np.bincount(part * 256 + data, minlength=256 * len(raws)).reshape(-1, 256)
    histogram[:, 10] -= 1  # the line end put behind each
    blank = _BLANK[data]
    edge = np.diff(np.concatenate(([True], blank)).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    of, length = part[starts], ends - starts

    def inside(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(kind[data], dtype=np.int32)))
        return total[ends] - total[starts]
    capitals, letters = inside(_UPPER), inside(_LETTER)
    last = data[ends - 1] if len(ends) else data[:0]
    kinds = [np.ones(len(of)), length, length <= 2, length >= 15, _UPPER[data[starts]], (capitals == letters) & (letters > 1),
             inside(_DIGIT) > 0, _class(SENTENCE)[last], _class(SYMBOLS)[last]]
    sums = np.stack([np.bincount(of, weights=k, minlength=len(raws)) for k in kinds], axis=1)
    longest = np.zeros(len(raws))
    np.maximum.at(longest, of, length)
    return histogram, np.column_stack((sums, longest))


def _runs(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``n`` documents: different keys, the commonest key's count, and occurrences of keys found twice or more."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))) if len(doc) else np.zeros(0, int)
    size, of = np.diff(np.append(new, len(doc))), doc[new]
    most = np.zeros(n)
    np.maximum.at(most, of, size)
    return np.bincount(of, minlength=n), most, np.bincount(of, weights=np.where(size > 1, size, 0), minlength=n)


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of ``STATISTICS`` for each text; texts go through in groups of about ``GROUP`` code points."""
    size = np.cumsum([len(t or "") for t in texts]) // GROUP
    edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    return np.concatenate([_statistics(texts[a:b]) for a, b in zip(edges, edges[1:])])


def _statistics(texts: list[str | None]) -> np.ndarray:
    n = len(texts)
    parts, of_part = [], []
    lines, repeated = np.zeros(n), np.zeros(n)
    for i, text in enumerate(texts):
        cut = _parts(text or "")
        parts += cut
        of_part += [i] * len(cut)
        filled = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        lines[i], repeated[i] = len(filled), len(filled) - len(set(filled))
    of_part = np.array(of_part, np.int64)
    histogram, sums, longest = np.zeros((n, 256)), np.zeros((n, 9)), np.zeros(n)
    at = 0
    while at < len(parts):
        raws, size, first = [], 0, at
        while at < len(parts) and len(raws) < BLOCK_PARTS and (size < BLOCK_BYTES or not raws):
            raws.append(parts[at].encode("utf-8", "surrogatepass"))
            size += len(raws[-1])
            at += 1
        h, s = _word_counts(raws)
        np.add.at(histogram, of_part[first:at], h)
        np.add.at(sums, of_part[first:at], s[:, :9])
        np.maximum.at(longest, of_part[first:at], s[:, 9])
    hashes, counts = hashed_words(parts)
    doc = np.repeat(of_part, counts)
    distinct, most, _ = _runs(doc, hashes, n)
    triples = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7) if len(hashes) > 2 else hashes[:0]
    whole = doc[:len(triples)] == doc[len(doc) - len(triples):]
    _, _, again = _runs(doc[:len(triples)][whole], triples[whole], n)

    n_bytes, n_words = histogram.sum(axis=1), sums[:, 0]
    a_byte, a_word, a_line = (1 / np.maximum(x, 1) for x in (n_bytes, n_words, lines))
    digits, capitals, symbols, sentence, commas, bangs, other, vowels, letters, blanks = (histogram @ _CLASSES).T
    p = histogram * a_byte[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    columns = [np.log1p(n_bytes), np.log1p(n_words), sums[:, 1] * a_word, digits * a_byte, capitals / np.maximum(letters, 1),
               symbols * a_byte, sentence * a_word, commas * a_word, bangs * a_word, other * a_byte,
               vowels / np.maximum(letters, 1), blanks * a_byte, entropy, *(sums[:, k] * a_word for k in range(2, 9)),
               np.log1p(longest), distinct * a_word, most * a_word, again * a_word, np.log1p(n_words * a_line), repeated * a_line]
    return np.column_stack(columns).astype(np.float32)


# ---- trees

@dataclass(frozen=True)
class Forest:
    """Trees side by side: arrays (trees, nodes) of statistic, threshold and value, the root first."""

    base: float
    statistic: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of statistics."""
        trees, nodes = self.statistic.shape
        total = np.full(len(x), self.base)
        tree = np.arange(trees)[None, :] * nodes
        statistic, threshold, value = (a.ravel() for a in (self.statistic, self.threshold, self.value))
        for at in range(0, len(x) if trees else 0, 4096):
            some = x[at:at + 4096]
            row, node = np.arange(len(some))[:, None], np.zeros((len(some), trees), np.int64)
            for _ in range((nodes + 1).bit_length() - 2):
                place = tree + node
                node = 2 * node + 1 + (some[row, statistic[place]] > threshold[place])
            total[at:at + 4096] += value[tree + node].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each statistic, upper ends of all bins but the last: different quantiles."""
    return [np.unique(np.quantile(col, np.arange(1, bins) / bins, method="lower"))[:bins - 1] for col in x.T]


def _best_splits(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistic, bin and gain of each node's best split, from sums (nodes, statistics, bins) of gradients, weights and rows."""
    left_g, left_h, left_c = (np.cumsum(x, axis=2) for x in (g, h, c))
    all_g, all_h, all_c = (x[:, :, -1:] for x in (left_g, left_h, left_c))

    def gained(a, b):
        return a * a / (b + RIDGE)
    gain = gained(left_g, left_h) + gained(all_g - left_g, all_h - left_h) - gained(all_g, all_h)
    gain[(left_c < LEAF_ROWS) | (all_c - left_c < LEAF_ROWS)] = 0.0
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    return best // gain.shape[2], best % gain.shape[2], flat[np.arange(len(flat)), best]


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE,
               bins: int = BINS) -> Forest:
    """Boosted trees for labels ``y`` (0 or 1) of rows of statistics."""
    n, k = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    nodes = 2 ** (depth + 1) - 1
    statistic = np.zeros((trees, nodes), np.int64)
    threshold = np.full((trees, nodes), np.inf, np.float32)  # a node without a split sends all rows left
    value = np.zeros((trees, nodes))
    if not n:
        return Forest(base, statistic[:0], threshold[:0], value[:0])
    edges = bin_edges(x, bins)
    binned = np.column_stack([np.searchsorted(e, col) for e, col in zip(edges, x.T)])
    cell = binned + np.arange(k) * bins
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2 ** level - 1
            flat = ((node - first)[:, None] * (k * bins) + cell).ravel()
            g, h, c = (np.bincount(flat, None if w is None else np.repeat(w, k), minlength=2 ** level * k * bins)
                       .reshape(-1, k, bins).astype(np.float64) for w in (gradient, weight, None))
            feature, cut, gain = _best_splits(g, h, c)
            for i in np.flatnonzero(gain > 1e-9):
                statistic[t, first + i], threshold[t, first + i] = feature[i], edges[feature[i]][cut[i]]
            right = (x[np.arange(n), statistic[t, node]] > threshold[t, node]).astype(np.int64)
            node = 2 * node + 1 + right
        sums = np.bincount(node, gradient, minlength=nodes) / (np.bincount(node, weight, minlength=nodes) + RIDGE)
        value[t] = rate * sums
        margin += value[t, node]
    return Forest(base, statistic, threshold, value)


# ---- documents

def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch["text"].to_pylist())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(list(x), pa.list_(pa.float32()))],
                                         names=["doc_id", "label", "x"])


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, label, x`` of at most ``rows`` documents that have a label and are not held out."""
    known = labels.select(F.col("doc_id"), F.col("quality").cast("double").alias("q")).filter("doc_id IS NOT NULL AND q IS NOT NULL")
    known = known.filter(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("long").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``rows`` ids
    measured = found.select("doc_id", "label", "text").mapInArrow(_measured, "doc_id long, label long, x array<float>")
    return measured.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, **options) -> Forest:
    """The forest learned from ``docs (doc_id, text)`` and ``labels (doc_id, quality)``."""
    train = labelled(docs, labels, rows).toArrow()
    x = np.array(train["x"].to_pylist(), np.float32).reshape(-1, len(STATISTICS))
    return fit_forest(x, train["label"].to_numpy().astype(np.float64), **options)


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """``row, held_out, score`` per row of ``docs``; ``row`` is the row itself."""
    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(forest.scores(statistics(t.tolist())))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, is_held_out(F.col("doc_id")).alias("held_out"), scored(F.coalesce("text", F.lit(""))).alias("score"))
