"""SimHash near-dedup with a Gray-order hierarchical index (operator 7).

Fingerprints that differ in at most ``DISTANCE`` bits are linked.  The 64 bits
are cut into blocks; two linked fingerprints agree in all but ``DISTANCE`` of
them, so one *table* per choice of agreeing blocks finds every link.  Within a
table those blocks go to the front and fingerprints are sorted by Gray rank, so
that neighbours differ in few bits.  Runs of neighbours form the leaves of a
tree, runs of leaves the nodes above, and so on.  Each node factors out the bits
that all its fingerprints share, as pattern and mask; nodes of equal pattern and
mask are merged.  The self-join walks pairs of nodes from the top, accumulates
the differences of shared bits, and drops a pair of whole groups once they pass
the distance; a pair of fingerprints that is left is a link.

A table's groups (one value of the agreeing blocks) are shuffled apart, so no
task sees more than whole groups; a group beyond ``GROUP_ROWS`` is dealt into
cells, each holding two of its chunks.  Equal fingerprints are one entry, and
a task reports a spanning forest of its links, not all pairs.  Components come
from distributed label contraction.

Defined results: null and blank texts have fingerprint zero and are linked like
any other; rows without an id get their component's smallest id, or null;
repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .graph import connected_components

SHINGLE, DISTANCE, SEED = 3, 3, 42
GROUP_ROWS = 20_000  # fingerprints of one group that one task joins
FLUSH_ROWS = 200_000  # rows that a task gathers before it joins the groups in them
PAIRS = 1 << 18  # node pairs expanded at once
FAN = 2  # neighbours in Gray order that make one node; 2 prunes best (see README)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bitwise majority of the shingles' XXH64, as an unsigned number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.diff(ends, prepend=0)).tolist()
    ends = (ends - 1).tolist()
    if len(words) < shingle:
        starts, ends = [0], [len(joined)]
    else:
        ends = ends[shingle - 1:]
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(ends)
    for at in range(0, n, 1 << 14):  # a long text in parts
        part = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:], ends[at:at + (1 << 14)])], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))
    return of


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``row, fp`` per row of ``docs``; ``fp`` holds the 64 bits as a long."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.pandas_udf(_fingerprints(shingle), "long")(F.col("text")).alias("fp"))


def tables(blocks: int, distance: int) -> list[list[tuple[int, int]]]:
    """Per table the (shift, width) of all blocks, those that must agree first."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    return [[*chosen, *(p for p in parts if p not in chosen)] for chosen in combinations(parts, blocks - distance)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order: the prefix XOR of its bits."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _front(x: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for shift, width in parts:
        out = (out << np.uint64(width)) | ((x >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def _starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))


class _Level:
    """Nodes of one tree level, by group: the bits that all codes below share, and each node's children."""

    def __init__(self, low: np.ndarray, high: np.ndarray, group: np.ndarray, begin: np.ndarray, kids: np.ndarray):
        self.pattern, self.shared = low, ~(low ^ high)
        self.low, self.high, self.group, self.begin, self.kids = low, high, group, begin, kids


def gray_tree(codes: np.ndarray, group: np.ndarray, fan: int = FAN) -> list[_Level]:
    """Levels from the codes up to one node a group.

    Up to ``fan`` neighbours in Gray order, which differ in few bits, become one
    node.  Nodes of a group with equal masked patterns are merged, and keep the
    place of the first.  ``codes`` are sorted by group and Gray rank.
    """
    none = np.zeros(0, np.int64)
    levels = [_Level(codes, codes, group, none, none)]
    while len(at := _starts(levels[-1].group)) < len(levels[-1].group):
        below = levels[-1]
        n = len(below.group)
        place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
        run = np.cumsum(place % fan == 0) - 1
        begin = np.flatnonzero(place % fan == 0)
        low, high = np.bitwise_and.reduceat(below.low, begin), np.bitwise_or.reduceat(below.high, begin)
        owner = below.group[begin]
        # nodes with equal masked patterns have equal low and high ends
        order = np.lexsort((high, low, owner))
        new = np.concatenate(([True], (np.diff(owner[order]) != 0) | (low[order][1:] != low[order][:-1])
                              | (high[order][1:] != high[order][:-1])))
        first = np.minimum.reduceat(order, np.flatnonzero(new))
        into = np.empty(len(order), np.int64)
        into[order] = first[np.cumsum(new) - 1]
        nodes, into = np.unique(into, return_inverse=True)
        parent = into[run]
        kids = np.argsort(parent, kind="stable")
        levels.append(_Level(low[nodes], high[nodes], owner[nodes],
                             np.searchsorted(parent[kids], np.arange(len(nodes) + 1)), kids))
    return levels


def linked_pairs(codes: np.ndarray, group: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of codes within ``distance`` in the same group.

    ``codes`` are distinct in a group, sorted by group and Gray rank.
    """
    levels = gray_tree(codes, group)
    top = len(levels) - 1
    if not top:  # no group has two codes
        return
    every = np.arange(len(levels[top].group))
    stack = [(top, every, every)]
    while stack:
        level, i, j = stack.pop()
        if not level:
            yield i, j
            continue
        at, below = levels[level], levels[level - 1]
        ni, nj = at.begin[i + 1] - at.begin[i], at.begin[j + 1] - at.begin[j]
        size = np.cumsum(ni * nj)
        if size[-1] > PAIRS and len(i) > 1:
            cut = min(max(1, int(np.searchsorted(size, PAIRS))), len(i) - 1)
            stack += [(level, i[cut:], j[cut:]), (level, i[:cut], j[:cut])]
            continue
        pair = np.repeat(np.arange(len(i)), ni * nj)
        k = np.arange(size[-1]) - np.repeat(size - ni * nj, ni * nj)
        a, b = at.kids[at.begin[i][pair] + k // nj[pair]], at.kids[at.begin[j][pair] + k % nj[pair]]
        # a node meets itself once, and a code never
        keep = (i[pair] != j[pair]) | ((a < b) if level == 1 else (a <= b))
        a, b = a[keep], b[keep]
        differ = (below.pattern[a] ^ below.pattern[b]) & below.shared[a] & below.shared[b]
        near = np.bitwise_count(differ) <= distance
        if near.any():
            stack.append((level - 1, a[near], b[near]))


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs over n items."""
    root, kept = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for left, right in pairs:
        for a, b in zip(left.tolist(), right.tolist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append((a, b))
    return kept


def _indexed(layout: list[list[tuple[int, int]]], top: list[int]):
    """Each fingerprint to its row of every table: table, group, Gray rank."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp"].to_numpy().view(np.uint64)
            for t, parts in enumerate(layout):
                code = _front(fp, parts)
                # offset so that the signed order of the long is the unsigned one of the rank
                rank = (gray_rank(code) ^ np.uint64(1 << 63)).view(np.int64)
                group = (code >> np.uint64(64 - top[t])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fp), t, np.int32)), pa.array(group), pa.array(rank), batch["fp"]],
                    names=["t", "node", "rank", "fp"])
    return index


def _joined(layout: list[list[tuple[int, int]]], distance: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def links(rows: pa.Table) -> pa.RecordBatch:
            table, fp = rows["t"].to_numpy(), rows["fp"].to_numpy()
            key = np.stack([table.astype(np.int64), rows["node"].to_numpy(), rows["cell"].to_numpy()])
            group = np.cumsum(np.any(np.diff(key, axis=1, prepend=key[:, :1]) != 0, axis=0))
            edges: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
            for t in np.unique(table):
                at = np.flatnonzero(table == t)
                code = _front(fp[at].view(np.uint64), layout[t])
                found = _forest(len(at), linked_pairs(code, group[at], distance))
                if found:
                    edges.append(fp[at][np.array(found)])
            a, b = np.concatenate(edges).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) < FLUSH_ROWS:
                continue
            rows = pa.concat_tables(held)
            keys = [rows[c].to_numpy() for c in ("t", "node", "cell")]
            last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            if cut:
                yield links(rows.slice(0, cut))
            held = [rows.slice(cut)]
        if sum(map(len, held)):
            yield links(pa.concat_tables(held))
    return join


def near_links(fingerprints: DataFrame, distance: int = DISTANCE, group_rows: int = GROUP_ROWS,
               blocks: int | None = None) -> DataFrame:
    """Links ``a, b`` that connect all distinct ``fp`` within ``distance`` bits.

    ``blocks`` sets how many bits must agree in a group; its default follows
    the number of fingerprints, so that groups stay small.  Links are exact for
    any value.
    """
    if blocks is None:
        n = fingerprints.count()
        blocks = distance + 1 + (n > 1 << 24) + (n > 1 << 30)
    layout = tables(blocks, distance)
    top = [sum(w for _, w in parts[:blocks - distance]) for parts in layout]
    rows = fingerprints.mapInArrow(_indexed(layout, top), "t int, node long, rank long, fp long")
    big = rows.groupBy("t", "node").count().filter(F.col("count") > group_rows).select(
        "t", "node", F.ceil(F.col("count") / group_rows).cast("int").alias("chunks"))
    chunks = F.coalesce("chunks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    # a cell holds chunks x <= y of a group; a fingerprint goes to each cell of its chunk
    cells = F.transform(F.sequence(F.lit(0), chunks - 1),
                        lambda c: F.least(c, own).cast("long") * chunks + F.greatest(c, own))
    dealt = rows.join(big, ["t", "node"], "left").select("t", "node", F.explode(cells).alias("cell"), "rank", "fp")
    dealt = dealt.repartition("t", "node", "cell").sortWithinPartitions("t", "node", "cell", "rank")
    return dealt.mapInArrow(_joined(layout, distance), "a long, b long")


def components(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp, component_id, component_fp`` for every distinct fingerprint of ``prints (doc_id, fp)``."""
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(near_links(classes.select("fp"), distance))
    rooted = saved(classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("component_fp")))
    least = rooted.groupBy("component_fp").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "component_fp").select("fp", "component_id", "component_fp")


def hex_digits(fp: Column) -> Column:
    """The 64 bits as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs (doc_id, text)``."""
    prints = saved(with_fingerprint(docs.select("doc_id", "text"), shingle).select("row.doc_id", "fp"))
    return prints.join(components(prints, distance), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, ties by row content."""
    tag = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    tagged = docs.withColumn("_tag", tag)
    prints = saved(with_fingerprint(tagged.select("doc_id", "_tag", "text"), shingle).select(
        "row.doc_id", F.col("row._tag").alias("tag"), "fp"))
    grouped = prints.join(components(prints, distance), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    firsts = grouped.groupBy("component_fp").agg(F.min(order).alias("first"))
    firsts = firsts.select(F.col("first.doc_id").alias("_id"), F.col("first.tag").alias("_first"))
    chosen = saved(tagged.join(firsts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tag") == F.col("_first")),
                               "left_semi"))
    many = chosen.groupBy("doc_id", "_tag").count().filter("count > 1")  # rows repeated as a whole
    same = F.col("c.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("c._tag") == F.col("m._tag"))
    once = chosen.alias("c").join(many.alias("m"), same, "left_anti")
    again = chosen.alias("c").join(many.alias("m"), same, "left_semi").dropDuplicates(["doc_id", "_tag"])
    return once.unionByName(again).drop("_tag")
