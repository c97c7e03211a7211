"""Mixing sources to target weights by pivotal dependent rounding (operator 5).

Every source gets a target size, every document of it the same expected number
of copies ``f = target / source_size``: ``floor(f)`` sure copies and one more
with probability ``f - floor(f)``.  Pivotal rounding makes these probabilities
integral: a pair trades size-weighted mass, one up and one down, until one of
the two is 0 or 1, and the direction is drawn so that expectations stay.  The
words that a source yields in expectation never change, so only the very last
open probability of a source (one document) moves them off the target.

The trades form a reduction tree: each (source, bucket) group settles all its
rows but one, and the open rows of ``FAN`` buckets meet in the next level.  A
hot source has as many first-level buckets as its row count asks for, so no
task ever holds a whole source.

Defined results: null texts and texts without words have size 0 and are never
taken; null sources are one source, ordered last; rows that repeat id, source,
size and text are interchangeable, and a counted number of them gets the extra
copy; an empty table gives an empty result.  Extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, numbered, saved

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, LIMIT = 1.5, 2.0
BUCKET_ROWS, FAN = 2_000, 64
EPS = 1e-9

_KEY = ("source", "doc_id", "size", "tag")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(items: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   limit: float = LIMIT) -> DataFrame:
    """``source, source_size, n_rows, target`` for rows ``source, size``.

    Sources in code point order (null last) take the weights in turn and share
    ``share`` of all sizes; a target stops at ``limit`` times its source's size
    and the excess is shared again by weight.  Each round of that is one
    aggregate over the table of sources.
    """
    per = items.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    order = numbered(per, F.col("source").asc_nulls_last(), name="rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    per = saved(order.withColumn("weight", weight))
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * level > limit * F.col("source_size")
        row = per.agg(F.sum("source_size").alias("all"), F.sum(above.cast("long")).alias("full"),
                      F.sum(F.when(above, limit * F.col("source_size")).otherwise(0.0)).alias("spent"),
                      F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not row["all"] or not row["open"] or row["full"] == full:
            break
        level, full = (share * row["all"] - row["spent"]) / row["open"], row["full"] if level else -1
    target = F.least(F.col("weight") * level, limit * F.col("source_size"))
    return per.select("source", "source_size", "n_rows", target.cast("double").alias("target"))


def _settle(seed: int, level: int):
    """One node of the reduction tree: all rows of a group but one become integral."""
    def node(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        import random

        # large documents first, so that a small one is left open at the end
        rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending"), ("tag", "ascending")])
        draw = random.Random(zlib.crc32(repr((seed, level, *(k.as_py() for k in key))).encode()))
        p, size = rows["p"].to_pylist(), rows["size"].to_pylist()
        held = -1
        for i in range(len(p)):
            if not 0.0 < p[i] < 1.0:
                continue
            if held < 0:
                held = i
                continue
            a, b = size[held], size[i]
            up, down = min(a * (1 - p[held]), b * p[i]), min(a * p[held], b * (1 - p[i]))
            move = up if draw.random() * (up + down) < down else -down
            for j, moved in ((held, move / a), (i, -move / b)):
                p[j] += moved
                p[j] = 0.0 if p[j] < EPS else 1.0 if p[j] > 1 - EPS else p[j]
            open_rows = [j for j in (held, i) if 0.0 < p[j] < 1.0]
            held = open_rows[-1] if open_rows else -1
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))
    return node


def round_copies(items: DataFrame, seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``source, doc_id, size, tag, extra``: which keys get the extra copy.

    ``items`` has the key columns, ``p`` (the probability still open) and
    ``n_rows`` (rows of its source).
    """
    buckets = F.ceil(F.col("n_rows") / bucket_rows).cast("long")
    nodes = items.select(*_KEY, "p", F.pmod(F.xxhash64("doc_id", "size", "tag"), buckets).alias("bucket"))
    done, level = [], 0
    while True:
        nodes = saved(nodes.groupBy("source", "bucket").applyInArrow(_settle(seed, level), nodes.schema))
        still = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(nodes.filter(~still))
        nodes = nodes.filter(still)
        most = nodes.agg(F.max("bucket")).first()[0]
        if not most:
            break
        nodes, level = nodes.withColumn("bucket", (F.col("bucket") / FAN).cast("long")), level + 1
    # one open probability per source: a plain draw
    chance = (F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id", "size"), F.lit(1 << 40)) / float(1 << 40))
    last = nodes.withColumn("p", (chance < F.col("p")).cast("double"))
    return reduce(DataFrame.unionByName, done + [last]).select(*_KEY, F.col("p").cast("long").alias("extra"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
        limit: float = LIMIT, seed: int = 7) -> DataFrame:
    """``row, size, source_size, target, copies`` per row of ``docs``; ``row`` is the row itself."""
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source",
                        word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tag"))
    items = saved(sized.select("doc_id", "source", "size", "tag"))
    targets = saved(source_targets(items, weights, share, limit))
    keys = items.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    factor = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(0.0)
    keys = keys.alias("k").join(targets.alias("t"), F.col("k.source").eqNullSafe(F.col("t.source")))
    keys = keys.select(*[f"k.{c}" for c in _KEY], "n", "n_rows", "source_size", "target", factor.alias("f"))
    sure = F.when(F.col("size") > 0, F.floor("f")).otherwise(0)
    extra = F.col("n") * (F.col("f") - sure)  # over the rows of the key
    keys = saved(keys.select(*_KEY, "n", "n_rows", "source_size", "target", sure.alias("sure"),
                             F.when(F.col("size") > 0, F.floor(extra)).otherwise(0).alias("whole"),
                             F.when(F.col("size") > 0, extra - F.floor(extra)).otherwise(0.0).alias("p")))
    rounded = round_copies(keys, seed)
    same = reduce(Column.__and__, [F.col(f"k.{c}").eqNullSafe(F.col(f"r.{c}")) for c in _KEY])
    keys = saved(keys.alias("k").join(rounded.alias("r"), same).select(
        "k.*", (F.col("whole") + F.col("extra")).alias("more")))
    same = reduce(Column.__and__, [F.col(f"d.{c}").eqNullSafe(F.col(f"k.{c}")) for c in _KEY])
    rows = sized.alias("d").join(keys.alias("k"), same).select("d.*", "n", "source_size", "target", "sure", "more")
    out = ["row", "size", "source_size", "target"]
    single = rows.filter("n = 1").select(*out, (F.col("sure") + F.col("more")).alias("copies"))
    nth = F.row_number().over(W.partitionBy(*_KEY).orderBy("tag"))
    repeated = rows.filter("n > 1").withColumn("nth", nth).select(
        *out, (F.col("sure") + (F.col("nth") <= F.col("more")).cast("long")).alias("copies"))
    return single.unionByName(repeated)
