"""Which indexes a score table covers, as bitmaps.

Indexes are cut into buckets of ``BUCKET`` consecutive ones; a bucket's bitmap
has a bit for each.  Bitmaps are built by a partial aggregate, so every map task
sends at most one 4 KB row per bucket it has seen, and tables of coverage merge by
``or``.  Gaps, duplicates and resume sets are then asked of N / 32768 small rows
instead of by an anti join of all rows with all indexes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 32_768  # bits of Spark's bitmaps
BITMAP_BYTES = BUCKET // 8
BROADCAST_BYTES = 64 << 20  # of bitmaps that are sent to all executors


def _bucket(index: str) -> Column:
    return F.floor(F.col(index) / F.lit(BUCKET)).cast("long")


def _position(index: str) -> Column:
    return F.pmod(F.col(index), F.lit(BUCKET)).cast("long")


def coverage(df: DataFrame, index: str = "global_idx") -> DataFrame:
    """``bucket, bits, rows, least, most`` of the indexes in ``df`` (E10); null indexes are left out.

    ``rows`` counts rows, so that duplicates show as rows beyond the bits.
    """
    rows = df.select(F.col(index).cast("long").alias("__i")).where("__i IS NOT NULL")
    return rows.groupBy(_bucket("__i").alias("bucket")).agg(
        F.bitmap_construct_agg(_position("__i")).alias("bits"), F.count(F.lit(1)).alias("rows"),
        F.min("__i").alias("least"), F.max("__i").alias("most"))


def merge_coverage(*tables: DataFrame) -> DataFrame:
    """The coverage of several tables together."""
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("rows").alias("rows"),
                                       F.min("least").alias("least"), F.max("most").alias("most"))


def coverage_summary(cover: DataFrame) -> DataFrame:
    """Rows, different indexes, duplicate rows and the index range, in one row."""
    bits = F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))
    rows = F.coalesce(F.sum("rows"), F.lit(0))
    return cover.agg(rows.alias("num_records"), bits.alias("num_indexes"), (rows - bits).alias("num_duplicates"),
                     F.min("least").alias("min_idx"), F.max("most").alias("max_idx"))


def _byte(bits: Column, at: Column) -> Column:
    """The byte of a bitmap at a place, as a number."""
    return F.conv(F.hex(F.substring(bits, at + 1, F.lit(1))), 16, 10).cast("int")


def index_gaps(cover: DataFrame, total: int) -> DataFrame:
    """``first, last`` of the stretches of 0 .. total - 1 that are not covered.

    A stretch ends with its bucket, so none is longer than ``BUCKET``.  A bucket
    without a row is one stretch; of the others only bytes with a free bit are
    unfolded.
    """
    spark = cover.sparkSession
    buckets = spark.range(-(-total // BUCKET)).select(F.col("id").alias("bucket"),
                                                      F.least(F.lit(total) - F.col("id") * BUCKET, F.lit(BUCKET)).alias("size"))
    known = buckets.join(cover.select("bucket", "bits"), "bucket", "left")
    absent = known.where("bits IS NULL").select((F.col("bucket") * BUCKET).alias("first"),
                                                (F.col("bucket") * BUCKET + F.col("size") - 1).alias("last"))
    some = known.where(F.col("bits").isNotNull() & (F.bitmap_count("bits") < F.col("size")))
    places = F.filter(F.sequence(F.lit(0), F.lit(BITMAP_BYTES - 1)),
                      lambda i: (i * 8 < F.col("size")) & (_byte(F.col("bits"), i) != 255))
    free = some.select("bucket", "size", "bits", F.explode(places).alias("at"))
    free = free.select("bucket", "size", "at", _byte(F.col("bits"), F.col("at")).alias("byte"))
    bit = F.explode(F.filter(F.array(*[F.lit(j) for j in range(8)]), lambda j: F.call_function("bit_get", F.col("byte"), j) == 0))
    free = free.select("bucket", "size", "at", bit.alias("j")).withColumn("p", F.col("at") * 8 + F.col("j"))
    free = free.where(F.col("p") < F.col("size"))
    run = F.col("p") - F.row_number().over(Window.partitionBy("bucket").orderBy("p"))
    runs = free.withColumn("__run", run).groupBy("bucket", "__run").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    return absent.unionByName(runs.select((F.col("bucket") * BUCKET + F.col("a")).alias("first"),
                                          (F.col("bucket") * BUCKET + F.col("b")).alias("last")))


def uncovered_rows(pairs: DataFrame, cover: DataFrame, index: str = "global_idx",
                   broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``pairs`` whose index is not covered (D6): equal to the anti join, a null index included.

    The bitmaps are counted first: up to ``broadcast_bytes`` they are sent to
    all executors and the pairs stay where they are; beyond that both sides are
    dealt by bucket, of which each holds ``BUCKET`` indexes.
    """
    small = cover.count() * BITMAP_BYTES <= broadcast_bytes
    bits = cover.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    rows = pairs.withColumn("__bucket", _bucket(index)).join(F.broadcast(bits) if small else bits, "__bucket", "left")
    at = _position(index)
    there = F.call_function("bit_get", _byte(F.col("__bits"), F.floor(at / 8).cast("int")), (at % 8).cast("int")) == 1
    return rows.where(~F.coalesce(there, F.lit(False))).drop("__bucket", "__bits")
