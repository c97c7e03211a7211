"""A bucketed, sorted pair store for repeated merges.

Pairs are written once, dealt by a hash of their index into buckets, one file a
bucket, each sorted by index.  A merge then shuffles the scores only: the pair
side is read by bucket as it lies.  As a bucket's file is sorted, its row groups
are index ranges, so a bounded merge skips the row groups outside the scores'
range; ``row_group_bytes`` sets how finely.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merge import index_range, merge_status

BUCKETS = 64


def write_pair_store(pairs: DataFrame, path: str, table: str, buckets: int = BUCKETS, index: str = "global_idx",
                     row_group_bytes: int = 16 << 20) -> DataFrame:
    """Write ``pairs`` as the table ``table`` with its files at ``path``; returns the store."""
    (pairs.repartition(buckets, F.col(index)).sortWithinPartitions(index)
     .write.mode("overwrite").option("path", path).option("parquet.block.size", row_group_bytes)
     .bucketBy(buckets, index).sortBy(index).saveAsTable(table))
    return pairs.sparkSession.table(table)


def open_pair_store(spark: SparkSession, path: str, table: str, buckets: int = BUCKETS, index: str = "global_idx") -> DataFrame:
    """A store that an earlier session wrote; ``buckets`` and ``index`` are those it was written with."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        place = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{index}`) SORTED BY (`{index}`) "
                  f"INTO {int(buckets)} BUCKETS LOCATION '{place}'")
    return spark.table(table)


def merge_with_store(store: DataFrame, scores: DataFrame, filter_invalid: bool = False, bounded: bool = False,
                     index: str = "global_idx", **kw) -> DataFrame:
    """``merge_status`` against a store; the pair side has no exchange.

    ``bounded`` asks the scores' index range first and gives it to the scan as
    numbers, which Parquet compares with each row group's range.  The join is a
    merge join by hint: a broadcast of a small score table would leave the
    buckets unused but also need no exchange.
    """
    if bounded:
        r = index_range(scores, index).first()
        store = store.where(F.col(index).between(r["min_idx"], r["max_idx"]) if r["num_records"] else F.lit(False))
    return merge_status(store, scores.hint("merge"), filter_invalid, **kw)
