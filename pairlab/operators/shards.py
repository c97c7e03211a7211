"""Shards and resume (A6, B25-B27, D5, D6, E14, I5 planning).

Ranks are small integers bounded by ``world_size``; the tables of ranks are
the only broadcast sides here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import batch_id, contiguous_shard, shuffle_key, strided_shard


def shard_counts(scores: DataFrame, rank: str = "rank") -> DataFrame:
    """Rows per shard."""
    return scores.groupBy(rank).count()


def present_ranks(scores: DataFrame, rank: str = "rank") -> DataFrame:
    return scores.select(F.col(rank).cast("long").alias("rank")).distinct()


def missing_ranks(spark: SparkSession, present: DataFrame, world_size: int) -> DataFrame:
    """Expected ranks ``0..world_size-1`` minus the present ones."""
    expected = spark.range(world_size).withColumnRenamed("id", "rank")
    return expected.join(F.broadcast(present.select(F.col("rank").cast("long"))), "rank", "left_anti")


def with_shard(df: DataFrame, world_size: int, mode: str = "strided",
               index: str = "global_idx", out: str = "rank") -> DataFrame:
    """Assign each row to a shard (B26): ``idx % world_size`` (strided) or
    contiguous blocks (needs the row count: one scalar subquery)."""
    if mode == "strided":
        return df.withColumn(out, strided_shard(index, world_size).cast("int"))
    if mode == "contiguous":
        total = df.select(F.count(F.lit(1))).scalar()
        return df.withColumn(out, contiguous_shard(index, total, world_size))
    raise ValueError("mode must be 'strided' or 'contiguous'")


def pairs_to_rescore(pairs: DataFrame, missing: DataFrame, world_size: int,
                     mode: str = "strided", index: str = "global_idx") -> DataFrame:
    """Rows of the missing shards, i.e. what a resume must score again.

    A left-semi join with the missing-rank table (at most ``world_size`` rows,
    broadcast)."""
    sharded = with_shard(pairs, world_size, mode, index, "__rank")
    m = F.broadcast(missing.select(F.col("rank").cast("int").alias("__rank")))
    return sharded.join(m, "__rank", "left_semi").drop("__rank")


def unscored_rows(pairs: DataFrame, scores: DataFrame, index: str = "global_idx") -> DataFrame:
    """Row-level resume set: pairs whose index has no score (D6 row variant)."""
    return pairs.join(scores.select(index), index, "left_anti")


def with_batch(df: DataFrame, size: int, index: str = "global_idx") -> DataFrame:
    """Fixed-size batch number per row."""
    return df.withColumn("batch", batch_id(index, size))


def seeded_shuffle(df: DataFrame, seed: int, *cols: str) -> DataFrame:
    """Reproducible shuffle order, independent of partitioning."""
    return df.withColumn("__shuf", shuffle_key(seed, *cols)).orderBy("__shuf", *cols).drop("__shuf")
