"""Incremental evaluation from mergeable partial states.

A shard of scores is reduced once to one small row per (run, data set, bin):
counts, sums, and count, mean and M2 of the margin, plus the sums of teacher-student
losses where a teacher is there.  The rows are stored by (run, data set, shard).  A
report reads states only, merges them, and equals an evaluation of all scores;
scoring a new shard, or a shard anew, reads and writes that shard alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.constants import ECE_BINS, SOFTEN_TEMPERATURE
from .calibration import bin_index
from .sharpness import with_sharpness

RUN_KEYS = ("run", "dataset")
LOSSES = ("jsd", "fkl", "rkl", "hard")
SUMS = ("n", "nv", "ss", "sl", "sent", "smx", "ssent", "nm", *[f"{x}_{k}" for x in ("loss", "rows") for k in LOSSES])


def evaluation_states(scores: DataFrame, score: str, label: str, probs: str, num_labels: int, label_max: int = 1,
                      n_bins: int = ECE_BINS, temperature: float = SOFTEN_TEMPERATURE, keys: Sequence[str] = RUN_KEYS,
                      teacher: str | None = None) -> DataFrame:
    """One state per ``keys`` and bin (E5 + E7, and E12 with a ``teacher`` distribution).

    ``n`` rows, ``nv`` rows with mass, sums of score, label, entropy, largest
    probability and softened entropy; ``nm, mm, m2`` of the margin; of each
    loss the sum and the rows that have it.  At most ``n_bins + 1`` rows
    per key leave a map task.
    """
    lab = F.col(label).cast("double")
    if label_max > 1:
        lab = lab / F.lit(float(label_max))
    s = F.col(score).cast("double")
    row = scores.select(*keys, s.alias("__s"), lab.alias("__l"), F.col(probs).alias("__p"),
                        *([F.col(teacher).alias("__t")] if teacher else []))
    row = with_sharpness(row, "__p", num_labels, temperature)
    if num_labels != 2:
        row = row.withColumn("__mg", F.lit(None).cast("double"))
    there = F.col("__t").isNotNull() & F.col("__p").isNotNull() if teacher else F.lit(False)
    one = {k: F.when(there, dist.divergence("__t", "__p", num_labels, k)) if teacher else F.lit(None).cast("double") for k in LOSSES}
    losses = [f(c).alias(f"{name}_{k}") for name, f in (("loss", F.sum), ("rows", F.count)) for k, c in one.items()]
    return row.withColumn("bin", bin_index("__s", n_bins)).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.count("__ent").alias("nv"), F.sum("__s").alias("ss"), F.sum("__l").alias("sl"),
        F.sum("__ent").alias("sent"), F.sum("__mx").alias("smx"), F.sum("__sent").alias("ssent"),
        F.count("__mg").alias("nm"), F.avg("__mg").alias("mm"),
        (F.var_pop("__mg") * F.count("__mg")).alias("m2"), *losses)


def merge_states(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """States of any shards to one per ``keys`` and bin; merging may go in steps and in any order.

    The margin's mean and M2 are merged around the common mean, so nothing is
    lost to cancellation.
    """
    group = [*keys, "bin"]
    w = Window.partitionBy(*group)
    nm = F.sum("nm").over(w)
    rows = states.withColumn("__mean", F.when(nm > 0, F.sum(F.col("mm") * F.col("nm")).over(w) / nm))
    spread = F.coalesce(F.col("m2"), F.lit(0.0)) + F.coalesce(F.col("nm") * F.pow(F.col("mm") - F.col("__mean"), 2), F.lit(0.0))
    return rows.groupBy(*group).agg(*[F.sum(c).alias(c) for c in SUMS], F.first("__mean").alias("mm"),
                                    F.when(F.sum("nm") > 0, F.sum(spread)).alias("m2"))


def state_report(states: DataFrame, keys: Sequence[str] = RUN_KEYS, weight: float = 1.0) -> DataFrame:
    """ECE, sharpness and mean losses per ``keys`` from states of any shards."""
    per_bin = merge_states(states, keys)
    w = Window.partitionBy(*keys)
    nm = F.sum("nm").over(w)
    per_bin = per_bin.withColumn("__mall", F.when(nm > 0, F.sum(F.col("mm") * F.col("nm")).over(w) / nm))
    gap = F.abs(F.col("ss") / F.col("n") - F.col("sl") / F.col("n")) * F.col("n")
    spread = F.coalesce(F.col("m2"), F.lit(0.0)) + F.coalesce(F.col("nm") * F.pow(F.col("mm") - F.col("__mall"), 2), F.lit(0.0))
    out = per_bin.groupBy(*keys).agg(
        *[F.sum(c).alias(f"__{c}") for c in ("n", "nv", "sent", "smx", "ssent", "nm")],
        F.sum(F.when(F.col("bin").isNotNull(), gap).otherwise(0.0)).alias("__gap"),
        F.first("__mall").alias("mean_margin"), F.sum(spread).alias("__m2"),
        *[F.sum(f"{x}_{k}").alias(f"__{x}_{k}") for x in ("loss", "rows") for k in LOSSES])
    return out.select(
        *keys, F.col("__n").alias("num_samples"), (F.col("__n") - F.col("__nv")).alias("num_without_mass"),
        F.try_divide("__gap", "__n").alias("ece"), F.try_divide("__sent", "__nv").alias("mean_entropy"),
        F.try_divide("__smx", "__nv").alias("mean_maxprob"),
        F.try_divide(F.col("__ssent") - F.col("__sent"), "__nv").alias("temp_sensitivity"),
        "mean_margin", F.when(F.col("__nm") > 0, F.col("__m2") / F.col("__nm")).alias("var_margin"),
        *[(F.try_divide(f"__loss_{k}", f"__rows_{k}") * F.lit(float(weight))).alias(f"loss_{k}") for k in LOSSES])


# ---- the store

def add_shards(scores: DataFrame, path: str, shard: str = "shard", keys: Sequence[str] = RUN_KEYS, **measures) -> None:
    """Reduce the shards in ``scores`` and store their states; a shard that is there is replaced.

    Dynamic partition overwrite touches the (keys, shard) folders of these
    shards only.  States are one file a folder: they are a few rows.
    """
    states = evaluation_states(scores, keys=(*keys, shard), **measures)
    (states.repartition(*keys, shard).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys, shard).parquet(path))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """All stored states."""
    return spark.read.parquet(path)


def unseen_shards(available: DataFrame, path: str, shard: str = "shard", keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """The rows of ``available (keys, shard)`` that the store has no state of; folder names only are read."""
    names = [*keys, shard]
    try:
        store = available.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return available
    seen = store.select(*[F.col(c).cast(available.schema[c].dataType) for c in names]).distinct()
    return available.join(seen, names, "left_anti")
