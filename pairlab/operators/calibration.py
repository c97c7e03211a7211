"""Calibration: expected calibration error and the reliability table.

Bins are equal-width on [0, 1], lower-inclusive, the last one closed.  The
bounds are the exact doubles ``i * (1/n)`` (so 0.30000000000000004, not 0.3)
and rows are binned by comparison with them, never by ``floor(s * n)``.
Rows that fall in no bin (NaN, null, < 0, > 1) still count in the
denominator (T6, T7).

Plan: one partial/final hash aggregate on ``(by..., bin)`` — at most
``n_bins + 1`` rows per group leave the map side — then a tiny second
aggregate per ``by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ECE_BINS


def bin_bounds(n_bins: int = ECE_BINS) -> list[float]:
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def bin_index(score, n_bins: int = ECE_BINS) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    b = bin_bounds(n_bins)
    expr = None
    for i in range(n_bins):
        lo, hi = F.lit(b[i]), F.lit(b[i + 1])
        inside = (s >= lo) & ((s <= hi) if i == n_bins - 1 else (s < hi))
        expr = F.when(inside, F.lit(i)) if expr is None else expr.when(inside, F.lit(i))
    return expr


def reliability(df: DataFrame, score: str = "score", label: str = "label",
                n_bins: int = ECE_BINS, label_max: int = 1,
                by: Sequence[str] = ()) -> DataFrame:
    """Per bin: count, mean confidence, mean accuracy (E6).  Includes the
    ``bin = NULL`` row of unbinned samples so totals can be formed from it."""
    lab = F.col(label).cast("double")
    if label_max > 1:
        lab = lab / F.lit(float(label_max))
    s = F.col(score).cast("double")
    return (df.select(*by, s.alias("__s"), lab.alias("__l"))
            .withColumn("bin", bin_index("__s", n_bins))
            .groupBy(*by, "bin")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.avg("__s").alias("avg_conf"),
                 F.avg("__l").alias("avg_acc")))


def ece_from_reliability(rel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    binned = F.col("bin").isNotNull()
    gap = F.col("count") * F.abs(F.col("avg_conf") - F.col("avg_acc"))
    n = F.coalesce(F.col("num_samples"), F.lit(0))
    return rel.groupBy(*by).agg(
        F.sum("count").alias("num_samples"),
        F.sum(F.when(~binned, F.col("count")).otherwise(0)).alias("unbinned"),
        F.sum(F.when(binned, gap).otherwise(0.0)).alias("__gap")) \
        .select(*by, n.alias("num_samples"), F.coalesce("unbinned", F.lit(0)).alias("unbinned"),
                F.when(n == 0, F.lit(0.0))
                .otherwise(F.col("__gap") / F.col("num_samples")).alias("ece"))


def ece(df: DataFrame, score: str = "score", label: str = "label",
        n_bins: int = ECE_BINS, label_max: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error per ``by`` group (E5)."""
    return ece_from_reliability(reliability(df, score, label, n_bins, label_max, by), by)
