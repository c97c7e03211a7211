"""Sharpness ("polarization") of label distributions.

Inputs are score tables with a probability array.  Full-vocabulary
probabilities are renormalised over the labels first (label-only softmax,
T9).  Every metric is a mean of an unrolled per-row expression, so the whole
report is one partial/final hash aggregate per group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dist
from ..functions.constants import ENTROPY_EPS, SOFTEN_TEMPERATURE


def with_sharpness(df: DataFrame, p, n: int, temperature: float = SOFTEN_TEMPERATURE,
                   renorm: bool = True) -> DataFrame:
    """Per-row ``__ent``, ``__mx``, ``__sent`` (softened entropy) and, for two
    labels, ``__mg`` (C5-C8); null where there is no mass to share.

    The mass is a column that is null without mass, so everything made from it
    is null too and nothing else needs a guard; each later step is a column of
    its own and reads scalars.  The softened distribution is never built: with
    ``d = (ln q - max ln q) / T`` its entropy is ``ln S - sum(e^d d) / S`` with
    ``S = sum e^d``.  The generated loop stays below the size up to which the
    JVM compiles a method (a plan test holds that).
    """
    xs = [F.get(F.col(p) if isinstance(p, str) else p, F.lit(i)) for i in range(n)]
    mass = _added(xs)
    df = df.withColumn("__mass", F.when(mass > 0, mass) if renorm else mass * 0.0 + 1.0)

    def each(fn) -> list[Column]:
        return [fn(i) for i in range(n)]

    def columns(frame: DataFrame, name: str, values: list[Column]) -> DataFrame:
        return frame.withColumns({f"__{name}{i}": v for i, v in enumerate(values)})
    df = columns(df, "q", [x / F.col("__mass") for x in xs])
    df = columns(df, "z", each(lambda i: F.ln(F.least(F.greatest(F.col(f"__q{i}"), F.lit(ENTROPY_EPS)), F.lit(1.0)))))
    top = F.greatest(*each(lambda i: F.col(f"__z{i}"))) if n > 1 else F.col("__z0")
    there = F.col("__mass").isNotNull()
    df = columns(df.withColumn("__top", top), "d", each(lambda i: (F.col(f"__z{i}") - F.col("__top")) / F.lit(float(temperature))))
    df = columns(df, "e", each(lambda i: F.exp(F.col(f"__d{i}"))))
    total = _added(each(lambda i: F.col(f"__e{i}")))
    out = {"__ent": -_added(each(lambda i: F.exp(F.col(f"__z{i}")) * F.col(f"__z{i}"))),
           "__mx": F.greatest(*each(lambda i: F.col(f"__q{i}"))) if n > 1 else F.col("__q0"),
           "__sent": F.ln(total) - _added(each(lambda i: F.col(f"__e{i}") * F.col(f"__d{i}"))) / total}
    if n == 2:
        out["__mg"] = F.col("__z1") - F.col("__z0")
    df = df.withColumns({k: F.when(there, v) for k, v in out.items()})
    return df.drop("__mass", "__top", *[f"__{k}{i}" for k in "qzde" for i in range(n)])


def _added(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def temp_soften(df: DataFrame, probs: str, n: int,
                temperature: float = SOFTEN_TEMPERATURE) -> DataFrame:
    """Per-row softened distribution and its entropy change."""
    df = df.withColumn("__q", dist.renormalize(probs, n))
    df = df.withColumn("soft_probs", dist.soften("__q", n, temperature))
    return df.withColumn("entropy", dist.entropy("__q", n)) \
        .withColumn("soft_entropy", dist.entropy("soft_probs", n)).drop("__q")


def polarization(df: DataFrame, probs: str, n: int, by: Sequence[str] = (),
                 temperature: float = SOFTEN_TEMPERATURE, renorm: bool = True,
                 logits_margin: str | None = None) -> DataFrame:
    """Mean entropy, mean max-prob, temperature sensitivity and — for two
    labels — mean and population variance of the margin (E7).

    ``logits_margin`` names a precomputed ``logit_1 - logit_0`` column; without
    it the margin comes from the probabilities (same value, C5).
    """
    keep = list(by) + ([logits_margin] if logits_margin else [])
    rows = with_sharpness(df.select(*keep, probs), probs, n, temperature, renorm)
    aggs = [F.count(F.lit(1)).alias("num_samples"),
            F.avg("__ent").alias("mean_entropy"),
            F.avg("__mx").alias("mean_maxprob"),
            (F.avg("__sent") - F.avg("__ent")).alias("temp_sensitivity")]
    if n == 2:
        m = F.col(logits_margin) if logits_margin else F.col("__mg")
        aggs += [F.avg(m).alias("mean_margin"), F.var_pop(m).alias("var_margin")]
    return rows.groupBy(*by).agg(*aggs)


def size_number(c) -> Column:
    """The parameter count that a size tag such as ``1.5B`` or ``560M`` names; null without one."""
    tag = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*([KMBT])(?![A-Za-z])"
    number = F.regexp_extract(c, tag, 1).try_cast("double")
    unit = F.upper(F.regexp_extract(c, tag, 2))
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).when(unit == "T", 1e12)
    return number * scale


def polarization_trend(report: DataFrame, size_col: str = "teacher_size",
                       by: Sequence[str] = ()) -> DataFrame:
    """Along increasing teacher size, does every step sharpen?

    A step sharpens when mean entropy falls and margin mean and variance rise.
    Sizes written as text (``7B``, ``560M``) are ordered by their number.  The
    report has one row per teacher, so the window is tiny.
    """
    order = [F.col(size_col)]
    if isinstance(report.schema[size_col].dataType, T.StringType):
        order.insert(0, size_number(size_col).asc_nulls_first())
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    steps = report
    conds = [F.col("mean_entropy") < F.lag("mean_entropy").over(w)]
    if "mean_margin" in report.columns:
        conds += [F.col("mean_margin") > F.lag("mean_margin").over(w),
                  F.col("var_margin") > F.lag("var_margin").over(w)]
    sharper = conds[0]
    for c in conds[1:]:
        sharper = sharper & c
    steps = steps.withColumn("is_first", F.lag(size_col).over(w).isNull()) \
        .withColumn("sharper", F.when(F.col("is_first"), F.lit(None).cast("boolean"))
                    .otherwise(F.coalesce(sharper, F.lit(False))))
    agg_w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return steps.withColumn(
        "trend_holds",
        F.coalesce(F.min(F.col("sharper").cast("int")).over(agg_w) == 1, F.lit(True)))
