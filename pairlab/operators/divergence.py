"""Teacher vs student distributions.

``pair_distributions`` joins a teacher and a student score table on row
identity; ``divergence_columns`` adds one per-row column per kind and
``divergence_report`` averages them (``batchmean``: row sums / rows, times
the loss weight).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist


def pair_distributions(teacher: DataFrame, student: DataFrame,
                       keys: Sequence[str] = ("global_idx",),
                       teacher_col: str = "probs", student_col: str = "probs") -> DataFrame:
    """Teacher ⋈ student on row identity (D8): columns ``keys, t, s``.

    An equi-join on the keys; AQE picks broadcast for a small side at run time
    and sort-merge otherwise.
    """
    t = teacher.select(*keys, F.col(teacher_col).alias("t"))
    s = student.select(*keys, F.col(student_col).alias("s"))
    return t.join(s, list(keys), "inner")


def divergence_columns(df: DataFrame, n: int, kinds: Sequence[str] = ("jsd", "fkl", "rkl", "hard"),
                       t: str = "t", s: str = "s") -> DataFrame:
    for k in kinds:
        df = df.withColumn(f"div_{dist.check_kind(k)}", dist.divergence(t, s, n, k))
    return df


def divergence_report(df: DataFrame, n: int,
                      kinds: Sequence[str] = ("jsd", "fkl", "rkl", "hard"),
                      weight: float = 1.0, by: Sequence[str] = (),
                      t: str = "t", s: str = "s") -> DataFrame:
    """Mean per-row divergence times ``weight`` for each kind."""
    aggs = [F.count(F.lit(1)).alias("num_rows")]
    for k in kinds:
        name = dist.check_kind(k)
        aggs.append((F.avg(dist.divergence(t, s, n, k)) * F.lit(float(weight)))
                    .alias(f"loss_{name}"))
    return df.groupBy(*by).agg(*aggs)
