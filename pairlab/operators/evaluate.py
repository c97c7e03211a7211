"""Evaluation glue: column typing, row-count check, positional join, report rounding
(B21, B22, B23, D3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def eval_columns(df: DataFrame, query_key: str, label_key: str, score_col: str | None = None,
                 qid: str = "qid", rel: str = "rel", score: str = "score") -> DataFrame:
    """Query id as text, label and score as DOUBLE (B21); a null, absent or
    non-numeric label or score raises."""
    out = df.withColumn(qid, F.col(query_key).cast("string")).withColumn(rel, _number(label_key))
    return out if score_col is None else out.withColumn(score, _number(score_col))


def _number(name: str) -> Column:
    absent = F.raise_error(F.lit(f"null {name} in evaluation rows")).cast("double")
    return F.when(F.col(name).isNull(), absent).otherwise(F.col(name).cast("double"))


def assert_same_count(a: DataFrame, b: DataFrame, what: str = "rows") -> int:
    """Raise unless both tables have the same number of rows (B22).  One job:
    both counts are partial aggregates of a single union."""
    tagged = a.select(F.lit(0).alias("__side")).unionByName(b.select(F.lit(1).alias("__side")))
    row = tagged.agg(F.sum(F.when(F.col("__side") == 0, 1).otherwise(0)).alias("na"),
                     F.sum(F.when(F.col("__side") == 1, 1).otherwise(0)).alias("nb")).first()
    na, nb = int(row["na"] or 0), int(row["nb"] or 0)
    if na != nb:
        raise ValueError(f"{what} differ: {na} vs {nb}")
    return na


def join_scores(pairs: DataFrame, scores: DataFrame, index: str = "global_idx",
                check_count: bool = True) -> DataFrame:
    """Positional evaluation join (D3, T2): row i of the scores with the i-th
    non-blank pair, i.e. an equi-join on the dense ``global_idx``."""
    if check_count:
        assert_same_count(scores, pairs, "score and pair rows")
    return pairs.join(scores, index, "inner")


def _parts(x: Column) -> tuple[Column, Column]:
    """A double as the sum of two halves of its digits, whose products are exact."""
    c = x * F.lit(float((1 << 27) + 1))
    high = c - (c - x)
    return high, x - high


def round_py(c, dp: int) -> Column:
    """Python ``round(x, dp)`` (B23, T8): correctly rounded from the binary value.

    The product ``p`` of the value and ``10**dp`` is rounded to a double, so a
    ``p`` just in the middle of two results may stand for a value beside it.
    The error of the product is a double too (the halves' products are exact)
    and its sign decides; without an error the even result is taken.  Beyond
    2**53 results are closer together than doubles, so the value stays.
    """
    if not 0 <= dp <= 22:
        raise ValueError("dp must be from 0 to 22")
    x, scale = (F.col(c) if isinstance(c, str) else c).cast("double"), 10.0 ** dp
    p = x * F.lit(scale)
    (xh, xl), (sh, sl) = _parts(x), _parts(F.lit(scale))
    error = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
    low = F.floor(p).cast("double")
    middle = p - low == 0.5
    near = F.when(middle & (error > 0), low + 1).when(middle & (error < 0), low).otherwise(F.rint(p))
    rounded = F.when(near == 0, p * F.lit(0.0)).otherwise(near / F.lit(scale))  # keeps the sign of zero
    return F.when(F.abs(p) < F.lit(2.0 ** 53), rounded).otherwise(x)


def round_report(df: DataFrame, dp: int = 4) -> DataFrame:
    """Round every DOUBLE column of a report table the way Python's ``round``
    does (B23); other columns pass through."""
    cols = [round_py(f.name, dp).alias(f.name) if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)
