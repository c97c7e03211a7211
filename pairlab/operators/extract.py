"""Field extraction from Parquet trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import falsy_to_empty


def extract_fields(df: DataFrame, fields: Sequence[str] = ("query", "title", "passage"),
                   keep: Sequence[str] = ()) -> DataFrame:
    """Chosen columns stringified, falsy values (null, "", 0, False) -> "" (B15).

    ``keep`` columns pass through untouched (e.g. a row id).  A narrow
    projection (B28): Parquet reads only these columns, no shuffle.
    """
    out = [F.col(k) for k in keep]
    for f in fields:
        if f in keep:
            continue
        out.append(falsy_to_empty(f, df.schema[f].dataType).alias(f))
    return df.select(*out)


def extract_counts(df: DataFrame) -> DataFrame:
    """Rows per source file and in total (E15).  ``df`` must come straight from a
    file scan so that ``_metadata`` is available."""
    per_file = df.groupBy(F.col("_metadata.file_name").alias("file_name")).count()
    return per_file.unionByName(per_file.agg(F.lit(None).cast("string").alias("file_name"),
                                             F.sum("count").alias("count")))
