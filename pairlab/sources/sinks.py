"""Sinks: soft-label Parquet, JSON lines, JSON reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOFT_LABEL_COLUMNS = ("query", "title", "passage", "label", "teacher_probs")


def write_soft_labels(df: DataFrame, path: str, max_records_per_file: int = 1_000_000,
                      mode: str = "overwrite") -> None:
    """Fixed five-column soft-label table, snappy Parquet.

    ``teacher_probs`` is written as JSON text; a map column is encoded here.
    Output chunking is ``maxRecordsPerFile`` plus Parquet row groups.
    """
    cols = []
    for c in SOFT_LABEL_COLUMNS:
        col = F.col(c)
        if c == "label":
            col = col.cast("int")
        elif c == "teacher_probs" and isinstance(df.schema[c].dataType, T.MapType):
            col = F.to_json(col)
        cols.append(col.alias(c))
    (df.select(*cols).write.mode(mode).option("compression", "snappy")
     .option("maxRecordsPerFile", max_records_per_file).parquet(path))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, UTF-8 with non-ASCII kept, nulls written as null (A10)."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_report(summary: DataFrame, path: str, details: dict[str, DataFrame] | None = None,
                 mode: str = "overwrite") -> None:
    """Report sink (A11): the summary table and each detail table as JSON
    lines under ``path/<name>``.  Details stay distributed; nothing is nested
    through the driver."""
    write_jsonl(summary, f"{path}/summary", mode)
    for name, df in (details or {}).items():
        write_jsonl(df, f"{path}/{name}", mode)


def write_nested_report(summary: DataFrame, name: str, elements: DataFrame, order: Sequence[str], path: str,
                        drop: Sequence[str] = (), mode: str = "overwrite") -> None:
    """One JSON document in parts (A11): the summary's fields and ``name``, the list of all ``elements``.

    The text files below ``path`` (``0-head``, ``1-body``, ``2-tail``), joined in
    the order of their names, are the document.  Only the summary and the first
    element pass through the driver; the others are range-sorted by ``order``,
    which must tell elements apart, and each starts with the comma before it.
    ``drop`` names columns that order the elements but are not written.
    """
    spark = summary.sparkSession
    options = {"ignoreNullFields": "false"}
    row = summary.select(F.to_json(F.struct("*"), options).alias("json")).first()
    head = (row["json"][:-1] if row else "{")
    shown = [F.col(f"`{c}`") for c in elements.columns if c not in drop]
    lines = elements.select(F.struct(*order).alias("__at"), F.to_json(F.struct(*shown), options).alias("json"))
    first = lines.orderBy("__at").limit(2).collect()
    if len(first) == 2 and first[0]["__at"] == first[1]["__at"]:
        raise ValueError(f"order {list(order)} does not tell elements apart")
    head += f"{', ' if head != '{' else ''}{json.dumps(name, ensure_ascii=False)}: [" + (first[0]["json"] if first else "")
    body = lines.where(F.col("__at") > lines.agg(F.min("__at")).scalar()).orderBy("__at") if first else lines

    def write(df: DataFrame, part: str) -> None:
        df.write.mode(mode).text(f"{path}/{part}")
    write(spark.createDataFrame([(head,)], "value string").coalesce(1), "0-head")
    write(body.select(F.concat(F.lit(","), "json").alias("value")), "1-body")
    write(spark.createDataFrame([("]}",)], "value string").coalesce(1), "2-tail")
