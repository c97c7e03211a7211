"""Pair-table scans: JSON lines with row positions, Parquet trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import LABEL_KEY_CANDIDATES, QUERY_KEY_CANDIDATES
from ..functions.text import py_strip
from .lines import read_indexed

# Pair fields are read as strings: ``int(label)`` accepts 2, 2.7 and "3",
# which an INT schema would turn into NULL.
PAIR_SCHEMA = T.StructType([
    T.StructField("qid", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("docid", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("passage", T.StringType()),
    T.StructField("label", T.StringType()),
])


def read_pairs(spark: SparkSession, paths: str | Sequence[str],
               schema: T.StructType = PAIR_SCHEMA, numbering: str = "dense",
               on_blank: str = "skip", absent_as_empty: Sequence[str] = ()) -> DataFrame:
    """JSON-lines pair file(s) with ``global_idx`` (A1 + A2).

    ``numbering='dense'`` numbers non-blank lines (evaluation and scoring);
    ``'physical'`` counts blank lines too and keeps them as rows with
    ``is_blank`` set (merge).  ``on_blank='fail'`` raises on a blank line, as the
    cross-encoder loaders do.  Fields named in ``absent_as_empty`` become ""
    when the key is absent from the object (JSON null stays null, B13).
    """
    if on_blank not in ("skip", "fail"):
        raise ValueError("on_blank must be 'skip' or 'fail'")
    lines = read_indexed(spark, paths, "physical" if on_blank == "fail" else numbering)
    blank = py_strip("line") == ""
    if on_blank == "fail":
        lines = lines.withColumn("line", F.when(blank, F.raise_error(F.lit("blank line in pair file")))
                                 .otherwise(F.col("line")))
    parsed = F.from_json("line", schema, {"mode": "FAILFAST"})
    out = lines.withColumn("is_blank", blank) \
        .withColumn("__obj", F.when(~F.col("is_blank"), parsed))
    cols = [F.col("global_idx"), F.col("is_blank")] + \
        [F.col(f"__obj.{f.name}").alias(f.name) for f in schema.fields]
    out = out.select(*cols, "line")
    for f in absent_as_empty:
        present = F.array_contains(F.json_object_keys("line"), F.lit(f))
        out = out.withColumn(f, F.when(F.col("is_blank") | present, F.col(f)).otherwise(F.lit("")))
    return out.drop("line")


def read_parquet_tree(spark: SparkSession, path: str,
                      columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet file, flat directory or, where that holds no Parquet file, nested
    directory (A3), on any file system that Spark reads.  ``columns`` prunes the
    scan.  An empty or absent tree raises ``FileNotFoundError``."""
    none = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
    try:
        df = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    except AnalysisException as flat:
        if flat.getCondition() not in none:
            raise
        try:
            df = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path)
        except AnalysisException as nested:
            if nested.getCondition() not in none:
                raise
            raise FileNotFoundError(f"no parquet files under {path}") from nested
    return df.select(*columns) if columns else df


def detect_keys(df: DataFrame, query_key: str | None = None,
                label_key: str | None = None) -> tuple[str, str]:
    """First present query-key and label-key candidates; explicit names win."""
    cols = set(df.columns)

    def pick(explicit, candidates, what):
        if explicit is not None:
            if explicit not in cols:
                raise ValueError(f"{what} column {explicit!r} not in {sorted(cols)}")
            return explicit
        for c in candidates:
            if c in cols:
                return c
        raise ValueError(f"cannot detect the {what} column among {sorted(cols)}")

    return pick(query_key, QUERY_KEY_CANDIDATES, "query"), pick(label_key, LABEL_KEY_CANDIDATES, "label")
