"""Score-file scans and sinks.

A score file is a tab-separated text file with a header naming at least
``global_idx`` and ``all_digit_scores``.  Two readers exist:

* tolerant (``read_scores_tolerant``): naive tab split of the stripped line,
  no quoting; blank, short, bad-index and bad-dict lines are skipped with a
  reason.  Each file's own header (line 0) locates the columns.
* strict (``read_scores``): CSV with quoting; columns are found by header name,
  so files of any column order and of the three-column layout are read alike.
  Quoted line breaks do not tie a file to one task (``quoted``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import (
    SCORE_INDEX_COLUMN, SCORE_PROBS_COLUMN, SCORE_TEXT_COLUMN, SCORE_WEIGHTED_COLUMN,
)
from ..functions.parse import parse_prob_map, probs_to_text
from ..functions.text import py_strip
from ..operators.evaluate import round_py
from .lines import read_indexed
from .quoted import fields, header_columns, read_records

STATUS_OK = "ok"
#: Columns of a score file, their types, and whether a file must have them.
SCORE_COLUMNS = ((SCORE_INDEX_COLUMN, "bigint", True), (SCORE_PROBS_COLUMN, "string", True),
                 (SCORE_TEXT_COLUMN, "string", False), (SCORE_WEIGHTED_COLUMN, "double", False))


def _pos(cols: Column, name: str) -> Column:
    """0-based position of ``name`` in a split header; raises when absent."""
    p = F.array_position(cols, F.lit(name)) - 1
    return F.when(p < 0, F.raise_error(F.concat(F.lit(f"score header lacks '{name}': "),
                                                  F.array_join(cols, ",")))).otherwise(p)


def score_row_status(df: DataFrame, line: str, h: str) -> DataFrame:
    """Parse stripped lines in stages: status, index, probability map.

    Each stage is its own projection holding the previous stage's values as
    columns, so the strip, the split and the JSON parse run once per line
    (Catalyst does not collapse projections that would repeat them).
    """
    idx_pos, probs_pos = _pos(F.col(h), SCORE_INDEX_COLUMN), _pos(F.col(h), SCORE_PROBS_COLUMN)
    df = df.withColumn("__s", py_strip(line))
    df = df.withColumn("__parts", F.split("__s", "\t", -1)) \
        .withColumn("__ip", idx_pos.cast("int")).withColumn("__pp", probs_pos.cast("int"))
    df = df.withColumn("__itxt", F.get(F.col("__parts"), F.col("__ip"))) \
        .withColumn("__ptxt", F.get(F.col("__parts"), F.col("__pp")))
    df = df.withColumn("__idx", F.when(F.col("__itxt").rlike("^\\s*[+-]?[0-9]+\\s*$"),
                                       F.trim("__itxt").try_cast("long"))) \
        .withColumn("__probs", parse_prob_map("__ptxt"))
    status = (F.when(F.col("__s") == "", F.lit("blank"))
              .when(F.size("__parts") <= F.greatest("__ip", "__pp"), F.lit("too_few_columns"))
              .when(F.col("__idx").isNull(), F.lit("bad_index"))
              .when(F.col("__probs").isNull(), F.lit("bad_probs"))
              .otherwise(F.lit(STATUS_OK)))
    df = df.withColumn("status", status)
    # Evaluate the parse once per line: a filter on ``status`` must not be
    # pushed below this point, or Catalyst would inline the strip/split/parse
    # into the predicate (and every branch of it).  Columns produced by a
    # generator are not pushed through, so the parse result is emitted as a
    # one-element inline.
    keep = [c for c in df.columns if not c.startswith("__") and c != "status"]
    parsed = F.struct(F.col("__parts").alias("__parts"), F.col("__idx").alias("__idx"),
                      F.col("__probs").alias("__probs"), F.col("status").alias("status"))
    return df.select(*keep, "__h", F.inline(F.array(parsed)))


def parse_score_lines(lines: DataFrame, header: Sequence[str] | None = None,
                      file_col: str = "file_ord", line_col: str = "line",
                      line_idx_col: str = "line_idx", keep: Sequence[str] = ()) -> DataFrame:
    """Tolerant parse of score-file lines (A4).

    ``lines`` holds ``file_col``, ``line_idx_col`` (physical, 0 = header) and
    ``line_col``.  With ``header=None`` each file's line 0 is its header, found
    in ``file_first`` on every row; otherwise ``header`` applies to all lines
    and no line is treated as a header.  An index beyond 64 bits is bad.  Output: every body line with
    ``status`` and, when ok, ``global_idx``, ``probs``, ``output_text`` and
    ``weighted_score`` (the last two when the header names them).
    """
    if header is None:
        body = lines.where(F.col(line_idx_col) > 0) \
            .withColumn("__h", F.split(py_strip("file_first"), "\t", -1)).drop("file_first")
    else:
        body = lines.withColumn("__h", F.array(*[F.lit(c) for c in header]))
    h = F.col("__h")
    text_pos = (F.array_position(h, F.lit(SCORE_TEXT_COLUMN)) - 1).cast("int")
    w_pos = (F.array_position(h, F.lit(SCORE_WEIGHTED_COLUMN)) - 1).cast("int")
    r = score_row_status(body, line_col, "__h")
    ok = F.col("status") == STATUS_OK
    return r.select(
        F.col(file_col), F.col(line_idx_col), *keep, "status",
        F.when(ok, F.col("__idx")).alias("global_idx"),
        F.when(ok, F.col("__probs")).alias("probs"),
        F.when(ok & (text_pos >= 0), F.get(F.col("__parts"), text_pos)).alias("output_text"),
        F.when(ok & (w_pos >= 0), F.get(F.col("__parts"), w_pos).try_cast("double"))
        .alias("weighted_score"))


def read_scores_tolerant(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Tolerant scan of one or more score files in the given order (A4); ``given``
    is the position of the path argument."""
    lines = read_indexed(spark, paths, "physical", with_first=True) \
        .select("file_ord", "given", F.col("line_in_file").alias("line_idx"), "line", "file_first")
    return parse_score_lines(lines, keep=("given",))


def _typed(value: Column, name: str, dtype: str) -> Column:
    """A column's value; bad values and a missing index raise."""
    if dtype != "string":
        value = F.trim(value).cast(dtype)  # ANSI: bad text raises
    if name == SCORE_INDEX_COLUMN:
        value = F.when(value.isNull(), F.raise_error(F.lit("score row without an index")).cast(dtype)).otherwise(value)
    return value.alias(name)


def read_score_rows(spark: SparkSession, paths: str | Sequence[str],
                    columns: Sequence[tuple[str, str, bool]] = SCORE_COLUMNS) -> DataFrame:
    """Strict rows with ``file_path``, ``block_start``, ``seq`` and ``given``.

    Files are read by split, whatever line breaks their quoted values hold (see
    ``quoted``).  Columns are taken by each file's own header, also within a
    directory; ``given`` is the position of the path argument.
    """
    records, files = read_records(spark, paths)
    headers = [r["header"] for r in files.select("header").distinct().collect()]  # one per layout
    names = [[c.strip('"') for c in (h or "").split("\t")] for h in headers]
    for cols in names:
        for name, _, required in columns:
            if required and name not in cols:
                raise ValueError(f"score file lacks column {name!r}: {cols}")
    cols = header_columns(F.col("header"))
    places = files.select("file_path", F.col("file_ord").alias("given"),
                          *[F.array_position(cols, F.lit(name)).cast("int").alias(f"__at{i}") for i, (name, _, _) in enumerate(columns)])
    rows = records.join(places, "file_path").select(
        "file_path", "block_start", "seq", "given", *[f"__at{i}" for i in range(len(columns))],
        F.inline(F.array(F.struct(fields(F.col("record"), max(map(len, names), default=1)).alias("__values")))))
    return rows.select(*[_typed(F.when(F.col(f"__at{i}") > 0, F.get("__values", F.col(f"__at{i}") - 1)), name, dtype)
                         for i, (name, dtype, _) in enumerate(columns)], "file_path", "block_start", "seq", "given")


def read_scores(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Strict scan with quoting, by header name (A5, T16): the score columns and ``probs``."""
    rows = read_score_rows(spark, paths).drop("file_path", "block_start", "seq", "given")
    return rows.withColumn("probs", parse_prob_map(SCORE_PROBS_COLUMN))


#: A shard is a file, or a directory of part files as Spark writes them.
SHARD_RANK = r"\.rank(\d+)\.tmp(?:/[^/]*)?$"


def shard_path(prefix: str, rank: int) -> str:
    return f"{prefix}.rank{rank}.tmp"


def shard_files(spark: SparkSession, prefix: str, world_size: int, min_bytes: int | None = None) -> DataFrame:
    """Shard files with ``rank``, ``path``, ``length`` and ``present``.

    Present: a header and at least one more line that isn't blank.  With
    ``min_bytes`` a file must also be larger than that.  File metadata and
    non-blank lines are read; works on any Hadoop file system.
    """
    schema = "path string, length long, rank int, present boolean"
    rank = F.regexp_extract("path", SHARD_RANK, 1)
    try:
        meta = (spark.read.format("binaryFile").load(f"{prefix}.rank*.tmp").select("path", "length")
                .withColumn("rank", F.when(rank != "", rank.cast("int"))))
        lines = spark.read.text(f"{prefix}.rank*.tmp").where(py_strip("value") != "") \
            .withColumn("path", F.col("_metadata.file_path"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    full = lines.groupBy("path").agg((F.count(F.lit(1)) > 1).alias("__full"))
    out = meta.where(F.col("rank").isNotNull() & (F.col("rank") < world_size)).join(full, "path", "left")
    present = F.coalesce("__full", F.lit(False))
    if min_bytes is not None:
        present = present & (F.col("length") > min_bytes)
    return out.select("path", "length", "rank", present.alias("present"))


def read_score_shards(spark: SparkSession, prefix: str, world_size: int, min_bytes: int | None = None,
                      tolerant: bool = False) -> DataFrame:
    """Score rows of every present shard ``<prefix>.rank{r}.tmp`` with ``rank``.

    The present-file list (at most ``world_size`` names) is what the scan is
    built from; absent shards contribute no rows
    (``operators.shards.missing_ranks`` reports them).
    """
    files = [r.path for r in shard_files(spark, prefix, world_size, min_bytes)
             .where("present").orderBy("rank").select("path").collect()]
    return read_shard_rows(spark, files, tolerant)


def read_shard_rows(spark: SparkSession, files: Sequence[str], tolerant: bool = False) -> DataFrame:
    """Score rows of the given shard files with ``rank``."""
    if not files:
        raise FileNotFoundError("no score shard is present")
    rank = F.regexp_extract("file_path", SHARD_RANK, 1).cast("int")
    if tolerant:
        lines = read_indexed(spark, files, "physical", with_first=True)
        lines = lines.select("file_ord", F.col("line_in_file").alias("line_idx"), "line", "file_first",
                             rank.alias("rank"))
        return parse_score_lines(lines, keep=("rank",))
    rows = read_score_rows(spark, files)
    return rows.withColumn("rank", rank).drop("file_path", "block_start", "seq", "given") \
        .withColumn("probs", parse_prob_map(SCORE_PROBS_COLUMN))


def write_scores(df: DataFrame, path: str, round_dp: int | None = None,
                 with_text: bool = True) -> None:
    """Score TSV sink, globally ordered by ``global_idx``.

    ``orderBy`` range-partitions the rows, so part files are ordered among
    themselves; probabilities are written as a single-quoted dict, which no
    reader needs quoting for (T26).  ``round_dp`` rounds probabilities and the
    weighted score as Python does (cross-encoder form).
    """
    probs = F.col("probs")
    w = F.col("weighted_score")
    if round_dp is not None:
        probs = F.transform_values(probs, lambda k, v: round_py(v, round_dp))
        w = round_py(w, round_dp)
    cols = [F.col("global_idx").alias(SCORE_INDEX_COLUMN),
            probs_to_text(probs).alias(SCORE_PROBS_COLUMN)]
    if with_text:
        cols.append(F.col("output_text").alias(SCORE_TEXT_COLUMN))
    cols.append(w.alias(SCORE_WEIGHTED_COLUMN))
    (df.select(*cols).orderBy(SCORE_INDEX_COLUMN)
     .write.mode("overwrite").option("sep", "\t").option("header", "true")
     .option("quote", '"').option("escape", '"').csv(path))
