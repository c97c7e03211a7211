"""Position-indexed line scans.

Spark rows have no position, but score files are keyed by the 0-based line
number of the pair file.  ``with_positions`` attaches it to the rows of any
file scan without a single-partition window over rows and without
``zipWithIndex``:

1. every row carries its split ``(file, block_start)`` and
   ``monotonically_increasing_id()`` (contiguous inside a split);
2. aggregate per split: row count, smallest id and first line — one row per split;
3. prefix-sum the split counts in (file order, block start) order — a window
   over the split table only, whose size is bytes / maxPartitionBytes;
4. join the offsets back.

That is two scans of the files: one narrow for the splits, one for the rows.
``numbering='physical'`` counts every line; ``'dense'`` drops blank lines
(whitespace only) first.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip


def as_list(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _path_pattern(path: str) -> str:
    """A regular expression for the files that a path argument names: the file
    itself, what lies below a directory, or what a glob matches."""
    path = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "", path).rstrip("/")
    globs = {"*": "[^/]*", "?": "[^/]", "{": "(", "}": ")", ",": "|", "[": "[", "]": "]"}
    is_glob = any(c in path for c in "*?[{")
    body = "".join(globs[c] if is_glob and c in globs else re.escape(c) for c in path)
    return rf"(^|[^/]/|:/*|//[^/]*){body}(/.*)?$" if path.startswith("/") else rf"(^|/){body}(/.*)?$"


def given_order(file_path: Column, paths: Sequence[str]) -> Column:
    """The position of the first path argument that names the file."""
    plain = F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))
    patterns = F.array(*[F.lit(_path_pattern(p)) for p in paths])
    hits = F.transform(patterns, lambda p, i: F.when(F.rlike(plain, p), i))
    return F.coalesce(F.array_min(hits), F.lit(len(paths)))


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw lines with their file path and split start, from one scan of all paths."""
    return spark.read.text(as_list(paths)).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"))


def with_positions(rows: DataFrame, paths: str | Sequence[str],
                   first_of: str | None = None) -> DataFrame:
    """``rows`` of a file scan (with ``file_path, block_start``, and ``seq`` where
    they do not come in their split's order) plus ``file_ord``
    (files in the given order, then by path), ``given`` (the position of the path
    argument), ``global_idx`` (across files) and
    ``line_in_file`` (A2, T1, G5).  ``first_of`` names a column whose first
    value in the file every row gets as ``file_first`` (a header line).

    The windows below run over the split table, one row per input split.
    """
    rows = rows.drop("given").withColumn("__mid", F.col("seq") if "seq" in rows.columns else F.monotonically_increasing_id())
    first = F.min_by(F.col(first_of), "__mid") if first_of else F.lit(None).cast("string")
    splits = rows.groupBy("file_path", "block_start").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__mid0"), first.alias("__first"))
    splits = splits.withColumn("__given", given_order(F.col("file_path"), as_list(paths)))
    files = Window.orderBy("__given", "file_path")
    w_all = Window.orderBy("__given", "file_path", "block_start").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file_path").orderBy("block_start")
    offsets = splits.select(
        "file_path", "block_start", "__mid0", F.col("__given").alias("given"),
        (F.dense_rank().over(files) - 1).alias("file_ord"),
        F.coalesce(F.sum("__n").over(w_all), F.lit(0)).alias("__off"),
        F.coalesce(F.sum("__n").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__foff"),
        F.first("__first").over(in_file).alias("file_first"))
    local = F.col("__mid") - F.col("__mid0")
    out = rows.join(offsets, ["file_path", "block_start"]) \
        .withColumn("global_idx", F.col("__off") + local).withColumn("line_in_file", F.col("__foff") + local)
    drop = ["__mid", "__mid0", "__off", "__foff", "block_start"]
    return out.drop(*drop) if first_of else out.drop(*drop, "file_first")


def read_indexed(spark: SparkSession, paths: str | Sequence[str],
                 numbering: str = "physical", with_first: bool = False) -> DataFrame:
    """Lines with ``file_path, file_ord, global_idx`` (across files, in file
    order) and ``line_in_file`` (0-based, per file), by the chosen numbering;
    ``with_first`` adds each file's first line as ``file_first``."""
    if numbering not in ("physical", "dense"):
        raise ValueError("numbering must be 'physical' or 'dense'")
    lines = read_lines(spark, paths)
    if numbering == "dense":
        lines = lines.where(py_strip("line") != "")
    out = with_positions(lines, paths, "line" if with_first else None)
    cols = ["file_path", "file_ord", "given", "global_idx", "line_in_file", "line"]
    return out.select(*cols, *(["file_first"] if with_first else []))
