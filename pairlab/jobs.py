"""End-to-end jobs over files: each is a chain of library operators with one sink.

* ``ndcg_report``   score TSV + pair JSONL -> per-query NDCG, summary, CDF, worst queries
* ``merge_to_soft_labels``  pair JSONL + score TSVs -> soft-label Parquet + counters
* ``extract_to_jsonl``  Parquet tree -> chosen fields as JSON lines
* ``merge_shards``  ``<prefix>.rank{r}.tmp`` shards -> one ordered score TSV + missing ranks
* ``run_report``  score TSVs of many runs + pair JSONLs -> one evaluation row per (run, data set)
* ``polarization_report``  score TSVs of many teachers -> sharpness per teacher and its trend
* ``resume``  pair JSONL + score shards + a scorer -> one complete, ordered score TSV
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.constants import NDCG_KS, SCORE_PROBS_COLUMN, SCORE_WEIGHTED_COLUMN
from .functions.parse import parse_prob_map, prob_vector
from .functions.text import label_int, normalize_qid, py_strip
from .operators import learn, merge, ranking, runs, shards, sharpness
from .session import materialized
from .operators.evaluate import eval_columns, round_report
from .operators.extract import extract_counts, extract_fields
from .sources.lines import read_indexed, with_positions
from .sources.pairs import PAIR_SCHEMA, detect_keys, read_pairs, read_parquet_tree
from .sources.scores import (read_score_rows, read_scores_tolerant, read_shard_rows, shard_files,
                             write_scores)
from .sources.sinks import write_jsonl, write_nested_report, write_report, write_soft_labels


_WRITTEN = {"output_texts": "output_text", "weighted_scores": "weighted_score"}


def _first_object_keys(spark: SparkSession, path: str) -> list[str]:
    """Keys of the first non-blank JSON line (key detection looks at one row, B14)."""
    from .functions.text import py_strip
    row = (spark.read.text(path).where(py_strip("value") != "")
           .select(F.json_object_keys("value").alias("k")).limit(1).first())
    if row is None:
        raise ValueError(f"no data rows in {path}")
    return list(row["k"] or [])


def _positional_scores(spark: SparkSession, path: str, score_col: str) -> DataFrame:
    """Score rows numbered by position among the data rows of the file(s): each
    file has its own header, quoted values may hold tabs and line breaks, and a
    value that is no number raises."""
    rows = read_score_rows(spark, path, columns=((score_col, "double", True),))
    return with_positions(rows, path).select("global_idx", F.col(score_col).alias("__score"))


def ndcg_tables(spark: SparkSession, infer_path: str, data_path: str,
                query_key: str | None = None, label_key: str | None = None,
                score_col: str = SCORE_WEIGHTED_COLUMN, ks: Sequence[int] = NDCG_KS,
                qid_mode: str = "nfkc") -> dict:
    """NDCG evaluation of a score file against its pair file (3.1).

    Scores align with the non-blank pair lines by position (dense numbering,
    T2); the row counts must match (B22).  Query keys are NFKC-normalised,
    lower-cased and stripped (``qid_mode='nfkc'``, B4) or taken as their raw
    text (``'raw'``, T5).
    """
    if qid_mode not in ("nfkc", "raw"):
        raise ValueError("qid_mode must be 'nfkc' or 'raw'")
    keys = _first_object_keys(spark, data_path)
    probe = spark.createDataFrame([], ", ".join(f"`{k}` string" for k in keys) or "x string")
    qk, lk = detect_keys(probe, query_key, label_key)
    schema = T.StructType([T.StructField(k, T.StringType()) for k in dict.fromkeys((qk, lk))])
    pairs = read_pairs(spark, data_path, schema=schema, numbering="dense").select(
        "global_idx", F.col(qk).alias("__qid"), F.col(lk).alias("__rel"), F.lit(1).alias("__pair"))
    scores = _positional_scores(spark, infer_path, score_col).withColumn("__one", F.lit(1))
    # one narrow row per pair, read by every branch below
    rows = materialized(pairs.join(scores, "global_idx", "full_outer"), "ndcg")
    n = rows.agg(F.count("__pair").alias("pairs"), F.count("__one").alias("scores")).first()
    if n["pairs"] != n["scores"]:
        raise ValueError(f"score and pair rows differ: {n['scores']} vs {n['pairs']}")
    ev = eval_columns(rows, "__qid", "__rel", "__score").select("global_idx", "qid", "rel", "score")
    if qid_mode == "nfkc":
        ev = normalize_qid(ev, "qid")
    # one row per query, read by five outputs
    pq = materialized(ranking.ndcg_per_query(ev, ks=ks, tie=("global_idx",)), "ndcg-per-query")
    return {
        "per_query": pq.orderBy("first_key"),
        "summary": ranking.ndcg_summary(pq, ks),
        "corpus": ranking.corpus_stats(pq),
        "cdf": ranking.ndcg_cdf(pq),
        "worst": ranking.worst_queries(pq),
    }


def ndcg_report(spark: SparkSession, infer_path: str, data_path: str, out_path: str,
                round_dp: int | None = 4, **kw) -> None:
    """Write the NDCG report tables, and one nested document in parts under ``report`` (A11).  Metric values are rounded as Python
    rounds them (4 dp by default, ``None`` keeps full precision); the summary
    names its input files."""
    t = ndcg_tables(spark, infer_path, data_path, **kw)
    if round_dp is not None:
        t = {k: round_report(v, round_dp) for k, v in t.items()}
    t["summary"] = t["summary"].select(F.lit(infer_path).alias("infer_file"), F.lit(data_path).alias("data_file"), "*")
    write_nested_report(t["summary"], "per_query", t["per_query"], ("first_key",), f"{out_path}/report", drop=("first_key",))
    t["per_query"] = t["per_query"].drop("first_key")
    write_report(t["summary"], out_path, {k: v for k, v in t.items() if k != "summary"})


def merge_to_soft_labels(spark: SparkSession, jsonl_path: str, tsv_paths: str | Sequence[str],
                         out_path: str, filter_invalid: bool = False,
                         bounded: bool = False) -> dict[str, int]:
    """Pair JSONL ⋈ score TSVs -> soft-label Parquet (3.2); returns the counters.

    Pair lines are numbered physically (blank lines count, T1) and joined to
    the scores as raw text; the JSON of a line is parsed only after the join,
    for lines that will be written.  Scores are parsed tolerantly and
    de-duplicated last-wins across files (E11); an empty valid score set is an
    error (T20).  The joined rows are written once; the output and the written /
    skipped / missing counters (E9) both read them.  Pairs keep their line order
    and a null label raises (B10).
    """
    parsed = read_scores_tolerant(spark, tsv_paths)
    latest = materialized(merge.latest_by_index(merge.valid_scores(parsed), payload=("probs",))
                          .select("global_idx", "probs"), "scores")
    if latest.isEmpty():
        raise ValueError("no valid score records")
    lines = read_indexed(spark, jsonl_path, "physical").select(
        "global_idx", "line", (py_strip("line") == "").alias("is_blank"))
    # the join runs once: rows and counters both read its result
    status = materialized(merge.merge_status(lines, latest, filter_invalid=filter_invalid, bounded=bounded)
                          .select("global_idx", F.when(F.col("status") == "written", F.col("line")).alias("line"),
                                  "__probs", "status"), "merge")
    written = status.where(F.col("status") == "written")
    # one parse per line; a generator, so that no field is parsed again for itself
    parsed = F.struct(F.from_json("line", PAIR_SCHEMA, {"mode": "FAILFAST"}).alias("obj"),
                      F.json_object_keys("line").alias("keys"))
    written = written.select("global_idx", "__probs", F.inline(F.array(parsed)))

    def field(name: str, absent: str):
        """An absent key has a default; a JSON null stays null."""
        return F.when(F.array_contains("keys", F.lit(name)), F.col(f"obj.{name}")).otherwise(F.lit(absent))
    out = written.select(
        "global_idx", *[field(f, "").alias(f) for f in ("query", "title", "passage")],
        label_int(field("label", "0")).alias("label"), F.to_json("__probs").alias("teacher_probs"))
    # line order, as in the pair file
    out = out.repartitionByRange("global_idx").sortWithinPartitions("global_idx")
    write_soft_labels(out, out_path)
    counts = {k: 0 for k in ("written", "skipped", "missing")}
    for r in status.groupBy("status").count().collect():
        counts[r["status"]] = int(r["count"])
    return counts


def extract_to_jsonl(spark: SparkSession, src: str, out_path: str,
                     fields: Sequence[str] = ("query", "title", "passage")) -> DataFrame:
    """Parquet tree -> JSON lines of the chosen fields (3.4); returns the rows per
    file and in total (E15)."""
    df = read_parquet_tree(spark, src, columns=list(fields))
    write_jsonl(extract_fields(df, fields), out_path)
    return extract_counts(df)


def _present_shards(spark: SparkSession, prefix: str, world_size: int) -> list[tuple[int, str]]:
    """Rank and path of each present shard file (names only)."""
    return [(r["rank"], r["path"]) for r in
            shard_files(spark, prefix, world_size).where("present").orderBy("rank", "path").collect()]


def merge_shards(spark: SparkSession, prefix: str, world_size: int, out_path: str) -> DataFrame:
    """Concatenate present shards ordered by ``global_idx`` (H1, G1); returns
    the missing ranks (D5)."""
    present = _present_shards(spark, prefix, world_size)
    rows = read_shard_rows(spark, [path for _, path in present])
    write_scores(rows.withColumnsRenamed(_WRITTEN), out_path)
    ranks = spark.createDataFrame(sorted({(rank,) for rank, _ in present}), "rank int")
    return shards.missing_ranks(spark, ranks, world_size)


def _tagged_scores(spark: SparkSession, paths: Sequence[str], tags: dict[str, Sequence[str]], num_labels: int) -> DataFrame:
    """Score rows of several files with the tags of each row's file."""
    rows = read_score_rows(spark, list(paths))
    cols = [F.get(F.array(*map(F.lit, values)), F.col("given")).alias(name) for name, values in tags.items()]
    vector = prob_vector(parse_prob_map(SCORE_PROBS_COLUMN), num_labels, "zero")
    return rows.select(*cols, "global_idx", vector.alias("probs"))


def run_report(spark: SparkSession, scores: Mapping[tuple[str, str], str], data: Mapping[str, str], out_path: str,
               num_labels: int = 2, label_max: int = 1, query_key: str = "qid", label_key: str = "label") -> DataFrame:
    """Evaluate many runs from files (E13, I6): ``scores`` maps (run, data set)
    to a score file, ``data`` a data set to its pair file.  Combinations
    without scores, or whose row counts differ, get an error row."""
    keys = list(scores)
    rows = _tagged_scores(spark, [scores[k] for k in keys],
                          {"run": [r for r, _ in keys], "dataset": [d for _, d in keys]}, num_labels)
    schema = T.StructType([T.StructField(k, T.StringType()) for k in (query_key, label_key)])
    pairs = None
    for name, path in data.items():  # a parameter list
        one = eval_columns(read_pairs(spark, path, schema=schema), query_key, label_key).select(
            F.lit(name).alias("dataset"), "global_idx", "qid", "rel")
        pairs = one if pairs is None else pairs.unionByName(one)
    expected = runs.evaluation_grid(rows.select("run").distinct(), list(data))
    board = runs.evaluate_runs(rows, pairs, expected=expected, num_labels=num_labels, label_max=label_max)
    paths = F.create_map(*[F.lit(x) for item in data.items() for x in item])
    report = round_report(board).select(F.try_element_at(paths, F.col("dataset")).alias("data_path"),
                                        F.lit(num_labels).alias("num_labels"), F.lit(label_max).alias("eval_label_max"), "*")
    report = materialized(report, "run-report")
    write_report(report, out_path)
    return report


def polarization_report(spark: SparkSession, scores: Mapping[str, str], out_path: str, num_labels: int = 2) -> DataFrame:
    """Sharpness per teacher from score files (E7, F4): ``scores`` maps a
    checkpoint path to its score file.  Writes the report and its trend."""
    paths = list(scores)
    rows = _tagged_scores(spark, [scores[p] for p in paths], {"path": paths}, num_labels)
    report = materialized(runs.teacher_report(rows, num_labels), "polarization")
    trend = sharpness.polarization_trend(report)
    write_report(round_report(report), out_path, {"trend": round_report(trend)})
    return trend


def resume(spark: SparkSession, pairs_path: str, prefix: str, world_size: int, out_path: str,
           scorer: Callable[[DataFrame], DataFrame], mode: str = "strided") -> DataFrame:
    """Score the rows of missing shards and write one ordered score file.

    ``scorer`` maps pair rows to ``global_idx, probs, output_text,
    weighted_score``.  Returns the missing ranks.
    """
    present = _present_shards(spark, prefix, world_size)
    missing = shards.missing_ranks(spark, spark.createDataFrame(sorted({(r,) for r, _ in present}), "rank int"), world_size)
    pairs = read_pairs(spark, pairs_path)
    cols = ["global_idx", "probs", "output_text", "weighted_score"]
    if present:
        existing = read_shard_rows(spark, [p for _, p in present]).withColumnsRenamed(_WRITTEN).select(*cols)
    else:
        existing = scorer(pairs).select(*cols).where(F.lit(False))
    whole = learn.resume_scores(pairs, existing, scorer, world_size=world_size, missing_ranks=missing, mode=mode)
    write_scores(whole, out_path)
    return missing
