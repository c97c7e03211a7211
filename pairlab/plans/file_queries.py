"""Registered queries of the file layer: fixture views written as files and read back.

Files go to the session's checkpoint folder.  Each query's oracle is a plain
statement on the source table, so a row, a position or a value that writing or
reading changes shows up.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import jobs
from ..functions import dist
from ..functions.parse import decode_probs, prob_mass, prob_vector
from ..operators import merge, shards
from ..operators.extract import extract_counts, extract_fields
from ..session import ensure_checkpoint_dir
from ..sources.pairs import read_pairs, read_parquet_tree
from ..sources.scores import (parse_score_lines, read_score_shards, read_scores, read_scores_tolerant, shard_files, shard_path,
                              write_scores)
from ..sources.sinks import write_jsonl
from . import fixtures as fx
from .merge_queries import _PARSE_CTES, _P_SQL, _probs_cols
from .registry import r6, register


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@register("file_pairs_roundtrip", sql=f"""WITH v AS ({fx.V3_SQL})
SELECT global_idx, qid, docid, query, title, passage, CAST(label AS VARCHAR) AS label FROM v""")
def q_file_pairs(spark, sf_dir):
    """Ordered JSON lines (A10) and their positions on reading."""
    path = _folder(spark)
    write_jsonl(fx.pairs_text(spark, sf_dir).orderBy("global_idx").drop("global_idx"), path)
    return read_pairs(spark, path).select("global_idx", "qid", "docid", "query", "title", "passage", "label")


def _scores(spark, sf_dir) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    p = (F.col("doc_id") * 37) % 400 / 1000.0
    return docs.select(F.col("doc_id").alias("global_idx"), "text",
                       F.create_map(F.lit("0"), p, F.lit("1"), 1 - p).alias("probs"),
                       F.concat("source", F.lit(' said "yes"\n\tthen '), "lang").alias("output_text"),
                       ((F.col("doc_id") * 7) % 1000 / 1000.0).alias("weighted_score"))


_SCORES_SQL = """doc_id AS global_idx, ROUND((doc_id * 37) % 400 / 1000.0, 6) AS p0,
  ROUND(1 - (doc_id * 37) % 400 / 1000.0, 6) AS p1, ROUND((doc_id * 7) % 1000 / 1000.0, 6) AS weighted_scores"""


def _p(i: int):
    return r6(F.try_element_at("probs", F.lit(str(i))), f"p{i}")


@register("file_scores_strict", sql=f"""SELECT {_SCORES_SQL},
  source || ' said "yes"' || chr(10) || chr(9) || 'then ' || lang AS output_texts FROM documents""")
def q_file_strict(spark, sf_dir):
    """Score TSV with quotes, tabs and line breaks in its text."""
    path = _folder(spark)
    write_scores(_scores(spark, sf_dir), path)
    return read_scores(spark, path).select("global_idx", _p(0), _p(1), r6("weighted_scores"), "output_texts")


@register("file_scores_cross_encoder", sql=f"""SELECT {_SCORES_SQL}, CAST(NULL AS VARCHAR) AS output_texts
FROM documents""")
def q_file_cross(spark, sf_dir):
    """The three-column layout without texts, read by header name."""
    path = _folder(spark)
    write_scores(_scores(spark, sf_dir), path, round_dp=6, with_text=False)
    return read_scores(spark, path).select("global_idx", _p(0), _p(1), r6("weighted_scores"), "output_texts")


def _write_lines(lines: DataFrame, path: str, header: list[str]) -> None:
    """Raw lines in order, with the header line on top of every part file; the
    writer leaves out empty lines, so a blank line is one space."""
    line = F.when(F.col("line") == "", F.lit(" ")).otherwise(F.col("line"))
    (lines.orderBy("line_idx").select(line.alias("\t".join(header))).write.option("header", "true")
     .option("sep", "\u0001").option("quote", "\u0000").option("escapeQuotes", "false").option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))


@register("file_scores_tolerant", sql=f"""WITH {_PARSE_CTES}
SELECT c.status, count(*) AS n, count(DISTINCT pr.global_idx) AS indexes,
  ROUND(sum(p0 + p1 + p2 + p3), 3) AS mass
FROM c LEFT JOIN pr ON pr.line_idx = c.line_idx GROUP BY c.status""")
def q_file_tolerant(spark, sf_dir):
    """Malformed lines in score files (A4)."""
    path = _folder(spark)
    _write_lines(fx.score_lines(spark, sf_dir), path, fx.SCORE_HEADER)
    parsed = read_scores_tolerant(spark, path)
    return parsed.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("global_idx").alias("indexes"),
                                        F.round(F.sum(prob_mass("probs")), 3).alias("mass"))


@register("file_upsert_two_files", sql=f"""WITH {_PARSE_CTES},
second AS (SELECT doc_id AS global_idx, 0.25 AS p0, 0.25 AS p1, 0.25 AS p2, 0.25 AS p3
           FROM documents WHERE doc_id % 3 = 0),
u AS (SELECT 1 AS f, global_idx, p0, p1, p2, p3 FROM second
      UNION ALL SELECT 0, global_idx, p0, p1, p2, p3 FROM latest)
SELECT global_idx, f AS file_ord, {_P_SQL} FROM u QUALIFY row_number() OVER (PARTITION BY global_idx ORDER BY f DESC) = 1""")
def q_file_upsert(spark, sf_dir):
    """A second folder of files, with their columns in another order, scores a third of the pairs again."""
    first, second = _folder(spark), _folder(spark)
    _write_lines(fx.score_lines(spark, sf_dir), first, fx.SCORE_HEADER)
    again = fx.table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(
        F.col("doc_id").alias("line_idx"),
        F.concat(F.lit("{'0': 0.25, '1': 0.25, '2': 0.25, '3': 0.25}\t"), F.col("doc_id").cast("string")).alias("line"))
    _write_lines(again, second, ["all_digit_scores", "global_idx"])
    parsed = merge.valid_scores(read_scores_tolerant(spark, [first, second]))
    latest = merge.latest_by_index(parsed, payload=("given", "probs"))
    return latest.select("global_idx", F.col("given").alias("file_ord"), *_probs_cols())


@register("file_shards", sql=f"""SELECT doc_id % {fx.WORLD_SIZE} AS rank, count(*) AS n, min(doc_id) AS least,
  max(doc_id) AS most, FALSE AS missing FROM documents
WHERE doc_id % {fx.WORLD_SIZE} NOT IN ({", ".join(map(str, fx.MISSING_RANKS))}) GROUP BY 1
UNION ALL SELECT r.rank, 0, NULL, NULL, TRUE FROM range({fx.WORLD_SIZE}) AS r(rank)
WHERE r.rank IN ({", ".join(map(str, fx.MISSING_RANKS))})""")
def q_file_shards(spark, sf_dir):
    """Shards per rank, two of them absent."""
    prefix = f"{_folder(spark)}/scores.tsv"
    scores = _scores(spark, sf_dir)
    for rank in range(fx.WORLD_SIZE):
        if rank not in fx.MISSING_RANKS:
            write_scores(scores.where(F.col("global_idx") % fx.WORLD_SIZE == rank), shard_path(prefix, rank))
    rows = read_score_shards(spark, prefix, fx.WORLD_SIZE)
    present = shard_files(spark, prefix, fx.WORLD_SIZE).where("present").select("rank").distinct()
    missing = shards.missing_ranks(spark, present, fx.WORLD_SIZE)
    found = rows.groupBy(F.col("rank").cast("long").alias("rank")).agg(
        F.count(F.lit(1)).alias("n"), F.min("global_idx").alias("least"), F.max("global_idx").alias("most"))
    none = F.lit(None).cast("long")
    return found.withColumn("missing", F.lit(False)).unionByName(missing.select(
        F.col("rank").cast("long"), F.lit(0).cast("long").alias("n"), none.alias("least"), none.alias("most"),
        F.lit(True).alias("missing")))


@register("parquet_tree_extract", sql="""SELECT doc_id, COALESCE(text, '') AS text, COALESCE(source, '') AS source,
  (SELECT count(*) FROM documents) AS total FROM documents""")
def q_parquet_tree(spark, sf_dir):
    """A nested Parquet tree (A3), its fields (B15) and its row counts."""
    root = _folder(spark)
    docs = fx.table(spark, sf_dir, "documents")
    docs.where("doc_id % 2 = 0").write.parquet(f"{root}/even/deep")
    docs.where("doc_id % 2 = 1").write.parquet(f"{root}/odd")
    tree = read_parquet_tree(spark, root, columns=["doc_id", "text", "source"])
    total = extract_counts(tree).where("file_name IS NULL").select("count").scalar()
    return extract_fields(tree, ("text", "source"), keep=("doc_id",)).withColumn("total", total)


@register("file_merge_job", sql=f"""WITH {_PARSE_CTES},
v AS ({fx.V3_SQL})
SELECT v.query, v.title, v.passage, CAST(v.label AS INTEGER) AS label, {_P_SQL}
FROM v JOIN latest ON latest.global_idx = v.global_idx WHERE p0 + p1 + p2 + p3 >= 0.99""")
def q_file_merge(spark, sf_dir):
    """Pair file and score files to the soft-label table."""
    pairs, scores, out = _folder(spark), _folder(spark), _folder(spark)
    write_jsonl(fx.pairs_text(spark, sf_dir).orderBy("global_idx").drop("global_idx"), pairs)
    _write_lines(fx.score_lines(spark, sf_dir), scores, fx.SCORE_HEADER)
    jobs.merge_to_soft_labels(spark, pairs, scores, out, filter_invalid=True)
    soft = spark.read.parquet(out)
    probs = F.from_json("teacher_probs", "map<string,double>")
    return soft.withColumn("probs", probs).select("query", "title", "passage", "label", *_probs_cols("probs"))


_NDCG_FILES_SQL = f"""WITH v AS ({fx.V3_SQL}),
w AS (SELECT qid, global_idx, CAST(label AS DOUBLE) AS rel, (global_idx * 7) % 1000 / 1000.0 AS score FROM v),
a AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY score DESC, global_idx) AS r FROM w),
i AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, global_idx) AS r FROM w),
ad AS (SELECT qid, count(*) AS n, sum(CASE WHEN r <= 5 THEN (pow(2.0, rel) - 1) / log2(r + 1) ELSE 0 END) AS d5,
         sum(CASE WHEN r <= 10 THEN (pow(2.0, rel) - 1) / log2(r + 1) ELSE 0 END) AS d10 FROM a GROUP BY qid),
id AS (SELECT qid, sum(CASE WHEN r <= 5 THEN (pow(2.0, rel) - 1) / log2(r + 1) ELSE 0 END) AS d5,
         sum(CASE WHEN r <= 10 THEN (pow(2.0, rel) - 1) / log2(r + 1) ELSE 0 END) AS d10 FROM i GROUP BY qid)
SELECT ad.qid, ad.n AS num_docs, ROUND(CASE WHEN id.d5 = 0 THEN 0.0 ELSE ad.d5 / id.d5 END, 6) AS ndcg5,
  ROUND(CASE WHEN id.d10 = 0 THEN 0.0 ELSE ad.d10 / id.d10 END, 6) AS ndcg10 FROM ad JOIN id USING (qid)"""


@register("file_ndcg", sql=_NDCG_FILES_SQL)
def q_file_ndcg(spark, sf_dir):
    """Score files against pair files by position (B14, B21, B22, D3): keys are
    found in the first row, columns typed, rows counted and joined by position."""
    pairs, scores = _folder(spark), _folder(spark)
    write_jsonl(fx.pairs_text(spark, sf_dir).orderBy("global_idx").select("qid", "query", "passage", "label"), pairs)
    write_scores(_scores(spark, sf_dir), scores)
    return jobs.ndcg_tables(spark, scores, pairs)["per_query"].select("qid", "num_docs", r6("ndcg5"), r6("ndcg10"))


@register("file_nested_report", sql=_NDCG_FILES_SQL)
def q_file_nested(spark, sf_dir):
    """The nested report (A11): its list of queries, read back from the document's parts."""
    pairs, scores, out = _folder(spark), _folder(spark), _folder(spark)
    write_jsonl(fx.pairs_text(spark, sf_dir).orderBy("global_idx").select("qid", "query", "passage", "label"), pairs)
    write_scores(_scores(spark, sf_dir), scores)
    jobs.ndcg_report(spark, scores, pairs, out, round_dp=None)
    parts = [f"{out}/report/{p}" for p in ("0-head", "1-body")]
    text = spark.read.text(parts)
    element = F.regexp_extract("value", r"(\{[^{}]*\})$", 1)  # the first element ends the head
    got = text.select(F.from_json(element, "qid string, num_docs long, ndcg5 double, ndcg10 double").alias("e"))
    return got.where("e.qid IS NOT NULL").select("e.qid", "e.num_docs", r6("e.ndcg5", "ndcg5"), r6("e.ndcg10", "ndcg10"))


@register("teacher_decode", sql=f"""WITH {_PARSE_CTES},
v AS ({fx.V3_SQL})
SELECT v.global_idx, {_P_SQL}, CASE WHEN p0 >= p1 AND p0 >= p2 AND p0 >= p3 THEN 0
  WHEN p1 >= p2 AND p1 >= p3 THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END AS hard
FROM v JOIN latest ON latest.global_idx = v.global_idx WHERE p0 + p1 + p2 + p3 >= 0.99""")
def q_teacher_decode(spark, sf_dir):
    """The soft-label table's JSON column decoded to vectors (A7) and hard labels."""
    scores = merge.latest_by_index(merge.valid_scores(parse_score_lines(
        fx.score_lines(spark, sf_dir), header=fx.SCORE_HEADER)), payload=("probs",))
    soft = merge.merge_soft_labels(fx.pairs_text(spark, sf_dir), scores, filter_invalid=True, as_json=True)
    vec = prob_vector(decode_probs(soft, "teacher_probs"), 4, "zero")
    return soft.select("global_idx", vec.alias("v")).select(
        "global_idx", *[r6(F.get("v", i), f"p{i}") for i in range(4)], dist.hard_label("v", 4).alias("hard"))
