"""Fixture views V1-V6: pair, score and run tables derived from the driver tables.

Every view is plain integer/string arithmetic on ``lineitem``, ``documents``,
``benchmark``, ``labels`` and ``embeddings`` so that Spark and the SQL oracle
see bit-identical doubles.  Each view exists twice: as a DataFrame builder
(used by the registered queries) and as a SQL body (used by the oracle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Five-column key of lineitem that is unique at every scale factor; it stands
# in for the position ``global_idx`` where lineitem plays the pair table.
LI_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
LI_KEY_SQL = ", ".join(LI_KEY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- V1 pairs_num: numeric pairs for ranking and calibration ----------------

def pairs_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        *LI_KEY,
        F.col("l_partkey").alias("qid"),
        (F.col("l_linenumber") % 4).cast("double").alias("rel"),
        (F.col("l_discount") * 10).alias("score"),
        (F.col("l_extendedprice") / 100000.0).alias("score2"),
        F.col("l_returnflag").alias("run"),
        F.col("l_linestatus").alias("dataset"),
    )


V1_SQL = f"""SELECT {LI_KEY_SQL}, l_partkey AS qid,
  CAST(l_linenumber % 4 AS DOUBLE) AS rel, l_discount * 10 AS score,
  l_extendedprice / 100000.0 AS score2,
  l_returnflag AS run, l_linestatus AS dataset
FROM lineitem"""


# -- V2 probs: teacher and student label distributions ----------------------

def _z(i: int, a: int, b: int, c: int, mod: int):
    return F.lit(1) + (F.col("l_orderkey") * (a * i + b) + F.col("l_linenumber") * c) % mod


def _z_sql(i: int, a: int, b: int, c: int, mod: int) -> str:
    return f"(1 + (l_orderkey * {a * i + b} + l_linenumber * {c}) % {mod})"


# teacher: z_i = 1 + (orderkey*(i+3) + linenumber*(7i+1)) % 97
# student: z_i = 1 + (orderkey*(2i+5) + linenumber*(3i+2)) % 89
_T = [(1, 3, lambda i: 7 * i + 1, 97)]
_S = [(2, 5, lambda i: 3 * i + 2, 89)]


def _dist_cols(n: int, spec) -> list:
    a, b, cf, mod = spec[0]
    zs = [_z(i, a, b, cf(i), mod) for i in range(n)]
    total = zs[0]
    for z in zs[1:]:
        total = total + z
    return [z.cast("double") / total.cast("double") for z in zs]


def _dist_sql(n: int, spec) -> list[str]:
    a, b, cf, mod = spec[0]
    zs = [_z_sql(i, a, b, cf(i), mod) for i in range(n)]
    total = " + ".join(zs)
    return [f"CAST({z} AS DOUBLE) / CAST({total} AS DOUBLE)" for z in zs]


def probs(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """``t`` teacher and ``s`` student arrays of length ``n`` per lineitem row."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LI_KEY,
                     F.col("l_returnflag").alias("run"),
                     F.col("l_linestatus").alias("dataset"),
                     F.array(*_dist_cols(n, _T)).alias("t"),
                     F.array(*_dist_cols(n, _S)).alias("s"))


def teacher_table(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LI_KEY, F.array(*_dist_cols(n, _T)).alias("probs"))


def student_table(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LI_KEY, F.array(*_dist_cols(n, _S)).alias("probs"))


def probs_sql(n: int) -> str:
    t = ", ".join(_dist_sql(n, _T))
    s = ", ".join(_dist_sql(n, _S))
    return (f"SELECT {LI_KEY_SQL}, l_returnflag AS run, l_linestatus AS dataset, "
            f"[{t}] AS t, [{s}] AS s FROM lineitem")


# -- V3 pairs_text: text pairs ----------------------------------------------

ASCII_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
FULLWIDTH_ALNUM = "".join(chr(ord(ch) + 0xFEE0) for ch in ASCII_ALNUM)


def pairs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⋈ benchmark on ``item_id = doc_id % |benchmark|``, ⟕ labels."""
    docs = table(spark, sf_dir, "documents")
    bench = table(spark, sf_dir, "benchmark")
    labels = table(spark, sf_dir, "labels")
    nb = bench.select(F.count(F.lit(1))).scalar()
    d = docs.select("doc_id", "text", (F.col("doc_id") % nb).alias("item_id"))
    b = bench.select("item_id", F.col("text").alias("query"))
    return (d.join(b, "item_id").join(labels, "doc_id", "left")
            .select(F.col("doc_id").alias("global_idx"),
                    F.col("item_id").cast("string").alias("qid"),
                    F.col("doc_id").cast("string").alias("docid"),
                    "query",
                    F.substring_index("text", "\n", 1).alias("title"),
                    F.col("text").alias("passage"),
                    F.coalesce(F.col("quality") + 2 * F.col("toxic"), F.lit(0)).alias("label")))


V3_SQL = """SELECT d.doc_id AS global_idx, CAST(b.item_id AS VARCHAR) AS qid,
  CAST(d.doc_id AS VARCHAR) AS docid, b.text AS query,
  split_part(d.text, chr(10), 1) AS title, d.text AS passage,
  COALESCE(l.quality + 2 * l.toxic, 0) AS label
FROM documents d
JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
LEFT JOIN labels l ON l.doc_id = d.doc_id"""


# -- V4 score_lines: score-file lines with malformed rows --------------------

SCORE_HEADER = ["global_idx", "all_digit_scores", "output_texts", "weighted_scores"]


def _digits(v):
    return F.concat(F.lit("0."), F.lpad(v.cast("string"), 3, "0"))


def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score line per document: ``idx \\t {probs} \\t text \\t weighted``.

    By ``doc_id % 50``: 7 too few columns, 13 non-integer index, 19 a list,
    23 missing brace, 29 duplicate of the previous index, 37 low mass,
    41 JSON quoting, 43 blank line.  ``line_idx`` is the physical line number
    (the header is line 0 and is not part of the table).
    """
    docs = table(spark, sf_dir, "documents")
    i, k = F.col("doc_id"), F.pmod(F.col("doc_id"), F.lit(50))
    a = F.pmod(i * 37, F.lit(400))
    b = F.pmod(i * 53, F.lit(300))
    c = F.pmod(i * 71, F.lit(200))
    d = F.when(k == 37, F.lit(0)).otherwise(F.lit(999) - a - b - c)
    q = F.when(k == 41, F.lit('"')).otherwise(F.lit("'"))
    body = F.concat(q, F.lit("0"), q, F.lit(": "), _digits(a), F.lit(", "),
                    q, F.lit("1"), q, F.lit(": "), _digits(b), F.lit(", "),
                    q, F.lit("2"), q, F.lit(": "), _digits(c), F.lit(", "),
                    q, F.lit("3"), q, F.lit(": "), _digits(d))
    probs_txt = (F.when(k == 19, F.concat(F.lit("["), _digits(a), F.lit(", "), _digits(b), F.lit("]")))
                 .when(k == 23, F.concat(F.lit("{"), body))
                 .otherwise(F.concat(F.lit("{"), body, F.lit("}"))))
    idx_txt = (F.when(k == 13, F.concat(F.lit("x"), i.cast("string")))
               .when(k == 29, (i - 1).cast("string"))
               .otherwise(i.cast("string")))
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    w = _digits(F.pmod(i * 7, F.lit(1000)))
    line = (F.when(k == 43, F.lit(""))
            .when(k == 7, idx_txt)
            .otherwise(F.concat_ws("\t", idx_txt, probs_txt, text, w)))
    return docs.select(F.lit(0).alias("file_ord"), (i + 1).alias("line_idx"), line.alias("line"))


def _digits_sql(v: str) -> str:
    return f"('0.' || lpad(CAST({v} AS VARCHAR), 3, '0'))"


def score_lines_sql() -> str:
    k = "(doc_id % 50)"
    a, b, c = "((doc_id * 37) % 400)", "((doc_id * 53) % 300)", "((doc_id * 71) % 200)"
    d = f"(CASE WHEN {k} = 37 THEN 0 ELSE 999 - {a} - {b} - {c} END)"
    q = f"(CASE WHEN {k} = 41 THEN '\"' ELSE '''' END)"
    body = (f"{q} || '0' || {q} || ': ' || {_digits_sql(a)} || ', ' || "
            f"{q} || '1' || {q} || ': ' || {_digits_sql(b)} || ', ' || "
            f"{q} || '2' || {q} || ': ' || {_digits_sql(c)} || ', ' || "
            f"{q} || '3' || {q} || ': ' || {_digits_sql(d)}")
    probs_txt = (f"(CASE WHEN {k} = 19 THEN '[' || {_digits_sql(a)} || ', ' || {_digits_sql(b)} || ']' "
                 f"WHEN {k} = 23 THEN '{{' || {body} ELSE '{{' || {body} || '}}' END)")
    idx_txt = (f"(CASE WHEN {k} = 13 THEN 'x' || CAST(doc_id AS VARCHAR) "
               f"WHEN {k} = 29 THEN CAST(doc_id - 1 AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END)")
    text = "replace(text, chr(10), ' ')"
    w = _digits_sql("((doc_id * 7) % 1000)")
    line = (f"(CASE WHEN {k} = 43 THEN '' WHEN {k} = 7 THEN {idx_txt} "
            f"ELSE {idx_txt} || chr(9) || {probs_txt} || chr(9) || {text} || chr(9) || {w} END)")
    return f"SELECT 0 AS file_ord, doc_id + 1 AS line_idx, {line} AS line FROM documents"


# -- V5 runs / shards -------------------------------------------------------

WORLD_SIZE = 8
MISSING_RANKS = (2, 5)


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows as written by ranks 0..7 of lineitem, ranks 2 and 5 lost."""
    li = table(spark, sf_dir, "lineitem")
    return (li.select(*LI_KEY, (F.col("l_orderkey") % WORLD_SIZE).cast("int").alias("rank"),
                      (F.col("l_discount") * 10).alias("score"))
            .where(~F.col("rank").isin(*MISSING_RANKS)))


V5_SHARDS_SQL = f"""SELECT {LI_KEY_SQL}, CAST(l_orderkey % {WORLD_SIZE} AS INTEGER) AS rank,
  l_discount * 10 AS score
FROM lineitem WHERE (l_orderkey % {WORLD_SIZE}) NOT IN ({', '.join(map(str, MISSING_RANKS))})"""


# -- V6 logits --------------------------------------------------------------

LABEL_TOKEN_IDS = (1, 2, 3, 4)


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("logits"), "label")


V6_SQL = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS logits, label FROM embeddings"
