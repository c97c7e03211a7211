"""Registered queries: text normalisation, prompts and messages (V3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.constants import (
    INSTRUCTION_BINARY, INSTRUCTION_GRADED, PROMPT_DOCUMENT_TAG, PROMPT_INSTRUCT_TAG,
    PROMPT_QUERY_TAG, PY_WHITESPACE, SYSTEM_PROMPT,
)
from . import fixtures as fx
from .registry import register

V3 = fx.V3_SQL


def _sql_str(s: str) -> str:
    """A SQL string expression for any text (newlines and quotes via chr())."""
    parts, buf = [], ""
    for ch in s:
        if ch == "'" or ord(ch) < 32 or ord(ch) > 126:
            if buf:
                parts.append("'" + buf + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf:
        parts.append("'" + buf + "'")
    return "(" + " || ".join(parts) + ")" if parts else "''"


_FW_SRC = _sql_str(chr(0x3000) + "".join(chr(c) for c in range(0xFF01, 0xFF5F)))
_FW_DST = _sql_str(" " + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)))
_WS = _sql_str(PY_WHITESPACE)


def _hw_sql(x: str) -> str:
    return f"translate({x}, {_FW_SRC}, {_FW_DST})"


def _norm_sql(x: str) -> str:
    return f"lower({_hw_sql(f'COALESCE(CAST({x} AS VARCHAR), {chr(39)}{chr(39)})')})"


def _prompt_sql(q: str, t: str, p: str, n: int) -> str:
    ins = INSTRUCTION_BINARY if n == 2 else INSTRUCTION_GRADED
    head = _sql_str(PROMPT_INSTRUCT_TAG + ins + PROMPT_QUERY_TAG)
    return f"({head} || {q} || {_sql_str(PROMPT_DOCUMENT_TAG)} || {t} || {p})"


def _fullwidth(c):
    return F.concat(F.lit("\u3000"), F.translate(c, fx.ASCII_ALNUM, fx.FULLWIDTH_ALNUM))


_FULLWIDTH_SQL = ("(chr(12288) || translate(passage, " + _sql_str(fx.ASCII_ALNUM) + ", "
                  + _sql_str(fx.FULLWIDTH_ALNUM) + "))")


@register("halfwidth", sql=f"""WITH v AS ({V3})
SELECT global_idx, {_hw_sql(_FULLWIDTH_SQL)} AS halfwidth FROM v""")
def q_halfwidth(spark, sf_dir):
    v = fx.pairs_text(spark, sf_dir)
    return v.select("global_idx", tx.to_halfwidth(_fullwidth(F.col("passage"))).alias("halfwidth"))


@register("normalize_field", sql=f"""WITH v AS ({V3})
SELECT global_idx, {_norm_sql('query')} AS query_n, {_norm_sql('title')} AS title_n,
  {_norm_sql(_FULLWIDTH_SQL)} AS passage_n FROM v""")
def q_normalize_field(spark, sf_dir):
    v = fx.pairs_text(spark, sf_dir)
    return v.select("global_idx", tx.normalize_field("query").alias("query_n"),
                    tx.normalize_field("title").alias("title_n"),
                    tx.normalize_field(_fullwidth(F.col("passage"))).alias("passage_n"))


@register("prompt", sql=f"""WITH v AS ({V3})
SELECT global_idx, {_prompt_sql('query', 'title', 'passage', 4)} AS prompt,
  {_prompt_sql('query', 'title', 'passage', 2)} AS prompt_binary FROM v""")
def q_prompt(spark, sf_dir):
    v = fx.pairs_text(spark, sf_dir)
    return v.select("global_idx", tx.prompt("query", "title", "passage", 4).alias("prompt"),
                    tx.prompt("query", "title", "passage", 2).alias("prompt_binary"))


def _turns_sql(with_answer: bool) -> str:
    q, t, p = (_norm_sql(c) for c in ("query", "title", "passage"))
    parts = [f"SELECT global_idx, 0 AS turn, 'system' AS role, {_sql_str(SYSTEM_PROMPT)} AS content FROM v",
             f"SELECT global_idx, 1 AS turn, 'user' AS role, {_prompt_sql(q, t, p, 4)} AS content FROM v"]
    if with_answer:
        parts.append("SELECT global_idx, 2 AS turn, 'assistant' AS role, "
                     "CAST(CAST(label AS INTEGER) AS VARCHAR) AS content FROM v")
    return f"WITH v AS ({V3}) " + " UNION ALL ".join(parts)


def _explode_turns(df, msgs):
    return df.select("global_idx", F.posexplode(msgs).alias("turn", "m")) \
        .select("global_idx", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


@register("scoring_messages", sql=_turns_sql(False))
def q_scoring_messages(spark, sf_dir):
    v = fx.pairs_text(spark, sf_dir)
    return _explode_turns(v, tx.scoring_messages("query", "title", "passage", 4))


@register("sft_messages", sql=_turns_sql(True))
def q_sft_messages(spark, sf_dir):
    v = fx.pairs_text(spark, sf_dir)
    return _explode_turns(v, tx.sft_messages("query", "title", "passage", "label", 4))


@register("doc_cross", sql=f"""WITH v AS ({V3})
SELECT global_idx, trim(title || ' ' || passage, {_WS}) AS doc,
  title || passage AS doc_prompt FROM v""")
def q_doc_cross(spark, sf_dir):
    v = fx.pairs_text(spark, sf_dir)
    return v.select("global_idx", tx.doc_text("title", "passage", "cross").alias("doc"),
                    tx.doc_text("title", "passage", "prompt").alias("doc_prompt"))


@register("extract_fields", sql=f"""WITH v AS ({V3})
SELECT global_idx, COALESCE(query, '') AS query, COALESCE(title, '') AS title,
  COALESCE(passage, '') AS passage,
  CASE WHEN label IS NULL OR label = 0 THEN '' ELSE CAST(label AS VARCHAR) END AS label FROM v""")
def q_extract_fields(spark, sf_dir):
    from ..operators.extract import extract_fields
    v = fx.pairs_text(spark, sf_dir)
    return extract_fields(v, ("global_idx", "query", "title", "passage", "label"), keep=("global_idx",))


@register("label_clamp", sql=f"""WITH v AS ({V3})
SELECT global_idx, CAST(label AS INTEGER) AS label, least(CAST(label AS INTEGER), 1) AS label_binary,
  CAST(label AS DOUBLE) / 3.0 AS label_scaled FROM v""")
def q_label_clamp(spark, sf_dir):
    v = fx.pairs_text(spark, sf_dir)
    lab = tx.label_int(F.col("label").cast("string"))
    return v.select("global_idx", lab.alias("label"), tx.clamp_label(lab, 2).alias("label_binary"),
                    tx.scale_label(lab, 3).alias("label_scaled"))


# DuckDB has no NFKC, but on this fixture (full-width ASCII, U+3000, and Latin
# letters already in composed form) NFKC is exactly the half-width fold; the
# compatibility characters added to each key have a fixed folded form.
_COMPAT, _FOLDED = "\u2460\ufb01\u00b2\uff76\uff9e", "1fi2\u30ac"


@register("normalize_qid", sql=f"""WITH v AS ({V3})
SELECT global_idx, trim(lower({_hw_sql("(chr(12288) || translate(query, " + _sql_str(fx.ASCII_ALNUM)
                                        + ", " + _sql_str(fx.FULLWIDTH_ALNUM) + f") || '{_FOLDED} ')")}), {_WS}) AS qid_norm
FROM v""")
def q_normalize_qid(spark, sf_dir):
    """NFKC query keys (B4): JVM functions for ASCII, an Arrow function for the rest."""
    v = fx.pairs_text(spark, sf_dir).select("global_idx", F.col("query").alias("qkey"))
    v = v.withColumn("qkey", F.concat(_fullwidth(F.col("qkey")), F.lit(_COMPAT), F.lit(" ")))
    return tx.normalize_qid(v, "qkey", "qid_norm").select("global_idx", "qid_norm")

