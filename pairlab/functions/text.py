"""Text columns: width folding, field normalisation, document text, prompts, messages.

All are Column -> Column built on JVM functions (``translate``, ``lower``,
``btrim``, ``concat``), so they stay inside whole-stage codegen.  The one
exception is Unicode NFKC (``normalize_qid``), which Spark has no function
for; it runs as an Arrow ``pandas_udf`` on the non-ASCII keys only.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import (
    FULLWIDTH_FIRST, FULLWIDTH_LAST, FULLWIDTH_OFFSET, FULLWIDTH_SPACE,
    INSTRUCTION_BINARY, INSTRUCTION_GRADED, PROMPT_DOCUMENT_TAG,
    PROMPT_INSTRUCT_TAG, PROMPT_QUERY_TAG, PY_WHITESPACE, SYSTEM_PROMPT,
)

_FW_FROM = FULLWIDTH_SPACE + "".join(
    chr(c) for c in range(FULLWIDTH_FIRST, FULLWIDTH_LAST + 1))
_FW_TO = " " + "".join(
    chr(c - FULLWIDTH_OFFSET) for c in range(FULLWIDTH_FIRST, FULLWIDTH_LAST + 1))

# ASCII subset of Python's whitespace: enough to strip an ASCII-only string.
_ASCII_WS = "".join(ch for ch in PY_WHITESPACE if ord(ch) < 128)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Any character the folding changes; most text has none, and one regex scan
# is about half the cost of ``translate``'s per-character map lookups.
_FW_CLASS = "[" + FULLWIDTH_SPACE + chr(FULLWIDTH_FIRST) + "-" + chr(FULLWIDTH_LAST) + "]"
# How those characters begin in UTF-8: a search for bytes costs far less than the regex.
_FW_BYTES = (FULLWIDTH_SPACE.encode(), *sorted({chr(c).encode()[:2] for c in range(FULLWIDTH_FIRST, FULLWIDTH_LAST + 1)}))


def to_halfwidth(c) -> Column:
    """Full-width to half-width: U+3000 -> space, U+FF01..FF5E -> ASCII (B1).

    ``translate`` runs only on strings that contain such a character, and the
    regex that finds it only on strings with the bytes it begins with.
    """
    c = _col(c)
    some = [F.contains(c.cast("binary"), F.lit(b)) for b in _FW_BYTES]
    return F.when((some[0] | some[1] | some[2]) & c.rlike(_FW_CLASS), F.translate(c, _FW_FROM, _FW_TO)).otherwise(c)


def py_strip(c) -> Column:
    """Strip Python whitespace from both ends (``str.strip()``)."""
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def normalize_field(c, on_null: str = "empty") -> Column:
    """Pair-field normalisation: null -> "", stringify, half-width, lower.

    ``on_null='fail'`` raises on null instead (the strict loaders).
    """
    c = _col(c)
    s = c.cast("string")
    if on_null == "empty":
        s = F.coalesce(s, F.lit(""))
    elif on_null == "fail":
        s = F.when(s.isNull(), F.raise_error(F.lit("null text field"))).otherwise(s)
    else:
        raise ValueError(f"on_null must be 'empty' or 'fail', got {on_null!r}")
    return F.lower(to_halfwidth(s))


def is_ascii(c) -> Column:
    return _col(c).rlike("^[\\x00-\\x7F]*$")


@F.pandas_udf(T.StringType())
def _nfkc_lower_strip(s: pd.Series) -> pd.Series:
    # a page of text shares few keys, so each is normalised once a batch
    keys = [None if pd.isna(v) else v for v in s]
    known = {v: v if v is None else unicodedata.normalize("NFKC", v).lower().strip() for v in set(keys)}
    return pd.Series([known[v] for v in keys], dtype="object")


def normalize_qid(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Query-key normalisation: NFKC, lower, Unicode strip.

    One pass over ``df``: ASCII keys (NFKC is the identity on them) are handled
    by JVM functions, and the Arrow function gets a null for them, so Python
    sees only non-ASCII keys.  Null keys become ``"none"`` (``str(None).lower()``).
    """
    key = F.coalesce(F.col(col).cast("string"), F.lit("None"))
    staged = df.withColumn("__qraw", key)
    staged = staged.withColumn("__qnorm", _nfkc_lower_strip(F.when(~is_ascii("__qraw"), F.col("__qraw"))))
    plain = F.btrim(F.lower("__qraw"), F.lit(_ASCII_WS))
    return staged.withColumn(out or col, F.coalesce("__qnorm", plain)).drop("__qraw", "__qnorm")


def doc_text(title, passage, style: str = "prompt") -> Column:
    """Document text: ``title + passage`` (prompt) or
    ``(title + " " + passage).strip()`` (cross-encoder) (B5, B6)."""
    t, p = _col(title), _col(passage)
    if style == "prompt":
        return F.concat(t, p)
    if style == "cross":
        return py_strip(F.concat(t, F.lit(" "), p))
    raise ValueError(f"style must be 'prompt' or 'cross', got {style!r}")


def instruction(num_labels: int) -> str:
    return INSTRUCTION_BINARY if num_labels == 2 else INSTRUCTION_GRADED


def prompt(query, title, passage, num_labels: int) -> Column:
    """Instruction prompt with query and document."""
    return F.concat(
        F.lit(PROMPT_INSTRUCT_TAG + instruction(num_labels) + PROMPT_QUERY_TAG),
        _col(query), F.lit(PROMPT_DOCUMENT_TAG), doc_text(title, passage, "prompt"))


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def scoring_messages(query, title, passage, num_labels: int) -> Column:
    """System + user turns for scoring (B8); fields are normalised first."""
    q, t, p = (normalize_field(x) for x in (query, title, passage))
    return F.array(_turn("system", F.lit(SYSTEM_PROMPT)),
                   _turn("user", prompt(q, t, p, num_labels)))


def sft_messages(query, title, passage, label, num_labels: int) -> Column:
    """Scoring turns plus the assistant answer ``str(int(label))``.

    Fields use the strict normalisation (null raises), as in the tuning job.
    """
    q, t, p = (normalize_field(x, on_null="fail") for x in (query, title, passage))
    answer = label_int(label).cast("string")
    return F.array(_turn("system", F.lit(SYSTEM_PROMPT)),
                   _turn("user", prompt(q, t, p, num_labels)),
                   _turn("assistant", answer))


def label_int(c) -> Column:
    """``int(label)`` (B10): integers kept, fractions truncated, null or
    non-numeric text raises (ANSI cast)."""
    c = _col(c)
    s = F.trim(c.cast("string"))
    as_int = F.when(s.rlike("^[+-]?[0-9]+$"), s.cast("int")) \
        .otherwise(s.cast("double").cast("int"))
    return F.when(c.isNull(), F.raise_error(F.lit("null label"))).otherwise(as_int)


def clamp_label(c, num_labels: int) -> Column:
    """Binary clamp ``min(label, 1)`` when ``num_labels == 2``."""
    c = _col(c)
    return F.least(c, F.lit(1)) if num_labels == 2 else c


def scale_label(c, label_max: int) -> Column:
    """``label / label_max`` when ``label_max > 1`` (B12), as DOUBLE."""
    c = _col(c).cast("double")
    return c / F.lit(float(label_max)) if label_max > 1 else c


def falsy_to_empty(c, dtype) -> Column:
    """``str(v or "")`` on a typed column (B15): null and falsy values -> ""."""
    c = _col(c)
    if isinstance(dtype, T.StringType):
        falsy = c.isNull() | (c == F.lit(""))
    elif isinstance(dtype, T.BooleanType):
        falsy = c.isNull() | ~c
    elif isinstance(dtype, T.NumericType):
        falsy = c.isNull() | (c == F.lit(0))
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        falsy = c.isNull() | (F.size(c) == 0)
    else:
        falsy = c.isNull()
    return F.when(falsy, F.lit("")).otherwise(c.cast("string"))
