"""Quality rules by a hashed n-gram log-likelihood ratio (operator 9), in Spark SQL functions only.

Two multinomials over ``BUCKETS`` hash buckets of words and word pairs are
counted: one from trusted documents, one from the whole corpus.  A document's
score is the mean over its n-grams of ``ln p_trusted - ln p_corpus``, so it does
not depend on its length; a document below ``THRESHOLD`` is rejected.  Nothing
is drawn at random: every document is scored and compared with the same number.

Corpus counts cover all documents.  Trusted documents are labelled rows of
quality 1 that are not toxic, at most ``TRUSTED_ROWS`` of them (in hash order),
so their ids can be broadcast; the weights are one integer per bucket.

Defined results: a null or blank text has no words and fails the base rules; the
first word of a text pairs with the text's start; without trusted rows all
weights are 0 and only the base rules decide; rows are judged one by one, so
repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words

BUCKETS = 1 << 16
TRUSTED_ROWS = 40_000
PSEUDO = 20
THRESHOLD = -0.06  # nats per n-gram
SCALE = 10_000  # weights are whole numbers of 1/SCALE nats
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = r"[^#*$%&|<>]+"  # all but the symbols that are counted


def _hashed(docs: DataFrame) -> DataFrame:
    """``row, text, hash``: the row, its text (null: empty) and its words' 64-bit hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), text.alias("text"),
                       F.transform(words(text), lambda w: F.xxhash64(w)).alias("hash"))


def _word_bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _pair_bucket(hashes: Column, h: Column, i: Column) -> Column:
    return F.pmod(F.xxhash64(h, F.get(hashes, i - 1)), F.lit(BUCKETS)).cast("int")


def _grams(hashes: Column) -> Column:
    """The hash buckets of all words and word pairs."""
    return F.concat(F.transform(hashes, _word_bucket),
                    F.transform(hashes, lambda h, i: _pair_bucket(hashes, h, i)))


def _total(hashes: Column, weights: Column) -> Column:
    """The summed weights of all words and word pairs."""
    each = F.transform(hashes, lambda h, i: F.get(weights, _word_bucket(h)) + F.get(weights, _pair_bucket(hashes, h, i)))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, w: a + w)


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    good = labels.filter("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def bucket_weights(docs: DataFrame, labels: DataFrame) -> list[int]:
    """One weight per bucket: ``SCALE * (ln p_trusted - ln p_corpus)``.

    Both multinomials are taken at the trusted documents' size and get
    ``PSEUDO`` counts more in every bucket, so buckets with little evidence
    weigh little, in a small corpus as in a large one.
    """
    trusted = F.broadcast(trusted_ids(labels).withColumn("trusted", F.lit(1)))  # at most TRUSTED_ROWS ids
    rows = _hashed(docs).select(F.col("row.doc_id").alias("doc_id"), "hash").join(trusted, "doc_id", "left")
    grams = rows.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(_grams(F.col("hash"))).alias("gram"))
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("all"), F.sum("trusted").alias("good"))
    weights, rows = [0] * BUCKETS, counted.collect()  # at most BUCKETS rows
    share = sum(r["good"] for r in rows) / max(1, sum(r["all"] for r in rows))
    for r in rows:
        weights[r["gram"]] = round(SCALE * math.log((r["good"] + PSEUDO) / (r["all"] * share + PSEUDO)))
    return weights


def _repeated(marks: Column) -> Column:
    """Words in 3-word windows, from the sorted positions of windows that occur twice."""
    return F.aggregate(F.transform(marks, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(marks, k + 1) - p, F.lit(3)))),
                       F.lit(0), lambda a, x: a + x)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``row``, the base counts, ``base_failed``, ``score`` and ``kept`` per row of ``docs``."""
    # a constant: one parse when the plan is made
    weights = F.from_json(F.lit(str(bucket_weights(docs, labels))), "array<int>")
    rows = _hashed(docs)
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    windows = F.slice(F.transform("hash", lambda h, i: F.xxhash64(F.get("hash", i - 2), F.get("hash", i - 1), h)),
                      3, F.greatest(F.size("hash") - 2, F.lit(0)))
    rows = rows.select(
        "row", F.size("hash").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        lines.alias("lines"), windows.alias("windows"),
        _total(F.col("hash"), weights).alias("total"))
    rows = rows.select("row", "n_words", "word_chars", "n_symbols", "total",
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       # windows in hash order, only where some window repeats
                       F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform(
                           "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ranked"))
    marks = F.filter(
        "ranked", lambda x, k: F.coalesce(F.get("ranked", k - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get("ranked", k + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("marks", F.sort_array(F.transform(marks, lambda x: x["i"]))).drop("ranked")
    rows = rows.withColumn("n_repeat_words", F.coalesce(_repeated(F.col("marks")), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    score = F.when(F.col("n_words") > 0, F.col("total") / (2 * SCALE * F.col("n_words"))).otherwise(0.0)
    # a generator, so that a filter on the verdict isn't pushed below and all of this computed once more for it
    return rows.select("row", F.inline(F.array(F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        score.alias("score"), (~failed & (score >= threshold)).alias("kept")))))
