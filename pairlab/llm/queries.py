"""Registered queries of the training-data operators: one per operator, and base columns with SQL forms."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    fingerprints,
    infill,
    lm,
    mixing,
    negatives,
    packing,
    quality,
    quality_trees,
    secret_scan,
    simhash,
    substring,
    urls,
)
from .common import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql):
    """Register a query; ``@query(sql)`` gives its DuckDB form too."""
    if callable(sql):
        _QUERIES[sql.__name__] = sql
        return sql

    def register(fn):
        _ORACLES[fn.__name__] = sql
        return query(fn)
    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


@query
def op1_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table and one more conversation, whose texts are control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.sql("""SELECT CAST(-1 AS BIGINT) conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
                           FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)""")
    return rows.unionByName(hostile)


_ESCAPED = functools.reduce(lambda s, c: f"replace({s}, '{c}', '{c[0]}\\{c[1:]}')", chat.CONTROL,
                            "replace({}, '\\', '\\\\')")


@query(f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 24 AS n FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op2_format_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.reply_paths(chat.chain(_conversations(spark, sf_dir)))
    return chat.read_back(chat.format_paths(turns)).drop("branch")


#: Host, path and action of the rules of the url query.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))


@query("""
WITH p AS (SELECT page_id, coalesce(url, '') AS url,
                  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(h, p, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (SELECT host, path, max_by(h || r.p, length(h || r.p)) AS rule, max_by(action, length(h || r.p)) AS action
        FROM (SELECT DISTINCT host, path FROM p) d JOIN rules r
          ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY host, path),
j AS (SELECT p.*, rule, action,
             bool_or(action = 'block') OVER alias AS blocked, bool_or(action = 'allow') OVER alias AS allowed
      FROM p LEFT JOIN fit USING (host, path)
      WINDOW alias AS (PARTITION BY regexp_replace(url, '(?s)#.*$', '')))
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN blocked AND NOT coalesce(allowed, FALSE) THEN 'block' ELSE 'allow' END) AS verdict
FROM j""")
def op3_judge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, action string")
    return urls.judge(table(spark, sf_dir, "pages"), rules).drop("url")


@query
def op4_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs)
    return mixed.select("row.doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"))


@query
def op8_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    def of_kind(k: int):  # no default argument: a lambda's second one is the element's position
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    count = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(secret_scan.KINDS[:3])]
    return found.select("row.doc_id", *count, F.sha2(secret_scan.span_list(base), 256).alias("base_sha256"),
                        secret_scan.span_list(F.col("spans")).alias("spans"))


@query
def op9_judge_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "score")


@query
def op6_score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


@query
def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
           FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s + 1:s + 20], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 19, 0))) AS s FROM w)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, min({'d': doc_id, 's': s}) OVER (PARTITION BY k) AS f FROM win)
          WHERE doc_id > f.d OR (doc_id = f.d AND s > f.s)),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM (SELECT doc_id, s, unnest(range(0, 20)) AS i FROM later)),
placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
         FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""")
def op10_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                       OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
                  WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, t[1:least(a, b)] AS pre, t[least(a, b) + 1:greatest(a, b)] AS mid, t[greatest(a, b) + 1:] AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(least(a, b) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(abs(a - b) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p""")
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = infill.restored(F.col("output"), F.col("form"))
    return filled.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars",
                         F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


@query("""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id,
       positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10""")
def op12_mine_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), moved.alias("label"),
                                                     F.col("embedding").alias("vec"))
    return negatives.hard_negatives(rows, F.col("id") % 100 == 0)


@query
def op13_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality_trees.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_trees.score(docs, forest)
    return scored.select("row.doc_id", "held_out", "score",
                         (F.col("score") >= quality_trees.THRESHOLD).cast("int").alias("predicted"))


# The columns of operators 5, 6, 8 and 9 that do not depend on their methods have SQL forms.

@query(r"""
WITH w AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                                       lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, 2.0 * sum(size) AS most, sum(size) AS source_size, [3, 1, 2][
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM w GROUP BY source),
-- in order of most / weight: what each unit of weight gets if this source and the later ones are below their bounds
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
      FROM s WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
u AS (SELECT coalesce(arg_min(unit, most / weight) FILTER (unit * weight <= most), 0) AS unit FROM l)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, CAST(least(most, weight * u.unit) AS DOUBLE) AS target
FROM w JOIN s ON w.source IS NOT DISTINCT FROM s.source, u""")
def base_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_mix_sources(spark, sf_dir).drop("taken")


_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
       lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""


@query(rf"""
WITH t AS (SELECT doc_id, {_CRC32.format('CAST(doc_id AS VARCHAR)')} % 7 = 2 AS held_out,
                  unnest(list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), '')) AS word
           FROM documents),
c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word),
n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(max(n) AS BIGINT) AS train_tokens,
       sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base_score
FROM t LEFT JOIN c USING (word), n GROUP BY doc_id, held_out""")
def base_text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_score_texts(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")


_SPANS = " UNION ALL ".join(
    f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{pattern}', 0) AS found, {least} AS least_chars,
               regexp_extract_all(t, '{pattern}', {group}) AS judged, regexp_split_to_array(t, '{pattern}') AS apart FROM d"""
    for k, (kind, pattern, group, least) in enumerate((
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))))


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_SPANS}),
-- a match starts after the i stretches and i - 1 matches before it
p AS (SELECT doc_id, k, kind, unnest(found) AS s, unnest(judged) AS g, unnest(apart[1:len(found)]) AS gap,
             unnest(range(len(found))) AS i, least_chars FROM m),
e AS (SELECT *, CAST(sum(length(gap) + length(s)) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS stop FROM p),
f AS (SELECT doc_id, k, kind, stop - length(s) AS start, stop FROM e WHERE length(g) >= least_chars)
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k), '')) AS base_sha256
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""")
def base_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_scan_secrets(spark, sf_dir).drop("spans")


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                                               lambda x: x <> '') AS ws FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM d),
win AS (SELECT doc_id, p, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS k
        FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
twice AS (SELECT doc_id, p FROM win WHERE k IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT p + i) AS n FROM (SELECT doc_id, p, unnest([0, 1, 2]) AS i FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
       len(ws) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(ws) AS base_failed
FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)""")
def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_judge_quality(spark, sf_dir).drop("kept", "score")
