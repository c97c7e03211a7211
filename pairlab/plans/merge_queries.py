"""Registered queries: score parsing, merge, shards and resume (V3, V4, V5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.parse import prob_mass
from ..operators import coverage, merge, pairstore, shards
from ..session import ensure_checkpoint_dir
from ..sources.scores import parse_score_lines
from . import fixtures as fx
from .registry import r6, register
from .text_queries import _WS

KEY = list(fx.LI_KEY)
KEY_SQL = fx.LI_KEY_SQL
NL = 4


def _parsed(spark, sf_dir):
    return parse_score_lines(fx.score_lines(spark, sf_dir), header=fx.SCORE_HEADER)


def _ok(spark, sf_dir):
    return merge.valid_scores(_parsed(spark, sf_dir))


def _probs_cols(m="probs"):
    return [r6(F.try_element_at(F.col(m), F.lit(str(i))), f"p{i}") for i in range(NL)]


_PARSE_CTES = f"""l AS ({fx.score_lines_sql()}),
st AS (SELECT file_ord, line_idx, trim(line, {_WS}) AS s FROM l),
sp AS (SELECT file_ord, line_idx, s, string_split(s, chr(9)) AS parts FROM st),
c AS (SELECT file_ord, line_idx, parts,
  CASE WHEN s = '' THEN 'blank'
       WHEN len(parts) <= 1 THEN 'too_few_columns'
       WHEN NOT regexp_matches(parts[1], '^\\s*[+-]?[0-9]+\\s*$') THEN 'bad_index'
       WHEN NOT regexp_matches(trim(parts[2]), '^\\{{.*\\}}$') THEN 'bad_probs'
       ELSE 'ok' END AS status FROM sp),
ok AS (SELECT file_ord, line_idx, CAST(trim(parts[1]) AS BIGINT) AS global_idx,
  replace(trim(parts[2]), '''', '"') AS j FROM c WHERE status = 'ok'),
pr AS (SELECT file_ord, line_idx, global_idx,
  CAST(json_extract_string(j, '$."0"') AS DOUBLE) AS p0,
  CAST(json_extract_string(j, '$."1"') AS DOUBLE) AS p1,
  CAST(json_extract_string(j, '$."2"') AS DOUBLE) AS p2,
  CAST(json_extract_string(j, '$."3"') AS DOUBLE) AS p3 FROM ok),
latest AS (SELECT * FROM pr QUALIFY row_number() OVER (
  PARTITION BY global_idx ORDER BY file_ord DESC, line_idx DESC) = 1)"""

_P_SQL = "ROUND(p0, 6) AS p0, ROUND(p1, 6) AS p1, ROUND(p2, 6) AS p2, ROUND(p3, 6) AS p3"


@register("parse_scores", sql=f"""WITH {_PARSE_CTES}
SELECT file_ord, line_idx, global_idx, {_P_SQL}, ROUND(p0 + p1 + p2 + p3, 6) AS mass,
  4 AS n_labels FROM pr""")
def q_parse_scores(spark, sf_dir):
    ok = _ok(spark, sf_dir)
    return ok.select("file_ord", "line_idx", "global_idx", *_probs_cols(),
                     r6(prob_mass("probs"), "mass"), F.size("probs").alias("n_labels"))


@register("score_reject_reasons", sql=f"""WITH {_PARSE_CTES}
SELECT status, count(*) AS count FROM c GROUP BY status""")
def q_score_reject_reasons(spark, sf_dir):
    return _parsed(spark, sf_dir).groupBy("status").count()


@register("latest_by_index", sql=f"""WITH {_PARSE_CTES}
SELECT global_idx, line_idx, {_P_SQL} FROM latest""")
def q_latest_by_index(spark, sf_dir):
    latest = merge.latest_by_index(_ok(spark, sf_dir), payload=("probs",))
    return latest.select("global_idx", "line_idx", *_probs_cols())


@register("index_range", sql=f"""WITH {_PARSE_CTES}
SELECT count(*) AS num_records, min(global_idx) AS min_idx, max(global_idx) AS max_idx FROM latest""")
def q_index_range(spark, sf_dir):
    return merge.index_range(merge.latest_by_index(_ok(spark, sf_dir), payload=()))


@register("drop_low_mass", sql=f"""WITH {_PARSE_CTES}
SELECT global_idx, line_idx, ROUND(p0 + p1 + p2 + p3, 6) AS mass FROM pr
WHERE p0 + p1 + p2 + p3 >= 0.99""")
def q_drop_low_mass(spark, sf_dir):
    kept = merge.drop_low_mass(_ok(spark, sf_dir))
    return kept.select("global_idx", "line_idx", r6(prob_mass("probs"), "mass"))


def _merge_inputs(spark, sf_dir):
    pairs = fx.pairs_text(spark, sf_dir)
    scores = merge.latest_by_index(_ok(spark, sf_dir), payload=("probs",))
    return pairs, scores


_MERGE_CTES = f"""{_PARSE_CTES},
v AS ({fx.V3_SQL}),
m AS (SELECT v.*, latest.p0, latest.p1, latest.p2, latest.p3,
  CASE WHEN latest.global_idx IS NULL THEN 'missing'
       WHEN latest.p0 + latest.p1 + latest.p2 + latest.p3 < 0.99 THEN 'skipped'
       ELSE 'written' END AS status
  FROM v LEFT JOIN latest ON latest.global_idx = v.global_idx)"""


@register("merge_soft_labels", sql=f"""WITH {_MERGE_CTES}
SELECT global_idx, query, title, passage, CAST(label AS INTEGER) AS label, {_P_SQL}
FROM m WHERE status = 'written'""")
def q_merge_soft_labels(spark, sf_dir):
    pairs, scores = _merge_inputs(spark, sf_dir)
    out = merge.merge_soft_labels(pairs, scores, filter_invalid=True, as_json=False)
    return out.select("global_idx", "query", "title", "passage", "label",
                      *_probs_cols("teacher_probs"))


@register("merge_stats", sql=f"""WITH {_MERGE_CTES}
SELECT status, count(*) AS count FROM m GROUP BY status""")
def q_merge_stats(spark, sf_dir):
    pairs, scores = _merge_inputs(spark, sf_dir)
    return merge.merge_stats(pairs, scores, filter_invalid=True)


@register("merge_bounded", sql=f"""WITH {_MERGE_CTES},
r AS (SELECT min(global_idx) AS lo, max(global_idx) AS hi FROM latest)
SELECT status, count(*) AS count FROM m, r WHERE m.global_idx BETWEEN lo AND hi GROUP BY 1""")
def q_merge_bounded(spark, sf_dir):
    """The pair file holds the pairs twice and only its second half is scored;
    the pair scan is cut to the scores' index range (D2)."""
    pairs, scores = _merge_inputs(spark, sf_dir)
    half = pairs.agg(F.max("global_idx")).first()[0] + 1
    twice = pairs.unionByName(pairs.withColumn("global_idx", F.col("global_idx") + half))
    later = scores.withColumn("global_idx", F.col("global_idx") + half)
    return merge.merge_status(twice, later, filter_invalid=True, bounded=True).groupBy("status").count()


@register("missing_pairs", sql=f"""WITH {_MERGE_CTES}
SELECT global_idx, qid FROM m WHERE status = 'missing'""")
def q_missing_pairs(spark, sf_dir):
    pairs, scores = _merge_inputs(spark, sf_dir)
    return merge.missing_pairs(pairs, scores).select("global_idx", "qid")


# -- coverage bitmaps (D4, D6, E10) and the pair store (D1, D2) ------------------

@register("index_coverage", sql=f"""WITH {_PARSE_CTES}
SELECT count(*) AS num_records, count(DISTINCT global_idx) AS num_indexes,
  count(*) - count(DISTINCT global_idx) AS num_duplicates, min(global_idx) AS min_idx, max(global_idx) AS max_idx FROM pr""")
def q_index_coverage(spark, sf_dir):
    """Coverage of two halves of the score lines, merged."""
    ok = _ok(spark, sf_dir)
    halves = [coverage.coverage(ok.where(F.col("line_idx") % 2 == k)) for k in (0, 1)]
    return coverage.coverage_summary(coverage.merge_coverage(*halves))


@register("index_gaps", sql=f"""WITH {_PARSE_CTES},
gone AS (SELECT d.doc_id AS i FROM documents d ANTI JOIN pr ON pr.global_idx = d.doc_id),
runs AS (SELECT i, i // 32768 AS b, i - row_number() OVER (PARTITION BY i // 32768 ORDER BY i) AS r FROM gone)
SELECT min(i) AS first, max(i) AS last FROM runs GROUP BY b, r""")
def q_index_gaps(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")  # ids 0 .. n - 1
    return coverage.index_gaps(coverage.coverage(_ok(spark, sf_dir)), docs.count())


@register("resume_by_bitmap", sql=f"""WITH {_MERGE_CTES}
SELECT global_idx, qid FROM m WHERE status = 'missing'""")
def q_resume_by_bitmap(spark, sf_dir):
    pairs, scores = _merge_inputs(spark, sf_dir)
    return coverage.uncovered_rows(pairs, coverage.coverage(scores)).select("global_idx", "qid")


@register("merge_pair_store", sql=f"""WITH {_MERGE_CTES}
SELECT global_idx, qid, status FROM m""")
def q_merge_pair_store(spark, sf_dir):
    """The merge against pairs that lie in buckets."""
    pairs, scores = _merge_inputs(spark, sf_dir)
    name = f"pairs_{uuid.uuid4().hex}"
    store = pairstore.write_pair_store(pairs.select("global_idx", "qid"), f"{ensure_checkpoint_dir(spark)}/{name}", name, 8)
    return pairstore.merge_with_store(store, scores, filter_invalid=True).select("global_idx", "qid", "status")


# -- shards (V5) ----------------------------------------------------------------

_SHARDS_CTE = f"sh AS ({fx.V5_SHARDS_SQL})"


def _shard_frames(spark, sf_dir):
    """Two tables, of the lower and the upper ranks: two scans whatever the world size."""
    rows = fx.shard_rows(spark, sf_dir)
    half = fx.WORLD_SIZE // 2
    return [rows.where(F.col("rank") < half), rows.where(F.col("rank") >= half)]


@register("shard_counts", sql=f"""WITH {_SHARDS_CTE}
SELECT rank, count(*) AS count FROM sh GROUP BY rank""")
def q_shard_counts(spark, sf_dir):
    return shards.shard_counts(fx.shard_rows(spark, sf_dir))


@register("missing_ranks", sql=f"""WITH {_SHARDS_CTE}
SELECT r.rank FROM range({fx.WORLD_SIZE}) AS r(rank)
WHERE r.rank NOT IN (SELECT DISTINCT rank FROM sh)""")
def q_missing_ranks(spark, sf_dir):
    present = shards.present_ranks(fx.shard_rows(spark, sf_dir))
    return shards.missing_ranks(spark, present, fx.WORLD_SIZE)


@register("union_shards", sql=f"""WITH {_SHARDS_CTE}
SELECT {KEY_SQL}, rank, ROUND(score, 6) AS score FROM sh""")
def q_union_shards(spark, sf_dir):
    u = merge.union_shards(_shard_frames(spark, sf_dir))
    return u.orderBy(*KEY).select(*KEY, "rank", r6("score"))


@register("pairs_to_rescore", sql=f"""WITH {_SHARDS_CTE}
SELECT {KEY_SQL} FROM lineitem
WHERE l_orderkey % {fx.WORLD_SIZE} NOT IN (SELECT DISTINCT rank FROM sh)""")
def q_pairs_to_rescore(spark, sf_dir):
    present = shards.present_ranks(fx.shard_rows(spark, sf_dir))
    missing = shards.missing_ranks(spark, present, fx.WORLD_SIZE)
    pairs = fx.table(spark, sf_dir, "lineitem").select(*KEY)
    return shards.pairs_to_rescore(pairs, missing, fx.WORLD_SIZE, index="l_orderkey")


@register("with_batch", sql=f"""SELECT {KEY_SQL}, CAST(floor(l_orderkey / 64) AS BIGINT) AS batch
FROM lineitem""")
def q_with_batch(spark, sf_dir):
    pairs = fx.table(spark, sf_dir, "lineitem").select(*KEY)
    return shards.with_batch(pairs, 64, index="l_orderkey")


@register("shuffle", sql=f"SELECT {KEY_SQL} FROM lineitem")
def q_shuffle(spark, sf_dir):
    """Seeded, partition-independent shuffle of the pair rows.  Compared as a
    set, the result is the input: no row dropped or repeated (the order is
    tested in pytest)."""
    pairs = fx.table(spark, sf_dir, "lineitem").select(*KEY)
    return shards.seeded_shuffle(pairs, 42, *KEY)


# -- label-order vectors and JSON text (B18, B20) ------------------------------

@register("prob_vector", sql=f"""WITH {_PARSE_CTES}
SELECT line_idx, global_idx, ROUND(p0, 6) AS b0, ROUND(p1, 6) AS b1,
  ROUND(p3, 6) AS w3, CAST(0 AS DOUBLE) AS w4, CAST(0 AS DOUBLE) AS w5 FROM pr""")
def q_prob_vector(spark, sf_dir):
    """4-label maps as a 2-label vector (first two entries, T10) and as a
    6-label vector (absent labels are 0.0)."""
    from ..functions.parse import prob_vector
    ok = _ok(spark, sf_dir)
    v2 = prob_vector("probs", 2)
    v6 = prob_vector("probs", 6, missing="zero")
    return ok.select("line_idx", "global_idx", r6(F.get(v2, 0), "b0"), r6(F.get(v2, 1), "b1"),
                     r6(F.get(v6, 3), "w3"), r6(F.get(v6, 4), "w4"), r6(F.get(v6, 5), "w5"))


@register("soft_label_json", sql=f"""WITH {_MERGE_CTES}
SELECT global_idx, '{{"0":' || CAST(p0 AS VARCHAR) || ',"1":' || CAST(p1 AS VARCHAR)
  || ',"2":' || CAST(p2 AS VARCHAR) || ',"3":' || CAST(p3 AS VARCHAR) || '}}' AS teacher_probs
FROM m WHERE status = 'written'""")
def q_soft_label_json(spark, sf_dir):
    """The soft-label table's ``teacher_probs`` JSON text (B20, A8 column)."""
    pairs, scores = _merge_inputs(spark, sf_dir)
    out = merge.merge_soft_labels(pairs, scores, filter_invalid=True, as_json=True)
    return out.select("global_idx", "teacher_probs")
