"""Registered queries: ranking, calibration, sharpness, distributions (V1, V2, V6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dist
from ..functions.constants import NDCG_CDF_THRESHOLDS
from ..operators import calibration, divergence, fullrank, ranking, sharpness
from ..operators.evaluate import round_py
from . import fixtures as fx
from .registry import r6, register

KEY = list(fx.LI_KEY)
KEY_SQL = fx.LI_KEY_SQL


def _per_query(spark, sf_dir):
    return ranking.ndcg_per_query(fx.pairs_num(spark, sf_dir), qid="qid", rel="rel",
                                  score="score", tie=KEY)


_NDCG_SQL_CTES = f"""v AS ({fx.V1_SQL}),
a AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY
        CASE WHEN score IS NULL OR isnan(score) THEN 1 ELSE 0 END, score DESC, {KEY_SQL}) AS r FROM v),
i AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, {KEY_SQL}) AS r FROM v),
ad AS (SELECT qid,
        SUM(CASE WHEN r <= 5 THEN (pow(2.0, rel) - 1) / log2(r + 1) ELSE 0 END) AS d5,
        SUM(CASE WHEN r <= 10 THEN (pow(2.0, rel) - 1) / log2(r + 1) ELSE 0 END) AS d10
      FROM a WHERE r <= 10 GROUP BY qid),
id AS (SELECT qid,
        SUM(CASE WHEN r <= 5 THEN (pow(2.0, rel) - 1) / log2(r + 1) ELSE 0 END) AS d5,
        SUM(CASE WHEN r <= 10 THEN (pow(2.0, rel) - 1) / log2(r + 1) ELSE 0 END) AS d10
      FROM i WHERE r <= 10 GROUP BY qid),
c AS (SELECT qid, count(*) AS num_docs,
        min({{'a': l_orderkey, 'b': l_partkey, 'c': l_suppkey, 'd': l_linenumber, 'e': l_extendedprice}}) AS first_key
      FROM v GROUP BY qid),
pq AS (SELECT c.qid, c.num_docs, c.first_key,
        CASE WHEN id.d5 = 0 THEN 0.0 ELSE ad.d5 / id.d5 END AS ndcg5,
        CASE WHEN id.d10 = 0 THEN 0.0 ELSE ad.d10 / id.d10 END AS ndcg10
      FROM c JOIN ad ON ad.qid = c.qid JOIN id ON id.qid = c.qid)"""


@register("ndcg_per_query", sql=f"""WITH {_NDCG_SQL_CTES}
SELECT qid, num_docs, ROUND(ndcg5, 6) AS ndcg5, ROUND(ndcg10, 6) AS ndcg10 FROM pq""")
def q_ndcg_per_query(spark, sf_dir):
    return _per_query(spark, sf_dir).select("qid", "num_docs", r6("ndcg5"), r6("ndcg10"))


@register("ndcg_summary", sql=f"""WITH {_NDCG_SQL_CTES}
SELECT count(*) AS num_queries, CAST(sum(num_docs) AS BIGINT) AS num_docs,
  ROUND(avg(ndcg5), 6) AS ndcg5_mean, ROUND(stddev_pop(ndcg5), 6) AS ndcg5_std,
  ROUND(avg(ndcg10), 6) AS ndcg10_mean, ROUND(stddev_pop(ndcg10), 6) AS ndcg10_std FROM pq""")
def q_ndcg_summary(spark, sf_dir):
    s = ranking.ndcg_summary(_per_query(spark, sf_dir))
    return s.select("num_queries", "num_docs", r6("ndcg5_mean"), r6("ndcg5_std"),
                    r6("ndcg10_mean"), r6("ndcg10_std"))


_THRESH_SQL = ", ".join(f"({t!r})" for t in NDCG_CDF_THRESHOLDS)


@register("ndcg_cdf", sql=f"""WITH {_NDCG_SQL_CTES},
t(threshold) AS (VALUES {_THRESH_SQL})
SELECT CAST(t.threshold AS DOUBLE) AS threshold,
  CAST(sum(CASE WHEN pq.ndcg10 <= CAST(t.threshold AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS n_le,
  count(*) AS num_queries,
  ROUND(sum(CASE WHEN pq.ndcg10 <= CAST(t.threshold AS DOUBLE) THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS pct_le
FROM t, pq GROUP BY t.threshold""")
def q_ndcg_cdf(spark, sf_dir):
    c = ranking.ndcg_cdf(_per_query(spark, sf_dir))
    return c.select("threshold", "n_le", "num_queries", r6("pct_le"))


@register("worst_queries", sql=f"""WITH {_NDCG_SQL_CTES}
SELECT qid, num_docs, ROUND(ndcg5, 6) AS ndcg5, ROUND(ndcg10, 6) AS ndcg10
FROM pq ORDER BY ndcg10, first_key, qid LIMIT 5""")
def q_worst_queries(spark, sf_dir):
    w = ranking.worst_queries(_per_query(spark, sf_dir))
    return w.select("qid", "num_docs", r6("ndcg5"), r6("ndcg10"))


@register("corpus_stats", sql=f"""WITH {_NDCG_SQL_CTES}
SELECT count(*) AS num_queries, CAST(sum(num_docs) AS BIGINT) AS num_docs, min(num_docs) AS min_docs,
  max(num_docs) AS max_docs, ROUND(avg(num_docs), 6) AS mean_docs FROM pq""")
def q_corpus_stats(spark, sf_dir):
    s = ranking.corpus_stats(_per_query(spark, sf_dir))
    return s.select("num_queries", "num_docs", "min_docs", "max_docs", r6("mean_docs"))


@register("top_k_per_query", sql=f"""WITH v AS ({fx.V1_SQL}),
a AS (SELECT qid, {KEY_SQL}, score, row_number() OVER (PARTITION BY qid ORDER BY
        CASE WHEN score IS NULL OR isnan(score) THEN 1 ELSE 0 END, score DESC, {KEY_SQL}) AS r FROM v)
SELECT qid, {KEY_SQL}, ROUND(score, 6) AS score, CAST(r AS BIGINT) AS rank FROM a WHERE r <= 10""")
def q_top_k(spark, sf_dir):
    t = ranking.top_k_per_query(fx.pairs_num(spark, sf_dir), 10, tie=KEY)
    return t.select("qid", *KEY, r6("score"), F.col("rank").cast("long").alias("rank"))


@register("rank_in_query", sql=f"""WITH v AS ({fx.V1_SQL}),
h AS (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE qid END AS q FROM v)
SELECT q AS qid, {KEY_SQL}, row_number() OVER (PARTITION BY q ORDER BY
    CASE WHEN score IS NULL OR isnan(score) THEN 1 ELSE 0 END, score DESC, {KEY_SQL}) AS rank,
  row_number() OVER (PARTITION BY q ORDER BY rel DESC, {KEY_SQL}) AS ideal_rank FROM h""")
def q_rank_in_query(spark, sf_dir):
    """Every document's rank by score and by label, where one query holds about a third of all rows."""
    v = fx.pairs_num(spark, sf_dir)
    v = v.withColumn("qid", F.when(F.col("l_linenumber") % 3 == 0, F.lit(-1).cast(v.schema["qid"].dataType)).otherwise(F.col("qid")))
    by_score = fullrank.full_rank(v.select("qid", *KEY, "score", "rel"), tie=KEY)
    both = fullrank.full_rank(by_score, score="rel", tie=KEY, ideal=True, rank_col="ideal_rank")
    return both.select("qid", *KEY, "rank", "ideal_rank")


# -- calibration -------------------------------------------------------------

#: The 11 doubles of an even split of [0, 1] into ten bins.
_BOUNDS = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def _bins_sql(score: str) -> str:
    b = _BOUNDS
    parts = []
    for i in range(10):
        lo, hi = f"CAST({b[i]!r} AS DOUBLE)", f"CAST({b[i + 1]!r} AS DOUBLE)"
        op = "<=" if i == 9 else "<"
        parts.append(f"WHEN {score} >= {lo} AND {score} {op} {hi} THEN {i}")
    return "CASE " + " ".join(parts) + " END"


_REL_SQL = f"""v AS ({fx.V1_SQL}),
b AS (SELECT run, dataset, score AS s, rel / 3.0 AS l, {_bins_sql('score')} AS bin FROM v),
rb AS (SELECT run, dataset, bin, count(*) AS cnt, avg(s) AS avg_conf, avg(l) AS avg_acc
       FROM b GROUP BY run, dataset, bin)"""


@register("reliability", sql=f"""WITH {_REL_SQL}
SELECT run, dataset, bin, cnt AS count, ROUND(avg_conf, 6) AS avg_conf, ROUND(avg_acc, 6) AS avg_acc
FROM rb""")
def q_reliability(spark, sf_dir):
    r = calibration.reliability(fx.pairs_num(spark, sf_dir), score="score", label="rel",
                                label_max=3, by=("run", "dataset"))
    return r.select("run", "dataset", "bin", "count", r6("avg_conf"), r6("avg_acc"))


@register("ece", sql=f"""WITH {_REL_SQL}
SELECT run, dataset, CAST(sum(cnt) AS BIGINT) AS num_samples,
  CAST(sum(CASE WHEN bin IS NULL THEN cnt ELSE 0 END) AS BIGINT) AS unbinned,
  ROUND(sum(CASE WHEN bin IS NOT NULL THEN cnt * abs(avg_conf - avg_acc) ELSE 0 END) / sum(cnt), 6) AS ece
FROM rb GROUP BY run, dataset""")
def q_ece(spark, sf_dir):
    e = calibration.ece(fx.pairs_num(spark, sf_dir), score="score", label="rel",
                        label_max=3, by=("run", "dataset"))
    return e.select("run", "dataset", "num_samples", "unbinned", r6("ece"))


# -- sharpness ---------------------------------------------------------------

def _sum_sql(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def _sharp_sql(n: int) -> str:
    """Per-row entropy / max / soft entropy / margin of renormalised teacher t."""
    t = [f"t[{i + 1}]" for i in range(n)]
    tot = _sum_sql(t)
    q = [f"({x} / {tot})" for x in t]
    clip = [f"least(greatest({x}, 1e-12), 1.0)" for x in q]
    ent = "-" + _sum_sql([f"({c} * ln({c}))" for c in clip])
    z = [f"(ln({c}) / 2.0)" for c in clip]
    zm = f"greatest({', '.join(z)})"
    e = [f"exp({x} - {zm})" for x in z]
    es = _sum_sql(e)
    sp = [f"least(greatest({x} / {es}, 1e-12), 1.0)" for x in e]
    sent = "-" + _sum_sql([f"({c} * ln({c}))" for c in sp])
    cols = [f"{ent} AS ent", f"greatest({', '.join(q)}) AS mx", f"{sent} AS sent"]
    if n == 2:
        cols.append(f"(ln({q[1]}) - ln({q[0]})) AS mg")
    return ", ".join(cols)


def _polar_sql(n: int) -> str:
    extra = (", ROUND(avg(mg), 6) AS mean_margin, ROUND(var_pop(mg), 6) AS var_margin"
             if n == 2 else "")
    return f"""WITH p AS ({fx.probs_sql(n)}), r AS (SELECT run, dataset, {_sharp_sql(n)} FROM p)
SELECT run, dataset, count(*) AS num_samples, ROUND(avg(ent), 6) AS mean_entropy,
  ROUND(avg(mx), 6) AS mean_maxprob, ROUND(avg(sent) - avg(ent), 6) AS temp_sensitivity{extra}
FROM r GROUP BY run, dataset"""


def _polar(n):
    def q(spark, sf_dir):
        p = sharpness.polarization(fx.probs(spark, sf_dir, n), "t", n, by=("run", "dataset"))
        cols = ["run", "dataset", "num_samples", r6("mean_entropy"), r6("mean_maxprob"),
                r6("temp_sensitivity")]
        if n == 2:
            cols += [r6("mean_margin"), r6("var_margin")]
        return p.select(*cols)
    return q


register("polarization", sql=_polar_sql(4))(_polar(4))
register("polarization_binary", sql=_polar_sql(2))(_polar(2))


def _soft_sql(n: int) -> str:
    t = [f"t[{i + 1}]" for i in range(n)]
    tot = _sum_sql(t)
    clip = [f"least(greatest({x} / {tot}, 1e-12), 1.0)" for x in t]
    z = [f"(ln({c}) / 2.0)" for c in clip]
    zm = f"greatest({', '.join(z)})"
    e = [f"exp({x} - {zm})" for x in z]
    es = _sum_sql(e)
    cols = ", ".join(f"ROUND({x} / {es}, 6) AS soft_p{i}" for i, x in enumerate(e))
    return f"WITH p AS ({fx.probs_sql(n)}) SELECT {KEY_SQL}, {cols} FROM p"


@register("temp_soften", sql=_soft_sql(4))
def q_temp_soften(spark, sf_dir):
    s = sharpness.temp_soften(fx.probs(spark, sf_dir, 4), "t", 4)
    return s.select(*KEY, *[r6(F.get(F.col("soft_probs"), i), f"soft_p{i}") for i in range(4)])


@register("weighted_score", sql=f"""WITH p AS ({fx.probs_sql(4)})
SELECT {KEY_SQL}, ROUND((t[1] * 0.0 + t[2] * 1.0 + t[3] * 2.0 + t[4] * 3.0) / 3.0, 6) AS weighted_score,
  ROUND((s[1] * 0.0 + s[2] * 1.0) / 1.0, 6) AS weighted_score_binary FROM p""")
def q_weighted_score(spark, sf_dir):
    p = fx.probs(spark, sf_dir, 4)
    return p.select(*KEY, r6(dist.weighted_score("t", 4), "weighted_score"),
                    r6(dist.weighted_score("s", 2), "weighted_score_binary"))


# -- softmax over logits (V6) -------------------------------------------------

_IDS = fx.LABEL_TOKEN_IDS


def _softmax_full_sql() -> str:
    cols = ", ".join(
        f"ROUND(exp(logits[{i + 1}] - list_max(logits)) / "
        f"list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))), 6) AS p{j}"
        for j, i in enumerate(_IDS))
    return f"WITH v AS ({fx.V6_SQL}) SELECT vec_id, {cols} FROM v"


@register("softmax_full", sql=_softmax_full_sql())
def q_softmax_full(spark, sf_dir):
    v = fx.logits(spark, sf_dir)
    v = dist.with_label_probs_full(v, "logits", _IDS, "p")
    return v.select("vec_id", *[r6(F.get("p", j), f"p{j}") for j in range(len(_IDS))])


def _softmax_label_sql() -> str:
    g = [f"logits[{i + 1}]" for i in _IDS]
    m = f"greatest({', '.join(g)})"
    s = _sum_sql([f"exp({x} - {m})" for x in g])
    cols = ", ".join(f"ROUND(exp({x} - {m}) / {s}, 6) AS p{j}" for j, x in enumerate(g))
    return (f"WITH v AS ({fx.V6_SQL}) SELECT vec_id, {cols}, "
            f"ROUND(logits[{_IDS[1] + 1}] - logits[{_IDS[0] + 1}], 6) AS margin FROM v")


@register("softmax_label", sql=_softmax_label_sql())
def q_softmax_label(spark, sf_dir):
    v = fx.logits(spark, sf_dir)
    p = dist.label_probs_only("logits", _IDS)
    return v.select("vec_id", *[r6(F.get(p, j), f"p{j}") for j in range(len(_IDS))],
                    r6(dist.logit_margin("logits", _IDS), "margin"))


@register("softmax_vector", sql=f"""WITH v AS ({fx.V6_SQL})
SELECT vec_id, ROUND(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))
  / list_sum(list_transform(logits, lambda y: exp(y - list_max(logits)))) * x)), 6) AS expected_logit
FROM v""")
def q_softmax_vector(spark, sf_dir):
    """Full softmax of the 64-wide vector, reduced to ``Σ p_i x_i`` for checking."""
    v = dist.with_softmax(fx.logits(spark, sf_dir), "logits", "p")
    e = F.aggregate(F.zip_with("p", "logits", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return v.select("vec_id", r6(e, "expected_logit"))


# -- divergences (V2) ---------------------------------------------------------

def _div_sql_terms(n: int) -> dict[str, str]:
    def cl(x):
        return f"least(greatest({x}, 1e-8), 1.0 - 1e-8)"
    t = [cl(f"t[{i + 1}]") for i in range(n)]
    s = [cl(f"s[{i + 1}]") for i in range(n)]
    m = [f"(({a}) + ({b})) * 0.5" for a, b in zip(s, t)]

    def kl(a, b):
        return _sum_sql([f"({x}) * (ln({x}) - ln({y}))" for x, y in zip(a, b)])
    sr = [f"s[{i + 1}]" for i in range(n)]
    tr = [f"t[{i + 1}]" for i in range(n)]
    # first argmax of the teacher
    h = "0"
    best = tr[0]
    for i in range(1, n):
        h = f"(CASE WHEN {tr[i]} > {best} THEN {i} ELSE {h} END)"
        best = f"greatest({best}, {tr[i]})"
    sh = "(CASE " + " ".join(f"WHEN {h} = {i} THEN {sr[i]}" for i in range(n)) + " END)"
    return {
        "jsd": f"0.5 * ({kl(s, m)} + {kl(t, m)})",
        "fkl": kl(t, s),
        "rkl": kl(s, t),
        "hard": f"-ln({sh} / {_sum_sql(sr)})",
        "hard_label": h,
    }


_DIV_N = 4
_DIV_TERMS = _div_sql_terms(_DIV_N)


def _div_query(kind):
    def q(spark, sf_dir):
        d = divergence.pair_distributions(fx.teacher_table(spark, sf_dir, _DIV_N),
                                          fx.student_table(spark, sf_dir, _DIV_N), keys=KEY)
        return d.select(*KEY, r6(dist.divergence("t", "s", _DIV_N, kind), f"div_{kind}"))
    return q


for _k in ("jsd", "fkl", "rkl", "hard"):
    register(f"divergence_{_k}", sql=f"""WITH p AS ({fx.probs_sql(_DIV_N)})
SELECT {KEY_SQL}, ROUND({_DIV_TERMS[_k]}, 6) AS div_{_k} FROM p""")(_div_query(_k))


@register("divergence_report", sql=f"""WITH p AS ({fx.probs_sql(_DIV_N)})
SELECT run, count(*) AS num_rows,
  ROUND(avg({_DIV_TERMS['jsd']}), 6) AS loss_jsd, ROUND(avg({_DIV_TERMS['fkl']}), 6) AS loss_fkl,
  ROUND(avg({_DIV_TERMS['rkl']}), 6) AS loss_rkl, ROUND(avg({_DIV_TERMS['hard']}), 6) AS loss_hard
FROM p GROUP BY run""")
def q_divergence_report(spark, sf_dir):
    p = fx.probs(spark, sf_dir, _DIV_N)
    r = divergence.divergence_report(p, _DIV_N, by=("run",))
    return r.select("run", "num_rows", *[r6(f"loss_{k}") for k in ("jsd", "fkl", "rkl", "hard")])


@register("hard_label", sql=f"""WITH p AS ({fx.probs_sql(_DIV_N)})
SELECT {KEY_SQL}, {_DIV_TERMS['hard_label']} AS hard_label FROM p""")
def q_hard_label(spark, sf_dir):
    p = fx.probs(spark, sf_dir, _DIV_N)
    return p.select(*KEY, dist.hard_label("t", _DIV_N).alias("hard_label"))


# -- rounding (B23) ------------------------------------------------------------

@register("python_round", sql=f"""SELECT {KEY_SQL}, CAST(CAST(l_extendedprice / 7.0 AS DECIMAL(30, 12)) AS DECIMAL(20, 4))::DOUBLE AS r4,
  CAST(l_linenumber + l_linenumber % 2 AS DOUBLE) AS even,
  CAST(CASE WHEN l_linenumber % 2 = 0 THEN 0.01 ELSE 0.03 END AS DOUBLE) AS beside FROM lineitem""")
def q_python_round(spark, sf_dir):
    """Values as Python rounds them: prices, exact halves (to even), and decimals
    whose binary value lies beside the middle (0.015 below it, 0.025 above)."""
    li = fx.table(spark, sf_dir, "lineitem")
    odd = F.col("l_linenumber") % 2 == 1
    return li.select(*KEY, round_py(F.col("l_extendedprice") / 7.0, 4).alias("r4"),
                     round_py(F.col("l_linenumber") + F.lit(0.5), 0).alias("even"),
                     round_py(F.when(odd, F.lit(0.025)).otherwise(F.lit(0.015)), 2).alias("beside"))
