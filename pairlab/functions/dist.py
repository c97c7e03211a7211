"""Per-row distribution math on ``ARRAY<DOUBLE>`` columns (2.C).

Label distributions have a known, small length (``num_labels`` is 2 or 4),
so the hot functions unroll to plain ``get(p, i)`` arithmetic: that keeps
them inside whole-stage codegen, where higher-order lambdas would not be.
Functions over arrays of unknown length (``softmax`` of a vocabulary-sized
logit vector) use ``aggregate``/``transform``.  The element-wise helpers
(clip, exp, ln, log2, pow, max, sum) are Spark's own functions (C18).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import DIVERGENCE_EPS, DIVERGENCE_KINDS, ENTROPY_EPS, SOFTEN_TEMPERATURE


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _items(p, n: int) -> list[Column]:
    p = _col(p)
    return [F.get(p, F.lit(i)) for i in range(n)]


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def _xlnx(x: Column) -> Column:
    return x * F.ln(x)


# -- softmax family ----------------------------------------------------------

def softmax_stats(a) -> Column:
    """``struct(m, s)``: max and ``Σ exp(x - m)`` of an array in one pass.

    An online fold (rescale the running sum when the max grows), so no lambda
    refers back to the array: a lambda that read ``array_max(a)`` would
    recompute it for every element, quadratic in a vocabulary-sized vector.
    """
    init = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))

    def step(acc, x):
        m = F.greatest(acc["m"], x)
        return F.struct(m.alias("m"), (acc["s"] * F.exp(acc["m"] - m) + F.exp(x - m)).alias("s"))
    return F.aggregate(_col(a), init, step)


def with_softmax(df, a: str, out: str):
    """Softmax of an array column of any length (C1), as a new column.

    The max/sum struct is its own column first, so the per-element lambda
    reads a column instead of re-deriving the statistics.
    """
    df = df.withColumn("__sm", softmax_stats(a))
    return df.withColumn(out, F.transform(a, lambda x: F.exp(x - F.col("__sm.m")) / F.col("__sm.s"))) \
        .drop("__sm")


def with_label_probs_full(df, logits: str, label_ids, out: str):
    """Full-vocabulary softmax gathered at the label ids, as a new column (C2); Σ <= 1.

    The vocabulary is folded once, in a generator of its own: an inlined fold
    would run for every label's numerator and denominator.
    """
    df = df.select("*", F.inline(F.array(F.struct(softmax_stats(logits).alias("__sm")))))
    probs = F.array(*[F.exp(F.get(logits, F.lit(i)) - F.col("__sm.m")) / F.col("__sm.s") for i in label_ids])
    return df.withColumn(out, probs).drop("__sm")


def label_probs_only(logits, label_ids) -> Column:
    """Softmax over the gathered label logits only."""
    a = _col(logits)
    g = [F.get(a, F.lit(i)) for i in label_ids]
    m = F.greatest(*g) if len(g) > 1 else g[0]
    e = [F.exp(x - m) for x in g]
    s = _sum(e)
    return F.array(*[x / s for x in e])


def renormalize(p, n: int) -> Column:
    """``p_i / Σp`` (C3 identity: label-only softmax from full-vocab probs);
    null where there is no mass to share."""
    xs = _items(p, n)
    s = _sum(xs)
    return F.when(s > 0, F.array(*[F.try_divide(x, s) for x in xs]))


def weighted_score(p, n: int) -> Column:
    """Expected label scaled to [0, 1]: ``Σ i·p_i / (n-1)`` (C4)."""
    if n < 2:
        return F.lit(None).cast("double")
    xs = _items(p, n)
    return _sum([x * F.lit(float(i)) for i, x in enumerate(xs)]) / F.lit(float(n - 1))


def margin(p, eps: float = ENTROPY_EPS) -> Column:
    """Binary margin ``ln p1 - ln p0`` (= logit_1 - logit_0), clipped as in the
    entropy, so that a probability rounded to 0 has a finite margin (C5)."""
    xs = [_clip(x, eps, 1.0) for x in _items(p, 2)]
    return F.ln(xs[1]) - F.ln(xs[0])


def logit_margin(logits, label_ids) -> Column:
    a = _col(logits)
    return F.get(a, F.lit(label_ids[1])) - F.get(a, F.lit(label_ids[0]))


def entropy(p, n: int, eps: float = ENTROPY_EPS) -> Column:
    """``-Σ q ln q`` with ``q = clip(p, eps, 1)``."""
    return -_sum([_xlnx(_clip(x, eps, 1.0)) for x in _items(p, n)])


def max_prob(p, n: int) -> Column:
    """Largest probability, unclipped."""
    xs = _items(p, n)
    return F.greatest(*xs) if n > 1 else xs[0]


def soften(p, n: int, temperature: float = SOFTEN_TEMPERATURE,
           eps: float = ENTROPY_EPS) -> Column:
    """``softmax(ln(clip(p)) / T)``."""
    z = [F.ln(_clip(x, eps, 1.0)) / F.lit(float(temperature)) for x in _items(p, n)]
    m = F.greatest(*z) if n > 1 else z[0]
    e = [F.exp(x - m) for x in z]
    s = _sum(e)
    return F.array(*[x / s for x in e])


def hard_label(t, n: int) -> Column:
    """First index of the maximum."""
    xs = _items(t, n)
    idx, best = F.lit(0), xs[0]
    for i in range(1, n):
        idx = F.when(xs[i] > best, F.lit(i)).otherwise(idx)
        best = F.greatest(best, xs[i])
    return idx


def _kl(a: list[Column], b: list[Column]) -> Column:
    return _sum([x * (F.ln(x) - F.ln(y)) for x, y in zip(a, b)])


def check_kind(kind: str) -> str:
    """Loss-type validation (C16); ``soft`` is an alias of ``jsd``."""
    if kind not in DIVERGENCE_KINDS:
        raise ValueError(f"invalid divergence kind {kind!r}; one of {DIVERGENCE_KINDS}")
    return "jsd" if kind == "soft" else kind


def divergence(teacher, student, n: int, kind: str,
               eps: float = DIVERGENCE_EPS) -> Column:
    """Per-row divergence between teacher ``t`` and student ``s``.

    * ``jsd``  ½KL(s‖m) + ½KL(t‖m), m = ½(s+t), both clamped
    * ``fkl``  KL(t‖s)
    * ``rkl``  KL(s‖t)
    * ``hard`` -ln(s_h / Σs), h = first argmax of t (label-only softmax of the
      student, clipped at the entropy's bound; null without student mass)
    """
    kind = check_kind(kind)
    if kind == "hard":
        s = _items(student, n)
        h = hard_label(teacher, n)
        sh = F.get(F.array(*s), h)
        mass = _sum(s)
        return F.when(mass > 0, -F.ln(_clip(F.try_divide(sh, mass), ENTROPY_EPS, 1.0)))
    t = [_clip(x, eps, 1.0 - eps) for x in _items(teacher, n)]
    s = [_clip(x, eps, 1.0 - eps) for x in _items(student, n)]
    if kind == "fkl":
        return _kl(t, s)
    if kind == "rkl":
        return _kl(s, t)
    m = [(x + y) * F.lit(0.5) for x, y in zip(s, t)]
    return F.lit(0.5) * (_kl(s, m) + _kl(t, m))


def dcg_term(rel, rank) -> Column:
    """``(2^rel - 1) / log2(rank + 1)`` with a 1-based rank (C17)."""
    return (F.pow(F.lit(2.0), _col(rel)) - F.lit(1.0)) / F.log2(_col(rank) + F.lit(1))
