"""Many runs at once: leaderboard, evaluation grid, result-store skip.

The reference evaluates one checkpoint per process.  Here the runs are a
column: one long table ``(run, dataset, row, probs, label, qid)`` is
evaluated by grouping, so parallelism over runs and over rows is the same
thing and every metric is a partial aggregate.

Passes over the score table for a leaderboard: one for NDCG (the ranked top-K branch,
see ``ranking``) and one for calibration and sharpness together (a single
``groupBy(run, dataset, bin)`` partial aggregate).
Rows whose probabilities hold no mass have no sharpness; they are counted and
named in the run's ``error``, and the means are over the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.constants import ECE_BINS, SOFTEN_TEMPERATURE
from .incremental import RUN_KEYS, evaluation_states, state_report
from .ranking import ndcg_values
from ..session import materialized

def evaluation_grid(runs: DataFrame, datasets: Sequence[str], run_col: str = "run") -> DataFrame:
    """Runs × the given data-set tags (D7).  The tags are a parameter list (as on
    a command line), so the grid is an ``explode`` per run, not a join."""
    return runs.select(run_col).distinct() \
        .withColumn("dataset", F.explode(F.array(*[F.lit(d) for d in datasets])))


def pending(todo: DataFrame, done: DataFrame, available: DataFrame | None = None,
            keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Combinations still to evaluate (A12): not in the result store (anti join)
    and, when given, with an available input (semi join on the data set)."""
    out = todo.join(done.select(*keys).distinct(), list(keys), "left_anti")
    if available is not None:
        out = out.join(available.select("dataset").distinct(), "dataset", "left_semi")
    return out.select(*todo.columns)


def calibration_sharpness(scores: DataFrame, score: str, label: str, probs: str,
                          num_labels: int, label_max: int = 1, n_bins: int = ECE_BINS,
                          temperature: float = SOFTEN_TEMPERATURE,
                          keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """ECE and the polarization summary per run in one pass (E5 + E7).

    Level 1 groups by ``keys + bin`` (≤ n_bins + 1 rows per run leave each map
    task); level 2 combines the bins per run (``incremental``).
    """
    states = evaluation_states(scores, score, label, probs, num_labels, label_max, n_bins, temperature, keys)
    cols = [*keys, "num_samples", "num_without_mass", "ece", "mean_entropy", "mean_maxprob", "temp_sensitivity"]
    return state_report(states, keys).select(*cols, *(["mean_margin", "var_margin"] if num_labels == 2 else []))


def leaderboard(scores: DataFrame, expected: DataFrame | None = None, qid: str = "qid",
                rel: str = "rel", score: str = "score", probs: str = "probs",
                num_labels: int = 2, label_max: int = 1, tie: Sequence[str] = ("global_idx",),
                keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """One row per (run, dataset): NDCG@5/@10 means, ECE, polarization.

    ``expected`` lists the (run, dataset) combinations that should have
    results; those without any score row get an ``error`` row (T22).  Sorted
    by run name as text (G4).
    """
    pq = ndcg_values(scores, qid=qid, rel=rel, score=score, tie=tie, by=keys)
    ndcg = pq.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_queries"),
                                 F.avg("ndcg5").alias("ndcg5"), F.avg("ndcg10").alias("ndcg10"))
    cs = calibration_sharpness(scores, score, rel, probs, num_labels, label_max, keys=keys)
    lacking = F.when(F.col("num_without_mass") > 0, F.concat(
        F.col("num_without_mass").cast("string"), F.lit(" rows without probability mass")))
    out = ndcg.join(cs, list(keys), "inner").withColumn("error", lacking).drop("num_without_mass")
    if expected is not None:
        exp = expected.select(*keys).distinct().withColumn("__exp", F.lit(True))
        out = out.join(exp, list(keys), "full_outer") \
            .withColumn("error", F.when(F.col("num_samples").isNull(), F.lit("no scores"))
                        .otherwise(F.col("error"))).drop("__exp")
    return out.orderBy(*keys)


def evaluate_runs(scores: DataFrame, pairs: DataFrame, join_keys: Sequence[str] = ("dataset", "global_idx"),
                  expected: DataFrame | None = None, materialize: bool = True,
                  **kw) -> DataFrame:
    """Evaluate every run of a long score table against its pairs.

    ``scores``: ``run, dataset, <row key>, probs[, score]``; ``pairs``:
    ``dataset, <row key>, qid, rel``.  Without a ``score`` column the weighted
    score of ``probs`` is used (C4).  A run whose scores do not match the data
    set's pairs one to one gets an ``error`` row with no metrics (B22).
    ``materialize`` writes the joined narrow table once as Parquet under the
    session's ``spark.checkpoint.dir`` and evaluates from it, so each metric
    branch reads its own columns instead of running the join again.
    """
    n = kw.get("num_labels", 2)
    keys = list(kw.get("keys", RUN_KEYS))
    if "score" not in scores.columns:
        scores = scores.withColumn("score", dist.weighted_score("probs", n))
    # the flag tells matched rows, so that the scores are read once
    # row keys first: a sort compares by its first column, which run keys hardly tell apart
    on = sorted(join_keys, key=keys.__contains__)
    joined = scores.join(pairs.withColumn("__hit", F.lit(True)), on, "left")
    if materialize:
        joined = materialized(joined, "runs")
    board = leaderboard(joined.where("__hit"), expected=expected, **kw)
    shared = [k for k in keys if k in join_keys]
    counts = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("__ns")).join(
        pairs.groupBy(*shared).agg(F.count(F.lit(1)).alias("__np")), shared, "left")
    board = board.join(counts, keys, "full_outer")
    differ = F.col("__ns").isNotNull() & ~(
        F.col("__ns").eqNullSafe(F.col("__np")) & F.col("__ns").eqNullSafe(F.col("num_samples")))
    text = F.format_string("rows differ: %d scores, %d pairs, %d matched", "__ns",
                           F.coalesce("__np", F.lit(0)), F.coalesce("num_samples", F.lit(0)))
    metrics = [F.when(~differ, F.col(c)).alias(c) for c in board.columns
               if c not in (*keys, "num_samples", "error", "__ns", "__np")]
    return board.select(*keys, "num_samples", *metrics, F.when(differ, text).otherwise(F.col("error")).alias("error")) \
        .orderBy(*keys)


def teacher_report(scores: DataFrame, num_labels: int, path_col: str = "path",
                   probs: str = "probs") -> DataFrame:
    """Polarization per teacher (E7, B24): the teacher is the parent directory
    of the checkpoint path (else its basename), with its size tag and sample
    count; one row per teacher, sorted by name (G4)."""
    from ..functions.parse import teacher_name, teacher_size
    from .sharpness import polarization
    named = scores.withColumn("checkpoint_name", teacher_name(path_col))
    rep = polarization(named, probs, num_labels, by=("checkpoint_name",))
    return rep.withColumn("teacher_size", teacher_size("checkpoint_name")).orderBy("checkpoint_name")


def write_results(results: DataFrame, path: str, keys: Sequence[str] = RUN_KEYS) -> None:
    """Append leaderboard rows to a result store partitioned by ``keys``.

    Dynamic partition overwrite replaces only the (run, dataset) partitions
    present in ``results``, so a re-run of one combination does not touch the
    others.
    """
    (results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys).parquet(path))


def done_combinations(spark, path: str, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """(run, dataset) combinations already in the result store (A12).  Only the
    partition columns are selected; an absent store means nothing is done."""
    schema = ", ".join(f"{k} string" for k in keys)
    try:
        store = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)  # no store yet
    return store.select(*keys).distinct()
