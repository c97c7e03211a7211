"""Relevance scorers fitted with Spark ML, scoring, bring-your-own scorer, resume.

The reference fine-tunes transformers; the table-level job it performs —
fit a scorer from hard or soft labels, score a pair table into the score
schema, rescore only what is missing — is expressed here with Spark ML
(distributed L-BFGS over hashed text features) and ``mapInPandas``.

Features: hashed, IDF-weighted tokens of the query and of the document
(separate hash spaces) plus the fraction of query tokens found in the
document.  Soft labels (forward KL) become one weighted row per (pair,
label): minimising weighted cross-entropy with weights = teacher
probabilities is forward KL up to the teacher's constant entropy.  Jensen-Shannon
and reverse KL are no likelihoods; ``softfit`` minimises them on the same features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDF, IDFModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dist
from ..functions.parse import decode_probs, prob_vector
from ..functions.text import clamp_label, doc_text, label_int, normalize_field
from ..session import materialized
from .softfit import fit_saved, fit_weighted, saved_rows, softmax_model

# Hash space per text side; the gradient L-BFGS aggregates every iteration is
# 2 * NUM_FEATURES * num_labels doubles, so this is the knob for speed.
NUM_FEATURES = 1 << 14
SOFT_REG = 0.001  # penalty of the Jensen-Shannon and reverse KL fits, whose losses are smaller
TOL = 1e-5  # relative change of the loss at which fits stop

# Token counts of both texts and the overlap, as ``token_counts`` writes them.
COUNTS = ("__qtf", "__dtf", "__overlap")

# What separates tokens: anything but letters, marks, digits and underscore of any script.
NON_WORD = r"(?U)\W+"


def pair_features(pairs: DataFrame) -> DataFrame:
    """Normalised query and document text, their tokens and the query-term overlap."""
    q = normalize_field("query")
    d = normalize_field(doc_text(F.coalesce("title", F.lit("")), F.coalesce("passage", F.lit("")),
                                 "cross"))
    df = pairs.withColumn("__qtext", q).withColumn("__dtext", d)
    for side in ("q", "d"):  # one split per text, read by the overlap and the counts
        df = df.withColumn(f"__{side}tok", F.array_remove(F.split(f"__{side}text", NON_WORD), ""))
    known = F.size(F.array_intersect("__dtok", "__qtok"))  # distinct tokens; the second side, the short one, is hashed
    overlap = known / F.greatest(F.size(F.array_distinct("__qtok")), F.lit(1))
    return df.withColumn("__overlap", overlap.cast("double"))


def _counted(num_features: int) -> Pipeline:
    return Pipeline(stages=[
        HashingTF(inputCol="__qtok", outputCol="__qtf", numFeatures=num_features),
        HashingTF(inputCol="__dtok", outputCol="__dtf", numFeatures=num_features),
    ])


def _weighted() -> Pipeline:
    return Pipeline(stages=[
        IDF(inputCol="__qtf", outputCol="__qv"),
        IDF(inputCol="__dtf", outputCol="__dv"),
        VectorAssembler(inputCols=["__qv", "__dv", "__overlap"], outputCol="features"),
    ])


def _spread(pairs: DataFrame) -> DataFrame:
    """Dealt over the cores where the input has fewer partitions than that; else as it is."""
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    return pairs.repartition(cores) if pairs.rdd.getNumPartitions() < cores else pairs


def token_counts(pairs: DataFrame, keep: Sequence[str], num_features: int = NUM_FEATURES) -> DataFrame:
    """Pairs with their token counts and overlap (``COUNTS``) in place of the texts,
    written once: fits and scoring of the same pairs read this table, so that the
    texts are split and hashed once for all of them."""
    narrow = _spread(pairs.select("query", "title", "passage", *keep))
    count = _counted(num_features).fit(narrow)  # nothing to fit
    return materialized(count.transform(pair_features(narrow)).select(*COUNTS, *keep), "token-counts")


def _feature_rows(pairs: DataFrame, keep: Sequence[str], num_features: int,
                  fitted: PipelineModel | None = None) -> tuple[PipelineModel, DataFrame]:
    """The fitted feature stages, and ``features`` with the columns ``keep``.

    Texts are read once: token counts are written as a table, which both the
    document frequencies (each pair counts once) and the rows read.  ``fitted``:
    a model whose feature stages are taken over.
    """
    if set(COUNTS) <= set(pairs.columns):
        counts = pairs.select(*COUNTS, *keep)
    else:
        counts = token_counts(pairs, keep, num_features)
    if fitted is not None:
        features = PipelineModel(fitted.stages[:-1])
    else:
        features = PipelineModel([*_counted(num_features).fit(counts).stages, *_weighted().fit(counts).stages])
    return features, _after_counts(features).transform(counts).select("features", *keep)


def _after_counts(model: PipelineModel) -> PipelineModel:
    """The stages that follow the token counts."""
    return PipelineModel([s for s in model.stages if not isinstance(s, HashingTF)])


def _units(model: PipelineModel) -> np.ndarray:
    """The weight of each hashed token, of which its values are whole multiples, and 1 for the overlap."""
    return np.concatenate([*[s.idf.toArray() for s in model.stages if isinstance(s, IDFModel)], [1.0]])


def _classifier(rows: DataFrame, weight_col: str | None, max_iter: int, reg: float, tol: float = TOL):
    """The classifier of ``features, __label`` (and a weight).

    Spark ML keeps the rows in blocks of its own (memory, spilling to disk) for
    the L-BFGS passes, so they are not persisted here a second time; they are
    read twice from the token counts.
    """
    classifier = LogisticRegression(featuresCol="features", labelCol="__label", family="multinomial",
                                    maxIter=max_iter, regParam=reg, tol=tol)
    if weight_col:
        classifier.setWeightCol(weight_col)
    return classifier.fit(rows.select("features", "__label", *([weight_col] if weight_col else [])))


def fit_hard(pairs: DataFrame, num_labels: int, max_iter: int = 30, reg: float = 0.01) -> PipelineModel:
    """Fit from hard labels (I1): ``int(label)``, clamped to 0/1 for two labels;
    0 without a label column, and a null label raises."""
    label = label_int(F.col("label").cast("string")) if "label" in pairs.columns else F.lit(0)
    lab = clamp_label(label, num_labels).cast("double")
    features, rows = _feature_rows(pairs.withColumn("__label", lab), ["__label"], NUM_FEATURES)
    return PipelineModel([*features.stages, _classifier(rows, None, max_iter, reg)])


def fit_soft(soft: DataFrame, num_labels: int, kind: str = "fkl", probs: str = "teacher_probs",
             max_iter: int = 30, reg: float = 0.01, start: PipelineModel | None = None) -> PipelineModel:
    """Fit from teacher distributions (I2), by any loss of the distributions.

    ``kind='fkl'``: multinomial regression on one row per (pair, label) weighted
    by the teacher probability, from one row per pair (``softfit.fit_weighted``);
    ``kind='hard'``: the teacher's first argmax; ``kind='jsd'`` (or ``'soft'``)
    and ``'rkl'``: the optimiser of ``softfit``, started at the forward KL fit,
    or at ``start`` where the caller has that fit of the same rows.  ``probs``
    may be JSON text, a map (``{"0": p, ...}``) or an array in label order.
    """
    kind = dist.check_kind(kind)
    dt = soft.schema[probs].dataType
    if isinstance(dt, T.ArrayType):
        vec = F.col(probs)
    else:   # a map, or JSON text as written by the soft-label sink (A7)
        vec = prob_vector(decode_probs(soft, probs), num_labels, "zero")
    features, rows = _feature_rows(soft.withColumn("__t", vec), ["__t"], NUM_FEATURES, start)
    if kind == "hard":
        labelled = rows.withColumn("__label", dist.hard_label("__t", num_labels).cast("double"))
        return PipelineModel([*features.stages, _classifier(labelled, None, max_iter, reg)])
    rows = saved_rows(rows)  # read by every pass of both optimisers
    unit = _units(features)
    model = start.stages[-1] if start is not None else fit_weighted(rows, num_labels, max_iter, reg, TOL, unit)
    if model is None:  # labels that no teacher gives weight to, or other lengths: rows per label
        per_label = (rows.select("features", F.posexplode("__t").alias("__lab", "__w")).where(F.col("__w") > 0)
                     .withColumn("__label", F.col("__lab").cast("double")))
        model = _classifier(per_label, "__w", max_iter, reg)
    if kind != "fkl":
        model = fit_saved(rows, num_labels, kind, max_iter, SOFT_REG, start=model, unit=unit)
    return PipelineModel([*features.stages, model])


def _dense(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The same stages, their classifier with dense coefficients.

    Spark ML returns coefficients as a sparse matrix where many hashed tokens do
    not occur, and then walks all its entries for each row it scores; of a dense
    one it reads only the row's own tokens.
    """
    *features, last = model.stages
    if isinstance(last, LogisticRegressionModel) and isinstance(matrix := last.coefficientMatrix, SparseMatrix) \
            and matrix.numRows == last.numClasses:
        last = last._copyValues(softmax_model(spark, matrix.toArray(), last.interceptVector.toArray()))
    return PipelineModel([*features, last])


def score_pairs(model: PipelineModel, pairs: DataFrame, num_labels: int) -> DataFrame:
    """Score a pair table into the score schema (I3): ``global_idx, probs
    (map "0".."n-1"), output_text (predicted label), weighted_score``.  Pairs of
    ``token_counts`` are scored from their counts."""
    model, counted = _dense(model, pairs.sparkSession), set(COUNTS) <= set(pairs.columns)
    out = _after_counts(model).transform(pairs) if counted else model.transform(pair_features(pairs))
    p = vector_to_array("probability")
    out = out.withColumn("__p", p)
    m = F.map_from_arrays(F.array(*[F.lit(str(i)) for i in range(num_labels)]),
                          F.array(*[F.get(F.col("__p"), i) for i in range(num_labels)]))
    return out.select("global_idx", m.alias("probs"),
                      F.col("prediction").cast("int").cast("string").alias("output_text"),
                      dist.weighted_score("__p", num_labels).alias("weighted_score"))


def score_with(pairs: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame],
               schema: T.StructType | str) -> DataFrame:
    """Bring-your-own scorer over Arrow batches (I4): ``fn`` maps a pandas batch
    of pair rows to a pandas frame of the given schema.  The batch size is the
    session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` (B27)."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            yield fn(batch)
    return pairs.mapInPandas(run, schema)


def resume_scores(pairs: DataFrame, existing: DataFrame, scorer: Callable[[DataFrame], DataFrame],
                  world_size: int | None = None, missing_ranks: DataFrame | None = None,
                  mode: str = "strided", merge_only: bool = False) -> DataFrame:
    """Resume (I5): score only the rows the existing scores lack and union.

    With ``missing_ranks`` (and ``world_size``) the rows of whole missing
    shards are rescored (D6); otherwise every pair without a score is.
    ``merge_only`` returns the existing scores unchanged.  ``scorer`` maps a
    pair DataFrame to score rows (e.g. ``lambda p: score_pairs(model, p, 2)``).
    """
    from .shards import pairs_to_rescore, unscored_rows
    if merge_only:
        return existing
    if missing_ranks is not None:
        todo = pairs_to_rescore(pairs, missing_ranks, world_size, mode)
    else:
        todo = unscored_rows(pairs, existing)
    cols = existing.columns
    return existing.unionByName(scorer(todo).select(*cols))
