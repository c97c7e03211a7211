import tracemalloc

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, SparseMatrix
from pyspark.sql import functions as F

from pairlab.operators import learn
from pairlab.plans import learn_queries


def pairs_of(spark, n=40):
    rows = [(i, f"apple  Pear{i % 3}", f"t {i}", None if i == 5 else f"apple plum Pear{i % 4}, kiwi", i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "global_idx long, query string, title string, passage string, label int")


def test_counts_fit_and_score_as_texts_do(spark):
    pairs = pairs_of(spark)
    counted = learn.token_counts(pairs, ("global_idx", "label"))
    assert set(counted.columns) == {*learn.COUNTS, "global_idx", "label"}
    out = [[(r[0], [round(v, 9) for v in r[1].values()]) for r in learn.score_pairs(learn.fit_hard(p, 2, 5), p, 2)
            .orderBy("global_idx").select("global_idx", "probs").collect()] for p in (pairs, counted)]
    assert out[0] == out[1] and len(out[0]) == 40


def test_scoring_reads_dense_coefficients(spark):
    pairs = pairs_of(spark)
    model = learn.fit_hard(pairs, 2, 5)
    assert isinstance(model.stages[-1].coefficientMatrix, SparseMatrix)  # most hashed tokens do not occur
    dense = learn._dense(model, spark)
    assert isinstance(dense.stages[-1].coefficientMatrix, DenseMatrix) and dense.stages[:-1] == model.stages[:-1]
    assert len({frozenset((p.name, v) for p, v in m.stages[-1].extractParamMap().items()) for m in (dense, model)}) == 1
    assert dense.stages[-1].getLabelCol() == "__label"
    want = {r[0]: r[1] for r in model.transform(learn.pair_features(pairs)).select("global_idx", vector_to_array("probability")).collect()}
    got = {r[0]: list(r[1].values()) for r in learn.score_pairs(model, pairs, 2).select("global_idx", "probs").collect()}
    assert len(got) == 40 and all(abs(a - b) < 1e-12 for i in got for a, b in zip(got[i], want[i]))


def test_overlap_hashes_the_query_side(spark):
    rows = [("a b b c", "b d B"), ("", "x"), ("x y", None), (None, None), ("k l", "l k k m")]
    df = spark.createDataFrame(rows, "query string, passage string").withColumn("title", F.lit(None).cast("string"))
    out = learn.pair_features(df).select("__overlap")
    assert [r[0] for r in out.collect()] == [1 / 3, 0.0, 0.0, 0.0, 1.0]
    assert "array_intersect(__dtok" in out._jdf.queryExecution().analyzed().toString()


def test_start_is_taken_over(spark, monkeypatch):
    soft = pairs_of(spark).withColumn("teacher_probs", F.expr("array(0.25 + label * 0.5D, 0.75 - label * 0.5D)"))
    first = learn.fit_soft(soft, 2, "fkl", max_iter=3)
    want = learn.fit_soft(soft, 2, "rkl", max_iter=3).stages[-1]
    monkeypatch.setattr(learn, "fit_weighted", lambda *a: 1 / 0)  # the forward KL fit is not made again
    got = learn.fit_soft(soft, 2, "rkl", max_iter=3, start=first).stages[-1]
    assert abs(got.coefficientMatrix.toArray() - want.coefficientMatrix.toArray()).max() < 1e-9


def test_overlap_scorer_holds_one_pair(spark):
    text = [" ".join(f"w{i}x{k}" for k in range(2000)) for i in range(200)]
    batch = pd.DataFrame({"global_idx": range(201), "query": ["W0X1 none w0x1", *[None] * 200], "passage": [*text, None]})
    tracemalloc.start()
    got = learn_queries._overlap_scorer(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["score"].tolist() == [2 / 3] + [0.0] * 200
    assert peak < 3e6  # all sets at once take tens of MB
