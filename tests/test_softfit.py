import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pairlab.functions import dist
from pairlab.operators import softfit


def taught(n=400, k=3, f=5, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, f)) * (draw.random((n, f)) < 0.7)
    t = softfit.softmax(x @ draw.normal(size=(f, k)) + 0.5 * draw.normal(size=(n, k)))
    return x, t


def frame(spark, x, t, sparse=True):
    def vec(row):
        return Vectors.sparse(len(row), [(i, v) for i, v in enumerate(row.tolist()) if v]) if sparse else Vectors.dense(row.tolist())
    return spark.createDataFrame([(vec(a), b.tolist()) for a, b in zip(x, t)], ["features", "__t"])


@pytest.mark.parametrize("kind", ["jsd", "rkl", "fkl"])
def test_slope_is_the_derivative(kind):
    draw = np.random.default_rng(0)
    z, t = draw.normal(size=(50, 4)) * 2, softfit.softmax(draw.normal(size=(50, 4)))
    t[0] = [1, 0, 0, 0]  # clamped
    _, slope = softfit.loss_and_slope(t, softfit.softmax(z), kind)
    for k in range(4):
        step = np.zeros(4)
        step[k] = 1e-6
        up, down = (softfit.loss_and_slope(t, softfit.softmax(z + s), kind)[0] for s in (step, -step))
        assert np.allclose((up - down) / 2e-6, slope[:, k], atol=1e-5)


@pytest.mark.parametrize("kind", ["jsd", "rkl", "fkl"])
def test_loss_is_the_librarys_divergence(spark, kind):
    draw = np.random.default_rng(2)
    t, s = (softfit.softmax(draw.normal(size=(40, 4)) * 3) for _ in range(2))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(t, s))], "i int, t array<double>, s array<double>")
    got = [r["d"] for r in df.orderBy("i").select(dist.divergence("t", "s", 4, kind).alias("d")).collect()]
    assert np.allclose(got, softfit.loss_and_slope(t, s, kind)[0])


@pytest.mark.parametrize("sparse", [True, False])
def test_pass_equals_one_process(spark, sparse, monkeypatch, tmp_path):
    monkeypatch.setattr(softfit, "BLOCK", 7)
    x, t = taught()
    frame(spark, x, t, sparse).repartition(9).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.schema(softfit.ROWS).parquet(str(tmp_path / "rows"))
    w, scale = np.random.default_rng(3).normal(size=(6, 3)), np.array([1.0, 0.5, 2.0, 0.0, 3.0])
    gradient, loss, n = softfit._pass(rows, w, scale, "jsd")
    one, slope = softfit.loss_and_slope(t, softfit.softmax((x * scale) @ w[:-1] + w[-1]), "jsd")
    want = np.vstack(((x * scale).T @ slope, slope.sum(axis=0)))
    assert n == len(x) and np.isclose(loss, one.sum()) and np.allclose(gradient.reshape(6, 3), want)
    spread, prior, n = softfit._moments(rows, 5, 3)
    assert np.allclose(spread, x.std(axis=0)) and np.allclose(prior, t.mean(axis=0)) and n == len(x)


@pytest.mark.parametrize("kind", ["jsd", "rkl"])
def test_fit_finds_a_point_without_slope(spark, kind):
    x, t = taught()
    model = softfit.fit_distribution(frame(spark, x, t), 3, kind, max_iter=60, reg=0.01, tol=1e-10)
    spread, w, b = x.std(axis=0), model.coefficientMatrix.toArray().T, model.interceptVector.toArray()
    loss, slope = softfit.loss_and_slope(t, softfit.softmax(x @ w + b), kind)
    gradient = (x.T @ slope) / len(x) * (1 / spread)[:, None] + 0.01 * w * spread[:, None]
    assert np.abs(gradient).max() < 1e-3 and np.abs(slope.mean(axis=0)).max() < 1e-3
    constant, _ = softfit.loss_and_slope(t, np.tile(t.mean(axis=0), (len(t), 1)), kind)
    assert loss.mean() < 0.5 * constant.mean()
    got = model.transform(frame(spark, x, t)).select("probability").collect()
    assert np.allclose([r[0].toArray() for r in got], softfit.softmax(x @ w + b))


def test_rows_without_a_teacher(spark):
    x, t = taught(60)
    rows = frame(spark, x, t)
    odd = rows.limit(5)
    more = rows.unionByName(odd.withColumn("__t", F.lit(None).cast("array<double>"))).unionByName(
        odd.withColumn("__t", F.array(F.lit(1.0)))).unionByName(odd.withColumn("__t", F.array(F.lit(float("nan")), F.lit(1.0), F.lit(0.0))))
    one, two = (softfit.fit_distribution(d, 3, "rkl", max_iter=5) for d in (rows, more))
    assert np.allclose(one.coefficientMatrix.toArray(), two.coefficientMatrix.toArray(), atol=1e-6)
    with pytest.raises(ValueError, match="no row"):
        softfit.fit_distribution(odd.limit(0), 3, "rkl")


def test_weighted_fit_is_spark_mls_on_rows_per_label(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression
    x, t = taught(300, 3, 6, seed=5)
    t[:20, 1] = 0.0
    x[:, 4] = 2.0  # no deviation
    df = softfit.saved_rows(frame(spark, x, t).unionByName(frame(spark, x[:3], t[:3]).withColumn("__t", F.lit(None).cast("array<double>"))))
    model = softfit.fit_weighted(df, 3, 30, 0.01, 1e-5)
    rows = df.select("features", F.posexplode("__t").alias("label", "w")).where("w > 0").withColumn("label", F.col("label").cast("double"))
    want = LogisticRegression(family="multinomial", weightCol="w", maxIter=30, regParam=0.01, tol=1e-5).fit(rows)
    assert np.allclose(model.coefficientMatrix.toArray(), want.coefficientMatrix.toArray(), atol=1e-8)
    assert np.allclose(model.interceptVector.toArray(), want.interceptVector.toArray(), atol=1e-8)


def test_weighted_fit_leaves_other_labels_to_spark_ml(spark):
    x, t = taught(30)
    t[:, 2] = 0.0
    assert softfit.fit_weighted(softfit.saved_rows(frame(spark, x, t)), 3, 5, 0.01, 1e-5) is None
    assert softfit.fit_weighted(softfit.saved_rows(frame(spark, x, t)), 4, 5, 0.01, 1e-5) is None


def test_packed_rows_hold_the_same_entries(spark):
    x, t = taught(50)
    saved = softfit.saved_rows(frame(spark, x, t))
    plain = softfit._plain(saved)
    packed = softfit._packed(plain)
    w, scale = np.random.default_rng(3).normal(size=(6, 3)), np.ones(5)
    one, two = (softfit._pass(d, w, scale, "ce") for d in (plain, packed))
    assert np.allclose(one[0], two[0]) and np.isclose(one[1], two[1]) and one[2] == two[2] == 50


def test_whole_multiples_are_packed_as_bytes(spark):
    draw = np.random.default_rng(9)
    unit = np.array([0.1, 1 / 3, 2.7, 0.0, 1.0])
    times = draw.integers(0, 300, (500, 5)) * (draw.random((500, 5)) < 0.6)
    x = times * unit
    x[:, 4] = draw.random(500)  # no multiples
    x[7], x[8, 0] = 0.0, -0.1
    saved = softfit.saved_rows(frame(spark, x, np.full((500, 3), 1 / 3)))
    packed = softfit._packed(softfit._plain(saved), 5, unit)
    kept = packed.select(F.sum(F.length("indices") / 2), F.sum(F.length("times")), F.sum(F.length("numbers")) / 8).first()
    assert kept[0] == kept[1] == (x != 0).sum() and kept[2] == ((times[:, :3] > 255) & (x[:, :3] != 0)).sum() + 500 - 1 + 1 - (times[8, 0] > 255)
    w, scale = draw.normal(size=(6, 3)), np.ones(5)
    one, two = softfit._pass(softfit._plain(saved), w, scale, "ce"), softfit._pass(packed, w, scale, "ce", unit)
    assert np.allclose(one[0], two[0], rtol=1e-12) and np.isclose(one[1], two[1], rtol=1e-12) and one[2] == two[2] == 500


def test_slices_hold_the_values_to_the_last_bit(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(softfit, "SLICE", 2)
    unit = np.array([0.1, 1 / 3, np.nan])
    value, index = np.array([0.1 * 3, 0.5, 7 * (1 / 3), 2.0, 0.1 * 255, 0.1 * 256, -0.0]), np.array([0, 1, 1, 2, 0, 0, 1])
    times = softfit._multiples(value, unit.take(index))
    assert times.tolist() == [3, 0, 7, 0, 255, 0, 0]
    size = [2, 0, 3, 2]
    at = np.concatenate(([0], np.cumsum(size)))

    def cut(numbers, some=None):
        return pa.array([numbers[a:b][some[a:b] if some is not None else slice(None)].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
    batch = pa.RecordBatch.from_arrays([cut(index.astype(np.uint16)), cut(times), cut(value, times == 0), pa.array([[1.0]] * 4)],
                                       names=["indices", "times", "numbers", "__t"])
    for some in (batch, batch.slice(2)):
        found = list(softfit._slices(iter([some]), unit))
        got = np.concatenate([s.value for s in found])
        assert got.tobytes() == value[len(value) - len(got):].tobytes() and sum(len(s.t) for s in found) == some.num_rows


def test_sums_by_row_with_empty_rows():
    value, size = np.arange(1.0, 7.0), np.array([0, 2, 0, 0, 3, 1, 0])
    assert softfit._by_row(value, size).tolist() == [0, 3, 0, 0, 12, 6, 0]
    assert softfit._by_row(np.zeros(0), np.zeros(3, int)).tolist() == [0, 0, 0]
    assert softfit._by_row(np.zeros(0), np.zeros(0, int)).tolist() == []
