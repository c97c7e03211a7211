"""A distributed optimiser for distillation losses that are no likelihoods.

Spark ML fits forward KL as a weighted likelihood, but not Jensen-Shannon or
reverse KL.  Here a softmax-linear student is fitted to teacher distributions by
L-BFGS with a backtracking line search.  Each evaluation is one pass over the
feature rows: every partition sums its loss and its gradient over Arrow batches,
and the partial gradients, cut into blocks of ``BLOCK`` numbers, are added in two
grouped steps (partitions of a bucket, then buckets), so that no task and not the
driver holds more than the square root of the partitions times a block.  What
passes through the driver is the model itself (labels x features numbers), which
does not grow with the pairs.

Features are scaled by their standard deviation while fitting, as Spark ML does,
and the L2 penalty is on the scaled coefficients, not on the intercepts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DIVERGENCE_EPS
from ..session import materialized

BLOCK = 1 << 13
#: A feature vector as Parquet holds it, and the teacher's distribution.
ROWS = "features struct<type:tinyint,size:int,indices:array<int>,values:array<double>>, __t array<double>"


def loss_and_slope(t: np.ndarray, s: np.ndarray, kind: str, eps: float = DIVERGENCE_EPS) -> tuple[np.ndarray, np.ndarray]:
    """Per-row loss between teacher and student rows, and its derivative by the student's logits."""
    t, inner = np.clip(t, eps, 1 - eps), (s > eps) & (s < 1 - eps)
    c = np.clip(s, eps, 1 - eps)
    if kind == "fkl":
        loss, by_s = (t * np.log(t / c)).sum(axis=1), -t / c
    elif kind == "rkl":
        loss, by_s = (c * np.log(c / t)).sum(axis=1), np.log(c / t) + 1
    elif kind == "jsd":
        m = 0.5 * (t + c)
        loss, by_s = 0.5 * (c * np.log(c / m) + t * np.log(t / m)).sum(axis=1), 0.5 * np.log(c / m)
    else:
        raise ValueError(f"no loss of kind {kind!r}")
    by_s = np.where(inner, by_s, 0.0)  # a clipped probability does not move
    return loss, s * (by_s - (s * by_s).sum(axis=1, keepdims=True))


def cross_entropy(t: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per-row cross-entropy of teacher weights with the student's logits, and its derivative by the logits.

    One row per label weighted by its teacher weight has the same sums.
    """
    t = np.where(t > 0, t, 0.0)
    shifted = z - z.max(axis=1, keepdims=True)
    e = np.exp(shifted)
    total, weight = e.sum(axis=1, keepdims=True), t.sum(axis=1, keepdims=True)
    return (t * (np.log(total) - shifted)).sum(axis=1), weight * e / total - t


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: The same as bytes, which readers copy whole: indices (16 bit where all fit, else 32), values as
#: multiples of their feature's unit (8 bit, 0 for a value that is none) and the values that are none (64 bit).
PACKED = "indices binary, times binary, numbers binary, __t array<double>"
#: Pairs whose entries are worked on at a time: their arrays stay in the processor's cache.
SLICE = 512


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of bytes, and how many each row has."""
    size = np.dtype(kind).itemsize
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    flat = np.frombuffer(held, np.uint8)[ends[0]:ends[-1]].view(kind) if held is not None else np.zeros(0, kind)
    return flat, np.diff(ends) // size


def _multiples(value: np.ndarray, unit: np.ndarray | float) -> np.ndarray:
    """What each value is as a multiple (1 to 255) of its unit, to the last bit; 0 where it is none."""
    with np.errstate(all="ignore"):
        times = np.rint(value / unit)
        times = np.where((times >= 1) & (times <= 255), times, 1.0)
        return np.where(times * unit == value, times, 0.0).astype(np.uint8)


class _Batch:
    """An Arrow batch of ``ROWS`` or ``PACKED``: entries of the feature matrix and teacher rows.

    Dense vectors have no indices; theirs are 0 .. size - 1.
    """

    def __init__(self, batch: pa.RecordBatch):
        n, self.times, self.used = batch.num_rows, None, 0
        if "numbers" in batch.schema.names:
            self.times, self.size = _numbers(batch["times"], "u1") if n else (np.zeros(0, np.uint8), np.zeros(0, int))
            self.value = _numbers(batch["numbers"], "f8")[0] if n else np.zeros(0)
            raw = _numbers(batch["indices"], "u1")[0] if n else np.zeros(0, np.uint8)
            self.index = raw.view(np.uint16 if len(raw) == 2 * len(self.times) else np.int32)
        else:
            values, indices = (batch["features"].field(k) for k in ("values", "indices"))
            self.size = np.diff(values.offsets.to_numpy()) if n else np.zeros(0, int)
            self.value = values.flatten().to_numpy()
            if indices.null_count:
                self.index = np.concatenate([np.arange(k) if i is None else np.array(i, np.int64)
                                             for i, k in zip(indices.to_pylist(), self.size)])
            else:
                self.index = indices.flatten().to_numpy()
        self.t = batch["__t"].flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1))

    def values(self, entries: slice, index: np.ndarray, unit: np.ndarray | None) -> np.ndarray:
        """The values of some entries; those of ``PACKED`` are asked for from the first to the last."""
        if self.times is None:
            return self.value[entries]
        times = self.times[entries]
        out = times.astype(np.float64) if unit is None else times * unit.take(index)
        none = np.flatnonzero(times == 0)
        out[none] = self.value[self.used:self.used + len(none)]
        self.used += len(none)
        return out


class _Slice:
    """Some rows of a batch."""

    def __init__(self, batch: _Batch, first: int, entries: slice, unit: np.ndarray | None):
        size = batch.size[first:first + SLICE]
        self.size, self.index, self.t = size, batch.index[entries].astype(np.int64), batch.t[first:first + SLICE]
        self.value = batch.values(entries, self.index, unit)


def _by_row(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the entries of each row, 0 for a row without any."""
    out, some = np.zeros(len(size)), size > 0
    if len(values):
        out[some] = np.add.reduceat(values, (np.cumsum(size) - size)[some])
    return out


def _slices(batches: Iterator[pa.RecordBatch], unit: np.ndarray | None = None) -> Iterator[_Slice]:
    for batch in map(_Batch, batches):
        ends = np.concatenate(([0], np.cumsum(batch.size)))
        for first in range(0, len(batch.size), SLICE):
            last = min(first + SLICE, len(batch.size))
            yield _Slice(batch, first, slice(ends[first], ends[last]), unit)


def _packed(rows: DataFrame, n_features: int | None = None, unit: np.ndarray | None = None) -> DataFrame:
    """Rows of ``ROWS`` saved as ``PACKED``, which every pass reads with the same ``unit`` (of each feature; else 1).

    Weighted token counts are whole multiples of their token's weight, so that an
    entry takes 3 bytes, not 12; any other value is kept as it is.
    """
    kind = np.uint16 if n_features is not None and n_features <= 1 << 16 else np.int32

    def as_bytes(numbers: np.ndarray, size: np.ndarray) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum(size * numbers.itemsize))).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(numbers.tobytes())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch)
            times = _multiples(b.value, 1.0 if unit is None else unit.take(b.index))
            before = np.concatenate(([0], np.cumsum(times == 0)))
            left = np.diff(before[np.concatenate(([0], np.cumsum(b.size)))])
            cols = [as_bytes(b.index.astype(kind), b.size), as_bytes(times, b.size), as_bytes(b.value[times == 0], left), batch["__t"]]
            yield pa.RecordBatch.from_arrays(cols, names=["indices", "times", "numbers", "__t"])
    return materialized(rows.mapInArrow(pack, PACKED), "soft-packed")


def _partials(total: np.ndarray, extra: tuple[float, int]) -> pa.RecordBatch:
    blocks = [total[at:at + BLOCK] for at in range(0, len(total), BLOCK)] or [total]
    first = np.arange(len(blocks)) == 0
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(blocks))), pa.array([b.tobytes() for b in blocks], pa.binary()),
         pa.array(np.where(first, extra[0], 0.0)), pa.array(np.where(first, extra[1], 0), pa.int64())],
        names=["block", "part", "loss", "rows"])


def _added(rows: pa.Table) -> tuple[bytes, float, int]:
    total = np.zeros(len(rows["part"][0].as_py()) // 8)
    for raw in rows["part"]:
        total += np.frombuffer(raw.as_py())
    return total.tobytes(), float(np.sum(rows["loss"].to_numpy())), int(np.sum(rows["rows"].to_numpy()))


def _summed(rows: DataFrame, partial, size: int) -> tuple[np.ndarray, float, int]:
    """Sum vectors of ``size`` numbers over partitions: ``partial`` maps batches to one vector, a loss and a row count."""
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _partials(*partial(batches))

    def add(key: tuple[pa.Scalar, ...], some: pa.Table) -> pa.Table:
        part, loss, n = _added(some)
        cols = [*([k.as_py()] for k in key), [part], [loss], [n]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * len(key) + [pa.binary(), pa.float64(), pa.int64()])],
                        names=[*("block", "bucket")[:len(key)], "part", "loss", "rows"])
    buckets = max(1, round(rows.rdd.getNumPartitions() ** 0.5))
    parts = rows.mapInArrow(per_partition, "block long, part binary, loss double, rows long") \
        .withColumn("bucket", (F.spark_partition_id() % buckets).cast("long"))
    some = parts.groupBy("block", "bucket").applyInArrow(add, "block long, bucket long, part binary, loss double, rows long")
    whole = some.groupBy("block").applyInArrow(add, "block long, part binary, loss double, rows long")
    found = sorted((r["block"], bytes(r["part"]), r["loss"], r["rows"]) for r in whole.collect())
    out = np.concatenate([np.frombuffer(p) for _, p, _, _ in found]) if found else np.zeros(size)
    return out, sum(x[2] for x in found), sum(x[3] for x in found)


def _moments(rows: DataFrame, n_features: int, n_labels: int,
             unit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Standard deviation of each feature, mean teacher distribution and number of rows."""
    size = 2 * n_features + n_labels

    def partial(batches):
        total, n = np.zeros(size), 0
        for batch in _slices(batches, unit):
            total[:n_features] += np.bincount(batch.index, batch.value, minlength=n_features)
            total[n_features:2 * n_features] += np.bincount(batch.index, batch.value ** 2, minlength=n_features)
            total[2 * n_features:] += batch.t.sum(axis=0) if len(batch.t) else 0.0
            n += len(batch.t)
        return total, (0.0, n)
    total, _, n = _summed(rows, partial, size)
    mean, square = total[:n_features] / max(n, 1), total[n_features:2 * n_features] / max(n, 1)
    return np.sqrt(np.maximum(square - mean ** 2, 0.0)), total[2 * n_features:] / max(n, 1), n


def _pass(rows: DataFrame, weights: np.ndarray, scale: np.ndarray, kind: str,
          unit: np.ndarray | None = None) -> tuple[np.ndarray, float, int]:
    """Sum of gradients (by scaled coefficients and intercepts), sum of losses and number of rows."""
    n_features, n_labels = len(scale), weights.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast((weights[:-1] * scale[:, None], weights[-1], unit))

    def partial(batches):
        coef, intercept, unit = sent.value
        by_label = [np.ascontiguousarray(coef[:, k]) for k in range(n_labels)]
        sums, last, loss, n = np.zeros((n_labels, n_features)), np.zeros(n_labels), 0.0, 0
        for batch in _slices(batches, unit):
            rows_here = len(batch.t)
            z = np.stack([_by_row(batch.value * by_label[k].take(batch.index), batch.size) for k in range(n_labels)], axis=1) + intercept
            one, slope = cross_entropy(batch.t, z) if kind == "ce" else loss_and_slope(batch.t, softmax(z), kind)
            for k in range(n_labels):
                sums[k] += np.bincount(batch.index, batch.value * np.repeat(slope[:, k], batch.size), minlength=n_features)
            last += slope.sum(axis=0)
            loss, n = loss + float(one.sum()), n + rows_here
        return np.vstack((sums.T * scale[:, None], last)).ravel(), (loss, n)
    try:
        return _summed(rows, partial, weights.size)
    finally:
        sent.unpersist()


def minimise(objective, start: np.ndarray, max_iter: int, tol: float, history: int = 8) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with backtracking; ``objective`` gives value and gradient.  Returns the point and the values on the way."""
    x, (value, gradient) = start, objective(start)
    values, pairs = [value], []
    for _ in range(max_iter):
        direction, stack = -gradient, []
        for s, y in reversed(pairs):
            a = (s @ direction) / (s @ y)
            stack.append(a)
            direction = direction - a * y
        if pairs:
            s, y = pairs[-1]
            direction = direction * ((s @ y) / (y @ y))
        else:
            direction = direction / max(1.0, float(np.linalg.norm(gradient)))
        for (s, y), a in zip(pairs, reversed(stack)):
            direction = direction + (a - (y @ direction) / (s @ y)) * s
        slope = float(gradient @ direction)
        if slope >= 0:
            direction, slope, pairs = -gradient, -float(gradient @ gradient), []
        step = 1.0
        for _ in range(12):
            new_value, new_gradient = objective(x + step * direction)
            if new_value <= value + 1e-4 * step * slope:
                break
            step *= 0.4
        else:
            break
        s, y = step * direction, new_gradient - gradient
        if s @ y > 1e-12 * float(np.linalg.norm(s) * np.linalg.norm(y)):
            pairs = [*pairs[1 - history:], (s, y)]
        x, gradient, before, value = x + s, new_gradient, value, new_value
        values.append(value)
        if before - value <= tol * max(1.0, abs(before)):
            break
    return x, values


def _weighted_moments(rows: DataFrame, n_features: int, n_labels: int,
                      unit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and unbiased standard deviation of each feature where a row counts with its teacher weights, and the labels' weights."""
    size = 2 * n_features + n_labels + 1

    def partial(batches):
        total, n = np.zeros(size), 0
        for batch in _slices(batches, unit):
            t = np.where(batch.t > 0, batch.t, 0.0)
            once = np.repeat(t.sum(axis=1), batch.size) * batch.value
            total[:n_features] += np.bincount(batch.index, once, minlength=n_features)
            total[n_features:2 * n_features] += np.bincount(batch.index, once * batch.value, minlength=n_features)
            total[2 * n_features:-1] += t.sum(axis=0)
            total[-1] += (t ** 2).sum()
            n += len(t)
        return total, (0.0, n)
    total, _, _ = _summed(rows, partial, size)
    labels, weight = total[2 * n_features:-1], total[2 * n_features:-1].sum()
    mean = total[:n_features] / weight
    left = np.maximum(total[n_features:2 * n_features] - weight * mean ** 2, 0.0)
    spread = weight - total[-1] / weight
    return mean, np.sqrt(left / spread) if spread > 0 else np.zeros(n_features), labels


def _wolfe(phi, first: float) -> float | None:
    """A step that meets the strong Wolfe conditions, by brackets and cubic steps; None where none is found.

    ``phi`` gives value and slope along the line.  The tests and limits are those of
    the line search behind Spark ML's logistic regression.
    """
    def at(step):
        return (step, *phi(step))
    zero = low = at(0.0)
    if zero[2] > 0:
        return None

    def between(a, b):
        d = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
        root = np.sqrt(max(d * d - a[2] * b[2], 0.0))
        width = b[0] - a[0]
        step = b[0] - width * (b[2] + root - d) / (b[2] - a[2] + 2 * root)
        return min(max(step, a[0] + 0.1 * width), a[0] + 0.9 * width)

    def zoom(low, high):
        for _ in range(10):
            now = at(between(high, low) if low[0] > high[0] else between(low, high))
            if now[1] > zero[1] + 1e-4 * now[0] * zero[2] or now[1] >= low[1]:
                high = now
            else:
                if abs(now[2]) <= 0.9 * abs(zero[2]):
                    return now[0]
                if now[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = now
        return None
    step = first
    for i in range(10):
        now = at(step)
        if not np.isfinite(now[1]):
            step /= 2
            continue
        if now[1] > zero[1] + 1e-4 * step * zero[2] or (now[1] >= low[1] and i > 0):
            return zoom(low, now)
        if abs(now[2]) <= 0.9 * abs(zero[2]):
            return step
        if now[2] >= 0:
            return zoom(now, low)
        low, step = now, step * 1.5
    return None


def minimise_wolfe(objective, start: np.ndarray, max_iter: int, tol: float, history: int = 10, memory: int = 20) -> np.ndarray:
    """L-BFGS with a strong Wolfe line search and the stopping tests of Spark ML's logistic regression.

    It stops after ``max_iter`` steps, when the value is within ``tol`` (of the
    first value) of the largest of the last ``memory`` values, when the gradient
    is small, or when the line search fails twice in a row.
    """
    known = {}

    def evaluate(x):
        key = x.tobytes()
        if key not in known:
            known.clear()
            known[key] = objective(x)
        return known[key]
    x = start
    value, gradient = evaluate(x)
    first, seen, pairs, failed, step_no = value, [np.inf], [], False, 0
    while step_no < max_iter:
        if len(seen) > 1 and abs(value - max(seen)) <= tol * first or np.linalg.norm(gradient) <= max(tol * value, 1e-8):
            break
        direction, factors = gradient.copy(), []
        for s, y in reversed(pairs):
            a = (s @ direction) / (s @ y)
            direction -= a * y
            factors.append(a)
        if pairs:
            s, y = pairs[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(factors)):
            direction += (a - (y @ direction) / (s @ y)) * s
        direction = -direction

        def phi(t, x=x, direction=direction, value=value, gradient=gradient):
            v, g = evaluate(x + direction * t) if t else (value, gradient)
            return v, float(g @ direction)
        step = _wolfe(phi, 1.0 / np.linalg.norm(direction) if step_no == 0 else 1.0)
        if step is None or step * np.linalg.norm(gradient) < 1e-10:
            if failed:
                break
            failed, pairs = True, []
            continue
        failed = False
        moved = x + direction * step
        new_value, new_gradient = evaluate(moved)
        pairs = [*pairs[-(history - 1):], (moved - x, new_gradient - gradient)]
        x, value, gradient, step_no = moved, new_value, new_gradient, step_no + 1
        seen = [*seen, value][-memory:]
    return x


def saved_rows(features: DataFrame) -> DataFrame:
    """``features`` and the teacher distribution ``__t``, written once under the checkpoint folder and read by every pass."""
    return materialized(features.select("features", F.col("__t").cast("array<double>").alias("__t")), "soft-rows")


def _plain(rows: DataFrame) -> DataFrame:
    """All rows of ``saved_rows`` with their vectors as Parquet holds them."""
    return rows.sparkSession.read.schema(ROWS).parquet(*rows.inputFiles())


def fit_weighted(rows: DataFrame, n_labels: int, max_iter: int, reg: float, tol: float,
                 unit: np.ndarray | None = None) -> LogisticRegressionModel | None:
    """Multinomial regression on one row per (pair, label) weighted by ``__t``, from ``saved_rows`` as they were returned.

    The model is that of Spark ML's ``LogisticRegression`` on the exploded rows:
    features scaled by their weighted deviation and centred, an L2 penalty on the
    scaled coefficients, the intercepts started at the labels' weights, the same
    steps.  Each pass reads a pair once, with all its labels, where exploded rows
    hold its features once per label; ``unit``: a number per feature of which most
    values are whole multiples, so that they are read as bytes.  Returns None where the exploded rows would
    have other labels: a label without weight, or teachers of another length.
    """
    bad = F.exists("__t", lambda x: F.isnan(x)) | (F.size("__t") != n_labels)
    taught = rows.where(F.col("__t").isNotNull())
    if taught.where(bad).limit(1).count() or (head := taught.select("features").first()) is None:
        return None
    n_features = head["features"].size
    plain = _packed(_plain(rows).where(F.col("__t").isNotNull())
                    .withColumn("__t", F.transform("__t", lambda x: F.coalesce(x, F.lit(0.0)))), n_features, unit)
    mean, spread, labels = _weighted_moments(plain, n_features, n_labels, unit)
    if not (labels > 0).all():
        return None
    scale = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
    centre, weight = mean * scale, labels.sum()

    def objective(flat: np.ndarray) -> tuple[float, np.ndarray]:
        w = flat.reshape(n_features + 1, n_labels).copy()
        coef = w[:-1].copy()
        w[-1] -= centre @ coef
        gradient, loss, _ = _pass(plain, w, scale, "ce", unit)
        gradient = gradient.reshape(w.shape) / weight
        gradient[:-1] += reg * coef - centre[:, None] * gradient[-1]
        return loss / weight + 0.5 * reg * float((coef ** 2).sum()), gradient.ravel()
    start = np.zeros((n_features + 1, n_labels))
    start[-1] = np.log1p(labels) - np.log1p(labels).mean()
    w = minimise_wolfe(objective, start.ravel(), max_iter, tol).reshape(n_features + 1, n_labels)
    intercepts = w[-1] - centre @ w[:-1]
    return softmax_model(rows.sparkSession, (w[:-1] * scale[:, None]).T, intercepts - intercepts.mean())


def fit_distribution(features: DataFrame, n_labels: int, kind: str, max_iter: int = 30, reg: float = 0.001,
                     tol: float = 1e-6, start: LogisticRegressionModel | None = None) -> LogisticRegressionModel:
    """A softmax-linear model of ``features`` (vector) that minimises the mean ``kind`` loss to ``__t``.

    The rows are written once under the checkpoint folder and read by every
    pass.  The search starts at ``start`` (the losses are not convex, forward KL
    is), else at the mean teacher distribution.  Rows whose teacher is null or
    has another number of labels are left out; without rows it raises.
    """
    return fit_saved(saved_rows(features), n_labels, kind, max_iter, reg, tol, start)


def fit_saved(saved: DataFrame, n_labels: int, kind: str, max_iter: int = 30, reg: float = 0.001,
              tol: float = 1e-6, start: LogisticRegressionModel | None = None,
              unit: np.ndarray | None = None) -> LogisticRegressionModel:
    """``fit_distribution`` of ``saved_rows``, as they were returned; ``unit`` as in ``fit_weighted``."""
    taught = (F.size("__t") == n_labels) & ~F.exists("__t", lambda x: x.isNull() | F.isnan(x))
    head = saved.where(taught).select("features").first()
    if head is None:
        raise ValueError("no row with a teacher distribution")
    n_features = head["features"].size
    rows = _packed(_plain(saved).where(taught), n_features, unit)
    spread, prior, n = _moments(rows, n_features, n_labels, unit)
    scale = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)

    def objective(flat: np.ndarray) -> tuple[float, np.ndarray]:
        w = flat.reshape(n_features + 1, n_labels)
        gradient, loss, _ = _pass(rows, w, scale, kind, unit)
        gradient = gradient.reshape(w.shape) / n
        gradient[:-1] += reg * w[:-1]
        return loss / n + 0.5 * reg * float((w[:-1] ** 2).sum()), gradient.ravel()
    first_w = np.zeros((n_features + 1, n_labels))
    if start is None:
        first_w[-1] = np.log(np.maximum(prior, 1e-6))
    else:
        first_w[:-1] = start.coefficientMatrix.toArray().T * spread[:, None]
        first_w[-1] = start.interceptVector.toArray()
    flat, _ = minimise(objective, first_w.ravel(), max_iter, tol)
    w = flat.reshape(n_features + 1, n_labels)
    return softmax_model(rows.sparkSession, (w[:-1] * scale[:, None]).T, w[-1])


def softmax_model(spark, coefficients: np.ndarray, intercepts: np.ndarray) -> LogisticRegressionModel:
    """A Spark ML model from coefficients (labels, features) and intercepts."""
    sc, (k, f) = spark.sparkContext, coefficients.shape
    matrix = _py2java(sc, DenseMatrix(k, f, coefficients.ravel(order="F").tolist()))
    vector = _py2java(sc, DenseVector(intercepts.tolist()))
    name = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel
    return LogisticRegressionModel(name(f"softfit_{k}x{f}", matrix, vector, k, True))
