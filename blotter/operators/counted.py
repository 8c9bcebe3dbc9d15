"""Fits on counted rows (M4, M5, M11 in a sweep of perceptrons).

A perceptron's loss is a sum over rows, and rows of equal features differ in their
class alone: a table of the different feature vectors with the numbers of rows of each
class has the same loss and gradient as all rows. Features that are date parts and
categories have as many vectors as the calendar and the categories allow, whatever
the number of rows.

Spark's perceptron takes no weights, so the optimiser is here: that of Spark's
default solver (Breeze's L-BFGS with 10 corrections, a line search by the strong
Wolfe conditions, the same stopping rules), from the weights that Spark's estimator
starts with. Spark averages the means of blocks of rows, here rows weigh alike; where
all blocks are full both are the same. Scalers and components of counted rows are
fitted by Spark's estimators, on rows that have the moments of all rows.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4096  # vectors that are worked out together


def fit_scaler(scaler: StandardScaler, rows: DataFrame, n: str = "n") -> StandardScalerModel:
    """The scaler's model of as many copies of each row as ``n`` says: fitted on two rows that
    have the copies' mean and deviation."""
    col = scaler.getInputCol()
    both = Summarizer.metrics("mean", "variance").summary(F.col(col), F.col(n).cast("double"))
    found = rows.select(both.alias("of"), F.sum(n).alias("n"), F.sum(F.col(n).cast("double") ** 2).alias("squares")).first()
    total = float(found["n"])
    # Spark's weights are of reliability, copies of frequency
    variance = found["of"]["variance"].toArray() * ((total - found["squares"] / total) / max(total - 1, 1))
    mean, away = found["of"]["mean"].toArray(), np.sqrt(np.maximum(variance, 0) / 2)
    return scaler.fit(rows.sparkSession.createDataFrame([(Vectors.dense(mean + away),), (Vectors.dense(mean - away),)], [col]))


def fit_pca(pca: PCA, rows: DataFrame, n: str = "n") -> PCAModel:
    """The components of as many copies of each row as ``n`` says: those of each row's difference
    to the mean, there and back, times the root of ``n``."""
    col = pca.getInputCol()
    mean = rows.select(Summarizer.mean(F.col(col), F.col(n).cast("double"))).first()[0]
    away = F.zip_with(vector_to_array(F.col(col)), F.array(*map(F.lit, mean.toArray().tolist())), lambda x, m: x - m)
    both = rows.select(away.alias("x"), F.explode(F.array(F.sqrt(n), -F.sqrt(n))).alias("w"))
    return pca.fit(both.select(array_to_vector(F.transform("x", lambda x: x * F.col("w"))).alias(col)))


def objective(x: np.ndarray, counts: np.ndarray, layers: list[int]):
    """Mean cross-entropy and its gradient as a function of the weights (per layer, as
    Spark has them: inputs by outputs, then the biases); sigmoids, softmax on top."""
    total, places, at = counts.sum(), [], 0
    for n, k in zip(layers, layers[1:]):
        places.append((slice(at, at + n * k), slice(at + n * k, at + n * k + k), (n, k)))
        at += n * k + k

    def value(v: np.ndarray) -> tuple[float, np.ndarray]:
        loss, grad = 0.0, np.zeros_like(v)
        parts = [(v[w].reshape(shape), v[b]) for w, b, shape in places]
        for a in range(0, len(x), CHUNK):
            outs, y = [x[a:a + CHUNK]], counts[a:a + CHUNK]
            for w, b in parts[:-1]:
                with np.errstate(over="ignore"):
                    outs.append(1.0 / (1.0 + np.exp(-(outs[-1] @ w + b))))
            z = outs[-1] @ parts[-1][0] + parts[-1][1]
            z -= z.max(1, keepdims=True)
            e = np.exp(z)
            s, n = e.sum(1, keepdims=True), y.sum(1, keepdims=True)
            loss += float((n * np.log(s)).sum() - (y * z).sum())
            delta = e * (n / s) - y
            for i in range(len(parts) - 1, -1, -1):
                w, b, shape = places[i]
                grad[w] += (outs[i].T @ delta).ravel()
                grad[b] += delta.sum(0)
                if i:
                    delta = (delta @ parts[i][0].T) * outs[i] * (1.0 - outs[i])
        return loss / total, grad / total
    return value


class _Failed(Exception):
    """No step is found."""


def _interpolated(low: tuple, high: tuple) -> float:
    """The least of the cubic through two points ``(t, value, slope)``, not too near either."""
    (lt, lv, ls), (rt, rv, rs) = sorted((low, high), key=lambda p: p[0])
    d1 = ls + rs - 3 * (lv - rv) / (lt - rt)
    root = d1 * d1 - ls * rs
    d2 = np.sqrt(root) if root >= 0 else np.nan
    t = rt - (rt - lt) * (rs + d2 - d1) / (rs - ls + 2 * d2)
    lowest, highest = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
    return lowest if t < lowest else highest if t > highest else t


def _step(phi, start: tuple, t: float, tries: int = 10) -> float:
    """A step along a direction that satisfies the strong Wolfe conditions."""
    _, value, slope = low = start
    if slope > 0:
        raise _Failed

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(tries):
            c = phi(_interpolated(low, high))
            if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(slope):
                return c[0]
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise _Failed

    for i in range(tries):
        c = phi(t)
        if not np.isfinite(c[1]):
            t /= 2.0
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, 1.5 * t
    raise _Failed


def _direction(grad: np.ndarray, history: deque) -> np.ndarray:
    """Downhill by the approximate inverse Hessian of the last steps (latest first)."""
    out, kept = grad.copy(), []
    if history:
        step, change = history[0]
        if not step @ change >= 0:
            raise _Failed
        scale = (step @ change) / (change @ change)
    for step, change in history:
        rho = step @ change
        a = (step @ out) / rho
        if np.isnan(a):
            raise _Failed
        out -= a * change
        kept.append((step, change, rho, a))
    if history:
        out *= scale
    for step, change, rho, a in reversed(kept):
        out += (a - (change @ out) / rho) * step
    return -out


def minimize(fn, x: np.ndarray, max_iter: int, tol: float, corrections: int = 10) -> np.ndarray:
    """Weights of least loss by L-BFGS, as Breeze goes about it: stops after ``max_iter`` steps,
    when 20 values lie within ``tol`` of the first one, at a small gradient or without a step."""
    last = {}

    def at(point: np.ndarray) -> tuple[float, np.ndarray]:
        if not np.array_equal(last.get("x"), point):
            last.update(x=point, found=fn(point))
        return last["found"]

    value, grad = at(x)
    first, values, history, failed, done = value, deque([np.inf], maxlen=20), deque(maxlen=corrections), False, 0
    while done < max_iter and not (len(values) >= 2 and abs(value - max(values)) <= tol * first) \
            and np.linalg.norm(grad) > max(tol * value, 1e-8):
        try:
            with np.errstate(divide="ignore", invalid="ignore"):
                way = _direction(grad, history)

                def phi(t, x=x, way=way):
                    v, g = at(x + way * t)
                    return t, v, g @ way
                size = _step(phi, (0.0, value, grad @ way), 1.0 / np.linalg.norm(way) if not done else 1.0)
            if size * np.linalg.norm(grad) < 1e-10:
                raise _Failed
        except _Failed:
            if failed:
                break
            failed = True
            history.clear()
            continue
        new = x + way * size
        new_value, new_grad = at(new)
        history.appendleft((new - x, new_grad - grad))
        x, value, grad, failed, done = new, new_value, new_grad, False, done + 1
        values.append(value)
    return x


def fit_perceptron(estimator: MultilayerPerceptronClassifier, rows: DataFrame, counts: str = "counts") -> MultilayerPerceptronClassificationModel:
    """The estimator's model of ``rows``, one per different feature vector, with an array
    of the numbers of rows of each class (more entries than classes are left out).

    One task holds all vectors and fits them in an order of their own, so the result
    doesn't depend on how rows are dealt; fits of several models run side by side.
    """
    col, label, layers = estimator.getFeaturesCol(), estimator.getLabelCol(), estimator.getLayers()
    max_iter, tol = estimator.getMaxIter(), estimator.getTol()

    def as_is(**params) -> MultilayerPerceptronClassificationModel:
        one = rows.select(col, F.lit(0.0).alias(label)).limit(1)
        return estimator.copy({getattr(estimator, k): v for k, v in {"maxIter": 0, **params}.items()}).fit(one)
    start = as_is().weights.toArray()

    def train(batches):
        table = np.concatenate([np.hstack([np.asarray(c.flatten(), dtype=float).reshape(len(c), -1) for c in b.columns])
                                for b in batches if b.num_rows])
        table = table[np.lexsort(table.T)]
        x, n = (np.ascontiguousarray(t) for t in (table[:, :layers[0]], table[:, layers[0]:layers[0] + layers[-1]]))
        del table
        weights = minimize(objective(x, n, layers), start, max_iter, tol)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()], pa.list_(pa.float64()))], ["weights"])

    found = rows.select(vector_to_array(F.col(col)), F.col(counts).cast("array<double>")).coalesce(1).mapInArrow(train, "weights array<double>").first()
    model = as_is(initialWeights=Vectors.dense(found["weights"]))
    return model.copy({model.maxIter: max_iter})
