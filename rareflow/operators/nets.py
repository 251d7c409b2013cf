"""A perceptron on distinct rows with counts: tasks sum loss and gradient, the driver takes the optimiser's steps.

Spark's perceptron takes no row weights, so equal rows and repeated positives are there rows of their own in every
pass. Here a row's loss counts as often as it is there. Layers, starting weights and the rules of the optimiser
(L-BFGS, ten corrections, strong Wolfe steps) are those of Spark's, and so is the fitted model.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession

# Workers get the functions of this module with the task; it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Point = tuple[float, np.ndarray]


def perceptron(
    spark: SparkSession, layers: list[int], seed: int, weights: list[float] | None = None, **columns: str
) -> MultilayerPerceptronClassificationModel:
    """Spark's model of these weights, or of its own starting weights: a fit of no steps on two empty rows."""
    net = MultilayerPerceptronClassifier(layers=layers, maxIter=0, seed=seed, **columns)
    if weights is not None:
        net = net.setInitialWeights(Vectors.dense(weights))
    blank = Vectors.sparse(layers[0], {})
    return net.fit(spark.createDataFrame([(blank, 0.0), (blank, 1.0)], [net.getFeaturesCol(), net.getLabelCol()]))


def shaped(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, bias) per layer; the flat vector holds them column by column."""
    flat, out, at = np.asarray(weights), [], 0
    for n_in, n_out in zip(layers, layers[1:]):
        w = flat[at : at + n_in * n_out].reshape((n_out, n_in), order="F")
        at += n_in * n_out
        out.append((w, flat[at : at + n_out]))
        at += n_out
    return out


def forward(x: np.ndarray, matrices: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Outputs of the input and hidden layers; logarithms of the class probabilities, and these."""
    held = [x]
    with np.errstate(over="ignore"):
        for w, b in matrices[:-1]:
            held.append(1.0 / (1.0 + np.exp(-(held[-1] @ w.T + b))))
    w, b = matrices[-1]
    raw = held[-1] @ w.T + b
    raw = raw - raw.max(axis=1, keepdims=True)
    logs = raw - np.log(np.exp(raw).sum(axis=1, keepdims=True))
    return held, logs, np.exp(logs)


def inputs_of(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]).astype(float, copy=False)
    if np.isnan(x).any():
        raise ValueError("the inputs of a net must not be null or NaN")
    return x


def gradient(
    table: DataFrame, names: list[str], layers: list[int], times: str, label: str = "y"
) -> Callable[[np.ndarray], Point]:
    """Mean cross entropy of the rows of ``table``, each there ``times`` times, and its gradient as a function of the weights.

    A task sends one row of sums, whatever the number of its rows.
    """
    n_weights = sum((a + 1) * b for a, b in zip(layers, layers[1:]))

    def at(weights: np.ndarray) -> Point:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            told, matrices = np.zeros(2 + n_weights), shaped(weights, layers)
            for batch in batches:
                if not batch.num_rows:
                    continue
                held, logs, p = forward(inputs_of(batch, names), matrices)
                if batch.column(label).null_count:
                    raise ValueError("the label of a net must not be null")
                y = batch.column(label).to_numpy(zero_copy_only=False).astype(int)
                n = batch.column(times).to_numpy(zero_copy_only=False).astype(float)
                told[0] += n.sum()
                told[1] -= n @ logs[np.arange(len(y)), y]
                delta = p
                delta[np.arange(len(y)), y] -= 1.0
                delta *= n[:, None]
                parts: list[np.ndarray] = []
                for i in range(len(matrices) - 1, -1, -1):
                    parts[:0] = [(delta.T @ held[i]).ravel(order="F"), delta.sum(axis=0)]
                    if i:
                        delta = (delta @ matrices[i][0]) * held[i] * (1.0 - held[i])
                told[2:] += np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([pa.array([told])], ["told"])

        sums = np.sum([r.told for r in table.mapInArrow(partial, "told array<double>").collect()], axis=0)
        return float(sums[1] / sums[0]), sums[2:] / sums[0]

    return at


def _line(evaluate, x: np.ndarray, f: float, g: np.ndarray, way: np.ndarray, first: float, tries: int = 10):
    """(step, value, gradient) along ``way`` under the strong Wolfe rules; None if none is found."""
    slope0 = float(g @ way)
    if slope0 > 0:
        return None

    def look(t: float):
        value, grad = evaluate(x + t * way)
        return t, value, float(grad @ way), grad

    def between(a, b) -> float:
        """Least point of the cubic through two points, kept off their ends."""
        (l, r) = (a, b) if a[0] <= b[0] else (b, a)
        d1 = l[2] + r[2] - 3.0 * (l[1] - r[1]) / (l[0] - r[0])
        d2 = np.sqrt(d1 * d1 - l[2] * r[2])
        width = r[0] - l[0]
        t = r[0] - width * (r[2] + d2 - d1) / (r[2] - l[2] + 2.0 * d2)
        return l[0] + 0.1 * width if t < l[0] + 0.1 * width else l[0] + 0.9 * width if t > l[0] + 0.9 * width else t

    def zoom(low, high):
        for _ in range(tries):
            c = look(between(low, high))
            if c[1] > f + 1e-4 * c[0] * slope0 or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(slope0):
                return c
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        return None

    found, t, low = None, first, (0.0, f, slope0, g)
    for i in range(tries):
        c = look(t)
        if not np.isfinite(c[1]):
            t /= 2.0
            continue
        if c[1] > f + 1e-4 * t * slope0 or (c[1] >= low[1] and i > 0):
            found = zoom(low, c)
            break
        if abs(c[2]) <= 0.9 * abs(slope0):
            found = c
            break
        if c[2] >= 0:
            found = zoom(c, low)
            break
        low, t = c, 1.5 * t
    if found is None or found[0] * np.linalg.norm(g) < 1e-10:
        return None
    return found[0], found[1], found[3]


def minimise(
    evaluate: Callable[[np.ndarray], Point], start: np.ndarray, steps: int, memory: int = 10, tolerance: float = 1e-6
) -> np.ndarray:
    """The weights after at most ``steps`` steps of L-BFGS from ``start``."""
    x = np.asarray(start, dtype=float)
    if not steps:
        return x
    f, g = evaluate(x)
    first, past = abs(f), deque(maxlen=20)
    pairs: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=memory)
    done = 0
    while done < steps:
        settled = len(past) == past.maxlen and abs(f - max(past)) <= tolerance * first
        if settled or np.linalg.norm(g) <= max(tolerance * abs(f), 1e-8):
            break
        way, shares = g.copy(), []
        for s, y in reversed(pairs):
            shares.append((s @ way) / (s @ y))
            way -= shares[-1] * y
        if pairs:
            s, y = pairs[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), share in zip(pairs, reversed(shares)):
            way += (share - (y @ way) / (s @ y)) * s
        found = _line(evaluate, x, f, g, -way, 1.0 if done else 1.0 / np.linalg.norm(way))
        if found is None:
            if not pairs:
                break
            pairs.clear()
            continue
        t, f, new = found
        pairs.append((-t * way, new - g))
        x, g = x - t * way, new
        past.append(f)
        done += 1
    return x
