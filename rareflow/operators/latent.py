"""Latent features: linear bottleneck, linear denoiser, supervised hidden-layer embedding.

All three learn from aggregates or distributed optimisers over the training rows
and are applied row by row: the linear ones as native expressions, the embedding
as one matrix product per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LABEL
from ..session import drop_stage, spread, stage_table
from . import nets
from .encoders import FittedStandardizer, Standardizer, periodic_features, periodic_frequencies
from .metrics import average_precision, class_balance, curve_of_counts
from .ordered import range_cuts
from .repeats import COUNT, moments, packed


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Vector column for the learners; nulls are an error, as for any model input."""
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error").transform(df)


def _dot(values: list[Column], weights: list[float]) -> Column:
    return reduce(add, [v * F.lit(float(w)) for v, w in zip(values, weights)])


@dataclass
class LinearBottleneck:
    """Best linear auto-encoder: leading principal components of the scaled inputs."""

    latent_dim: int = 4

    def fit(self, train: DataFrame, columns: list[str]) -> "FittedBottleneck":
        scaler = Standardizer().fit(train, columns)
        k = min(self.latent_dim, len(columns))
        scaled = assemble(train.select(*[scaler.value(c).alias(c) for c in columns]), columns)
        model = PCA(k=k, inputCol="features", outputCol="latent").fit(scaled)
        return FittedBottleneck(columns, scaler, model.pc.toArray().T.tolist())


@dataclass
class FittedBottleneck:
    columns: list[str]
    scaler: FittedStandardizer
    components: list[list[float]]

    def transform(self, df: DataFrame) -> DataFrame:
        values = [self.scaler.value(c) for c in self.columns]
        latent = [_dot(values, w).alias(f"ae_{i}") for i, w in enumerate(self.components)]
        return df.select(*[c for c in df.columns if c not in self.columns], *latent)

    def output_columns(self) -> list[str]:
        return [f"ae_{i}" for i in range(len(self.components))]


@dataclass
class LinearDenoiser:
    """Closed-form denoiser of Gaussian corruption (marginalised auto-encoder, rank-limited).

    With covariance C of the scaled inputs and noise variance s^2 the best linear
    reconstruction is C (C + s^2 I)^-1; it shares C's eigenvectors, so keeping the
    leading ones needs one covariance aggregate and a small decomposition.
    """

    noise: float = 0.3
    rank: int = 4

    def fit(self, train: DataFrame, columns: list[str]) -> "FittedDenoiser":
        n, means, products = moments(train, columns, products=True)
        deviations = np.sqrt(products.diagonal() / max(n, 1.0))
        scaler = FittedStandardizer({c: (m, s or 1.0) for c, m, s in zip(columns, means.tolist(), deviations.tolist())})
        # A constant column goes with no other.
        known = np.where(products.diagonal() / max(n - 1.0, 1.0) > 1e-12, deviations, np.inf)
        corr = products / max(n, 1.0) / np.outer(known, known)
        np.fill_diagonal(corr, 1.0)
        values, axes = np.linalg.eigh(corr)
        top = np.argsort(values)[::-1][: self.rank]
        gains = np.maximum(values[top], 0.0)
        gains = gains / (gains + self.noise**2)
        return FittedDenoiser(columns, scaler, axes[:, top].T.tolist(), gains.tolist())


@dataclass
class FittedDenoiser:
    columns: list[str]
    scaler: FittedStandardizer
    axes: list[list[float]]
    gains: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        values = [self.scaler.value(c) for c in self.columns]
        codes = [(_dot(values, a) * F.lit(g)).alias(f"_code_{i}") for i, (a, g) in enumerate(zip(self.axes, self.gains))]
        coded = df.select("*", *codes)
        code_columns = [F.col(f"_code_{i}") for i in range(len(self.axes))]
        out = []
        for j, c in enumerate(self.columns):
            mean, std = self.scaler.moments[c]
            clean = _dot(code_columns, [a[j] for a in self.axes])
            out.append((clean * F.lit(std) + F.lit(mean)).alias(f"{c}_dn"))
        return coded.select(*[c for c in df.columns if c not in self.columns], *out)

    def output_columns(self) -> list[str]:
        return [f"{c}_dn" for c in self.columns]


def held_out(columns: list[str], share: float, seed: int) -> Column:
    """Whether a row belongs to the held-out share; rows with equal columns do together."""
    place = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]), F.lit(1 << 20))
    return place < F.lit(int(share * (1 << 20)))


def net_table(
    train: DataFrame, columns: list[str], label: str, seed: int, periodic: int = 0, holdout: float = 0.0
) -> tuple[FittedStandardizer, list[list[float]], DataFrame]:
    """Scaler, frequencies, and the staged table of a net: y, held, how many equal rows a row stands for, and the inputs."""
    count = [COUNT] if COUNT in train.columns else []
    distinct = stage_table(packed(train.select(F.col(label).cast("double").alias("_y"), *columns, *count)), "net-rows")
    scaler = Standardizer().fit(distinct, columns)
    frequencies = periodic_frequencies(len(columns), periodic, seed=seed) if periodic else []
    names = [f"z{i}" for i in range(len(columns))]
    scaled = spread(distinct).select(
        F.col("_y").alias("y"),
        held_out(columns, holdout, seed).alias("held"),
        COUNT,
        *[scaler.value(c).alias(n) for c, n in zip(columns, names)],
    )
    table = stage_table(scaled.select("*", *periodic_features(names, frequencies)), "net")
    drop_stage(distinct)
    return scaler, frequencies, table


class SlicedNet:
    """A perceptron trained in slices, each from the weights of the one before, and judged after each.

    ``table`` has y, held, a count of equal rows and the inputs. A slice takes ``steps`` optimiser steps on the rows
    that are not held out, positives repeated to the size of the negatives; average precision on both parts is kept,
    and the weights of the best slice.
    """

    def __init__(self, table: DataFrame, layers: list[int], steps: int, seed: int):
        self.table, self.layers, self.steps, self.seed = table, layers, steps, seed
        self.names = [c for c in table.columns if c not in ("y", "held", COUNT)]
        own = table.filter("not held")
        copies = max(1, round(class_balance(own, "y", COUNT)["imbalance_ratio"]))
        times = F.when(F.col("y") == 1, F.col(COUNT) * copies).otherwise(F.col(COUNT))
        self.rows = own.select("y", times.alias("times"), *self.names)
        self.last = self.best = None
        #: Per slice: held-out and training average precision; NaN where a part has one class.
        self.history: list[tuple[float, float]] = []

    def train(self) -> None:
        if self.last is None:
            self.last = nets.perceptron(self.table.sparkSession, self.layers, self.seed).weights.toArray()
        self.last = nets.minimise(nets.gradient(self.rows, self.names, self.layers, "times"), self.last, self.steps)

    def scored(self) -> DataFrame:
        """(held, score, pos, n): ``score_counts`` of both parts."""
        names, matrices = self.names, nets.shaped(self.last, self.layers)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    p = nets.forward(nets.inputs_of(batch, names), matrices)[2][:, 1]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("held", "y", COUNT)), pa.array(p)], ["held", "y", "n", "score"])

        rows = self.table.mapInArrow(score, "held boolean, y double, n long, score double")
        return rows.groupBy("held", "score").agg(F.sum(F.col("y").cast("bigint") * F.col("n")).alias("pos"), F.sum("n").alias("n"))

    def advance(self) -> None:
        self.train()
        counts = stage_table(self.scored(), "net-scores")
        curve = curve_of_counts(counts, ["held"], range_cuts(counts, "score"))
        told = {r.held: r.ap for r in curve.groupBy("held").agg(average_precision().alias("ap")).collect()}
        drop_stage(counts)
        self.history.append((told.get(True, float("nan")), told.get(False, float("nan"))))
        if self.best_slice() == len(self.history) - 1:
            self.best = self.last

    def best_slice(self) -> int:
        """The slice of the highest held-out average precision, the first of equals; the last if none has one."""
        known = [i for i, (ap, _) in enumerate(self.history) if ap == ap]
        return max(known, key=lambda i: (self.history[i][0], -i)) if known else len(self.history) - 1

    def gap(self) -> float:
        """How much better the best slice does on the rows it was trained on."""
        held, own = self.history[self.best_slice()]
        return own - held


@dataclass
class HiddenLayerEmbedding:
    """Supervised net trained on the training rows; emits its last hidden layer.

    The optimiser runs in ``slices`` of its ``max_iter`` steps. After each, average precision is taken on the
    ``holdout`` share of the training rows; the weights of the best slice are kept, and training ends when
    ``patience`` slices in a row were no better. Without a holdout all steps are one slice on all rows.
    ``periodic`` adds sines and cosines of each scaled input at so many seeded frequencies to the net's inputs.
    """

    embedding_dim: int = 16
    hidden1: int = 40
    hidden2: int = 20
    max_iter: int = 100
    seed: int = 42
    keep_raw: bool = True
    label: str = LABEL
    slices: int = 5
    holdout: float = 0.1
    patience: int = 2
    periodic: int = 0

    def inputs(self, train: DataFrame, columns: list[str]) -> tuple[FittedStandardizer, list[list[float]], DataFrame]:
        """Scaler, frequencies, and the staged table of y, held, counts and inputs."""
        return net_table(train, columns, self.label, self.seed, self.periodic, self.holdout)

    def layers(self, n_inputs: int) -> list[int]:
        return [n_inputs * (1 + 2 * self.periodic), self.hidden1, self.hidden2, self.embedding_dim, 2]

    def fit(self, train: DataFrame, columns: list[str]) -> "FittedEmbedding":
        scaler, frequencies, table = self.inputs(train, columns)
        slices = self.slices if self.holdout > 0 else 1
        net = SlicedNet(table, self.layers(len(columns)), -(-self.max_iter // slices), self.seed)
        while len(net.history) < slices and len(net.history) - net.best_slice() <= self.patience:
            net.advance()
        drop_stage(table)
        return FittedEmbedding(
            columns, scaler, net.layers, net.best.tolist(), self.keep_raw, frequencies, [list(h) for h in net.history], net.best_slice()
        )


@dataclass
class FittedEmbedding:
    columns: list[str]
    scaler: FittedStandardizer
    layers: list[int]
    weights: list[float] = field(repr=False, default_factory=list)
    keep_raw: bool = True
    frequencies: list[list[float]] = field(repr=False, default_factory=list)
    #: Held-out and training average precision after each slice, and the slice whose weights these are.
    history: list[list[float]] = field(default_factory=list)
    best: int = 0

    def overfit_gap(self) -> float:
        held, own = self.history[self.best]
        return own - held

    def matrices(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(weights, bias) per layer."""
        return nets.shaped(self.weights, self.layers)

    def transform(self, df: DataFrame) -> DataFrame:
        hidden = self.matrices()[:-1]

        frequencies = [2.0 * np.pi * np.asarray(row) for row in self.frequencies]

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def embed(*inputs: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in inputs])
            if frequencies:
                # Each input's sine and cosine at each of its frequencies, as the fit has them.
                angles = np.stack([x[:, [i]] * row for i, row in enumerate(frequencies)], axis=1)
                waves = np.stack([np.sin(angles), np.cos(angles)], axis=3)
                x = np.hstack([x, waves.reshape(len(x), -1)])
            for w, b in hidden:
                x = 1.0 / (1.0 + np.exp(-(x @ w.T + b)))
            return pd.Series(list(x), dtype=object)

        named = df.withColumn("_nn", embed(*[self.scaler.value(c) for c in self.columns]))
        kept = [c for c in df.columns if self.keep_raw or c not in self.columns]
        nn = [F.col("_nn")[i].alias(n) for i, n in enumerate(self.new_columns())]
        return named.select(*kept, *nn)

    def new_columns(self) -> list[str]:
        return [f"nn_{i}" for i in range(self.layers[-2])]

    def output_columns(self) -> list[str]:
        return (self.columns if self.keep_raw else []) + self.new_columns()


def prefixed(df: DataFrame, prefix: str = "nn_", carry: list[str] = ()) -> DataFrame:
    """Projection on a column-name prefix."""
    return df.select(*carry, *[c for c in df.columns if c.startswith(prefix)])
