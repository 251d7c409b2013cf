"""Encoders and robust transforms: fitted on training rows, applied to any rows.

``fit`` returns a fitted object whose state is a few numbers (or, for target
encoding, a map table); ``transform`` keeps every other column. Quantile-based
fits use exact distributed quantiles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LABEL
from ..session import stage_table
from .lookup import BROADCAST_ROWS, attach, attach_long
from .ordered import cut_index, exact_quantiles, keyed_form
from .repeats import COUNT, moments

NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


# ---------------------------------------------------------------- quantile bins


@dataclass
class QuantileBinner:
    """Ordinal bins between quantiles; edges that collapse are dropped."""

    n_bins: int = 8
    min_gap: float = 1e-8

    def fit(self, train: DataFrame, columns: list[str]) -> "FittedBinner":
        steps = [i / self.n_bins for i in range(self.n_bins + 1)]
        edges = {}
        for c, points in exact_quantiles(train, columns, steps).items():
            kept: list[float] = []
            for p in points:
                if not kept or p - kept[-1] > self.min_gap:
                    kept.append(p)
            edges[c] = kept
        return FittedBinner(edges)


@dataclass
class FittedBinner:
    edges: dict[str, list[float]]

    def bin_of(self, column: str) -> Column:
        """Number of inner edges at or below the value, so outer values take the end bins."""
        return cut_index(column, self.edges[column][1:-1])

    def transform(self, df: DataFrame) -> DataFrame:
        bins = [self.bin_of(c).cast("int").alias(f"{c}_bin") for c in self.edges]
        return df.select(*[c for c in df.columns if c not in self.edges], *bins)

    def output_columns(self) -> list[str]:
        return [f"{c}_bin" for c in self.edges]


# ---------------------------------------------------------------- target means


def target_map(
    train: DataFrame, column: str, label: str = LABEL, smoothing: float = 20.0
) -> tuple[DataFrame, float]:
    """(value, n, te) per distinct value, and the prior: the mean label of the fit rows."""
    prior = train.agg(F.avg(label)).first()[0]
    smoothed = (F.sum(F.col(label)).cast("double") + F.lit(prior * smoothing)) / (
        F.count(F.lit(1)).cast("double") + F.lit(float(smoothing))
    )
    table = (
        train.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), smoothed.alias("te"))
    )
    return table, prior


@dataclass
class CrossFitTargetEncoder:
    """Smoothed target means; training rows see only the statistics of other folds."""

    smoothing: float = 20.0
    label: str = LABEL
    fold: str = "fold"

    def fit(self, train: DataFrame, columns: list[str]) -> "FittedTargetEncoder":
        """One aggregate by (feature, value, fold) serves every column and both encodings."""
        prior = train.agg(F.avg(self.label)).first()[0]
        folds = F.col(self.fold) if self.fold in train.columns else F.lit(0)
        cells = train.select(F.col(self.label).alias("_y"), folds.alias("_f"), *columns)
        stats = (
            keyed_form(cells, columns, carry=["_y", "_f"])
            .filter(F.col("value").isNotNull())
            .groupBy("feature", "value", "_f")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.sum(F.col("_y").cast("bigint")).alias("pos"),
            )
        )
        # The statistics are the model: a small table, written once and read by every use.
        stats = stage_table(stats, "target-stats")
        return FittedTargetEncoder(list(columns), stats, float(prior), self.smoothing, self.fold)


@dataclass
class FittedTargetEncoder:
    columns: list[str]
    stats: DataFrame
    prior: float
    smoothing: float
    fold: str
    maps: dict[str, tuple[DataFrame, dict[str, int]]] = field(default_factory=dict, repr=False)

    def _smooth(self, pos: Column, n: Column) -> Column:
        return (pos.cast("double") + F.lit(self.prior * self.smoothing)) / (
            n.cast("double") + F.lit(self.smoothing)
        )

    def full_map(self) -> DataFrame:
        """(feature, value, n, te) over all training rows."""
        totals = self.stats.groupBy("feature", "value").agg(
            F.sum("n").alias("n"), F.sum("pos").alias("pos")
        )
        return totals.select("feature", "value", "n", self._smooth(F.col("pos"), F.col("n")).alias("te"))

    def out_of_fold_map(self) -> DataFrame:
        """(feature, value, fold, n, te) where te leaves the row's own fold out.

        A value seen in no other fold is absent, so it falls to the global prior.
        """
        totals = self.stats.groupBy("feature", "value").agg(
            F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos")
        )
        others = self.stats.join(totals, ["feature", "value"]).filter(F.col("all_n") > F.col("n"))
        te = self._smooth(F.col("all_pos") - F.col("pos"), F.col("all_n") - F.col("n"))
        return others.select("feature", "value", F.col("_f").alias(self.fold), "n", te.alias("te"))

    def transform(self, df: DataFrame) -> DataFrame:
        """Encode rows that were not in the fit (validation, test, scoring)."""
        return self._encode(df, "full", self.full_map, [])

    def transform_train(self, train: DataFrame) -> DataFrame:
        """Encode the fit rows, each from the other folds."""
        return self._encode(train, "out_of_fold", self.out_of_fold_map, [self.fold])

    def applied(self, kind: str, build) -> tuple[DataFrame, dict[str, int]]:
        """A map and its rows per feature; written once for the model, however many batches it encodes."""
        if kind not in self.maps:
            # One folder per feature: every column then reads only its own part.
            table = stage_table(build(), "target-map", partition_by="feature")
            rows = table.groupBy("feature").agg(F.count(F.lit(1)).alias("size")).collect()
            self.maps[kind] = table, {r["feature"]: r["size"] for r in rows}
        return self.maps[kind]

    def _encode(self, df: DataFrame, kind: str, build, extra: list[str]) -> DataFrame:
        out = df
        table, sizes = self.applied(kind, build)
        # What all columns together may broadcast.
        room = BROADCAST_ROWS // max(1, len(self.columns))
        large = [c for c in self.columns if sizes.get(c, 0) > room]
        if len(large) > 1 and not df.isStreaming:
            # One numbering, one join and one wide shuffle serve all large maps.
            out = attach_long(out, table, {c: f"{c}_te" for c in large}, extra)
        else:
            large = []
        for c in self.columns:
            if c in large:
                continue
            mine = table.filter(F.col("feature") == c).select(
                F.col("value").cast(df.schema[c].dataType).alias(c),
                *extra,
                "n",
                F.col("te").alias(f"{c}_te"),
            )
            keys = [c, *extra]
            out = attach(out, mine, keys, [f"{c}_te"], rows_column="n", broadcast_rows=room, size=sizes.get(c, 0))
        encoded = [F.coalesce(F.col(f"{c}_te"), F.lit(self.prior)).alias(f"{c}_te") for c in self.columns]
        return out.select(*[c for c in df.columns if c not in self.columns], *encoded)

    def output_columns(self) -> list[str]:
        return [f"{c}_te" for c in self.columns]


# ---------------------------------------------------------------- smoothing


def smoothable_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Numeric columns that are neither ``has_*`` flags nor 0/1-valued: one aggregate."""
    types = dict(df.dtypes)
    candidates = [
        c
        for c in (columns or df.columns)
        if c != COUNT and types[c] in NUMERIC and not c.startswith("has_")
    ]
    if not candidates:
        return []
    other = df.agg(
        *[F.max((~F.col(c).isin(0, 1)).cast("int")).alias(c) for c in candidates]
    ).first()
    return [c for c in candidates if other[c] == 1]


@dataclass
class FeatureSmoothing:
    """Clip to training quantiles, then (optionally) map to the uniform distribution."""

    method: str = "winsor_quantile"
    lower: float = 0.01
    upper: float = 0.99
    n_quantiles: int | None = None

    def fit(self, train: DataFrame, columns: list[str] | None = None) -> "FittedSmoothing":
        counted = [COUNT] if COUNT in train.columns else []
        chosen = smoothable_columns(train, columns)
        limits = exact_quantiles(train, chosen, [self.lower, self.upper])
        bounds = {c: (q[0], q[1]) for c, q in limits.items()}
        fitted = FittedSmoothing(bounds)
        if self.method == "winsor_quantile" and chosen:
            n_rows = train.agg(F.coalesce(F.sum(COUNT), F.lit(0))).first()[0] if counted else train.count()
            n_q = self.n_quantiles or min(1000, max(10, n_rows))
            # More reference points than rows add nothing.
            n_q = max(2, min(n_q, n_rows))
            clipped = train.select(*[fitted.clipped(c).alias(c) for c in chosen], *counted)
            grid = [i / (n_q - 1) for i in range(n_q)]
            fitted.references = exact_quantiles(clipped, chosen, grid)
        return fitted


@dataclass
class FittedSmoothing:
    bounds: dict[str, tuple[float, float]]
    references: dict[str, list[float]] = field(default_factory=dict)

    def clipped(self, column: str) -> Column:
        low, high = self.bounds[column]
        value = F.col(column).cast("double")
        # Comparisons keep nulls null, unlike least/greatest.
        return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.bounds:
            return df
        clipped = df.select(
            *[self.clipped(c).alias(c) if c in self.bounds else F.col(c) for c in df.columns]
        )
        if not self.references:
            return clipped
        names = list(self.references)
        ranks = uniform_ranks([self.references[c] for c in names])
        ranked = clipped.withColumn("_u", ranks(*[F.col(c) for c in names]))
        return ranked.select(
            *[F.col("_u")[names.index(c)].alias(c) if c in names else F.col(c) for c in df.columns]
        )


def uniform_ranks(references: list[list[float]]):
    """Vectorised map of double columns through their reference quantiles, one array out.

    Interpolation from the left and from the right agree except on plateaus,
    where their mean is used; the ends map to exactly 0 and 1.
    """
    tables = [np.maximum.accumulate(np.asarray(r, dtype=float)) for r in references]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def ranks(*values: pd.Series) -> pd.Series:
        block = np.column_stack([v.to_numpy(dtype=float) for v in values])
        for j, q in enumerate(tables):
            level = np.linspace(0.0, 1.0, len(q))
            x = block[:, j].copy()
            forward = np.interp(x, q, level)
            backward = -np.interp(-x, -q[::-1], -level[::-1])
            u = 0.5 * (forward + backward)
            u[x >= q[-1]] = 1.0
            u[x <= q[0]] = 0.0
            block[:, j] = u
        return pd.Series(list(block), dtype=object)

    return ranks


# ---------------------------------------------------------------- standardising


@dataclass
class Standardizer:
    """(x - mean) / population deviation; a constant column is only centred."""

    def fit(self, train: DataFrame, columns: list[str]) -> "FittedStandardizer":
        if COUNT in train.columns:
            n, means, squares = moments(train, columns)
            stds = np.sqrt(squares / max(n, 1.0)).tolist()
            return FittedStandardizer({c: (m, s or 1.0) for c, m, s in zip(columns, means.tolist(), stds)})
        aggs = []
        for c in columns:
            aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
        row = train.agg(*aggs).first()
        return FittedStandardizer(
            {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}
        )


@dataclass
class FittedStandardizer:
    moments: dict[str, tuple[float, float]]

    def value(self, column: str) -> Column:
        mean, std = self.moments[column]
        return (F.col(column).cast("double") - F.lit(mean)) / F.lit(std)

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        scaled = {c: self.value(c).alias(f"{c}{suffix}") for c in self.moments}
        if suffix:
            return df.select("*", *scaled.values())
        return df.select(*[scaled.get(c, F.col(c)) for c in df.columns])


# ---------------------------------------------------------------- periodic features


def periodic_frequencies(n_features: int, n_frequencies: int = 8, sigma: float = 1.0, seed: int = 42):
    """Seeded N(0, sigma) frequencies per feature."""
    return np.random.default_rng(seed).normal(0.0, sigma, (n_features, n_frequencies)).tolist()


def periodic_features(columns: list[str], frequencies: list[list[float]]) -> list[Column]:
    """sin and cos of 2 pi c x for every column and its frequencies."""
    out = []
    for column, row in zip(columns, frequencies):
        for i, c in enumerate(row):
            angle = F.lit(2.0 * math.pi * c) * F.col(column)
            out.append(F.sin(angle).alias(f"{column}_sin_{i}"))
            out.append(F.cos(angle).alias(f"{column}_cos_{i}"))
    return out


__all__ = [
    "CrossFitTargetEncoder",
    "FeatureSmoothing",
    "QuantileBinner",
    "Standardizer",
    "periodic_features",
    "periodic_frequencies",
    "smoothable_columns",
    "target_map",
]
