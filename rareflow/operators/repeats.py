"""Equal rows as one row with a count, for learners whose work then grows with the distinct rows.

Sums over rows become sums over distinct rows times their count. Draws of rows become draws of counts: how many of n
equal rows a sample takes is binomial, how often a bootstrap takes them is Poisson of mean n.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_stage, stage_table

# Workers get the functions of this module with the task; it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNT = "_n"
#: Rows per distinct row from which learners see distinct rows with counts.
REPEATS = 4
#: Draws of counts up to this mean or size are inverted for a whole batch at once; there is at most one larger one in so many rows.
SMALL = 64


def packed(df: DataFrame, columns: list[str] | None = None, **tests: Column) -> DataFrame:
    """Distinct rows (of ``columns``) and how many there are of each; rows that have a count already stand for so many.

    Every one of ``tests`` names a further count, of those of the equal rows that pass it.
    """
    one = F.col(COUNT) if COUNT in df.columns else F.lit(1)
    n = F.sum(COUNT) if COUNT in df.columns else F.count(F.lit(1))
    passed = [F.sum(F.when(t, one).otherwise(0)).alias(name) for name, t in tests.items()]
    keys = [c for c in (columns or df.columns) if c != COUNT]
    return df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(n.alias(COUNT), *passed)


def counted_rows(df: DataFrame, columns: list[str] | None = None, **tests: Column) -> DataFrame | None:
    """``packed`` rows, written once, or None where rows repeat less than ``REPEATS`` times on average."""
    distinct = stage_table(packed(df, columns, **tests), "packed")
    n_rows, n_distinct = distinct.agg(F.coalesce(F.sum(COUNT), F.lit(0)), F.count(F.lit(1))).first()
    if n_rows < REPEATS * n_distinct:
        drop_stage(distinct)
        return None
    return distinct


def unpacked(df: DataFrame) -> DataFrame:
    """Every row as often as its count says."""
    if COUNT not in df.columns:
        return df
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(COUNT).cast("int")))).drop("_copy", COUNT)


def merged(a: tuple, b: tuple) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, means, sums of squares or products about them) of two lots of rows together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    apart = b[1] - a[1]
    spread = np.outer(apart, apart) if a[2].ndim == 2 else apart * apart
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + spread * (a[0] * b[0] / n)


def moments(df: DataFrame, columns: list[str], products: bool = False) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows (by ``COUNT``, if there is one), means, and sums of squares about them, with ``products`` of all pairs.

    A task sends one row of sums. Null and NaN are errors, as in any model input.
    """
    k = len(columns)
    shape = (k, k) if products else (k,)
    counted = COUNT in df.columns

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = 0.0, np.zeros(k), np.zeros(shape)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float)
            if np.isnan(x).any():
                raise ValueError("the inputs of a model must not be null or NaN")
            n = batch.column(COUNT).to_numpy(zero_copy_only=False).astype(float) if counted else np.ones(len(x))
            # About the first row, so that the mean of a constant is exact.
            mean = x[0] + n @ (x - x[0]) / n.sum()
            x -= mean
            told = merged(told, (n.sum(), mean, (x * n[:, None]).T @ x if products else n @ (x * x)))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[told[0]], told[1], told[2].ravel()])])], ["told"])

    rows = df.select(*columns, *([COUNT] if counted else [])).mapInArrow(partial, "told array<double>")
    told = 0.0, np.zeros(k), np.zeros(shape)
    for r in rows.collect():
        part = np.array(r.told)
        told = merged(told, (part[0], part[1 : k + 1], part[k + 1 :].reshape(shape)))
    return told


def dealt(rows: DataFrame, count: str, weights: list[str], least: int) -> DataFrame:
    """Rows as min(count, least) copies with shares of their weights, for learners that ask for ``least`` rows a node.

    A node has ``least`` rows exactly if it has as many such copies: one row of that count is enough on its own, and
    rows of smaller counts are all there.
    """
    if least <= 1:
        return rows
    copies = F.least(F.col(count), F.lit(least)).cast("int")
    shared = rows.withColumns({w: F.col(w) / copies for w in weights})
    return shared.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def draw(n: np.ndarray, keys: np.ndarray, share: float | None) -> np.ndarray:
    """Binomial(n, share), or Poisson(n) without a share, each decided by its own key."""
    out = np.zeros(len(n), dtype=np.int64)
    small = np.flatnonzero(n <= SMALL)
    size = n[small].astype(float)
    left = (keys[small].astype(np.int64).view(np.uint64) >> np.uint64(11)).astype(float) * 2.0**-53
    p = np.exp(-size) if share is None else (1.0 - share) ** size
    k = 0
    while len(small):
        on = left >= p
        # Beyond every place of the distribution only rounding is left.
        on &= (k < size) if share is not None else (k < 16 * SMALL)
        small, size, left, p = small[on], size[on], (left - p)[on], p[on]
        k += 1
        out[small] = k
        p = p * size / k if share is None else p * (size - k + 1) / k * (share / (1.0 - share))
    for i in np.flatnonzero(n > SMALL):
        rng = np.random.default_rng(int(keys[i]) & (2**64 - 1))
        out[i] = rng.poisson(n[i]) if share is None else rng.binomial(n[i], share)
    return out


def drawn(count: Column, key: Column, share: float | None = None) -> Column:
    """Of ``count`` equal rows, how many a sample of ``share`` takes, or a bootstrap without one. The same key draws the same."""

    @F.pandas_udf("long")
    def take(n: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series(draw(n.to_numpy(), keys.to_numpy(), share))

    return take(count, key)
