"""Exact stratified splits, folds and samples.

Rows are ordered inside their class by a seeded hash of the row id. A split takes
exact ranks of that order without ranking the table: one aggregate counts hash
cells per class, only the cells that a cut falls into are ordered, and what comes
back is one (hash, row id) boundary per class and cut. Assignment then is a
comparison with literals: no shuffle of the wide table, no matter how skewed the
classes are, and the same membership under any partitioning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from ..schema import LABEL, ROW_ID

CELL_BITS = 16

Boundary = tuple[int, int]


def class_quotas(counts: dict[int, int], total: int) -> dict[int, int]:
    """Share ``total`` among classes in proportion; leftovers go to the largest remainders."""
    n = sum(counts.values())
    exact = {k: c * total / n for k, c in counts.items()}
    quotas = {k: math.floor(e) for k, e in exact.items()}
    left = total - sum(quotas.values())
    by_remainder = sorted(counts, key=lambda k: (-(exact[k] - quotas[k]), k))
    for k in by_remainder[:left]:
        quotas[k] += 1
    return quotas


@dataclass
class HashOrder:
    """Rows of every class in seeded hash order, known by a histogram of hash cells.

    The histogram is one aggregate over (label, row id). It has at most 2^16 rows
    per class, whatever the size of the table.
    """

    rows: DataFrame
    cells: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, df: DataFrame, label: str, row_id: str, seed: int | str) -> "HashOrder":
        rows = df.select(
            F.col(label).cast("int").alias("k"),
            F.col(row_id).alias("id"),
            hash32(F.col(row_id), seed).alias("h"),
        ).withColumn("cell", F.shiftright("h", 32 - CELL_BITS).cast("int"))
        counts = rows.groupBy("k", "cell").agg(F.count(F.lit(1)).alias("n")).toPandas()
        counts = counts.sort_values(["k", "cell"])
        cells = {
            int(k): (g["cell"].to_numpy(), g["n"].to_numpy().cumsum())
            for k, g in counts.groupby("k")
        }
        return cls(rows, cells)

    def class_counts(self) -> dict[int, int]:
        return {k: int(ends[-1]) for k, (_, ends) in self.cells.items()}

    def boundaries(self, ranks: dict[int, list[int]]) -> dict[tuple[int, int], Boundary]:
        """(hash, row id) of the r-th row per class, for every requested 1-based rank.

        Only rows of the cells that a rank falls into are read back and ordered:
        about one row in 65,536 per rank.
        """
        # (class, cell) -> [(rank, rank inside the cell)]
        wanted: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k, rs in ranks.items():
            names, ends = self.cells[k]
            for r in {r for r in rs if r > 0}:
                i = int(np.searchsorted(ends, r))
                before = int(ends[i - 1]) if i else 0
                wanted.setdefault((k, int(names[i])), []).append((r, r - before))
        if not wanted:
            return {}
        in_cells = F.expr(
            " OR ".join(f"(k = {k} AND cell = {cell})" for k, cell in wanted)
        )
        hits = F.expr(
            " OR ".join(
                f"(k = {k} AND cell = {cell} AND r IN ({', '.join(str(i) for _, i in rs)}))"
                for (k, cell), rs in wanted.items()
            )
        )
        order = Window.partitionBy("k", "cell").orderBy("h", "id")
        ranked = self.rows.filter(in_cells).withColumn("r", F.row_number().over(order))
        rows = ranked.filter(hits).collect()
        found = {(x["k"], x["cell"], x["r"]): (x["h"], x["id"]) for x in rows}
        return {
            (k, r): found[(k, cell, inside)]
            for (k, cell), rs in wanted.items()
            for r, inside in rs
        }


def _not_after(h: Column, row_id: str, bound: Boundary) -> Column:
    return (h < bound[0]) | ((h == bound[0]) & (F.col(row_id) <= bound[1]))


def assign_by_rank(
    df: DataFrame,
    hash_order: HashOrder,
    cuts: dict[int, list[tuple[int, object]]],
    rest: object,
    out: str,
    label: str = LABEL,
    row_id: str = ROW_ID,
    seed: int | str = 42,
) -> DataFrame:
    """Add ``out``: per class, ranks up to each cut take that cut's value, the others ``rest``.

    ``cuts`` maps a class to ascending (last rank, value) pairs.
    """
    bounds = hash_order.boundaries({k: [r for r, _ in cs] for k, cs in cuts.items()})
    # The hash is a column of its own, so the comparisons do not each compute md5.
    h = F.col("_h")
    value = None
    for k, pairs in cuts.items():
        for rank, taken in pairs:
            if rank <= 0:
                continue
            test = (F.col(label) == k) & _not_after(h, row_id, bounds[(k, rank)])
            branch = F.lit(taken)
            value = F.when(test, branch) if value is None else value.when(test, branch)
    value = F.lit(rest) if value is None else value.otherwise(F.lit(rest))
    return df.withColumn("_h", hash32(F.col(row_id), seed)).withColumn(out, value).drop("_h")


def _two_cut_split(df, first, second, totals, label, row_id, seed):
    """``totals`` maps the number of rows to the sizes of the two parts cut off."""
    hash_order = HashOrder.of(df, label, row_id, seed)
    counts = hash_order.class_counts()
    n_first, n_second = totals(sum(counts.values()))
    q1 = class_quotas(counts, n_first)
    q2 = class_quotas({k: counts[k] - q1[k] for k in counts}, n_second)
    cuts = {k: [(q1[k], first), (q1[k] + q2[k], second)] for k in counts}
    return assign_by_rank(df, hash_order, cuts, "train", "split", label, row_id, seed)


def stratified_split(
    df: DataFrame,
    val_size: float = 0.2,
    test_size: float = 0.2,
    label: str = LABEL,
    row_id: str = ROW_ID,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: test first, then val as a share of the whole taken from the rest."""

    def totals(n: int) -> tuple[int, int]:
        n_test = math.ceil(test_size * n)
        return n_test, math.ceil(val_size / (1.0 - test_size) * (n - n_test))

    return _two_cut_split(df, "test", "val", totals, label, row_id, seed)


def holdout_split(
    df: DataFrame,
    val_fraction: float = 0.05,
    test_fraction_of_rest: float = 0.20,
    label: str = LABEL,
    row_id: str = ROW_ID,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: val first, then test from the remaining rows (about 76/19/5)."""
    if label not in df.columns:
        raise ValueError("a labelled table is required")

    def totals(n: int) -> tuple[int, int]:
        n_val = math.ceil(val_fraction * n)
        return n_val, math.ceil(test_fraction_of_rest * (n - n_val))

    return _two_cut_split(df, "val", "test", totals, label, row_id, seed)


def assign_folds(
    df: DataFrame,
    n_folds: int = 5,
    label: str = LABEL,
    row_id: str = ROW_ID,
    seed: int = 42,
    out: str = "fold",
) -> DataFrame:
    """Add ``fold``: shuffled stratified folds whose class sizes differ by at most one."""
    hash_order = HashOrder.of(df, label, row_id, seed)
    cuts = {}
    for k, n in hash_order.class_counts().items():
        small, extra = divmod(n, n_folds)
        ends = [small * (i + 1) + min(extra, i + 1) for i in range(n_folds - 1)]
        cuts[k] = [(end, i) for i, end in enumerate(ends)]
    return assign_by_rank(df, hash_order, cuts, n_folds - 1, out, label, row_id, seed)


def stratified_sample(
    df: DataFrame, n: int, label: str = LABEL, row_id: str = ROW_ID, seed: int = 42
) -> DataFrame:
    """About ``n`` rows with the same fraction of every class, exact per-class rounding."""
    if label not in df.columns:
        return df
    hash_order = HashOrder.of(df, label, row_id, seed)
    counts = hash_order.class_counts()
    total = sum(counts.values())
    if n >= total:
        return df
    cuts = {k: [(round(n / total * c), 1)] for k, c in counts.items()}
    marked = assign_by_rank(df, hash_order, cuts, 0, "_taken", label, row_id, seed)
    return marked.filter(F.col("_taken") == 1).drop("_taken")


def positive_rates(df: DataFrame, by: str = "split", label: str = LABEL) -> DataFrame:
    return df.groupBy(by).agg(
        F.avg(label).alias("positive_rate"), F.count(F.lit(1)).alias("n_rows")
    )


def part(df: DataFrame, name: str) -> DataFrame:
    """One member of a split."""
    return df.filter(F.col("split") == name).drop("split")
