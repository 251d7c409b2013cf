"""Supervised binning with weight of evidence.

All rows are reduced to a count table of at most ``prebins`` rows per feature in
one distributed aggregate. Only that bounded table reaches the driver, where
neighbouring pre-bins are merged to the contiguous bins of highest information
value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LABEL
from .metrics import ratio
from .ordered import cut_index, exact_quantiles, long_form


def prebin_cuts(df: DataFrame, columns: list[str], prebins: int = 20) -> dict[str, list[float]]:
    """Inner cut points: distinct quantiles above the minimum."""
    steps = [i / prebins for i in range(prebins)]
    return {
        c: sorted(set(q) - {min(q)}) if q else []
        for c, q in exact_quantiles(df, columns, steps).items()
    }


def bin_counts(
    df: DataFrame, cuts: dict[str, list[float]], label: str = LABEL
) -> DataFrame:
    """(feature, bin, n, events) for all features in one scan and one shuffle of counts."""
    bins = df.select(F.col(label).alias("_y"), *[cut_index(c, k).alias(c) for c, k in cuts.items()])
    return (
        long_form(bins, list(cuts), carry=["_y"], cast="int")
        .withColumnRenamed("value", "bin")
        .groupBy("feature", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_y").cast("bigint")).alias("events"))
    )


def woe_of(n: Column, events: Column, all_n: Column, all_events: Column) -> Column:
    """ln of the share of non-events over the share of events; 0 if either is absent."""
    non = ratio(n - events, all_n - all_events)
    hit = ratio(events, all_events)
    return F.when((n > events) & (events > 0), F.log(non / F.nullif(hit, F.lit(0.0)))).otherwise(
        F.lit(0.0)
    )


def woe_table(counts: DataFrame) -> DataFrame:
    """Per feature and bin: count, share, non-events, events, rate, WOE, IV; total row has a null bin."""
    totals = counts.groupBy("feature").agg(
        F.sum("n").alias("all_n"), F.sum("events").alias("all_events")
    )
    # One row per feature.
    rows = counts.join(F.broadcast(totals), "feature").withColumn(
        "woe", woe_of(F.col("n"), F.col("events"), F.col("all_n"), F.col("all_events"))
    )
    gap = ratio(F.col("n") - F.col("events"), F.col("all_n") - F.col("all_events")) - ratio(
        F.col("events"), F.col("all_events")
    )
    rows = rows.withColumn("iv", gap * F.col("woe"))
    return (
        rows.rollup("feature", "bin")
        .agg(
            F.sum("n").alias("n"),
            ratio(F.sum("n"), F.max("all_n")).alias("share"),
            (F.sum("n") - F.sum("events")).alias("non_events"),
            F.sum("events").alias("events"),
            ratio(F.sum("events"), F.sum("n")).alias("event_rate"),
            F.when(F.grouping("bin") == 0, F.max("woe")).alias("woe"),
            F.sum("iv").alias("iv"),
            F.grouping("bin").alias("is_total"),
            F.grouping("feature").alias("_all"),
        )
        .filter(F.col("_all") == 0)
        .drop("_all")
    )


def merge_bins(
    counts: list[tuple[int, int]], max_bins: int = 8, min_share: float = 0.02
) -> list[int]:
    """Start positions of the best contiguous bins over (n, events) pre-bins.

    Maximises total information value with every bin holding ``min_share`` of the
    rows and both classes. A monotone event rate is tried first, in both
    directions; if no monotone merge exists, any order is allowed.
    """
    candidates = [_best_merge(counts, max_bins, min_share, d) for d in (1, -1)]
    found = [c for c in candidates if c is not None]
    if not found:
        free = _best_merge(counts, max_bins, min_share, 0)
        return free[1] if free else [0]
    return max(found, key=lambda c: c[0])[1]


def _best_merge(counts, max_bins, min_share, direction):
    k = len(counts)
    all_n = sum(n for n, _ in counts)
    all_e = sum(e for _, e in counts)
    all_good = all_n - all_e
    if k == 0 or all_e == 0 or all_good == 0:
        return None
    n_to, e_to = [0], [0]
    for n, e in counts:
        n_to.append(n_to[-1] + n)
        e_to.append(e_to[-1] + e)

    def segment(i, j):
        n, e = n_to[j] - n_to[i], e_to[j] - e_to[i]
        if e == 0 or n == e or n < min_share * all_n:
            return None
        good, bad = (n - e) / all_good, e / all_e
        return e / n, (good - bad) * math.log(good / bad)

    # best[(i, j, b)]: highest value of pre-bins [0, j) in b bins whose last is [i, j).
    best: dict[tuple[int, int, int], tuple[float, list[int]]] = {}
    rates = {}
    for j in range(1, k + 1):
        for i in range(j):
            seg = segment(i, j)
            if seg is None:
                continue
            rates[(i, j)] = seg[0]
            if i == 0:
                best[(0, j, 1)] = (seg[1], [0])
                continue
            for b in range(2, max_bins + 1):
                options = [
                    best[(h, i, b - 1)]
                    for h in range(i)
                    if (h, i, b - 1) in best
                    and (direction == 0 or direction * (seg[0] - rates[(h, i)]) > 0)
                ]
                if options:
                    value, starts = max(options, key=lambda o: o[0])
                    best[(i, j, b)] = (value + seg[1], starts + [i])
    final = [v for (i, j, b), v in best.items() if j == k]
    return max(final, key=lambda v: v[0]) if final else None


@dataclass
class OptimalBinningWOE:
    """Fit supervised bins and their weights of evidence on training rows."""

    max_n_bins: int = 8
    min_bin_size: float = 0.02
    prebins: int = 20
    label: str = LABEL

    def fit(self, train: DataFrame, columns: list[str]) -> "FittedWOE":
        fine = prebin_cuts(train, columns, self.prebins)
        # At most prebins rows per feature.
        rows = bin_counts(train, fine, self.label).filter(F.col("bin").isNotNull()).collect()
        cuts: dict[str, list[float]] = {}
        values: dict[str, list[float]] = {}
        for c in columns:
            mine = {r["bin"]: (r["n"], r["events"]) for r in rows if r["feature"] == c}
            table = [mine.get(i, (0, 0)) for i in range(len(fine[c]) + 1)]
            starts = merge_bins(table, self.max_n_bins, self.min_bin_size)
            cuts[c] = [fine[c][s - 1] for s in starts if s > 0]
            values[c] = _bin_woe(table, starts)
        return FittedWOE(cuts, values, self.label)


def _bin_woe(table, starts):
    all_e = sum(e for _, e in table)
    all_good = sum(n for n, _ in table) - all_e
    out = []
    for a, b in zip(starts, [*starts[1:], len(table)]):
        n = sum(n for n, _ in table[a:b])
        e = sum(e for _, e in table[a:b])
        usable = 0 < e < n and all_e and all_good
        out.append(math.log(((n - e) / all_good) / (e / all_e)) if usable else 0.0)
    return out


@dataclass
class FittedWOE:
    cuts: dict[str, list[float]]
    values: dict[str, list[float]] = field(default_factory=dict)
    label: str = LABEL

    def woe(self, column: str) -> Column:
        """WOE of the row's bin as CASE branches; missing values get 0."""
        weights = self.values[column]
        branches = [f"WHEN `{column}` IS NULL THEN 0D"]
        for cut, w in zip(self.cuts[column], weights):
            branches.append(f"WHEN `{column}` < {float(cut)!r}D THEN {float(w)!r}D")
        last = float(weights[-1]) if weights else 0.0
        return F.expr(f"CASE {' '.join(branches)} ELSE {last!r}D END")

    def transform(self, df: DataFrame) -> DataFrame:
        out = [self.woe(c).alias(f"{c}_woe") for c in self.cuts]
        return df.select(*[c for c in df.columns if c not in self.cuts], *out)

    def output_columns(self) -> list[str]:
        return [f"{c}_woe" for c in self.cuts]

    def binning_tables(self, df: DataFrame) -> DataFrame:
        """One long table for all features, with a total row per feature."""
        return woe_table(bin_counts(df, self.cuts, self.label))
