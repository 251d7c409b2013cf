"""Running sums and order statistics over a global order, without a one-task window.

A window with an ORDER BY and no partition sends every row to one task. Here the
value axis is cut into ranges of about equal row mass; sums run inside a range,
and the totals of the ranges before it (one small row per range) are added. The
result is exact: cut points only decide how the work is spread.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage_table
from .repeats import COUNT

ROWS_PER_RANGE = 1_000_000


def range_cuts(df: DataFrame, value: str, rows_per_range: int = ROWS_PER_RANGE) -> list[float]:
    """Inner cut points for ``value``: one aggregate, one number for each ``rows_per_range`` rows.

    A value holding much of the mass repeats among the quantiles and collapses to
    one cut; after grouping by value it is one row, so it does not skew a range.
    """
    steps = [i / 256 for i in range(1, 256)]
    n, coarse = df.agg(
        F.count(value), F.percentile_approx(F.col(value).cast("double"), steps, 10_000)
    ).first()
    wanted = -(-n // rows_per_range) if n else 1
    if wanted <= 1:
        return []
    if wanted <= 256:
        every = max(1, 256 // wanted)
        return sorted(set(coarse[every - 1 :: every]))
    fine = [i / wanted for i in range(1, wanted)]
    points = df.agg(
        F.percentile_approx(F.col(value).cast("double"), fine, min(20 * wanted, 1 << 30))
    ).first()[0]
    return sorted(set(points))


def with_range(df: DataFrame, value: str, cuts: list[float], out: str = "_range") -> DataFrame:
    """Add the range number of ``value`` (binary search on the cut points, JVM side)."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    typed = df.withColumn("_axis", F.col(value).cast("double"))
    # NaN gets a range of its own above all others and null one below, as they stand in Spark's order.
    ranged = Bucketizer(
        splits=splits, inputCol="_axis", outputCol="_slot", handleInvalid="keep"
    ).transform(typed)
    slot = F.when(F.col("_axis").isNull(), F.lit(-1)).otherwise(F.col("_slot").cast("int"))
    return ranged.withColumn(out, slot).drop("_axis", "_slot")


def running_sums(
    df: DataFrame,
    value: str,
    sums: list[str],
    keys: list[str] = (),
    descending: bool = True,
    cuts: list[float] | None = None,
) -> DataFrame:
    """Add ``cum_<s>`` (inclusive running sum) and ``all_<s>`` (total) for every sum.

    ``df`` must hold one row per (keys, value). ``keys`` separates independent
    series, such as one series per feature or per weight vector.
    """
    keys = list(keys)
    cuts = range_cuts(df, value) if cuts is None else cuts
    ordered = F.col(value).desc() if descending else F.col(value).asc()
    local = Window.partitionBy(*keys, "_range").orderBy(ordered)
    local = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not cuts:
        series = Window.partitionBy(*keys, F.lit(0))
        running = series.orderBy(ordered).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        return df.select(
            "*",
            *[F.sum(s).over(running).alias(f"cum_{s}") for s in sums],
            *[F.sum(s).over(series).alias(f"all_{s}") for s in sums],
        )

    ranged = with_range(df, value, cuts)
    step = F.col("_range").desc() if descending else F.col("_range").asc()
    series = Window.partitionBy(*keys, F.lit(0))
    before = series.orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    # At most len(cuts) + 1 rows per series.
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
        .select(
            *keys,
            "_range",
            *[
                F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_off_{s}")
                for s in sums
            ],
            *[F.sum(f"_t_{s}").over(series).alias(f"all_{s}") for s in sums],
        )
    )
    inner = ranged.select("*", *[F.sum(s).over(local).alias(f"_in_{s}") for s in sums])
    joined = inner.join(offsets, [*keys, "_range"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_in_{s}") + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"all_{s}") for s in sums],
    )


def long_form(
    df: DataFrame, columns: list[str], carry: list[str] = (), cast: str = "double"
) -> DataFrame:
    """(carry…, feature, value): one scan for all columns instead of one job per column."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast(cast).alias("value")) for c in columns]
    return df.select(*carry, F.inline(F.array(*cells)))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n) over non-null values; repeated values collapse before the shuffle.

    Rows of a ``COUNT`` stand for so many.
    """
    counted = [COUNT] if COUNT in df.columns else []
    return (
        long_form(df, columns, counted)
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("feature", "value")
        .agg((F.sum(COUNT) if counted else F.count(F.lit(1))).alias("n"))
    )


def as_key(value: Column, kind: T.DataType) -> Column:
    """A value of type ``kind`` as text that tells different values apart, -0.0 and 0.0 excepted."""
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        value = value + F.lit(0.0).cast(kind)
    return value.cast("string")


def value_key(df: DataFrame, column: str) -> Column:
    """``as_key`` of a column."""
    return as_key(F.col(column), df.schema[column].dataType)


def keyed_form(df: DataFrame, columns: list[str], carry: list[str] = ()) -> DataFrame:
    """(carry…, feature, value) with values as ``value_key``: nothing is merged by a common type."""
    cells = [F.struct(F.lit(c).alias("feature"), value_key(df, c).alias("value")) for c in columns]
    return df.select(*carry, F.inline(F.array(*cells)))


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float]
) -> dict[str, list[float]]:
    """Linear-interpolated quantiles of every column (as numpy computes them).

    Ranks are read off distributed running counts at every size, since the built-in exact
    ``percentile`` keeps all distinct values of a column in one task. Nulls and NaN are left out.
    """
    if not columns:
        return {}
    return _quantiles_by_rank(df, columns, probabilities)


def _quantiles_by_rank(df, columns, probabilities, cuts=None):
    # Written once: the cuts and the running sums both read it, and it is smaller than the rows.
    counts = stage_table(value_counts(df, columns), "value-counts")
    cum = running_sums(counts, "value", ["n"], ["feature"], descending=False, cuts=cuts)
    # Row covers 0-based ranks [cum_n - n, cum_n); a quantile needs the two ranks
    # around p * (total - 1).
    spans = cum.select(
        "feature",
        "value",
        (F.col("cum_n") - F.col("n")).alias("first"),
        F.col("cum_n").alias("end"),
        F.col("all_n").alias("total"),
    )
    covered = _with_probes(spans, [float(p) for p in probabilities])
    position = F.col("p") * (F.col("total") - 1).cast("double")
    low, high = F.floor(position), F.ceil(position)
    inside = lambda rank: (F.col("first") <= rank) & (rank < F.col("end"))
    picked = (
        covered.filter(inside(low) | inside(high))
        .groupBy("feature", "i")
        .agg(
            F.max(F.when(inside(low), F.col("value"))).alias("lo"),
            F.max(F.when(inside(high), F.col("value"))).alias("hi"),
            F.first(position - F.floor(position)).alias("share"),
        )
        .select("feature", "i", (F.col("lo") + F.col("share") * (F.col("hi") - F.col("lo"))).alias("q"))
    )
    # columns x probabilities rows, whatever the size of the data.
    table: dict[str, dict[int, float]] = {c: {} for c in columns}
    for r in picked.collect():
        table[r["feature"]][r["i"]] = r["q"]
    return {c: [v for _, v in sorted(table[c].items())] for c in columns}


def _with_probes(spans: DataFrame, probabilities: list[float]) -> DataFrame:
    """One row per (span, probability that may fall in it).

    On an even grid the few candidates follow from the span's own ranks, so a
    thousand quantiles do not mean a thousand copies of every row.
    """
    last = len(probabilities) - 1
    even = last > 8 and all(abs(p - i / last) < 1e-12 for i, p in enumerate(probabilities))
    if not even:
        probes = F.array(*[F.lit(p) for p in probabilities])
        return spans.select("*", F.posexplode(probes).alias("i", "p"))
    scale = F.lit(float(last)) / F.greatest(F.col("total") - 1, F.lit(1)).cast("double")
    start = F.greatest(F.floor(F.col("first") * scale) - 1, F.lit(0)).cast("int")
    stop = F.least(F.ceil(F.col("end") * scale) + 1, F.lit(last)).cast("int")
    return spans.select("*", F.explode(F.sequence(start, stop)).alias("i")).withColumn(
        "p", F.col("i") / F.lit(float(last))
    )


def cut_index(column: str, cuts: list[float]) -> Column:
    """Number of cuts at or below the value (0 to len(cuts)); null stays null.

    Parsed from text: for many columns and cuts, building the same expression call
    by call takes longer than running it.
    """
    if not cuts:
        return F.when(F.col(column).isNotNull(), F.lit(0))
    return F.expr(" + ".join(f"CAST(`{column}` >= {float(c)!r}D AS INT)" for c in cuts))
