"""Exploration queries: feature statistics, distributions, class balance, mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CLASS_NAMES, LABEL
from .metrics import ratio
from .ordered import exact_quantiles, keyed_form, long_form


def feature_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per feature: count, mean, std, min, quartiles, max, dtype, distinct values.

    Moments come from one aggregate without a shuffle of rows; the distinct counts
    from value counts, which avoids one distinct aggregation per column.
    """
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    types = dict(df.dtypes)
    facts = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit(types[c]).alias("dtype"),
            *[
                F.lit(q).cast("double").alias(name)
                for name, q in zip(("p25", "p50", "p75"), quartiles[c] or [None] * 3)
            ],
        )
        for c in columns
    ]
    # By the values themselves: long integers and strings are not merged by a common number type.
    values = keyed_form(df, columns).filter(F.col("value").isNotNull()).distinct()
    distinct = values.groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique"))
    moments = (
        long_form(df, columns)
        .groupBy("feature")
        .agg(
            F.count("value").alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    # One row per feature on every side.
    table = moments.join(distinct, "feature", "left")
    table = table.withColumn("_facts", F.array(*facts))
    mine = F.filter("_facts", lambda s: s["feature"] == F.col("feature"))[0]
    return table.select(
        "feature",
        "count",
        "mean",
        "std",
        "min",
        *[mine[q].alias(q) for q in ("p25", "p50", "p75")],
        "max",
        mine["dtype"].alias("dtype"),
        F.coalesce("n_unique", F.lit(0)).cast("bigint").alias("n_unique"),
    )


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    return (
        df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy("value")
    )


def class_balance_table(df: DataFrame, label: str = LABEL) -> DataFrame:
    name = F.coalesce(
        *[F.when(F.col(label) == k, F.lit(v)) for k, v in CLASS_NAMES.items()],
        F.col(label).cast("string"),
    )
    return df.groupBy(name.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def mutual_information(
    df: DataFrame,
    columns: list[str],
    label: str = LABEL,
    continuous: list[str] = (),
    n_bins: int = 20,
) -> DataFrame:
    """(feature, mi) in nats: plug-in estimate on exact values, or on quantile bins.

    ``continuous`` columns are cut at ``n_bins`` quantiles first.
    """
    cells = df.select(F.col(label).alias("_y"), *columns)
    if continuous:
        from .encoders import QuantileBinner

        binner = QuantileBinner(n_bins=n_bins).fit(df, list(continuous))
        for c in continuous:
            cells = cells.withColumn(c, binner.bin_of(c))
    joint = (
        keyed_form(cells, columns, carry=["_y"])
        .groupBy("feature", "value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("_y").cast("bigint")).alias("pos"),
        )
    )
    # Per feature the totals are the same rows, so two sums give both marginals.
    totals = joint.groupBy("feature").agg(
        F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos")
    )
    # One row per requested column.
    both = joint.join(F.broadcast(totals), "feature")

    def term(count, label_total):
        share = ratio(count, F.col("all_n"))
        independent = F.col("n").cast("double") * label_total.cast("double")
        lift = count.cast("double") * F.col("all_n").cast("double") / F.nullif(independent, F.lit(0.0))
        return F.when(count > 0, share * F.log(lift)).otherwise(F.lit(0.0))

    neg = F.col("n") - F.col("pos")
    mi = F.sum(
        term(F.col("pos"), F.col("all_pos")) + term(neg, F.col("all_n") - F.col("all_pos"))
    )
    return both.groupBy("feature").agg(mi.alias("mi")).orderBy(F.desc("mi"), "feature")
