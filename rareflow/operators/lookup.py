"""Joining learned value maps onto rows, whatever their size and however skewed the values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .ordered import as_key, keyed_form, value_key

BROADCAST_ROWS = 500_000
HOT_SHARE = 1 / 500


def attach(
    df: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    values: list[str],
    rows_column: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    size: int | None = None,
) -> DataFrame:
    """Left join ``lookup`` (unique on ``keys``) onto ``df``.

    The map's size is measured (or given as ``size``). A map of at most ``broadcast_rows`` rows is
    broadcast. A larger one is split: keys holding more than 1/500 of all rows
    (fewer than 500 of them, by counting) are broadcast, the others are joined by
    shuffle. Rows already answered by the hot part, and rows with a null key, get
    a spread-out key in the shuffle, so no reducer receives a hot value.
    ``rows_column`` names the map's row count per key.
    """
    if size is None:
        size = lookup.limit(broadcast_rows + 1).count()
    wanted = lookup.select(*keys, *values)
    if size <= broadcast_rows:
        return df.join(F.broadcast(wanted), keys, "left")
    if rows_column is None:
        return df.join(wanted, keys, "left")

    total = lookup.agg(F.sum(rows_column)).first()[0]
    is_hot = F.col(rows_column) > F.lit(total * HOT_SHARE)
    hot = lookup.filter(is_hot).select(*keys, *[F.col(v).alias(f"_hot_{v}") for v in values])
    hot = hot.withColumn("_hot", F.lit(True))
    with_hot = df.join(F.broadcast(hot), keys, "left")
    # The keys as text, alike on both sides and for -0.0 and 0.0, as in an ordinary join.
    text = lambda frame: F.concat_ws("\u0001", *[value_key(frame, k) for k in keys])
    absent = F.lit(False)
    for k in keys:
        absent = absent | F.col(k).isNull()
    # Unique for each row, so that equal rows are spread too.
    spread = F.concat(F.lit("~"), F.monotonically_increasing_id().cast("string"))
    done = F.col("_hot").isNotNull() | absent
    routed = with_hot.withColumn("_key", F.when(done, spread).otherwise(text(df)))
    cold = lookup.filter(~is_hot).select(
        text(lookup).alias("_key"), *[F.col(v).alias(f"_cold_{v}") for v in values]
    )
    joined = routed.join(cold, "_key", "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_hot_{v}", f"_cold_{v}").alias(v) for v in values],
    )


def attach_long(
    df: DataFrame, lookup: DataFrame, columns: dict[str, str], extra: list[str] = (), value: str = "te"
) -> DataFrame:
    """Left join the maps of several columns at once; ``columns`` names the output of each.

    ``lookup`` holds (feature, value, extra…, n, ``value``), one row per feature, value and extra, the values
    as text. Rows are numbered and written once, then their cells are asked in long form: keys that hold
    more than 1/500 of a feature's rows (fewer than 500 a feature) are answered from a broadcast, the others
    meet the map in one join, and the answers return as one narrow row per row. So wide rows are shuffled
    once, however many columns there are, and no reducer receives a hot value. Null cells are not
    asked. The numbers are stored, so a repeated task reads the same ones. ``df`` may not be a stream.
    """
    keys = ["feature", "_cell", *extra]
    rows = stage_table(df.select(F.monotonically_increasing_id().alias("_row"), F.struct(*df.columns).alias("_in")), "rows")
    cells = rows.select("_row", *[F.col(f"_in.`{c}`").alias(c) for c in [*columns, *extra]])
    asked = keyed_form(cells, list(columns), carry=["_row", *extra]).withColumnRenamed("value", "_cell")
    asked = asked.filter(F.col("_cell").isNotNull())
    # The map's text is of the fitted type, the cells' of the type at hand.
    here: Column = F.lit(None).cast("string")
    for c in columns:
        kind = df.schema[c].dataType
        here = F.when(F.col("feature") == c, as_key(F.col("value").cast(kind), kind)).otherwise(here)
    table = lookup.filter(F.col("feature").isin(*columns)).withColumn("_cell", here)
    totals = table.groupBy("feature").agg((F.sum("n") * HOT_SHARE).alias("_bar"))
    ranked = table.join(F.broadcast(totals), "feature").withColumn("_is_hot", F.col("n") > F.col("_bar"))
    hot = ranked.filter("_is_hot").select(*keys, F.col(value).alias("_hot"))
    cold = ranked.filter("not _is_hot").select(*keys, F.col(value).alias("_cold"))
    marked = asked.join(F.broadcast(hot), keys, "left")
    found = (
        marked.filter(F.col("_hot").isNotNull()).select("_row", "feature", F.col("_hot").alias("_answer"))
    ).unionByName(
        marked.filter(F.col("_hot").isNull()).join(cold, keys).select("_row", "feature", F.col("_cold").alias("_answer"))
    )
    answers = found.groupBy("_row").agg(
        *[F.max(F.when(F.col("feature") == c, F.col("_answer"))).alias(f"_a{i}") for i, c in enumerate(columns)]
    )
    outs = [F.col(f"_a{i}").alias(out) for i, out in enumerate(columns.values())]
    return rows.join(answers, "_row", "left").select("_in.*", *outs)
