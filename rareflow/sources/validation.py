"""Checks on rows that arrive for scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COUNT_COLUMNS


def rejection_reasons(columns: list[str] = COUNT_COLUMNS) -> Column:
    """Array of ``missing:<column>`` / ``negative:<column>``, empty for a valid row."""
    checks = []
    for c in columns:
        checks.append(F.when(F.col(c).isNull(), F.lit(f"missing:{c}")))
        checks.append(F.when(F.col(c) < 0, F.lit(f"negative:{c}")))
    return F.filter(F.array(*checks), lambda r: r.isNotNull())


def with_reason(df: DataFrame, columns: list[str] = COUNT_COLUMNS) -> DataFrame:
    """Add ``reason`` (null for valid rows). A missing column is an error of the batch."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns missing from the batch: {', '.join(absent)}")
    return df.withColumn("reason", F.nullif(F.concat_ws(";", rejection_reasons(columns)), F.lit("")))


def split_valid(df: DataFrame, columns: list[str] = COUNT_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their reasons."""
    checked = with_reason(df, columns)
    return (
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()),
    )


def require_rows(df: DataFrame) -> None:
    """An empty scoring batch is an error."""
    if df.isEmpty():
        raise ValueError("the batch holds no rows")
