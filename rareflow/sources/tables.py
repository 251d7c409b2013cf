"""Readers: count tables from CSV or Parquet, and folder listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LABEL, ROW_ID, counts_schema, feature_columns, has_labels


def load_counts(
    spark: SparkSession, path: str, labelled: bool = True, row_id: bool = True
) -> DataFrame:
    """Read a count table (CSV with header, or Parquet by suffix) under the fixed schema."""
    schema = counts_schema(labelled, row_id)
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .schema(schema)
        .csv(path)
    )


def list_folder(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """Files of a data folder with size and time, without reading their content."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(folder)
        .select(
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            F.col("length").alias("n_bytes"),
            F.col("modificationTime").alias("modified_at"),
        )
    )


def load_folder(spark: SparkSession, folder: str, labelled: bool = True) -> DataFrame:
    """All CSV files of a folder as one table that keeps the file each row came from."""
    return (
        spark.read.option("header", True)
        .option("pathGlobFilter", "*.csv")
        .schema(counts_schema(labelled))
        .csv(folder)
        .select("*", F.col("_metadata.file_name").alias("file_name"))
    )


def features_and_label(df: DataFrame, target: str = LABEL) -> DataFrame:
    """Row id, canonical features and the label as int (label only when present)."""
    keep = [c for c in [ROW_ID] if c in df.columns] + feature_columns(df, target)
    columns = [F.col(c) for c in keep]
    if has_labels(df, target):
        columns.append(F.col(target).cast("int").alias(target))
    return df.select(*columns)


def feature_frame(df: DataFrame) -> DataFrame:
    """Canonical features present; if there are none, every column as it is."""
    from ..schema import COUNT_COLUMNS

    present = [c for c in COUNT_COLUMNS if c in df.columns]
    return df.select(*present) if present else df
