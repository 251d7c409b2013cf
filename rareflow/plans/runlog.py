"""Append-only run log: parameters, metrics and tags of fits and scoring batches."""

from __future__ import annotations

import numbers
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("run_name", T.StringType()),
        T.StructField("experiment", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)
FIT = "fit"
INFERENCE = "inference"


def numeric_only(metrics: dict) -> dict[str, float]:
    """Scalar numbers only: no booleans, arrays or strings."""
    return {
        k: float(v)
        for k, v in metrics.items()
        if isinstance(v, numbers.Real) and not isinstance(v, bool)
    }


def numeric_columns(df: DataFrame) -> DataFrame:
    """The same filter on a metrics table, by schema."""
    return df.select(
        *[f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    )


def metrics_long(df: DataFrame, carry: list[str] = (), prefix: str = "") -> DataFrame:
    """Numeric metric columns as (carry…, key, value) rows."""
    names = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in carry
    ]
    cells = [
        F.struct(F.lit(f"{prefix}{n}").alias("key"), F.col(n).cast("double").alias("value"))
        for n in names
    ]
    return df.select(*carry, F.inline(F.array(*cells)))


def _append(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, RUN_LOG_SCHEMA).coalesce(1).write.mode("append").partitionBy(
        "experiment"
    ).parquet(path)


def log_fit(
    spark: SparkSession,
    path: str,
    run_name: str,
    params: dict,
    cv_metrics: dict,
    val_metrics: dict | None = None,
    test_metrics: dict | None = None,
    tags: dict | None = None,
) -> str:
    run_id = uuid.uuid4().hex
    rows = [(run_id, run_name, FIT, "tag", k, None, str(v)) for k, v in (tags or {}).items()]
    rows += [(run_id, run_name, FIT, "param", k, None, str(v)) for k, v in params.items()]
    for prefix, metrics in (("cv_", cv_metrics), ("val_", val_metrics), ("test_", test_metrics)):
        for k, v in numeric_only(metrics or {}).items():
            rows.append((run_id, run_name, FIT, "metric", f"{prefix}{k}", v, None))
    _append(spark, path, rows)
    return run_id


def log_inference(
    spark: SparkSession,
    path: str,
    model_version: str,
    threshold: float,
    n_samples: int,
    predicted_positive_rate: float,
    eval_metrics: dict | None = None,
) -> str:
    """One batch summary; never row-level data."""
    run_id = uuid.uuid4().hex
    name = f"infer:{model_version}"
    metrics = {
        "n_samples": n_samples,
        "predicted_positive_rate": predicted_positive_rate,
        **(eval_metrics or {}),
    }
    rows = [
        (run_id, name, INFERENCE, "param", "model_version", None, model_version),
        (run_id, name, INFERENCE, "param", "threshold", None, str(threshold)),
    ]
    rows += [
        (run_id, name, INFERENCE, "metric", k, v, None) for k, v in numeric_only(metrics).items()
    ]
    _append(spark, path, rows)
    return run_id


def read_log(spark: SparkSession, path: str, experiment: str | None = None) -> DataFrame:
    """Log rows; the experiment filter prunes partitions."""
    log = spark.read.schema(RUN_LOG_SCHEMA).parquet(path)
    return log if experiment is None else log.filter(F.col("experiment") == experiment)


def write_binning_tables(tables: DataFrame, path: str) -> None:
    """All features' binning tables as one table partitioned by feature."""
    tables.write.mode("overwrite").partitionBy("feature").parquet(path)
