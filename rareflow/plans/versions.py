"""Saved model versions: one new folder each, with the model and a metadata file."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.textfiles import list_dirs, make_dir, read_text, write_text
from .bundles import BlendBundle, ModelBundle, load_bundle

METADATA_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("algorithm", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("feature_names", T.ArrayType(T.StringType())),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("threshold_mode", T.StringType()),
        T.StructField("feature_mode", T.StringType()),
        T.StructField("metrics", T.StringType()),
        T.StructField("params", T.StringType()),
    ]
)


def save_version(
    spark: SparkSession,
    bundle: ModelBundle | BlendBundle,
    folder: str,
    metrics: dict | None = None,
    params: dict | None = None,
    at: datetime | None = None,
) -> str:
    """Write ``<slug>__<utc time>``; an existing folder of that name is an error."""
    stamp = (at or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%SZ")
    slug = re.sub(r"[^A-Za-z0-9_.-]+", "_", bundle.name).strip("_")
    path = f"{folder}/{slug}__{stamp}"
    make_dir(spark, path)
    bundle.save(spark, f"{path}/model")
    algorithm = type(bundle).__name__
    if isinstance(bundle, ModelBundle):
        algorithm = type(bundle.scorer).__name__
    metadata = {
        "name": bundle.name,
        "algorithm": algorithm,
        "created_at": stamp,
        "feature_names": bundle.inputs,
        "threshold": bundle.threshold,
        "threshold_mode": bundle.threshold_mode,
        "feature_mode": bundle.mode,
        "metrics": metrics or {},
        "params": params or {},
    }
    # Last of all: a folder without metadata is an unfinished version and is skipped.
    write_text(spark, f"{path}/metadata.json", json.dumps(metadata))
    return path


def version_table(spark: SparkSession, folder: str) -> DataFrame:
    """(version, path, metadata…) of all finished versions, read in one job."""
    text = (
        spark.read.option("wholetext", True)
        .text([f"{d}/metadata.json" for d in _finished(spark, folder)])
        .select(F.input_file_name().alias("file"), F.from_json("value", METADATA_SCHEMA).alias("m"))
    )
    path = F.regexp_replace("file", "/metadata\\.json$", "")
    return text.select(
        F.element_at(F.split(path, "/"), -1).alias("version"), path.alias("path"), "m.*"
    )


def _finished(spark: SparkSession, folder: str) -> list[str]:
    from ..sources.textfiles import exists

    return [d for d in list_dirs(spark, folder) if exists(spark, f"{d}/metadata.json")]


def newest_first(versions: DataFrame) -> DataFrame:
    """Number versions by creation time, newest 1; the version name breaks ties."""
    # One row per saved version.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("created_at"), F.desc("version"))
    return versions.withColumn("rank", F.row_number().over(order).cast("bigint"))


def list_versions(spark: SparkSession, folder: str) -> DataFrame | None:
    """Versions newest first, or None if there are none."""
    if not _finished(spark, folder):
        return None
    return newest_first(version_table(spark, folder)).orderBy("rank")


def load_version(
    spark: SparkSession, folder: str, version: str | None = None
) -> tuple[ModelBundle | BlendBundle, dict]:
    """The pinned version, else the newest one; an error if there is none."""
    finished = _finished(spark, folder)
    if version is not None:
        match = [d for d in finished if d.rstrip("/").split("/")[-1] == version]
        if not match:
            raise FileNotFoundError(f"no version {version!r} in {folder}")
        path = match[0]
    else:
        table = list_versions(spark, folder)
        if table is None:
            raise FileNotFoundError(f"no saved versions in {folder}; train one first")
        path = table.first()["path"]
    metadata = json.loads(read_text(spark, f"{path}/metadata.json"))
    metadata["version"] = path.rstrip("/").split("/")[-1]
    return load_bundle(spark, f"{path}/model"), metadata
