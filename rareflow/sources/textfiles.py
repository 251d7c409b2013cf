"""Small text files (metadata, settings) on any file system Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file(spark, path)
    return fs.exists(target)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    fs, target = _file(spark, path)
    stream = fs.create(target, overwrite)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row is not None else ""


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Full paths of the sub-folders, in name order."""
    fs, target = _file(spark, path)
    if not fs.exists(target):
        return []
    found = [s for s in fs.listStatus(target) if s.isDirectory()]
    return sorted(s.getPath().toString() for s in found)


def make_dir(spark: SparkSession, path: str) -> None:
    """Create a folder that must not exist yet."""
    fs, target = _file(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    fs.mkdirs(target)
