"""Session defaults and the shared folder that holds intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", app: str = "rareflow", **conf: str) -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, as the session names it.

    On a cluster the folder must be given in ``spark.checkpoint.dir``. Only a session of
    one process (``local``, ``local[n]``) without one gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="rareflow-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage_table(
    df: DataFrame, label: str = "stage", partition_by: str | None = None
) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts lineage between rounds of iterative work, and survives lost executors
    because the files do not live on them. Columns stay prunable on re-read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rareflow-{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by is not None:
        # Few files per folder; a value with many rows is split over several writers.
        writer = df.hint("rebalance", partition_by).write.partitionBy(partition_by)
    writer.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._stage_path = path
    return staged


def drop_stage(*staged: DataFrame) -> None:
    """Remove the files of stage tables that nothing reads any more."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stage_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core for compute-bound work on few, small files.

    A large table has far more partitions than cores and is returned as it is. The
    check plans a scan; give it a stage table rather than an unevaluated query.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
