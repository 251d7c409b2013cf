"""Stateless scoring of arriving rows with Structured Streaming.

Every micro-batch writes its scored rows, its rejected rows and one summary row
under its batch number. A replayed batch overwrites its own folders, so the
results are exactly-once even after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.scoring import batch_summary, response_rows, scored_rows
from ..schema import COUNT_COLUMNS, PROBABILITY_OUT, counts_schema
from ..sources.validation import split_valid


def read_count_stream(
    spark: SparkSession, folder: str, max_files: int = 1000, labelled: bool = False
) -> DataFrame:
    """Count rows from Parquet files as they arrive in a folder."""
    return (
        spark.readStream.schema(counts_schema(labelled))
        .option("maxFilesPerTrigger", max_files)
        .parquet(folder)
    )


def start_scoring(
    rows: DataFrame,
    bundle,
    version: str,
    out_dir: str,
    checkpoint: str,
    threshold: float | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Score a stream into ``out_dir``/{scored,rejected,summary}/batch_id=<n>."""
    at = bundle.threshold if threshold is None else float(threshold)
    carry = [c for c in rows.columns if c not in COUNT_COLUMNS]

    def handle(batch: DataFrame, batch_id: int) -> None:
        valid, rejected = split_valid(batch)
        target = lambda kind: f"{out_dir}/{kind}/batch_id={batch_id}"
        scored = scored_rows(valid, bundle, at)
        answers = response_rows(
            scored, at, bundle.name, version, [*carry, *COUNT_COLUMNS], PROBABILITY_OUT
        )
        answers.write.mode("overwrite").parquet(target("scored"))
        rejected.write.mode("overwrite").parquet(target("rejected"))
        written = batch.sparkSession.read.schema(answers.schema).parquet(target("scored"))
        decided = written.withColumn("decision", written["is_phishing"].cast("int"))
        batch_summary(decided, version, at, "decision").coalesce(1).write.mode(
            "overwrite"
        ).parquet(target("summary"))

    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


