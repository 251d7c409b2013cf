"""Batch scoring: probability and decision per row, metrics if labels are present, one log row."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import decide
from ..operators.metrics import metric_record, score_curve
from ..schema import DECISION_OUT, LABEL, PROBABILITY_OUT, has_labels
from ..session import stage_table
from .runlog import log_inference

log = logging.getLogger("rareflow")


def scored_rows(
    df: DataFrame,
    bundle,
    threshold: float | None = None,
    probability: str = PROBABILITY_OUT,
    decision: str = DECISION_OUT,
) -> DataFrame:
    """Input columns plus probability and 0/1 decision."""
    at = bundle.threshold if threshold is None else float(threshold)
    return bundle.with_score(df, probability).withColumn(decision, decide(F.col(probability), at))


def batch_summary(
    scored: DataFrame, version: str, threshold: float, decision: str = DECISION_OUT
) -> DataFrame:
    """One aggregate row per batch."""
    return scored.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(decision).alias("predicted_positive_rate"),
    ).select(
        F.lit(version).alias("model_version"),
        F.lit(float(threshold)).alias("threshold"),
        "n_samples",
        "predicted_positive_rate",
    )


@dataclass
class ScoredBatch:
    rows: DataFrame
    summary: dict
    metrics: dict | None


def score_batch(
    df: DataFrame,
    bundle,
    version: str,
    threshold: float | None = None,
    out_path: str | None = None,
    out_format: str = "parquet",
    log_dir: str | None = None,
    label: str = LABEL,
) -> ScoredBatch:
    """Score, write, evaluate if labelled, log. The scored rows are computed once."""
    at = bundle.threshold if threshold is None else float(threshold)
    scored = scored_rows(df, bundle, at)
    if out_path and out_format == "parquet":
        scored.write.mode("overwrite").parquet(out_path)
        scored = df.sparkSession.read.parquet(out_path)
    else:
        scored = stage_table(scored, "scored")
        if out_path:
            scored.write.mode("overwrite").option("header", True).format(out_format).save(out_path)
    summary = batch_summary(scored, version, at).first().asDict()
    metrics = None
    if has_labels(df, label):
        curve = score_curve(scored, PROBABILITY_OUT, label)
        metrics = metric_record(curve, at).first().asDict()
    if log_dir:
        try:
            log_inference(
                df.sparkSession,
                f"{log_dir}/run_log",
                version,
                at,
                summary["n_samples"],
                summary["predicted_positive_rate"] or 0.0,
                metrics,
            )
        except Exception:  # logging must never block predictions
            log.exception("batch summary not logged")
    return ScoredBatch(scored, summary, metrics)


def response_rows(
    scored: DataFrame,
    threshold: float,
    model_name: str,
    version: str,
    carry: list[str] = (),
    probability: str = PROBABILITY_OUT,
) -> DataFrame:
    """Rows in the shape of the scoring response."""
    return scored.select(
        *carry,
        F.col(probability).alias("phishing_likelihood"),
        (F.col(probability) >= F.lit(float(threshold))).alias("is_phishing"),
        F.lit(float(threshold)).alias("threshold_used"),
        F.lit(model_name).alias("model_name"),
        F.lit(version).alias("model_version"),
    )
