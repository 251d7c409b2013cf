"""Imbalance-aware metrics as distributed aggregates.

Everything that depends on the ranking starts from ``score_counts``: one row per
distinct score with its positives and its rows. Rows of a heavy score collapse
before the shuffle. Curves, average precision, ROC-AUC, confusion counts and
threshold choices all read that table, so one pass over the scored rows serves
every metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LABEL
from ..session import stage_table
from .ordered import range_cuts, running_sums
from .repeats import COUNT


def score_counts(
    df: DataFrame, score: str, label: str = LABEL, keys: list[str] = ()
) -> DataFrame:
    """(keys…, score, pos, n): label counts per distinct score. Rows of a ``COUNT`` stand for so many."""
    pos, n = F.col(label).cast("bigint"), F.count(F.lit(1))
    if COUNT in df.columns:
        pos, n = pos * F.col(COUNT), F.sum(COUNT)
    return df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.sum(pos).alias("pos"), n.alias("n"))


def score_curve(
    df: DataFrame, score: str, label: str = LABEL, keys: list[str] = ()
) -> DataFrame:
    """Confusion counts of ``score >= threshold`` for every distinct score.

    Columns: keys…, threshold, pos, n, tp, fp, n_pos, n_neg.
    """
    scored = df.filter(F.col(score).isNotNull())
    # The counts are written once, so that rows are scored once for the cuts and the curve together.
    counts = stage_table(score_counts(scored, score, label, keys), "score-counts")
    return curve_of_counts(counts, keys, range_cuts(counts, "score"))


def curve_of_counts(
    counts: DataFrame, keys: list[str] = (), cuts: list[float] | None = None
) -> DataFrame:
    """The same from a ``score_counts`` table (for instance a staged one)."""
    cum = running_sums(counts, "score", ["pos", "n"], keys, descending=True, cuts=cuts)
    return cum.select(
        *keys,
        F.col("score").alias("threshold"),
        "pos",
        "n",
        F.col("cum_pos").alias("tp"),
        (F.col("cum_n") - F.col("cum_pos")).alias("fp"),
        F.col("all_pos").alias("n_pos"),
        (F.col("all_n") - F.col("all_pos")).alias("n_neg"),
    )


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    """Double division, ``empty`` where the divisor is zero."""
    return F.when(
        bottom != 0, top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))
    ).otherwise(F.lit(empty))


def precision_of() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def recall_of() -> Column:
    # Without positives every recall is 1, as the usual curve convention has it.
    return ratio(F.col("tp"), F.col("n_pos"), empty=1.0)


def pr_grid(curve: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Threshold, precision and recall for every distinct score; no (1, 0) end point."""
    return curve.select(
        *keys,
        "threshold",
        "tp",
        "fp",
        "n_pos",
        "n_neg",
        precision_of().alias("precision"),
        recall_of().alias("recall"),
    )


def pr_roc_curves(curve: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Plot table: precision, recall, false and true positive rate per threshold."""
    return curve.select(
        *keys,
        "threshold",
        precision_of().alias("precision"),
        recall_of().alias("recall"),
        ratio(F.col("fp"), F.col("n_neg")).alias("fpr"),
        recall_of().alias("tpr"),
    )


def thin_curve(curve: DataFrame, points: int = 200, by: str = "recall") -> DataFrame:
    """At most ``points`` + 1 evenly spread curve rows for display, lowest threshold per step."""
    step = F.floor(F.col(by) * F.lit(float(points)))
    packed = F.struct("threshold", *[c for c in curve.columns if c != "threshold"])
    return curve.groupBy(step.alias("_step")).agg(F.min(packed).alias("_row")).select("_row.*")


def recall_steps(curve: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Recall gained at each threshold; its own positives over all, so no lag is needed."""
    return curve.select(
        *keys,
        "threshold",
        precision_of().alias("precision"),
        ratio(F.col("pos"), F.col("n_pos")).alias("recall_step"),
    )


def _two_classes() -> Column:
    return (F.max("n_pos") > 0) & (F.max("n_neg") > 0)


def average_precision() -> Column:
    """Aggregate over a curve: precision summed over recall steps; NaN for one class."""
    terms = F.sum(ratio(F.col("pos"), F.col("n_pos")) * precision_of())
    return F.when(_two_classes(), terms).otherwise(F.lit(float("nan")))


def roc_auc() -> Column:
    """Aggregate over a curve: share of (positive, negative) pairs in order, ties half."""
    negatives = (F.col("n") - F.col("pos")).cast("double")
    above = F.col("tp").cast("double") - F.col("pos").cast("double") / 2.0
    pairs = F.max("n_pos").cast("double") * F.max("n_neg").cast("double")
    area = F.sum(negatives * above) / F.nullif(pairs, F.lit(0.0))
    return F.when(_two_classes(), area).otherwise(F.lit(float("nan")))


def ranking_metrics(curve: DataFrame, keys: list[str] = ()) -> DataFrame:
    aggs = [average_precision().alias("pr_auc"), roc_auc().alias("roc_auc")]
    return curve.groupBy(*keys).agg(*aggs) if keys else curve.agg(*aggs)


def confusion_aggs(predicted: Column, actual: Column, weight: Column = None) -> list[Column]:
    """tn, fp, fn, tp, n_samples and n_positives in one pass; absent classes count 0."""
    weight = F.lit(1) if weight is None else weight
    total = lambda test: F.coalesce(F.sum(F.when(test, weight).otherwise(0)), F.lit(0)).cast("bigint")
    return [
        total((actual == 0) & (predicted == 0)).alias("tn"),
        total((actual == 0) & (predicted == 1)).alias("fp"),
        total((actual == 1) & (predicted == 0)).alias("fn"),
        total((actual == 1) & (predicted == 1)).alias("tp"),
        F.coalesce(F.sum(weight), F.lit(0)).cast("bigint").alias("n_samples"),
        total(actual == 1).alias("n_positives"),
    ]


def confusion(
    df: DataFrame, score: str, threshold: float, label: str = LABEL, keys: list[str] = ()
) -> DataFrame:
    predicted = (F.col(score) >= F.lit(float(threshold))).cast("int")
    aggs = confusion_aggs(predicted, F.col(label))
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def label_metrics() -> dict[str, Column]:
    """Precision, recall, F1 and MCC from confusion columns; zero divisors give 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2.0 * tp, 2.0 * tp + fp + fn),
        "mcc": ratio(tp * tn - fp * fn, spread),
    }


def with_label_metrics(confusion_df: DataFrame) -> DataFrame:
    return confusion_df.select("*", *[c.alias(n) for n, c in label_metrics().items()])


def metric_record(
    curve: DataFrame, threshold: float | Column, keys: list[str] = ()
) -> DataFrame:
    """All metrics of one score at one threshold, from a single aggregate over its curve.

    ``threshold`` may be a column of ``curve``, so each series can have its own.
    """
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    positive = F.col("threshold") >= t
    count = lambda test, what: F.coalesce(F.sum(F.when(test, what)), F.lit(0)).cast("bigint")
    negatives = F.col("n") - F.col("pos")
    aggs = [
        F.max(t).alias("at_threshold"),
        average_precision().alias("pr_auc"),
        roc_auc().alias("roc_auc"),
        count(~positive, negatives).alias("tn"),
        count(positive, negatives).alias("fp"),
        count(~positive, F.col("pos")).alias("fn"),
        count(positive, F.col("pos")).alias("tp"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_samples"),
        F.coalesce(F.sum("pos"), F.lit(0)).cast("bigint").alias("n_positives"),
    ]
    grouped = curve.groupBy(*keys).agg(*aggs) if keys else curve.agg(*aggs)
    derived = label_metrics()
    return grouped.select(
        *keys,
        F.col("at_threshold").alias("threshold"),
        "pr_auc",
        "roc_auc",
        *[derived[n].alias(n) for n in ("precision", "recall", "f1", "mcc")],
        "tn",
        "fp",
        "fn",
        "tp",
        "n_samples",
        "n_positives",
    )


def class_balance(df: DataFrame, label: str = LABEL, copies: str | None = None) -> dict[str, float]:
    """Counts and the weights learners derive from them, in one aggregate; ``copies`` is how many rows a row stands for."""
    one = F.lit(1) if copies is None else F.col(copies)
    n, pos = df.agg(F.coalesce(F.sum(one), F.lit(0)), F.sum(F.col(label).cast("bigint") * one)).first()
    pos = pos or 0
    neg = n - pos
    return {
        "n": n,
        "positives": pos,
        "negatives": neg,
        "rate": pos / n if n else float("nan"),
        "imbalance_ratio": neg / max(pos, 1),
        "weight_0": n / (2.0 * max(neg, 1)),
        "weight_1": n / (2.0 * max(pos, 1)),
    }


def with_balanced_weight(df: DataFrame, label: str = LABEL, out: str = "weight", copies: str | None = None) -> DataFrame:
    """n / (2 n_k) per row, as two literals."""
    b = class_balance(df, label, copies)
    return df.withColumn(
        out, F.when(F.col(label) == 1, F.lit(b["weight_1"])).otherwise(F.lit(b["weight_0"]))
    )


def with_imbalance_weight(df: DataFrame, label: str = LABEL, out: str = "weight", copies: str | None = None) -> DataFrame:
    """Negatives-to-positives ratio on positives, 1 on negatives."""
    ratio_ = class_balance(df, label, copies)["imbalance_ratio"]
    return df.withColumn(
        out, F.when(F.col(label) == 1, F.lit(float(ratio_))).otherwise(F.lit(1.0))
    )
