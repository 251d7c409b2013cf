"""Queries: aggregates, metrics, curves and operating points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import decide
from ..operators import explore, metrics, thresholds
from ..operators.features import FeatureEngineer
from ..operators.splits import holdout_split, part
from ..schema import LABEL, ROW_ID
from .base import (
    AP_SQL,
    AUC_SQL,
    F1_SQL,
    FEATURES,
    HOLDOUT_SQL,
    MCC_SQL,
    PRECISION_SQL,
    RECALL_SQL,
    confusion_sql,
    counts,
    grid_ctes,
    query,
    r6,
    rounded,
    staged_counts,
    with_sql,
)

CUT = 0.3


@query("a01_positive_rate", with_sql(f"SELECT {r6('avg(label_1)', 'positive_rate')} FROM counts"))
def positive_rate(spark, sf_dir):
    return rounded(counts(spark, sf_dir).agg(F.avg(LABEL).alias("positive_rate")))


_STAT_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS count, {r6(f'avg({c})', 'mean')},
        {r6(f'stddev_samp({c})', 'std')}, CAST(min({c}) AS DOUBLE) AS min,
        {r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.25e0)', 'p25')},
        {r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.5e0)', 'p50')},
        {r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.75e0)', 'p75')},
        CAST(max({c}) AS DOUBLE) AS max, 'bigint' AS dtype, count(DISTINCT {c}) AS n_unique
        FROM counts"""
    for c in FEATURES
)


@query("a03_feature_statistics", with_sql(_STAT_SQL))
def statistics(spark, sf_dir):
    return rounded(explore.feature_statistics(staged_counts(spark, sf_dir), FEATURES))


@query(
    "a04_value_distribution",
    with_sql("SELECT num_links AS value, count(*) AS n FROM counts GROUP BY 1 ORDER BY 1"),
)
def distribution(spark, sf_dir):
    return explore.value_distribution(counts(spark, sf_dir), "num_links")


@query(
    "a05_class_balance",
    with_sql(
        "SELECT CASE label_1 WHEN 0 THEN 'legit' WHEN 1 THEN 'phishing' END AS class,"
        " count(*) AS n FROM counts GROUP BY 1"
    ),
)
def class_balance(spark, sf_dir):
    return explore.class_balance_table(counts(spark, sf_dir))


@query("a06_confusion", with_sql(f"SELECT * FROM {confusion_sql('p_a', CUT)}"))
def confusion(spark, sf_dir):
    return metrics.confusion(counts(spark, sf_dir), "p_a", CUT)


@query(
    "a07_precision_recall_f1",
    with_sql(
        f"SELECT {r6(PRECISION_SQL, 'precision')}, {r6(RECALL_SQL, 'recall')}, {r6(F1_SQL, 'f1')}"
        f" FROM {confusion_sql('p_a', CUT)}"
    ),
)
def precision_recall_f1(spark, sf_dir):
    table = metrics.with_label_metrics(metrics.confusion(counts(spark, sf_dir), "p_a", CUT))
    return rounded(table.select("precision", "recall", "f1"))


@query("a08_mcc", with_sql(f"SELECT {r6(MCC_SQL, 'mcc')} FROM {confusion_sql('p_a', CUT)}"))
def mcc(spark, sf_dir):
    table = metrics.with_label_metrics(metrics.confusion(counts(spark, sf_dir), "p_a", CUT))
    return rounded(table.select("mcc"))


@query(
    "a09_average_precision", with_sql(f"SELECT {r6(AP_SQL, 'pr_auc')} FROM grid", grid_ctes("p_a"))
)
def average_precision(spark, sf_dir):
    curve = metrics.score_curve(staged_counts(spark, sf_dir), "p_a")
    return rounded(curve.agg(metrics.average_precision().alias("pr_auc")))


@query("a10_roc_auc", with_sql(f"SELECT {r6(AUC_SQL, 'roc_auc')} FROM grid", grid_ctes("p_a")))
def roc_auc(spark, sf_dir):
    curve = metrics.score_curve(staged_counts(spark, sf_dir), "p_a")
    return rounded(curve.agg(metrics.roc_auc().alias("roc_auc")))


@query(
    "a10_metric_record",
    with_sql(
        f"""SELECT 0.3e0 AS threshold, g.pr_auc, g.roc_auc, {r6(PRECISION_SQL, 'precision')},
              {r6(RECALL_SQL, 'recall')}, {r6(F1_SQL, 'f1')}, {r6(MCC_SQL, 'mcc')},
              tn, fp, fn, tp, n_samples, n_positives
            FROM {confusion_sql('p_a', CUT)}
            CROSS JOIN (SELECT {r6(AP_SQL, 'pr_auc')}, {r6(AUC_SQL, 'roc_auc')} FROM grid) g""",
        grid_ctes("p_a"),
    ),
)
def record(spark, sf_dir):
    return rounded(metrics.metric_record(metrics.score_curve(staged_counts(spark, sf_dir), "p_a"), CUT))


@query(
    "a11_imbalance_weight",
    with_sql(
        f"""SELECT row_id, {r6("CASE WHEN label_1 = 1 THEN ratio ELSE 1e0 END", 'weight')}
            FROM counts, (SELECT CAST(sum(1 - label_1) AS DOUBLE) / greatest(sum(label_1), 1) AS ratio
                          FROM counts)"""
    ),
)
def imbalance_weight(spark, sf_dir):
    df = metrics.with_imbalance_weight(staged_counts(spark, sf_dir).select(ROW_ID, LABEL))
    return rounded(df.drop(LABEL))


@query(
    "a12_balanced_weight",
    with_sql(
        f"""SELECT row_id, {r6('n / (2e0 * nk)', 'weight')} FROM (
              SELECT row_id, count(*) OVER () AS n, count(*) OVER (PARTITION BY label_1) AS nk
              FROM counts)"""
    ),
)
def balanced_weight(spark, sf_dir):
    df = metrics.with_balanced_weight(staged_counts(spark, sf_dir).select(ROW_ID, LABEL))
    return rounded(df.drop(LABEL))


def mi_sql(cells: str) -> str:
    """Plug-in mutual information over a (feature, value, label_1) subquery."""
    return f"""
WITH_CELLS AS ({cells}),
joint AS (SELECT feature, value, label_1, count(*) AS c FROM WITH_CELLS GROUP BY 1, 2, 3),
marg AS (SELECT *, sum(c) OVER (PARTITION BY feature, value) AS cx,
           sum(c) OVER (PARTITION BY feature, label_1) AS cy, sum(c) OVER (PARTITION BY feature) AS n
         FROM joint)"""


_MI_CELLS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, label_1 FROM counts" for c in FEATURES
)
_MI_VALUE = r6(
    "sum(CAST(c AS DOUBLE) / n * ln(CAST(c AS DOUBLE) * n / (CAST(cx AS DOUBLE) * cy)))", "mi"
)
_MI_BODY = f"SELECT feature, {_MI_VALUE} FROM marg GROUP BY 1"


@query("a13_mutual_information", with_sql(_MI_BODY, "," + mi_sql(_MI_CELLS)))
def mutual_information(spark, sf_dir):
    return rounded(explore.mutual_information(staged_counts(spark, sf_dir), FEATURES))


_W = "greatest(num_words + 1e0, 1e0)"
_RATIO_OF = {
    "lexical_diversity": f"num_unique_words / {_W}",
    "link_density": f"num_links / {_W}",
    "stopword_ratio": f"num_stopwords / {_W}",
}
_BIN_EDGES = ", ".join(
    f"list_distinct([{', '.join(f'quantile_cont({e}, {i / 20}e0)' for i in range(1, 20))}]) AS e_{n},"
    f" min({e}) AS lo_{n}, max({e}) AS hi_{n}"
    for n, e in _RATIO_OF.items()
)
_BIN_CELLS = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, len(list_filter(e_{n}, lambda q: q <= {e} AND q > lo_{n} AND q < hi_{n}))"
    f" AS value, label_1 FROM counts, edges"
    for n, e in _RATIO_OF.items()
)


@query(
    "a13_mutual_information_binned",
    with_sql(
        _MI_BODY, f", edges AS (SELECT {_BIN_EDGES} FROM counts)," + mi_sql(_BIN_CELLS)
    ),
)
def mutual_information_binned(spark, sf_dir):
    frame = FeatureEngineer().fit(staged_counts(spark, sf_dir)).transform(staged_counts(spark, sf_dir))
    names = list(_RATIO_OF)
    return rounded(explore.mutual_information(frame, names, continuous=names))


@query(
    "k01_importance_ranking",
    with_sql(
        f"SELECT row_number() OVER (ORDER BY mi DESC, feature) AS rank, feature FROM ({_MI_BODY})",
        "," + mi_sql(_MI_CELLS),
    ),
)
def importance_ranking(spark, sf_dir):
    from pyspark.sql import Window

    mi = rounded(explore.mutual_information(staged_counts(spark, sf_dir), FEATURES))
    # One row per feature.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("mi"), "feature")
    return mi.select(F.row_number().over(order).cast("bigint").alias("rank"), "feature")


@query(
    "a15_predicted_positive_rate",
    with_sql(f"SELECT {r6('avg(CASE WHEN p_a >= 0.3e0 THEN 1e0 ELSE 0e0 END)', 'rate')} FROM counts"),
)
def predicted_rate(spark, sf_dir):
    return rounded(counts(spark, sf_dir).agg(F.avg(decide(F.col("p_a"), CUT)).alias("rate")))


# ------------------------------------------------------------------ curves


def _curve(spark, sf_dir) -> DataFrame:
    return metrics.score_curve(staged_counts(spark, sf_dir), "p_a")


@query(
    "w01_pr_grid",
    with_sql(
        f"SELECT {r6('threshold', 'threshold')}, tp, fp, n_pos, n_neg, {r6('precision', 'precision')},"
        f" {r6('recall', 'recall')} FROM grid",
        grid_ctes("p_a"),
    ),
)
def pr_grid(spark, sf_dir):
    return rounded(metrics.pr_grid(_curve(spark, sf_dir)))


@query(
    "w02_pr_roc_curves",
    with_sql(
        f"SELECT {r6('threshold', 'threshold')}, {r6('precision', 'precision')},"
        f" {r6('recall', 'recall')}, {r6('CAST(fp AS DOUBLE) / n_neg', 'fpr')},"
        f" {r6('recall', 'tpr')} FROM grid",
        grid_ctes("p_a"),
    ),
)
def pr_roc_curves(spark, sf_dir):
    return rounded(metrics.pr_roc_curves(_curve(spark, sf_dir)))


@query(
    "w02_curve_for_display",
    with_sql(
        f"SELECT {r6('min(threshold)', 'threshold')}, {r6('arg_min(precision, threshold)', 'precision')},"
        f" {r6('arg_min(recall, threshold)', 'recall')} FROM grid GROUP BY floor(recall * 100e0)",
        grid_ctes("p_a"),
    ),
)
def display_curve(spark, sf_dir):
    curves = metrics.pr_grid(_curve(spark, sf_dir)).select("threshold", "precision", "recall")
    return rounded(metrics.thin_curve(curves, 100))


@query(
    "w03_recall_steps",
    with_sql(
        f"SELECT {r6('threshold', 'threshold')}, {r6('precision', 'precision')},"
        f" {r6('recall - coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0e0)', 'recall_step')}"
        " FROM grid",
        grid_ctes("p_a"),
    ),
)
def recall_steps(spark, sf_dir):
    return rounded(metrics.recall_steps(_curve(spark, sf_dir)))


@query(
    "p01_decision",
    with_sql("SELECT row_id, CAST(p_a >= 0.3e0 AS INTEGER) AS pred FROM counts"),
)
def decision(spark, sf_dir):
    return counts(spark, sf_dir).select(ROW_ID, decide(F.col("p_a"), CUT).alias("pred"))


@query(
    "p02_feasible_points",
    with_sql(
        f"SELECT {r6('threshold', 'threshold')}, {r6('precision', 'precision')}, {r6('recall', 'recall')}"
        " FROM grid WHERE recall >= 0.5e0 AND precision >= 0.3e0",
        grid_ctes("p_a"),
    ),
)
def feasible_points(spark, sf_dir):
    grid = metrics.pr_grid(_curve(spark, sf_dir)).select("threshold", "precision", "recall")
    return rounded(grid.filter(thresholds.feasible(0.5, 0.3)))


# ------------------------------------------------------------------ operating points

_VAL = ", val AS (SELECT * FROM parts WHERE split = 'val')"
_VAL_GRID = HOLDOUT_SQL + _VAL + grid_ctes("p_a", "val")


def _point(mode: str, order: str, where: str = "", note: str = "''") -> str:
    return (
        f"SELECT {r6('threshold', 'threshold')}, '{mode}' AS mode, {r6('precision', 'precision')},"
        f" {r6('recall', 'recall')}, {note} AS note FROM grid {where}"
        f" ORDER BY {order}, threshold LIMIT 1"
    )


def validation(spark, sf_dir) -> DataFrame:
    df = staged_counts(spark, sf_dir).select(ROW_ID, LABEL, "p_a", "p_b")
    return part(holdout_split(df), "val")


def _val_grid(spark, sf_dir) -> DataFrame:
    return metrics.pr_grid(metrics.score_curve(validation(spark, sf_dir), "p_a"))


@query(
    "t01_recall_target",
    with_sql(
        _point("recall_target", "precision DESC", "WHERE recall >= 0.6e0 AND precision >= 0.05e0"),
        _VAL_GRID,
    ),
)
def recall_target(spark, sf_dir):
    return rounded(thresholds.for_recall_target(_val_grid(spark, sf_dir), 0.6, 0.05))


@query(
    "t01_recall_target_infeasible",
    with_sql(
        _point("recall_target", "recall DESC", note=f"'{thresholds.INFEASIBLE}'"), _VAL_GRID
    ),
)
def recall_target_infeasible(spark, sf_dir):
    return rounded(thresholds.for_recall_target(_val_grid(spark, sf_dir), 0.99, 0.95))


_F1_OF = "CASE WHEN precision + recall > 0 THEN 2e0 * precision * recall / (precision + recall) ELSE 0e0 END"


@query("t02_max_f1", with_sql(_point("max_f1", f"{_F1_OF} DESC"), _VAL_GRID))
def max_f1(spark, sf_dir):
    return rounded(thresholds.for_max_f1(_val_grid(spark, sf_dir)))


@query(
    "t03_manual",
    with_sql(
        f"SELECT 0.25e0 AS threshold, 'manual' AS mode, {r6(PRECISION_SQL, 'precision')},"
        f" {r6(RECALL_SQL, 'recall')}, '' AS note FROM {confusion_sql('p_a', 0.25, 'val')}",
        HOLDOUT_SQL + _VAL,
    ),
)
def manual(spark, sf_dir):
    return rounded(thresholds.manual(validation(spark, sf_dir), "p_a", 0.25))


def _cost(fn_cost: float) -> str:
    return f"({fn_cost}e0 * (n_pos - tp) + 1e0 * CASE WHEN precision > 0 THEN fp ELSE n_neg END)"


@query(
    "t04_min_cost",
    with_sql(_point("cost", _cost(10.0), note="'min expected cost (FN=10.0, FP=1.0)'"), _VAL_GRID),
)
def min_cost(spark, sf_dir):
    return rounded(thresholds.for_min_cost(_val_grid(spark, sf_dir)))


@query(
    "t05_select_threshold",
    with_sql(
        " UNION ALL ".join(
            f"SELECT * FROM ({q})"
            for q in (
                _point("max_f1", f"{_F1_OF} DESC"),
                _point("cost", _cost(20.0), note="'min expected cost (FN=20.0, FP=1.0)'"),
                _point("recall_target", "precision DESC", "WHERE recall >= 0.5e0 AND precision >= 0.3e0"),
            )
        )
        + f" UNION ALL SELECT 0.5e0, 'manual', {r6(PRECISION_SQL, 'precision')},"
        f" {r6(RECALL_SQL, 'recall')}, '' FROM {confusion_sql('p_a', 0.5, 'val')}",
        _VAL_GRID,
    ),
)
def select_threshold(spark, sf_dir):
    df = validation(spark, sf_dir)
    grid = metrics.pr_grid(metrics.score_curve(df, "p_a"))
    table = None
    for config in (
        thresholds.ThresholdConfig("max_f1"),
        thresholds.ThresholdConfig("cost", fn_cost=20.0),
        thresholds.ThresholdConfig("recall_target", recall_target=0.5),
        thresholds.ThresholdConfig("manual"),
    ):
        row = thresholds.select_threshold(df, "p_a", config, grid=grid)
        table = row if table is None else table.unionByName(row)
    return rounded(table)


_COSTS = [1.0, 5.0, 10.0, 20.0, 50.0]


@query(
    "t06_cost_sweep",
    with_sql(
        " UNION ALL ".join(
            f"SELECT * FROM (SELECT {c}e0 AS fn_cost, {r6('threshold', 'threshold')},"
            f" {r6('precision', 'precision')}, {r6('recall', 'recall')}, {r6(_cost(c), 'cost')}"
            f" FROM grid ORDER BY {_cost(c)}, grid.threshold LIMIT 1)"
            for c in _COSTS
        ),
        _VAL_GRID,
    ),
)
def cost_sweep(spark, sf_dir):
    return rounded(thresholds.cost_sweep(_val_grid(spark, sf_dir), _COSTS))


_TARGETS = [0.3, 0.5, 0.6, 0.8]


@query(
    "t06_recall_sweep",
    with_sql(
        " UNION ALL ".join(
            f"SELECT * FROM (SELECT {t}e0 AS recall_target, {r6('threshold', 'threshold')},"
            f" {r6('precision', 'precision')}, {r6('recall', 'recall')}"
            f" FROM grid WHERE recall >= {t}e0 ORDER BY grid.precision DESC, grid.threshold LIMIT 1)"
            for t in _TARGETS
        ),
        _VAL_GRID,
    ),
)
def recall_sweep(spark, sf_dir):
    return rounded(thresholds.recall_sweep(_val_grid(spark, sf_dir), _TARGETS))


@query(
    "k04_best_threshold",
    with_sql(
        f"SELECT {r6('threshold', 'threshold')}, {r6(_F1_OF, 'f1')} FROM grid"
        f" ORDER BY {_F1_OF} DESC, grid.threshold LIMIT 1",
        grid_ctes("p_a"),
    ),
)
def best_threshold(spark, sf_dir):
    p, r = F.col("precision"), F.col("recall")
    best = thresholds.for_max_f1(metrics.pr_grid(_curve(spark, sf_dir)))
    return rounded(best.select("threshold", metrics.ratio(2.0 * p * r, p + r).alias("f1")))


@query(
    "k03_preview",
    with_sql("SELECT row_id, p_a, label_1 FROM counts ORDER BY p_a DESC, row_id LIMIT 20"),
)
def preview(spark, sf_dir):
    df = counts(spark, sf_dir).select(ROW_ID, "p_a", LABEL)
    return df.orderBy(F.desc("p_a"), ROW_ID).limit(20)
