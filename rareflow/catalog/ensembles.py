"""Queries: blending, calibration, stacking, comparison reports and unions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..functions.scores import sigmoid, weighted_mean
from ..operators import blend, calibration, metrics, thresholds
from ..operators.features import FeatureEngineer
from ..operators.frames import append_columns, scores_long, scores_side_by_side
from ..operators.ordered import range_cuts
from ..operators.splits import assign_folds, holdout_split, part
from ..plans import reports
from ..plans.bundles import BlendBundle, predict
from ..plans.experiment import ExperimentConfig, _evaluate
from ..plans.search import candidate_means
from ..schema import LABEL, ROW_ID
from ..session import stage_table
from .base import (
    AP_SQL,
    AUC_SQL,
    F1_SQL,
    HOLDOUT_SQL,
    MCC_SQL,
    PRECISION_SQL,
    RECALL_SQL,
    counts,
    grid_ctes,
    query,
    r6,
    rounded,
    staged_counts,
    with_sql,
)
from .metrics import validation

VAL_SQL = HOLDOUT_SQL + ", val AS (SELECT * FROM parts WHERE split = 'val')"
PAIR = ["p_a", "p_b"]


@dataclass
class FixedLinear:
    """A scorer with given coefficients, so that whatever consumes it can be checked by SQL."""

    name: str
    intercept: float
    weights: dict[str, float]
    threshold: float = 0.3
    threshold_mode: str = "manual"
    mode: str = "raw"

    @property
    def inputs(self):
        return list(self.weights)

    def with_score(self, df, out="p"):
        z = F.lit(self.intercept)
        for c, w in self.weights.items():
            z = z + F.lit(w) * F.col(c)
        return df.withColumn(out, F.round(sigmoid(z), 6))


MODEL_A = FixedLinear(
    "linear_a",
    -5.0,
    {"num_links": 0.9, "num_urgent_keywords": 1.1, "num_spelling_errors": 0.3, "num_words": -0.004},
)
MODEL_B = FixedLinear("linear_b", -4.0, {"num_links": 0.5, "num_urgent_keywords": 0.8})


# ------------------------------------------------------------------ blending

@query(
    "a18_blend_mean",
    with_sql(
        "SELECT row_id, round(p_a * 0.5e0 + p_b * 0.5e0, 9) + 0.0 AS p_equal,"
        " round(p_a * 0.75e0 + p_b * 0.25e0, 9) + 0.0 AS p_weighted FROM counts"
    ),
)
def blend_mean(spark, sf_dir):
    # Means of 6-digit scores need more digits, or they sit on rounding ties.
    return rounded(
        counts(spark, sf_dir).select(
            ROW_ID,
            weighted_mean(PAIR).alias("p_equal"),
            weighted_mean(PAIR, [3.0, 1.0]).alias("p_weighted"),
        ),
        9,
    )


@query("j03_score_matrix", with_sql("SELECT row_id, label_1, p_a AS p_m1, p_b AS p_m2 FROM counts"))
def score_matrix(spark, sf_dir):
    long = scores_long(counts(spark, sf_dir), {"m1": "p_a", "m2": "p_b"}, [ROW_ID, LABEL])
    return scores_side_by_side(long, ["m1", "m2"], [ROW_ID, LABEL])


@query(
    "j02_append_columns",
    with_sql(f"SELECT row_id, num_words, num_links, {r6('ln(1e0 + num_words)', 'log_num_words')} FROM counts"),
)
def appended(spark, sf_dir):
    df = counts(spark, sf_dir)
    left = df.select(ROW_ID, "num_words", "num_links")
    right = df.select(ROW_ID, F.log1p(F.col("num_words").cast("double")).alias("log_num_words"))
    return rounded(append_columns(left, right))


def weights_sql(n_models: int) -> str:
    rows = ", ".join(
        f"({i}, {', '.join(f'CAST({x!r} AS DOUBLE)' for x in w)})"
        for i, w in enumerate(blend.weight_vectors(n_models))
    )
    names = ", ".join(f"w{i}" for i in range(n_models))
    return f", weights AS (SELECT * FROM (VALUES {rows}) AS t(weight_id, {names}))"


def weight_ap_sql(columns: list[str], source: str = "val") -> str:
    score = " + ".join(f"w{i} * {c}" for i, c in enumerate(columns))
    return f""",
wb AS (SELECT weight_id, {score} AS score, CAST(sum(label_1) AS BIGINT) AS pos, count(*) AS n
       FROM weights CROSS JOIN {source} GROUP BY 1, 2),
wc AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY weight_id) AS n_pos
       FROM wb WINDOW w AS (PARTITION BY weight_id ORDER BY score DESC)),
wap AS (SELECT weight_id, sum(CAST(pos AS DOUBLE) / n_pos * (CAST(tp AS DOUBLE) / seen)) AS ap FROM wc GROUP BY 1)"""


@query(
    "j06_weight_grid",
    with_sql(
        f"SELECT weight_id, count(*) AS n_rows, {r6('sum(w0 * p_a + w1 * p_b)', 'total')}"
        " FROM weights CROSS JOIN counts GROUP BY 1",
        weights_sql(2),
    ),
)
def weight_grid(spark, sf_dir):
    vectors = dict(enumerate(blend.weight_vectors(2)))
    rows = blend.blended(blend.score_tuples(staged_counts(spark, sf_dir), PAIR), PAIR, vectors)
    return rounded(
        rows.groupBy("weight_id").agg(
            F.sum("n").alias("n_rows"), F.sum(F.col("score") * F.col("n")).alias("total")
        )
    )


@query(
    "t09_weight_scores",
    with_sql(
        f"SELECT weight_id, {r6('ap', 'ap')} FROM wap",
        VAL_SQL + weights_sql(2) + weight_ap_sql(PAIR),
    ),
)
def weight_scores(spark, sf_dir):
    return rounded(blend.weight_scores(validation(spark, sf_dir), PAIR))


_P_C = "round(1e0 / (1e0 + exp(-(-3e0 + 0.6e0 * num_spelling_errors + 0.4e0 * num_email_addresses))), 6)"
_VAL3 = HOLDOUT_SQL + f", val AS (SELECT *, {_P_C} AS p_c FROM parts WHERE split = 'val')"
TRIPLE = [*PAIR, "p_c"]


def _validation3(spark, sf_dir):
    df = staged_counts(spark, sf_dir)
    third = FixedLinear("c", -3.0, {"num_spelling_errors": 0.6, "num_email_addresses": 0.4})
    scored = third.with_score(df, "p_c").select(ROW_ID, LABEL, *TRIPLE)
    return part(holdout_split(scored), "val")


@query(
    "t09_weight_scores_three_models",
    with_sql(
        f"SELECT weight_id, {r6('ap', 'ap')} FROM wap",
        _VAL3 + weights_sql(3) + weight_ap_sql(TRIPLE),
    ),
)
def weight_scores3(spark, sf_dir):
    return rounded(blend.weight_scores(_validation3(spark, sf_dir), TRIPLE))


@query(
    "t09_best_weights",
    with_sql(
        f"SELECT {r6('w0', 'w_a')}, {r6('w1', 'w_b')}, {r6('w2', 'w_c')}, {r6('ap', 'pr_auc')}"
        " FROM wap JOIN weights USING (weight_id) ORDER BY ap DESC, weight_id LIMIT 1",
        _VAL3 + weights_sql(3) + weight_ap_sql(TRIPLE),
    ),
)
def best_weights(spark, sf_dir):
    best = blend.optimize_weights(_validation3(spark, sf_dir), TRIPLE)
    row = [(*best.weights, best.pr_auc)]
    return rounded(spark.createDataFrame(row, "w_a double, w_b double, w_c double, pr_auc double"))


@query(
    "t10_blend_model",
    with_sql(
        f"SELECT row_id, {r6('p_a * 0.6e0 + p_b * 0.4e0', 'p')},"
        " CAST(p_a * 0.6e0 + p_b * 0.4e0 >= 0.25e0 AS INTEGER) AS pred FROM counts"
    ),
)
def blend_model(spark, sf_dir):
    model = BlendBundle([MODEL_A, MODEL_B], [0.6, 0.4], threshold=0.25)
    scored = predict(counts(spark, sf_dir).drop("p_a", "p_b"), model)
    return rounded(scored.select(ROW_ID, "p", "pred"))


def record_sql(source: str, grid: str, threshold: str, keys: str) -> str:
    """Metric record of ``score`` rows in ``source`` whose curve is ``grid``."""
    return f"""SELECT {keys}, {r6('t', 'threshold')}, {r6('pr_auc', 'pr_auc')}, {r6('roc_auc', 'roc_auc')},
      {r6(PRECISION_SQL, 'precision')}, {r6(RECALL_SQL, 'recall')}, {r6(F1_SQL, 'f1')}, {r6(MCC_SQL, 'mcc')},
      tn, fp, fn, tp, n_samples, n_positives
    FROM (SELECT max(t) AS t, count(CASE WHEN label_1 = 0 AND score < t THEN 1 END) AS tn,
            count(CASE WHEN label_1 = 0 AND score >= t THEN 1 END) AS fp,
            count(CASE WHEN label_1 = 1 AND score < t THEN 1 END) AS fn,
            count(CASE WHEN label_1 = 1 AND score >= t THEN 1 END) AS tp,
            count(*) AS n_samples, count(CASE WHEN label_1 = 1 THEN 1 END) AS n_positives
          FROM {source} CROSS JOIN (SELECT {threshold} AS t) thr) counted
    CROSS JOIN (SELECT {AP_SQL} AS pr_auc, {AUC_SQL} AS roc_auc FROM {grid}) ranked"""


_BEST_F1 = (
    "(SELECT threshold FROM {grid} ORDER BY CASE WHEN precision + recall > 0 THEN"
    " 2e0 * precision * recall / (precision + recall) ELSE 0e0 END DESC, threshold LIMIT 1)"
)
_T12 = (
    VAL_SQL
    + weights_sql(2)
    + weight_ap_sql(PAIR)
    + """,
best AS (SELECT w0 / (w0 + w1) AS b0, w1 / (w0 + w1) AS b1
         FROM wap JOIN weights USING (weight_id) ORDER BY ap DESC, weight_id LIMIT 1),
bval AS (SELECT label_1, p_a * b0 + p_b * b1 AS score FROM parts, best WHERE split = 'val'),
btest AS (SELECT label_1, p_a * b0 + p_b * b1 AS score FROM parts, best WHERE split = 'test')"""
    + grid_ctes("score", "bval", "gval")
    + grid_ctes("score", "btest", "gtest")
)


@query(
    "t12_blend_build",
    with_sql(
        record_sql("bval", "gval", _BEST_F1.format(grid="gval"), "'val' AS split")
        + " UNION ALL "
        + record_sql("btest", "gtest", _BEST_F1.format(grid="gval"), "'test' AS split"),
        _T12,
    ),
)
def blend_build(spark, sf_dir):
    df = holdout_split(staged_counts(spark, sf_dir).select(ROW_ID, LABEL, *PAIR))
    best = blend.optimize_weights(part(df, "val"), PAIR)
    scored = blend.with_blend(df.filter(F.col("split") != "train"), PAIR, best.weights, "p")
    threshold, _, _, _ = _evaluate(scored, ExperimentConfig())
    curve = metrics.score_curve(scored, "p", keys=["split"])
    return rounded(metrics.metric_record(curve, threshold, keys=["split"]))


# ------------------------------------------------------------------ flagship

_SEGMENTS = " UNION ALL ".join(
    record_sql(f"seg{s}", f"g{s}", _BEST_F1.format(grid="grid"), f"CAST({s} AS INTEGER) AS short_email")
    for s in (0, 1)
)


@query(
    "t12_flagship_metrics",
    with_sql(
        _SEGMENTS,
        grid_ctes("p_a")
        + ", seg0 AS (SELECT label_1, p_a AS score FROM counts WHERE num_words >= 50)"
        + ", seg1 AS (SELECT label_1, p_a AS score FROM counts WHERE num_words < 50)"
        + grid_ctes("score", "seg0", "g0")
        + grid_ctes("score", "seg1", "g1"),
    ),
)
def flagship(spark, sf_dir):
    """Counts, engineered features, curve, best-F1 threshold, metrics per message length."""
    df = staged_counts(spark, sf_dir)
    engineered = FeatureEngineer().fit(part(holdout_split(df), "train")).transform(df)
    # Score counts per segment are the only thing both curves need.
    by_segment = stage_table(metrics.score_counts(engineered, "p_a", keys=["short_email"]))
    cuts = range_cuts(by_segment, "score")
    totals = by_segment.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    overall = metrics.curve_of_counts(totals, cuts=cuts)
    threshold = thresholds.for_max_f1(metrics.pr_grid(overall)).first()["threshold"]
    curve = metrics.curve_of_counts(by_segment, ["short_email"], cuts)
    return rounded(metrics.metric_record(curve, threshold, keys=["short_email"]))


# ------------------------------------------------------------------ calibration, stacking


@query("t07_sigmoid_calibration")
def sigmoid_calibration(spark, sf_dir):
    df = holdout_split(staged_counts(spark, sf_dir).select(ROW_ID, LABEL, "p_a"))
    fitted = calibration.fit_calibration(part(df, "val"), "p_a", "sigmoid")
    return rounded(fitted.apply(part(df, "test"), "p_a", "p"))


#: The best non-decreasing rate at each score is the largest over its left of the smallest mean to its right.
_ISOTONIC_SQL = VAL_SQL + """,
iso AS (SELECT s, y, n, row_number() OVER (ORDER BY s) AS k, sum(y) OVER (ORDER BY s) AS cy, sum(n) OVER (ORDER BY s) AS cn
        FROM (SELECT p_a AS s, sum(label_1) AS y, count(*) AS n FROM val GROUP BY 1)),
runs AS (SELECT a.k AS i, b.k AS j, CAST(b.cy - a.cy + a.y AS DOUBLE) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS m
         FROM iso a JOIN iso b ON a.k <= b.k),
low AS (SELECT j, min(m) OVER (PARTITION BY i ORDER BY j DESC ROWS UNBOUNDED PRECEDING) AS m FROM runs),
knots AS (SELECT s, p FROM iso JOIN (SELECT j, max(m) AS p FROM low GROUP BY 1) ON j = k),
near AS (SELECT DISTINCT p_a, (SELECT max(s) FROM knots WHERE s <= p_a) AS ls, (SELECT arg_max(p, s) FROM knots WHERE s <= p_a) AS lp,
         (SELECT min(s) FROM knots WHERE s >= p_a) AS hs, (SELECT arg_min(p, s) FROM knots WHERE s >= p_a) AS hp
         FROM parts WHERE split = 'test')"""


@query(
    "t08_isotonic_calibration",
    with_sql(
        f"SELECT row_id, label_1, p_a, {r6('CASE WHEN ls IS NULL THEN hp WHEN hs IS NULL OR hs = ls THEN lp ELSE lp + (hp - lp) * (p_a - ls) / (hs - ls) END', 'p')}"
        " FROM parts JOIN near USING (p_a) WHERE split = 'test'",
        _ISOTONIC_SQL,
    ),
)
def isotonic_calibration(spark, sf_dir):
    df = holdout_split(staged_counts(spark, sf_dir).select(ROW_ID, LABEL, "p_a"))
    fitted = calibration.fit_calibration(part(df, "val"), "p_a", "isotonic")
    return rounded(fitted.apply(part(df, "test"), "p_a", "p"))


@query("t11_stacking")
def stacking(spark, sf_dir):
    df = holdout_split(staged_counts(spark, sf_dir).select(ROW_ID, LABEL, *PAIR))
    stacker = calibration.fit_stacker(part(df, "val"), ["a", "b"], PAIR)
    return rounded(stacker.apply(part(df, "test"), PAIR, "p"))


# ------------------------------------------------------------------ candidates and reports

_MODELS = {"m1": "p_a", "m2": "p_b", "m3": "p_mix"}
_FOLD_SCORES = """,
folded AS (SELECT *, p_a * 0.5e0 + p_b * 0.5e0 AS p_mix,
             CAST(ntile(5) OVER (PARTITION BY label_1 ORDER BY h, row_id) - 1 AS INTEGER) AS fold FROM counts),
long AS (SELECT 'm1' AS model, fold, label_1, p_a AS score FROM folded
         UNION ALL SELECT 'm2', fold, label_1, p_b FROM folded
         UNION ALL SELECT 'm3', fold, label_1, p_mix FROM folded),
lb AS (SELECT model, fold, score, CAST(sum(label_1) AS BIGINT) AS pos, count(*) AS n FROM long GROUP BY 1, 2, 3),
lc AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY model, fold) AS n_pos
       FROM lb WINDOW w AS (PARTITION BY model, fold ORDER BY score DESC)),
fold_ap AS (SELECT model, fold, sum(CAST(pos AS DOUBLE) / n_pos * (CAST(tp AS DOUBLE) / seen)) AS ap
            FROM lc GROUP BY 1, 2)"""


def _fold_scores(spark, sf_dir):
    """(model, fold, ap) of three given scores: all folds and models in one curve."""
    df = assign_folds(staged_counts(spark, sf_dir).select(ROW_ID, LABEL, *PAIR))
    df = blend.with_blend(df, PAIR, out="p_mix")
    long = scores_long(df, _MODELS, ["fold", LABEL])
    curve = metrics.score_curve(long, "p", keys=["model", "fold"])
    return curve.groupBy("model", "fold").agg(metrics.average_precision().alias("ap"))


@query("a17_fold_scores", with_sql(f"SELECT model, fold, {r6('ap', 'ap')} FROM fold_ap", _FOLD_SCORES))
def fold_scores(spark, sf_dir):
    return rounded(_fold_scores(spark, sf_dir))


@query(
    "a17_best_candidate",
    with_sql(
        f"SELECT model AS candidate, {r6('avg(ap)', 'mean_score')}, count(*) AS n_folds"
        " FROM fold_ap GROUP BY 1",
        _FOLD_SCORES,
    ),
)
def best_candidate(spark, sf_dir):
    scores = _fold_scores(spark, sf_dir).select(F.col("model").alias("candidate"), F.col("ap").alias("score"))
    return rounded(candidate_means(scores))


_CUT = 0.3
_RECORDS = HOLDOUT_SQL + "".join(
    f", {m}{s} AS (SELECT label_1, {e} AS score FROM parts WHERE split = '{s}')"
    + grid_ctes("score", f"{m}{s}", f"g{m}{s}")
    for m, e in (("m1", "p_a"), ("m2", "p_b"), ("m3", "p_a * 0.5e0 + p_b * 0.5e0"))
    for s in ("val", "test")
)
_RECORD_ROWS = " UNION ALL ".join(
    record_sql(f"{m}{s}", f"g{m}{s}", "0.3e0", f"'{m}' AS model, '{s}' AS split")
    for m in _MODELS
    for s in ("val", "test")
)


def _model_records(spark, sf_dir, models=None):
    df = holdout_split(staged_counts(spark, sf_dir).select(ROW_ID, LABEL, *PAIR))
    held_out = blend.with_blend(df.filter(F.col("split") != "train"), PAIR, out="p_mix")
    long = scores_long(held_out, models or _MODELS, ["split", LABEL])
    curve = metrics.score_curve(long, "p", keys=["model", "split"])
    return metrics.metric_record(curve, _CUT, keys=["model", "split"])


_r4 = lambda c: f"round({c}, 4) + 0.0"
_WIDE = (
    "SELECT model, CAST(NULL AS DOUBLE) AS cv_pr_auc,"
    f" {_r4('max(CASE WHEN split = ' + chr(39) + 'val' + chr(39) + ' THEN pr_auc END)')} AS val_pr_auc, "
    + ", ".join(
        f"{_r4(f'max(CASE WHEN split = {chr(39)}test{chr(39)} THEN {m} END)')} AS test_{m}"
        for m in ("pr_auc", "recall", "precision", "f1", "mcc")
    )
    + f", max(threshold) AS threshold FROM ({_RECORD_ROWS}) GROUP BY 1"
)


@query("k02_comparison_table", with_sql(_WIDE, _RECORDS))
def comparison(spark, sf_dir):
    return reports.comparison_table(reports.wide_metrics(_model_records(spark, sf_dir)))


@query(
    "k04_best_model",
    with_sql(f"SELECT model, test_pr_auc FROM ({_WIDE}) ORDER BY test_pr_auc DESC, model LIMIT 1", _RECORDS),
)
def best_model(spark, sf_dir):
    table = reports.comparison_table(reports.wide_metrics(_model_records(spark, sf_dir)))
    return reports.best_row(table).select("model", "test_pr_auc")


@query("u02_models_and_ensembles", with_sql(_WIDE, _RECORDS))
def models_and_ensembles(spark, sf_dir):
    singles = reports.wide_metrics(_model_records(spark, sf_dir, {"m1": "p_a", "m2": "p_b"}))
    ensembles = reports.wide_metrics(_model_records(spark, sf_dir, {"m3": "p_mix"}))
    return reports.comparison_table(singles.unionByName(ensembles))


@query(
    "k05_delta_report",
    with_sql(
        f"""SELECT 'fold_' || fold AS model, {r6("max(CASE WHEN model = 'm1' THEN ap END)", 'without_embedding')},
              {r6("max(CASE WHEN model = 'm3' THEN ap END)", 'with_embedding')},
              {r6("max(CASE WHEN model = 'm3' THEN ap END) - max(CASE WHEN model = 'm1' THEN ap END)", 'delta')}
            FROM fold_ap GROUP BY fold""",
        _FOLD_SCORES,
    ),
)
def delta_report(spark, sf_dir):
    condition = F.when(F.col("model") == "m1", "without_embedding").otherwise("with_embedding")
    rows = (
        _fold_scores(spark, sf_dir)
        .filter(F.col("model") != "m2")
        .select(
            condition.alias("condition"),
            F.concat(F.lit("fold_"), F.col("fold").cast("string")).alias("model"),
            F.col("ap").alias("test_pr_auc"),
        )
    )
    return rounded(reports.delta_report(rows))


@query("u01_classes_union", with_sql("SELECT row_id, num_words, num_links, label_1 FROM counts"))
def classes_union(spark, sf_dir):
    df = counts(spark, sf_dir).select(ROW_ID, "num_words", "num_links", LABEL)
    return df.filter(F.col(LABEL) == 0).unionByName(df.filter(F.col(LABEL) == 1))
