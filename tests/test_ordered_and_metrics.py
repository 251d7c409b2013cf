import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rareflow.operators import metrics, thresholds
from rareflow.operators.ordered import (
    _quantiles_by_rank,
    exact_quantiles,
    range_cuts,
    running_sums,
)


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "label_1 int, s double")


def brute_ap(pairs):
    pos = sum(y for y, _ in pairs)
    area, last = 0.0, 0.0
    for t in sorted({s for _, s in pairs}, reverse=True):
        hit = [y for y, s in pairs if s >= t]
        area += (sum(hit) / pos - last) * sum(hit) / len(hit)
        last = sum(hit) / pos
    return area


def brute_auc(pairs):
    p = [s for y, s in pairs if y]
    n = [s for y, s in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))


MICRO = [(0, 0.1), (0, 0.2), (1, 0.9), (1, 0.8), (0, 0.3), (1, 0.4)]
rng = np.random.default_rng(0)
TIED = [(int(y), float(s)) for y, s in zip(rng.random(400) < 0.2, rng.integers(0, 25, 400) / 25)]


@pytest.mark.parametrize("pairs", [MICRO, TIED])
def test_ranking_metrics_match_brute_force(spark, pairs):
    row = metrics.ranking_metrics(metrics.score_curve(scored(spark, pairs), "s")).first()
    assert row["pr_auc"] == pytest.approx(brute_ap(pairs), abs=1e-12)
    assert row["roc_auc"] == pytest.approx(brute_auc(pairs), abs=1e-12)


@pytest.mark.parametrize("per_range", [1, 7, 50, 1000])
def test_curve_does_not_depend_on_the_ranges(spark, per_range):
    df = scored(spark, TIED)
    cuts = range_cuts(df, "s", rows_per_range=per_range)
    curve = metrics.curve_of_counts(metrics.score_counts(df, "s"), cuts=cuts)
    rows = {r["threshold"]: (r["tp"], r["fp"], r["n_pos"], r["n_neg"]) for r in curve.collect()}
    n_pos = sum(y for y, _ in TIED)
    for t in {s for _, s in TIED}:
        tp = sum(y for y, s in TIED if s >= t)
        assert rows[t] == (tp, sum(s >= t for _, s in TIED) - tp, n_pos, len(TIED) - n_pos)


def test_metric_record_micro_case(spark):
    curve = metrics.score_curve(scored(spark, MICRO), "s")
    r = metrics.metric_record(curve, 0.5).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (3, 0, 1, 2)
    assert r["precision"] == 1.0 and r["recall"] == pytest.approx(2 / 3)
    assert r["f1"] == pytest.approx(0.8)
    assert r["mcc"] == pytest.approx((2 * 3) / math.sqrt(2 * 3 * 3 * 4))


def test_one_class_gives_nan_and_zero(spark):
    curve = metrics.score_curve(scored(spark, [(0, 0.2), (0, 0.7)]), "s")
    r = metrics.metric_record(curve, 0.9).first()
    assert math.isnan(r["pr_auc"]) and math.isnan(r["roc_auc"])
    assert r["precision"] == r["recall"] == r["f1"] == r["mcc"] == 0.0


def test_average_precision_is_rank_based(spark):
    squashed = [(y, s**3 / 2) for y, s in TIED]
    a, b = (
        metrics.ranking_metrics(metrics.score_curve(scored(spark, p), "s")).first()["pr_auc"]
        for p in (TIED, squashed)
    )
    assert a == pytest.approx(b, abs=1e-12)


def test_running_sums_per_key_ascending(spark):
    rows = [(k, float(v), v + 1) for k in "ab" for v in range(40)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    out = running_sums(df, "v", ["n"], ["k"], descending=False, cuts=[3.0, 11.5, 30.0])
    for r in out.collect():
        v = int(r["v"])
        assert r["cum_n"] == (v + 1) * (v + 2) // 2 and r["all_n"] == 40 * 41 // 2


@pytest.mark.parametrize("probabilities", [[0.01, 0.25, 0.5, 0.99], [i / 50 for i in range(51)]])
def test_quantiles_match_numpy(spark, probabilities):
    data = np.concatenate([np.zeros(60), rng.integers(0, 9, 90), rng.random(51) * 3]).tolist()
    df = spark.createDataFrame([(v, -v) for v in data], "a double, b double")
    want = {"a": np.quantile(data, probabilities), "b": np.quantile([-v for v in data], probabilities)}
    plain = exact_quantiles(df, ["a", "b"], probabilities)
    ranged = _quantiles_by_rank(df, ["a", "b"], probabilities, cuts=[-2.0, -0.5, 0.0, 1.0, 4.0])
    assert plain == ranged
    for c in "ab":
        assert plain[c] == pytest.approx(list(want[c]), abs=1e-9)


def test_quantiles_and_ranks_of_odd_values(spark):
    """NaN, null, signed zeros and a one-value column: the same with and without ranges."""
    values = [float("nan"), None, -0.0, 0.0, 2.0, 2.0, -1.0]
    df = spark.createDataFrame([(v, 3.0) for v in values], "a double, b double")
    plain = exact_quantiles(df, ["a", "b"], [0.0, 0.5, 1.0])
    assert plain == _quantiles_by_rank(df, ["a", "b"], [0.0, 0.5, 1.0], cuts=[-0.5, 0.0, 1.0, 3.0])
    assert plain == {"a": [-1.0, 0.0, 2.0], "b": [3.0, 3.0, 3.0]}
    counts = df.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    told = lambda cuts, down: sorted(
        (str(r["a"]), r["cum_n"], r["all_n"]) for r in running_sums(counts, "a", ["n"], [], down, cuts).collect()
    )
    for down in (True, False):
        assert told([], down) == told([-0.5, 0.0, 1.0], down)


def grid_of(spark, pairs):
    return metrics.pr_grid(metrics.score_curve(scored(spark, pairs), "s"))


def test_thresholds_match_brute_force(spark):
    grid = grid_of(spark, TIED)
    points = [(r["threshold"], r["precision"], r["recall"], r["tp"], r["fp"]) for r in grid.collect()]
    points.sort()
    f1 = lambda p: 2 * p[1] * p[2] / (p[1] + p[2]) if p[1] + p[2] else 0.0
    assert thresholds.for_max_f1(grid).first()["threshold"] == max(points, key=f1)[0]
    n_pos = sum(y for y, _ in TIED)
    n_neg = len(TIED) - n_pos
    cost = lambda p: 10 * (n_pos - p[3]) + (p[4] if p[1] > 0 else n_neg)
    assert thresholds.for_min_cost(grid).first()["threshold"] == min(points, key=cost)[0]
    ok = [p for p in points if p[2] >= 0.5]
    best = thresholds.for_recall_target(grid, 0.5).first()
    assert best["threshold"] == max(ok, key=lambda p: p[1])[0] and best["note"] == ""


def test_infeasible_target_takes_the_lowest_threshold(spark):
    row = thresholds.for_recall_target(grid_of(spark, TIED), 0.9, 0.99).first()
    assert row["threshold"] == min(s for _, s in TIED) and row["note"]


def test_higher_miss_cost_never_raises_the_threshold(spark):
    rows = thresholds.cost_sweep(grid_of(spark, TIED), [1.0, 5.0, 20.0]).orderBy("fn_cost").collect()
    picks = [r["threshold"] for r in rows]
    assert picks == sorted(picks, reverse=True)


def test_unknown_mode_is_an_error(spark):
    with pytest.raises(ValueError):
        thresholds.select_threshold(scored(spark, MICRO), "s", thresholds.ThresholdConfig("best"))


def test_recall_falls_with_the_threshold(spark):
    rows = grid_of(spark, TIED).orderBy("threshold").collect()
    recalls = [r["recall"] for r in rows]
    assert recalls == sorted(recalls, reverse=True)


def test_thin_curve_keeps_real_points(spark):
    grid = grid_of(spark, TIED).select("threshold", "precision", "recall")
    thin = metrics.thin_curve(grid, 10)
    assert thin.count() <= 11
    assert thin.join(grid, thin.columns, "left_anti").count() == 0


def test_weights(spark):
    df = scored(spark, [(1, 0.0)] + [(0, 0.0)] * 3)
    got = metrics.with_balanced_weight(df).agg(F.sum("weight"), F.max("weight")).first()
    assert tuple(got) == pytest.approx((4.0, 2.0))
    assert metrics.with_imbalance_weight(df).agg(F.max("weight")).first()[0] == 3.0
