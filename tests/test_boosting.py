"""Boosters, searches and pooled calibration against work by hand."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from rareflow.functions import scores
from rareflow.operators import boosting, calibration, latent, learners
from rareflow.operators.metrics import average_precision, score_counts, score_curve
from rareflow.operators.splits import assign_folds, part
from rareflow.plans import experiment, recipes, search
from rareflow.schema import COUNT_COLUMNS, LABEL, ROW_ID
from rareflow.session import drop_stage, stage_table


@pytest.fixture(scope="module")
def train(split):
    return stage_table(part(split, "train"))


def vectors(df):
    rows = VectorAssembler(inputCols=COUNT_COLUMNS, outputCol="_x").transform(df)
    return rows.select("_x", F.col(LABEL).cast("double").alias("_y"), F.lit(1.0).alias("_w"))


def test_leaves_carry_the_penalty(train):
    """-sum(g) / (sum(h) + penalty), from sums grouped by leaf."""
    margin = F.lit(-2.0)
    loss = boosting.log_loss()
    rows = vectors(train).withColumn("_h", loss.bend(margin, F.col("_y")))
    rows = rows.withColumn("_t", -loss.slope(margin, F.col("_y")) / F.col("_h"))
    tree = DecisionTreeRegressor(
        featuresCol="_x", labelCol="_t", weightCol="_h", maxDepth=3, leafCol="leaf", predictionCol="plain"
    ).fit(rows)
    penalised = boosting.with_penalty(tree, 2.5).setFeaturesCol("_x").setPredictionCol("step")
    met = penalised.transform(tree.transform(rows).drop("_prediction"))
    sums = met.groupBy("leaf").agg(
        F.sum("_h").alias("h"),
        F.sum(F.col("_h") * F.col("_t")).alias("g"),
        F.min("step").alias("low"),
        F.max("step").alias("high"),
        F.first("plain").alias("plain"),
    )
    told = sums.collect()
    assert len(told) > 2
    for r in told:
        assert r.low == r.high == pytest.approx(r.g / (r.h + 2.5))
        assert r.plain == pytest.approx(r.g / r.h)


def test_picked_features_keep_their_numbers(train):
    rows = vectors(train)
    model, _ = boosting.boost(rows, boosting.log_loss(), 3, 0.3, 3, 32, penalty=1.0, column_share=0.4, row_share=0.7)
    assert model.getNumTrees == 3
    assert model.transform(rows.withColumnRenamed("_x", model.getFeaturesCol())).count() == rows.count()


def test_boosters_differ_in_more_than_presets(train):
    one = {"learning_rate": 0.3, "max_depth": 3, "depth": 3, "n_estimators": 4, "iterations": 4, "min_child_samples": 1}
    means = set()
    for name in ("lightgbm", "xgboost", "catboost"):
        params = {k: v for k, v in one.items() if k != "max_depth" or name != "catboost"}
        scored = learners.LEARNERS[name].fit(train, COUNT_COLUMNS, **params).with_score(train, "p")
        means.add(round(scored.agg(F.avg("p")).first()[0], 9))
    assert len(means) == 3
    assert all("reg_lambda" in learners.LEARNERS[n].distributions for n in ("lightgbm", "xgboost"))
    assert "l2_leaf_reg" in learners.LEARNERS["catboost"].distributions


def test_focal_slope_is_the_derivative(spark):
    step = 1e-5
    rows = spark.createDataFrame([(m / 4, y) for m in range(-24, 25) for y in (0, 1)], "m double, y int")
    m, y = F.col("m"), F.col("y")
    loss = lambda x: scores.focal_loss(x, y, 2.0, 0.25)
    told = rows.select(
        ((loss(m + step) - loss(m - step)) / (2 * step)).alias("by_difference"),
        scores.focal_slope(m, y, 2.0, 0.25).alias("slope"),
        scores.focal_bend(m, y, 2.0, 0.25).alias("bend"),
    ).collect()
    for r in told:
        assert r.slope == pytest.approx(r.by_difference, abs=1e-6)
        assert r.bend > 0


def test_focal_boosting_lowers_its_loss(train):
    rows = vectors(train)
    loss = boosting.focal_exact(2.0, 0.25)
    model, init = boosting.boost(rows, loss, 12, 0.3, 3, 64, guarded=True)
    stepped = model.setFeaturesCol("_x").setPredictionCol("_s").transform(rows)
    before, after, low, high = stepped.agg(
        F.avg(loss.value(F.lit(init), F.col("_y"))),
        F.avg(loss.value(F.lit(init) + F.col("_s"), F.col("_y"))),
        F.min("_s"),
        F.max("_s"),
    ).first()
    assert after < 0.8 * before and high > low
    assert all(w in [0.3 / 2**k for k in range(boosting.HALVINGS + 1)] for w in model.treeWeights)


def test_staged_margins_change_nothing(train):
    rows = vectors(train)
    models = [boosting.boost(rows, boosting.focal_terms(2.0, 0.25), 5, 0.2, 2, 32, stage_every=k)[0] for k in (2, 100)]
    a, b = (m.setFeaturesCol("_x").setPredictionCol("_s").transform(rows).select("_s").toPandas()["_s"] for m in models)
    assert np.allclose(np.sort(a), np.sort(b))


# ------------------------------------------------------------------ isotonic


def by_max_min(rows):
    """The largest over the left of the smallest mean to the right."""
    out = []
    for k in range(len(rows)):
        means = []
        for i in range(k + 1):
            means.append(min(sum(p for _, p, _ in rows[i : j + 1]) / sum(n for _, _, n in rows[i : j + 1]) for j in range(k, len(rows))))
        out.append(max(means))
    return out


@pytest.mark.parametrize(("parts", "ways"), [(1, 16), (7, 2), (7, 3)])
def test_pooled_blocks_are_those_of_all_rows(spark, parts, ways):
    rng = np.random.default_rng(parts)
    rows = [(float(s), int(rng.integers(0, 4)), 4) for s in rng.permutation(60)]
    counts = spark.createDataFrame(rows, "score double, pos long, n long")
    blocks = calibration.isotonic_blocks(counts, ways, parts).orderBy("low").collect()
    rows = sorted(rows)
    want = by_max_min(rows)
    assert all(a.pos / a.n < b.pos / b.n for a, b in zip(blocks, blocks[1:], strict=False))
    for (s, _, _), w in zip(rows, want, strict=True):
        own = [b for b in blocks if b.low <= s <= b.high]
        assert len(own) == 1 and own[0].pos / own[0].n == pytest.approx(w)


def test_isotonic_of_nothing(spark):
    counts = spark.createDataFrame([], "score double, pos long, n long")
    fitted = calibration.fit_isotonic(counts)
    rows = spark.createDataFrame([(0.3,)], "s double")
    assert fitted.apply(rows, "s", "p").first().p == 0.0


# ------------------------------------------------------------------ search


def one_by_one(train, learner, recipe, candidates, n_folds):
    """Every fold and candidate for itself."""
    folded = assign_folds(train, n_folds)
    out = {}
    for k in range(n_folds):
        fitted, prepared = recipe.fit_transform(folded.filter(F.col("fold") != k).drop("fold"), COUNT_COLUMNS)
        val = fitted.transform(folded.filter(F.col("fold") == k).drop("fold"))
        for i, params in enumerate(candidates):
            scorer = learner.fit(prepared.select(LABEL, *fitted.columns), fitted.columns, **params)
            curve = score_curve(scorer.with_score(val, "_p"), "_p")
            out[i, k] = curve.agg(average_precision()).first()[0]
    return out


@pytest.mark.parametrize("mode", ["raw", "target"])
def test_one_curve_per_fold_gives_the_same_scores(train, mode):
    rows = train.select(ROW_ID, LABEL, *COUNT_COLUMNS)
    learner, recipe = learners.LEARNERS["logreg"], recipes.FeatureRecipe(mode)
    candidates = [{"C": 0.01}, {"C": 1.0}]
    want = one_by_one(rows, learner, recipe, candidates, 2)
    got = search.cross_validate(rows, COUNT_COLUMNS, learner, recipe, candidates, n_folds=2).collect()
    assert {(r.candidate, r.fold): r.score for r in got} == pytest.approx(want, abs=1e-6)


def test_searches_share_folds_and_remove_them(spark, train):
    import os

    rows = train.select(ROW_ID, LABEL, *COUNT_COLUMNS)
    folds = search.stage_folds(rows, COUNT_COLUMNS, recipes.FeatureRecipe("raw"), 2)
    path = folds.rows._stage_path.removeprefix("file:")
    for c in (0.1, 1.0):
        found = search.search(
            rows, COUNT_COLUMNS, learners.LEARNERS["logreg"], recipes.FeatureRecipe("raw"), n_folds=2,
            candidates=[{"C": c}], staged=folds,
        )
        assert found.best_params == {"C": c} and os.path.isdir(path)
    folds.remove()
    assert not os.path.exists(path)


def test_ranges_may_be_narrowed():
    learner = learners.LEARNERS["xgboost"]
    drawn = search.random_candidates(learner, 20, ranges={"n_estimators": ("int", 3, 6)})
    assert {c["n_estimators"] for c in drawn} <= {3, 4, 5} and len({c["learning_rate"] for c in drawn}) == 20
    assert all(1e-3 <= c["reg_lambda"] <= 10.0 and 0.6 <= c["subsample"] <= 1.0 for c in drawn)
    assert len({c["reg_lambda"] for c in search.random_candidates(learner, 20)}) == 20


# ------------------------------------------------------------------ forests, interactions


def test_importance_grows_in_batches(train, monkeypatch):
    # Which rows a tree draws hangs on their order.
    monkeypatch.setattr(learners, "spread", lambda df: df)
    table = learners.forest_importance(train, COUNT_COLUMNS, n_estimators=6, max_depth=4, batch=4).collect()
    rows = stage_table(learners._training_rows(train, COUNT_COLUMNS, LABEL, "balanced"))
    parts = [
        n * learners._forest(rows, {"n_estimators": n, "max_depth": 4}, 42 + at).featureImportances.toArray()
        for at, n in ((0, 4), (4, 2))
    ]
    want = dict(zip(COUNT_COLUMNS, (sum(parts) / sum(parts).sum()).tolist(), strict=True))
    assert {r.feature: r.importance for r in table} == pytest.approx(want, abs=1e-6)
    assert math.isclose(sum(want.values()), 1.0)


def test_width_of_interactions(train):
    fitted = recipes.FeatureRecipe("ix_raw", interaction_width=3).fit(train, COUNT_COLUMNS)
    assert len(fitted.columns) == len(COUNT_COLUMNS) + 3


def test_counts_of_one_class_are_scored(spark):
    counts = score_counts(spark.createDataFrame([(0.2, 0), (0.4, 0)], "p double, label_1 int"), "p")
    staged = stage_table(counts)
    assert calibration.isotonic_blocks(staged).collect()[0].pos == 0
    drop_stage(staged)


# ------------------------------------------------------------------ nets, clusters


def test_best_slice_is_kept(train):
    net = latent.HiddenLayerEmbedding(embedding_dim=4, hidden1=6, hidden2=5, max_iter=12, slices=4, holdout=0.3, patience=9)
    fitted = net.fit(train, COUNT_COLUMNS)
    held = [h for h, _ in fitted.history]
    assert len(held) == 4 and held[fitted.best] == max(held) and held.index(max(held)) == fitted.best
    assert fitted.overfit_gap() == pytest.approx(fitted.history[fitted.best][1] - max(held))
    alone = latent.HiddenLayerEmbedding(embedding_dim=4, hidden1=6, hidden2=5, max_iter=5, holdout=0.0).fit(train, COUNT_COLUMNS)
    assert len(alone.history) == 1


def test_periodic_inputs_reach_the_net(spark, train, tmp_path):
    """The emitted layer is that of the net on scaled inputs, sines and cosines; saved and reloaded it is the same."""
    settings = {"embedding_dim": 3, "hidden1": 5, "hidden2": 4, "max_iter": 4, "slices": 2, "periodic": 2}
    fitted = recipes.FeatureRecipe("engineered_nnembed", settings).fit(train, COUNT_COLUMNS)
    fitted.save(spark, str(tmp_path / "r"))
    again = recipes.load_recipe(spark, str(tmp_path / "r"))
    a, b = (r.transform(train).select(ROW_ID, *fitted.columns) for r in (fitted, again))
    assert a.exceptAll(b).count() == 0
    net = latent.HiddenLayerEmbedding(embedding_dim=3, hidden1=5, hidden2=4, max_iter=4, slices=2, periodic=2)
    own = net.fit(train, COUNT_COLUMNS)
    row = train.first()
    z = [(row[c] - own.scaler.moments[c][0]) / own.scaler.moments[c][1] for c in COUNT_COLUMNS]
    x = [*z, *[f(2 * math.pi * c * v) for v, cs in zip(z, own.frequencies, strict=True) for c in cs for f in (math.sin, math.cos)]]
    for w, bias in own.matrices()[:-1]:
        x = 1 / (1 + np.exp(-(w @ np.array(x) + bias)))
    got = own.transform(train.filter(F.col(ROW_ID) == row[ROW_ID])).first()
    assert [got[f"nn_{i}"] for i in range(3)] == pytest.approx(list(x))
    scorer = learners.LEARNERS["tensorflow_dnn"].fit(train, COUNT_COLUMNS, max_iter=3, periodic=2)
    scorer.save(spark, str(tmp_path / "m"))
    reloaded = learners.load_scorer(spark, str(tmp_path / "m"))
    assert scorer.with_score(train, "p").select(ROW_ID, "p").exceptAll(reloaded.with_score(train, "p").select(ROW_ID, "p")).count() == 0


def test_sweep_halves_its_field(split):
    table = experiment.architecture_sweep(
        split, [(6, 4), (5, 4), (4, 3)], embedding={"max_iter": 6, "slices": 2, "embedding_dim": 3, "holdout": 0.3}
    ).collect()
    assert sorted(r.slices for r in table) == [1, 2, 2]
    assert [r.chosen for r in table].count(True) == 1
    best = max((r for r in table if r.slices == 2), key=lambda r: r.holdout_ap)
    assert best.chosen


def test_all_restarts_in_one_pass(spark):
    """The same best cost as ten runs, one after the other."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(m, 1.0, (150, 3)) for m in (0.0, 6.0)])
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "_z0 double, _z1 double, _z2 double")
    centres = learners.two_means(stage_table(df), ["_z0", "_z1", "_z2"], 10, 1)
    own = ((points[:, None] - np.array(centres)[None]) ** 2).sum(axis=2).min(axis=1).sum()
    best = np.inf
    for seed in range(10):
        c = points[np.random.default_rng(seed).choice(300, 2, replace=False)]
        for _ in range(30):
            at = ((points[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([points[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(2)])
        best = min(best, ((points[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum())
    assert own == pytest.approx(best)
