import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassificationModel  # noqa: F401
from pyspark.sql import functions as F

from rareflow.catalog.ensembles import MODEL_A, MODEL_B
from rareflow.functions import hashing
from rareflow.operators import blend, calibration, latent, learners
from rareflow.operators.metrics import score_curve, ranking_metrics
from rareflow.operators.splits import part
from rareflow.plans import caches, experiment, recipes, runlog, scoring, search, versions
from rareflow.plans.bundles import BlendBundle, ModelBundle
from rareflow.schema import COUNT_COLUMNS, LABEL, ROW_ID
from rareflow.sources.textfiles import write_text
from rareflow.streaming.score_stream import read_count_stream, start_scoring

QUICK = {
    "lightgbm": {"n_estimators": 3, "num_leaves": 4},
    "xgboost": {"n_estimators": 3, "max_depth": 2},
    "catboost": {"iterations": 3, "depth": 2},
    "randomforest": {"n_estimators": 4, "max_depth": 3},
    "catboost_focal": {"iterations": 3, "depth": 2},
    "lightgbm_focal": {"n_estimators": 2, "num_leaves": 4},
    "xgboost_focal": {"n_estimators": 2, "max_depth": 2},
    "lightgbm_focal_native": {"n_estimators": 2, "num_leaves": 4},
    "xgboost_focal_native": {"n_estimators": 2, "max_depth": 2},
    "adaboost": {"n_estimators": 3, "max_depth": 2},
    "cluster": {"n_init": 2},
    "tensorflow_dnn": {"max_iter": 5},
}


@pytest.mark.parametrize("name", sorted(learners.LEARNERS))
def test_learner_scores_and_reloads(spark, split, tmp_path, name):
    scorer = learners.LEARNERS[name].fit(part(split, "train"), COUNT_COLUMNS, **QUICK.get(name, {}))
    rows = part(split, "test")
    scored = scorer.with_score(rows, "p")
    assert scored.columns == [*rows.columns, "p"]
    low, high, n = scored.agg(F.min("p"), F.max("p"), F.count("p")).first()
    assert 0.0 <= low <= high <= 1.0 and n == rows.count()
    scorer.save(spark, str(tmp_path / "m"))
    again = learners.load_scorer(spark, str(tmp_path / "m")).with_score(rows, "p")
    assert scored.select(ROW_ID, "p").exceptAll(again.select(ROW_ID, "p")).count() == 0


def test_gaussian_mixture_variant(split):
    scorer = learners.LEARNERS["cluster"].fit(part(split, "train"), COUNT_COLUMNS, algo="gmm")
    low, high = scorer.with_score(split, "p").agg(F.min("p"), F.max("p")).first()
    assert 0.0 <= low <= high <= 1.0


def test_focal_rounds_survive_restaging(split):
    params = {"iterations": 12, "depth": 2}
    scorer = learners.LEARNERS["catboost_focal"].fit(part(split, "train"), COUNT_COLUMNS, **params)
    assert scorer.model.getNumTrees == 12
    auc = ranking_metrics(score_curve(scorer.with_score(part(split, "train"), "p"), "p")).first()
    assert auc["roc_auc"] > 0.9


def test_embedding_reproduces_the_network(split):
    """The last layer on top of the emitted hidden layer gives the net's own probability."""
    train = part(split, "train")
    fitted = latent.HiddenLayerEmbedding(embedding_dim=6, max_iter=5).fit(train, COUNT_COLUMNS)
    rows = fitted.transform(train).select(*fitted.new_columns()).toPandas().to_numpy()
    assert rows.shape[1] == 6 and np.all((rows > 0) & (rows < 1))
    w, b = fitted.matrices()[-1]
    raw = rows @ w.T + b
    p = np.exp(raw[:, 1]) / np.exp(raw).sum(axis=1)
    assert np.all(np.isfinite(p))


def test_denoiser_keeps_the_means(split):
    train = part(split, "train")
    out = latent.LinearDenoiser().fit(train, COUNT_COLUMNS).transform(train)
    a = train.agg(*[F.avg(c) for c in COUNT_COLUMNS]).first()
    b = out.agg(*[F.avg(f"{c}_dn") for c in COUNT_COLUMNS]).first()
    assert list(a) == pytest.approx(list(b), rel=1e-6)


@pytest.mark.parametrize("mode", recipes.FEATURE_MODES)
def test_recipe_round_trip(spark, split, tmp_path, mode):
    recipe = recipes.FeatureRecipe(mode, {"max_iter": 3, "embedding_dim": 4} if "nnembed" in mode else {})
    fitted, rows = recipe.fit_transform(part(split, "train"), COUNT_COLUMNS)
    assert set(fitted.columns) <= set(rows.columns) and ROW_ID in rows.columns
    fitted.save(spark, str(tmp_path / "r"))
    again = recipes.load_recipe(spark, str(tmp_path / "r"))
    test = part(split, "test")
    a, b = (r.transform(test).select(ROW_ID, *fitted.columns) for r in (fitted, again))
    assert a.count() == test.count() and a.exceptAll(b).count() == 0


def test_unknown_mode_is_an_error():
    with pytest.raises(ValueError):
        recipes.mode_steps("engineered_woe")


def test_grid_sizes_and_order():
    sizes = {2: 11, 3: 66, 4: 286, 5: 1001}
    for m, n in sizes.items():
        vectors = blend.weight_vectors(m)
        assert len(vectors) == n + 1 and vectors[1:] == sorted(vectors[1:])
        assert all(sum(v) == pytest.approx(1.0) for v in vectors)


def test_pruned_search_equals_exhaustive_search(counts):
    third = F.round(F.col("num_spelling_errors") / 7 + F.col("p_a") / 9, 4)
    df = counts.withColumn("p_c", third)
    names = ["p_a", "p_b", "p_c"]
    everything = blend.weight_scores(df, names).collect()
    best = min(everything, key=lambda r: (-r["ap"], r["weight_id"]))
    found = blend.optimize_weights(df, names)
    assert found.weights == blend.weight_vectors(3)[best["weight_id"]]
    assert found.pr_auc == pytest.approx(best["ap"], abs=1e-12)
    assert found.pr_auc >= everything[0]["ap"] or best["weight_id"] == 0
    assert found.n_evaluated <= 67


def test_bounds_enclose_the_exact_value(counts):
    names = ["p_a", "p_b"]
    vectors = dict(enumerate(blend.weight_vectors(2)))
    tuples = blend.score_tuples(counts, names)
    exact = {r["weight_id"]: r["ap"] for r in blend.weight_scores(counts, names).collect()}
    for bins in (1, 8, 256):
        for r in blend.ap_bounds(tuples, names, vectors, bins).collect():
            assert r["low"] - 1e-12 <= exact[r["weight_id"]] <= r["high"] + 1e-12


def test_crowded_scores_are_pruned(spark):
    """Calibrated scores of rare events lie near zero; most weight vectors must still drop out early."""
    rng = np.random.default_rng(4)
    y = rng.random(20_000) < 0.02
    a, b, c = (0.004 / (1 + np.exp(3 - g * y - rng.normal(size=len(y)))) for g in (3.0, 1.5, 0.2))
    rows = [(int(t), float(p), float(q), float(r)) for t, p, q, r in zip(y, a, b, c)]
    df = spark.createDataFrame(rows, f"{LABEL} int, p_a double, p_b double, p_c double")
    names = ["p_a", "p_b", "p_c"]
    best = blend.optimize_weights(df, names)
    scores = {r["weight_id"]: r["ap"] for r in blend.weight_scores(df, names).collect()}
    winner = min(scores, key=lambda i: (-scores[i], i))
    assert best.weights == blend.weight_vectors(3)[winner]
    assert best.n_evaluated < 0.2 * len(scores)


def _correlated_scores(spark, n_models, rows=20_000):
    rng = np.random.default_rng(11)
    y = rng.random(rows) < 0.02
    shared = rng.normal(size=rows)
    gains = np.linspace(3.0, 0.4, n_models)
    scores = [1 / (1 + np.exp(4 - g * y - 0.8 * shared - 0.6 * rng.normal(size=rows))) for g in gains]
    data = [(int(t), *[round(float(v), 3) for v in x]) for t, *x in zip(y, *scores)]
    names = [f"p{i}" for i in range(n_models)]
    return spark.createDataFrame(data, f"{LABEL} int, " + ", ".join(f"{n} double" for n in names)), names


def test_cell_limits_hold_for_all_their_vectors(spark):
    df, names = _correlated_scores(spark, 4, 2_000)
    scores = {r["weight_id"]: r["ap"] for r in blend.weight_scores(df, names, n_grid=5).collect()}
    points = dict(enumerate(list(blend.compositions(4, 4)), start=1))
    cells = [(), *[(a,) for a in range(5)], *[(a, b) for a in range(5) for b in range(5 - a)]]
    tuples = blend.score_tuples(df, names)
    for bins in (1, 4, 64):
        for r in blend.cell_bounds(tuples, names, dict(enumerate(cells)), 4, bins).collect():
            cell = cells[r["weight_id"]]
            inside = [scores[i] for i, units in points.items() if units[: len(cell)] == cell]
            assert inside and max(inside) <= r["high"] + 1e-12


def test_search_over_cells_equals_exhaustive_search(spark, monkeypatch):
    """Many rounds: a small round makes cells of all depths be bounded, opened and left."""
    df, names = _correlated_scores(spark, 4, 3_000)
    scores = {r["weight_id"]: r["ap"] for r in blend.weight_scores(df, names).collect()}
    winner = min(scores, key=lambda i: (-scores[i], i))
    monkeypatch.setattr(blend, "ROUND", 40)
    best = blend.optimize_weights(df, names)
    assert best.weights == blend.weight_vectors(4)[winner]
    assert best.pr_auc == pytest.approx(scores[winner], abs=1e-12)


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibration_is_monotone(counts, method):
    fitted = calibration.fit_calibration(counts, "p_a", method)
    rows = fitted.apply(counts, "p_a", "p").select("p_a", "p").orderBy("p_a").collect()
    p = [r["p"] for r in rows]
    assert all(a <= b + 1e-12 for a, b in zip(p, p[1:])) and 0 <= p[0] and p[-1] <= 1
    total = counts.agg(F.sum(LABEL)).first()[0]
    assert sum(p) == pytest.approx(total, rel=0.05)


def test_driver_keys_equal_column_keys(spark):
    row = spark.range(1).select(
        hashing.search_key(
            F.lit("m"), F.lit("raw"), F.lit("random"), F.lit(40), F.lit(3),
            F.array(F.lit("b"), F.lit("a")), F.array(F.lit("y=2"), F.lit("x=1")),
        ).alias("s"),
        hashing.embedding_key(
            F.lit(16), F.lit(40), F.lit(20), F.lit(0.5), F.lit(0.25), F.lit(15), F.lit("sgd"),
            F.lit(0.005), F.lit(False), F.lit(True), F.array(F.lit("b"), F.lit("a")), F.lit(99),
        ).alias("e"),
    ).first()
    short = lambda text: hashlib.sha256(text.encode()).hexdigest()[:16]
    assert row["s"] == short("m|raw|random|40|3|a,b|x=1,y=2")
    assert row["e"] == short("16|40|20|0.500000|0.250000|15|sgd|0.00500000|False|True|a,b|99")


def test_cache_key_covers_every_setting():
    base = {"model": "m", "seed": 1, "columns": ["a", "b"], "candidates": None, "label": "y"}
    assert caches.settings_key(base) == caches.settings_key(dict(reversed(base.items())))
    changes = [{"seed": 2}, {"label": "z"}, {"candidates": [{"C": 1}]}, {"columns": ["a"]}, {"max_iter": 5}]
    keys = {caches.settings_key({**base, **c}) for c in [{}, *changes]}
    assert len(keys) == len(changes) + 1


def test_unreadable_cache_entry_is_a_miss(spark, tmp_path):
    folder = str(tmp_path)
    settings = {"model": "m", "seed": 3}
    assert caches.load_winner(spark, folder, settings) is None
    path = caches.save_winner(spark, folder, settings, {"C": 1.0}, 0.5)
    assert caches.load_winner(spark, folder, settings)["best_params"] == {"C": 1.0}
    assert caches.load_winner(spark, folder, {**settings, "seed": 4}) is None
    for content in ("{broken", json.dumps({"best_params": {}}), json.dumps({"settings": {"seed": 4}, "best_params": {}, "cv_pr_auc": 1})):
        write_text(spark, path, content)
        assert caches.load_winner(spark, folder, settings) is None
    assert caches.load_embedding(spark, folder, settings) is None


def test_candidates():
    grid = search.grid_candidates({"b": [1, 2], "a": [3]})
    assert grid == [{"a": 3, "b": 1}, {"a": 3, "b": 2}]
    drawn = search.random_candidates(learners.LEARNERS["lightgbm"], 5)
    assert drawn == search.random_candidates(learners.LEARNERS["lightgbm"], 5)
    assert all(200 <= c["n_estimators"] < 800 and 0.01 <= c["learning_rate"] <= 0.2 for c in drawn)
    assert len(search.random_candidates(learners.LEARNERS["logreg"], 40)) == 4
    assert len(search.random_candidates(learners.LEARNERS["randomforest"], 5)) == 5


def test_experiment_end_to_end(spark, split, tmp_path):
    base = str(tmp_path)
    config = experiment.ExperimentConfig(
        n_folds=2,
        cache_dir=f"{base}/best",
        log_dir=f"{base}/logs",
        candidates={"logreg_woe": [{"C": 1.0}], "randomforest": [QUICK["randomforest"]]},
    )
    found = experiment.run_experiments(split, ["logreg_woe", "randomforest"], config, True, True)
    table = experiment.results_table(*found).collect()
    assert [r["model"] for r in table][0] in {"logreg_woe", "randomforest", "blend", "stacking"}
    assert len(table) == 4
    pr = [r["test_pr_auc"] for r in table]
    assert pr == sorted(pr, reverse=True)

    name, _ = experiment.save_best(*found, f"{base}/models")
    assert name != "stacking"
    versions.save_version(spark, found[1]["blend"].bundle, f"{base}/other")
    bundle, meta = versions.load_version(spark, f"{base}/other")
    assert isinstance(bundle, BlendBundle) and meta["version"].startswith("blend__")
    test = part(split, "test")
    stored = found[1]["blend"].scores.filter("split = 'test'").select(ROW_ID, F.round("p", 9).alias("p"))
    fresh = bundle.with_score(test, "p").select(ROW_ID, F.round("p", 9).alias("p"))
    assert stored.exceptAll(fresh).count() == 0

    cached = experiment.run_model(split, "randomforest", config)
    assert cached.test_metrics == found[0][1].test_metrics
    log = runlog.read_log(spark, f"{base}/logs/run_log", "fit")
    assert log.filter("key = 'test_pr_auc'").count() == 5
    woe_rows = spark.read.parquet(f"{base}/logs/woe_tables/{found[0][0].run_id}")
    assert woe_rows.filter("is_total = 1").count() == len(COUNT_COLUMNS)


def test_training_needs_labels(split):
    with pytest.raises(ValueError):
        experiment.run_model(split.drop(LABEL), "logreg")


def test_versions_pin_newest_and_conflict(spark, split, tmp_path):
    from datetime import datetime, timezone

    folder = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        versions.load_version(spark, folder)
    fitted = recipes.FeatureRecipe("raw").fit(part(split, "train"), COUNT_COLUMNS)
    scorer = learners.LEARNERS["logreg"].fit(part(split, "train"), COUNT_COLUMNS)
    at = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    old = versions.save_version(spark, ModelBundle("z model", fitted, scorer), folder, at=at(1))
    versions.save_version(spark, ModelBundle("a", fitted, scorer, threshold=0.7), folder, at=at(2))
    assert old.endswith("/z_model__20240101T000000Z")
    with pytest.raises(FileExistsError):
        versions.save_version(spark, ModelBundle("a", fitted, scorer), folder, at=at(2))
    listed = [r["version"] for r in versions.list_versions(spark, folder).collect()]
    assert listed == ["a__20240102T000000Z", "z_model__20240101T000000Z"]
    newest, meta = versions.load_version(spark, folder)
    assert newest.threshold == 0.7 and meta["threshold"] == 0.7
    pinned, _ = versions.load_version(spark, folder, "z_model__20240101T000000Z")
    assert pinned.name == "z model"
    with pytest.raises(FileNotFoundError):
        versions.load_version(spark, folder, "nothing")


def test_batch_scoring_with_and_without_labels(spark, counts, tmp_path):
    rows = counts.drop("p_a", "p_b")
    batch = scoring.score_batch(rows, MODEL_A, "v", log_dir=str(tmp_path))
    assert batch.metrics["n_samples"] == batch.summary["n_samples"] == rows.count()
    assert batch.rows.columns == [*rows.columns, "phishing_proba", "phishing_pred"]
    unlabelled = scoring.score_batch(rows.drop(LABEL), MODEL_A, "v", threshold=0.0)
    assert unlabelled.metrics is None and unlabelled.summary["predicted_positive_rate"] == 1.0


def test_stream_is_drained_and_rejects_are_kept(spark, counts, tmp_path):
    base = str(tmp_path)
    rows = counts.drop("p_a", "p_b", LABEL)
    damaged = rows.withColumn("num_links", F.when(F.col(ROW_ID) % 10 == 0, -1).otherwise(F.col("num_links")))
    damaged.withColumn("num_links", F.col("num_links").cast("bigint")).repartition(3).write.parquet(f"{base}/in")
    model = BlendBundle([MODEL_A, MODEL_B], [0.5, 0.5])
    query = start_scoring(
        read_count_stream(spark, f"{base}/in", 1), model, "v", f"{base}/out", f"{base}/ck", once=True
    )
    query.awaitTermination()
    scored = spark.read.parquet(f"{base}/out/scored")
    rejected = spark.read.parquet(f"{base}/out/rejected")
    summary = spark.read.parquet(f"{base}/out/summary")
    bad = damaged.filter("num_links < 0").count()
    assert rejected.count() == bad and scored.count() == rows.count() - bad
    assert summary.agg(F.sum("n_samples")).first()[0] == scored.count() and summary.count() == 3


def test_numeric_only():
    assert runlog.numeric_only({"a": 1, "b": True, "c": [1], "d": "x", "e": 0.5}) == {"a": 1.0, "e": 0.5}
    assert not math.isnan(runlog.numeric_only({"a": 2})["a"])
