"""Learners on distinct rows with counts: the same as on all rows."""

import math
import threading

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from rareflow.operators import boosting, encoders, latent, learners, nets, repeats
from rareflow.operators.features import FeatureEngineer
from rareflow.operators.splits import assign_folds, holdout_split
from rareflow.plans import experiment, recipes, search
from rareflow.schema import LABEL, ROW_ID
from rareflow.session import stage_table


@pytest.fixture(scope="module")
def many(spark):
    """40 distinct pairs of counts, each up to 60 times, with a label of its own rate."""
    rng = np.random.default_rng(5)
    rows = []
    for a in range(8):
        for b in range(5):
            n = int(rng.integers(1, 60))
            rows += [(a, b, int(rng.random() < 0.05 + 0.1 * a)) for _ in range(n)]
    return stage_table(spark.createDataFrame(rows, f"a long, b long, {LABEL} int"))


def test_draws_have_the_moments_of_samples():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 40_000)
    for size in (1, 7, 200):
        n = np.full(len(keys), size)
        taken, boots = repeats.draw(n, keys, 0.8), repeats.draw(n, keys, None)
        assert taken.max() <= size and taken.mean() == pytest.approx(0.8 * size, rel=0.02)
        assert taken.var() == pytest.approx(0.16 * size, rel=0.05)
        assert boots.mean() == pytest.approx(size, rel=0.02) and boots.var() == pytest.approx(size, rel=0.05)
        assert (repeats.draw(n, keys, None) == boots).all()


def test_training_rows_are_distinct(many):
    rows = learners._training_rows(many, ["a", "b"], LABEL, "balanced")
    assert rows.count() == many.distinct().count() < many.count() / 4
    total, n = rows.agg(F.sum("_w"), F.sum("_n")).first()
    assert n == many.count() and total == pytest.approx(n)


@pytest.mark.parametrize("least", [1, 20])
def test_boosting_counts_equal_rows(many, least):
    models = []
    for pack in (True, False):
        rows = learners._training_rows(many, ["a", "b"], LABEL, "ratio", pack=pack)
        model, init = boosting.boost(rows, boosting.log_loss(), 3, 0.3, 4, 32, penalty=1.0, min_rows=least)
        models.append((model.toDebugString.split("\n", 1)[1], init))
    assert models[0][1] == pytest.approx(models[1][1])
    shape = lambda text: [w for w in text.split() if not w.replace(".", "").replace("-", "").replace("E", "").isdigit()]
    assert shape(models[0][0]) == shape(models[1][0])


def test_sampled_rounds_on_counts(many):
    rows = learners._training_rows(many, ["a", "b"], LABEL, "ratio")
    sizes = []
    for share in (0.5, 0.999):
        model, _ = boosting.boost(rows, boosting.log_loss(), 1, 1.0, 2, 32, row_share=share)
        sizes.append(list(model.trees[0]._java_obj.rootNode().impurityStats().stats())[0])
    assert sizes[0] == pytest.approx(sizes[1] / 2, rel=0.2)


def test_forest_of_drawn_counts(many):
    """Close to Spark's own forest on all rows, and the same on every run."""
    rows = learners._training_rows(many, ["a", "b"], LABEL, "balanced")
    plain = learners._training_rows(many, ["a", "b"], LABEL, "balanced", pack=False)
    params = {"n_estimators": 12, "max_depth": 4}
    one, two, spark_own = (learners._forest(r, params, 3) for r in (rows, rows, plain))
    assert one.uid.startswith("bagged_") and one.getNumTrees == 12 and not spark_own.uid.startswith("bagged_")
    assert one.featureImportances == two.featureImportances
    assert np.allclose(one.featureImportances.toArray(), spark_own.featureImportances.toArray(), atol=0.15)
    mean = lambda m: m.setFeaturesCol("_x").setProbabilityCol("_q").setPredictionCol("").setRawPredictionCol("").transform(rows).select("_q").toPandas()["_q"].map(lambda v: v[1]).to_numpy()
    assert np.abs(np.sort(mean(one)) - np.sort(mean(spark_own))).max() < 0.2


def test_centres_of_counts(spark, many):
    flat = many.select(F.col("a").cast("double").alias("_z0"), F.col("b").cast("double").alias("_z1"))
    told = [
        learners.two_means(stage_table(flat), ["_z0", "_z1"], 4, 1),
        learners.two_means(stage_table(repeats.packed(flat)), ["_z0", "_z1"], 4, 1, count="_n"),
    ]
    assert all(math.isclose(x, y, abs_tol=1e-9) for p, q in zip(*told, strict=True) for x, y in zip(p, q, strict=True))


def test_net_on_counts_is_the_perceptron_on_rows(spark):
    """Two and three copies of rows, in one count each: the weights of Spark's perceptron on all copies."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(128, 2))
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(float)
    rows = [(*map(float, r), float(t), 2 + int(t)) for r, t in zip(x, y, strict=True)]
    table = stage_table(spark.createDataFrame(rows, "a double, b double, y double, n long"))
    copies = table.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    vectors = stage_table(latent.assemble(copies, ["a", "b"]).select("features", "y")).coalesce(1)
    layers = [2, 4, 3, 2]
    # One block, so that the mean of the blocks is that of the rows.
    spark_net = MultilayerPerceptronClassifier(layers=layers, labelCol="y", maxIter=12, seed=7, blockSize=1024).fit(vectors)
    start = nets.perceptron(spark, layers, 7).weights.toArray()
    got = nets.minimise(nets.gradient(table, ["a", "b"], layers, "n"), start, 12)
    assert got == pytest.approx(spark_net.weights.toArray(), abs=1e-8)
    again = nets.perceptron(spark, layers, 7, got.tolist()).weights.toArray()
    assert (again == got).all()


def test_net_trains_on_distinct_rows(many):
    scaler, _, table = latent.net_table(many, ["a", "b"], LABEL, 42)
    assert table.count() == many.distinct().count() < many.count() / 4
    own = encoders.Standardizer().fit(many, ["a", "b"])
    for c in ("a", "b"):
        assert scaler.moments[c] == pytest.approx(own.moments[c])
    net = latent.SlicedNet(table, [2, 3, 2, 2], 2, 42)
    pos, n = net.rows.agg(F.sum(F.col("y") * F.col("times")), F.sum("times")).first()
    assert pos / n == pytest.approx(0.5, abs=0.17)
    net.advance()
    scored = net.scored().agg(F.sum("pos"), F.sum("n")).first()
    assert tuple(scored) == (many.filter(F.col(LABEL) == 1).count(), many.count())


def test_moments_of_counted_rows(spark, many):
    counted = repeats.packed(many.withColumn("c", F.lit(0.1)))
    n, means, products = repeats.moments(counted, ["a", "b", "c"], products=True)
    x = many.select("a", "b").toPandas().to_numpy(dtype=float)
    assert n == len(x) and means[:2] == pytest.approx(x.mean(axis=0)) and means[2] == 0.1 and (products[2] == 0).all()
    assert products[:2, :2] == pytest.approx(np.cov(x.T, bias=True) * len(x))


def test_dense_net_is_the_perceptron_on_balanced_copies(many):
    """Positives repeated to the size of the negatives and all in one block: the same probabilities as of the learner."""
    settings = {"hidden1": 4, "hidden2": 3, "hidden3": 2, "max_iter": 8}
    scorer = learners.LEARNERS["tensorflow_dnn"].fit(many, ["a", "b"], LABEL, 42, **settings)
    scaled = encoders.Standardizer().fit(many, ["a", "b"]).transform(many)
    pos, n = many.agg(F.sum(LABEL), F.count(F.lit(1))).first()
    times = F.when(F.col(LABEL) == 1, F.lit(max(1, round((n - pos) / pos)))).otherwise(F.lit(1))
    rows = latent.assemble(scaled.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))), ["a", "b"], "_x")
    rows = stage_table(rows.select("_x", F.col(LABEL).cast("double").alias("_y"))).coalesce(1)
    own = MultilayerPerceptronClassifier(
        featuresCol="_x", labelCol="_y", layers=[2, 4, 3, 2, 2], maxIter=8, seed=42, blockSize=1 << 16
    ).fit(rows)
    assert scorer.model.weights.toArray() == pytest.approx(own.weights.toArray(), abs=1e-7)


def test_smoothing_and_denoiser_on_counts(many):
    """Fitted on distinct rows with counts: the bounds, references and axes of all rows."""
    wide = many.select("a", "b", (F.col("a") * F.col("b")).alias("c"))
    names, distinct = ["a", "b", "c"], stage_table(repeats.packed(wide))
    one, other = (encoders.FeatureSmoothing(n_quantiles=50).fit(d, names) for d in (wide, distinct))
    assert one.bounds == other.bounds and one.references == other.references
    one, other = (latent.LinearDenoiser(rank=2).fit(d, names) for d in (wide, distinct))
    assert one.gains == pytest.approx(other.gains)
    a, b = (f.transform(wide).agg(*[F.avg(c) for c in f.output_columns()], *[F.stddev(c) for c in f.output_columns()]).first() for f in (one, other))
    assert list(a) == pytest.approx(list(b))


@pytest.mark.parametrize("name", ["smoothing", "denoiser", "embedding"])
def test_recipe_fits_last_step_on_distinct_rows(many, monkeypatch, name):
    mode = {"smoothing": "engineered_smooth", "denoiser": "engineered_denoise", "embedding": "engineered_nnembed"}[name]
    rows = many.select(F.col("a").alias("num_links"), F.col("b").alias("num_words"), LABEL)
    seen = {}
    fit_step = recipes.FeatureRecipe._fit_step

    class Seen(Exception):
        pass

    def spy(self, step, df, columns):
        if step == name:
            seen["n"], seen["all"] = df.count(), df.agg(F.sum(repeats.COUNT)).first()[0]
            raise Seen
        return fit_step(self, step, df, columns)

    monkeypatch.setattr(recipes.FeatureRecipe, "_fit_step", spy)
    with pytest.raises(Seen):
        recipes.FeatureRecipe(mode).fit(rows, ["num_links", "num_words"])
    assert seen["all"] == rows.count() and seen["n"] < rows.count() / 4


def test_study_engineers_once_for_all_widths(split, monkeypatch):
    fits, fit = [], experiment.FeatureEngineer.fit
    monkeypatch.setattr(experiment.FeatureEngineer, "fit", lambda self, train: fits.append(1) or fit(self, train))
    small = {"max_iter": 1, "hidden1": 3, "hidden2": 2, "holdout": 0.0}
    assert experiment.embedding_study(split, [], [2, 3], embedding=small).count() == 0
    assert len(fits) == 1


@pytest.mark.parametrize("logged", [False, True])
def test_study_measures_conditions_at_once(split, monkeypatch, tmp_path, logged):
    """Both widths wait for each other, but not where they append to one log."""
    gate, met, many = threading.Barrier(2), [], {"pr_auc": 0.5, "recall": 0.1, "precision": 0.2, "f1": 0.3, "mcc": 0.4}

    def run(frame, name, config):
        try:
            gate.wait(20 if not logged else 0.1)
            met.append(name)
        except threading.BrokenBarrierError:
            gate.reset()
        return experiment.ModelResult(name, {}, None, 0.5, many, many, frame)

    monkeypatch.setattr(experiment, "run_model", run)
    monkeypatch.setattr(experiment, "embed_split", lambda data, *a, **k: data)
    config = experiment.ExperimentConfig(log_dir=str(tmp_path) if logged else None)
    rows = experiment.embedding_study(split, ["logreg"], [2, 3, 2], config, with_baseline=False).collect()
    assert sorted((r.condition, r.dim, r.model) for r in rows) == [("with_embedding", d, "logreg") for d in (2, 2, 3)]
    assert len(met) == (0 if logged else 2)


def test_small_linear_fit_is_one_task(many, monkeypatch):
    parts, fit = [], learners.LogisticRegression.fit
    monkeypatch.setattr(learners.LogisticRegression, "fit", lambda self, rows: parts.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    learners.fit_logistic(many.repartition(6).withColumn(repeats.COUNT, F.lit(1).cast("long")), ["a", "b"], LABEL, {"C": 1.0}, 1)
    assert parts == [1]


@pytest.fixture(scope="module")
def copied(spark):
    """120 rows of three counts, 40 copies of each, with an id and a label of their own."""
    rng = np.random.default_rng(8)
    rows = []
    for links, words, emails in rng.integers(0, [6, 90, 4], (120, 3)).tolist():
        rows += [(len(rows) + i, links, words, emails, int(rng.random() < 0.1 + 0.12 * links)) for i in range(40)]
    return stage_table(spark.createDataFrame(rows, f"{ROW_ID} long, num_links long, num_words long, num_email_addresses long, {LABEL} int"))


INPUTS = ["num_links", "num_words", "num_email_addresses"]


def test_engineer_fits_counted_rows(copied):
    rows = copied.select(*INPUTS)
    for df in (rows, rows.withColumn("num_email_addresses", F.lit(2)), rows.limit(1), rows.limit(0)):
        df = stage_table(df)
        one, other = FeatureEngineer().fit(df), FeatureEngineer().fit(stage_table(repeats.packed(df)))
        assert other.cutoffs == one.cutoffs and other.moments == pytest.approx(one.moments)


@pytest.mark.parametrize("mode", ["ix_raw", "engineered", "engineered_smooth"])
def test_folds_stage_distinct_rows(copied, monkeypatch, mode):
    """One row per distinct row and fitted features, however often it comes; the same scores as of all rows."""
    recipe, learner = recipes.FeatureRecipe(mode), learners.LEARNERS["logreg"]
    folds = search.stage_folds(copied, INPUTS, recipe, 3)
    distinct = copied.select(LABEL, *INPUTS).distinct().count()
    assert folds.rows.count() == distinct * (1 if mode == "ix_raw" else 3) < copied.count()
    sizes = dict(map(tuple, assign_folds(copied, 3).groupBy("fold").count().collect()))
    for k in range(3):
        held, trained = folds.part(k, True), folds.part(k, False)
        n, m = (d.agg(F.sum(repeats.COUNT)).first()[0] for d in (held, trained))
        assert n == sizes[k] and n + m == copied.count()
    scores = []
    for counts in (True, False):
        monkeypatch.setattr(recipes.FeatureRecipe, "takes_counts", lambda self: counts)  # noqa: B023
        # Few steps, so that rounding does not decide where the optimiser stops.
        got = search.cross_validate(copied, INPUTS, learner, recipe, [{"C": 0.1, "max_iter": 5}], 3).collect()
        scores.append({(r.candidate, r.fold): r.score for r in got})
    assert scores[0] == pytest.approx(scores[1], abs=1e-9)


@pytest.mark.parametrize("name", ["adaboost", "cluster"])
def test_other_learners_get_all_rows(copied, monkeypatch, name):
    learner, seen = learners.LEARNERS[name], []
    monkeypatch.setattr(learner, "fit_rows", lambda rows, columns, *rest: seen.append(rows) or rows.columns)
    folds = search.stage_folds(copied, INPUTS, recipes.FeatureRecipe("raw"), 3)
    assert learner.fit(folds.part(0, False), folds.columns) == [LABEL, *INPUTS]
    assert seen[0].count() == assign_folds(copied, 3).filter("fold != 0").count()


def test_model_fits_distinct_rows(copied, monkeypatch):
    """The engineered features of the final fit, too, are those of distinct rows, and every held-out row has its score."""
    data = stage_table(holdout_split(copied, 0.25, 1 / 3))
    fits, fit = [], FeatureEngineer.fit
    monkeypatch.setattr(FeatureEngineer, "fit", lambda self, rows: fits.append(rows.count()) or fit(self, rows))
    config = experiment.ExperimentConfig(mode="engineered", n_folds=3, candidates={"logreg": [{"C": 1.0, "max_iter": 5}]})
    result = experiment.run_model(data, "logreg", config)
    distinct = copied.select(LABEL, *INPUTS).distinct().count()
    assert len(fits) == 4 and max(fits) <= distinct < copied.count() / 4
    assert result.scores.count() == data.filter("split != 'train'").count()
    monkeypatch.setattr(recipes.FeatureRecipe, "takes_counts", lambda self: False)
    plain = experiment.run_model(data, "logreg", config)
    both = result.scores.join(plain.scores.withColumnRenamed("p", "q"), ROW_ID)
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9
    assert result.cv_pr_auc == pytest.approx(plain.cv_pr_auc, abs=1e-9)
