"""Importances grown node by node in tasks: Spark's trees where nothing is drawn, its forest's law where rows are."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier

from rareflow.operators import forest, learners
from rareflow.schema import LABEL
from rareflow.session import stage_table

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def noisy(spark):
    """3,000 rows of which few are equal; one column has more values than bins."""
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(3_000):
        a, b, c, d = int(rng.integers(0, 12)), int(rng.integers(0, 300)), float(rng.normal()), int(rng.integers(0, 3))
        rows.append((a, b, c, d, int(rng.random() < 0.02 + 0.04 * a + 0.1 * (b > 200) * d)))
    return stage_table(spark.createDataFrame(rows, f"a long, b long, c double, d long, {LABEL} int"))


def of(df):
    return np.array([{r.feature: r.importance for r in df.collect()}[n] for n in NAMES])


# Equal gains go to the first feature, as in Spark where all are seen. A lambda travels to the workers.
in_order = lambda rng, nodes, features, n: np.tile(np.arange(n), (nodes, 1))


@pytest.mark.parametrize("local", [10**6, 300])
@pytest.mark.parametrize("depth", [3, 30])
def test_undrawn_tree_is_sparks(noisy, monkeypatch, local, depth):
    monkeypatch.setattr(forest, "draw", lambda n, keys, share: n)
    monkeypatch.setattr(forest, "picked", in_order)
    monkeypatch.setattr(forest, "LOCAL", local)
    rows = learners._training_rows(noisy.drop("c"), ["a", "b", "d"], LABEL, "balanced")
    own = DecisionTreeClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxDepth=depth, maxBins=512).fit(rows)
    found = forest.importances(rows, 3, [7], [3], 512, depth)[0]
    # Deep down many cuts are equally good but for rounding.
    assert np.allclose(found / found.sum(), own.featureImportances.toArray(), atol=1e-9 if depth == 3 else 5e-3)


def test_large_nodes_are_cut_as_small_ones(noisy, monkeypatch):
    """The same draws and all features: where a node is grown does not matter."""
    rows = learners._training_rows(noisy, NAMES, LABEL, "balanced")
    monkeypatch.setattr(forest, "picked", in_order)
    whole = forest.importances(rows, 4, [1, 2], [4, 4], 64, 30)
    monkeypatch.setattr(forest, "LOCAL", 100)
    assert np.allclose(forest.importances(rows, 4, [1, 2], [4, 4], 64, 30), whole, rtol=1e-9)


def test_no_job_for_every_level(noisy, monkeypatch):
    """Close to Spark's forest; many rows no longer go to it."""
    spark_own = of(learners.forest_importance(noisy, NAMES, n_estimators=40, max_depth=6))
    monkeypatch.setattr(learners, "MANY_ROWS", 100)
    monkeypatch.setattr(learners, "_forest", None)
    found = of(learners.forest_importance(noisy, NAMES, n_estimators=40, max_depth=6, batch=25))
    again = of(learners.forest_importance(noisy, NAMES, n_estimators=40, max_depth=6, batch=25))
    assert found.sum() == pytest.approx(1.0) and (found == again).all()
    assert np.allclose(found, spark_own, atol=0.06)


def test_one_class_has_no_importances(noisy, monkeypatch):
    monkeypatch.setattr(learners, "MANY_ROWS", 100)
    assert not of(learners.forest_importance(noisy.filter(f"{LABEL} = 0"), NAMES, n_estimators=2)).any()
