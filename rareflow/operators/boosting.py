"""Newton boosting of regression trees with a leaf penalty.

Every round fits one Spark regression tree to -g/h with row weight h, so that a leaf's mean is its Newton step
-sum(g)/sum(h). Spark keeps both sums with each leaf, and the penalised step -sum(g)/(sum(h) + penalty) is read
off them: no pass over the rows is needed to refit a leaf. Margins live in a table that is rewritten every few
rounds, so neither lineage nor plan grows with the number of rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import SparkContext
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..session import drop_stage, stage_table
from .repeats import COUNT, dealt, drawn

STAGE_EVERY = 10
#: How often a step is halved before boosting ends.
HALVINGS = 6


@dataclass
class Loss:
    """Row loss in the margin: slope, positive curvature and value, each of (margin, label)."""

    slope: Callable[[Column, Column], Column]
    bend: Callable[[Column, Column], Column]
    value: Callable[[Column, Column], Column] | None = None


def log_loss() -> Loss:
    p = scores.sigmoid
    return Loss(
        lambda m, y: p(m) - y,
        lambda m, y: F.greatest(p(m) * (1.0 - p(m)), F.lit(1e-6)),
        lambda m, y: scores.cross_entropy(y, p(m), 1e-9),
    )


def focal_terms(gamma: float, alpha: float) -> Loss:
    """The focal loss with the derivative formulas of the scripted objectives."""
    return Loss(
        lambda m, y: scores.focal_gradient(m, y, gamma, alpha),
        lambda m, y: scores.focal_hessian(m, y, gamma, alpha),
    )


def focal_exact(gamma: float, alpha: float) -> Loss:
    """The focal loss with its own derivative and a curvature held above zero."""
    return Loss(
        lambda m, y: scores.focal_slope(m, y, gamma, alpha),
        lambda m, y: scores.focal_bend(m, y, gamma, alpha),
        lambda m, y: scores.focal_loss(m, y, gamma, alpha),
    )


def with_penalty(tree: DecisionTreeRegressionModel, penalty: float, picked: list[int] | None = None, n_features: int = 0):
    """The tree with leaves sum(w * t) / (sum(w) + penalty), and with the numbers of the picked features put back."""
    if not penalty and picked is None:
        return tree
    fitted = tree._java_obj
    package = SparkContext._active_spark_context._jvm.org.apache.spark.ml

    def copy(node):
        told = node.impurityStats()
        weight, total = list(told.stats())[:2]
        if node.subtreeDepth() == 0:
            return package.tree.LeafNode(total / (weight + penalty), node.impurity(), told)
        split = node.split()
        if picked is not None:
            split = package.tree.ContinuousSplit(picked[split.featureIndex()], split.threshold())
        return package.tree.InternalNode(
            node.prediction(), node.impurity(), node.gain(), copy(node.leftChild()), copy(node.rightChild()), split, told
        )

    width = n_features if picked is not None else fitted.numFeatures()
    made = package.regression.DecisionTreeRegressionModel(f"penalised_{tree.uid}", copy(fitted.rootNode()), width)
    return DecisionTreeRegressionModel(made)


def sum_of_trees(spark, trees: list, weights: list[float]) -> GBTRegressionModel:
    """Spark's own tree ensemble over already fitted trees: one expression, one save."""
    gateway = spark.sparkContext._gateway
    regression = gateway.jvm.org.apache.spark.ml.regression
    members = gateway.new_array(regression.DecisionTreeRegressionModel, len(trees))
    shares = gateway.new_array(gateway.jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        members[i] = tree._java_obj
        shares[i] = float(weight)
    uid = f"newton_{trees[0].uid}"
    return GBTRegressionModel(regression.GBTRegressionModel(uid, members, shares))


def boost(
    rows: DataFrame,
    loss: Loss,
    rounds: int,
    rate: float,
    depth: int,
    bins: int,
    penalty: float = 0.0,
    min_rows: int = 1,
    min_bend: float = 0.0,
    row_share: float = 1.0,
    column_share: float = 1.0,
    guarded: bool = False,
    stage_every: int = STAGE_EVERY,
    seed: int = 42,
) -> tuple[GBTRegressionModel, float]:
    """Sum of trees and first margin from rows (_x vector, _y 0/1, _w weight, and _n if a row stands for n equal ones).

    ``_w`` is the weight of all n rows; a row counts n times for ``min_rows`` and ``row_share``.

    ``min_bend`` is the least sum(h) of a node, as a share of the whole sum of the round before. With ``guarded`` a
    step is halved until the loss falls, and boosting ends when it no longer does. A tree sees ``row_share`` of the
    rows and ``column_share`` of the features, drawn anew each round.
    """
    spark = rows.sparkSession
    share = rows.agg(F.sum(F.col("_y") * F.col("_w")) / F.sum("_w")).first()[0]
    prior = min(max(share, 1e-6), 1 - 1e-6)
    init = math.log(prior / (1.0 - prior))
    counted = rows if COUNT in rows.columns else rows.withColumn(COUNT, F.lit(1).cast("long"))
    state = stage_table(counted.select("_x", "_y", "_w", COUNT).withColumn("_m", F.lit(init)), "boost")
    staged = state
    single = state.filter(F.col(COUNT) > 1).isEmpty()
    m, y, w = F.col("_m"), F.col("_y"), F.col("_w")
    rng = np.random.default_rng(seed)
    learner = DecisionTreeRegressor(
        featuresCol="_x", labelCol="_target", weightCol="_h", maxDepth=depth, maxBins=bins, minInstancesPerNode=min_rows, seed=seed
    )
    whole = None
    n_features = len(state.first()["_x"])
    trees, weights = [], []
    for done in range(1, rounds + 1):
        target = state.withColumn("_h", w * loss.bend(m, y)).withColumn("_target", -w * loss.slope(m, y) / F.col("_h"))
        if min_bend:
            if whole is None:
                whole = target.agg(F.sum("_h")).first()[0]
            learner.setMinWeightFractionPerNode(min(0.49, min_bend / (whole * row_share)))
        if row_share < 1.0 and single:
            target = target.sample(row_share, seed=seed + done)
        elif row_share < 1.0:
            taken = drawn(F.col(COUNT), F.xxhash64(F.lit(seed + done), "_x", "_y"), row_share)
            target = target.withColumn("_taken", taken).filter("_taken > 0")
            target = target.withColumn("_h", F.col("_h") * F.col("_taken") / F.col(COUNT)).withColumn(COUNT, F.col("_taken"))
        if not single:
            target = dealt(target, COUNT, ["_h"], min_rows)
        picked = None
        if column_share < 1.0:
            n = max(1, round(column_share * n_features))
            picked = sorted(rng.choice(n_features, n, replace=False).tolist())
            target = VectorSlicer(inputCol="_x", outputCol="_part", indices=picked).transform(target)
        learner.setFeaturesCol("_x" if picked is None else "_part")
        fitted = learner.fit(target)
        whole = list(fitted._java_obj.rootNode().impurityStats().stats())[0] / row_share
        tree = with_penalty(fitted, penalty, picked, n_features)
        stepped = tree.setFeaturesCol("_x").setPredictionCol("_step").transform(state)
        weight = rate
        if guarded:
            tries = [0.0, *[rate / 2**k for k in range(HALVINGS + 1)]]
            sums = [F.sum(w * loss.value(m + F.lit(t) * F.col("_step"), y)) for t in tries]
            now, *then = stepped.agg(*sums).first()
            weight = next((t for t, value in zip(tries[1:], then, strict=True) if value < now), None)
            if weight is None:
                break
        trees.append(tree)
        weights.append(weight)
        if done == rounds:
            break
        state = stepped.withColumn("_m", m + F.lit(weight) * F.col("_step")).drop("_step")
        if done % stage_every == 0:
            state, last = stage_table(state, "boost"), staged
            staged = state
            drop_stage(last)
    drop_stage(staged)
    if not trees:
        trees, weights = [tree], [0.0]
    return sum_of_trees(spark, trees, weights), init
