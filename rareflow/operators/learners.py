"""Registered classifiers: Spark ML learners, a Newton booster for the focal loss, SAMME.

Every entry fits on a table with plain feature columns and returns a scorer whose
``with_score`` adds one probability column and keeps all others.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    GBTClassificationModel,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..schema import LABEL
from ..session import drop_stage, spread, stage_table
from ..sources.textfiles import read_text, write_text
from . import boosting, forest
from .encoders import FittedStandardizer, Standardizer, periodic_features
from .latent import SlicedNet, assemble, net_table
from .metrics import with_balanced_weight, with_imbalance_weight
from .nets import perceptron
from .repeats import COUNT, REPEATS, counted_rows, dealt, drawn, packed, unpacked

STAGE_EVERY = 10
MAX_TREE_DEPTH = 30
MAX_BINS = 256
#: Least rows of a task of a linear model's pass, which else takes longer to send than to run.
ROWS_A_TASK = 50_000
#: Trees of a forest that grow at once where rows repeat ``REPEATS`` times.
TREES_AT_ONCE = 4
#: Distinct rows from which importances grow small nodes in one task each; Spark sends a job for every level of every tree.
MANY_ROWS = 50_000

# ---------------------------------------------------------------- scorers


@dataclass
class Scorer:
    """A fitted model that adds a probability column; subclasses store their own state."""

    columns: list[str]

    def with_score(self, df: DataFrame, out: str = "p") -> DataFrame:
        raise NotImplementedError

    def save(self, spark, path: str) -> None:
        raise NotImplementedError


_ML_MODELS = {
    m.__name__: m
    for m in (
        GBTClassificationModel,
        LogisticRegressionModel,
        RandomForestClassificationModel,
        MultilayerPerceptronClassificationModel,
    )
}


@dataclass
class MLScorer(Scorer):
    """Any Spark ML classification model, with optional input scaling."""

    model: object = None
    scaler: FittedStandardizer | None = None
    frequencies: list[list[float]] = field(default_factory=list)

    def with_score(self, df: DataFrame, out: str = "p") -> DataFrame:
        rows = _model_input(df, self.columns, self.scaler, self.frequencies)
        self.model.setFeaturesCol("_x").setPredictionCol("").setRawPredictionCol("")
        scored = self.model.setProbabilityCol("_prob").transform(rows)
        return scored.select(*df.columns, vector_to_array("_prob")[1].alias(out))

    def save(self, spark, path: str) -> None:
        self.model.write().save(f"{path}/model")
        state = {
            "kind": "ml",
            "class": type(self.model).__name__,
            "columns": self.columns,
            "moments": self.scaler.moments if self.scaler else None,
            "frequencies": self.frequencies,
        }
        write_text(spark, f"{path}/scorer.json", json.dumps(state))


def _model_input(
    df: DataFrame, columns: list[str], scaler: FittedStandardizer | None, frequencies: list[list[float]] = ()
) -> DataFrame:
    """Vector of the (scaled) inputs, and of their sines and cosines if any, next to all columns of ``df``."""
    if scaler is None:
        return assemble(df, columns, "_x")
    names = [f"_z_{i}" for i in range(len(columns))]
    scaled = df.select("*", *[scaler.value(c).alias(n) for c, n in zip(columns, names)])
    if frequencies:
        scaled = scaled.select("*", *periodic_features(names, frequencies))
        names += [f"{n}_{part}_{i}" for n, row in zip(list(names), frequencies) for i in range(len(row)) for part in ("sin", "cos")]
    return assemble(scaled, names, "_x")


@dataclass
class BoostedScorer(Scorer):
    """sigmoid(prior margin + sum of trees)."""

    model: GBTRegressionModel = None
    init: float = 0.0

    def with_score(self, df: DataFrame, out: str = "p") -> DataFrame:
        rows = assemble(df, self.columns, "_x")
        summed = self.model.setFeaturesCol("_x").setPredictionCol("_sum").transform(rows)
        return summed.select(*df.columns, scores.sigmoid(F.lit(self.init) + F.col("_sum")).alias(out))

    def save(self, spark, path: str) -> None:
        self.model.write().save(f"{path}/model")
        state = {"kind": "boosted", "columns": self.columns, "init": self.init}
        write_text(spark, f"{path}/scorer.json", json.dumps(state))


@dataclass
class VotingScorer(Scorer):
    """Weighted votes of classification trees, squashed to a probability."""

    trees: list[DecisionTreeClassificationModel] = field(default_factory=list)
    alphas: list[float] = field(default_factory=list)

    def with_score(self, df: DataFrame, out: str = "p") -> DataFrame:
        rows = assemble(df, self.columns, "_x")
        total = F.lit(0.0)
        for i, (tree, alpha) in enumerate(zip(self.trees, self.alphas)):
            rows = _vote(tree, rows, f"_v{i}")
            total = total + F.lit(alpha) * (2.0 * F.col(f"_v{i}") - 1.0)
        share = total / F.lit(sum(self.alphas))
        return rows.select(*df.columns, scores.sigmoid(2.0 * share).alias(out))

    def save(self, spark, path: str) -> None:
        for i, tree in enumerate(self.trees):
            tree.write().save(f"{path}/tree-{i:04d}")
        state = {"kind": "voting", "columns": self.columns, "alphas": self.alphas}
        write_text(spark, f"{path}/scorer.json", json.dumps(state))


def _vote(tree: DecisionTreeClassificationModel, rows: DataFrame, out: str) -> DataFrame:
    tree.setFeaturesCol("_x").setRawPredictionCol("").setProbabilityCol("")
    return tree.setPredictionCol(out).transform(rows)


@dataclass
class CentreScorer(Scorer):
    """Distance to two cluster centres; closer to the positive one is more likely positive."""

    scaler: FittedStandardizer = None
    centres: list[list[float]] = field(default_factory=list)
    positive: int = 1

    def distance(self, k: int) -> Column:
        squares = [
            F.pow(self.scaler.value(c) - F.lit(float(m)), F.lit(2.0))
            for c, m in zip(self.columns, self.centres[k])
        ]
        return F.sqrt(sum(squares[1:], squares[0]))

    def with_score(self, df: DataFrame, out: str = "p") -> DataFrame:
        near, far = self.distance(self.positive), self.distance(1 - self.positive)
        return df.withColumn(out, scores.clip(far / (near + far + F.lit(1e-9)), 0, 1))

    def save(self, spark, path: str) -> None:
        state = {
            "kind": "centres",
            "columns": self.columns,
            "moments": self.scaler.moments,
            "centres": self.centres,
            "positive": self.positive,
        }
        write_text(spark, f"{path}/scorer.json", json.dumps(state))


@dataclass
class MixtureScorer(Scorer):
    """Posterior of the component aligned with the positive class."""

    model: GaussianMixtureModel = None
    scaler: FittedStandardizer = None
    positive: int = 1

    def with_score(self, df: DataFrame, out: str = "p") -> DataFrame:
        rows = _model_input(df, self.columns, self.scaler)
        self.model.setFeaturesCol("_x").setProbabilityCol("_prob").setPredictionCol("_c")
        scored = self.model.transform(rows)
        p = scores.clip(vector_to_array("_prob")[self.positive], 0, 1)
        return scored.select(*df.columns, p.alias(out))

    def save(self, spark, path: str) -> None:
        self.model.write().save(f"{path}/model")
        state = {
            "kind": "mixture",
            "columns": self.columns,
            "moments": self.scaler.moments,
            "positive": self.positive,
        }
        write_text(spark, f"{path}/scorer.json", json.dumps(state))


def load_scorer(spark, path: str) -> Scorer:
    state = json.loads(read_text(spark, f"{path}/scorer.json"))
    columns = state["columns"]
    scaler = None
    if state.get("moments"):
        scaler = FittedStandardizer({c: tuple(m) for c, m in state["moments"].items()})
    kind = state["kind"]
    if kind == "ml":
        return MLScorer(columns, _ML_MODELS[state["class"]].load(f"{path}/model"), scaler, state.get("frequencies", []))
    if kind == "boosted":
        return BoostedScorer(columns, GBTRegressionModel.load(f"{path}/model"), state["init"])
    if kind == "voting":
        trees = [
            DecisionTreeClassificationModel.load(f"{path}/tree-{i:04d}")
            for i in range(len(state["alphas"]))
        ]
        return VotingScorer(columns, trees, state["alphas"])
    if kind == "centres":
        return CentreScorer(columns, scaler, state["centres"], state["positive"])
    if kind == "mixture":
        model = GaussianMixtureModel.load(f"{path}/model")
        return MixtureScorer(columns, model, scaler, state["positive"])
    raise ValueError(f"unknown scorer kind: {kind!r}")


# ---------------------------------------------------------------- fitting


def _training_rows(
    train: DataFrame,
    columns: list[str],
    label: str,
    weighting: str | None,
    all_cores: bool = True,
    pack: bool = True,
) -> DataFrame:
    """Vector, label, weight and count; with ``pack`` equal rows are one, with their weights together, where they
    repeat ``REPEATS`` times on average. Sums then differ by rounding, which may decide between equally near cuts.
    Rows that come with counts are taken as they are.

    Trees use every core even on one small file; the many short passes of a linear model are
    better off with the partitions as they are.
    """
    if COUNT in train.columns:
        train = train.select(label, *columns, COUNT)
    else:
        train = train.select(label, *columns)
        distinct = counted_rows(train) if pack else None
        train = train.withColumn(COUNT, F.lit(1).cast("long")) if distinct is None else distinct
    if all_cores:
        train = spread(train)
    weighted = {
        None: lambda d: d.withColumn("_w", F.lit(1.0)),
        "balanced": lambda d: with_balanced_weight(d, label, "_w", COUNT),
        "ratio": lambda d: with_imbalance_weight(d, label, "_w", COUNT),
    }[weighting](train)
    return assemble(weighted, columns, "_x").select(
        "_x", F.col(label).cast("double").alias("_y"), (F.col("_w") * F.col(COUNT)).alias("_w"), COUNT
    )


def _depth(params: dict) -> int:
    """Tree depth from an explicit depth or from a leaf count (trees grow level by level)."""
    depth = params.get("max_depth", params.get("depth"))
    if depth is None and "num_leaves" in params:
        depth = math.ceil(math.log2(params["num_leaves"]))
    return MAX_TREE_DEPTH if depth is None else min(int(depth), MAX_TREE_DEPTH)


def _bins(params: dict) -> int:
    """How finely tree learners cut a feature; Spark's own default of 32 is coarse for skewed counts."""
    return int(params.get("max_bins", MAX_BINS))


def _boosted(train, columns, label, params, seed, loss, weighting, guarded=False) -> Scorer:
    rows = _training_rows(train, columns, label, weighting)
    model, init = boosting.boost(
        rows,
        loss,
        rounds=int(params.get("n_estimators", params.get("iterations", 100))),
        rate=float(params["learning_rate"]),
        depth=_depth(params),
        bins=_bins(params),
        penalty=float(params.get("reg_lambda", params.get("l2_leaf_reg", 0.0))),
        min_rows=int(params.get("min_child_samples", 1)),
        min_bend=float(params.get("min_child_weight", 0.0)),
        row_share=float(params.get("subsample", 1.0)),
        column_share=float(params.get("colsample_bytree", 1.0)),
        guarded=guarded,
        stage_every=int(params.get("stage_every", boosting.STAGE_EVERY)),
        seed=seed,
    )
    return BoostedScorer(columns, model, init)


def fit_gradient_boosting(weighting: str) -> Callable:
    """Newton boosting of the weighted log loss."""

    def fit(train, columns, label, params, seed) -> Scorer:
        return _boosted(train, columns, label, params, seed, boosting.log_loss(), weighting)

    return fit


def _forest(rows: DataFrame, params: dict, seed: int) -> RandomForestClassificationModel:
    """A forest on rows (_x, _y, _w, _n).

    Where rows repeat, a bootstrap draws counts of distinct rows: each tree is fitted to its own draw, ``TREES_AT_ONCE``
    at a time, and the trees are joined. Where they hardly do, Spark draws the rows and grows all trees together.
    """
    n_trees, least = int(params["n_estimators"]), int(params.get("min_samples_leaf", 1))
    learner = RandomForestClassifier(
        featuresCol="_x",
        labelCol="_y",
        weightCol="_w",
        numTrees=n_trees,
        maxDepth=_depth(params),
        maxBins=_bins(params),
        minInstancesPerNode=least,
        seed=seed,
    )
    n_rows, n_distinct, top = rows.agg(F.sum(COUNT), F.count(F.lit(1)), F.max("_y")).first()
    if n_rows == n_distinct or not n_distinct:
        return learner.fit(rows)
    if n_rows < REPEATS * n_distinct:
        flat = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(COUNT).cast("int"))))
        return learner.fit(flat.withColumn("_w", F.col("_w") / F.col(COUNT)))
    classes = {"ml_attr": {"type": "nominal", "vals": [str(k) for k in range(max(2, int(top) + 1))]}}
    rows = rows.withColumn("_y", F.col("_y").alias("_y", metadata=classes))
    learner = learner.setNumTrees(1).setBootstrap(False).setMaxMemoryInMB(1024)
    learner = learner.setFeatureSubsetStrategy("sqrt" if n_trees > 1 else "all")

    def tree(t: int):
        taken = drawn(F.col(COUNT), F.xxhash64(F.lit(seed + t), "_x", "_y"))
        bag = rows.withColumn("_taken", taken).filter("_taken > 0")
        bag = bag.withColumn("_w", F.col("_w") * F.col("_taken") / F.col(COUNT))
        return learner.copy({learner.seed: seed + t}).fit(dealt(bag, "_taken", ["_w"], least)).trees[0]

    with ThreadPoolExecutor(max_workers=TREES_AT_ONCE) as pool:
        trees = list(pool.map(inheritable_thread_target(rows.sparkSession)(tree), range(n_trees)))
    gateway = rows.sparkSession.sparkContext._gateway
    made = gateway.jvm.org.apache.spark.ml.classification
    members = gateway.new_array(made.DecisionTreeClassificationModel, n_trees)
    for i, one in enumerate(trees):
        members[i] = one._java_obj
    first = trees[0]
    uid = f"bagged_{first.uid}"
    joined = made.RandomForestClassificationModel(uid, members, first.numFeatures, first.numClasses)
    joined.set(joined.numTrees(), n_trees)
    return RandomForestClassificationModel(joined)


def fit_forest(train, columns, label, params, seed) -> Scorer:
    return MLScorer(columns, _forest(_training_rows(train, columns, label, "balanced"), params, seed))


def fit_logistic(train, columns, label, params, seed) -> Scorer:
    """Balanced logistic regression; C maps to Spark's penalty per unit of total weight."""
    rows = _training_rows(train, columns, label, "balanced", all_cores=False)
    # Balanced weights sum to the number of rows.
    total, n_rows = rows.agg(F.sum("_w"), F.count(F.lit(1))).first()
    model = LogisticRegression(
        featuresCol="_x",
        labelCol="_y",
        weightCol="_w",
        regParam=1.0 / (float(params["C"]) * total),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=int(params.get("max_iter", 1000)),
        tol=1e-4,
    ).fit(rows.coalesce(max(1, -(-n_rows // ROWS_A_TASK))))
    return MLScorer(columns, model)


def fit_network(train, columns, label, params, seed) -> Scorer:
    periodic, steps = int(params.get("periodic", 0)), int(params["max_iter"])
    scaler, frequencies, table = net_table(train, columns, label, seed, periodic)
    layers = [len(columns) * (1 + 2 * periodic), int(params["hidden1"]), int(params["hidden2"]), int(params["hidden3"]), 2]
    net = SlicedNet(table, layers, steps, seed)
    net.train()
    drop_stage(table)
    model = perceptron(train.sparkSession, layers, seed, net.last, featuresCol="_x", labelCol="_y")
    return MLScorer(columns, model, scaler, frequencies)


def fit_focal_boosting(exact: bool) -> Callable:
    """Newton boosting of the focal loss: by its own derivative, or by the scripted objectives' formulas."""

    def fit(train, columns, label, params, seed) -> Scorer:
        made = boosting.focal_exact if exact else boosting.focal_terms
        loss = made(float(params["gamma"]), float(params["alpha"]))
        return _boosted(train, columns, label, params, seed, loss, None, guarded=exact)

    return fit


def fit_adaboost(train, columns, label, params, seed) -> Scorer:
    """Discrete boosting of balanced trees: one tree and one aggregate per round."""
    rate = float(params["learning_rate"])
    rows = _training_rows(train, columns, label, "balanced", pack=False).select("_x", "_y", F.col("_w").alias("_c"))
    state = stage_table(rows.withColumn("_b", F.lit(1.0)), "adaboost")
    learner = DecisionTreeClassifier(
        featuresCol="_x", labelCol="_y", weightCol="_w", maxDepth=_depth(params), maxBins=_bins(params), seed=seed
    )
    trees, alphas = [], []
    for done in range(1, int(params["n_estimators"]) + 1):
        tree = learner.fit(state.withColumn("_w", F.col("_b") * F.col("_c")))
        voted = _vote(tree, state, "_v")
        missed = F.col("_v") != F.col("_y")
        wrong, total, n = voted.agg(
            F.sum(F.when(missed, F.col("_b")).otherwise(0.0)), F.sum("_b"), F.count(F.lit(1))
        ).first()
        error = wrong / total
        if error >= 0.5:
            if not trees:
                raise ValueError("the first tree is no better than chance")
            break
        alpha = 1.0 if error <= 0 else rate * math.log((1.0 - error) / error)
        trees.append(tree)
        alphas.append(alpha)
        if error <= 0:
            break
        grown = F.when(missed, F.col("_b") * F.lit(math.exp(alpha))).otherwise(F.col("_b"))
        # Mean weight 1 keeps the numbers in range whatever the number of rounds.
        scale = n / (total - wrong + wrong * math.exp(alpha))
        state = voted.withColumn("_b", grown * F.lit(scale)).drop("_v")
        if done % STAGE_EVERY == 0:
            state = stage_table(state, "adaboost")
    return VotingScorer(columns, trees, alphas)


def align_clusters(assigned: DataFrame, cluster: str, label: str = LABEL) -> DataFrame:
    """Positive rate per cluster (one row each)."""
    return assigned.groupBy(cluster).agg(
        F.avg(F.col(label).cast("double")).alias("positive_rate"), F.count(F.lit(1)).alias("n")
    )


def positive_cluster(rates: DataFrame, cluster: str) -> int:
    """Cluster 1 if its rate is at least that of cluster 0; an empty cluster counts 0."""
    by = {int(r[cluster]): r["positive_rate"] for r in rates.collect()}
    return 1 if by.get(1, 0.0) >= by.get(0, 0.0) else 0


def fit_clusters(train, columns, label, params, seed) -> Scorer:
    scaler = Standardizer().fit(train, columns)
    if params["algo"] == "gmm":
        rows = stage_table(_model_input(train, columns, scaler).select("_x", F.col(label).alias("_y")), "cluster")
        model = GaussianMixture(featuresCol="_x", k=2, seed=seed).fit(rows)
        assigned = model.setPredictionCol("_c").transform(rows)
        return MixtureScorer(
            columns, model, scaler, positive_cluster(align_clusters(assigned, "_c", "_y"), "_c")
        )
    names = [f"_z{i}" for i in range(len(columns))]
    raw = packed(train.select(F.col(label).alias("_y"), *columns))
    scaled = stage_table(raw.select("_y", COUNT, *[scaler.value(c).alias(n) for c, n in zip(columns, names)]), "cluster")
    centres = two_means(scaled, names, int(params["n_init"]), seed, count=COUNT)
    code = F.when(_square(columns, centres[1]) < _square(columns, centres[0]), 1).otherwise(0)
    rates = scaled.groupBy(code.alias("_c")).agg((F.sum(F.col("_y").cast("double") * F.col(COUNT)) / F.sum(F.when(F.col("_y").isNotNull(), F.col(COUNT)))).alias("positive_rate"))
    positive = positive_cluster(rates, "_c")
    drop_stage(scaled)
    return CentreScorer(columns, scaler, centres, positive)


def _square(columns: list, centre: list[float]) -> Column:
    """Squared distance of the scaled row from a centre."""
    return sum(((F.col(f"_z{i}") - F.lit(float(m))) ** 2 for i, m in enumerate(centre)), F.lit(0.0))


def two_means(rows: DataFrame, names: list[str], restarts: int, seed: int, max_iter: int = 20, tol: float = 1e-4, count: str | None = None) -> list[list[float]]:
    """The two centres of the cheapest of several k-means runs (Lloyd), all runs in the same passes.

    ``count`` names how many equal rows a row stands for.

    A task sums its batches by (run, centre), so a pass sends two rows per run and task whatever the number of rows. A run
    starts from two rows chosen by a hash of their values, so it does not depend on how the rows are dealt.
    """
    point = F.array(*names)
    firsts = [F.min_by(point, F.xxhash64(*names, F.lit(seed + r), F.lit(j))).alias(f"c{r}_{j}") for r in range(restarts) for j in range(2)]
    told = rows.agg(*firsts).first()
    origin = [0.0] * len(names)
    centres = [[list(told[f"c{r}_{j}"] or origin) for j in range(2)] for r in range(restarts)]

    width = len(names)

    def summed() -> dict[tuple[int, int], dict]:
        now = np.array(centres, dtype=float)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            told = np.zeros((len(now), 2, 2 + width))
            for batch in batches:
                x, times = batch[names].to_numpy(dtype=float), batch["_times"].to_numpy(dtype=float)
                carried = np.column_stack([x, np.ones(len(x))]) * times[:, None]
                for r, pair in enumerate(now):
                    near, far = (sum((x[:, i] - c) ** 2 for i, c in enumerate(m)) for m in pair)
                    is_far = far < near
                    cost = np.minimum(near, far) * times
                    for j, mine in enumerate((~is_far, is_far)):
                        told[r, j, 0] += cost[mine].sum()
                        told[r, j, 1:] += mine.astype(float) @ carried
            flat = pd.DataFrame(told.reshape(-1, 2 + width), columns=["cost", *names, "n"])
            flat["run"], flat["centre"] = np.repeat(range(len(now)), 2), np.tile([0, 1], len(now))
            yield flat[flat["n"] > 0][["run", "centre", "n", "cost", *names]]

        fields = ", ".join(["run int", "centre int", "n double", "cost double", *[f"{c} double" for c in names]])
        by = weighted.mapInPandas(partial, fields).groupBy("run", "centre")
        sums = by.agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(c).alias(c) for c in names])
        return {(x["run"], x["centre"]): x.asDict() for x in sums.collect()}

    weighted = rows.select(*names, (F.lit(1) if count is None else F.col(count)).alias("_times"))
    found = summed()
    for _ in range(max_iter):
        shift = 0.0
        for (r, j), x in found.items():
            moved = [x[c] / x["n"] for c in names]
            shift = max(shift, math.dist(moved, centres[r][j]))
            centres[r][j] = moved
        # The costs are those of the centres as they stand now.
        found = summed()
        if shift <= tol:
            break
    cost = [sum(found[r, j]["cost"] for j in range(2) if (r, j) in found) for r in range(restarts)]
    return centres[cost.index(min(cost))]


def forest_importance(
    train: DataFrame,
    columns: list[str],
    label: str = LABEL,
    n_estimators: int = 300,
    max_depth: int | None = None,
    seed: int = 42,
    batch: int = 50,
) -> DataFrame:
    """(feature, importance) by impurity decrease of a balanced forest, highest first.

    The forest grows ``batch`` trees at a time, each with its own seed; a forest's importance is the mean of its
    trees', so only one batch is ever in the driver's memory. From ``MANY_ROWS`` distinct rows on, small nodes are grown
    whole in one task each (``forest``), by the same rules and other draws.
    """
    values = np.zeros(len(columns))
    rows = stage_table(_training_rows(train, columns, label, "balanced"), "forest")
    n_rows, others = rows.agg(F.count(F.lit(1)), F.count_if(F.coalesce(~F.col("_y").isin(0.0, 1.0), F.lit(True)))).first()
    depth = _depth({"max_depth": max_depth})
    for start in range(0, n_estimators, batch):
        n = min(batch, n_estimators - start)
        if n_rows > MANY_ROWS and not others:
            seeds = [seed + start + t for t in range(n)]
            # A single tree sees all features at every node, as Spark's does.
            width = math.ceil(math.sqrt(len(columns))) if n > 1 else len(columns)
            trees = forest.importances(rows, len(columns), seeds, [width] * n, MAX_BINS, depth)
            trees = (trees / np.maximum(trees.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
            values += n * trees / max(trees.sum(), 1e-300)
            continue
        model = _forest(rows, {"n_estimators": n, "max_depth": max_depth}, seed + start)
        # Spark scales a forest's importances to a sum of one, as it does each tree's.
        values += n * model.featureImportances.toArray()
    drop_stage(rows)
    values = (values / max(values.sum(), 1e-300)).tolist()
    rows = sorted(zip(columns, values), key=lambda r: (-r[1], r[0]))
    return train.sparkSession.createDataFrame(rows, "feature string, importance double")


# ---------------------------------------------------------------- registry


@dataclass
class Learner:
    """A named classifier with its defaults and search spaces.

    ``counted`` says that ``fit_rows`` reads a ``COUNT`` column, if there is one, as so many equal rows; to other
    learners counted rows are unpacked.
    """

    name: str
    fit_rows: Callable
    defaults: dict
    grid: dict[str, list]
    distributions: dict[str, tuple] | None = None
    forced_mode: str | None = None
    counted: bool = False

    def fit(
        self, train: DataFrame, columns: list[str], label: str = LABEL, seed: int = 42, **params
    ) -> Scorer:
        rows = train if self.counted else unpacked(train)
        return self.fit_rows(rows, list(columns), label, {**self.defaults, **params}, seed)


# Defaults, grids and sampling ranges of the registered models.
# Ranges: ("int", low, high), high excluded; ("uniform", low, high); ("log", low, high).
_BOOST_GRID = {"n_estimators": [200, 400], "learning_rate": [0.03, 0.1]}
_ROW_SHARE = ("uniform", 0.6, 1.0)
_RATE = ("log", 0.01, 0.2)
_ROUNDS = ("int", 200, 800)
_PENALTY = ("log", 1e-3, 10.0)
_C_GRID = {"C": [0.01, 0.1, 1.0, 10.0]}
_FOCAL_GRID = {"gamma": [1.0, 2.0], "alpha": [0.25, 0.5], "n_estimators": [400]}
_FOCAL = {"gamma": 2.0, "alpha": 0.25, "n_estimators": 400, "learning_rate": 0.05}

LEARNERS: dict[str, Learner] = {
    m.name: m
    for m in [
        Learner(
            "lightgbm",
            fit_gradient_boosting("ratio"),
            {"n_estimators": 100, "learning_rate": 0.1, "num_leaves": 31, "min_child_samples": 20, "reg_lambda": 0.0},
            {**_BOOST_GRID, "num_leaves": [15, 31], "min_child_samples": [20, 50]},
            {
                "n_estimators": _ROUNDS,
                "learning_rate": _RATE,
                "num_leaves": ("int", 15, 96),
                "min_child_samples": ("int", 10, 100),
                "subsample": _ROW_SHARE,
                "colsample_bytree": _ROW_SHARE,
                "reg_lambda": _PENALTY,
            },
            counted=True,
        ),
        Learner(
            "xgboost",
            fit_gradient_boosting("ratio"),
            {"n_estimators": 100, "learning_rate": 0.3, "max_depth": 6, "reg_lambda": 1.0, "min_child_weight": 1},
            {**_BOOST_GRID, "max_depth": [3, 6], "subsample": [0.8, 1.0]},
            {
                "n_estimators": _ROUNDS,
                "learning_rate": _RATE,
                "max_depth": ("int", 3, 10),
                "subsample": _ROW_SHARE,
                "colsample_bytree": _ROW_SHARE,
                "min_child_weight": ("int", 1, 10),
                "reg_lambda": _PENALTY,
            },
            counted=True,
        ),
        Learner(
            "catboost",
            fit_gradient_boosting("balanced"),
            {"iterations": 100, "learning_rate": 0.1, "depth": 6, "l2_leaf_reg": 3.0},
            {"iterations": [200, 400], "learning_rate": [0.03, 0.1], "depth": [4, 6]},
            {"iterations": _ROUNDS, "learning_rate": _RATE, "depth": ("int", 4, 9), "l2_leaf_reg": ("log", 1.0, 30.0)},
            counted=True,
        ),
        Learner("logreg_woe", fit_logistic, {"C": 1.0}, _C_GRID, forced_mode="binned_woe", counted=True),
        Learner("logreg", fit_logistic, {"C": 1.0}, _C_GRID, counted=True),
        Learner(
            "randomforest",
            fit_forest,
            {"n_estimators": 100, "max_depth": None},
            {"n_estimators": [300, 600], "max_depth": [None, 8, 16], "min_samples_leaf": [1, 5]},
            counted=True,
        ),
        Learner(
            "catboost_focal",
            fit_focal_boosting(True),
            {"gamma": 2.0, "alpha": 0.25, "iterations": 100, "learning_rate": 0.1, "depth": 6, "l2_leaf_reg": 3.0},
            {"iterations": [200, 400], "learning_rate": [0.05, 0.1], "depth": [4, 6]},
            counted=True,
        ),
        Learner(
            "lightgbm_focal",
            fit_focal_boosting(False),
            {**_FOCAL, "num_leaves": 31},
            {**_FOCAL_GRID, "learning_rate": [0.05]},
            counted=True,
        ),
        Learner(
            "xgboost_focal",
            fit_focal_boosting(False),
            {**_FOCAL, "max_depth": 6, "reg_lambda": 1.0},
            {**_FOCAL_GRID, "max_depth": [6]},
            counted=True,
        ),
        Learner(
            "lightgbm_focal_native",
            fit_focal_boosting(False),
            {**_FOCAL, "num_leaves": 31},
            {**_FOCAL_GRID, "learning_rate": [0.05]},
            counted=True,
        ),
        Learner(
            "xgboost_focal_native",
            fit_focal_boosting(False),
            {**_FOCAL, "max_depth": 6, "reg_lambda": 1.0},
            {**_FOCAL_GRID, "max_depth": [6]},
            counted=True,
        ),
        Learner(
            "adaboost",
            fit_adaboost,
            {"n_estimators": 50, "learning_rate": 1.0, "max_depth": 3},
            {"n_estimators": [200, 400], "learning_rate": [0.5, 1.0], "max_depth": [2, 3]},
        ),
        Learner(
            "cluster", fit_clusters, {"algo": "kmeans", "n_init": 10}, {"algo": ["kmeans", "gmm"]}
        ),
        Learner(
            "tensorflow_dnn",
            fit_network,
            {"hidden1": 40, "hidden2": 20, "hidden3": 16, "max_iter": 100},
            {"max_iter": [100]},
            counted=True,
        ),
    ]
}
# Fixed value: the order decides ties in a blend.
DEFAULT_MODELS = ["lightgbm", "catboost", "xgboost"]

