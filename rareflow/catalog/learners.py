"""Queries: learners, latent features, importance and search on the whole count table.

Learned models have no SQL counterpart. Each query fits on the train part of the
table and returns one row of test metrics (or the transformed rows).
"""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import latent, learners
from ..operators.metrics import metric_record, score_curve
from ..operators.splits import holdout_split, part
from ..plans.experiment import (
    ExperimentConfig,
    architecture_sweep,
    embedding_study,
    results_table,
    run_experiments,
    run_model,
    save_best,
)
from ..plans.recipes import FEATURE_MODES, FeatureRecipe
from ..plans.search import candidate_means, random_candidates, search
from ..plans.versions import list_versions, load_version
from ..schema import LABEL, ROW_ID, has_labels
from ..session import shared_dir, stage_table
from .base import (
    FEATURES,
    HOLDOUT_SQL,
    ORACLE,
    counts,
    query,
    r6,
    rounded,
    staged_counts,
    with_sql,
)
from .features import CATALOGUE_SQL, LOGZ_SQL, MOMENTS_SQL, P95_SQL


def _split_table(spark, sf_dir):
    df = staged_counts(spark, sf_dir).select(ROW_ID, *FEATURES, LABEL)
    return stage_table(holdout_split(df), "query-split")


def _fit_and_test(spark, sf_dir, name, mode="raw", **params):
    data = _split_table(spark, sf_dir)
    recipe, prepared = FeatureRecipe(mode).fit_transform(part(data, "train"), FEATURES)
    scorer = learners.LEARNERS[name].fit(
        stage_table(prepared.select(LABEL, *recipe.columns)), recipe.columns, **params
    )
    test = scorer.with_score(recipe.transform(part(data, "test")), "p")
    record = metric_record(score_curve(test, "p"), 0.5)
    return rounded(record.select(F.lit(name).alias("model"), "*"))


# Fewer trees than the registry's defaults, so that a check on one machine ends; enough for margins to be staged.
_QUICK = {
    "m01_lightgbm": ("lightgbm", {"n_estimators": 12, "num_leaves": 15, "reg_lambda": 1.0}),
    "m02_xgboost": ("xgboost", {"n_estimators": 12, "max_depth": 4, "subsample": 0.8, "colsample_bytree": 0.8}),
    "m03_catboost": ("catboost", {"iterations": 12, "depth": 4}),
    "m04_logreg_woe": ("logreg_woe", {}),
    "m05_logreg": ("logreg", {}),
    "m06_randomforest": ("randomforest", {"n_estimators": 20, "max_depth": 8}),
    "m07_catboost_focal": ("catboost_focal", {"iterations": 12, "depth": 4}),
    "m08_lightgbm_focal": ("lightgbm_focal", {"n_estimators": 12, "num_leaves": 15}),
    "m08_xgboost_focal": ("xgboost_focal", {"n_estimators": 12, "max_depth": 4}),
    "m09_lightgbm_focal_native": ("lightgbm_focal_native", {"n_estimators": 12, "num_leaves": 15}),
    "m09_xgboost_focal_native": ("xgboost_focal_native", {"n_estimators": 12, "max_depth": 4}),
    "m10_adaboost": ("adaboost", {"n_estimators": 12}),
    "m11_cluster_kmeans": ("cluster", {"algo": "kmeans"}),
    "m12_cluster_gmm": ("cluster", {"algo": "gmm"}),
    "m13_dense_net": ("tensorflow_dnn", {"max_iter": 40}),
}


def _register_learner(key: str, name: str, params: dict) -> None:
    mode = learners.LEARNERS[name].forced_mode or "raw"

    @query(key)
    def run(spark, sf_dir):
        return _fit_and_test(spark, sf_dir, name, mode, **params)


for _key, (_name, _params) in _QUICK.items():
    _register_learner(_key, _name, _params)


@query("e11_linear_bottleneck")
def bottleneck(spark, sf_dir):
    data = _split_table(spark, sf_dir)
    fitted = latent.LinearBottleneck().fit(part(data, "train"), FEATURES)
    return rounded(fitted.transform(data))


@query("e12_linear_denoiser")
def denoiser(spark, sf_dir):
    data = _split_table(spark, sf_dir)
    fitted = latent.LinearDenoiser().fit(part(data, "train"), FEATURES)
    return rounded(fitted.transform(data))


@query("e13_hidden_layer_embedding")
def embedding(spark, sf_dir):
    data = _split_table(spark, sf_dir)
    net = latent.HiddenLayerEmbedding(max_iter=20)
    return rounded(net.fit(part(data, "train"), FEATURES).transform(data))


@query("e13_embedding_slices")
def embedding_slices(spark, sf_dir):
    """Held-out and training average precision after each slice of the net's training, and the slice it keeps."""
    data = _split_table(spark, sf_dir)
    net = latent.HiddenLayerEmbedding(max_iter=40, slices=4, holdout=0.2, patience=4, periodic=2)
    fitted = net.fit(part(data, "train"), FEATURES)
    rows = [(i, held, own, i == fitted.best, fitted.overfit_gap()) for i, (held, own) in enumerate(fitted.history)]
    return rounded(
        spark.createDataFrame(rows, "slice int, holdout_ap double, train_ap double, kept boolean, overfit_gap double")
    )


@query("r07_architecture_sweep")
def sweep(spark, sf_dir):
    """Hidden widths by successive halving on held-out average precision."""
    widths = [(40, 20), (20, 10), (12, 8), (8, 4)]
    settings = {"max_iter": 18, "slices": 3, "embedding_dim": 6, "holdout": 0.2}
    return rounded(architecture_sweep(_split_table(spark, sf_dir), widths, _config(), settings))


@query("s02_has_labels", with_sql("SELECT true AS labelled, false AS unlabelled, count(*) AS n FROM counts"))
def labelled(spark, sf_dir):
    """Evaluation or inference, told from the columns alone."""
    df = counts(spark, sf_dir)
    return df.agg(F.lit(has_labels(df)).alias("labelled"), F.lit(has_labels(df.drop(LABEL))).alias("unlabelled"), F.count(F.lit(1)).alias("n"))


@query("p03_embedding_columns")
def embedding_columns(spark, sf_dir):
    data = _split_table(spark, sf_dir)
    net = latent.HiddenLayerEmbedding(max_iter=5)
    embedded = net.fit(part(data, "train"), FEATURES).transform(data)
    return rounded(latent.prefixed(embedded, "nn_", [ROW_ID]))


@query(
    "p03_prefix_projection",
    with_sql("SELECT row_id, num_links, num_stopwords, num_spelling_errors, num_words,"
             " num_unique_words, num_unique_domains, num_email_addresses, num_urgent_keywords FROM counts"),
)
def prefix_projection(spark, sf_dir):
    return latent.prefixed(counts(spark, sf_dir), "num_", [ROW_ID])


def _exact(column: str) -> str:
    """A catalogue column without its rounding."""
    return re.sub(r"^round\((.*), 6\) \+ 0\.0 AS (\w+)$", r"\1 AS \2", column, flags=re.S)


_NAMES = [c.split(" AS ")[-1] for c in CATALOGUE_SQL]
_CATALOGUE_CTES = HOLDOUT_SQL + P95_SQL + MOMENTS_SQL
_CATALOGUE = f", cat AS (SELECT row_id, label_1, split, {', '.join(map(_exact, CATALOGUE_SQL))} FROM parts)"


def _target_sql(columns: list[str], source: str, ctes: str) -> str:
    """Smoothed maps of the train rows of ``source``, applied to all of its rows."""
    maps = "".join(
        f", tm_{c} AS (SELECT {c} AS value, (sum(label_1) + p * 20e0) / (count(*) + 20e0) AS te"
        f" FROM {source}, tprior WHERE split = 'train' GROUP BY {c}, p)"
        for c in columns
    )
    values = ", ".join(r6(f"coalesce(tm_{c}.te, p)", f"{c}_te") for c in columns)
    joins = " ".join(f"LEFT JOIN tm_{c} ON tm_{c}.value = {source}.{c}" for c in columns)
    prior = f", tprior AS (SELECT avg(label_1) AS p FROM {source} WHERE split = 'train')"
    return with_sql(f"SELECT row_id, label_1, {values} FROM {source} {joins} CROSS JOIN tprior", ctes + prior + maps)


def _bins_sql(columns: list[str], source: str, ctes: str) -> str:
    """Eighths of the train rows of ``source``, applied to all of its rows."""
    points = lambda c: ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {i / 8}e0)" for i in range(9))
    edges = ", ".join(f"list_sort(list_distinct([{points(c)}])) AS e_{c}" for c in columns)
    values = ", ".join(
        f"CAST(len(list_filter(e_{c}[2:len(e_{c}) - 1], lambda q: q <= {c})) AS INTEGER) AS {c}_bin" for c in columns
    )
    cut = f", cuts AS (SELECT {edges} FROM {source} WHERE split = 'train')"
    return with_sql(f"SELECT row_id, label_1, {values} FROM {source}, cuts", ctes + cut)


_MODE_SQL = {
    "engineered_noemail": with_sql(
        f"SELECT row_id, label_1, {', '.join(c for c in CATALOGUE_SQL if c not in LOGZ_SQL)} FROM counts",
        HOLDOUT_SQL + P95_SQL,
    ),
    "ix_engineered": with_sql(
        f"SELECT row_id, label_1, {', '.join(CATALOGUE_SQL)}, "
        + ", ".join(f"{a} * {b} AS {a}__x__{b}" for a, b in combinations(FEATURES, 2))
        + " FROM counts",
        _CATALOGUE_CTES,
    ),
    "target": _target_sql(FEATURES, "parts", HOLDOUT_SQL),
    "engineered_target": _target_sql(_NAMES, "cat", _CATALOGUE_CTES + _CATALOGUE),
    "engineered_quantile": _bins_sql(_NAMES, "cat", _CATALOGUE_CTES + _CATALOGUE),
    "raw": with_sql(f"SELECT row_id, {', '.join(FEATURES)}, label_1 FROM counts"),
    "quantile": ORACLE["e01_quantile_bins"],
    "engineered": ORACLE["f10_catalogue"],
    "ix_raw": ORACLE["f12_interactions"],
}


def _register_mode(mode: str) -> None:
    @query(f"e16_{mode}", _MODE_SQL.get(mode))
    def run(spark, sf_dir):
        data = _split_table(spark, sf_dir)
        recipe = FeatureRecipe(mode)
        fitted = recipe.fit(part(data, "train"), FEATURES)
        return rounded(fitted.transform(data.drop("split")))


for _mode in FEATURE_MODES:
    _register_mode(_mode)


@query("a14_forest_importance")
def importance(spark, sf_dir):
    data = part(_split_table(spark, sf_dir), "train")
    return rounded(learners.forest_importance(data, FEATURES, n_estimators=20))


_CLUSTER = "CAST(num_links >= 2 AS INTEGER)"


@query(
    "a16_cluster_alignment",
    with_sql(
        f"SELECT {_CLUSTER} AS cluster, {r6('avg(CAST(label_1 AS DOUBLE))', 'positive_rate')},"
        " count(*) AS n FROM counts GROUP BY 1"
    ),
)
def alignment(spark, sf_dir):
    df = counts(spark, sf_dir).withColumn("cluster", (F.col("num_links") >= 2).cast("int"))
    return rounded(learners.align_clusters(df, "cluster"))


# ------------------------------------------------------------------ scores and losses

_MARGIN = "(CAST(num_links AS DOUBLE) + num_urgent_keywords - 3e0)"
_SIG = f"1e0 / (1e0 + exp(-{_MARGIN}))"


@query(
    "c04_score_maps",
    with_sql(
        f"SELECT row_id, {r6(_SIG, 'p')}, {r6(f'({_MARGIN} - lo) / (hi - lo)', 'rescaled')},"
        f" {r6('ln(rate / (1e0 - rate))', 'prior_logit')}"
        f" FROM counts, (SELECT min({_MARGIN}) AS lo, max({_MARGIN}) AS hi, avg(label_1) AS rate FROM counts)"
    ),
)
def score_maps(spark, sf_dir):
    margin = F.col("num_links").cast("double") + F.col("num_urgent_keywords") - 3.0
    df = staged_counts(spark, sf_dir).select(ROW_ID, LABEL, margin.alias("m"))
    rate = df.agg(F.avg(LABEL)).first()[0]
    scaled = scores.with_rescaled(df, "m", "rescaled")
    return rounded(
        scaled.select(
            ROW_ID,
            scores.sigmoid(F.col("m")).alias("p"),
            "rescaled",
            scores.prior_logit(F.lit(rate)).alias("prior_logit"),
        )
    )


@query(
    "c05_tanh_probability",
    with_sql(
        f"SELECT row_id, {r6('least(greatest((tanh(num_links - 2e0) + 1e0) / 2e0, 0e0), 1e0)', 'p')} FROM counts"
    ),
)
def tanh_probability(spark, sf_dir):
    score = F.tanh(F.col("num_links") - 2.0)
    return rounded(counts(spark, sf_dir).select(ROW_ID, scores.tanh_to_probability(score).alias("p")))


_FOCAL_BASE = f"""(SELECT row_id, label_1 AS y, {_SIG} AS p,
   CASE WHEN label_1 = 1 THEN {_SIG} ELSE 1e0 - {_SIG} END AS pt,
   CASE WHEN label_1 = 1 THEN 0.25e0 ELSE 0.75e0 END AS a FROM counts)"""


@query(
    "c06_focal_derivatives",
    with_sql(
        f"SELECT row_id, {r6('a * (pow(1e0 - pt, 2e0) * (p - y) + sign(p - y) * 2e0 * pow(1e0 - pt, 1e0) * pt * (-ln(pt)) * pt)', 'grad')},"
        f" {r6('greatest(a * pow(1e0 - pt, 2e0) * p * (1e0 - p) * (1e0 + 2e0 * pt), 1e-6)', 'hess')}"
        f" FROM {_FOCAL_BASE}"
    ),
)
def focal_derivatives(spark, sf_dir):
    margin = F.col("num_links").cast("double") + F.col("num_urgent_keywords") - 3.0
    y = F.col(LABEL)
    return rounded(
        counts(spark, sf_dir).select(
            ROW_ID,
            scores.focal_gradient(margin, y, 2.0, 0.25).alias("grad"),
            scores.focal_hessian(margin, y, 2.0, 0.25).alias("hess"),
        )
    )


@query(
    "c07_cross_entropy",
    with_sql(
        f"SELECT row_id, {r6('-(label_1 * ln(q) + (1e0 - label_1) * ln(1e0 - q))', 'loss')}"
        " FROM (SELECT row_id, label_1, least(greatest((tanh(num_links - 2e0) + 1e0) / 2e0, 1e-7), 1e0 - 1e-7) AS q FROM counts)"
    ),
)
def cross_entropy(spark, sf_dir):
    p = scores.tanh_to_probability(F.tanh(F.col("num_links") - 2.0))
    return rounded(
        counts(spark, sf_dir).select(ROW_ID, scores.cross_entropy(F.col(LABEL), p).alias("loss"))
    )


# ------------------------------------------------------------------ search and experiments

_FAST = {
    "lightgbm": [{"n_estimators": 4, "num_leaves": 8}, {"n_estimators": 4, "num_leaves": 4}],
    "logreg": [{"C": 0.1}, {"C": 1.0}],
    "randomforest": [{"n_estimators": 8, "max_depth": 5}],
}


def _config(**settings):
    return ExperimentConfig(n_folds=3, candidates=_FAST, **settings)


@query("r01_grid_search")
def grid_search(spark, sf_dir):
    train = part(_split_table(spark, sf_dir), "train")
    found = search(
        train, FEATURES, learners.LEARNERS["logreg"], FeatureRecipe("raw"), n_folds=3
    )
    return rounded(candidate_means(found.scores))


@query("r02_random_search")
def random_search(spark, sf_dir):
    """A booster on values drawn from its ranges; only the number of rounds has a range of its own here."""
    train = part(_split_table(spark, sf_dir), "train")
    learner = learners.LEARNERS["catboost"]
    drawn = random_candidates(learner, 3, ranges={"iterations": ("int", 11, 16), "depth": ("int", 3, 6)})
    found = search(
        train, FEATURES, learner, FeatureRecipe("raw"), n_folds=3, candidates=drawn
    )
    values = [(i, c["iterations"], c["learning_rate"], c["depth"], c["l2_leaf_reg"]) for i, c in enumerate(drawn)]
    table = spark.createDataFrame(values, "candidate int, iterations int, learning_rate double, depth int, l2_leaf_reg double")
    return rounded(found.scores.join(F.broadcast(table), "candidate"))


@query("r03_cached_search")
def cached_search(spark, sf_dir):
    """First run searches and stores the winner, the second one reads it; same metrics."""
    import uuid

    data = _split_table(spark, sf_dir)
    config = _config(cache_dir=f"{shared_dir(spark)}/best-params-{uuid.uuid4().hex}")
    runs = [run_model(data, "logreg", config) for _ in range(2)]
    rows = [(i, r.best_params["C"], r.cv_pr_auc, r.test_metrics["pr_auc"]) for i, r in enumerate(runs)]
    return rounded(spark.createDataFrame(rows, "run int, c double, cv_pr_auc double, test_pr_auc double"))


@query("r05_run_model")
def one_model(spark, sf_dir):
    result = run_model(_split_table(spark, sf_dir), "logreg", _config(mode="engineered"))
    return rounded(result.scores.select(ROW_ID, LABEL, "split", "p"))


@query("r06_run_experiments")
def experiments(spark, sf_dir):
    found = run_experiments(
        _split_table(spark, sf_dir), ["lightgbm", "logreg"], _config(), stacking=True
    )
    return results_table(*found)


@query("r06_top3_experiment")
def top3_experiment(spark, sf_dir):
    from ..operators.features import top3_frame

    data = _split_table(spark, sf_dir)
    flags = top3_frame(data, carry=[ROW_ID, "split"])
    return results_table(*run_experiments(stage_table(flags), ["logreg", "randomforest"], _config()))


@query("r07_embedding_study")
def study(spark, sf_dir):
    import uuid

    folder = f"{shared_dir(spark)}/embeddings-{uuid.uuid4().hex}"
    return rounded(
        embedding_study(
            _split_table(spark, sf_dir),
            ["logreg"],
            [4, 8],
            _config(),
            embedding={"max_iter": 10},
            cache_dir=folder,
        )
    )


@query("r08_save_and_load_best")
def save_and_load(spark, sf_dir):
    """Winner of two models saved as a version, listed, loaded and used on all rows."""
    import uuid

    data = _split_table(spark, sf_dir)
    results, ensembles = run_experiments(data, ["logreg", "randomforest"], _config())
    folder = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    name, _ = save_best(results, ensembles, folder)
    bundle, _ = load_version(spark, folder)
    listed = list_versions(spark, folder).count()
    scored = bundle.with_score(data, "p").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("p").alias("mean_p")
    )
    return rounded(
        scored.select(F.lit(name).alias("model"), F.lit(listed).alias("versions"), "n_rows", "mean_p")
    )


