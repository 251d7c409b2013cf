"""Queries: keys and slugs, caches, versions, run log, batch and streaming scoring."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from ..functions import hashing
from ..operators.metrics import metric_record, score_curve
from ..operators.woe import bin_counts, woe_table
from ..plans import runlog, scoring
from ..plans.versions import newest_first
from ..schema import LABEL, ROW_ID
from ..session import shared_dir
from ..sources.star import read_table
from ..streaming.score_stream import read_count_stream, start_scoring
from .base import (
    AP_SQL,
    AUC_SQL,
    F1_SQL,
    FEATURES,
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
from .encoders import FIXED_CUTS, woe_table_sql
from .ensembles import MODEL_A

VERSION = "linear_a__fixed"


def _folder(spark, kind):
    return f"{shared_dir(spark)}/rareflow-{kind}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ keys and slugs

_SLUG = "trim(regexp_replace(o_orderpriority, '[^A-Za-z0-9_.-]+', '_', 'g'), '_')"
_STAMP = "strftime(o_orderdate, '%Y%m%dT%H%M%SZ')"


@query("c01_version_names", f"SELECT o_orderkey, {_SLUG} || '__' || {_STAMP} AS version FROM orders")
def version_names(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    name = hashing.version_name(F.col("o_orderpriority"), F.col("o_orderdate"))
    return orders.select("o_orderkey", name.alias("version"))


def _sha(parts: list[str]) -> str:
    return f"substr(sha256({' || chr(124) || '.join(parts)}), 1, 16)"


_METHOD = "CASE WHEN p_size % 2 = 0 THEN 'random' ELSE 'grid' END"
_BUDGET = "CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'grid' END"
_COLUMNS = "list_aggregate(list_sort(string_split(p_name, ' ')), 'string_agg', ',')"
_OVERRIDES = "'dim=' || p_size || ',name=' || p_brand"
_SEARCH_KEY = _sha(["p_brand", "p_type", _METHOD, _BUDGET, "'5'", _COLUMNS, _OVERRIDES])


@query("c02_search_keys", f"SELECT p_partkey, {_SEARCH_KEY} AS cache_key FROM part")
def search_keys(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    method = F.when(F.col("p_size") % 2 == 0, "random").otherwise("grid")
    key = hashing.search_key(
        F.col("p_brand"),
        F.col("p_type"),
        method,
        F.col("p_size"),
        F.lit(5),
        F.split("p_name", " "),
        F.array(
            F.concat(F.lit("name="), F.col("p_brand")),
            F.concat(F.lit("dim="), F.col("p_size").cast("string")),
        ),
    )
    return part.select("p_partkey", key.alias("cache_key"))


_EMBEDDING_KEY = _sha(
    [
        "CAST(p_size AS VARCHAR)",
        "'40'",
        "'20'",
        "printf('%.6f', p_size / 64e0)",
        "printf('%.6f', 0.25e0)",
        "'15'",
        "'sgd'",
        "printf('%.8f', p_size / 1000e0)",
        "CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END",
        "'False'",
        _COLUMNS,
        "CAST(p_partkey AS VARCHAR)",
    ]
)


@query("c03_embedding_keys", f"SELECT p_partkey, {_EMBEDDING_KEY} AS cache_key FROM part")
def embedding_keys(spark, sf_dir):
    size = F.col("p_size")
    key = hashing.embedding_key(
        size,
        F.lit(40),
        F.lit(20),
        size / 64.0,
        F.lit(0.25),
        F.lit(15),
        F.lit("sgd"),
        size / 1000.0,
        size % 2 == 0,
        F.lit(False),
        F.split("p_name", " "),
        F.col("p_partkey"),
    )
    return read_table(spark, sf_dir, "part").select("p_partkey", key.alias("cache_key"))



@query(
    "j07_cache_lookup",
    f"""SELECT p_brand AS brand, count(*) AS n FROM part
        WHERE {_sha(["p_brand", "'raw'", "'grid'", "'grid'", "'5'", "'a,b'", "''"])} =
          substr(sha256('Brand#11|raw|grid|grid|5|a,b|'), 1, 16) GROUP BY 1""",
)
def cache_lookup(spark, sf_dir):
    """Point lookup: entries keyed per brand, one key computed on the driver."""
    key = hashing.search_key(
        F.col("p_brand"),
        F.lit("raw"),
        F.lit("grid"),
        F.lit(40),
        F.lit(5),
        F.array(F.lit("b"), F.lit("a")),
        F.array().cast("array<string>"),
    )
    wanted = hashlib.sha256(b"Brand#11|raw|grid|grid|5|a,b|").hexdigest()[:16]
    entries = read_table(spark, sf_dir, "part").withColumn("cache_key", key)
    found = entries.filter(F.col("cache_key") == wanted)
    return found.groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ versions

_VERSIONS = f"""SELECT {_SLUG} || '__' || strftime(max(o_orderdate), '%Y%m%dT%H%M%SZ') AS version,
   strftime(max(o_orderdate), '%Y%m%dT%H%M%SZ') AS created_at, count(*) AS n_orders FROM orders GROUP BY o_orderpriority"""


def _version_rows(spark, sf_dir):
    latest = (
        read_table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority")
        .agg(F.max("o_orderdate").alias("at"), F.count(F.lit(1)).alias("n_orders"))
    )
    return latest.select(
        hashing.version_name(F.col("o_orderpriority"), F.col("at")).alias("version"),
        F.date_format("at", "yyyyMMdd'T'HHmmss'Z'").alias("created_at"),
        "n_orders",
    )


@query(
    "w06_newest_first",
    f"SELECT *, row_number() OVER (ORDER BY created_at DESC, version DESC) AS rank FROM ({_VERSIONS})",
)
def versions_ranked(spark, sf_dir):
    return newest_first(_version_rows(spark, sf_dir))


@query(
    "v02_version_listing",
    f"SELECT version, created_at FROM ({_VERSIONS}) WHERE n_orders > 0 ORDER BY created_at DESC, version DESC",
)
def versions_listed(spark, sf_dir):
    listed = newest_first(_version_rows(spark, sf_dir).filter(F.col("n_orders") > 0))
    return listed.orderBy("rank").select("version", "created_at")


# ------------------------------------------------------------------ sinks and run log


@query(
    "s04_prediction_sink",
    with_sql(
        f"SELECT row_id, {', '.join(FEATURES)}, label_1, {r6('p_a', 'phishing_proba')},"
        " CAST(p_a >= 0.3e0 AS INTEGER) AS phishing_pred FROM counts"
    ),
)
def prediction_sink(spark, sf_dir):
    path = _folder(spark, "predictions")
    rows = counts(spark, sf_dir).drop("p_a", "p_b")
    scoring.score_batch(rows, MODEL_A, VERSION, out_path=path)
    return rounded(spark.read.parquet(path))


@query(
    "s04_prediction_sink_csv",
    with_sql(
        f"SELECT row_id, {r6('p_a', 'phishing_proba')}, CAST(p_a >= 0.3e0 AS INTEGER) AS phishing_pred FROM counts"
    ),
)
def prediction_sink_csv(spark, sf_dir):
    path = _folder(spark, "predictions-csv")
    rows = counts(spark, sf_dir).drop("p_a", "p_b")
    scoring.score_batch(rows, MODEL_A, VERSION, out_path=path, out_format="csv")
    read = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return rounded(
        read.select(
            F.col(ROW_ID).cast("bigint").alias(ROW_ID),
            F.col("phishing_proba").cast("double").alias("phishing_proba"),
            F.col("phishing_pred").cast("int").alias("phishing_pred"),
        )
    )


_RECORD = f"""(SELECT 0.3e0 AS threshold, pr_auc, roc_auc, {PRECISION_SQL} AS precision, {RECALL_SQL} AS recall,
    {F1_SQL} AS f1, {MCC_SQL} AS mcc, tn, fp, fn, tp, n_samples, n_positives
  FROM {confusion_sql('p_a', 0.3)} CROSS JOIN (SELECT {AP_SQL} AS pr_auc, {AUC_SQL} AS roc_auc FROM grid))"""
_METRIC_NAMES = [
    "threshold", "pr_auc", "roc_auc", "precision", "recall", "f1", "mcc",
    "tn", "fp", "fn", "tp", "n_samples", "n_positives",
]


def _long_sql(prefix: str, source: str = _RECORD) -> str:
    return " UNION ALL ".join(
        f"SELECT 'metric' AS kind, '{prefix}{m}' AS key, {r6(f'CAST({m} AS DOUBLE)', 'value')},"
        f" CAST(NULL AS VARCHAR) AS text FROM {source}"
        for m in _METRIC_NAMES
    )


@query(
    "s07_fit_log",
    with_sql(
        _long_sql("val_")
        + f" UNION ALL SELECT 'metric', 'cv_pr_auc', {r6('pr_auc', 'value')}, NULL FROM {_RECORD}"
        + " UNION ALL SELECT 'param', 'depth', CAST(NULL AS DOUBLE), '4'"
        + " UNION ALL SELECT 'param', 'grid', CAST(NULL AS DOUBLE), '[1, 2]'"
        + " UNION ALL SELECT 'tag', 'feature_mode', CAST(NULL AS DOUBLE), 'raw'",
        grid_ctes("p_a"),
    ),
)
def fit_log(spark, sf_dir):
    path = _folder(spark, "run-log")
    record = metric_record(score_curve(staged_counts(spark, sf_dir), "p_a"), 0.3).first().asDict()
    noisy = {**record, "confusion": [[1]], "fitted": True}
    runlog.log_fit(
        spark,
        path,
        "linear_a",
        {"depth": 4, "grid": [1, 2]},
        {"pr_auc": record["pr_auc"]},
        noisy,
        None,
        {"feature_mode": "raw"},
    )
    return rounded(runlog.read_log(spark, path, "fit").select("kind", "key", "value", "text"))


@query(
    "p05_numeric_metrics",
    with_sql(
        " UNION ALL ".join(
            f"SELECT 'm_{m}' AS key, {r6(f'CAST({m} AS DOUBLE)', 'value')} FROM {_RECORD}"
            for m in _METRIC_NAMES
        ),
        grid_ctes("p_a"),
    ),
)
def numeric_metrics(spark, sf_dir):
    record = metric_record(score_curve(staged_counts(spark, sf_dir), "p_a"), 0.3)
    noisy = record.withColumn("name", F.lit("x")).withColumn("ok", F.lit(True))
    return rounded(runlog.metrics_long(runlog.numeric_columns(noisy), prefix="m_"))


_RATE = "avg(CASE WHEN p_a >= 0.3e0 THEN 1e0 ELSE 0e0 END)"


@query(
    "s08_inference_log",
    with_sql(
        _long_sql("")
        + f" UNION ALL SELECT 'metric', 'predicted_positive_rate', {r6(_RATE, 'value')}, NULL FROM counts"
        + f" UNION ALL SELECT 'param', 'model_version', CAST(NULL AS DOUBLE), '{VERSION}'"
        + " UNION ALL SELECT 'param', 'threshold', CAST(NULL AS DOUBLE), '0.3'",
        grid_ctes("p_a"),
    ),
)
def inference_log(spark, sf_dir):
    folder = _folder(spark, "inference")
    scoring.score_batch(counts(spark, sf_dir).drop("p_a", "p_b"), MODEL_A, VERSION, log_dir=folder)
    log = runlog.read_log(spark, f"{folder}/run_log", "inference")
    return rounded(log.select("kind", "key", "value", "text"))


_FIXED = (
    ", fixed AS (SELECT feature, bin, count(*) AS n, CAST(sum(label_1) AS BIGINT) AS events FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {' + '.join(f'CAST({c} >= {k}e0 AS INTEGER)' for k in cuts)} AS bin, label_1 FROM counts"
        for c, cuts in FIXED_CUTS.items()
    )
    + ") GROUP BY 1, 2)"
    + woe_table_sql("fixed")
)


@query(
    "s09_binning_table_sink",
    with_sql(
        f"SELECT feature, bin, n, {r6('share', 'share')}, non_events, events, {r6('event_rate', 'event_rate')},"
        f" {r6('woe', 'woe')}, {r6('iv', 'iv')} FROM table_rows",
        _FIXED,
    ),
)
def binning_table_sink(spark, sf_dir):
    path = _folder(spark, "woe-tables")
    tables = woe_table(bin_counts(staged_counts(spark, sf_dir), FIXED_CUTS)).drop("is_total")
    runlog.write_binning_tables(tables, path)
    return rounded(spark.read.parquet(path).withColumn("feature", F.col("feature").cast("string")))


@query(
    "u03_run_history",
    with_sql(
        f"""SELECT CASE label_1 WHEN 1 THEN 'positives' ELSE 'negatives' END AS run_name, 'metric' AS kind,
              'predicted_positive_rate' AS key, {r6(_RATE, 'value')} FROM counts GROUP BY label_1
            UNION ALL SELECT CASE label_1 WHEN 1 THEN 'positives' ELSE 'negatives' END, 'metric',
              'n_samples', CAST(count(*) AS DOUBLE) FROM counts GROUP BY label_1"""
    ),
)
def run_history(spark, sf_dir):
    """Two batches appended to one log, then read back as one history."""
    path = _folder(spark, "history")
    rows = staged_counts(spark, sf_dir)
    for name, label in (("positives", 1), ("negatives", 0)):
        scored = scoring.scored_rows(rows.filter(F.col(LABEL) == label), MODEL_A)
        s = scoring.batch_summary(scored, name, 0.3).first()
        runlog.log_inference(spark, path, name, 0.3, s["n_samples"], s["predicted_positive_rate"])
    log = runlog.read_log(spark, path).filter(F.col("kind") == "metric")
    return rounded(
        log.select(F.regexp_replace("run_name", "^infer:", "").alias("run_name"), "kind", "key", "value")
    )


# ------------------------------------------------------------------ scoring


@query(
    "i01_batch_scoring",
    with_sql(
        f"SELECT row_id, label_1, {r6('p_a', 'phishing_proba')},"
        " CAST(p_a >= 0.45e0 AS INTEGER) AS phishing_pred FROM counts"
    ),
)
def batch_scoring(spark, sf_dir):
    rows = counts(spark, sf_dir).drop("p_a", "p_b")
    scored = scoring.scored_rows(rows, MODEL_A, threshold=0.45)
    return rounded(scored.select(ROW_ID, LABEL, "phishing_proba", "phishing_pred"))


@query(
    "i01_batch_summary",
    with_sql(
        f"SELECT '{VERSION}' AS model_version, 0.3e0 AS threshold, count(*) AS n_samples,"
        f" {r6(_RATE, 'predicted_positive_rate')} FROM counts"
    ),
)
def batch_summary(spark, sf_dir):
    scored = scoring.scored_rows(counts(spark, sf_dir), MODEL_A)
    return rounded(scoring.batch_summary(scored, VERSION, 0.3))


@query(
    "i02_scoring_response",
    with_sql(
        f"SELECT row_id, {r6('p_a', 'phishing_likelihood')}, p_a >= 0.3e0 AS is_phishing,"
        f" 0.3e0 AS threshold_used, 'linear_a' AS model_name, '{VERSION}' AS model_version FROM counts"
    ),
)
def scoring_response(spark, sf_dir):
    scored = scoring.scored_rows(counts(spark, sf_dir), MODEL_A)
    return rounded(scoring.response_rows(scored, 0.3, MODEL_A.name, VERSION, [ROW_ID]))


@query(
    "i03_streaming_scoring",
    with_sql(
        f"SELECT is_phishing, count(*) AS n, {r6('avg(p_a)', 'mean_likelihood')}"
        " FROM (SELECT p_a, p_a >= 0.3e0 AS is_phishing FROM counts) GROUP BY 1"
    ),
)
def streaming_scoring(spark, sf_dir):
    """The count table as a stream of files, scored in micro-batches until drained."""
    source, out = _folder(spark, "stream-in"), _folder(spark, "stream-out")
    counts(spark, sf_dir).drop("p_a", "p_b", LABEL).repartition(3).write.parquet(source)
    stream = read_count_stream(spark, source, max_files=2)
    start_scoring(
        stream, MODEL_A, VERSION, out, _folder(spark, "stream-state"), once=True
    ).awaitTermination()
    scored = spark.read.parquet(f"{out}/scored")
    return rounded(
        scored.groupBy("is_phishing").agg(
            F.count(F.lit(1)).alias("n"), F.avg("phishing_likelihood").alias("mean_likelihood")
        )
    )
