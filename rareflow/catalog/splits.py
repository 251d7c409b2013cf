"""Queries: splits, folds, samples and their rates."""

from __future__ import annotations

from ..operators import splits
from ..schema import LABEL, ROW_ID
from .base import FEATURES, HOLDOUT_SQL, staged_counts, query, r6, rounded, split_ctes, with_sql

_SPLIT_SQL = split_ctes(
    "test", "ceil(0.2e0 * n)", "val", "ceil(0.2e0 / (1e0 - 0.2e0) * (n - t1))"
)
_FOLD_SQL = (
    "SELECT row_id, label_1, CAST(ntile(5) OVER (PARTITION BY label_1 ORDER BY h, row_id) - 1"
    " AS INTEGER) AS fold FROM counts"
)


@query("d01_stratified_split", with_sql("SELECT row_id, label_1, split FROM parts", _SPLIT_SQL))
def stratified(spark, sf_dir):
    return splits.stratified_split(staged_counts(spark, sf_dir).select(ROW_ID, LABEL))


@query("d02_holdout_split", with_sql("SELECT row_id, label_1, split FROM parts", HOLDOUT_SQL))
def holdout(spark, sf_dir):
    return splits.holdout_split(staged_counts(spark, sf_dir).select(ROW_ID, LABEL))


@query("d03_cv_folds", with_sql(_FOLD_SQL))
def folds(spark, sf_dir):
    return splits.assign_folds(staged_counts(spark, sf_dir).select(ROW_ID, LABEL))


@query(
    "d04_stratified_sample",
    with_sql(
        f"""SELECT row_id, {', '.join(FEATURES)}, label_1 FROM (
              SELECT *, row_number() OVER (PARTITION BY label_1 ORDER BY h, row_id) AS rk,
                     count(*) OVER (PARTITION BY label_1) AS nk, count(*) OVER () AS n FROM counts)
            WHERE rk <= CAST(round_even(500e0 / n * nk, 0) AS BIGINT)"""
    ),
)
def sample(spark, sf_dir):
    df = staged_counts(spark, sf_dir).select(ROW_ID, *FEATURES, LABEL)
    return splits.stratified_sample(df, 500)


@query(
    "w04_fold_sizes",
    with_sql(
        "SELECT label_1, fold, count(*) AS n FROM folds GROUP BY 1, 2", f", folds AS ({_FOLD_SQL})"
    ),
)
def fold_sizes(spark, sf_dir):
    df = splits.assign_folds(staged_counts(spark, sf_dir).select(ROW_ID, LABEL))
    return df.groupBy(LABEL, "fold").count().withColumnRenamed("count", "n")


@query(
    "w05_split_sizes",
    with_sql("SELECT label_1, split, count(*) AS n FROM parts GROUP BY 1, 2", HOLDOUT_SQL),
)
def split_sizes(spark, sf_dir):
    df = splits.holdout_split(staged_counts(spark, sf_dir).select(ROW_ID, LABEL))
    return df.groupBy(LABEL, "split").count().withColumnRenamed("count", "n")


@query(
    "a02_positive_rates",
    with_sql(
        f"SELECT split, {r6('avg(label_1)', 'positive_rate')}, count(*) AS n_rows"
        " FROM parts GROUP BY 1",
        _SPLIT_SQL,
    ),
)
def rates(spark, sf_dir):
    df = splits.stratified_split(staged_counts(spark, sf_dir).select(ROW_ID, LABEL))
    return rounded(splits.positive_rates(df))


@query(
    "p04_validation_rows",
    with_sql(
        f"SELECT row_id, {', '.join(FEATURES)}, label_1 FROM parts WHERE split = 'val'", HOLDOUT_SQL
    ),
)
def validation_rows(spark, sf_dir):
    df = splits.holdout_split(staged_counts(spark, sf_dir).select(ROW_ID, *FEATURES, LABEL))
    return splits.part(df, "val")
