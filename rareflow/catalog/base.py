"""Query registry and the shared SQL building blocks of the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import COUNT_COLUMNS
from ..session import stage_table
from ..sources.star import counts_from_orders

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

FEATURES = list(COUNT_COLUMNS)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its checking SQL if there is one."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_from_orders(spark, sf_dir)


def staged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count table written once, for queries that read it in several passes."""
    return stage_table(counts_from_orders(spark, sf_dir), "counts")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double after all arithmetic; adding 0 turns -0 into 0."""
    return df.select(
        *[
            (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


COUNTS_SQL = """
lines AS (
  SELECT l_orderkey,
         sum(l_quantity) AS words,
         count(DISTINCT l_partkey) AS unique_words,
         sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS stopwords,
         count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS links,
         count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS domains,
         count(CASE WHEN l_discount >= 0.09e0 THEN 1 END) AS emails,
         count(CASE WHEN l_tax >= 0.07e0 THEN 1 END) AS errors,
         count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS accepted
  FROM lineitem GROUP BY l_orderkey),
raw_counts AS (
  SELECT o_orderkey AS row_id,
         CAST(coalesce(words, 0) AS BIGINT) AS num_words,
         CAST(coalesce(unique_words, 0) AS BIGINT) AS num_unique_words,
         CAST(coalesce(stopwords, 0) AS BIGINT) AS num_stopwords,
         CAST(coalesce(links, 0) AS BIGINT) AS num_links,
         CAST(coalesce(domains, 0) AS BIGINT) AS num_unique_domains,
         CAST(coalesce(emails, 0) AS BIGINT) AS num_email_addresses,
         CAST(coalesce(errors, 0) AS BIGINT) AS num_spelling_errors,
         CAST(coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN accepted END, 0) AS BIGINT)
           AS num_urgent_keywords,
         CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|42'), 1, 8) AS BIGINT) AS h
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey),
counts AS (
  SELECT *,
         CAST(CASE WHEN (num_links >= 2 AND num_urgent_keywords >= 2 AND h % 1000 >= 200)
                     OR h % 1000 < 4 THEN 1 ELSE 0 END AS INTEGER) AS label_1,
         round(1e0 / (1e0 + exp(-(-5e0 + 0.9e0 * num_links + 1.1e0 * num_urgent_keywords
               + 0.3e0 * num_spelling_errors - 0.004e0 * num_words))), 6) AS p_a,
         round(1e0 / (1e0 + exp(-(-4e0 + 0.5e0 * num_links + 0.8e0 * num_urgent_keywords))), 6) AS p_b
  FROM raw_counts)"""


def split_ctes(first: str, t1: str, second: str, t2: str, table: str = "counts") -> str:
    """CTE ``parts``: the table with ``split``. ``t1`` may use n, ``t2`` n and t1."""
    return f""",
classes AS (SELECT label_1 AS k, count(*) AS nk, sum(count(*)) OVER () AS n FROM {table} GROUP BY 1),
c1 AS (SELECT *, CAST({t1} AS BIGINT) AS t1 FROM classes),
c2 AS (SELECT *, nk * t1 / CAST(n AS DOUBLE) AS e1 FROM c1),
c3 AS (SELECT *, floor(e1) + CAST(row_number() OVER (ORDER BY e1 - floor(e1) DESC, k)
         <= t1 - sum(floor(e1)) OVER () AS INTEGER) AS q1 FROM c2),
c4 AS (SELECT *, CAST({t2} AS BIGINT) AS t2 FROM c3),
c5 AS (SELECT *, (nk - q1) * t2 / CAST(n - t1 AS DOUBLE) AS e2 FROM c4),
quotas AS (SELECT *, floor(e2) + CAST(row_number() OVER (ORDER BY e2 - floor(e2) DESC, k)
         <= t2 - sum(floor(e2)) OVER () AS INTEGER) AS q2 FROM c5),
ranks AS (SELECT *, row_number() OVER (PARTITION BY label_1 ORDER BY h, row_id) AS rk FROM {table}),
parts AS (SELECT ranks.*, CASE WHEN rk <= q1 THEN '{first}' WHEN rk <= q1 + q2 THEN '{second}'
         ELSE 'train' END AS split FROM ranks JOIN quotas ON k = label_1)"""


HOLDOUT_SQL = split_ctes("val", "ceil(0.05e0 * n)", "test", "ceil(0.2e0 * (n - t1))")


def with_sql(body: str, extra: str = "") -> str:
    """Query text over the derived count table."""
    return f"WITH {COUNTS_SQL}{extra}\n{body}"


def grid_ctes(score: str = "p_a", source: str = "counts", name: str = "grid") -> str:
    """CTE with one row per distinct score: confusion counts, precision and recall."""
    return f""",
{name}_0 AS (SELECT {score} AS threshold, CAST(sum(label_1) AS BIGINT) AS pos, count(*) AS n
             FROM {source} GROUP BY 1),
{name}_1 AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(n - pos) OVER w AS BIGINT) AS fp,
               CAST(sum(pos) OVER () AS BIGINT) AS n_pos, CAST(sum(n - pos) OVER () AS BIGINT) AS n_neg
             FROM {name}_0 WINDOW w AS (ORDER BY threshold DESC)),
{name} AS (SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / n_pos AS recall,
             CAST(pos AS DOUBLE) / n_pos AS step
           FROM {name}_1)"""


AP_SQL = "sum(step * precision)"
AUC_SQL = (
    "sum(CAST(n - pos AS DOUBLE) * (CAST(tp AS DOUBLE) - CAST(pos AS DOUBLE) / 2e0))"
    " / (CAST(max(n_pos) AS DOUBLE) * CAST(max(n_neg) AS DOUBLE))"
)


def confusion_sql(score: str, threshold: float, source: str = "counts") -> str:
    """Confusion counts of ``score >= threshold`` as a subquery."""
    t = f"{threshold}e0"
    return f"""(SELECT
      count(CASE WHEN label_1 = 0 AND {score} < {t} THEN 1 END) AS tn,
      count(CASE WHEN label_1 = 0 AND {score} >= {t} THEN 1 END) AS fp,
      count(CASE WHEN label_1 = 1 AND {score} < {t} THEN 1 END) AS fn,
      count(CASE WHEN label_1 = 1 AND {score} >= {t} THEN 1 END) AS tp,
      count(*) AS n_samples,
      count(CASE WHEN label_1 = 1 THEN 1 END) AS n_positives
    FROM {source})"""


PRECISION_SQL = "CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0e0 END"
RECALL_SQL = "CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0e0 END"
F1_SQL = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 0e0 END"
_SPREAD = (
    "sqrt(CAST(tp + fp AS DOUBLE) * CAST(tp + fn AS DOUBLE)"
    " * CAST(tn + fp AS DOUBLE) * CAST(tn + fn AS DOUBLE))"
)
MCC_SQL = (
    f"CASE WHEN {_SPREAD} > 0 THEN (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)"
    f" / {_SPREAD} ELSE 0e0 END"
)
