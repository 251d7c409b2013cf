"""Adapters that derive count tables from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from ..schema import COUNT_COLUMNS, LABEL, ROW_ID


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def counts_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: eight zero-inflated counts, a rare noisy label and two scores.

    The lines are aggregated per order before the join, so the join is 1:1 and a
    hot order key never meets the orders side unaggregated.
    """
    lineitem = read_table(spark, sf_dir, "lineitem")
    returned = F.col("l_returnflag") == "R"
    # One distinct count per aggregate: two in one would triple the shuffled rows.
    lines = lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("words"),
        F.count_distinct("l_partkey").alias("unique_words"),
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("stopwords"),
        F.count_if(returned).alias("links"),
        F.count_if(F.col("l_discount") >= 0.09).alias("emails"),
        F.count_if(F.col("l_tax") >= 0.07).alias("errors"),
        F.count_if(F.col("l_returnflag") == "A").alias("accepted"),
    )
    domains = (
        lineitem.filter(returned)
        .groupBy("l_orderkey")
        .agg(F.count_distinct("l_suppkey").alias("domains"))
    )
    lines = lines.join(domains, "l_orderkey", "left")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    sources = [
        "words",
        "unique_words",
        "stopwords",
        "links",
        "domains",
        "emails",
        "errors",
        "urgent",
    ]
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("accepted"))
    counts = (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
        .withColumn("urgent", urgent)
        .select(
            F.col("o_orderkey").alias(ROW_ID),
            *[
                F.coalesce(F.col(s).cast("bigint"), F.lit(0).cast("bigint")).alias(c)
                for s, c in zip(sources, COUNT_COLUMNS)
            ],
        )
    )
    return _labelled(counts)


def _labelled(counts: DataFrame) -> DataFrame:
    links, urgent = F.col("num_links"), F.col("num_urgent_keywords")
    noise = F.pmod(hash32(F.col(ROW_ID), 42), F.lit(1000))
    signal = (links >= 2) & (urgent >= 2) & (noise >= 200)
    z_a = (
        F.lit(-5.0)
        + 0.9 * links
        + 1.1 * urgent
        + 0.3 * F.col("num_spelling_errors")
        - 0.004 * F.col("num_words")
    )
    z_b = F.lit(-4.0) + 0.5 * links + 0.8 * urgent
    logistic = lambda z: F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6)
    return counts.select(
        "*",
        (signal | (noise < 4)).cast("int").alias(LABEL),
        logistic(z_a).alias("p_a"),
        logistic(z_b).alias("p_b"),
    )


def counts_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-based counts of whole documents; the label is ``toxic``, null where there is none.

    Links, domains and e-mail addresses hardly occur in these texts, so the table
    carries the word columns only: a natural case of missing canonical columns.
    """
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(ROW_ID), words.alias("words")
    )
    labels = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias(ROW_ID), F.col("toxic").cast("int").alias(LABEL)
    )
    common = F.filter("words", lambda w: F.length(w) <= 3)
    return docs.join(labels, ROW_ID, "left").select(
        ROW_ID,
        F.size("words").cast("bigint").alias("num_words"),
        F.size(F.array_distinct("words")).cast("bigint").alias("num_unique_words"),
        F.size(common).cast("bigint").alias("num_stopwords"),
        LABEL,
    )
