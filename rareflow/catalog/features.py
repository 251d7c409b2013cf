"""Queries: readers, validation and the feature catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as feats
from ..operators.splits import holdout_split, part
from ..schema import LABEL, ROW_ID
from ..sources.star import counts_from_documents
from ..sources.tables import features_and_label, list_folder, load_counts, load_folder
from ..sources.validation import with_reason
from .base import (
    FEATURES,
    HOLDOUT_SQL,
    counts,
    query,
    r6,
    rounded,
    staged_counts,
    with_sql,
)

PLAIN = ", ".join(FEATURES)

# ------------------------------------------------------------------ sources


@query("s00_counts_from_orders", with_sql(f"SELECT row_id, {PLAIN}, label_1, p_a, p_b FROM counts"))
def counts_table(spark, sf_dir):
    return counts(spark, sf_dir)


_DOCS_SQL = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS ws
  FROM documents)
SELECT doc_id AS row_id, CAST(len(ws) AS BIGINT) AS num_words,
       CAST(len(list_distinct(ws)) AS BIGINT) AS num_unique_words,
       CAST(len(list_filter(ws, lambda w: length(w) <= 3)) AS BIGINT) AS num_stopwords,
       CAST(toxic AS INTEGER) AS label_1
FROM words LEFT JOIN labels USING (doc_id)"""


@query("s00_counts_from_documents", _DOCS_SQL)
def documents_table(spark, sf_dir):
    return counts_from_documents(spark, sf_dir)


def _csv_copy(spark, sf_dir, files=4):
    """The count table written as CSV files into the shared folder."""
    import uuid

    from ..session import shared_dir

    path = f"{shared_dir(spark)}/rareflow-csv-{uuid.uuid4().hex}"
    table = counts(spark, sf_dir).drop("p_a", "p_b")
    # Round robin: a repartition by the key the rows already lie by may be planned away.
    table.repartition(files).write.option("header", True).csv(path)
    return path


@query("s01_load_csv", with_sql(f"SELECT row_id, {PLAIN}, label_1 FROM counts"))
def load_csv(spark, sf_dir):
    return load_counts(spark, _csv_copy(spark, sf_dir))


@query(
    "s03_features_and_label", with_sql(f"SELECT row_id, {PLAIN}, label_1 FROM counts")
)
def split_features(spark, sf_dir):
    return features_and_label(counts(spark, sf_dir))


@query(
    "s05_folder_rows",
    with_sql(
        "SELECT CAST(4 AS BIGINT) AS n_files, count(*) AS n_rows,"
        " CAST(sum(num_words) AS BIGINT) AS words FROM counts"
    ),
)
def folder_rows(spark, sf_dir):
    return load_folder(spark, _csv_copy(spark, sf_dir)).agg(
        F.count_distinct("file_name").alias("n_files"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("num_words").alias("words"),
    )


@query("s05_list_folder", "SELECT CAST(4 AS BIGINT) AS n_files, true AS sized")
def folder_listing(spark, sf_dir):
    """The listing itself: names and sizes without reading a row."""
    return list_folder(spark, _csv_copy(spark, sf_dir)).agg(
        F.count_distinct("file_name").alias("n_files"), (F.min("n_bytes") > 0).alias("sized")
    )


def _damaged(df):
    """Rows as they might arrive: some with a missing word count, some with negative links."""
    kind = F.pmod(F.col(ROW_ID), F.lit(50))
    return df.select(
        ROW_ID,
        F.when(kind == 7, F.lit(None)).otherwise(F.col("num_words")).alias("num_words"),
        *[c for c in FEATURES if c not in ("num_words", "num_links")],
        F.when(kind.isin(7, 11), F.lit(-1)).otherwise(F.col("num_links")).cast("bigint").alias("num_links"),
    )


@query(
    "s06_validate_rows",
    with_sql(
        """SELECT row_id, CASE WHEN num_words IS NULL AND num_links < 0 THEN 'missing:num_words;negative:num_links'
             WHEN num_links < 0 THEN 'negative:num_links' END AS reason
           FROM (SELECT row_id, CASE WHEN row_id % 50 <> 7 THEN num_words END AS num_words,
                   CASE WHEN row_id % 50 IN (7, 11) THEN -1 ELSE num_links END AS num_links FROM counts)"""
    ),
)
def validate_rows(spark, sf_dir):
    return with_reason(_damaged(counts(spark, sf_dir))).select(ROW_ID, "reason")


# ------------------------------------------------------------------ feature catalogue

W = "greatest(num_words + 1e0, 1e0)"
CONTENT = "greatest(CAST(num_words - num_stopwords AS DOUBLE), 1e0)"


def _mx(c):
    return f"greatest(CAST({c} AS DOUBLE), 1e0)"


def _flag(test, name):
    return f"CAST({test} AS INTEGER) AS {name}"


PRESENCE_SQL = [
    _flag("num_links > 0", "has_links"),
    _flag("num_unique_domains > 0", "has_domains"),
    _flag("num_email_addresses > 0", "has_emails"),
    _flag("num_urgent_keywords > 0", "has_urgent"),
]
LOG_SQL = [r6(f"ln(1e0 + {c})", f"log_{c}") for c in FEATURES]
DENSITY_SQL = [
    r6(f"num_unique_words / {W}", "lexical_diversity"),
    r6(f"1e0 - num_unique_words / {W}", "word_repetition_ratio"),
    r6(f"num_stopwords / {W}", "stopword_ratio"),
    r6(f"(num_words - num_stopwords) / {W}", "content_word_ratio"),
    r6(f"num_links / {W}", "link_density"),
    r6(f"num_email_addresses / {W}", "email_density"),
    r6(f"num_spelling_errors / {W}", "spelling_error_ratio"),
    r6(f"num_urgent_keywords / {W}", "urgency_ratio"),
]
RATIO_SQL = [
    r6(f"num_unique_domains / {_mx('num_links')}", "domain_per_link_ratio"),
    r6(f"num_links / {_mx('num_unique_domains')}", "links_per_domain_ratio"),
    r6(f"num_email_addresses / {_mx('num_links')}", "emails_per_link_ratio"),
    r6(f"num_email_addresses / {_mx('num_unique_domains')}", "emails_per_domain_ratio"),
    r6(f"num_spelling_errors / {_mx('num_links')}", "spelling_errors_per_link"),
    r6(f"num_urgent_keywords / {_mx('num_links')}", "urgent_keywords_per_link"),
    r6(f"num_spelling_errors / {_mx('num_unique_words')}", "spelling_errors_per_unique_word"),
    r6(f"num_urgent_keywords / {_mx('num_unique_words')}", "urgency_per_unique_word"),
    r6(f"num_unique_words / {_mx('num_stopwords')}", "text_complexity"),
]
CONTENT_SQL = [
    r6(f"num_links / {CONTENT}", "link_to_content_ratio"),
    r6(f"num_email_addresses / {CONTENT}", "email_to_content_ratio"),
    r6(f"num_spelling_errors / {CONTENT}", "error_to_content_ratio"),
    r6(f"num_urgent_keywords / {CONTENT}", "urgency_to_content_ratio"),
]
GRADED_SQL = [
    _flag("num_links > 1", "has_multiple_links"),
    _flag("num_unique_domains > 1", "has_multiple_domains"),
    _flag("num_spelling_errors > 0", "has_spelling_errors"),
    _flag("num_spelling_errors >= 3", "many_spelling_errors"),
    _flag("num_urgent_keywords >= 2", "many_urgent_keywords"),
    _flag("num_words < 50", "short_email"),
    _flag("num_words < 20", "very_short_email"),
    _flag("num_words > 300", "long_email"),
]
P95_SQL = f""",
p95 AS (SELECT quantile_cont(num_links / {W}, 0.95e0) AS q_link,
               quantile_cont(num_urgent_keywords / {W}, 0.95e0) AS q_urgent,
               quantile_cont(num_spelling_errors / {W}, 0.95e0) AS q_error
        FROM parts WHERE split = 'train')"""
HIGH_SQL = [
    _flag(f"num_links / {W} > (SELECT q_link FROM p95)", "high_link_density"),
    _flag(f"num_urgent_keywords / {W} > (SELECT q_urgent FROM p95)", "high_urgency_density"),
    _flag(f"num_spelling_errors / {W} > (SELECT q_error FROM p95)", "high_error_density"),
]
PRODUCT_SQL = [
    "num_links * num_urgent_keywords AS links_x_urgency",
    "num_links * num_spelling_errors AS links_x_errors",
    "num_unique_domains * num_urgent_keywords AS domains_x_urgency",
    "num_unique_domains * num_spelling_errors AS domains_x_errors",
    "num_spelling_errors * num_urgent_keywords AS errors_x_urgency",
    "num_email_addresses * num_links AS emails_x_links",
    "num_email_addresses * num_unique_domains AS emails_x_domains",
]
MOMENTS_SQL = """,
moments AS (SELECT avg(ln(1e0 + num_email_addresses)) AS m,
                   stddev_samp(ln(1e0 + num_email_addresses)) AS s
            FROM parts WHERE split = 'train')"""
LOGZ_SQL = [
    r6(
        "(ln(1e0 + num_email_addresses) - (SELECT m FROM moments))"
        " / (SELECT CASE WHEN s > 0 THEN s ELSE 1e0 END FROM moments)",
        "logz_num_email_addresses",
    )
]


def _select(columns, source="counts", extra=""):
    return with_sql(f"SELECT row_id, {', '.join(columns)} FROM {source}", extra)


def _project(spark, sf_dir, make):
    df = counts(spark, sf_dir)
    return rounded(df.select(ROW_ID, *feats.aliased(make(df.columns))))


@query("f01_presence_flags", _select(PRESENCE_SQL))
def presence(spark, sf_dir):
    return _project(spark, sf_dir, feats.presence_flags)


@query("f02_log_counts", _select(LOG_SQL))
def logs(spark, sf_dir):
    return _project(spark, sf_dir, feats.log_counts)


@query("f03_length_densities", _select(DENSITY_SQL))
def densities(spark, sf_dir):
    return _project(spark, sf_dir, feats.length_densities)


@query("f04_structural_ratios", _select(RATIO_SQL))
def ratios(spark, sf_dir):
    return _project(spark, sf_dir, feats.structural_ratios)


@query("f05_content_intensities", _select(CONTENT_SQL))
def intensities(spark, sf_dir):
    return _project(spark, sf_dir, feats.content_intensities)


@query("f06_graded_flags", _select(GRADED_SQL))
def graded(spark, sf_dir):
    return _project(spark, sf_dir, feats.graded_flags)


def _fitted(spark, sf_dir, **settings):
    df = staged_counts(spark, sf_dir).drop("p_a", "p_b")
    parts = holdout_split(df)
    return df, feats.FeatureEngineer(**settings).fit(part(parts, "train"))


@query("f07_high_density_flags", _select(HIGH_SQL, extra=HOLDOUT_SQL + P95_SQL))
def high_density(spark, sf_dir):
    df, fitted = _fitted(spark, sf_dir, add_logz_email=False)
    return df.select(ROW_ID, *feats.aliased(feats.high_density_flags(df.columns, fitted.cutoffs)))


@query("f08_risk_products", _select(PRODUCT_SQL))
def products(spark, sf_dir):
    return _project(spark, sf_dir, feats.risk_products)


@query("f09_logz_emails", _select(LOGZ_SQL, extra=HOLDOUT_SQL + MOMENTS_SQL))
def logz(spark, sf_dir):
    df, fitted = _fitted(spark, sf_dir)
    return rounded(df.select(ROW_ID, *feats.aliased(feats.logz(*fitted.moments))))


CATALOGUE_SQL = [
    *FEATURES,
    *PRESENCE_SQL,
    *LOG_SQL,
    *DENSITY_SQL,
    *RATIO_SQL,
    *CONTENT_SQL,
    *GRADED_SQL,
    *HIGH_SQL,
    *PRODUCT_SQL,
    *LOGZ_SQL,
]


@query(
    "f10_catalogue",
    _select([*CATALOGUE_SQL, "label_1"], extra=HOLDOUT_SQL + P95_SQL + MOMENTS_SQL),
)
def catalogue(spark, sf_dir):
    df, fitted = _fitted(spark, sf_dir)
    return rounded(fitted.transform(df))


@query(
    "f11_top3_frame",
    _select(
        [
            _flag("num_email_addresses > 0", "has_emails"),
            _flag("num_words < 50", "is_short_email"),
            _flag("num_urgent_keywords > 0", "has_urgent"),
            "label_1",
        ]
    ),
)
def top3(spark, sf_dir):
    return feats.top3_frame(counts(spark, sf_dir), carry=[ROW_ID])


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@query(
    "f12_interactions",
    _select([*FEATURES, "label_1", *[f"{a} * {b} AS {a}__x__{b}" for a, b in _PAIRS]]),
)
def interactions(spark, sf_dir):
    df = counts(spark, sf_dir).select(ROW_ID, *FEATURES, LABEL)
    return feats.add_interactions(df, FEATURES)
