"""Column names and types shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The canonical count columns, in order, and the target.
COUNT_COLUMNS = [
    "num_words",
    "num_unique_words",
    "num_stopwords",
    "num_links",
    "num_unique_domains",
    "num_email_addresses",
    "num_spelling_errors",
    "num_urgent_keywords",
]
LABEL = "label_1"

# Columns appended by batch scoring, and class display names.
PROBABILITY_OUT = "phishing_proba"
DECISION_OUT = "phishing_pred"
CLASS_NAMES = {0: "legit", 1: "phishing"}

ROW_ID = "row_id"


def counts_schema(labelled: bool = True, row_id: bool = True) -> T.StructType:
    """Explicit read schema, so no source ever needs an inference pass."""
    fields = [T.StructField(ROW_ID, T.LongType())] if row_id else []
    fields += [T.StructField(c, T.LongType()) for c in COUNT_COLUMNS]
    if labelled:
        fields.append(T.StructField(LABEL, T.IntegerType()))
    return T.StructType(fields)


def feature_columns(df: DataFrame, target: str = LABEL) -> list[str]:
    """Canonical columns present in ``df``; if there are none, all but id and target."""
    present = [c for c in COUNT_COLUMNS if c in df.columns]
    return present or [c for c in df.columns if c not in (target, ROW_ID)]


def has_labels(df: DataFrame, target: str = LABEL) -> bool:
    """Evaluation mode if the target column exists, else inference (schema only, no job)."""
    return target in df.columns
