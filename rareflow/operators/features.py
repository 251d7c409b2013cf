"""The engineered feature catalogue: native column expressions over the counts.

Every feature is emitted only if all its inputs exist. The whole catalogue is one
``select``. Learned values (density cut-offs, mean and deviation) are a handful
of numbers fitted on the training rows and applied as literals, so scoring needs
neither a join nor a second pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COUNT_COLUMNS, LABEL
from .ordered import exact_quantiles
from .repeats import COUNT, moments

# Feature names and their inputs, in catalogue order.
PRESENCE_FLAGS = {
    "has_links": "num_links",
    "has_domains": "num_unique_domains",
    "has_emails": "num_email_addresses",
    "has_urgent": "num_urgent_keywords",
}
LENGTH_DENSITIES = {
    "lexical_diversity": "num_unique_words",
    "word_repetition_ratio": "num_unique_words",
    "stopword_ratio": "num_stopwords",
    "content_word_ratio": "num_stopwords",
    "link_density": "num_links",
    "email_density": "num_email_addresses",
    "spelling_error_ratio": "num_spelling_errors",
    "urgency_ratio": "num_urgent_keywords",
}
STRUCTURAL_RATIOS = {
    "domain_per_link_ratio": ("num_unique_domains", "num_links"),
    "links_per_domain_ratio": ("num_links", "num_unique_domains"),
    "emails_per_link_ratio": ("num_email_addresses", "num_links"),
    "emails_per_domain_ratio": ("num_email_addresses", "num_unique_domains"),
    "spelling_errors_per_link": ("num_spelling_errors", "num_links"),
    "urgent_keywords_per_link": ("num_urgent_keywords", "num_links"),
    "spelling_errors_per_unique_word": ("num_spelling_errors", "num_unique_words"),
    "urgency_per_unique_word": ("num_urgent_keywords", "num_unique_words"),
    "text_complexity": ("num_unique_words", "num_stopwords"),
}
CONTENT_INTENSITIES = {
    "link_to_content_ratio": "num_links",
    "email_to_content_ratio": "num_email_addresses",
    "error_to_content_ratio": "num_spelling_errors",
    "urgency_to_content_ratio": "num_urgent_keywords",
}
GRADED_FLAGS = {
    "has_multiple_links": ("num_links", ">", 1),
    "has_multiple_domains": ("num_unique_domains", ">", 1),
    "has_spelling_errors": ("num_spelling_errors", ">", 0),
    "many_spelling_errors": ("num_spelling_errors", ">=", 3),
    "many_urgent_keywords": ("num_urgent_keywords", ">=", 2),
    "short_email": ("num_words", "<", 50),
    "very_short_email": ("num_words", "<", 20),
    "long_email": ("num_words", ">", 300),
}
HIGH_DENSITY_FLAGS = {
    "high_link_density": "link_density",
    "high_urgency_density": "urgency_ratio",
    "high_error_density": "spelling_error_ratio",
}
RISK_PRODUCTS = {
    "links_x_urgency": ("num_links", "num_urgent_keywords"),
    "links_x_errors": ("num_links", "num_spelling_errors"),
    "domains_x_urgency": ("num_unique_domains", "num_urgent_keywords"),
    "domains_x_errors": ("num_unique_domains", "num_spelling_errors"),
    "errors_x_urgency": ("num_spelling_errors", "num_urgent_keywords"),
    "emails_x_links": ("num_email_addresses", "num_links"),
    "emails_x_domains": ("num_email_addresses", "num_unique_domains"),
}
LOGZ_COLUMN = "num_email_addresses"

_COMPARE: dict[str, Callable[[Column, float], Column]] = {
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
}


def at_least_one(c: str | Column) -> Column:
    """Safe divisor: the value, never below 1."""
    column = F.col(c) if isinstance(c, str) else c
    return F.greatest(column.cast("double"), F.lit(1.0))


def presence_flags(available: list[str]) -> dict[str, Column]:
    return {
        name: (F.col(c) > 0).cast("int") for name, c in PRESENCE_FLAGS.items() if c in available
    }


def log_counts(available: list[str]) -> dict[str, Column]:
    return {f"log_{c}": F.log1p(F.col(c).cast("double")) for c in COUNT_COLUMNS if c in available}


def length_densities(available: list[str], eps: float = 1.0) -> dict[str, Column]:
    """Counts per word; the complement and the content share are derived the same way."""
    if "num_words" not in available:
        return {}
    words = at_least_one(F.col("num_words") + F.lit(float(eps)))
    out = {}
    for name, c in LENGTH_DENSITIES.items():
        if c not in available:
            continue
        if name == "word_repetition_ratio":
            out[name] = 1.0 - F.col(c) / words
        elif name == "content_word_ratio":
            out[name] = (F.col("num_words") - F.col(c)) / words
        else:
            out[name] = F.col(c) / words
    return out


def structural_ratios(available: list[str]) -> dict[str, Column]:
    return {
        name: F.col(top) / at_least_one(bottom)
        for name, (top, bottom) in STRUCTURAL_RATIOS.items()
        if top in available and bottom in available
    }


def content_intensities(available: list[str]) -> dict[str, Column]:
    """Counts per content word (words that are not stop words)."""
    if "num_words" not in available or "num_stopwords" not in available:
        return {}
    content = at_least_one(F.col("num_words") - F.col("num_stopwords"))
    return {n: F.col(c) / content for n, c in CONTENT_INTENSITIES.items() if c in available}


def graded_flags(available: list[str]) -> dict[str, Column]:
    return {
        name: _COMPARE[op](F.col(c), limit).cast("int")
        for name, (c, op, limit) in GRADED_FLAGS.items()
        if c in available
    }


def high_density_flags(
    available: list[str], cutoffs: dict[str, float], eps: float = 1.0
) -> dict[str, Column]:
    densities = length_densities(available, eps)
    return {
        name: (densities[d] > F.lit(cutoffs[d])).cast("int")
        for name, d in HIGH_DENSITY_FLAGS.items()
        if d in densities and d in cutoffs
    }


def risk_products(available: list[str]) -> dict[str, Column]:
    return {
        name: F.col(a) * F.col(b)
        for name, (a, b) in RISK_PRODUCTS.items()
        if a in available and b in available
    }


def logz(mean: float, std: float) -> dict[str, Column]:
    value = (F.log1p(F.col(LOGZ_COLUMN).cast("double")) - F.lit(mean)) / F.lit(std)
    return {f"logz_{LOGZ_COLUMN}": value}


def aliased(features: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in features.items()]


@dataclass
class FeatureEngineer:
    """Fits the learned part of the catalogue on training rows, or on distinct ones with a ``COUNT``."""

    keep_raw: bool = True
    eps: float = 1.0
    add_logz_email: bool = True
    density_pct: float = 0.95

    def fit(self, train: DataFrame) -> "FittedEngineer":
        available = [c for c in COUNT_COLUMNS if c in train.columns]
        counted = [COUNT] if COUNT in train.columns else []
        densities = length_densities(available, self.eps)
        wanted = [d for d in HIGH_DENSITY_FLAGS.values() if d in densities]
        cutoffs: dict[str, float] = {}
        if wanted:
            frame = train.select(*[densities[d].alias(d) for d in wanted], *counted)
            quantiles = exact_quantiles(frame, wanted, [self.density_pct])
            cutoffs = {d: q[0] for d, q in quantiles.items() if q}
        scale = None
        if self.add_logz_email and LOGZ_COLUMN in available:
            value = F.log1p(F.col(LOGZ_COLUMN).cast("double"))
            if counted:
                known = train.select(value.alias(LOGZ_COLUMN), COUNT).filter(F.col(LOGZ_COLUMN).isNotNull())
                n, means, squares = moments(known, [LOGZ_COLUMN])
                mean, std = float(means[0]), math.sqrt(squares[0] / (n - 1.0)) if n > 1 else None
            else:
                mean, std = train.agg(F.avg(value), F.stddev_samp(value)).first()
            usable = std is not None and std > 0
            scale = (mean or 0.0, std if usable else 1.0)
        return FittedEngineer(self.keep_raw, self.eps, cutoffs, scale)


@dataclass
class FittedEngineer:
    """The catalogue with its learned values; JSON-serialisable through ``vars``."""

    keep_raw: bool = True
    eps: float = 1.0
    cutoffs: dict[str, float] = field(default_factory=dict)
    moments: tuple[float, float] | None = None

    def features(self, available: list[str]) -> dict[str, Column]:
        out: dict[str, Column] = {}
        out.update(presence_flags(available))
        out.update(log_counts(available))
        out.update(length_densities(available, self.eps))
        out.update(structural_ratios(available))
        out.update(content_intensities(available))
        out.update(graded_flags(available))
        out.update(high_density_flags(available, self.cutoffs, self.eps))
        out.update(risk_products(available))
        if self.moments and LOGZ_COLUMN in available:
            out.update(logz(*self.moments))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """One projection; columns that are not counts (id, label, split) pass through."""
        available = [c for c in COUNT_COLUMNS if c in df.columns]
        kept = [c for c in df.columns if self.keep_raw or c not in available]
        return df.select(*kept, *aliased(self.features(available)))

    def output_columns(self, inputs: list[str]) -> list[str]:
        available = [c for c in COUNT_COLUMNS if c in inputs]
        kept = [c for c in inputs if self.keep_raw or c not in available]
        return kept + list(self.features(available))


def interaction_pairs(
    columns: list[str], max_features: int = 8
) -> list[tuple[str, str, str]]:
    """(name, left, right) for all pairs among the first ``max_features`` columns."""
    return [(f"{a}__x__{b}", a, b) for a, b in combinations(columns[:max_features], 2)]


def add_interactions(
    df: DataFrame, columns: list[str], keep_raw: bool = True, max_features: int = 8
) -> DataFrame:
    """Pairwise products of the first ``max_features`` columns, in combination order."""
    products = [
        (F.col(a) * F.col(b)).alias(name)
        for name, a, b in interaction_pairs(columns, max_features)
    ]
    kept = [c for c in df.columns if keep_raw or c not in columns]
    return df.select(*kept, *products)


def top3_frame(df: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Three strongest flags and, when present, the label."""
    columns = [
        (F.col("num_email_addresses") > 0).cast("int").alias("has_emails"),
        (F.col("num_words") < 50).cast("int").alias("is_short_email"),
        (F.col("num_urgent_keywords") > 0).cast("int").alias("has_urgent"),
    ]
    if LABEL in df.columns:
        columns.append(F.col(LABEL).cast("int").alias(LABEL))
    return df.select(*carry, *columns)
