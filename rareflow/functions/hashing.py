"""Seeded row hashes, version slugs and configuration keys as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(key: Column, seed: int | str) -> Column:
    """First 32 bits of md5(key|seed), as a non-negative bigint."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def slug(name: Column) -> Column:
    """File-system safe name: runs of other characters become ``_``, outer ``_`` removed."""
    return F.trim(F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_"), F.lit("_"))


def version_name(name: Column, created_at: Column) -> Column:
    """``slug__yyyyMMddTHHmmssZ`` (UTC session time zone assumed)."""
    stamp = F.date_format(created_at, "yyyyMMdd'T'HHmmss'Z'")
    return F.concat(slug(name), F.lit("__"), stamp)


def short_sha(parts: Sequence[Column]) -> Column:
    """16 hex digits of the sha256 over ``|``-joined parts."""
    joined = F.concat_ws("|", *parts)
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 16)


def sorted_list(columns: Column) -> Column:
    """Comma-joined ascending list, so the order of columns never changes a key."""
    return F.concat_ws(",", F.array_sort(columns))


def search_key(
    model: Column,
    mode: Column,
    method: Column,
    n_iter: Column,
    n_folds: Column,
    columns: Column,
    overrides: Column,
) -> Column:
    """Key of one hyper-parameter search (fixed fields and order); the budget counts for random search only.

    ``overrides`` is an array of ``name=value`` strings (embedding settings).
    """
    budget = F.when(method == "random", n_iter.cast("string")).otherwise(F.lit("grid"))
    return short_sha(
        [
            model,
            mode,
            method,
            budget,
            n_folds.cast("string"),
            sorted_list(columns),
            sorted_list(overrides),
        ]
    )


def embedding_key(
    width: Column,
    hidden1: Column,
    hidden2: Column,
    dropout1: Column,
    dropout2: Column,
    patience: Column,
    optimizer: Column,
    learning_rate: Column,
    periodic: Column,
    cosine: Column,
    columns: Column,
    n_train_rows: Column,
) -> Column:
    """Key of one trained embedding (fixed fields and order): settings, input columns and training size."""

    def flag(c: Column) -> Column:
        return F.when(c, F.lit("True")).otherwise(F.lit("False"))

    return short_sha(
        [
            width.cast("string"),
            hidden1.cast("string"),
            hidden2.cast("string"),
            F.format_string("%.6f", dropout1),
            F.format_string("%.6f", dropout2),
            patience.cast("string"),
            optimizer,
            F.format_string("%.8f", learning_rate),
            flag(periodic),
            flag(cosine),
            sorted_list(columns),
            n_train_rows.cast("string"),
        ]
    )
