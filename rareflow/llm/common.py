"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_table

#: White space of the word rule, as the inside of a character class and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: A word: a longest run of anything else.
WORD = rf"[^{SPACE_CLASS}]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Shared:
    """A value of bounded size, broadcast with its code, so that executors need no copy of this package."""

    def __init__(self, spark: SparkSession, value: Any):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> Any:
        """Unpacked anew at each use: once per task."""
        return cloudpickle.loads(self.sent.value)


def map_batches(
    df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """One Arrow batch out for each batch in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(batch)

    return df.mapInArrow(run, schema)


#: Rows of a table that is broadcast; counted, not estimated.
SMALL_ROWS = 200_000


def joined(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` join ``small``, which is broadcast if it has at most ``SMALL_ROWS`` rows and is shuffled else."""
    small = stage_table(small, "looked-up")
    few = small.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return rows.join(F.broadcast(small) if few else small.hint("merge"), on, how)
