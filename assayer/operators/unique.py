"""Uniqueness: values beyond the first of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer text moves as its SHA-256 and its length, which tell different texts apart as surely as can be asked.
LONG_TEXT = 32


def unique_key(value: Column, text: bool) -> list[Column]:
    """What equal values have in common and others don't, in a few bytes."""
    if not text:
        return [value.alias("key")]
    size = F.octet_length(value)
    return [F.when(size > LONG_TEXT, F.unhex(F.sha2(value, 256))).otherwise(value.cast("binary")).alias("key"), size.alias("size")]


def value_counts(df: DataFrame, value: Column, text: bool = False) -> DataFrame:
    """Keys of the non-null values with their number ``n``, summed before the shuffle."""
    keys = unique_key(value, text)
    rows = df.where(value.isNotNull()).select(*keys)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def repeats(counts: DataFrame) -> DataFrame:
    """One row ``errors``: non-null values less distinct values."""
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("errors"))


def count_repeats(df: DataFrame, value: Column, text: bool = False) -> DataFrame:
    """One row ``errors``: non-null values less distinct values.

    Equal values are summed before the shuffle, so a value that a third of all rows
    hold moves as one row a task.  Each column gets a plan of its own: several
    distinct counts in one would multiply every row by their number.
    """
    return repeats(value_counts(df, value, text))
