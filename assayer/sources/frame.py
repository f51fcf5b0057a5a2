"""Any DataFrame as a table: every connector that Spark has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from assayer.operators.order import ordered_by
from assayer.sources.base import Source


def from_frame(df: DataFrame, text: bool = False) -> Source:
    """``text``: columns are text to be cast, as from a CSV file."""
    return Source(df, text)


def with_order(df: DataFrame, keys: list[str], values: list[Column]) -> Source:
    """The source's ordered values, for the order pass."""
    ranged, block = ordered_by(df, keys, values)
    return Source(ranged, False, ranged, block)
