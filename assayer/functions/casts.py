"""Tolerant casts of text: what isn't a value of the type becomes null, and counts as a type error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer import spec
from assayer.functions.dates import parse_date

#: Text that is a number of the type.  Spark's own cast would also take blanks, suffixes and fractions.
GRAMMAR = {
    spec.INTEGER: r"^[+-]?[0-9]+\z",
    spec.FLOAT: r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\z",
}


def typed(raw: Column, kind: str, date_format: str | None = None) -> Column:
    """``raw`` text as the declared type, null where it isn't one."""
    if kind == spec.STRING:
        return raw
    if kind == spec.DATE:
        return parse_date(raw, date_format or "%Y-%m-%d")
    value = raw.try_cast(spec.SPARK_TYPES[kind])
    if kind == spec.FLOAT:
        bare = F.lower(F.regexp_replace(raw, r"^[+-]", ""))
        value = F.when(bare == "nan", F.lit(float("nan"))).otherwise(value)
    return F.when(raw.rlike(GRAMMAR[kind]), value)
