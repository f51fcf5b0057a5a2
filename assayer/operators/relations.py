"""Comparisons of two columns of the same row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer import spec
from assayer.functions.compare import FUNCTIONS, TITLES


def relation_title(rule: spec.RelationRule) -> str:
    return f"DateCompare {TITLES[rule.operator]}"


def relation_violation(rule: spec.RelationRule, left: Column, right: Column, floats: bool) -> Column:
    """True where the comparison fails: also where just one side is null or, for floats, where a side is NaN."""
    failed = F.coalesce(~FUNCTIONS[rule.operator](left, right), F.lit(True))
    if floats:
        failed = failed | F.coalesce(F.isnan(left), F.lit(False)) | F.coalesce(F.isnan(right), F.lit(False))
    return failed & ~(left.isNull() & right.isNull())
