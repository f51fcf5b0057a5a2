"""Row-local rules: a condition on one value that holds where it violates the rule.

Every condition is false, never null, for a null value, so conditions may be
combined and counted as they are.  NaN compares as in IEEE arithmetic: it is
neither above nor below a bound.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer import spec
from assayer.functions.patterns import NAMED, translate

#: Lengths are counted in bytes of UTF-8.
LENGTH = F.octet_length
#: Smallest positive value that a type counts as positive.
UNIT = {spec.INTEGER: 1, spec.FLOAT: sys.float_info.epsilon}


def _below(value: Column, bound: object) -> Column:
    return value < F.lit(bound)


def _above(value: Column, bound: object, kind: str) -> Column:
    over = value > F.lit(bound)
    return over & ~F.isnan(value) if kind == spec.FLOAT else over


def violations(rule: spec.RuleSpec, value: Column, kind: str) -> list[Column]:
    """Conditions whose counts add up to the rule's errors."""
    arg, name = rule.arg, rule.kind
    if name == "custom":
        found = [rule.predicate(value)]
    elif name in ("with_length_between", "with_min_length", "with_max_length", "is_exact_length"):
        size, low, high = LENGTH(value), arg("min_length"), arg("max_length")
        if name == "is_exact_length":
            found = [size != arg("length")]
        else:
            found = [c for c in (size < low if low is not None else None, size > high if high is not None else None) if c is not None]
    elif name == "is_in":
        members = list(arg("members"))
        found = [~value.isin(members) if members else value.isNotNull()]
    elif name == "with_regex":
        found = [~value.rlike(translate(arg("pattern"), arg("flags")))]
    elif name in NAMED:
        found = [~value.rlike(translate(NAMED[name]))]
    elif name in ("between", "min", "max"):
        found = [_below(value, arg("min"))] if name != "max" else []
        found += [_above(value, arg("max"), kind)] if name != "min" else []
    elif name == "is_positive":
        found = [_below(value, UNIT[kind])]
    elif name == "is_negative":
        found = [_above(value, -UNIT[kind], kind)]
    elif name == "is_non_negative":
        found = [_below(value, 0)]
    elif name == "is_non_positive":
        found = [_above(value, 0, kind)]
    elif name in ("is_before", "is_not_futur"):
        found = [value >= F.lit(arg("bound"))]
    elif name in ("is_after", "is_not_past"):
        found = [value <= F.lit(arg("bound"))]
    elif name == "is_weekday":
        found = [F.weekday(value) >= 5]
    elif name == "is_weekend":
        found = [F.weekday(value) < 5]
    else:
        raise AssertionError(name)
    return [F.coalesce(c, F.lit(False)) for c in found]


def count_violations(rule: spec.RuleSpec, value: Column, kind: str) -> Column:
    """The aggregate that counts a rule's errors."""
    counts = [F.count_if(c) for c in violations(rule, value, kind)]
    return sum(counts[1:], counts[0])
