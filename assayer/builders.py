"""The fluent interface: columns, rules and relations.

Every method changes the builder and returns it.  Thresholds are percentages of
all rows, 0 to 100; a rule passes at or below its own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column

from assayer import spec
from assayer.errors import IncorrectDate, RuleTypeError
from assayer.functions.compare import parse_operator
from assayer.functions.dates import date_pattern
from assayer.functions.patterns import translate


class ColumnBuilder:
    kind: str

    def __init__(self, name: str):
        self.name = name
        self.rules: list[spec.RuleSpec] = []
        self.type_threshold = 0.0
        self.format: str | None = None

    def _add(self, kind: str, threshold: float, **args) -> ColumnBuilder:
        self.rules.append(spec.RuleSpec(kind, float(threshold), tuple(args.items())))
        return self

    def with_type_threshold(self, threshold: float) -> ColumnBuilder:
        """Tolerated share of values that aren't of the type."""
        self.type_threshold = float(threshold)
        return self

    def is_not_null(self, threshold: float = 0.0) -> ColumnBuilder:
        return self._add("is_not_null", threshold)

    def is_unique(self, threshold: float = 0.0) -> ColumnBuilder:
        return self._add("is_unique", threshold)

    def custom(self, name: str, violates: Callable[[Column], Column], threshold: float = 0.0) -> ColumnBuilder:
        """Any rule on one value: ``violates`` makes the condition of an error; null is none."""
        self.rules.append(spec.RuleSpec("custom", float(threshold), (), name, violates))
        return self

    def build(self) -> spec.ColumnSpec:
        return spec.ColumnSpec(self.name, self.kind, tuple(self.rules), self.type_threshold, self.format)


class StringColumn(ColumnBuilder):
    kind = spec.STRING

    def with_length_between(self, min_length: int, max_length: int, threshold: float = 0.0) -> StringColumn:
        """Length in bytes of UTF-8."""
        return self._add("with_length_between", threshold, min_length=min_length, max_length=max_length)

    def with_min_length(self, min_length: int, threshold: float = 0.0) -> StringColumn:
        return self._add("with_min_length", threshold, min_length=min_length)

    def with_max_length(self, max_length: int, threshold: float = 0.0) -> StringColumn:
        return self._add("with_max_length", threshold, max_length=max_length)

    def is_exact_length(self, length: int, threshold: float = 0.0) -> StringColumn:
        return self._add("is_exact_length", threshold, length=length)

    def is_in(self, members: Sequence[str], threshold: float = 0.0) -> StringColumn:
        return self._add("is_in", threshold, members=tuple(members))

    def with_regex(self, pattern: str, flags: str | None = None, threshold: float = 0.0) -> StringColumn:
        translate(pattern, flags)
        return self._add("with_regex", threshold, pattern=pattern, flags=flags)

    def is_numeric(self, threshold: float = 0.0) -> StringColumn:
        return self._add("is_numeric", threshold)

    def is_alpha(self, threshold: float = 0.0) -> StringColumn:
        return self._add("is_alpha", threshold)

    def is_alphanumeric(self, threshold: float = 0.0) -> StringColumn:
        return self._add("is_alphanumeric", threshold)

    def is_lowercase(self, threshold: float = 0.0) -> StringColumn:
        return self._add("is_lowercase", threshold)

    def is_uppercase(self, threshold: float = 0.0) -> StringColumn:
        return self._add("is_uppercase", threshold)

    def is_url(self, threshold: float = 0.0) -> StringColumn:
        return self._add("is_url", threshold)

    def is_email(self, threshold: float = 0.0) -> StringColumn:
        return self._add("is_email", threshold)

    def is_uuid(self, threshold: float = 0.0) -> StringColumn:
        return self._add("is_uuid", threshold)


class NumericColumn(ColumnBuilder):
    number: type

    def _bound(self, value) -> int | float:
        if isinstance(value, bool) or not isinstance(value, (int, float)) or self.number is int and int(value) != value:
            raise RuleTypeError(f"{value!r} is no bound for the {self.kind} column {self.name!r}")
        return self.number(value)

    def between(self, min_value, max_value, threshold: float = 0.0) -> NumericColumn:
        """Both bounds included."""
        return self._add("between", threshold, min=self._bound(min_value), max=self._bound(max_value))

    def min(self, min_value, threshold: float = 0.0) -> NumericColumn:
        return self._add("min", threshold, min=self._bound(min_value))

    def max(self, max_value, threshold: float = 0.0) -> NumericColumn:
        return self._add("max", threshold, max=self._bound(max_value))

    def is_positive(self, threshold: float = 0.0) -> NumericColumn:
        return self._add("is_positive", threshold)

    def is_negative(self, threshold: float = 0.0) -> NumericColumn:
        return self._add("is_negative", threshold)

    def is_non_negative(self, threshold: float = 0.0) -> NumericColumn:
        return self._add("is_non_negative", threshold)

    def is_non_positive(self, threshold: float = 0.0) -> NumericColumn:
        return self._add("is_non_positive", threshold)

    def is_monotonically_increasing(self, threshold: float = 0.0) -> NumericColumn:
        """No value below the row before it."""
        return self._add("is_increasing", threshold)

    def is_monotonically_decreasing(self, threshold: float = 0.0) -> NumericColumn:
        return self._add("is_decreasing", threshold)

    def std_dev_check(self, max_std_dev: float, threshold: float = 0.0) -> NumericColumn:
        """Fewer than so many sample deviations from the mean."""
        return self._add("std_dev", threshold, max_std_dev=float(max_std_dev))

    def mean_variance(self, max_variance_percent: float, threshold: float = 0.0) -> NumericColumn:
        """At most so many percent of the mean away from it."""
        return self._add("mean_variance", threshold, max_variance_percent=float(max_variance_percent))


class IntegerColumn(NumericColumn):
    kind, number = spec.INTEGER, int


class FloatColumn(NumericColumn):
    kind, number = spec.FLOAT, float


class DateColumn(ColumnBuilder):
    kind = spec.DATE

    def __init__(self, name: str, format: str | None = None):
        super().__init__(name)
        if format is not None:
            date_pattern(format)
        self.format = format

    def get_format(self) -> str | None:
        return self.format

    @staticmethod
    def _date(year: int, month: int | None, day: int | None) -> dt.date:
        month, day = 1 if month is None else month, 1 if day is None else day
        try:
            return dt.date(year, month, day)
        except ValueError as e:
            raise IncorrectDate(year, month, day) from e

    def is_before(self, year: int, month: int | None = None, day: int | None = None, threshold: float = 0.0) -> DateColumn:
        """Strictly before; month and day default to 1."""
        return self._add("is_before", threshold, bound=self._date(year, month, day))

    def is_after(self, year: int, month: int | None = None, day: int | None = None, threshold: float = 0.0) -> DateColumn:
        return self._add("is_after", threshold, bound=self._date(year, month, day))

    def is_not_futur(self, threshold: float = 0.0) -> DateColumn:
        """Before today, as of this call."""
        return self._add("is_not_futur", threshold, bound=dt.date.today())

    def is_not_past(self, threshold: float = 0.0) -> DateColumn:
        return self._add("is_not_past", threshold, bound=dt.date.today())

    def is_weekday(self, threshold: float = 0.0) -> DateColumn:
        return self._add("is_weekday", threshold)

    def is_weekend(self, threshold: float = 0.0) -> DateColumn:
        return self._add("is_weekend", threshold)


class RelationBuilder:
    def __init__(self, left: str, right: str):
        self.left, self.right = left, right
        self.rules: list[spec.RelationRule] = []

    def date_comparaison(self, operator: str, threshold: float = 0.0) -> RelationBuilder:
        self.rules.append(spec.RelationRule("date", parse_operator(operator), float(threshold)))
        return self

    def numeric_comparaison(self, operator: str, threshold: float = 0.0) -> RelationBuilder:
        self.rules.append(spec.RelationRule("numeric", parse_operator(operator), float(threshold)))
        return self

    def build(self) -> spec.RelationSpec:
        return spec.RelationSpec(self.left, self.right, tuple(self.rules))


def string_column(name: str) -> StringColumn:
    return StringColumn(name)


def integer_column(name: str) -> IntegerColumn:
    return IntegerColumn(name)


def float_column(name: str) -> FloatColumn:
    return FloatColumn(name)


def date_column(name: str, format: str | None = None) -> DateColumn:
    """``format`` is a strftime format, needed where the column is read from text."""
    return DateColumn(name, format)


def relation(left: str, right: str) -> RelationBuilder:
    return RelationBuilder(left, right)
