"""The logical plan of a validation: frozen descriptions of tables, columns, rules and relations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import types as T

STRING, INTEGER, FLOAT, DATE = "string", "integer", "float", "date"
SPARK_TYPES: dict[str, T.DataType] = {STRING: T.StringType(), INTEGER: T.LongType(), FLOAT: T.DoubleType(), DATE: T.DateType()}

# Which pass of the plan answers a rule.
ROW, STATISTICAL, UNIQUE, ORDER, NULLS = "row", "statistical", "unique", "order", "nulls"

#: Rule kind: (reported name, pass, column types that take it).
RULES: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "is_not_null": ("NullCheck", NULLS, (STRING, INTEGER, FLOAT, DATE)),
    "is_unique": ("Unicity", UNIQUE, (STRING, INTEGER, FLOAT, DATE)),
    "with_length_between": ("WithLengthBetween", ROW, (STRING,)),
    "with_min_length": ("WithMinLength", ROW, (STRING,)),
    "with_max_length": ("WithMaxLength", ROW, (STRING,)),
    "is_exact_length": ("IsExactLength", ROW, (STRING,)),
    "is_in": ("IsIn", ROW, (STRING,)),
    "with_regex": ("WithRegex", ROW, (STRING,)),
    "is_numeric": ("IsNumeric", ROW, (STRING,)),
    "is_alpha": ("IsAlpha", ROW, (STRING,)),
    "is_alphanumeric": ("IsAlphaNumeric", ROW, (STRING,)),
    "is_lowercase": ("IsLowerCase", ROW, (STRING,)),
    "is_uppercase": ("IsUpperCase", ROW, (STRING,)),
    "is_url": ("IsUrl", ROW, (STRING,)),
    "is_email": ("IsEmail", ROW, (STRING,)),
    "is_uuid": ("IsUuid", ROW, (STRING,)),
    "between": ("Between", ROW, (INTEGER, FLOAT)),
    "min": ("Min", ROW, (INTEGER, FLOAT)),
    "max": ("Max", ROW, (INTEGER, FLOAT)),
    "is_positive": ("IsPositive", ROW, (INTEGER, FLOAT)),
    "is_negative": ("IsNegative", ROW, (INTEGER, FLOAT)),
    "is_non_negative": ("IsNonNegative", ROW, (INTEGER, FLOAT)),
    "is_non_positive": ("IsNonPositive", ROW, (INTEGER, FLOAT)),
    "is_increasing": ("IsIncreasing", ORDER, (INTEGER, FLOAT)),
    "is_decreasing": ("IsDecreasing", ORDER, (INTEGER, FLOAT)),
    "std_dev": ("StdDevCheck", STATISTICAL, (INTEGER, FLOAT)),
    "mean_variance": ("MeanVariance", STATISTICAL, (INTEGER, FLOAT)),
    "is_before": ("IsBefore", ROW, (DATE,)),
    "is_after": ("IsAfter", ROW, (DATE,)),
    "is_not_futur": ("IsNotFutur", ROW, (DATE,)),
    "is_not_past": ("IsNotPast", ROW, (DATE,)),
    "is_weekday": ("IsWeekday", ROW, (DATE,)),
    "is_weekend": ("IsWeekend", ROW, (DATE,)),
    "custom": ("Custom", ROW, (STRING, INTEGER, FLOAT, DATE)),
}


@dataclass(frozen=True)
class RuleSpec:
    kind: str
    threshold: float = 0.0
    args: tuple[tuple[str, Any], ...] = ()
    label: str | None = None  # of a custom rule
    predicate: Callable[[Column], Column] | None = field(default=None, compare=False)

    @property
    def name(self) -> str:
        return self.label or RULES[self.kind][0]

    @property
    def stage(self) -> str:
        return RULES[self.kind][1]

    def arg(self, name: str) -> Any:
        return dict(self.args).get(name)


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    rules: tuple[RuleSpec, ...] = ()
    type_threshold: float = 0.0
    format: str | None = None

    def of(self, *stages: str) -> list[RuleSpec]:
        return [r for r in self.rules if r.stage in stages]


@dataclass(frozen=True)
class RelationRule:
    kind: str  # "date" or "numeric"
    operator: str  # one of compare.OPERATORS
    threshold: float = 0.0


@dataclass(frozen=True)
class RelationSpec:
    left: str
    right: str
    rules: tuple[RelationRule, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.left} | {self.right}"


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    relations: tuple[RelationSpec, ...] = ()

    def column(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name == name), None)
