"""Results of a validation, on the driver and as a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "table_name string, kind string, target string, rule_name string, error_count bigint, error_percentage double, threshold double, passed boolean, error_message string"
)
#: What is reported where every value of a column failed its cast.
CAST_FAILURE = "TypeCast failure: the column's other rules were not checked"


@dataclass
class RuleResult:
    rule_name: str
    error_count: int
    threshold: float
    total_rows: int
    error_message: str | None = None

    @property
    def error_percentage(self) -> float:
        return 100.0 * self.error_count / self.total_rows if self.total_rows else 0.0

    @property
    def passed(self) -> bool:
        return self.error_percentage <= self.threshold

    def set_error_message(self, message: str) -> None:
        self.error_message = message


@dataclass
class ValidationResult:
    """Rule results by column and by relation; the table passes if all of its columns' rules do."""

    table_name: str
    total_rows: int
    columns: dict[str, list[RuleResult]] = field(default_factory=dict)
    relations: dict[str, list[RuleResult]] = field(default_factory=dict)
    valid_values: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def get_column_results(self) -> dict[str, list[RuleResult]]:
        return self.columns

    def get_relation_results(self) -> dict[str, list[RuleResult]]:
        return self.relations

    def is_passed(self) -> tuple[int, int]:
        """Rules passed and rules in all, of columns only."""
        rules = [r for rs in self.columns.values() for r in rs]
        return sum(r.passed for r in rules), len(rules)

    def relations_passed(self) -> tuple[int, int]:
        rules = [r for rs in self.relations.values() for r in rs]
        return sum(r.passed for r in rules), len(rules)

    @property
    def passed(self) -> bool:
        good, total = self.is_passed()
        return good == total

    def as_dict(self) -> dict:
        return {"table_name": self.table_name, "total_rows": self.total_rows, "passed": self.is_passed()}

    def rows(self) -> list[tuple]:
        out = []
        for kind, group in (("column", self.columns), ("relation", self.relations)):
            for target, rules in group.items():
                out += [(self.table_name, kind, target, r.rule_name, r.error_count, r.error_percentage, r.threshold, r.passed, r.error_message) for r in rules]
        return sorted(out, key=lambda r: r[1:4])

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """A row for each rule."""
        kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        fields = [f.split() for f in SCHEMA.split(", ")]
        columns = [*zip(*self.rows())] or [()] * len(fields)
        table = pa.table([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])
        return spark.createDataFrame(table)
