"""A Spark-native engine for declarative data validation.

Declare tables, typed columns, rules and same-row relations; get one result
a rule, planned by Catalyst as a few aggregations.
"""

from assayer.builders import date_column, float_column, integer_column, relation, string_column
from assayer.config import load_tables
from assayer.report import ConsoleReporter, JsonReporter
from assayer.results import RuleResult, ValidationResult
from assayer.tables import CsvTable, FrameTable, ParquetTable, Validator

__all__ = [
    "ConsoleReporter", "CsvTable", "FrameTable", "JsonReporter", "ParquetTable", "RuleResult", "ValidationResult", "Validator",
    "date_column", "float_column", "integer_column", "load_tables", "relation", "string_column",
]
