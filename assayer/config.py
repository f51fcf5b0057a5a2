"""TOML documents that declare tables.

::

    [[table]]
    name, path, type_checking_threshold?, rule_threshold?
    [[table.column]]
    name, datatype, format?, type_checking_threshold?, rule_threshold?
    [[table.column.rule]]
    name, threshold?, and the rule's arguments
    [[table.relations]]
    column_one, column_two, rule_threshold?
    [[table.relations.rule]]
    name, operator, threshold?

A rule's threshold is its own, or else its column's or relation's, or else its
table's, or else 0.
"""

from __future__ import annotations

import os
import tomllib
from typing import Any

from pyspark.sql import SparkSession

from assayer import builders, spec
from assayer.errors import AssayError, ConfigError
from assayer.sources.formats import format_of
from assayer.tables import CsvTable, ParquetTable, Table

COLUMNS = {"string": builders.StringColumn, "integer": builders.IntegerColumn, "float": builders.FloatColumn, "date": builders.DateColumn}
#: Rule name: (builder method, arguments that it needs, arguments that it may have).
ARGUMENTS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {kind: (kind, (), ()) for kind in spec.RULES if kind != "custom"} | {
    "with_length_between": ("with_length_between", ("min_length", "max_length"), ()),
    "with_min_length": ("with_min_length", ("min_length",), ()),
    "with_max_length": ("with_max_length", ("max_length",), ()),
    "is_exact_length": ("is_exact_length", ("length",), ()),
    "is_in": ("is_in", ("members",), ()),
    "with_regex": ("with_regex", ("pattern",), ("flag",)),
    "between": ("between", ("min", "max"), ()),
    "min": ("min", ("min",), ()),
    "max": ("max", ("max",), ()),
    "is_increasing": ("is_monotonically_increasing", (), ()),
    "is_decreasing": ("is_monotonically_decreasing", (), ()),
    "std_dev": ("std_dev_check", ("max_std_dev",), ()),
    "mean_variance": ("mean_variance", ("max_variance_percent",), ()),
    "is_before": ("is_before", ("year",), ("month", "day")),
    "is_after": ("is_after", ("year",), ("month", "day")),
}
WHOLE = ("min_length", "max_length", "length", "year", "month", "day")
RELATIONS = ("date_comparaison", "numeric_comparaison")


def _need(block: dict, key: str, where: str) -> Any:
    if key not in block:
        raise ConfigError(f"{where}: {key} is missing")
    return block[key]


def _number(value: Any, where: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ConfigError(f"{where}: {value!r} is no number")
    return float(value)


def _threshold(where: str, *levels: dict[str, Any]) -> float:
    """The first threshold given, from the rule outwards."""
    for block, key in zip(levels, ("threshold", *["rule_threshold"] * 2)):
        if block.get(key) is not None:
            return _number(block[key], where)
    return 0.0


def _check_arguments(rule: dict, datatype: str, where: str) -> None:
    name = rule["name"]
    for key in WHOLE:
        if key in rule and (isinstance(rule[key], bool) or not isinstance(rule[key], int) or rule[key] < 0):
            raise ConfigError(f"{where}: {key} must be a whole number")
    if name == "with_length_between":
        low, high = rule["min_length"], rule["max_length"]
        if low > high:
            raise ConfigError(f"{where}: no text has {low} bytes or more and {high} or fewer")
        if low == high:
            raise ConfigError(f"{where}: is_exact_length is the rule for {low} bytes exactly")
    if name in ("between", "min", "max"):
        bounds = [rule[k] for k in ("min", "max") if k in rule]
        if any(isinstance(b, bool) or not isinstance(b, (int, float)) for b in bounds):
            raise ConfigError(f"{where}: bounds must be integers or floats")
        if len({type(b) for b in bounds}) > 1:
            raise ConfigError(f"{where}: min and max must be of the same type, both integer or both float")
        if name == "between" and bounds[0] >= bounds[1]:
            raise ConfigError(f"{where}: min {bounds[0]} must be less than max {bounds[1]}")
        wanted = {"integer": int, "float": float}.get(datatype)
        if wanted and not all(isinstance(b, wanted) for b in bounds):
            raise ConfigError(f"{where}: a column of type {datatype} needs {datatype} bounds")
    if name == "is_in" and (not isinstance(rule["members"], list) or not all(isinstance(m, str) for m in rule["members"])):
        raise ConfigError(f"{where}: members must be strings")


def build_column(block: dict, table: dict) -> builders.ColumnBuilder:
    name = _need(block, "name", "a column")
    where = f"column {name!r}"
    datatype = _need(block, "datatype", where)
    if datatype not in COLUMNS:
        raise ConfigError(f"{where}: unknown datatype {datatype!r}")
    if datatype == "date" and block.get("format") is None and format_of(table["path"]) == "csv":
        raise ConfigError(f"{where}: a date read from CSV needs a format")
    column = COLUMNS[datatype](name, block["format"]) if datatype == "date" and block.get("format") else COLUMNS[datatype](name)
    for level in (block, table):
        if level.get("type_checking_threshold") is not None:
            column.with_type_threshold(_number(level["type_checking_threshold"], where))
            break
    for rule in _need(block, "rule", where):
        kind = _need(rule, "name", where)
        at = f"{where}, rule {kind!r}"
        if kind not in ARGUMENTS:
            raise ConfigError(f"{at}: unknown rule")
        if datatype not in spec.RULES[kind][2]:
            raise ConfigError(f"{at}: not a rule for a column of type {datatype}")
        method, needed, optional = ARGUMENTS[kind]
        for key in needed:
            _need(rule, key, at)
        _check_arguments(rule, datatype, at)
        args = [rule[k] for k in needed] + [rule.get(k) for k in optional]
        try:
            getattr(column, method)(*args, threshold=_threshold(at, rule, block, table))
        except AssayError as e:
            raise ConfigError(f"{at}: {e}") from e
    return column


def build_relation(block: dict, table: dict, names: list[str]) -> builders.RelationBuilder:
    sides = [_need(block, k, "a relation") for k in ("column_one", "column_two")]
    for side in sides:
        if side not in names:
            raise ConfigError(f"relation: column {side!r} isn't declared")
    made = builders.relation(*sides)
    for rule in _need(block, "rule", f"relation {sides}"):
        kind = _need(rule, "name", f"relation {sides}")
        if kind not in RELATIONS:
            raise ConfigError(f"relation {sides}: unknown rule {kind!r}")
        try:
            getattr(made, kind)(_need(rule, "operator", f"relation {sides}"), _threshold(f"relation {sides}", rule, block, table))
        except AssayError as e:
            raise ConfigError(f"relation {sides}: {e}") from e
    return made


def build_table(block: dict, spark: SparkSession | None = None) -> Table:
    name = _need(block, "name", "a table")
    path = _need(block, "path", f"table {name!r}")
    if "://" not in path and not os.path.exists(path):
        raise ConfigError(f"table {name!r}: no file at {path}")
    try:
        kind = format_of(path)
        table = (CsvTable if kind == "csv" else ParquetTable)(path, name, spark)
        columns = [build_column(c, block) for c in _need(block, "column", f"table {name!r}")]
        relations = [build_relation(r, block, [c.name for c in columns]) for r in block.get("relations", [])]
        return table.prepare(columns, relations)
    except ConfigError as e:
        raise ConfigError(f"table {name!r}: {e}") from e
    except AssayError as e:
        raise ConfigError(f"table {name!r}: {e}") from e


def parse_config(path: str) -> dict:
    """The document, read and with at least one table."""
    try:
        with open(path, "rb") as f:
            document = tomllib.load(f)
    except OSError as e:
        raise ConfigError(f"can't read {path}: {e}") from e
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path} is no TOML document: {e}") from e
    if not document.get("table"):
        raise ConfigError(f"{path} declares no table")
    return document


def load_tables(path: str, spark: SparkSession | None = None) -> list[Table]:
    """All tables of a document, in its order."""
    return [build_table(block, spark) for block in parse_config(path)["table"]]
