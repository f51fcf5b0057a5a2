"""Checks a table's description against its source and binds rules to columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer import spec
from assayer.errors import ColumnNotFound, RuleTypeError
from assayer.functions.casts import typed
from assayer.sources.base import Source

#: Narrower types that hold no value that the declared type doesn't.
WIDENED = {spec.INTEGER: (T.ByteType, T.ShortType, T.IntegerType), spec.FLOAT: (T.FloatType,)}


@dataclass
class BoundColumn:
    """A declared column that the source has."""

    spec: spec.ColumnSpec
    raw: Column
    value: Column
    checked: bool  # text that is cast and gets a TypeCheck
    mismatched: bool  # of another physical type: nothing but its nulls can be checked


@dataclass
class BoundTable:
    spec: spec.TableSpec
    source: Source
    columns: dict[str, BoundColumn]
    relations: list[spec.RelationSpec]
    warnings: list[str] = field(default_factory=list)


def check(table: spec.TableSpec) -> None:
    """Errors of the description itself: rules that a type doesn't take, relations without a common type."""
    for column in table.columns:
        for rule in column.rules:
            if column.kind not in spec.RULES[rule.kind][2]:
                raise RuleTypeError(f"{rule.name} isn't a rule for the {column.kind} column {column.name!r}")
    for relation in table.relations:
        sides = [table.column(n) for n in (relation.left, relation.right)]
        for name, side in zip((relation.left, relation.right), sides):
            if side is None:
                raise ColumnNotFound(name)
        kinds = {s.kind for s in sides}
        for rule in relation.rules:
            if len(kinds) > 1 or not kinds <= ({spec.DATE} if rule.kind == "date" else {spec.INTEGER, spec.FLOAT}):
                raise RuleTypeError(f"a {rule.kind} comparison of {relation.name!r} needs two columns of one such type, not {sides[0].kind} and {sides[1].kind}")


def bind(table: spec.TableSpec, source: Source, compat: bool = False) -> BoundTable:
    """Columns by name; those that the source lacks are left out with a warning.

    ``compat``: a Parquet column of a narrower number type is a mismatch too.
    """
    check(table)
    kinds = {f.name: f.dataType for f in source.frame.schema.fields}
    columns, warnings = {}, []
    for column in table.columns:
        if column.name not in kinds:
            warnings.append(f"{table.name}: the source has no column {column.name!r}; its rules were skipped")
            continue
        raw, actual, wanted = F.col(f"`{column.name}`"), kinds[column.name], spec.SPARK_TYPES[column.kind]
        if source.text and isinstance(actual, T.StringType):
            columns[column.name] = BoundColumn(column, raw, typed(raw, column.kind, column.format), True, False)
            continue
        widened = isinstance(actual, WIDENED.get(column.kind, ())) and not compat
        same = type(actual) is type(wanted) or widened
        columns[column.name] = BoundColumn(column, raw, raw.cast(wanted) if widened else raw, False, not same)
    relations = [r for r in table.relations if all(n in columns and not columns[n].mismatched for n in (r.left, r.right))]
    return BoundTable(table, source, columns, relations, warnings)
