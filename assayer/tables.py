"""Tables to validate, and a registry of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from assayer import spec
from assayer.builders import ColumnBuilder, RelationBuilder
from assayer.errors import AssayError, PatternError, TableNotFound
from assayer.plans.compiler import bind, check
from assayer.plans.executor import execute
from assayer.results import ValidationResult
from assayer.sources.base import Source
from assayer.sources.csv import read_csv
from assayer.sources.frame import from_frame
from assayer.sources.parquet import read_parquet
from assayer.sources.sizing import SplitSize, cut_by


class Table:
    """``prepare`` declares, ``validate`` runs.

    ``order_by``: columns that order the rows for the monotone rules; needed where the
    source has no file order.  ``compat``: nulls enter moments as 0, narrower Parquet
    numbers are mismatches, rules of one name merge, and any rule whose errors equal
    the number of values gets the cast failure's message.  ``split``: how large the pieces
    of files are that tasks read; Spark's own setting if none.
    """

    typed_text = False
    path = ""
    split: SplitSize | None = None

    def __init__(self, name: str, spark: SparkSession | None = None, order_by: list[str] | None = None, compat: bool = False):
        self.name, self._spark, self.order_by, self.compat = name, spark, order_by, compat
        self.spec = spec.TableSpec(name, ())

    @property
    def spark(self) -> SparkSession:
        return self._spark or SparkSession.active()

    def prepare(self, columns: Iterable[ColumnBuilder], relations: Iterable[RelationBuilder] = ()) -> Table:
        declared = spec.TableSpec(self.name, tuple(c.build() for c in columns), tuple(r.build() for r in relations))
        check(declared)
        for column in declared.columns:
            if self.typed_text and column.kind == spec.DATE and not column.format:
                raise PatternError(f"the date column {column.name!r} is read from text and needs a format")
        self.spec = declared
        return self

    def source(self) -> Source:
        raise NotImplementedError

    def validate(self) -> ValidationResult:
        with cut_by(self.spark, self.path, self.split):
            return execute(bind(self.spec, self.source(), self.compat), self.order_by, self.compat)

    def results(self) -> DataFrame:
        """Results as a DataFrame, a row for each rule."""
        return self.validate().to_frame(self.spark)

    def get_rules(self) -> dict[str, list[str]]:
        """Names of the domain and statistical rules by column, the type check of text first."""
        stages = (spec.ROW, spec.ORDER, spec.STATISTICAL)
        out = {}
        for column in self.spec.columns:
            ordered = [r.name for s in ((spec.ROW, spec.ORDER), (spec.STATISTICAL,)) for r in column.rules if r.stage in s and r.stage in stages]
            out[column.name] = ["TypeCheck"] * self.typed_text + ordered
        return out

    def _wanted(self) -> list[str]:
        return list(dict.fromkeys([c.name for c in self.spec.columns] + list(self.order_by or [])))


class CsvTable(Table):
    typed_text = True

    def __init__(self, path: str, name: str, spark: SparkSession | None = None, order_by: list[str] | None = None, compat: bool = False, multi_line: bool = False, split: SplitSize | None = None):
        super().__init__(name, spark, order_by, compat)
        self.path, self.multi_line, self.split = path, multi_line, split

    def source(self) -> Source:
        return read_csv(self.spark, self.path, self._wanted(), self.multi_line)


class ParquetTable(Table):
    def __init__(self, path: str, name: str, spark: SparkSession | None = None, order_by: list[str] | None = None, compat: bool = False, split: SplitSize | None = None):
        super().__init__(name, spark, order_by, compat)
        self.path, self.split = path, split

    def source(self) -> Source:
        return read_parquet(self.spark, self.path, self._wanted())


class FrameTable(Table):
    """Any DataFrame; ``text`` casts its string columns as a CSV file's."""

    def __init__(self, df: DataFrame, name: str, order_by: list[str] | None = None, compat: bool = False, text: bool = False):
        super().__init__(name, df.sparkSession, order_by, compat)
        self.df, self.typed_text = df, text

    def source(self) -> Source:
        wanted = [c for c in self._wanted() if c in self.df.columns]
        return from_frame(self.df.select(*(f"`{c}`" for c in wanted)) if wanted else self.df, self.typed_text)


class Validator:
    """Tables by name, in the order in which they were first added."""

    def __init__(self) -> None:
        self.tables: dict[str, Table] = {}

    def add_table(self, table: Table) -> Validator:
        self.tables[table.name] = table
        return self

    def validate_table(self, name: str) -> ValidationResult:
        if name not in self.tables:
            raise TableNotFound(name)
        return self.tables[name].validate()

    def validate_all(self) -> list[ValidationResult]:
        """All results; the first error ends it."""
        return [t.validate() for t in self.tables.values()]


__all__ = ["AssayError", "CsvTable", "FrameTable", "ParquetTable", "Table", "Validator"]
