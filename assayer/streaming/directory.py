"""A folder of arriving files, validated in micro-batches.

Row-local counts are additive, so each batch adds its one row of counts to a state
table in the checkpoint folder; results so far are read from it at any time.  For a
unique column a batch adds the number of each of its values, by a key of a few bytes,
and the batches' numbers are summed when results are read.
Distances from a mean and order need all rows at once and aren't offered here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer import spec
from assayer.errors import RuleTypeError
from assayer.operators.unique import repeats, value_counts
from assayer.plans.compiler import BoundColumn, BoundTable, bind
from assayer.plans.executor import _results, pass_a
from assayer.results import ValidationResult
from assayer.sources.csv import text_schema
from assayer.sources.frame import from_frame


class ArrivingFiles:
    """CSV (``text``) or Parquet files in a folder; ``state`` is a folder on storage that all executors share."""

    def __init__(self, table: spec.TableSpec, folder: str, state: str, schema=None, text: bool = False):
        for column in table.columns:
            if column.of(spec.STATISTICAL, spec.ORDER):
                raise RuleTypeError(f"{column.name!r}: only row-local, null and uniqueness rules can be added up over arriving files")
        self.table, self.folder, self.state, self.text = table, folder, state.rstrip("/"), text
        self.schema = schema or text_schema([c.name for c in table.columns])

    def _count(self, batch: DataFrame, number: int) -> None:
        bound = bind(self.table, from_frame(batch, self.text))
        # Named by batch: a batch that is run again replaces its own counts.
        batch.agg(*pass_a(bound, False)).write.mode("overwrite").parquet(f"{self.state}/counts/batch={number}")
        for i, column in self._unique(bound):
            value_counts(batch, column.value, column.spec.kind == spec.STRING).write.mode("overwrite").parquet(f"{self.state}/values_{i}/batch={number}")

    @staticmethod
    def _unique(bound: BoundTable) -> list[tuple[int, BoundColumn]]:
        return [(i, c) for i, c in enumerate(bound.columns.values()) if not c.mismatched and c.spec.of(spec.UNIQUE)]

    def start(self, spark: SparkSession, once: bool = True) -> StreamingQuery:
        """Processes what has arrived and ends, or keeps running."""
        reader = spark.readStream.schema(self.schema)
        files = reader.option("header", True).option("mode", "FAILFAST").csv(self.folder) if self.text else reader.parquet(self.folder)
        writer = files.writeStream.foreachBatch(self._count).option("checkpointLocation", f"{self.state}/progress")
        return (writer.trigger(availableNow=True) if once else writer).start()

    def result(self, spark: SparkSession) -> ValidationResult:
        """Results over all batches so far."""
        rows = spark.read.parquet(f"{self.state}/counts")
        found = rows.agg(*(F.sum(c).alias(c) for c in rows.columns if c != "batch")).first().asDict()
        empty = spark.createDataFrame([], self.schema)
        bound, counts = bind(self.table, from_frame(empty, self.text)), {}
        for i, _ in self._unique(bound):
            values = spark.read.parquet(f"{self.state}/values_{i}").drop("batch")
            keys = [c for c in values.columns if c != "n"]
            counts[i] = repeats(values.groupBy(*keys).agg(F.sum("n").alias("n"))).first()["errors"]
        return _results(bound, found, counts, False)
