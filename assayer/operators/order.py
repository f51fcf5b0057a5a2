"""Monotonicity over the whole table without moving or sorting rows that are in order already.

A task reads stretches of rows that follow each other: the rows of a piece of a file, or of
a range of sort keys.  Where it reads them it compares neighbours, in Arrow batches, and
reduces a stretch to its count of violations and its edge values; a lag over the few
stretches compares the edges.  A null on either side of a pair is no comparison; it
isn't skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.shipping import ship


def _broken(kind: str, before: Column, after: Column) -> Column:
    return F.coalesce(after < before if kind == "is_increasing" else after > before, F.lit(False))


def _breaks(increasing: bool, values: np.ndarray, known: np.ndarray) -> int:
    """Pairs of neighbours out of order; not-a-number is above all numbers, as Spark orders it."""
    low, high = (values[1:], values[:-1]) if increasing else (values[:-1], values[1:])
    out = low < high
    if values.dtype.kind == "f":
        out |= np.isnan(high) & ~np.isnan(low)
    return int((out & known[1:] & known[:-1]).sum())


def _stretches(increasing: list[bool], blocks: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (block columns, start, values) to a row for each stretch: blocks, start, and errors, first and last of each value."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple | None = None  # block, start, errors, firsts, lasts
        schema = None

        def row(done: tuple) -> pa.RecordBatch:
            block, start, errors, firsts, lasts = done
            columns = [*block, start]
            for e, f, l in zip(errors, firsts, lasts, strict=True):
                columns += [e, f, l]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, schema.types, strict=True)], names=schema.names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if schema is None:
                kinds = [batch.schema.field(i).type for i in range(batch.num_columns)]
                fields = [(f"block_{i}", kinds[i]) for i in range(blocks)] + [("start", kinds[blocks])]
                for i in range(len(increasing)):
                    fields += [(f"errors_{i}", pa.int64()), (f"first_{i}", kinds[blocks + 1 + i]), (f"last_{i}", kinds[blocks + 1 + i])]
                schema = pa.schema(fields)
            edge = np.zeros(n, bool)
            edge[0] = True
            for i in range(blocks):
                column = batch.column(i)
                edge[1:] |= np.asarray(pa.compute.not_equal(column[1:], column[:-1]).fill_null(True))
            starts = np.flatnonzero(edge).tolist()
            for a, b in zip(starts, [*starts[1:], n], strict=True):
                block = tuple(batch.column(i)[a].as_py() for i in range(blocks))
                errors, firsts, lasts = [], [], []
                same = open_ is not None and open_[0] == block
                for i, up in enumerate(increasing):
                    column = batch.column(blocks + 1 + i)[a:b]
                    first, last = column[0].as_py(), column[-1].as_py()
                    if same and open_[4][i] is not None:  # the last value of the batch before is a neighbour
                        column = pa.concat_arrays([pa.array([open_[4][i]], column.type), column])
                    known = np.asarray(column.is_valid())
                    values = np.asarray(column.fill_null(0))
                    errors.append(_breaks(up, values, known))
                    firsts.append(first)
                    lasts.append(last)
                if same:
                    open_ = (block, open_[1], [x + y for x, y in zip(open_[2], errors)], open_[3], lasts)
                else:
                    if open_ is not None:
                        yield row(open_)
                    open_ = (block, batch.column(blocks)[a].as_py(), errors, firsts, lasts)
        if open_ is not None:
            yield row(open_)

    return run


def count_breaks(df: DataFrame, checks: list[tuple[str, Column]], block: list[Column]) -> DataFrame:
    """One row ``errors_0``, ``errors_1``...: violations of each (rule kind, value).

    ``block`` columns are equal in a stretch of rows that a task reads one after another;
    the stretches sort by them, those of one block by their first row in the task.
    """
    ship(df.sparkSession)
    values = [c.alias(f"value_{i}") for i, (_, c) in enumerate(checks)]
    rows = df.select(*(c.alias(f"block_{i}") for i, c in enumerate(block)), F.monotonically_increasing_id().alias("start"), *values)
    fields = [*rows.schema.fields[: len(block) + 1]]
    for i in range(len(checks)):
        kind = rows.schema[f"value_{i}"].dataType
        fields += [T.StructField(f"errors_{i}", T.LongType()), T.StructField(f"first_{i}", kind), T.StructField(f"last_{i}", kind)]
    edges = rows.mapInArrow(_stretches([kind == "is_increasing" for kind, _ in checks], len(block)), T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
    along = Window.orderBy(*(f"block_{i}" for i in range(len(block))), "start")  # one row for each stretch
    edges = edges.select("*", *(F.lag(f"last_{i}").over(along).alias(f"came_{i}") for i in range(len(checks))))
    return edges.agg(
        *(F.coalesce(F.sum(F.col(f"errors_{i}") + _broken(kind, F.col(f"came_{i}"), F.col(f"first_{i}")).cast("long")), F.lit(0)).cast("long").alias(f"errors_{i}") for i, (kind, _) in enumerate(checks))
    )


def ordered_by(df: DataFrame, keys: list[str], values: list[Column], partitions: int | None = None) -> tuple[DataFrame, list[Column]]:
    """The values in stretches for a table without file order: sorted ranges of the keys, one for each partition.

    Rows with equal keys have no order among themselves, so the keys should be unique.
    """
    narrow = df.select(*(F.col(f"`{k}`").alias(f"key_{i}") for i, k in enumerate(keys)), *(v.alias(f"value_{i}") for i, v in enumerate(values)))
    names = [f"key_{i}" for i in range(len(keys))]
    ranged = (narrow.repartitionByRange(partitions, *names) if partitions else narrow.repartitionByRange(*names)).sortWithinPartitions(*names)
    return ranged, [F.spark_partition_id()]
