"""What the operators share: shipping the package, slicing Arrow batches, work folders, joins on keys that may be hot."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.shipping import shared_folder, ship

#: Rows and payload bytes of one slice that a Python function sees at a time.
SLICE_ROWS = 512
SLICE_BYTES = 4 << 20
#: Pages of 4 KB in memory from which a worker gives back what it doesn't use.
LARGE_PAGES = (160 << 20) >> 12
#: A key with at least this share of a table's rows, so at most 1/HEAVY keys, is joined by a broadcast.
HEAVY, HEAVY_LEAST = 1 / 1024, 256
#: Up to so many narrow rows are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has few rows and, but for one long row, few bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = min(SLICE_ROWS, max(1, int(SLICE_BYTES * batch.num_rows / max(1, batch.nbytes))))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def release() -> None:
    """Give freed memory back to the system, so that a reused worker doesn't keep a large task's peak."""
    try:
        with open("/proc/self/statm") as f:
            if int(f.read().split()[1]) < LARGE_PAGES:
                return
    except OSError:
        pass  # no such file on this system
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def releasing(run: Callable) -> Callable:
    """A function for mapInArrow that releases memory when its task ends."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over small slices; ``make`` runs once a task and returns the function."""
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for part in slices(batches):
            yield each(part)

    return df.mapInArrow(releasing(run), schema)


def keep(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def discard(kept: DataFrame) -> None:
    """Delete what ``keep`` wrote, once nothing reads it any more."""
    spark = kept.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(kept._kept_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def attach(left: DataFrame, right: DataFrame, key: str, how: str = "inner", narrow: bool = True) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key; ``how`` is inner or left.

    A narrow ``right`` of at most BROADCAST_ROWS rows is broadcast.  Else rows of ``left`` whose key
    is heavy, or null, meet a broadcast of those rows of ``right``, at most 1/HEAVY of them; the others
    meet by a shuffle.  So no key fills a task.
    """
    right = right if hasattr(right, "_kept_at") or not narrow else keep(right, "right")
    if narrow and right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    left = left if hasattr(left, "_kept_at") else keep(left, "left")
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    bound = max(HEAVY_LEAST, HEAVY * left.count())
    heavy = [r[0] for r in counts.where(F.col("rows") >= bound).select(key).collect()]
    if not heavy:
        return left.join(right, key, how)
    keys = left.sparkSession.createDataFrame([(k,) for k in heavy if k is not None], left.select(key).schema)
    few = right.join(F.broadcast(keys), key, "left_semi")
    marked = left.join(F.broadcast(keys.withColumn("_heavy", F.lit(True))), key, "left")
    is_hot = F.coalesce(F.col("_heavy"), F.col(key).isNull())
    hot = marked.where(is_hot).drop("_heavy").join(F.broadcast(few), key, how)
    return marked.where(~is_hot).drop("_heavy").join(right, key, how).unionByName(hot)
