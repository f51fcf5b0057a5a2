"""How large the pieces of a file should be that tasks read.

Spark cuts files itself by ``spark.sql.files.maxPartitionBytes``; this gives a value
for it that keeps every core busy with several pieces, none of them tiny or huge.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

MB = 1 << 20
SETTING = "spark.sql.files.maxPartitionBytes"


@dataclass(frozen=True)
class SplitSize:
    least: int = MB
    most: int = 100 * MB
    per_core: int = 5

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.most or self.per_core < 1:
            raise ValueError("sizes must be positive and the least at most the most")

    def bytes_for(self, file_bytes: int, cores: int) -> int:
        """Bytes a piece for a file read by so many cores."""
        return min(self.most, max(self.least, file_bytes // max(1, cores * self.per_core)))


def bytes_at(spark: SparkSession, path: str) -> int:
    """Size of a file or folder in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


@contextmanager
def cut_by(spark: SparkSession, path: str, size: SplitSize | None) -> Iterator[None]:
    """Reads that are planned inside take pieces of that size; without one Spark's setting holds."""
    if size is None:
        yield
        return
    before = spark.conf.get(SETTING)
    spark.conf.set(SETTING, str(size.bytes_for(bytes_at(spark, path), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(SETTING, before)
