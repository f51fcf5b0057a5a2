"""Parquet files, with their own types."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from assayer.errors import SourceError
from assayer.sources.base import Source


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> Source:
    """The named columns that the file has; file order by file and piece of it."""
    try:
        frame = spark.read.parquet(path)
    except Exception as e:
        raise SourceError(f"can't read {path}: {str(e).splitlines()[0]}") from e
    wanted = [n for n in frame.columns if columns is None or n in columns]
    place = [F.col("_metadata.file_path").alias("_assayer_file"), F.col("_metadata.file_block_start").alias("_assayer_block")]
    columns = [F.col(f"`{n}`") for n in wanted]
    return Source(frame.select(*columns), False, frame.select(*columns, *place), [F.col("_assayer_file"), F.col("_assayer_block")])
