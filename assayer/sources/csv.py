"""CSV files, read as text and cast by the rules.

The header gives the names, trimmed; values keep their blanks.  A row with too
many or too few fields fails the read, which needs every field parsed: column
pruning in the parser is off for this read.  Quoted line breaks need
``multi_line``, which gives up splitting a file.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.errors import SourceError
from assayer.sources.base import Source


def header(spark: SparkSession, path: str) -> list[str]:
    """Names in the first line of the file, or of the first file of a folder."""
    try:
        first = spark.read.option("wholetext", False).text(path).select("value").limit(1).collect()
    except Exception as e:
        raise SourceError(f"can't read {path}: {str(e).splitlines()[0]}") from e
    if not first or not first[0].value:
        raise SourceError(f"{path} is empty")
    return [n.strip() for n in next(csv.reader([first[0].value.lstrip("﻿")]))]


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = False) -> Source:
    """The named columns that the file has, in file order; all of them by default."""
    names = header(spark, path)
    frame: DataFrame = (
        spark.read.schema(text_schema(names)).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").option("multiLine", multi_line).option("columnPruning", False).csv(path)
    )
    wanted = [n for n in names if columns is None or n in columns]
    place = [F.col("_metadata.file_path").alias("_assayer_file"), F.col("_metadata.file_block_start").alias("_assayer_block")]
    columns = [F.col(f"`{n}`") for n in dict.fromkeys(wanted)]
    return Source(frame.select(*columns), True, frame.select(*columns, *place), [F.col("_assayer_file"), F.col("_assayer_block")])
