"""Gives executors this package, and a folder that they share with the driver."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows of a batch that Spark hands to Python: Spark's default fits numbers, not long texts, whose batches lie in memory on both sides.
BATCH, BATCH_ROWS, DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000", "10000"


def ship(spark: SparkSession) -> None:
    """The package through Spark's own file server, once a context; and smaller batches unless the session sets their size."""
    context = spark.sparkContext
    if spark.conf.get(BATCH) == DEFAULT_ROWS:
        spark.conf.set(BATCH, BATCH_ROWS)
    if getattr(context, "_assayer_shipped", False):
        return
    top = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="assayer-"), "assayer.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(archive)
    context._assayer_shipped = True


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder under the one that the cluster names in ``spark.checkpoint.dir``.

    Without one, a session on one machine gets a temporary folder; on a cluster,
    where executors could not see it, that is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = Path(tempfile.mkdtemp(prefix="assayer-work-")).as_uri()
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
