"""What Python workers hold, and tables that are read more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What Python workers are started with: buffers of a batch go back to the system at its end, else each worker keeps its largest.
WORKER_ENV = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "131072", "MALLOC_TRIM_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows of a batch that goes to a Python worker, unless the session has its own number: whole texts are long.
BATCH_ROWS = 256


def bounded(spark: SparkSession) -> SparkSession:
    """Bounds what Python workers hold: batches of few rows, so that their memory does not follow the size of a partition."""
    for name, value in WORKER_ENV.items():
        spark.sparkContext.environment.setdefault(name, value)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir.

    On one machine that names no folder, as in tests, it is a temporary one; a cluster must name one that all share.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lorespark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df below spark.checkpoint.dir and reads it again, so that what reads it more than once does not make it anew."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
