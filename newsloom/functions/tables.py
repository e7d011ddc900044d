"""Tables: reading them, and ending a lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Spark's own switch: shuffle files go as soon as the write that needed them is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows and bytes of an Arrow batch: Spark's default of 10,000 whole pages or feeds takes several times their size in a task.
ARROW_ROWS, ARROW_BYTES = 1_000, 8_000_000


def with_small_batches(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query (spark, ...) that hands pages or feeds to Python in small Arrow batches; a session's own setting stays."""

    @wraps(query)
    def run(spark: SparkSession, *args):
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
        return query(spark, *args)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without it gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="newsloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = f"{shared_dir(spark)}/newsloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
