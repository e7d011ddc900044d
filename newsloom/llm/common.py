"""What the operators of this package share: tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch: Spark's default of 10,000 whole texts takes several times their size in a task.
ARROW_ROWS, ARROW_BYTES = 2_000, 16_000_000


def with_small_batches(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query or stage (spark, ...) that hands texts to Python in small Arrow batches; a session's own setting stays."""

    @wraps(step)
    def run(spark: SparkSession, *args):
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
        return step(spark, *args)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors can reach.

    Only a local session without that setting gets a folder of its own, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="newsloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


#: Spark's own switch: shuffle files go as soon as the write that needed them is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/newsloom/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str, path: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and lost executors cost nothing.

    What was shuffled for it is no longer needed then, and its files go. A path of the caller's is the caller's to remove.
    """
    if path is None:
        path = new_path(spark, name)
        _scratch.get().append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_scratch: ContextVar[list[str]] = ContextVar("tables to remove", default=[])


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are written within, but for those at a path of the caller's, go at its end."""
    token = _scratch.set([])
    try:
        yield
    finally:
        tables = _scratch.get()
        _scratch.reset(token)
        removed(spark, *tables)


def fresh(name: str) -> str:
    """A column name that no table of a user has."""
    return f"{name}_{uuid.uuid4().hex}"


#: Up to so many rows of keys are broadcast; beyond that both sides of the join are shuffled.
BROADCAST_KEYS = 500_000


def sized(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """A written table of keys with the hint that its size allows."""
    return F.broadcast(keys) if keys.count() <= limit else keys.hint("shuffle_hash")


def id_fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def is_held_out(id_column: str, modulus: int) -> Column:
    """Fold 2 of `modulus` is held out; a row without an id is held out as well, for nothing may be learned from it."""
    return F.coalesce(id_fold(id_column, modulus) == 2, F.lit(True))
