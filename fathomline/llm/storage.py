"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


#: Spark drops a query's shuffle files when the query is done; without it they stay until the driver's next full collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCRATCH: contextvars.ContextVar[list | None] = contextvars.ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. A folder of our own only where none is set and all runs on this machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir() if hasattr(context, "getCheckpointDir") else None
    if not current:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="fathomline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
        current = context.getCheckpointDir()
    return current.rstrip("/")


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """Queries run inside leave no shuffle files behind."""
    return _setting(spark, CLEANUP, "true")


def batches_of(spark: SparkSession, rows: int):
    """Queries run inside hand ``rows`` rows to Python at once."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables staged inside are deleted at the end, but for those that ``keep`` was given."""
    held: list = []
    token = _SCRATCH.set(held)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        discard(*held)


def keep(staged: DataFrame) -> DataFrame:
    """Leave ``staged`` when the scratch it belongs to ends."""
    held = _SCRATCH.get()
    if held is not None:
        held[:] = [df for df in held if df is not staged]
    return staged


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table: lineage is cut, a lost executor costs no recomputation.

    zstd is for tables of whole texts; its writers hold much memory outside the heap, which adds up over many small files."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with shuffles_dropped(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if (held := _SCRATCH.get()) is not None:
        held.append(out)
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in staged:
        if path := getattr(df, "_staged_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
