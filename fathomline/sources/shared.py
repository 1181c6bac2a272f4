"""The folder that driver and executors share, for indexes over tables that queries find again."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from fathomline.sources.log import Files


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where none is set and all runs on this machine."""
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


def fingerprint(rows: DataFrame, *more: object) -> str:
    """Of the files that ``rows`` come from (name, size, time of change) and of anything else that a derived table depends on."""
    files, told = Files(rows.sparkSession), []
    for name in sorted(rows.inputFiles()):
        s = files.system(name).getFileStatus(files.path(name))
        told.append(f"{name}\t{s.getLen()}\t{s.getModificationTime()}")
    return hashlib.sha256("\n".join([*told, *map(repr, more)]).encode()).hexdigest()[:20]


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files behind; without it they stay until the driver's next full collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read again: what is read several times is worked out once, and a lost executor costs no recomputation. The table goes when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files = Files(spark)

    def clear() -> None:
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            files.delete(path)

    atexit.register(clear)
    return spark.read.schema(df.schema).parquet(path)
