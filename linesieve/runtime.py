"""Session services: the shared folder for checkpoints, scratch tables and kept tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Drops the shuffle files of an SQL execution as soon as it is over (Spark 4.1; unknown to older versions).
_EARLY_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The application's own folder below the one named by ``spark.checkpoint.dir``; it is removed when the application ends.

    Where that is unset, a temporary folder serves a local master, as in tests; on a cluster this raises,
    since executors share no machine's folders.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="linesieve-")
        context.setCheckpointDir(folder)
        remove_at_exit(spark, context.getCheckpointDir())
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the application's folder, removed with it."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and forget the lineage; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like :func:`cut`, but as a table of columns, smaller than a checkpoint; also gives its folder, for :func:`remove`."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def early_cleanup(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside leave no shuffle files behind; for steps whose results are all written out."""
    before = spark.conf.get(_EARLY_CLEANUP, None) if spark.version >= "4.1" else None
    spark.conf.set(_EARLY_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_EARLY_CLEANUP)
        else:
            spark.conf.set(_EARLY_CLEANUP, before)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, in order; none if it isn't there."""
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def touch(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.create(p, True).close()


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = _path(spark, path)
        fs.delete(p, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
