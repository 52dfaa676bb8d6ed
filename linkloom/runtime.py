"""Cutting lineage on reliable storage.

Iterative jobs and tables that several jobs read are written once to the shared folder that the
cluster names in ``spark.checkpoint.dir``.  Nothing is kept only in executor memory, so a lost
executor costs a re-read and not a wrong or failed result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The reliable folder of this session; a temporary one only for local sessions without one."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    active = context.getCheckpointDir()
    if active:
        return active
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="linkloom-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed once.

    A filter on a computed column is normally pushed below its projection as a copy of the whole
    expression, and a chain of text columns then splits the same text many times.  Filters are not
    pushed through a generator, so a one-element ``inline`` keeps them above the work.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: keeps the partitioning and the row order inside each partition."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


_written: dict[str, list[str]] = {}  # by application, so one session never deletes another's tables


def release(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` wrote in this session, once their results are stored.

    Returns how many were deleted.  Frames that still read them stop working.
    """
    return _delete(spark, _written.pop(spark.sparkContext.applicationId, []))


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += path.getFileSystem(conf).delete(path, True)
    return n


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``materialize`` writes inside are deleted at the end, but for those that are kept.

    The function that comes with it marks a frame, as ``materialize`` returned it, to be kept.
    """
    own = _written.setdefault(spark.sparkContext.applicationId, [])
    before, kept = set(own), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._table_path)
        return df

    try:
        yield keep
    finally:
        gone = [path for path in own if path not in before and path not in kept]
        own[:] = [path for path in own if path in before or path in kept]
        _delete(spark, gone)


@contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    """A path in the shared folder for a table that grows; it is deleted at the end."""
    path = f"{checkpoint_root(spark)}/folder-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        _delete(spark, [path])


def discard(*tables: DataFrame) -> None:
    """Delete tables, as ``materialize`` returned them, that nothing reads any more."""
    for df in tables:
        own = _written.get(df.sparkSession.sparkContext.applicationId, [])
        if df._table_path in own:
            own.remove(df._table_path)
            _delete(df.sparkSession, [df._table_path])


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and scan it back.

    Preferred over ``cut`` for tables read more than once: later readers get column pruning and
    pushed filters.  The shuffle files of the write are deleted with its end.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _without_shuffle_files(spark):
        writer.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._table_path = path
    return table
