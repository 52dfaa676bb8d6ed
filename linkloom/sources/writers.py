"""Sinks: tables, CSV, partitioned matrices and per-experiment results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATRIX_PARTITIONS = ("feature", "reduction", "tsvd", "cca_k", "side", "split")


def replace_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def append_table(df: DataFrame, name: str) -> None:
    df.write.mode("append").saveAsTable(name)


def jdbc(df: DataFrame, name: str, options: Mapping[str, str], mode: str = "overwrite") -> None:
    df.write.format("jdbc").options(**options).option("dbtable", name).mode(mode).save()


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header and doubled quotes; ``append`` adds files to the same directory."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def matrix(df: DataFrame, path: str, mode: str = "append") -> None:
    """A matrix part; its parameters are partition columns, so parts never overwrite each other."""
    by = [c for c in MATRIX_PARTITIONS if c in df.columns]
    parquet(df, path, mode, by)


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _paths(spark: SparkSession, path: str):
    fs, target = _files(spark, path)
    beside = [spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{name}") for name in ("staged", "previous")]
    return fs, target, *beside


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a ``replace`` that was cut off; does nothing otherwise."""
    fs, target, staged, previous = _paths(spark, path)
    if fs.exists(previous):
        if fs.exists(target):  # the new rows are in place, only the old ones were not yet removed
            fs.delete(previous, True)
        else:
            fs.rename(previous, target)
    fs.delete(staged, True)


def replace(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the parquet folder ``path`` by ``df``, which may read it.

    The rows are written beside it and swapped in by two renames once they are complete.  A run that
    is cut off leaves the old rows or the new ones, never a part; the next ``replace`` or ``recover``
    tidies up.
    """
    spark = df.sparkSession
    recover(spark, path)
    fs, target, staged, previous = _paths(spark, path)
    parquet(df, str(staged), "errorifexists", partition_by)
    if fs.exists(target):
        fs.rename(target, previous)
    fs.rename(staged, target)
    fs.delete(previous, True)


def append_once(df: DataFrame, path: str, batch: str, key: str = "batch") -> None:
    """Append the rows of one ``batch`` to the parquet folder ``path``; a rerun replaces them.

    The batch is a partition column ``key``, and only its own partition is overwritten, so writing a
    batch twice, or again after a crash, adds nothing.
    """
    if key in df.columns:
        raise ValueError(f"column {key!r} is the batch's own")
    rows = df.withColumn(key, F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
