"""What was requested, what arrived and what to request again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flag_downloaded(requested: DataFrame, landed: DataFrame, key: str = "pmid") -> DataFrame:
    """Requested ids with ``downloaded``: whether the id is among the landed records."""
    there = landed.select(key).distinct().withColumn("_there", F.lit(True))
    return requested.join(there, key, "left").select(
        *requested.columns, F.coalesce("_there", F.lit(False)).alias("downloaded")
    )


def to_retry(requested: DataFrame, landed: DataFrame, key: str = "pmid") -> DataFrame:
    return requested.select(key).join(landed.select(key), key, "left_anti")


def append_retried(landed: DataFrame, retried: DataFrame) -> DataFrame:
    return landed.unionByName(retried)
