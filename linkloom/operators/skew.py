"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
NULL_SALTS = 4096  # missing keys repeat nothing, so they can be spread widely


def attach_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    size: str,
    spread: Column,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` with ``per_key`` (one row per key, ``size`` = rows of that key).

    A key with more than ``hot_rows`` rows is spread by ``spread`` over so many join partitions that
    each gets about ``hot_rows`` of them, and only its single ``per_key`` row is repeated.  Rows with
    a NULL key, which match nothing, are spread as well.  The list of hot keys is the one broadcast
    here; it has at most total-rows / ``hot_rows`` entries, whatever the distribution.
    """
    hot = per_key.where((F.col(size) > hot_rows) & _all_present(keys)).select(
        *keys, _salts_of(F.col(size), hot_rows).alias("_salts")
    )
    left = rows.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", _salt(spread, _all_present(keys)))
    salts = F.when(F.col(size) > hot_rows, _salts_of(F.col(size), hot_rows)).otherwise(F.lit(1).cast("long"))
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    return left.join(right, [*keys, "_salt"], how).drop("_salt", "_salts")


def _salts_of(size: Column, hot_rows: int) -> Column:
    return F.ceil(size / F.lit(hot_rows)).cast("long")


def _salt(spread: Column, present: Column) -> Column:
    """Number of the join partition of a row: 0 unless its key is hot (``_salts``) or missing."""
    code = F.xxhash64(spread)
    return (
        F.when(~present, F.pmod(code, F.lit(NULL_SALTS)))
        .when(F.col("_salts").isNotNull(), F.pmod(code, F.col("_salts")))
        .otherwise(F.lit(0))
        .cast("long")
    )


def join_on_hot_key(
    rows: DataFrame,
    per_key: DataFrame,
    key: str,
    spread: Column,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join with one row per key when only ``rows`` itself tells which keys are hot.

    Same spreading as ``attach_per_key``; also serves semi and anti joins.  Sizes come from one
    combining count of the key column.
    """
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > hot_rows).select(key, _salts_of(F.col("_n"), hot_rows).alias("_salts"))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", _salt(spread, F.col(key).isNotNull()))
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    right = (
        per_key.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
        .drop("_salts")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt", "_salts")


def _all_present(keys: Sequence[str]) -> Column:
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    return present


def text_key(*cols: Column) -> Column:
    """Fixed-width key of long texts: shuffles move 64 characters instead of whole documents."""
    parts = [F.coalesce(F.sha2(c.cast("string"), 256), F.lit("null")) for c in cols]
    return F.sha2(F.concat_ws("|", *parts), 256)
