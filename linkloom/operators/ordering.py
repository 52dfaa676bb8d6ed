"""Global numbering, batching and exact sampling without a single-partition window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.runtime import cut

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits
_EDGE_ROWS = 1_000_000  # rows that one task sorts when an exact sample is cut


def with_global_index(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number the rows 0, 1, 2, ... in ``order``.

    Range-partitioned sort, reliable checkpoint, then row-in-partition plus the offset of the
    partition.  The offsets are one row per partition, so their window and broadcast are bounded by
    the partition count and not by the data.
    """
    placed = cut(df.orderBy(*order)).withColumn("_pos", F.monotonically_increasing_id())
    part = F.shiftright("_pos", _ROW_BITS)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_part",
            (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias(
                "_offset"
            ),
        )
    )
    row_in_part = F.col("_pos").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, row_in_part + F.col("_offset"))
        .drop("_pos", "_part", "_offset")
    )


def factorize(df: DataFrame, key: str, row_id: str, name: str, hot_rows: int | None = None) -> DataFrame:
    """Dense ids of ``key`` by first appearance in ``row_id`` order."""
    from linkloom.operators.skew import HOT_ROWS, attach_per_key

    firsts = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(row_id).alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    coded = with_global_index(firsts, [F.col("_first")], name)
    joined = attach_per_key(
        df, coded, [key], "_n", F.col(row_id), how="left", hot_rows=hot_rows or HOT_ROWS
    )
    return joined.drop("_first", "_n")


def request_batches(ids: DataFrame, id_col: str, size: int = 100) -> DataFrame:
    """Cut an ordered id list into batches of ``size``: one row per batch with its id list."""
    indexed = with_global_index(ids.select(id_col), [F.col(id_col).asc_nulls_last()], "_i")
    return (
        indexed.groupBy(F.floor(F.col("_i") / F.lit(size)).cast("long").alias("batch"))
        .agg(F.sort_array(F.collect_list(id_col)).alias("ids"))
        .withColumn("n_ids", F.size("ids").cast("long"))
    )


def seeded_hash(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def tag_exact_fraction(
    df: DataFrame,
    ids: Sequence[str],
    fraction: float = 0.7,
    seed: int = 42,
    tag: str = "train_test",
    inside: str = "Train",
    outside: str = "Test",
) -> DataFrame:
    """Tag exactly ``bround(fraction * n)`` rows as ``inside``, chosen by seeded hash order.

    The first hash characters split the rows into buckets, more of them the more rows there are.
    Running bucket counts locate the one bucket in which the boundary falls; only its rows are
    sorted.  The rest are decided by their bucket alone, so no global sort, no driver-side list and
    no random split.
    """
    prefix = max(3, math.ceil(math.log(max(1, df.count()) / _EDGE_ROWS, 16)))
    hashed = df.withColumn("_h", seeded_hash(seed, *ids)).withColumn("_b", F.substring("_h", 1, prefix))
    counts = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    quota = F.bround(F.lit(fraction) * F.sum("_n").over(whole), 0).cast("long")
    cuts = counts.select(
        "_b", (quota - (F.sum("_n").over(running) - F.col("_n"))).alias("_room"), "_n"
    ).select(
        "_b",
        F.when(F.col("_room") >= F.col("_n"), F.lit("in"))
        .when(F.col("_room") <= 0, F.lit("out"))
        .otherwise(F.lit("edge"))
        .alias("_side"),
        "_room",
    )
    placed = hashed.join(F.broadcast(cuts), "_b")
    decided = placed.where(F.col("_side") != "edge").withColumn(
        tag, F.when(F.col("_side") == "in", F.lit(inside)).otherwise(F.lit(outside))
    )
    edge_order = Window.partitionBy("_b").orderBy("_h", *ids)
    edge = (
        placed.where(F.col("_side") == "edge")
        .withColumn("_rn", F.row_number().over(edge_order))
        .withColumn(tag, F.when(F.col("_rn") <= F.col("_room"), F.lit(inside)).otherwise(F.lit(outside)))
        .drop("_rn")
    )
    return decided.unionByName(edge).drop("_h", "_b", "_side", "_room")


def running_total(
    df: DataFrame, within: Sequence[str], position: str, value: str, name: str, width: int = 100_000
) -> DataFrame:
    """Running sum of ``value`` by the integer ``position``, in two levels.

    Positions are cut into strips of ``width``; strip totals are summed first, then each strip is
    scanned on its own, so a task holds at most one strip.  One row per position is assumed.
    """
    strip = F.floor(F.col(position) / F.lit(width)).cast("long")
    keyed = df.withColumn("_strip", strip)
    totals = keyed.groupBy(*within, "_strip").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*within).orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*within, "_strip", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inner = (
        Window.partitionBy(*within, "_strip").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        keyed.join(offsets, [*within, "_strip"])
        .withColumn(name, F.col("_off") + F.sum(value).over(inner))
        .drop("_strip", "_off")
    )
