"""Delimited files whose quoted fields hold line ends, read by several tasks per file.

A line end inside quotes belongs to the field, so where a record starts depends on the number of quotes
before it.  Files are read as lines, which Spark splits by byte range; one small table has the parity of
the quotes of each range.  Each range then puts its own records together.  What a range opens and does
not close, and the lines of a later range that close it, are few and are joined by a short grouping.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WHOLE, HEAD, TAIL = 0, 1, 2
_PIECES = "file string, start long, place int, kind int, first boolean, text string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each range, and the lines at its ends that belong to records of more than one range."""
    at, held, place, inside, opened = None, [], 0, False, False
    out: list[tuple] = []

    def close(kind: int) -> None:
        nonlocal held, place
        out.append((*at, place, kind, place == 0 and at[1] == 0, "\n".join(held)))
        held, place = [], place + 1

    for batch in batches:
        for file, start, odd, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, start) != at:
                if held:
                    close(TAIL if opened else HEAD)
                at, held, place, inside = (file, start), [], 0, bool(odd)
                opened = not inside  # whether the record in hand began in this range
            held.append(text)
            inside ^= text.count('"') % 2 == 1
            if not inside:
                close(WHOLE if opened else HEAD)
                opened = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["file", "start", "place", "kind", "first", "text"]).cast(_ARROW)
            out = []
    if held:
        close(TAIL if opened else HEAD)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["file", "start", "place", "kind", "first", "text"]).cast(_ARROW)


_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int32()), ("kind", pa.int32()), ("first", pa.bool_()), ("text", pa.string())])


def records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(file, first, text)``: the records of delimited files, each with its line ends, in no order.

    ``first`` marks the first record of a file.  Lines end in ``\\n`` or ``\\r\\n``; quotes inside a field are doubled.
    """
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.make_valid_utf8("value").alias("text")
    )
    quotes = F.length("text") - F.length(F.replace(F.col("text"), F.lit('"'), F.lit("")))
    ranges = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("own"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd = ranges.select("file", "start", (F.coalesce(F.sum("own").over(before), F.lit(0)) % 2).cast("int").alias("odd"))
    # one row per byte range of 128 MB or so: its size is known from the files, and a range needs its lines in order
    marked = lines.join(F.broadcast(odd), ["file", "start"]).select("file", "start", "odd", "text")
    pieces = marked.mapInArrow(_pieces, _PIECES)
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "first", "text")
    ends = pieces.where(F.col("kind") != WHOLE)
    by_place = Window.partitionBy("file").orderBy("start", "place")
    joined = (
        ends.withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(by_place))
        .groupBy("file", "record")
        .agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("start", "place", "text"))).alias("parts"))
    )
    return whole.unionByName(joined.select("file", "first", F.array_join("parts.text", "\n").alias("text")))


def read(spark: SparkSession, paths: str | Sequence[str], schema: StructType, sep: str = ",", header: bool = True) -> DataFrame:
    """The rows of delimited files with quoted line ends; empty records and, with ``header``, first records are left out."""
    found = records(spark, paths)
    if header:
        found = found.where(~F.col("first"))
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE"}
    row = F.from_csv(F.col("text"), schema.simpleString()[len("struct<") : -1].replace(":", " "), options)
    return found.where(F.col("text") != "").select(row.alias("row")).select("row.*")
