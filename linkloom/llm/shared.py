"""Helpers that several training-data operators use."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.runtime import materialize

#: ASCII blanks as the operators' contracts name them.
BLANKS = r"\x20\x09-\x0D"
#: Characters of texts that a task works on at a time.
GROUP_CHARS = 1 << 21


def text_groups(texts: list[str]) -> Iterator[list[int]]:
    """Positions of ``texts`` in groups of about ``GROUP_CHARS`` characters."""
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(i)
        size += len(text)
        if size >= GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others as signs from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def shuffle_width(df: DataFrame) -> int:
    """Partition count for a keyed repartition that feeds a Python stage."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph ``edges(u, v)`` as rows ``(node, component)``.

    The component is the smallest node.  Nodes without an edge to another node get no row.  Each
    round hangs the larger neighbours of a node, then its smaller ones, under its smallest
    neighbour; a long chain folds up in logarithmically many rounds.  Rounds, and the smallest
    neighbours that a hot node's many edges are joined with, are written to the shared folder; the
    driver sees one count and one checksum of a round.  The rounds end when one changes nothing.
    """
    current = materialize(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = _fingerprint(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = (
            both.join(low, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = materialize(large)
        down = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        current = materialize(small)
        after = _fingerprint(current)
        if after == before:
            break
        before = after
    star = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return star.unionByName(roots)
