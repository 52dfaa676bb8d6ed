"""Exact duplicates: census, keep-first and flags, without windows over hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.skew import HOT_ROWS, attach_per_key, text_key
from linkloom.runtime import discard, materialize


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add one fixed-width key column; NULLs in keys are equal to each other."""
    return df.withColumn("_key", text_key(*[F.col(k) for k in keys]))


def _groups(keyed: DataFrame, row_id: str) -> DataFrame:
    return keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min(row_id).alias("_first"))


def keep_first(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """The row with the lowest ``row_id`` of each key.

    The winner per key is found by a combining aggregate on a hashed key; rows are then matched on
    their own unique id, so a key that holds a large share of all rows never meets in one task.
    """
    winners = _groups(_keyed(df.select(*keys, row_id), keys), row_id).select(F.col("_first").alias(row_id))
    return df.join(winners, row_id, "left_semi")


def duplicate_census(df: DataFrame, keys: Sequence[str], row_id: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every row of a key that occurs more than once, with the size of its group as ``copies``."""
    keyed = _keyed(df, keys)
    groups = _groups(keyed, row_id).where(F.col("_n") > 1)
    joined = attach_per_key(keyed, groups, ["_key"], "_n", F.col(row_id), hot_rows=hot_rows)
    return joined.withColumnRenamed("_n", "copies").drop("_key", "_first")


def flag_not_first(df: DataFrame, keys: Sequence[str], row_id: str, name: str = "is_repeat", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Flag all but the first row of each key."""
    keyed = _keyed(df, keys)
    joined = attach_per_key(keyed, _groups(keyed, row_id), ["_key"], "_n", F.col(row_id), hot_rows=hot_rows)
    return joined.withColumn(name, F.col(row_id) != F.col("_first")).drop("_key", "_n", "_first")


def group_size(
    df: DataFrame, key: str, row_id: str, name: str, hot_rows: int = HOT_ROWS, counted: DataFrame | None = None
) -> DataFrame:
    """Number of rows sharing ``key``; NULL for a NULL key.

    Only keys of several rows are joined.  ``counted`` is a frame with the same keys that is cheaper to
    count than ``df``.
    """
    source = df if counted is None else counted
    sizes = source.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)
    joined = attach_per_key(df, sizes, [key], name, F.col(row_id), how="left", hot_rows=hot_rows)
    return joined.withColumn(name, F.when(F.col(key).isNotNull(), F.coalesce(name, F.lit(1))))


def with_link_counts(pages: DataFrame, row_id: str = "web_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``pmid_count`` and ``url_count``.

    Both are counted on ``pages`` itself; the article comes last, so that its rows end up together.
    """
    by_url = group_size(pages, "url", row_id, "url_count", hot_rows)
    both = group_size(by_url, "pmid", row_id, "pmid_count", hot_rows, counted=pages)
    return both.select(*pages.columns, "pmid_count", "url_count")


def drop_exact_duplicates(pages: DataFrame, row_id: str = "web_id") -> DataFrame:
    """Keep-first on (content, pmid), then on (title, pmid), then the link counts.

    Rows are chosen and counted on their ids and fixed-width keys; the texts move once, when the
    chosen rows are fetched.
    """
    ids = [row_id, "pmid", "url"]
    keyed = pages.select(*ids, *[text_key(F.col(c), F.col("pmid")).alias(f"_{c}") for c in ("content", "title")])
    kept = materialize(keyed)
    for key in ("_content", "_title"):
        winners = kept.groupBy(key).agg(F.min(row_id).alias(row_id)).select(row_id)
        before, kept = kept, materialize(kept.join(winners, row_id, "left_semi"))
        discard(before)
    counted = with_link_counts(kept.select(*ids), row_id).distinct()
    chosen = counted.select(*[F.col(c).alias(f"_{c}") for c in ids], "pmid_count", "url_count")
    same = (F.col(row_id) == F.col(f"_{row_id}")) & F.col("pmid").eqNullSafe(F.col("_pmid")) & F.col("url").eqNullSafe(F.col("_url"))
    chosen = materialize(chosen)
    discard(kept)
    return pages.join(chosen, same).select(*[F.col(c) for c in pages.columns], "pmid_count", "url_count")


def distinct_profile(pages: DataFrame) -> DataFrame:
    """Distinct urls, texts and articles; NULL counts as one value."""

    def n_distinct(*cols: Column) -> Column:
        return F.count_distinct(text_key(*cols))

    return pages.agg(
        n_distinct(F.col("url")).alias("n_urls"),
        n_distinct(F.col("corpus_text"), F.col("title"), F.col("content")).alias("n_texts"),
        n_distinct(F.col("pmid")).alias("n_pmids"),
    )
