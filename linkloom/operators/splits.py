"""Train / test tags of links and of both corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.ordering import tag_exact_fraction


def split_links(links: DataFrame, fraction: float = 0.7, seed: int = 42) -> DataFrame:
    """(web_id, pmid, train_test) with an exact, reproducible number of train links."""
    return tag_exact_fraction(links.select("web_id", "pmid"), ["web_id", "pmid"], fraction, seed)


def write_tags(links: DataFrame, tagged: DataFrame) -> DataFrame:
    """``links`` with ``train_test`` taken from ``tagged``; links that were not split keep NULL."""
    tags = tagged.select("web_id", "pmid", "train_test")
    return links.drop("train_test").join(tags, ["web_id", "pmid"], "left").select(*links.columns)


def split_corpus(corpus: DataFrame, tagged: DataFrame) -> DataFrame:
    """Add ``split``: documents of a train link are Train, all others Test.

    Articles without any link therefore belong to the test set.
    """
    train = tagged.where(F.col("train_test") == "Train")
    ends = train.select(
        F.inline(
            F.array(
                F.struct(F.lit("web").alias("side"), F.col("web_id").alias("id")),
                F.struct(F.lit("pm").alias("side"), F.col("pmid").alias("id")),
            )
        )
    ).distinct()
    return corpus.join(ends.withColumn("_train", F.lit(True)), ["side", "id"], "left").select(
        "side", F.when(F.col("_train"), "Train").otherwise("Test").alias("split"), "id", "txt"
    )


def corpus_lengths(split: DataFrame) -> DataFrame:
    return split.groupBy("side", "split").agg(F.count(F.lit(1)).alias("n_docs"))


def part(vectors: DataFrame, side: str, split: str) -> DataFrame:
    """One of the four side x split parts, selected by value and not by row position."""
    return vectors.where((F.col("side") == side) & (F.col("split") == split))
