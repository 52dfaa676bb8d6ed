"""Shared vocabulary and Binary / TF / TF-IDF document vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.operators.ordering import with_global_index
from linkloom.operators.skew import HOT_ROWS, attach_per_key

METHODS = ("Binary", "TF", "TF-IDF")
CHARS_PER_TASK = 1 << 23  # of the texts whose terms a task counts


def doc_terms(corpus: DataFrame, keys: tuple[str, ...] = ("side", "split", "id")) -> DataFrame:
    """(keys, term, tf).

    The texts are dealt by document id, one shuffle that also evens out long and short files; the
    count per document term then needs no further shuffle.  Tasks grow in number with the text, so
    that the terms one of them counts do not.  ``corpus`` is read twice; pass a written table.
    """
    chars = corpus.agg(F.sum(F.length("txt"))).first()[0] or 0
    width = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / CHARS_PER_TASK))
    placed = corpus.select(*keys, "txt").repartition(width, *[k for k in keys if k != "split"])
    return (
        placed.select(*keys, F.explode(T.tokens(F.col("txt"))).alias("term"))
        .groupBy(*keys, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def term_frequencies(terms: DataFrame) -> DataFrame:
    """(term, web_df, pm_df, df): document frequencies on each side and together."""
    return terms.groupBy("term").agg(
        F.count_if(F.col("side") == "web").alias("web_df"),
        F.count_if(F.col("side") == "pm").alias("pm_df"),
        F.count(F.lit(1)).alias("df"),
    )


def shared_terms(
    terms: DataFrame, n_docs: Column, min_df: int | None = None, max_df: float | None = None
) -> DataFrame:
    """Terms of both sides that are not plain numbers, within the document-frequency limits.

    ``min_df`` counts documents, ``max_df`` is a share of the combined corpus.
    """
    kept = term_frequencies(terms).where(
        (F.col("web_df") > 0) & (F.col("pm_df") > 0) & ~T.is_numeric_term(F.col("term"))
    )
    if min_df is not None:
        kept = kept.where(F.col("df") >= min_df)
    if max_df is not None:
        kept = kept.where(F.col("df") <= F.lit(float(max_df)) * n_docs)
    return kept


def exclusive_terms(terms: DataFrame, side: str) -> DataFrame:
    """Terms seen only on one side."""
    other = "pm_df" if side == "web" else "web_df"
    return term_frequencies(terms).where(F.col(other) == 0).select("term", "df")


def number_terms(vocab: DataFrame) -> DataFrame:
    """Alphabetical ``term_id`` from 0."""
    return with_global_index(vocab, [F.col("term")], "term_id")


def idf(df: Column, n_docs: Column) -> Column:
    """Smoothed inverse document frequency: ln((1 + N) / (1 + df)) + 1."""
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + F.lit(1.0)


def weigh(method: str, tf: Column, df: Column, n_docs: Column) -> Column:
    if method == "Binary":
        return F.lit(1.0)
    if method == "TF":
        return tf.cast("double")
    if method == "TF-IDF":
        return tf * idf(df, n_docs)
    raise ValueError(f"unknown feature method {method!r}; expected one of {METHODS}")


def in_vocabulary(terms: DataFrame, vocab: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Document terms with ``term_id`` and ``df``; terms of very many documents are salted."""
    ids = vocab.select("term", "term_id", "df")
    return attach_per_key(terms, ids, ["term"], "df", F.col("id"), hot_rows=hot_rows).drop("term")


def features(known_terms: DataFrame, method: str, n_docs: Column) -> DataFrame:
    """Long feature matrix (side, split, id, term_id, weight); TF-IDF rows have unit length."""
    weighted = known_terms.select(
        "side", "split", "id", "term_id", weigh(method, F.col("tf"), F.col("df"), n_docs).alias("weight")
    )
    if method != "TF-IDF":
        return weighted
    norms = weighted.groupBy("side", "id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighted.join(norms, ["side", "id"]).select(
        "side", "split", "id", "term_id", (F.col("weight") / F.col("norm")).alias("weight")
    )


def packed_terms(known_terms: DataFrame) -> DataFrame:
    """One row per document, ordered by term id: (side, split, id, v), an entry of v being (term_id, tf, df).

    The row holds one document's distinct terms, so its size is that of a document.
    """
    return known_terms.groupBy("side", "split", "id").agg(F.sort_array(F.collect_list(F.struct("term_id", "tf", "df"))).alias("v"))


def packed_vectors(packed: DataFrame, method: str, n_docs: Column) -> DataFrame:
    """(side, split, id, terms, weights) of packed documents; weights are not scaled to unit length: the cosine does that."""
    weights = F.transform("v", lambda x: weigh(method, x["tf"], x["df"], n_docs))
    return packed.select("side", "split", "id", F.col("v.term_id").alias("terms"), weights.alias("weights"))


def sparse_vectors(known_terms: DataFrame, method: str, n_docs: Column) -> DataFrame:
    """One row per document, ordered by term id: (side, split, id, terms, weights)."""
    return packed_vectors(packed_terms(known_terms), method, n_docs)
