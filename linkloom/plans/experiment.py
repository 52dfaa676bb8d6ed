"""The link-retrieval experiment: corpora and links in, ranks and measures out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators import evaluate, features, scoring, splits
from linkloom.runtime import materialize


@dataclass(frozen=True)
class Prepared:
    """Tables shared by all experiments on one pair of corpora."""

    corpus: DataFrame
    tagged: DataFrame
    terms: DataFrame
    n_docs: Column

    @property
    def test_links(self) -> DataFrame:
        return self.tagged.where(F.col("train_test") == "Test").select("web_id", "pmid")

    @property
    def train_links(self) -> DataFrame:
        return self.tagged.where(F.col("train_test") == "Train").select("web_id", "pmid")


def prepare(corpus: DataFrame, links: DataFrame, fraction: float = 0.7, seed: int = 42) -> Prepared:
    """Split once, tokenise once; later experiments scan the written tables."""
    tagged = materialize(splits.split_links(materialize(links.select("web_id", "pmid")), fraction, seed))
    tagged_corpus = materialize(splits.split_corpus(corpus, tagged))
    terms = materialize(features.doc_terms(tagged_corpus))
    n_docs = F.lit(tagged_corpus.count())
    return Prepared(tagged_corpus, tagged, terms, n_docs)


def known_terms(prepared: Prepared, min_df: int | None = None, max_df: float | None = None, split: str | None = None) -> DataFrame:
    """Document terms inside the shared vocabulary, written once for all weightings.

    The vocabulary is that of all documents; with ``split`` only the terms of its documents are returned.
    """
    vocab = features.number_terms(
        features.shared_terms(prepared.terms, prepared.n_docs, min_df, max_df).select("term", "df")
    )
    terms = prepared.terms if split is None else prepared.terms.where(F.col("split") == split)
    return materialize(features.in_vocabulary(terms, vocab))


def packed_test(prepared: Prepared, min_df: int | None = None, max_df: float | None = None) -> DataFrame:
    """The test documents over the shared vocabulary, packed and written once for all weightings."""
    return materialize(features.packed_terms(known_terms(prepared, min_df, max_df, "Test")))


def sparse_ranks(prepared: Prepared, known: DataFrame, method: str) -> DataFrame:
    """Ranks of the test links among the test articles under one weighting.

    Documents without any vocabulary term have no vector: their score is 0, which never exceeds the
    score of a link, because weights are not negative.
    """
    return packed_ranks(prepared, features.packed_terms(known.where(F.col("split") == "Test")), method)


def packed_ranks(prepared: Prepared, packed: DataFrame, method: str) -> DataFrame:
    """As ``sparse_ranks``, of test documents that are packed already."""
    vectors = materialize(features.packed_vectors(packed, method, prepared.n_docs))
    return scoring.rank_links(prepared.test_links, vectors)


def flagship(corpus: DataFrame, links: DataFrame, method: str = "TF-IDF") -> DataFrame:
    """One row: link quality of one weighting over the full shared vocabulary."""
    prepared = prepare(corpus, links)
    return evaluate.measures(sparse_ranks(prepared, known_terms(prepared, split="Test"), method))
