"""What a block of links and articles costs and counts, and which documents are packed for ranking."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.operators import features, scoring
from linkloom.plans import experiment


def entries(seed, n, copies=1):
    """``n`` vectors over two sets of 300 terms, of which each takes one, and their lists."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        terms = np.unique(300 * (i % 2) + np.minimum(rng.geometric(0.03, 40), 299))
        rows.append((terms, rng.integers(1, 9, len(terms)).astype(float)))
    rows = [rows[i // copies] for i in range(n)]
    return rows, [pa.array([r[c] for r in rows]) for c in (0, 1)]


def matrix(rows):
    out = np.zeros((len(rows), 600))
    for i, (t, w) in enumerate(rows):
        out[i, t] = w / np.linalg.norm(w)
    return out


@pytest.mark.parametrize("copies", [1, 40])
@pytest.mark.parametrize("signed", [False, True])
@pytest.mark.parametrize("single", [True, False])
def test_counts_in_single_precision_are_exact(monkeypatch, single, signed, copies):
    doubles, whole = [], scoring._block_scores
    monkeypatch.setattr(scoring, "_block_scores", lambda *x: doubles.append(x) or whole(*x))
    monkeypatch.setattr(scoring, "_OPEN_SHARE", 1.0 if single else -1.0)
    pages, lists = entries(1, 120)
    articles, others = entries(1, 240, copies)
    if signed:
        pages[0][1][0] *= -1
        lists[1] = pa.array([r[1] for r in pages])
    scores = np.round(matrix(articles) @ matrix(pages).T, scoring.DECIMALS)
    cos = scores[np.arange(120), np.arange(120)]
    part = pa.table({"web_id": np.arange(120), "pmid": np.arange(120), "cos": cos, "terms": lists[0], "weights": lists[1]})
    batches = pa.table(others, ["terms", "weights"]).to_batches(100)
    got = pa.Table.from_batches(list(scoring._count_above(*scoring._grouped(part))(iter(batches)))).to_pydict()
    assert sorted(got["web_id"]) == list(range(120))
    assert [a for _, a in sorted(zip(got["web_id"], got["above"]))] == (scores > cos).sum(axis=0).tolist()
    assert bool(doubles) != single


def test_pages_of_few_shared_words_fall_into_different_groups():
    pages, lists = entries(2, 120)
    part = pa.table({"web_id": np.arange(120), "pmid": np.arange(120), "cos": np.zeros(120), "terms": lists[0], "weights": lists[1]})
    links, ids = scoring._grouped(part)
    place = np.array(ids.column("web_id"))
    for lo, hi in zip(links.bounds, links.bounds[1:]):
        assert len(np.unique(place[lo:hi] % 2)) <= 1


def test_only_test_documents_are_joined_with_the_vocabulary(spark):
    corpus = [(s, i, f"common word{i % 3} {s}{i}") for s in ("web", "pm") for i in range(20)]
    prepared = experiment.prepare(
        spark.createDataFrame(corpus, "side string, id long, txt string"),
        spark.createDataFrame([(i, i) for i in range(20)], "web_id long, pmid long"),
    )
    every, test = experiment.known_terms(prepared), experiment.known_terms(prepared, split="Test")
    assert 0 < test.count() < every.count()
    assert sorted(test.collect()) == sorted(every.where(F.col("split") == "Test").collect())
    packed = experiment.packed_test(prepared)
    for method in features.METHODS:
        one = experiment.packed_ranks(prepared, packed, method).collect()
        assert sorted(one) == sorted(experiment.sparse_ranks(prepared, every, method).collect()) and len(one) == 6
