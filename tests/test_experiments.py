import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.operators import cca, evaluate, features, scoring, splits, svd
from linkloom.plans import catalog, experiment, grid
from linkloom.plans import standins as S
from linkloom.runtime import materialize

CORPUS = [
    ("web", 1, "apple banana cherry 2019"),
    ("web", 2, "banana banana dog only_web"),
    ("web", 3, "solo word"),
    ("pm", 1, "apple banana apple 2019"),
    ("pm", 2, "dog dog banana"),
    ("pm", 9, "cherry dog only_pm"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "side string, id long, txt string").withColumn("split", F.lit("Test"))


@pytest.fixture(scope="module")
def known(spark, corpus):
    terms = features.doc_terms(corpus)
    vocab = features.number_terms(features.shared_terms(terms, F.lit(6)))
    return materialize(features.in_vocabulary(terms, vocab))


def test_vocabulary(spark, corpus):
    terms = features.doc_terms(corpus)
    vocab = features.number_terms(features.shared_terms(terms, F.lit(6)))
    got = [(r["term_id"], r["term"], r["df"]) for r in vocab.orderBy("term_id").collect()]
    assert got == [(0, "apple", 2), (1, "banana", 4), (2, "cherry", 2), (3, "dog", 3)]
    limited = features.shared_terms(terms, F.lit(6), 3, 0.6).collect()
    assert {r["term"] for r in limited} == {"dog"}
    assert {r["term"] for r in features.exclusive_terms(terms, "web").collect()} == {"only_web", "solo", "word"}


def test_idf_values(spark):
    df = spark.createDataFrame([(3.0,), (1.0,)], "df double").select(features.idf(F.col("df"), F.lit(3.0)))
    assert [round(r[0], 6) for r in df.collect()] == [1.0, 1.693147]


def test_salted_vocabulary_join_is_the_same(spark, corpus):
    terms = features.doc_terms(corpus)
    vocab = features.number_terms(features.shared_terms(terms, F.lit(6)))
    plain = {tuple(r) for r in features.in_vocabulary(terms, vocab).select("side", "id", "term_id", "tf").collect()}
    hot = {tuple(r) for r in features.in_vocabulary(terms, vocab, 1).select("side", "id", "term_id", "tf").collect()}
    assert plain == hot and len(plain) == 11


def test_weights(spark, known):
    def rows(method):
        m = features.features(known, method, F.lit(6)).where("side = 'web' and id = 2").orderBy("term_id")
        return [r["weight"] for r in m.collect()]

    assert rows("Binary") == [1.0, 1.0] and rows("TF") == [2.0, 1.0]
    raw = [2 * (math.log(7 / 5) + 1), math.log(7 / 4) + 1]
    assert rows("TF-IDF") == pytest.approx([x / math.hypot(*raw) for x in raw])
    with pytest.raises(ValueError):
        features.features(known, "BM25", F.lit(6))


def test_ranks_count_ties_and_zero_vectors(spark, known):
    vectors = materialize(features.sparse_vectors(known, "TF", F.lit(6)))
    links = spark.createDataFrame([(1, 1), (2, 2), (3, 9), (1, 9)], "web_id long, pmid long")
    got = {(r["web_id"], r["pmid"]): (r["cos"], r["rank"]) for r in scoring.rank_links(links, vectors).collect()}
    assert got[(1, 1)] == (round(3 / math.sqrt(15), 9), 1)
    assert got[(3, 9)] == (0.0, 1)
    assert got[(2, 2)][1] == 1 and got[(1, 9)][1] == 2


@pytest.mark.parametrize("seed", range(3))
def test_counted_ranks_equal_window_rank(spark, seed, monkeypatch):
    monkeypatch.setattr(scoring, "SLICE_ENTRIES", 20)
    rng = np.random.default_rng(seed)
    rows = []
    for side, n in (("web", 15), ("pm", 40)):
        for i in range(n):
            terms = np.sort(rng.choice(30, rng.integers(0, 9), replace=False))
            rows.append((side, "Test", i, [int(t) for t in terms], [float(w) for w in rng.integers(1, 4, len(terms))]))
    schema = "side string, split string, id long, terms array<long>, weights array<double>"
    vectors = materialize(spark.createDataFrame(rows, schema))
    links = spark.createDataFrame([(i, (i * 7) % 40) for i in range(15)], "web_id long, pmid long")
    got = {(r["web_id"], r["pmid"]): r["rank"] for r in scoring.rank_links(links, vectors).collect()}
    dense = {(s, i): np.zeros(30) for s, _, i, _, _ in rows}
    for s, _, i, t, w in rows:
        dense[(s, i)][t] = w
    cells = []
    for w in range(15):
        for p in range(40):
            a, b = dense[("web", w)], dense[("pm", p)]
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            cells.append((w, p, round(float(a @ b / norm), 9) if norm else 0.0))
    cosines = spark.createDataFrame(cells, "web_id long, pmid long, cos double")
    window = Window.partitionBy("web_id").orderBy(F.desc("cos"))
    expected = cosines.withColumn("rank", F.rank().over(window)).join(links, ["web_id", "pmid"]).collect()
    assert got == {(r["web_id"], r["pmid"]): r["rank"] for r in expected}


def test_block_scores_use_both_paths():
    rng = np.random.default_rng(0)
    a, b = rng.random((50, 400)) * (rng.random((50, 400)) < 0.03), rng.random((20, 400)) * (rng.random((20, 400)) < 0.03)
    a[:, 0], b[:, 0] = 1.0, 1.0

    def entries(m):
        row, col = np.nonzero(m)
        return row, col, m[row, col]

    got = np.vstack(list(scoring._block_scores(entries(b), entries(a), 20, 50)))
    assert np.allclose(got, a @ b.T)


def test_measures_and_recall(spark):
    ranks = spark.createDataFrame([(r,) for r in (1, 2, 10, 50)], "rank long")
    m = evaluate.measures(ranks).first()
    assert (m["iqr25"], m["median"], m["iqr75"], m["pct1"], m["pct50"], m["pct250"]) == (1.75, 6.0, 20.0, 25.0, 100.0, 100.0)
    curve = evaluate.recall_at_n(spark.createDataFrame([(r,) for r in (1, 1, 3, 7)], "rank long"))
    assert {r["rank"]: r["recall"] for r in curve.collect()} == {1: 0.5, 3: 0.75, 7: 1.0}
    both = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "m string, rank long")
    got = {(r["m"], r["rank"]): r["recall"] for r in evaluate.recall_at_n(both, ("m",)).collect()}
    assert got == {("a", 1): 0.5, ("a", 2): 1.0, ("b", 5): 1.0}
    assert evaluate.marker_size(spark.createDataFrame([(10.0,)], "median double")).first()["marker_size"] == 30000.0


def test_split_is_consistent(spark, sf):
    links, corpus = S.links(spark, sf), S.corpus(spark, sf)
    tagged = materialize(splits.split_links(links))
    n = links.count()
    train = tagged.where("train_test = 'Train'")
    assert tagged.count() == n and train.count() == round(0.7 * n)
    lengths = {(r["side"], r["split"]): r["n_docs"] for r in splits.corpus_lengths(splits.split_corpus(corpus, tagged)).collect()}
    assert lengths[("web", "Train")] == lengths[("pm", "Train")] == train.count()
    assert lengths[("pm", "Test")] > lengths[("web", "Test")]
    parts = splits.part(splits.split_corpus(corpus, tagged), "web", "Test")
    assert parts.count() == lengths[("web", "Test")]


def test_grids(spark):
    plain = grid.experiment_grid(spark, ["Binary", "TF", "TF-IDF"], [2], [0.85], [100, 200, 400, 600, 800, 1600])
    assert plain.count() == 21 and plain.columns == list(grid.PARAMETERS)
    with_cca = grid.experiment_grid(spark, ["TF-IDF"], [2], [1.0], [100, 200], [50, 100, 200]).collect()
    assert sorted((r["tsvd"], r["cca_k"]) for r in with_cca) == [(100, 50), (100, 100), (200, 50), (200, 100), (200, 200)]
    two = grid.experiment_grid(spark, ["TF", "Binary"], [2, 5], [0.85, 0.5], [100])
    assert two.count() == 6
    with pytest.raises(ValueError):
        grid.experiment_grid(spark, ["TF"], [2, 3], [0.85], [])
    ordered = plain.withColumn("i", F.xxhash64(F.concat_ws("-", "feature", "reduction", "tsvd")))
    order = plain.withColumn("i", F.concat_ws("-", "feature", "reduction", F.lpad(F.col("tsvd").cast("string"), 5, "0")))
    flags = grid.reuse_flags(order, "i")
    assert flags.where("same_features").count() == 15 and ordered.count() == 21


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(4)
    dense = rng.random((60, 25)) * (rng.random((60, 25)) < 0.4)
    cells = [(int(i), int(j)) for i, j in zip(*np.nonzero(dense))]
    rows = [("web" if i < 20 else "pm", "Test", i, j, float(dense[i, j])) for i, j in cells]
    matrix = materialize(spark.createDataFrame(rows, "side string, split string, id long, term_id long, weight double"))
    model = svd.by_sweeps(matrix, 4, tolerance=1e-10)
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    assert model.singular_values == pytest.approx(s[:4], abs=1e-8)
    corpus = spark.createDataFrame([("pm", "Test", 99)], "side string, split string, id long").unionByName(
        model.projected.select("side", "split", "id")
    )
    everyone = {r["id"]: r["vec"] for r in svd.all_documents(model, corpus, 3).collect()}
    assert everyone[99] == [0.0, 0.0, 0.0]
    ids = sorted(i for i in everyone if i != 99)
    ours, exact = np.array([everyone[i] for i in ids]), (u * s)[ids, :3]
    assert np.allclose(ours @ ours.T, exact @ exact.T, atol=1e-6)
    ratio = {r["component"]: r["ratio"] for r in svd.explained_variance(model, matrix, 60, 4).collect()}
    scores = dense @ vt[:4].T
    assert [ratio[i] for i in range(4)] == pytest.approx(scores.var(axis=0) / dense.var(axis=0).sum(), abs=1e-6)


def deflated_cca(x, y, n_components):
    """Component by component on rows: scale, solve, deflate; then rotations from the loadings."""
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    y = (y - y.mean(0)) / y.std(0, ddof=1)
    rotations = []
    xk, yk, wx, px, wy, py = x.copy(), y.copy(), [], [], [], []
    for _ in range(n_components):
        ix, iy = np.linalg.pinv(xk, rcond=1e-9), np.linalg.pinv(yk, rcond=1e-9)
        score = yk[:, 0]
        for _ in range(5000):
            w = ix @ score
            w /= np.linalg.norm(w)
            v = iy @ (xk @ w)
            v /= np.linalg.norm(v)
            new = yk @ v
            if np.linalg.norm(new - score) < 1e-14:
                break
            score = new
        t, u = xk @ w, yk @ v
        p, q = xk.T @ t / (t @ t), yk.T @ u / (u @ u)
        xk, yk = xk - np.outer(t, p), yk - np.outer(u, q)
        wx.append(w), px.append(p), wy.append(v), py.append(q)
    for w, p in ((np.array(wx).T, np.array(px).T), (np.array(wy).T, np.array(py).T)):
        rotations.append(w @ np.linalg.inv(p.T @ w))
    return rotations


def test_cca_equals_row_space_deflation(spark):
    rng = np.random.default_rng(2)
    shared = rng.normal(size=(80, 3))
    x = shared @ rng.normal(size=(3, 5)) + 0.5 * rng.normal(size=(80, 5)) + 3
    y = shared @ rng.normal(size=(3, 5)) + 0.5 * rng.normal(size=(80, 5)) - 1
    rows = [("web", "Train", i, x[i].tolist()) for i in range(80)] + [("pm", "Train", 100 + i, y[i].tolist()) for i in range(80)]
    vectors = spark.createDataFrame(rows, "side string, split string, id long, vec array<double>")
    links = spark.createDataFrame([(i, 100 + i) for i in range(80)], "web_id long, pmid long")
    model = cca.fit(vectors, links, 5, 4)
    rx, ry = deflated_cca(x, y, 4)
    for ours, theirs in ((model.web.rotation, rx), (model.pm.rotation, ry)):
        sign = np.sign((ours * theirs).sum(0))
        assert np.allclose(ours * sign, theirs, atol=1e-6)
    assert np.allclose(model.web.scale, x.std(0, ddof=1)) and np.allclose(model.pm.mean, y.mean(0))
    smaller = cca.fit(vectors, links, 5, 2)
    assert np.allclose(smaller.web.rotation, model.web.rotation[:, :2])
    back = cca.model_from_table(cca.model_table(spark, model))
    scores = {(r["side"], r["id"]): r["vec"] for r in cca.transform(vectors, back, 3).collect()}
    expected = (x - x.mean(0)) / x.std(0, ddof=1) @ model.web.rotation[:, :3]
    assert np.allclose([scores[("web", i)] for i in range(80)], expected)


def test_dense_vectors_rank_negative_cosines(spark):
    rows = [("web", "Test", 1, [1.0, 0.0]), ("pm", "Test", 1, [-1.0, 0.1]), ("pm", "Test", 2, [0.0, 0.0]), ("pm", "Test", 3, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "side string, split string, id long, vec array<double>")
    links = spark.createDataFrame([(1, 1), (1, 2)], "web_id long, pmid long")
    got = {(r["size"], r["pmid"]): r["rank"] for r in scoring.rank_prefixes(links, materialize(vectors), [2, 1]).collect()}
    assert got == {(2, 1): 3, (2, 2): 2, (1, 1): 3, (1, 2): 2}


def test_ranks_at_all_sizes_equal_plain_cosines(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SLICE_ENTRIES", 60)
    monkeypatch.setattr(scoring, "_CELLS_AT_ONCE", 30)
    rng = np.random.default_rng(4)
    x = {("web", i): rng.integers(-2, 3, 8).astype(float) for i in range(12)} | {("pm", i): rng.integers(-2, 3, 8).astype(float) for i in range(40)}
    rows = [(s, "Test", i, v.tolist()) for (s, i), v in x.items()]
    vectors = materialize(spark.createDataFrame(rows, "side string, split string, id long, vec array<double>"))
    links = [(i, (i * 7) % 40) for i in range(12)] + [(3, 4)]
    got = scoring.rank_prefixes(spark.createDataFrame(links, "web_id long, pmid long"), vectors, [2, 5, 8]).collect()
    assert len(got) == 3 * len(links)

    def cosine(a, b, k):
        scale = np.linalg.norm(a[:k]) * np.linalg.norm(b[:k])
        return round(float(a[:k] @ b[:k] / scale), 9) if scale else 0.0

    for r in got:
        cosines = [cosine(x["web", r["web_id"]], x["pm", p], r["size"]) for p in range(40)]
        assert r["rank"] == 1 + sum(c > cosines[r["pmid"]] for c in cosines) and abs(r["cos"] - cosines[r["pmid"]]) < 1e-9


def test_moments_of_more_columns_hold_those_of_fewer(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(50, 4)), rng.normal(size=(50, 4))
    pairs = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>").repartition(7)
    total = cca.moments(pairs, 4)
    both = np.hstack([x, y, np.ones((50, 1))])
    assert np.allclose(total, both.T @ both)
    assert np.allclose(cca.prefix(total, 2), cca.moments(pairs, 2))
    assert not cca.moments(pairs.where("false"), 2).any()


def test_catalogue_has_stable_schemas(spark, sf):
    for name in ("rank_measures", "experiment_results"):
        first = catalog.QUERIES[name](spark, sf)
        assert first.count() >= 1 and len(set(first.columns)) == len(first.columns)


def test_flagship_runs_on_given_frames(spark, sf):
    out = experiment.flagship(S.corpus(spark, sf), S.links(spark, sf), "Binary").toPandas()
    assert isinstance(out, pd.DataFrame) and out["n_links"][0] > 10 and out["median"][0] >= 1
