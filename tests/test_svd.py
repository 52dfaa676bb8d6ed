"""Truncated SVD against NumPy on well and badly conditioned input."""

import numpy as np
import pytest

from linkloom.operators import smallside, svd


def as_rows(spark, a):
    rows = [("web", "Train", int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    return spark.createDataFrame(rows, "side string, split string, id long, term_id long, weight double")


def with_spectrum(rng, n, m, values):
    u = np.linalg.qr(rng.normal(size=(n, len(values))))[0]
    v = np.linalg.qr(rng.normal(size=(m, len(values))))[0]
    return (u * values) @ v.T


CASES = {
    "rank 5 of 4": (lambda r: r.normal(size=(40, 5)) @ r.normal(size=(5, 30)), 4),
    "rank 5 of 10": (lambda r: r.normal(size=(40, 5)) @ r.normal(size=(5, 30)), 10),
    "copied rows": (lambda r: np.repeat(r.integers(0, 3, (6, 25)).astype(float), 7, axis=0), 5),
    "spectrum 1e3": (lambda r: with_spectrum(r, 60, 50, np.logspace(3, 0, 30)), 8),
    "spectrum 1e5": (lambda r: with_spectrum(r, 60, 50, np.logspace(5, 0, 30)), 8),
    "more than columns": (lambda r: r.normal(size=(12, 6)), 9),
}


def by_lanczos(rows, k):
    """The path for sides that are too large for all inner products, three columns at a time."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(smallside, "GRAM_SIDE", 0)
        patch.setattr(smallside, "_COLUMNS", 3)
        return svd.truncated_svd(rows, k, tolerance=1e-7)


WAYS = {"inner products": svd.truncated_svd, "lanczos": by_lanczos, "sweeps": svd.by_sweeps}


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("name", CASES)
def test_singular_values_and_vectors(spark, name, way):
    make, k = CASES[name]
    a = make(np.random.default_rng(5))
    model = WAYS[way](as_rows(spark, a), k)
    exact = np.zeros(k)
    values = np.linalg.svd(a, compute_uv=False)[:k]
    exact[: len(values)] = np.where(values > values[0] * 1e-10, values, 0)
    assert model.singular_values.shape == (k,)
    assert np.allclose(model.singular_values, exact, rtol=1e-6, atol=exact[0] * 1e-9)
    rows = {r.id: r.vec for r in model.projected.collect()}
    assert {len(v) for v in rows.values()} == {k}
    projected = np.array([rows.get(i, np.zeros(k)) for i in range(len(a))])
    best = np.linalg.svd(a, full_matrices=False)
    kept = exact > 0
    if k >= np.linalg.matrix_rank(a) or exact[kept][-1] > best[1][kept.sum()] * 1.05:
        r = kept.sum()
        assert np.allclose(projected @ projected.T, (best[0][:, :r] * best[1][:r] ** 2) @ best[0][:, :r].T, atol=exact[0] ** 2 * 1e-5)


def test_unsettled_raises(spark):
    a = np.random.default_rng(1).normal(size=(60, 50))
    with pytest.raises(RuntimeError):
        svd.by_sweeps(as_rows(spark, a), 5, margin=1, max_sweeps=2)


def test_real_frequencies_against_numpy(spark, sf):
    from linkloom.operators import features
    from linkloom.plans import catalog, experiment

    prepared = catalog._prepared(spark, sf)
    matrix = features.features(experiment.known_terms(prepared), "TF", prepared.n_docs)
    rows = matrix.toPandas()
    docs, terms = (rows.groupby(c).ngroup() for c in (["side", "id"], "term_id"))
    a = np.zeros((docs.max() + 1, terms.max() + 1))
    a[docs, terms] = rows["weight"]
    exact = np.linalg.svd(a, compute_uv=False)[:400]
    exact = np.pad(np.where(exact > exact[0] * 1e-8, exact, 0), (0, 400 - len(exact)))
    for block in (smallside.GRAM_SIDE, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(smallside, "GRAM_SIDE", block)
            got = svd.truncated_svd(matrix, 400).singular_values
        assert np.allclose(got, exact, rtol=1e-4 if block == 0 else 1e-8, atol=exact[0] * 1e-8)


def test_columns_in_slices_and_an_empty_matrix(spark, monkeypatch):
    monkeypatch.setattr(smallside, "SLICE_VALUES", 40)
    a = np.random.default_rng(2).random((14, 9)) + 0.1
    for matrix in (a, a.T):
        model = svd.truncated_svd(as_rows(spark, matrix), 5)
        projected = {r.id: r.vec for r in model.projected.collect()}
        basis = {r.term_id: r.v for r in model.basis.collect()}
        p, v = (np.array([x[i] for i in range(len(x))]) for x in (projected, basis))
        assert np.allclose(p, matrix @ v) and np.allclose(v.T @ v, np.eye(5))
    empty = svd.truncated_svd(as_rows(spark, a).where("false"), 3)
    assert empty.projected.count() == 0 and not empty.singular_values.any()


def test_fit_now_transform_later(spark, tmp_path):
    rng = np.random.default_rng(8)
    a, b = rng.random((30, 12)), rng.random((7, 14)) * (rng.random((7, 14)) < 0.5)
    svd.save(svd.truncated_svd(as_rows(spark, a), 3), str(tmp_path / "model"))
    model = svd.load(spark, str(tmp_path / "model"))
    v = np.zeros((14, 3))
    for r in model.basis.collect():
        v[r.term_id] = r.v
    got = {r.id: r.vec for r in svd.transform(as_rows(spark, b), model).collect()}
    want = b @ v
    assert all(np.allclose(got.get(i, np.zeros(3)), want[i]) for i in range(len(b)))
    assert np.allclose(model.singular_values, np.linalg.svd(a, compute_uv=False)[:3])


def test_stored_experiments_add_up(spark, tmp_path):
    from pyspark.sql import functions as F

    from linkloom.plans import grid

    def run(feature, size, ranks):
        rows = spark.createDataFrame([(i, i, r) for i, r in enumerate(ranks)], "web_id long, pmid long, rank long")
        values = {"feature": feature, "reduction": grid.TSVD, "min_df": 2, "max_df": 1.0, "tsvd": size, "cca": False, "cca_k": 0}
        return rows.withColumns({k: F.lit(v) for k, v in values.items()})

    path = str(tmp_path / "grid")
    first = grid.store(run("TF", 100, [1, 2, 9]).unionByName(run("TF", 200, [1, 1, 3])), path).collect()
    assert {(r.tsvd, r.median) for r in first} == {(100, 2.0), (200, 1.0)}
    second = grid.store(run("Binary", 100, [4]), path).collect()
    assert {(r.feature, r.tsvd, r.n_links, r.median) for r in second} == {("TF", 100, 3, 2.0), ("TF", 200, 3, 1.0), ("Binary", 100, 1, 4.0)}
