"""Block-wise factorisation against a dense fit, prepared runs, usages."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.errors import AnalysisError
from ionweave.operators import factorisation as fa

from .test_qc_analysis import bundle


def planted(n=90, seed=1):
    rng = np.random.default_rng(seed)
    w = rng.dirichlet([0.3] * 3, n)
    h = np.zeros((3, 9))
    for c in range(3):
        h[c, 3 * c : 3 * c + 3] = [5, 4, 3]
    return w @ h + rng.random((n, 9)) * 0.02, w


def scaled(a):
    return a / np.where(a.std(0) == 0, 1, a.std(0))


def dense_fit(m, k, seed):
    """The same rounds with the whole matrix in memory."""
    h, error = fa.start(k, m.shape[1], m.mean(), seed), np.inf
    for i in range(fa.ITERATIONS):
        w = fa.usage_of(m, h)
        now = ((m - w @ h) ** 2).sum()
        if error - now <= fa.ENOUGH * (m * m).sum() or i == fa.ITERATIONS - 1:
            return h, now
        error, h = now, fa.descend(h.T.copy(), m.T @ w, w.T @ w).T


def multiplicative(m, k, seed, iterations=200):
    """Another method for the same error."""
    rng = np.random.default_rng(seed)
    w, h = rng.random((len(m), k)) + 1e-6, rng.random((k, m.shape[1])) + 1e-6
    for _ in range(iterations):
        h *= (w.T @ m) / (w.T @ w @ h + 1e-12)
        w *= (m @ h.T) / (w @ h @ h.T + 1e-12)
    return ((m - w @ h) ** 2).sum()


@pytest.mark.parametrize("block", [1000, 7])
def test_blocks_equal_the_dense_fit(spark, monkeypatch, block):
    monkeypatch.setattr(fa, "BLOCK", block)
    a, _ = planted()
    b = bundle(spark, a)
    found = fa.factorize(b, [2, 3], n_iter=2, n_features=9).collect()
    assert len(found) == 2 * 2 + 3 * 2
    for k, r in ((2, 0), (2, 1), (3, 0), (3, 1)):
        h, error = dense_fit(scaled(a), k, 14 + 1000 * k + r)
        h = h / np.linalg.norm(h, axis=1, keepdims=True)
        rows = sorted((x for x in found if (x.k, x.replicate) == (k, r)), key=lambda x: x.component)
        assert np.array([x.spectrum for x in rows]) == pytest.approx(h, abs=1e-6)
        assert rows[0].error == pytest.approx(error, rel=1e-6, abs=1e-6)
        assert error <= 1.1 * min(multiplicative(scaled(a), k, s) for s in range(3)) + 1e-3 * (scaled(a) ** 2).sum()


def test_usages_find_the_planted_programmes(spark):
    a, w = planted()
    b = bundle(spark, a)
    whole, table = fa.run_cnmf(b, [2, 3], 3, n_iter=4, n_features=9)
    got = whole.obs.orderBy("obs_ord").toPandas()
    names = ["Usage_1", "Usage_2", "Usage_3"]
    assert np.allclose(got[names].sum(axis=1), 1) and (got[names] >= 0).all().all()
    assert got[names].sum().tolist() == sorted(got[names].sum().tolist(), reverse=True)
    fit = np.abs(np.corrcoef(got[names].to_numpy().T, w.T)[:3, 3:])
    assert (fit.max(axis=1) > 0.95).all() and len(set(fit.argmax(axis=1))) == 3
    assert {r.k: r.stability for r in table.collect()}[3] > 0.9


def test_prepared_run_is_never_overwritten(spark, tmp_path):
    b = bundle(spark, planted(40)[0])
    path = str(tmp_path / "run")
    run = fa.prepare_cnmf(b, path, [2, 3], n_iter=3, n_features=6)
    assert fa.load_prepared(spark, path) == run and run.features(spark).count() == 6
    with pytest.raises(AnalysisError, match="never overwritten"):
        fa.prepare_cnmf(b, path, [2], n_iter=1)
    parts = [fa.factorize_prepared(spark, run, i, 2) for i in (0, 1)]
    assert [p.select("k", "replicate").distinct().count() for p in parts] == [3, 3]
    with pytest.raises(AnalysisError, match="never overwritten"):
        fa.factorize_prepared(spark, run, 1, 2)
    got = {(r.k, r.replicate, r.component): r.spectrum for r in fa.prepared_spectra(spark, run).collect()}
    want = {(r.k, r.replicate, r.component): r.spectrum for r in fa.factorize(b, [2, 3], n_iter=3, n_features=6).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert fa.usages(run.matrix(spark), fa.consensus_spectra(fa.prepared_spectra(spark, run), 2, 2.0)).count() == 40


def test_prepared_run_with_missing_replicates(spark, tmp_path):
    b = bundle(spark, planted(30)[0])
    run = fa.prepare_cnmf(b, str(tmp_path / "run"), [2], n_iter=2, n_features=6)
    fa.factorize_prepared(spark, run, 0, 2)
    with pytest.raises(AnalysisError, match="missing"):
        fa.prepared_spectra(spark, run)
    with pytest.raises(AnalysisError, match="no prepared run"):
        fa.load_prepared(spark, str(tmp_path / "other"))


def test_what_factorisation_refuses(spark):
    b = bundle(spark, planted(20)[0])
    for bad in (dict(components=[1]), dict(components=[2], n_iter=0), dict(components=[2], worker_index=1)):
        with pytest.raises(AnalysisError):
            fa.factorize(b, **bad)
    with pytest.raises(AnalysisError, match="variable"):
        fa.factorize(bundle(spark, np.ones((4, 2))), [2])
    with pytest.raises(AnalysisError, match="non-negative"):
        fa.factorize(bundle(spark, -np.ones((4, 2))), [2])
    assert fa.factorize(b, [2], n_iter=1, worker_index=1, total_workers=2).count() == 0
    rows = fa.usages(fa.matrix_blocks(bundle(spark, np.vstack([planted(20)[0], np.zeros((1, 9))])), 9)[0], np.eye(2, 9)).orderBy(F.desc("obs_id")).first()
    assert (rows.Usage_1, rows.Usage_2) == (0, 0)
