"""Contour integration against a dense solver, and whitening against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from corpusloom.llm import whitening


def spectrum(values, seed=0):
    turned = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    v = (turned * np.array(values, float)) @ turned.T
    return (v + v.T) / 2


SPECTRA = {
    "flat": list(np.linspace(1, 2, 40)),
    "geometric": [2.0**-k for k in range(30)],
    "repeated": [5.0] * 13 + [3.0] * 3 + [1.0] * 20,
    "clustered": [1 + 1e-9 * k for k in range(20)] + [7.0, 7.0 + 1e-7],
    "deficient": [4.0, 2.0, 1.0] + [0.0] * 12,
    "one": [3.0],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_components(name):
    values = np.sort(np.array(SPECTRA[name]))[::-1]
    v = spectrum(values)
    wanted = min(32, len(values))
    got, vectors = whitening.components(v, wanted)
    kept = values[:wanted][values[:wanted] > values[0] * 1e-9]
    assert np.allclose(got, kept, rtol=0, atol=1e-12 * values[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12
    assert np.abs(v @ vectors - vectors * got).max() < 1e-11 * values[0]


def test_inertia_counts():
    v = spectrum([-3.0, -1.0, -1.0, 0.5, 2.0, 2.0, 9.0])
    assert [whitening.below(v, s) for s in (-4, -2, 0, 1, 3, 10)] == [0, 1, 3, 4, 6, 7]
    assert whitening.below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0) == 1
    assert whitening.below(np.zeros((3, 3)), 0) == 0


def test_intervals_hold_what_inertia_says():
    v = spectrum(SPECTRA["flat"])
    values = np.linalg.eigvalsh(v)
    parts = whitening.intervals(v, 20)
    assert all(((values >= low) & (values < high)).sum() == count <= whitening.FEW for low, high, count in parts)
    assert sum(count for *_, count in parts) >= 20 and [p[0] for p in parts] == sorted((p[0] for p in parts), reverse=True)


def rows_of(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 7, "x") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, c string")


def test_matches_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6))
    vectors[7] = vectors[8]
    bad = [None, [], [1.0, None, 2, 3, 4, 5], [1.0, float("nan"), 2, 3, 4, 5], [float("inf")] * 6, [1e30] * 6, [1.0, 2.0], [0.0] * 7]
    got = whitening.whiten(rows_of(spark, [*vectors, *bad], [*range(298), 3, None, *range(500, 508)]), wanted=4).toPandas()
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    want = centred @ (u[:, ::-1][:, :4] / np.sqrt(e[::-1][:4]))
    assert len(got) == 300 * 4 and set(got.n) == {300} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert got.vec_id.isna().sum() == 4 and (got.vec_id == 3).sum() == 8
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    for k in range(4):
        part = got[got.component == k + 1]
        assert np.allclose(part.explained, e[::-1][k] / e.sum(), rtol=1e-10)
        keyed = lambda d, w: sorted(zip(d, np.round(w, 6) + 0.0))
        have = keyed(map(int, part.deviation), part.whitened.to_numpy())
        assert have in (keyed(deviation.tolist(), want[:, k]), keyed(deviation.tolist(), -want[:, k]))


def test_no_variance_no_components(spark):
    assert whitening.whiten(rows_of(spark, [])).collect() == []
    assert whitening.whiten(rows_of(spark, [None, [float("nan")]])).collect() == []
    assert whitening.whiten(rows_of(spark, [[1.0, 2.0]] * 3)).collect() == []
    two = whitening.whiten(rows_of(spark, [[1.0, 2.0], [2.0, 2.0]])).collect()
    assert [(r.component, abs(round(r.whitened, 9)), r.explained) for r in two] == [(1, 1.0, 1.0)] * 2


def test_deviations_beyond_a_long():
    d = np.array([[3, 4], [2**33, 1]])
    assert [int(x) for x in whitening.deviations(d).to_pylist()] == [25, 2**66 + 1]
    assert [int(x) for x in whitening.deviations(d[:1]).to_pylist()] == [25]
