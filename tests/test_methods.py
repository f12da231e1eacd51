"""Methods, kernels and smoothing against dense and padded forms."""

import itertools

import numpy as np
import pytest

from flicker.functions.methods import FAMILIES, PARAMETERS, TIMES, candidates, halo, kernel_weights, method, shape
from flicker.operators.smoothing import Series, brief_and_edges, convolved, thomas


def dense(n, t):
    a = np.zeros((n, n))
    for i in range(n):
        for j in (i - 1, i, i + 1):
            k = min(max(j, 0), n - 1)
            a[i, k] += 0.25 if j != i else 0.5
    return np.linalg.inv(np.eye(n) + t * (np.eye(n) - a))


@pytest.mark.parametrize("n,t", list(itertools.product((*range(1, 13), 47), (3, 21, 150))))
def test_resolvent_equals_dense_inverse(n, t):
    z = np.random.default_rng(n).integers(0, 2, n).astype(float)
    h = convolved(z, 0, 0, n, n, kernel_weights("resolvent", t))
    assert np.allclose(h, dense(n, t) @ z, atol=1e-13)
    assert np.allclose(thomas(z[:, None], t)[:, 0], h, atol=1e-13)
    assert abs(h.mean() - z.mean()) < 1e-12


def test_exhaustive_binary_series():
    for n in range(1, 8):
        m = dense(n, 4)
        for bits in itertools.product((0.0, 1.0), repeat=n):
            assert np.allclose(convolved(np.array(bits), 0, 0, n, n, kernel_weights("resolvent", 4)), m @ np.array(bits), atol=1e-13)


def test_candidates():
    assert len(candidates(0.1)) == 120 and len(candidates()) == 113
    assert {m.name for m in candidates(0.1)} == set(FAMILIES)
    assert len(set(candidates(0.1))) == 120


def test_resolvent_equals_its_spectral_form():
    """Cosines are the eigenvectors of the reflecting path; eigenvalue k is 1 + t sin^2(pi k / 2n)."""
    rng = np.random.default_rng(12)
    for n in (1, 4, 17, 60):
        k = np.arange(n)
        basis = np.cos(np.pi * np.outer(k, np.arange(n) + 0.5) / n) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))[:, None]
        z = rng.integers(0, 2, n).astype(float)
        for t in (2, 16, 64):
            want = basis.T @ ((basis @ z) / (1 + t * np.sin(np.pi * k / (2 * n)) ** 2))
            assert np.allclose(convolved(z, 0, 0, n, n, kernel_weights("resolvent", t)), want, atol=1e-12)


@pytest.mark.parametrize("m", candidates(0.1), ids=str)
def test_constants_and_range(m):
    """Series of zeros or ones stay exactly that, at any length and in any stretch."""
    w = kernel_weights(*m.kernel)
    for n in (1, 3, 8, 70, 900, 6000):
        for v in (0.0, 1.0):
            assert (shape(m, convolved(np.full(n, v), 0, 0, n, n, w), 0.1) == v).all()
    half = len(w) // 2
    assert (shape(m, convolved(np.ones(50 + 2 * half), 1000, half, 50, 10_000, w), 0.1) == 1).all()
    p = shape(m, convolved(np.random.default_rng(3).integers(0, 2, 40).astype(float), 0, 0, 40, 40, w), 0.1)
    assert ((p >= 0) & (p <= 1)).all()


def test_batches_equal_single_series():
    """Series of many lengths, smoothed and masked together, against each alone."""
    rng = np.random.default_rng(6)
    rows = []
    for n in (1, 2, 5, 40, 300, 3):
        x = (rng.random(n) < 0.4).astype(np.int8)
        rows.append((0, 0, n, n, x))
    x = (rng.random(500) < 0.3).astype(np.int8)
    rows += [(200, 30, 100, 500, x[170:330]), (0, 0, 100, 500, x[:130])]
    s = Series(*(np.array([r[k] for r in rows], np.int64) for k in range(4)), np.array([len(r[4]) for r in rows], np.int64))
    flat = np.concatenate([r[4] for r in rows])
    for kernel in (("resolvent", 2), ("gaussian", 2.0), ("median", 5), ("raw", 0.0)):
        w = kernel_weights(*kernel)
        want = np.concatenate([convolved(x, lo, pre, own, n, w) for lo, pre, own, n, x in rows])
        assert np.allclose(s.convolved(flat, w), want, atol=1e-15)
    for a, b in zip(s.brief_and_edges(flat), zip(*[brief_and_edges(x, lo, pre, own, n) for lo, pre, own, n, x in rows])):
        assert (a == np.concatenate(b)).all()


def test_values_outside_the_range_fail():
    with pytest.raises(ArithmeticError):
        convolved(np.array([1.0, 0.0, 1.0]), 0, 0, 3, 3, np.array([-0.5, 2.0, -0.5]))


@pytest.mark.parametrize("kind,param", [("moving_average", 2), ("median", 5), ("gaussian", 1.0)])
def test_reflection_by_padding(kind, param):
    x = np.array([1, 0, 0, 1, 1], float)
    w = kernel_weights(kind, param)
    half = len(w) // 2
    padded = np.pad(x, half, mode="symmetric")
    want = [padded[i : i + len(w)] @ w for i in range(5)]
    assert np.allclose(convolved(x, 0, 0, 5, 5, w), want)


@pytest.mark.parametrize("name,params", [("cubic_median", {"t": 2}), *[("power_full", {"t": 2, "alpha": a}) for a in (1.25, 2.0, 8.0)]])
def test_sharpening_is_monotone_and_keeps_the_threshold(name, params):
    """Over random heights: order is kept, so are 0, one half and 1, and nothing changes sides."""
    rng = np.random.default_rng(9)
    h = np.sort(np.concatenate((rng.random(2000), 0.5 + rng.normal(0, 1e-9, 50), [0.0, 0.5, 1.0])))
    p = shape(method(name, **params), h)
    assert (np.diff(p) >= -1e-15).all()
    assert (p[h == 0] == 0).all() and np.allclose(p[h == 0.5], 0.5, atol=1e-15) and (p[h == 1] == 1).all()
    far = np.abs(h - 0.5) > 1e-7
    assert ((p >= 0.5) == (h >= 0.5))[far].all()
    assert (np.abs(p - 0.5) >= np.abs(h - 0.5) - 1e-12)[far].all()  # sharper


def _bad_parameters():
    """Each parameter of each family replaced by values that are no positive number, or left out, or beside one too many."""
    good = {"t": 3, "alpha": 1.5, "half_width": 2, "sigma": 0.7, "width": 7}
    for name, keys in PARAMETERS.items():
        own = {k: good[k] for k in keys}
        yield name, {**own, "surplus": 1}
        for k in keys:
            yield name, {q: v for q, v in own.items() if q != k}
            for v in (0, -2, float("nan"), float("inf"), True, "4", None, *((2.5,) if k in ("t", "half_width", "width") else ()), *((6,) if k == "width" else ())):
                yield name, {**own, k: v}


@pytest.mark.parametrize("name,params", list(_bad_parameters()), ids=str)
def test_bad_parameters(name, params):
    with pytest.raises(ValueError):
        method(name, **params)


def test_unknown_method():
    with pytest.raises(ValueError):
        method("wavelet")


@pytest.mark.parametrize("level", [None, -1e-9, 0.5, 7.0, float("nan")])
def test_noise_level_must_be_known(level):
    with pytest.raises(ValueError):
        shape(method("oracle_debiased_linear", t=1), np.array([0.5]), level)
    assert not any(m.name == "oracle_debiased_linear" for m in candidates(level))


def test_brief_runs_and_edges_against_a_run_finder():
    """Masks of random series against a plain walk over runs."""
    rng = np.random.default_rng(15)
    for n in (1, 2, 3, 7, 30, 200):
        for share in (0.1, 0.5, 0.9):
            x = (rng.random(n) < share).astype(np.int8)
            brief, edge = np.zeros(n, bool), np.zeros(n, bool)
            at = 0
            for v, run in itertools.groupby(x.tolist()):
                size = len(list(run))
                if v and size <= 3 and at > 0 and at + size < n:
                    brief[at : at + size] = True
                if at:
                    edge[at - 1] = edge[at] = True
                at += size
            got = brief_and_edges(x, 0, 0, n, n)
            assert (got[0] == brief).all() and (got[1] == edge).all()


def test_chunks_see_what_whole_series_see():
    rng = np.random.default_rng(5)
    x = (rng.random(400) < 0.4).astype(float)
    m = [method("linear", t=t) for t in TIMES[:4]] + [method("gaussian", sigma=4.0)]
    need = max(halo(m), 4)
    for lo in range(0, 400, 100):
        pre, post = min(need, lo), min(need, 300 - lo)
        part = x[lo - pre : lo + 100 + post]
        for k in m:
            w = kernel_weights(*k.kernel)
            assert np.allclose(convolved(part, lo, pre, 100, 400, w), convolved(x, 0, 0, 400, 400, w)[lo : lo + 100], atol=1e-12)
        for a, b in zip(brief_and_edges(part, lo, pre, 100, 400), brief_and_edges(x, 0, 0, 400, 400)):
            assert (a == b[lo : lo + 100]).all()
