"""The whole grid against NumPy: all 120 candidates on two runs, decisions on what was selected, and kernels of constant work."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flicker.functions.methods import candidates, kernel_weights, method
from flicker.operators import contacts as C
from flicker.operators import metrics as M
from flicker.operators import noise as N
from flicker.operators import smoothing as H
from flicker.plans import benchmark as B

LEVEL = 0.1


@pytest.fixture(scope="module")
def frames(spark):
    """Twelve runs of two features; two of them are tested."""
    rng = np.random.default_rng(17)
    rows = [(r, f, i, int(v)) for r in range(12) for f in (0, 1) for i, v in enumerate(np.repeat(rng.integers(0, 2, 30), rng.integers(1, 9, 30))[:60])]
    return spark.createDataFrame(rows, "run_id long, feature_id long, frame long, x byte")


CFG = B.Config(level=LEVEL, sizes=(6, 4, 2), validation_draws=2, test_draws=2)


def padded(z, w):
    return np.pad(z, w, "symmetric") if w else z


def smoothed(m, z):
    n = len(z)
    if m.name in ("moving_average", "median"):
        w = int(m["half_width"] or (m["width"] - 1) / 2)
        windows = np.lib.stride_tricks.sliding_window_view(padded(z, w), 2 * w + 1)
        return np.median(windows, 1) if m.name == "median" else windows.mean(1)
    if m.name == "gaussian":
        w = int(4 * m["sigma"] + 0.5)
        g = np.exp(-0.5 * (np.arange(-w, w + 1) / m["sigma"]) ** 2)
        return np.lib.stride_tricks.sliding_window_view(padded(z, w), 2 * w + 1) @ (g / g.sum())
    if m.name == "raw":
        return z
    t = m["t"]
    a = np.diag(np.full(n, 1 + t / 2)) - np.diag(np.full(n - 1, t / 4), 1) - np.diag(np.full(n - 1, t / 4), -1)
    a[0, 0] -= t / 4
    a[-1, -1] -= t / 4
    h = np.clip(np.linalg.solve(a, z), 0, 1)
    if m.name == "cubic_median":
        return 3 * h**2 - 2 * h**3
    if m.name == "oracle_debiased_linear":
        return np.clip((h - LEVEL) / (1 - 2 * LEVEL), 0, 1)
    if m.name == "hard_linear":
        return (np.round(h, 12) >= 0.5).astype(float)
    if m.name.startswith("power"):
        p = m["alpha"] or 3.0
        return h**p / (h**p + (1 - h) ** p)
    return h


def flipped(x, phase, run_index, feature, draw):
    words = f"{N.ROOT}|{phase}|1|{run_index}|0|{draw}"
    u = [int(hashlib.md5(f"{words}|{feature}|{i}".encode()).hexdigest()[:8], 16) / 2**32 for i in range(len(x))]
    return np.where(np.array(u) < LEVEL, 1 - x, x).astype(float)


def scored(frames, split, phase, methods):
    """(run, draw, method, candidate): brier, mae, recall and the numbers of other sides of one half, by NumPy."""
    number, draws = {"validation": (1, CFG.validation_draws), "test": (2, CFG.test_draws)}[phase]
    runs = {r["run_id"]: r["run_index"] for r in split.collect() if r["split"] == phase}
    x = {}
    for r in frames.orderBy("frame").collect():
        x.setdefault((r["run_id"], r["feature_id"]), []).append(r["x"])
    out = {}
    for run, index in runs.items():
        for draw in range(draws):
            z = {f: flipped(np.array(x[run, f]), number, index, f, draw) for f in (0, 1)}
            truth = np.concatenate([x[run, f] for f in (0, 1)])
            for m in methods:
                p = np.concatenate([smoothed(m, z[f]) for f in (0, 1)])
                hit = np.round(p, 9) >= 0.5
                out[run, draw, m.name, m.cand] = ((p - truth) ** 2).mean(), np.abs(p - truth).mean(), (hit & (truth == 1)).sum() / (truth == 1).sum()
    return out


def test_all_candidates_against_numpy(spark, frames):
    split = B.splits(frames, CFG)
    methods = candidates(LEVEL)
    assert len(methods) == 120
    want = scored(frames, split, "test", methods)
    got = {(r["run_id"], r["draw"], r["method"], r["cand_ord"]): (r["brier"], r["mae"], r["recall"]) for r in B.scores(B.phase_sums(frames, split, "test", methods, CFG)).collect()}
    assert got.keys() == want.keys() and len(got) == 2 * 2 * 120
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-9), k


def test_decisions_are_made_on_what_validation_selected(spark, frames):
    split = B.splits(frames, CFG)
    methods = candidates(LEVEL)
    validation, test = (scored(frames, split, p, methods) for p in ("validation", "test"))
    mean = lambda s, m: np.mean([v[0] for k, v in s.items() if k[2:] == (m.name, m.cand)])
    best = {}
    for m in methods:
        s = round(mean(validation, m), 12)
        if m.name not in best or s < best[m.name][0] - 1e-12:
            best[m.name] = (s, m)
    order = {f: i for i, f in enumerate(M.CONTROLS)}
    control = lambda families: min(families, key=lambda f: (best[f][0], order[f]))
    selection = B.select(frames, split, methods, CFG)
    assert {(r["method"], r["cand_ord"]) for r in selection.collect()} == {(m.name, m.cand) for _, m in best.values()}
    tested = B.test_selected(frames, split, methods, selection, CFG)
    assert {r[0] for r in tested.select("selection_sha256").distinct().collect()} == {B.selection_digest(selection)}
    for r in B.decisions(tested, selection).collect():
        base = control([f for f in M.CONTROLS if r["against"] == "selected" or f != "power_full"])
        a, b = mean(test, best[base][1]), mean(test, best["cubic_median"][1])
        assert r["baseline"] == base and np.isclose(r["gain"], (a - b) / a, atol=1e-9)
    cubic = best["cubic_median"][1]
    report = {r["method"]: r for r in B.same_t_report(tested, methods, selection).collect()}
    line = next(m for m in methods if m.name == "linear" and m["t"] == cubic["t"])
    assert report["linear"]["t"] == cubic["t"] and np.isclose(report["linear"]["brier"], mean(test, line), atol=1e-9)
    pairs = M.paired_with_all(tested.where("selected"), "cubic_median").collect()
    assert {r["base"] for r in pairs} == set(best) - {"cubic_median"} and len(pairs) == 2 * 9
    for r in pairs:
        d = [test[r["run_id"], k, *(lambda m: (m.name, m.cand))(best[r["base"]][1])][0] - test[r["run_id"], k, "cubic_median", cubic.cand][0] for k in (0, 1)]
        assert np.isclose(r["mean_diff"], np.mean(d), atol=1e-9)


def test_another_plans_selection_is_refused(spark, frames):
    split = B.splits(frames, CFG)
    grid = [method("raw"), method("linear", 0, t=2), method("cubic_median", 0, t=2)]
    selection = B.select(frames, split, grid, CFG)
    with pytest.raises(ValueError, match="grid_sha256"):
        B.test_selected(frames, split, [*grid, method("linear", 1, t=4)], selection, CFG)
    turned = frames.withColumn("x", F.when(F.col("frame") % 3 == 0, 1 - F.col("x")).otherwise(F.col("x")).cast("tinyint"))
    with pytest.raises(ValueError, match="features_sha256"):
        B.test_selected(turned, split, grid, selection, CFG)


@pytest.mark.parametrize("sizes", [[1, 2, 3, 50], [700, 1, 900], [5] * 100])
def test_kernels_of_constant_work(sizes):
    """Every kernel of the grid by running sums equals the direct convolution, on whole series and on stretches with halos."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, sum(sizes)).astype(np.int8)
    n = np.array(sizes)
    whole = H.Series(np.zeros(len(n), int), np.zeros(len(n), int), n, n, n)
    for kernel in dict.fromkeys(m.kernel for m in candidates(LEVEL)):
        w = kernel_weights(*kernel)
        direct = np.concatenate([np.convolve(padded(x[a : a + k].astype(float), len(w) // 2), w[::-1], "valid") for a, k in zip(np.cumsum(n) - n, n)])
        assert np.abs(whole.response(x, kernel) - direct).max() < 1e-14, kernel
        if len(n) == 3:
            wide = len(w) // 2
            lo, own = np.arange(0, 700, 100), np.full(7, 100)
            pre, post = np.minimum(lo, wide), np.minimum(700 - lo - own, wide)
            cut = H.Series(lo, pre, own, np.full(7, 700), pre + own + post)
            assert np.abs(cut.response(np.concatenate([x[a - p : a + 100 + q] for a, p, q in zip(lo, pre, post)]), kernel) - direct[:700]).max() < 1e-14, kernel


def test_falling_sums():
    v = np.random.default_rng(1).random(5000)
    for ratio in (0.001, 0.17, 0.78, 0.99):
        s, want = 0.0, []
        for x in v:
            s = ratio * s + x
            want.append(s)
        assert np.allclose(H.falling_sums(v, ratio), want, rtol=1e-12)
    assert len(H.falling_sums(v[:0], 0.5)) == 0


def test_frames_of_repeated_ids_and_null_labels(spark):
    rows = [(7, [1.0] * 6, 0), (7, [2.0] * 6, 0), (5, [3.0] * 6, 0), (9, [4.0] * 6, None), (None, [5.0] * 6, None), (1, [6.0] * 6, 1)]
    got = C.embedding_frames(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 2).collect()
    assert len(got) == 6
    by = {}
    for r in got:
        by.setdefault(r["run_id"], {})[r["frame"]] = r["xyz"][0]
    assert by[0][0] == 3.0 and {by[0][1], by[0][2]} == {1.0, 2.0} and by[1] == {0: 6.0} and sorted(by[None].values()) == [4.0, 5.0] and sorted(by[None]) == [0, 1]
