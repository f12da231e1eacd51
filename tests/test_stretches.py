"""Operators on series of any length: neighbours, runs, exact systems and NumPy's streams, over many short stretches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flicker.operators import integrity as I
from flicker.operators import series as S
from flicker.operators import strata as R
from flicker.operators import streams as X
from flicker.operators import stretches
from flicker.operators import tridiagonal as D
from flicker.registry import QUERIES
from tests.conftest import DATA

SMALL = f"{DATA}/sf0.001"


def series(spark, many):
    rows = [(r, f, i, int(v)) for (r, f), x in many.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "run_id long, feature_id long, frame long, x byte").repartition(3)


@pytest.fixture(scope="module")
def many():
    """A run with a third of all frames, runs of one value over many stretches, single frames, ends at and beside borders."""
    rng = np.random.default_rng(2)
    out = {(k, 0): rng.integers(0, 2, n) for k, n in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 33])}
    out |= {(20, 0): np.ones(70, int), (21, 0): np.zeros(40, int), (22, 0): np.repeat(rng.integers(0, 2, 12), 9)}
    out[30, 0] = np.repeat(rng.integers(0, 2, 60), rng.integers(1, 12, 60))
    out[30, 1] = 1 - out[30, 0]
    return out


@pytest.fixture
def short(monkeypatch):
    """Stretches of 4 frames, in groups of 3."""
    monkeypatch.setattr(stretches, "STRETCH", 4)
    monkeypatch.setattr(stretches, "SPAN", 3)


def plain_runs(x):
    padded = np.concatenate(([0], x, [0]))
    at = np.flatnonzero(np.diff(padded))
    return list(zip(at[::2].tolist(), at[1::2].tolist()))


def test_runs_over_stretches(spark, many, short):
    got = R.positive_runs(series(spark, many)).collect()
    want = [(r, f, a, b, len(x)) for (r, f), x in many.items() for a, b in plain_runs(x)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_edges_and_counts_over_stretches(spark, many, short):
    frames = series(spark, many)
    got = {(r["run_id"], r["feature_id"], r["frame"]): r["edge"] for r in R.transitions(frames).collect()}
    for (r, f), x in many.items():
        d = np.concatenate(([False], x[1:] != x[:-1], [False]))
        assert [got[r, f, i] for i in range(len(x))] == (d[1:] | d[:-1]).tolist()
    counted = {r["run_id"]: r for r in R.counts(frames).collect()}
    for r in {k for k, _ in many}:
        own = [x for (k, _), x in many.items() if k == r]
        brief = [b - a for x in own for a, b in plain_runs(x) if b - a <= R.BRIEF and a > 0 and b < len(x)]
        assert (counted[r]["frames"], counted[r]["positive"], counted[r]["brief_events"], counted[r]["brief_cells"]) == (sum(map(len, own)), int(sum(x.sum() for x in own)), len(brief), sum(brief))


def test_no_window_covers_a_run(spark, many):
    """Every window of the plan has the stretch or the group among its keys, but that over what touches a group's border."""
    plan = R.counts(series(spark, many))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and sum("_s#" not in w and "_g#" not in w for w in windows) <= 2


def test_cadence_over_stretches(spark, short):
    rng = np.random.default_rng(4)
    times = {k: np.cumsum(rng.integers(1, 50, n)) for k, n in enumerate([1, 2, 4, 5, 40])}
    rows = [(k, int(t)) for k, ts in times.items() for t in ts]
    rng.shuffle(rows)
    got = {r["run_id"]: (r["frames"], r["min_dt"], r["max_dt"]) for r in I.cadence(spark.createDataFrame([tuple(map(int, r)) for r in rows], "run_id long, t long"), "t").collect()}
    assert got == {k: (len(t), *((int(np.diff(t).min()), int(np.diff(t).max())) if len(t) > 1 else (None, None))) for k, t in times.items()}


# ---------------------------------------------------------------- exact systems


def dense(n, t):
    m = np.diag(np.full(n, 1 + t / 2)) - np.diag(np.full(n - 1, t / 4), 1) - np.diag(np.full(n - 1, t / 4), -1)
    m[0, 0] -= t / 4
    m[-1, -1] -= t / 4
    return m


@pytest.mark.parametrize("t,frames", [(0.7, 1), (3.0, 2), (16.0, 16), (200.0, 5), (16.0, 1000)])
def test_system_over_stretches_equals_the_dense_inverse(spark, many, t, frames):
    got = {(r["run_id"], r["feature_id"], r["frame"]): r["h"] for r in S.to_frames(D.resolvent(S.to_chunks(series(spark, many), 0, frames), t), "h").collect()}
    for (r, f), x in many.items():
        want = np.linalg.solve(dense(len(x), t), x.astype(float))
        assert np.abs(want - [got[r, f, i] for i in range(len(x))]).max() < 1e-12


def test_system_refuses_other_parameters(spark, many):
    with pytest.raises(ValueError):
        D.resolvent(S.to_chunks(series(spark, many), 0, 4), 0.0)


# ---------------------------------------------------------------- NumPy's streams


def generator(words):
    return np.random.default_rng(np.random.SeedSequence(words))


def test_numbers_at_any_place():
    words = [9, 1, 1, 4, 0, 2]
    whole = generator(words).random((700, 11))
    assert (X.uniforms(words, 0, 1, 7700) == whole.ravel()).all()
    for first, column, n in ((0, 0, 700), (1, 10, 699), (333, 5, 1), (600, 3, 100), (5, 2, 0)):
        assert (X.uniforms(words, first * 11 + column, 11, n) == whole[first : first + n, column]).all()
    far = np.random.PCG64(np.random.SeedSequence(words))
    far.advance(10**20)
    assert X.uniforms(words, 10**20, 1, 3).tolist() == np.random.Generator(far).random(3).tolist()


def chunks_of(spark, x, frames, words):
    rows = [(r, f, i, int(v)) for (r, f), col in x.items() for i, v in enumerate(col)]
    df = spark.createDataFrame(rows, "run_id long, feature_id long, frame long, x byte")
    extra = {"words": F.array(*[F.lit(w).cast("long") for w in words], "run_id"), "column": F.col("feature_id"), "columns": F.lit(5).cast("long")}
    return S.to_chunks(df, 0, frames).withColumns(extra)


@pytest.mark.parametrize("frames", [3, 64, 1000])
def test_flips_and_chain_equal_numpys(spark, frames):
    """Of five columns, the first and the fourth only, in blocks."""
    rng = np.random.default_rng(1)
    x = {(r, f): rng.integers(0, 2, 200) for r in (4, 7) for f in (0, 3)}
    chunks = chunks_of(spark, x, frames, [3, 1])

    def values(df):
        out = {k: np.zeros(200, int) for k in x}
        for r in S.to_frames(df, "zs").collect():
            out[r["run_id"], r["feature_id"]][r["frame"]] = r["zs"]
        return out

    got = values(X.flipped(chunks, 0.2))
    chain = {rho: values(X.chained(chunks, 0.2, rho)) for rho in (0.8, 0.0, -0.2)}
    for run in (4, 7):
        u = generator([3, 1, run]).random((200, 5))
        for f in (0, 3):
            assert (got[run, f] == x[run, f] ^ (u[:, f] < 0.2)).all()
        for rho, z in chain.items():
            state = np.zeros((200, 5), bool)
            state[0] = u[0] < 0.2
            for i in range(1, 200):
                state[i] = u[i] < np.where(state[i - 1], 1 - 0.8 * (1 - rho), 0.2 * (1 - rho))
            for f in (0, 3):
                assert (z[run, f] == x[run, f] ^ state[:, f]).all(), rho


@pytest.mark.parametrize("size,span", [(1, 40), (50, 64), (333, 1000), (5000, 300)])
def test_normals_equal_numpys(spark, size, span):
    total = 5000
    streams = spark.createDataFrame([(r, [8, 2, r], total) for r in (1, 2)], "run_id long, words array<long>, total long")
    places = [k for k in range(0, total, size)][:: max(1, total // size // 60)]
    blocks = spark.createDataFrame([(r, k, min(size, total - k)) for r in (1, 2) for k in places], "run_id long, first long, size long")
    got = {(r["run_id"], r["first"]): r["v"] for r in X.normals(blocks, streams, span).collect()}
    assert len(got) == 2 * len(places)
    for r in (1, 2):
        want = generator([8, 2, r]).standard_normal(total)
        for k in places:
            assert got[r, k] == want[k : k + size].tolist()


def test_exact_queries_equal_numpys(spark):
    from flicker.operators.contacts import embedding_frames
    from flicker.queries.contacts import ATOMS

    events = spark.read.parquet(f"{SMALL}/events.parquet").toPandas().sort_values(["user_id", "ts", "event_id"])
    flips = {(r["run_id"], r["feature_id"], r["frame"]): r["z"] for r in QUERIES["exact_flips"](spark, SMALL).collect()}
    chain = QUERIES["exact_chain"](spark, SMALL).collect()
    assert len(chain) == len(flips) == 3 * len(events)
    for user, own in events.groupby("user_id"):
        x = np.stack([own.event_type.isin(["click", "purchase"]), own.value > 150, own.event_type == "error"], 1)
        z = x ^ (generator([20261128, 1, 1, user, 0, 0]).random(x.shape) < 0.1)
        assert [[flips[user, f, i] for f in range(3)] for i in range(len(x))] == z.astype(int).tolist()
    frames = {(r["run_id"], r["frame"]): r["xyz"] for r in embedding_frames(spark.read.parquet(f"{SMALL}/embeddings.parquet"), ATOMS).collect()}
    got = {(r["run_id"], r["frame"]): r["xyz"] for r in QUERIES["exact_normals"](spark, SMALL).collect()}
    assert got.keys() == frames.keys()
    for run in {r for r, _ in frames}:
        n = sum(r == run for r, _ in frames)
        noise = generator([20261128, 2, 1, run, 3, 0]).normal(0, 0.0125, (n, 3 * ATOMS))
        for i in range(n):
            assert (np.array(frames[run, i]) + noise[i]).tolist() == got[run, i]
