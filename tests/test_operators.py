"""Operators on small fixtures."""

import hashlib
import io
import math
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from flicker.functions.methods import candidates, halo, kernel_weights, method
from flicker.functions.scalars import all_known, decision, t_975
from flicker.operators import contacts as C
from flicker.operators import integrity as I
from flicker.operators import metrics as M
from flicker.operators import noise as N
from flicker.operators import series as S
from flicker.operators import smoothing as H
from flicker.operators.order import numbered
from flicker.operators.smoothing import convolved
from flicker.operators.splits import hash_split
from flicker.plans import benchmark as B
from flicker.registry import ORACLE, QUERIES
from flicker.sources import formats as A
from tests.conftest import DATA, assert_same


def test_pairs_and_strict_cutoff(spark):
    assert [tuple(r) for r in C.pairs(spark, 6).orderBy("feature_id").collect()] == [(0, 0, 4), (1, 0, 5), (2, 1, 5)]
    assert C.pairs(spark, 35).count() == 496 and C.pairs(spark, 162).count() == 12561
    at = [np.nextafter(8.0, 0), 8.0, np.nextafter(8.0, 9)]
    frames = spark.createDataFrame([(0, i, [0.0] * 12 + [float(v), 0.0, 0.0]) for i, v in enumerate(at)], "run_id long, frame long, xyz array<double>")
    rows = C.contacts(C.distances(frames, C.pairs(spark, 5)), {8: 8.0}).orderBy("frame").collect()
    assert [r["c8"] for r in rows] == [1, 0, 0]


def test_null_dominant_decision(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (None, False), (None, True)], "a boolean, b boolean")
    got = rows.select(all_known(F.col("a"), F.col("b")).alias("k"), decision(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r["k"] for r in got] == [True, False, None, None]
    assert [r["d"] for r in got] == ["pass", "fail", "not_evaluable", "not_evaluable"]


def test_student_quantiles(spark):
    got = {r["d"]: r["t"] for r in spark.range(1, 200).select(F.col("id").alias("d"), t_975(F.col("id")).alias("t")).collect()}
    assert abs(got[15] - 2.1314495456) < 1e-9 and abs(got[30] - got[31]) < 0.01
    assert abs(got[60] - 2.000297822) < 1e-5 and abs(got[120] - 1.979930405) < 1e-6


def test_chain_statistics(spark):
    n = 4000
    chunks = spark.range(12).select(F.lit(0).cast("long").alias("run_id"), F.col("id").alias("feature_id"), F.lit(n).cast("long").alias("n"), F.array_repeat(F.lit(0).cast("tinyint"), n).alias("xs"))
    z = np.array([r["zs"] for r in N.chained(chunks, 0.1, 0.8, F.lit("key")).select("zs").collect()])
    a, b = z[:, :-1], z[:, 1:]
    assert z.shape == (12, n)
    assert abs(z.mean() - 0.1) < 0.015 and abs(b[a == 0].mean() - 0.02) < 0.004 and abs(1 - b[a == 1].mean() - 0.18) < 0.02


def _frames(spark, runs=8, n=50):
    rng = np.random.default_rng(7)
    rows = [(r, f, i, int(v)) for r in range(runs) for f in range(2) for i, v in enumerate(rng.random(n) < (0.05 if f else 0.4))]
    return spark.createDataFrame(rows, "run_id long, feature_id long, frame long, x tinyint")


def test_chunked_sums_equal_whole_ones(spark):
    frames = N.flips(_frames(spark), 0.1, N.seed(F.lit(1), 1, "run_id", 0, F.lit(0)))
    methods = [method("linear", t=2), method("median", width=5), method("cubic_median", t=2)]
    one = M.run_metrics(H.error_sums(S.to_chunks(frames, halo(methods), 1000, ("x", "z")), methods).withColumn("rare", F.col("feature_id") == 1))
    many = M.run_metrics(H.error_sums(S.to_chunks(frames, halo(methods), 10, ("x", "z")), methods).withColumn("rare", F.col("feature_id") == 1))
    for a, b in zip(one.orderBy("run_id", "method").collect(), many.orderBy("run_id", "method").collect()):
        for m in M.METRICS:
            assert (a[m] is None and b[m] is None) or math.isclose(a[m], b[m], abs_tol=1e-12), m


def test_no_leak_between_runs(spark):
    m = method("gaussian", sigma=2.0)
    frames = _frames(spark)
    alone = S.to_frames(H.smooth(S.to_chunks(frames.where("run_id = 3"), halo([m])), [m]), "p")
    among = S.to_frames(H.smooth(S.to_chunks(frames, halo([m])), [m]), "p").where("run_id = 3")
    assert alone.exceptAll(among).isEmpty() and among.exceptAll(alone).isEmpty()


def test_perfect_and_empty_strata(spark):
    rows = [(0, 0, i, 0, 0) for i in range(5)]
    f = spark.createDataFrame(rows, "run_id long, feature_id long, frame long, x tinyint, z tinyint")
    r = M.run_metrics(H.error_sums(S.to_chunks(f, 4, values=("x", "z")), [method("raw")]).withColumn("rare", F.lit(False))).first()
    assert r["brier"] == 0 and r["rare_positive_recall"] is None and r["short_positive_recall"] is None and r["recall"] is None


def test_means_leave_nulls_out(spark):
    runs = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("b", 0, None)], "run_id string, draw int, brier double")
    r = M.equal_weight(runs, ("run_id",), (), ("brier",)).first()
    assert r["brier"] == 1.0 and r["n_brier"] == 1


def test_selection_ties_by_order(spark):
    runs = spark.createDataFrame([("power_full", 4, 0.1), ("power_full", 2, 0.1), ("power_matched", 0, 0.1), ("raw", 0, 0.2)], "method string, cand_ord int, brier double")
    best = M.best_candidates(runs)
    assert best.where("method = 'power_full'").first()["cand_ord"] == 2
    assert M.best_control(best).first()["method"] == "power_full"


def test_paired_interval(spark):
    rows = [("r", d, m, v) for d, (b, c) in enumerate([(0.3, 0.2), (0.4, 0.2), (0.5, 0.6)]) for m, v in (("linear", b), ("cubic_median", c))] + [("s", 0, "linear", 0.0), ("s", 0, "cubic_median", 0.0)]
    got = {r["run_id"]: r for r in M.paired(spark.createDataFrame(rows, "run_id string, draw int, method string, brier double"), "linear", "cubic_median").collect()}
    d = np.array([0.1, 0.2, -0.1])
    assert math.isclose(got["r"]["mean_diff"], d.mean()) and math.isclose(got["r"]["half_width"], 4.3026527297 * d.std(ddof=1) / math.sqrt(3), rel_tol=1e-9)
    assert (got["r"]["positive"], got["r"]["negative"]) == (2, 1)
    assert got["s"]["half_width"] is None and got["s"]["relative_gain"] is None


def test_test_runs_cannot_reach_selection(spark):
    frames = _frames(spark, runs=12)
    cfg = B.Config(sizes=(4, 4, 4), validation_draws=1, test_draws=1)
    split = B.splits(frames, cfg)
    grid = [method("linear", i, t=t) for i, t in enumerate((1, 8))] + [method("raw")]
    changed = frames.join(split.select("run_id", "split"), "run_id").withColumn("x", F.when(F.col("split") == "test", 1 - F.col("x")).otherwise(F.col("x")).cast("tinyint")).drop("split").select(frames.columns)
    a, b = B.select(frames, split, grid, cfg), B.select(changed, split, grid, cfg)
    assert a.exceptAll(b).isEmpty() and a.count() == 2


def test_roots_cycles_and_missing_parents(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 4), (6, 7), (7, 6)], "node long, parent long")
    got = {r["node"]: (r["root"], r["depth"]) for r in I.roots(edges).collect()}
    assert got[1] == (1, 0) and got[3] == (1, 2) and got[4][0] is None and got[5][0] is None and got[6][0] is None


def test_roots_of_long_chains(spark):
    n = 300
    chain = [(1, None), *[(i, i - 1) for i in range(2, n)], (1000, 999), *[(i, i - 1) for i in range(1001, 1100)], (2001, 2000), (2000, 2001), (2002, 2001)]
    got = {r["node"]: (r["root"], r["depth"]) for r in I.roots(spark.createDataFrame(chain, "node long, parent long")).collect()}
    assert len(got) == len(chain)
    assert all(got[i] == (1, i - 1) for i in range(1, n))
    assert all(got[i] == (None, i - 1000) for i in range(1000, 1100))
    assert all(got[i][0] is None for i in (2000, 2001, 2002))


def test_ancestry_of_long_conversations(spark, tmp_path):
    turns = [(c, t, "user", "x") for c in (7, 8) for t in range(150)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in QUERIES["ancestry_roots"](spark, str(tmp_path)).select("node", "root", "depth").collect())
    assert got == sorted((c * 100 + t, c * 100, t) for c in (7, 8) for t in range(150))


@pytest.mark.parametrize("name", ["noise_correlated", "npz_roundtrip"])
def test_series_cut_into_stretches(spark, duck, monkeypatch, name):
    monkeypatch.setattr(S, "to_chunks", lambda frames, *_, cut=S.to_chunks: cut(frames, 0, 7))
    assert_same(QUERIES[name](spark, f"{DATA}/sf0.001"), duck, ORACLE[name])


@pytest.mark.parametrize("rho", [0.8, -0.05, -0.9])
def test_chain_carried_over_stretches(spark, rho):
    frames = _frames(spark, 6, 200)
    of = lambda size: {(r["run_id"], r["feature_id"], r["frame"], r["zs"]) for r in S.to_frames(N.chained(S.to_chunks(frames, 0, size), 0.45, rho, F.lit("key")), "zs").collect()}
    whole = of(1000)
    assert len(whole) == 2400 and of(3) == whole and of(1) == whole


class _Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["test_of_selected", *(q for q in sorted(QUERIES) if q.startswith("whole_"))])
def test_whole_benchmark(spark, monkeypatch, name):
    def seen(frames, split, phase, methods, cfg, clean=False):
        raise _Seen(len(methods), cfg.validation_draws, cfg.test_draws)

    monkeypatch.setattr(B, "phase_sums", seen)
    with pytest.raises(_Seen) as got:
        QUERIES[name](spark, f"{DATA}/sf0.001")
    pair = name.removeprefix("whole_") in ("paired_interval", "composite_decision", "same_t_attribution")
    assert got.value.args == (2 if pair else 120, 8, 16)


# ---------------------------------------------------------------- scenarios


def _prepared(spark, runs=9, frames=30):
    """Eight atoms that move about in a small box; runs 0 to 3 for discovery, 4 to 6 for validation, the others for test."""
    rng = np.random.default_rng(21)
    rows = [(r, f, rng.random(24).tolist()) for r in range(runs) for f in range(frames)]
    xyz = spark.createDataFrame(rows, "run_id long, frame long, xyz array<double>").withColumn("xyz", F.transform("xyz", lambda v: v * 0.35))
    split = spark.createDataFrame([(r, r, "discovery" if r < 4 else "validation" if r < 7 else "test") for r in range(runs)], "run_id long, run_index long, split string")
    return B.prepare(xyz, split, C.pairs(spark, 8))


SOME = [method("raw"), method("linear", 0, t=2), method("linear", 1, t=8), method("cubic_median", 0, t=2), method("oracle_debiased_linear", 0, t=2)]
FEW = B.Config(validation_draws=2, test_draws=2)


def test_scenarios_by_name():
    assert [s.index for s in B.scenarios_named()] == list(range(8)) and sum(s.primary for s in B.SCENARIOS) == 1
    assert [s.index for s in B.scenarios_named("correlated10_cut20")] == [5]
    with pytest.raises(ValueError):
        B.scenarios_named("flip11")
    assert {s.kind: len(B.eligible(candidates(0.1), s)) for s in B.SCENARIOS} == {"bitflip": 120, "jitter": 113, "correlated": 120}


@pytest.mark.parametrize("name", ["flip20_cut20", "jitter050_cut20", "correlated10_cut20", "flip10_cut15"])
def test_corruption_by_kind(spark, name):
    """Truth is the contacts; the corrupted series are those of the same pairs, drawn by their definition."""
    [s] = B.scenarios_named(name)
    p = _prepared(spark)
    got = B.corrupted(p, s, "test", SOME, FEW).collect()
    xyz = {(r["run_id"], r["frame"]): np.array(r["xyz"]).reshape(8, 3) for r in p.frames.collect()}
    kept = {r["feature_id"]: (r["i"], r["j"]) for r in p.features.where(F.col("cutoff") == s.cutoff).collect()}
    assert len(got) == 2 * 2 * len(kept) and {r["run_id"] for r in got} == {7, 8}
    changed = cells = 0
    for r in got:
        i, j = kept[r["feature_id"]]
        want = [int(np.linalg.norm(xyz[r["run_id"], f][i] - xyz[r["run_id"], f][j]) < C.CUTOFFS[s.cutoff]) for f in range(30)]
        assert list(r["xs"]) == want
        changed += sum(a != b for a, b in zip(r["xs"], r["zs"]))
        cells += 30
    rate = changed / cells
    assert abs(rate - s.level) < 0.03 if s.kind == "bitflip" else 0 < rate < 0.2
    if s.kind == "jitter":  # one deviate for each atom and axis: pairs of one frame move together
        assert len({tuple(r["zs"]) for r in got}) > len(kept)


def test_jitter_is_shared_by_the_pairs_of_an_atom(spark):
    """Contacts after jitter are those of one moved set of coordinates."""
    from flicker.functions.scalars import gaussian, uniform

    [s] = B.scenarios_named("jitter050_cut20")
    p = _prepared(spark)
    key = F.concat_ws("|", N.seed(F.lit(N.PHASES["test"]), FEW.dataset, "run_index", s.index, F.lit(1)), "frame")
    one = p.frames.join(p.split, "run_id").where("run_id = 8").select("frame", F.transform("xyz", lambda v, k: v + F.lit(s.level) * gaussian(uniform(key, F.lit("a"), k), uniform(key, F.lit("b"), k))).alias("m"))
    xyz = {r["frame"]: np.array(r["m"]).reshape(8, 3) for r in one.collect()}
    kept = {r["feature_id"]: (r["i"], r["j"]) for r in p.features.where(F.col("cutoff") == s.cutoff).collect()}
    for r in B.corrupted(p, s, "test", SOME, FEW).where("run_id = 8 and draw = 1").collect():
        i, j = kept[r["feature_id"]]
        assert list(r["zs"]) == [int(np.linalg.norm(xyz[f][i] - xyz[f][j]) < C.CUTOFFS[s.cutoff]) for f in range(30)]


def test_scenario_from_selection_to_summary(spark):
    p = _prepared(spark)
    some = [B.SCENARIOS[0], B.SCENARIOS[3]]
    picked, tested = B.run_scenarios(p, some, SOME, FEW)
    assert {(r["scenario"], r["method"]) for r in picked.collect()} == {(s.name, m.name) for s in some for m in B.eligible(SOME, s)}
    assert tested.groupBy("scenario").agg(F.count_distinct("run_id", "draw").alias("n")).where("n <> 4").isEmpty()
    rows = {r["scenario"]: r for r in B.summary(picked, tested).collect()}
    assert set(rows) == {s.name for s in some}
    for name, r in rows.items():
        best = min((x["score"], M.CONTROLS.index(x["method"]), x["method"]) for x in picked.where(F.col("scenario") == name).collect() if x["method"] in M.CONTROLS)
        assert r["baseline"] == best[2]
        brier = {m: np.mean([np.mean([x["brier"] for x in tested.where((F.col("scenario") == name) & (F.col("method") == m) & (F.col("run_id") == run)).collect()]) for run in (7, 8)]) for m in ("cubic_median", "linear", best[2])}
        assert math.isclose(r["cubic"], brier["cubic_median"]) and math.isclose(r["gain_percent"], 100 * (brier[best[2]] - brier["cubic_median"]) / brier[best[2]], abs_tol=1e-9)
    counts = B.better_counts(B.summary(picked, tested)).first()
    assert counts["scenarios"] == 2 and counts["better_than_linear"] == sum(r["linear_gain_percent"] > 0 for r in rows.values())


def test_a_selection_of_something_else_is_refused(spark):
    p = _prepared(spark)
    selection = B.select_scenario(p, B.SCENARIOS[0], SOME, FEW)
    assert B.test_scenario(p, B.SCENARIOS[0], SOME, selection, FEW).count() > 0
    with pytest.raises(ValueError, match="scenario"):
        B.test_scenario(p, B.SCENARIOS[1], SOME, selection, FEW)
    with pytest.raises(ValueError, match="grid"):
        B.test_scenario(p, B.SCENARIOS[0], SOME[:-1], selection, FEW)
    other = B.Prepared(p.frames, p.split, p.pairs, p.features.where("feature_id > 0").withColumn("frequency", F.col("frequency") + 0.01))
    with pytest.raises(ValueError, match="features"):
        B.test_scenario(other, B.SCENARIOS[0], SOME, selection, FEW)


def test_missing_candidates_are_named(spark):
    p = _prepared(spark)
    scored = B.scenario_scores(p, B.SCENARIOS[0], "validation", SOME[:-1], FEW)
    assert [tuple(r) for r in B.missing_candidates(scored, SOME, B.SCENARIOS[0]).collect()] == [("oracle_debiased_linear", 0)]


# ---------------------------------------------------------------- order, documents, targets


def test_numbering_of_hot_groups_and_ties(spark):
    rows = [("hot", i // 3) for i in range(400)] + [(None, i) for i in range(50)] + [("a", 1)]
    df = spark.createDataFrame(rows, "g string, t long").repartition(5)
    got = numbered(df, ["g"], "t").collect()
    for g in ("hot", None, "a"):
        mine = sorted((r["nth"], r["t"]) for r in got if r["g"] == g)
        assert [n for n, _ in mine] == list(range(len(mine))) and [t for _, t in mine] == sorted(t for _, t in mine)
    assert sorted(r["nth"] for r in numbered(df, [], "t").collect()) == list(range(451))
    assert numbered(df.where("false"), ["g"], "t").count() == 0


def test_hash_split_indexes_all_runs(spark):
    runs = spark.range(1000).select((F.col("id") * 7).alias("run_id"))
    got = hash_split(runs, "run_id", (3, 4, 5)).collect()
    order = sorted(range(0, 7000, 7), key=lambda r: hashlib.sha256(str(r).encode()).hexdigest())
    want = {r: ("discovery" if k < 3 else "validation" if k < 7 else "test", r // 7) for k, r in enumerate(order[:12])}
    assert {r["run_id"]: (r["split"], r["run_index"]) for r in got} == want


def test_flattening_of_nested_documents(spark):
    text = '{"a": {"b": [1, {"c": "x"}, [], [2.5, null]], "seconds": {"d": 1}}, "e": true}'
    flat = I.flatten_json(spark.createDataFrame([(1, text), (2, "7")], "id long, j string"), "id", "j")
    assert sorted(tuple(r) for r in flat.collect()) == sorted([(1, "$.a.b[0]", "number", "1"), (1, "$.a.b[1].c", "string", "x"), (1, "$.a.b[3][0]", "number", "2.5"), (1, "$.a.b[3][1]", "null", None), (1, "$.a.seconds.d", "number", "1"), (1, "$.e", "boolean", "true"), (2, "$", "number", "7")], key=str)
    other = I.flatten_json(spark.createDataFrame([(1, text.replace('"d": 1', '"d": 9').replace("2.5", "2.75"))], "id long, j string"), "id", "j")
    diff = I.structural_diff(flat.where("id = 1"), other, volatile=("seconds",)).collect()
    assert [tuple(r) for r in diff] == [("$.a.b[3][0]", "value", 0.25)]


def test_existing_targets_are_refused_before_any_work(spark, tmp_path):
    (tmp_path / "there").mkdir()
    I.refuse_existing(spark, [str(tmp_path / "new")])
    with pytest.raises(FileExistsError, match="there"):
        I.refuse_existing(spark, [str(tmp_path / "new"), str(tmp_path / "there")])


def test_eligibility_names_the_first_reason(spark):
    rows = [("ok", 30, 1.0, 1.0, 35, 0.3), ("short", 5, 1.0, 1.0, 10, 9.0), ("bent", 30, 1.0, 1.0, 35, 0.9), ("fewer", 30, 1.0, 1.0, 34, 0.3), ("slow", 30, 1.0, 2.0, 35, 0.3), ("unknown", 30, 1.0, 1.0, 35, None)]
    runs = spark.createDataFrame(rows, "run string, frames long, min_dt double, max_dt double, atoms long, max_step double")
    got = {r["run"]: (r["eligible"], r["reason"]) for r in I.eligibility(runs, 20, 1.0, atoms=35, longest_step=0.5).collect()}
    assert got == {"ok": (True, None), "short": (False, "too_few_frames"), "bent": (False, "geometry"), "fewer": (False, "atom_count"), "slow": (False, "cadence"), "unknown": (False, "geometry")}


def test_formats(spark, tmp_path):
    np.savez_compressed(tmp_path / "a.npz", xyz=np.arange(12, dtype=np.float32).reshape(2, 2, 3), flag=np.array([True, False]))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("in/a.pdb", "ATOM")
        z.writestr("../out", "x")
    head = struct.pack("<i4s20ii", 84, b"CORD", 10, 5, 2, *[0] * 17, 84)
    title = b"t" * 80
    (tmp_path / "c.dcd").write_bytes(head + struct.pack("<ii", 84, 1) + title + struct.pack("<iiii", 84, 4, 35, 4))
    npz = {r["array"]: r for r in A.read_npz(A.files(spark, str(tmp_path), "*.npz")).collect()}
    assert npz["xyz"]["shape"] == [2, 2, 3] and npz["xyz"]["values"] == list(map(float, range(12))) and npz["flag"]["values"] == [1.0, 0.0]
    assert {r["member"]: r["safe"] for r in A.read_zip(A.files(spark, str(tmp_path), "*.zip")).collect()} == {"in/a.pdb": True, "../out": False}
    d = A.read_dcd_headers(A.files(spark, str(tmp_path), "*.dcd")).first()
    assert (d["frames"], d["first_step"], d["step_interval"], d["atoms"]) == (10, 5, 2, 35)
    assert A.digests(A.files(spark, str(tmp_path), "*.dcd")).first()["bytes"] == (tmp_path / "c.dcd").stat().st_size
    assert io.BytesIO(b"") is not None


def test_fixed_lag_stream(spark, tmp_path):
    from flicker.streaming.rolling import fixed_lag

    m = method("moving_average", half_width=3)
    x = (np.random.default_rng(2).random(60) < 0.5).astype(int)
    src = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([(1, i, float(x[i])) for i in range(20 * k, 20 * k + 20)], "run_id long, frame long, x double").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("run_id long, frame long, x double").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(src))
    q = fixed_lag(stream, m).writeStream.format("memory").queryName("lagged").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["frame"]: r["y"] for r in spark.table("lagged").collect()}
    whole = convolved(x.astype(float), 0, 0, 60, 60, kernel_weights(*m.kernel))
    assert sorted(got) == list(range(57))
    assert all(math.isclose(got[i], whole[i], abs_tol=1e-12) for i in got)


def test_windowed_stream_equals_batch(spark, tmp_path):
    from flicker.streaming.rolling import EVENTS, windowed_counts

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "e"))
    q = windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = windowed_counts(e)
    assert spark.table("counted").exceptAll(batch).isEmpty() and spark.table("counted").count() == batch.count()
