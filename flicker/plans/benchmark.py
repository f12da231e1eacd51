"""The benchmark as a plan: scenarios, splits, corruption, selection on validation runs only, scoring of test runs, comparison.

Selected parameters are written, with what they were selected on, before any test run is scored, so a test run can't
reach them; scoring refuses a selection that was made on something else.
"""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.methods import Method, halo
from ..operators import contacts as C
from ..operators import metrics as M
from ..operators.noise import PHASES, chained, draws, flipped, moved, seed
from ..operators.series import to_chunks, to_frames
from ..operators.smoothing import error_sums
from ..operators.splits import hash_split
from ..operators.strata import BRIEF, RARE
from ..session import discard, persisted

#: Kinds of corruption whose level is the chance that a cell is flipped: only there is it known to the oracle family.
FLIPPING = ("bitflip", "correlated")
#: Cells of a task, in scenarios.
PIECE = 1 << 22
#: Scenarios that run at once.
ABREAST = 4


@dataclass(frozen=True)
class Scenario:
    """level: chance of a flip, or the width of the jitter in the units of the coordinates."""

    name: str
    kind: str
    level: float
    cutoff: int
    rho: float | None = None
    primary: bool = False
    index: int = 0


def _numbered(*scenarios: Scenario) -> tuple[Scenario, ...]:
    return tuple(replace(s, index=i) for i, s in enumerate(scenarios))


#: Eight scenarios. Cutoff 20 stands for the primary one of 8, 15 and 25 for 7 and 9; jitter widths are scaled alike.
SCENARIOS = _numbered(
    Scenario("flip10_cut20", "bitflip", 0.1, 20, primary=True), Scenario("flip05_cut20", "bitflip", 0.05, 20), Scenario("flip20_cut20", "bitflip", 0.2, 20),
    Scenario("jitter025_cut20", "jitter", 0.25 / 40, 20), Scenario("jitter050_cut20", "jitter", 0.5 / 40, 20), Scenario("correlated10_cut20", "correlated", 0.1, 20, rho=0.8),
    Scenario("flip10_cut15", "bitflip", 0.1, 15), Scenario("flip10_cut25", "bitflip", 0.1, 25),
)


@dataclass(frozen=True)
class Config:
    level: float = 0.1
    scenario: int = 0
    dataset: int = 1
    validation_draws: int = 2
    test_draws: int = 3
    sizes: tuple[int, int, int] = (24, 24, 48)
    chunk_frames: int = 32768


def scenarios_named(name: str = "all") -> list[Scenario]:
    """All scenarios, or the one of a name with the index that it has among all."""
    got = [s for s in SCENARIOS if name in ("all", s.name)]
    if not got:
        raise ValueError(f"unknown scenario {name!r}")
    return got


def eligible(methods: list[Method], scenario: Scenario) -> list[Method]:
    """The methods that a scenario allows: the oracle family only where the noise level is a known flip rate."""
    return [m for m in methods if m.name != "oracle_debiased_linear" or scenario.kind in FLIPPING]


def splits(frames: DataFrame, cfg: Config) -> DataFrame:
    """run_id, split, run_index: by hash order, the rest of the runs left out."""
    return hash_split(frames.select("run_id").distinct(), "run_id", cfg.sizes)


def _runs(split: DataFrame, phase: str) -> DataFrame:
    """run_id, run_index of a phase, to be broadcast: at most as many rows as its size. Left to Spark, frames may be broadcast instead: their files are small, their rows aren't."""
    return F.broadcast(split.where(F.col("split") == phase).select("run_id", "run_index"))


def frequencies(frames: DataFrame, split: DataFrame) -> DataFrame:
    """feature_id, frequency of features that vary in the discovery runs."""
    seen = frames.join(_runs(split, "discovery"), "run_id").groupBy("feature_id").agg(F.sum(F.col("x").cast("long")).alias("p"), F.count("*").alias("n"))
    return seen.where("p > 0 and p < n").select("feature_id", (F.col("p") / F.col("n")).alias("frequency"))


_KEYS = ("run_id", "feature_id", "draw", "frequency")


def _phase_draws(phase: str, cfg: Config) -> int:
    return cfg.validation_draws if phase == "validation" else cfg.test_draws


def phase_sums(frames: DataFrame, split: DataFrame, phase: str, methods: list[Method], cfg: Config, clean: bool = False, timed: bool = False) -> DataFrame:
    """Chunk sums of all methods over the runs of a phase: series are cut into stretches once and corrupted there, each draw once for all methods."""
    runs = frames.join(_runs(split, phase), "run_id").join(frequencies(frames, split), "feature_id")
    keys = ("run_id", "feature_id", "frequency", "run_index")
    chunks = to_chunks(runs, max(halo(methods), BRIEF + 1), cfg.chunk_frames, ("x",), keys)
    chunks = draws(chunks, 1 if clean else _phase_draws(phase, cfg))
    key = seed(F.lit(PHASES[phase]), cfg.dataset, "run_index", cfg.scenario, "draw")
    chunks = chunks.withColumn("zs", F.col("xs")) if clean else flipped(chunks, cfg.level, key)
    return error_sums(chunks, methods, cfg.level, keep=_KEYS, timed=timed).withColumn("rare", F.col("frequency") <= RARE)


def seconds(sums: DataFrame) -> DataFrame:
    """method, candidates, cells and seconds of timed sums: the time that prediction and metrics took inside the tasks."""
    return sums.groupBy("method").agg(F.count_distinct("cand_ord").alias("candidates"), F.sum("cells").cast("long").alias("cells"), F.sum("seconds").alias("seconds"))


def scores(sums: DataFrame, keys: tuple[str, ...] = ("run_id", "draw", "method", "cand_ord")) -> DataFrame:
    """METRICS for each (run, draw, method, candidate)."""
    return M.run_metrics(sums, keys)


def _identity(features: DataFrame, columns: list[str], methods: list[Method], name: str, index: int, about: object) -> DataFrame:
    """One row: digests of the features, the grid and the scenario that a selection is made on."""
    each = F.sha2(F.concat_ws("|", *columns), 256)
    ordered = F.array_join(F.array_sort(F.collect_list(each)), "")  # one hash for each feature
    grid = ";".join(f"{m.name},{m.cand},{m.params}" for m in methods)
    return features.agg(F.sha2(ordered, 256).alias("features_sha256"), F.count("*").alias("features")).withColumns({"grid_sha256": F.sha2(F.lit(grid), 256), "scenario": F.lit(name), "scenario_index": F.lit(index), "scenario_sha256": F.sha2(F.lit(repr(about)), 256)})


def plan_identity(frames: DataFrame, split: DataFrame, methods: list[Method], cfg: Config) -> DataFrame:
    """One row: what the plain plan's selection is made on."""
    return _identity(frequencies(frames, split), ["feature_id", "frequency"], methods, "plain", cfg.scenario, (cfg.level, cfg.scenario, cfg.dataset, cfg.sizes))


def select(frames: DataFrame, split: DataFrame, methods: list[Method], cfg: Config) -> DataFrame:
    """method, cand_ord, score chosen on the validation runs, and the identity; written, then read. Fails if a candidate has no score."""
    scored = persisted(scores(phase_sums(frames, split, "validation", methods, cfg)), "validation")
    picked = _picked(scored, methods, plan_identity(frames, split, methods, cfg), "the plain plan")
    discard(scored)
    return picked


def _picked(scored: DataFrame, methods: list[Method], identity: DataFrame, name: str) -> DataFrame:
    absent = missing_candidates(scored, methods).count()
    if absent:
        raise ValueError(f"{name}: {absent} candidates without a score")
    return persisted(M.best_candidates(scored).join(F.broadcast(identity), F.lit(True)), "selection")  # identity: one row


def chosen(methods: list[Method], selection: DataFrame) -> list[Method]:
    """The selected candidate of each family; at most one row a family comes to the driver."""
    got = {(r["method"], r["cand_ord"]) for r in selection.collect()}
    missing = {m.name for m in methods} - {name for name, _ in got}
    if missing:
        raise ValueError(f"no selection for {sorted(missing)}")
    return [m for m in methods if (m.name, m.cand) in got]


def selection_digest(selection: DataFrame) -> str:
    """A digest of a selection's rows (one for each family), which test results carry."""
    rows = sorted((r["method"], r["cand_ord"], r["score"], r["features_sha256"], r["grid_sha256"], r["scenario_sha256"]) for r in selection.collect())
    return hashlib.sha256(repr(rows).encode()).hexdigest()


def same_t(methods: list[Method], picked: list[Method]) -> Method:
    """The linear candidate with the t of the selected cubic."""
    t = next(m["t"] for m in picked if m.name == "cubic_median")
    return next(m for m in methods if m.name == "linear" and m["t"] == t)


def test_selected(frames: DataFrame, split: DataFrame, methods: list[Method], selection: DataFrame, cfg: Config) -> DataFrame:
    """Scores of the selected candidates, and of linear at the cubic's t, on the test runs, after checking that the selection is this plan's.

    selected tells the candidates that were chosen; selection_sha256 is the digest of what they were chosen by.
    """
    same_identity(selection, plan_identity(frames, split, methods, cfg))
    return _scored_with(scores(phase_sums(frames, split, "test", _with_same_t(methods, selection), cfg)), methods, selection)


def _with_same_t(methods: list[Method], selection: DataFrame) -> list[Method]:
    picked = chosen(methods, selection)
    return list(dict.fromkeys([*picked, same_t(methods, picked)]))


def _scored_with(scored: DataFrame, methods: list[Method], selection: DataFrame) -> DataFrame:
    picked = F.array(*[F.struct(F.lit(m.name).alias("m"), F.lit(m.cand).alias("c")) for m in chosen(methods, selection)])
    here = F.struct(F.col("method").alias("m"), F.col("cand_ord").alias("c"))
    return persisted(scored.withColumns({"selected": F.array_contains(picked, here), "selection_sha256": F.lit(selection_digest(selection))}), "tested")


def baselines(selection: DataFrame) -> dict[str, str]:
    """The control with the smallest validation error: of all families, and of those with as many parameters as the cubic."""
    matched = tuple(f for f in M.CONTROLS if f != "power_full")
    return {"selected": M.best_control(selection).first()["method"], "matched": M.best_control(selection, matched).first()["method"]}


def decisions(tested: DataFrame, selection: DataFrame) -> DataFrame:
    """against (selected or matched), baseline, gain, the conditions and the decision on the selected cubic."""
    own, out = tested.where("selected"), None
    for against, base in baselines(selection).items():
        rule = M.composite(own, base, "cubic_median").select(F.lit(against).alias("against"), F.lit(base).alias("baseline"), "*")
        out = rule if out is None else out.unionByName(rule)
    return out


def same_t_report(tested: DataFrame, methods: list[Method], selection: DataFrame) -> DataFrame:
    """method, t, disagreements and mean error of the selected cubic and of linear at its t, on the same corrupted series."""
    picked = chosen(methods, selection)
    line = same_t(methods, picked)
    rows = tested.where(((F.col("method") == "cubic_median") & F.col("selected")) | ((F.col("method") == "linear") & (F.col("cand_ord") == line.cand)))
    means = M.equal_weight(rows, ("run_id", "method"), ("method",), ("brier",)).select("method", "brier")
    return rows.groupBy("method").agg(F.sum("changed").cast("long").alias("disagreements")).join(means, "method").select("method", F.lit(int(line["t"])).alias("t"), "disagreements", "brier")


# ---------------------------------------------------------------- scenarios over coordinates


@dataclass
class Prepared:
    """Runs of coordinates, ready for any scenario: frames (run_id, frame, xyz), split (run_id, split, run_index), pairs, features."""

    frames: DataFrame
    split: DataFrame
    pairs: DataFrame
    features: DataFrame
    cells: int = 0  # of all frames and pairs


def spread(rows: DataFrame, cells: int, *keys: str) -> DataFrame:
    """rows dealt by keys to a task for each PIECE of so many cells, and to two tasks for each core at least.

    Spark puts small partitions together, but a frame or a stretch of a few bytes is much work: all of it went to one task.
    """
    return rows.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-cells // PIECE)), *keys)


def prepare(frames: DataFrame, split: DataFrame, pairs: DataFrame) -> Prepared:
    """Features of every cutoff are the pairs that vary in the discovery runs; they and the frames are written, the frames in files for many tasks."""
    cells = frames.count() * pairs.count()
    frames = persisted(spread(frames, cells, "run_id", "frame"), "frames")
    seen = frames.join(F.broadcast(split.where("split = 'discovery'").select("run_id")), "run_id")  # the runs of a manifest
    counts = C.contact_counts(C.contacts(C.distances(seen, pairs)), "feature_id", "i", "j")
    kept = counts.where("positives > 0 and positives < frames").select("cutoff", "feature_id", "i", "j", (F.col("positives") / F.col("frames")).alias("frequency"))
    return Prepared(frames, split, pairs, persisted(kept, "features"), cells)


def identity(p: Prepared, methods: list[Method], scenario: Scenario) -> DataFrame:
    """One row: what a selection of a scenario is made on."""
    return _identity(p.features.where(F.col("cutoff") == scenario.cutoff), ["feature_id", "i", "j", "frequency"], methods, scenario.name, scenario.index, scenario)


def corrupted(p: Prepared, scenario: Scenario, phase: str, methods: list[Method], cfg: Config, clean: bool = False) -> DataFrame:
    """Stretches with xs and zs of the features of a scenario for each run and draw of a phase."""
    n = 1 if clean else _phase_draws(phase, cfg)
    features = p.features.where(F.col("cutoff") == scenario.cutoff).drop("cutoff")
    runs = p.frames.join(F.broadcast(p.split.where(F.col("split") == phase).select("run_id", "run_index")), "run_id")
    touch = lambda xyz: (C.distance(xyz) < F.lit(C.CUTOFFS[scenario.cutoff])).cast("tinyint")
    wide, dealt = max(halo(methods), BRIEF + 1), ("run_id", "feature_id", "draw", "lo")
    lengths = p.frames.groupBy("run_id").agg((F.max("frame") + 1).alias("n"))  # all series of a run are of its length
    if scenario.kind == "jitter" and not clean:
        key = F.concat_ws("|", seed(F.lit(PHASES[phase]), cfg.dataset, "run_index", scenario.index, "draw"), "frame")
        both = draws(runs, n).withColumn("moved", moved("xyz", scenario.level, key)).join(F.broadcast(features), F.lit(True))  # the pairs of one molecule
        rows = both.select(*_KEYS, "frame", touch("xyz").alias("x"), touch("moved").alias("z"))  # contacts of the same pairs again
        return spread(to_chunks(rows, wide, cfg.chunk_frames, ("x", "z"), _KEYS, lengths), p.cells * n, *dealt)
    keys = ("run_id", "feature_id", "run_index", "frequency")
    cells = runs.join(F.broadcast(features), F.lit(True)).select(*keys, "frame", touch("xyz").alias("x"))
    key = seed(F.lit(PHASES[phase]), cfg.dataset, "run_index", scenario.index, "draw")
    if scenario.kind == "correlated" and not clean:
        # the chain runs over whole series: over stretches without halos first
        plain = spread(draws(to_chunks(cells, 0, cfg.chunk_frames, ("x",), keys, lengths), n), p.cells * n, *dealt)
        rows = to_frames(chained(plain, scenario.level, scenario.rho, key, ("run_id", "feature_id", "draw")), "xs", "zs", keys=_KEYS)
        return spread(to_chunks(rows.withColumnsRenamed({"xs": "x", "zs": "z"}), wide, cfg.chunk_frames, ("x", "z"), _KEYS, lengths), p.cells * n, *dealt)
    chunks = draws(spread(to_chunks(cells, wide, cfg.chunk_frames, ("x",), keys, lengths), p.cells * n, "run_id", "feature_id", "lo"), n)
    if clean:
        return chunks.withColumn("zs", F.col("xs"))
    if scenario.kind != "bitflip":
        raise ValueError(f"unknown kind of corruption {scenario.kind!r}")
    return flipped(chunks, scenario.level, key)


def scenario_scores(p: Prepared, scenario: Scenario, phase: str, methods: list[Method], cfg: Config, clean: bool = False) -> DataFrame:
    """scenario, scenario_index, run_id, draw, method, cand_ord and METRICS of the eligible methods: scenario x run x draw x candidate."""
    methods = eligible(methods, scenario)
    # clean series are smoothed with the noise level that the selection was made at
    level = scenario.level if scenario.kind in FLIPPING else None
    sums = error_sums(corrupted(p, scenario, phase, methods, cfg, clean), methods, level, keep=_KEYS).withColumn("rare", F.col("frequency") <= RARE)
    return scores(sums).select(F.lit(scenario.name).alias("scenario"), F.lit(scenario.index).alias("scenario_index"), "*")


def missing_candidates(scored: DataFrame, methods: list[Method], scenario: Scenario | None = None) -> DataFrame:
    """method, cand_ord of (a scenario's eligible) candidates that a run or draw has no score of: must be empty."""
    spark = scored.sparkSession
    methods = methods if scenario is None else eligible(methods, scenario)
    grid = spark.createDataFrame([(m.name, m.cand) for m in methods], "method string, cand_ord int")
    slots = scored.select("run_id", "draw").distinct()
    want = slots.join(F.broadcast(grid), F.lit(True))  # the grid: at most 120 rows
    return want.join(scored, ["run_id", "draw", "method", "cand_ord"], "left_anti").select("method", "cand_ord").distinct()


def select_scenario(p: Prepared, scenario: Scenario, methods: list[Method], cfg: Config) -> DataFrame:
    """method, cand_ord, score and the identity of the scenario; written, then read. Fails if a candidate has no score."""
    scored = persisted(scenario_scores(p, scenario, "validation", methods, cfg), "validation")
    picked = _picked(scored, eligible(methods, scenario), identity(p, methods, scenario), scenario.name)
    discard(scored)
    return picked


def same_identity(selection: DataFrame, own: DataFrame) -> None:
    """Fails if a selection was made on other features, another grid or another scenario."""
    fields = own.columns
    other = selection.select(*fields).distinct().exceptAll(own).collect()  # one row if all is well
    if other or selection.isEmpty():
        want = own.first()
        raise ValueError(f"saved selection differs in {[f for f in fields for o in other if o[f] != want[f]]}")


def test_scenario(p: Prepared, scenario: Scenario, methods: list[Method], selection: DataFrame, cfg: Config, clean: bool = False) -> DataFrame:
    """Scores of the selected candidates on the test runs, after checking that the selection is this scenario's."""
    same_identity(selection, identity(p, methods, scenario))
    return scenario_scores(p, scenario, "test", chosen(eligible(methods, scenario), selection), cfg, clean)


def test_selected_scenario(p: Prepared, scenario: Scenario, methods: list[Method], selection: DataFrame, cfg: Config, clean: bool = False) -> DataFrame:
    """As test_selected, of a scenario."""
    same_identity(selection, identity(p, methods, scenario))
    able = eligible(methods, scenario)
    return _scored_with(scenario_scores(p, scenario, "test", _with_same_t(able, selection), cfg, clean), able, selection)


def primary(p: Prepared, scenario: Scenario, methods: list[Method], cfg: Config) -> DataFrame:
    """The final report of a scenario: the decisions on the selected cubic beside its clean control and the coverage of the features.

    Everything is chosen on validation runs and written before a test run is scored; the clean control isn't tuned anew.
    """
    selection = select_scenario(p, scenario, methods, cfg)
    ruled = decisions(test_selected_scenario(p, scenario, methods, selection, cfg), selection)
    clean = M.equal_weight(test_selected_scenario(p, scenario, methods, selection, cfg, clean=True).where("selected"), ("run_id", "method"), ("method",), ("brier",))
    clean = clean.agg(F.map_from_entries(F.collect_list(F.struct("method", "brier"))).alias("clean"))  # a row for each family
    test = p.frames.join(F.broadcast(p.split.where("split = 'test'").select("run_id")), "run_id")  # the runs of a manifest
    counts = C.contact_counts(C.contacts(C.distances(test, p.pairs), {scenario.cutoff: C.CUTOFFS[scenario.cutoff]}), "feature_id")
    kept = p.features.where(F.col("cutoff") == scenario.cutoff).select("feature_id", F.lit(True).alias("kept"))
    covered = counts.join(kept, "feature_id", "left").agg((F.sum(F.when(F.col("kept"), F.col("positives"))) / F.sum("positives")).alias("selected_fraction"))
    both = ruled.join(F.broadcast(clean), F.lit(True)).join(F.broadcast(covered), F.lit(True))  # one row each
    at = lambda m: F.element_at("clean", m)
    return both.select("against", "baseline", "gain", "decision", at(F.lit("cubic_median")).alias("clean_cubic"), at(F.col("baseline")).alias("clean_baseline"), "selected_fraction")


def run_scenarios(p: Prepared, scenarios: list[Scenario], methods: list[Method], cfg: Config) -> tuple[DataFrame, DataFrame]:
    """Selections and test scores of several scenarios, as rows. No scenario needs another one, so ABREAST of them are planned and run at once."""

    def one(s: Scenario) -> tuple[DataFrame, DataFrame]:
        selection = select_scenario(p, s, methods, cfg)
        return selection, persisted(test_scenario(p, s, methods, selection, cfg), "tested")

    with ThreadPoolExecutor(ABREAST) as pool:
        picked, scored = zip(*pool.map(one, scenarios), strict=True)
    return reduce(DataFrame.unionByName, picked), reduce(DataFrame.unionByName, scored)


def summary(selection: DataFrame, tested: DataFrame) -> DataFrame:
    """For each scenario: the controls chosen on validation runs, the cubic's mean error and its gains over them and over linear, in percent."""
    means = M.equal_weight(tested, ("scenario", "scenario_index", "run_id", "method"), ("scenario", "scenario_index", "method"), ("brier",))
    value = lambda m: F.max(F.when(F.col("method") == m, F.col("brier")))
    wide = means.groupBy("scenario", "scenario_index").agg(value("cubic_median").alias("cubic"), value("linear").alias("linear"), F.map_from_entries(F.collect_list(F.struct("method", "brier"))).alias("by_method"))
    full = M.best_control(selection, by="scenario").select("scenario", F.col("method").alias("baseline"))
    matched = M.best_control(selection, tuple(f for f in M.CONTROLS if f != "power_full"), by="scenario").select("scenario", F.col("method").alias("matched_baseline"))
    rows = wide.join(full, "scenario").join(matched, "scenario")
    gain = lambda base: F.lit(100.0) * (base - F.col("cubic")) / F.nullif(base, F.lit(0.0))
    base = F.element_at("by_method", F.col("baseline"))
    return rows.select("scenario", "scenario_index", "baseline", "matched_baseline", "cubic", "linear", base.alias("baseline_brier"), gain(base).alias("gain_percent"), gain(F.element_at("by_method", F.col("matched_baseline"))).alias("matched_gain_percent"), gain(F.col("linear")).alias("linear_gain_percent"))


def better_counts(summed: DataFrame) -> DataFrame:
    """Over how many scenarios the cubic is better than linear, and than the chosen control."""
    return summed.agg(F.count("*").alias("scenarios"), F.count_if(F.col("linear_gain_percent") > 0).alias("better_than_linear"), F.count_if(F.col("gain_percent") > 0).alias("better_than_baseline"))
