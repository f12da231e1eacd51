"""Queries over the benchmark: minimum slice, metrics, selection, paired comparison, decision, summary."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.methods import CONTROLS, candidates, halo, method
from ..functions.scalars import T_975, ratio
from ..operators import metrics as M
from ..operators import noise as N
from ..operators import series as S
from ..operators import smoothing as H
from ..operators import strata as R
from ..operators.order import numbered
from ..plans import benchmark as B
from ..registry import query
from ..session import persisted, table
from . import sqltext as Q

LEVEL = 0.1
CFG = B.Config(level=LEVEL)
#: The reference's job: 120 candidates, 8 validation and 16 test draws. The queries whole_... and test_of_selected run it, without SQL.
WHOLE = candidates(LEVEL)
WHOLE_CFG = B.Config(level=LEVEL, validation_draws=8, test_draws=16)
#: A grid small enough for the SQL check; the queries beside SQL run it.
GRID = [
    method("raw"), *[method("linear", i, t=t) for i, t in enumerate((1, 4, 16))], *[method("cubic_median", i, t=t) for i, t in enumerate((1, 4, 16))],
    *[method("moving_average", i, half_width=w) for i, w in enumerate((1, 4))], method("gaussian", 0, sigma=2.0), *[method("median", i, width=w) for i, w in enumerate((3, 9))],
    *[method("hard_linear", i, t=t) for i, t in enumerate((1, 4))], *[method("power_full", i, t=4, alpha=a) for i, a in enumerate((1.5, 3.0))], method("power_matched", 0, t=4),
    method("oracle_debiased_linear", 0, t=4),
]

# ---------------------------------------------------------------- minimum slice

_SLICE = method("cubic_median", t=16)


@query(
    "metrics_minimum_slice",
    f"""WITH {Q.SERIES}, s AS (SELECT ev.run_id, frame, x, n, CASE WHEN {Q.uniform("concat_ws('|', 20261007, 1, 1, run_id, 0, 0)", '0', 'frame')} < 0.1 THEN 1 - x ELSE x END AS z FROM ev JOIN nn USING (run_id)
), {Q.kernels([_SLICE])}, {Q.convolved("s", "z")}, p AS (SELECT run_id, frame, {Q.shaped(_SLICE, LEVEL)} AS p FROM h
), r AS (SELECT p.run_id, avg((p - x) * (p - x)) AS brier, avg(abs(p - x)) AS mae, count(*) FILTER (round(p, 12) >= 0.5 AND x = 1) AS tp, count(*) FILTER (round(p, 12) >= 0.5 AND x = 0) AS fp, count(*) FILTER (round(p, 12) < 0.5 AND x = 1) AS fn, count(*) AS cells
  FROM p JOIN s ON s.run_id = p.run_id AND s.frame = p.frame GROUP BY p.run_id)
SELECT count(*) AS runs, CAST(sum(cells) AS BIGINT) AS cells, round(avg(brier), 9) AS brier, round(avg(mae), 9) AS mae, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM r""",
)
def metrics_minimum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to series, 10 % flips, resolvent, cubic, errors of each run, mean over runs."""
    frames = S.event_frames(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"))
    chunks = N.flipped(S.to_chunks(frames, halo([_SLICE])), LEVEL, N.seed(F.lit(1), 1, "run_id", 0, F.lit(0)))
    sums = H.error_sums(chunks, [_SLICE])
    runs = sums.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("cells", "sum_sq", "sum_abs", "tp", "fp", "fn")])
    whole = [F.sum(c).cast("long").alias(c) for c in ("cells", "tp", "fp", "fn")]
    return runs.agg(F.count("*").alias("runs"), F.round(F.avg(F.col("sum_sq") / F.col("cells")), 9).alias("brier"), F.round(F.avg(F.col("sum_abs") / F.col("cells")), 9).alias("mae"), *whole).select("runs", "cells", "brier", "mae", "tp", "fp", "fn")


# ---------------------------------------------------------------- splits, features and corrupted cells in SQL

_SPLIT = """ru AS (SELECT DISTINCT user_id AS run_id FROM events
), sp AS (SELECT run_id, CAST(row_number() OVER (ORDER BY run_id) - 1 AS BIGINT) AS run_index, row_number() OVER (ORDER BY sha256(CAST(run_id AS VARCHAR))) AS place FROM ru
), split AS (SELECT run_id, run_index, CASE WHEN place <= 24 THEN 'discovery' WHEN place <= 48 THEN 'validation' WHEN place <= 96 THEN 'test' END AS split FROM sp WHERE place <= 96)"""
_FEATURES = """fx AS (
  SELECT run_id, frame, f.feature_id, CASE f.feature_id WHEN 0 THEN x WHEN 1 THEN CASE WHEN value > 150 THEN 1 ELSE 0 END ELSE CASE WHEN event_type = 'error' THEN 1 ELSE 0 END END AS x
  FROM ev CROSS JOIN (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT))) f(feature_id)
), fq AS (SELECT feature_id, sum(fx.x) / count(*) AS frequency FROM fx JOIN split USING (run_id) WHERE split = 'discovery' GROUP BY feature_id HAVING sum(fx.x) > 0 AND sum(fx.x) < count(*))"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three features of every run: clicks and purchases, high values (rare), errors."""
    bits = F.array(F.col("event_type").isin("click", "purchase"), F.col("value") > 150, F.col("event_type") == "error")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", bits.alias("bits"))
    framed = persisted(numbered(e, ["run_id"], "ts", "event_id", name="frame").select("run_id", "frame", "bits"), "frames")
    rows = framed.select("run_id", "frame", F.posexplode("bits").alias("feature_id", "x"))
    return rows.select("run_id", F.col("feature_id").cast("long").alias("feature_id"), "frame", F.col("x").cast("tinyint").alias("x"))


def _cells(phase: str, draws: int, methods=None, clean: bool = False) -> str:
    number = {"validation": 1, "test": 2}[phase]
    flip = Q.uniform(f"concat_ws('|', 20261007, {number}, 1, run_index, 0, draw)", "feature_id", "frame")
    z = "x" if clean else f"CASE WHEN {flip} < 0.1 THEN 1 - x ELSE x END"
    methods = GRID if methods is None else methods
    return f"""{Q.SERIES}, {_SPLIT}, {_FEATURES}, s AS (
  SELECT fx.run_id, fx.feature_id, frame, fx.x, draw, nn.n, frequency, {z} AS z FROM fx JOIN split USING (run_id) JOIN fq USING (feature_id) JOIN nn USING (run_id) CROSS JOIN (SELECT CAST(unnest(range({draws})) AS INTEGER) AS draw) WHERE split = '{phase}'
), {Q.kernels(methods)}, {Q.convolved("s", "z", "run_id, feature_id, draw")}, {Q.methods_union(methods, LEVEL, "run_id, feature_id, draw")}"""


_STRATA = """is1 AS (SELECT run_id, feature_id, draw, frame, x, n, frame - row_number() OVER (PARTITION BY run_id, feature_id, draw, x ORDER BY frame) AS g FROM s
), st AS (SELECT *, x = 1 AND count(*) OVER i <= 3 AND min(frame) OVER i > 0 AND max(frame) OVER i < n - 1 AS brief,
  coalesce(x <> lag(x) OVER w, false) OR coalesce(x <> lead(x) OVER w, false) AS edge FROM is1 WINDOW i AS (PARTITION BY run_id, feature_id, draw, x, g), w AS (PARTITION BY run_id, feature_id, draw ORDER BY frame)
), c AS (SELECT p.*, st.x, brief, edge, frequency <= 0.1 AS rare, round(p, 12) >= 0.5 AS hit, round(h, 12) >= 0.5 AS base FROM p JOIN st USING (run_id, feature_id, draw, frame) JOIN fq USING (feature_id))"""
_METRICS = """oc AS (SELECT run_id, draw, method, cand_ord, feature_id, abs(avg(p) - avg(x)) AS o FROM c GROUP BY ALL
), om AS (SELECT run_id, draw, method, cand_ord, avg(o) AS occupancy_mae FROM oc GROUP BY ALL
), m AS (SELECT run_id, draw, method, cand_ord, avg((p - x) * (p - x)) AS brier, avg(abs(p - x)) AS mae, avg(p - x) AS occupancy_signed_bias,
  count(*) FILTER (hit AND x = 1) AS tp, count(*) FILTER (hit AND x = 0) AS fp, count(*) FILTER (NOT hit AND x = 1) AS fn,
  avg((p - x) * (p - x)) FILTER (rare) AS rare_brier, avg(hit::INT) FILTER (rare AND x = 1) AS rare_positive_recall, avg(hit::INT) FILTER (brief) AS short_positive_recall, avg((p - x) * (p - x)) FILTER (edge) AS transition_brier,
  count(*) FILTER (hit <> base) AS changed FROM c GROUP BY ALL
), rm AS (SELECT m.*, occupancy_mae, tp / nullif(tp + fp, 0) AS "precision", tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM m JOIN om USING (run_id, draw, method, cand_ord))"""
_ROUNDED = ", ".join(f'round("{m}", 9) AS "{m}"' for m in M.METRICS)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query("hash_split_cap", f"WITH {_SPLIT} SELECT run_id, run_index, split FROM split")
def hash_split_cap(spark, sf_dir):
    return B.splits(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id")), CFG)


@query("discovery_frequency", f"WITH {Q.SERIES}, {_SPLIT}, {_FEATURES} SELECT feature_id, round(frequency, 9) AS frequency FROM fq")
def discovery_frequency(spark, sf_dir):
    f = _frames(spark, sf_dir)
    return _rounded(B.frequencies(f, B.splits(f, CFG)), "frequency")


@query("metrics_all", f"WITH {_cells('test', 1)}, {_STRATA}, {_METRICS} SELECT run_id, method, cand_ord, {_ROUNDED} FROM rm")
def metrics_all(spark, sf_dir, grid=GRID, cfg=B.Config(level=LEVEL, test_draws=1)):
    """All eleven metrics of every candidate of the grid, for each test run."""
    f = _frames(spark, sf_dir)
    sums = B.phase_sums(f, B.splits(f, cfg), "test", grid, cfg)
    draw = ["draw"] * (cfg.test_draws > 1)
    return _rounded(B.scores(sums).select("run_id", *draw, "method", "cand_ord", *M.METRICS), *M.METRICS)


_EQUAL = f"""w AS (SELECT run_id, method, cand_ord, {', '.join(f'avg("{m}") AS "{m}"' for m in M.METRICS)} FROM rm GROUP BY ALL)"""


@query(
    "equal_weight_rollup",
    f"""WITH {_cells('test', 2)}, {_STRATA}, {_METRICS}, {_EQUAL} SELECT method, cand_ord, {', '.join(f'round(avg("{m}"), 9) AS "{m}", count("{m}") AS n_{m}' for m in M.METRICS)} FROM w GROUP BY method, cand_ord""",
)
def equal_weight_rollup(spark, sf_dir, grid=GRID, cfg=B.Config(level=LEVEL, test_draws=2)):
    f = _frames(spark, sf_dir)
    runs = B.scores(B.phase_sums(f, B.splits(f, cfg), "test", grid, cfg))
    return _rounded(M.equal_weight(runs, ("run_id", "method", "cand_ord"), ("method", "cand_ord")), *M.METRICS)


@query(
    "cell_vs_run_weight",
    f"""WITH {_cells('test', 1)}, {_STRATA}, {_METRICS}, k AS (SELECT method, cand_ord, round(avg((p - x) * (p - x)), 9) AS cell_weighted FROM c GROUP BY ALL)
SELECT method, cand_ord, round(avg(brier), 9) AS run_weighted, max(cell_weighted) AS cell_weighted FROM rm JOIN k USING (method, cand_ord) GROUP BY method, cand_ord""",
)
def cell_vs_run_weight(spark, sf_dir, grid=GRID, cfg=B.Config(level=LEVEL, test_draws=1)):
    f = _frames(spark, sf_dir)
    runs = B.scores(B.phase_sums(f, B.splits(f, cfg), "test", grid, cfg))
    return runs.groupBy("method", "cand_ord").agg(F.round(F.avg("brier"), 9).alias("run_weighted"), F.round(F.sum(F.col("brier") * F.col("cells")) / F.sum("cells"), 9).alias("cell_weighted"))


# ---------------------------------------------------------------- selection and comparison

_ORDER = "[" + ", ".join(f"'{c}'" for c in CONTROLS) + "]"
_SELECT = """sc AS (SELECT method, cand_ord, round(avg(brier), 12) AS score FROM rm GROUP BY ALL
), best AS (SELECT method, cand_ord, score FROM sc QUALIFY row_number() OVER (PARTITION BY method ORDER BY score, cand_ord) = 1)"""


def _selection(spark, sf_dir, grid, cfg):
    f = _frames(spark, sf_dir)
    split = B.splits(f, cfg)
    return f, split, B.select(f, split, grid, cfg)


@query("select_params", f"WITH {_cells('validation', 2)}, {_STRATA}, {_METRICS}, {_SELECT} SELECT method, cand_ord, round(score, 9) AS score FROM best")
def select_params(spark, sf_dir, grid=GRID, cfg=CFG):
    return _rounded(_selection(spark, sf_dir, grid, cfg)[2].select("method", "cand_ord", "score"), "score")


def _control_sql(families: tuple[str, ...]) -> str:
    order = "[" + ", ".join(f"'{c}'" for c in families) + "]"
    return f"WITH {_cells('validation', 2)}, {_STRATA}, {_METRICS}, {_SELECT} SELECT method, cand_ord, round(score, 9) AS score FROM best WHERE list_contains({order}, method) ORDER BY best.score, list_position({order}, method) LIMIT 1"


@query("select_baseline", _control_sql(CONTROLS))
def select_baseline(spark, sf_dir, grid=GRID, cfg=CFG):
    return _rounded(M.best_control(_selection(spark, sf_dir, grid, cfg)[2]), "score")


_MATCHED = tuple(c for c in CONTROLS if c != "power_full")


@query("matched_baseline", _control_sql(_MATCHED))
def matched_baseline(spark, sf_dir, grid=GRID, cfg=CFG):
    return _rounded(M.best_control(_selection(spark, sf_dir, grid, cfg)[2], _MATCHED), "score")


_PAIR = [method("linear", 1, t=4), method("cubic_median", 1, t=4)]
_TVALUES = ", ".join(f"({i + 1}, {t!r}::DOUBLE)" for i, t in enumerate(T_975))
_PAIRED = f"""pr AS (SELECT run_id, draw, max(brier) FILTER (method = 'linear') AS b, max(brier) FILTER (method = 'cubic_median') AS o FROM rm GROUP BY ALL
), pa AS (SELECT run_id, count(*) AS n, avg(b - o) AS mean_diff, stddev_samp(b - o) AS sd, avg(b) AS base_mean, count(*) FILTER (b > o) AS positive, count(*) FILTER (b < o) AS negative FROM pr GROUP BY run_id
), iv AS (SELECT run_id, n, mean_diff, q * sd / sqrt(n) AS half_width, CASE WHEN base_mean > 0 THEN mean_diff / base_mean END AS relative_gain, positive, negative FROM pa LEFT JOIN (VALUES {_TVALUES}) t(df, q) ON df = n - 1)"""


def _pair_runs(spark, sf_dir, cfg):
    f = _frames(spark, sf_dir)
    return B.scores(B.phase_sums(f, B.splits(f, cfg), "test", _PAIR, cfg))


@query("paired_interval", f"WITH {_cells('test', 3, _PAIR)}, {_STRATA}, {_METRICS}, {_PAIRED} SELECT run_id, n, round(mean_diff, 9) AS mean_diff, round(half_width, 9) AS half_width, round(relative_gain, 9) AS relative_gain, positive, negative FROM iv")
def paired_interval(spark, sf_dir, cfg=CFG):
    return _rounded(M.paired(_pair_runs(spark, sf_dir, cfg), "linear", "cubic_median"), "mean_diff", "half_width", "relative_gain")


#: The composite rule over rows cm (case, run_id, method, brier, rare, brief; one for each draw) of methods b and o.
_COMPOSITE = """cpr AS (SELECT k, run_id, avg(brier) FILTER (method = 'b') AS bb, avg(brier) FILTER (method = 'o') AS ob, avg(rare) FILTER (method = 'b') AS br, avg(rare) FILTER (method = 'o') AS orr,
  avg(brief) FILTER (method = 'b') AS bs, avg(brief) FILTER (method = 'o') AS os FROM cm GROUP BY k, run_id
), agg AS (SELECT k, CASE WHEN avg(bb) > 0 THEN (avg(bb) - avg(ob)) / avg(bb) END AS gain, min(CASE WHEN bb > ob THEN 1 ELSE 0 END) AS gains,
  CASE WHEN count(*) FILTER (br IS NULL OR orr IS NULL) = 0 THEN count(*) FILTER (br - orr > 0.02) = 0 END AS rare_kept, CASE WHEN count(*) FILTER (bs IS NULL OR os IS NULL) = 0 THEN count(*) FILTER (bs - os > 0.02) = 0 END AS brief_kept FROM cpr GROUP BY k
), ruled AS (SELECT k, gain, CASE WHEN gain IS NULL OR rare_kept IS NULL OR brief_kept IS NULL THEN 'not_evaluable' WHEN gain >= 0.02 AND gains = 1 AND rare_kept AND brief_kept THEN 'pass' ELSE 'fail' END AS decision FROM agg)"""


@query(
    "composite_decision",
    f"""WITH {_cells('test', 3, _PAIR)}, {_STRATA}, {_METRICS}, cm AS (SELECT 0 AS k, run_id, CASE method WHEN 'linear' THEN 'b' ELSE 'o' END AS method, brier, rare_positive_recall AS rare, short_positive_recall AS brief FROM rm
), {_COMPOSITE} SELECT round(gain, 9) AS gain, decision FROM ruled""",
)
def composite_decision(spark, sf_dir, cfg=CFG):
    """The cubic against linear at the same t: gain, every run's gain and every run's recalls."""
    got = M.composite(_pair_runs(spark, sf_dir, cfg), "linear", "cubic_median")
    return got.select(F.round("gain", 9).alias("gain"), "decision")


#: Cases by name: values of (brier, rare, brief) in each of three runs for the base and the other method.
_CASES = {
    "all_kept": [((0.30, 0.50, 0.40), (0.25, 0.49, 0.39)), ((0.20, 0.60, 0.45), (0.18, 0.60, 0.50)), ((0.25, 0.55, 0.50), (0.21, 0.54, 0.49))],
    "small_gain": [((0.300, 0.50, 0.40), (0.297, 0.50, 0.40)), ((0.200, 0.60, 0.45), (0.198, 0.60, 0.45)), ((0.250, 0.55, 0.50), (0.248, 0.55, 0.50))],
    "one_run_loses": [((0.30, 0.50, 0.40), (0.20, 0.50, 0.40)), ((0.20, 0.60, 0.45), (0.205, 0.60, 0.45)), ((0.25, 0.55, 0.50), (0.21, 0.55, 0.50))],
    "one_run_forgets_rare": [((0.30, 0.50, 0.40), (0.25, 0.90, 0.40)), ((0.20, 0.60, 0.45), (0.18, 0.57, 0.45)), ((0.25, 0.55, 0.50), (0.21, 0.55, 0.50))],
    "one_run_without_brief": [((0.30, 0.50, 0.40), (0.25, 0.50, 0.40)), ((0.20, 0.60, None), (0.18, 0.60, None)), ((0.25, 0.55, 0.50), (0.21, 0.55, 0.50))],
    "unknown_beside_failure": [((0.30, None, 0.40), (0.31, None, 0.40)), ((0.20, 0.60, 0.45), (0.28, 0.10, 0.05)), ((0.25, 0.55, 0.50), (0.31, 0.55, 0.50))],
    "zero_base": [((0.0, 0.50, 0.40), (0.0, 0.50, 0.40)), ((0.0, 0.60, 0.45), (0.0, 0.60, 0.45)), ((0.0, 0.55, 0.50), (0.0, 0.55, 0.50))],
}
_CASE_ROWS = [(k, r, m, *v) for k, runs in _CASES.items() for r, both in enumerate(runs) for m, v in zip("bo", both)]
_shown = lambda v: "NULL::DOUBLE" if v is None else f"{v!r}::DOUBLE"
_CASE_VALUES = ", ".join(f"('{k}', {r}, '{m}', {', '.join(map(_shown, v))})" for k, r, m, *v in _CASE_ROWS)


@query("decision_cases", f"WITH cm AS (SELECT * FROM (VALUES {_CASE_VALUES}) t(k, run_id, method, brier, rare, brief)), {_COMPOSITE} SELECT k AS name, decision FROM ruled")
def decision_cases(spark, sf_dir):
    rows = spark.createDataFrame(_CASE_ROWS, "name string, run_id int, method string, brier double, rare_positive_recall double, short_positive_recall double")
    return M.composite(rows, "b", "o", by=("name",)).select("name", "decision")


@query("same_t_attribution", f"WITH {_cells('test', 3, _PAIR)}, {_STRATA}, {_METRICS} SELECT method, CAST(sum(changed) AS BIGINT) AS disagreements, round(avg(brier), 9) AS brier FROM rm GROUP BY method")
def same_t_attribution(spark, sf_dir, cfg=CFG):
    """Linear and cubic at the same t on the same corrupted series; cells where they classify differently."""
    return _pair_runs(spark, sf_dir, cfg).groupBy("method").agg(F.sum("changed").cast("long").alias("disagreements"), F.round(F.avg("brier"), 9).alias("brier"))


@query("clean_control", f"WITH {_cells('test', 1, clean=True)}, {_STRATA}, {_METRICS} SELECT method, cand_ord, round(avg(brier), 9) AS brier, round(avg(mae), 9) AS mae FROM rm GROUP BY method, cand_ord")
def clean_control(spark, sf_dir, grid=GRID, cfg=CFG):
    f = _frames(spark, sf_dir)
    runs = B.scores(B.phase_sums(f, B.splits(f, cfg), "test", grid, cfg, clean=True))
    return runs.groupBy("method", "cand_ord").agg(F.round(F.avg("brier"), 9).alias("brier"), F.round(F.avg("mae"), 9).alias("mae"))


@query(
    "test_of_selected_small",
    f"""SELECT t.* FROM (WITH {_cells('test', 3)}, {_STRATA}, {_METRICS}, {_EQUAL} SELECT method, cand_ord, {', '.join(f'round(avg("{m}"), 9) AS "{m}", count("{m}") AS n_{m}' for m in M.METRICS)} FROM w GROUP BY method, cand_ord) t
JOIN (WITH {_cells('validation', 2)}, {_STRATA}, {_METRICS}, {_SELECT} SELECT method, cand_ord FROM best) b ON b.method = t.method AND b.cand_ord = t.cand_ord""",
)
def test_of_selected_small(spark, sf_dir):
    """test_of_selected on the small grid."""
    return test_of_selected(spark, sf_dir, GRID, CFG)


@query("test_of_selected", None)
def test_of_selected(spark, sf_dir, grid=WHOLE, cfg=WHOLE_CFG):
    """The whole plan: selection is written, then the selected candidates are scored on the test runs (checked by tests)."""
    runs = _tested(spark, sf_dir, grid, cfg)[1].where("selected")
    return _rounded(M.equal_weight(runs, ("run_id", "method", "cand_ord"), ("method", "cand_ord")), *M.METRICS)


def _tested(spark, sf_dir, grid, cfg):
    """The selection, and the test scores of what was selected."""
    f, split, selection = _selection(spark, sf_dir, grid, cfg)
    return selection, B.test_selected(f, split, grid, selection, cfg)


def _selected_sql(draws: int) -> str:
    """picks(method, cand_ord, score): chosen on validation runs; sel: their metrics on the test runs; bases(against, baseline)."""
    base = lambda order: f"(SELECT method FROM picks WHERE list_contains({order}, method) ORDER BY score, list_position({order}, method) LIMIT 1)"
    short = "[" + ", ".join(f"'{c}'" for c in _MATCHED) + "]"
    return f"""picks AS MATERIALIZED (SELECT * FROM (WITH {_cells('validation', 2)}, {_STRATA}, {_METRICS}, {_SELECT} SELECT method, cand_ord, score FROM best)
), tests AS MATERIALIZED (SELECT * FROM (WITH {_cells('test', draws)}, {_STRATA}, {_METRICS} SELECT * FROM rm)
), sel AS MATERIALIZED (SELECT t.* FROM tests t JOIN picks b ON b.method = t.method AND b.cand_ord = t.cand_ord
), bases AS MATERIALIZED (SELECT 'selected' AS against, {base(_ORDER)} AS baseline UNION ALL SELECT 'matched', {base(short)})"""


@query(
    "decision_of_selected",
    f"""WITH {_selected_sql(3)}, cm AS (SELECT against AS k, run_id, CASE method WHEN baseline THEN 'b' ELSE 'o' END AS method, brier, rare_positive_recall AS rare, short_positive_recall AS brief FROM sel JOIN bases ON method IN (baseline, 'cubic_median')
), {_COMPOSITE} SELECT k AS against, baseline, round(gain, 9) AS gain, decision FROM ruled JOIN bases ON against = k""",
)
def decision_of_selected(spark, sf_dir, grid=GRID, cfg=CFG):
    """The selected cubic against the control that validation runs chose, and against the best one with as many parameters."""
    selection, tested = _tested(spark, sf_dir, grid, cfg)
    return _rounded(B.decisions(tested, selection).select("against", "baseline", "gain", "decision"), "gain")


@query(
    "paired_all_methods",
    f"""WITH {_selected_sql(3)}, o AS (SELECT run_id, draw, brier FROM sel WHERE method = 'cubic_median'
), pa AS (SELECT s.method AS base, s.run_id, count(*) AS n, avg(s.brier - o.brier) AS mean_diff, stddev_samp(s.brier - o.brier) AS sd, avg(s.brier) AS base_mean, count(*) FILTER (s.brier > o.brier) AS positive, count(*) FILTER (s.brier < o.brier) AS negative
  FROM sel s JOIN o ON o.run_id = s.run_id AND o.draw = s.draw WHERE s.method <> 'cubic_median' GROUP BY ALL)
SELECT base, run_id, n, round(mean_diff, 9) AS mean_diff, round(q * sd / sqrt(n), 9) AS half_width, round(CASE WHEN base_mean > 0 THEN mean_diff / base_mean END, 9) AS relative_gain, positive, negative FROM pa LEFT JOIN (VALUES {_TVALUES}) t(df, q) ON df = n - 1""",
)
def paired_all_methods(spark, sf_dir, grid=GRID, cfg=CFG):
    """Intervals of the selected cubic against every other family's selected candidate, for each test run."""
    tested = _tested(spark, sf_dir, grid, cfg)[1].where("selected")
    return _rounded(M.paired_with_all(tested, "cubic_median"), "mean_diff", "half_width", "relative_gain")


_SAME_T = ", ".join(f"({c.cand}, {next(m.cand for m in GRID if m.name == 'linear' and m['t'] == c['t'])}, {int(c['t'])})" for c in GRID if c.name == "cubic_median")


@query(
    "same_t_of_selected",
    f"""WITH {_selected_sql(3)}, st AS (SELECT c AS cubic, l AS linear, tt FROM (VALUES {_SAME_T}) v(c, l, tt) JOIN picks ON method = 'cubic_median' AND cand_ord = c
), w AS (SELECT method, run_id, avg(brier) AS brier, sum(changed) AS changed FROM tests JOIN st ON (method = 'cubic_median' AND cand_ord = cubic) OR (method = 'linear' AND cand_ord = linear) GROUP BY ALL)
SELECT method, CAST(max(tt) AS INTEGER) AS t, CAST(sum(changed) AS BIGINT) AS disagreements, round(avg(brier), 9) AS brier FROM w CROSS JOIN st GROUP BY method""",
)
def same_t_of_selected(spark, sf_dir, grid=GRID, cfg=CFG):
    """The selected cubic and linear at the same t, whatever t linear itself was selected with."""
    selection, tested = _tested(spark, sf_dir, grid, cfg)
    return _rounded(B.same_t_report(tested, grid, selection), "brier")


@query(
    "summary_table",
    f"""WITH {_selected_sql(1)}, g AS (SELECT method, avg(brier) AS brier FROM sel GROUP BY method)
SELECT method, round(brier, 9) AS brier, round(100 * ((SELECT brier FROM g WHERE method = 'raw') - brier) / (SELECT brier FROM g WHERE method = 'raw'), 6) AS gain_percent, brier < (SELECT brier FROM g WHERE method = 'linear') AS better_than_linear FROM g""",
)
def summary_table(spark, sf_dir, grid=GRID, cfg=B.Config(level=LEVEL, test_draws=1)):
    """Every family's error on the test runs, with the candidate that validation runs chose."""
    g = M.equal_weight(_tested(spark, sf_dir, grid, cfg)[1].where("selected"), ("run_id", "method"), ("method",), ("brier",))
    ref = g.agg(F.max(F.when(F.col("method") == "raw", F.col("brier"))).alias("raw"), F.max(F.when(F.col("method") == "linear", F.col("brier"))).alias("linear"))
    both = g.join(F.broadcast(ref), F.lit(True))  # one row
    return both.select("method", F.round("brier", 9).alias("brier"), F.round(100 * ratio(F.col("raw") - F.col("brier"), F.col("raw")), 6).alias("gain_percent"), (F.col("brier") < F.col("linear")).alias("better_than_linear"))


def _grid_sql() -> str:
    rows = [f"({i}, '{m.name}', {m.cand}, {m['t'] or 'NULL'}, {m['alpha'] or 'NULL'}, {m['half_width'] or 'NULL'}, {m['sigma'] or 'NULL'}, {m['width'] or 'NULL'})" for i, m in enumerate(WHOLE)]
    cells = lambda phase: f"(SELECT count(*) FROM fx JOIN split USING (run_id) JOIN fq USING (feature_id) WHERE split = '{phase}')"
    return f"WITH {Q.SERIES}, {_SPLIT}, {_FEATURES} SELECT CAST(c.place AS INTEGER) AS place, c.method, CAST(c.cand_ord AS INTEGER) AS cand_ord, CAST(t AS INTEGER) AS t, CAST(alpha AS DOUBLE) AS alpha, CAST(half_width AS INTEGER) AS half_width, CAST(sigma AS DOUBLE) AS sigma, CAST(width AS INTEGER) AS width, {cells('validation')} AS validation_cells, {cells('test')} AS test_cells FROM (VALUES " + ", ".join(rows) + ") c(place, method, cand_ord, t, alpha, half_width, sigma, width)"


@query("candidate_grid", _grid_sql())
def candidate_grid(spark, sf_dir):
    """The grid, with the cells of the validation and test runs that every candidate is scored on in each draw."""
    whole = lambda v: None if v is None else int(v)
    rows = [(i, m.name, m.cand, whole(m["t"]), m["alpha"], whole(m["half_width"]), m["sigma"], whole(m["width"])) for i, m in enumerate(WHOLE)]
    grid = spark.createDataFrame(rows, "place int, method string, cand_ord int, t int, alpha double, half_width int, sigma double, width int")
    f = _frames(spark, sf_dir)
    split = B.splits(f, CFG)
    cells = f.join(F.broadcast(split.select("run_id", "split")), "run_id").join(B.frequencies(f, split).select("feature_id"), "feature_id")
    of = lambda phase: F.count_if(F.col("split") == phase).alias(f"{phase}_cells")
    return grid.join(F.broadcast(cells.agg(of("validation"), of("test"))), F.lit(True))  # one row


@query(
    "decision_against_all",
    f"""WITH {_selected_sql(3)}, others AS (SELECT DISTINCT method AS base FROM sel WHERE method <> 'cubic_median'
), cm AS (SELECT base AS k, run_id, CASE method WHEN base THEN 'b' ELSE 'o' END AS method, brier, rare_positive_recall AS rare, short_positive_recall AS brief FROM sel JOIN others ON method IN (base, 'cubic_median')
), {_COMPOSITE} SELECT k AS base, round(gain, 9) AS gain, decision FROM ruled""",
)
def decision_against_all(spark, sf_dir, grid=GRID, cfg=CFG):
    """The composite rule on the selected cubic against every other family's selected candidate."""
    tested = _tested(spark, sf_dir, grid, cfg)[1].where("selected")
    own = tested.where("method = 'cubic_median'")
    bases = F.array(*[F.lit(m) for m in dict.fromkeys(m.name for m in grid) if m != "cubic_median"])
    both = tested.where("method <> 'cubic_median'").withColumn("base", F.col("method")).unionByName(own.withColumn("base", F.explode(bases)))
    both = both.withColumn("method", F.when(F.col("method") == "cubic_median", "o").otherwise("b"))
    return _rounded(M.composite(both, "b", "o", by=("base",)).select("base", "gain", "decision"), "gain")


@query("measured_seconds")
def measured_seconds(spark, sf_dir):
    """What each family's prediction and metrics took inside the tasks, over the whole grid and all test draws."""
    f = _frames(spark, sf_dir)
    return B.seconds(B.phase_sums(f, B.splits(f, WHOLE_CFG), "test", WHOLE, WHOLE_CFG, timed=True))


for _f in (metrics_all, equal_weight_rollup, cell_vs_run_weight, select_params, select_baseline, matched_baseline, clean_control, summary_table, decision_of_selected, paired_all_methods, same_t_of_selected):
    query(f"whole_{_f.__name__}")(partial(_f, grid=WHOLE, cfg=WHOLE_CFG))
for _f in (paired_interval, composite_decision, same_t_attribution):
    query(f"whole_{_f.__name__}")(partial(_f, cfg=WHOLE_CFG))


@query(
    "label_confusion",
    """WITH j AS (SELECT quality = 1 AS truth, n_chars >= 500 AS hit FROM labels JOIN documents USING (doc_id)), k AS (SELECT count(*) FILTER (hit AND truth) AS tp, count(*) FILTER (hit AND NOT truth) AS fp, count(*) FILTER (NOT hit AND truth) AS fn FROM j)
SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 9) AS "precision", round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM k""",
)
def label_confusion(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    truth, hit = F.col("quality") == 1, F.col("n_chars") >= 500
    k = j.agg(F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"), F.count_if(~hit & truth).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return k.select("tp", "fp", "fn", F.round(ratio(tp, tp + fp), 9).alias("precision"), F.round(ratio(tp, tp + fn), 9).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 9).alias("f1"))


@query(
    "rare_stratum_counts",
    f"""WITH {Q.SERIES}, {_SPLIT}, {_FEATURES} SELECT run_id, count(DISTINCT fx.feature_id) FILTER (frequency <= 0.1) AS rare_features, CAST(coalesce(sum(x) FILTER (frequency <= 0.1), 0) AS BIGINT) AS rare_positive FROM fx LEFT JOIN fq USING (feature_id) GROUP BY run_id""",
)
def rare_stratum_counts(spark, sf_dir):
    """Rare features of every run and their positive cells."""
    f = _frames(spark, sf_dir)
    return R.rare_counts(f, B.frequencies(f, B.splits(f, CFG)))
