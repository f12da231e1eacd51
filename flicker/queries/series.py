"""Queries over binary series: scans, strata, smoothing methods, noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.methods import candidates, halo, method
from ..functions.scalars import shown, uniform
from ..operators import noise as N
from ..operators import series as S
from ..operators import smoothing as H
from ..operators import strata as R
from ..operators import streams as X
from ..operators import tridiagonal as D
from ..operators.order import numbered
from ..registry import query
from ..session import table
from . import sqltext as Q


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.event_frames(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"))


@query("series_from_events", f"WITH {Q.SERIES} SELECT run_id, frame, CAST(x AS TINYINT) AS x FROM ev")
def series_from_events(spark, sf_dir):
    return _frames(spark, sf_dir).select("run_id", "frame", "x")


@query("series_roundtrip", f"WITH {Q.SERIES} SELECT run_id, frame, CAST(x AS TINYINT) AS x FROM ev")
def series_roundtrip(spark, sf_dir):
    """Frames to chunks of 16 frames with halos, and back."""
    chunks = S.to_chunks(_frames(spark, sf_dir), halo=5, chunk_frames=16)
    own = chunks.withColumn("x", F.slice("xs", F.col("pre") + 1, F.col("own")))
    return S.to_frames(own, "x").select("run_id", "frame", "x")


@query("stride_sample", f"WITH {Q.SERIES} SELECT run_id, frame, CAST(x AS TINYINT) AS x FROM ev WHERE frame % 5 = 0")
def stride_sample(spark, sf_dir):
    return _frames(spark, sf_dir).where(F.col("frame") % 5 == 0).select("run_id", "frame", "x")


@query("json_props", "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))


@query("transition_mask", f"WITH {Q.SERIES}, {Q.EDGES} SELECT run_id, frame, CAST(x AS TINYINT) AS x, edge FROM edges")
def transition_mask(spark, sf_dir):
    return R.transitions(_frames(spark, sf_dir)).select("run_id", "frame", "x", "edge")


@query("positive_runs", f"WITH {Q.SERIES}, {Q.RUNS} SELECT run_id, start, stop FROM runs")
def positive_runs(spark, sf_dir):
    return R.positive_runs(_frames(spark, sf_dir)).select("run_id", "start", "stop")


@query("brief_runs", f"WITH {Q.SERIES}, {Q.RUNS} SELECT run_id, start, stop FROM brief")
def brief_runs(spark, sf_dir):
    return R.brief_runs(R.positive_runs(_frames(spark, sf_dir))).select("run_id", "start", "stop")


@query(
    "strata_counts",
    f"""WITH {Q.SERIES}, {Q.RUNS}, {Q.EDGES}, b AS (SELECT run_id, count(*) AS e, CAST(sum(stop - start) AS BIGINT) AS c FROM brief GROUP BY run_id)
SELECT run_id, count(*) AS frames, CAST(sum(x) AS BIGINT) AS positive, count(*) FILTER (edge) AS edge_cells, coalesce(max(e), 0) AS brief_events, coalesce(max(c), 0) AS brief_cells
FROM edges LEFT JOIN b USING (run_id) GROUP BY run_id""",
)
def strata_counts(spark, sf_dir):
    return R.counts(_frames(spark, sf_dir))


# ---------------------------------------------------------------- smoothing

LEVEL = 0.1
SHOWN = {
    "raw_series": method("raw"),
    "resolvent_t16": method("linear", t=16),
    "cubic_t16": method("cubic_median", t=16),
    "oracle_debias_t16": method("oracle_debiased_linear", t=16),
    "hard_t16": method("hard_linear", t=16),
    "moving_average_w16": method("moving_average", half_width=16),
    "gaussian_s4": method("gaussian", sigma=4.0),
    "median_w9": method("median", width=9),
    "power_t8_a15": method("power_full", t=8, alpha=1.5),
    "power_matched_t8": method("power_matched", t=8),
}


def _smooth_query(name: str, m) -> None:
    sql = f"""WITH {Q.SERIES}, s AS (SELECT ev.run_id, frame, x, n FROM ev JOIN nn USING (run_id)), {Q.kernels([m])}, {Q.convolved("s", "x")}
SELECT run_id, frame, round({Q.shaped(m, LEVEL)}, 9) AS y FROM h"""

    @query(name, sql)
    def run(spark, sf_dir):
        chunks = S.to_chunks(_frames(spark, sf_dir), halo([m]))
        values = H.smooth(chunks, [m], LEVEL)
        return S.to_frames(values, "p").select("run_id", "frame", F.round("p", 9).alias("y"))


for _name, _m in SHOWN.items():
    _smooth_query(_name, _m)


@query(
    "all_families",
    f"""WITH {Q.SERIES}, s AS (SELECT ev.run_id, frame, x, n FROM ev JOIN nn USING (run_id)), {Q.kernels(list(SHOWN.values()))}, {Q.convolved("s", "x")}, {Q.methods_union(list(SHOWN.values()), LEVEL, "run_id")}
SELECT run_id, method, count(*) AS cells, round(avg(p), 9) AS mean_p, round(max(p), 9) AS max_p FROM p GROUP BY run_id, method""",
)
def all_families(spark, sf_dir):
    """Every family at one setting: each kernel is convolved once and shared."""
    methods = list(SHOWN.values())
    values = H.smooth(S.to_chunks(_frames(spark, sf_dir), halo(methods)), methods, LEVEL)
    return S.to_frames(values, "p", keys=("run_id", "feature_id", "method")).groupBy("run_id", "method").agg(F.count("*").alias("cells"), F.round(F.avg("p"), 9).alias("mean_p"), F.round(F.max("p"), 9).alias("max_p"))


@query(
    "occupancy_preserved",
    f"WITH {Q.SERIES} SELECT run_id, round(avg(x), 9) AS mean_x, round(avg(x), 9) AS mean_h FROM ev GROUP BY run_id",
)
def occupancy_preserved(spark, sf_dir):
    """The resolvent keeps a series' mean."""
    m = method("linear", t=16)
    frames = _frames(spark, sf_dir)
    h = S.to_frames(H.smooth(S.to_chunks(frames, halo([m])), [m]), "p").groupBy("run_id").agg(F.round(F.avg("p"), 9).alias("mean_h"))
    return frames.groupBy("run_id").agg(F.round(F.avg("x"), 9).alias("mean_x")).join(h, "run_id").select("run_id", "mean_x", "mean_h")


@query("resolvent_exact", f"WITH {Q.SERIES}, s AS (SELECT ev.run_id, frame, x, n FROM ev JOIN nn USING (run_id)), {Q.kernels([SHOWN['resolvent_t16']])}, {Q.convolved('s', 'x')} SELECT run_id, frame, round(h, 9) AS y FROM h")
def resolvent_exact(spark, sf_dir):
    """The resolvent by its tridiagonal system, over stretches of 16 frames that meet in a small system for each series."""
    h = D.resolvent(S.to_chunks(_frames(spark, sf_dir), 0, 16), 16.0)
    return S.to_frames(h, "h").select("run_id", "frame", F.round("h", 9).alias("y"))


@query("resolvent_residual", f"WITH {Q.SERIES} SELECT DISTINCT run_id, true AS solved FROM ev")
def resolvent_residual(spark, sf_dir):
    """The smoothed series solves the resolvent's equation at every frame."""
    m = method("linear", t=16)
    frames = _frames(spark, sf_dir)
    h = S.to_frames(H.smooth(S.to_chunks(frames, halo([m])), [m]), "p").select("run_id", "feature_id", "frame", F.col("p").alias("h"))
    rows = h.join(frames.withColumnRenamed("x", "z"), ["run_id", "feature_id", "frame"])
    return H.residuals(rows, 16.0).select("run_id", (F.col("residual") < 1e-12).alias("solved"))


# ---------------------------------------------------------------- noise

_KEY = "concat_ws('|', 20261007, 1, 1, run_id, 0, 0)"


def _key():
    return N.seed(F.lit(1), 1, "run_id", 0, F.lit(0))


@query("noise_bitflip", f"WITH {Q.SERIES} SELECT run_id, frame, CAST(CASE WHEN {Q.uniform(_KEY, '0', 'frame')} < 0.1 THEN 1 - x ELSE x END AS TINYINT) AS z FROM ev")
def noise_bitflip(spark, sf_dir):
    return N.flips(_frames(spark, sf_dir), 0.1, _key()).select("run_id", "frame", "z")


@query(
    "noise_correlated",
    f"""WITH RECURSIVE {Q.SERIES}, u AS (SELECT run_id, frame, x, {Q.uniform(_KEY, '0', 'frame')} AS u FROM ev
), c AS (
  SELECT run_id, frame, x, CASE WHEN u < 0.1::DOUBLE THEN 1 ELSE 0 END AS e FROM u WHERE frame = 0
  UNION ALL SELECT u.run_id, u.frame, u.x, CASE WHEN u.u < CASE WHEN c.e = 1 THEN {1 - (1 - 0.1) * (1 - 0.8)!r}::DOUBLE ELSE {0.1 * (1 - 0.8)!r}::DOUBLE END THEN 1 ELSE 0 END FROM c JOIN u ON u.run_id = c.run_id AND u.frame = c.frame + 1
) SELECT run_id, frame, CAST(CASE WHEN e = 1 THEN 1 - x ELSE x END AS TINYINT) AS z FROM c""",
)
def noise_correlated(spark, sf_dir):
    chunks = S.to_chunks(_frames(spark, sf_dir))
    return S.to_frames(N.chained(chunks, 0.1, 0.8, _key()), "zs").select("run_id", "frame", F.col("zs").alias("z"))


@query(
    "noise_draws",
    f"""WITH {Q.SERIES}, d AS (SELECT ev.*, CAST(draw AS INTEGER) AS draw FROM ev CROSS JOIN range(8) t(draw))
SELECT draw, count(*) AS cells, count(*) FILTER ({Q.uniform("concat_ws('|', 20261007, 1, 1, run_id, 0, draw)", '0', 'frame')} < 0.1) AS flipped FROM d GROUP BY draw""",
)
def noise_draws(spark, sf_dir):
    rows = N.draws(_frames(spark, sf_dir), 8)
    z = N.flips(rows, 0.1, N.seed(F.lit(1), 1, "run_id", 0, "draw"))
    return z.groupBy("draw").agg(F.count("*").alias("cells"), F.count_if(F.col("z") != F.col("x")).alias("flipped"))


@query(
    "noise_seeds",
    """WITH s AS (SELECT phase, r.user_id AS run_id, draw, concat_ws('|', 20261007, phase, 1, r.user_id, 0, draw) AS seed
FROM (SELECT DISTINCT user_id FROM events) r CROSS JOIN (SELECT 1 AS phase, unnest(range(8)) AS draw UNION ALL SELECT 2, unnest(range(16))) p)
SELECT count(*) AS seeds, count(DISTINCT seed) AS distinct_seeds, (SELECT count(*) FROM (SELECT seed FROM s WHERE phase = 1 INTERSECT SELECT seed FROM s WHERE phase = 2)) AS shared FROM s""",
)
def noise_seeds(spark, sf_dir):
    """Seeds are unique, and validation and test share none."""
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id")).distinct()
    v = N.draws(runs, 8).withColumn("seed", N.seed(F.lit(1), 1, "run_id", 0, "draw")).select("seed")
    t = N.draws(runs, 16).withColumn("seed", N.seed(F.lit(2), 1, "run_id", 0, "draw")).select("seed")
    shared = v.intersect(t).agg(F.count("*").alias("shared"))
    return v.union(t).agg(F.count("*").alias("seeds"), F.count_distinct("seed").alias("distinct_seeds")).join(F.broadcast(shared), F.lit(True))  # one row each


#: Words before the run's own in a seed: a root of our own, the phase, the data set.
_WORDS = (20261128, 1, 1)


def _words():
    """The seed words of a run: root, phase, data set, run, scenario, draw."""
    return F.array(*[F.lit(w).cast("long") for w in _WORDS], "run_id", F.lit(0).cast("long"), F.lit(0).cast("long"))


def _three_features(spark, sf_dir):
    """Stretches of three features of a run, which share the run's stream frame by frame."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", F.array(F.col("event_type").isin("click", "purchase"), F.col("value") > 150, F.col("event_type") == "error").alias("bits"))
    rows = numbered(e, ["run_id"], "ts", "event_id", name="frame").select("run_id", "frame", F.posexplode("bits").alias("feature_id", "x"))
    frames = rows.select("run_id", F.col("feature_id").cast("long").alias("feature_id"), "frame", F.col("x").cast("tinyint").alias("x"))
    return S.to_chunks(frames, 0).withColumns({"words": _words(), "column": F.col("feature_id"), "columns": F.lit(3).cast("long")})


@query("exact_flips")
def exact_flips(spark, sf_dir):
    """Flips by the very numbers that NumPy's default generator draws for a whole run at once (tested against it)."""
    z = X.flipped(_three_features(spark, sf_dir), 0.1)
    return S.to_frames(z, "zs").select("run_id", "feature_id", "frame", F.col("zs").alias("z"))


@query("exact_chain")
def exact_chain(spark, sf_dir):
    """Correlated flips by the same numbers; a stretch starts from the state in which the chain comes to it."""
    z = X.chained(_three_features(spark, sf_dir), 0.1, 0.8)
    return S.to_frames(z, "zs").select("run_id", "feature_id", "frame", F.col("zs").alias("z"))


@query(
    "rolling_counts",
    f"WITH {Q.SERIES} SELECT run_id, frame, CAST(sum(x) OVER (PARTITION BY run_id ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS last10 FROM ev",
)
def rolling_counts(spark, sf_dir):
    """Over stretches that carry the frames before them."""
    chunks = S.to_chunks(_frames(spark, sf_dir), 9)
    last = lambda k: F.slice("xs", F.greatest(F.col("pre") + k - 8, F.lit(1)), F.least(F.col("pre") + k + 1, F.lit(10)))
    sums = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda k: F.aggregate(last(k), F.lit(0).cast("long"), lambda a, v: a + v))
    return S.to_frames(chunks.withColumn("last10", sums), "last10").select("run_id", "frame", "last10")


@query("shown_rates", "SELECT event_type, CASE WHEN count(*) FILTER (value > 300) = 0 THEN 'not evaluable' ELSE printf('%.2f%%', 100.0 * count(*) FILTER (value > 300) / count(*)) END AS rate FROM events GROUP BY event_type")
def shown_rates(spark, sf_dir):
    high = F.count_if(F.col("value") > 300)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(high.alias("h"), F.count("*").alias("n")).select("event_type", shown(F.when(F.col("h") > 0, F.col("h") / F.col("n")), 2, percent=True).alias("rate"))


@query("hashed_uniforms", f"SELECT count(*) AS n, round(avg({Q.uniform('event_id')}), 9) AS mean_u, round(min({Q.uniform('event_id')}), 9) AS min_u FROM events")
def hashed_uniforms(spark, sf_dir):
    u = uniform("event_id")
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.round(F.avg(u), 9).alias("mean_u"), F.round(F.min(u), 9).alias("min_u"))


@query(
    "long_runs_smoothing",
    f"""WITH li AS (SELECT l_suppkey AS run_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS BIGINT) AS frame, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS x FROM lineitem
), s AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM li), {Q.kernels([SHOWN["gaussian_s4"]])}, {Q.convolved("s", "x")}
SELECT run_id, count(*) AS frames, round(avg(h), 9) AS mean_h, round(max(h), 9) AS max_h FROM h GROUP BY run_id""",
)
def long_runs_smoothing(spark, sf_dir):
    """Long series in stretches of 256 frames with halos."""
    m = SHOWN["gaussian_s4"]
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run_id"), "l_shipdate", "l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).cast("tinyint").alias("x"))
    placed = numbered(li, ["run_id"], "l_shipdate", "l_orderkey", "l_linenumber", name="frame")
    frames = placed.select("run_id", F.lit(0).cast("long").alias("feature_id"), "frame", "x")
    h = S.to_frames(H.smooth(S.to_chunks(frames, halo([m]), 256), [m]), "p")
    return h.groupBy("run_id").agg(F.count("*").alias("frames"), F.round(F.avg("p"), 9).alias("mean_h"), F.round(F.max("p"), 9).alias("max_h"))
