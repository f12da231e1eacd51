"""Queries over coordinates: pairs, contacts, discovery features, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contacts as C
from ..operators import streams as X
from ..operators import noise as N
from ..registry import query
from ..session import persisted, table
from .sqltext import uniform

ATOMS = 21
DISCOVERY = "run_id < 4"
TEST = "run_id >= 7"

_FRAMES = """fr AS (SELECT CAST(label AS BIGINT) AS run_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame, embedding FROM embeddings
), atm AS (SELECT run_id, frame, CAST(atom AS BIGINT) AS atom, CAST(embedding[3 * atom + 1] AS DOUBLE) AS x, CAST(embedding[3 * atom + 2] AS DOUBLE) AS y, CAST(embedding[3 * atom + 3] AS DOUBLE) AS z FROM fr CROSS JOIN range(21) t(atom))"""
_PAIRS = "pr AS (SELECT CAST(row_number() OVER (ORDER BY a.i, b.j) - 1 AS BIGINT) AS feature_id, a.i, b.j FROM range(21) a(i) JOIN range(21) b(j) ON b.j >= a.i + 4)"


def _E(atom: str, axis: int, of: str = "embedding") -> str:
    """A coordinate of an atom, read from the list."""
    return f"{of}[3 * {atom} + {axis}]::DOUBLE"


_CELLS = f"""{_FRAMES}, {_PAIRS}, di AS (
  SELECT run_id, frame, feature_id, i, j, sqrt(({_E('i', 1)} - {_E('j', 1)}) * ({_E('i', 1)} - {_E('j', 1)}) + ({_E('i', 2)} - {_E('j', 2)}) * ({_E('i', 2)} - {_E('j', 2)}) + ({_E('i', 3)} - {_E('j', 3)}) * ({_E('i', 3)} - {_E('j', 3)})) AS distance
  FROM fr CROSS JOIN pr
), ce AS (SELECT run_id, frame, feature_id, i, j, c.cutoff, CASE WHEN distance < c.v THEN 1 ELSE 0 END AS x FROM di CROSS JOIN (VALUES (15, 0.15::DOUBLE), (20, 0.20::DOUBLE), (25, 0.25::DOUBLE)) c(cutoff, v)
), fe AS (SELECT cutoff, feature_id, i, j, CAST(sum(x) AS BIGINT) AS positives, count(*) AS frames FROM ce WHERE run_id < 4 GROUP BY ALL HAVING sum(x) > 0 AND sum(x) < count(*))"""
_COVER = """ab AS (SELECT cutoff, feature_id FROM ce WHERE run_id < 4 GROUP BY ALL HAVING max(x) = 0
), cv AS (SELECT ce.cutoff, run_id, CAST(sum(x) AS BIGINT) AS all_positive, CAST(coalesce(sum(x) FILTER (fe.feature_id IS NOT NULL), 0) AS BIGINT) AS selected_positive, CAST(coalesce(sum(x) FILTER (ab.feature_id IS NOT NULL), 0) AS BIGINT) AS absent_positive
  FROM ce LEFT JOIN fe ON fe.cutoff = ce.cutoff AND fe.feature_id = ce.feature_id LEFT JOIN ab ON ab.cutoff = ce.cutoff AND ab.feature_id = ce.feature_id GROUP BY ce.cutoff, run_id)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.embedding_frames(table(spark, sf_dir, "embeddings"), ATOMS)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of each run and pair at all cutoffs, counted in one pass over the cells."""
    cells = C.contacts(C.distances(_frames(spark, sf_dir), C.pairs(spark, ATOMS)))
    return C.contact_counts(cells, "run_id", "feature_id", "i", "j")


@query("pairs_theta_join", f"WITH {_PAIRS} SELECT feature_id, i, j FROM pr")
def pairs_theta_join(spark, sf_dir):
    return C.pairs(spark, ATOMS)


def _cut_query(name: int, value: float) -> None:
    @query(f"contacts_cut{name}", f"WITH {_CELLS} SELECT run_id, frame, feature_id FROM ce WHERE cutoff = {name} AND x = 1")
    def run(spark, sf_dir):
        cells = C.contacts(C.distances(_frames(spark, sf_dir), C.pairs(spark, ATOMS)), {name: value})
        return cells.where(f"c{name} = 1").select("run_id", "frame", "feature_id")


for _k, _v in C.CUTOFFS.items():
    _cut_query(_k, _v)


@query("discovery_features", f"WITH {_CELLS} SELECT cutoff, feature_id, i, j, positives, frames, round(positives / frames, 9) AS frequency FROM fe")
def discovery_features(spark, sf_dir):
    return C.discovery_features(_counts(spark, sf_dir), DISCOVERY).withColumn("frequency", F.round("frequency", 9))


@query("rare_features", f"WITH {_CELLS} SELECT cutoff, feature_id FROM fe WHERE positives * 10 <= frames")
def rare_features(spark, sf_dir):
    return C.discovery_features(_counts(spark, sf_dir), DISCOVERY).where("frequency <= 0.1D").select("cutoff", "feature_id")


@query("coverage", f"WITH {_CELLS}, {_COVER} SELECT *, round(absent_positive / nullif(all_positive, 0), 9) AS absent_fraction, all_positive - selected_positive AS omitted_positive FROM cv")
def coverage(spark, sf_dir):
    return C.coverage(_counts(spark, sf_dir), DISCOVERY).withColumn("absent_fraction", F.round("absent_fraction", 9))


@query(
    "pair_constancy",
    f"""WITH {_CELLS}, s AS (SELECT cutoff, feature_id, sum(x) AS p, count(*) AS n FROM ce WHERE run_id < 4 GROUP BY ALL)
SELECT cutoff, count(*) AS eligible, count(*) FILTER (p > 0 AND p < n) AS selected, count(*) FILTER (p = 0) AS constant_absent, count(*) FILTER (p = n) AS constant_present FROM s GROUP BY cutoff""",
)
def pair_constancy(spark, sf_dir):
    s = _counts(spark, sf_dir).where(DISCOVERY).groupBy("cutoff", "feature_id").agg(F.sum("positives").alias("p"), F.sum("frames").alias("n"))
    return s.groupBy("cutoff").agg(F.count("*").alias("eligible"), F.count_if((F.col("p") > 0) & (F.col("p") < F.col("n"))).alias("selected"), F.count_if(F.col("p") == 0).alias("constant_absent"), F.count_if(F.col("p") == F.col("n")).alias("constant_present"))


@query(
    "pooled_coverage",
    f"WITH {_CELLS}, {_COVER} SELECT cutoff, round(sum(absent_positive) / sum(all_positive), 9) AS absent_fraction, round(sum(selected_positive) / sum(all_positive), 9) AS selected_fraction, round(sum(all_positive - selected_positive) / sum(all_positive), 9) AS omitted_fraction FROM cv WHERE {TEST} GROUP BY cutoff",
)
def pooled_coverage(spark, sf_dir):
    c = C.coverage(_counts(spark, sf_dir), DISCOVERY).where(TEST).groupBy("cutoff").agg(*[F.sum(x).alias(x) for x in ("all_positive", "selected_positive", "absent_positive", "omitted_positive")])
    part = lambda x: F.round(F.col(f"{x}_positive") / F.col("all_positive"), 9).alias(f"{x}_fraction")
    return c.select("cutoff", part("absent"), part("selected"), part("omitted"))


@query(
    "feature_compatibility",
    f"""WITH {_CELLS}, f AS (SELECT run_id, cutoff, i, j, round(avg(x), 9) AS frequency FROM ce WHERE run_id < 2 GROUP BY ALL HAVING sum(x) > 0 AND sum(x) < count(*)
), a AS (SELECT cutoff, i, j, frequency FROM f WHERE run_id = 0), b AS (SELECT cutoff, i, j, frequency FROM f WHERE run_id = 1)
SELECT *, 'a' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def feature_compatibility(spark, sf_dir):
    counts = persisted(_counts(spark, sf_dir), "counts")
    of = lambda r: C.discovery_features(counts, F.col("run_id") == r).withColumn("frequency", F.round("frequency", 9))
    return C.incompatible(of(0), of(1)).withColumns({"cutoff": F.col("cutoff").cast("int")})


@query(
    "features_of_all_runs",
    f"""WITH {_CELLS}, f AS (SELECT run_id, cutoff, feature_id, round(avg(x), 9) AS frequency FROM ce GROUP BY ALL HAVING sum(x) > 0 AND sum(x) < count(*)
), k AS (SELECT cutoff, feature_id, count(*) AS runs, count(DISTINCT frequency) AS frequencies FROM f GROUP BY ALL)
SELECT cutoff, count(*) AS features, count(*) FILTER (runs < (SELECT count(DISTINCT run_id) FROM fr)) AS not_in_all, count(*) FILTER (frequencies > 1) AS of_other_frequency FROM k GROUP BY cutoff""",
)
def features_of_all_runs(spark, sf_dir):
    """How many features differ between any two of all runs, in presence or frequency."""
    counts = persisted(_counts(spark, sf_dir), "counts")
    runs = counts.agg(F.count_distinct("run_id").alias("all_runs"))
    f = counts.where("positives > 0 and positives < frames").withColumn("frequency", F.round(F.col("positives") / F.col("frames"), 9))
    k = f.groupBy("cutoff", "feature_id").agg(F.count("*").alias("runs"), F.count_distinct("frequency").alias("frequencies")).join(F.broadcast(runs), F.lit(True))  # one row
    return k.groupBy("cutoff").agg(F.count("*").alias("features"), F.count_if(F.col("runs") < F.col("all_runs")).alias("not_in_all"), F.count_if(F.col("frequencies") > 1).alias("of_other_frequency"))


@query(
    "broken_frames",
    f"""WITH {_FRAMES}, s AS (SELECT run_id, frame, atom, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step FROM atm WINDOW w AS (PARTITION BY run_id, frame ORDER BY atom))
SELECT run_id, frame, count(*) AS steps, round(max(step), 9) AS longest FROM s WHERE step >= 0.5 GROUP BY run_id, frame""",
)
def broken_frames(spark, sf_dir):
    """The frames with a step of 0.5 or more along the chain."""
    steps = C.neighbour_steps(C.atoms_of(_frames(spark, sf_dir))).where("step >= 0.5")
    return steps.groupBy("run_id", "frame").agg(F.count("*").alias("steps"), F.round(F.max("step"), 9).alias("longest"))


@query(
    "adjacent_distance",
    f"""WITH {_FRAMES}, s AS (SELECT run_id, frame, atom, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step FROM atm WINDOW w AS (PARTITION BY run_id, frame ORDER BY atom))
SELECT run_id, round(min(step), 9) AS least, round(max(step), 9) AS most, count(*) FILTER (step >= 0.5) AS broken FROM s WHERE step IS NOT NULL GROUP BY run_id""",
)
def adjacent_distance(spark, sf_dir):
    return C.neighbour_steps(C.atoms_of(_frames(spark, sf_dir))).groupBy("run_id").agg(F.round(F.min("step"), 9).alias("least"), F.round(F.max("step"), 9).alias("most"), F.count_if(F.col("step") >= 0.5).alias("broken"))


def _u(letter: str) -> str:
    return uniform("concat_ws('|', 20261007, 1, 1, run_id, 4, 0, frame)", f"'{letter}'", "k")


@query(
    "noise_jitter",
    f"""WITH {_FRAMES}, c AS (SELECT run_id, frame, k, CAST(embedding[k + 1] AS DOUBLE) + 0.025::DOUBLE * sqrt(-2.0::DOUBLE * ln(greatest({_u('a')}, {2.0**-33!r}::DOUBLE))) * cos(6.283185307179586::DOUBLE * {_u('b')}) AS v FROM fr CROSS JOIN range(63) t(k))
SELECT run_id, frame, round(sum(v), 6) AS total, round(max(v), 6) AS largest FROM c GROUP BY run_id, frame""",
)
def noise_jitter(spark, sf_dir):
    key = F.concat_ws("|", N.seed(F.lit(1), 1, "run_id", 4, F.lit(0)), "frame")
    j = N.jittered(_frames(spark, sf_dir), 0.025, key)
    return j.select("run_id", "frame", F.round(F.aggregate("xyz", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(F.array_max("xyz"), 6).alias("largest"))


@query(
    "backbone_fragments",
    f"""WITH {_FRAMES}, s AS (SELECT run_id, frame, atom, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step FROM atm WINDOW w AS (PARTITION BY run_id, frame ORDER BY atom)
), f AS (SELECT run_id, frame, 1 + count(*) FILTER (step >= 0.25) AS fragments FROM s GROUP BY run_id, frame) SELECT run_id, fragments, count(*) AS frames FROM f GROUP BY run_id, fragments""",
)
def backbone_fragments(spark, sf_dir):
    """Connected pieces of the chain in each frame: a step of 0.25 or more breaks it."""
    steps = C.neighbour_steps(C.atoms_of(_frames(spark, sf_dir)))
    f = steps.groupBy("run_id", "frame").agg((F.count_if(F.col("step") >= 0.25) + 1).alias("fragments"))
    return f.groupBy("run_id", "fragments").agg(F.count("*").alias("frames"))


@query("exact_normals")
def exact_normals(spark, sf_dir):
    """Coordinates moved by the very normals that NumPy's default generator draws for a whole run at once, 64 frames at a time (tested against it)."""
    frames = C.embedding_frames(table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), ATOMS)
    runs = frames.groupBy("run_id").agg(F.count("*").alias("frames"))
    words = F.array(*[F.lit(w).cast("long") for w in (20261128, 2, 1)], "run_id", F.lit(3).cast("long"), F.lit(0).cast("long"))
    streams = runs.select("run_id", words.alias("words"), (F.col("frames") * 3 * ATOMS).alias("total"))
    blocks = runs.select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(64).cast("long"))).alias("lo"), "frames")
    blocks = blocks.select("run_id", "lo", (F.col("lo") * 3 * ATOMS).alias("first"), (F.least(F.lit(64), F.col("frames") - F.col("lo")) * 3 * ATOMS).alias("size"))
    drawn = X.normals(blocks, streams).select("run_id", "lo", "v")
    moved = frames.join(drawn, (frames["run_id"] == drawn["run_id"]) & ((frames["frame"] - frames["frame"] % 64) == drawn["lo"])).drop(drawn["run_id"])
    own = F.slice("v", ((F.col("frame") - F.col("lo")) * 3 * ATOMS + 1).cast("int"), 3 * ATOMS)
    return moved.select("run_id", "frame", F.zip_with("xyz", own, lambda c, z: c + F.lit(0.0125) * z).alias("xyz"))
