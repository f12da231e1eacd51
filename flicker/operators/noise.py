"""Reproducible corruption: counter-based streams keyed by (scenario, draw, run, feature, frame), the same in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import below, gaussian, uniform

ROOT = 20261007
PHASES = {"validation": 1, "test": 2}


def seed(phase: Column | str, dataset: int, run_index: Column | str, scenario: int, draw: Column | str) -> Column:
    """The seed words as text; the same Z for all methods of a (run, draw)."""
    words = [F.lit(ROOT), phase, F.lit(dataset), run_index, F.lit(scenario), draw]
    return F.concat_ws("|", *[(F.col(w) if isinstance(w, str) else w).cast("string") for w in words])


def draws(frames: DataFrame, n: int) -> DataFrame:
    """Every row once for each of n draws."""
    return frames.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def flips(frames: DataFrame, level: float, key: Column, x: str = "x") -> DataFrame:
    """frames with z: x flipped with probability level, independently."""
    u = uniform(key, F.col("feature_id"), F.col("frame"))
    return frames.withColumn("z", F.when(u < level, 1 - F.col(x)).otherwise(F.col(x)).cast("tinyint"))


def flipped(chunks: DataFrame, level: float, key: Column) -> DataFrame:
    """Stretches (to_chunks) with zs: the same flips as by flips, of every frame that the stretch holds."""
    first = F.col("lo") - F.col("pre")
    hit = lambda k: below(level, key, F.col("feature_id"), first + k)
    return chunks.withColumn("zs", F.transform("xs", lambda x, k: F.when(hit(k), 1 - x).otherwise(x).cast("tinyint")))


def chained(chunks: DataFrame, level: float, rho: float, key: Column, keys: tuple[str, ...] = ("run_id", "feature_id")) -> DataFrame:
    """Stretches without halos (to_chunks; without lo: whole series) with zs: x flipped by a two-state chain that keeps its prevalence.

    A fold over uniforms; the state after frame i depends only on the uniforms up to i. A stretch maps the state before
    it to the state after it; these maps, one row for each stretch, are composed over a series, then every stretch is
    folded from the state it is entered with.
    """
    rise, stay = level * (1 - rho), 1 - (1 - level) * (1 - rho)
    whole = "lo" not in chunks.columns
    if whole:
        chunks = chunks.withColumns({"lo": F.lit(0).cast("long"), "entry": F.lit(0)})
    else:
        chunks = chunks.join(_entries(chunks, level, rise, stay, key, keys), [*keys, "lo"])
    # states as a string of digits; a later stretch starts with the state before it
    start = F.when(F.col("lo") == 0, "").otherwise(F.col("entry").cast("string"))
    states = F.aggregate(_uniforms(key), start, lambda s, v: F.concat(s, F.when(v < F.when(s == "", F.lit(level)).when(F.right(s, F.lit(1)) == "1", F.lit(stay)).otherwise(F.lit(rise)), "1").otherwise("0")))
    flip = F.transform(F.split(states, ""), lambda c: c.cast("tinyint"))
    z = F.zip_with("xs", F.slice(flip, F.when(F.col("lo") == 0, 1).otherwise(2), F.size("xs")), lambda a, b: F.when(b == 1, 1 - a).otherwise(a).cast("tinyint"))
    return chunks.withColumn("zs", z).drop("entry", *["lo"] * whole)


def _uniforms(key: Column) -> Column:
    return F.transform(F.sequence(F.col("lo"), F.col("lo") + F.size("xs") - 1), lambda i: uniform(key, F.col("feature_id"), i))


def _entries(chunks: DataFrame, level: float, rise: float, stay: float, key: Column, keys: tuple[str, ...]) -> DataFrame:
    """keys, lo and entry: the chain's state before each stretch."""
    after = lambda s, v: F.when(v < F.when(s < 0, F.lit(level)).when(s == 1, F.lit(stay)).otherwise(F.lit(rise)), 1).otherwise(0)
    begin = F.struct(F.when(F.col("lo") == 0, -1).otherwise(0).alias("a"), F.when(F.col("lo") == 0, -1).otherwise(1).alias("b"))
    ends = chunks.select(*keys, "lo", F.aggregate(_uniforms(key), begin, lambda s, v: F.struct(after(s["a"], v).alias("a"), after(s["b"], v).alias("b"))).alias("m"))
    # a map is constant, swaps the states or leaves them: the last constant one counts, and the swaps after it
    w = Window.partitionBy(*keys).orderBy("lo")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("m.a") > F.col("m.b")).cast("int")
    ends = ends.withColumn("swaps", F.sum(swap).over(w)).withColumn("fixed", F.when(F.col("m.a") == F.col("m.b"), F.struct(F.col("m.a").alias("state"), "swaps")))
    last = F.last("fixed", ignorenulls=True).over(before)
    return ends.withColumn("last", last).select(*keys, "lo", F.when(F.col("lo") == 0, 0).otherwise((F.col("last.state") + F.col("swaps") - swap - F.col("last.swaps")) % 2).cast("int").alias("entry"))


def moved(xyz: Column | str, sigma: float, key: Column) -> Column:
    """A flat array of coordinates with a normal deviate of width sigma on every one."""
    return F.transform(xyz, lambda v, k: v + F.lit(sigma) * gaussian(uniform(key, F.lit("a"), k), uniform(key, F.lit("b"), k)))


def jittered(frames: DataFrame, sigma: float, key: Column) -> DataFrame:
    """Frames (with xyz) whose coordinates are moved."""
    return frames.withColumn("xyz", moved("xyz", sigma, key))
