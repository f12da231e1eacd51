"""Contacts: coordinates to pairs, distances, cutoffs, discovery-only feature selection and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered

LEAST_GAP = 4
#: Cutoffs in the units of the stand-in coordinates, with the names they have in results.
CUTOFFS = {15: 0.15, 20: 0.20, 25: 0.25}


def embedding_frames(embeddings: DataFrame, atoms: int = 21) -> DataFrame:
    """run_id, frame, xyz (a flat array of 3 * atoms doubles): runs by label, frames by vec_id.

    Every row is a frame: those of a repeated vec_id follow each other, and rows without a label form a run of their own.
    """
    xyz = F.slice(F.transform("embedding", lambda v: v.cast("double")), 1, 3 * atoms)
    held = embeddings.select(F.col("label").cast("long").alias("run_id"), "vec_id", xyz.alias("xyz"))
    return numbered(held, ["run_id"], "vec_id", name="frame").select("run_id", "frame", "xyz")


def atoms_of(frames: DataFrame) -> DataFrame:
    """run_id, frame, atom, x, y, z."""
    rows = frames.select("run_id", "frame", "xyz", F.explode(F.sequence(F.lit(0), F.floor(F.size("xyz") / 3).cast("int") - 1)).alias("atom"))
    return rows.select("run_id", "frame", "atom", *[F.get("xyz", F.col("atom") * 3 + k).alias(c) for k, c in enumerate("xyz")])


def pairs(spark, atoms: int, least_gap: int = LEAST_GAP) -> DataFrame:
    """feature_id, i, j of all atom pairs at least least_gap apart, in row-major order: a theta join of a small dimension."""
    a = spark.range(atoms).select(F.col("id").alias("i"))
    b = spark.range(atoms).select(F.col("id").alias("j"))
    both = a.join(F.broadcast(b), F.col("j") >= F.col("i") + least_gap)  # atoms of one molecule: a few hundred rows
    return both.select((F.row_number().over(Window.orderBy("i", "j")) - 1).cast("long").alias("feature_id"), "i", "j")


def distances(frames: DataFrame, of: DataFrame) -> DataFrame:
    """run_id, frame, feature_id, i, j, distance. The coordinates of a frame are one array, so both ends are gathered without a join."""
    rows = frames.join(F.broadcast(of), F.lit(True))  # of: the pairs of one molecule
    return rows.select("run_id", "frame", "feature_id", "i", "j", distance("xyz").alias("distance"))


def distance(xyz: str) -> Column:
    """The distance of atoms i and j of a flat array of coordinates."""
    part = [F.get(xyz, F.col("i").cast("int") * 3 + k) - F.get(xyz, F.col("j").cast("int") * 3 + k) for k in range(3)]
    return F.sqrt(part[0] * part[0] + part[1] * part[1] + part[2] * part[2])


def contacts(dist: DataFrame, cutoffs: dict[int, float] | None = None) -> DataFrame:
    """run_id, frame, feature_id, i, j and c<name> (distance below the cutoff, strictly) for all cutoffs in one pass."""
    cutoffs = CUTOFFS if cutoffs is None else cutoffs
    return dist.select("run_id", "frame", "feature_id", "i", "j", *[(F.col("distance") < F.lit(v)).cast("tinyint").alias(f"c{k}") for k, v in cutoffs.items()])


def contact_counts(cells: DataFrame, *keys: str) -> DataFrame:
    """cutoff, keys, positives, frames: the cutoff columns of contacts are summed first, then the sums become rows."""
    names = [c for c in cells.columns if c[0] == "c" and c[1:].isdigit()]
    sums = cells.groupBy(*keys).agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in names], F.count("*").alias("frames"))
    each = F.array(*[F.struct(F.lit(int(c[1:])).alias("cutoff"), F.col(c).alias("positives")) for c in names])
    return sums.select(*keys, "frames", F.explode(each).alias("v")).select("v.cutoff", *keys, "v.positives", "frames")


def discovery_features(counts: DataFrame, discovery) -> DataFrame:
    """cutoff, feature_id, i, j, positives, frames, frequency of the pairs that are neither always nor never in contact in the discovery runs. counts: by run_id, feature_id, i, j."""
    seen = counts.where(discovery).groupBy("cutoff", "feature_id", "i", "j").agg(F.sum("positives").alias("positives"), F.sum("frames").alias("frames"))
    return seen.where("positives > 0 and positives < frames").withColumn("frequency", F.col("positives") / F.col("frames"))


def coverage(counts: DataFrame, discovery) -> DataFrame:
    """For each cutoff and run: positive cells, those of selected features, of pairs absent in discovery and their fraction, and those left out. counts: by run_id, feature_id, i, j."""
    disc = F.expr(discovery) if isinstance(discovery, str) else discovery
    pair = Window.partitionBy("cutoff", "feature_id")  # one row for each run
    p, n = F.sum(F.when(disc, F.col("positives"))).over(pair), F.sum(F.when(disc, F.col("frames"))).over(pair)
    rows = counts.withColumns({"kept": (p > 0) & (p < n), "absent": p == 0})
    out = rows.groupBy("cutoff", "run_id").agg(
        F.sum("positives").alias("all_positive"), F.sum(F.when(F.col("kept"), F.col("positives")).otherwise(0)).alias("selected_positive"), F.sum(F.when(F.col("absent"), F.col("positives")).otherwise(0)).alias("absent_positive")
    )
    return out.select("*", (F.col("absent_positive") / F.nullif(F.col("all_positive").cast("double"), F.lit(0.0))).alias("absent_fraction"), (F.col("all_positive") - F.col("selected_positive")).alias("omitted_positive"))


def incompatible(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features (cutoff, i, j, frequency) that only one of two runs' tables has, and in which."""
    cols = ["cutoff", "i", "j", "frequency"]
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))


def neighbour_steps(atoms: DataFrame) -> DataFrame:
    """run_id, frame, atom, step: the distance to the atom before, by lag."""
    w = Window.partitionBy("run_id", "frame").orderBy("atom")
    d = [F.col(c) - F.lag(c).over(w) for c in "xyz"]
    return atoms.select("run_id", "frame", "atom", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("step")).where("step is not null")
