"""Hash-ordered splits and caps, and stable run indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered


def run_index(runs: DataFrame, by: str) -> DataFrame:
    """runs with run_index: their place by the given column, before any filter. runs: one row for each run of a manifest."""
    return numbered(runs, [], by, name="run_index")


def hash_cap(rows: DataFrame, group: list[str], path: str, cap: int) -> DataFrame:
    """The first `cap` rows of each group by the hash of their path."""
    w = Window.partitionBy(*group).orderBy(F.sha2(F.col(path).cast("string"), 256))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def hash_split(runs: DataFrame, by: str, sizes: tuple[int, int, int]) -> DataFrame:
    """runs (their `by` only) with split and run_index: the first runs by hash are for discovery, the next for validation, the next for test.

    The sizes are the feature, so only that many runs are ordered in one task. Their indexes among all runs follow from
    how many of all runs lie between one kept run and the next.
    """
    a, b, c = sizes
    hashed = F.sha2(F.col(by).cast("string"), 256)
    first = runs.select(by).orderBy(hashed, by).limit(a + b + c)
    place = F.row_number().over(Window.orderBy(hashed, by))  # at most sum(sizes) rows
    kept = first.withColumn("place", place)
    all_kept = kept.agg(F.array_sort(F.collect_list(by)).alias("kept"))
    between = runs.join(F.broadcast(all_kept), F.lit(True)).groupBy(F.size(F.filter("kept", lambda k: k <= F.col(by))).alias("slot")).agg(F.count("*").alias("n"))
    # slot k holds the k-th kept run and those up to the next one
    ahead = F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))  # at most sum(sizes) + 1 rows
    index = between.withColumn("run_index", F.coalesce(ahead, F.lit(0)).cast("long")).where("slot > 0")
    split = F.when(F.col("place") <= a, "discovery").when(F.col("place") <= a + b, "validation").otherwise("test")
    slot = F.row_number().over(Window.orderBy(by))  # again the kept runs only
    named = kept.select(by, split.alias("split"), slot.alias("slot"))
    return named.join(index, "slot").select(by, "run_index", "split")
