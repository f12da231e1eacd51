"""Strata of a binary series: transitions, positive runs, brief runs, rare features, for results as rows. No window covers a whole series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stretches import neighbours, runs_of

RARE = 0.10
BRIEF = 3
_KEY = ["run_id", "feature_id"]


def transitions(frames: DataFrame) -> DataFrame:
    """frames with edge: whether either neighbour differs."""
    both = neighbours(frames, _KEY, ["x"])
    differs = lambda c: F.coalesce(F.col("x") != F.col(c), F.lit(False))
    return both.select(*frames.columns, (differs("before_x") | differs("after_x")).alias("edge"))


def positive_runs(frames: DataFrame) -> DataFrame:
    """run_id, feature_id, start, stop (exclusive), n of every positive run."""
    ends = frames.groupBy(*_KEY).agg((F.max("frame") + 1).alias("n"))
    return runs_of(frames, _KEY, F.col("x") == 1).join(ends, _KEY).select(*_KEY, "start", "stop", "n")


def brief_runs(runs: DataFrame, longest: int = BRIEF) -> DataFrame:
    """Runs of at most `longest` frames that touch neither end of the series."""
    return runs.where((F.col("stop") - F.col("start") <= longest) & (F.col("start") > 0) & (F.col("stop") < F.col("n")))


def counts(frames: DataFrame) -> DataFrame:
    """run_id, frames, positive, edge_cells, brief_events, brief_cells."""
    cells = transitions(frames).groupBy("run_id").agg(F.count("*").alias("frames"), F.sum(F.col("x").cast("long")).alias("positive"), F.count_if("edge").alias("edge_cells"))
    brief = brief_runs(positive_runs(frames)).groupBy("run_id").agg(F.count("*").alias("brief_events"), F.sum(F.col("stop") - F.col("start")).alias("brief_cells"))
    return cells.join(brief, "run_id", "left").na.fill(0, ["brief_events", "brief_cells"])


def rare_counts(frames: DataFrame, frequencies: DataFrame) -> DataFrame:
    """run_id, rare_features and rare_positive (their positive cells): features of at most RARE by frequencies (feature_id, frequency)."""
    rare = frames.join(frequencies.where(F.col("frequency") <= RARE), "feature_id")
    found = rare.groupBy("run_id").agg(F.count_distinct("feature_id").alias("rare_features"), F.sum(F.col("x").cast("long")).alias("rare_positive"))
    return frames.select("run_id").distinct().join(found, "run_id", "left").na.fill(0)
