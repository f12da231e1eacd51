"""What neighbours in a series see of each other, and runs of equal values, without a task that has a whole series.

A series is cut into stretches of STRETCH frames. Windows stay inside a stretch; what crosses its borders follows from a
summary of each stretch, one row: its first and last values, and the runs that touch a border. Frames of a series must be
numbered from 0 without gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 32768
#: Stretches that are put together at once.
SPAN = 4096


def neighbours(frames: DataFrame, keys: list[str], values: list[str], at: str = "frame", stretch: int | None = None) -> DataFrame:
    """frames with before_<v> and after_<v> for each of values: those of the frames before and after, null at a series' ends."""
    rows = frames.withColumn("_s", F.floor(F.col(at) / (stretch or STRETCH)))
    w = Window.partitionBy(*keys, "_s").orderBy(at)
    ends = rows.groupBy(*keys, "_s").agg(*[f(v, at).alias(f"_{p}_{v}") for v in values for p, f in (("first", F.min_by), ("last", F.max_by))])
    left = ends.select(*keys, (F.col("_s") + 1).alias("_s"), *[f"_last_{v}" for v in values])
    right = ends.select(*keys, (F.col("_s") - 1).alias("_s"), *[f"_first_{v}" for v in values])
    rows = rows.withColumns({f"_lag_{v}": F.lag(v).over(w) for v in values} | {f"_lead_{v}": F.lead(v).over(w) for v in values} | {"_nth": F.row_number().over(w), "_left": F.lead(F.lit(1)).over(w)})
    rows = rows.join(left, [*keys, "_s"], "left").join(right, [*keys, "_s"], "left")
    before = {f"before_{v}": F.when(F.col("_nth") > 1, F.col(f"_lag_{v}")).otherwise(F.col(f"_last_{v}")) for v in values}
    after = {f"after_{v}": F.when(F.col("_left") == 1, F.col(f"_lead_{v}")).otherwise(F.col(f"_first_{v}")) for v in values}
    return rows.withColumns(before | after).select(*frames.columns, *before, *after)


def runs_of(frames: DataFrame, keys: list[str], condition, at: str = "frame", stretch: int | None = None) -> DataFrame:
    """keys, start and stop (exclusive) of every longest run of frames where condition holds.

    Runs are found inside stretches. Those that touch a border are put together where one ends and the next starts, first
    inside groups of SPAN stretches, then what touches a group's border (one row for each SPAN * STRETCH frames that are
    all in one run, two more for each group) over the series.
    """
    size = stretch or STRETCH
    rows = frames.where(condition).select(*keys, F.col(at).alias("_at"), F.floor(F.col(at) / size).alias("_s"))
    w = Window.partitionBy(*keys, "_s").orderBy("_at")
    found = rows.withColumn("_island", F.col("_at") - F.row_number().over(w)).groupBy(*keys, "_s", "_island").agg(F.min("_at").alias("start"), (F.max("_at") + 1).alias("stop")).select(*keys, "start", "stop")
    for group in (size * SPAN, None):
        touches = (F.col("start") % size == 0) & (F.col("start") > 0) | (F.col("stop") % size == 0)
        inside = [*keys] if group is None else [*keys, "_g"]
        some = found.where(touches) if group is None else found.where(touches).withColumn("_g", F.floor(F.col("start") / group))
        order = Window.partitionBy(*inside).orderBy("start")
        new = F.coalesce((F.col("start") != F.lag("stop").over(order)).cast("int"), F.lit(1))
        some = some.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        merged = some.groupBy(*inside, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select(*keys, "start", "stop")
        found = found.where(~touches).unionByName(merged)
        size = group
    return found
