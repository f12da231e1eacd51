"""Places in an order without a task that sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import persisted


def numbered(rows: DataFrame, group: list[str], *order: str | Column, name: str = "nth") -> DataFrame:
    """rows with their place (from 0) in their group by the given order; [] for one group of all rows.

    Rows are sorted by (group, order) over range partitions, so a group of any size is spread over tasks, and written;
    a row's place is the one in its partition and what earlier partitions hold of its group. rows should be slim.
    Equal keys are split by the rows' place in the input, which makes their order arbitrary.
    """
    keys = [*[F.col(g) for g in group], *[F.col(c) if isinstance(c, str) else c for c in order], F.col("_tie")]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    held = persisted(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")  # counts from 0 in each partition, below bit 33
    held = held.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = held.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # few rows for each group: one for each partition that has some of it
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    names = {g: f"_g{i}" for i, g in enumerate(group)}
    counts = counts.select(F.col("_part").alias("_p"), *[F.col(g).alias(n) for g, n in names.items()], "_ahead")
    on = F.col("_part") == F.col("_p")
    for g, n in names.items():
        on = on & F.col(g).eqNullSafe(F.col(n))
    return held.join(counts, on).select(*rows.columns, (F.col("_at") + F.col("_ahead")).cast("long").alias(name))
