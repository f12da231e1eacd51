"""Sharding by jump consistent hashing: the id and the number of shards decide, no ring table is kept.

When shards are appended, a row either stays or goes to one of the new shards; about 1 / n of the rows move.
Law: `key`. Rows of equal text go where their own ids send them.

At scale: the shard is a vectorised function of the id; texts aren't shuffled, only (id, size, crc32, shard) rows.
These rows are sorted by (shard, id, size, checksum) over range partitions that grow in number with the rows and split
repeated rows too; a row's slot is its place in its partition and what earlier partitions hold of the shard.

Defined results: a null id hashes as 0 and comes first; a null text has size 1 and the crc32 of no bytes (0). Texts of
any length count whole. Repeated rows go to the same shard and get slots of their own. An empty table gives an empty
result. Extra columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sorted_rows

#: Fixed values of the published algorithm: a linear congruential step and 2 ** 31.
STEP, SPAN = 2862933555777941757, float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    key = keys.astype(np.int64).view(np.uint64).copy()
    b = np.zeros(len(key), np.int64)
    j = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        b[live] = j[live]
        key[live] = key[live] * np.uint64(STEP) + np.uint64(1)
        j[live] = ((b[live] + 1) * (SPAN / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[j[live] < shards]
    return b


def jump_hash(col: str, shards: int):
    @F.pandas_udf("int")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series(jump(ids.fillna(0).to_numpy(np.int64), shards).astype(np.int32))

    return run(F.coalesce(F.col(col), F.lit(0)))


def shard_by_key(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = materialize(rows.withColumn("shard", jump_hash("doc_id", shards)).withColumn("grown_shard", jump_hash("doc_id", shards + 1)), "sharded")
    order = ["shard", "doc_id", "size", "text_crc32"]
    held = sorted_rows(rows, *[F.col(c) for c in order], rows=rows.count(), name="shards")
    counts = held.groupBy("shard", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = counts.select("shard", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("start"))
    out = held.join(F.broadcast(starts), ["shard", "part"])  # at most one row for each partition and shard
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at")).alias("slot"), "grown_shard")
