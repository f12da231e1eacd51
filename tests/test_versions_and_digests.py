"""Tables replaced as a whole, digests of any number of values, seconds measured inside the tasks."""

import hashlib
import os
import time

import pytest
from pyspark.sql import functions as F

from flicker.functions.methods import candidates
from flicker.operators import integrity as I
from flicker.operators import series as S
from flicker.operators import smoothing as H
from flicker.plans import benchmark as B
from flicker.sources import versions as V


def test_a_reader_sees_whole_versions(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        V.read_current(spark, path)
    V.publish(spark.range(10), path)
    before = V.read_current(spark, path)
    V.publish(spark.range(100, 130), path)
    assert before.count() == 10  # a reader that is at work keeps its version
    assert V.read_current(spark, path).agg(F.min("id"), F.count("*")).first() == (100, 30)


def test_a_failed_job_leaves_the_old_version(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    V.publish(spark.range(10), path)
    bad = spark.range(20).withColumn("id", F.when(F.col("id") == 19, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="no"):
        V.publish(bad, path)
    assert V.read_current(spark, path).count() == 10
    for k in range(4):
        V.publish(spark.range(k), path)
    assert V.read_current(spark, path).count() == 3
    assert sum(n.startswith("v-") for n in os.listdir(f"{tmp_path}/table")) == V.KEEP


def tree(values, block):
    level = [hashlib.sha256(b"".join(values[i : i + block])).digest() for i in range(0, len(values), block)]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + block])).digest() for i in range(0, len(level), block)]
    return level[0].hex()


def test_tree_digests(spark, monkeypatch):
    """Keys of one value to one with most of the rows, also null, over three levels of blocks of 4."""
    monkeypatch.setattr(I, "BLOCK_BITS", 2)
    rows = [(k, i, i * 7919 - 2**62 * (i % 3)) for k, n in ((1, 1), (2, 4), (3, 5), (4, 16), (5, 17), (6, 150), (None, 6)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, v long").repartition(5)
    got = {r["k"]: (r["values"], r["digest"]) for r in I.tree_digest(df, ["k"], "i", I.little_endian(F.col("v"))).collect()}
    for key in {r[0] for r in rows}:
        own = [v.to_bytes(8, "little", signed=True) for k, _, v in rows if k == key]
        assert got[key] == (len(own), tree(own, 4))


def test_seconds_inside_the_tasks(spark):
    frames = spark.range(4000).selectExpr("id % 4 AS run_id", "0L AS feature_id", "id div 4 AS frame", "CAST(xxhash64(id) % 2 = 0 AS TINYINT) AS x")
    methods = candidates(0.1)
    chunks = S.to_chunks(frames, 200).withColumn("zs", F.col("xs"))
    began = time.perf_counter()
    sums = H.error_sums(chunks, methods, 0.1, timed=True)
    got = {r["method"]: r for r in B.seconds(sums).collect()}
    wall = time.perf_counter() - began
    assert {m: r["candidates"] for m, r in got.items()} == {m.name: sum(x.name == m.name for x in methods) for m in methods}
    assert all(r["cells"] == 4000 * r["candidates"] and r["seconds"] > 0 for r in got.values())
    assert sum(r["seconds"] for r in got.values()) < 4 * wall
    plain = H.error_sums(chunks, methods, 0.1)
    assert plain.columns == [c for c in sums.columns if c != "seconds"]
