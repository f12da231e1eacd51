"""Tables that are replaced as a whole: every version is a folder of its own, and a small pointer names the current one.

A version is written first; then the pointer is written beside it and renamed over the old one, which file systems do in
one step. A reader opens the folder that the pointer names, so it sees a whole version, the old or the new one, and a job
that fails leaves the old one in place. The last versions are kept for readers that are still at work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER, KEEP = "CURRENT", 2


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version, or None if there is no version."""
    jvm, root, fs = _files(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(root, POINTER)
    if not fs.exists(pointer):
        return None
    with_name = fs.open(pointer)
    try:
        name = bytes(jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(with_name)).decode()
    finally:
        with_name.close()
    return f"{path.rstrip('/')}/{name}"


def publish(df: DataFrame, path: str) -> str:
    """Writes df as the new version of the table at path and makes it the current one; gives its folder."""
    spark = df.sparkSession
    jvm, root, fs = _files(spark, path)
    was = current(spark, path)
    name = f"v-{jvm.System.currentTimeMillis():015d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{name}")
    beside = jvm.org.apache.hadoop.fs.Path(root, f".{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.write(bytearray(name.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, jvm.org.apache.hadoop.fs.Path(root, POINTER), over)
    kept = {was.rsplit("/", 1)[1] if was else "", name}
    versions = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("v-"))
    for old in versions[:-KEEP]:
        if old not in kept:
            fs.delete(jvm.org.apache.hadoop.fs.Path(root, old), True)
    return f"{path.rstrip('/')}/{name}"


def read_current(spark: SparkSession, path: str) -> DataFrame:
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no version of {path}")
    return spark.read.parquet(folder)
