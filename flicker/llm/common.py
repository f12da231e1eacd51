"""Shared helpers: scratch tables in the cluster's shared folder, global order, and byte-level text kernels."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of texts handed to Python at once, and bytes that the numpy kernels expand at once.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: Bytes at once where a worker or executor holds much besides: a model, or sorted texts.
NARROW_BYTES = 2 << 20
CHUNK_BYTES = 1 << 20

_own_dirs: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. A folder of our own where that is unset, in local mode (tests) only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dirs.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="flicker-"))
    return f"{base.rstrip('/')}/flicker-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialize that no later step reads."""
    for t in tables:
        remove(t.sparkSession, t.scratch)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Texts can be long: bound the rows and bytes of an Arrow batch for the Python operators of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free(name: str, *tables: DataFrame) -> str:
    """name, with underscores after it until no column of the tables has it."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_mod(col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod, F.lit(0))


def parts_for(rows: int, per: int, least: int = 1) -> int:
    return max(least, -(-rows // per))


# ---------------------------------------------------------------- byte kernels

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift rounds): a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOW[buf]


def heads(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 8 and the next 8 bytes of each span as numbers, zero behind its end: with the length, all of a span of at most 16 bytes."""
    pad = np.concatenate((buf, np.zeros(16, np.uint8)))
    words = np.ndarray(len(pad) - 7, "<u8", pad, strides=(1,))  # eight bytes from every place
    size = ends - starts
    shift = (np.uint64(8) * (np.uint64(8) - np.clip(size, 1, 8).astype(np.uint64))) & np.uint64(63)
    a = words[starts] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> shift)
    more = np.clip(size - 8, 0, 8).astype(np.uint64)
    b = np.zeros(len(a), np.uint64)
    at = np.flatnonzero(more)
    b[at] = words[starts[at] + 8] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - more[at])))
    return a, b


class WordHash:
    """Keyed 64-bit hashes of words: multilinear in the four quarters of words up to 16 bytes, keyed blake2b beyond.

    Two different words collide with a chance of about 2^-64 over the key, whatever the words are, so texts that don't
    know the key can't be made to collide. A key is drawn for each job.
    """

    def __init__(self, key: bytes):
        self.key = key
        self.k = np.random.default_rng(list(key)).integers(0, 1 << 63, (2, 5), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        import hashlib

        a, b = heads(buf, starts, ends)
        low = np.uint64(0xFFFFFFFF)
        size = (ends - starts).astype(np.uint64)
        parts = (a & low, a >> np.uint64(32), b & low, b >> np.uint64(32))
        lane = [np.uint64(k[4]) * (size + np.uint64(1)) + sum(np.uint64(c) * x for c, x in zip(k, parts)) for k in self.k]
        out = (lane[0] >> np.uint64(32) << np.uint64(32)) | (lane[1] >> np.uint64(32))
        for i in np.flatnonzero(size > 16):
            out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, key=self.key).digest(), "little")
        return out


def text_buffers(col: pa.Array):
    """Yields (first row, row count, bytes, offsets of count + 1) of a string column, about CHUNK_BYTES at once; nulls are empty."""
    col = col.cast(pa.large_string()).fill_null("")
    raw = col.buffers()
    offs = np.frombuffer(raw[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK_BYTES, "right")) - 1)
        j = min(j, len(col))
        yield i, j - i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the white-space separated words; words never cross rows."""
    w = ~WHITE[buf]
    if not w.any():
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    before = np.concatenate(([False], w[:-1]))
    after = np.concatenate((w[1:], [False]))
    starts = np.flatnonzero(w & (~before | first[:-1]))
    ends = np.flatnonzero(w & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


# ---------------------------------------------------------------- order without one task


def sorted_rows(df: DataFrame, *keys: Column, rows: int, per: int = 1 << 20, name: str = "sorted", then=None) -> DataFrame:
    """df, written in the order of keys over all its partitions, with `part` and `at`: the number of a row's partition and its place in it.

    Partitions hold about `per` rows however many there are. The last key is the row's place in its input, so rows with
    equal keys are split as well. df should be slim. then: what is done to the sorted partitions before they are written.
    """
    tie = free("tie", df)
    held = df.withColumn(tie, F.monotonically_increasing_id())
    order = [*keys, F.col(tie)]
    dealt = held.repartitionByRange(parts_for(rows, per, 8), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # counts from 0 in each partition, below bit 33
    dealt = dealt.drop(tie).withColumn("place", place)
    out = dealt.withColumns({"part": F.shiftright("place", 33), "at": F.col("place").bitwiseAND((1 << 33) - 1)}).drop("place")
    return materialize(then(out) if then else out, name)


def order_ranges(df: DataFrame, keys: dict[str, Column], rows: int, per: int) -> Column:
    """The number (ascending) of the range of about `per` rows that a row of df belongs to by the order of keys (longs, not null).

    Bounds are every per-th row of the slim sorted keys, so there are as many as the rows need, equal values of the
    first keys are split by the later ones, and ranges are even whatever the values are. Looked up in steps of 128
    comparisons.
    """
    slim = df.select(*[c.alias(k) for k, c in keys.items()])
    held = sorted_rows(slim, *[F.col(k) for k in keys], rows=rows, name="ranges")
    ahead, before = {}, 0
    for part, n in sorted(held.groupBy("part").agg(F.count("*")).collect()):  # one row for each partition
        ahead[part], before = before, before + n
    table = df.sparkSession.createDataFrame(list(ahead.items()) or [(0, 0)], "part long, ahead long")
    cut = held.join(F.broadcast(table), "part").where((F.col("at") + F.col("ahead")) % per == per - 1).select(*keys)
    bounds = sorted(tuple(r) for r in cut.collect())  # one row for each range
    discard(held)
    if not bounds:
        return F.lit(0)
    here = F.struct(*[c.alias(k) for k, c in keys.items()])
    kind = "array<struct<" + ", ".join(f"{k}: bigint" for k in keys) + ">>"
    levels = [bounds]
    while len(levels[0]) > 128:
        levels.insert(0, levels[0][127::128])
    found = None
    for level in levels:
        text = "[" + ",".join("{" + ",".join(f'"{k}":{v}' for k, v in zip(keys, b)) + "}" for b in level) + "]"
        whole = F.from_json(F.lit(text), kind)  # a literal: folded when the plan is made
        some = whole if found is None else F.slice(whole, found * 128 + 1, F.lit(128))
        n = F.size(F.filter(some, lambda b: b < here))
        found = n if found is None else found * 128 + n
    return found


# ---------------------------------------------------------------- code points

SPACE = 0x20
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point of the basic plane: its lower-case letter, or a space for what is no letter."""
    global _letters
    if _letters is None:
        t = np.full(1 << 16, SPACE, np.uint32)
        for c in range(1 << 16):
            if (x := chr(c)).isalpha():
                t[c] = ord(low) if len(low := x.lower()) == 1 else c
        _letters = t
    return _letters


def letters(col: pa.Array):
    """Yields (first row, row count, lower-case letters with spaces for all else, offsets) of a string column."""
    table = letter_table()
    for i, n, buf, offs in text_buffers(col):
        raw = buf.tobytes()
        try:
            text = raw.decode()
            cut = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[offs]
        except UnicodeDecodeError:
            each = [raw[a:b].decode(errors="replace") for a, b in zip(offs, offs[1:])]
            text, cut = "".join(each), np.concatenate(([0], np.cumsum([len(x) for x in each], dtype=np.int64)))
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = table[np.minimum(cps, 0xFFFF)]
        for c in np.unique(cps[cps > 0xFFFF]).tolist():
            low[cps == c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else SPACE
        yield i, n, low, cut


def least_hashed(df: DataFrame, by: str, per: int) -> DataFrame:
    """For each value of by: the per ids with the least hashes, one row each. df: doc_id and by (a class label: few values).

    Only ids below a hash limit are ranked: it follows from the count of a value, so that somewhat more than per are left
    whatever the count is. A value with fewer below its limit (a chance below 1e-9) is ranked whole.
    """
    one = materialize(df.groupBy("doc_id").agg(F.min(by).alias(by)).withColumn("u", F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))), "labelled")
    held = dict(one.groupBy(by).agg(F.count("*")).collect())  # one row for each class

    def below(limits: dict) -> DataFrame:
        table = one.sparkSession.createDataFrame(list(limits.items()) or [(None, 0.0)], f"{by} string, most double")
        return one.join(F.broadcast(table), by).where("u < most")

    want = per + 8 * per**0.5 + 64
    limits = {k: want / n for k, n in held.items()}
    got = dict(below(limits).groupBy(by).agg(F.count("*")).collect())
    near = below({k: 2.0 if got.get(k, 0) < min(per, held[k]) else v for k, v in limits.items()})
    order = Window.partitionBy(by).orderBy("u", "doc_id")
    return near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per).select("doc_id", by)
