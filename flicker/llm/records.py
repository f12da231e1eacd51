"""Token ids as length-delimited binary records, with an offset index beside them for shuffled reads.

A data file is a row of frames, each with masked CRC-32C checksums of its length and of its data:

    length of the data, unsigned 64 bits | masked checksum of these 8 bytes | data | masked checksum of the data

all little-endian, so any reader of this common record layout can open the files. The data of a document is HEAD (its id,
flags, number of ids) and the ids in 2 bytes each where the vocabulary allows it, else in 4. After every chunk of about
CHUNK_BYTES of frames stands an empty frame, a sync mark that readers pass over. The index is a table of its own with a
row for each document: file, nth, doc_id, first (ids before it in its file), n_tokens, offset and length of its frame. It
is made from the files themselves, so it can be made anew at any time, and it is all that an epoch's order needs: `epoch`
deals the documents by a keyed permutation of index rows, `fetch` cuts just these frames out of the files.

At scale: texts are sorted by (id, place in the input) over range partitions, so a hot id is split as well, and tokenised
behind that one shuffle. Spark's own text sink writes the chunks as bytes and commits the files, so a lost task leaves
nothing behind and every store that Spark writes to will do. Files hold CHUNKS chunks, or one document that is larger than
that. A document's global place needs one number for each file.

Defined results: a null or empty text is the end id alone. Null ids come first, rows of one id in the order that Spark
reads them. Texts of any length are one record. An empty table gives no records. Other columns aren't looked at. A file
that is cut off, or of which a byte was changed, raises ValueError when it is read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, parts_for, remove, scratch_path, small_batches
from .packing import tokenizer

#: Bytes of frames in a value that Spark writes, and such values in a file.
CHUNK_BYTES, CHUNKS = 4 << 20, 4
#: Documents of a range partition.
RANGE_ROWS = 8192
#: Index rows whose frames are looked up by a broadcast.
BROADCAST_ENTRIES = 200_000
#: doc_id (0 if null), flags, number of ids.
HEAD, HEAD_BYTES = "<qII", 16
NULL_ID, WIDE = 1, 2
#: Fixed values of the checksum: the reversed Castagnoli polynomial, and the number that masking adds.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8


# ---------------------------------------------------------------- checksums


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1)).astype(np.uint32)
    return t


class Crc32c:
    """CRC-32C of many byte strings at once.

    The register is linear, so strings are cut, from their ends, into blocks of BLOCK bytes that all go through it side by
    side, four bytes a step. What a block adds behind 1 to 255 further blocks comes from a table, groups of 256 blocks are
    put together in the same way by a table of 256 times the distance, and so on, whatever the length is.
    """

    BLOCK = 256

    def __init__(self):
        self.one = _byte_table()
        halves = np.stack([np.arange(1 << 16, dtype=np.uint32), np.arange(1 << 16, dtype=np.uint32) << np.uint32(16)])
        for _ in range(4):
            halves = self.one[halves & 0xFF] ^ (halves >> np.uint32(8))
        self.low, self.high = halves  # the register four bytes on, from its lower and its upper half
        self.levels: list[np.ndarray] = []  # [level][distance][byte of the register][value]

    def _shift(self, level: int) -> np.ndarray:
        """What each byte of a register becomes behind 0 to 255 times BLOCK * 256 ** level zero bytes."""
        while len(self.levels) <= level:
            at = np.zeros((256, 4, 256), np.uint32)
            at[0] = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * b) for b in range(4)])
            if self.levels:
                step = self._apply(self.levels[-1][255], self.levels[-1][1])
            else:
                step = at[0]
                for _ in range(self.BLOCK):
                    step = self.one[step & 0xFF] ^ (step >> np.uint32(8))
            for d in range(1, 256):
                at[d] = self._apply(at[d - 1], step)
            self.levels.append(at)
        return self.levels[level]

    @staticmethod
    def _apply(values: np.ndarray, step: np.ndarray) -> np.ndarray:
        out = np.zeros_like(values)
        for b in range(4):
            out ^= step[b][(values >> np.uint32(8 * b)) & np.uint32(0xFF)]
        return out

    def __call__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Checksums of data[start : start + size] for each start; spans may lie anywhere, empty ones too."""
        out = np.zeros(len(starts), np.uint32)
        some = np.flatnonzero(sizes)
        for group in np.split(some, np.flatnonzero(np.diff(np.cumsum(sizes[some]) >> 20)) + 1) if len(some) else []:
            n = sizes[group]
            blocks = -(-n // self.BLOCK)
            ends = np.cumsum(blocks) * self.BLOCK
            held = np.zeros(ends[-1], np.uint8)  # zeros in front of a string leave an empty register as it is
            for end, start, size in zip(ends.tolist(), starts[group].tolist(), n.tolist()):
                held[end - size : end] = data[start : start + size]
                held[end - size : min(end, end - size + 4)] ^= 0xFF  # the ones that the register starts with
            words = np.ascontiguousarray(held.view("<u4").reshape(-1, self.BLOCK // 4).T)
            value = np.zeros(words.shape[1], np.uint32)
            for w in words:
                value ^= w
                value = self.low[value & np.uint32(0xFFFF)] ^ self.high[value >> np.uint32(16)]
            own = np.repeat(np.arange(len(group)), blocks)
            back = np.repeat(np.cumsum(blocks), blocks) - np.arange(len(own)) - 1  # blocks behind each
            level = 0
            while back.any():
                at, d = self._shift(level), back & 0xFF
                value = at[d, 0, value & 0xFF] ^ at[d, 1, (value >> 8) & 0xFF] ^ at[d, 2, (value >> 16) & 0xFF] ^ at[d, 3, value >> 24]
                back = back >> 8
                cut = np.flatnonzero(np.concatenate(([True], (np.diff(own) != 0) | (np.diff(back) != 0))))
                value, own, back = np.bitwise_xor.reduceat(value, cut), own[cut], back[cut]
                level += 1
            short = n < 4  # ones that are left over move on with the bytes
            value[short] ^= np.uint32(0xFFFFFFFF) >> (np.uint32(8) * n[short].astype(np.uint32))
            out[group] = value ^ np.uint32(0xFFFFFFFF)
        return out


_crc: list[Crc32c] = []


def masked(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Masked checksums: rotated by 15 bits, and a number added, so that checksums of checksums are sound."""
    if not _crc:
        _crc.append(Crc32c())
    c = _crc[0](data, starts, sizes)
    return ((c >> np.uint32(15)) | (c << np.uint32(17))) + np.uint32(MASK)


# ---------------------------------------------------------------- frames


def frame(parts: list[bytes]) -> bytes:
    """The frames of parts, one behind the other."""
    sizes = np.array([len(p) for p in parts], np.int64)
    lengths = sizes.astype("<u8").view(np.uint8)
    data = np.frombuffer(b"".join(parts), np.uint8)
    heads = masked(lengths, np.arange(len(parts)) * 8, np.full(len(parts), 8)).astype("<u4")
    tails = masked(data, np.cumsum(sizes) - sizes, sizes).astype("<u4")
    return b"".join(x for n, h, p, t in zip(sizes.tolist(), heads, parts, tails) for x in (struct.pack("<Q", n), h.tobytes(), p, t.tobytes()))


SYNC = frame([b""])


def frames(data: bytes, name: str = "file") -> tuple[np.ndarray, np.ndarray]:
    """Places and sizes of the data of all frames of a file; checks the lengths and their checksums."""
    at, found = 0, []
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError(f"{name} ends inside the frame at {at}")
        (n,) = struct.unpack_from("<Q", data, at)
        if n > len(data) - at - 16:
            raise ValueError(f"{name}: the frame at {at} doesn't fit")
        found.append((at + 12, n))
        at += n + 16
    starts, sizes = np.array(found, np.int64).reshape(-1, 2).T
    raw = np.frombuffer(data, np.uint8)
    if len(starts) and (masked(raw, starts - 12, np.full(len(starts), 8)) != _words(raw, starts - 4)).any():
        raise ValueError(f"{name}: a length doesn't match its checksum")
    return starts, sizes


def _words(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw[at[:, None] + np.arange(4)]).view("<u4").ravel()


def check(data: bytes, starts: np.ndarray, sizes: np.ndarray, name: str = "file") -> None:
    raw = np.frombuffer(data, np.uint8)
    if len(starts) and (masked(raw, starts, sizes) != _words(raw, starts + sizes)).any():
        raise ValueError(f"{name}: data don't match their checksum")


def pack_ids(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    flags = NULL_ID * (doc_id is None) | WIDE * wide
    return struct.pack(HEAD, doc_id or 0, flags, len(ids)) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack_ids(data: bytes, start: int, size: int) -> tuple[int | None, np.ndarray]:
    """doc_id and ids (unsigned 32-bit) of a record's data."""
    doc_id, flags, n = struct.unpack_from(HEAD, data, start)
    width = 4 if flags & WIDE else 2
    if size != HEAD_BYTES + n * width:
        raise ValueError(f"a record of {n} ids has {size} bytes")
    return None if flags & NULL_ID else doc_id, np.frombuffer(data, f"<u{width}", n, start + HEAD_BYTES).astype("<u4")


# ---------------------------------------------------------------- writing


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, range_rows: int = RANGE_ROWS) -> None:
    """Writes data files below path/data, in ascending order of ids, and the index below path/index."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        wide = max(len(tok.ends) - 1, end_id) > 0xFFFF
        parts, size = [], 0

        def chunk() -> pa.RecordBatch:
            return pa.record_batch([pa.array([frame(parts)], pa.binary())], ["value"])

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), tok.ids(b.column(1))):
                ids[-1] = end_id
                parts.append(pack_ids(doc_id, ids, wide))
                size += len(parts[-1]) + 16
                if size >= chunk_bytes:
                    yield chunk()
                    parts, size = [], 0
        if parts:
            yield chunk()

    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts_for(rows.count(), range_rows, 8), *order).sortWithinPartitions(*order)
    chunks = dealt.select("doc_id", "text").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    sink = chunks.write.option("maxRecordsPerFile", CHUNKS).option("encoding", "ISO-8859-1").option("lineSep", SYNC.decode("latin-1"))
    sink.text(f"{path}/data")
    index_files(spark, path).write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select(F.substring_index("path", "/", -1).alias("file"), "content")


INDEX = "file string, nth long, doc_id long, first long, n_tokens long, offset long, length long"


def index_files(spark: SparkSession, path: str) -> DataFrame:
    """The index of the data files below path, from their frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_py()
                starts, sizes = frames(data, file)
                starts, sizes = starts[sizes > 0], sizes[sizes > 0]
                heads = [struct.unpack_from(HEAD, data, s) for s in starts.tolist()]
                n = np.array([h[2] for h in heads], np.int64)
                cols = [pa.array([file] * len(n)), pa.array(np.arange(len(n))), pa.array([None if h[1] & NULL_ID else h[0] for h in heads], pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(starts - 12), pa.array(sizes + 16)]
                yield pa.record_batch(cols, [x.split()[0] for x in INDEX.split(", ")])

    return _files(spark, path).mapInArrow(run, INDEX)


# ---------------------------------------------------------------- reading


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with start: the ids of all documents before one, over all files in order."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    task = F.regexp_extract("file", r"^part-(\d+)-", 1).cast("long")
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("ids")).select("file", "ids", task.alias("task"))
    # files of a task by name, then one row for each task
    inside = Window.partitionBy("task").orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    tasks = files.groupBy("task").agg(F.sum("ids").alias("ids"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ahead"))
    starts = files.withColumn("in_task", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(tasks, "task").select("file", (F.col("ahead") + F.col("in_task")).alias("ahead"))
    return index.join(starts, "file").select(*index.columns, (F.col("ahead") + F.col("first")).alias("start"))


RECORD = "file string, nth long, doc_id long, n_tokens long, ids_crc32 long"


def _rows(data: bytes, file: str, nths, starts: np.ndarray, sizes: np.ndarray, with_ids: bool) -> Iterator[pa.RecordBatch]:
    check(data, starts, sizes, file)
    rows, held = [], 0
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    names = [x.split()[0] for x in RECORD.split(", ")] + ["ids"] * with_ids
    for nth, start, size in zip(nths, starts.tolist(), sizes.tolist()):
        doc_id, ids = unpack_ids(data, start, size)
        rows.append((file, nth, doc_id, len(ids), zlib.crc32(ids), *([ids.astype(np.int32)] * with_ids)))
        held += 4 * len(ids) * with_ids + 64
        if held > CHUNK_BYTES:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows, held = [], 0
    if rows:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_records(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """All records: file, nth (place in its file), doc_id, n_tokens, ids_crc32 and, if asked for, ids. Every checksum is held against its data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_py()
                starts, sizes = frames(data, file)
                starts, sizes = starts[sizes > 0], sizes[sizes > 0]
                yield from _rows(data, file, range(len(starts)), starts, sizes, with_ids)

    return _files(spark, path).mapInArrow(run, RECORD + (", ids array<int>" if with_ids else ""))


def epoch(index: DataFrame, key: int, ranks: int = 1) -> DataFrame:
    """The index in the order of an epoch: rank (the reader that takes a record) and turn, a hash that orders the records of a rank. No data are read."""
    own: Column = F.xxhash64(F.lit(key), "file", "nth")
    return index.withColumn("turn", F.xxhash64(F.lit(~key), "file", "nth")).withColumn("rank", F.pmod(own, F.lit(ranks)).cast("int"))


def fetch(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """The records of some index rows (file, nth, offset, length), with ids: only their frames are cut out and checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                data = content.as_py()
                at = np.array([w["offset"] for w in wanted], np.int64)
                size = np.array([w["length"] for w in wanted], np.int64) - 16
                if (at + size + 16 > len(data)).any():
                    raise ValueError(f"{file} is shorter than its index says")
                raw = np.frombuffer(data, np.uint8)
                if (masked(raw, at, np.full(len(at), 8)) != _words(raw, at + 8)).any():
                    raise ValueError(f"{file}: a length doesn't match its checksum")
                yield from _rows(data, file, [w["nth"] for w in wanted], at + 12, size, True)

    small = entries.count() <= BROADCAST_ENTRIES
    wanted = entries.groupBy("file").agg(F.collect_list(F.struct("nth", "offset", "length")).alias("wanted"))  # at most a file's records
    files = _files(spark, path).join(F.broadcast(wanted) if small else wanted, "file")
    return files.select("file", "content", "wanted").mapInArrow(run, RECORD + ", ids array<int>")


def encode_and_read(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes the records of docs, reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = scratch_path(spark, "records")
    write_records(docs, path, tokenizer_path, end_id)
    places = read_index(spark, path).select("file", "nth", "start")
    out = materialize(read_records(spark, path, with_ids=False).join(places, ["file", "nth"]).select("doc_id", "start", "n_tokens", "ids_crc32"), "read-back")
    remove(spark, path)
    return out
