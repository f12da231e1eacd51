"""Mixing sources to target weights over fixed-length blocks of words.

The words of a source, document after document by id, are cut into blocks of BLOCK_WORDS. The mix is a row of slots in
output shards of SHARD_SLOTS: for each shard the numbers of slots of the sources are a multinomial draw, conditioned on
every source's total over all shards being its target (shards are split in halves; how many of a source's slots fall in
the first half is a binomial draw with a seed of its own, the largest source takes what is left, so any task can find
any shard's counts by itself, and there is no size from which on something else is done). Slot j of a source with n
blocks takes block P(j mod n), where P is a pseudorandom permutation of the block numbers (a Feistel network with cycle
walking) keyed by source and round j div n. Slots and blocks are joined by source and block number.

Targets: sources by code point, null last, weigh WEIGHTS in turn; together they get SHARE of all words; a target stops
at MOST times its source's size and the excess is shared again by weight until none is above. Whole rounds take all
words of a source, the last round BLOCK_WORDS at a time and in its last slot only as many as the target still lacks. The
words taken differ from the target by less than a word, or by less than a block where the source's last, shorter block
is in the last round. No document is taken more than MOST times.

At scale: slim rows (no texts) are sorted by source and id over range partitions that grow in number with the rows, and
the words before a document are summed within a partition and over the partitions before it, so no task holds a source.
A source's size, not its texts, goes to the driver and, as three numbers, to the tasks that draw: sources must fit there
(some millions do). Joins are keyed by source and block, so a hot source is spread over tasks. Texts are shuffled once,
to the spans that are taken of them.

Defined results: null or white-space text has size 0 and takes 0; texts of any length count whole. A null source is a
source. Null ids come first within a source; repeated rows have their own words. An empty table gives an empty result.
Columns besides id, text and source are kept by mix_texts, whatever their names, and not looked at by mix_counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NARROW_BYTES, discard, free, materialize, parts_for, small_batches, sorted_rows, text_buffers, word_spans

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
BLOCK_WORDS, SHARD_SLOTS = 128, 4096
BROADCAST_SOURCES = 10_000
SEED = 20250101
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]]) -> list[tuple[str | None, int, float]]:
    """(source, size, target) of all sources, by code point and null last."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(order))]
    left, open_ = SHARE * sum(n for _, n in order), list(range(len(order)))
    out = [0.0] * len(order)
    while open_:
        unit = left / sum(weight[i] for i in open_)
        above = [i for i in open_ if weight[i] * unit > MOST * order[i][1]]
        if not above:
            for i in open_:
                out[i] = weight[i] * unit
            break
        for i in above:
            out[i] = MOST * order[i][1]
            left -= out[i]
        gone = set(above)
        open_ = [i for i in open_ if i not in gone]
    return [(s, n, t) for (s, n), t in zip(order, out)]


def _seeded(*words) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr((SEED, *words)).encode(), digest_size=16).digest(), "little"))


def _half(counts: np.ndarray, take: int, node: tuple[int, int]) -> np.ndarray:
    """How many of each source's slots fall among the first `take` of sum(counts): binomial draws, the largest source takes what is left."""
    total, top = int(counts.sum()), int(counts.argmax())
    out = _seeded(*node).binomial(counts, take / total)
    out[top] = take - (int(out.sum()) - int(out[top]))
    if not 0 <= out[top] <= counts[top]:  # the others were drawn too many or too few: move the difference on to them, in order
        over = int(out[top]) - int(np.clip(out[top], 0, counts[top]))
        out[top] -= over
        room = counts - out if over > 0 else out
        step = np.minimum(room, np.maximum(0, abs(over) - (np.cumsum(room) - room)))
        out += step if over > 0 else -step
    return out


def shard_counts(totals: np.ndarray, shard: int, slots: int = SHARD_SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """For a shard: the number of each source's slots in earlier shards, and in this one."""
    lo, hi, before, counts = 0, max(1, -(-int(totals.sum()) // slots)), np.zeros_like(totals), totals
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = _half(counts, (mid - lo) * slots, (lo, hi))
        if shard < mid:
            hi, counts = mid, first
        else:
            lo, before, counts = mid, before + first, counts - first
    return before, counts


def permuted(i: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """P(i) of a keyed pseudorandom permutation P of 0 .. n - 1, or the place of i in it with back."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = _seeded("round", key).integers(0, 1 << 63, 6, dtype=np.uint64)
    out, live = i.astype(np.uint64), np.arange(len(i))
    while len(live):
        x = out[live]
        left, right = x >> np.uint64(half), x & mask
        for k in rounds[::-1] if back else rounds:
            f = ((left if back else right) + k) * np.uint64(0x9E3779B97F4A7C15)
            f = ((f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) & mask
            left, right = (right ^ f, left) if back else (right, left ^ f)
        x = left << np.uint64(half) | right
        out[live] = x
        live = live[x >= np.uint64(n)]
    return out.astype(np.int64)


def _last_words(n: int, target: float, block_words: int, source: int) -> tuple[int, int]:
    """(slots, words of the last slot) of a source of n words; the last slot is whole but where the target ends within it."""
    if not n:
        return 0, 0
    blocks, whole = -(-n // block_words), int(target // n)
    rest = min(round(target - whole * n), n)
    slots_ = -(-rest // block_words)
    if not slots_:
        return whole * blocks, block_words
    short = n - (blocks - 1) * block_words
    # where the source's last, shorter block comes in the last round
    place = int(permuted(np.array([blocks - 1]), blocks, source * 4 + whole, back=True)[0])
    lacks = block_words - short if place < slots_ - 1 else 0
    last = rest - (slots_ - 1) * block_words + lacks
    return whole * blocks + slots_, min(last, block_words)


def slots(spark, plan: list[tuple[str | None, int, float]], block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, position (in the shard), source_no, round, block and most (words that are taken of it) of every slot of the mix."""
    blocks = np.array([-(-n // block_words) for _, n, _ in plan], np.int64)
    ends = [_last_words(n, t, block_words, i) for i, (_, n, t) in enumerate(plan)]
    totals, last = np.array([k for k, _ in ends], np.int64), np.array([w for _, w in ends], np.int64)
    shards = -(-int(totals.sum()) // shard_slots) if len(totals) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                before, counts = shard_counts(totals, shard, shard_slots)
                source = np.repeat(np.arange(len(totals)), counts)
                rounds, block, most = np.zeros(len(source), np.int64), np.zeros(len(source), np.int64), np.full(len(source), block_words)
                at = 0
                for s in np.flatnonzero(counts):
                    j = before[s] + np.arange(counts[s])
                    r = j // blocks[s]
                    for k in np.unique(r):
                        block[at : at + len(j)][r == k] = permuted(j[r == k] % blocks[s], int(blocks[s]), int(s) * 4 + int(k))
                    rounds[at : at + len(j)] = r
                    most[at : at + len(j)][j == totals[s] - 1] = last[s]
                    at += len(j)
                place = _seeded("order", shard).permutation(len(source))
                yield pa.record_batch([pa.array(np.full(len(source), shard)), pa.array(place), pa.array(source), pa.array(rounds), pa.array(block), pa.array(most)], ["shard", "position", "source_no", "round", "block", "most"])

    return spark.range(0, shards, 1, max(1, min(shards, parts_for(shards, 16)))).mapInArrow(run, "shard long, position long, source_no long, round long, block long, most long")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ahead: the words of the row's source before it in this partition. Rows come sorted by source."""
    held, total = None, 0
    for b in batches:
        no, size = b.column("source_no").to_numpy(), b.column("size").to_numpy()
        ahead = np.cumsum(size) - size
        cuts = np.flatnonzero(np.concatenate(([True], no[1:] != no[:-1]))) if len(no) else np.zeros(0, np.int64)
        for s, e in zip(cuts, [*cuts[1:], len(no)]):
            base = ahead[s]
            ahead[s:e] += (total if no[s] == held else 0) - base
            held, total = no[s], int(ahead[e - 1] + size[e - 1])
        yield pa.record_batch([*b.columns, pa.array(ahead, pa.int64())], [*b.schema.names, "ahead"])


def _laid_out(rows: DataFrame) -> tuple[DataFrame, list[tuple[str | None, int, float]]]:
    """rows (doc_id, source, size, tie and any others; slim) with source_no, source_size, target and start (words of its source before it)."""
    spark = rows.sparkSession
    plan = targets([(r[0], r[1]) for r in rows.groupBy("source").agg(F.sum("size")).collect()])  # one row for each source
    table = spark.createDataFrame([(i, s, n, t) for i, (s, n, t) in enumerate(plan)], "source_no long, s string, source_size long, target double")
    named = rows.join(F.broadcast(table) if len(plan) <= BROADCAST_SOURCES else table, rows["source"].eqNullSafe(table["s"])).drop("s", "source")
    order = [F.col("source_no"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("tie")]
    wide = T.StructType([*named.schema.fields, *[T.StructField(c, T.LongType()) for c in ("part", "at", "ahead")]])
    summed = sorted_rows(named, *order, rows=rows.count(), name="by-source", then=lambda d: d.mapInArrow(_running, wide))
    sums = summed.groupBy("source_no", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    sums = sums.select("source_no", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("earlier"))
    out = summed.join(F.broadcast(sums) if len(plan) <= BROADCAST_SOURCES else sums, ["source_no", "part"])
    return out.withColumn("start", F.col("ahead") + F.col("earlier")).drop("part", "at", "ahead", "earlier", "tie"), plan


def _pieces(rows: DataFrame, block_words: int, *keep: str) -> DataFrame:
    """For each row and block that it has words in: first (word of the row), offset (in the block) and words."""
    end = F.col("start") + F.col("size")
    at = rows.where("size > 0").select(*keep, "source_no", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))).alias("block"))
    lo, hi = F.greatest("start", F.col("block") * block_words), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return at.select(*keep, "source_no", "start", "block", (lo - F.col("start")).alias("first"), (lo - F.col("block") * block_words).alias("offset"), (hi - lo).alias("words"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _taken() -> Column:
    """Words of a piece that a slot takes: all but where the slot is the last of its source."""
    return F.greatest(F.lit(0), F.least(F.col("most") - F.col("offset"), F.col("words")))


def mix_counts(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs (doc_id, text, source)."""
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _size().alias("size"), F.xxhash64("text").alias("tie")), "sizes")
    rows, plan = _laid_out(sizes)
    rows = materialize(rows, "laid-out")
    discard(sizes)
    # slots grow with the corpus, which Spark can't see from the range that they are made of: never broadcast them
    drawn = slots(docs.sparkSession, plan, block_words).groupBy("source_no", "block", "most").agg(F.count("*").alias("times")).hint("merge")
    got = _pieces(rows, block_words).join(drawn, ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(_taken() * F.col("times")).alias("taken")).hint("merge")
    some = rows.where("size > 0").join(got, ["source_no", "start"], "left")
    cols = ["doc_id", "size", "source_size", "target"]
    return some.select(*cols, F.coalesce("taken", F.lit(0)).alias("taken")).unionByName(rows.where("size = 0").select(*cols, F.lit(0).cast("long").alias("taken")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns, text and spans (first, words), to the text of these words, as it stands; stretches are parted by a line end."""
    for b in batches:
        out = []
        *kept, text, held = b.columns
        for i, n, buf, offs in text_buffers(text):
            starts, ends, row = word_spans(buf, offs)
            first = np.searchsorted(row, np.arange(n + 1))
            raw = buf.tobytes()
            for r, spans in enumerate(held.slice(i, n).to_pylist()):
                merged: list[list[int]] = []
                for s in sorted((x["first"], x["words"]) for x in spans):
                    if merged and merged[-1][1] == s[0]:
                        merged[-1][1] = s[0] + s[1]
                    else:
                        merged.append([s[0], s[0] + s[1]])
                k = first[r]
                out.append(b"\n".join(raw[starts[k + a] : ends[k + z - 1]] for a, z in merged).decode(errors="replace"))
        yield pa.record_batch([*kept, pa.array(out, pa.string())], b.schema.names[:-1])


def mix_texts(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as rows with the columns of docs: for each row and round, the words that the mix takes of it (rows without any are left out).

    n_chars, where docs has it, is that of the new text.
    """
    small_batches(docs.sparkSession, NARROW_BYTES)
    row, size, tie = free("row", docs), free("size", docs), free("tie", docs)
    held = materialize(docs.withColumns({row: F.monotonically_increasing_id(), size: _size(), tie: F.xxhash64("text")}).where(F.col(size) > 0), "sized")
    slim = held.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", F.col(size).alias("size"), F.col(tie).alias("tie"))
    rows, plan = _laid_out(slim)
    drawn = slots(docs.sparkSession, plan, block_words).select("source_no", "round", "block", "most").hint("merge")
    taken = _pieces(rows, block_words, "row").join(drawn, ["source_no", "block"]).select("row", "round", "first", _taken().alias("words")).where("words > 0")
    spans = taken.groupBy("row", "round").agg(F.collect_list(F.struct("first", "words")).alias("spans"))
    spans = spans.select(F.col("row").alias(row), F.col("spans").alias(free("spans", held))).hint("merge")
    fields = [c for c in docs.columns if c != "text"]
    found = held.join(spans, row).select(*fields, "text", spans.columns[1])
    cut = found.mapInArrow(_cut, T.StructType([*[docs.schema[c] for c in fields], docs.schema["text"]]))
    if "n_chars" in fields:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)
