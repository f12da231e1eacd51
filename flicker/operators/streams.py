"""NumPy's own random streams by block: the numbers of default_rng(SeedSequence(words)) at any place, without those before it.

Uniforms: the generator steps a 128-bit state by a multiplication and an addition modulo 2^128, so the state k steps on is
one multiplication and one addition too, for constants that squaring gives in log k steps. One number is one step, so cell
(frame, column) of an array of so many columns is number frame * columns + column, and the numbers of a column are those
of a generator with a longer step.

Normals take one number mostly, sometimes more, so where the k-th begins depends on all before it. The stream is cut
into spans of numbers; a span is read from each of its first few numbers on, as if a normal began there. Each reading
gives how many normals begin in the span and where, in the next one, the first of them begins: a small map from entry to
exit for each span. These maps are composed over the spans, which says where every normal begins; blocks are then drawn
by the generator itself from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import arrow_batches, persisted

#: Fixed value: the multiplier of the generator's step.
MULTIPLIER = 0x2360ED051FC65DA44385DF649FCCF645
_MOST = (1 << 128) - 1
_LOW = np.uint64(0xFFFFFFFF)
#: Numbers of a span, and entries that a span is read from; a normal takes more than ENTRIES numbers with a chance below 1e-12.
SPAN, ENTRIES = 1 << 20, 16


# ---------------------------------------------------------------- the generator


def seeded(words) -> tuple[int, int]:
    """State and increment of the generator of some seed words."""
    s = np.random.PCG64(np.random.SeedSequence([int(w) for w in words])).state["state"]
    return s["state"], s["inc"]


def jump(steps: int, increment: int) -> tuple[int, int]:
    """a, c such that so many steps take state s to a s + c."""
    a, c, by, add = 1, 0, MULTIPLIER, increment
    while steps:
        if steps & 1:
            a, c = a * by & _MOST, (c * by + add) & _MOST
        by, add = by * by & _MOST, (add * by + add) & _MOST
        steps >>= 1
    return a, c


def _times(hi: np.ndarray, lo: np.ndarray, a: int, c: int) -> tuple[np.ndarray, np.ndarray]:
    """a * (hi, lo) + c modulo 2^128, in halves."""
    ah, al = np.uint64(a >> 64), np.uint64(a & 0xFFFFFFFFFFFFFFFF)
    ch, cl = np.uint64(c >> 64), np.uint64(c & 0xFFFFFFFFFFFFFFFF)
    a0, a1, l0, l1 = al & _LOW, al >> np.uint64(32), lo & _LOW, lo >> np.uint64(32)
    low, mid, cross = l0 * a0, l1 * a0, l0 * a1
    carry = (low >> np.uint64(32)) + (mid & _LOW) + (cross & _LOW)
    high = l1 * a1 + (mid >> np.uint64(32)) + (cross >> np.uint64(32)) + (carry >> np.uint64(32)) + hi * al + lo * ah
    new = lo * al + cl
    return high + ch + (new < cl), new


def uniforms(words, start: int, step: int, n: int) -> np.ndarray:
    """Numbers start, start + step, ... of default_rng(SeedSequence(words)).random(): n of them."""
    state, inc = seeded(words)
    a, c = jump(start + 1, inc)  # a number is made of the state after its step
    first = (a * state + c) & _MOST
    hi, lo = np.empty(n, np.uint64), np.empty(n, np.uint64)
    if n:
        hi[0], lo[0] = first >> 64, first & 0xFFFFFFFFFFFFFFFF
    done, (a, c) = 1, jump(step, inc)
    while done < n:  # twice as many each time, that many steps further on
        m = min(done, n - done)
        hi[done : done + m], lo[done : done + m] = _times(hi[:m], lo[:m], a, c)
        a, c = a * a & _MOST, (a * c + c) & _MOST
        done += m
    turn = hi >> np.uint64(58)
    x = hi ^ lo
    x = (x >> turn) | (x << ((np.uint64(64) - turn) & np.uint64(63)))
    return (x >> np.uint64(11)) * 2.0**-53


# ---------------------------------------------------------------- flips

_KEYS = ("run_id", "feature_id")


def _rows(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, its series and its uniforms, which begin at its first frame."""
    get = lambda c: b.column(b.schema.get_field_index(c))
    lo, pre, column, columns = (get(c).to_pylist() for c in ("lo", "pre", "column", "columns"))
    for r, (words, x) in enumerate(zip(get("words").to_pylist(), get("xs"))):
        x = x.values.to_numpy(zero_copy_only=False)
        yield r, x, uniforms(words, (lo[r] - pre[r]) * columns[r] + column[r], columns[r], len(x))


def _with_lists(b: pa.RecordBatch, keep: list[str], lists: list[np.ndarray], name: str) -> pa.RecordBatch:
    offs = np.concatenate(([0], np.cumsum([len(v) for v in lists]))).astype(np.int32)
    flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int8))
    return pa.record_batch([*[b.column(b.schema.get_field_index(c)) for c in keep], pa.ListArray.from_arrays(pa.array(offs), flat)], [*keep, name])


def flipped(chunks: DataFrame, level: float) -> DataFrame:
    """Stretches (to_chunks, with words, column and columns) with zs: x flipped where the run's uniform of (frame, column) is below level."""
    keep = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _with_lists(b, keep, [(x ^ (u < level)).astype(np.int8) for _, x, u in _rows(b)], "zs")

    arrow_batches(chunks.sparkSession)
    return chunks.mapInArrow(run, T.StructType([*chunks.schema.fields, T.StructField("zs", T.ArrayType(T.ByteType()))]))


def _followed(u: np.ndarray, level: float, rho: float, state: int) -> np.ndarray:
    """States of the chain over uniforms; state: the one before, or -1 at a series' start.

    A uniform below both chances makes a 1, one above both a 0; between them the state stays, or is turned where the
    chance of a 1 is smaller after a 1. So each state is that of the last frame that doesn't depend on it, turned or not.
    """
    rise, stay = level * (1 - rho), 1 - (1 - level) * (1 - rho)
    if not len(u):
        return np.zeros(0, np.int8)
    after0, after1 = (u < rise).astype(np.int8), (u < stay).astype(np.int8)
    if state < 0:
        after0[0] = after1[0] = u[0] < level
    else:
        after0[0] = after1[0] = after1[0] if state else after0[0]
    fixed = np.flatnonzero(after0 == after1)
    last = fixed[np.searchsorted(fixed, np.arange(len(u)), "right") - 1]
    turns = np.concatenate(([0], np.cumsum(after0 > after1)))
    return after0[last] ^ ((turns[1:] - turns[last + 1]) & 1).astype(np.int8)


def chained(chunks: DataFrame, level: float, rho: float, keys: tuple[str, ...] = _KEYS) -> DataFrame:
    """Stretches without halos with zs: x flipped by a two-state chain over the run's uniforms; its states carry over from stretch to stretch."""
    keep = [*chunks.columns, "entry"]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r, _, u in _rows(b):
                first = b.column(b.schema.get_field_index("lo"))[r].as_py() == 0
                out.append([int(_followed(u, level, rho, -1 if first else s)[-1]) for s in (0, 1)])
            kept = [b.column(b.schema.get_field_index(c)) for c in (*keys, "lo")]
            yield pa.record_batch([*kept, *[pa.array([o[s] for o in out], pa.int32()) for s in (0, 1)]], [*keys, "lo", "m0", "m1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entry = b.column(b.schema.get_field_index("entry")).to_pylist()
            yield _with_lists(b, keep[:-1], [(x ^ _followed(u, level, rho, entry[r])).astype(np.int8) for r, x, u in _rows(b)], "zs")

    arrow_batches(chunks.sparkSession)
    maps = chunks.mapInArrow(ends, T.StructType([*[chunks.schema[c] for c in (*keys, "lo")], T.StructField("m0", T.IntegerType()), T.StructField("m1", T.IntegerType())]))
    # a map is constant, turns the state or leaves it: the last constant one counts, and the turns after it
    w = Window.partitionBy(*keys).orderBy("lo")  # one row for each stretch
    turn = (F.col("m0") > F.col("m1")).cast("int")
    maps = maps.withColumn("turns", F.sum(turn).over(w)).withColumn("fixed", F.when(F.col("m0") == F.col("m1"), F.struct(F.col("m0").alias("state"), "turns")))
    last = F.last("fixed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    entry = F.when(F.col("lo") == 0, -1).otherwise((F.col("last.state") + F.col("turns") - turn - F.col("last.turns")) % 2).cast("int")
    maps = maps.withColumn("last", last).select(*keys, "lo", entry.alias("entry"))
    return chunks.join(maps, [*keys, "lo"]).select(*keep).mapInArrow(run, T.StructType([*chunks.schema.fields, T.StructField("zs", T.ArrayType(T.ByteType()))]))


# ---------------------------------------------------------------- normals


def _at(words, place: int) -> np.random.Generator:
    """A generator that goes on with number place."""
    bits = np.random.PCG64(np.random.SeedSequence([int(w) for w in words]))
    bits.advance(place)
    return np.random.Generator(bits)


def _place(state: int, begin: int, inc: int) -> int:
    """How many steps lie between two states: bit by bit, as a step of 2^k alone settles bit k."""
    place, bit, by, add = 0, 1, MULTIPLIER, inc
    while state != begin:
        if (state ^ begin) & bit:
            begin = (begin * by + add) & _MOST
            place |= bit
        by, add = by * by & _MOST, (add * by + add) & _MOST
        bit <<= 1
    return place


def read_span(words, start: int, size: int, entries: int = ENTRIES) -> list[tuple[int, int]]:
    """For each entry: how many normals begin in numbers start + entry .. start + size - 1, and how far behind the span the next one begins."""
    _, inc = seeded(words)
    state = lambda g: g.bit_generator.state["state"]["state"]
    out: list[tuple[int, int]] = []
    met: dict[int, tuple[int, int]] = {}  # where a normal begins early in the span, by the first reading: normals from there on, exit
    for entry in range(entries):
        g = _at(words, start + entry)
        begin, at, n = state(g), entry, 0
        path: list[tuple[int, int]] = []
        while at < size and at not in met:
            path.append((at, n))
            k = 1 if at < 4 * entries or size - at < 64 else max(1, int((size - at) * 0.97) - 8)
            g.standard_normal(k)
            n += k
            at = entry + _place(state(g), begin, inc)
            if k > 1 and at >= size:  # it went over: again, one by one
                at, n = path.pop()
                g = _at(words, start + at)
                begin_at = at
                while at < size:
                    g.standard_normal()
                    n += 1
                    at = begin_at + _place(state(g), state(_at(words, start + begin_at)), inc)
        more, leave = met.get(at, (0, at - size)) if at < size else (0, at - size)
        for place, before in path:
            met[place] = (n + more - before, leave)
        out.append((n + more, leave))
    return out


def normal_starts(spans: DataFrame, span: int = SPAN, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """spans (keys, words, span_no) with entry (where in the span the first normal begins) and ahead (normals that begin before it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            got = [read_span(w, k * span, span) for w, k in zip(get("words"), get("span_no"))]
            kept = [b.column(b.schema.get_field_index(c)) for c in (*keys, "span_no")]
            yield pa.record_batch([*kept, pa.array([[c for c, _ in g] for g in got], pa.list_(pa.int64())), pa.array([[e for _, e in g] for g in got], pa.list_(pa.int64()))], [*keys, "span_no", "counts", "exits"])

    arrow_batches(spans.sparkSession)
    schema = T.StructType([*[spans.schema[c] for c in (*keys, "span_no")], *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("counts", "exits")]])
    maps = spans.select(*keys, "words", "span_no").mapInArrow(run, schema)

    def compose(t: pa.Table) -> pa.Table:
        t = t.sort_by("span_no")
        entry, ahead, rows = 0, 0, []
        for counts, exits in zip(t.column("counts").to_pylist(), t.column("exits").to_pylist()):
            if entry >= len(counts):
                raise ArithmeticError("a normal takes more numbers than entries are read")
            rows.append((entry, ahead))
            entry, ahead = exits[entry], ahead + counts[entry]
        return t.select([*keys, "span_no"]).append_column("entry", pa.array([r[0] for r in rows], pa.int64())).append_column("ahead", pa.array([r[1] for r in rows], pa.int64()))

    # one task for each stream has a few numbers for each span
    schema = T.StructType([*[spans.schema[c] for c in (*keys, "span_no")], T.StructField("entry", T.LongType()), T.StructField("ahead", T.LongType())])
    return spans.join(persisted(maps.groupBy(*keys).applyInArrow(compose, schema), "starts"), [*keys, "span_no"])


def normals(blocks: DataFrame, streams: DataFrame, span: int = SPAN, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """blocks (keys, first, size) with v: normals first to first + size - 1 of a stream; streams: keys, words, total (normals that may be asked for)."""
    # a normal takes 1.012 numbers on average; how many more than that is bounded by far more than the deviation
    last = F.ceil((F.col("total") * 1.02 + 1000) / span).cast("long")
    spans = streams.withColumn("span_no", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(*keys, "words", "span_no")
    starts = normal_starts(spans, span, keys)
    # a block is drawn from the span that its first normal begins in: the last one that begins with it or before
    begun = starts.select(*keys, F.col("ahead").alias("_at"), F.struct("words", "span_no", "entry", "ahead").alias("_span"), F.lit(None).cast(blocks.schema).alias("_block"))
    asked = blocks.select(*keys, F.col("first").alias("_at"), F.lit(None).cast(begun.schema["_span"].dataType).alias("_span"), F.struct(*blocks.columns).alias("_block"))
    w = Window.partitionBy(*keys).orderBy("_at", F.col("_span").isNull())  # one row for each span and block
    near = begun.unionByName(asked).withColumn("_span", F.last("_span", ignorenulls=True).over(w)).where("_block is not null").select("_block.*", "_span.*")
    keep = blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            out = []
            for words, k, entry, ahead, first, size in zip(*map(get, ("words", "span_no", "entry", "ahead", "first", "size"))):
                g = _at(words, k * span + entry)
                g.standard_normal(first - ahead)
                out.append(g.standard_normal(size))
            yield _with_lists(b, keep, out, "v")

    return near.mapInArrow(run, T.StructType([*blocks.schema.fields, T.StructField("v", T.ArrayType(T.DoubleType()))]))
