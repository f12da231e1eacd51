"""The resolvent by its own equations: exact tridiagonal systems of series of any length, solved stretch by stretch.

(1 + t (1 - A)) h = z has one equation for each frame: diagonal 1 + t / 2 (1 + t / 4 at a series' ends, 1 for a single
frame), -t / 4 beside it. Inside a stretch h is y + p l + q r, where l and r are the values beside the stretch: y solves
the equations with nothing beside, p and q answer to a one at either side. Its two outer frames give two equations in the
stretches' outer values; these small systems, one for each series, are solved, and every stretch is filled in with
what it has beside it.

Inside a stretch, elimination and substitution are first-order recurrences; a recurrence of n steps is run for all
stretches of a batch at once, in log n passes that join twice as many steps each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import arrow_batches


def _recurrence(m: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """v with v[i] = m[i] v[i - 1] + b[i] along the first axis, for the columns of b; m is 0 where a series begins."""
    m, v, d = m.copy(), b.copy(), 1
    while d < steps:
        v[d:] += m[d:, None] * v[:-d]
        m[d:] *= m[:-d]
        m[:d] = 0
        if not m.any():
            break
        d *= 2
    return v


def _pivots(n: int, off: float, first: float, rest: float) -> np.ndarray:
    """Pivots of the elimination: they settle on a limit, which is then kept."""
    out = np.empty(n)
    d = out[0] = first
    for i in range(1, n):
        d = rest - off * off / d
        if d == out[i - 1]:
            out[i:] = d
            return out
        out[i] = d
    return out


def solve_stretches(t: float, z: np.ndarray, size: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """y, p, q (columns) of stretches one behind the other; size: their frames; begins, ends: whether they are at their series' ends."""
    off, total = -t / 4, len(z)
    at = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(total) - at[row]
    longest = int(size.max()) if len(size) else 0
    tables = {b: _pivots(longest, off, 1 + t / 4 if b else 1 + t / 2, 1 + t / 2) for b in (False, True)}
    d = np.where(begins[row], tables[True][place], tables[False][place])
    last = at + size - 1
    # the last equation of a series has another diagonal, and its pivot is that much less
    d[last[ends]] -= t / 4
    single = (size == 1) & begins & ends
    d[at[single]] = 1.0
    rhs = np.zeros((total, 3))
    rhs[:, 0] = z
    rhs[at[~begins], 1] = -off
    rhs[last[~ends], 2] = -off
    before = np.roll(d, 1)
    down = np.where(place > 0, -off / before, 0.0)
    g = _recurrence(down, rhs, longest)
    up = np.where(place < size[row] - 1, -off / d, 0.0)
    return _recurrence(up[::-1], (g / d[:, None])[::-1], longest)[::-1]


def _columns(b: pa.RecordBatch, column: str) -> tuple[np.ndarray, ...]:
    get = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = b.column(b.schema.get_field_index(column))
    z = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    size, lo, n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), get("lo"), get("n")
    return z, size, lo, n


def interfaces(chunks: DataFrame, t: float, column: str = "xs", keys: tuple[str, ...] = ("run_id", "feature_id")) -> DataFrame:
    """keys, lo and what the outer frames of each stretch (to_chunks, without halos) are: first and last, each y, p, q."""
    names = [f"{e}_{c}" for e in ("first", "last") for c in "ypq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z, size, lo, n = _columns(b, column)
                s = solve_stretches(t, z, size, lo == 0, lo + size == n)
                a = np.cumsum(size) - size
                ends = np.concatenate((s[a], s[a + size - 1]), 1)
                kept = [b.column(b.schema.get_field_index(c)) for c in (*keys, "lo")]
                yield pa.record_batch([*kept, *[pa.array(ends[:, k]) for k in range(6)]], [*keys, "lo", *names])

    arrow_batches(chunks.sparkSession)
    schema = T.StructType([*[chunks.schema[c] for c in (*keys, "lo")], *[T.StructField(c, T.DoubleType()) for c in names]])
    return chunks.select(*keys, "lo", "n", column).mapInArrow(run, schema)


def beside(ends: DataFrame, keys: tuple[str, ...] = ("run_id", "feature_id")) -> DataFrame:
    """keys, lo and the solution's values left and right of each stretch (0 where there are none), from interfaces.

    One task for each series has seven numbers for each of its stretches.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("lo")
        f, l = (np.stack([t.column(f"{e}_{c}").to_numpy() for c in "ypq"], 1) for e in ("first", "last"))  # noqa: E741
        k = len(f)
        # with all before put together, a stretch's last value is a + b r, r being the one right of it
        a, b = np.zeros(k), np.zeros(k)
        for i in range(k):
            x, y = (a[i - 1], b[i - 1]) if i else (0.0, 0.0)  # left of the stretch: x + y * its first value
            down = 1 - f[i, 1] * y
            # first value: (y_f + p_f x + q_f r) / down; last value: y_l + p_l (x + y first) + q_l r
            g, h = (f[i, 0] + f[i, 1] * x) / down, f[i, 2] / down
            a[i], b[i] = l[i, 0] + l[i, 1] * (x + y * g), l[i, 2] + l[i, 1] * y * h
        left, right = np.zeros(k), np.zeros(k)
        for i in range(k - 1, 0, -1):  # from the far end, where nothing is beside
            r = right[i]
            down = 1 - f[i, 1] * b[i - 1]
            first = (f[i, 0] + f[i, 1] * a[i - 1] + f[i, 2] * r) / down
            right[i - 1], left[i] = first, a[i - 1] + b[i - 1] * first
        return t.select([*keys, "lo"]).append_column("left", pa.array(left)).append_column("right", pa.array(right))

    schema = T.StructType([*[ends.schema[c] for c in (*keys, "lo")], T.StructField("left", T.DoubleType()), T.StructField("right", T.DoubleType())])
    return ends.groupBy(*keys).applyInArrow(run, schema)


def resolvent(chunks: DataFrame, t: float, column: str = "xs", keys: tuple[str, ...] = ("run_id", "feature_id")) -> DataFrame:
    """keys, lo and h: the exact solution at the frames of each stretch (to_chunks, without halos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z, size, lo, n = _columns(b, column)
                s = solve_stretches(t, z, size, lo == 0, lo + size == n)
                left, right = (np.repeat(b.column(b.schema.get_field_index(c)).to_numpy(), size) for c in ("left", "right"))
                h = s[:, 0] + s[:, 1] * left + s[:, 2] * right
                offs = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                kept = [b.column(b.schema.get_field_index(c)) for c in (*keys, "lo")]
                yield pa.record_batch([*kept, pa.ListArray.from_arrays(pa.array(offs), pa.array(h))], [*keys, "lo", "h"])

    if t <= 0:
        raise ValueError("t must be positive")
    arrow_batches(chunks.sparkSession)
    near = beside(interfaces(chunks, t, column, keys), keys)
    schema = T.StructType([*[chunks.schema[c] for c in (*keys, "lo")], T.StructField("h", T.ArrayType(T.DoubleType()))])
    return chunks.select(*keys, "lo", "n", F.col(column)).join(near, [*keys, "lo"]).mapInArrow(run, schema)
