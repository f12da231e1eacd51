"""Smoothing of chunked series and their error sums, in Arrow batches: each kernel once for all series of a batch."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.methods import Method, at_least_half, kernel_weights, log_odds, shape
from ..session import arrow_batches
from .stretches import neighbours

#: Additive sums of a chunk, from which every metric follows.
SUMS = ("cells", "sum_sq", "sum_abs", "sum_p", "sum_x", "tp", "fp", "fn", "brief_hits", "brief_cells", "edge_sq", "edge_cells", "changed")
#: Taps times frames that one convolution takes at once.
PART = 1 << 22
#: Frames that running sums take at once.
SHORT = 1 << 16
TOLERANCE = 1e-11


class Series:
    """The series of a batch, one after the other. lo, pre, own, n: see to_chunks; values: frames from lo - pre on, halos included."""

    def __init__(self, lo: np.ndarray, pre: np.ndarray, own: np.ndarray, n: np.ndarray, size: np.ndarray):
        self.lo, self.pre, self.own, self.n, self.size = lo, pre, own, n, size
        self.at = np.cumsum(size) - size  # where a series' values begin
        self.cuts = np.cumsum(own) - own  # where its own frames begin among all own frames
        self.row = np.repeat(np.arange(len(own)), own)
        self.own_at = np.arange(int(own.sum())) - np.repeat(self.cuts - self.at - pre, own)

    def convolved(self, x: np.ndarray, weights: np.ndarray, ratio: float | None = None) -> np.ndarray:
        """The convolution at all own frames, with half-sample symmetric reflection (repeated if need be) at each series' ends.

        Equal weights are summed as differences of running sums, weights that fall by a ratio (if given) by two running
        sums that fall likewise, so the work for a frame doesn't grow with the width. Where the whole window is 0 or 1, so
        is the result, exactly: sharpening would amplify what rounding leaves.
        """
        w = len(weights) // 2
        if not w:
            return x[self.own_at].astype(float)
        out = np.empty(len(self.row))
        wide = self.own + 2 * w
        ends = np.cumsum(wide)
        same = weights[0] == weights[w]
        most = SHORT if same or ratio else PART // len(weights)
        a = 0
        while a < len(wide):  # so many series that their windows fit
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + max(most, 1), "right")))
            first = np.cumsum(wide[a:b]) - wide[a:b]
            v = self._windows(x, a, b, w)
            keep = np.repeat(first, self.own[a:b]) + np.arange(int(self.own[a:b].sum())) - np.repeat(self.cuts[a:b] - self.cuts[a], self.own[a:b])
            ones = np.concatenate(([0.0], np.cumsum(v)))
            ones = ones[keep + 2 * w + 1] - ones[keep]
            if same:
                h = ones * weights[w]
            elif ratio:
                # a window of its own width lies before and after every series: what the one before leaves is below LEAST_WEIGHT
                h = ((falling_sums(v, ratio) + falling_sums(v[::-1], ratio)[::-1] - v) * weights[w])[keep + w]
            else:
                h = np.convolve(v, weights[::-1], "valid")[keep]
            h[ones == 0], h[ones == 2 * w + 1] = 0.0, 1.0
            out[self.cuts[a] : self.cuts[a] + len(h)] = h
            a = b
        if len(out) and (out.min() < -TOLERANCE or out.max() > 1 + TOLERANCE):
            raise ArithmeticError("smoothed values lie outside 0 to 1")
        return out

    def _windows(self, x: np.ndarray, a: int, b: int, w: int) -> np.ndarray:
        """Values of frames lo - w to lo + own + w of series a to b, one behind the other."""
        if b - a > 64:  # many short ones: all places at once
            some = self.own[a:b] + 2 * w
            of = np.repeat(np.arange(a, b), some)
            f = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some - self.lo[a:b] + w, some)
            return x[self._reflected(f, self.n[of]) - (self.lo - self.pre - self.at)[of]].astype(float)
        parts = []
        for i in range(a, b):
            lo, hi, n, at = self.lo[i], self.lo[i] + self.own[i], self.n[i], self.at[i] + self.pre[i] - self.lo[i]
            start, stop = max(lo - w, 0), min(hi + w, n)
            parts += [x[at + self._reflected(np.arange(lo - w, start), n)], x[at + start : at + stop], x[at + self._reflected(np.arange(stop, hi + w), n)]]
        return np.concatenate(parts).astype(float)

    @staticmethod
    def _reflected(f: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        f = f % (2 * n)
        return np.where(f < n, f, 2 * n - 1 - f)

    def response(self, x: np.ndarray, kernel: tuple[str, float]) -> np.ndarray:
        """convolved with a kernel of the catalogue."""
        weights = kernel_weights(*kernel)
        return self.convolved(x, weights, weights[len(weights) // 2 + 1] / weights[len(weights) // 2] if kernel[0] == "resolvent" else None)

    def brief_and_edges(self, x: np.ndarray, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Masks at the own frames: cells of positive runs of at most `longest` that touch neither end of the series; both ends of every change.

        The chunks' halos must hold longest + 1 frames.
        """
        border = np.zeros(len(x) + 1, bool)
        border[self.at], border[-1] = True, True
        change = np.zeros(len(x) + 1, bool)
        change[1:-1] = x[1:] != x[:-1]
        change &= ~border
        edge = change[:-1] | change[1:]
        starts = np.flatnonzero((change | border)[:-1])
        stops = np.append(starts[1:], len(x))
        of = np.searchsorted(self.at, starts, "right") - 1
        a, b = starts - self.at[of], stops - self.at[of]
        first = (self.lo - self.pre)[of]
        # a run cut by the chunk's own border continues in the halo's halo: then it's longer than `longest`
        short = (b - a <= longest) & (x[starts] == 1) & (first + a > 0) & (first + b < self.n[of]) & (a > 0) & (b < self.size[of])
        return np.repeat(short, stops - starts)[self.own_at], edge[self.own_at]

    def sums(self, v: np.ndarray) -> np.ndarray:
        """Sums over the own frames of each series."""
        return np.add.reduceat(v.astype(float), self.cuts) if len(v) else np.zeros(len(self.own))


def falling_sums(v: np.ndarray, ratio: float) -> np.ndarray:
    """s with s[i] = ratio * s[i - 1] + v[i], for v of at least 0.

    In blocks in which the inverse powers of the ratio stay finite: there s is a running sum of values divided by powers,
    times powers. A block's last sum goes on into the next one; into the one after that nothing is left of it.
    """
    size = max(1, min(len(v), int(-250 / math.log10(ratio))))
    rows = np.zeros(-(-len(v) // size) * size)
    rows[: len(v)] = v
    rows = rows.reshape(-1, size)
    k = np.arange(size)
    s = np.cumsum(rows * ratio**-k.astype(float), 1) * ratio**k
    s[1:] += s[:-1, -1:] * ratio ** (k + 1)
    return s.ravel()[: len(v)]


def _one(x: np.ndarray, lo: int, pre: int, own: int, n: int) -> Series:
    return Series(*(np.array([v], np.int64) for v in (lo, pre, own, n, len(x))))


def convolved(x: np.ndarray, lo: int, pre: int, own: int, n: int, weights: np.ndarray) -> np.ndarray:
    """Series.convolved of one stretch."""
    return _one(x, lo, pre, own, n).convolved(x, weights)


def brief_and_edges(x: np.ndarray, lo: int, pre: int, own: int, n: int, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Series.brief_and_edges of one stretch."""
    return _one(x, lo, pre, own, n).brief_and_edges(x, longest)


def _read(b: pa.RecordBatch, *arrays: str) -> tuple[Series, list[np.ndarray]]:
    lo, pre, own, n = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "pre", "own", "n"))
    lists = [b.column(b.schema.get_field_index(a)) for a in arrays]
    size = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return Series(lo, pre, own, n, size), [c.flatten().to_numpy(zero_copy_only=False) for c in lists]


def _repeated(b: pa.RecordBatch, names: tuple[str, ...], times: int) -> list[pa.Array]:
    """Columns of b, each row so many times."""
    at = pa.array(np.repeat(np.arange(b.num_rows), times))
    return [b.column(b.schema.get_field_index(c)).take(at) for c in names]


def _method_columns(methods: list[Method], rows: int) -> list[pa.Array]:
    return [pa.array([m.name for m in methods] * rows), pa.array([m.cand for m in methods] * rows, pa.int32())]


def smooth(chunks: DataFrame, methods: list[Method], noise_level: float | None = None, column: str = "xs", keep: tuple[str, ...] = ("run_id", "feature_id")) -> DataFrame:
    """keep, lo, method, cand_ord and p (the method's values at the chunk's own frames) for each chunk and method."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels = dict.fromkeys(m.kernel for m in methods)
        for b in batches:
            if not b.num_rows:
                continue
            s, (x,) = _read(b, column)
            h = {k: s.response(x, k) for k in kernels}
            p = [shape(m, h[m.kernel], noise_level) for m in methods]
            ends = np.append(s.cuts, len(s.row))
            flat = np.concatenate([v[a:z] for a, z in zip(ends, ends[1:]) for v in p])
            offs = np.concatenate(([0], np.cumsum(np.repeat(s.own, len(methods)))))
            values = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat))
            yield pa.record_batch([*_repeated(b, (*keep, "lo"), len(methods)), *_method_columns(methods, b.num_rows), values], [*keep, "lo", "method", "cand_ord", "p"])

    arrow_batches(chunks.sparkSession)
    fields = [chunks.schema[c] for c in (*keep, "lo")]
    schema = T.StructType([*fields, T.StructField("method", T.StringType()), T.StructField("cand_ord", T.IntegerType()), T.StructField("p", T.ArrayType(T.DoubleType()))])
    return chunks.select(*keep, "lo", "pre", "own", "n", column).mapInArrow(run, schema)


def error_sums(chunks: DataFrame, methods: list[Method], noise_level: float | None = None, truth: str = "xs", given: str = "zs", keep: tuple[str, ...] = ("run_id", "feature_id"), timed: bool = False) -> DataFrame:
    """keep, method, cand_ord and SUMS for each chunk and method: the values are scored where they are made and never leave the task.

    changed counts cells where the method and its kernel alone fall on different sides of one half. timed: seconds as
    well, those of a batch shared among its chunks by their frames, and a kernel's among its methods.
    """
    names = (*SUMS, "seconds") if timed else SUMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels = dict.fromkeys(m.kernel for m in methods)
        powers = {m.kernel for m in methods if m.name in ("power_full", "power_matched")}
        for b in batches:
            if not b.num_rows:
                continue
            s, (x, z) = _read(b, truth, given)
            brief, edge = s.brief_and_edges(x)
            x = x[s.own_at]
            one = x == 1
            same = [s.own.astype(float), s.sums(x), s.sums(brief), s.sums(edge)]
            out = np.empty((b.num_rows, len(methods), len(names)))
            share = s.own / max(s.own.sum(), 1)
            for kernel in kernels:
                began = time.perf_counter()
                h = s.response(z, kernel)
                half, odds = at_least_half(h), log_odds(h) if kernel in powers else None
                common = (time.perf_counter() - began) / sum(m.kernel == kernel for m in methods)
                for k, m in enumerate(methods):
                    if m.kernel != kernel:
                        continue
                    began = time.perf_counter()
                    p = shape(m, h, noise_level, odds)
                    d, hit = p - x, at_least_half(p)
                    sq = d * d
                    sums = (same[0], s.sums(sq), s.sums(np.abs(d)), s.sums(p), same[1], s.sums(hit & one), s.sums(hit & ~one), s.sums(~hit & one), s.sums(hit & brief), same[2], s.sums(sq * edge), same[3], s.sums(hit != half))
                    out[:, k, : len(SUMS)] = np.stack(sums, 1)
                    if timed:
                        out[:, k, -1] = share * (common + time.perf_counter() - began)
            flat = out.reshape(-1, len(names))
            yield pa.record_batch([*_repeated(b, keep, len(methods)), *_method_columns(methods, b.num_rows), *[pa.array(flat[:, c]) for c in range(len(names))]], [*keep, "method", "cand_ord", *names])

    arrow_batches(chunks.sparkSession)
    schema = T.StructType([*[chunks.schema[c] for c in keep], T.StructField("method", T.StringType()), T.StructField("cand_ord", T.IntegerType()), *[T.StructField(s, T.DoubleType()) for s in names]])
    return chunks.select(*keep, "lo", "pre", "own", "n", truth, given).mapInArrow(run, schema)


def thomas(z: np.ndarray, t: float) -> np.ndarray:
    """The resolvent by its tridiagonal system, for whole series (frames x features): the exact long-series form."""
    n = len(z)
    if n == 1:
        return z.astype(float)
    diag = np.full(n, 1 + t / 2)
    diag[0] = diag[-1] = 1 + t / 4
    off, h, c = -t / 4, z.astype(float).copy(), np.zeros(n)
    for i in range(n):
        d = diag[i] - (off * c[i - 1] if i else 0)
        c[i] = off / d
        h[i] = (h[i] - (off * h[i - 1] if i else 0)) / d
    for i in range(n - 2, -1, -1):
        h[i] -= c[i] * h[i + 1]
    return h


def residuals(frames: DataFrame, t: float, h: str = "h", z: str = "z") -> DataFrame:
    """run_id, feature_id and the largest absolute residual of the resolvent's equation."""
    both = neighbours(frames, ["run_id", "feature_id"], [h])
    step = F.coalesce(F.col(h) - F.col(f"before_{h}"), F.lit(0.0)) + F.coalesce(F.col(h) - F.col(f"after_{h}"), F.lit(0.0))
    res = F.abs(F.col(h) + F.lit(t / 4) * step - F.col(z))
    return both.withColumn("res", res).groupBy("run_id", "feature_id").agg(F.max("res").alias("residual"))
