"""Nearest neighbours by collision counting over single-projection sorted arrays.

Vectors are dealt by a hash of their id into blocks of about BLOCK_ROWS. The index of a block is PROJECTIONS random
lines with the block's vectors sorted along each. A query opens a window around its own projection on every line
(half width HALF * R) and counts in how many windows each vector lies; vectors with at least the threshold of
collisions are verified by their exact distance. Virtual rehashing: R grows by GROWTH, windows only add what is new,
until the k-th verified distance is at most R (every vector that near has collided often enough but for a chance of
about 1e-3) or the windows hold the whole block. There is no cap on candidates.

A first pass searches every query in one block only. The k-th distance found there bounds what any other block can add,
so in the second pass a query leaves a block as soon as R has reached its bound: how far it looks depends on its
neighbours in the whole table, not on what the block happens to hold. Queries are dealt into chunks; each (block, chunk)
is one task with bounded memory, which searches its queries together, and the k best of each block are merged.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part; an empty table gives an empty result. Projections are taken of vectors divided by the median of their largest
components, and components are cut at LARGEST times that, so no finite vector overflows them and a few huge ones don't
make all others one point; distances are exact all the same, and one beyond the doubles is infinite and sorts last. Equal distances go to the
smaller id. Copies of a query under other ids are ordinary candidates. Rows of one id are candidates each, but a query
is searched once, with the smallest vector of its id, and its own id is never its neighbour. Columns besides id and
vector are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parts_for

BLOCK_ROWS, CHUNK_QUERIES, LEAST_TASKS = 16384, 4096, 12
PROJECTIONS, HALF, ALPHA, GROWTH = 64, 0.8, 0.39, 1.3
#: Components of projected vectors, in medians of the largest ones.
LARGEST = 1e100
#: Queries that are counted together: so many rows of counters for a block are held at once.
TOGETHER = 32


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; differences are scaled where their squares would overflow or vanish."""
    with np.errstate(over="ignore"):
        d = np.abs(x - q)
        top = d.max(-1, initial=0.0)
        plain = (top < 1e150) & (top > 1e-140)
        scale = np.where(plain | (top == 0) | ~np.isfinite(top), 1.0, top)
        d = d / scale[..., None] if not plain.all() else d
        return np.where(np.isfinite(top), scale * np.sqrt((d * d).sum(-1)), np.inf)


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(x / scale, -LARGEST, LARGEST)


class CollisionIndex:
    """Sorted projections of one block of vectors. scale: what vectors are divided by before they are projected."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scale: float = 1.0, seed: int = 7):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.scale = ids[order], vectors[order], scale
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1], PROJECTIONS))
        p = scaled(self.x, scale) @ self.lines
        self.order = np.argsort(p, axis=0, kind="stable").T.copy()
        self.sorted = np.sort(p, axis=0).T.copy()
        self.visited = 0

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, bounds: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and distances of the k nearest found for each query, nearest first. bounds: distances beyond which nothing is wanted."""
        out = []
        for at in range(0, len(queries), TOGETHER):
            some = slice(at, at + TOGETHER)
            out += self._search(queries[some], own[some], k, np.full(len(queries[some]), np.inf) if bounds is None else bounds[some])
        return out

    def _search(self, q: np.ndarray, own: np.ndarray, k: int, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        n, m, many = len(self.ids), PROJECTIONS, len(q)
        p = scaled(q, self.scale) @ self.lines
        need = int(np.ceil(ALPHA * m))
        counts = np.zeros(many * n, np.int16)
        dist = np.full((many, n), np.nan)
        done = self.ids[None, :] == own[:, None]
        lo = np.stack([np.searchsorted(self.sorted[j], p[:, j]) for j in range(m)], 1)
        hi = lo.copy()
        # the first radius: windows of the middle line hold about k vectors
        there = np.clip(lo + k // 2, 0, n - 1)
        reach = np.sort(np.abs(np.stack([self.sorted[j][there[:, j]] for j in range(m)], 1) - p), 1)
        r = np.maximum(reach[:, m // 2] / HALF, 1e-12)
        live = np.arange(many)
        while len(live):
            left = np.stack([np.searchsorted(self.sorted[j], p[live, j] - HALF * r[live], "left") for j in range(m)], 1)
            right = np.stack([np.searchsorted(self.sorted[j], p[live, j] + HALF * r[live], "right") for j in range(m)], 1)
            # the windows' new stretches, below and above the old ones
            a, b = np.concatenate((left, hi[live]), 1), np.concatenate((lo[live], right), 1)
            size = np.maximum(b - a, 0)
            line = np.tile(np.arange(m), 2)
            for g, i in enumerate(live):
                if not size[g].any():
                    continue
                new = np.concatenate([self.order[j][s:e] for j, s, e in zip(line.tolist(), a[g].tolist(), b[g].tolist()) if e > s])
                counts[i * n : (i + 1) * n] += np.bincount(new, minlength=n).astype(np.int16)
            lo[live], hi[live] = left, right
            self.visited += int(size.sum())
            ended = []
            for i in live.tolist():
                fresh = np.flatnonzero((counts[i * n : (i + 1) * n] >= need) & ~done[i])
                if len(fresh):
                    done[i, fresh] = True
                    dist[i, fresh] = distances(self.x[fresh], q[i])
                found = dist[i][~np.isnan(dist[i])]
                enough = len(found) >= k and np.partition(found, k - 1)[k - 1] <= r[i] * self.scale
                if enough or r[i] * self.scale >= bounds[i] or done[i].all():
                    ended.append(i)
            live = np.setdiff1d(live, ended)
            r[live] *= GROWTH
        out = []
        for i in range(many):
            got = np.flatnonzero(~np.isnan(dist[i]) & (dist[i] <= bounds[i]))
            best = got[np.lexsort((self.ids[got], dist[i][got]))][:k]
            out.append((self.ids[best], dist[i][best]))
        return out


def _vectors(t: pa.Table, dims: int) -> np.ndarray:
    return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _searched(left: DataFrame, right: DataFrame, dims: int, scale: float, k: int) -> DataFrame:
    """The k best of each block for the queries sent to it. left: vec_id, v, block, chunk; right: vec_id, v, bound, block, chunk."""

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        got = []
        if a.num_rows and b.num_rows:
            ids, query = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
            index = CollisionIndex(ids, _vectors(a, dims), scale)
            got = [(q, *x) for q, x in zip(query, index.search(_vectors(b, dims), query, k, b.column("bound").to_numpy()))]
        flat = lambda i, kind: pa.array(np.concatenate([g[i] for g in got]) if got else np.zeros(0), kind)
        return pa.table({"query_id": pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]) if got else [], pa.int64()), "vec_id": flat(1, pa.int64()), "score": flat(2, pa.float64())})

    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(block, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, k: int = 10, query_every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by query_every."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    # exact where there are few values, and within 1 in 10,000 of the rank otherwise: any value near the middle will do
    largest = F.percentile_approx(F.array_max(F.transform("v", lambda x: F.abs(x))), 0.5)
    width = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), largest.alias("largest")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not width:
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, rows, largest = width[0]
    scale = 2.0 ** np.floor(np.log2(largest))  # a power of two: scaling changes no digit
    v = v.where(F.size("v") == dims)
    queries = materialize(v.where(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = parts_for(rows, BLOCK_ROWS)
    most = parts_for(parts_for(rows, query_every), CHUNK_QUERIES)
    hashed = F.xxhash64("vec_id")
    v = v.withColumn("block", F.pmod(hashed, F.lit(blocks)))
    infinite = F.lit(float("inf"))

    def searched(of: DataFrame, asked: DataFrame, places: int) -> DataFrame:
        chunks = max(most, parts_for(LEAST_TASKS, places))
        left = of.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
        return _searched(left, asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks))), int(dims), float(scale), k)

    first = materialize(searched(v.where("block = 0"), queries.select("vec_id", "v", infinite.alias("bound"), F.lit(0).cast("long").alias("block")), 1), "first-block")
    found = first
    if blocks > 1:
        bound = first.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("far"))
        asked = queries.join(bound, queries["vec_id"] == bound["query_id"], "left").select("vec_id", "v", F.when(F.col("n") >= k, F.col("far")).otherwise(infinite).alias("bound"))
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(blocks - 1).cast("long"))))
        found = first.unionByName(searched(v.where("block > 0"), asked, blocks - 1))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
