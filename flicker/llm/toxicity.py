"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the lower-case words of a text. The examples are a bounded sample of labelled rows, the PER_CLASS[label] of
each label with the smallest id hashes (documented parameters); the vocabulary is every word of at least LEAST_DOCS of
them, without a cap. Document frequencies are counted over all documents. A text's vector has the weights
(1 + ln count) * idf * relevance at unit length; the relevance of a term is how far it goes with the label in the
sample, its chi-squared over CHI2, at most 1, to the power of SHARPNESS. No term is left out by it, but those that go
with neither label hardly count. This is a departure from plain TF-IDF: with SHARPNESS 0 the cosine knows no labels, and
finds about half of the toxic rows of a held-out part where the weighted one finds 95 % (README has the figures).

The index keeps the postings of each term, whole rows of weights for terms of many examples, and, for blocks of BLOCK
similar examples, the largest weight of the term in the block. A query adds up its terms by falling weight; what the
terms that are left can still add to an example is bounded by its block's largest weights. It stops as soon as the
bounds leave few examples that can be among the K nearest, and completes those alone, so the K nearest and their
similarities are exact. Their votes are weighted by distance and by the true share of their label; a logistic curve
fitted to the examples' own votes, each without itself, turns votes into calibrated scores. The three nearest examples
come along as evidence.

At scale: three scans of the texts (sample, frequencies, scores), of which none shuffles them; the index is broadcast
and bounded by the sample.

Defined results: texts without any term of the vocabulary (also null and empty ones) get the smoothed share of label 1
among such examples, and no evidence. If nothing is labelled, scores are 0. Repeated labels of one id count once, toxic
if any is; rows of one id are one example with the smallest text. Rows without an id are scored, labels without one are
not used. Texts of any length are read whole. Repeated rows get equal scores; ties in similarity go to the smaller id.
An empty table gives an empty result. Other columns stay as they are, whatever their names, in keep_clean; score adds
toxicity and evidence to them.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NARROW_BYTES, SPACE, discard, free, id_mod, letters, materialize, small_batches

PER_CLASS = {1: 3000, 0: 5000}
CHI2, SHARPNESS, LEAST_DOCS = 36.0, 2, 3
#: FEW: examples that are completed one by one. Terms of more than one in LONG examples are held as whole rows.
BLOCK, FEW, K, EVIDENCE = 128, 128, 32, 3
LONG = 8
#: Upper bits of a hash that its place among the terms is looked up by.
BITS = 18
THRESHOLD = 0.3
#: Scores that a task keeps for texts of equal terms.
STORE = 20_000

class TermHash:
    """Keyed 64-bit hashes of words of any length: multilinear in their letters, in two lanes of which the upper halves are kept.

    Each place of a word has a random factor of its own, so two different words collide with a chance of about 2^-64 over
    the key, whatever the words are. A key is drawn for each job.
    """

    STEP = 64

    def __init__(self, key: tuple[int, ...]):
        self.key = key
        self.factors = np.zeros((2, 0), np.uint64)

    def _factors(self, n: int) -> np.ndarray:
        have = self.factors.shape[1] // self.STEP
        more = [np.random.default_rng([*self.key, block]).integers(0, 1 << 63, (2, self.STEP), np.uint64) * np.uint64(2) + np.uint64(1) for block in range(have, -(-n // self.STEP))]
        if more:
            self.factors = np.concatenate((self.factors, *more), 1)
        return self.factors

    def __call__(self, letters: np.ndarray, first: np.ndarray) -> np.ndarray:
        """letters: those of all words, one word behind the other; first: where each begins."""
        size = np.diff(np.append(first, len(letters)))
        place = np.arange(1, len(letters) + 1, dtype=np.int32)
        place -= np.repeat(first.astype(np.int32), size)
        k = self._factors(int(size.max()) + 1)
        value, count = letters.astype(np.uint64) + np.uint64(1), size.astype(np.uint64)
        lanes = [np.add.reduceat(np.take(k[j], place) * value, first) + k[j][0] * count for j in (0, 1)]
        return (lanes[0] >> np.uint64(32) << np.uint64(32)) | (lanes[1] >> np.uint64(32))


def row_terms(col: pa.Array, words: TermHash) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, 64-bit hash) of all words, in text order, repeats included."""
    for i, n, cps, offs in letters(col):
        full = cps != SPACE
        begins = full.copy()
        begins[1:] &= ~full[:-1]
        rows = offs[:-1][offs[:-1] < len(cps)]
        begins[rows] = full[rows]  # words never cross rows
        at = np.flatnonzero(begins)
        first = (np.cumsum(full) - 1)[at] if len(at) else at
        sizes = np.diff(np.searchsorted(at, offs))
        yield i, n, np.repeat(np.arange(n), sizes), words(cps[full], first) if len(at) else np.zeros(0, np.uint64)


class Vocabulary:
    """Terms by the order of their hashes, with the relevance of each."""

    def __init__(self, hashes: list[int], words: TermHash, relevance: list[float] | None = None):
        self.words = words
        held = np.array(hashes, np.int64).view(np.uint64)
        order = np.argsort(held)
        self.hashes = held[order]
        self.relevance = np.ones(len(held)) if relevance is None else np.array(relevance, float)[order]
        # hashes with equal upper BITS bits lie side by side: the first of each, and the most of any
        self.first = np.searchsorted(self.hashes >> np.uint64(64 - BITS), np.arange((1 << BITS) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.first).max())

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h of the hashes of terms, and their terms."""
        top = (h >> np.uint64(64 - BITS)).astype(np.int64)
        t, end = self.first[top], self.first[top + 1]
        at = np.flatnonzero(t < end)
        t, end = t[at], end[at]
        places, terms = [at[:0]], [t[:0]]
        for _ in range(self.most):
            same = self.hashes[t] == h[at]
            places.append(at[same])
            terms.append(t[same])
            more = ~same & (t + 1 < end)
            at, t, end = at[more], t[more] + 1, end[more]
        return np.concatenate(places), np.concatenate(terms)

    def counts(self, col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, rows, row, term, count), by row and term."""
        size = max(len(self.hashes), 1)
        for i, n, row, h in row_terms(col, self.words):
            at, t = self.find(h)
            keys, count = np.unique(row[at] * size + t, return_counts=True)
            row = keys // size
            yield i, n, row, keys - row * size, count


class BlockMaxIndex:
    """Exact top-k cosine search over unit sparse vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        lead = [(int(t[w.argmax()]) if len(t) else -1, len(t)) for t, w in vectors]
        self.order = np.array(sorted(range(len(vectors)), key=lambda r: (lead[r], r)), np.int64)  # alike examples share blocks
        self.size, self.blocks = len(vectors), max(1, -(-len(vectors) // BLOCK))
        self.block = np.arange(self.size) // BLOCK
        sizes = [len(vectors[r][0]) for r in self.order]
        ex = np.repeat(np.arange(self.size), sizes)
        t = np.concatenate([vectors[r][0] for r in self.order] or [np.zeros(0, np.int64)]).astype(np.int64)
        w = np.concatenate([vectors[r][1] for r in self.order] or [np.zeros(0)])
        # the vectors themselves, and their postings by term
        self.cuts, self.terms, self.weights = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), t.astype(np.int32), w
        by = np.argsort(t, kind="stable")
        self.example, self.weight = ex[by].astype(np.int16 if self.size < 1 << 15 else np.int32), w[by]
        self.offs = np.searchsorted(t[by], np.arange(terms + 1))
        # terms of many examples: a weight for every example, at most 8 * LONG bytes for each posting
        long = np.flatnonzero(np.diff(self.offs) * LONG > self.size)
        self.row, self.rows = np.full(terms, -1, np.int32), np.zeros((len(long), self.size))
        self.row[long] = np.arange(len(long))
        for r, (a, z) in enumerate(zip(self.offs[long], self.offs[long + 1])):
            self.rows[r, self.example[a:z]] = self.weight[a:z]
        # in single precision, rounded up: no less than the weights
        self.largest = np.zeros((terms, self.blocks), np.float32)
        np.maximum.at(self.largest, (t, ex // BLOCK), np.nextafter(w.astype(np.float32), np.float32(2)))
        self.query = np.zeros(terms)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and similarities of the k nearest with a similarity above 0, nearest first, and the number of blocks that they were sought in to the end."""
        by = np.argsort(-weights, kind="stable")
        terms, weights = terms[by], weights[by]
        largest, part = self.largest[terms], weights.astype(np.float32)
        total, skip = np.zeros(self.size), np.flatnonzero(self.order == but) if but >= 0 else np.zeros(0, np.int64)
        at, step, held = 0, 32, np.zeros(self.size)
        while True:
            t, w = terms[at : at + step], weights[at : at + step]
            row = self.row[t]
            long = row >= 0
            for r, x in zip(row[long].tolist(), w[long].tolist()):
                total += np.multiply(self.rows[r], x, out=held)
            t, w = t[~long], w[~long]
            size = self.offs[t + 1] - self.offs[t]
            place = np.repeat(self.offs[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            total += np.bincount(self.example[place], self.weight[place] * np.repeat(w, size), self.size)
            at, step = min(at + step, len(terms)), step * 2
            total[skip] = 0
            kth = np.partition(total, self.size - k)[self.size - k] if self.size > k else 0.0
            rest = (part[at:] @ largest[at:]) * (1 + 1e-4)  # what the other terms can add in each block, above rounding
            can = np.flatnonzero(total + np.repeat(rest, BLOCK)[: self.size] >= max(kth, 1e-300) - 1e-12)
            if at == len(terms) or len(can) <= FEW:
                break
        if len(skip):
            can = can[~np.isin(can, skip)]
        if at < len(terms):  # complete the few that are left
            self.query[terms] = weights
            spans = [slice(a, z) for a, z in zip(self.cuts[can].tolist(), self.cuts[can + 1].tolist())]
            parts = self.query[np.concatenate([self.terms[:0], *[self.terms[s] for s in spans]])]
            parts *= np.concatenate([self.weights[:0], *[self.weights[s] for s in spans]])
            sims = np.bincount(np.repeat(np.arange(len(can)), self.cuts[can + 1] - self.cuts[can]), parts, len(can))
            self.query[terms] = 0
        else:
            sims = total[can]
        seen = np.count_nonzero(np.bincount(self.block[can]))
        can, sims = can[sims > 0], sims[sims > 0]
        best = np.lexsort((self.order[can], -sims))[:k]
        return self.order[can[best]], np.minimum(sims[best], 1.0), seen


@dataclass
class Model:
    vocabulary: Vocabulary
    idf: np.ndarray
    index: BlockMaxIndex | None = None
    ids: np.ndarray | None = None
    toxic: np.ndarray | None = None
    weight: tuple[float, float] = (1.0, 1.0)  # of a vote for 0 and for 1
    curve: tuple[float, float] = (1.0, 0.0)
    empty: float = 0.0

    def vector(self, terms: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = (1 + np.log(count)) * self.idf[terms] * self.vocabulary.relevance[terms]
        norm = np.sqrt((x * x).sum())
        return x / norm if norm > 0 else x

    def vote(self, near: np.ndarray, sims: np.ndarray) -> float:
        """The log odds of the neighbours' distance-weighted votes."""
        w = 1 / (np.sqrt(np.maximum(2 - 2 * sims, 0)) + 0.05) ** 2
        y = self.toxic[near]
        one, zero = self.weight[1] * w[y == 1].sum(), self.weight[0] * w[y == 0].sum()
        rest = 0.01 * (one + zero)
        return float(np.log((one + rest) / (zero + rest)))

    def score(self, terms: np.ndarray, count: np.ndarray) -> tuple[float, list]:
        if self.index is None or not len(terms):
            return self.empty, []
        near, sims, _ = self.index.search(terms, self.vector(terms, count), K)
        if not len(near):
            return self.empty, []
        z = self.curve[0] * self.vote(near, sims) + self.curve[1]
        return float(1 / (1 + np.exp(-z))), [(int(self.ids[r]), float(s), int(self.toxic[r])) for r, s in zip(near[:EVIDENCE], sims)]


def logistic_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic regression of y on x (Newton steps, slightly shrunk to slope 1)."""
    b = np.array([1.0, 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(b[0] * x + b[1], -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + (b[0] - 1), (w * (p - y)).sum() + 0.1 * b[1]])
        s = w * p * (1 - p)
        h = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        b = b - np.clip(step, -2, 2)
    return float(max(b[0], 0.05)), float(b[1])


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, toxic of the examples; number of labelled rows of each label."""
    one = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    one = one.where(id_mod("doc_id", 4) != 2)
    rows = {r[0]: r[1] for r in one.groupBy("toxic").count().collect()}
    parts = [one.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in PER_CLASS.items()]
    ids = F.broadcast(parts[0].union(parts[1]))  # at most sum(PER_CLASS) rows
    found = docs.join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return materialize(found, "examples"), rows


def _vocabulary(sample: DataFrame) -> Vocabulary:
    words = TermHash(tuple(secrets.token_bytes(16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column(1).to_numpy()
            for i, _, row, h in row_terms(b.column(0), words):
                by = np.lexsort((h, row))
                row, h = row[by], h[by]
                new = np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, bool)
                row, h = row[new], h[new]
                t, back = np.unique(h, return_inverse=True)
                yield pa.record_batch([pa.array(t.view(np.int64)), pa.array(np.bincount(back, minlength=len(t))), pa.array(np.bincount(back, toxic[i + row], len(t)).astype(np.int64))], ["term", "n", "a"])

    by = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = by.get(1, 0), by.get(0, 0)
    t = sample.select("text", "toxic").mapInArrow(run, "term long, n long, a long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("a").alias("a")).where(F.col("n") >= LEAST_DOCS)
    a, n, rows = F.col("a").cast("double"), F.col("n").cast("double"), float(pos + neg)
    cross = a * (neg - (n - a)) - (n - a) * (pos - a)
    chi2 = F.coalesce(F.try_divide(F.lit(rows) * cross * cross, n * (F.lit(rows) - n) * float(pos) * float(neg)), F.lit(0.0))
    got = t.select("term", F.pow(F.least(F.lit(1.0), F.greatest(chi2, F.lit(1e-6)) / CHI2), F.lit(SHARPNESS)).alias("relevance")).toArrow()  # the words of the bounded sample
    return Vocabulary(got.column("term").to_numpy(), words, got.column("relevance").to_numpy())


def term_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """Number of documents, and for each term in how many it occurs: counted in the tasks, then summed."""
    size = len(vocabulary.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(size, np.int64), 0
        for b in batches:
            rows += b.num_rows
            for _, _, _, term, _ in vocabulary.counts(b.column(0)):
                total += np.bincount(term, minlength=size)
        yield pa.record_batch([pa.array(np.arange(-1, size)), pa.array(np.concatenate(([rows], total)))], ["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # the words of the bounded sample
    df = np.zeros(size + 1, np.int64)
    df[got.column("term").to_numpy() + 1] = got.column("n").to_numpy()
    return int(df[0]), df[1:]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text of all documents; labels: doc_id, toxic (rows held out by the id rule are left out here)."""
    small_batches(docs.sparkSession, NARROW_BYTES)
    sample, labelled = _sample(docs, labels)
    vocabulary = _vocabulary(sample)
    rows, df = term_frequencies(docs, vocabulary)
    model = Model(vocabulary, np.log((1 + rows) / (1 + df)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n, row, term, count in vocabulary.counts(b.column(1)):
                offs = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offs, pa.array(x.astype(np.int32))) for x in (term, count)]
                yield pa.record_batch([b.column(0).slice(i, n), b.column(2).slice(i, n), *lists], ["doc_id", "toxic", "terms", "counts"])

    got = sample.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, terms array<int>, counts array<int>").toArrow().sort_by("doc_id")
    discard(sample)
    model.ids, model.toxic = got.column("doc_id").to_numpy(), got.column("toxic").to_numpy()
    if not len(model.ids):
        return model
    share = [max(1, int((model.toxic == k).sum())) for k in (0, 1)]
    model.weight = tuple(labelled.get(k, 0) / share[k] / (len(model.ids) / 2) for k in (0, 1))
    sparse = [(t.values.to_numpy().astype(np.int64), c.values.to_numpy()) for t, c in zip(got.column("terms"), got.column("counts"))]
    vectors = [(t, model.vector(t, c) if len(t) else np.zeros(0)) for t, c in sparse]
    del got, sparse
    model.index = BlockMaxIndex(vectors, len(vocabulary.hashes))
    x, y, none = [], [], [1.0 * model.weight[1], 20.0 * model.weight[0]]
    for r, (t, w) in enumerate(vectors):
        near, sims, _ = model.index.search(t, w, K, but=r) if len(t) else ([], [], 0)
        label = int(model.toxic[r])
        if len(near):
            x.append(model.vote(near, sims))
            y.append(label)
        else:
            none[1 - label] += model.weight[label]
    model.empty = none[0] / (none[0] + none[1])
    if len(set(y)) == 2:
        y = np.array(y)
        scale = len(y) / sum(model.weight[v] for v in y.tolist())
        model.curve = logistic_curve(np.array(x), y, np.array([model.weight[v] * scale for v in y.tolist()]))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("toxicity", "evidence")) -> DataFrame:
    """docs with toxicity and evidence (doc_id, similarity and label of the nearest examples), under the given names; other columns stay."""

    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample; one copy in a worker, for all its tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        store: dict[bytes, tuple] = {}  # texts of equal terms
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        for b in batches:
            out = []
            for _, n, row, term, count in model.vocabulary.counts(b.column(b.schema.get_field_index(text_col))):
                cut = np.searchsorted(row, np.arange(n + 1)).tolist()
                for a, z in zip(cut, cut[1:]):
                    key = hashlib.blake2b(term[a:z].tobytes() + count[a:z].tobytes(), digest_size=16).digest()
                    if (got := store.get(key)) is None:
                        if len(store) >= STORE:
                            store.clear()
                        got = store[key] = model.score(term[a:z], count[a:z])
                    out.append(got)
            evidence = [[{"doc_id": i, "similarity": s, "toxic": t} for i, s, t in e] for _, e in out]
            yield pa.record_batch([*b.columns, pa.array([s for s, _ in out], pa.float64()), pa.array(evidence, kind)], [*b.schema.names, *names])

    small_batches(docs.sparkSession, NARROW_BYTES)
    near = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], near)]))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence; learns only from rows whose crc32(doc_id as text) mod 4 is not 2."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(docs.select("doc_id", (id_mod("doc_id", 4) == 2).alias("held_out"), "text"), train(docs, labels))
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with the columns they had."""
    names = free("toxicity", docs), free("evidence", docs)
    return score(docs, model, names=names).where(F.col(names[0]) < THRESHOLD).select(*docs.columns)
