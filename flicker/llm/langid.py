"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of the lower-case letters of a text (everything else is a space), hashed into BUCKETS,
with weights (1 + ln count) * idf and unit length. Document frequencies of the buckets are counted over all documents.
The model is trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample: the PER_LANGUAGE
labelled documents with the smallest id hashes of each language (a documented parameter; every fifth one is held back
to fit the temperature by which the logits are divided). Only the sample's sparse vectors come to the driver. Labels
are classes of one model, so there are few of them: one row for each comes to the driver.

Defined results: a text that is null or has no letter is `und` with score 0; so is every text if nothing is labelled.
With one labelled language, every text with a letter has it, with score 1. Ties go to the smaller language code. Texts
of any length are read whole. Repeated rows get equal results; to learn from, rows of one id count once, with the
smallest text and label. Null ids are predicted but not learned from. An empty table gives an empty result. Other
columns stay as they are, whatever their names, in keep_identified; identify adds lang_pred and score to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free, id_mod, least_hashed, letters, small_batches

BITS = 16
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
PER_LANGUAGE = 800
EPOCHS = 3
#: Step sizes and elastic-net penalties of the leader.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
#: Below this confidence the filter of a pipeline rejects a text, besides texts without a letter.
LEAST_SCORE = 0.35


def ngram_counts(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row, bucket, count, whether a row has letters), by row and bucket."""
    for i, n, cps, offs in letters(col):
        row = np.repeat(np.arange(n, dtype=np.uint32), np.diff(offs))
        full = cps != SPACE
        has = np.zeros(n, bool)
        has[np.unique(row[full])] = True
        keys = []
        h, ok = np.zeros(len(cps), np.uint32), np.ones(len(cps), bool)
        some = np.zeros(len(cps), bool)
        for k in range(max(ORDERS)):
            m = max(0, len(cps) - k)
            h = (h[:m] ^ cps[k:]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            ok = ok[:m] & (row[:m] == row[k:])
            some = some[:m] | full[k:]
            if k + 1 in ORDERS:
                at = np.flatnonzero(ok & some)
                keys.append((row[at] << np.uint32(BITS)) | ((h[at] * np.uint32(0x85EBCA6B + 2 * k)) >> np.uint32(32 - BITS)))
        if keys:
            got = np.sort(np.concatenate(keys))
            new = np.flatnonzero(np.concatenate(([True], got[1:] != got[:-1]))) if len(got) else np.zeros(0, np.int64)
            count = np.diff(np.concatenate((new, [len(got)])))
            got = got[new]
            yield i, n, (got >> np.uint32(BITS)).astype(np.int64), (got & np.uint32(BUCKETS - 1)).astype(np.int64), count, has


def bucket_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and for each bucket in how many of them it occurs: counted in the tasks, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            rows += b.num_rows
            for _, _, _, bucket, _, _ in ngram_counts(b.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["bucket", "n"])

    small_batches(docs.sparkSession)
    rows = docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS + 1 rows
    df = np.zeros(BUCKETS + 1, np.int64)
    df[[r[0] for r in rows]] = [r[1] for r in rows]
    return int(df[-1]), df[:-1]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    def vectors(self, row: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """Weights of the features, of unit length in each row."""
        x = (1 + np.log(count)) * self.idf[bucket]
        norm = np.sqrt(np.bincount(row, x * x, n))
        return x / norm[row]

    def probabilities(self, row: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        x = self.vectors(row, bucket, count, n)
        z = np.stack([np.bincount(row, x * self.weights[bucket, c], n) for c in range(len(self.langs))], 1) + self.bias
        return softmax(z / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of FTRL-proximal with L1 and L2, one pass over the rows in a seeded order for each epoch."""
    z, g2 = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def leader(at: np.ndarray) -> np.ndarray:
        a = z[at]
        l1 = np.where(at == BUCKETS, 0.0, L1)[:, None]
        return np.where(np.abs(a) <= l1, 0.0, -(a - np.sign(a) * l1) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2))

    for e in range(epochs):
        for r in np.random.default_rng(11 + e).permutation(len(rows)):
            at, x = np.append(rows[r][0], BUCKETS), np.append(rows[r][1], 1.0)
            w = leader(at)
            p = softmax(x @ w)
            p[y[r]] -= 1
            g = x[:, None] * p
            sq = g2[at] + g * g
            z[at] += g - (np.sqrt(sq) - np.sqrt(g2[at])) / ALPHA * w
            g2[at] = sq
    w = np.concatenate([leader(np.arange(i, min(i + 4096, BUCKETS + 1))) for i in range(0, BUCKETS + 1, 4096)])
    return w[:-1], w[-1]


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, of a geometric grid from 0.02 to 20.

    One label's weight is spread over all classes, so a few rows without an error don't make every score 1.
    """
    if not len(y):
        return 1.0
    grid = np.geomspace(0.02, 20, 121)
    spread = 1 / (len(y) + 1)
    want = np.full(z.shape, spread / z.shape[1])
    want[np.arange(len(y)), y] += 1 - spread
    loss = [-(want * np.log(np.maximum(softmax(z / t), 1e-300))).sum(1).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, labelled: DataFrame) -> Model:
    """docs: text of all documents; labelled: doc_id, text, lang of those to learn from."""
    rows, df = bucket_frequencies(docs)
    idf = np.log((1 + rows) / (1 + df)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n, row, bucket, count, _ in ngram_counts(b.column(1)):
                cut = np.searchsorted(row, np.arange(n + 1))
                part = b.column(0).slice(i, n)
                offs = pa.array(cut.astype(np.int32))
                yield pa.record_batch([part, pa.ListArray.from_arrays(offs, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(offs, pa.array(count.astype(np.int32)))], ["lang", "buckets", "counts"])

    ids = least_hashed(labelled.where("lang is not null and doc_id is not null").select("doc_id", "lang"), "lang", PER_LANGUAGE)
    sample = labelled.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"))
    got = sample.select("lang", "text").mapInArrow(run, "lang string, buckets array<int>, counts array<int>").toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    model = Model(langs, idf, np.zeros((BUCKETS, len(langs))), np.zeros(len(langs)))
    vectors, y = [], []
    for lang, bucket, count in zip(got.column("lang").to_pylist(), got.column("buckets"), got.column("counts")):
        bucket, count = bucket.values.to_numpy(), count.values.to_numpy()
        if len(bucket):
            vectors.append((bucket, model.vectors(np.zeros(len(bucket), np.int64), bucket, count, 1)))
            y.append(langs.index(lang))
    if len(set(y)) < 2:
        return model
    # an order that doesn't depend on how Spark returned the rows
    order = sorted(range(len(y)), key=lambda i: (y[i], len(vectors[i][0]), vectors[i][0].tolist()))
    vectors, y = [vectors[i] for i in order], np.array([y[i] for i in order])
    held = np.arange(len(y)) % 5 == 4
    model.weights, model.bias = follow_the_leader([v for v, h in zip(vectors, held) if not h], y[~held], len(langs))
    z = np.array([x @ model.weights[at] + model.bias for (at, x), h in zip(vectors, held) if h]).reshape(-1, len(langs))
    model.temperature = fit_temperature(z, y[held])
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score, under the given names; other columns stay as they are."""
    from pyspark.sql import types as T

    model.weights = model.weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*model.langs, "und"], object)
        for b in batches:
            pred, score = np.full(b.num_rows, len(model.langs)), np.zeros(b.num_rows)
            if model.langs:
                for i, n, row, bucket, count, has in ngram_counts(b.column(b.schema.get_field_index(text_col))):
                    p = model.probabilities(row, bucket, count, n)
                    pred[i : i + n] = np.where(has, p.argmax(1), len(model.langs))
                    score[i : i + n] = np.where(has, p.max(1), 0.0)
            yield pa.record_batch([*b.columns, pa.array(langs[pred], pa.string()), pa.array(score)], [*b.schema.names, *names])

    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns only from rows whose crc32(doc_id as text) mod 3 is not 1."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held = id_mod("doc_id", 3) == 1
    model = train(docs.select("text"), docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language was identified, with the columns they had."""
    lang, score = free("lang_pred", docs), free("score", docs)
    return identify(docs, model, names=(lang, score)).where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)
