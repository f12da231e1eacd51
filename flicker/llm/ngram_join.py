"""Exact n-gram Jaccard self-join: size-banded tiles, hashed bitmap signatures, sorted-array intersection.

How it works
    1. Each text becomes its set of distinct 5-word shingles, as 64-bit hashes under a key drawn for the job: two
       different shingles collide with a chance of about 2^-64, whatever the texts are. Rows with equal sets are one node.
    2. Two sets with Jaccard >= 0.8 share an element among the first n - ceil(0.8 n) + 1 of either set in any common
       order. The order is the keyed hash itself. With tokens=None whole prefixes are taken: exact. With a number (TOKENS),
       prefixes are cut there: the order is random to every text, so a linked pair shares none of 28 elements with a
       chance of at most 0.2 ** 28 = 3e-20, below that of a collision; sets of up to 140 shingles aren't cut at all.
    3. Nodes that share a prefix element and a size band meet in a tile, sorted by size. A bitmap of 2 to 4 bits for
       each element bounds the overlap from above: overlap <= (|x| + |y| - popcount(bx xor by)) / 2. A pair belongs to
       the tile of its smallest shared prefix element only. A tile returns the nodes with a pair that the bound lets
       through, never the pairs.
    4. The texts of these nodes are joined to their tiles, where pairs are verified by intersecting the sorted arrays
       of the whole texts. Pairs that verified links already connect are skipped, so a tile returns fewer links than
       it has nodes, and no link between different components is lost.
    5. Tiles above TILE_SHINGLES elements are cut into blocks, and all block pairs are visited, each in a task's memory.

Defined results: null, empty or white-space-only text: set size 0, its own component. Rows that share a doc_id are
rows of one output each; null doc_ids never lead a component (its component is null if all ids in it are null), but link
as all others do. Texts of any length are taken whole. An empty table gives an empty result. Columns besides id and text
are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NARROW_BYTES, WordHash, discard, free, lower_ascii, materialize, mix, small_batches, text_buffers, word_spans

WORDS, PERCENT, TOKENS, TILE_SHINGLES = 5, 80, 28, 4 << 20
#: Rows of (id, 16-byte hash) that are broadcast to pick texts by; above, texts are shuffled to them.
BROADCAST_ROWS = 500_000


def shingle_sets(col: pa.Array, word: WordHash) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for _, n, buf, offs in text_buffers(col):
        starts, ends, rows = word_spans(buf, offs)
        if not len(starts):
            yield from (np.zeros(0, np.uint64) for _ in range(n))
            continue
        h = word(lower_ascii(buf), starts, ends)
        m = max(0, len(h) - WORDS + 1)
        s = np.zeros(m, np.uint64)
        for k in range(WORDS):
            s = (s ^ h[k : k + m]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            s ^= s >> np.uint64(29)
        s = mix(s)
        whole = rows[:m] == rows[WORDS - 1 :]
        s, at = s[whole], rows[:m][whole]
        cuts = np.searchsorted(at, np.arange(n + 1))
        wcuts = np.searchsorted(rows, np.arange(n + 1))
        for i in range(n):
            if cuts[i + 1] > cuts[i]:
                yield np.unique(s[cuts[i] : cuts[i + 1]])
            elif wcuts[i + 1] > wcuts[i]:  # fewer words: the whole sequence is the one shingle
                g = np.uint64(wcuts[i + 1] - wcuts[i])
                for x in h[wcuts[i] : wcuts[i + 1]]:
                    g = mix((np.array([g]) ^ x) * np.uint64(0x9E3779B97F4A7C15))[0]
                yield np.array([g], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def bitmap(s: np.ndarray) -> bytes:
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    on = np.zeros(bits, np.uint8)
    on[(s >> np.uint64(20)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(on, bitorder="little").tobytes()


def _node(s: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def _sketch(key: bytes, tokens: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = WordHash(key)
        for b in batches:
            size, node, toks, bits = [], [], [], []
            for s in shingle_sets(b.column(1), word):
                n = len(s)
                size.append(n)
                node.append(_node(s))
                prefix = n + (n > 0) - -(-PERCENT * n // 100)
                toks.append(s[: prefix if tokens is None else min(prefix, tokens)].view(np.int64))
                bits.append(bitmap(s) if n else None)
            cols = [b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(toks, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.record_batch(cols, ["doc_id", "text_hash", "n", "node", "toks", "bits"])

    return run


_ONES = np.array([bin(i).count("1") for i in range(65536)], np.uint8)


def _fold(m: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows) as 64-bit words, or-ed down to width words."""
    while m.shape[1] > width:
        m = m[:, : m.shape[1] // 2] | m[:, m.shape[1] // 2 :]
    return m


def _popcount(m: np.ndarray) -> np.ndarray:
    return np.bitwise_count(m).sum(1, dtype=np.int64) if hasattr(np, "bitwise_count") else _ONES[m.view(np.uint16)].sum(1, dtype=np.int64)


class Tile:
    """Nodes of a tile, sorted by size, and the pairs that belong to it and pass the bitmap bound.

    side: odd for visitors from the next size band, which don't meet each other; plus 2 or 4 for rows of the first or
    second of two blocks.
    """

    def __init__(self, token: int, n: np.ndarray, side: np.ndarray, toks: list[np.ndarray], bits: list[bytes]):
        self.n, self.side = n, side
        # prefix elements below the tile's own: a pair that shares one of them belongs elsewhere
        own = np.array([token]).view(np.uint64)[0]
        low = [t.view(np.uint64)[t.view(np.uint64) < own] for t in toks]
        self.low = np.zeros((len(n), max((len(t) for t in low), default=0)), np.uint64)
        for r, t in enumerate(low):
            self.low[r, : len(t)] = t
        self.lows = [len(t) for t in low]
        self.widths = np.array([len(b) // 8 for b in bits])
        self.row = np.zeros(len(n), np.int64)
        self.maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.widths):
            at = np.flatnonzero(self.widths == w)
            self.maps[int(w)] = at, np.frombuffer(b"".join(bits[k] for k in at), np.uint64).reshape(len(at), w)
            self.row[at] = np.arange(len(at))

    def partners(self, i: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """Places k > i of the partners of i (among those wanted)."""
        found = []
        w = int(self.widths[i])
        mine = self.maps[w][1][self.row[i] : self.row[i] + 1]
        most = 100 * self.n[i] // PERCENT
        for v, (at, m) in self.maps.items():
            lo = int(np.searchsorted(at, i, "right"))
            hi = int(np.searchsorted(self.n[at], most, "right"))
            if lo >= hi:
                continue
            k = at[lo:hi]
            ok = (self.side[k] % 2 == 0) | (self.side[i] % 2 == 0)
            if self.side[i] > 1:  # of two blocks: pairs of one block meet where it is alone
                ok &= self.side[k] // 2 != self.side[i] // 2
            if wanted is not None:
                ok &= wanted[k]
            if not ok.all():
                k, m = k[ok], m[lo:hi][ok]
            else:
                m = m[lo:hi]
            if not len(k):
                continue
            width = min(v, w)
            diff = _popcount(_fold(m, width) ^ _fold(mine, width))
            both = self.n[k] + self.n[i]
            over = (both - diff) // 2
            k = k[100 * over >= PERCENT * (both - over)]
            if len(k) and self.lows[i]:
                k = k[~np.isin(self.low[k], self.low[i, : self.lows[i]]).any(1)]
            if len(k):
                found.append(k)
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _by_tile(flush):
    """Runs flush over the rows of each tile; rows come sorted by tile, which ends where its key changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("token", "band", "block")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                key = tuple(keys[s].tolist())
                if last is not None and key != last:
                    yield from flush(last, pa.Table.from_batches(held).combine_chunks())
                    held.clear()
                last = key
                held.append(b.slice(s, e - s))
        if held:
            yield from flush(last, pa.Table.from_batches(held).combine_chunks())

    return run


def _tile(token: int, t: pa.Table) -> Tile:
    n, side = (t.column(c).to_numpy() for c in ("n", "side"))
    return Tile(token, n, side, [np.asarray(x.values, np.int64) for x in t.column("toks")], t.column("bits").to_pylist())


def _mark(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
    """The nodes of a tile that have a partner in it."""
    if t.num_rows > 1 and (t.column("side").to_numpy() % 2 == 0).any():
        tile, marked = _tile(key[0], t), np.zeros(t.num_rows, bool)
        for i in range(t.num_rows - 1):
            k = tile.partners(i)
            if len(k):
                marked[i] = True
                marked[k] = True
        if marked.any():
            yield t.filter(pa.array(marked)).select(["token", "band", "block", "node", "n", "side", "toks", "bits"]).combine_chunks().to_batches()[0]


def _link(word_key: bytes):
    """Links (a, b) that connect all nodes of a tile which its verified pairs connect."""

    def run(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        tile, sets = _tile(key[0], t), list(shingle_sets(t.column("text").combine_chunks(), WordHash(word_key)))
        node, comp = t.column("node").to_numpy(), np.arange(t.num_rows)
        a, b = [], []
        for i in range(t.num_rows - 1):
            k = tile.partners(i, comp != comp[i])
            while len(k):
                j, k = k[0], k[1:]
                x, y = sets[i], sets[j]
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    a.append(min(node[i], node[j]))
                    b.append(max(node[i], node[j]))
                    comp[comp == comp[j]] = comp[i]
                    k = k[comp[k] != comp[i]]
        if a:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _candidates(nodes: DataFrame) -> DataFrame:
    """The rows (token, band, block, node, n, side, toks, bits) of nodes in the tiles where they have a partner."""
    rows = nodes.select("node", "n", F.explode("toks").alias("token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    rows = rows.join(shared, "token").withColumn("band", F.floor(F.log("n") / F.log(F.lit(100.0 / PERCENT))).cast("long"))
    # a set of band k + 1 visits band k, so that sizes within the ratio always meet
    homes = rows.select("node", "n", "token", F.explode(F.array(F.struct("band", F.lit(0).alias("side")), F.struct((F.col("band") - 1).alias("band"), F.lit(1).alias("side")))).alias("t")).select("node", "n", "token", "t.*")
    tiles = homes.groupBy("token", "band").agg(F.count("*").alias("size"), F.sum("n").alias("held"), F.min("side").alias("own")).where("size > 1 and own = 0").select("token", "band", F.ceil(F.col("held") / TILE_SHINGLES).cast("int").alias("k"))
    homes = homes.join(tiles, ["token", "band"])
    # block pairs (i, j) of a tile of k blocks have the number i * k + j; a row of block x meets all blocks y
    x = F.pmod(F.col("node"), F.col("k")).cast("int")
    homes = homes.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("block", F.least(x, "y") * F.col("k") + F.greatest(x, "y"))
    homes = homes.withColumn("side", F.col("side") + F.when(x == F.col("y"), 0).when(x < F.col("y"), 2).otherwise(4))
    rows = homes.select("token", "band", "block", "node", "side").join(nodes.select("node", "n", "toks", "bits"), "node")
    parts = rows.repartition("token", "band", "block").sortWithinPartitions("token", "band", "block", "n", "node").select(*_KEYS)
    return parts.mapInArrow(_by_tile(_mark), _ROW)


_KEYS = ["token", "band", "block", "node", "n", "side", "toks", "bits"]
_ROW = "token long, band long, block int, node long, n long, side int, toks array<long>, bits binary"


def _links(marked: DataFrame, texts: DataFrame, key: bytes) -> DataFrame:
    rows = marked.join(texts, "node").repartition("token", "band", "block").sortWithinPartitions("token", "band", "block", "n", "node")
    return rows.select(*_KEYS, "text").mapInArrow(_by_tile(_link(key)), "a long, b long").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b): smallest label of the neighbours, then labels of labels, until stable."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("comp")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        top = labels.select(F.col("node").alias("to"), F.col("comp").alias("up"))
        last, labels = labels, materialize(step.join(top, "to").select("node", F.least("to", "up").alias("comp"), (F.least("to", "up") != F.col("was")).alias("moved")), name)
        discard(last)
        if labels.where("moved").isEmpty():
            return labels.select("node", "comp")


def _text_hash(text: str) -> Column:
    """128 bits of the text's SHA-256: equal for equal texts only. Null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))


def _rows(docs: DataFrame, tokens: int | None) -> DataFrame:
    """One row for each row of docs (doc_id, text, text_hash): doc_id, text_hash, n, node, comp, component_id, lead.

    comp is the smallest node of a component, lead the smallest text hash of the row's node; all are null without a shingle.
    """
    small_batches(docs.sparkSession, NARROW_BYTES)
    key = secrets.token_bytes(16)
    sketch = materialize(docs.mapInArrow(_sketch(key, tokens), "doc_id long, text_hash binary, n long, node long, toks array<long>, bits binary"), "sketch")
    sets = sketch.where("node is not null")
    reps = sets.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("lead"), F.min_by(F.struct("n", "toks", "bits"), "n").alias("s"))
    nodes = materialize(reps.select("node", "doc_id", "lead", "s.*"), "nodes")
    marked = materialize(_candidates(nodes), "marked")
    near = materialize(nodes.join(marked.select("node").distinct(), "node", "left_semi").select(F.col("lead").alias("text_hash"), "node"), "near")
    # the text of one row of each node, found by the text's hash: ids can repeat or be null. Copies go once from each batch
    if near.count() <= BROADCAST_ROWS:
        texts = docs.select("text_hash", "text").join(F.broadcast(near.select("text_hash")), "text_hash", "left_semi")
    else:
        texts = docs.select("text_hash", "text")
    wanted = texts.mapInArrow(_distinct_texts, "text_hash binary, text string").join(near, "text_hash")
    texts = materialize(wanted.select("node", "text").dropDuplicates(["node"]), "texts")
    links = materialize(_links(marked, texts, key), "links")
    comp = components(links, "comp")
    discard(marked, near, texts, links)
    named = nodes.select("node", "doc_id", "lead").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    to = named.select("node", "comp", "lead").join(least, "comp").select("node", "comp", "component_id", "lead")
    return sketch.select("doc_id", "text_hash", "n", "node").join(to, "node", "left")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: int | None = TOKENS) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (see the module)."""
    out = _rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _text_hash(text_col).alias("text_hash")), tokens)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, tokens: int | None = TOKENS) -> DataFrame:
    """The rows of docs (doc_id, text and any others), with their columns, without near duplicates.

    Of each component the rows with its smallest id stay, equal texts of them once. Rows without an id stay only if no
    row of their component has one, and then one of them. Rows without a word are kept, equal texts of one id once.
    """
    rows = _rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash("text").alias("text_hash")), tokens)
    first = (F.col("node") == F.col("comp")) & (F.col("text_hash") == F.col("lead"))
    leads = F.col("node").isNull() | (F.col("doc_id") == F.col("component_id")) | (F.col("doc_id").isNull() & F.col("component_id").isNull() & first)
    # the texts that stay, once, are most: look for the others
    each = rows.groupBy("doc_id", "text_hash").agg(F.bool_or(F.coalesce(leads, F.lit(False))).alias("stays"), F.count("*").alias("n")).where(~F.col("stays") | (F.col("n") > 1))
    own = [free(c, docs) for c in ("own_id", "own_hash", "stays", "text_hash")]
    others = materialize(each.select(F.col("doc_id").alias(own[0]), F.col("text_hash").alias(own[1]), F.col("stays").alias(own[2])), "others")
    some = F.broadcast(others) if others.count() <= BROADCAST_ROWS else others
    held = docs.withColumn(own[3], _text_hash("text"))
    held = held.join(some, F.col("doc_id").cast("long").eqNullSafe(F.col(own[0])) & (F.col(own[3]) == F.col(own[1])), "left")
    again = held.where(own[2]).dropDuplicates(["doc_id", own[3]])
    return held.where(F.col(own[2]).isNull()).unionByName(again).select(*docs.columns)


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        first = dict(zip(reversed(b.column(0).to_pylist()), range(b.num_rows - 1, -1, -1)))
        yield b.take(pa.array(sorted(first.values()), pa.int64()))
