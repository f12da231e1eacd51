"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

A document is its token ids and a final id 0. Documents longer than a sequence are cut into whole sequences and one
rest; every other document is one piece. A piece goes into the open sequence (or a new one) for which the sum over the
residual gaps of the squared number of open sequences becomes smallest; ties go to the smallest gap.

At scale: texts are tokenised where they are read and never shuffled; only (id, piece, length, checksum) rows move.
They are dealt by a hash of the whole row and its place in its task into groups of about GROUP_PIECES pieces, so a hot
key can't fill one group, and each group is packed by one task with bounded state (gap counts and open sequences).
A group leaves at most a few sequences partly empty, so the number of sequences stays near the sum over lengths.

Defined results: a null or empty text is the single id 0 (one piece of length 1). A text of any length is tokenised
whole. Repeated rows, and rows without an id, are packed once each; ties in length keep the order of checksum, id and
piece. An empty table gives an empty result. Columns besides id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heads, mix, parts_for, small_batches, text_buffers

SEQUENCE = 2048
GROUP_PIECES = 32768
#: Words that a Python worker keeps with their ids, at most: 32 bytes each, and as many ids as 4 a word before the store starts anew.
STORE_WORDS = 1 << 19
#: Words that are encoded at once.
ENCODE_WORDS = 500

_LETTER, _DIGIT, _OTHER, _CONTRACTION, _BAD = 1, 2, 3, 4, 9
_CLASS = np.full(256, _BAD, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT


class WordTokenizer:
    """Ids of the tokenizer word_bpe_49k (lower case, word ends), by a store of words for plain Latin text.

    The tokenizer itself gives the ids of every word, and of every text with other characters or with the string of a
    special token. Words up to 16 bytes have a place in the store by their hash and are compared byte by byte; a new one
    takes the place of what was there, so frequent words stay or come back and rare ones make room. Longer words are kept
    by themselves.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        bits = max(1, (STORE_WORDS - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros((1 << bits, 4), np.uint64)  # a word's bytes in two numbers, first of its ids in flat, how many
        self.long: dict[bytes, tuple[int, int]] = {}
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _add(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes words: the first of the ids of each in flat, and how many they are."""
        sizes = [np.zeros(0, np.int64)]
        begin = self.used
        for at in range(0, len(words), ENCODE_WORDS):
            some = words[at : at + ENCODE_WORDS]
            ids = self._encode(b" ".join(some).decode())
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(ids):
                each = [self._encode(w.decode()) for w in some]
                ids, cuts = np.concatenate(each), np.cumsum([len(e) for e in each])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            sizes.append(np.diff(cuts, prepend=0))
        size = np.concatenate(sizes)
        return begin + np.cumsum(size) - size, size

    def _words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of the ids of each word in flat, and how many they are."""
        if self.used > 4 * STORE_WORDS:
            self._clear()
        a, b = heads(buf, starts, ends)
        hashes = mix(a ^ mix(b + np.uint64(0x9E3779B97F4A7C15)))
        slot = (hashes >> self.shift).astype(np.int64)
        held = self.table[slot]
        at, size = held[:, 2].astype(np.int64), held[:, 3].astype(np.int64)
        long = ends - starts > 16
        missing = np.flatnonzero(((held[:, 0] != a) | (held[:, 1] != b)) & ~long)
        if len(missing):
            by = missing[np.argsort(hashes[missing])]
            new = np.ones(len(by), bool)  # words of one hash may be mixed: then some are encoded twice
            new[1:] = (a[by[1:]] != a[by[:-1]]) | (b[by[1:]] != b[by[:-1]])
            first, nth = by[new], np.cumsum(new) - 1
            raw = buf.tobytes()
            place, count = self._add([raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist())])
            self.table[slot[first]] = np.stack((a[first], b[first], place.astype(np.uint64), count.astype(np.uint64)), 1)
            at[by], size[by] = place[nth], count[nth]
        if long.any():
            which = np.flatnonzero(long)
            own = [buf[x:y].tobytes() for x, y in zip(starts[which].tolist(), ends[which].tolist())]
            if len(self.long) > STORE_WORDS // 8:
                self.long.clear()
            fresh = [w for w in dict.fromkeys(own) if w not in self.long]
            place, count = self._add(fresh)
            self.long.update(zip(fresh, zip(place.tolist(), count.tolist())))
            at[which], size[which] = np.array([self.long[w] for w in own], np.int64).T
        return at, size

    def ids(self, col: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row, and a final 0, as unsigned 32-bit numbers."""
        for i, n, buf, offs in text_buffers(col):
            kind, raw = _CLASS[buf], buf.tobytes()
            buf = buf.copy()
            buf[(buf >= 65) & (buf <= 90)] += 32
            lead = np.flatnonzero(buf == 0xC3)
            lead = lead[lead + 1 < len(buf)]
            second = buf[lead + 1]
            letter = (second != 0x97) & (second != 0xB7)
            kind[lead] = kind[lead + 1] = np.where(letter, _LETTER, _OTHER)
            buf[lead + 1] = np.where((second >= 0x80) & (second <= 0x9E) & letter, second + 32, second)
            bad = np.zeros(n, bool)
            bad[np.searchsorted(offs, np.flatnonzero(kind == _BAD), "right") - 1] = True
            first = np.zeros(len(buf) + 1, bool)
            first[offs] = True
            cut = first.copy()
            cut[1:-1] |= kind[1:] != kind[:-1]
            cut[:-1] |= kind == _DIGIT
            # 's 't 'm 'd 're 've 'll at the start of a run of other characters
            p = np.flatnonzero((buf == 39) & cut[:-1])
            if len(p):
                pad = np.concatenate((buf, np.zeros(3, np.uint8)))
                fence = np.concatenate((first, np.ones(3, bool)))
                a, b = pad[p + 1], pad[p + 2]
                near = ~fence[p + 1]
                one = near & np.isin(a, np.frombuffer(b"stmd", np.uint8))
                two = near & ~fence[p + 2] & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
                for q, k in ((p[one], 2), (p[two & ~one], 3)):
                    for d in range(k):
                        kind[q + d] = _CONTRACTION
                        if d:
                            cut[q + d] = False
                    cut[q + k] = True
            stops = np.flatnonzero(cut)
            full = kind[stops[:-1]] != 0
            starts, ends = stops[:-1][full], stops[1:][full]
            rows = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, offs)))
            for text in self.special:
                p = raw.find(text)
                while p >= 0:
                    bad[np.searchsorted(offs, p, "right") - 1] = True
                    p = raw.find(text, p + 1)
            good = ~bad[rows]
            starts, ends, rows = starts[good], ends[good], rows[good]
            at, size = self._words(buf, starts, ends)
            place = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
            got = self.flat[place]
            cuts = np.concatenate(([0], np.cumsum(np.bincount(rows, weights=size, minlength=n).astype(np.int64))))
            for r in range(n):
                if bad[r]:
                    own = self._encode(col[i + r].as_py())
                else:
                    own = got[cuts[r] : cuts[r + 1]]
                yield np.append(own, np.uint32(0))


_tokenizers: dict[tuple[str, bool], WordTokenizer] = {}


def tokenizer(path: str, special_as_text: bool = False) -> WordTokenizer:
    """One for each Python worker, path and way of special tokens."""
    key = (path, special_as_text)
    if key not in _tokenizers:
        _tokenizers[key] = WordTokenizer(*key)
    return _tokenizers[key]


def cut_pieces(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, place (of the row in its task) and, if asked for, ids (bytes).

    The strings of special tokens are these tokens, as the tokenizer has it, or ordinary text with special_as_text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, place = tokenizer(tokenizer_path, special_as_text), 0
        for b in batches:
            rows = []
            for r, ids in enumerate(tok.ids(b.column(1))):
                raw = ids.astype("<u4").tobytes()
                for k in range(0, len(ids), length):
                    part = raw[4 * k : 4 * (k + length)]
                    rows.append((r, k // length, k, len(part) // 4, zlib.crc32(part), place, part if with_ids else None))
                    place += 1
            src, piece, start, size, crc, at, ids = zip(*rows) if rows else ([],) * 7
            cols = [b.column(0).take(pa.array(src, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(at, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "place"]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.record_batch(cols, names)

    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, place long" + (", ids binary" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length (all <= capacity), placed in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences of each gap; full and empty ones don't count
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    no = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        rest = count[: capacity + 1 - s]  # what each gap from s on becomes
        now = count[s:]
        change = 2 * (rest - now) + 2
        change[0] = 1 - 2 * now[0]  # filled up
        change[now == 0] = no
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        best = int(change.argmin())
        if change[best] <= fresh and change[best] != no:
            gap = best + s
            b = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, made
            made += 1
        seq[i], off[i] = b, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_at[gap - s].append(b)
    return seq, off


def pack(pieces: DataFrame, rows: int, length: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to pieces; rows: about how many there are."""
    groups = parts_for(rows, GROUP_PIECES)
    cols = [c for c in pieces.columns if c != "place"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != "place") + ", sequence_id long, offset long"

    def one(t: pa.Table) -> pa.Table:
        # ids stay in Arrow: null ids don't turn their neighbours into floats
        t = t.sort_by([("length", "descending"), *[(c, "ascending") for c in ("ids_crc32", "doc_id", "piece", "place")]])
        seq, off = sum_of_squares(t.column("length").to_numpy(), length)
        first = t.column("grp")[0].as_py() << 32
        return t.select(cols).append_column("sequence_id", pa.array(seq + first)).append_column("offset", pa.array(off))

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "place"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(one, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    return pack(cut_pieces(docs, tokenizer_path, length, with_ids, special_as_text=special_as_text), 2 * docs.count(), length)
