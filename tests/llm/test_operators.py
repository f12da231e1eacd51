"""The ten operators: brute force, round trips, held-out accuracy, and odd input."""

import gzip
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flicker.llm import chat, imatch, langid, mixing, neighbours, ngram_join, packing, sharding, toxicity, warc
from flicker.llm.common import scratch_path
from flicker.llm.queries import QUERIES, SQL, tokenizer_path
from tests.conftest import DATA, assert_same

SMALL = f"{DATA}/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SMALL), duck, SQL[name])


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]


# ---------------------------------------------------------------- 1 packing


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def thue_morse(n):
    """The Thue-Morse word of 2 ** n letters and its complement: polynomial hashes modulo 2 ** 64 can't tell them apart from n = 10 on."""
    w = "a"
    for _ in range(n):
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


TEXTS = [
    "a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|> <|endoftext |>", *thue_morse(10), " ".join(thue_morse(11)), "abcdefgh abcdefghi abcdefghijklmnop abcdefghijklmnopq",
    "", "It's 12,5% of we'll don't DON'T a'b ''s 've", "été über ÀÉ ×÷ ß ÿ", "日本語 mixed with latin <|endoftext|> <|startoftext|>x", "a\tb\x0bc\x0c d e", "x" * 300, "I'LL i'll 'LL 're' 1234567890 _-_ (a)[b]{c}", "\U0001f600 ok\x00\x01", None,
]


def test_ids_equal_the_tokenizers(tok):
    got = list(packing.WordTokenizer(tokenizer_path()).ids(pa.array(TEXTS)))
    for text, ids in zip(TEXTS, got):
        assert ids.tolist() == [*tok.encode(text or "", add_special_tokens=False).ids, 0], text


def test_special_tokens_as_text():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    texts = ["a <|endoftext|> b", "x<|startoftext|>y"]
    for text, ids in zip(texts, packing.WordTokenizer(tokenizer_path(), special_as_text=True).ids(pa.array(texts))):
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


def test_two_words_of_one_hash(tok, monkeypatch):
    monkeypatch.setattr(packing, "mix", lambda x: x * np.uint64(0))  # all words collide
    texts = ["one two three", "two", "three two", "one"]
    t = packing.WordTokenizer(tokenizer_path())
    for _ in range(2):
        for text, ids in zip(texts, t.ids(pa.array(texts))):
            assert ids.tolist() == [*tok.encode(text, add_special_tokens=False).ids, 0]


def test_packing_keeps_large_ids_beside_null_ids(spark, tok):
    docs = [(9007199254740993, "a b c"), (None, "d e"), (2**63 - 1, "f <|endoftext|>"), (None, None)]
    got = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), tokenizer_path()).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got if r["doc_id"] is not None) == [(9007199254740993, 4), (2**63 - 1, 3)]


def test_ids_of_all_documents(spark, tok):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text").toArrow().column("text").combine_chunks()
    for text, ids in zip(docs.to_pylist(), packing.WordTokenizer(tokenizer_path()).ids(docs)):
        assert ids.tolist() == [*tok.encode(text, add_special_tokens=False).ids, 0]


def test_ids_with_more_words_than_the_store_holds(tok, monkeypatch):
    monkeypatch.setattr(packing, "STORE_WORDS", 50)
    texts = [" ".join(f"w{k}" for k in range(a, a + 80)) for a in (0, 40, 80, 0)]
    t = packing.WordTokenizer(tokenizer_path())
    for _ in range(2):
        for text in texts:
            [ids] = t.ids(pa.array([text]))
            assert ids.tolist() == [*tok.encode(text, add_special_tokens=False).ids, 0]


def test_most_of_many_words_are_encoded_once(monkeypatch):
    """250,000 words, seen twice: the store neither starts anew nor grows beyond its bound."""
    t, encoded = packing.WordTokenizer(tokenizer_path()), []
    add = t._add
    monkeypatch.setattr(t, "_add", lambda words, *more: encoded.append(len(words)) or add(words, *more))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(w) for w in itertools.islice(itertools.product(letters, repeat=4), 250_000)]
    text = pa.array([" ".join(words[k : k + 5000]) for k in range(0, len(words), 5000)])
    first = [ids.tolist() for ids in t.ids(text)]
    assert sum(encoded) == len(words)
    encoded.clear()
    assert [ids.tolist() for ids in t.ids(text)] == first
    assert sum(encoded) < 0.4 * len(words)
    assert t.table.nbytes + t.flat.nbytes <= 64 * packing.STORE_WORDS


def check_packing(df, docs, tok):
    got = df.toPandas()
    assert len(got) and (got.length >= 1).all() and (got.length <= 2048).all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    want = []
    for doc_id, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    have = [(None if x != x else int(x), *r) for x, *r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    return got


def test_packing(spark, tok):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = check_packing(QUERIES["op1_best_fit_packing"](spark, SMALL), rows(docs, "doc_id", "text"), tok)
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 2


def test_packing_of_odd_input(odd_docs, no_docs, tok):
    check_packing(packing.pack_documents(odd_docs, tokenizer_path()), rows(odd_docs, "doc_id", "text"), tok)
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


def test_sum_of_squares_rule():
    """Each placement makes the sum of squared counts smallest, against trying every place."""
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 21, 300)
    seq, off = packing.sum_of_squares(lengths, 20)
    fill: dict[int, int] = {}

    def cost(fill):
        c = np.bincount([20 - v for v in fill.values() if 0 < v < 20], minlength=21)
        return int((c * c).sum())

    for s, b, o in zip(lengths.tolist(), seq.tolist(), off.tolist()):
        best = min(cost({**fill, k: fill.get(k, 0) + s}) for k in [*[k for k, v in fill.items() if v + s <= 20], -1])
        assert fill.get(b, 0) == o
        fill[b] = o + s
        assert cost(fill) == best


# ---------------------------------------------------------------- 2 near duplicates


def brute_components(docs):
    sets = []
    for _, text in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs))


def near_copies(n=60):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    docs = []
    for i in range(n):
        w = list(base[: 60 + i % 60])
        for k in rng.integers(0, len(w), i % 6):
            w[k] = f"X{i}_{k}"
        docs.append((i, " ".join(w)))
    return [*docs, (1000, docs[3][1].upper()), (1001, ""), (1002, None), (1003, "a b"), (1004, "A  B"), (1005, "a b c")]


@pytest.mark.parametrize("tile,broadcast", [(4 << 20, 1000), (300, 0)])
def test_near_duplicates(spark, monkeypatch, tile, broadcast):
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", tile)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", broadcast)
    docs = near_copies()
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(rows(got, "doc_id", "n_shingles", "component_id")) == brute_components(docs)


@pytest.mark.parametrize("tokens", [None, 28])
def test_near_duplicates_of_long_sets(spark, tokens):
    """Sets of over 140 shingles, whose prefixes are longer than TOKENS: whole, and cut."""
    rng = np.random.default_rng(8)
    docs = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(900)]
        for c in range(4):
            w = list(base)
            for k in rng.choice(900, 8 + 8 * c, replace=False):
                w[k] = f"x{c}_{k}"
            docs.append((g * 10 + c, " ".join(w)))
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), tokens=tokens)
    assert sorted(rows(got, "doc_id", "n_shingles", "component_id")) == brute_components(docs)


def test_sets_of_words_that_collide_in_polynomial_hashes(spark):
    x, y = thue_morse(10)
    docs = [(1, " ".join([x] * 3 + ["p"] * 3)), (2, " ".join([y] * 3 + ["p"] * 3)), (3, x + " " + y), (4, y + " " + x)]
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(rows(got, "doc_id", "n_shingles", "component_id")) == brute_components(docs)


def test_dropping_near_duplicates_keeps_all_columns(spark, monkeypatch):
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("text_md5", "text_hash", "own_id", "own_hash", "stays", "node")})
    want = {c for _, _, c in brute_components(near_copies())}
    for most in (1000, 0):
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", most)
        kept = ngram_join.keep_one_of_each(docs)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want


def test_near_duplicates_of_odd_input(odd_docs, no_docs):
    got = rows(ngram_join.jaccard_components(odd_docs), "doc_id", "n_shingles", "component_id")
    assert len(got) == 9 and got.count((1, 5, 1)) == 2 and (None, 5, 1) in got and (2, 0, 2) in got and (5, 1, 5) in got
    assert ngram_join.jaccard_components(no_docs).count() == 0
    kept = ngram_join.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_near_duplicates_without_ids(spark):
    """Rows 1 and 9 are linked only by a set whose rows have no id; other sets without ids are alone or near each other."""
    word = lambda name, n: [f"{name}{i}" for i in range(n)]
    bridge = word("w", 64)
    far, near = " ".join(["x", "y", "z", "u", *bridge[4:]]), " ".join([*bridge[:-4], "p", "q", "r", "s"])
    bridge = " ".join(bridge)
    alone = " ".join(word("n", 64))
    close = alone + " more"
    other = " ".join(word("k", 64))
    docs = spark.createDataFrame([(1, far), (9, near), (None, bridge), (None, bridge), (None, alone), (None, alone), (None, close), (None, other), (3, other), (4, other + " more"), (4, alone + " x y")], "doc_id long, text string")
    got = rows(ngram_join.jaccard_components(docs), "doc_id", "component_id")
    assert sorted(got, key=repr) == sorted([(1, 1), (9, 1), (None, 1), (None, 1), (None, 4), (None, 4), (None, 4), (None, 3), (3, 3), (4, 3), (4, 4)], key=repr)
    assert sorted(rows(ngram_join.keep_one_of_each(docs), "doc_id", "text")) == [(1, far), (3, other), (4, alone + " x y")]
    none = spark.createDataFrame([(None, alone), (None, alone), (None, close), (None, alone.upper()), (None, None), (None, None), (5, other)], "doc_id long, text string")
    kept = rows(ngram_join.keep_one_of_each(none), "doc_id", "text")
    assert len(kept) == 3 and (None, None) in kept and (5, other) in kept


# ---------------------------------------------------------------- 3 fingerprints


def test_fingerprints_of_odd_input(odd_docs, no_docs):
    got = imatch.fingerprint_edits(odd_docs).collect()
    assert len(got) == 9
    same = {r["fingerprint"] for r in got if r["n_chars"] == 43}
    assert len(same) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    order = sorted(odd_docs.collect(), key=lambda r: (-r["doc_id"] if r["doc_id"] is not None else 99))
    texts = [r["text"] or "" for r in order]
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for t, n in zip(texts, [*texts[1:], texts[0]]))
    assert sorted(r["edited_sha256"] for r in got) == want
    assert imatch.fingerprint_edits(no_docs).count() == 0


def test_next_text_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 7)
    docs = spark.createDataFrame([(i * 3, f"text {i}") for i in range(100)], "doc_id long, text string")
    got = {r["doc_id"]: r["next"] for r in imatch.with_next(docs).where("ghost = 0").collect()}
    assert got == {i * 3: f"text {i - 1 if i else 99}" for i in range(100)}


def test_next_text_among_equal_and_null_ids(spark, monkeypatch):
    """Rows of one id, or without any, are spread over ranges by their texts."""
    monkeypatch.setattr(imatch, "RANGE_ROWS", 7)
    docs = [(i if i < 20 else 20 if i < 60 else None, f"{i * 7919 % 100:03} text") for i in range(100)]
    with_range = imatch.with_next(spark.createDataFrame(docs, "doc_id long, text string")).where("ghost = 0")
    order = [t for _, t in sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))]
    assert {r["text"]: r["next"] for r in with_range.collect()} == dict(zip(order, [*order[1:], order[0]]))
    assert with_range.groupBy("range").count().agg(F.max("count")).first()[0] <= 14


def test_edits_are_nearer_than_strangers(spark):
    got = QUERIES["op3_imatch_fingerprints"](spark, SMALL).where("n_chars > 100")
    near, far = got.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert near > far


def test_half_kept_texts_lie_above_strangers(spark):
    got = QUERIES["op3_imatch_fingerprints"](spark, f"{DATA}/sf0.01").where("fingerprint <> edited_fingerprint or near_edited < 1")
    share, none = got.agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("int")), F.avg((F.col("near_edited") == 0).cast("int"))).first()
    assert share >= 0.95 and none <= 0.05


# ---------------------------------------------------------------- 4 toxicity


def test_block_max_search_is_exact():
    rng = np.random.default_rng(5)

    def vector():
        t = np.sort(rng.choice(50, rng.integers(1, 8), replace=False))
        w = rng.random(len(t)) + 0.1
        return t, w / np.linalg.norm(w)

    have = [vector() for _ in range(700)]
    dense = np.zeros((700, 50))
    for r, (t, w) in enumerate(have):
        dense[r, t] = w
    index = toxicity.BlockMaxIndex(have, 50)
    visited = []
    for _ in range(100):
        t, w = vector()
        found, sims, blocks = index.search(t, w, 5)
        want = np.sort(dense[:, t] @ w)[::-1][:5]
        want = want[want > 0]
        assert len(found) == len(sims) == len(want) > 0
        assert np.allclose(sims, want, atol=1e-12) and np.allclose(dense[found][:, t] @ w, sims)
        visited.append(blocks)
    assert np.mean(visited) < index.blocks  # bounds let blocks be left out


def test_block_max_search_with_frequent_terms():
    """Terms of many examples are added from whole rows, without their postings; ties still go to the smaller row."""
    rng = np.random.default_rng(6)
    have = []
    for r in range(600):
        t = np.sort(np.concatenate((np.flatnonzero(rng.random(6) < 0.7), 6 + rng.choice(300, 5, replace=False))))
        w = rng.random(len(t)) + 0.1
        have.append((t, w / np.linalg.norm(w)) if r % 50 else (np.array([0, 2, 4]), np.full(3, 3**-0.5)))
    dense = np.zeros((600, 306))
    for r, (t, w) in enumerate(have):
        dense[r, t] = w
    index = toxicity.BlockMaxIndex(have, 306)
    frequent = np.flatnonzero((dense > 0).sum(0) > 600 // toxicity.LONG)
    assert 0 < len(frequent) < 306 and (np.flatnonzero(index.row >= 0) == frequent).all()
    assert (index.rows == dense[index.order][:, frequent].T).all()
    index.weight[np.isin(np.repeat(np.arange(306), np.diff(index.offs)), frequent)] = np.nan  # the search doesn't touch these postings
    for q in [*have[1:60], (np.array([0, 2, 4]), np.full(3, 3**-0.5))]:
        found, sims, _ = index.search(*q, 8)
        assert np.allclose(sims, np.sort(dense[:, q[0]] @ q[1])[::-1][:8], atol=1e-12) and np.allclose(dense[found][:, q[0]] @ q[1], sims)
    assert found.tolist() == list(range(0, 400, 50))
    alone = np.arange(40), np.full(40, 40**-0.5)
    assert len(toxicity.BlockMaxIndex([alone], 40).search(*alone, 8, but=0)[0]) == 0


def test_terms_are_found_by_their_upper_bits():
    """Also among terms whose upper bits are all equal, at both ends of the range, and in an empty vocabulary."""
    hashes = np.unique(np.concatenate((np.arange(40, dtype=np.uint64) * np.uint64(3) + np.uint64(5 << 50), np.array([0, 1, 2**64 - 1, 2**63], np.uint64))))
    terms = toxicity.Vocabulary(hashes.view(np.int64), toxicity.TermHash((1,)))
    asked = np.random.default_rng(7).permutation(np.concatenate((hashes, hashes + np.uint64(1), hashes - np.uint64(1), hashes)))
    place = {h: t for t, h in enumerate(hashes.tolist())}
    at, t = terms.find(asked)
    assert dict(zip(at.tolist(), t.tolist())) == {i: place[h] for i, h in enumerate(asked.tolist()) if h in place} and len(at) == len(set(at.tolist()))
    assert len(toxicity.Vocabulary([], toxicity.TermHash((1,))).find(asked)[0]) == 0


def test_words_of_a_hash():
    """Words of any length, also those that polynomial hashes can't tell apart, and words at borders of rows."""
    words = [w for n in (1, 3, 10, 11) for w in thue_morse(n)] + ["a", "aa", "b" * 5000, "b" * 5001, "été", "𐐀x"]
    hashing = toxicity.TermHash((1, 2, 3))
    got = {}
    for texts in (words, [" ".join(words)], ["x y", *words[::-1]], [None, "", "12", *words]):
        for _, _, row, h in toxicity.row_terms(pa.array(texts), hashing):
            flat = [w.lower() for t in texts for w in re.findall(r"[^\W\d_]+", t or "")]
            assert len(flat) == len(h) == len(row)
            for w, v in zip(flat, h.tolist()):
                assert got.setdefault(w, v) == v
    assert len(set(got.values())) == len(got)
    other = next(toxicity.row_terms(pa.array(["a"]), toxicity.TermHash((4,))))[3]
    assert other[0] != got["a"]


def test_toxicity_against_brute_force(spark):
    """Neighbours, votes, curve and scores from dense vectors, on the words of a small table."""
    sf = f"{DATA}/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    words = {d: [x.lower() for x in re.findall(r"[^\W\d_]+", t)] for d, t in texts.items()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["toxic"] is not None}
    ids = sorted(toxic)
    y = np.array([toxic[d] for d in ids])
    held = {}
    for d, t in zip(ids, y):
        for w in set(words[d]):
            held.setdefault(w, [0, 0])[t] += 1
    n, pos = len(ids), int(y.sum())
    relevance = {}
    for w, (clean, bad) in held.items():
        k = clean + bad
        if k >= toxicity.LEAST_DOCS:
            below = k * (n - k) * pos * (n - pos)
            chi2 = n * (bad * (n - pos - clean) - clean * (pos - bad)) ** 2 / below if below else 0
            relevance[w] = min(1, max(chi2, 1e-6) / toxicity.CHI2) ** toxicity.SHARPNESS
    df = {w: 0 for w in relevance}
    for d in words:
        for w in set(words[d]) & df.keys():
            df[w] += 1
    place = {w: i for i, w in enumerate(relevance)}

    def vector(d):
        x = np.zeros(len(place))
        for w in set(words[d]) & place.keys():
            x[place[w]] = (1 + np.log(words[d].count(w))) * (np.log((1 + len(words)) / (1 + df[w])) + 1) * relevance[w]
        return x / np.linalg.norm(x) if x.any() else x

    X = np.stack([vector(d) for d in ids])

    def vote(x, but=None):
        s = X @ x
        if but is not None:
            s[but] = 0
        at = [i for i in np.lexsort((np.arange(n), -s))[: toxicity.K] if s[i] > 0]
        if not at:
            return None
        w = 1 / (np.sqrt(np.maximum(2 - 2 * s[at], 0)) + 0.05) ** 2
        one, zero = w[y[at] == 1].sum(), w[y[at] == 0].sum()
        one, zero = one * 2, zero * 2  # every labelled row is an example: a label weighs the same
        return np.log((one + 0.01 * (one + zero)) / (zero + 0.01 * (one + zero)))

    own = [(vote(X[i], i), y[i]) for i in range(n)]
    known = [(v, t) for v, t in own if v is not None]
    a, b = toxicity.logistic_curve(np.array([v for v, _ in known]), np.array([t for _, t in known]), np.ones(len(known)))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    checked = 0
    for d in list(texts)[::7]:
        v = vote(vector(d))
        if v is not None:
            assert abs(got[d] - 1 / (1 + np.exp(-(a * v + b)))) < 1e-3, d
            checked += 1
    assert checked > 50


def test_toxicity_on_held_out_rows(spark):
    sf = f"{DATA}/sf0.1"
    got = QUERIES["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("predicted", "toxic", "score").toPandas()
    hits = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hits / (got.predicted == 1).sum() > 0.75 and hits / (got.toxic == 1).sum() > 0.8
    assert got.score.between(0, 1).all()


def test_toxicity_of_odd_input(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (5, 0, 0), (None, 1, 1), (6, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(odd_docs, labels).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert toxicity.score_toxicity(no_docs, labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(odd_docs, labels.where("false")).collect()} == {0.0}


# ---------------------------------------------------------------- 5 chat


def test_chat_of_long_conversations_without_turns(spark, monkeypatch):
    """Null, equal and repeated turns in one long conversation: runs go by place, none holds more than RUN messages of a perspective."""
    monkeypatch.setattr(chat, "RUN", 16)
    monkeypatch.setattr(chat, "PART_ROWS", 50)
    rows = [(1, None if k % 3 else 7, "ab"[k % 2], f"t{k % 90:03}") for k in range(300)] + [(None, 1, "x", "same")] * 40 + [(2, t, "system", "s") for t in range(3)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    order = sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
    for who in "ab":
        own = sorted((r for r in got if r["conv_id"] == 1 and r["perspective"] == who), key=lambda r: r["message"])
        assert [r["message"] for r in own] == list(range(300))
        assert [(r["speaker"], r["turn"]) for r in own] == [(r[2], r[1]) for r in order]
        assert [r["start"] for r in own] == [0, *np.cumsum([len(r["segment"]) for r in own])[:-1]]
    assert sorted(r["message"] for r in got if r["conv_id"] is None) == list(range(40)) and not any(r["conv_id"] == 2 for r in got)


def test_chat_masks_and_assembly(spark):
    m = [("c", 0, "system", "be kind"), ("c", 1, "ann", "hi <|end|>"), ("c", 2, "bob", None), ("c", None, None, "late"), (None, 0, "ann", "x"), ("s", 0, "system", "alone"), ("c", 1, "ann", "hi <|end|>")]
    msgs = spark.createDataFrame(m, "conv_id string, turn long, role string, text string").withColumn("start", F.lit("clash"))
    seg = chat.rotate(msgs)
    assert {(r["conv_id"], r["perspective"]) for r in seg.collect()} == {("c", "ann"), ("c", "bob"), ("c", "unknown"), (None, "ann")}
    text = {(r["conv_id"], r["perspective"]): r for r in chat.assemble(seg).collect()}
    ann = text["c", "ann"]
    assert ann["text"].count("<|assistant|>") == 2 and "<|user:bob|>" in ann["text"] and ann["text"].count("< |end|>") == 2
    assert [ann["text"][s["start"] : s["end"]] for s in ann["train_spans"]] == ["hi < |end|><|end|>\n"] * 2
    for r in seg.where("conv_id = 'c' and perspective = 'bob'").collect():
        assert text["c", "bob"]["text"][r["start"] : r["start"] + len(r["segment"])] == r["segment"]
    assert chat.rotate(msgs.where("false")).count() == 0
    long = "word " * 200_000
    [one] = chat.rotate(spark.createDataFrame([("c", 0, "ann", long)], "conv_id string, turn long, role string, text string")).collect()
    assert one["segment"].startswith("<|assistant|>\n" + long) and one["train_end"] == len(one["segment"])


# ---------------------------------------------------------------- 6 mixing


def test_targets():
    got = mixing.targets([("b", 100), (None, 10), ("a", 1000)])
    assert [s for s, _, _ in got] == ["a", "b", None]
    assert got[1][2] == 200 and got[2][2] == 20 and abs(sum(t for *_, t in got) - 1665) < 1e-9
    assert mixing.targets([]) == [] and mixing.targets([("a", 0)])[0][2] == 0


def test_permutation_and_shard_counts():
    for n in (1, 2, 3, 100, 1023):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    totals = np.array([5000, 0, 12345, 77])
    shards = -(-int(totals.sum()) // 256)
    before = np.zeros(4, np.int64)
    for s in range(shards):
        first, counts = mixing.shard_counts(totals, s, 256)
        assert (first == before).all() and counts.sum() == (256 if s < shards - 1 else totals.sum() - 256 * s)
        before = before + counts
    assert (before == totals).all()


def test_mix_counts_against_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a, b = QUERIES["op6_source_mixing"](spark, SMALL), QUERIES["op6_source_mixing"](spark, SMALL)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    got = {r["doc_id"]: r for r in a.collect()}
    texts: dict[int, list] = {}
    for d, t in rows(mixing.mix_texts(docs), "doc_id", "text"):
        texts.setdefault(d, []).append(WORD.findall(t))
    sources: dict = {}
    for r in docs.collect():
        words, g = WORD.findall(r["text"]), got[r["doc_id"]]
        assert g["size"] == len(words) and g["taken"] <= 2 * g["size"] and g["taken"] == sum(map(len, texts.get(r["doc_id"], [])))
        assert all(set(t) <= set(words) for t in texts.get(r["doc_id"], []))
        s = sources.setdefault(r["source"], [0, g["target"]])
        s[0] += g["taken"]
    assert all(abs(n - t) <= 2 * mixing.BLOCK_WORDS for n, t in sources.values())


def test_draws_of_any_size():
    """Shares of halves are drawn, not averaged, beyond what fits a hypergeometric draw; they keep the totals and the spread."""
    for counts in ([10**13, 3 * 10**12, 5], [7, 0, 2], [1], [400, 1, 1]):
        counts = np.array(counts)
        take = int(counts.sum()) // 2
        drawn = np.array([mixing._half(counts, take, (0, k)) for k in range(400)])
        assert (drawn.sum(1) == take).all() and (drawn >= 0).all() and (drawn <= counts).all()
    drawn = np.array([mixing._half(np.array([10**13, 4 * 10**12]), 7 * 10**12, (1, k))[1] for k in range(400)])
    assert 0.8 < drawn.std() / np.sqrt(10**12) < 1.2 and len(set(drawn.tolist())) == 400


def test_mix_against_brute_force(spark):
    """Slots, blocks and words, drawn and laid out in plain Python from the same seeds."""
    rng = np.random.default_rng(2)
    docs = [(int(i), " ".join(f"s{s}d{i}w{k}" for k in range(int(rng.integers(0, 90)))), [None, "a", "b", "c"][s]) for i in range(120) for s in [int(rng.integers(0, 4))]]
    docs += [(500, "tiny source", "t"), (501, "x " * 30, "u")]
    size = {i: len(t.split()) for i, t, _ in docs}
    words = {s: [w for i, t, q in sorted(docs) if q == s for w in [(i, k) for k in range(size[i])]] for s in {q for *_, q in docs}}
    plan = mixing.targets([(s, len(w)) for s, w in words.items()])
    block = 16
    drawn = mixing.slots(spark, plan, block, 32).collect()
    taken = dict.fromkeys(size, 0)
    total = dict.fromkeys(words, 0)
    for r in drawn:
        s = plan[r["source_no"]][0]
        for i, _ in words[s][r["block"] * block :][: min(block, r["most"])]:
            taken[i] += 1
            total[s] += 1
    assert sorted((r["shard"], r["position"]) for r in drawn) == [(k // 32, k % 32) for k in range(len(drawn))]
    for s, n, t in plan:
        assert abs(total[s] - t) < block and (len([r for r in drawn if plan[r["source_no"]][0] == s]) > 0) == (t > 0.5)
        if n % block == 0 or n < block:
            assert abs(total[s] - t) <= 0.5
    got = {r["doc_id"]: r for r in mixing.mix_counts(spark.createDataFrame(docs, "doc_id long, text string, source string"), block).collect()}
    assert {i: r["taken"] for i, r in got.items()} == taken
    assert all(taken[i] <= 2 * size[i] for i in size)


def test_mix_of_odd_input(odd_docs, no_docs):
    docs = odd_docs.withColumns({c: F.lit("clash") for c in ("start", "range", "tie", "spans", "own_text", "round", "row", "words", "part", "ahead")})
    got = mixing.mix_counts(odd_docs).collect()
    assert len(got) == 9 and sum(r["size"] for r in got) == sum(len(WORD.findall(r["text"] or "")) for r in docs.collect())
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix_counts(no_docs).count() == 0
    assert mixing.mix_texts(docs).columns == docs.columns and mixing.mix_texts(docs.where("false")).count() == 0


# ---------------------------------------------------------------- 7 archives


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc_round_trip(spark, version):
    long = "<html>" + "é" * 200
    page = [(1, "http://a/ b\x01", long), (2, "http://b", long), (3, None, None), (None, "http://c", long), (4, "http://d", "short"), (5, "http://e", "short"), (6, "", "\r\n\r\nWARC/1.0\r\n\r\n" * 30), (6, "", "\r\n\r\nWARC/1.0\r\n\r\n" * 30)]
    pages = spark.createDataFrame(page, "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    warc.write_arc(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")), arc, 2, version)
    assert sorted(rows(warc.read_arc(spark, arc), "page_id", "payload_bytes"), key=repr) == sorted([(p, len((h or "").encode())) for p, _, h in page], key=repr)
    warc.convert(spark, arc, out, 3)
    got = warc.read_warc(spark, out).collect()
    assert {bytes(r["payload"]).decode() for r in got if r["type"] == "response"} == {long, "", "short", page[6][2]}
    ids = {r["page_id"]: r["record_id"] for r in got if r["type"] == "response" and r["page_id"] is not None}
    assert all(r["refers_to_id"] == ids[1] for r in got if r["type"] == "revisit")
    assert len({r["record_id"] for r in got}) == len(got)  # of repeated page ids too
    assert {r["url"] for r in got} == {"http://a/%20b%01", "http://b", "urn:unknown", "http://c", "http://d", "http://e"}
    result = sorted(rows(warc.archive_pages(pages), "page_id", "payload_bytes", "record_type", "refers_to"), key=repr)
    n = len(long.encode())
    assert result == sorted([(1, n, "response", None), (2, n, "revisit", 1), (3, 0, "response", None), (None, n, "revisit", 1), (4, 5, "response", None), (5, 5, "response", None), *[(6, len(page[6][2]), "response", None)] * 2], key=repr)


def test_arc_parser_by_declared_length():
    body = b"HTTP/1.1 200 OK\r\n\r\nhttp://x 1 2 text/html 5\n12345"
    data = b"filedesc://f.arc 0.0.0.0 20010101000000 text/plain 70\n" + b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n".ljust(70, b"\n")
    data += b"\nhttp://a 1.2.3.4 20010101000000 text/html %d\n" % len(body) + body + b"\n"
    [(fields, got)] = list(warc.parse_arc(data))
    assert fields["URL"] == "http://a" and got == body
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-10]))
    assert gzip.decompress(gzip.compress(data)) == data


def test_archives_of_pages_of_all_sizes(spark, monkeypatch):
    """Large pages in a row make more files, not large ones."""
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    page = [(i, f"http://x/{i}", "y" * n) for i, n in enumerate([90] * 300 + [50_000] * 12 + [400_000] * 2)]
    sizes = []
    write = warc.write_arc
    monkeypatch.setattr(warc, "write_arc", lambda p, path, per, version=2: (write(p, path, per, version), sizes.extend(len(gzip.decompress(bytes(r["content"]))) for r in warc._files(spark, path).collect())))
    got = rows(warc.archive_pages(spark.createDataFrame(page, "page_id long, url string, html string").coalesce(1)), "page_id", "payload_bytes", "record_type", "refers_to")
    assert sorted(got) == sorted((i, len(h), "response" if len(h) < 100 or i in (300, 312) else "revisit", None if len(h) < 100 or i in (300, 312) else 300 if len(h) < 100_000 else 312) for i, _, h in page)
    assert max(sizes) < 402_000 and sorted(sizes)[-3] < 202_000


def test_archives_of_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---------------------------------------------------------------- 8 language


def test_languages_on_held_out_rows(spark):
    sf = f"{DATA}/sf0.01"
    got = QUERIES["op8_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_languages_against_brute_force(spark):
    """Features, TF-IDF, the leader's steps and the softmax in plain Python, on the same sample."""
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs.select("text"), docs)
    texts = [r["text"] or "" for r in docs.collect()]

    def counts(text):
        low = [ch.lower() if ch.isalpha() and len(ch.lower()) == 1 else " " for ch in text]
        out = {}
        for k in langid.ORDERS:
            for i in range(len(low) - k + 1):
                if any(c != " " for c in low[i : i + k]):
                    h = 0
                    for c in low[i : i + k]:
                        h = ((h ^ ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
                        h ^= h >> 15
                    b = ((h * (0x85EBCA6B + 2 * (k - 1))) & 0xFFFFFFFF) >> (32 - langid.BITS)
                    out[b] = out.get(b, 0) + 1
        return out

    some = [counts(t) for t in texts]
    df = np.zeros(langid.BUCKETS)
    for c in some:
        df[list(c)] += 1
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    assert np.allclose(idf, model.idf)
    got = [r["score"] for r in langid.identify(docs.select("text"), model).collect()]
    for c, s in list(zip(some, got))[::5]:
        if c:
            at = np.array(sorted(c))
            x = np.array([(1 + np.log(c[b])) * idf[b] for b in at])
            z = (x / np.linalg.norm(x)) @ model.weights[at] + model.bias
            p = np.exp((z - z.max()) / model.temperature)
            assert abs(p.max() / p.sum() - s) < 1e-4
    # one step of the leader by its definition
    at, x = np.array([3, 5]), np.array([0.6, 0.8])
    w, bias = langid.follow_the_leader([(at, x)], np.array([0]), 2, epochs=1)
    for j, v in [(3, 0.6), (5, 0.8)]:
        g = v * np.array([-0.5, 0.5])
        want = -(g - np.sign(g) * langid.L1) / ((langid.BETA + np.abs(g)) / langid.ALPHA + langid.L2)
        assert np.allclose(w[j], want)
    assert np.allclose(bias, [0.5 / ((langid.BETA + 0.5) / langid.ALPHA + langid.L2), -0.5 / ((langid.BETA + 0.5) / langid.ALPHA + langid.L2)])


def test_sample_of_least_hashes(spark):
    from flicker.llm.common import least_hashed

    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") == 1, "one").otherwise("hot").alias("lang"))
    got = least_hashed(docs, "lang", 40)
    want = {(r["doc_id"], r["lang"]) for k in ("rare", "one", "hot") for r in docs.where(F.col("lang") == k).orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 11)).limit(40).collect()}
    assert {(r["doc_id"], r["lang"]) for r in got.collect()} == want and len(want) == 81


def test_filters_keep_clashing_columns(spark, odd_docs):
    docs = odd_docs.withColumns({c: F.lit("clash") for c in ("score", "Lang_Pred", "toxicity", "evidence")})
    labels = spark.createDataFrame([(1, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    kept = langid.keep_identified(docs, langid.train(docs.select("text"), docs))
    assert kept.columns == docs.columns and {2, 3, 4}.isdisjoint(r["doc_id"] for r in kept.collect())
    kept = toxicity.keep_clean(docs, toxicity.train(docs.select("doc_id", "text"), labels))
    assert kept.columns == docs.columns and kept.exceptAll(docs).isEmpty()


def test_languages_of_odd_input(odd_docs, no_docs):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict_languages(odd_docs).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= got and all(p in ("en", "de", "fr", "und") for _, p in got)
    assert langid.predict_languages(no_docs).count() == 0
    assert {r["lang_pred"] for r in langid.predict_languages(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_temperature_and_penalty():
    z = np.array([[5.0, 0], [5, 0], [0, 5], [5, 0]])
    assert langid.fit_temperature(z, np.array([0, 0, 1, 1])) > langid.fit_temperature(z, np.array([0, 0, 1, 0]))
    w, _ = langid.follow_the_leader([(np.array([1, 2]), np.array([0.7, 0.7])), (np.array([2, 3]), np.array([0.7, 0.7]))] * 20, np.array([0, 1] * 20), 2)
    assert w[1, 0] > 0 > w[1, 1] and w[3, 1] > 0 and not w[4:].any()


# ---------------------------------------------------------------- 9 neighbours


def brute_nearest(ids, x, k=10):
    out = {}
    for i, v in zip(ids, x):
        if i % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(1))
            out[i] = [ids[j] for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def test_neighbours_recall(spark):
    got = QUERIES["op9_collision_counting_neighbours"](spark, SMALL).toPandas()
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    ids, x = e.vec_id.to_numpy(), np.stack(e.embedding).astype(float)
    want = brute_nearest(ids, x)
    hit = sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hit >= 0.95 * sum(map(len, want.values()))
    assert all(g.sort_values("rank")["rank"].tolist() == list(range(1, len(g) + 1)) and g.sort_values("rank").score.is_monotonic_increasing for _, g in got.groupby("query_id"))


def test_neighbours_recall_over_blocks(spark, monkeypatch):
    """All queries of a table of many blocks; the bound of the first block makes the others' work no larger."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 400)
    df = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").limit(4000)
    e = df.toPandas()
    want = brute_nearest(e.vec_id.to_numpy(), np.stack(e.embedding).astype(float))
    got = neighbours.nearest(df).toPandas()
    assert set(got.query_id) == set(want) and (got.groupby("query_id").size() == 10).all()
    assert sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id")) >= 0.9 * sum(map(len, want.values()))


def test_a_bound_ends_the_search_early():
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(0, 0.05, (500, 16)) + 5, rng.normal(0, 1, (3000, 16))))
    index = neighbours.CollisionIndex(np.arange(len(x)) + 1, x)
    q, own = rng.normal(0, 0.05, (20, 16)) - 5, np.zeros(20)
    index.search(q, own, 10)
    free, index.visited = index.visited, 0
    assert all(not len(ids) for ids, _ in index.search(q, own, 10, np.full(20, 0.5))) and index.visited < free / 4


def test_neighbours_of_very_large_and_small_vectors(spark):
    for size in (1e200, 1e-200, 1e308):
        v = [(0, [size, 0.0]), (1, [size / 2, 0.0]), (2, [-size, size / 4]), (3, [size / 2, size / 8])]
        got = rows(neighbours.nearest(spark.createDataFrame(v, "vec_id long, embedding array<double>")), "rank", "vec_id", "score")
        assert [r[:2] for r in sorted(got)] == [(1, 1), (2, 3), (3, 2)] and sorted(got)[0][2] == size / 2


def test_neighbours_of_repeated_ids(spark):
    v = [(0, [1.0, 0.0]), (0, [5.0, 0.0]), (7, [1.0, 1.0]), (7, [1.0, 3.0]), (8, [1.0, 2.0])]
    got = sorted(rows(neighbours.nearest(spark.createDataFrame(v, "vec_id long, embedding array<double>")), "query_id", "rank", "vec_id", "score"))
    assert got == [(0, 1, 7, 1.0), (0, 2, 8, 2.0), (0, 3, 7, 3.0)]


def test_neighbours_of_odd_input(spark):
    nan = float("nan")
    v = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, [1.0]), (8, [0.0, 1.0]), (None, [1.0, 1.0]), (100, [2.0, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted(rows(neighbours.nearest(df), "query_id", "rank", "vec_id", "score"))
    assert [r[:3] for r in got if r[0] == 0] == [(0, 1, 1), (0, 2, 100), (0, 3, 8)]
    assert [r[2] for r in got if r[0] == 100][-1] == 8 and neighbours.nearest(df.where("false")).count() == 0


def test_neighbours_beside_huge_vectors(spark):
    """A few huge vectors leave the search of the others as it is, and find their own neighbours."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((600, 12)) * 0.01
    x[[3, 100, 450]] *= 1e17
    x[7], x[8] = 1e307, -1e307
    index = neighbours.CollisionIndex(np.arange(600), x, 0.01)
    index.search(x[200:240], np.arange(200, 240), 10)
    plain = neighbours.CollisionIndex(np.arange(600), np.delete(x, [3, 7, 8, 100, 450], 0)[np.arange(600) % 595], 0.01)
    plain.search(x[200:240], np.arange(200, 240), 10)
    assert index.visited < 1.3 * plain.visited
    got = {}
    for r in neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), query_every=50).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, 600, 50):
        d = neighbours.distances(x, x[q])
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(600), d))[:10].tolist()) & set(got[q]))
    assert hits >= 0.9 * 120


# ---------------------------------------------------------------- 10 sharding


def test_jump_moves_only_to_the_new_shard():
    keys = np.arange(20000)
    for n in (1, 5, 16):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert ((a == b) | (b == n)).all() and abs((a != b).mean() - 1 / (n + 1)) < 0.02 and (a < n).all()


def test_sharding(spark, odd_docs, no_docs):
    for got in (QUERIES["op10_jump_hash_sharding"](spark, SMALL).toPandas(), sharding.shard_by_key(odd_docs).toPandas()):
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        assert ((got.shard == got.grown_shard) | (got.grown_shard == 16)).all() and (got.law == "key").all()
        assert (got.groupby("doc_id").shard.nunique() == 1).all()
    size = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.shard_by_key(odd_docs).collect()}
    assert size[2] == (1, 0) and size[7] == (len("één".encode()) + 1, zlib.crc32("één".encode()))
    assert sharding.shard_by_key(no_docs).count() == 0
