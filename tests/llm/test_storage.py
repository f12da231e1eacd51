"""Binary records, Merkle manifests and the prefix trie: brute force, round trips, damage, odd input."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flicker.llm import merkle, records, trie
from flicker.llm.common import materialize, scratch_path
from flicker.llm.queries import QUERIES, tokenizer_path
from tests.conftest import DATA

SMALL = f"{DATA}/sf0.001"


# ---------------------------------------------------------------- 11 binary records


def crc32c(data: bytes) -> int:
    table = []
    for b in range(256):
        for _ in range(8):
            b = (b >> 1) ^ (0x82F63B78 if b & 1 else 0)
        table.append(b)
    r = 0xFFFFFFFF
    for x in data:
        r = table[(r ^ x) & 0xFF] ^ (r >> 8)
    return r ^ 0xFFFFFFFF


def test_checksums():
    assert crc32c(b"123456789") == 0xE3069283
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 2, 3, 4, 5, 8, 255, 256, 257, 1000, 0, 65536, 65537, 70001, 2)]
    data, sizes = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
    assert records.Crc32c()(data, np.cumsum(sizes) - sizes, sizes).tolist() == [crc32c(p) for p in parts]


def test_long_strings_go_through_all_levels(monkeypatch):
    monkeypatch.setattr(records.Crc32c, "BLOCK", 4)  # levels of 4, 1,024 and 262,144 bytes
    data = np.random.default_rng(6).integers(0, 256, 600_001, dtype=np.uint8)
    assert records.Crc32c()(data, np.array([0, 7]), np.array([600_001, 5])).tolist() == [crc32c(data.tobytes()), crc32c(data[7:12].tobytes())]


def test_frames_by_hand():
    mask = lambda c: (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    n = (5).to_bytes(8, "little")
    want = n + mask(crc32c(n)).to_bytes(4, "little") + b"hello" + mask(crc32c(b"hello")).to_bytes(4, "little")
    assert records.frame([b"hello"]) == want
    starts, sizes = records.frames(want + records.SYNC + want)
    assert (starts.tolist(), sizes.tolist()) == ([12, 33, 49], [5, 0, 5])


@pytest.mark.parametrize("wide", [False, True])
def test_ids_round_trip(wide):
    ids = np.array([0, 1, 65535], np.uint32)
    for doc_id in (None, 0, -5, 2**63 - 1):
        data = records.pack_ids(doc_id, ids, wide)
        got, back = records.unpack_ids(b"x" + data, 1, len(data))
        assert got == doc_id and back.tolist() == ids.tolist()


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def expected(docs, tok):
    """doc_id, start, n_tokens, ids_crc32, by the tokenizer itself; docs in ascending order."""
    out, start = [], 0
    for doc_id, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


def test_records_against_the_tokenizer(spark, tok):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, QUERIES["op11_binary_records"](spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == expected(sorted((r[0], r[1]) for r in docs), tok)


def test_odd_documents_in_many_files(spark, odd_docs, no_docs, tok):
    """Small chunks and ranges, so that places run on over chunks, files and tasks; a range of one repeated id is split."""
    path = scratch_path(spark, "records")
    repeated = spark.createDataFrame([(6, f"copy {k}") for k in range(40)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text", "fingerprint").unionByName(repeated, allowMissingColumns=True)
    records.write_records(docs, path, tokenizer_path(), 1, chunk_bytes=100, range_rows=5)
    index = records.read_index(spark, path)
    got = index.select("file", "nth", "start").join(records.read_records(spark, path), ["file", "nth"]).orderBy("start").collect()
    assert index.select("file").distinct().count() > 8
    ends = np.cumsum([r["n_tokens"] for r in got])
    assert [r["start"] for r in got] == [0, *ends[:-1]]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = sorted((r[2], r[3], r[0] is None, r[0] or 0) for r in expected([(r["doc_id"], r["text"]) for r in docs.collect()], tok))
    assert sorted((r["n_tokens"], r["ids_crc32"], r["doc_id"] is None, r["doc_id"] or 0) for r in got) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4")) == r["ids_crc32"] for r in got)
    assert records.encode_and_read(no_docs, tokenizer_path(), 1).collect() == []


def test_shuffled_reads_by_the_index(spark):
    path = scratch_path(spark, "records")
    records.write_records(spark.read.parquet(f"{SMALL}/documents.parquet"), path, tokenizer_path(), 1, chunk_bytes=5000, range_rows=20)
    index = records.read_index(spark, path)
    orders = [[r["doc_id"] for r in records.epoch(index, key, 3).where("rank = 1").orderBy("turn").collect()] for key in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2] and orders[0] != sorted(orders[0])
    assert sum(records.epoch(index, 1, 3).where(f"rank = {k}").count() for k in range(3)) == 200
    some = records.epoch(index, 1, 3).where("rank = 1")
    whole = {r["doc_id"]: r["ids"] for r in records.read_records(spark, path).collect()}
    got = records.fetch(spark, path, some).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(orders[0]) and all(whole[r["doc_id"]] == r["ids"] for r in got)


def test_damage_is_found():
    data = bytearray(records.frame([b"some data", b"more"]))
    starts, sizes = records.frames(bytes(data))
    records.check(bytes(data), starts, sizes)
    with pytest.raises(ValueError):
        records.frames(bytes(data[:-1]))
    for at in (0, 3, 9, 11):  # length and its checksum
        bad = data.copy()
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.frames(bytes(bad))
    for at in (12, 20, 22):  # data and their checksum
        bad = data.copy()
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.check(bytes(bad), starts, sizes)


# ---------------------------------------------------------------- 12 Merkle manifest


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(level):
    out = [level]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings_and_fold(steps, cur):
    siblings = ""
    for levels, j in steps:
        for level in levels[:-1]:
            a = j - j % 8
            left, right = "".join(level[a:j]), "".join(level[j + 1 : a + 8])
            siblings, cur, j = siblings + left + right, sha(left + cur + right), j // 8
    return sha(siblings), cur


def manifest(docs):
    """Rows of (doc_id, text, lang, source, n_chars) by the contract, with lists."""
    def value(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(d, text):
        return sha("".join(map(value, (d[0], d[3], d[2], d[4], text))))

    groups = defaultdict(list)
    for d in docs:
        own = leaf(d, d[1])
        low = d[1] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d[1])
        hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
        groups[d[2]].append((d[0], own, leaf(d, low) if hit else own))
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in keys:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {g: levels_of([r[1] for r in groups[g]]) for g in keys}
    top = levels_of([trees[g][-1][0] for g in keys]) if keys else []
    out = []
    for i, g in enumerate(keys):
        for j, (doc_id, own, changed) in enumerate(groups[g]):
            proof, folded = siblings_and_fold([(trees[g], j), (top, i)], changed)
            out.append((doc_id, own, trees[g][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_of_odd_documents(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", F.lit(3).cast("long").alias("n_chars"), F.lit("x").alias("leaf"), F.lit("y").alias("grp"))
    docs = docs.union(spark.range(100, 112).select("id", F.format_string("Some Text %d", "id"), F.lit("fr"), F.lit("A"), F.lit(None), F.lit("x"), F.lit("y")))
    got = sorted((tuple(r) for r in merkle.document_manifest(docs).select(*COLUMNS).collect()), key=repr)
    assert got == manifest([tuple(r)[:5] for r in docs.collect()])
    assert merkle.document_manifest(docs.where("false")).collect() == []
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.fixture(scope="module")
def many(spark):
    """Groups of sizes around the powers of 8, one of them far larger; 70 groups, so the upper tree has levels of its own."""
    rng = random.Random(3)
    sizes = {f"g{k:02d}": s for k, s in enumerate([1, 2, 7, 8, 9, 63, 64, 65, 511, 513, 4095, 4096, 4097, 9000, *[rng.randint(1, 5) for _ in range(56)]])}
    rows = [(g, k, sha(f"{g} {k}")) for g, n in sizes.items() for k in range(n)]
    rng.shuffle(rows)
    return sizes, materialize(spark.createDataFrame(rows, "grp string, k long, hash string").repartition(4), "many")


@pytest.mark.parametrize("part_rows", [100, 1 << 16])
def test_trees_of_any_size(spark, many, part_rows):
    sizes, rows = many
    tree = merkle.build(rows, [F.col("k")], rows.count(), part_rows)
    roots = {r["grp"]: (r["hash"], r["height"]) for r in tree.roots().collect()}
    nodes = defaultdict(dict)
    for r in tree.nodes.where("level > 0").collect():
        assert (r["level"], r["idx"]) not in nodes[r["grp"]]
        nodes[r["grp"]][r["level"], r["idx"]] = r["hash"]
    for g, n in sizes.items():
        levels = levels_of([sha(f"{g} {k}") for k in range(n)])
        assert roots[g] == (levels[-1][0], len(levels) - 1)
        assert nodes[g] == {(k, i): d for k, level in enumerate(levels) if k for i, d in enumerate(level)}
    top = merkle.build(tree.roots().select(F.lit("").alias("grp"), F.col("grp").alias("g"), "hash"), [F.col("g")], len(sizes))
    over = merkle.paths(top, 0).join(top.leaves.select("idx", "g"), "idx").select(F.col("g").alias("grp"), "path")
    trees = {g: levels_of([sha(f"{g} {k}") for k in range(n)]) for g, n in sizes.items()}
    above = levels_of([trees[g][-1][0] for g in sorted(trees)])
    place = {g: i for i, g in enumerate(sorted(trees))}
    got = merkle.prove(tree, over, ["k"]).collect()
    assert len(got) == sum(sizes.values())
    for r in random.Random(1).sample(got, 1500):
        assert (r["proof_sha256"], r["folded"]) == siblings_and_fold([(trees[r["grp"]], r["k"]), (above, place[r["grp"]])], r["hash"])


def test_ranges_begin_anywhere():
    """Stacks over any cut of the leaves, and their open nodes, hold every node that a stack over all of them makes."""
    leaves = [sha(str(k)) for k in range(700)]
    whole = {(k, i, d) for k, i, d, _ in merkle.Range.end(_fed(leaves, 0, 700))}
    for cuts in ([0, 700], [0, 5, 9, 64, 65, 513, 700], [0, 1, 2, 3, 700]):
        parts = [x for a, b in zip(cuts, cuts[1:]) for x in _fed(leaves, a, b).end()]
        assert {(k, i, d) for k, i, d, _ in parts} <= whole
        closed = {(k, i) for k, i, _, is_open in parts if not is_open}
        assert all((k + 1, i >> 3) in {(a, b) for a, b, _, _ in parts} for k, i in closed)


def _fed(leaves, a, b):
    r = merkle.Range()
    for i in range(a, b):
        r.add(i, leaves[i])
    return r


def test_differing_leaves(spark, many):
    sizes, rows = many
    other = rows.withColumn("hash", F.when((F.col("k") % 700 == 3) & (F.col("grp") > "g03"), F.sha2("hash", 256)).otherwise(F.col("hash")))
    a, b = (merkle.build(r, [F.col("k")], rows.count(), 500) for r in (rows, other))
    got = merkle.differing(a, b)
    want = {(g, k) for g, n in sizes.items() for k in range(3, n, 700) if g > "g03"}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert merkle.differing(a, a).collect() == []


# ---------------------------------------------------------------- 13 prefix trie


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    convs = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    members = defaultdict(list)
    for c, own in convs.items():
        k = zlib.crc32(str(c).encode()) % 6
        seq = convs.get(c - c % 100, [])[:k] + own[k:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append((c, len(seq)))
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    saved, leaves, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].decode()) if p else 0) + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        ends = ",".join(map(str, sorted(c for c, n in members[p] if n == len(p))))
        up = min(members[p[:-1]])[0] if p else None
        out.append((min(members[p])[0], len(p), up, len(members[p]), len(kids[p]), leaves[p], saved[p], sha(ends)))
    return sorted(out, key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def same_trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"d": F.lit("clash"), "chars": F.lit(1.5), "part": F.lit(None).cast("int")})
    assert sorted((tuple(r) for r in trie.prefix_trie(df).select(*TRIE).collect()), key=repr) == brute_trie(rows)


def test_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH_BITS", 2)  # stretches of 4 turns
    monkeypatch.setattr(trie, "PIECE_BITS", 1)  # pieces of 2 ids
    rows = [(1, 0, "user", "hi"), (1, None, None, None), (1, 0, "user", "hi"), (1, 0, "user", "a"), (None, 1, "user", "lost"), (2, 5, "user", "\U0001f600 été")]
    rows += [(200, t, "u", "long " * t) for t in range(30)] + [(200 + c, t, "u", "long " * t) for c in range(1, 9) for t in range(c * 3)]
    rows += [(500 + c, t, "same", "copy") for c in range(12) for t in range(9)]  # copies end at one node
    rows += [(700 + c, t, "x", str(min(c, t))) for c in range(40) for t in range(40)]  # each parts from the next one turn later
    rows += [(c, 0, "only", "turn") for c in (901, 902, 903, 904, 905)]  # shorter than what they would share, with no first one
    same_trie(spark, rows)


def test_random_conversations(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["a", "b", None]), rng.choice(["", "x", "xy"])) for c in [*range(60), *range(100, 140), *range(330, 350)] for t in range(rng.randint(1, 9))]
    same_trie(spark, rows)


def test_no_conversations(spark):
    same_trie(spark, [])
    same_trie(spark, [(None, 1, "a", "b")])
