"""The trie of conversations' prefixes: what dialogues share from their beginnings on, and what sharing it saves.

A node is a distinct sequence of first turns (role, text); its members are the conversations that begin with it. The tree
is built as a Patricia tree: turns are sorted, prefixes that neighbours in that order share are put together, and every
stretch of nodes with the same members becomes one compressed edge that ends in a point, where conversations part, end or
the path stops. All nodes of an edge have the same smallest member and the same number of members, and no two edges have
both in common, so (conv_id, n_convs) names an edge. Sums over subtrees are made on the edges, of which there are at most
two for each conversation, by doubling the distance of the ancestor that an edge's sum is sent to: as many rounds as the
logarithm of the tree's height in points. Unary nodes are then read off their edge by sums over its nodes from the lower
end on.

At scale: nothing holds a whole conversation. Turns are placed by a sort over range partitions, a prefix's key (two 64-bit
sums, modulo 2, of hashes of place and turn, with hash keys drawn for the job) is summed within stretches of 256 turns and
over the stretches, members of a prefix meet only as counts and least ids after a map-side combine, and edges' suffix sums
are made in the same stretches. Digests of the conversations that end at a node are made by streaming pieces of 4,096
sorted ids through the task that has the node, since the hash is one of the whole string.

Defined results: null role or text is empty, null turns come first, ties in turn are ordered by role, then text. Repeated
rows are turns of their own. Rows without a conversation id belong to none and are left out. An empty table has no nodes,
not even the root. Columns besides conv_id, turn, role and text aren't looked at.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, sorted_rows

#: Turns of a stretch, as a power of two; sorted ids of a piece; turns of a range partition.
STRETCH_BITS, PIECE_BITS, PART_ROWS = 8, 12, 1 << 17
#: Conversations of a family share the beginning of the one whose id is a multiple of FAMILY; of up to MOST - 1 turns.
FAMILY, MOST = 100, 6

UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)


def placed(conversations: DataFrame) -> DataFrame:
    """conv_id, i (place from 1), n (turns of the conversation), hi and lo (120 bits of a hash of role and text), chars."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    part = lambda k: F.conv(F.substring("digest", k, 15), 16, 10).cast("long")
    slim = lambda df: df.withColumn("digest", digest).select("conv_id", part(1).alias("hi"), part(16).alias("lo"), F.char_length("text").cast("long").alias("chars"), "part", "at")
    held = sorted_rows(rows, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), rows=rows.count(), per=PART_ROWS, name="turns", then=slim)
    counts = held.groupBy("conv_id", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first_at"))
    own = Window.partitionBy("conv_id")  # one row for each partition that has some of it
    starts = counts.select("conv_id", "part", (F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(*BEFORE)), F.lit(0)) - F.col("first_at") + 1).alias("start"), F.sum("rows").over(own).alias("n"))
    out = materialize(held.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("start")).alias("i"), "n", "hi", "lo", "chars"), "placed")
    discard(held)
    return out


def shared_start(conv_id: str) -> Column:
    return F.crc32(F.col(conv_id).cast("string").cast("binary")) % MOST


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, d, hi, lo, chars, len) and conversations (conv_id, len), each with the beginning of its family's first one."""
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("i") < MOST)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("i", "hi", "lo", "chars"))).alias("head"))  # at most MOST - 1 turns
    convs = turns.where("i = 1").select("conv_id", "n", shared_start("conv_id").alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    convs = convs.join(heads, "base", "left")
    head = F.when(F.col("head").isNotNull() & (F.col("h") > 0), F.slice("head", 1, F.greatest(F.col("h"), F.lit(1)).cast("int")))
    convs = convs.withColumn("head", head).withColumn("m", F.coalesce(F.size("head"), F.lit(0)).cast("long"))
    convs = convs.withColumn("m", F.when(F.col("head").isNull(), F.lit(0)).otherwise(F.col("m")))
    convs = materialize(convs.withColumn("len", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "h", "m", "len", "head"), "conversations")
    first = convs.select("conv_id", "len", F.explode("head").alias("t")).select("conv_id", F.col("t.i").alias("d"), "t.hi", "t.lo", "t.chars", "len")
    rest = turns.where(F.col("i") > shared_start("conv_id")).join(convs.select("conv_id", "h", "m", "len"), "conv_id")
    rest = rest.select("conv_id", (F.col("m") + F.col("i") - F.col("h")).alias("d"), "hi", "lo", "chars", "len")
    return first.unionByName(rest), convs


def prefix_keys(rows: DataFrame) -> DataFrame:
    """rows (conv_id, d, hi, lo, chars, len) with the keys p1, p2 of their prefix and q1, q2 of the one before."""
    keys = [secrets.randbits(63), secrets.randbits(63)]
    stretch = F.shiftright("d", STRETCH_BITS)
    own = rows.select("conv_id", "d", "chars", "len", stretch.alias("stretch"), *[F.xxhash64(F.lit(k), "d", "hi", "lo").alias(f"t{j}") for j, k in enumerate(keys, 1)])
    whole = own.groupBy("conv_id", "stretch").agg(*[F.bit_xor(f"t{j}").alias(f"s{j}") for j in (1, 2)])
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(*BEFORE)  # one row for each stretch
    whole = whole.select("conv_id", "stretch", *[F.coalesce(F.bit_xor(f"s{j}").over(before), F.lit(0)).alias(f"b{j}") for j in (1, 2)])
    inside = Window.partitionBy("conv_id", "stretch").orderBy("d").rowsBetween(*UP_TO_HERE)
    own = own.withColumns({f"u{j}": F.bit_xor(f"t{j}").over(inside) for j in (1, 2)}).join(whole, ["conv_id", "stretch"])
    p = {j: F.col(f"u{j}").bitwiseXOR(F.col(f"b{j}")) for j in (1, 2)}
    return own.select("conv_id", "d", "chars", "len", *[p[j].alias(f"p{j}") for j in p], *[p[j].bitwiseXOR(F.col(f"t{j}")).alias(f"q{j}") for j in p])


def end_digests(ends: DataFrame, rows: int) -> DataFrame:
    """d, p1, p2, ends_sha256: of the decimal ids of the conversations (ends: d, p1, p2, conv_id) that end there, ascending and joined by commas."""
    node = ["d", "p1", "p2"]
    held = sorted_rows(ends, *[F.col(c) for c in node], F.col("conv_id"), rows=rows, per=PART_ROWS, name="ends")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = held.groupBy(*node, "part", F.shiftright("at", PIECE_BITS).alias("piece")).agg(text.alias("text"))
    dealt = pieces.repartition(*node).sortWithinPartitions(*node, "part", "piece").select(*node, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            out = []
            for key, text in zip(zip(*(b.column(k).to_pylist() for k in range(3))), b.column(3).to_pylist()):
                if key != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds())], names)
        if now is not None:
            yield pa.record_batch([pa.array([x], k) for x, k in zip((*now, state.hexdigest()), kinds())], names)

    names = [*node, "ends_sha256"]
    kinds = lambda: (pa.int64(), pa.int64(), pa.int64(), pa.string())
    small_batches(ends.sparkSession)
    return dealt.mapInArrow(run, "d long, p1 long, p2 long, ends_sha256 string")


def subtree_sums(edges: DataFrame, sums: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """edges (conv_id, n_convs, up_conv, up_n: the edge above, null at the top) with sums over all edges of their subtrees, and tables to delete.

    After k rounds an edge has the sum over descendants nearer than 2 ** k, and knows its ancestor at that distance.
    """
    key, up = ["conv_id", "n_convs"], ["up_conv", "up_n"]
    at, tables = edges.select(*key, *up, *sums), []
    while not at.where("up_conv is not null").isEmpty():
        below = at.where("up_conv is not null").groupBy(*up).agg(*[F.sum(s).alias(f"more_{s}") for s in sums])
        below = below.select(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs"), *[f"more_{s}" for s in sums])
        above = at.where("up_conv is not null").select(F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n"), F.col("up_conv").alias("far_conv"), F.col("up_n").alias("far_n"))
        new = at.join(below, key, "left").join(above, up, "left")
        at = materialize(new.select(*key, F.col("far_conv").alias("up_conv"), F.col("far_n").alias("up_n"), *[(F.col(s) + F.coalesce(f"more_{s}", F.lit(0))).alias(s) for s in sums]), "sums")
        tables.append(at)
    return at.select(*key, *sums), tables


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    small_batches(conversations.sparkSession)
    turns = placed(conversations)
    rows, convs = rebuild(turns)
    rows = materialize(prefix_keys(rows), "prefixes")
    node = ["d", "p1", "p2"]
    zero = F.lit(0).cast("long")
    own = rows.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("q1").alias("q1"), F.max("q2").alias("q2"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in node], "conv_id", "n_convs", zero.alias("chars"), *[F.lit(None).cast("long").alias(c) for c in ("q1", "q2")])
    own = own.unionByName(root)
    children = own.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = materialize(own.join(children, node, "left").withColumns({"n_children": F.coalesce("n_children", zero), "saves": (F.col("n_convs") - 1) * F.col("chars"), "stretch": F.shiftright("d", STRETCH_BITS)}), "trie-nodes")

    # compressed edges: their ends, and the point above
    key = ["conv_id", "n_convs"]
    low, top = F.max(F.struct(*node, "n_children")), F.min(F.struct("d", "q1", "q2"))
    edges = nodes.groupBy(*key).agg(low.alias("low"), top.alias("top"), F.sum("saves").alias("saved"))
    edges = materialize(edges.select(*key, "low", "top", "saved", (F.col("low.n_children") == 0).cast("long").alias("leaves")), "edges")
    points = edges.select(F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n"), *[F.col(f"low.{c}").alias(f"at_{c}") for c in node])
    on = (F.col("top.d") - 1 == F.col("at_d")) & (F.col("top.q1") == F.col("at_p1")) & (F.col("top.q2") == F.col("at_p2"))
    edges_up = materialize(edges.join(points, on, "left").select(*key, F.col("top.d").alias("top_d"), "up_conv", "up_n", "saved", "leaves"), "edges-up")
    sums, tables = subtree_sums(edges_up, ["saved", "leaves"])

    # expand: sums over an edge's nodes from the lower end on, within stretches and over the later stretches
    stretch = [*key, "stretch"]
    later = nodes.groupBy(*stretch).agg(F.sum("saves").alias("saves"))
    after = Window.partitionBy(*key).orderBy(F.col("stretch").desc()).rowsBetween(*BEFORE)  # one row for each stretch of an edge
    later = later.select(*stretch, F.coalesce(F.sum("saves").over(after), zero).alias("later"))
    under = edges_up.select(*key, "top_d", "up_conv", F.col("saved").alias("own")).join(sums, key)
    under = under.select(*key, "top_d", "up_conv", (F.col("saved") - F.col("own")).alias("under"), "leaves")
    later = later.join(under, key)
    here = Window.partitionBy(*stretch).orderBy(F.col("d").desc()).rowsBetween(*UP_TO_HERE)
    out = nodes.withColumn("rest", F.sum("saves").over(here)).join(later, stretch)
    ends = rows.where("d = len").select(*node, "conv_id").unionByName(convs.where("len = 0").select(*[zero.alias(c) for c in node], "conv_id"))
    digests = end_digests(ends, convs.count())
    out = out.join(digests, node, "left")
    out = out.select(
        "conv_id", F.col("d").alias("depth"),
        F.when(F.col("d") == 0, None).when(F.col("d") > F.col("top_d"), F.col("conv_id")).otherwise(F.col("up_conv")).alias("parent_conv_id"),
        "n_convs", "n_children", F.col("leaves").alias("n_leaves"), (F.col("rest") + F.col("later") + F.col("under")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    out = materialize(out, "trie")
    discard(turns, convs, rows, nodes, edges, edges_up, *tables)
    return out
