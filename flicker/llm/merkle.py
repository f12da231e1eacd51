"""Merkle manifests of datasets: a tree of hashes of fan-out 8 for each group of rows, proofs for each row, comparison.

A group's leaves stand in the order of a key. While more than one node is left, every FANOUT consecutive ones become their
hash; a last run of fewer, even of one, is hashed as it is, without padding. What is left is the group's root; a lone leaf
is its own root. H is lowercase hex SHA-256 over the inputs one behind the other, digests as hex text.

Building: leaves are sorted over range partitions and get their place in their group. Each partition feeds its leaves, in
order, to a stack of runs, one for each level (a mountain range): a run that is full becomes a node of the level above,
which may fill the run there, as a carry does. What a partition can't complete stays open: runs that began before it,
and the peaks that are left at its end, at most 7 nodes a level on either side. Open nodes of neighbouring partitions are
merged level by level, by (group, run), which also closes each level's short last run. So a group of any size is spread
over tasks, and what partitions pass on grows with their number and the logarithm of their size.

Proving: subtrees of BLOCK leaves are proved by one task each, from their leaves, their nodes in the manifest and the
path from the subtree's top to the root, which is one row for each subtree.

Defined results: null keys come first, leaves of one key are ordered by their digest, repeated rows are leaves of their
own. An empty table has no groups, no root and no rows. Texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, sorted_rows

FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
#: Levels that a proving task goes through by itself: subtrees of 8 ** 4 leaves.
BLOCK_LEVELS = 4
#: Leaves of a range partition.
PART_ROWS = 1 << 16
#: Beginnings of groups in partitions that are broadcast.
BROADCAST_STARTS = 100_000

NODES = "grp string, level int, idx long, hash string"


def h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Range:
    """The runs of one group's nodes, level by level, as leaves come in order from any place on."""

    def __init__(self):
        self.runs: list[list[tuple[int, str]]] = []
        self.done: list[tuple[int, int, str, bool]] = []  # level, place, hash, whether its own run is still open

    def add(self, idx: int, digest: str) -> None:
        level = 0
        while True:
            if level == len(self.runs):
                self.runs.append([])
            run = self.runs[level]
            run.append((idx, digest))
            if (idx + 1) % FANOUT:
                return
            self._close(level, len(run) < FANOUT)
            if len(run) < FANOUT:  # it began before this partition
                return
            idx, digest, level = idx >> FANOUT_BITS, h([d for _, d in run]), level + 1

    def _close(self, level: int, is_open: bool) -> None:
        self.done += [(level, i, d, is_open) for i, d in self.runs[level]]
        self.runs[level] = []

    def end(self) -> list[tuple[int, int, str, bool]]:
        for level in range(len(self.runs)):
            self._close(level, True)
        return self.done


class Tree:
    """leaves: grp, idx, hash, height, part and all columns of the rows; nodes: all nodes from level 1 on, and leaves that were open; roots: grp, height, hash, n."""

    def __init__(self, leaves: DataFrame, nodes: DataFrame, sizes: DataFrame, most: int, tables: list[DataFrame]):
        self.leaves, self.nodes, self.sizes, self.most, self.tables = leaves, nodes, sizes, most, tables

    def roots(self) -> DataFrame:
        top = self.nodes.select(F.col("grp"), "level", "hash").join(self.sizes, "grp").where(F.col("level") == F.col("height"))
        return top.select("grp", "height", "n", "hash")

    def runs(self, level: int) -> DataFrame:
        """grp, run and its members' hashes in order, of a level from 1 on."""
        some = self.nodes.where(F.col("level") == level).withColumn("run", F.shiftright("idx", FANOUT_BITS))
        members = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda m: m["hash"])
        return some.groupBy("grp", "run").agg(members.alias("members"))

    def discard(self) -> None:
        discard(*self.tables)


def heights(n: Column, most: int = 21) -> Column:
    """Levels above the leaves: the least number of times that n must be cut by FANOUT, rounding up, to leave one."""
    out = F.lit(0)
    for k in range(most):
        out = out + (n > F.lit(1 << (FANOUT_BITS * k))).cast("int")
    return out


def build(rows: DataFrame, order: list[Column], n_rows: int, part_rows: int = PART_ROWS) -> Tree:
    """The tree of rows (grp, hash and others; grp and hash not null) whose leaves are ordered by order, then by hash, within each grp."""
    held = sorted_rows(rows, F.col("grp"), *order, F.col("hash"), rows=n_rows, per=part_rows, name="leaves")
    counts = held.groupBy("grp", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first_at"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition that has some of it
    whole = Window.partitionBy("grp")
    starts = materialize(counts.select("grp", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first_at")).alias("start"), F.sum("rows").over(whole).alias("n")), "starts")
    sizes = starts.groupBy("grp").agg(F.max("n").alias("n")).withColumn("height", heights(F.col("n")))
    most = sizes.agg(F.max("height")).first()[0] or 0
    near = F.broadcast(starts) if starts.count() <= BROADCAST_STARTS else starts
    leaves = held.join(near, ["grp", "part"]).withColumn("idx", F.col("at") + F.col("start")).withColumn("height", heights(F.col("n"))).drop("at", "start", "n")

    def stack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("grp", "ascending"), ("idx", "ascending")])
        out: list[tuple] = []
        grp, height, run = None, 0, None

        def close():
            if run is not None:
                out.extend((grp, level, i, d, o and level < height) for level, i, d, o in run.end() if level or o)

        for g, i, d, k in zip(*(t.column(c).to_pylist() for c in ("grp", "idx", "hash", "height"))):
            if g != grp:
                close()
                grp, height, run = g, k, Range()
            run.add(i, d)
        close()
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=["grp", "level", "idx", "hash", "open"])

    nodes = materialize(leaves.select("grp", "idx", "hash", "height", "part").groupBy("part").applyInArrow(stack, NODES + ", open boolean"), "nodes")
    all_nodes, tables, made = nodes.drop("open"), [held, starts, nodes], None
    heights_ = sizes.select("grp", "height")
    for level in range(most):
        members = nodes.where(F.col("open") & (F.col("level") == level)).select("grp", "idx", "hash")
        members = members if made is None else members.unionByName(made.select("grp", "idx", "hash"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda m: m["hash"]), "")  # at most FANOUT members
        above = members.groupBy("grp", F.shiftright("idx", FANOUT_BITS).alias("up")).agg(F.sha2(text, 256).alias("hash"))
        made = materialize(above.select("grp", F.lit(level + 1).alias("level"), F.col("up").alias("idx"), "hash"), "merged")
        tables.append(made)
        all_nodes = all_nodes.unionByName(made)
        made = made.join(heights_, "grp").where(F.col("height") > level + 1).drop("height")
    return Tree(leaves, all_nodes, sizes, most, tables)


def paths(tree: Tree, level: int) -> DataFrame:
    """grp, idx, path of the nodes of a level (or of the root, where the tree is lower): from there up, each step with the place in the run and its members."""
    step = "array<struct<pos:int,members:array<string>>>"
    own = tree.leaves.select("grp", "idx", "height").where(F.col("idx") % (1 << FANOUT_BITS * level) == 0)
    at = own.select("grp", "height", F.shiftright("idx", FANOUT_BITS * level).alias("idx"), F.expr(f"cast(array() as {step})").alias("path")).withColumn("cur", F.col("idx"))
    for k in range(level, tree.most):
        if k == 0:
            first = tree.leaves.select("grp", "idx", "hash").withColumn("run", F.shiftright("idx", FANOUT_BITS))
            runs = first.groupBy("grp", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda m: m["hash"]).alias("members"))
        else:
            runs = tree.runs(k)
        at = at.withColumn("run", F.shiftright("cur", FANOUT_BITS)).join(runs, ["grp", "run"], "left")
        here = F.struct((F.col("cur") % FANOUT).cast("int").alias("pos"), F.col("members"))
        at = at.select("grp", "idx", "height", F.when(F.col("height") > k, F.concat("path", F.array(here))).otherwise(F.col("path")).alias("path"), F.col("run").alias("cur"))
    return at.select("grp", "idx", "path")


def prove(tree: Tree, above: DataFrame, keep: list[str], changed: str | None = None) -> DataFrame:
    """For each leaf: keep columns, grp, idx, hash, proof_sha256 and folded, the root that follows from the leaf (or from column changed, where that isn't null) and its siblings.

    above: grp, path of each group's root in a tree above this one (empty if there is none).
    """
    bits = FANOUT_BITS * BLOCK_LEVELS
    tops = paths(tree, BLOCK_LEVELS).join(above.select("grp", F.col("path").alias("over")), "grp")
    tops = tops.select("grp", F.col("idx").alias("block"), F.concat("path", "over").alias("path"))
    inner = tree.nodes.where(F.col("level").between(1, BLOCK_LEVELS - 1)).select("grp", F.expr(f"shiftright(idx, {bits} - {FANOUT_BITS} * level)").alias("block"), "level", "idx", "hash")
    leaves = tree.leaves.select("grp", F.shiftright("idx", bits).alias("block"), "idx", "hash", (F.col(changed) if changed else F.lit(None).cast("string")).alias("changed_"), "height", *keep)
    # a task has the leaves of a subtree, its nodes and its path as rows of three kinds
    none = lambda t, names: [F.lit(None).cast(t.schema[c].dataType).alias(c) for c in names]
    path_type = tops.schema["path"].dataType
    rows = leaves.withColumns({"level": F.lit(0), "path": F.lit(None).cast(path_type)})
    more = inner.select("*", *none(leaves, ["changed_", "height", *keep])).withColumn("path", F.lit(None).cast(path_type))
    top = tops.select("grp", "block", "path", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit(None).cast("string").alias("hash"), *none(leaves, ["changed_", "height", *keep]))
    names = [c for c in rows.columns if c in keep]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("level", "ascending"), ("idx", "ascending")])
        level, hashes = t.column("level").to_pylist(), t.column("hash").to_pylist()
        own = t.filter(pc.equal(t.column("level"), 0))
        steps = t.column("path")[0].as_py()
        height = min(BLOCK_LEVELS, own.column("height")[0].as_py())
        at: dict[int, list[str]] = {}
        for k, d in zip(level, hashes):
            if k >= 0:
                at.setdefault(k, []).append(d)
        rest = "".join(x for s in steps for p, x in enumerate(s["members"]) if p != s["pos"])
        # what follows level by level above each node of a level: the siblings' text, and the runs to fold through
        tails: list[list[str]] = [[rest]] * (height + 1)
        for k in range(height - 1, 0, -1):
            up, mine = tails[k + 1], at[k]
            tails[k] = ["".join(mine[i - i % FANOUT : i]) + "".join(mine[i + 1 : i - i % FANOUT + FANOUT]) + up[i // FANOUT if k + 1 < height else 0] for i in range(len(mine))]
        above_ = [("".join(s["members"][: s["pos"]]), "".join(s["members"][s["pos"] + 1 :])) for s in steps]
        proofs, folded = [], []
        for i, (leaf, new) in enumerate(zip(at[0], own.column("changed_").to_pylist())):
            text, cur, j = "", leaf if new is None else new, i
            for k in range(height):
                a = j - j % FANOUT
                left, right = "".join(at[k][a:j]), "".join(at[k][j + 1 : a + FANOUT])
                if k == 0:
                    text = left + right + tails[1][j // FANOUT if height > 1 else 0]
                cur = hashlib.sha256((left + cur + right).encode()).hexdigest()
                j //= FANOUT
            for left, right in above_:
                cur = hashlib.sha256((left + cur + right).encode()).hexdigest()
            proofs.append(hashlib.sha256((text if height else rest).encode()).hexdigest())
            folded.append(cur)
        return own.select([*names, "grp", "idx", "hash"]).append_column("proof_sha256", pa.array(proofs, pa.string())).append_column("folded", pa.array(folded, pa.string()))

    kinds = ", ".join(f"`{c}` {leaves.schema[c].dataType.simpleString()}" for c in names)
    whole = rows.unionByName(more).unionByName(top)
    return whole.groupBy("grp", "block").applyInArrow(run, f"{kinds}, grp string, idx long, hash string, proof_sha256 string, folded string")


def differing(old: Tree, new: Tree) -> DataFrame:
    """grp, idx of the leaves that differ between two trees over groups of equal sizes: from the roots down, only children of nodes that differ are compared."""
    at = None
    for level in range(max(old.most, new.most), -1, -1):
        a, b = ((t.nodes.where(F.col("level") == level) if level else t.leaves).select("grp", "idx", "hash") for t in (old, new))
        both = a.withColumnRenamed("hash", "was").join(b, ["grp", "idx"]).where("was <> hash").select("grp", "idx")
        found = both.join(new.sizes.where(F.col("height") == level).select("grp"), "grp", "left_semi")  # groups whose root is here
        if at is not None:
            above = at.select("grp", F.col("idx").alias("up"))
            found = found.unionByName(both.withColumn("up", F.shiftright("idx", FANOUT_BITS)).join(above, ["grp", "up"], "left_semi").select("grp", "idx"))
            last = at
        at = materialize(found, "differing")
        if level < max(old.most, new.most):
            discard(last)
    return at


# ---------------------------------------------------------------- documents


def field(c: Column) -> Column:
    """A value as text that can't run into the next one: its length in bytes, a colon, the value; - if null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each document; a tree for each language and one above them.

    Tampered with are the documents whose id's crc32 is a multiple of 3; those without an id aren't.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").select(
        "doc_id",
        F.coalesce(F.concat(F.lit("."), "lang"), F.lit("-")).alias("grp"),  # null comes first, then by bytes
        F.sha2(F.concat(*parts, field(F.col("text"))), 256).alias("hash"),
        F.when(tampered, F.sha2(F.concat(*parts, field(lower)), 256)).alias("changed"),
    )
    rows = materialize(rows, "digests")
    tree = build(rows, [F.col("doc_id").asc_nulls_first()], rows.count())
    roots = materialize(tree.roots(), "subroots")
    top = build(roots.select(F.lit("").alias("grp"), F.col("grp").alias("lang_key"), "hash"), [F.col("lang_key")], roots.count())
    over = paths(top, 0).join(top.leaves.select("grp", "idx", "lang_key"), ["grp", "idx"]).select(F.col("lang_key").alias("grp"), "path")
    proved = prove(tree, over, ["doc_id"], "changed")
    root = F.lit((top.roots().first() or {"hash": None})["hash"])  # one row
    out = proved.join(roots.select("grp", F.col("hash").alias("subroot")), "grp").withColumn("root", root)
    out = out.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
    out = materialize(out, "manifest")
    discard(rows, roots)
    tree.discard()
    top.discard()
    return out
