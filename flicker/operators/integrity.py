"""Manifests, checksums, structural differences, ancestry and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered
from .stretches import neighbours

#: Keys whose values may differ between two runs of the same work.
VOLATILE = ("created_utc", "elapsed_seconds", "environment", "argv")


def unsafe_path(path: Column) -> Column:
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def verify_manifest(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """path and issue (unsafe, missing, size, sha256 or ok) for every row of manifest (path, bytes, sha256) against actual files."""
    a = actual.select("path", F.col("bytes").alias("has_bytes"), F.col("sha256").alias("has_sha256"))
    issue = F.when(unsafe_path(F.col("path")), "unsafe").when(F.col("has_bytes").isNull(), "missing").when(F.col("has_bytes") != F.col("bytes"), "size").when(F.col("has_sha256") != F.col("sha256"), "sha256").otherwise("ok")
    return manifest.join(a, "path", "left").select("path", issue.alias("issue"))


def mismatched(published: DataFrame, verified: DataFrame, key: str) -> DataFrame:
    """Keys of published rows that have no verified row with all fields equal."""
    return published.exceptAll(verified.select(published.columns)).select(key).distinct()


def structural_diff(a: DataFrame, b: DataFrame, volatile: tuple[str, ...] = VOLATILE) -> DataFrame:
    """path, issue and abs_diff for flattened documents (path, kind, value): only_a, only_b, kind or value; equal ones are left out.

    What lies below a volatile key, at any depth, isn't compared.
    """
    drop = lambda d: d.where(~F.exists(F.split("path", r"[.\[]"), lambda k: k.isin(*volatile)))
    x, y = drop(a).select("path", F.col("kind").alias("ka"), F.col("value").alias("va")), drop(b).select("path", F.col("kind").alias("kb"), F.col("value").alias("vb"))
    both = x.join(y, "path", "full_outer")
    issue = F.when(F.col("kb").isNull(), "only_a").when(F.col("ka").isNull(), "only_b").when(F.col("ka") != F.col("kb"), "kind").when(~F.col("va").eqNullSafe(F.col("vb")), "value")
    diff = F.when((F.col("ka") == "number") & (F.col("kb") == "number"), F.abs(F.col("va").cast("double") - F.col("vb").cast("double")))
    return both.select("path", issue.alias("issue"), diff.alias("abs_diff")).where("issue is not null")


def flatten_json(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, path ($.a[0].b), kind (number, string, boolean or null) and value of every leaf of JSON texts, level by level until none is left.

    Empty objects and arrays have no leaves. A text that isn't JSON fails the job.
    """
    from ..session import discard, persisted

    schema = F.schema_of_variant("v")
    inner = lambda: schema.startswith("OBJECT") | schema.startswith("ARRAY")
    level = persisted(documents.select(F.col(key), F.lit("$").alias("path"), F.parse_json(text).alias("v")), "json")
    leaves = None
    while True:
        found = level.where(~inner())
        number = schema.startswith("DECIMAL") | schema.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
        kind = F.when(number, "number").when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").otherwise("string")
        found = persisted(found.select(key, "path", kind.alias("kind"), F.try_variant_get("v", "$", "string").alias("value")), "leaves")
        leaves = found if leaves is None else leaves.unionByName(found)
        below = level.where(inner())
        if below.isEmpty():
            discard(level)
            return leaves
        view = f"json_{id(level)}"
        below.createOrReplaceTempView(view)
        step = level.sparkSession.sql(f"SELECT b.`{key}`, b.path || CASE WHEN e.key IS NULL THEN '[' || e.pos || ']' ELSE '.' || e.key END AS path, e.value AS v FROM {view} b, LATERAL variant_explode(b.v) e")
        last, level = level, persisted(step, "json")
        level.sparkSession.catalog.dropTempView(view)
        discard(last)


def refuse_existing(spark, paths: list[str]) -> None:
    """Fails, before any work is done, if any of the targets exists."""
    there = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            there.append(path)
    if there:
        raise FileExistsError(f"will not overwrite {', '.join(there)}")


def roots(edges: DataFrame) -> DataFrame:
    """node, root, depth of all nodes of edges (node, parent; null parent: a root), by doubling: each step joins twice as far.

    A node on a cycle, or below one or a missing parent, has a null root; depth is then the steps to where it ends. No
    path has more steps than there are nodes, so a node that goes further is on or below a cycle.
    """
    from ..session import persisted

    known = edges.select(F.col("node").alias("known"))
    below = edges.where("parent is not null")
    hop = below.join(known, below["parent"] == F.col("known"), "left").select("node", "parent", F.col("known").isNull().alias("lost"))
    state = hop.select("node", F.when(~F.col("lost"), F.col("parent")).alias("at"), F.when(F.col("lost"), 0).otherwise(1).cast("long").alias("depth"), "lost", F.when(F.col("lost"), F.col("node")).otherwise(F.col("parent")).alias("top"))
    none = F.lit(None).cast(edges.schema["parent"].dataType)
    state = persisted(state.union(edges.where("parent is null").select("node", none, F.lit(0).cast("long"), F.lit(False), "node")), "roots")
    most, steps = state.count(), 1
    while steps <= most and not state.where("at is not null").isEmpty():
        up = state.select(F.col("node").alias("n2"), F.col("at").alias("a2"), F.col("depth").alias("d2"), F.col("lost").alias("l2"), F.col("top").alias("t2"))
        # nodes that have ended stay out of the join, where they would all meet under null
        going = state.where("at is not null")
        s = going.join(up, going["at"] == up["n2"])
        moved = s.select("node", F.col("a2").alias("at"), (F.col("depth") + F.col("d2")).alias("depth"), F.col("l2").alias("lost"), F.col("t2").alias("top"))
        state = persisted(state.where("at is null").union(moved), "roots")
        steps *= 2
    ends = state["at"].isNull() & ~state["lost"]
    return state.select("node", F.when(ends, F.col("top")).alias("root"), "depth")


def ancestry_violations(nodes: DataFrame) -> DataFrame:
    """Nodes (node, parent, parent_frame, epoch, frames) whose parent is missing, too short for parent_frame, or no earlier."""
    p = nodes.select(F.col("node").alias("pn"), F.col("frames").alias("pf"), F.col("epoch").alias("pe"))
    both = nodes.where("parent is not null").join(p, F.col("parent") == F.col("pn"), "left")
    why = F.when(F.col("pn").isNull(), "missing_parent").when(F.col("parent_frame") >= F.col("pf"), "frame_out_of_range").when(F.col("epoch") <= F.col("pe"), "epoch_not_later")
    return both.select("node", why.alias("violation")).where("violation is not null")


def eligibility(runs: DataFrame, least_frames: int = 20, cadence: float | None = None, tolerance: float = 1e-3, atoms: int | None = None, longest_step: float | None = None) -> DataFrame:
    """runs (frames, min_dt, max_dt; atoms and max_step if asked for) with eligible and the first reason why not; excluded rows stay."""
    reason = F.when(F.col("frames") < least_frames, "too_few_frames")
    if longest_step is not None:
        reason = reason.when(F.coalesce(F.col("max_step") >= longest_step, F.lit(True)), "geometry")
    if atoms is not None:
        reason = reason.when(F.coalesce(F.col("atoms") != atoms, F.lit(True)), "atom_count")
    reason = reason.when(F.col("min_dt") <= 0, "time_not_increasing")
    if cadence is not None:
        reason = reason.when((F.abs(F.col("min_dt") - cadence) > tolerance) | (F.abs(F.col("max_dt") - cadence) > tolerance), "cadence")
    return runs.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())


def cadence(frames: DataFrame, time: str, run: str = "run_id", order: tuple[str, ...] = ()) -> DataFrame:
    """run_id, frames, min_dt, max_dt of numeric times; a run of any length is sorted over many tasks."""
    placed = numbered(frames.select(run, time, *order), [run], time, *order, name="_place")
    both = neighbours(placed, [run], [time], "_place")
    dt = F.col(time) - F.col(f"before_{time}")
    return both.groupBy(run).agg(F.count("*").alias("frames"), F.min(dt).alias("min_dt"), F.max(dt).alias("max_dt"))


def stride(dt: str, wanted: float, tolerance: float = 1e-8) -> Column:
    """Every how many frames of spacing dt are `wanted` apart; null where no whole number is."""
    k = F.round(F.lit(wanted) / F.col(dt))
    return F.when((k >= 1) & (F.abs(k * F.col(dt) - wanted) <= tolerance * wanted), k.cast("long"))


#: Fixed pattern of a trajectory's folder: e<epoch>s<sample>, and the parent that it started from.
CHILD, PARENT = r"^e(\d+)s(\d+)", r"_e(\d+)s(\d+)p(\d+)f(\d+)"


def trajectory_parts(paths: DataFrame, path: str = "path") -> DataFrame:
    """paths with grp, folder, child_node, epoch, sample, parent_node, parent_piece and parent_frame, read off the path ../<group>/../<folder>/.. ; null where a part is missing."""
    part = F.split(path, "/")
    grp, folder = F.get(part, F.lit(1)), F.get(part, F.lit(3))
    number = lambda pattern, k: F.nullif(F.regexp_extract(folder, pattern, k), F.lit("")).cast("int")
    node = lambda pattern: F.concat(grp, F.lit("/e"), number(pattern, 1).cast("string"), F.lit("s"), number(pattern, 2).cast("string"))
    return paths.withColumns({
        "grp": grp, "folder": folder, "child_node": node(CHILD), "epoch": number(CHILD, 1), "sample": number(CHILD, 2),
        "parent_node": node(PARENT), "parent_piece": number(PARENT, 3), "parent_frame": number(PARENT, 4),
    })


def input_paths(runs: DataFrame, cutoff: int, maps: tuple[str, ...] = ("contacts", "contacts_sha256")) -> DataFrame:
    """runs of a manifest with the entry of each of maps (by cutoff, as text) that a scenario of a cutoff reads; null where there is none."""
    return runs.withColumns({f"{m}_of_cutoff": F.try_element_at(m, F.lit(str(cutoff))) for m in maps})


def array_digest(rows: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """keys and a SHA-256 of the given columns in order: stable under any partitioning."""
    text = F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
    parts = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("t")))).alias("s"))
    return parts.select(*keys, F.sha2(F.array_join(F.transform("s", lambda s: s["t"]), ";"), 256).alias("digest"))


#: Values of a block, and digests of a block of digests.
BLOCK_BITS = 12


def little_endian(value: Column) -> Column:
    """The 8 bytes of a whole number, least first."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)]))


def tree_digest(rows: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
    """keys, values and a SHA-256 of value (bytes) in order, as a tree: no task has more than 4,096 values or digests at once.

    A key's values are numbered over many tasks; 4,096 at a time, their bytes one behind the other, have a digest, and so have
    4,096 digests (32 bytes each) at a time, until one is left. Equal keys and values give equal digests however the rows lie.
    """
    from ..session import persisted

    placed = numbered(rows.select(*keys, order, value.alias("_v")), keys, order, name="_at")
    ordered = lambda at, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("a"), F.hex(v).alias("v")))), lambda x: x["v"]), "")
    up = lambda at: F.shiftright(at, BLOCK_BITS).alias("_up")
    level = placed.groupBy(*keys, up("_at")).agg(F.count("*").alias("values"), F.unhex(F.sha2(F.unhex(ordered("_at", "_v")), 256)).alias("_v"))
    out = None
    while True:
        level = persisted(level.withColumnRenamed("_up", "_at"), "digests")
        first = level.groupBy(*keys).agg(F.max("_at").alias("_last")).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
        on = None
        for i, k in enumerate(keys):
            same = F.col(k).eqNullSafe(F.col(f"_k{i}"))
            on = same if on is None else on & same
        both = level.join(first, on).drop(*[f"_k{i}" for i in range(len(keys))])
        done = both.where("_last = 0").select(*keys, "values", F.lower(F.hex("_v")).alias("digest"))
        out = done if out is None else out.unionByName(done)
        rest = both.where("_last > 0")
        if rest.isEmpty():
            return out
        level = rest.groupBy(*keys, up("_at")).agg(F.sum("values").alias("values"), F.unhex(F.sha2(F.unhex(ordered("_at", "_v")), 256)).alias("_v"))
