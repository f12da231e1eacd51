"""Queries over manifests, checksums, differences, ancestry and eligibility."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.methods import candidates
from ..operators import contacts as C
from ..operators import integrity as I
from ..operators import splits as P
from ..registry import query
from ..session import table

_FILES = """act AS (SELECT 'docs/' || doc_id AS path, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents WHERE doc_id % 11 <> 0
), man AS (SELECT CASE WHEN doc_id % 13 = 0 THEN '../' ELSE '' END || 'docs/' || doc_id AS path, CAST(strlen(text) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS bytes, sha256(text || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END) AS sha256 FROM documents)"""


def _files(spark, sf_dir):
    """Actual files and a manifest with planted faults."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    name = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    actual = d.where("doc_id % 11 <> 0").select(name.alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    off = lambda m, v, w: F.when(F.col("doc_id") % m == 0, v).otherwise(w)
    manifest = d.select(
        F.concat(off(13, F.lit("../"), F.lit("")), name).alias("path"), (F.octet_length("text") + off(7, F.lit(1), F.lit(0))).cast("long").alias("bytes"), F.sha2(F.concat("text", off(5, F.lit("x"), F.lit(""))), 256).alias("sha256")
    )
    return manifest, actual


@query(
    "manifest_verify",
    f"""WITH {_FILES} SELECT path, CASE WHEN starts_with(path, '../') THEN 'unsafe' WHEN a.bytes IS NULL THEN 'missing' WHEN a.bytes <> m.bytes THEN 'size' WHEN a.sha256 <> m.sha256 THEN 'sha256' ELSE 'ok' END AS issue
FROM man m LEFT JOIN act a USING (path)""",
)
def manifest_verify(spark, sf_dir):
    return I.verify_manifest(*_files(spark, sf_dir))


@query("checksum_mismatch", f"WITH {_FILES} SELECT DISTINCT path FROM (SELECT * FROM man EXCEPT ALL SELECT * FROM act)")
def checksum_mismatch(spark, sf_dir):
    return I.mismatched(*_files(spark, sf_dir), "path")


_FLAT = """a AS (SELECT 'run.' || event_id || '.value' AS path, 'number' AS kind, CAST(round(value, 2) AS VARCHAR) AS value FROM events WHERE event_id % 10 < 8
  UNION ALL SELECT 'run.' || event_id || '.elapsed_seconds', 'number', CAST(event_id AS VARCHAR) FROM events WHERE event_id % 10 = 1
), b AS (SELECT 'run.' || event_id || '.value' AS path, CASE WHEN event_id % 100 = 3 THEN 'text' ELSE 'number' END AS kind, CAST(round(value + CASE WHEN event_id % 50 = 2 THEN 0.5 ELSE 0 END, 2) AS VARCHAR) AS value FROM events WHERE event_id % 10 > 1)"""
_DIFF = f"""{_FLAT}, d AS (SELECT coalesce(x.path, y.path) AS path, CASE WHEN y.path IS NULL THEN 'only_a' WHEN x.path IS NULL THEN 'only_b' WHEN x.kind <> y.kind THEN 'kind' WHEN x.value <> y.value THEN 'value' END AS issue,
  CASE WHEN x.kind = 'number' AND y.kind = 'number' THEN abs(CAST(x.value AS DOUBLE) - CAST(y.value AS DOUBLE)) END AS abs_diff
  FROM (SELECT * FROM a WHERE NOT ends_with(path, 'elapsed_seconds')) x FULL OUTER JOIN b y ON x.path = y.path)"""


def _documents(spark, sf_dir):
    """Two flattened result documents with planted differences and a volatile key."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    path = lambda leaf: F.concat(F.lit("run."), F.col("event_id").cast("string"), F.lit("." + leaf)).alias("path")
    shown = lambda v: F.round(v, 2).cast("string").alias("value")
    a = e.where("event_id % 10 < 8").select(path("value"), F.lit("number").alias("kind"), shown(F.col("value")))
    a = a.unionByName(e.where("event_id % 10 = 1").select(path("elapsed_seconds"), F.lit("number").alias("kind"), F.col("event_id").cast("string").alias("value")))
    kind = F.when(F.col("event_id") % 100 == 3, "text").otherwise("number").alias("kind")
    b = e.where("event_id % 10 > 1").select(path("value"), kind, shown(F.col("value") + F.when(F.col("event_id") % 50 == 2, 0.5).otherwise(0)))
    return a, b


@query("structural_diff", f"WITH {_DIFF} SELECT path, issue, round(abs_diff, 6) AS abs_diff FROM d WHERE issue IS NOT NULL")
def structural_diff(spark, sf_dir):
    return I.structural_diff(*_documents(spark, sf_dir)).withColumn("abs_diff", F.round("abs_diff", 6))


@query("diff_summary", f"WITH {_DIFF} SELECT issue, count(*) AS n, round(max(abs_diff), 6) AS largest FROM d WHERE issue IS NOT NULL GROUP BY issue")
def diff_summary(spark, sf_dir):
    return I.structural_diff(*_documents(spark, sf_dir)).groupBy("issue").agg(F.count("*").alias("n"), F.round(F.max("abs_diff"), 6).alias("largest"))


@query("key_set_difference", "SELECT k, CAST(n AS BIGINT) AS n FROM (SELECT 'shared' AS k, (SELECT count(*) FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error')) AS n UNION ALL SELECT 'click_only', (SELECT count(*) FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'error')))")
def key_set_difference(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    of = lambda t: e.where(F.col("event_type") == t).select("user_id")
    a, b = of("click"), of("error")
    count = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n")
    return count(a.intersect(b), "shared").unionByName(count(a.subtract(b), "click_only"))


_TREE = "nd AS (SELECT conv_id * 100 + turn AS node, CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS parent FROM conversations WHERE conv_id % 7 <> 3 OR turn <> 1)"


def _tree(spark, sf_dir):
    """Turns as nodes below the turn before; some chains have lost a link."""
    c = table(spark, sf_dir, "conversations").where("conv_id % 7 <> 3 OR turn <> 1")
    turn = F.col("turn").cast("long")
    # a number such as conv_id * 100 + turn would meet the next conversation's from turn 100 on
    node = lambda t: F.struct("conv_id", t.alias("turn"))
    return c.select(node(turn).alias("node"), F.when(turn > 0, node(turn - 1)).alias("parent"))


@query(
    "ancestry_roots",
    f"""WITH RECURSIVE {_TREE}, up AS (SELECT node, parent AS nxt, 0 AS depth, node AS top FROM nd UNION ALL SELECT up.node, nd.parent, depth + 1, nd.node FROM up JOIN nd ON nd.node = up.nxt),
f AS (SELECT node, max(depth) AS depth, arg_max(top, depth) AS top, max(CASE WHEN nxt IS NULL THEN 1 ELSE 0 END) AS whole FROM up GROUP BY node)
SELECT node, CASE WHEN whole = 1 THEN top END AS root, CAST(depth AS BIGINT) AS depth FROM f""",
)
def ancestry_roots(spark, sf_dir):
    """Nodes are shown as conv_id * 100 + turn."""
    shown = lambda c: (F.col(c)["conv_id"] * 100 + F.col(c)["turn"]).alias(c)
    return I.roots(_tree(spark, sf_dir)).select(shown("node"), shown("root"), "depth")


@query(
    "ancestry_bounds",
    """WITH n AS (SELECT conv_id * 100 + turn AS node, CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS parent, CAST(length(text) % 9 AS BIGINT) AS parent_frame, turn - CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN 1 ELSE 0 END AS epoch, CAST(5 + length(role) % 4 AS BIGINT) AS frames FROM conversations WHERE conv_id % 7 <> 3 OR turn <> 1
), j AS (SELECT c.node, CASE WHEN p.node IS NULL THEN 'missing_parent' WHEN c.parent_frame >= p.frames THEN 'frame_out_of_range' WHEN c.epoch <= p.epoch THEN 'epoch_not_later' END AS violation FROM n c LEFT JOIN n p ON p.node = c.parent WHERE c.parent IS NOT NULL)
SELECT node, violation FROM j WHERE violation IS NOT NULL""",
)
def ancestry_bounds(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("conv_id % 7 <> 3 OR turn <> 1")
    node = F.col("conv_id") * 100 + F.col("turn")
    rows = c.select(
        node.alias("node"), F.when(F.col("turn") > 0, node - 1).alias("parent"), (F.char_length("text") % 9).cast("long").alias("parent_frame"),
        (F.col("turn") - F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), 1).otherwise(0)).alias("epoch"), (F.char_length("role") % 4 + 5).cast("long").alias("frames"),
    )
    return I.ancestry_violations(rows)


_CADENCE = """t AS (SELECT user_id AS run_id, epoch_us(ts) / 1000000.0::DOUBLE AS s, event_id FROM events), c AS (SELECT run_id, s - lag(s) OVER (PARTITION BY run_id ORDER BY s, event_id) AS dt FROM t
), ca AS (SELECT run_id, count(*) AS frames, min(dt) AS min_dt, max(dt) AS max_dt FROM c GROUP BY run_id)"""


def _times(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1000000.0).alias("s"), "event_id")


@query("cadence_check", f"WITH {_CADENCE} SELECT run_id, frames, round(min_dt, 5) AS min_dt, round(max_dt, 5) AS max_dt FROM ca")
def cadence_check(spark, sf_dir):
    return I.cadence(_times(spark, sf_dir), "s", order=("event_id",)).select("run_id", "frames", F.round("min_dt", 5).alias("min_dt"), F.round("max_dt", 5).alias("max_dt"))


@query("eligibility", f"WITH {_CADENCE} SELECT run_id, frames, frames >= 60 AS eligible, CASE WHEN frames < 60 THEN 'too_few_frames' END AS reason FROM ca")
def eligibility(spark, sf_dir):
    return I.eligibility(I.cadence(_times(spark, sf_dir), "s", order=("event_id",)), 60).select("run_id", "frames", "eligible", "reason")


@query("mode_frames", "WITH c AS (SELECT user_id, count(*) AS frames FROM events GROUP BY user_id), k AS (SELECT frames, count(*) AS runs FROM c GROUP BY frames) SELECT frames, runs FROM k ORDER BY runs DESC, frames LIMIT 1")
def mode_frames(spark, sf_dir):
    k = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("frames")).groupBy("frames").agg(F.count("*").alias("runs"))
    return k.orderBy(F.desc("runs"), "frames").limit(1)


@query("group_counts", "SELECT lang, source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang, source")
def group_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("uniqueness_check", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) = count(DISTINCT doc_id) AS is_unique, count(DISTINCT sha256(text)) AS texts FROM documents")
def uniqueness_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), (F.count("*") == F.count_distinct("doc_id")).alias("is_unique"), F.count_distinct("h").alias("texts"))


@query("array_digest", "SELECT user_id, sha256(string_agg(concat_ws(',', event_id, event_type), ';' ORDER BY event_id)) AS digest FROM events GROUP BY user_id")
def array_digest(spark, sf_dir):
    return I.array_digest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_id", "event_type")


@query("stable_run_index", "SELECT DISTINCT source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS run_index FROM documents")
def stable_run_index(spark, sf_dir):
    return P.run_index(table(spark, sf_dir, "documents").select("source").distinct(), "source")


@query("hash_capped_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS place FROM documents) WHERE place <= 3")
def hash_capped_sample(spark, sf_dir):
    """The cap is the feature: the first three documents of each source by hash."""
    return P.hash_cap(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", 3).select("source", "doc_id")


@query(
    "sequence_difference",
    """WITH w AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS s FROM conversations WHERE turn < 2), p AS (SELECT conv_id, turn, generate_subscripts(s, 1) AS pos, unnest(s) AS word FROM w)
SELECT a.conv_id, count(*) AS compared, count(*) FILTER (a.word = b.word) AS equal_words FROM p a JOIN p b ON b.conv_id = a.conv_id AND b.pos = a.pos AND a.turn = 0 AND b.turn = 1 GROUP BY a.conv_id""",
)
def sequence_difference(spark, sf_dir):
    """Two sequences compared position by position."""
    c = table(spark, sf_dir, "conversations").where("turn < 2")
    p = c.select("conv_id", "turn", F.posexplode(F.split(F.lower("text"), " ")).alias("pos", "word"))
    a, b = p.where("turn = 0").drop("turn"), p.where("turn = 1").select("conv_id", "pos", F.col("word").alias("other"))
    return a.join(b, ["conv_id", "pos"]).groupBy("conv_id").agg(F.count("*").alias("compared"), F.count_if(F.col("word") == F.col("other")).alias("equal_words"))


@query(
    "phase_chronology",
    "WITH t AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS selected, max(ts) FILTER (event_type = 'purchase') AS tested FROM events GROUP BY user_id) SELECT user_id, selected <= tested - INTERVAL 3600 SECOND AS in_order FROM t WHERE selected IS NOT NULL AND tested IS NOT NULL",
)
def phase_chronology(spark, sf_dir):
    """Whether one phase ended an hour before the other did."""
    last = lambda t: F.max(F.when(F.col("event_type") == t, F.col("ts")))
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(last("view").alias("a"), last("purchase").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return t.select("user_id", (F.col("a") <= F.col("b") - F.expr("INTERVAL 3600 SECOND")).alias("in_order"))


@query("adjacent_orders", "WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders) SELECT o_custkey, o_orderkey, round(step, 2) AS step FROM o WHERE step IS NOT NULL")
def adjacent_orders(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("step")).where("step IS NOT NULL")


# ---------------------------------------------------------------- manifests, names, nested documents

_NAMES = """nm AS (SELECT conv_id, turn, 'md/' || (conv_id % 3 + 1) || '/run/' || CASE WHEN conv_id % 11 = 5 THEN 'other' ELSE 'e' || turn || 's' || conv_id END || CASE WHEN turn > 0 THEN '_e' || (turn - 1) || 's' || conv_id || 'p' || (conv_id % 4) || 'f' || (length(text) % 250) ELSE '' END || '/traj.xtc' AS path FROM conversations)"""


def _paths(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    t = lambda x: (x if not isinstance(x, str) else F.lit(x)).cast("string")
    child = F.when(F.col("conv_id") % 11 == 5, "other").otherwise(F.concat(t("e"), t(F.col("turn")), t("s"), t(F.col("conv_id"))))
    parent = F.when(F.col("turn") > 0, F.concat(t("_e"), t(F.col("turn") - 1), t("s"), t(F.col("conv_id")), t("p"), t(F.col("conv_id") % 4), t("f"), t(F.char_length("text") % 250))).otherwise("")
    return c.select("conv_id", "turn", F.concat(t("md/"), t(F.col("conv_id") % 3 + 1), t("/run/"), child, parent, t("/traj.xtc")).alias("path"))


@query(
    "trajectory_names",
    f"""WITH {_NAMES}, f AS (SELECT path, split_part(path, '/', 2) AS grp, split_part(path, '/', 4) AS folder FROM nm
), e AS (SELECT *, TRY_CAST(regexp_extract(folder, '^e([0-9]+)s([0-9]+)', 1) AS INTEGER) AS epoch, TRY_CAST(regexp_extract(folder, '^e([0-9]+)s([0-9]+)', 2) AS INTEGER) AS sample, TRY_CAST(regexp_extract(folder, '_e([0-9]+)s([0-9]+)p', 1) AS INTEGER) AS pe, TRY_CAST(regexp_extract(folder, '_e([0-9]+)s([0-9]+)p', 2) AS INTEGER) AS ps,
  TRY_CAST(regexp_extract(folder, '_e[0-9]+s[0-9]+p([0-9]+)f', 1) AS INTEGER) AS parent_piece, TRY_CAST(regexp_extract(folder, '_e[0-9]+s[0-9]+p[0-9]+f([0-9]+)', 1) AS INTEGER) AS parent_frame FROM f)
SELECT path, grp, folder, CASE WHEN epoch IS NOT NULL THEN grp || '/e' || epoch || 's' || sample END AS child_node, epoch, sample, CASE WHEN pe IS NOT NULL THEN grp || '/e' || pe || 's' || ps END AS parent_node, parent_piece, parent_frame FROM e""",
)
def trajectory_names(spark, sf_dir):
    """Group, child and parent that a trajectory's path names."""
    return I.trajectory_parts(_paths(spark, sf_dir).select("path"))


@query(
    "scenario_inputs",
    """SELECT user_id AS run_id, CASE WHEN user_id % 9 <> 4 THEN 'contacts/' || user_id || '_20.npz' END AS contacts_of_cutoff, CASE WHEN user_id % 9 <> 4 THEN sha256('contacts/' || user_id || '_20.npz') END AS contacts_sha256_of_cutoff FROM (SELECT DISTINCT user_id FROM events)""",
)
def scenario_inputs(spark, sf_dir):
    """The file and checksum that each run of a manifest has for a cutoff, from maps by cutoff."""
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id")).distinct()
    cuts = F.when(F.col("run_id") % 9 == 4, F.array(F.lit("15"))).otherwise(F.array(F.lit("15"), F.lit("20"), F.lit("25")))
    paths = F.map_from_entries(F.transform(cuts, lambda c: F.struct(c, F.concat(F.lit("contacts/"), F.col("run_id").cast("string"), F.lit("_"), c, F.lit(".npz")))))
    manifest = runs.withColumn("contacts", paths).withColumn("contacts_sha256", F.transform_values("contacts", lambda _, v: F.sha2(v, 256)))
    return I.input_paths(manifest, 20).select("run_id", "contacts_of_cutoff", "contacts_sha256_of_cutoff")


@query(
    "exact_stride",
    "SELECT o_custkey AS run_id, dt, CASE WHEN round(200 / dt) >= 1 AND abs(round(200 / dt) * dt - 200) <= 2e-6 THEN CAST(round(200 / dt) AS BIGINT) END AS stride FROM (SELECT o_custkey, 10.0::DOUBLE * (1 + min(o_orderkey) % 7) AS dt FROM orders GROUP BY o_custkey)",
)
def exact_stride(spark, sf_dir):
    """Frames between samples that are 200 apart, where the run's own spacing allows that exactly."""
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg((F.lit(10.0) * (F.min("o_orderkey") % 7 + 1)).alias("dt"))
    return runs.withColumn("stride", I.stride("dt", 200.0))


@query(
    "eligibility_reasons",
    """WITH fr AS (SELECT CAST(label AS BIGINT) AS run_id, vec_id, embedding FROM embeddings), a AS (SELECT run_id, vec_id, CAST(atom AS BIGINT) AS atom, embedding[3 * atom + 1]::DOUBLE AS x, embedding[3 * atom + 2]::DOUBLE AS y, embedding[3 * atom + 3]::DOUBLE AS z FROM fr CROSS JOIN range(21) t(atom)
), s AS (SELECT run_id, atom, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step FROM a WINDOW w AS (PARTITION BY run_id, vec_id ORDER BY atom)
), k AS (SELECT run_id, count(*) FILTER (atom = 0) AS frames, max(step) AS max_step, count(DISTINCT atom) - CASE WHEN run_id = 6 THEN 1 ELSE 0 END AS atoms FROM s GROUP BY run_id)
SELECT run_id, frames, atoms, CASE WHEN frames < 45 THEN 'too_few_frames' WHEN max_step >= 0.72 THEN 'geometry' WHEN atoms <> 21 THEN 'atom_count' END AS reason FROM k""",
)
def eligibility_reasons(spark, sf_dir):
    """Runs by number of frames, longest step along the chain and number of atoms; one run is short of an atom."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("run_id"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda v: v.cast("double")).alias("xyz"))
    atoms = C.atoms_of(e.withColumn("xyz", F.slice("xyz", 1, 63)))
    steps = C.neighbour_steps(atoms).groupBy("run_id").agg(F.max("step").alias("max_step"))
    lost = F.when(F.col("run_id") == 6, 1).otherwise(0)
    runs = atoms.groupBy("run_id").agg(F.count_if(F.col("atom") == 0).alias("frames"), F.count_distinct("atom").alias("n")).withColumn("atoms", F.col("n") - lost)
    runs = runs.join(steps, "run_id").withColumns({"min_dt": F.lit(1.0), "max_dt": F.lit(1.0)})
    return I.eligibility(runs, 45, atoms=21, longest_step=0.72).select("run_id", "frames", "atoms", "reason")


_JSON = """js AS (SELECT event_id, '{"run":{"id":' || user_id || ',"values":[' || event_id || ',{"k":"x' || (event_id % 5) || '"},[]],"environment":{"host":"h"}},"ok":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"none":null}' AS j FROM events)"""


def _json(spark, sf_dir):
    t = lambda c: c.cast("string")
    e = table(spark, sf_dir, "events")
    j = F.concat(F.lit('{"run":{"id":'), t(F.col("user_id")), F.lit(',"values":['), t(F.col("event_id")), F.lit(',{"k":"x'), t(F.col("event_id") % 5), F.lit('"},[]],"environment":{"host":"h"}},"ok":'), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit(',"none":null}'))
    return e.select("event_id", j.alias("j"))


@query(
    "json_leaves",
    f"WITH {_JSON} SELECT event_id, fullkey AS path, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, CASE WHEN type <> 'NULL' THEN atom ->> '$' END AS value FROM js, json_tree(js.j) WHERE type NOT IN ('OBJECT', 'ARRAY')",
)
def json_leaves(spark, sf_dir):
    """The leaves of nested JSON documents, with their paths."""
    return I.flatten_json(_json(spark, sf_dir), "event_id", "j")


@query(
    "json_diff",
    f"WITH {_JSON}, l AS (SELECT event_id, fullkey AS path, type, CASE WHEN type <> 'NULL' THEN atom ->> '$' END AS value FROM js, json_tree(js.j) WHERE type NOT IN ('OBJECT', 'ARRAY') AND fullkey NOT LIKE '%.environment.%'), a AS (SELECT * FROM l WHERE event_id = 2), b AS (SELECT * FROM l WHERE event_id = 5)\n"
    "SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'only_a' WHEN a.path IS NULL THEN 'only_b' WHEN a.value IS DISTINCT FROM b.value THEN 'value' END AS issue, CASE WHEN a.type = 'UBIGINT' THEN abs(a.value::DOUBLE - b.value::DOUBLE) END AS abs_diff FROM a FULL OUTER JOIN b ON a.path = b.path WHERE a.value IS DISTINCT FROM b.value",
)
def json_diff(spark, sf_dir):
    """Two documents compared leaf by leaf; what lies below a volatile key isn't."""
    leaves = I.flatten_json(_json(spark, sf_dir).where("event_id in (2, 5)"), "event_id", "j")
    return I.structural_diff(leaves.where("event_id = 2"), leaves.where("event_id = 5"))


@query("candidate_sets", "SELECT CAST(0 AS BIGINT) AS only_here, CAST(7 AS BIGINT) AS only_with_known_noise")
def candidate_sets(spark, sf_dir):
    """The grid with and without a known noise level, compared both ways as sets."""
    of = lambda level: spark.createDataFrame([(m.name, m.cand) for m in candidates(level)], "method string, cand_ord int")
    a, b = of(None), of(0.1)
    return a.exceptAll(b).agg(F.count("*").alias("only_here")).join(F.broadcast(b.exceptAll(a).agg(F.count("*").alias("only_with_known_noise"))), F.lit(True))  # one row each


@query("method_seconds", "SELECT event_type AS method, count(*) AS calls, round(sum(value) / 1000, 6) AS seconds FROM events GROUP BY event_type")
def method_seconds(spark, sf_dir):
    """Seconds summed over the calls of each method, from a table of timings."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("calls"), F.round(F.sum("value") / 1000, 6).alias("seconds"))


@query(
    "tree_digests",
    """WITH v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, printf('%016X', event_id) AS h FROM events
), l AS (SELECT user_id, place, h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS b FROM v
), d AS (SELECT user_id, place // 4096 AS block, count(*) AS n, sha256(unhex(string_agg(b, '' ORDER BY place))) AS s FROM l GROUP BY ALL
), e AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS n, CASE WHEN count(*) = 1 THEN max(s) ELSE sha256(unhex(string_agg(s, '' ORDER BY block))) END AS digest FROM d GROUP BY user_id)
SELECT user_id, n AS "values", digest FROM e""",
)
def tree_digests(spark, sf_dir):
    """Digests of every user's event ids as little-endian 64-bit numbers, in blocks of 4,096 (the SQL has two levels)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    return I.tree_digest(e, ["user_id"], "event_id", I.little_endian(F.col("event_id")))
