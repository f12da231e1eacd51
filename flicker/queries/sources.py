"""Queries over sources, sinks and file formats; they write below the scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contacts as C
from ..operators import series as S
from ..registry import query
from ..session import scratch_path, table
from ..sources import formats as A
from . import sqltext as Q


@query("content_hash", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def content_hash(spark, sf_dir):
    return A.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


@query("csv_roundtrip", "SELECT event_type, count(*) AS events, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean_value"))
    out.write.csv(path, header=True)
    return spark.read.schema("event_type string, events bigint, mean_value double").csv(path, header=True)


@query("json_roundtrip", "SELECT event_type, count(*) AS events, CAST(max(user_id) AS BIGINT) AS top FROM events GROUP BY event_type")
def json_roundtrip(spark, sf_dir):
    """A write-once JSON sink and a scan with a fixed schema of nested fields."""
    path = scratch_path(spark, "json")
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(F.struct(F.count("*").alias("events"), F.max("user_id").alias("top")).alias("s"))
    out.write.mode("errorifexists").json(path)
    return spark.read.schema("event_type string, s struct<events: bigint, top: bigint>").json(path).select("event_type", "s.events", "s.top")


@query("partition_pruned_scan", f"WITH {Q.SERIES} SELECT run_id, count(*) AS frames, CAST(sum(x) AS BIGINT) AS positive FROM ev WHERE event_type = 'click' GROUP BY run_id")
def partition_pruned_scan(spark, sf_dir):
    """A partitioned Parquet sink; the scan reads one partition and two columns."""
    path = scratch_path(spark, "parts")
    e = table(spark, sf_dir, "events")
    e.select("user_id", "event_type", F.col("event_type").isin("click", "purchase").cast("tinyint").alias("x")).repartition("event_type").write.partitionBy("event_type").parquet(path)
    return spark.read.parquet(path).where("event_type = 'click'").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("frames"), F.sum(F.col("x").cast("long")).alias("positive"))


@query("npz_roundtrip", f"WITH {Q.SERIES} SELECT CAST(run_id AS VARCHAR) AS path, frame, CAST(x AS DOUBLE) AS x FROM ev")
def npz_roundtrip(spark, sf_dir):
    """Series to NPZ bytes and back: a file for each stretch, which holds the place of its first frame."""
    frames = S.event_frames(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"))
    runs = S.to_chunks(frames).select(F.concat_ws("/", "run_id", "chunk").alias("path"), F.col("xs").alias("X"), F.array("lo").alias("lo"))
    of = lambda name: F.first(F.when(F.col("array") == name, F.col("values")), ignorenulls=True).alias(name)
    files = A.read_npz(A.write_npz(runs)).groupBy("path").agg(of("X"), of("lo"))
    rows = files.select(F.substring_index("path", "/", 1).alias("path"), F.col("lo")[0].cast("long").alias("lo"), F.posexplode("X").alias("at", "x"))
    return rows.select("path", (F.col("lo") + F.col("at")).alias("frame"), "x")


@query(
    "pdb_roundtrip",
    """WITH fr AS (SELECT CAST(label AS BIGINT) AS run_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame, embedding FROM embeddings
), atm AS (SELECT run_id, CAST(a AS BIGINT) AS atom, embedding[3 * a + 1]::DOUBLE AS x, embedding[3 * a + 2]::DOUBLE AS y, embedding[3 * a + 3]::DOUBLE AS z FROM fr CROSS JOIN range(21) t(a) WHERE frame = 0)
SELECT run_id, CAST(atom AS INTEGER) AS serial, atom + 1 AS resid, 'ALA' AS resname, 'A' AS chain, CAST(printf('%.3f', x) AS DOUBLE) AS x, CAST(printf('%.3f', y) AS DOUBLE) AS y, CAST(printf('%.3f', z) AS DOUBLE) AS z FROM atm""",
)
def pdb_roundtrip(spark, sf_dir):
    atoms = C.atoms_of(C.embedding_frames(table(spark, sf_dir, "embeddings")).where("frame = 0")).withColumns({"resid": F.col("atom") + 1, "resname": F.lit("ALA")})
    return A.parse_pdb(A.pdb_lines(atoms).select("run_id", "line")).drop("line").select("run_id", "serial", F.col("resid").cast("long").alias("resid"), "resname", "chain", "x", "y", "z")


@query(
    "validation_report",
    "SELECT vec_id, CASE WHEN label >= 8 THEN ['label'] ELSE [] END || CASE WHEN embedding[1] > 0.3 THEN ['range'] ELSE [] END AS broken FROM embeddings WHERE label >= 8 OR embedding[1] > 0.3",
)
def validation_report(spark, sf_dir):
    """Rows that break a rule (shape, finite values, range, label), with the rules' names."""
    e = table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v))
    broken = A.violations(("shape", F.size("embedding") == 64), ("finite", finite), ("label", F.col("label") < 8), ("range", ~(F.get("embedding", F.lit(0)) > 0.3)))
    return e.select("vec_id", broken.alias("broken")).where(F.size("broken") > 0)


@query(
    "audit_log",
    """SELECT 'prepare' AS phase, 'documents' AS input, count(*) AS rows, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents
UNION ALL SELECT 'score', 'labels', count(*), CAST(16 * count(*) AS BIGINT) FROM labels""",
)
def audit_log(spark, sf_dir):
    """An append-only table of what each phase read; phases append in turn, nothing is overwritten."""
    path = scratch_path(spark, "audit")
    entry = lambda phase, name, size: table(spark, sf_dir, name).agg(F.count("*").alias("rows"), F.sum(size).cast("long").alias("bytes")).select(F.lit(phase).alias("phase"), F.lit(name).alias("input"), "rows", "bytes")
    entry("prepare", "documents", F.octet_length("text")).write.mode("append").parquet(path)
    entry("score", "labels", F.lit(16)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query(
    "zip_members",
    """WITH m AS (SELECT lang || '.zip' AS path, CASE WHEN doc_id % 17 = 3 THEN '../' ELSE '' END || 'docs/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.pdb' ELSE '.xtc' END AS member, CAST(strlen(source || doc_id) AS BIGINT) AS bytes FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT path, member, bytes, NOT starts_with(member, '../') AS safe FROM m""",
)
def zip_members(spark, sf_dir):
    """ZIP files of each language and their members; some would leave the folder that they are unpacked in."""
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select("lang", "source", "doc_id")
    end = F.when(F.col("doc_id") % 2 == 0, ".pdb").otherwise(".xtc")
    name = F.concat(F.when(F.col("doc_id") % 17 == 3, "../").otherwise(""), F.lit("docs/"), F.col("doc_id").cast("string"), end)
    parts = d.groupBy("lang").agg(F.collect_list(F.struct(name.alias("name"), F.concat("source", F.col("doc_id").cast("string")).alias("data"))).alias("members"))
    files = A.write_zip(parts.select(F.concat("lang", F.lit(".zip")).alias("path"), "members"))
    return A.read_zip(files).select("path", "member", "bytes", "safe")


@query("member_extensions", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'pdb' ELSE 'xtc' END AS extension, count(*) AS members FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def member_extensions(spark, sf_dir):
    return zip_members(spark, sf_dir).groupBy(F.substring_index("member", ".", -1).alias("extension")).agg(F.count("*").alias("members"))


@query("dcd_headers", "SELECT CAST(user_id AS VARCHAR) AS path, count(*) AS frames, CAST(min(event_id) AS BIGINT) AS first_step, CAST(2 AS BIGINT) AS step_interval, CAST(35 + user_id % 5 AS BIGINT) AS atoms FROM events GROUP BY user_id")
def dcd_headers(spark, sf_dir):
    """Headers of DCD files that runs of events stand for, written and read back."""
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("frames"), F.min("event_id").alias("first"))
    files = runs.select(F.col("user_id").cast("string").alias("path"), A.dcd_header(F.col("frames"), F.col("first"), F.lit(2), 35 + F.col("user_id") % 5).alias("content"))
    return A.read_dcd_headers(files)


@query(
    "audit_record",
    """SELECT 'score' AS phase, 'labels' AS input, count(*) AS rows, sha256(string_agg(sha256(concat_ws('|', doc_id, quality, toxic)), '' ORDER BY sha256(concat_ws('|', doc_id, quality, toxic)))) AS sha256, '{"draws":2,"level":0.1}' AS arguments, true AS has_environment FROM labels""",
)
def audit_record(spark, sf_dir):
    """What a phase was started with: a digest of its input, its arguments, the environment and the time, appended to a log."""
    path = scratch_path(spark, "audit")
    A.audit(spark, "score", "labels", table(spark, sf_dir, "labels"), ["doc_id", "quality", "toxic"], {"level": 0.1, "draws": 2}).write.mode("append").parquet(path)
    known = F.try_element_at("environment", F.lit("spark")).isNotNull() & F.try_element_at("environment", F.lit("python")).isNotNull() & F.col("started_utc").isNotNull()
    return spark.read.parquet(path).select("phase", "input", "rows", "sha256", "arguments", known.alias("has_environment"))
