"""File formats of the domain: NPZ, PDB lines, ZIP members, DCD headers. Files are read through Spark's own binary source."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NPZ_ROWS = "path string, array string, shape array<long>, values array<double>"
ZIP_ROWS = "path string, member string, bytes long, crc32 long, safe boolean"
DCD_ROWS = "path string, frames long, first_step long, step_interval long, atoms long"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def _each(parse, schema: str):
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [dict(zip(arrow.names, (path, *row))) for row in parse(content.as_py())]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return run


def _npz(data: bytes):
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        for name in z.files:
            a = z[name]
            if a.dtype.kind not in "biuf":
                raise ValueError(f"{name}: {a.dtype} is not numeric")
            yield name, list(a.shape), np.asarray(a, float).ravel().tolist()


def read_npz(content: DataFrame) -> DataFrame:
    """content (path, content): one row for each array, in C order."""
    return content.mapInArrow(_each(_npz, NPZ_ROWS), NPZ_ROWS)


def write_npz(arrays: DataFrame) -> DataFrame:
    """path and content of one compressed NPZ file for each row (path, and array columns of numbers)."""
    names = [c for c in arrays.columns if c != "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                f = io.BytesIO()
                np.savez_compressed(f, **{n: np.asarray(b.column(b.schema.get_field_index(n))[r].values) for n in names})
                out.append(f.getvalue())
            yield pa.record_batch([b.column(b.schema.get_field_index("path")), pa.array(out, pa.binary())], ["path", "content"])

    return arrays.mapInArrow(run, "path string, content binary")


def _zip(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for m in z.infolist():
            link = (m.external_attr >> 28) == 0xA
            safe = not (m.filename.startswith("/") or ".." in m.filename.split("/") or link)
            yield m.filename, m.file_size, m.CRC, safe


def read_zip(content: DataFrame) -> DataFrame:
    """content (path, content): the members of ZIP files, and whether they may be unpacked below a folder."""
    return content.mapInArrow(_each(_zip, ZIP_ROWS), ZIP_ROWS)


def write_zip(files_: DataFrame) -> DataFrame:
    """path and content of a ZIP file for each row (path, members: array<struct<name, data>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for members in b.column(1).to_pylist():
                f = io.BytesIO()
                with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                    for m in members:
                        z.writestr(zipfile.ZipInfo(m["name"]), m["data"])
                out.append(f.getvalue())
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], ["path", "content"])

    return files_.select("path", "members").mapInArrow(run, "path string, content binary")


def dcd_header(frames: Column, first_step: Column, interval: Column, atoms: Column) -> Column:
    """The header records of a DCD file, as bytes: control block, an empty title and the number of atoms."""
    word = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))
    little = lambda c: F.concat(*[F.substring(word(c), 4 - k, 1) for k in range(4)])
    n = lambda *v: F.concat(*[little(F.lit(x)) for x in v])
    control = F.concat(n(84), F.encode(F.lit("CORD"), "US-ASCII"), little(frames), little(first_step), little(interval), n(*[0] * 17), n(84))
    return F.concat(control, n(4, 0, 4), n(4), little(atoms), n(4))


def _dcd(data: bytes):
    size, magic = struct.unpack_from("<i4s", data)
    if size != 84 or magic != b"CORD":
        raise ValueError("no little-endian DCD header")
    control = struct.unpack_from("<20i", data, 8)
    at = 4 + 84 + 4
    (title,) = struct.unpack_from("<i", data, at)
    (atoms,) = struct.unpack_from("<i", data, at + 4 + title + 4 + 4)
    yield control[0], control[1], control[2], atoms


def read_dcd_headers(content: DataFrame) -> DataFrame:
    """content (path, content): frame count, first step, interval and atoms of DCD files."""
    return content.mapInArrow(_each(_dcd, DCD_ROWS), DCD_ROWS)


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """line of each atom (atom, resid, resname, x, y, z) in the fixed columns of the PDB format, all CA of chain A."""
    n = lambda c, w: F.lpad(F.col(c).cast("string"), w, " ")
    xyz = F.concat(*[F.lpad(F.format_string("%.3f", c), 8, " ") for c in "xyz"])
    line = F.concat(F.lit("ATOM  "), n("atom", 5), F.lit("  CA  "), F.lpad("resname", 3, " "), F.lit(" A"), n("resid", 4), F.lit("    "), xyz)
    return atoms.withColumn("line", line)


def parse_pdb(lines: DataFrame, line: str = "line") -> DataFrame:
    """The CA atoms of PDB lines: serial, resname, chain, resid, x, y, z, by fixed columns."""
    cut = lambda a, b: F.trim(F.substring(line, a, b))
    rows = lines.where(F.startswith(F.col(line), F.lit("ATOM")) & (cut(13, 4) == "CA"))
    return rows.withColumns({
        "serial": cut(7, 5).cast("int"), "resname": cut(18, 3), "chain": cut(22, 1), "resid": cut(23, 4).cast("long"),
        "x": cut(31, 8).cast("double"), "y": cut(39, 8).cast("double"), "z": cut(47, 8).cast("double"),
    })


def digests(content: DataFrame, data: str = "content") -> DataFrame:
    """content with bytes, sha256 and md5 of its data."""
    return content.withColumns({"bytes": F.octet_length(data).cast("long"), "sha256": F.sha2(F.col(data), 256), "md5": F.md5(data)})


def violations(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that don't hold for a row."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))


def audit(spark: SparkSession, phase: str, name: str, rows: DataFrame, columns: list[str], arguments: dict) -> DataFrame:
    """One row for a log: phase, input, rows, sha256 (of the sorted hashes of all rows, in two levels), arguments (JSON), environment, started_utc."""
    import json
    import platform

    each = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)
    # the hashes of a first digit are joined apart; their texts follow each other in order
    parts = rows.select(each.alias("h")).groupBy(F.substring("h", 1, 2).alias("p")).agg(F.array_join(F.array_sort(F.collect_list("h")), "").alias("t"), F.count("*").alias("n"))
    whole = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda s: s["t"]), ""), 256).alias("sha256"))
    environment = F.create_map(*[F.lit(x) for kv in {"spark": spark.version, "python": platform.python_version(), "platform": platform.platform()}.items() for x in kv])
    return whole.select(F.lit(phase).alias("phase"), F.lit(name).alias("input"), "rows", "sha256", F.lit(json.dumps(arguments, sort_keys=True, separators=(",", ":"))).alias("arguments"), environment.alias("environment"), F.current_timestamp().alias("started_utc"))
