"""Legacy ARC archives: a writer for test input, a converter to WARC, and a WARC reader.

The converter reads whole archive files, takes each record by the header line of its file's version (1: URL, address,
date, type, length; 2: also result code, checksum, location, offset and file name) and the declared length, and makes
an equivalent WARC record: a name-based record id, an ISO timestamp, the record type and SHA-256 digests of block and
payload. Of records with equal payloads of at least REVISIT_BYTES, that with the smallest page id is the response and
the others revisit it by its record id, without the payload.

At scale: archives are written where the rows are, one task writing files one after the other, so no payload is
shuffled. Pages of like size share files, so that a file has about FILE_BYTES at most (or one page), wherever large pages
lie. The decision about each record is made over (file, place, digest) rows; the decisions of a file are joined to it by
its path, as a broadcast up to BROADCAST_REVISITS records and by a shuffle of the compressed files beyond, and the task
that converts a file has them all. Equal payloads meet only as (digest, smallest id) after a map-side combine.

Defined results: a null html is the empty payload, a payload of any length is one record; a null or empty url is
`urn:unknown`; spaces and control characters in urls are percent-encoded. A null page id is left out of the headers,
reads back as null and never is the response that others refer to. Repeated rows of one page id are written each, with
record ids of their own, all with the type of the first; others refer to the first by file and place. No pages make no
records. Columns besides page_id, url and html are not looked at, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, remove, scratch_path

FILE_BYTES = 64 << 20
REVISIT_BYTES = 100
#: Revisits (some 100 bytes each) whose decisions are broadcast to the archives.
BROADCAST_REVISITS = 500_000
#: Sizes of pages that share files: up to each of these, in bytes.
SIZES = (1 << 14, 1 << 18, 1 << 22, 1 << 62)
#: Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _write(rows: DataFrame, head, per: int, path: str, sep: str) -> None:
    """Gzip files of per values each, in the tasks that have the rows; head(name) is put before the first value of a file."""
    place = F.monotonically_increasing_id()  # counts from 0 in each task, below bit 33
    name = F.concat(F.lit("pages-"), F.shiftright(place, 33).cast("string"), F.lit("-"), F.floor(place.bitwiseAND((1 << 33) - 1) / per).cast("string"))
    first = F.pmod(place.bitwiseAND((1 << 33) - 1), F.lit(per)) == 0
    value = F.when(first, F.concat(head(name), F.col("value"))).otherwise(F.col("value"))
    rows.select(value.alias("value")).write.option("maxRecordsPerFile", per).option("lineSep", sep).option("compression", "gzip").text(path)


def write_arc(pages: DataFrame, path: str, per: int, version: int = 2) -> None:
    """pages: page_id, url, payload (string). Files of per records."""
    # percent-encode what would break a header line
    url = F.coalesce("url", F.lit("urn:unknown"))
    encoded = url
    for c in (*range(0x21), 0x7F):
        encoded = F.replace(encoded, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    url = F.when(url == "", "urn:unknown").when(url.rlike(r"[\x00-\x20\x7F]"), encoded).otherwise(url)
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")), F.lit(CRLF))
    date = F.date_format(F.timestamp_seconds(F.lit(1_000_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100_000_000))), "yyyyMMddHHmmss")
    rows = pages.select(url.alias("url"), date.alias("date"), F.concat(head, "payload").alias("body"))
    extra = [] if version == 1 else [F.lit("200"), F.md5("body"), F.lit("-"), F.lit("0"), F.lit("pages.arc")]
    line = F.concat_ws(" ", "url", F.lit("192.0.2.1"), "date", F.lit("text/html"), *extra, F.octet_length("body"))
    about = f"{version} 0 flicker\n{ARC_FIELDS[version]}\n"
    own = f" 0.0.0.0 20010909014640 text/plain{'' if version == 1 else ' 200 - - 0 -'} {len(about)}\n{about}\n"
    _write(rows.select(F.concat(line, F.lit("\n"), "body").alias("value")), lambda name: F.concat(F.lit("filedesc://"), name, F.lit(".arc" + own)), per, path, "\n")


def parse_arc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields, body) of each record after the version block; an empty file has none."""
    if not data:
        return
    end = data.index(b"\n")
    length = int(data[:end].split(b" ")[-1])
    lines = data[end + 1 : end + 1 + length].decode().split("\n")
    names = ARC_FIELDS[int(lines[0].split()[0])].split()
    at = end + 1 + length
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        fields = dict(zip(names, data[at:end].decode().rstrip("\r").split(" "), strict=True))
        size = int(fields["Archive-length"])
        if end + 1 + size > len(data):
            raise ValueError(f"record of {size} bytes at {at} exceeds the file")
        yield fields, data[end + 1 : end + 1 + size]
        at = end + 1 + size


def split_http(block: bytes) -> tuple[bytes, bytes, int | None]:
    """HTTP head with its blank line, payload, and the page id that the head carries."""
    cut = block.find(b"\r\n\r\n")
    head, payload = (block[: cut + 4], block[cut + 4 :]) if cut >= 0 else (b"", block)
    found = re.search(rb"(?mi)^X-Page-Id: (-?\d+)\r$", head)
    return head, payload, int(found[1]) if found else None


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _rows(parse, schema: str):
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in schema.split(", ")]
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_py()
                if path.endswith(".gz"):
                    data = gzip.decompress(data)
                rows, size = [], 0
                for row in parse(data):
                    rows.append(row)
                    size += sum(len(x) for x in row if isinstance(x, bytes))
                    if size > 4 << 20:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of ARC files: page_id, url, address, date (14 digits), head, payload (null if not wanted), payload_bytes, payload_digest, block_digest."""
    schema = "page_id long, url string, address string, date string, head binary, payload binary, payload_bytes long, payload_digest string, block_digest string"

    def parse(data: bytes):
        for f, body in parse_arc(data):
            head, content, page = split_http(body)
            yield page, f["URL"], f["IP-address"], f["Archive-date"], head, content if payload else None, len(content), hashlib.sha256(content).hexdigest(), hashlib.sha256(body).hexdigest()

    return _files(spark, path).mapInArrow(_rows(parse, schema), schema)


def record_id(*parts) -> str:
    """A name-based record id: the same parts always give the same id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def warc_record(fields: dict, body: bytes, place: str, first: tuple[int, str] | None) -> bytes:
    """The WARC record that is equivalent to an ARC record at a place (file and number); a revisit, without payload, of the record of page first[0] at place first[1], if given."""
    head, payload, page = split_http(body)
    again = first is not None
    block = head if again else body
    d = fields["Archive-date"]
    lines = {
        "WARC-Type": "revisit" if again else "response",
        "WARC-Record-ID": record_id("page", page, place),
        "WARC-Date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "WARC-Target-URI": fields["URL"],
        "WARC-IP-Address": fields["IP-address"],
        "WARC-Profile": REVISIT_PROFILE if again else None,
        "WARC-Refers-To": record_id("page", *first) if again else None,
        "WARC-Payload-Digest": "sha256:" + hashlib.sha256(payload).hexdigest(),
        "WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    return ("WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in lines.items() if v is not None) + CRLF).encode() + block


def _place(path: str, nth: int) -> str:
    """A record's place: the file's name below its archive, and the record's number in it."""
    return f"{'/'.join(path.rsplit('/', 2)[-2:])} {nth}"


def _decisions(spark: SparkSession, arc_path: str) -> DataFrame:
    """file, nth, page, place: for each record that revisits another, its file and number in it, and the page and place of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for nth, (_, body) in enumerate(parse_arc(gzip.decompress(content.as_py()))):
                    _, payload, page = split_http(body)
                    if len(payload) >= REVISIT_BYTES:
                        rows.append((path, nth, _place(path, nth), page, hashlib.sha256(payload).hexdigest()))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["file", "nth", "place", "page_id", "digest"])

    large = materialize(_files(spark, arc_path).mapInArrow(run, "file string, nth long, place string, page_id long, digest string"), "digests")
    some = F.min(F.when(F.col("page_id").isNotNull(), F.struct(F.col("page_id").alias("page"), "place"))).alias("first")
    first = large.groupBy("digest").agg(some, F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first.*")
    again = large.drop("place").join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("page")))
    return materialize(again.select("file", "nth", "page", "place"), "decisions")


def convert(spark: SparkSession, arc_path: str, warc_path: str, per: int) -> None:
    """Writes WARC files of per records for the records of ARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, revisits in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                to = {x["nth"]: (x["page"], x["place"]) for x in revisits or []}
                out, size = [], 0
                for nth, (fields, body) in enumerate(parse_arc(gzip.decompress(content.as_py()))):
                    out.append(warc_record(fields, body, _place(path, nth), to.get(nth)))
                    size += len(out[-1])
                    if size > 4 << 20:
                        yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
                if out:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    again = _decisions(spark, arc_path)
    small = again.count() <= BROADCAST_REVISITS
    again = again.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("nth", "page", "place")).alias("revisits"))
    files = _files(spark, arc_path).join(F.broadcast(again) if small else again, "path", "left")
    rows = files.select("path", "content", "revisits").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    about = f"software: flicker{CRLF}format: WARC File Format 1.1{CRLF}"
    tail = f"{CRLF}WARC-Date: 2001-09-09T01:46:40Z{CRLF}Content-Type: application/warc-fields{CRLF}Content-Length: {len(about)}{CRLF}{CRLF}{about}{CRLF}{CRLF}"
    named = lambda name: [F.substring(F.sha2(name, 256), a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    info = lambda name: F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:uuid:"), F.concat_ws("-", named(name)[0], named(name)[1], F.concat(F.lit("5"), named(name)[2]), F.concat(F.lit("8"), named(name)[3]), named(name)[4]), F.lit(">" + tail))
    _write(rows, info, per, warc_path, CRLF + CRLF)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """type, record_id, refers_to_id, page_id, url, date, payload (null for revisits), payload_bytes, payload_digest of the response and revisit records."""
    schema = "type string, record_id string, refers_to_id string, page_id long, url string, date string, payload binary, payload_bytes long, payload_digest string"

    def parse(data: bytes):
        for f, block in parse_warc(data):
            if f["warc-type"] not in ("response", "revisit"):
                continue
            _, payload, page = split_http(block)
            stated = f["warc-payload-digest"].removeprefix("sha256:")
            if f["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != stated:
                raise ValueError(f"payload of {f['warc-record-id']} doesn't match its digest")
            whole = f["warc-type"] == "response"
            yield f["warc-type"], f["warc-record-id"], f.get("warc-refers-to"), page, f["warc-target-uri"], f["warc-date"], payload if whole else None, len(payload) if whole else None, stated

    return _files(spark, path).mapInArrow(_rows(parse, schema), schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes pages as ARC, converts them to WARC, reads these: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    # pages of like size share files, so the size of a file follows from the number of its pages
    size = F.octet_length("payload") + 400
    kind = F.lit(0)
    for most in SIZES[:-1]:
        kind = kind + (size > most).cast("int")
    sizes = {r[0]: r[1] for r in pages.groupBy(kind.alias("kind")).agg(F.max(size)).collect()}  # at most one row for each of SIZES
    records = None
    for k, largest in sorted(sizes.items()):  # equal payloads are of one size
        arc, warc, per = scratch_path(spark, "arc"), scratch_path(spark, "warc"), max(1, FILE_BYTES // largest)
        write_arc(pages.where(kind == k), arc, per)
        convert(spark, arc, warc, per)
        some = materialize(read_warc(spark, warc).drop("payload", "url", "date"), "records")
        remove(spark, arc)
        remove(spark, warc)
        records = some if records is None else records.unionByName(some)
    if records is None:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    whole = records.where("type = 'response' and page_id is not null").groupBy("record_id").agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("bytes"))
    out = records.join(whole.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left")
    return out.select("page_id", F.coalesce("payload_bytes", "bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), "refers_to")
