"""Operator 7: WARC archives, and the normaliser for monolithic gzip files.

``write_archives`` writes one WARC record per page with Spark's text writer,
which closes each part as one gzip stream over the whole file.  Such a file
cannot be entered in the middle.  ``normalise`` inflates each stream once,
from front to back, rewrites every record as a gzip member of its own, and
``write_normalised`` stores the members with a sidecar index (archive,
offset, length, id, type, digest), so that any record can be read alone: the
members of an archive in the order of their offsets are a valid
``.warc.gz`` file.  ``read_records`` reads members back.

Records of equal payload of at least ``REVISIT_BYTES`` bytes are kept once:
the page of the smallest id is the response, the others are revisit records
that refer to it and carry no payload.  Archives are cut at
``RECORDS_PER_ARCHIVE`` records, so that one file fits into a task.

Defined cases: a null html counts as empty; blanks and control characters
in a url are written as %20 and a null url as an empty one; repeated rows of
the page that is the response are responses, too; a null page_id is written
and read back as null, and refers to the response like any other; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.llm.common import map_arrow, table
from grantlens.session import ensure_parallelism, scratch_path

REVISIT_BYTES = 100
RECORDS_PER_ARCHIVE = 1000
LEVEL = 3
#: Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:page:{}>"


def with_roles(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(id, url, payload, n, digest, refers): refers is null for responses."""
    rows = pages.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest"))
    long_enough = F.col("n") >= REVISIT_BYTES
    first = rows.where(long_enough).groupBy("digest").agg(F.min("id").alias("first"))
    found = rows.join(first, "digest", "left")
    return found.withColumn("refers", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def record_text(refers, key, url, payload, n, digest):
    """The record without the blank lines that close it."""
    def named(x):
        return F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("null")), F.lit(">"))
    revisit = refers.isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit(END))
    body = F.when(revisit, F.lit("")).otherwise(payload)
    return F.concat(
        F.lit(VERSION + "\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), named(key),
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(url, "[\\x00-\\x20\\x7F]", "%20"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), digest,
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: " + PROFILE + "\r\nWARC-Refers-To: "), named(refers))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit(END), http, body)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
                   records: int = RECORDS_PER_ARCHIVE) -> None:
    """Write one record per page; every file is a single gzip stream."""
    rows = with_roles(ensure_parallelism(pages), key, url, html)
    c = F.col
    text = rows.select(record_text(c("refers"), c("id"), c("url"), c("payload"), c("n"), c("digest")).alias("value"))
    (text.write.mode("overwrite").option("compression", "gzip").option("lineSep", END)
         .option("maxRecordsPerFile", records).text(path))


def split_records(stream: bytes):
    """Cut inflated WARC bytes into records, each with the blank lines that close it."""
    at, end = 0, END.encode()
    while at < len(stream):
        head = stream.find(end, at)
        if head < 0 or not stream.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        length = next((int(x.split(b":", 1)[1]) for x in stream[at:head].split(b"\r\n")
                       if x.lower().startswith(b"content-length:")), None)
        stop = head + 4 + (length or 0) + 4
        if length is None or stream[stop - 4:stop] != end:
            raise ValueError(f"the WARC record at byte {at} is cut short")
        yield stream[at:stop]
        at = stop


def inflate(packed: bytes) -> bytes:
    """All members of a gzip file, in one pass."""
    out = []
    while packed:
        d = zlib.decompressobj(31)
        out.append(d.decompress(packed) + d.flush())
        if not d.eof:
            raise ValueError("the gzip stream is cut short")
        packed = d.unused_data
    return b"".join(out)


def as_member(record: bytes, level: int = LEVEL) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def parse(record: bytes) -> dict:
    """Headers (lower-case names), and the payload of the HTTP message inside with its length."""
    head, _, block = record.partition(END.encode())
    out = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:]))
    http, _, body = block[:int(out["content-length"])].partition(END.encode())
    out["http-length"] = next(int(x.split(":")[1]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
    return out | {"payload": body}


def page_of(name: str | None):
    """The page id inside a record id, or None."""
    inner = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner not in ("", "null") else None


MEMBER = "archive string, offset long, length long, id string, type string, digest string, member binary"


def normalise(files: DataFrame) -> DataFrame:
    """From (path, content) of gzip files to one row per record: its member and where it lies."""
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, offset = [], 0
                for record in split_records(inflate(content.as_py())):
                    member, head = as_member(record), parse(record)
                    rows.append((path.rsplit("/", 1)[-1], offset, len(member), head["warc-record-id"], head["warc-type"],
                                 head["warc-payload-digest"], member))
                    offset += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)],
                                                     names=[x.split()[0] for x in MEMBER.split(", ")])

    return map_arrow(files.select("path", "content"), run, MEMBER)


def write_normalised(spark: SparkSession, source: str, target: str) -> None:
    """Normalise the archives in ``source``: members into ``target``/members, the index into ``target``/index."""
    files = spark.read.format("binaryFile").load(source)
    normalise(files).write.mode("overwrite").option("compression", "none").parquet(f"{target}/members")
    members = spark.read.parquet(f"{target}/members")
    members.select("archive", "offset", "length", "id", "type", "digest").write.mode("overwrite").parquet(f"{target}/index")


def read_records(members: DataFrame) -> DataFrame:
    """(id, bytes, digest, type, refers, archive, offset, length); digests of responses are computed from the payload."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for archive, offset, length, member in zip(*(x.to_pylist() for x in batch.slice(at, 200).columns)):
                    r = parse(inflate(member))
                    digest = r["warc-payload-digest"].removeprefix("sha256:")
                    if r["warc-type"] == "response":
                        if hashlib.sha256(r["payload"]).hexdigest() != digest or len(r["payload"]) != r["http-length"]:
                            raise ValueError(f"the payload at {archive}:{offset} is not what its header says")
                    rows.append((page_of(r["warc-record-id"]), r["http-length"], digest, r["warc-type"],
                                 page_of(r.get("warc-refers-to")), archive, offset, length))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                                                 names=["id", "bytes", "digest", "type", "refers", "archive", "offset", "length"])

    return map_arrow(
        members.select("archive", "offset", "length", "member"), run,
        "id long, bytes long, digest string, type string, refers long, archive string, offset long, length long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as read back."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), f"{path}/raw")
    write_normalised(spark, f"{path}/raw", path)
    return read_records(spark.read.parquet(f"{path}/members")).select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers").alias("refers_to"))
