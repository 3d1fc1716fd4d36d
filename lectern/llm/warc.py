"""WARC archives: one gzip member per record, and a sequential reader.

Spark's text writer puts the archives into any file system: a row is an archive,
gzip members one after another, and makes a file of its own; the line separator
is an empty gzip member, which readers pass over. A row is closed before it
would exceed `bytes_per_file`, so a file holds that much or one record. Files
come back through binaryFile and are read member by member without a copy.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ._shared import fresh_path, small_rows

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVED_AT = "2024-01-01T00:00:00Z"
#: A gzip member without content; between records, so that rows need no line end.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003") + bytes.fromhex("03000000000000000000")
RECORDS_PER_FILE, BYTES_PER_FILE = 5000, 16 << 20


class WarcError(ValueError):
    """A record whose framing, length or digest is wrong."""


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response, or, where refers_to isn't None, a revisit without the payload; as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", ARCHIVED_AT)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(url.split())))
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        head.append(("X-Page", str(page_id)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text + block + b"\r\n\r\n") + packer.flush()


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of each gzip member in turn; the input (bytes or a view of them) is fed in steps, and what a member leaves begins the next."""
    data, at, rest = memoryview(data), 0, b""
    while at < len(data) or rest:
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            fed = rest or data[at : at + step]
            if not rest:
                at += len(fed)
            if not fed:
                raise WarcError("the archive ends inside a record")
            out.append(inflate.decompress(fed))
            rest = b""
        rest = inflate.unused_data
        if rest.strip(b"\r\n") == b"" and at >= len(data):
            rest = b""
        yield b"".join(out)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block); Content-Length frames the block and both digests are verified."""
    head, found, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not found or not version.startswith(b"WARC/1."):
        raise WarcError("not a WARC record")
    fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}
    size = int(fields.get("content-length", "-1"))
    block = rest[:size]
    if size < 0 or len(block) != size or rest[size:] != b"\r\n\r\n":
        raise WarcError("Content-Length and block don't agree")
    if fields.get("warc-block-digest", "sha1:" + payload_digest(block)) != "sha1:" + payload_digest(block):
        raise WarcError("block digest is wrong")
    if fields.get("warc-type") == "response" and "warc-payload-digest" in fields:
        payload = block.partition(b"\r\n\r\n")[2]
        if fields["warc-payload-digest"] != "sha1:" + payload_digest(payload):
            raise WarcError("payload digest is wrong")
    return fields, block


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for member in members(data):
        if member:
            yield parse_record(member)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, records_per_file: int = RECORDS_PER_FILE, bytes_per_file: int = BYTES_PER_FILE) -> None:
    """A record per row. Among payloads of at least `least` bytes that are equal, rows with the smallest id are responses, the others revisit it.

    A null payload is empty; a null id is larger than any, and rows that have
    nothing but null ids are all responses; repeated rows give a record each;
    an empty table gives no archive; other columns are ignored.
    """
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    hashed = named.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    firsts = hashed.where(F.col("size") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = hashed.join(firsts, "sha", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("size") >= least), F.col("first"))
    rows = marked.select("page_id", "url", "html", "sha", refers.alias("refers_to"))
    schema = StructType([StructField("member", BinaryType())])

    def run(batches):
        held, size = [], 0
        archive = lambda: pa.RecordBatch.from_arrays([pa.array([EMPTY_MEMBER.join(held)], type=pa.binary())], names=["member"])
        for batch in small_rows(batches, 200):
            for page_id, url, html, sha, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                member = make_record(page_id, url, payload, digest, refers_to)
                if held and (len(held) == records_per_file or size + len(member) > bytes_per_file):
                    yield archive()
                    held, size = [], 0
                held.append(member)
                size += len(member) + len(EMPTY_MEMBER)
        if held:
            yield archive()

    made = rows.mapInArrow(run, schema).select(F.col("member").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


FOUND = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()), StructField("record_type", StringType()), StructField("refers_to", LongType()), StructField("payload", BinaryType())])


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of all archives under path; a revisit's payload bytes come from its kept HTTP header. A damaged record fails the read."""
    arrow = to_arrow_schema(FOUND)
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for fields, block in read_records(data.as_buffer()):
                    if len(rows) == 2000:
                        yield pack(rows)
                        rows = []
                    http, _, payload = block.partition(b"\r\n\r\n")
                    lengths = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    number = lambda k: int(fields[k]) if k in fields else None  # noqa: E731, B023
                    rows.append((number("x-page"), fields.get("warc-target-uri"), int(lengths[0]) if lengths else len(payload), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], number("x-refers-to-page"), payload if with_payload else None))
                if rows:
                    yield pack(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = files.mapInArrow(run, FOUND)
    return found if with_payload else found.drop("payload")


def check_revisits(found: DataFrame) -> DataFrame:
    """The revisits of read_archives() whose response is missing or has another digest: none in a sound archive."""
    responses = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest")).distinct()
    sound = found.where("record_type = 'revisit'").join(responses, "refers_to", "left")
    return sound.groupBy(*found.columns).agg(F.max(F.coalesce(F.col("digest") == F.col("payload_digest"), F.lit(False))).alias("sound")).where("not sound").drop("sound")


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back; with an empty table, no rows."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
