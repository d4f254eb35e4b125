"""WARC archives: write pages as records and read them back by boundary-chain verification.

Writing: of pages with equal payloads the one with the largest id becomes a
response, the others revisit it. Archives are plain files of concatenated
records in the shared folder, each of a bounded number of records.

Reading: tasks look for every place in an archive that could start a record and
emit candidate -> successor offsets from its length header. Pointer jumping from
offset 0 doubles the reach each round and keeps only candidates on the chain of
true boundaries, so record starts faked inside payloads are rejected.

Defined results: a null payload is an empty one. Pages without id are always
responses and come back with a null id. Rows that share the largest id of their
payload are all responses. Repeated rows come back as often as they occur, and
rows of one id with different payloads are pages of their own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import common as C

MAGIC = b"WARC/1.1\r\n"
#: Records a file if none is larger than SMALL_BYTES; half as many whenever the bound on their size doubles.
FILE_RECORDS = 1000
SMALL_BYTES = 64 << 10
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_head(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[str, bytes]:
    """Header of a record and the block that follows it (empty for a revisit)."""
    revisit = refers_to is not None
    block = b"" if revisit else _HTTP + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")),
        ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    else:
        fields.append(("Content-Type", "application/http; msgtype=response"))
    fields.append(("Content-Length", str(len(block))))
    return MAGIC.decode() + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n", block


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload a page with a larger id also has.

    Only digests and ids are shuffled; a payload's largest id is pre-aggregated,
    and its copies meet it in a join that splits hot keys.
    """
    small = pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size")).where(F.col("page_id").isNotNull() & (F.col("size") >= min_bytes))
    best = small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("refers_to > least").drop("least")
    return small.join(best, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write (page_id, url, html) as archives below ``path`` through Spark's text writer.

    Pages are written by classes of their size, of which there are a few dozen at
    most, so that a file has about FILE_RECORDS * SMALL_BYTES bytes at most, or
    one record.
    """
    C.small_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    again = C.checked_broadcast(C.cut(revisits(pages, min_bytes)))
    size = F.octet_length("html") + F.coalesce(F.octet_length("url"), F.lit(0))
    pages = pages.withColumn("class", F.when(size <= SMALL_BYTES, 0).otherwise(F.ceil(F.log2(size / SMALL_BYTES))).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, url, html, to in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                head, block = record_head(page_id, url, html.encode(), to)
                out.append(head.encode() + block)
            yield pa.record_batch([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])

    for k in sorted(r["class"] for r in pages.select("class").distinct().collect()) or [0]:
        rows = pages.where(F.col("class") == k).withColumn("digest", F.sha1(F.col("html").cast("binary"))).join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
        rows.mapInArrow(run, "value string").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, FILE_RECORDS >> k)).text(f"{path}/class-{k}")


class ArchiveError(ValueError):
    """An archive whose chain of records does not end where the file does."""


def _long(pattern: bytes, value: bytes | None) -> int | None:
    """The number in a field, or None: fields of faked records can hold anything."""
    m = re.fullmatch(pattern, value or b"")
    number = int(m[1]) if m and len(m[1]) <= 20 else None
    return number if number is not None and -(2**63) <= number < 2**63 else None


def _page(value: bytes | None) -> int | None:
    return _long(rb"<urn:page:(-?\d+)>", value)


def candidates(content: bytes) -> Iterator[tuple]:
    """Everything in an archive that could be a record: offset, successor and fields."""
    at = content.find(MAGIC)
    while at >= 0:
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = {k.lower(): v for k, v in _FIELD.findall(content, at + len(MAGIC), end + 2)}
        size = _long(rb"(\d+)", fields.get(b"content-length"))
        stop = -1 if size is None else end + 4 + size
        kind = fields.get(b"warc-type", b"")
        if 0 <= stop <= len(content) - 4 and content[stop : stop + 4] == b"\r\n\r\n" and kind in (b"response", b"revisit"):
            if kind == b"response":
                body = content.find(b"\r\n\r\n", end + 4, stop)
                payload = content[body + 4 : stop] if body >= 0 else b""
                length, digest = len(payload), digest32(payload)
            else:
                length, digest = _long(rb"(\d+)", fields.get(b"warc-payload-length")), fields.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode()
            yield at, stop + 4, _page(fields.get(b"warc-record-id")), length, digest, kind.decode(), _page(fields.get(b"warc-refers-to"))
        at = content.find(MAGIC, at + 1)


def reachable(links: DataFrame) -> DataFrame:
    """(file, at) on the chain from offset 0 of each file, of links (file, at, next).

    Pointers that end at no candidate are left out first. Round k adds what lies
    2^k records after a known boundary and doubles the pointers: as many rounds as
    the logarithm of a file's records. Each round is cut by a checkpoint.
    """
    links = links.select("file", "at", "next").distinct()
    known = C.cut(links.where("at = 0").select("file", "at"))
    jumps = C.cut(links.join(links.select("file", F.col("at").alias("next")), ["file", "next"], "left_semi"))
    size = known.count()
    while True:
        ahead = known.join(jumps, ["file", "at"]).select("file", F.col("next").alias("at"))
        known = C.cut(known.unionByName(ahead).distinct())
        if (now := known.count()) == size:
            return known
        size = now
        then = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        jumps = C.cut(jumps.join(then, ["file", "next"]).select("file", "at", F.col("after").alias("next")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each true record.

    An archive in which the chain breaks off before the end is an error, since
    the records behind the break are lost.
    """
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    source = source.withColumn("file", F.regexp_extract("path", "[^/]+/[^/]+$", 0))
    files = source.select("file", "content")
    schema = "file string, at long, next long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for i in range(b.num_rows):
                rows = [(b.column(0)[i].as_py(), *x) for x in candidates(b.column(1)[i].as_py())]
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    found = C.cut(files.mapInArrow(run, schema))  # no payloads, a few fields a candidate
    true = found.join(reachable(found), ["file", "at"], "left_semi")
    ends = source.select("file", "length").join(true.groupBy("file").agg(F.max("next").alias("end")), "file", "left")
    broken = ends.where("end is null or end <> length").orderBy("file").limit(10).collect()
    if broken:
        raise ArchiveError("; ".join(f"{r['file']}: the chain ends at byte {r['end'] or 0} of {r['length']}" for r in broken))
    return true.drop("file", "at", "next")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{C.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    records = C.cut(read_archives(spark, path))
    C.remove(spark, path)
    return records
