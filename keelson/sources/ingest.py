"""From blobs to the tables of the object model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions import scalar as S
from keelson.runtime import cut

#: The union of the fields of all schema documents that the tables need.
DOCUMENT = (
    "camliVersion int, camliType string, claimType string, claimDate string, permaNode string, camliSigner string, attribute string, value string, target string, "
    "fileName string, unixMtime string, members array<string>, mergeSets array<string>, entries string, symlinkTarget string, random string, "
    "parts array<struct<size:bigint,blobRef:string,bytesRef:string,offset:bigint>>, transitive boolean, expires string, authType string"
)
#: Limits of the chunker in bytes.
MAX_CHUNK, FIRST_CHUNK, MIN_CHUNK = 1 << 20, 256 << 10, 64 << 10
_WINDOW = 64


def sniff(blobs: DataFrame) -> DataFrame:
    """(ref, size, camli_type, mime, doc): blobs (ref, data) that are schema documents, parsed."""
    text = F.when(F.hex(F.substring("data", 1, 1)) == "7B", F.decode("data", "UTF-8"))
    doc = F.from_json(text, DOCUMENT)
    rows = blobs.select("ref", F.octet_length("data").cast("bigint").alias("size"), F.coalesce(doc["camliType"], F.lit("")).alias("camli_type"), S.mime_of_bytes(F.col("data")).alias("mime"), doc.alias("doc"))
    return rows.withColumn("mime", F.when(F.col("camli_type") != "", F.concat(F.lit("application/json; camliType="), F.col("camli_type"))).otherwise(F.col("mime")))


def claims(sniffed: DataFrame) -> DataFrame:
    """Claim rows of claim documents."""
    d = F.col("doc")
    rows = sniffed.where("camli_type = 'claim' and doc.claimType in ('set-attribute', 'add-attribute', 'del-attribute')")
    return rows.select(F.col("ref").alias("claim_ref"), d["permaNode"].alias("permanode"), d["camliSigner"].alias("signer"), S.parsed_time(d["claimDate"]).alias("date"), d["claimType"].alias("ctype"), d["attribute"].alias("attr"), F.coalesce(d["value"], F.lit("")).alias("value")).where("permanode is not null and date is not null")


def deletions(sniffed: DataFrame) -> DataFrame:
    """(target, deleter): delete claims, which count only on permanodes and claims."""
    rows = sniffed.where("camli_type = 'claim' and doc.claimType = 'delete'").select(F.col("doc.target").alias("target"), F.col("ref").alias("deleter"))
    kinds = sniffed.where("camli_type in ('permanode', 'claim')").select(F.col("ref").alias("target"))
    return rows.join(kinds, "target", "left_semi").select("target", "deleter")


def paths(claim_rows: DataFrame) -> DataFrame:
    """Paths from camliPath attributes: active unless the claim deletes."""
    rows = claim_rows.where(F.col("attr").startswith("camliPath:"))
    return rows.select("signer", F.col("permanode").alias("base"), F.expr("try_url_decode(substr(attr, 11))").alias("suffix"), "date", "claim_ref", (F.col("ctype") != "del-attribute").alias("active"), F.col("value").alias("target"))


def set_members(sniffed: DataFrame) -> DataFrame:
    """(set_ref, child_ref) of static sets, through nested sets, to any depth."""
    sets = sniffed.where("camli_type = 'static-set'")
    own = cut(sets.select(F.col("ref").alias("set_ref"), F.explode("doc.members").alias("child_ref")))
    nested = cut(sets.select(F.col("ref").alias("set_ref"), F.explode("doc.mergeSets").alias("inner")))
    found = frontier = own
    while True:
        up = nested.join(frontier.withColumnRenamed("set_ref", "inner"), "inner").select("set_ref", "child_ref").distinct()
        frontier = cut(up.join(found, ["set_ref", "child_ref"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = cut(found.unionByName(frontier))


def directories(sniffed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of files for directories (size: number of entries), and (dir_ref, child_ref)."""
    dirs = sniffed.where("camli_type = 'directory'").select(F.col("ref").alias("dir_ref"), F.col("doc.fileName").alias("file_name"), F.col("doc.entries").alias("set_ref"))
    children = dirs.join(set_members(sniffed), "set_ref").select("dir_ref", "child_ref").distinct()
    count = children.groupBy("dir_ref").agg(F.count("*").alias("n"))
    rows = dirs.join(count, "dir_ref", "left").select(F.col("dir_ref").alias("file_ref"), "file_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("size"))
    return rows, children


def file_chunks(sniffed: DataFrame) -> DataFrame:
    """(file_ref, place, blob_ref, offset, size): the parts of files in order, nested ones expanded.

    ``place`` is an array that sorts as the parts follow each other; a part
    without a blob stands for zeros.
    """
    parts = sniffed.where("camli_type in ('file', 'bytes')").select("ref", F.posexplode("doc.parts").alias("pos", "p")).select("ref", "pos", "p.*")
    parts = cut(parts)
    open_parts = parts.join(sniffed.where("camli_type = 'file'").select("ref"), "ref", "left_semi").select(F.col("ref").alias("file_ref"), F.array("pos").alias("place"), F.col("blobRef").alias("blob_ref"), "bytesRef", F.coalesce("offset", F.lit(0)).alias("offset"), "size")
    done = None
    while True:
        flat = open_parts.where("bytesRef is null").drop("bytesRef")
        done = flat if done is None else done.unionByName(flat)
        inner = parts.select(F.col("ref").alias("bytesRef"), "pos", F.col("blobRef").alias("b"), F.col("bytesRef").alias("by"), F.coalesce("offset", F.lit(0)).alias("o"), F.col("size").alias("s"))
        nested = open_parts.where("bytesRef is not null").join(inner, "bytesRef")
        open_parts = cut(nested.select("file_ref", F.concat("place", F.array("pos")).alias("place"), F.col("b").alias("blob_ref"), F.col("by").alias("bytesRef"), F.col("o").alias("offset"), F.col("s").alias("size")))
        if open_parts.isEmpty():
            return done


def file_sizes(sniffed: DataFrame) -> DataFrame:
    """(ref, size): sum of the sizes of the parts that a file or bytes document names."""
    size = F.aggregate("doc.parts", F.lit(0).cast("bigint"), lambda a, p: a + F.coalesce(p["size"], F.lit(0)))
    return sniffed.where("camli_type in ('file', 'bytes')").select("ref", F.coalesce(size, F.lit(0)).cast("bigint").alias("size"))


def file_pieces(chunks: DataFrame, blobs: DataFrame) -> DataFrame:
    """(file_ref, start, size, data) of files: what is cut out of blobs, by its place in the file.

    Places are sums over the parts' sizes, without the data. Data is null where no
    blob is named, which stands for zeros. No file has to fit into a row.
    """
    before = Window.partitionBy("file_ref").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunks.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    rows = placed.join(blobs.select(F.col("ref").alias("blob_ref"), "data"), "blob_ref", "left")
    return rows.select("file_ref", "start", "size", F.expr("substring(data, cast(offset + 1 as int), cast(size as int))").alias("data"))


def whole_refs(pieces: DataFrame, digest: str = "sha224") -> DataFrame:
    """(file_ref, size, whole_ref): digests of whole files, one piece after the other."""
    import hashlib

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, size, state = None, 0, None
        for pdf in parts:
            done = []
            for ref, n, data in zip(pdf["file_ref"], pdf["size"], pdf["data"], strict=True):
                if ref != name:
                    if state is not None:
                        done.append((name, size, f"{digest}-{state.hexdigest()}"))
                    name, size, state = ref, 0, hashlib.new(digest)
                size += n
                for at in range(0, n, MAX_CHUNK):
                    state.update(bytes(min(MAX_CHUNK, n - at)) if data is None else data[at : at + MAX_CHUNK])
            yield pd.DataFrame(done, columns=["file_ref", "size", "whole_ref"])
        if state is not None:
            yield pd.DataFrame([(name, size, f"{digest}-{state.hexdigest()}")], columns=["file_ref", "size", "whole_ref"])

    ordered = pieces.repartition("file_ref").sortWithinPartitions("file_ref", "start")
    return ordered.mapInPandas(run, "file_ref string, size bigint, whole_ref string")


def missing_parts(sniffed: DataFrame) -> DataFrame:
    """(ref, needed) of documents that name blobs which have not arrived."""
    needs = sniffed.select("ref", F.explode(F.array_union(F.coalesce(F.transform("doc.parts", lambda p: F.coalesce(p["blobRef"], p["bytesRef"])), F.array().cast("array<string>")), F.filter(F.array("doc.entries"), lambda e: e.isNotNull()))).alias("needed")).where("needed is not null")
    return needs.join(sniffed.select(F.col("ref").alias("needed")), "needed", "left_anti").select("ref", "needed")


def file_times(times: Column) -> Column:
    """struct<time, mod_time> of an array of candidate times: earliest, and latest unless they are equal.

    Nulls and the oldest time of the DOS calendar do not count.
    """
    good = F.array_sort(F.filter(times, lambda t: t.isNotNull() & (t != F.lit("1980-01-01 00:00:00").cast("timestamp"))))
    first, last = F.array_min(good), F.array_max(good)
    return F.struct(first.alias("time"), F.when(last != first, last).alias("mod_time"))


def gps(rows: DataFrame) -> DataFrame:
    """Places rounded to seven decimals; those out of range or not numbers are dropped."""
    good = rows.where("not isnan(lat) and not isnan(long) and abs(lat) <= 90 and abs(long) <= 180")
    return good.select("whole_ref", F.round("lat", 7).alias("lat"), F.round("long", 7).alias("long"))


#: Frames of audio files by the tag that they hold.
AUDIO_FRAMES = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TCON": "genre", "TYER": "year", "TDRC": "year", "TRCK": "track", "TPOS": "disc", "TLEN": "durationms"}


def audio_tags_of(data: bytes, digest: str = "sha224") -> dict[str, str]:
    """Tags of MPEG audio: from frames at the beginning, else from the fields at the end, and the digest of what lies between."""
    import hashlib

    got: dict[str, str] = {}
    start, end = 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10 and data[3] in (3, 4):
        packed = lambda b: sum((x & 127) << 7 * (3 - k) for k, x in enumerate(b))
        start = min(len(data), 10 + packed(data[6:10]))
        at = 10
        while at + 10 <= start and data[at : at + 4].strip(b"\0"):
            name, size = data[at : at + 4].decode("latin-1"), packed(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
            body, at = data[at + 10 : at + 10 + size], at + 10 + size
            if not body or body[0] > 3:
                continue
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0]], "replace").rstrip("\0")
            if name == "TXXX":
                label, _, text = text.partition("\0")
                if label.lower() == "musicbrainz album id":
                    got.setdefault("musicbrainzalbumid", text)
            elif name in AUDIO_FRAMES:
                got.setdefault(AUDIO_FRAMES[name], text.split("/")[0] if name in ("TRCK", "TPOS") else text[:4] if name == "TDRC" else text)
    if data[-128:-125] == b"TAG" and end - start >= 128:
        end -= 128
        tail = data[end:]
        field = lambda a, b: tail[a:b].split(b"\0")[0].decode("latin-1").strip()
        for name, value in (("title", field(3, 33)), ("artist", field(33, 63)), ("album", field(63, 93)), ("year", field(93, 97)), ("track", str(tail[126]) if tail[125] == 0 and tail[126] else "")):
            got.setdefault(name, value)
    if (start, end) != (0, len(data)):
        got["mediaref"] = f"{digest}-{hashlib.new(digest, data[start:end]).hexdigest()}"
    return {k: v for k, v in got.items() if v not in ("", "0")}


def audio_tags(files: DataFrame, digest: str = "sha224") -> DataFrame:
    """(ref, tag, value) of MPEG audio files (ref, data)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(ref, k, v) for ref, data in zip(pdf["ref"], pdf["data"], strict=True) for k, v in audio_tags_of(bytes(data), digest).items()]
            yield pd.DataFrame(rows, columns=["ref", "tag", "value"])

    return files.where("data is not null").select("ref", "data").mapInPandas(run, "ref string, tag string, value string")


def chunk_bounds(data: bytes, bits: int = 13) -> list[int]:
    """Ends of content-defined chunks: where a rolling sum over 64 bytes has its low bits set.

    The sum of every window is computed at once; only candidates are walked.
    """
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    x = np.frombuffer(data, np.uint8).astype(np.int64) + 31
    c = np.concatenate((np.zeros(_WINDOW, np.int64), np.cumsum(x)))
    s1 = c[_WINDOW:] - c[:-_WINDOW]
    d = np.concatenate((np.zeros(_WINDOW, np.int64), np.cumsum(s1)))
    s2 = d[_WINDOW:] - d[:-_WINDOW]
    mask = (1 << bits) - 1
    spots = np.flatnonzero(((s1 << 16 | s2 & 0xFFFF) & mask) == mask) + 1
    out, at = [], 0
    while at < n:
        least = at + (FIRST_CHUNK if at == 0 else MIN_CHUNK)
        k = np.searchsorted(spots, least)
        end = min(n, at + MAX_CHUNK, int(spots[k]) if k < len(spots) else n)
        out.append(end)
        at = end
    return out


def chunks(files: DataFrame, digest: str = "sha224") -> DataFrame:
    """(ref, pos, offset, size, chunk_ref) of files (ref, data)."""
    import hashlib

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for ref, data in zip(pdf["ref"], pdf["data"], strict=True):
                at = 0
                for pos, end in enumerate(chunk_bounds(bytes(data))):
                    rows.append((ref, pos, at, end - at, f"{digest}-{hashlib.new(digest, data[at:end]).hexdigest()}"))
                    at = end
            yield pd.DataFrame(rows, columns=["ref", "pos", "offset", "size", "chunk_ref"])

    return files.select("ref", "data").mapInPandas(run, "ref string, pos int, offset bigint, size bigint, chunk_ref string")


def vivify(files: DataFrame, signer: str, date: Column, digest: str = "sha224") -> DataFrame:
    """Claims that give each file an object with its content."""
    permanode = S.ref_of(F.concat(F.lit("permanode:"), F.col("file_ref")).cast("binary"), digest)
    claim = S.ref_of(F.concat(F.lit("claim:"), F.col("file_ref")).cast("binary"), digest)
    return files.select(claim.alias("claim_ref"), permanode.alias("permanode"), F.lit(signer).alias("signer"), date.alias("date"), F.lit("set-attribute").alias("ctype"), F.lit("camliContent").alias("attr"), F.col("file_ref").alias("value"))
