"""Scalar functions as column expressions; every predicate is true or false, never null."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.runtime import QueryError

#: Digest names and their hex lengths; other names are accepted as they are.
DIGEST_HEX = {"sha1": 40, "sha224": 56, "sha256": 64}
REF_PATTERN = r"^[a-z0-9]+-[0-9a-f]+$"
REF_IN_TEXT = r"\b[a-z0-9]+-[0-9a-f]{2,}\b"
#: File types by extension.
MIME_BY_EXTENSION = {
    ".avi": "video/x-msvideo", ".css": "text/css", ".gif": "image/gif", ".heic": "image/heic", ".htm": "text/html", ".html": "text/html", ".jpeg": "image/jpeg", ".jpg": "image/jpeg",
    ".js": "text/javascript", ".json": "application/json", ".m4v": "video/mp4", ".mkv": "video/x-matroska", ".mov": "video/quicktime", ".mp3": "audio/mpeg", ".mp4": "video/mp4",
    ".mpeg": "video/mpeg", ".mpg": "video/mpeg", ".ogv": "video/ogg", ".pdf": "application/pdf", ".png": "image/png", ".svg": "image/svg+xml", ".txt": "text/plain", ".webm": "video/webm", ".xml": "text/xml", ".zip": "application/zip",
}
#: First bytes as hex, and the file type they tell; the first match counts.
MAGIC_HEX = (
    ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("ffd8ff", "image/jpeg"), ("89504e470d0a1a0a", "image/png"), ("49492a00", "image/tiff"), ("4d4d002a", "image/tiff"), ("424d", "image/bmp"),
    ("25504446", "application/pdf"), ("504b0304", "application/zip"), ("1f8b08", "application/gzip"), ("494433", "audio/mpeg"), ("664c6143", "audio/x-flac"), ("4f676753", "audio/ogg"), ("1a45dfa3", "video/webm"),
)
_TIME_BASE = "0000-01-01T00:00:00Z"


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_ref(v: Column) -> Column:
    """Whether text is a reference: a name, a dash and hex digits, as many as a known digest has."""
    name = F.substring_index(v, "-", 1)
    size = F.length(v) - F.length(name) - 1
    known = F.lit(True)
    for digest, n in DIGEST_HEX.items():
        known &= (name != digest) | (size == n)
    return true(v.rlike(REF_PATTERN) & known)


def ref_prefix(ref: Column, prefix: str) -> Column:
    """References that start with a digest name and at least one hex digit; else none."""
    return true(ref.startswith(prefix)) if re.match(r"[a-z0-9]+-[0-9a-f]+$", prefix) else F.lit(False)


def refs_in(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(REF_IN_TEXT), F.lit(0)), is_ref)


def ref_of(data: Column, digest: str = "sha224") -> Column:
    return F.concat(F.lit(f"{digest}-"), F.sha1(data) if digest == "sha1" else F.sha2(data, int(digest[3:])))


def sum32(ref: Column) -> Column:
    """The first 32 bits of a reference's digest."""
    return F.conv(F.substring(F.substring_index(ref, "-", -1), 1, 8), 16, 10).cast("bigint")


def parsed_int(v: Column) -> Column:
    return F.when(v.rlike(r"^[+-]?[0-9]+$"), v.try_cast("bigint"))


def parsed_float(v: Column) -> Column:
    return F.when(v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"), v.try_cast("double"))


def parsed_time(v: Column) -> Column:
    """RFC 3339 text as a timestamp, null if it is none."""
    return F.when(v.rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(v))


def time_of_prefix(when: str) -> datetime:
    """The start of the time that a prefix of RFC 3339 text names."""
    full = when + _TIME_BASE[len(when) :] if len(when) < len(_TIME_BASE) else when
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", full):
        raise QueryError(f'parsing time "{full}" as "2006-01-02T15:04:05Z07:00"')
    try:
        return datetime.fromisoformat(full.replace("Z", "+00:00")).astimezone(UTC)
    except (ValueError, OverflowError):
        if full.startswith("0000"):
            return datetime(1, 1, 1, tzinfo=UTC)
        raise QueryError(f'parsing time "{full}" as "2006-01-02T15:04:05Z07:00"') from None


def int_test(v: Column, c: dict) -> Column:
    if "equals" in c:
        return true(v == c["equals"])
    out = v.isNotNull()
    if c.get("min") or c.get("zeroMin"):
        out &= v >= c.get("min", 0)
    if c.get("max") or c.get("zeroMax"):
        out &= v <= c.get("max", 0)
    return true(out)


def float_test(v: Column, c: dict) -> Column:
    """Bounds are inclusive; what is not a number is never out of bounds."""
    out = F.lit(True)
    if c.get("min") or c.get("zeroMin"):
        out &= v >= c.get("min", 0.0)
    if c.get("max") or c.get("zeroMax"):
        out &= v <= c.get("max", 0.0)
    return true(v.isNotNull() & (F.isnan(v) | out))


def _valid_pattern(pattern: str) -> bool:
    """Patterns of the dialect without look-around and back references that also compile."""
    if re.search(r"\(\?[=!]|\(\?<[=!]|\(\?>|\\[1-9]|[*+?}]\+", pattern):
        return False
    try:
        re.compile(re.sub(r"\\[pP]\{\w+\}|\\[pP]\w|\\z|\\Q|\\E", ".", pattern))
    except re.error:
        return False
    return True


def string_test(v: Column, c: dict) -> Column:
    out = v.isNotNull()
    if c.get("empty"):
        out &= v == ""
    if c.get("byteLength"):
        out &= int_test(F.octet_length(v), c["byteLength"])
    if c.get("regexp"):  # excludes the tests below
        return true(out & (v.rlike(c["regexp"]) if _valid_pattern(c["regexp"]) else F.lit(False)))
    fold = F.lower if c.get("caseInsensitive") else lambda x: x
    low = str.lower if c.get("caseInsensitive") else str
    if c.get("equals"):
        out &= fold(v) == low(c["equals"])
    if c.get("contains"):
        out &= fold(v).contains(low(c["contains"]))
    if c.get("hasPrefix"):
        out &= fold(v).startswith(low(c["hasPrefix"]))
    if c.get("hasSuffix"):
        out &= fold(v).endswith(low(c["hasSuffix"]))
    return true(out)


def time_test(t: Column, c: dict, now: datetime) -> Column:
    """Before is exclusive, after inclusive; ``inLast`` (seconds) counts only without after."""
    out = t.isNotNull()
    after = c.get("after")
    if not after and c.get("inLast", 0) > 0:
        after = datetime.fromtimestamp(now.timestamp() - c["inLast"], UTC)
    if c.get("before"):
        out &= t < F.lit(c["before"])
    if after:
        out &= t >= F.lit(after)
    return true(out)


def mime_of_extension(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))
    pairs = [F.lit(x) for pair in MIME_BY_EXTENSION.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.lit(""))


def mime_of_bytes(data: Column) -> Column:
    head = F.lower(F.hex(F.substring(data, 1, 16)))
    out = None
    for magic, mime in MAGIC_HEX:
        out = F.when(head.startswith(magic), mime) if out is None else out.when(head.startswith(magic), mime)
    riff = F.substring(head, 17, 8)
    box = F.substring(head, 9, 16)
    out = out.when(head.startswith("52494646") & (riff == "57454250"), "image/webp").when(head.startswith("52494646") & (riff == "41564920"), "video/x-msvideo")
    out = out.when(box.isin("6674797068656963", "667479706d696631", "6674797068656978"), "image/heic").when(F.substring(box, 1, 8) == "66747970", "video/mp4")
    return F.coalesce(out, F.lit(""))


def scaled_size(width: Column, height: Column, max_width: int, max_height: int) -> Column:
    """struct<w, h> that fits into the box, with the sides' ratio, never larger than before."""
    w, h = width.cast("double"), height.cast("double")
    ratio = F.least(F.lit(1.0), F.try_divide(F.lit(float(max_width)), w), F.try_divide(F.lit(float(max_height)), h))
    return F.struct(F.floor(w * ratio).cast("int").alias("w"), F.floor(h * ratio).cast("int").alias("h"))


def go_text(value: str) -> str:
    """Text in double quotes for messages."""
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
