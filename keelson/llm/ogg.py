"""Ogg media columns: write payloads as multiplexed Ogg files and read them back.

Each file interleaves two logical streams: 8-bit mono samples in packets of 576
samples, whose pages carry the sample count as granule position, and a marks
stream with one packet a page of samples. Reading verifies the checksum of each
page, demultiplexes by serial number, checks page sequence numbers, reassembles
packets from lacing values (packets may span pages) and derives timestamps from
granule positions.

Defined results: null and empty texts give one packet of 255s; equal texts give
equal files, since serial numbers come from the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from keelson.llm import common as C

SAMPLES = 576
RATE = 8000
#: Samples a page; a page holds at most 255 lacing values, of which a packet takes three.
PAGE_PACKETS = 64
_HEAD = struct.Struct("<4sBBqIII B".replace(" ", ""))
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, not reflected, start and final value 0.

    It is the mirror image of zlib's reflected CRC over mirrored bytes.
    """
    mirrored = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_FLIP), "big")


def lacing(size: int) -> bytes:
    """Lacing values of a packet: 255s and a smaller last one, 0 if need be."""
    return b"\xff" * (size // 255) + bytes([size % 255])


def page(flags: int, granule: int, serial: int, number: int, laces: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(laces)) + laces
    crc = page_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def write_ogg(payload: bytes) -> bytes:
    """An Ogg file of two logical streams; ``payload`` is a multiple of 576 bytes."""
    serial = zlib.crc32(payload) & 0x7FFFFFFE
    marks = serial + 1
    head = b"PCM8" + struct.pack("<IHQ", RATE, SAMPLES, len(payload))
    out = [page(2, 0, serial, 0, lacing(len(head)), head), page(2, 0, marks, 0, lacing(4), b"MARK")]
    step, number = PAGE_PACKETS * SAMPLES, 1
    laces = lacing(SAMPLES)
    for at in range(0, len(payload), step):
        body = payload[at : at + step]
        last = 4 * (at + step >= len(payload))
        done = at + len(body)
        out.append(page(last, done, serial, number, laces * (len(body) // SAMPLES), body))
        mark = struct.pack("<Q", done)
        out.append(page(last, done, marks, number, lacing(8), mark))
        number += 1
    return b"".join(out)


class OggError(ValueError):
    """A page that is cut off, out of order or whose checksum is wrong."""


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, number, lacing values, body) of each verified page."""
    at = 0
    while at < len(media):
        if len(media) - at < 27:
            raise OggError("page header is cut off")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        laces = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(laces)
        if end > len(media) or len(laces) < n:
            raise OggError("page is cut off")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at} is wrong")
        yield flags, granule, serial, number, laces, media[at + 27 + n : end]
        at = end


def read_ogg(media: bytes) -> dict[int, dict]:
    """By serial number: packets, (granule, seconds) of pages on which a packet ends, pages."""
    streams: dict[int, dict] = {}
    for flags, granule, serial, number, laces, body in read_pages(media):
        if flags & 2:
            if serial in streams:
                raise OggError("two streams have one serial number")
            streams[serial] = {"packets": [], "times": [], "pages": 0, "open": b"", "ended": False}
        s = streams.get(serial)
        if s is None or s["ended"] or number != s["pages"] or bool(flags & 1) != bool(s["open"]):
            raise OggError("page out of order")
        at, start = 0, 0
        for lace in laces:
            at += lace
            if lace < 255:
                s["packets"].append(s["open"] + body[start:at])
                s["open"], start = b"", at
        s["open"] += body[start:at]
        s["pages"] += 1
        s["ended"] = bool(flags & 4)
        if granule >= 0:
            s["times"].append((granule, granule / RATE))
    if any(s["open"] or not s["ended"] for s in streams.values()):
        raise OggError("a stream does not end")
    return streams


def samples_of(streams: dict[int, dict]) -> tuple[bytes, dict]:
    """Payload of the sample stream, its packets cut by its header's length, and the stream."""
    for s in streams.values():
        head = s["packets"][0]
        if head[:4] == b"PCM8":
            _, _, size = struct.unpack("<IHQ", head[4:18])
            payload = b"".join(s["packets"][1:])
            if len(payload) != size or s["times"][-1][0] != size:
                raise OggError("samples are missing")
            return payload, s
    raise OggError("no sample stream")


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % SAMPLES if text else SAMPLES)


def ogg_media(documents: DataFrame, keep_media: bool = False) -> DataFrame:
    """Store every whole text as Ogg, read the stored bytes back and describe them.

    With ``keep_media`` the media column (binary) is returned too.
    """
    docs = C.texts(documents)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", media binary" * keep_media
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in C.slices(batches):
            rows = []
            raw = buf.tobytes()
            for i in range(batch.num_rows):
                text = raw[offs[i] : offs[i + 1]]
                media = write_ogg(payload_of(text))
                streams = read_ogg(media)
                back, s = samples_of(streams)
                mean = sum(back) / len(back)
                feature = f"streams={len(streams)};pages={sum(x['pages'] for x in streams.values())};packets={len(s['packets']) - 1};seconds={s['times'][-1][1]:.6f};mean={mean:.4f}"
                row = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                rows.append(row + (media,) * keep_media)
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names=names)

    return docs.mapInArrow(run, schema)
