"""Exact removal of repeated passages with suffix arrays of distributed collections.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. Equal strings must meet in one task without all
suffixes being shuffled, so each window is represented by its anchors: the
32-byte words in it whose hash is smallest among 19 in a row. Equal windows have
equal anchors, and about every tenth byte starts one.

1. Tasks send the hashes of anchors, once a block of documents and bucket of
   hashes; buckets report those that occur in two documents or more.
2. Blocks send, for shared anchors, the 18 bytes on either side (all that a
   window around the anchor can hold), once for equal surroundings, with the
   smallest doc_id there.
3. Buckets collapse equal surroundings. Where an anchor has several, a
   collection of them (the anchor as one symbol of weight 32 between its flanks)
   is sorted column by column (``bcr``): neighbours with a common prefix of 50
   are equal windows, and each surrounding learns the smallest document of each
   of its windows.
4. Blocks mark windows in the documents and cut the bytes out.

Documents travel as compressed blocks of bounded size, which the steps share.
Every group is a block or a bucket whose number grows with the bytes of the
input; hot anchors are pre-aggregated by block before they are shuffled. What is
sent to buckets goes through a second level if there are more buckets than a task
can make blobs for. An anchor that very many blocks have is split by the bytes
beside it: a window has 9 bytes after the anchor or 10 before it, and equal
windows have the same ones, so each such surrounding goes to the bucket of either
side for the windows of this side.

Defined results: a null text is an empty one; texts under 50 bytes are kept
whole. Rows without id are kept whole and are nobody's earlier document. Rows
that share a doc_id do not remove each other's text. ``kept`` is binary, since
a cut may fall inside a character.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keelson.llm import bcr
from keelson.llm import common as C

LENGTH = 50
WORD = 32
FLANK = LENGTH - WORD  # 18; a window holds FLANK + 1 words
#: Bytes of text a block is meant to hold; a longer text is a block with others.
BLOCK_BYTES = 8 << 20
#: Bytes of text in which anchors are searched at once (a longer single text is one step); a byte needs about 70.
SEARCH_BYTES = 1 << 19
#: Sequences sorted in one collection; each has one anchor, and symbols have 16 bits.
COLLECTION_ROWS = 20_000
#: Buckets for which one task makes blobs; beyond them a blob goes to a range of buckets first.
FAN = 2048
#: Bytes that a task of the second level gathers before it deals them to buckets.
GATHER_BYTES = 64 << 20
#: Blocks with one anchor from which on it is split; bytes after it and before it by which it is.
HOT_BLOCKS = 4096
AFTER, BEFORE = FLANK // 2, FLANK - FLANK // 2 + 1
_TOP = np.uint64(2**64 - 1)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def packed(**arrays: np.ndarray) -> bytes:
    """Named arrays as one compressed blob."""
    out = [struct.pack("<H", len(arrays))]
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a)
        label = f"{name}:{raw.dtype.str}".encode()
        out += [struct.pack("<HQ", len(label), raw.nbytes), label, raw.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,), at, out = struct.unpack_from("<H", raw), 2, {}
    for _ in range(n):
        size, nbytes = struct.unpack_from("<HQ", raw, at)
        label, kind = raw[at + 10 : at + 10 + size].decode().split(":")
        at += 10 + size
        out[label] = np.frombuffer(raw, np.dtype(kind), count=nbytes // np.dtype(kind).itemsize, offset=at)
        at += nbytes
    return out


def _row_lists(a: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
    """Arrays with one entry, or one row of entries, for each of n rows."""
    return {k: x.reshape(n, -1) if len(x) != n else x for k, x in a.items()}


def dealt(bucket: np.ndarray, buckets: int, fan: int, **arrays: np.ndarray) -> list[tuple[int, bytes]]:
    """(key, blob) of rows by bucket, or by ranges of buckets (then with the bucket) if there are many."""
    width = -(-buckets // fan)
    if width > 1:
        arrays["bucket"] = bucket.astype(np.uint32)
        bucket = bucket // width
    by = np.argsort(bucket, kind="stable")
    return [(b, packed(**{k: x[by[s]].ravel() for k, x in arrays.items()})) for b, s in _split(bucket[by].astype(np.int64))]


def second_level(sent: DataFrame, buckets: int) -> DataFrame:
    """(key, blob) by bucket of what was sent to ranges of buckets.

    Tasks stream over whole ranges, however many blobs these have, and deal what
    they gathered; each range has FAN buckets or fewer if there are up to FAN * FAN.
    """
    if buckets <= FAN:
        return sent
    limit = GATHER_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            got = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            bucket = got.pop("bucket").astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            return _rows(*_KEYED, [(b, packed(**{k: x[by[s]].ravel() for k, x in got.items()})) for b, s in _split(bucket[by])])

        for batch in batches:
            for blob in batch.column(1):
                a = unpacked(blob.as_py())
                a = _row_lists(a, len(a["bucket"]))
                held.append(a)
                size += sum(x.nbytes for x in a.values())
                if size >= limit:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return sent.repartition("key").mapInArrow(run, "key long, blob binary")


def block_of(doc_id: np.ndarray, blocks: int) -> np.ndarray:
    return (C.mix(doc_id.astype(np.int64).view(np.uint64).copy()) % np.uint64(blocks)).astype(np.int64)


def code_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of an anchor hash in the upper half, tag within it in the lower."""
    return (h & _LOW) % np.uint64(buckets) << _32 | h >> _32


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and documents of anchors, and the prefix hash of the bytes."""
    prefix = C.prefix_hash(buf)
    m = len(buf) - WORD + 1
    if m <= 0:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z, prefix
    h = prefix[WORD:] - prefix[:-WORD]
    h *= C.powers(len(prefix), C._INV)[:m]
    h = C.mix(h)
    ok, whole = np.ones(m, bool), np.ones(m, bool)
    for end in offs[1:]:
        ok[max(0, end - WORD + 1) : end] = False
        whole[max(0, end - LENGTH + 1) : end] = False
    h[~ok] = _TOP
    least = C.sliding(h, FLANK + 1, np.minimum, 2**64 - 1, True)
    least[~whole] = 0
    most = C.sliding(least, FLANK + 1, np.maximum, 0, False)
    at = np.flatnonzero((most == h) & ok)
    return at, h[at], np.searchsorted(offs, at, side="right") - 1, prefix


def _rows(kinds: tuple, names: tuple, rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


_KEYED = ((pa.int64(), pa.binary()), ("key", "blob"))


def _split(groups: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values in a sorted array."""
    if len(groups):
        cuts = np.flatnonzero(np.diff(groups)) + 1
        for a, b in zip((0, *cuts), (*cuts, len(groups)), strict=True):
            yield int(groups[a]), slice(int(a), int(b))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]]:
    """About BLOCK_BYTES of (doc ids, bytes, offsets, other columns) at a time."""
    held, size = [], 0

    def take() -> tuple:
        bufs = [C.utf8(b.column(1)) for b in held]
        sizes = np.concatenate([np.diff(offs) for _, offs in bufs])
        ids = np.concatenate([np.asarray(b.column(0)) for b in held])
        others = pa.Table.from_batches([b.select(b.schema.names[2:]) for b in held])
        return ids, np.concatenate([buf for buf, _ in bufs]), np.concatenate(([0], np.cumsum(sizes))), others

    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= BLOCK_BYTES:
            yield take()
            held, size = [], 0
    if held:
        yield take()


def _ipc(table: pa.Table) -> np.ndarray:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return np.frombuffer(sink.getvalue(), np.uint8)


def pack_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """(key, blob): documents by block, compressed, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, buf, offs, others in _gathered(batches):
            block = block_of(ids, blocks)
            order = np.argsort(block, kind="stable")
            rows = []
            for b, s in _split(block[order]):
                own = order[s]
                more = {"others": _ipc(others.take(pa.array(own)))} if others.num_columns else {}
                rows.append((b, packed(ids=ids[own], sizes=np.diff(offs)[own], text=np.concatenate([buf[offs[i] : offs[i + 1]] for i in own]), **more)))
            if rows:
                yield _rows(*_KEYED, rows)

    return docs.mapInArrow(run, "key long, blob binary")


def _cuts(ids: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First document, bytes and offsets of slices of at most SEARCH_BYTES or one text."""
    at = 0
    while at < len(ids):
        to = min(len(ids), max(at + 1, int(np.searchsorted(offs, offs[at] + SEARCH_BYTES, side="right")) - 1))
        yield at, buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def send_anchors(docs: DataFrame, blocks: int, buckets: int) -> DataFrame:
    """(key, blob): by bucket, the distinct anchor tags of each block in a part of the input."""
    fan = FAN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, buf, offs, _ in _gathered(batches):
            block = block_of(ids, blocks)
            codes, docs_ = [], []
            for first, part, ends in _cuts(ids, buf, offs):
                _, h, doc, _ = anchors(part, ends)
                codes.append(code_of(h, buckets))
                docs_.append(doc + first)
            code, doc = np.concatenate(codes), np.concatenate(docs_)
            order = np.lexsort((doc, block[doc], code))
            code, own, doc = code[order], block[doc[order]], doc[order]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (own[1:] != own[:-1])
            again = np.zeros(len(code), bool)
            again[1:] = ~new[1:] & (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            several = np.maximum.reduceat(again, first) if len(first) else again
            code, own = code[first], own[first]
            rows = dealt((code >> _32).astype(np.int64), buckets, fan, tag=(code & _LOW).astype(np.uint32), block=own.astype(np.uint32), several=several)
            if rows:
                yield _rows(*_KEYED, rows)

    return second_level(docs.mapInArrow(run, "key long, blob binary"), buckets)


def shared_anchors(sent: DataFrame) -> DataFrame:
    """(key, blob): by block, the codes of its anchors that occur in two documents, and which are to be split."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["key"][0].as_py()
        got = [unpacked(x.as_py()) for x in table["blob"]]
        tag, block, several = (np.concatenate([g[k] for g in got]) for k in ("tag", "block", "several"))
        order = np.argsort(tag, kind="stable")
        tag, block, several = tag[order], block[order], several[order]
        first = np.flatnonzero(np.concatenate(([True], tag[1:] != tag[:-1])))
        n = np.diff(np.append(first, len(tag)))
        shared = np.repeat((n > 1) | np.logical_or.reduceat(several, first), n)
        hot = np.repeat(n > HOT_BLOCKS, n)
        tag, block, hot = tag[shared], block[shared], hot[shared]
        order = np.lexsort((tag, block))
        tag, block, hot = tag[order], block[order], hot[order]
        once = np.ones(len(tag), bool)
        once[1:] = (tag[1:] != tag[:-1]) | (block[1:] != block[:-1])
        tag, block, hot = tag[once], block[once], hot[once]
        rows = [(b, packed(code=np.uint64(bucket) << _32 | tag[s].astype(np.uint64), hot=hot[s])) for b, s in _split(block.astype(np.int64))]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["key", "blob"])

    return sent.groupBy("key").applyInArrow(run, "key long, blob binary")


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table | None]:
    got = [unpacked(x.as_py()) for x in table["blob"]]
    sizes = np.concatenate([g["sizes"] for g in got])
    others = pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(g["others"])).read_all() for g in got]) if "others" in got[0] else None
    return np.concatenate([g["ids"] for g in got]), np.concatenate([g["text"] for g in got]), np.concatenate(([0], np.cumsum(sizes))), others


def _surroundings(ids: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple]:
    """Of each slice: first document, start, hashes, fingerprints, room on either side, documents and places of anchors."""
    for first, part, ends in _cuts(ids, buf, offs):
        at, h, doc, prefix = anchors(part, ends)
        left = np.minimum(FLANK, at - ends[doc])
        right = np.minimum(FLANK, ends[doc + 1] - at - WORD)
        mark = C.span_hash(prefix, at - left, at + WORD + right)
        mark ^= (left * 19 + right).astype(np.uint64) * np.uint64(C._MULT)
        yield part, at, h, mark, left, right, doc + first


def send_surroundings(texts: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """(key, blob): by bucket, the distinct surroundings of shared anchors in each block."""
    fan = FAN

    def run(key: tuple, left_table: pa.Table, right_table: pa.Table) -> pa.Table:
        rows = []
        if left_table.num_rows and right_table.num_rows:
            got = [unpacked(x.as_py()) for x in right_table["blob"]]
            wanted, split = (np.concatenate([g[k] for g in got]) for k in ("code", "hot"))
            by = np.argsort(wanted)
            wanted, split = wanted[by], split[by]
            ids, buf, offs, _ = _block(left_table)
            parts = []
            for part, at, h, mark, left, right, doc in _surroundings(ids, buf, offs):
                code = code_of(h, buckets)
                k = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
                keep = np.flatnonzero(wanted[k] == code)
                at, h, mark, left, right, doc = (x[keep] for x in (at, h, mark, left, right, doc))
                # the bytes around, as symbols 1 to 256; 0 is beyond the text
                near = np.arange(-FLANK, FLANK)
                where = at[:, None] + np.where(near < 0, near, near + WORD)
                flanks = part[np.clip(where, 0, len(part) - 1)] if len(part) else np.zeros((0, 2 * FLANK), np.uint8)
                parts.append((h, mark, ids[doc], left.astype(np.uint8), right.astype(np.uint8), flanks, split[k[keep]]))
            h, mark, doc, left, right, flanks, hot = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((doc, mark, h))
            new = np.ones(len(order), bool)
            new[1:] = (h[order[1:]] != h[order[:-1]]) | (mark[order[1:]] != mark[order[:-1]])
            first = order[new]  # with the smallest doc_id of the block
            whole = first[~hot[first]]
            after = first[hot[first] & (right[first] >= AFTER)]
            before = first[hot[first] & (left[first] >= BEFORE)]
            i = np.concatenate((whole, after, before))
            side = np.repeat(np.array([0, 1, 2], np.uint8), (len(whole), len(after), len(before)))
            bucket = (code_of(_grouping(h[i], flanks[i], side), buckets) >> _32).astype(np.int64)
            rows = dealt(bucket, buckets, fan, block=np.full(len(i), key[0], np.int64), h=h[i], mark=mark[i], side=side, doc=doc[i], left=left[i], right=right[i], flanks=flanks[i])
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["key", "blob"])

    return second_level(texts.groupBy("key").cogroup(shared.groupBy("key")).applyInArrow(run, "key long, blob binary"), buckets)


def _grouping(h: np.ndarray, flanks: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Hashes of anchors, of split ones together with the bytes on their side."""
    out = h.copy()
    for s, near in ((1, slice(FLANK, FLANK + AFTER)), (2, slice(FLANK - BEFORE, FLANK))):
        own = np.flatnonzero(side == s)
        x = h[own] + np.uint64(s) * np.uint64(C._MULT)
        for column in flanks[own, near].T:
            x = C.mix(x + column + np.uint64(1))
        out[own] = x
    return out


#: Windows that a surrounding is asked for, by side: all, those with AFTER bytes after the anchor, those with BEFORE before it.
_ASKED = np.array([[True] * (FLANK + 1), [j <= FLANK - AFTER for j in range(FLANK + 1)], [j > FLANK - AFTER for j in range(FLANK + 1)]])


def _window_owners(h: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, flanks: np.ndarray) -> np.ndarray:
    """Smallest document of each of the FLANK + 1 windows of each surrounding (max: no window).

    Window j starts j bytes before the anchor. Rows are sorted by h.
    """
    n = len(h)
    word = np.cumsum(np.concatenate(([0], (h[1:] != h[:-1]).astype(np.int64))))
    columns = np.empty((n, 2 * FLANK + 1), np.uint16)
    columns[:, :FLANK] = flanks[:, :FLANK].astype(np.uint16) + 1
    columns[:, :FLANK][np.arange(FLANK) < FLANK - left[:, None]] = 0
    columns[:, FLANK + 1 :] = flanks[:, FLANK:].astype(np.uint16) + 1
    columns[:, FLANK + 1 :][np.arange(FLANK) >= right[:, None]] = 0
    columns[:, FLANK] = 300 + word
    weights = np.ones(2 * FLANK + 2, np.int64)
    weights[FLANK] = WORD
    row, start, lcp = bcr.suffixes(columns, weights)
    most = np.iinfo(np.int64).max
    out = np.full((n, FLANK + 1), most)
    # maximal runs of suffixes that agree on LENGTH bytes
    group = np.cumsum(lcp < LENGTH)
    before = FLANK - start.astype(np.int64)  # bytes before the anchor
    usable = np.flatnonzero((before >= 0) & (before <= left[row]) & (FLANK - before <= right[row]))
    row, before, group = row[usable], before[usable], group[usable]
    if len(row):
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        least = np.minimum.reduceat(doc[row], first)
        out[row, before] = np.repeat(least, np.diff(np.append(first, len(row))))
    return out


def resolve(sent: DataFrame) -> DataFrame:
    """(key, blob): by block, what to mark around its anchors.

    For each surrounding: its smallest document anywhere, in which only the
    windows of ``mask`` are repeated; in its later documents all windows are.
    """

    def run(table: pa.Table) -> pa.Table:
        got = [unpacked(x.as_py()) for x in table["blob"]]
        block, h, mark, side, doc, left, right = (np.concatenate([g[k] for g in got]) for k in ("block", "h", "mark", "side", "doc", "left", "right"))
        flanks = np.concatenate([g["flanks"] for g in got]).reshape(len(h), 2 * FLANK)
        key = h ^ mark * np.uint64(3)
        h = _grouping(h, flanks, side)
        order = np.lexsort((doc, mark, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (mark[order[1:]] != mark[order[:-1]])
        kind = np.cumsum(new) - 1  # class of equal surroundings, in order
        rep = order[new]
        least = doc[rep]
        mask = np.zeros(len(rep), np.uint32)
        # anchors with several surroundings: sort these, some collections at a time
        starts = np.flatnonzero(np.concatenate(([True], h[rep[1:]] != h[rep[:-1]])))
        n = np.diff(np.append(starts, len(rep)))
        rivals = np.flatnonzero(np.repeat(n > 1, n))
        words = np.cumsum(np.concatenate(([0], (h[rep[rivals[1:]]] != h[rep[rivals[:-1]]]).astype(np.int64)))) if len(rivals) else rivals
        at = 0
        while at < len(rivals):
            to = int(np.searchsorted(words, words[min(at + COLLECTION_ROWS, len(rivals)) - 1], side="left"))
            if to <= at:  # one anchor fills the collection
                to = int(np.searchsorted(words, words[at], side="right"))
            if at + COLLECTION_ROWS >= len(rivals):
                to = len(rivals)
            part = rivals[at:to]
            i = rep[part]
            owners = _window_owners(h[i], doc[i], left[i], right[i], flanks[i])
            hit = (owners < least[part][:, None]) & _ASKED[side[i]]
            mask[part] = (hit << np.arange(FLANK + 1)).sum(1)
            at = to
        mask, least = mask[kind], least[kind]
        back = order
        # a block whose only document here is the class's first one, with no window, has nothing to mark;
        # whether it has later documents only the block knows, so every surrounding goes back
        by = np.lexsort((mark[back], h[back], block[back]))
        block, key, mask, least = block[back][by], key[back][by], mask[by], least[by]
        rows = [(b, packed(key=key[s], least=least[s], mask=mask[s])) for b, s in _split(block)]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["key", "blob"])

    return sent.groupBy("key").applyInArrow(run, "key long, blob binary")


def cut_repeats(texts: DataFrame, marks: DataFrame, others_schema: T.StructType, whole_chars: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, other columns) of every document of every block.

    With ``whole_chars`` characters of which a cut takes a part are not in ``kept``.
    """
    counts = [T.StructField(n, T.LongType()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([*counts, T.StructField("kept", T.BinaryType()), *others_schema.fields])

    def run(texts_table: pa.Table, marks_table: pa.Table) -> pa.Table:
        out = []
        known = np.zeros(0, np.uint64)
        if texts_table.num_rows:
            ids, buf, offs, others = _block(texts_table)
            if marks_table.num_rows:
                got = [unpacked(x.as_py()) for x in marks_table["blob"]]
                known, least, mask = (np.concatenate([g[k] for g in got]) for k in ("key", "least", "mask"))
                order = np.argsort(known)
                known, least, mask = known[order], least[order], mask[order]
                first = np.flatnonzero(np.append(True, known[1:] != known[:-1]))  # split anchors have one for either side
                known, least, mask = known[first], least[first], np.bitwise_or.reduceat(mask, first)
            done = 0
            for part, at, h, mark, left, right, doc in _surroundings(ids, buf, offs):
                first, to = done, done
                while to < len(ids) and offs[to + 1] - offs[first] <= len(part):
                    to += 1
                done = to
                ends = offs[first : to + 1] - offs[first]
                delta = np.zeros(len(part) + 1, np.int32)
                if len(known):
                    key = h ^ mark * np.uint64(3)
                    k = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    hit = np.flatnonzero(known[k] == key)
                    at, left, right, doc, k = at[hit], left[hit], right[hit], doc[hit], k[hit]
                    later = ids[doc] > least[k]
                    for j in range(FLANK + 1):  # the window that starts j bytes before the anchor
                        w = at[(later | (mask[k] >> np.uint32(j) & np.uint32(1)).astype(bool)) & (j <= left) & (FLANK - j <= right)] - j
                        delta += np.bincount(w, minlength=len(delta)).astype(np.int32)[: len(delta)]
                        delta -= np.bincount(w + LENGTH, minlength=len(delta)).astype(np.int32)[: len(delta)]
                gone = np.cumsum(delta[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                edge = ends[:-1][ends[:-1] < len(part)]
                begins[edge] = gone[edge]
                n_gone, n_spans = C.per_doc_sum(gone, ends), C.per_doc_sum(begins, ends)
                if whole_chars and gone.any():
                    char = np.maximum(np.cumsum(C.NOT_TAIL[part]) - 1, 0)
                    hit = np.zeros(int(char[-1]) + 1, bool)
                    hit[char[gone]] = True
                    gone = hit[char]
                kept_ends = ends[1:] - np.cumsum(C.per_doc_sum(gone, ends))
                kept = pa.Array.from_buffers(pa.large_binary(), to - first, [None, pa.py_buffer(np.concatenate(([0], kept_ends)).astype(np.int64)), pa.py_buffer(part[~gone])])
                cut = pa.table([pa.array(ids[first:to]), C.long_column(np.diff(ends)), C.long_column(n_gone), C.long_column(n_spans), kept.cast(pa.binary())], names=schema.names[:5])
                for name in schema.names[5:]:
                    cut = cut.append_column(name, others[name].slice(first, to - first))
                out.append(cut)
        return pa.concat_tables(out) if out else to_arrow_schema(schema).empty_table()

    return texts.groupBy("key").cogroup(marks.groupBy("key")).applyInArrow(run, schema)


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_others: bool = False, whole_chars: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every row.

    With ``keep_others`` the other columns of the input follow, as they are. With
    ``whole_chars`` what a cut leaves of a character goes too, beside the counts.
    """
    docs, others = C.with_others(documents, id_col, text_col)
    others = others if keep_others else []
    names = [f"other_{i}" for i in range(len(others))]
    docs = docs.select("doc_id", "text", *names)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = buckets = max(1, -(-size // BLOCK_BYTES))
    known = docs.where("doc_id is not null")
    texts = pack_blocks(known, blocks)
    shared = shared_anchors(send_anchors(known.select("doc_id", "text"), blocks, buckets))
    marks = resolve(send_surroundings(texts, shared, buckets))
    rest = docs.where("doc_id is null").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("kept"), *names)
    out = cut_repeats(texts, marks, T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, others, strict=True)]), whole_chars).unionByName(rest)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", *(F.col(n).alias(f.name) for n, f in zip(names, others, strict=True)))
