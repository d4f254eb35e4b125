"""Best-fit packing of documents into sequences of several permitted lengths.

Texts are cut into pieces of at most the longest permitted length. Pieces are
dealt by a hash over shards, whose number grows with the input, and each shard
is packed by best-fit in falling order of length: a piece goes into the open
bin, of whatever size, that it fills best; if none has room, a bin of the least
cost is opened. What a bin of some size would cost a unit is found by looking
ahead: how far the pieces that are still to come would fill it, the largest that
fits first, and what the smallest permitted length for these contents costs. A
sequence costs a fixed part, its length, and a part that grows with the square
of its length (attention), so short sequences are cheaper where they can be
filled and long ones where they cannot.

The sizes are optimised jointly: a shard is packed with every range of permitted
lengths, and the packing of least total cost stays. At the end every bin is
downsized to the smallest permitted length that holds its contents.

Defined results: null and empty texts take no room: one row with a null bin.
Ties are broken by doc_id, then place. Repeated rows are packed as often as they
occur.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copies of a repeated row that one row stands for while they are dealt.
COPIES = 1000


@dataclass(frozen=True)
class PackParams:
    """Permitted lengths, cost of a sequence, and rows a shard is meant to hold."""

    sizes: tuple[int, ...] = (4096, 8192, 16384)
    overhead: int = 256
    #: Length at which the square part of the cost is as large as the linear one.
    square: int = 65536
    shard_rows: int = 20_000

    def cost(self, size: int) -> float:
        return self.overhead + size + size * size / self.square

    def holding(self, filled: int) -> int:
        """The smallest permitted length for some contents."""
        return min(s for s in self.sizes if s >= filled)


@dataclass
class Packing:
    bins: list[int]
    offsets: list[int]
    sizes: list[int]
    cost: float


def pack_with(lengths: Sequence[int], allowed: Sequence[int], p: PackParams) -> Packing:
    """Best-fit of falling lengths that opens the allowed sizes (a longer piece: the smallest that holds it)."""
    rising = [-x for x in lengths]
    rooms: list[int] = []  # sorted distinct rooms of open bins
    by_room: dict[int, list[int]] = {}
    sizes, filled, bins, offsets = [], [], [], []
    for i, length in enumerate(lengths):
        k = bisect_left(rooms, length)
        if k < len(rooms):
            room = rooms[k]
            waiting = by_room[room]
            b = heapq.heappop(waiting)
            if not waiting:
                del by_room[room], rooms[k]
        else:
            best = None
            for size in [s for s in allowed if s >= length] or [p.holding(length)]:
                total, at = length, i + 1
                while total < size and (at := bisect_left(rising, total - size, at)) < len(rising):
                    total += lengths[at]
                    at += 1
                rate = (p.cost(p.holding(total)) / total, size)
                best = rate if best is None or rate < best else best
            b = len(sizes)
            sizes.append(best[1])
            filled.append(0)
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += length
        room = sizes[b] - filled[b]
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            heapq.heappush(by_room[room], b)
    sizes = [p.holding(f) for f in filled]
    return Packing(bins, offsets, sizes, sum(map(p.cost, sizes)))


def best_fit(lengths: Sequence[int], p: PackParams) -> Packing:
    """The cheapest packing of lengths (falling, each 1 to the longest size) over all ranges of permitted sizes."""
    sizes = sorted(p.sizes)
    ranges = [sizes[a:z] for a in range(len(sizes)) for z in range(len(sizes), a, -1)]
    return min((pack_with(lengths, r, p) for r in ranges), key=lambda found: found.cost)


def pack(documents: DataFrame, p: PackParams = PackParams(), length: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_offset, bin_size) of every piece.

    ``length`` is a column of the documents' lengths (default: UTF-8 bytes). Only
    ids and lengths are shuffled. Repeated rows are counted first and dealt by
    their number, so that they spread over all shards. ``bin_id`` is unique over
    all shards.
    """
    longest = max(p.sizes)
    long = lambda x: F.lit(x).cast("long")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(length if length is not None else F.octet_length("text"), F.lit(0)).cast("long").alias("total"))
    counted = docs.groupBy("doc_id", "total").agg(F.count("*").alias("copies"))
    shards = max(1, -(-docs.count() // p.shard_rows))
    some = counted.select("doc_id", "total", "copies", F.explode(F.sequence(long(0), F.col("copies") - 1, long(COPIES))).alias("first")).repartition("doc_id", "total", "first")
    each = some.select("doc_id", "total", F.explode(F.sequence("first", F.least(F.col("first") + (COPIES - 1), F.col("copies") - 1))).alias("copy"))
    starts = F.when(F.col("total") > 0, F.sequence(long(0), F.col("total") - 1, long(longest))).otherwise(F.array(long(0)))
    pieces = each.select("doc_id", "total", "copy", F.posexplode(starts).alias("piece", "start"))
    pieces = pieces.select("doc_id", F.col("piece").cast("long").alias("piece"), "start", F.least(F.lit(longest), F.col("total") - F.col("start")).alias("length"), F.pmod(F.xxhash64("doc_id", "piece", "total", "copy"), F.lit(shards)).alias("shard"))
    schema = "doc_id long, piece long, start long, length long, bin_id long, bin_offset long, bin_size long"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        shard = table["shard"][0].as_py()
        lengths = table["length"].to_pylist()
        n = sum(x > 0 for x in lengths)
        found = best_fit(lengths[:n], p)
        none = [None] * (len(lengths) - n)
        cols = [[shard << 32 | b for b in found.bins] + none, found.offsets + none, [found.sizes[b] for b in found.bins] + none]
        out = table.select(["doc_id", "piece", "start", "length"])
        for name, col in zip(("bin_id", "bin_offset", "bin_size"), cols, strict=True):
            out = out.append_column(name, pa.array(col, pa.int64()))
        return out

    return pieces.groupBy("shard").applyInArrow(run, schema)
