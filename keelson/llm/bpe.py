"""Byte-level BPE by merge replay.

The distinct pieces of a block of documents that are not known yet form a corpus.
An inverted index maps every token pair that can be merged to the positions where
it stands; pairs wait in a heap by the rank of the token that they make, merges
are applied in rank order, and a merge touches only its two neighbours. What a
task has encoded once it keeps in a memo that is bounded in pieces and bytes, so
each distinct piece is normally merged once a task. No row is shuffled: blocks are
cut inside scan partitions, so memory depends on the block size and the memo
bound alone.

Defined results: null and empty texts have no ids, and decode to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from keelson.llm import common as C

#: Entries, and bytes of pieces, after which a task forgets the pieces that it has encoded.
MEMO_PIECES = 400_000
MEMO_BYTES = 32 << 20


def parse_ranks(raw: bytes) -> list[bytes]:
    """Tokens in rank order from a file of 'base64 rank' lines."""
    got = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, raw.splitlines()) if token}
    return [got[i] for i in range(len(got))]


class MergeReplay:
    """Applies all merges to a corpus of pieces at once."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.made: dict[int, int] = {}  # pair -> id of the token that it makes, or -1
        self.byte_ids = np.array([self.rank[bytes([b])] for b in range(256)])
        self.byte_pairs = np.full((self.byte_ids.max() + 1,) * 2, -1, np.int64)
        for token, i in self.rank.items():
            if len(token) == 2:
                self.byte_pairs[tuple(self.byte_ids[list(token)])] = i

    def encode(self, pieces: Iterable[bytes]) -> list[np.ndarray]:
        """Ids of each piece; pieces never merge with each other."""
        pieces = list(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw) + len(sizes)
        start = np.full(n, -1, np.int64)  # -1: a wall between pieces
        start[np.arange(len(raw)) + np.repeat(np.arange(len(sizes)), sizes)] = self.byte_ids[raw]
        first = np.where((start[:-1] >= 0) & (start[1:] >= 0), self.byte_pairs[start[:-1], start[1:]], -1)
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        ranks, at = np.unique(first[order], return_index=True)
        pairs = (start[:-1][order[at]] << 32 | start[1:][order[at]]).tolist() if len(order) else []
        places: dict[int, list[int]] = {p: x.tolist() for p, x in zip(pairs, np.split(order, at[1:]), strict=True)} if pairs else {}
        waiting: dict[int, list[int]] = {r: [p] for r, p in zip(ranks.tolist(), pairs, strict=True)}  # rank -> pairs that make its token
        ids = start.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known, tokens, rank_of = self.made, self.tokens, self.rank
        heap = list(waiting)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            pairs = waiting.pop(rank, None)
            if pairs is None:
                continue
            if len(pairs) == 1:
                spots = places.pop(pairs[0])
            else:  # merges of one rank go from left to right, whatever their pair
                spots = [i for p in pairs for i in places.pop(p)]
            spots.sort()
            token = tokens[rank]
            for k, i in enumerate(spots):
                a = ids[i]
                if a < 0:
                    continue
                j = after[i]
                b = ids[j]
                if b < 0 or (a << 32 | b) not in pairs:
                    continue
                ids[i] = rank
                ids[j] = -2  # gone
                after[i] = right = after[j]
                before[right] = i
                lower = False
                left = before[i]
                if left >= 0 and (x := ids[left]) >= 0:
                    pair = x << 32 | rank
                    if (made := known.get(pair)) is None:
                        made = known[pair] = rank_of.get(tokens[x] + token, -1)
                    if made >= 0:
                        if pair in places:
                            places[pair].append(left)
                        else:
                            places[pair] = [left]
                            if made in waiting:
                                waiting[made].append(pair)
                            else:
                                waiting[made] = [pair]
                                heapq.heappush(heap, made)
                        lower = made <= rank
                if (y := ids[right]) >= 0:
                    pair = rank << 32 | y
                    if (made := known.get(pair)) is None:
                        made = known[pair] = rank_of.get(token + tokens[y], -1)
                    if made >= 0:
                        if pair in places:
                            places[pair].append(i)
                        else:
                            places[pair] = [i]
                            if made in waiting:
                                waiting[made].append(pair)
                            else:
                                waiting[made] = [pair]
                                heapq.heappush(heap, made)
                        lower |= made <= rank
                if lower:  # an earlier merge has become possible: it goes first
                    for i in spots[k + 1 :]:
                        pair = ids[i] << 32 | ids[after[i]] if ids[i] >= 0 else -1
                        if pair in pairs:
                            if pair in places:
                                places[pair].append(i)
                            else:
                                places[pair] = [i]
                                if rank in waiting:
                                    waiting[rank].append(pair)
                                else:
                                    waiting[rank] = [pair]
                                    heapq.heappush(heap, rank)
                    break
        flat = np.array(ids, np.int64)
        kept = flat >= 0
        size = np.diff(np.concatenate(([0], np.cumsum(kept)[flat == -1]))) if len(sizes) else []
        return np.split(flat[kept].astype("<u4"), np.cumsum(size)[:-1]) if len(sizes) else []


class BlockEncoder:
    """Encodes documents block by block with a bounded memo of pieces."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.replay, self.find = MergeReplay(tokens), regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def encode(self, documents: list[str]) -> list[bytes]:
        """Packed little-endian ids of each document."""
        cut = [self.find(t) for t in documents]
        if len(self.memo) > MEMO_PIECES or self.held > MEMO_BYTES:
            self.memo.clear()
            self.replay.made.clear()
            self.held = 0
        new = list(set().union(*cut) - self.memo.keys())
        self.held += sum(map(len, new))
        self.memo.update(zip(new, (x.tobytes() for x in self.replay.encode(p.encode() for p in new)), strict=True))
        get = self.memo.__getitem__
        return [b"".join(map(get, c)) for c in cut]


def decode(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, text, ids array<long>): the ids of every whole text."""
    return _run(documents, ranks_path, pattern, digests=False)


def encode_digests(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    return _run(documents, ranks_path, pattern, digests=True)


def _run(documents: DataFrame, ranks_path: str, pattern: str, digests: bool) -> DataFrame:
    docs = C.texts(documents)
    with open(ranks_path, "rb") as f:  # a file of fixed size on the driver; tasks get it broadcast
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = parse_ranks(raw.value)
        encoder = BlockEncoder(tokens, pattern)
        for batch, _, _ in C.slices(batches):
            packed = encoder.encode(batch.column(1).fill_null("").to_pylist())
            if digests:
                yield pa.record_batch(
                    [batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()), pa.array([hashlib.sha256(decode(p, tokens)).hexdigest() for p in packed], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            else:
                ids = [np.frombuffer(p, "<u4").astype(np.int64) for p in packed]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "text", "ids"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, text string, ids array<long>")
