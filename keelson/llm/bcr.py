"""Column-wise construction of a collection's suffix array, BWT and common prefixes.

All sequences of a collection have the same number of columns. Starting from the
terminators, each round prepends one symbol to the current suffix of every
sequence: its place follows from the place of the shorter suffix by counting
symbols of the transform so far (last-to-first mapping), and its common prefix
with the suffix before it from the smallest prefix since the last occurrence of
the same symbol. The transform, the prefix lengths, the owners and the columns
where suffixes start are kept in files. A round reads them twice from start to
end, block by block - once to find the places, once to write the files of the
next round with the new suffixes in them - so that it holds a block, a few numbers
a symbol and a few a sequence, and one column of the sequences.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

CAP = 255
#: Entries of a file that are read at once.
BLOCK = 1 << 16
_SYMBOLS = 1 << 16


def range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of ``values`` over each [lo, hi), none of which is empty, by doubling."""
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    table, k = values, 0
    for want in np.unique(level).tolist():
        while k < want:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
            k += 1
        at = np.flatnonzero(level == want)
        out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << want)])
    return out


class _Files:
    """Arrays in sequential files of a temporary folder that goes with the task."""

    KINDS = {"bwt": np.uint16, "lcp": np.uint8, "owner": np.uint32, "begin": np.uint8}

    def __init__(self):
        self.folder = tempfile.TemporaryDirectory(prefix="bcr")
        self.round = 0
        self.out: dict = {}

    def _path(self, name: str, round_: int) -> str:
        return os.path.join(self.folder.name, f"{name}-{round_ % 2}")

    def read(self, *names: str) -> Iterator[tuple[int, list[np.ndarray]]]:
        """First entry and arrays of each block of the current round."""
        sources = [open(self._path(n, self.round), "rb") for n in names]
        try:
            at = 0
            while len((got := [np.fromfile(f, self.KINDS[n], BLOCK) for f, n in zip(sources, names, strict=True)])[0]):
                yield at, got
                at += len(got[0])
        finally:
            for f in sources:
                f.close()

    def write(self, **arrays: np.ndarray) -> None:
        """Append to the files of the next round."""
        for name, values in arrays.items():
            if name not in self.out:
                self.out[name] = open(self._path(name, self.round + 1), "wb")
            values.astype(self.KINDS[name], copy=False).tofile(self.out[name])

    def turn(self) -> None:
        """The next round begins."""
        for f in self.out.values():
            f.close()
        self.out = {}
        self.round += 1

    def close(self) -> None:
        self.turn()
        self.folder.cleanup()


def _find(files: _Files, n: int, place: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the longer suffixes, and what prefixes change: places and lengths without the first symbol (-1: none)."""
    smaller = n + np.cumsum(have) - have
    seen = np.zeros(_SYMBOLS, np.int64)
    since = np.full(_SYMBOLS, CAP, np.uint8)  # smallest prefix since the last occurrence of a symbol
    wanted = np.zeros(_SYMBOLS, bool)  # whether that occurrence is one of the new ones
    rows = np.argsort(place, kind="stable")
    ordered = place[rows]
    to = np.empty(n, np.int64)
    spots, prefixes = [], []
    for at, (bwt, lcp) in files.read("bwt", "lcp"):
        a, z = np.searchsorted(ordered, (at, at + len(bwt)))
        new = np.zeros(len(bwt), bool)
        new[ordered[a:z] - at] = True
        order = np.argsort(bwt, kind="stable")  # of one block
        symbol = bwt[order]
        head = np.ones(len(order), bool)
        head[1:] = symbol[1:] != symbol[:-1]
        heads = np.flatnonzero(head)
        count = np.diff(np.append(heads, len(order)))
        nth = np.arange(len(order)) - np.repeat(heads, count)
        goal = np.empty(len(order), np.int64)
        goal[order] = smaller[symbol] + seen[symbol] + nth
        to[rows[a:z]] = goal[ordered[a:z] - at]
        # prefixes change at new suffixes and at those that follow them
        mine = new[order]
        after = np.zeros(len(order), bool)
        after[1:] = mine[:-1]
        after[heads] = wanted[symbol[heads]]
        change = np.flatnonzero(mine | after)
        where = order[change]
        prefix = np.full(len(change), -1, np.int64)
        inside = ~head[change]
        prefix[inside] = range_min(lcp, order[change[inside] - 1] + 1, where[inside] + 1)
        across = ~inside & (seen[symbol[change]] > 0)
        prefix[across] = np.minimum(since[symbol[change[across]]], np.minimum.accumulate(lcp)[where[across]])
        spots.append(goal[where])
        prefixes.append(prefix)
        # what the next block needs
        since = np.minimum(since, lcp.min())
        tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], CAP)
        last = heads + count - 1
        since[symbol[last]] = tail[order[last] + 1]
        wanted[symbol[last]] = mine[last]
        seen[symbol[last]] += count
    spots, prefixes = np.concatenate(spots), np.concatenate(prefixes)
    order = np.argsort(spots, kind="stable")
    return to, spots[order], prefixes[order]


def _insert(files: _Files, to: np.ndarray, symbol: np.ndarray, col: int, spots: np.ndarray, prefixes: np.ndarray, weights: np.ndarray, size: int) -> None:
    """Write the next round's files: the old entries, the new ones at their places, and changed prefixes."""
    rows = np.argsort(to, kind="stable")
    before = to[rows] - np.arange(len(rows))  # old entries before each new one
    for at, (bwt, lcp, owner, begin) in files.read("bwt", "lcp", "owner", "begin"):
        end = at + len(bwt)
        a, z = np.searchsorted(before, at), np.searchsorted(before, end) if end < size else len(rows)
        here, k = before[a:z] - at, rows[a:z]
        first = at + a
        begin = np.insert(begin, here, np.full(len(k), col, np.uint8))
        lcp = np.insert(lcp, here, np.zeros(len(k), np.uint8))
        b, y = np.searchsorted(spots, (first, first + len(lcp)))
        where, prefix = spots[b:y] - first, prefixes[b:y]
        lcp[where] = np.where(prefix < 0, 0, np.minimum(CAP, prefix + weights[begin[where]]))
        files.write(bwt=np.insert(bwt, here, symbol[k]), lcp=lcp, owner=np.insert(owner, here, k.astype(np.uint32)), begin=begin)
    files.turn()


def suffixes(columns: np.ndarray, weights: np.ndarray, stop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of all rows of ``columns`` (n x m, symbols below 65535).

    Returns, in order, the row of each suffix, the column at which it starts (m:
    the terminator) and its common prefix with the suffix before, as the sum of
    the ``weights`` of the columns that it spans (at most 255). Suffixes that
    start before column ``stop`` are left out. Terminators are smaller than all
    symbols and differ from each other.
    """
    n, m = columns.shape
    files = _Files()
    try:
        place = np.arange(n, dtype=np.int64)  # of each row's current suffix
        symbol = columns[:, m - 1] + np.uint16(1) if m else np.zeros(n, np.uint16)
        have = np.bincount(symbol, minlength=_SYMBOLS)
        files.write(bwt=symbol, lcp=np.zeros(n, np.uint8), owner=place, begin=np.full(n, m, np.uint8))
        files.turn()
        for size, col in zip(range(n, n * (m + 1) + 1, max(1, n)), range(m - 1, stop - 1, -1), strict=False):
            to, spots, prefixes = _find(files, n, place, have)
            symbol = columns[:, col - 1] + np.uint16(1) if col else np.zeros(n, np.uint16)
            _insert(files, to, symbol, col, spots, prefixes, weights, size)
            have += np.bincount(symbol, minlength=_SYMBOLS)
            place = to
        blocks = [got for _, got in files.read("owner", "begin", "lcp")]
        owner, begin, lcp = (np.concatenate(x) for x in zip(*blocks, strict=True)) if blocks else (np.zeros(0, k) for k in (np.uint32, np.uint8, np.uint8))
        return owner.astype(np.int64), begin, lcp
    finally:
        files.close()
