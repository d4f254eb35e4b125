"""n-gram Jaccard join by MinHash LSH forest with exact verification.

A text's set are the hashes of its five-word shingles (a shorter text has one
shingle of all its words). MinHash signatures are laid out as ``trees`` labels of
``depth`` bytes each; in the order of its labels, a tree is a prefix trie whose
nodes are runs of equal prefixes. All tries are descended from their full depth
upwards together. At each depth, the nodes that branch there are looked at: in
them lie the pairs whose longest common prefix in any tree has this length. Pairs
whose signatures agree well enough are candidates, each in one node: of the trees
in which it has its longest prefix, in the first. The prefix is shortened until
the forest finds even the least similar candidate at the threshold or above with
the target recall; one that shows no candidate there is shortened as far as the
recall of a pair just at the threshold asks for.

Candidates are verified exactly. Tasks get shingles of the sets that are
connected by candidates inside one node, and return numbers of links and one edge
a linked set, never pairs. Classes are the components of verified links alone.
Nodes with some sets are a task's group each, small ones are dealt over tasks
together. Nodes with very many sets are cut into parts as large as a task can hold,
and every pair of parts is a group: a set then travels once a part of its node.

Sets are numbered; texts with equal sets are one set from the start, counted by
size, so copies are never paired.

Defined results: null texts and texts without a word have no shingle, no link
and a class of their own; rows without id are in no class. Rows that share a
doc_id and text count as copies of each other, and rows that share a doc_id but
not the text are documents of their own. A class is named by the smallest doc_id
in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import common as C
from keelson.llm.graph import components

#: Bytes of a label, the symbols of the tries.
DEPTH = 8


@dataclass(frozen=True)
class ForestParams:
    words: int = 5
    similarity: Fraction = Fraction(4, 5)
    trees: int = 24
    target_recall: float = 0.9999
    #: Pairs whose signatures agree less than this many standard deviations below the threshold are no candidates.
    slack: float = 6.0
    #: Sets and shingles that a part of a node is meant to hold: two parts are 0.8 MB of labels and 8 MB of shingles.
    part_rows: int = 2048
    part_shingles: int = 1 << 19
    #: Rows, and bytes of shingles, of small nodes that a task is meant to hold; nodes of more than an eighth have tasks of their own.
    task_rows: int = 2000
    task_bytes: int = 4 << 20

    @property
    def values(self) -> int:
        return self.trees * DEPTH

    def recall(self, similarity: float, depth: int) -> float:
        """Share of pairs of a similarity that have a common prefix of this depth in some tree."""
        return 1 - (1 - similarity**depth) ** self.trees

    def least_depth(self) -> int:
        """The longest prefix that finds pairs just at the threshold with the target recall."""
        return next((d for d in range(DEPTH, 1, -1) if self.recall(float(self.similarity), d) >= self.target_recall), 1)

    def least_agreement(self) -> int:
        """Labels in which a candidate's signatures agree at least."""
        s = float(self.similarity)
        return max(0, int(self.values * s - self.slack * sqrt(self.values * s * (1 - s))))


_rng = np.random.RandomState(97)
_A = (_rng.randint(0, 1 << 31, 1024).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.randint(0, 1 << 31, 1024).astype(np.uint32) * np.uint32(2654435761)
_WORD_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93)]


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ordered by document, and where each document's start."""
    n = len(offs) - 1
    starts, ends, doc = C.word_spans(buf, offs, C.IN_WORD)
    h = C.span_hash(C.prefix_hash(buf), starts, ends)
    runs = C.runs_of(doc, n)
    count = np.diff(runs)
    out, owner = [], []
    if len(h) >= words:
        tri = np.zeros(len(h) - words + 1, np.uint64)
        for k in range(words):
            tri += h[k : len(h) - words + 1 + k] * _WORD_MULT[k % 8]
            tri ^= tri >> np.uint64(29)
        inside = doc[: len(tri)] == doc[words - 1 :]
        out.append(C.mix(tri[inside]))
        owner.append(doc[: len(tri)][inside])
    for k in range(1, words):  # short texts
        own = np.flatnonzero(count == k)
        if len(own):
            v = np.full(len(own), k, np.uint64)
            for j in range(k):
                v += h[runs[own] + j] * _WORD_MULT[j % 8]
                v ^= v >> np.uint64(29)
            out.append(C.mix(v))
            owner.append(own)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    value, own = np.concatenate(out), np.concatenate(owner)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[new], own[new]
    return value, np.searchsorted(own, np.arange(n + 1))


def set_digests(values: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell sets apart."""
    total = np.zeros((2, len(values) + 1), np.uint64)
    np.cumsum(values, out=total[0, 1:])
    np.cumsum(C.mix(values ^ _WORD_MULT[2]), out=total[1, 1:])
    both = total[:, runs[1:]] - total[:, runs[:-1]]
    return both[0].view(np.int64), both[1].view(np.int64)


def labels_of(values: np.ndarray, runs: np.ndarray, p: ForestParams) -> list[np.ndarray | None]:
    """Per document one label a tree: DEPTH bytes of MinHash values as a number, the first byte highest."""
    small = (values >> np.uint64(32)).astype(np.uint32)
    out: list[np.ndarray | None] = []
    for s, e in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
        if s == e:
            out.append(None)
            continue
        low = None
        for at in range(s, e, 512):
            part = small[at : min(e, at + 512), None] * _A[: p.values]
            part += _B[: p.values]
            least = part.min(0)
            low = least if low is None else np.minimum(low, least)
        low *= np.uint32(0x9E3779B1)
        out.append((low >> np.uint32(24)).astype(np.uint8).view(">i8").astype(np.int64))
    return out


def signatures(docs: DataFrame, p: ForestParams) -> DataFrame:
    """(doc_id, h, d1, d2, n, labels) of every (doc_id, text, h); n = 0 and no labels without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in C.slices(batches):
            values, runs = shingle_sets(buf, offs, p.words)
            d1, d2 = set_digests(values, runs)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(d1), pa.array(d2), C.long_column(np.diff(runs)), pa.array(labels_of(values, runs, p), pa.list_(pa.int64()))], names=["doc_id", "h", "d1", "d2", "n", "labels"])

    return docs.mapInArrow(run, "doc_id long, h long, d1 long, d2 long, n long, labels array<long>")


def label_bytes(labels: pa.ChunkedArray, trees: int) -> np.ndarray:
    """n x trees x DEPTH bytes of a column of labels."""
    flat = np.asarray(labels.combine_chunks().flatten()) if len(labels) else np.zeros(0, np.int64)
    return flat.astype(">i8").view(np.uint8).reshape(-1, trees, DEPTH)


def prefixes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest common prefix of pairs in any tree, and the first tree that has it."""
    common = np.minimum.accumulate(a == b, axis=2).sum(2)
    return common.max(1), common.argmax(1)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Numbers of common values of every set of ``a`` with every set of ``b``."""
    values = np.concatenate(a + b)
    _, column = np.unique(values, return_inverse=True)
    used_a = np.bincount(column[: sum(map(len, a))], minlength=column.max() + 1)
    used_b = np.bincount(column[sum(map(len, a)) :], minlength=column.max() + 1)
    common = np.flatnonzero((used_a > 0) & (used_b > 0))
    place = np.full(column.max() + 1, -1)
    place[common] = np.arange(len(common))
    column = place[column]
    row_a = np.repeat(np.arange(len(a)), [len(x) for x in a])
    row_b = np.repeat(np.arange(len(b)), [len(x) for x in b])
    col_a, col_b = column[: len(row_a)], column[len(row_a) :]
    row_a, col_a = row_a[col_a >= 0], col_a[col_a >= 0]
    row_b, col_b = row_b[col_b >= 0], col_b[col_b >= 0]
    out = np.zeros((len(a), len(b)), np.float32)
    step = 4096
    oa, ob = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    col_a, row_a, col_b, row_b = col_a[oa], row_a[oa], col_b[ob], row_b[ob]
    for at in range(0, len(common), step):
        sa = slice(*np.searchsorted(col_a, (at, at + step)))
        sb = slice(*np.searchsorted(col_b, (at, at + step)))
        width = min(step, len(common) - at)
        ma, mb = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        ma[row_a[sa], col_a[sa] - at] = 1
        mb[row_b[sb], col_b[sb] - at] = 1
        out += ma @ mb.T
    return out


def linked(a: list[np.ndarray], b: list[np.ndarray], similarity: Fraction) -> np.ndarray:
    """Which pairs reach the Jaccard similarity, by whole numbers: q * inner >= p * union."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    inner = np.array([[len(np.intersect1d(a[0], b[0], assume_unique=True))]]) if len(a) == len(b) == 1 else overlaps(a, b).astype(np.int64)
    return similarity.denominator * inner >= similarity.numerator * (na[:, None] + nb[None, :] - inner)


def _least_linked(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index in each of n nodes' component of the links left - right."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        now = root.copy()
        np.minimum.at(now, left, low)
        np.minimum.at(now, right, low)
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _pairs(first: np.ndarray, count: np.ndarray, limit: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row r with rows first[r] to first[r] + count[r], about ``limit`` pairs at a time."""
    ends = np.cumsum(count)
    at = 0
    while at < len(first):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        n = count[at:to]
        left = np.repeat(np.arange(at, to), n)
        yield left, first[left] + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        at = to


#: What names a group: a node of a tree, and which two parts of it.
_GROUP = ("tree", "depth", "prefix", "low", "high")


def _grouped(table: pa.Table, names: tuple[str, ...]) -> tuple[pa.Table, np.ndarray]:
    """Rows ordered by group and side, and the bounds of groups."""
    table = table.sort_by([(n, "ascending") for n in (*names, "side", "node")])
    new = np.zeros(table.num_rows, bool)
    for n in names:
        x = np.asarray(table[n])
        new[1:] |= x[1:] != x[:-1]
    new[:1] = True
    return table, np.append(np.flatnonzero(new), table.num_rows)


def branching(rows: DataFrame, depth: int) -> DataFrame:
    """(tree, prefix, rows, shingles) of nodes that branch at a depth; rows has (tree, label, n)."""
    child = _prefix(min(depth + 1, DEPTH))
    nodes = rows.select("tree", _prefix(depth).alias("prefix"), child.alias("child"), "n").groupBy("tree", "prefix")
    nodes = nodes.agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.min("child").alias("a"), F.max("child").alias("z"))
    return nodes.where("rows > 1" if depth == DEPTH else "a < z").drop("a", "z")  # below a leaf are only sets


def _prefix(depth: int):
    return F.shiftright("label", 8 * (DEPTH - depth))


def deal(rows: DataFrame, nodes: DataFrame, depth: int, p: ForestParams) -> DataFrame:
    """Rows (node, tree, label, n, labels) with task, group and side; a row goes to every pair of parts of its node."""
    nodes = C.cut(nodes.withColumn("parts", F.ceil(F.greatest(F.col("rows") / p.part_rows, F.col("shingles") / p.part_shingles)).cast("int")))
    nodes = nodes.withColumn("alone", (F.col("parts") > 1) | (F.col("rows") > p.task_rows // 8))
    small = nodes.where("not alone").agg(F.sum("rows")).first()[0] or 0
    bins = max(1, ceil(small / p.task_rows))
    g = rows.withColumn("prefix", _prefix(depth)).join(nodes.select("tree", "prefix", "parts", "alone"), ["tree", "prefix"])
    g = g.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    g = g.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).withColumn("depth", F.lit(depth))
    task = F.when(~F.col("alone"), F.pmod(F.xxhash64("tree", "prefix"), F.lit(bins)).cast("string")).otherwise(F.concat_ws(":", "tree", "prefix", "low", "high"))
    return g.select(task.alias("task"), *_GROUP, (F.col("part") > F.col("other")).cast("int").alias("side"), "node", "labels")


_FOUND = "tree int, depth int, prefix long, low int, high int, root long, side int, node long, agreement int, pairs long"


def candidates(dealt: DataFrame, p: ForestParams) -> DataFrame:
    """Sets connected by candidate pairs that belong to their group, and how well those agree.

    Rows either name a set (``node``) and the component that it is in, or count
    pairs by the number of labels in which they agree.
    """

    def run(table: pa.Table) -> pa.Table:
        table, bounds = _grouped(table, _GROUP)
        n = table.num_rows
        labels = label_bytes(table["labels"], p.trees)
        node, side, tree, depth = (np.asarray(table[c]) for c in ("node", "side", "tree", "depth"))
        crossing = np.asarray(table["low"]) != np.asarray(table["high"])
        size = np.diff(bounds)
        start, end = np.repeat(bounds[:-1], size), np.repeat(bounds[1:], size)
        ones = np.concatenate(([0], np.cumsum(side)))
        cross_first = end - (ones[end] - ones[start])
        first = np.where(crossing, cross_first, np.arange(n) + 1)
        count = np.where(crossing & (side == 1), 0, end - first)
        lefts, rights = [], []
        tally = np.zeros(p.values + 1, np.int64)
        flat = labels.reshape(n, -1)
        for left, right in _pairs(first, count):
            agree = (flat[left] == flat[right]).sum(1)
            good = agree >= p.least_agreement()
            left, right, agree = left[good], right[good], agree[good]
            longest, owner = prefixes(labels[left], labels[right]) if len(left) else (left, left)
            own = (longest == depth[left]) & (owner == tree[left])
            lefts.append(left[own])
            rights.append(right[own])
            tally += np.bincount(agree[own], minlength=len(tally))
        left, right = np.concatenate(lefts or [np.zeros(0, np.int64)]), np.concatenate(rights or [np.zeros(0, np.int64)])
        some = np.unique(np.concatenate((left, right)))
        root = node[_least_linked(n, left, right)[some]]
        seen = np.flatnonzero(tally)
        names = [x.split()[0] for x in _FOUND.split(", ")]
        kinds = [{"int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in _FOUND.split(", ")]
        members = table.take(pa.array(some)).select([*_GROUP, "side", "node"]).append_column("root", pa.array(root, pa.int64()))
        rows = {c: pa.concat_arrays([members[c].combine_chunks().cast(k) if members.num_rows else pa.nulls(0, k), pa.nulls(len(seen), k)]) for c, k in zip(names[:8], kinds, strict=False)}
        none = len(some)
        rows["agreement"] = pa.concat_arrays([pa.nulls(none, pa.int32()), pa.array(seen, pa.int32())])
        rows["pairs"] = pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(tally[seen], pa.int64())])
        return pa.table([rows[c] for c in names], names=names)

    return dealt.groupBy("task").applyInArrow(run, _FOUND)


def descend(sets: DataFrame, p: ForestParams) -> tuple[DataFrame, int, dict[int, int]]:
    """Members of candidate groups, the depth at which the descent ended, and pairs by agreement.

    ``sets`` has (node, n, labels).
    """
    least = p.least_depth()
    keyed = sets.select("node", "n", F.posexplode("labels").alias("tree", "label")).withColumn("prefix", _prefix(least))
    shared = keyed.groupBy("tree", "prefix").agg(F.count("*").alias("rows")).where("rows > 1").select("tree", "prefix")
    near = C.cut(keyed.join(shared, ["tree", "prefix"]).drop("prefix"))  # beyond these nodes no pair can be found
    labels = C.cut(sets.select("node", "labels").join(near.select("node").distinct(), "node", "left_semi"))
    found: DataFrame | None = None
    tally: dict[int, int] = {}
    for depth in range(DEPTH, least - 1, -1):
        dealt = deal(near.join(labels, "node"), branching(near, depth), depth, p)
        now = C.cut(candidates(dealt, p))
        members = now.where("node is not null").drop("agreement", "pairs")
        found = members if found is None else found.unionByName(members)
        for agreement, pairs in now.where("node is null").groupBy("agreement").agg(F.sum("pairs")).collect():  # at most one a number of labels
            tally[agreement] = tally.get(agreement, 0) + pairs
        similar = [a for a in tally if a >= float(p.similarity) * p.values]
        if similar and p.recall(min(similar) / p.values, depth) >= p.target_recall:
            break
    return found, depth, tally


_MEMBER = (*_GROUP, "root")


def verify(rows: DataFrame, p: ForestParams) -> DataFrame:
    """(node, other, links) from rows (task, group, root, side, node, copies, labels, shingles).

    ``links`` counts documents linked to the set's in this task, ``other`` is the
    smallest set that it is joined to here. A pair counts in its own group only.
    """

    def run(table: pa.Table) -> pa.Table:
        table, bounds = _grouped(table, _MEMBER)
        node, side, copies, tree, depth = (np.asarray(table[c]) for c in ("node", "side", "copies", "tree", "depth"))
        labels, blobs = label_bytes(table["labels"], p.trees), table["shingles"]
        crossing = np.asarray(table["low"]) != np.asarray(table["high"])
        lefts, rights = [], []
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = np.arange(a, z)
            own = own[np.concatenate(([True], node[own[1:]] != node[own[:-1]]))]  # a repeated row counts once
            sets = [np.frombuffer(blobs[int(i)].as_py(), np.uint64) for i in own]
            if crossing[a]:
                k = int((side[own] == 0).sum())
                one, two = (own[:k], sets[:k]), (own[k:], sets[k:])
                if not k or k == len(own):
                    continue
                left, right = np.nonzero(linked(one[1], two[1], p.similarity))
                left, right = one[0][left], two[0][right]
            elif len(own) == 2:
                left, right = (own[:1], own[1:]) if linked(sets[:1], sets[1:], p.similarity)[0, 0] else (own[:0], own[:0])
            else:
                left, right = np.nonzero(np.triu(linked(sets, sets, p.similarity), 1))
                left, right = own[left], own[right]
            for at in range(0, len(left), 1 << 17):
                u, v = left[at : at + (1 << 17)], right[at : at + (1 << 17)]
                longest, owner = prefixes(labels[u], labels[v])
                mine = (longest == depth[a]) & (owner == tree[a])
                lefts.append(u[mine])
                rights.append(v[mine])
        left, right = np.concatenate(lefts or [np.zeros(0, np.int64)]), np.concatenate(rights or [np.zeros(0, np.int64)])
        links = np.bincount(left, weights=copies[right], minlength=len(node)) + np.bincount(right, weights=copies[left], minlength=len(node))
        some = np.flatnonzero(links > 0)
        root = _least_linked(len(node), left, right)[some]
        return pa.table([pa.array(node[some]), pa.array(node[root]), pa.array(links[some].astype(np.int64))], names=["node", "other", "links"])

    return rows.groupBy("task").applyInArrow(run, "node long, other long, links long")


def shingles_of(docs: DataFrame, wanted: DataFrame, p: ForestParams) -> DataFrame:
    """(node, shingles) of sets (node, doc_id, h, d1, d2), read again from their first texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch, buf, offs in C.slices(batches):
            values, runs = shingle_sets(buf, offs, p.words)
            d1, d2 = set_digests(values, runs)
            node = batch.column(2).to_pylist()
            right = []
            for i in np.flatnonzero((d1 == np.asarray(batch.column(3))) & (d2 == np.asarray(batch.column(4)))).tolist():
                if node[i] not in done:  # repeated rows
                    done.add(node[i])
                    right.append(i)
            yield pa.record_batch([pa.array([node[i] for i in right], pa.int64()), pa.array([values[runs[i] : runs[i + 1]].tobytes() for i in right], pa.binary())], names=["node", "shingles"])

    return docs.join(wanted, ["doc_id", "h"]).select("doc_id", "text", "node", "d1", "d2").mapInArrow(run, "node long, shingles binary")


def jaccard_rows(documents: DataFrame, p: ForestParams = ForestParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, class_key, class_id, n_links) of every row.

    ``h`` is the xxhash64 of the text, which tells rows of one doc_id apart;
    ``class_key`` is the number of the class, null without shingles or id.
    """
    docs = C.texts(documents, id_col, text_col).withColumn("h", F.xxhash64("text"))
    marked = C.cut(signatures(docs, p))
    same = ["d1", "d2", "n"]
    sets = marked.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.count("*").alias("copies"), F.first("labels").alias("labels"))
    sets = C.cut(sets.select(F.monotonically_increasing_id().alias("node"), *same, "rep.doc_id", "rep.h", "copies", "labels"))
    members, _, _ = descend(sets.select("node", "n", "labels"), p)
    near = C.cut(sets.join(members.select("node").distinct(), "node", "left_semi"))
    bins = max(1, ceil(8 * (members.join(near.select("node", "n"), "node").agg(F.sum("n")).first()[0] or 0) / p.task_bytes))
    texts = shingles_of(docs, C.checked_broadcast(near.select("node", "doc_id", "h", "d1", "d2")), p)
    task = F.pmod(F.xxhash64(*_MEMBER), F.lit(bins)).alias("task")
    rows = members.select(task, *_MEMBER, "side", "node").join(near.select("node", "copies", "labels"), "node")
    found = C.cut(verify(texts.join(rows, "node"), p))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    root = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = root.join(near.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    linked_sets = links.join(root, "node", "left").join(named, "root", "left")
    per_set = sets.select("node", "doc_id", "copies", *same).join(linked_sets, "node", "left")
    per_set = per_set.select(*same, F.coalesce("root", "node").alias("class_key"), F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = marked.select("doc_id", "h", *same).join(per_set, same, "left")
    lone = F.col("doc_id").isNull()
    return joined.select("doc_id", "h", F.when(~lone, F.col("class_key")).alias("class_key"), F.when(~lone, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(lone, F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))


def jaccard_classes(documents: DataFrame, p: ForestParams = ForestParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) of every row."""
    return jaccard_rows(documents, p, id_col, text_col).select("doc_id", "class_id", "n_links")
