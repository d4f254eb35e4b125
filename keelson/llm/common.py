"""Shared helpers: batch-wise access to UTF-8 bytes and vectorised word hashing.

All numpy work here runs inside Spark tasks on one Arrow batch at a time.
Null texts count as empty; offsets are byte offsets into the UTF-8 form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step looks at (a longer single text is one step).
SLICE_BYTES = 1 << 20
#: Rows up to which an id list is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

_rng = np.random.RandomState(20240229)
_BYTE = _rng.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Bytes outside [\x20\x09-\x0D]: what words of the quality rules consist of.
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
NOT_TAIL = np.ones(256, bool)  # false for UTF-8 continuation bytes
NOT_TAIL[0x80:0xC0] = False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) alone, so that other columns cannot clash."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def with_others(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list]:
    """doc_id and text first, then all other columns under numbered names, and their fields."""
    others = [f for f in df.schema.fields if f.name not in (id_col, text_col)]
    small_batches(df.sparkSession)
    cols = [F.col(f"`{f.name}`").alias(f"other_{i}") for i, f in enumerate(others)]
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *cols), others


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def checked_broadcast(ids: DataFrame) -> DataFrame:
    """Mark ``ids`` for broadcast only if its counted rows prove it small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its texts."""
    col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(bufs[1], kind, count=len(col) + 1, offset=col.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches (doc_id, text, ...) so that each cut has about ``limit`` bytes."""
    for batch in batches:
        buf, offs = utf8(batch.column(1))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; changes ``x`` in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (1 << 18))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the polynomial of bytes i..j, for ``span_hash``."""
    out = np.zeros(len(buf) + 1, np.uint64)
    vals = _BYTE[buf]
    vals *= powers(len(buf), _MULT)
    np.cumsum(vals, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal values everywhere."""
    h = prefix[end] - prefix[start]
    h *= powers(len(prefix), _INV)[start]
    return mix(h)


def word_spans(buf: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of maximal runs of member bytes."""
    mask = member[buf]
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], mask[:-1]))
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    after = np.concatenate((mask[1:], [False]))
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0])


def runs_of(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """First position of each document in a sorted list of document indexes, and its end."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def per_doc_sum(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` (per byte) over documents."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def text_stats(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every text: words, symbols, repeated lines and three-word windows, letters."""
    n = len(offs) - 1
    starts, ends, doc = word_spans(buf, offs, IN_WORD)
    prefix = prefix_hash(buf)
    out = {"n_bytes": np.diff(offs), "n_words": np.bincount(doc, minlength=n)}
    heads = NOT_TAIL[buf]
    out["n_chars"] = per_doc_sum(heads, offs)
    out["word_chars"] = per_doc_sum(heads & IN_WORD[buf], offs)
    out["n_symbols"] = per_doc_sum(SYMBOL[buf], offs)
    out["n_upper"] = per_doc_sum((buf >= 65) & (buf <= 90), offs)
    out["n_lower"] = per_doc_sum((buf >= 97) & (buf <= 122), offs)
    out["n_digits"] = per_doc_sum((buf >= 48) & (buf <= 57), offs)
    out["n_bangs"] = per_doc_sum((buf == 33), offs)
    out["n_stops"] = per_doc_sum((buf == 46) | (buf == 44), offs)
    # lines
    cuts = np.flatnonzero(buf == 10)
    l_start = np.sort(np.concatenate((offs[:-1], cuts + 1)), kind="stable")
    l_end = np.sort(np.concatenate((cuts, offs[1:])), kind="stable")
    has = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    l_start, l_end = l_start[has], l_end[has]
    l_doc = np.searchsorted(offs, l_start, side="right") - 1
    keys = mix(span_hash(prefix, l_start, l_end) + l_doc.astype(np.uint64) * np.uint64(_MULT))
    _, first = np.unique(keys, return_index=True)
    out["n_lines"] = np.bincount(l_doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(l_doc[first], minlength=n)
    # words
    h = span_hash(prefix, starts, ends)
    salt = doc.astype(np.uint64) * np.uint64(_MULT)
    _, first = np.unique(mix(h + salt), return_index=True)
    out["n_distinct_words"] = np.bincount(doc[first], minlength=n)
    out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(h) >= 3:
        tri = mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(0x632BE59BD9B4E019) + h[2:] * np.uint64(_MULT) + salt[:-2])
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        order = inside[np.argsort(tri[inside])]
        same = tri[order[1:]] == tri[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        cover = np.zeros(len(h), bool)
        at = order[twice]
        for k in range(3):
            cover[at + k] = True
        out["n_repeat_words"] = np.bincount(doc[cover], minlength=n)
    return out


def long_column(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, np.int64))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode, where all share one disk, else one below /tmp."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = "/tmp/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that an operator wrote into the shared folder for itself."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a checkpoint in the shared folder: survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sliding(x: np.ndarray, width: int, op: np.ufunc, fill: int, forward: bool) -> np.ndarray:
    """``op`` over [i, i + width) (forward) or (i - width, i], by doubling."""
    size = 1
    while size < width:
        step = min(size, width - size)
        moved = np.full_like(x, fill)
        if forward:
            moved[:-step] = x[step:]
        else:
            moved[step:] = x[:-step]
        x = op(x, moved)
        size += step
    return x
