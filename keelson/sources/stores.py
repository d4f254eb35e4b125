"""Blob stores as tables (ref, size, data) behind one registry of kinds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import scalar as S
from keelson.runtime import QueryError

_KINDS: dict[str, Callable[..., DataFrame]] = {}


def register(kind: str, reader: Callable[..., DataFrame]) -> None:
    """Make a kind of store known; its reader gets (spark, **options)."""
    if kind in _KINDS:
        raise QueryError(f"store kind {kind!r} is registered already")
    _KINDS[kind] = reader


def read(spark: SparkSession, kind: str, **options) -> DataFrame:
    if kind not in _KINDS:
        raise QueryError(f"unknown store kind {kind!r}")
    return _KINDS[kind](spark, **options)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """One file a blob, named by its reference; any file system that Spark reads."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.regexp_extract("path", r"([a-z0-9]+-[0-9a-f]+)(?:\.dat)?$", 1).alias("ref"), F.col("length").alias("size"), F.col("content").alias("data")).where("ref <> ''")


def _packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ref string, size bigint, data binary").parquet(path)


def _jdbc(spark: SparkSession, **options) -> DataFrame:
    """Key-value rows of a database as (key, value)."""
    return spark.read.format("jdbc").options(**options).load()


register("filesystem", _files)
register("packed", _packed)
register("jdbc", _jdbc)


def received(rows: DataFrame) -> DataFrame:
    """Blobs (ref, data) whose bytes hash to their name, each once."""
    name = F.substring_index("ref", "-", 1)
    own = F.when(name == "sha1", F.sha1("data")).when(name == "sha224", F.sha2("data", 224)).when(name == "sha256", F.sha2("data", 256))
    good = rows.where(S.true(F.concat_ws("-", name, own) == F.col("ref")))
    return good.dropDuplicates(["ref"]).select("ref", F.octet_length("data").cast("bigint").alias("size"), "data")


def write_packed(blobs: DataFrame, path: str) -> None:
    blobs.select("ref", "size", "data").write.mode("append").parquet(path)


def compact(blobs: DataFrame, chunks: DataFrame, path: str) -> None:
    """Rewrite blobs so that the chunks of one file lie together: chunks has (whole_ref, blob_ref, pos).

    Ranges of (whole_ref, pos) keep the order, and a very large file spans several
    of them. A manifest says which chunks a file has, with their sizes.
    """
    rows = blobs.join(chunks.select(F.col("blob_ref").alias("ref"), "whole_ref", "pos"), "ref")
    rows.repartitionByRange("whole_ref", "pos").sortWithinPartitions("whole_ref", "pos").write.mode("overwrite").parquet(f"{path}/data")
    written = blobs.sparkSession.read.parquet(f"{path}/data").select("whole_ref", "pos", "ref", "size")
    written.write.mode("overwrite").parquet(f"{path}/manifest")


def removed(blobs: DataFrame, refs: DataFrame) -> DataFrame:
    """The store without some blobs."""
    return blobs.join(refs.select("ref").distinct(), "ref", "left_anti")


def encrypted(blobs: DataFrame, key: bytes) -> DataFrame:
    """(ref, data) with data under AES in GCM mode; the reference is bound to it."""
    return blobs.select("ref", F.aes_encrypt("data", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.encode("ref", "UTF-8")).alias("data"))


def decrypted(blobs: DataFrame, key: bytes) -> DataFrame:
    """(ref, data); what was not made with this key and reference gives null."""
    return blobs.select("ref", F.try_aes_decrypt("data", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.encode("ref", "UTF-8")).alias("data"))
