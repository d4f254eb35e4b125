"""Set operations between collections of blobs (ref, size), reachability, and validation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions import scalar as S
from keelson.runtime import QueryError, cut


def enumerate_blobs(blobs: DataFrame, after: str = "", limit: int = 1000) -> DataFrame:
    """Blobs in order of reference after a cursor."""
    return blobs.where(F.col("ref") > after).orderBy("ref").limit(limit)


def stat(blobs: DataFrame, refs: DataFrame) -> DataFrame:
    return blobs.join(refs.select("ref").distinct(), "ref", "left_semi").select("ref", "size")


def in_range(rows: DataFrame, start: str, end: str = "", key: str = "ref") -> DataFrame:
    """Rows with start <= key < end in order; an empty end is open."""
    rows = rows.where(F.col(key) >= start)
    return (rows.where(F.col(key) < end) if end else rows).orderBy(key)


def with_prefix(rows: DataFrame, prefix: str, key: str = "ref") -> DataFrame:
    return rows.where(F.col(key).startswith(prefix))


def union(*sources: DataFrame) -> DataFrame:
    """All blobs once; of equal references the first source's size stays."""
    out = None
    for i, s in enumerate(sources):
        s = s.select("ref", "size", F.lit(i).alias("source"))
        out = s if out is None else out.unionAll(s)
    return out.groupBy("ref").agg(F.min_by("size", "source").alias("size"))


replica = union


def overlay(upper: DataFrame, lower: DataFrame, gone: DataFrame) -> DataFrame:
    """The upper store over the lower one, without tombstones."""
    return union(upper, lower).join(gone.select("ref"), "ref", "left_anti")


def namespace(blobs: DataFrame, inventory: DataFrame) -> DataFrame:
    return blobs.join(inventory.select("ref").distinct(), "ref", "left_semi")


def missing(source: DataFrame, target: DataFrame) -> DataFrame:
    """Blobs of the source that the target has not."""
    return source.join(target.select("ref"), "ref", "left_anti").select("ref", "size")


def size_mismatches(source: DataFrame, target: DataFrame) -> DataFrame:
    both = source.select("ref", F.col("size").alias("source_size")).join(target.select("ref", F.col("size").alias("target_size")), "ref")
    return both.where("source_size <> target_size")


def validation(source: DataFrame, target: DataFrame) -> DataFrame:
    """(ref, problem) of all differences between two stores, both ways, in one join."""
    both = source.select("ref", F.col("size").alias("a")).join(target.select("ref", F.col("size").alias("b")), "ref", "full")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "size")
    return both.select("ref", problem.alias("problem")).where("problem is not null")


def shard(blobs: DataFrame, shards: int) -> DataFrame:
    """Blobs with the shard that the first bits of their digest choose."""
    return blobs.withColumn("shard", (S.sum32(F.col("ref")) % shards).cast("int"))


def route(blobs: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Blobs that satisfy a condition, and the others."""
    return blobs.where(S.true(condition)), blobs.where(~S.true(condition))


def totals(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def verify_sample(source: DataFrame, target: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """(ref, problem) of sampled blobs (ref, data) whose copy is missing or does not hash to its name."""
    digest = F.substring_index("ref", "-", 1)
    named = F.when(digest == "sha1", F.sha1("data")).when(digest == "sha224", F.sha2("data", 224)).otherwise(F.sha2("data", 256))
    copies = target.select("ref", (named == F.substring_index("ref", "-", -1)).alias("good"))
    rows = source.select("ref").sample(fraction, seed).join(copies, "ref", "left")
    return rows.where("good is null or not good").select("ref", F.when(F.col("good").isNull(), "missing").otherwise("digest").alias("problem"))


def attribute_changes(have: DataFrame, want: DataFrame) -> DataFrame:
    """Claims (permanode, attr, ctype, value) that turn held values into wanted ones, and no others."""
    both = have.groupBy("permanode", "attr").agg(F.collect_set("value").alias("old")).join(want.groupBy("permanode", "attr").agg(F.collect_set("value").alias("new")), ["permanode", "attr"], "right")
    old, new = F.coalesce("old", F.array().cast("array<string>")), F.col("new")
    changes = F.concat(F.transform(F.array_except(old, new), lambda v: F.struct(F.lit("del-attribute").alias("ctype"), v.alias("value"))), F.transform(F.array_except(new, old), lambda v: F.struct(F.lit("add-attribute").alias("ctype"), v.alias("value"))))
    return both.select("permanode", "attr", F.explode(changes).alias("c")).select("permanode", "attr", "c.ctype", "c.value")


def reachable(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(ref) that can be reached from the roots along (ref, next)."""
    links = cut(links.select("ref", "next").distinct())
    known = frontier = cut(roots.select("ref").distinct())
    while True:
        frontier = cut(frontier.join(links, "ref").select(F.col("next").alias("ref")).distinct().join(known, "ref", "left_anti"))
        if frontier.isEmpty():
            return known
        known = cut(known.unionByName(frontier))


def garbage(blobs: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """Blobs that no root reaches."""
    return blobs.join(reachable(links, roots), "ref", "left_anti")


def share_allows(shares: DataFrame, mentions: DataFrame, chain: list[str], now: datetime) -> bool:
    """Whether a chain of references is authorised: a live share first, its target next, and so on.

    ``shares`` has (ref, target, transitive, expires, deleted), ``mentions``
    (ref, next). More than one hop after the share's target needs a transitive
    share; each blob must mention the next.
    """
    if len(chain) < 2:
        raise QueryError("a chain has a share and at least its target")
    share = shares.where((F.col("ref") == chain[0]) & ~S.true(F.col("deleted")) & (F.col("expires").isNull() | (F.col("expires") > F.lit(now)))).first()
    if share is None or share["target"] != chain[1] or (len(chain) > 2 and not share["transitive"]):
        return False
    hops = list(zip(chain[1:-1], chain[2:], strict=True))
    if not hops:
        return True
    wanted = shares.sparkSession.createDataFrame(hops, "ref string, next string").distinct()
    return wanted.join(mentions, ["ref", "next"], "left_anti").isEmpty()


def outside_domain(rows: DataFrame, domain: DataFrame) -> DataFrame:
    """(ref) of an application's results that lie outside the domain that it may see."""
    return rows.select("ref").distinct().join(domain.select("ref"), "ref", "left_anti")


def within_domain(rows: DataFrame, domain: DataFrame) -> bool:
    """Whether an application's results all lie in the domain that it may see."""
    return outside_domain(rows, domain).isEmpty()


def shares_allow(shares: DataFrame, mentions: DataFrame, chains: DataFrame, now: datetime) -> DataFrame:
    """(chain_id, allowed) of many chains (chain_id, chain array) by the rules of ``share_allows``."""
    hops = F.transform(F.sequence(F.lit(1), F.greatest(F.size("chain") - 2, F.lit(1))), lambda i: F.struct(F.get("chain", i).alias("ref"), F.get("chain", i + 1).alias("next")))
    hop = chains.where("size(chain) > 2").select("chain_id", F.explode(hops).alias("h")).select("chain_id", "h.*")
    broken = hop.join(mentions.select("ref", "next").distinct(), ["ref", "next"], "left_anti").select("chain_id").distinct().withColumn("broken", F.lit(True))
    live = shares.where(~S.true(F.col("deleted")) & (F.col("expires").isNull() | (F.col("expires") > F.lit(now)))).select(F.col("ref").alias("first"), F.col("target").alias("target"), "transitive")
    rows = chains.withColumn("first", F.get("chain", F.lit(0))).join(live, "first", "left").join(broken, "chain_id", "left")
    allowed = (F.size("chain") >= 2) & (F.col("target") == F.get("chain", F.lit(1))) & ((F.size("chain") == 2) | F.col("transitive")) & F.col("broken").isNull()
    return rows.select("chain_id", S.true(allowed).alias("allowed"))


def archives(blobs: DataFrame, min_bytes: int) -> DataFrame:
    """(ref, size, archive): blobs in order of reference, bundled by their place in the sum of all sizes.

    An archive has the blobs that begin in one stretch of ``min_bytes``, so it
    differs from the minimum by less than a blob at either end. Sums are taken
    over ranges of references first and inside each range then, so neither all
    blobs nor an archive have to meet in one task.
    """
    ranged = cut(blobs.select("ref", "size").repartitionByRange("ref").withColumn("part", F.spark_partition_id()))
    sums = sorted((r["part"], r["bytes"]) for r in ranged.groupBy("part").agg(F.sum("size").alias("bytes")).collect())  # a row a range
    starts, total = [], 0
    for part, size in sums:
        starts.append((part, total))
        total += size
    begin = blobs.sparkSession.createDataFrame(starts, "part int, begin bigint")
    before = Window.partitionBy("part").orderBy("ref").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.join(F.broadcast(begin), "part").withColumn("at", F.col("begin") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    return rows.select("ref", "size", F.floor(F.col("at") / min_bytes).cast("bigint").alias("archive"))
