"""Lookups that read the tables without a constraint: recent objects, claims, paths, references."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.model import INDEXED_ATTRS, Store
from keelson.operators import replay
from keelson.runtime import QueryError


def recent(store: Store, dead: DataFrame, before: datetime | None = None, limit: int = 50) -> DataFrame:
    """(permanode, signer, mod): objects by their newest claim; one whose newest is not before the time is left out."""
    claims = replay.of_key(replay.not_deleted(store.claims, dead, "claim_ref", "permanode"), store.signers, store.owner_key)
    last = claims.groupBy("permanode").agg(F.max(F.struct("date", "claim_ref", "signer")).alias("l")).select("permanode", "l.signer", F.col("l.date").alias("mod"))
    if before is not None:
        last = last.where(F.col("mod") < F.lit(before))
    return last.orderBy(F.desc("mod"), F.desc("permanode")).limit(limit)


def by_attribute(store: Store, dead: DataFrame, attr: str, value: str = "", limit: int = 50, fuzzy: bool = False) -> DataFrame:
    """(permanode) ever given a value of an indexed attribute, newest first; later deletes of values are not seen.

    A limit of 0 asks for all of them.
    """
    if attr not in INDEXED_ATTRS:
        return store.claims.select("permanode").limit(0)
    if fuzzy:
        raise QueryError("fuzzy matching is not supported")
    c = replay.not_deleted(store.claims, dead, "claim_ref", "permanode").where((F.col("attr") == attr) & F.col("ctype").isin("set-attribute", "add-attribute"))
    c = replay.of_key(c, store.signers, store.owner_key)
    if value:
        c = c.where(F.col("value") == value)
    newest = c.groupBy("permanode").agg(F.max("date").alias("date")).orderBy(F.desc("date"), "permanode")
    return (newest.limit(limit) if limit > 0 else newest).select("permanode")


def claims_of(store: Store, dead: DataFrame, permanode: str, attr: str = "") -> DataFrame:
    """The owner's claims on an object that are not deleted, by date."""
    c = store.claims.where(F.col("permanode") == permanode)
    if attr:
        c = c.where(F.col("attr") == attr)
    return replay.of_key(replay.not_deleted(c, dead, "claim_ref"), store.signers, store.owner_key).orderBy("date", "claim_ref")


def object_of_value(store: Store, dead: DataFrame, signer: str, attr: str, value: str) -> DataFrame:
    """(permanode) with the newest live claim of exactly this signer, attribute and value."""
    c = store.claims.where((F.col("signer") == signer) & (F.col("attr") == attr) & (F.col("value") == value) & F.col("ctype").isin("set-attribute", "add-attribute"))
    c = replay.not_deleted(c, dead, "claim_ref", "permanode")
    return c.orderBy(F.desc("date"), F.desc("claim_ref")).limit(1).select("permanode")


def paths_to(store: Store, dead: DataFrame, target: str) -> DataFrame:
    """Active paths to a target: of each base and suffix the newest claim counts, if it is active."""
    newest = replay.not_deleted(store.paths, dead, "claim_ref").where(F.col("target") == target).groupBy("signer", "base", "suffix").agg(F.max(F.struct("date", "claim_ref", "active", "target")).alias("p"))
    return newest.select("signer", "base", "suffix", "p.*").where("active").drop("active")


def active_paths(store: Store, dead: DataFrame) -> DataFrame:
    """(signer, base, suffix, target, date) of every path whose newest claim is active."""
    newest = replay.not_deleted(store.paths, dead, "claim_ref").groupBy("signer", "base", "suffix").agg(F.max(F.struct("date", "claim_ref", "active", "target")).alias("p"))
    return newest.where("p.active").select("signer", "base", "suffix", "p.target", "p.date")


def paths_at(store: Store, dead: DataFrame, at: datetime) -> DataFrame:
    """(signer, base, suffix, target, date): the newest path of each base and suffix at a second; activity is not asked."""
    p = replay.not_deleted(store.paths, dead, "claim_ref").where(F.unix_seconds("date") <= F.unix_seconds(F.lit(at)))
    return p.groupBy("signer", "base", "suffix").agg(F.max(F.struct("date", "claim_ref", "target")).alias("p")).select("signer", "base", "suffix", "p.target", "p.date")


def edges_to(store: Store, dead: DataFrame, verified: bool = False) -> DataFrame:
    """(child, parent, name): objects that refer to others as members or paths.

    Deleted parents and claims are left out. ``verified`` asks that the parent
    still holds the reference.
    """
    member = (F.col("attr") == "camliMember") | F.col("attr").startswith("camliPath:")
    c = replay.not_deleted(store.claims.where(member & F.col("ctype").isin("set-attribute", "add-attribute")), dead, "claim_ref", "permanode")
    edges = c.groupBy(F.col("value").alias("child"), F.col("permanode").alias("parent")).agg(F.min("attr").alias("name"))
    if verified:
        held = replay.held_values(store.claims.where(member)).select(F.col("value").alias("child"), F.col("permanode").alias("parent"))
        edges = edges.join(held, ["child", "parent"], "left_semi")
    return edges


def existing_files(store: Store) -> DataFrame:
    """(whole_ref, files): all file references of one content, sorted."""
    return store.files.where("whole_ref <> ''").groupBy("whole_ref").agg(F.array_sort(F.collect_set("file_ref")).alias("files"))


def media_tags(store: Store) -> DataFrame:
    """(file_ref, tags map) through the content's digest."""
    tags = store.media_tags.groupBy("whole_ref").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("tag", "value")))).alias("tags"))
    return store.files.join(tags, "whole_ref").select("file_ref", "tags")


def stored_searches(store: Store, times: DataFrame, dead: DataFrame, blobs: DataFrame) -> DataFrame:
    """(name, permanode, text) of searches that are kept in objects: of each name the newest object counts.

    ``times`` has (ref, any_time); the text is the blob (ref, data) that the object's
    content refers to, null if it is not there.
    """
    mine = replay.not_deleted(replay.of_key(store.claims.where("attr in ('camliNamedSearch', 'camliContent')"), store.signers, store.owner_key), dead, "permanode")
    named = replay.held_values(mine.where("attr = 'camliNamedSearch'")).select("permanode", F.col("value").alias("name")).distinct()
    newest = named.join(times.select(F.col("ref").alias("permanode"), "any_time"), "permanode").groupBy("name").agg(F.max(F.struct("any_time", "permanode")).alias("l")).select("name", "l.permanode")
    shown = replay.held_values(replay.not_deleted(mine.where("attr = 'camliContent'"), dead, "claim_ref"), dedupe=True)
    content = shown.groupBy("permanode").agg(F.min_by("value", replay.place()).alias("ref"))
    return newest.join(content, "permanode", "left").join(blobs.select("ref", F.decode("data", "UTF-8").alias("text")), "ref", "left").select("name", "permanode", "text")


def named_search(searches: DataFrame) -> Callable[[str], str]:
    """What the keyword for stored searches asks: the text of a name, from ``stored_searches``."""

    def text(name: str) -> str:
        row = searches.where(F.col("name") == name).first()
        if row is None or row["text"] is None:
            raise QueryError(f"no search is kept under the name {name!r}")
        return row["text"]

    return text


def recent_names(store: Store, dead: DataFrame, limit: int = 100) -> DataFrame:
    """(name, permanode, file_ref) of recent objects with a file; of equal names the newest stays."""
    first = replay.first_values(replay.of_key(store.claims, store.signers, store.owner_key)).where("attr = 'camliContent'")
    rows = recent(store, dead, None, limit).join(first.select("permanode", F.col("value").alias("file_ref")), "permanode").join(store.files.select("file_ref", "file_name"), "file_ref")
    w = Window.partitionBy("file_name").orderBy(F.desc("mod"), "permanode")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("file_name").alias("name"), "permanode", "file_ref")
