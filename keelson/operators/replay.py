"""Claims to attribute values, and deletion.

Replay is relational: a value is held if no later claim of its object and
attribute resets it (a set, or a delete of everything) or deletes that value.
Resets and deletes are aggregates with partial aggregation, so an object with
very many claims never has to fit into one task, as a fold over its list would.
Lists of values are made of claims that were sorted together, and windows over them.
Order of claims is (date, claim_ref).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.scalar import is_ref
from keelson.runtime import cut


#: As many references are broadcast at most.
BROADCAST_REFS = 1_000_000
#: As many signers of a key become a condition at most.
KEY_SIGNERS = 1_000


def place() -> Column:
    return F.struct("date", "claim_ref")


def of_key(claims: DataFrame, signers: DataFrame, key_id: str) -> DataFrame:
    """Claims of all signers that belong to a key.

    A key has few signers, so they are a condition, which reaches the scan. A semi join
    would be taken into every part of a union of claims; where all claims of a part have
    one signer no key is left to join by, and the part itself would be broadcast. Signers
    beyond are joined inside, which stays above the union.
    """
    mine = signers.where(F.col("key_id") == key_id).select("signer").distinct()
    few = [r["signer"] for r in mine.limit(KEY_SIGNERS + 1).collect()]
    if len(few) <= KEY_SIGNERS:
        return claims.where(F.col("signer").isin(few))
    how = "broadcast" if mine.limit(BROADCAST_REFS + 1).count() <= BROADCAST_REFS else "shuffle_hash"
    return claims.join(mine.hint(how), "signer")


def until(claims: DataFrame, at: datetime | Column | None) -> DataFrame:
    """Claims up to a time; without one, claims dated in the future count too."""
    return claims if at is None else claims.where(F.col("date") <= F.lit(at))


def held_values(claims: DataFrame, dedupe: bool = False) -> DataFrame:
    """(permanode, attr, value, date, claim_ref) of every value held after replay.

    A value that was added several times is held as often. With ``dedupe`` it is
    the presentation's replay: empty values are never held and a value is held
    once, in the place of its first addition.
    """
    c = claims.where("ctype in ('set-attribute', 'add-attribute', 'del-attribute')").select("permanode", "attr", "value", "date", "claim_ref", "ctype")
    reset = c.where("ctype = 'set-attribute' or (ctype = 'del-attribute' and value = '')")
    reset = reset.groupBy("permanode", "attr").agg(F.max(place()).alias("reset"))
    gone = c.where("ctype = 'del-attribute' and value <> ''").groupBy("permanode", "attr", "value").agg(F.max(place()).alias("gone"))
    added = c.where("ctype <> 'del-attribute'").join(reset, ["permanode", "attr"], "left").join(gone, ["permanode", "attr", "value"], "left")
    is_reset = F.col("ctype") == "set-attribute"
    held = added.where((F.col("reset").isNull() | (place() > F.col("reset")) | (is_reset & (place() == F.col("reset")))) & (F.col("gone").isNull() | (place() > F.col("gone"))))
    held = held.select("permanode", "attr", "value", "date", "claim_ref")
    if dedupe:
        first = held.where("value <> ''").groupBy("permanode", "attr", "value").agg(F.min(place()).alias("p"))
        held = first.select("permanode", "attr", "value", "p.date", "p.claim_ref")
    return held


def attributes(claims: DataFrame, dedupe: bool = False, again: bool = False) -> DataFrame:
    """(permanode, attr, vals): held values in order of their claims.

    A list gathers an attribute of an object, so its claims meet first and windows, which
    spill, say what is held: every claim is shuffled once, where ``held_values`` shuffles
    it for each join. With ``dedupe`` the replay is the presentation's; ``again`` says that
    a claim may come several times and counts once.
    """
    c = claims.where("ctype in ('set-attribute', 'add-attribute', 'del-attribute')").select("permanode", "attr", "value", "date", "claim_ref", "ctype")
    known, is_set, deletes = F.expr("permanode is not null and attr is not null"), F.col("ctype") == "set-attribute", F.col("ctype") == "del-attribute"
    reset = F.max(F.when(known & (is_set | (deletes & (F.col("value") == ""))), place())).over(Window.partitionBy("permanode", "attr"))
    gone = F.max(F.when(known & deletes & (F.col("value") != ""), place())).over(Window.partitionBy("permanode", "attr", "value"))
    c = c.withColumn("reset", reset).withColumn("gone", gone).where(~deletes)
    held = c.where((F.col("reset").isNull() | (place() > F.col("reset")) | (is_set & (place() == F.col("reset")))) & (F.col("gone").isNull() | (place() > F.col("gone"))))
    if dedupe:
        first = held.where("value <> ''").groupBy("permanode", "attr", "value").agg(F.min(place()).alias("p"))
        held = first.select("permanode", "attr", "value", "p.date", "p.claim_ref")
    collect = F.collect_set if again else F.collect_list
    held = held.groupBy("permanode", "attr").agg(F.sort_array(collect(F.struct("date", "claim_ref", "value"))).alias("l"))
    return held.select("permanode", "attr", F.col("l.value").alias("vals"))


def first_values(claims: DataFrame) -> DataFrame:
    """(permanode, attr, value) with the first held value."""
    return held_values(claims).groupBy("permanode", "attr").agg(F.min_by("value", place()).alias("value"))


def pivoted(claims: DataFrame, names: list[str], read: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """(permanode, a column for each name): first held values, as ``read`` gives them, of objects that hold any.

    A single claim on an attribute needs no replay, so one aggregation gives most
    objects, and which have more claims; only the claims of those are replayed.
    """
    c = claims.where(F.col("attr").isin(names) & F.col("ctype").isin("set-attribute", "add-attribute", "del-attribute"))
    adds = F.col("ctype") != "del-attribute"
    most = F.greatest(F.lit(0).cast("bigint"), *(F.count_if(F.col("attr") == n) for n in names))
    once = cut(c.groupBy("permanode").agg(F.count_if(adds).alias("held"), most.alias("most"), *(F.max(F.when(adds & (F.col("attr") == n), read(F.col("value")))).alias(n) for n in names)))
    alone, more = once.where("most = 1 and held > 0").select("permanode", *names), once.where("most > 1").select("permanode")
    n_more = more.limit(BROADCAST_REFS + 1).count()
    if not n_more:
        return alone
    rest = c.join(more.hint("broadcast" if n_more <= BROADCAST_REFS else "shuffle_hash"), "permanode", "left_semi")
    first = first_values(rest).groupBy("permanode").agg(*(F.max(F.when(F.col("attr") == n, read(F.col("value")))).alias(n) for n in names))
    return alone.unionByName(first)


def contents(claims: DataFrame) -> DataFrame:
    """(permanode, value, date): what an object's last camliContent claim set.

    Claims of all signers count, deleted ones too. Another set replaces, a delete
    of whatever value clears, and additions are not looked at.
    """
    rows = claims.where("attr = 'camliContent' and ctype in ('set-attribute', 'del-attribute')")
    last = rows.groupBy("permanode").agg(F.max_by(F.struct("ctype", "value", "date"), place()).alias("l"))
    return last.where("l.ctype = 'set-attribute'").select("permanode", "l.value", "l.date").where(is_ref(F.col("value")))


def first_seen(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, date, claim_ref) of distinct keys, in the place of their first claim."""
    return rows.groupBy(*keys).agg(F.min(place()).alias("p")).select(*keys, "p.date", "p.claim_ref").orderBy("date", "claim_ref")


def update_deleted(dead: DataFrame, known: DataFrame, new: DataFrame) -> DataFrame:
    """(ref) of what is deleted after more deletions (target, deleter) arrived.

    Only chains that a new deletion touches are settled again: from its ends along
    known deletions in both directions. All others stay as they were in ``dead``.
    """
    links = known.unionByName(new).select("target", "deleter").distinct()
    touched = cut(new.select(F.col("target").alias("ref")).union(new.select("deleter")).distinct())
    frontier = touched
    while not frontier.isEmpty():
        near = links.join(frontier.withColumnRenamed("ref", "deleter"), "deleter", "left_semi").select(F.col("target").alias("ref")).union(links.join(frontier.withColumnRenamed("ref", "target"), "target", "left_semi").select("deleter"))
        frontier = cut(near.distinct().join(touched, "ref", "left_anti"))
        touched = cut(touched.unionByName(frontier))
    again = deleted(links.join(touched.withColumnRenamed("ref", "target"), "target", "left_semi"))
    return dead.join(touched, "ref", "left_anti").unionByName(again)


def has_value(claims: DataFrame, attr: str, value: str) -> DataFrame:
    """Objects that hold a value of an attribute."""
    return held_values(claims.where(F.col("attr") == attr)).where(F.col("value") == value).select("permanode").distinct()


def deleted(deletions: DataFrame) -> DataFrame:
    """(ref): what is deleted by a deleter that is not deleted itself.

    Deleters that nobody deletes are alive; what they delete is dead, and what
    the dead deleted is no longer. Every round settles one level of the chain,
    at the cost of one checkpoint.
    """
    edges = deletions.select("target", "deleter").distinct()
    dead: DataFrame | None = None
    while True:
        targets = edges.select(F.col("target").alias("deleter"), F.lit(True).alias("hit")).distinct()
        level = cut(edges.join(targets, "deleter", "left").select("target", "deleter", F.col("hit").isNull().alias("alive")))
        now = level.where("alive").select("target").distinct()
        dead = now if dead is None else dead.unionByName(now)
        rest = level.where("not alive").drop("alive")
        if rest.isEmpty() or now.isEmpty():  # nobody alive: a cycle, which content addressing rules out
            return dead.select(F.col("target").alias("ref")).distinct()
        edges = rest.join(now, "target", "left_anti").join(now.select(F.col("target").alias("deleter")), "deleter", "left_anti")


def not_deleted(rows: DataFrame, dead: DataFrame, *columns: str) -> DataFrame:
    """Rows none of whose columns names something deleted.

    The rows are many and what is deleted are few of them: that is counted, and
    broadcast if it is small; else both are shuffled, but only the deleted is hashed
    and no row is sorted.
    """
    how = "broadcast" if dead.limit(BROADCAST_REFS + 1).count() <= BROADCAST_REFS else "shuffle_hash"
    for c in columns:
        rows = rows.join(dead.select(F.col("ref").alias(c)).hint(how), c, "left_anti")
    return rows


def modtimes(claims: DataFrame, dead: DataFrame) -> DataFrame:
    """(permanode, mod): newest date of an object's claims of any signer that are not deleted."""
    return not_deleted(claims, dead, "claim_ref").groupBy("permanode").agg(F.max("date").alias("mod"))
