"""Descriptions: one record a reference, and growth along references and rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions import scalar as S
from keelson.model import Store
from keelson.operators import replay
from keelson.plans.search import page_size
from keelson.runtime import cut


def of_refs(rows: DataFrame, refs: DataFrame, column: str) -> DataFrame:
    """Rows whose column is one of the references, which are many at times and then hashed in shuffled tasks.

    What lies outside of the range of the references is left out before that.
    ``refs`` should be cheap to read, as it is counted.
    """
    refs = refs.select(F.col("ref").alias(column)).distinct()
    n, low, high = refs.agg(F.count("*"), F.min(column), F.max(column)).first()
    if not n:
        return rows.limit(0)
    how = "broadcast" if n <= replay.BROADCAST_REFS else "shuffle_hash"
    return rows.where(F.col(column).between(low, high)).join(refs.hint(how), column, "left_semi")


def _claims(store: Store, dead: DataFrame, at=None, refs: DataFrame | None = None, wanted: Column | None = None) -> DataFrame:
    """Live claims of the owner on the given objects (default: all), which are chosen before anything else is done.

    ``wanted`` is a condition on the attribute. The claims of an object are in one
    partition, so that replay asks for no other shuffle.
    """
    c = replay.until(store.claims, at).where("ctype in ('set-attribute', 'add-attribute', 'del-attribute')")
    if wanted is not None:
        c = c.where(wanted)
    c = replay.of_key(c, store.signers, store.owner_key).select("permanode", "attr", "value", "date", "claim_ref", "ctype")
    if refs is not None:
        c = of_refs(c, refs, "permanode")
    return replay.not_deleted(c, dead, "claim_ref").repartition("permanode")


_RESET = "ctype = 'set-attribute' or (ctype = 'del-attribute' and value = '')"


def described_values(store: Store, dead: DataFrame, at=None, refs: DataFrame | None = None, wanted: Column | None = None) -> DataFrame:
    """Held values as descriptions show them: live claims of the owner, no empty and no double values.

    The same as ``replay.held_values`` with ``dedupe``, but the claims, which are few
    of the store's, are found once and not for additions, resets and deletes each.
    """
    c = _claims(store, dead, at, refs, wanted).withColumn("p", replay.place())
    value, attr = Window.partitionBy("permanode", "attr", "value"), Window.partitionBy("permanode", "attr")
    c = c.withColumn("gone", F.max(F.when(F.expr("ctype = 'del-attribute' and value <> ''"), F.col("p"))).over(value)).withColumn("reset", F.max(F.when(F.expr(_RESET), F.col("p"))).over(attr))
    held = c.where("ctype <> 'del-attribute' and value <> '' and (reset is null or p > reset or (ctype = 'set-attribute' and p = reset)) and (gone is null or p > gone)")
    first = held.groupBy("permanode", "attr", "value").agg(F.min("p").alias("p"))
    return first.select("permanode", "attr", "value", "p.date", "p.claim_ref")


def described_modtimes(store: Store, dead: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """(permanode, mod): date of the last claim that had an effect in the description's replay.

    Deletes always have one; additions do unless they are empty or the value is held
    already. Whether it is held is asked of the claims before, in windows over an
    attribute of an object.
    """
    c = _claims(store, dead, None, refs).withColumn("p", replay.place())
    attr = Window.partitionBy("permanode", "attr").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    value = Window.partitionBy("permanode", "attr", "value").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("reset", F.max(F.when(F.expr(_RESET), F.col("p"))).over(attr)).withColumn("added", F.max(F.when(F.col("ctype") != "del-attribute", F.col("p"))).over(value)).withColumn("gone", F.max(F.when(F.col("ctype") == "del-attribute", F.col("p"))).over(value))
    held = S.true(F.col("added").isNotNull() & (F.col("reset").isNull() | (F.col("added") >= F.col("reset"))) & (F.col("gone").isNull() | (F.col("added") > F.col("gone"))))
    effect = F.when(F.col("ctype") == "del-attribute", F.lit(True)).otherwise((F.col("value") != "") & ((F.col("ctype") == "set-attribute") | ~held))
    return c.where(effect).groupBy("permanode").agg(F.max("date").alias("mod"))


def records(store: Store, refs: DataFrame, dead: DataFrame, places: DataFrame | None = None, at=None) -> DataFrame:
    """One record for each known reference: metadata, attributes, file, image, media tags, children."""
    meta = cut(store.blob_meta.join(refs.select("ref").distinct(), "ref", "left_semi"))
    values = described_values(store, dead, at, meta)
    lists = values.groupBy("permanode", "attr").agg(F.array_sort(F.collect_list(F.struct("date", "claim_ref", "value"))).alias("l"))
    attrs = lists.groupBy(F.col("permanode").alias("ref")).agg(F.map_from_entries(F.collect_list(F.struct("attr", F.col("l.value")))).alias("attrs"))
    mods = described_modtimes(store, dead, meta).select(F.col("permanode").alias("ref"), "mod")
    files = store.files.select(F.col("file_ref").alias("ref"), F.struct("file_name", "size", "mime", "time", "mod_time", "whole_ref").alias("file"))
    images = store.images.select(F.col("file_ref").alias("ref"), F.struct("width", "height").alias("image"))
    tags = store.media_tags.groupBy("whole_ref").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("tag", "value")))).alias("media_tags"))
    tags = store.files.join(tags, "whole_ref").select(F.col("file_ref").alias("ref"), "media_tags")
    kids = members(of_refs(store.dir_children, meta.select("ref"), "dir_ref")).groupBy(F.col("dir_ref").alias("ref")).agg(F.array_sort(F.collect_list("child_ref")).alias("children"))
    out = meta
    for side in (attrs, mods, files, images, tags, kids):
        out = out.join(side, "ref", "left")
    if places is not None:
        out = out.join(places.select("ref", F.struct("lat", "long").alias("location")), "ref", "left")
    return out


def members(dir_children: DataFrame, limit: int = 0) -> DataFrame:
    """(dir_ref, child_ref): the first children of each directory, by reference."""
    w = Window.partitionBy("dir_ref").orderBy("child_ref")
    return dir_children.distinct().withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= page_size(limit)).drop("rn")


def title(attrs: Column, file_name: Column) -> Column:
    """Title attribute, or else the name of the file."""
    first = lambda a: F.try_element_at(F.try_element_at(attrs, F.lit(a)), F.lit(1))
    return F.coalesce(first("title"), file_name, F.lit(""))


def is_container(attrs: Column) -> Column:
    return S.true(F.exists(F.map_keys(attrs), lambda k: (k == "camliMember") | k.startswith("camliPath:")))


def mentions(store: Store, dead: DataFrame, at=None, refs: DataFrame | None = None) -> DataFrame:
    """(ref, next): references in the names and values of an object's attributes."""
    v = described_values(store, dead, at, refs)
    found = v.select(F.col("permanode").alias("ref"), F.explode(F.array_union(S.refs_in(F.col("attr")), S.refs_in(F.col("value")))).alias("next"))
    return found.distinct()


def reach(store: Store, roots: DataFrame, depth: int, dead: DataFrame) -> DataFrame:
    """(ref, depth) of what a description covers: each mention costs one step, children of directories none.

    Only the claims on what was reached last are replayed, so the cost follows
    what is described and not the store.
    """
    known = cut(store.blob_meta.join(roots.select("ref"), "ref", "left_semi").select("ref", F.lit(depth).alias("depth")).distinct())
    frontier = known
    while True:
        children = members(of_refs(store.dir_children, frontier, "dir_ref"))
        links = children.select(F.col("dir_ref").alias("ref"), F.col("child_ref").alias("next"), F.lit(0).alias("cost"))
        far = frontier.where("depth > 1")  # what others mention has no depth left
        if not far.isEmpty():
            mentioned = mentions(store, dead, refs=far).join(store.blob_meta.select(F.col("ref").alias("next")), "next", "left_semi")
            links = links.unionByName(mentioned.select("ref", "next", F.lit(1).alias("cost")))
        ahead = frontier.join(links, "ref").select(F.col("next").alias("ref"), (F.col("depth") - F.col("cost")).alias("depth")).where("depth > 0").groupBy("ref").agg(F.max("depth").alias("depth"))
        new = ahead.join(known.select("ref", F.col("depth").alias("had")), "ref", "left").where("had is null or depth > had").select("ref", "depth")
        frontier = cut(new)
        if frontier.isEmpty():
            return known
        known = cut(known.join(frontier.select("ref"), "ref", "left_anti").unionByName(frontier))


def with_results(store: Store, found: DataFrame, dead: DataFrame, depth: int = 1) -> DataFrame:
    """Records of a search's results (ref) and of what they reach; ``result`` marks the results themselves."""
    found = cut(found.select("ref").distinct())
    covered = reach(store, found, depth, dead)
    out = records(store, covered, dead)
    return out.join(found.withColumn("result", F.lit(True)), "ref", "left").withColumn("result", F.coalesce("result", F.lit(False)))


@dataclass
class Rule:
    """Follow attributes of objects that the rule applies to; inner rules apply to what it found."""

    attrs: tuple[str, ...]
    if_result_root: bool = False
    if_node_type: str = ""
    rules: tuple[Rule, ...] = field(default_factory=tuple)


def by_rules(store: Store, roots: DataFrame, rules: tuple[Rule, ...], dead: DataFrame) -> DataFrame:
    """(ref) of the roots and all that the rules add, to a fixed point."""
    flat: list[tuple[int, int, Rule]] = []

    def add(rule: Rule, parent: int) -> None:
        mine = len(flat)
        flat.append((mine, parent, rule))
        for inner in rule.rules:
            add(inner, mine)

    for rule in rules:
        add(rule, -1)
    known_blobs = store.blob_meta.select("ref")
    roots = cut(roots.select("ref").join(known_blobs, "ref", "left_semi").distinct())
    if not flat:
        return roots

    def follows(rule: Rule) -> Column:
        out = F.lit(False)
        for a in rule.attrs:
            out |= F.col("attr").startswith(a[:-1]) if a.endswith("*") else F.col("attr") == a
        return out

    # attributes are replayed independently: claims on others than these are not read
    typed = any(rule.if_node_type for _, _, rule in flat)
    wanted = F.col("attr") == "camliNodeType" if typed else F.lit(False)
    for _, _, rule in flat:
        wanted |= follows(rule)
    parents = sorted({parent for _, parent, _ in flat})
    # what a rule with parent -1 applies to: everything described; else what the parent rule found
    found = frontier = cut(roots.select("ref", F.lit(-1).alias("rule")))
    while True:
        frontier = frontier.where(F.col("rule").isin(parents))  # nothing follows from the others
        if frontier.isEmpty():
            return found.select("ref").distinct()
        values = described_values(store, dead, refs=frontier, wanted=wanted)
        values = cut(values.select(F.col("permanode").alias("ref"), "attr", F.col("value").alias("next"), "date", "claim_ref"))
        rows = values.where(S.is_ref(F.col("next"))).join(known_blobs.withColumnRenamed("ref", "next"), "next", "left_semi").join(roots.withColumn("root", F.lit(True)), "ref", "left")
        if typed:
            kinds = values.where("attr = 'camliNodeType'").groupBy("ref").agg(F.min_by("next", replay.place()).alias("kind"))
            rows = rows.join(kinds, "ref", "left")
        hits = None
        for mine, parent, rule in flat:
            fits = follows(rule)
            if rule.if_node_type:
                fits &= S.true(F.col("kind") == rule.if_node_type)
            if rule.if_result_root:
                fits &= F.col("root").isNotNull()
            mine_of = frontier.where(F.col("rule") == parent).select("ref").join(rows.where(fits), "ref").select("next", F.lit(mine).alias("by"))
            hits = mine_of if hits is None else hits.unionByName(mine_of)
        new = hits.select(F.col("next").alias("ref"), F.col("by").alias("rule")).unionByName(hits.select(F.col("next").alias("ref"), F.lit(-1).alias("rule"))).distinct()
        frontier = cut(new.join(found, ["ref", "rule"], "left_anti"))
        if frontier.isEmpty():
            return found.select("ref").distinct()
        found = cut(found.unionByName(frontier))
