"""Constraint trees as one boolean column over candidates.

Each leaf is a column that is never null, so 'not' and 'xor' mean what they say.
What a leaf needs beyond (ref, size, camli_type) is joined to the candidates by
reference: values of attributes as counts from one aggregation for all leaves of
a point in time, files, images, places, and marks of sub-queries.
"""

from __future__ import annotations

from datetime import UTC, datetime
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions import scalar as S
from keelson.model import TIME_ATTRS_AFTER_FILE, TIME_ATTRS_BEFORE_FILE, VENUE, Store
from keelson.operators import geo, replay
from keelson.runtime import cut


def dead(store: Store) -> DataFrame:
    """(ref) of what is deleted in a store."""
    return store.once("dead", lambda: cut(replay.deleted(store.deletions)))


class Derived:
    """Tables that many leaves share, each made once a query."""

    def __init__(self, store: Store, now: datetime | None = None):
        self.store, self.now = store, now or datetime.now(UTC)

    def held(self, at: datetime | None, wanted: Column | None = None, owner: bool = True) -> DataFrame:
        """Held values at a time, of the owner's key or of all signers.

        ``wanted`` is a condition on the attribute. Attributes are replayed
        independently, so it is applied to the claims before, where it reaches
        the scan.
        """
        return replay.held_values(self.counted(at, wanted, owner))

    def counted(self, at: datetime | None, wanted: Column | None, owner: bool = True) -> DataFrame:
        """The claims that ``held`` replays."""
        claims = replay.until(self.store.claims, at)
        if wanted is not None:
            claims = claims.where(wanted)
        return replay.of_key(claims, self.store.signers, self.store.owner_key) if owner else claims

    @property
    def dead(self) -> DataFrame:
        return dead(self.store)

    @cached_property
    def modtimes(self) -> DataFrame:
        return replay.modtimes(self.store.claims, self.dead)

    @cached_property
    def content_times(self) -> DataFrame:
        """(permanode, content_time): the first readable one of certain attributes and the file's times."""
        names = [*TIME_ATTRS_BEFORE_FILE, *TIME_ATTRS_AFTER_FILE]
        row = replay.pivoted(self.counted(None, F.col("attr").isin(names), owner=False), names, S.parsed_time)  # times are hashed, texts would be sorted
        files = self.store.files.select(F.col("file_ref").alias("value"), F.col("time").alias("f_time"), F.col("mod_time").alias("f_mod"))
        content = replay.contents(self.store.claims).join(files, "value").select("permanode", "f_time", "f_mod")
        return row.join(content, "permanode", "full").select("permanode", F.coalesce(*TIME_ATTRS_BEFORE_FILE, "f_time", *TIME_ATTRS_AFTER_FILE, "f_mod").alias("content_time"))

    @property
    def times(self) -> DataFrame:
        """(ref, mod, any_time) of objects: last change, and content time or else last change."""
        return self.store.once("times", lambda: cut(self._times()))

    def _times(self) -> DataFrame:
        t = self.modtimes.join(self.content_times, "permanode", "full")
        return t.select(F.col("permanode").alias("ref"), "mod", F.coalesce("content_time", "mod").alias("any_time"))

    @property
    def places(self) -> DataFrame:
        """(ref, lat, long) of objects with a place."""
        return self.places_at(None)

    def places_at(self, at: datetime | None) -> DataFrame:
        """(ref, lat, long) as of a time."""
        return self.store.once("places" if at is None else f"places at {at.isoformat()}", lambda: cut(self._places(at)))

    def _places(self, at: datetime | None) -> DataFrame:
        first = replay.pivoted(self.counted(at, F.col("attr").isin(geo.PLACE_ATTRS)), geo.PLACE_ATTRS)
        return geo.places_of(first, self.store.files, self.store.exif_gps)


class Compiled:
    """A constraint over candidates of a store."""

    def __init__(self, derived: Derived, constraint: dict):
        self.d, self.store = derived, derived.store
        self.joins: dict[str, DataFrame] = {}
        self.leaves: dict[datetime | None, list[Column]] = {}
        self.attrs: dict[datetime | None, set[str]] = {}
        self.count = 0
        self.test = self.node(constraint)

    def candidates(self, base: DataFrame | None = None) -> DataFrame:
        """Candidates with all columns that the test reads."""
        df = self.store.blob_meta if base is None else base
        for at, aggregates in self.leaves.items():
            wanted = F.col("attr").isin(*sorted(self.attrs[at]))
            rows = self.d.held(at, wanted).groupBy(F.col("permanode").alias("ref")).agg(*aggregates)
            df = df.join(rows, "ref", "left")
        for rows in self.joins.values():
            df = df.join(rows, "ref", "left")
        return df

    def matches(self, base: DataFrame | None = None) -> DataFrame:
        return self.candidates(base).where(self.test).select("ref", "size", "camli_type")

    def refs(self, constraint: dict) -> DataFrame:
        """(ref) of blobs that match a sub-constraint."""
        return Compiled(self.d, constraint).matches().select("ref").distinct()

    def mark(self, refs: DataFrame) -> Column:
        """True for candidates in a set of references."""
        self.count += 1
        name = f"m{self.count}"
        self.joins[name] = refs.select("ref", F.lit(True).alias(name))
        return F.coalesce(F.col(name), F.lit(False))

    def need(self, name: str, rows: DataFrame) -> None:
        self.joins.setdefault(name, rows)

    # nodes

    def node(self, c: dict) -> Column:
        tests = []
        if c.get("anything"):
            tests.append(F.lit(True))
        if "logical" in c:
            tests.append(self.logical(c["logical"]))
        if "camliType" in c:
            tests.append(F.col("camli_type") == c["camliType"])
        if c.get("anyCamliType"):
            tests.append(F.col("camli_type") != "")
        if "blobRefPrefix" in c:
            tests.append(S.ref_prefix(F.col("ref"), c["blobRefPrefix"]))
        if "blobSize" in c:
            tests.append(S.int_test(F.col("size"), c["blobSize"]))
        if "permanode" in c:
            tests.append(self.permanode(c["permanode"]))
        if "file" in c:
            tests.append(self.file(c["file"]))
        if "dir" in c:
            tests.append(self.directory(c["dir"]))
        return reduce(lambda a, b: a & b, map(S.true, tests)) if tests else F.lit(False)

    def logical(self, c: dict) -> Column:
        a = self.node(c["a"])
        if c["op"] == "not":
            return ~a
        b = self.node(c["b"])
        return a & b if c["op"] == "and" else a | b if c["op"] == "or" else a != b

    def permanode(self, c: dict) -> Column:
        out = F.col("camli_type") == "permanode"
        at = c.get("at")
        if "attr" in c:
            out &= self.attribute(c, at)
        if c.get("skipHidden"):
            first = [self.leaf(at, n, F.min_by(F.when(F.col("attr") == n, F.col("value")), F.when(F.col("attr") == n, replay.place()))) for n in ("camliDefVis", "camliNodeType")]
            out &= S.true(F.coalesce(first[0], F.lit("")) != "hide") & S.true(F.coalesce(first[1], F.lit("")) != VENUE)
        if "modTime" in c or "time" in c:
            self.need("times", self.d.times)
        if "modTime" in c:
            out &= S.time_test(F.col("mod"), c["modTime"], self.d.now)
        if "time" in c:
            out &= S.time_test(F.col("any_time"), c["time"], self.d.now)
        if "relation" in c:
            out &= self.relation(c["relation"], at)
        if "location" in c:
            lat, long = ("lat", "long") if at is None else (f"lat at {at.isoformat()}", f"long at {at.isoformat()}")
            self.need(lat, self.d.places_at(at).select("ref", F.col("lat").alias(lat), F.col("long").alias(long)))
            out &= geo.in_rectangle(F.col(f"`{lat}`"), F.col(f"`{long}`"), c["location"])
        return out

    def leaf(self, at: datetime | None, attr: str, aggregate: Column) -> Column:
        """A column of the one aggregation over the held values of all attributes that leaves read."""
        self.attrs.setdefault(at, set()).add(attr)
        self.count += 1
        name = f"a{self.count}"
        self.leaves.setdefault(at, []).append(aggregate.alias(name))
        return F.col(name)

    def attribute(self, c: dict, at: datetime | None) -> Column:
        value, mine = F.col("value"), F.col("attr") == c["attr"]
        tests = []
        if "value" in c:
            tests.append(value == c["value"])
        if "valueMatches" in c:
            tests.append(S.string_test(value, c["valueMatches"]))
        if "valueMatchesInt" in c:
            tests.append(S.int_test(S.parsed_int(value), c["valueMatchesInt"]))
        if "valueMatchesFloat" in c:
            tests.append(S.float_test(S.parsed_float(value), c["valueMatchesFloat"]))
        fits = reduce(lambda a, b: a & b, tests, F.lit(True))
        if "valueInSet" in c:  # every test must hold for one and the same value
            inner = self.refs(c["valueInSet"]).select(F.col("ref").alias("value"), F.lit(True).alias("known"))
            rows = self.d.held(at, mine).join(inner, "value", "left")
            self.count += 1
            n, k = f"n{self.count}", f"k{self.count}"
            self.joins[n] = rows.groupBy(F.col("permanode").alias("ref")).agg(F.count("*").alias(n), F.count_if(fits & F.coalesce("known", F.lit(False))).alias(k))
            number, good = F.coalesce(n, F.lit(0)), F.coalesce(k, F.lit(0))
        else:
            number = F.coalesce(self.leaf(at, c["attr"], F.count_if(mine)), F.lit(0))
            good = F.coalesce(self.leaf(at, c["attr"], F.count_if(mine & fits)), F.lit(0)) if tests else None
        out = F.lit(True)
        if "numValue" in c:
            out &= S.int_test(number, c["numValue"])
        if good is not None:
            out &= (number > 0) & (good == number) if c.get("valueAllMatch") else good > 0
        return out

    def relation(self, c: dict, at: datetime | None) -> Column:
        edge = F.col("attr") == c["edgeType"] if "edgeType" in c else (F.col("attr") == "camliMember") | F.col("attr").startswith("camliPath:")
        edges = self.d.held(at, edge, owner=False).where(S.is_ref(F.col("value"))).select(F.col("permanode").alias("from"), F.col("value").alias("to"))
        me, other = ("to", "from") if c["relation"] == "parent" else ("from", "to")
        near = edges.select(F.col(me).alias("ref"), F.col(other).alias("near")).distinct()
        inner = self.refs(c.get("any") or c["all"]).select(F.col("ref").alias("near"))
        if "any" in c:
            return self.mark(near.join(inner, "near", "left_semi").select("ref").distinct())
        judged = near.join(inner.withColumn("good", F.lit(True)), "near", "left")
        return self.mark(judged.groupBy("ref").agg(F.bool_and(F.coalesce("good", F.lit(False))).alias("all_good")).where("all_good").select("ref"))

    def need_file(self) -> None:
        f = self.store.files
        self.need("file", f.select(F.col("file_ref").alias("ref"), "file_name", F.col("size").alias("file_size"), "mime", F.col("time").alias("file_time"), F.col("mod_time").alias("file_mod"), "whole_ref"))

    def file(self, c: dict) -> Column:
        self.need_file()
        out = (F.col("camli_type") == "file") & F.col("file_name").isNotNull()
        if "fileSize" in c:
            out &= S.int_test(F.col("file_size"), c["fileSize"])
        if c.get("isImage"):
            out &= F.col("mime").startswith("image/")
        if "fileName" in c:
            out &= S.string_test(F.col("file_name"), c["fileName"])
        if "mimeType" in c:
            out &= S.string_test(F.col("mime"), c["mimeType"])
        if "time" in c:
            out &= S.time_test(F.col("file_time"), c["time"], self.d.now)
        if "modTime" in c:
            out &= S.time_test(F.col("file_mod"), c["modTime"], self.d.now)
        if "wholeRef" in c:
            out &= F.col("whole_ref") == c["wholeRef"]
        if "parentDir" in c:
            out &= self.in_directory(c["parentDir"])
        if {"width", "height", "widthHeightRation"} & set(c):
            self.need("images", self.store.images.select(F.col("file_ref").alias("ref"), "width", "height"))
            if "width" in c:
                out &= S.int_test(F.col("width"), c["width"])
            if "height" in c:
                out &= S.int_test(F.col("height"), c["height"])
            if "widthHeightRation" in c:
                ratio = F.try_divide(F.col("width").cast("double"), F.col("height").cast("double"))
                none = F.col("width").isNotNull() & (F.col("height") == 0)
                ratio = F.when(none, F.when(F.col("width") == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(ratio)
                out &= S.float_test(ratio, c["widthHeightRation"])
        if "location" in c:
            gps = self.store.files.join(self.store.exif_gps, "whole_ref").select(F.col("file_ref").alias("ref"), F.col("lat").alias("file_lat"), F.col("long").alias("file_long"))
            self.need("gps", gps)
            out &= geo.in_rectangle(F.col("file_lat"), F.col("file_long"), c["location"])
        if "mediaTag" in c:
            out &= self.media_tag(c["mediaTag"])
        return out

    def media_tag(self, c: dict) -> Column:
        self.count += 1
        name = f"t{self.count}"
        tags = self.store.media_tags.where(F.col("tag") == c.get("tag", "")).select("whole_ref", F.col("value").alias(name))
        self.joins[name] = self.store.files.join(tags, "whole_ref").select(F.col("file_ref").alias("ref"), name)
        value = F.coalesce(F.col(name), F.lit(""))
        out = F.lit(True)
        if "int" in c:
            out &= S.int_test(S.parsed_int(value), c["int"])
        if "string" in c:
            out &= S.string_test(value, c["string"])
        return out

    def in_directory(self, c: dict) -> Column:
        dirs = self.refs({"dir": c}).select(F.col("ref").alias("dir_ref"))
        return self.mark(self.store.dir_children.join(dirs, "dir_ref", "left_semi").select(F.col("child_ref").alias("ref")).distinct())

    def directory(self, c: dict) -> Column:
        self.need_file()
        children = self.store.dir_children
        out = F.col("camli_type") == "directory"
        if "fileName" in c:
            out &= S.string_test(F.col("file_name"), c["fileName"])
        if "blobRefPrefix" in c:
            out &= S.ref_prefix(F.col("ref"), c["blobRefPrefix"])
        if "parentDir" in c:
            out &= self.in_directory(c["parentDir"])
        if "topFileCount" in c:
            self.need("children", children.groupBy(F.col("dir_ref").alias("ref")).agg(F.count_distinct("child_ref").alias("children")))
            out &= S.int_test(F.coalesce("children", F.lit(0)), c["topFileCount"])
        if "contains" in c:
            inner = self.refs(c["contains"]).select(F.col("ref").alias("child_ref"))
            out &= self.mark(children.join(inner, "child_ref", "left_semi").select(F.col("dir_ref").alias("ref")).distinct())
        if "recursiveContains" in c:
            # only directories that satisfy the rest of this constraint pass a match on to their parents
            rest = {k: v for k, v in c.items() if k != "recursiveContains"}
            eligible = self.refs({"dir": rest} if rest else {"camliType": "directory"})
            out &= self.mark(holding(children, self.refs(c["recursiveContains"]), eligible))
        return out


def holding(children: DataFrame, found: DataFrame, eligible: DataFrame) -> DataFrame:
    """(ref) of eligible directories that hold a found blob, at any depth.

    Each round takes the parents of the last round's directories; directories
    named by their content cannot contain themselves, so the rounds end.
    """
    edges = cut(children.join(eligible.select(F.col("ref").alias("dir_ref")), "dir_ref", "left_semi").select("dir_ref", "child_ref").distinct())
    frontier, known = found.select("ref"), None
    while True:
        up = edges.join(frontier.select(F.col("ref").alias("child_ref")), "child_ref", "left_semi").select(F.col("dir_ref").alias("ref")).distinct()
        if known is not None:
            up = up.join(known, "ref", "left_anti")
        frontier = cut(up)
        if known is not None and frontier.isEmpty():
            return known
        known = frontier if known is None else cut(known.unionByName(frontier))
