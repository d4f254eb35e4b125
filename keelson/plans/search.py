"""Searches: planning, order, limits, pages, windows around a row, and map results."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.model import Store
from keelson.operators import geo, replay
from keelson.plans import constraints as K
from keelson.plans.compile import Compiled, Derived
from keelson.plans.expressions import Keywords, default_keywords, parse
from keelson.runtime import QueryError, cut

DEFAULT_LIMIT = 200


def page_size(n: int) -> int:
    """Sizes of lookup pages: 50 unless 1 to 1000 is asked for."""
    return n if 0 < n <= 1000 else 50


def read_token(token: str) -> tuple[datetime, str] | None:
    m = re.fullmatch(r"pn:(\d{1,19}):([a-z0-9]+-[0-9a-f]+)", token)
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=int(m[1]) // 1000), m[2]) if m else None


def write_token(time: datetime, ref: str) -> str:
    time = time if time.tzinfo else time.replace(tzinfo=UTC)
    micros = (time - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
    return f"pn:{micros * 1000}:{ref}"


@dataclass
class Plan:
    """A checked query with its defaults filled in."""

    constraint: dict
    sort: str
    limit: int
    around: str
    after: tuple[datetime, str] | None
    source: str


class Search:
    """Queries over one store."""

    def __init__(self, store: Store, keywords: Keywords | None = None, now: datetime | None = None):
        self.store, self.keywords = store, keywords or default_keywords()
        self.derived = Derived(store, now)

    def plan(self, query: dict) -> Plan:
        q = K.decode(query, "query")
        if "constraint" in query and "constraint" not in q and query["constraint"] is not None:
            q["constraint"] = {}
        sort, around, token = q.get("sort", ""), q.get("around", ""), q.get("continue", "")
        if token and around:
            raise QueryError("Continue and Around parameters are mutually exclusive")
        if sort == "map" and (token or around):
            raise QueryError("Continue or Around parameters are not available with MapSort")
        if "constraint" in q and q.get("expression"):
            raise QueryError("Constraint and Expression are mutually exclusive in a search query")
        c = K.decode(q["constraint"] if "constraint" in q else parse(q.get("expression", ""), self.keywords))
        K.check(c)
        objects = K.only_permanodes(c)
        if not sort and objects:
            sort = "-created"
        if sort == "mod" or (sort == "-mod" and not objects):
            raise QueryError("unsupported sort+query combination")
        if sort in ("created", "-created") and not objects:
            raise QueryError("can only sort by ctime when all results are permanodes")
        after = read_token(token) if token and objects and sort in ("-mod", "-created") else None
        return Plan(c, sort, int(q.get("limit", 0)) or DEFAULT_LIMIT, around, after, K.source_name(c, sort))

    def candidates(self, plan: Plan) -> DataFrame:
        """The rows that the plan's source gives; only the sorted sources leave out deleted objects."""
        meta = self.store.blob_meta
        if plan.source in ("corpus_permanode_lastmod", "corpus_permanode_created"):
            return replay.not_deleted(meta.where("camli_type = 'permanode'"), self.derived.dead, "ref")
        if plan.source == "corpus_permanode_types":
            ever = self.store.claims.where((F.col("attr") == "camliNodeType") & F.col("value").isin(K.node_types(plan.constraint)))
            return meta.join(ever.select(F.col("permanode").alias("ref")), "ref", "left_semi")
        if plan.source == "one_blob":
            return meta.where(F.col("ref") == K.single_ref(plan.constraint))
        if plan.source == "corpus_file_meta":
            return meta.where("camli_type = 'file'")
        if plan.source == "corpus_blob_meta":
            wanted = plan.constraint.get("camliType")
            return meta.where(F.col("camli_type") == wanted) if wanted else meta.where("camli_type <> ''")
        return meta

    def matches(self, plan: Plan) -> DataFrame:
        """All matches (ref, time), before order and limit; ``time`` is what the sort reads."""
        found = Compiled(self.derived, plan.constraint).matches(self.candidates(plan)).select("ref")
        if plan.sort in ("-mod", "-created", "created"):
            time = "mod" if plan.sort == "-mod" else "any_time"
            found = found.join(self.derived.times.select("ref", F.col(time).alias("time")), "ref").where("time is not null")
        else:
            found = found.withColumn("time", F.lit(None).cast("timestamp"))
        if plan.after:
            t, ref = plan.after
            found = found.where((F.col("time") < F.lit(t)) | ((F.col("time") == F.lit(t)) & (F.col("ref") < ref)))
        return found

    def order(self, sort: str, reverse: bool = False) -> list:
        """Without an order of their own, results come by reference."""
        down = [F.desc("time"), F.desc("ref")]
        up = [F.asc("time"), F.asc("ref")]
        if sort in ("-mod", "-created"):
            return up if reverse else down
        if sort == "created":
            return down if reverse else up
        return [F.desc("ref")] if reverse else [F.asc("ref")]

    def query(self, query: dict) -> DataFrame:
        """(ref, time) of the results, in order."""
        plan = self.plan(query)
        found = self.matches(plan)
        if plan.sort == "map":
            return self.spread(found, plan.limit)
        if plan.around:
            return self.window(found, plan)
        found = found.orderBy(*self.order(plan.sort))
        return found.limit(plan.limit) if plan.limit > 0 else found

    def window(self, found: DataFrame, plan: Plan) -> DataFrame:
        """At most half of the limit before the row, then the row and what follows.

        Two bounded top-k selections around the row's sort key; no row numbers
        over all matches.
        """
        found = cut(found)
        hit = found.where(F.col("ref") == plan.around).first()
        if hit is None:
            return found.limit(0)
        if plan.limit < 0:
            return found.orderBy(*self.order(plan.sort))
        ref, time = F.col("ref"), F.col("time")
        if plan.sort in ("-mod", "-created"):
            t = F.lit(hit["time"])
            before = (time > t) | ((time == t) & (ref > plan.around))
        elif plan.sort == "created":
            t = F.lit(hit["time"])
            before = (time < t) | ((time == t) & (ref < plan.around))
        else:
            before = ref < plan.around
        first = found.where(before).orderBy(*self.order(plan.sort, reverse=True)).limit(plan.limit // 2)
        rest = found.where(~before).orderBy(*self.order(plan.sort)).limit(plan.limit)
        return first.unionByName(rest).orderBy(*self.order(plan.sort)).limit(plan.limit)

    def spread(self, found: DataFrame, limit: int) -> DataFrame:
        """All matches if they are few; else those with a place, spread over the map."""
        found = cut(found)
        if limit <= 0 or found.limit(limit + 1).count() <= limit:
            return found.orderBy("ref")
        placed = found.join(self.derived.places, "ref").select("ref", "time", "lat", "long")
        if placed.isEmpty():
            return found.orderBy("ref")
        return geo.spread(placed, limit).select("ref", "time")

    def area(self, query: dict) -> DataFrame:
        """(north, west, south, east) of the places of all matches."""
        return geo.area(self.matches(self.plan(query)).select("ref").join(self.derived.places, "ref"))

    def next_token(self, query: dict, page: DataFrame) -> str:
        """Where the next page starts; empty unless this page of a descending sort is full."""
        plan = self.plan(query)
        if plan.sort not in ("-mod", "-created") or plan.around or plan.limit <= 0 or not K.only_permanodes(plan.constraint):
            return ""
        rows = page.select("ref", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("time")).collect()  # one page
        if len(rows) != plan.limit:
            return ""
        last = min(rows, key=lambda r: (r["time"], r["ref"]))
        return write_token(datetime.fromisoformat(last["time"]), last["ref"])
