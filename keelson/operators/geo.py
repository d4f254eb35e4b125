"""Places: wrapping, rectangles across the dateline, areas, and spreading over a map."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.scalar import is_ref, parsed_float, true
from keelson.model import PLACE_OF
from keelson.runtime import cut


def wrapped(longitude: Column) -> Column:
    """A longitude within -180 to 180."""
    inside = (longitude >= -180) & (longitude <= 180)
    return F.when(inside, longitude).otherwise(F.pmod(longitude + 180, F.lit(360.0)) - 180)


def in_rectangle(lat: Column, long: Column, c: dict) -> Column:
    """Rectangle north, west, south, east; with west >= east it spans the dateline."""
    here = lat.isNotNull() & long.isNotNull()
    if c.get("any"):
        return true(here)
    n, w, s, e = (float(c.get(k, 0.0)) for k in ("north", "west", "south", "east"))
    across = (long >= w) & (long <= e) if w < e else (long >= w) | (long <= e)
    if n == w == s == e == 0.0:
        return F.lit(False)
    return true(here & (lat <= n) & (lat >= s) & across)


def expanded(box: tuple[float, float, float, float] | None, lat: float, long: float) -> tuple[float, float, float, float]:
    """North, west, south, east after a box takes in one more place, on the shorter side."""
    if box is None:
        return lat, long, lat, long
    n, w, s, e = box
    n, s = max(n, lat), min(s, lat)
    inside = w <= long <= e if w <= e else long >= w or long <= e
    if not inside:
        if (w - long) % 360 <= (long - e) % 360:
            w = long
        else:
            e = long
    return n, w, s, e


def area(places: DataFrame) -> DataFrame:
    """(north, west, south, east) of all places: the narrower of the plain and the dateline box."""
    a = places.agg(F.max("lat").alias("north"), F.min("lat").alias("south"), F.min("long").alias("w"), F.max("long").alias("e"), F.min(F.when(F.col("long") >= 0, F.col("long"))).alias("wd"), F.max(F.when(F.col("long") < 0, F.col("long"))).alias("ed"))
    across = true((F.col("ed") - F.col("wd") + 360) < (F.col("e") - F.col("w")))
    return a.select("north", F.when(across, F.col("wd")).otherwise(F.col("w")).alias("west"), "south", F.when(across, F.col("ed")).otherwise(F.col("e")).alias("east"))


def spread(places: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` of (ref, lat, long), spread evenly over a grid on their area.

    Rows are taken one a cell and round. Each cell keeps its first ``limit``
    rows before the shuffle, so a crowded cell does not gather in one task.
    """
    box = area(places).first()
    if box is None or box["north"] is None:
        return places.limit(0)
    dim = min(100, max(3, round(math.sqrt(limit))))
    n, w, s, e = (box[k] for k in ("north", "west", "south", "east"))
    width = ((e - w) % 360 if e < w else e - w) / dim or 1.0
    height = (n - s) / dim or 1.0
    x = F.least(F.lit(dim - 1), F.floor((F.col("long") - w + F.when(F.col("long") < w, 360.0).otherwise(0.0)) / width))
    y = F.least(F.lit(dim - 1), F.floor((F.lit(n) - F.col("lat")) / height))
    cells = places.withColumn("cell", (y * dim + x).cast("int"))
    turn = cells.withColumn("turn", F.row_number().over(Window.partitionBy("cell").orderBy("ref"))).where(F.col("turn") <= limit)
    return turn.orderBy("turn", "cell").limit(limit)


def gazetteer(table: DataFrame) -> Callable[[str], list[dict]]:
    """Rectangles of a place's name, whatever its case, from a table (name, north, west, south, east)."""

    def lookup(name: str) -> list[dict]:
        rows = table.where(F.lower("name") == name.lower()).orderBy("north", "west", "south", "east").limit(100).collect()  # one name
        return [{k: r[k] for k in ("north", "west", "south", "east")} for r in rows]

    return lookup


def _joined(objects: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Left join on a reference that most objects lack; those without are dealt by their name, as nulls would all meet in one task."""
    named = F.when(F.col(key).isNotNull(), F.concat(F.lit("+"), key)).otherwise(F.concat(F.lit("-"), "permanode"))
    return objects.withColumn("dealt", named).join(side.select(F.concat(F.lit("+"), key).alias("dealt"), *(c for c in side.columns if c != key)), "dealt", "left").drop("dealt")


#: Attributes that an object's place depends on.
PLACE_ATTRS = ["latitude", "longitude", "camliContent", "camliNodeType", *PLACE_OF.values()]


def object_places(first: DataFrame, files: DataFrame, gps: DataFrame) -> DataFrame:
    """(ref, lat, long) of objects, from (permanode, attr, value) first values."""
    one = lambda a: F.max(F.when(F.col("attr") == a, F.col("value"))).alias(a)
    return places_of(first.where(F.col("attr").isin(PLACE_ATTRS)).groupBy("permanode").agg(*map(one, PLACE_ATTRS)), files, gps)


def places_of(values: DataFrame, files: DataFrame, gps: DataFrame) -> DataFrame:
    """(ref, lat, long) of objects, from their first values of PLACE_ATTRS as columns.

    An object's own latitude and longitude count first; if they cannot be read
    it has no place. Else, for objects of certain types, the place of the object
    that they refer to, if that has one by itself; else that of the photo that the
    object holds. Objects that have none of these are left out before the joins.
    """
    p = values.select("permanode", F.col("latitude").alias("la"), F.col("longitude").alias("lo"), F.col("camliContent").alias("content"), F.col("camliNodeType").alias("kind"), *PLACE_OF.values())
    alt = F.lit(None).cast("string")
    for kind, attr in PLACE_OF.items():
        alt = F.when(F.col("kind") == kind, F.col(attr)).otherwise(alt)
    p = p.withColumn("alt", F.when(is_ref(alt), alt))
    p = p.withColumn("own", F.col("la").isNotNull() & F.col("lo").isNotNull() & (F.col("la") != "") & (F.col("lo") != ""))
    p = p.select("permanode", "la", "lo", "content", "alt", "own").where("own or content is not null or alt is not null")
    photo = files.join(gps, "whole_ref").where("not isnan(lat) and not isnan(long)").select(F.col("file_ref").alias("content"), F.col("lat").alias("plat"), F.col("long").alias("plong"))
    p = _joined(p, photo, "content")
    p = p.withColumn("lat", F.when(F.col("own"), parsed_float(F.col("la"))).otherwise(F.col("plat"))).withColumn("long", F.when(F.col("own"), parsed_float(F.col("lo"))).otherwise(F.col("plong")))
    p = cut(p.select("permanode", "alt", "own", "lat", "long"))
    via = p.where("lat is not null and long is not null").select(F.col("permanode").alias("alt"), F.col("lat").alias("alat"), F.col("long").alias("along"))
    p = _joined(p, via, "alt")
    lat = F.when(F.col("own"), F.col("lat")).otherwise(F.coalesce("alat", "lat"))
    long = F.when(F.col("own"), F.col("long")).otherwise(F.coalesce("along", "long"))
    return p.select(F.col("permanode").alias("ref"), lat.alias("lat"), long.alias("long")).where("lat is not null and long is not null")
