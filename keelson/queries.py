"""Registry of queries over the driver's tables, and the SQL that checks them.

Names end with the operators of the inventory that a query shows. The SQL states
results from scratch, over the same projection of the tables, and shares no code
with the operators.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import scalar as S
from keelson.operators import describe, geo, lookup, replay, sets
from keelson.plans.compile import Derived, dead
from keelson.plans.expressions import default_keywords
from keelson.plans.search import Search
from keelson.runtime import fit_tasks, table
from keelson.sources import ingest, projection
from keelson.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# common table expressions for checking

_AFTER = "(b.date > a.date OR (b.date = a.date AND b.claim_ref > a.claim_ref))"


def _held(source: str) -> str:
    return (
        f"SELECT a.permanode, a.attr, a.value, a.date, a.claim_ref FROM {source} a WHERE a.ctype IN ('set-attribute', 'add-attribute') AND NOT EXISTS ("
        f"SELECT 1 FROM {source} b WHERE b.permanode = a.permanode AND b.attr = a.attr AND {_AFTER} AND (b.ctype = 'set-attribute' OR (b.ctype = 'del-attribute' AND (b.value = '' OR b.value = a.value))))"
    )


def _first(source: str) -> str:
    return f"SELECT permanode, attr, first(value ORDER BY date, claim_ref) AS value FROM {source} GROUP BY permanode, attr"


_LEVELS = ", ".join(f"k{i} AS (SELECT DISTINCT target FROM deletions WHERE deleter NOT IN (SELECT target FROM k{i - 1}))" for i in range(2, 9))
DEFS: dict[str, tuple[tuple[str, ...], str]] = {
    "dead": (("deletions",), f"k1 AS (SELECT DISTINCT target FROM deletions), {_LEVELS}, dead AS (SELECT target AS ref FROM k8)"),
    "own": (("claims", "signers"), "own AS (SELECT c.* FROM claims c JOIN signers s ON c.signer = s.signer WHERE s.key_id = 'ka')"),
    "live": (("claims", "dead"), "live AS (SELECT * FROM claims WHERE claim_ref NOT IN (SELECT ref FROM dead))"),
    "ownlive": (("own", "dead"), "ownlive AS (SELECT * FROM own WHERE claim_ref NOT IN (SELECT ref FROM dead))"),
    "held": (("own",), f"held AS ({_held('own')})"),
    "heldall": (("claims",), f"heldall AS ({_held('claims')})"),
    "firsts": (("held",), f"firsts AS ({_first('held')})"),
    "firstsall": (("heldall",), f"firstsall AS ({_first('heldall')})"),
    "mods": (("live",), "mods AS (SELECT permanode, max(date) AS mod FROM live GROUP BY permanode)"),
    "content": (
        ("claims",),
        f"content AS (SELECT a.permanode, a.value, a.date FROM claims a WHERE a.attr = 'camliContent' AND a.ctype = 'set-attribute' AND regexp_full_match(a.value, '[a-z0-9]+-[0-9a-f]+') AND NOT EXISTS (SELECT 1 FROM claims b WHERE b.permanode = a.permanode AND b.attr = 'camliContent' AND b.ctype IN ('set-attribute', 'del-attribute') AND {_AFTER}))",
    ),
    "times": (
        ("mods", "firstsall", "files", "content"),
        "row1 AS (SELECT permanode, max(CASE WHEN attr = 'startDate' THEN TRY_CAST(value AS TIMESTAMP) END) AS sd FROM firstsall GROUP BY permanode), "
        "ct AS (SELECT coalesce(r.permanode, c.permanode) AS permanode, coalesce(r.sd, f.time, f.mod_time) AS t FROM row1 r FULL JOIN content c ON c.permanode = r.permanode LEFT JOIN files f ON f.file_ref = c.value), "
        "times AS (SELECT coalesce(m.permanode, ct.permanode) AS ref, m.mod, coalesce(ct.t, m.mod) AS any_time FROM mods m FULL JOIN ct ON ct.permanode = m.permanode)",
    ),
    "objects": (("blob_meta", "firsts"), "objects AS (SELECT ref FROM blob_meta WHERE camli_type = 'permanode' AND ref NOT IN (SELECT permanode FROM firsts WHERE (attr = 'camliDefVis' AND value = 'hide') OR (attr = 'camliNodeType' AND value = 'foursquare.com:venue')))"),
    "places": (
        ("firsts", "files", "exif_gps"),
        "pl AS (SELECT permanode, " + ", ".join(f"max(CASE WHEN attr = '{a}' THEN value END) AS {n}" for a, n in (("latitude", "la"), ("longitude", "lo"), ("camliContent", "cc"), ("camliNodeType", "nt"), ("foursquareVenuePermanode", "vp"))) + " FROM firsts GROUP BY permanode), "
        "ph AS (SELECT f.file_ref, g.lat, g.long FROM files f JOIN exif_gps g ON g.whole_ref = f.whole_ref), "
        "alone AS (SELECT pl.*, la IS NOT NULL AND lo IS NOT NULL AS own, CASE WHEN la IS NOT NULL AND lo IS NOT NULL THEN TRY_CAST(la AS DOUBLE) ELSE ph.lat END AS lat, CASE WHEN la IS NOT NULL AND lo IS NOT NULL THEN TRY_CAST(lo AS DOUBLE) ELSE ph.long END AS long FROM pl LEFT JOIN ph ON ph.file_ref = pl.cc), "
        "places AS (SELECT a.permanode AS ref, CASE WHEN NOT a.own AND b.lat IS NOT NULL THEN b.lat ELSE a.lat END AS lat, CASE WHEN NOT a.own AND b.lat IS NOT NULL THEN b.long ELSE a.long END AS long FROM alone a LEFT JOIN alone b ON b.permanode = a.vp AND a.nt = 'foursquare.com:checkin' WHERE a.lat IS NOT NULL OR (NOT a.own AND b.lat IS NOT NULL))",
    ),
    "contents": (("held", "files", "images"), "contents AS (SELECT DISTINCT h.permanode AS ref, f.*, i.width, i.height FROM held h JOIN files f ON f.file_ref = h.value LEFT JOIN images i ON i.file_ref = f.file_ref WHERE h.attr = 'camliContent')"),
}


def with_(*names: str) -> str:
    """WITH clause of the named tables and all that they read."""
    done: list[str] = []
    out: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        done.append(name)
        if name in DEFS:
            for dep in DEFS[name][0]:
                add(dep)
            out.append(DEFS[name][1])
        else:
            out.append(projection.sql_tables(name))

    for name in names:
        add(name)
    return "WITH " + ", ".join(out) + " "


def query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def on_store(name: str, f: Callable, sql: str | None = None) -> None:
    """A query that is a function of the projected store."""
    query(name, sql)(lambda spark, sf_dir: f(projection.store(spark, sf_dir)))


def found(name: str, constraint: dict | None = None, sql: str | None = None, expression: str | None = None, **options) -> None:
    """A search without limit; its references are the result."""
    q = options | ({"constraint": constraint} if constraint is not None else {"expression": expression}) | {"limit": options.get("limit", -1)}
    gazetteer = {"testville": [{"north": 50.0, "west": 170.0, "south": -20.0, "east": -150.0}, {"north": 10.0, "west": 0.0, "south": 0.0, "east": 20.0}]}
    query(name, sql)(lambda spark, sf_dir: Search(projection.store(spark, sf_dir), default_keywords(lambda n: gazetteer.get(n, []), {"tagged": "tag:t1 or tag:t2"}.__getitem__)).query(q).select("ref"))


def micros(c: str, name: str | None = None):
    return F.unix_micros(c).alias(name or c)


def dead_of(s) -> DataFrame:
    return dead(s)


def own(s) -> DataFrame:
    return replay.of_key(s.claims, s.signers, s.owner_key)


AT = datetime(2024, 1, 15, tzinfo=UTC)
_AT = "TIMESTAMP '2024-01-15 00:00:00'"


def _joined(df: DataFrame) -> DataFrame:
    return df.select("permanode", "attr", F.array_join("vals", "|").alias("vals"))


def _lists(source: str) -> str:
    return f"SELECT permanode, attr, string_agg(value, '|' ORDER BY date, claim_ref) AS vals FROM {source} GROUP BY permanode, attr"


# replay, deletion, times

on_store("attr_replay_current_agg_01", lambda s: _joined(replay.attributes(s.claims)), with_("heldall") + _lists("heldall"))
on_store("attr_replay_asof_agg_02_time_01", lambda s: _joined(replay.attributes(replay.until(s.claims, AT))), with_("claims") + f", c AS (SELECT * FROM claims WHERE date <= {_AT}), h AS ({_held('c')}) " + _lists("h"))
on_store("attr_replay_signer_agg_02_join_11", lambda s: _joined(replay.attributes(own(s))), with_("held") + _lists("held"))
on_store("attr_first_value_agg_03", lambda s: replay.first_values(own(s)), with_("firsts") + "SELECT permanode, attr, value FROM firsts")
on_store("attr_has_value_agg_05", lambda s: replay.has_value(s.claims, "tag", "t3"), with_("heldall") + "SELECT DISTINCT permanode FROM heldall WHERE attr = 'tag' AND value = 't3'")
on_store(
    "attr_describe_dedup_agg_06",
    lambda s: _joined(replay.attributes(replay.not_deleted(own(s), dead_of(s), "claim_ref"), dedupe=True)),
    with_("ownlive") + f", h AS ({_held('ownlive')}), f AS (SELECT permanode, attr, value, min(date) AS date, first(claim_ref ORDER BY date, claim_ref) AS claim_ref FROM h WHERE value <> '' GROUP BY 1, 2, 3) " + _lists("f"),
)
on_store("permanode_modtime_agg_07", lambda s: replay.modtimes(s.claims, dead_of(s)).select("permanode", micros("mod")), with_("mods") + "SELECT permanode, epoch_us(mod) AS mod FROM mods")
on_store(
    "describe_modtime_agg_08",
    lambda s: describe.described_modtimes(s, dead_of(s)).select("permanode", micros("mod")),
    with_("ownlive") + ", k AS (SELECT * FROM ownlive WHERE ctype IN ('set-attribute', 'add-attribute', 'del-attribute')), "
    "e AS (SELECT c.claim_ref AS c, a.claim_ref AS a, a.date AS ad FROM k c JOIN k a ON a.permanode = c.permanode AND a.attr = c.attr AND a.value = c.value AND a.ctype <> 'del-attribute' AND (a.date < c.date OR (a.date = c.date AND a.claim_ref < c.claim_ref)) WHERE c.ctype = 'add-attribute'), "
    "lost AS (SELECT DISTINCT e.c, e.a FROM e JOIN k c ON c.claim_ref = e.c JOIN k r ON r.permanode = c.permanode AND r.attr = c.attr AND (r.date > e.ad OR (r.date = e.ad AND r.claim_ref > e.a)) AND (r.date < c.date OR (r.date = c.date AND r.claim_ref < c.claim_ref)) WHERE r.ctype = 'set-attribute' OR (r.ctype = 'del-attribute' AND (r.value = '' OR r.value = c.value))), "
    "had AS (SELECT DISTINCT c FROM (SELECT c, a FROM e EXCEPT SELECT c, a FROM lost)) "
    "SELECT permanode, epoch_us(max(date)) AS mod FROM k WHERE ctype = 'del-attribute' OR (value <> '' AND (ctype = 'set-attribute' OR claim_ref NOT IN (SELECT c FROM had))) GROUP BY 1",
)
on_store("permanode_any_time_time_02_time_03", lambda s: Derived(s).times.select("ref", micros("mod"), micros("any_time")), with_("times") + "SELECT ref, epoch_us(mod) AS mod, epoch_us(any_time) AS any_time FROM times")
on_store("is_deleted_time_05_join_10", dead_of, with_("dead") + "SELECT ref FROM dead")
on_store("undeleted_time_06", lambda s: s.deletions.select(F.col("target").alias("ref")).distinct().join(dead_of(s), "ref", "left_anti"), with_("dead") + "SELECT DISTINCT target AS ref FROM deletions WHERE target NOT IN (SELECT ref FROM dead)")

# scans

_NEWEST = with_("times", "objects", "dead", "held") + "SELECT o.ref FROM objects o JOIN times t ON t.ref = o.ref WHERE o.ref NOT IN (SELECT ref FROM dead) AND {0}"
found("scan_lastmod_scan_01_sort_01", {"permanode": {"skipHidden": True}}, with_("times", "objects") + "SELECT o.ref FROM objects o JOIN times t ON t.ref = o.ref WHERE t.mod IS NOT NULL ORDER BY t.mod DESC, o.ref DESC LIMIT 300", sort="-mod", limit=300)
found("scan_created_scan_02_sort_03", {"permanode": {}, "camliType": "permanode"}, with_("times", "blob_meta") + "SELECT b.ref FROM blob_meta b JOIN times t ON t.ref = b.ref WHERE b.camli_type = 'permanode' AND any_time IS NOT NULL ORDER BY any_time DESC, b.ref DESC LIMIT 300", sort="-created", limit=300)
found("sort_created_asc_sort_04", {"camliType": "permanode"}, with_("times", "blob_meta") + "SELECT b.ref FROM blob_meta b JOIN times t ON t.ref = b.ref WHERE b.camli_type = 'permanode' AND any_time IS NOT NULL ORDER BY any_time, b.ref LIMIT 100", sort="created", limit=100)
found("sort_blobref_sort_05_sort_07", {"anyCamliType": True}, with_("blob_meta") + "SELECT ref FROM blob_meta WHERE camli_type <> '' ORDER BY ref LIMIT 200", sort="blobref", limit=0)
found("scan_node_types_scan_04", {"permanode": {"attr": "camliNodeType", "value": "BUILDING"}}, with_("held") + "SELECT DISTINCT permanode AS ref FROM held WHERE attr = 'camliNodeType' AND value = 'BUILDING'", sort="unsorted")
found("scan_one_blob_scan_05", {"blobRefPrefix": "item-00000012"}, with_("blob_meta") + "SELECT ref FROM blob_meta WHERE ref LIKE 'item-00000012%'")
found("scan_file_meta_scan_06", {"camliType": "file"}, with_("blob_meta") + "SELECT ref FROM blob_meta WHERE camli_type = 'file'")
on_store("scan_full_scan_07_scan_08", lambda s: s.blob_meta.groupBy("camli_type").agg(F.count("*").alias("n"), F.sum("size").cast("bigint").alias("bytes")), with_("blob_meta") + "SELECT camli_type, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM blob_meta GROUP BY 1")
on_store("scan_prefix_scan_10", lambda s: sets.with_prefix(s.blob_meta, "item-").select("ref", "size"), with_("blob_meta") + "SELECT ref, size FROM blob_meta WHERE ref LIKE 'item-%'")
on_store("scan_range_scan_11_scan_12", lambda s: sets.in_range(s.blob_meta, "doc-00000100", "image-00000010").select("ref"), with_("blob_meta") + "SELECT ref FROM blob_meta WHERE ref >= 'doc-00000100' AND ref < 'image-00000010'")
on_store("enumerate_scan_14", lambda s: sets.enumerate_blobs(s.blob_meta, "doc-00000050", 100).select("ref", "size"), with_("blob_meta") + "SELECT ref, size FROM blob_meta WHERE ref > 'doc-00000050' ORDER BY ref LIMIT 100")
on_store("stat_scan_15", lambda s: sets.stat(s.blob_meta, s.files.where("mime = 'text/html'").select(F.col("file_ref").alias("ref"))), with_("blob_meta", "files") + "SELECT ref, size FROM blob_meta WHERE ref IN (SELECT file_ref FROM files WHERE mime = 'text/html')")

# predicates

_META = with_("blob_meta") + "SELECT ref FROM blob_meta WHERE "
_ATTR = with_("held") + "SELECT DISTINCT permanode AS ref FROM held WHERE "
found("pred_anything_pred_01", {"anything": True, "blobRefPrefix": "page-"[:4] + "-0"}, _META + "ref LIKE 'page-0%'")
found("pred_empty_pred_02", {}, _META + "false")
found("pred_blob_size_pred_06_pred_07", {"blobSize": {"min": 310, "max": 320}}, _META + "size BETWEEN 310 AND 320")
found("pred_any_camli_type_pred_04", {"logical": {"op": "not", "a": {"anyCamliType": True}}}, _META + "camli_type = ''")
found("attr_value_pred_21_pred_25", {"permanode": {"attr": "tag", "value": "t4"}}, _ATTR + "attr = 'tag' AND value = 't4'", sort="unsorted")
found("int_range_pred_27", {"permanode": {"attr": "rating", "valueMatchesInt": {"min": 3, "max": 5}}}, _ATTR + "attr = 'rating' AND TRY_CAST(value AS BIGINT) BETWEEN 3 AND 5", sort="unsorted")
found("int_equals_pred_07", {"permanode": {"attr": "rating", "valueMatchesInt": {"equals": 0}}}, _ATTR + "attr = 'rating' AND TRY_CAST(value AS BIGINT) = 0", sort="unsorted")
found("float_range_pred_09_pred_28", {"permanode": {"attr": "price", "valueMatchesFloat": {"min": 905.5, "max": 910.0}}}, _ATTR + "attr = 'price' AND TRY_CAST(value AS DOUBLE) BETWEEN 905.5 AND 910.0", sort="unsorted")
found("num_value_pred_22", {"permanode": {"attr": "tag", "numValue": {"min": 3}}}, with_("held") + "SELECT permanode AS ref FROM held WHERE attr = 'tag' GROUP BY 1 HAVING count(*) >= 3", sort="unsorted")
found("num_value_zero_pred_22", {"permanode": {"attr": "tag", "numValue": {"zeroMax": True}}}, with_("held", "blob_meta") + "SELECT ref FROM blob_meta WHERE camli_type = 'permanode' AND ref NOT IN (SELECT permanode FROM held WHERE attr = 'tag')", sort="unsorted")
found("value_any_pred_23", {"permanode": {"attr": "title", "valueMatches": {"hasPrefix": "t", "byteLength": {"max": 2}}}}, _ATTR + "attr = 'title' AND value LIKE 't%' AND strlen(value) <= 2", sort="unsorted")
found("value_all_pred_24", {"permanode": {"attr": "rating", "valueAllMatch": True, "valueMatchesInt": {"min": 2}}}, with_("held") + "SELECT permanode AS ref FROM held WHERE attr = 'rating' GROUP BY 1 HAVING bool_and(coalesce(TRY_CAST(value AS BIGINT) >= 2, false))", sort="unsorted")
for _slug, _name, _test, _cond in (
    ("str_empty_pred_10a", "note", {"empty": True}, "value = ''"),
    ("str_bytelen_pred_10b", "note", {"byteLength": {"min": 9, "max": 10}}, "strlen(value) BETWEEN 9 AND 10"),
    ("str_regexp_pred_10c", "title", {"regexp": "^[a-m].*t$", "equals": "ignored"}, "regexp_matches(value, '^[a-m].*t$')"),
    ("str_contains_pred_10d", "title", {"contains": "er", "hasSuffix": "1"}, "contains(value, 'er') AND value LIKE '%1'"),
    ("str_contains_ci_pred_10e", "title", {"contains": "OMER#0", "caseInsensitive": True}, "contains(lower(value), 'omer#0')"),
):
    found(_slug, {"permanode": {"attr": _name, "valueMatches": _test}}, _ATTR + f"attr = '{_name}' AND {_cond}", sort="unsorted")
found("time_between_pred_11_pred_32", {"permanode": {"time": {"after": "1996-01-01T00:00:00Z", "before": "1996-06-01T00:00:00Z"}}}, with_("times", "blob_meta", "dead") + "SELECT b.ref FROM blob_meta b JOIN times t ON t.ref = b.ref WHERE camli_type = 'permanode' AND b.ref NOT IN (SELECT ref FROM dead) AND any_time >= TIMESTAMP '1996-01-01' AND any_time < TIMESTAMP '1996-06-01'")
found("mod_time_pred_31", {"permanode": {"modTime": {"after": "2024-01-15T00:00:00Z"}}}, with_("times", "blob_meta", "dead") + f"SELECT b.ref FROM blob_meta b JOIN times t ON t.ref = b.ref WHERE camli_type = 'permanode' AND b.ref NOT IN (SELECT ref FROM dead) AND mod >= {_AT}")
_PLACED = with_("places", "blob_meta") + "SELECT b.ref FROM blob_meta b JOIN places p ON p.ref = b.ref WHERE camli_type = 'permanode' AND "
found("locrect_pred_12_pred_34", {"permanode": {"location": {"north": 40.0, "west": -20.0, "south": 10.0, "east": 60.0}}}, _PLACED + "lat BETWEEN 10 AND 40 AND long BETWEEN -20 AND 60", sort="unsorted")
found("locrect_dateline_pred_12", {"permanode": {"location": {"north": 40.0, "west": 170.0, "south": -40.0, "east": -150.0}}}, _PLACED + "lat BETWEEN -40 AND 40 AND (long >= 170 OR long <= -150)", sort="unsorted")
found("has_location_geo_01_kw_21", {"permanode": {"location": {"any": True}}}, _PLACED + "true", sort="unsorted")
_TAG = {"permanode": {"attr": "tag", "value": "t1"}}
_RATED = {"permanode": {"attr": "rating", "valueMatchesInt": {"min": 5}}}
_X = "ref IN (SELECT permanode FROM held WHERE attr = 'tag' AND value = 't1')"
_Y = "ref IN (SELECT permanode FROM held WHERE attr = 'rating' AND TRY_CAST(value AS BIGINT) >= 5)"
_BOTH = with_("blob_meta", "held") + "SELECT ref FROM blob_meta WHERE "
found("logical_and_pred_15", {"logical": {"op": "and", "a": _TAG, "b": _RATED}}, _BOTH + f"{_X} AND {_Y}", sort="unsorted")
found("logical_or_pred_16", {"logical": {"op": "or", "a": _TAG, "b": _RATED}}, _BOTH + f"{_X} OR {_Y}")
found("logical_xor_pred_17", {"logical": {"op": "xor", "a": _TAG, "b": _RATED}}, _BOTH + f"({_X}) <> ({_Y})")
found("logical_not_pred_18", {"logical": {"op": "not", "a": _TAG}}, _BOTH + f"NOT {_X}")
found("skip_hidden_pred_20_pred_30", {"permanode": {"skipHidden": True}}, with_("objects") + "SELECT ref FROM objects", sort="unsorted")
_FILE = with_("files", "images", "blob_meta", "media_tags", "exif_gps", "dir_children") + "SELECT b.ref FROM blob_meta b JOIN files f ON f.file_ref = b.ref LEFT JOIN images i ON i.file_ref = b.ref WHERE b.camli_type = 'file' AND "
found("file_size_name_pred_37_pred_38", {"file": {"fileSize": {"min": 3000}, "fileName": {"hasSuffix": ".txt"}}}, _FILE + "f.size >= 3000 AND file_name LIKE '%.txt'")
found("file_mime_pred_38", {"file": {"mimeType": {"equals": "text/html"}}}, _FILE + "mime = 'text/html'")
found("file_is_image_pred_39", {"file": {"isImage": True}}, _FILE + "mime LIKE 'image/%'")
found("file_time_pred_40", {"file": {"time": {"before": "2021-01-01T00:05:00Z"}}}, _FILE + "time < TIMESTAMP '2021-01-01 00:05:00'")
found("file_whole_ref_pred_41", {"file": {"wholeRef": "sha1-" + "7".zfill(40)}}, _FILE + f"whole_ref = 'sha1-{'7'.zfill(40)}'")
found("file_width_range_pred_42", {"file": {"width": {"min": 400, "max": 800}, "height": {"min": 640}}}, _FILE + "width BETWEEN 400 AND 800 AND height >= 640")
found("file_ratio_pred_43", {"file": {"widthHeightRation": {"min": 1.5, "max": 2.5}}}, _FILE + "CAST(width AS DOUBLE) / height BETWEEN 1.5 AND 2.5")
found("file_location_pred_44_join_08", {"file": {"location": {"north": 30.0, "west": -90.0, "south": -30.0, "east": 90.0}}}, _FILE + "f.whole_ref IN (SELECT whole_ref FROM exif_gps WHERE lat BETWEEN -30 AND 30 AND long BETWEEN -90 AND 90)")
found("file_media_tag_pred_45", {"file": {"mediaTag": {"tag": "year", "int": {"min": 2000, "max": 2010}}}}, _FILE + "f.whole_ref IN (SELECT whole_ref FROM media_tags WHERE tag = 'year' AND TRY_CAST(value AS BIGINT) BETWEEN 2000 AND 2010)")
found("file_parent_dir_pred_46_join_05", {"file": {"parentDir": {"fileName": {"hasPrefix": "home1"}}}}, _FILE + "b.ref IN (SELECT child_ref FROM dir_children c JOIN files d ON d.file_ref = c.dir_ref WHERE d.file_name LIKE 'home1%')")
_DIR = with_("files", "blob_meta", "dir_children") + "SELECT b.ref FROM blob_meta b JOIN files f ON f.file_ref = b.ref WHERE b.camli_type = 'directory' AND "
found("dir_name_pred_47", {"dir": {"fileName": {"contains": "n_1"}}}, _DIR + "contains(file_name, 'n_1')")
found("dir_parent_pred_48", {"dir": {"parentDir": {"fileName": {"equals": "asia"}}}}, _DIR + "b.ref IN (SELECT child_ref FROM dir_children c JOIN files d ON d.file_ref = c.dir_ref WHERE d.file_name = 'asia')")
found("dir_top_file_count_pred_49_agg_09", {"dir": {"topFileCount": {"min": 5}}}, _DIR + "b.ref IN (SELECT dir_ref FROM dir_children GROUP BY 1 HAVING count(DISTINCT child_ref) >= 5)")
found("dir_contains_pred_50_join_06", {"dir": {"contains": {"blobRefPrefix": "doc-0000001"}}}, _DIR + "b.ref IN (SELECT dir_ref FROM dir_children WHERE child_ref LIKE 'doc-0000001%')")
found(
    "dir_recursive_pred_51_join_07",
    {"dir": {"recursiveContains": {"file": {"fileName": {"contains": "-33"}}}}},
    with_("files", "dir_children") + ", h AS (SELECT c.dir_ref AS ref FROM dir_children c JOIN files f ON f.file_ref = c.child_ref WHERE f.mime <> '' AND contains(f.file_name, '-33')), n AS (SELECT dir_ref AS ref FROM dir_children WHERE child_ref IN (SELECT ref FROM h)), r AS (SELECT dir_ref AS ref FROM dir_children WHERE child_ref IN (SELECT ref FROM n)) SELECT ref FROM h UNION SELECT ref FROM n UNION SELECT ref FROM r",
)
found("value_in_set_pred_29_join_01", {"permanode": {"attr": "customer", "valueInSet": {"permanode": {"attr": "camliNodeType", "value": "MACHINERY"}}}}, with_("held") + "SELECT DISTINCT permanode AS ref FROM held WHERE attr = 'customer' AND value IN (SELECT permanode FROM held WHERE attr = 'camliNodeType' AND value = 'MACHINERY')", sort="unsorted")
found("content_is_image_join_02", {"permanode": {"attr": "camliContent", "valueInSet": {"file": {"isImage": True, "width": {"min": 1200}}}}}, with_("contents") + "SELECT ref FROM contents WHERE mime LIKE 'image/%' AND width >= 1200", sort="unsorted")
_EDGES = with_("heldall", "blob_meta") + ", e AS (SELECT DISTINCT permanode AS f, value AS t FROM heldall WHERE attr = 'camliMember' OR attr LIKE 'camliPath:%') "
found("children_of_join_03_kw_04", {"permanode": {"relation": {"relation": "parent", "any": {"blobRefPrefix": "place-0000001"}}}}, _EDGES + "SELECT DISTINCT t AS ref FROM e WHERE f LIKE 'place-0000001%'", sort="unsorted")
found("parent_of_join_04_kw_05", {"permanode": {"relation": {"relation": "child", "any": {"blobRefPrefix": "order-0000002"}}}}, _EDGES + "SELECT DISTINCT f AS ref FROM e WHERE t LIKE 'order-0000002%'", sort="unsorted")
found(
    "relation_all_join_03c",
    {"permanode": {"relation": {"relation": "child", "all": {"permanode": {"time": {"after": "1995-01-01T00:00:00Z"}}}}}},
    with_("heldall", "times") + ", e AS (SELECT DISTINCT permanode AS f, value AS t FROM heldall WHERE attr = 'camliMember') SELECT e.f AS ref FROM e LEFT JOIN times x ON x.ref = e.t GROUP BY 1 HAVING bool_and(coalesce(x.any_time >= TIMESTAMP '1995-01-01', false))",
    sort="unsorted",
)

# expressions

_KEYWORD = with_("objects", "held", "contents", "times", "dead", "places", "heldall") + "SELECT o.ref FROM objects o JOIN times t ON t.ref = o.ref WHERE t.any_time IS NOT NULL AND o.ref NOT IN (SELECT ref FROM dead) AND "
_HAS = "o.ref IN (SELECT permanode FROM held WHERE attr = '{0}' AND {1})"
_CONTENT = "o.ref IN (SELECT ref FROM contents WHERE {0})"
for _slug, _text, _cond in (
    ("after_kw_01", "after:1997", "t.any_time >= TIMESTAMP '1997-01-01'"),
    ("before_kw_02", "before:1995-06", "t.any_time < TIMESTAMP '1995-06-01'"),
    ("attr_kw_03", "attr:rating:7", _HAS.format("rating", "value = '7'")),
    ("attr_part_kw_03", "attr:title:~R#0000000", _HAS.format("title", "contains(lower(value), 'r#0000000')")),
    ("childrenof_kw_04", "childrenof:place-0000002", "o.ref IN (SELECT value FROM heldall WHERE attr = 'camliMember' AND permanode LIKE 'place-0000002%')"),
    ("parentof_kw_05", "parentof:order-0000001", "o.ref IN (SELECT permanode FROM heldall WHERE attr = 'camliMember' AND value LIKE 'order-0000001%')"),
    ("format_kw_06", "format:png", _CONTENT.format("mime = 'image/png'")),
    ("tag_kw_07", "tag:t2", _HAS.format("tag", "value = 't2'")),
    ("title_kw_08", "title:customer", _HAS.format("title", "contains(lower(value), 'customer')")),
    ("ref_kw_09", "ref:item-0000002", "o.ref LIKE 'item-0000002%'"),
    ("is_image_kw_10", "is:image", _CONTENT.format("mime LIKE 'image/%'")),
    ("height_kw_11", "height:-640", _CONTENT.format("mime LIKE 'image/%' AND height <= 640")),
    ("landscape_kw_12", "is:landscape", _CONTENT.format("mime LIKE 'image/%' AND CAST(width AS DOUBLE) / height >= 1.0")),
    ("pano_kw_13", "is:pano", _CONTENT.format("mime LIKE 'image/%' AND CAST(width AS DOUBLE) / height >= 2.0")),
    ("portrait_kw_14", "is:portrait", _CONTENT.format("mime LIKE 'image/%' AND CAST(width AS DOUBLE) / height <= 1.0")),
    ("width_kw_15", "width:800-1000", _CONTENT.format("mime LIKE 'image/%' AND width BETWEEN 800 AND 1000")),
    ("filename_kw_16", "filename:p1*", _CONTENT.format("file_name LIKE 'p1%'")),
    ("is_post_kw_17", "is:post", _HAS.format("camliNodeType", "value = 'twitter.com:tweet'")),
    ("is_like_kw_18", "is:like", _HAS.format("camliNodeType", "value = 'twitter.com:like'")),
    ("is_checkin_kw_19", "is:checkin", _HAS.format("camliNodeType", "value = 'foursquare.com:checkin'")),
    ("untagged_kw_20", "is:untagged", "NOT " + _HAS.format("tag", "strlen(value) >= 1")),
    ("has_location_kw_21", "has:location", "o.ref IN (SELECT ref FROM places)"),
    ("loc_kw_22", 'loc:"testville"', "o.ref IN (SELECT ref FROM places WHERE (lat BETWEEN -20 AND 50 AND (long >= 170 OR long <= -150)) OR (lat BETWEEN 0 AND 10 AND long BETWEEN 0 AND 20))"),
    ("locrect_kw_23", "locrect:60,-10,30,50", "o.ref IN (SELECT ref FROM places WHERE lat BETWEEN 30 AND 60 AND long BETWEEN -10 AND 50)"),
    ("with_kw_24", "with:ann", _HAS.format("with", "value IN (SELECT permanode FROM held WHERE attr IN ('givenName', 'familyName') AND contains(lower(value), 'ann') AND permanode IN (SELECT permanode FROM held WHERE attr = 'camliNodeType' AND value = 'foursquare.com:person'))")),
    ("named_kw_25", "named:tagged", _HAS.format("tag", "value IN ('t1', 't2')")),
    ("and_or_expr_04_expr_05", "tag:t1 and attr:rating:3 or tag:t2 attr:rating:4", f"(({_HAS.format('tag', chr(39).join(['value = ', 't1', '']))} AND {_HAS.format('rating', chr(39).join(['value = ', '3', '']))}) OR ({_HAS.format('tag', chr(39).join(['value = ', 't2', '']))} AND {_HAS.format('rating', chr(39).join(['value = ', '4', '']))}))"),
    ("negation_groups_expr_06_expr_07", "-(tag:t1 or tag:t2) is:image", "NOT " + _HAS.format("tag", "value IN ('t1', 't2')") + " AND " + _CONTENT.format("mime LIKE 'image/%'")),
):
    found(f"expr_{_slug}", None, _KEYWORD + _cond, expression=_text)
_WORDS = "after attr before childrenof filename format has:location height is:checkin is:image is:landscape is:like is:pano is:portrait is:post is:untagged loc locrect named parentof ref tag title width with"
query("keyword_help_kw_27", "SELECT unnest(string_split('" + _WORDS + "', ' ')) AS name, true AS described")(lambda spark, sf_dir: spark.createDataFrame(default_keywords(named=str).descriptions(), "name string, description string").select("name", (F.length("description") > 10).alias("described")))

# order and pages


@query("tag_newest", with_("times", "objects", "dead", "held") + "SELECT o.ref, epoch_us(t.any_time) AS time FROM objects o JOIN times t ON t.ref = o.ref WHERE o.ref NOT IN (SELECT ref FROM dead) AND o.ref IN (SELECT permanode FROM held WHERE attr = 'tag' AND value = 't1') ORDER BY t.any_time DESC, o.ref DESC LIMIT 50")
def tag_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Search(projection.store(spark, sf_dir)).query({"expression": "tag:t1", "limit": 50}).select("ref", micros("time"))


@query("page_continue_sort_08", with_("times", "blob_meta", "dead") + "SELECT b.ref FROM blob_meta b JOIN times t ON t.ref = b.ref WHERE camli_type = 'permanode' AND mod IS NOT NULL AND b.ref NOT IN (SELECT ref FROM dead) ORDER BY mod DESC, b.ref DESC LIMIT 40 OFFSET 40")
def page_continue(spark: SparkSession, sf_dir: str) -> DataFrame:
    search = Search(projection.store(spark, sf_dir))
    q = {"constraint": {"camliType": "permanode"}, "sort": "-mod", "limit": 40}
    return search.query(q | {"continue": search.next_token(q, search.query(q))}).select("ref")


found("page_around_sort_09_win_05", {"camliType": "file"}, with_("blob_meta") + ", r AS (SELECT ref, row_number() OVER (ORDER BY ref) AS n FROM blob_meta WHERE camli_type = 'file') SELECT ref FROM r, (SELECT n AS p FROM r WHERE ref = 'doc-00000100') WHERE n BETWEEN p - 10 AND p + 10 ORDER BY n LIMIT 21", sort="blobref", around="doc-00000100", limit=21)
on_store("map_spread_sort_10_sort_11_win_06", lambda s: geo.spread(Derived(s).places, 60).select("ref", "cell"), with_("places") + """, a AS (SELECT max(lat) AS n, min(lat) AS s, min(long) AS w0, max(long) AS e0, min(CASE WHEN long >= 0 THEN long END) AS wd, max(CASE WHEN long < 0 THEN long END) AS ed FROM places),
b AS (SELECT n, s, CASE WHEN ed - wd + 360 < e0 - w0 THEN wd ELSE w0 END AS w, CASE WHEN ed - wd + 360 < e0 - w0 THEN ed ELSE e0 END AS e FROM a),
g AS (SELECT p.*, CAST(least(7, floor((b.n - lat) / ((b.n - b.s) / 8))) * 8 + least(7, floor((long - b.w + CASE WHEN long < b.w THEN 360 ELSE 0 END) / (CASE WHEN b.e < b.w THEN (b.e - b.w) + 360 ELSE b.e - b.w END / 8))) AS INT) AS cell FROM places p, b),
t AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ref) AS turn FROM g) SELECT ref, cell FROM t ORDER BY turn, cell LIMIT 60""")
on_store("location_bounds_agg_11", lambda s: geo.area(Derived(s).places.where("long between -100 and 100")), with_("places") + "SELECT max(lat) AS north, min(long) AS west, min(lat) AS south, max(long) AS east FROM places WHERE long BETWEEN -100 AND 100")
on_store("places_geo_01_geo_02", lambda s: Derived(s).places, with_("places") + "SELECT ref, lat, long FROM places")
query("wrap_longitude_geo_03", "SELECT c_custkey, CASE WHEN x BETWEEN -180 AND 180 THEN x ELSE x - 360 * floor((x + 180) / 360) END AS long FROM (SELECT c_custkey, CAST(c_custkey % 1500 AS DOUBLE) - 700.5 AS x FROM customer)")(lambda spark, sf_dir: table(spark, sf_dir, "customer").select("c_custkey", geo.wrapped((F.col("c_custkey") % 1500).cast("double") - 700.5).alias("long")))

# lookups and windows

on_store("recent_win_01_ep_03", lambda s: lookup.recent(s, dead_of(s), None, 100).select("permanode", "signer", micros("mod")), with_("ownlive") + "SELECT permanode, last(signer ORDER BY date, claim_ref) AS signer, epoch_us(max(date)) AS mod FROM ownlive GROUP BY 1 ORDER BY 3 DESC, 1 DESC LIMIT 100")
on_store("permanode_attr_ep_04", lambda s: lookup.by_attribute(s, dead_of(s), "tag", "t5", 0), with_("ownlive") + "SELECT DISTINCT permanode FROM ownlive WHERE attr = 'tag' AND value = 't5' AND ctype <> 'del-attribute'")
on_store("claims_of_ep_05_ep_13", lambda s: lookup.claims_of(s, dead_of(s), "user-00000003").select("claim_ref", micros("date"), "ctype", "attr", "value"), with_("ownlive") + "SELECT claim_ref, epoch_us(date) AS date, ctype, attr, value FROM ownlive WHERE permanode = 'user-00000003'")
on_store("existing_files_join_15_ep_06", lambda s: lookup.existing_files(s).select("whole_ref", F.array_join("files", ",").alias("files")), with_("files") + "SELECT whole_ref, string_agg(DISTINCT file_ref, ',' ORDER BY file_ref) AS files FROM files WHERE whole_ref <> '' GROUP BY 1")
on_store("signer_attr_value_ep_07", lambda s: lookup.object_of_value(s, dead_of(s), "signer-01", "tag", "t1"), with_("live") + "SELECT permanode FROM live WHERE signer = 'signer-01' AND attr = 'tag' AND value = 't1' AND ctype <> 'del-attribute' ORDER BY date DESC, claim_ref DESC LIMIT 1")
_PATHS = with_("paths") + ", r AS (SELECT *, row_number() OVER (PARTITION BY signer, base, suffix ORDER BY date DESC, claim_ref DESC) AS n FROM paths{0}) SELECT signer, base, suffix, target, epoch_us(date) AS date FROM r WHERE n = 1"
on_store("signer_paths_win_02_ep_08", lambda s: lookup.active_paths(s, dead_of(s)).select("signer", "base", "suffix", "target", micros("date")), _PATHS.format("") + " AND active")
on_store("path_at_time_win_03", lambda s: lookup.paths_at(s, dead_of(s), datetime(1996, 1, 1, tzinfo=UTC)).select("signer", "base", "suffix", "target", micros("date")), _PATHS.format(" WHERE date <= TIMESTAMP '1996-01-01'"))
on_store("edges_to_join_12", lambda s: lookup.edges_to(s, dead_of(s)), with_("live", "dead") + "SELECT DISTINCT value AS child, permanode AS parent, attr AS name FROM live WHERE attr = 'camliMember' AND ctype <> 'del-attribute' AND permanode NOT IN (SELECT ref FROM dead)")
on_store("edges_to_verified_join_13_ep_09", lambda s: lookup.edges_to(s, dead_of(s), verified=True), with_("heldall") + "SELECT DISTINCT value AS child, permanode AS parent, attr AS name FROM heldall WHERE attr = 'camliMember'")
on_store("media_tags_join_09", lambda s: lookup.media_tags(s).select("file_ref", F.size("tags").alias("n"), F.col("tags")["title"].alias("title")), with_("files", "media_tags") + "SELECT f.file_ref, CAST(count(*) AS INT) AS n, max(CASE WHEN tag = 'title' THEN value END) AS title FROM files f JOIN media_tags m ON m.whole_ref = f.whole_ref GROUP BY 1")
on_store("content_claim_win_07", lambda s: replay.contents(s.claims).select("permanode", "value", micros("date")), with_("content") + "SELECT permanode, value, epoch_us(date) AS date FROM content")

# describe

on_store("describe_records_desc_01_desc_06", lambda s: describe.records(s, s.blob_meta.where("ref like 'item-%'"), dead_of(s)).select("ref", "size", describe.title(F.col("attrs"), F.lit("")).alias("title"), micros("mod"), describe.is_container(F.col("attrs")).alias("container")), with_("ownlive", "blob_meta") + "SELECT b.ref, b.size, t.value AS title, epoch_us(t.date) AS mod, false AS container FROM blob_meta b JOIN ownlive t ON t.permanode = b.ref AND t.attr = 'title' WHERE b.ref LIKE 'item-%'")
on_store("describe_container_desc_07", lambda s: describe.records(s, s.blob_meta.where("ref like 'place-%'"), dead_of(s)).where(describe.is_container(F.col("attrs"))).select("ref"), with_("held") + "SELECT DISTINCT permanode AS ref FROM held WHERE attr = 'camliMember'")
on_store("describe_depth2_desc_02", lambda s: describe.reach(s, s.blob_meta.where("ref like 'place-%'"), 2, dead_of(s)), with_("held", "blob_meta") + ", r AS (SELECT ref FROM blob_meta WHERE ref LIKE 'place-%'), n AS (SELECT DISTINCT value AS ref FROM held JOIN r ON r.ref = held.permanode WHERE attr = 'camliMember') SELECT ref, CAST(2 AS INT) AS depth FROM r UNION ALL SELECT ref, CAST(1 AS INT) FROM n")
on_store("describe_rules_desc_03_desc_04", lambda s: describe.by_rules(s, s.blob_meta.where("ref like 'place-%'"), (describe.Rule(("camliMember",), if_result_root=True, rules=(describe.Rule(("cust*",)),)),), dead_of(s)), with_("held", "blob_meta") + ", r AS (SELECT ref FROM blob_meta WHERE ref LIKE 'place-%') SELECT ref FROM r UNION SELECT value AS ref FROM held WHERE attr = 'camliMember' AND permanode IN (SELECT ref FROM r)")
on_store("describe_members_desc_05", lambda s: describe.members(s.dir_children), with_("dir_children") + ", r AS (SELECT *, row_number() OVER (PARTITION BY dir_ref ORDER BY child_ref) AS n FROM (SELECT DISTINCT * FROM dir_children)) SELECT dir_ref, child_ref FROM r WHERE n <= 50")

# set operations between two stores made of line items


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fit_tasks(spark, sf_dir, "lineitem")
    rows = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey").cast("string")
    key = F.when(F.length(key) < 8, F.lpad(key, 8, "0")).otherwise(key)  # lpad alone cuts longer keys
    ref = F.concat(F.lit("line-"), key, F.col("l_linenumber").cast("string"))
    size = F.floor("l_extendedprice").cast("bigint")
    one = rows.where("l_returnflag <> 'R'").select(ref.alias("ref"), size.alias("size"))
    two = rows.where("l_linestatus = 'O' or l_returnflag = 'R'").select(ref.alias("ref"), F.when(F.col("l_orderkey") % 50 == 0, size + 1).otherwise(size).alias("size"))
    return one.groupBy("ref").agg(F.max("size").alias("size")), two.groupBy("ref").agg(F.max("size").alias("size"))


_L = "'line-' || lpad(CAST(l_orderkey AS VARCHAR), greatest(8, length(CAST(l_orderkey AS VARCHAR)))::INT, '0') || CAST(l_linenumber AS VARCHAR)"
_Z = "CAST(floor(l_extendedprice) AS BIGINT)"
_TWO = f"WITH one AS (SELECT {_L} AS ref, max({_Z}) AS size FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), two AS (SELECT {_L} AS ref, max({_Z} + CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END) AS size FROM lineitem WHERE l_linestatus = 'O' OR l_returnflag = 'R' GROUP BY 1) "
_UNION = "SELECT ref, size FROM one UNION ALL SELECT ref, size FROM two WHERE ref NOT IN (SELECT ref FROM one)"


def on_two(name: str, f: Callable[[DataFrame, DataFrame], DataFrame], sql: str = "") -> None:
    query(name, _TWO + sql if sql else None)(lambda spark, sf_dir: f(*_two(spark, sf_dir)))


on_two("set_union_set_01_sto_07_sto_08", sets.union, _UNION)
on_two("set_missing_set_02_join_14", sets.missing, "SELECT ref, size FROM one WHERE ref NOT IN (SELECT ref FROM two)")
on_two("set_size_mismatch_set_03", sets.size_mismatches, "SELECT one.ref, one.size AS source_size, two.size AS target_size FROM one JOIN two ON one.ref = two.ref WHERE one.size <> two.size")
on_two("set_overlay_set_04_sto_09", lambda a, b: sets.overlay(a, b, a.where("size % 7 = 0")), f"SELECT * FROM ({_UNION}) WHERE ref NOT IN (SELECT ref FROM one WHERE size % 7 = 0)")
on_two("set_namespace_set_05_sto_11", sets.namespace, "SELECT ref, size FROM one WHERE ref IN (SELECT ref FROM two)")
on_two("set_shard_set_06_sto_06_fn_09", lambda a, b: sets.shard(a, 16).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "SELECT CAST(CAST('0x' || substr(ref, 6, 8) AS BIGINT) % 16 AS INT) AS shard, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM one GROUP BY 1")
on_two("set_concat_set_07", lambda a, b: a.unionAll(b), "SELECT ref, size FROM one UNION ALL SELECT ref, size FROM two")
on_two("set_validation_set_10", sets.validation, "SELECT coalesce(one.ref, two.ref) AS ref, CASE WHEN two.ref IS NULL THEN 'missing' WHEN one.ref IS NULL THEN 'extra' ELSE 'size' END AS problem FROM one FULL JOIN two ON one.ref = two.ref WHERE one.ref IS NULL OR two.ref IS NULL OR one.size <> two.size")
on_two("store_totals_sto_24_agg_17", lambda a, b: sets.totals(a), "SELECT count(*) AS blobs, CAST(sum(size) AS BIGINT) AS bytes FROM one")
on_two("store_route_sto_10", lambda a, b: sets.totals(sets.route(a, F.col("size") % 2 == 0)[0]), "SELECT count(*) AS blobs, CAST(sum(size) AS BIGINT) AS bytes FROM one WHERE size % 2 = 0")
on_two("archives_sto_23_win_08", lambda a, b: sets.archives(a, 1_000_000).groupBy("archive").agg(F.min("ref").alias("first"), F.count("*").alias("n"), F.sum("size").alias("bytes")), "SELECT archive, min(ref) AS first, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT ref, size, CAST(floor((sum(size) OVER (ORDER BY ref) - size) / 1000000) AS BIGINT) AS archive FROM one) GROUP BY 1")
on_store(
    "attribute_changes_set_09",
    lambda s: sets.attribute_changes(replay.held_values(own(s)).where("attr = 'tag'"), s.claims.where("attr = 'tag' and ctype = 'add-attribute'").select("permanode", "attr", "value")),
    with_("held") + ", h AS (SELECT DISTINCT permanode, attr, value FROM held WHERE attr = 'tag'), w AS (SELECT DISTINCT permanode, attr, value FROM claims WHERE attr = 'tag' AND ctype = 'add-attribute') SELECT permanode, attr, 'del-attribute' AS ctype, value FROM (SELECT * FROM h EXCEPT SELECT * FROM w) WHERE permanode IN (SELECT permanode FROM w) UNION ALL SELECT permanode, attr, 'add-attribute', value FROM (SELECT * FROM w EXCEPT SELECT * FROM h)",
)
on_store("gc_garbage_set_12", lambda s: sets.garbage(s.blob_meta.where("camli_type in ('directory', 'file')").select("ref"), s.dir_children.select(F.col("dir_ref").alias("ref"), F.col("child_ref").alias("next")), s.blob_meta.where("ref = 'region-00000002'")), with_("blob_meta", "dir_children") + ", n AS (SELECT child_ref AS ref FROM dir_children WHERE dir_ref = 'region-00000002'), h AS (SELECT child_ref AS ref FROM dir_children WHERE dir_ref IN (SELECT ref FROM n)), d AS (SELECT child_ref AS ref FROM dir_children WHERE dir_ref IN (SELECT ref FROM h)) SELECT ref FROM blob_meta WHERE camli_type IN ('directory', 'file') AND ref NOT IN (SELECT ref FROM n UNION SELECT ref FROM h UNION SELECT ref FROM d UNION SELECT 'region-00000002')")

# aggregates of applications

on_store("tag_histogram_agg_13", lambda s: replay.held_values(own(s)).where("attr = 'tag'").groupBy(F.col("value").alias("tag")).agg(F.count_distinct("permanode").alias("n")), with_("held") + "SELECT value AS tag, count(DISTINCT permanode) AS n FROM held WHERE attr = 'tag' GROUP BY 1")
on_store("corpus_stats_agg_12", lambda s: s.blob_meta.agg(F.count("*").alias("blobs"), F.sum("size").cast("bigint").alias("bytes"), F.count_if(F.expr("camli_type <> ''")).alias("schema_blobs"), F.count_if(F.expr("camli_type = 'permanode'")).alias("permanodes"), F.count_if(F.expr("camli_type = 'file'")).alias("files")), with_("blob_meta") + "SELECT count(*) AS blobs, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (WHERE camli_type <> '') AS schema_blobs, count(*) FILTER (WHERE camli_type = 'permanode') AS permanodes, count(*) FILTER (WHERE camli_type = 'file') AS files FROM blob_meta")
found("doc_tags_or", {"logical": {"op": "or", "a": {"permanode": {"attr": "tag", "value": "t1"}}, "b": {"permanode": {"attr": "tag", "value": "Brand#11"}}}}, _ATTR + "attr = 'tag' AND value IN ('t1', 'Brand#11')")
on_store("doc_untagged", lambda s: s.blob_meta.where("camli_type = 'permanode'").join(replay.held_values(own(s)).where("attr = 'tag' and value <> ''").select(F.col("permanode").alias("ref")), "ref", "left_anti").select("ref"), with_("blob_meta", "held") + "SELECT ref FROM blob_meta WHERE camli_type = 'permanode' AND ref NOT IN (SELECT permanode FROM held WHERE attr = 'tag' AND value <> '')")

# functions

query("fn_sums_fn_08_fn_09", "SELECT doc_id, 'sha1-' || sha1(text) AS sha1_ref, 'sha256-' || sha256(text) AS sha256_ref, CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) AS sum32 FROM documents")(lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", S.ref_of(F.col("text").cast("binary"), "sha1").alias("sha1_ref"), S.ref_of(F.col("text").cast("binary"), "sha256").alias("sha256_ref"), S.sum32(S.ref_of(F.col("text").cast("binary"), "sha256")).alias("sum32")))
query("fn_parse_fn_04_fn_05", "SELECT event_id, TRY_CAST(v AS BIGINT) AS i, TRY_CAST(v AS DOUBLE) AS f FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 'x' || CAST(user_id AS VARCHAR) ELSE '-' || CAST(user_id AS VARCHAR) END AS v FROM events)")(lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", F.expr("case event_id % 3 when 0 then cast(user_id as string) when 1 then concat('x', user_id) else concat('-', user_id) end").alias("v")).select("event_id", S.parsed_int(F.col("v")).alias("i"), S.parsed_float(F.col("v")).alias("f")))
on_store("fn_mime_extension_fn_10_src_11", lambda s: s.files.select("file_ref", S.mime_of_extension(F.col("file_name")).alias("mime")), with_("files") + "SELECT file_ref, CASE WHEN file_name LIKE '%.txt' THEN 'text/plain' WHEN file_name LIKE '%.html' THEN 'text/html' WHEN file_name LIKE '%.jpg' THEN 'image/jpeg' WHEN file_name LIKE '%.png' THEN 'image/png' ELSE '' END AS mime FROM files")
on_store("fn_scaled_size_fn_11", lambda s: s.images.select("file_ref", S.scaled_size(F.col("width"), F.col("height"), 640, 480).alias("x")).select("file_ref", "x.w", "x.h"), with_("images") + ", r AS (SELECT *, least(1.0::DOUBLE, 640.0::DOUBLE / width, 480.0::DOUBLE / height) AS r FROM images) SELECT file_ref, CAST(floor(CAST(width AS DOUBLE) * r) AS INT) AS w, CAST(floor(CAST(height AS DOUBLE) * r) AS INT) AS h FROM r")
query("fn_byte_length_fn_02", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents WHERE strlen(text) > 1000")(lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n")).where("n > 1000"))

# ingestion: event claims as documents, and back


def _claim_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = projection.store(spark, sf_dir).claims.where("claim_ref like 'claim-%'")
    doc = F.to_json(F.struct(F.lit(1).alias("camliVersion"), F.lit("claim").alias("camliType"), F.col("ctype").alias("claimType"), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("claimDate"), F.col("permanode").alias("permaNode"), F.col("signer").alias("camliSigner"), F.col("attr").alias("attribute"), "value"))
    return c.select(F.col("claim_ref").alias("ref"), doc.cast("binary").alias("data"))


query("ingest_claims_src_01_src_02", with_("claims") + "SELECT claim_ref, permanode, signer, epoch_us(date) AS date, ctype, attr, value FROM claims WHERE claim_ref LIKE 'claim-%'")(lambda spark, sf_dir: ingest.claims(ingest.sniff(_claim_documents(spark, sf_dir))).select("claim_ref", "permanode", "signer", micros("date"), "ctype", "attr", "value"))
query("ingest_sniff_src_01", "SELECT page_id, CASE WHEN substr(html, 1, 1) = '{' THEN 'claim' ELSE '' END AS camli_type FROM pages")(lambda spark, sf_dir: ingest.sniff(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("ref"), F.col("html").cast("binary").alias("data"))).select(F.col("ref").cast("bigint").alias("page_id"), "camli_type"))
query(
    "ingest_chunks_src_10",
    """WITH RECURSIVE d AS (SELECT 'doc-' || doc_id AS ref, hex(encode(text)) AS h, CAST(length(hex(encode(text))) // 2 AS BIGINT) AS n FROM documents),
b AS (SELECT ref, i, CAST('0x' || substr(h, CAST(2 * i + 1 AS INT), 2) AS BIGINT) + 31 AS x FROM (SELECT ref, h, unnest(range(0, n)) AS i FROM d WHERE n > 65536)),
one AS (SELECT ref, i, sum(x) OVER (PARTITION BY ref ORDER BY i ROWS 63 PRECEDING) AS s1 FROM b),
two AS (SELECT ref, i, CAST(sum(s1) OVER (PARTITION BY ref ORDER BY i ROWS 63 PRECEDING) AS BIGINT) AS s2 FROM one),
spot AS (SELECT ref, list(i + 1 ORDER BY i) AS l FROM two WHERE s2 % 8192 = 8191 GROUP BY ref),
e AS (SELECT d.ref, n, coalesce(l, []) AS l FROM d LEFT JOIN spot ON spot.ref = d.ref WHERE n > 0),
w AS (SELECT ref, n, l, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS a, CASE WHEN n <= 65536 THEN n ELSE least(n, 1048576, coalesce(list_filter(l, lambda p: p >= 262144)[1], n)) END AS z FROM e
  UNION ALL SELECT ref, n, l, pos + 1, z, least(n, z + 1048576, coalesce(list_filter(l, lambda p: p >= z + 65536)[1], n)) FROM w WHERE z < n)
SELECT w.ref, CAST(pos AS INT) AS pos, a AS "offset", z - a AS size, 'sha256-' || sha256(unhex(substr(h, CAST(2 * a + 1 AS INT), CAST(2 * (z - a) AS INT)))) AS chunk_ref FROM w JOIN d ON d.ref = w.ref""",
)(lambda spark, sf_dir: ingest.chunks(table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("ref"), F.col("text").cast("binary").alias("data")), "sha256"))
on_store("ingest_file_times_src_04_agg_15", lambda s: s.files.select("file_ref", ingest.file_times(F.array("mod_time", "time", F.lit("1980-01-01 00:00:00").cast("timestamp"))).alias("t")).select("file_ref", micros("t.time", "time"), micros("t.mod_time", "mod_time")), with_("files") + "SELECT file_ref, epoch_us(least(time, mod_time)) AS time, epoch_us(CASE WHEN time <> mod_time THEN greatest(time, mod_time) END) AS mod_time FROM files")
on_store("ingest_gps_src_06", lambda s: ingest.gps(s.exif_gps.select("whole_ref", (F.col("lat") * 2).alias("lat"), "long")), with_("exif_gps") + "SELECT whole_ref, round(lat * 2, 7) AS lat, round(long, 7) AS long FROM exif_gps WHERE abs(lat * 2) <= 90")
on_store("vivify_src_12", lambda s: ingest.vivify(s.files.where("mime = 'text/html'"), "signer-00", F.col("time"), "sha256").select("claim_ref", "permanode", "value"), with_("files") + "SELECT 'sha256-' || sha256('claim:' || file_ref) AS claim_ref, 'sha256-' || sha256('permanode:' || file_ref) AS permanode, file_ref AS value FROM files WHERE mime = 'text/html'")
on_store("stream_replay_str_03_str_04", lambda s: _joined(live.replay_as_stream(s.spark, s.claims)), with_("heldall") + _lists("heldall"))
