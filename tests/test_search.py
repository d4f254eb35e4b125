"""Searches over small stores: order, pages, windows, directories, relations, times and places."""

import json
from datetime import UTC, datetime, timedelta

import pytest

from keelson.functions import scalar as S
from keelson.model import SCHEMAS, Store
from keelson.operators import describe, geo, lookup, replay
from keelson.plans.constraints import from_json
from keelson.plans.search import Search, page_size, read_token, write_token
from keelson.runtime import QueryError
from pyspark.sql import functions as F

START = datetime(2020, 1, 1, tzinfo=UTC)


def claim(n, pn, attr, value, ctype="set-attribute", signer="s-1"):
    return (f"c-{n:04x}", pn, signer, START + timedelta(seconds=n), ctype, attr, value)


@pytest.fixture(scope="module")
def store(spark):
    """Nine objects a-1 to a-9 made one after the other, directories, files, an object with a member."""
    claims = [claim(i, f"a-{i}", "tag", "even" if i % 2 == 0 else "odd") for i in range(1, 10)]
    claims += [claim(20, "a-1", "camliMember", "a-2", "add-attribute"), claim(21, "a-1", "camliMember", "a-3", "add-attribute"), claim(22, "a-4", "latitude", "1.0"), claim(23, "a-4", "longitude", "179.0"), claim(24, "a-5", "latitude", "x"), claim(25, "a-5", "longitude", "3")]
    claims += [claim(26, "a-6", "camliDefVis", "hide"), claim(27, "a-7", "tag", "other", signer="s-2"), claim(28, "a-8", "camliContent", "f-1")]
    files = [("d-1", "attic"), ("d-2", "chest"), ("d-3", "cellar"), ("f-1", "north.map"), ("f-2", "south.map"), ("f-3", "barrel")]
    meta = [(f"a-{i}", 10 + i, "permanode") for i in range(1, 10)] + [(r, 50, "directory" if r[0] == "d" else "file") for r, _ in files] + [("b-1", 7, "")]
    make = lambda name, rows: spark.createDataFrame(rows, SCHEMAS[name])
    return Store.of(
        spark,
        blob_meta=make("blob_meta", meta),
        claims=make("claims", claims),
        signers=make("signers", [("s-1", "ka"), ("s-2", "kb")]),
        deletions=make("deletions", [("a-9", "c-00ff")]),
        files=make("files", [(r, n, 1, "text/plain" if r[0] == "f" else "", START if r == "f-1" else None, None, f"w-{r[2]}") for r, n in files]),
        exif_gps=make("exif_gps", [("w-1", 5.0, 6.0)]),
        dir_children=make("dir_children", [("d-1", "d-2"), ("d-2", "f-1"), ("d-2", "f-2"), ("d-3", "f-3")]),
    )


def refs(store, q):
    return [r["ref"] for r in Search(store).query(q).collect()]


def test_newest_first_without_deleted_and_hidden(store):
    assert refs(store, {"expression": "tag:even", "sort": "-mod"}) == ["a-8", "a-4", "a-2"]
    assert refs(store, {"constraint": {"permanode": {"attr": "tag", "value": "odd"}}, "sort": "blobref"}) == ["a-1", "a-3", "a-5", "a-7", "a-9"]
    assert "a-9" not in refs(store, {"constraint": {"permanode": {"attr": "tag", "value": "odd"}}, "sort": "-created"})


def test_claims_of_other_keys_do_not_count(store):
    assert refs(store, {"constraint": {"permanode": {"attr": "tag", "value": "other"}}, "sort": "blobref"}) == []


def test_pages(store):
    search = Search(store)
    q = {"constraint": {"camliType": "permanode"}, "sort": "-mod", "limit": 3}
    seen, token = [], ""
    for _ in range(5):
        page = search.query(q | ({"continue": token} if token else {}))
        seen += [r["ref"] for r in page.collect()]
        token = search.next_token(q, page)
        if not token:
            break
    assert seen == refs(store, q | {"limit": -1}) and len(seen) == 8


def test_tokens():
    t = datetime(2020, 1, 2, 3, 4, 5, 678901, tzinfo=UTC)
    assert read_token(write_token(t, "a-1")) == (t, "a-1")
    assert read_token("pn:x:a-1") is None and read_token("nope") is None
    assert [page_size(n) for n in (0, -1, 20, 1000, 1001)] == [50, 50, 20, 1000, 50]


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 5, 20])
@pytest.mark.parametrize("sort", ["-mod", "blobref", "created"])
def test_around(store, limit, sort):
    q = {"constraint": {"permanode": {"attr": "tag", "numValue": {"min": 1}}}, "sort": sort}
    rows = refs(store, q | {"limit": -1})
    for ref in (rows[0], rows[len(rows) // 2], rows[-1]):
        start = max(0, rows.index(ref) - limit // 2)
        assert refs(store, q | {"limit": limit, "around": ref}) == rows[start : start + limit]
    assert refs(store, q | {"limit": limit, "around": "z-1"}) == []


def test_directories(store):
    holds = {"dir": {"recursiveContains": {"file": {"fileName": {"contains": "north.map"}}}}}
    assert refs(store, {"constraint": holds}) == ["d-1", "d-2"]
    assert refs(store, {"constraint": {"dir": {"contains": {"blobRefPrefix": "f-1"}}}}) == ["d-2"]
    assert refs(store, {"constraint": {"dir": holds["dir"] | {"fileName": {"equals": "attic"}}}}) == []
    assert refs(store, {"constraint": {"file": {"parentDir": {"parentDir": {"fileName": {"equals": "attic"}}}}}}) == ["f-1", "f-2"]
    assert refs(store, {"constraint": {"dir": {"topFileCount": {"min": 2}}}}) == ["d-2"]


def test_relations(store):
    by = lambda r: {"constraint": {"permanode": {"relation": r}}, "sort": "blobref"}
    assert refs(store, by({"relation": "parent", "any": {"blobRefPrefix": "a-1"}})) == ["a-2", "a-3"]
    assert refs(store, by({"relation": "child", "any": {"blobRefPrefix": "a-2"}})) == ["a-1"]
    assert refs(store, by({"relation": "child", "all": {"blobRefPrefix": "a-2"}})) == []
    assert refs(store, by({"relation": "child", "all": {"camliType": "permanode"}})) == ["a-1"]


def test_logic_is_two_valued(store):
    none = {"permanode": {"attr": "never", "value": "x"}}
    assert len(refs(store, {"constraint": {"logical": {"op": "not", "a": none}}})) == 16
    assert refs(store, {"constraint": {"logical": {"op": "xor", "a": none, "b": {"camliType": ""}}}}) == []
    assert refs(store, {"constraint": {"logical": {"op": "not", "a": {"anyCamliType": True}}}}) == ["b-1"]
    assert refs(store, {"constraint": {}}) == []


def test_places(store):
    assert {r["ref"]: (r["lat"], r["long"]) for r in Search(store).derived.places.collect()} == {"a-4": (1.0, 179.0), "a-8": (5.0, 6.0)}
    assert refs(store, {"expression": "locrect:2,178,0,-170"}) == ["a-4"]
    area = Search(store).area({"expression": "has:location"}).first()
    assert tuple(area) == (5.0, 6.0, 1.0, 179.0)


def test_content_time(store):
    assert refs(store, {"constraint": {"permanode": {"time": {"before": "2020-01-01T00:00:01Z"}}}, "sort": "blobref"}) == ["a-8"]


def test_invalid_queries(store):
    for q, text in (({"sort": "mod"}, "unsupported"), ({"sort": "nope"}, "invalid sort"), ({"constraint": {"anything": True}, "sort": "-mod"}, "unsupported"), ({"constraint": {"anything": True}, "sort": "created"}, "ctime"), ({"continue": "pn:1:a-1", "around": "a-1"}, "mutually exclusive"), ({"sort": "map", "around": "a-1"}, "MapSort"), ({"constraint": {"anything": True}, "expression": "tag:x"}, "mutually exclusive")):
        with pytest.raises(QueryError) as e:
            Search(store).query(q)
        assert text in str(e.value)
    with pytest.raises(QueryError):
        from_json(json.dumps({"constraint": {"anything": True}, "extra": 1}))
    with pytest.raises(QueryError):
        from_json('{"expression": "' + "x" * (1 << 20) + '"}')


def test_map_spread_fills_the_limit(spark):
    places = spark.range(5000).select(F.concat(F.lit("p-"), F.lpad(F.hex("id"), 6, "0")).alias("ref"), (F.rand(1) * 180 - 90).alias("lat"), (F.rand(2) * 360 - 180).alias("long"))
    assert geo.spread(places.cache(), 117).count() == 117


BOXES = [(None, (35, -90), (35, -90, 35, -90)), ((35, -90, 35, -90), (40, -100), (40, -100, 35, -90)), ((40, -100, 35, -90), (37, 170), (40, 170, 35, -90)), ((40, 170, 35, -90), (-20, 20), (40, 170, -20, 20)), ((40, 120, 35, 160), (-20, -160), (40, 120, -20, -160)), ((40, 120, -20, -160), (0, 100), (40, 100, -20, -160))]


@pytest.mark.parametrize(("before", "point", "after"), BOXES)
def test_boxes_grow_on_the_shorter_side(before, point, after):
    assert geo.expanded(before, *point) == after


def test_geometry_columns(spark):
    row = spark.createDataFrame([(-50.0,), (50.0,), (-190.2,), (190.3,), (-362.0,), (362.0,)], "x double").select(F.round(geo.wrapped(F.col("x")), 6).alias("w"))
    assert [r["w"] for r in row.collect()] == [-50.0, 50.0, 169.8, -169.7, -2.0, 2.0]
    box = lambda la, lo, c: spark.range(1).select(geo.in_rectangle(F.lit(float(la)), F.lit(float(lo)), c).alias("x")).first()["x"]
    plain = {"north": 2, "south": 1, "east": 2}
    assert [box(*p, plain) for p in ((1, 1), (3, 1), (1, 3), (1, -1), (0, 1))] == [True, False, False, False, False]
    line = {"north": 2, "south": 1, "west": 179, "east": -179}
    assert [box(*p, line) for p in ((1, 179), (1, -178), (1, 177), (3, 179), (0, 179))] == [True, False, False, False, False]
    assert not box(1, 2, {}) and box(1, 2, {"any": True})


def test_time_constraint(spark):
    t = lambda s, us=0: datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=s, microseconds=us)
    ok = lambda c, v: spark.range(1).select(S.time_test(F.lit(v), c, t(10**9)).alias("x")).first()["x"]
    assert ok({"before": t(124)}, t(123)) and not ok({"before": t(123)}, t(123, 1)) and ok({"after": t(123)}, t(123)) and not ok({"after": t(123)}, t(122)) and not ok({"inLast": 365 * 86400}, t(123))


def test_lookups_and_descriptions(store):
    dead = replay.deleted(store.deletions)
    assert [r["permanode"] for r in lookup.recent(store, dead, None, 2).collect()] == ["a-8", "a-6"]
    assert {r["child"] for r in lookup.edges_to(store, dead, verified=True).collect()} == {"a-2", "a-3"}
    with pytest.raises(QueryError):
        lookup.by_attribute(store, dead, "tag", "x", fuzzy=True)
    roots = store.blob_meta.where("ref = 'a-1'")
    got = describe.by_rules(store, roots, (describe.Rule(("camliMember",), if_result_root=True),), dead)
    assert {r["ref"] for r in got.collect()} == {"a-1", "a-2", "a-3"}
    record = describe.records(store, store.blob_meta.where("ref in ('a-8', 'd-2', 'zz')"), dead).collect()
    assert {r["ref"]: r["children"] for r in record} == {"a-8": None, "d-2": ["f-1", "f-2"]}


def test_attribute_lookup_without_limit(spark):
    """All objects with the value come, also more than a page holds; a limit still cuts, newest first."""
    rows = [claim(i, f"a-{i}", "tag", "x") for i in range(1, 1203)]
    s = Store.of(spark, claims=spark.createDataFrame(rows, SCHEMAS["claims"]), signers=spark.createDataFrame([("s-1", "ka")], SCHEMAS["signers"]))
    dead = replay.deleted(s.deletions)
    assert lookup.by_attribute(s, dead, "tag", "x", 0).count() == 1202
    assert [r["permanode"] for r in lookup.by_attribute(s, dead, "tag", "x", 2).collect()] == ["a-1202", "a-1201"]


def test_objects_without_reference_do_not_meet_in_one_task(spark):
    """Places of objects are right, and those that refer to nothing are dealt over the tasks of the joins."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    first = [(f"a-{i}", a, v) for i in range(200) for a, v in (("latitude", f"{i / 10}"), ("longitude", "1.5"))]
    first += [("b-1", "camliContent", "f-1"), ("b-2", "camliNodeType", "foursquare.com:checkin"), ("b-2", "foursquareVenuePermanode", "a-7"), ("b-3", "camliContent", "f-9")]
    make = lambda name, rows: spark.createDataFrame(rows, SCHEMAS[name])
    try:
        for n, v in zip(names, ("-1", "false"), strict=True):
            spark.conf.set(n, v)
        files = make("files", [("f-1", "x", 1, "", None, None, "w-1")])
        got = geo.object_places(spark.createDataFrame(first, "permanode string, attr string, value string"), files, make("exif_gps", [("w-1", 5.0, 6.0)]))
        rows = got.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    places = {r["ref"]: (r["lat"], r["long"]) for r in rows}
    assert len(rows) == len(places) == 202
    assert places["b-1"] == (5.0, 6.0) and places["b-2"] == (0.7, 1.5) and places["a-199"] == (19.9, 1.5)
    assert len({r["task"] for r in rows if r["ref"].startswith("a-")}) > 1
