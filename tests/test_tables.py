"""Set operations, stores, ingestion, streams, and the queries against their SQL."""

import hashlib
import json
import random
from datetime import UTC, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from keelson import queries, runtime
from keelson.model import SCHEMAS, Store
from keelson.operators import geo, replay, sets
from keelson.sources import ingest, projection, stores
from keelson.streaming import live


def blobs(spark, *rows):
    return spark.createDataFrame(list(rows), "ref string, size bigint")


def pairs(df):
    return {(r["ref"], r["size"]) for r in df.collect()}


def test_set_operations(spark):
    a, b = blobs(spark, ("x-1", 1), ("x-2", 2), ("x-3", 3)), blobs(spark, ("x-2", 9), ("x-4", 4))
    assert pairs(sets.union(a, b)) == {("x-1", 1), ("x-2", 2), ("x-3", 3), ("x-4", 4)}
    assert pairs(sets.overlay(a, b, blobs(spark, ("x-3", 0)))) == {("x-1", 1), ("x-2", 2), ("x-4", 4)}
    assert {r["ref"]: r["problem"] for r in sets.validation(a, b).collect()} == {"x-1": "missing", "x-2": "size", "x-3": "missing", "x-4": "extra"}
    assert pairs(sets.enumerate_blobs(a, "x-1", 1)) == {("x-2", 2)}
    assert [r["shard"] for r in sets.shard(blobs(spark, ("sha1-0000000a", 1)), 4).collect()] == [2]
    assert pairs(sets.missing(a, b.limit(0))) == pairs(a)


def test_line_keys_are_never_cut(spark, tmp_path):
    rows = [(123456781, 1, "N", "O", 5.5), (123456782, 1, "N", "O", 7.5), (7, 1, "N", "O", 9.5)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    one, _ = queries._two(spark, str(tmp_path))
    assert {tuple(r) for r in one.collect()} == {("line-1234567811", 5), ("line-1234567821", 7), ("line-000000071", 9)}


def test_archives_are_stretches_of_the_sum_of_sizes(spark):
    rows = sets.archives(blobs(spark, *((f"x-{i}", 4) for i in range(6))).repartition(3), 8).collect()
    assert [r["archive"] for r in sorted(rows)] == [0, 0, 1, 1, 2, 2]
    rng = random.Random(2)
    sizes = [rng.randint(1, 50) for _ in range(500)]
    rows = sorted(sets.archives(blobs(spark, *((f"x-{i:04d}", n) for i, n in enumerate(sizes))), 100).collect())
    assert [r["archive"] for r in rows] == [sum(sizes[:i]) // 100 for i in range(500)]
    assert sets.archives(blobs(spark, ("x-1", 1)).limit(0), 8).count() == 0


def test_garbage_and_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "ref string, next string")
    roots = spark.createDataFrame([("a",)], "ref string")
    assert pairs(sets.garbage(blobs(spark, ("a", 1), ("b", 1), ("c", 1), ("d", 1)), links, roots)) == {("c", 1), ("d", 1)}


def test_share_chains(spark):
    now = datetime(2024, 1, 1, tzinfo=UTC)
    shares = spark.createDataFrame([("s-1", "a-1", True, None, False), ("s-2", "a-1", False, None, False), ("s-3", "a-1", True, datetime(2020, 1, 1), False), ("s-4", "a-1", True, None, True)], "ref string, target string, transitive boolean, expires timestamp, deleted boolean")
    links = spark.createDataFrame([("a-1", "a-2")], "ref string, next string")
    ok = lambda *c: sets.share_allows(shares, links, list(c), now)
    assert ok("s-1", "a-1") and ok("s-1", "a-1", "a-2") and ok("s-2", "a-1")
    assert not ok("s-2", "a-1", "a-2") and not ok("s-3", "a-1") and not ok("s-4", "a-1") and not ok("s-1", "a-2") and not ok("s-1", "a-1", "a-3")


def test_attribute_changes_are_minimal(spark):
    have = spark.createDataFrame([("p", "t", "a"), ("p", "t", "b")], "permanode string, attr string, value string")
    want = spark.createDataFrame([("p", "t", "b"), ("p", "t", "c"), ("q", "t", "a")], "permanode string, attr string, value string")
    assert {tuple(r) for r in sets.attribute_changes(have, want).collect()} == {("p", "t", "del-attribute", "a"), ("p", "t", "add-attribute", "c"), ("q", "t", "add-attribute", "a")}


def documents(spark, docs):
    rows = [(ref, bytearray(json.dumps(d).encode() if isinstance(d, dict) else d)) for ref, d in docs.items()]
    return spark.createDataFrame(rows, "ref string, data binary")


def test_ingestion(spark):
    raw = documents(
        spark,
        {
            "p-1": {"camliType": "permanode"}, "c-1": {"camliType": "claim", "claimType": "set-attribute", "claimDate": "2020-01-01T00:00:00Z", "permaNode": "p-1", "camliSigner": "s", "attribute": "tag", "value": "x"},
            "c-2": {"camliType": "claim", "claimType": "delete", "target": "c-1"}, "c-3": {"camliType": "claim", "claimType": "delete", "target": "f-1"},
            "f-1": {"camliType": "file", "fileName": "f", "parts": [{"size": 3, "blobRef": "b-1", "offset": 1}, {"size": 2}, {"size": 4, "bytesRef": "y-1"}]}, "y-1": {"camliType": "bytes", "parts": [{"size": 2, "blobRef": "b-1"}, {"size": 2, "blobRef": "b-2"}]},
            "b-1": b"hello", "b-2": b"\xff\xd8\xff\xe0", "d-1": {"camliType": "directory", "fileName": "d", "entries": "e-1"}, "e-1": {"camliType": "static-set", "members": ["f-1"], "mergeSets": ["e-2"]}, "e-2": {"camliType": "static-set", "members": ["f-2"]}, "x-1": b"{broken",
        },
    )
    s = ingest.sniff(raw)
    kinds = {r["ref"]: (r["camli_type"], r["mime"]) for r in s.collect()}
    assert kinds["p-1"][0] == "permanode" and kinds["b-2"] == ("", "image/jpeg") and kinds["x-1"][0] == ""
    assert [r["value"] for r in ingest.claims(s).collect()] == ["x"]
    assert [tuple(r) for r in ingest.deletions(s).collect()] == [("c-1", "c-2")]
    pieces = ingest.file_pieces(ingest.file_chunks(s), raw)
    assert sorted((r["start"], r["size"], r["data"] and bytes(r["data"])) for r in pieces.collect()) == [(0, 3, b"ell"), (3, 2, None), (5, 2, b"he"), (7, 2, b"\xff\xd8")]
    assert [tuple(r) for r in ingest.whole_refs(pieces).collect()] == [("f-1", 9, "sha224-" + hashlib.sha224(b"ell\0\0he\xff\xd8").hexdigest())]
    assert {r["ref"]: r["size"] for r in ingest.file_sizes(s).collect()} == {"f-1": 9, "y-1": 4}
    rows, children = ingest.directories(s)
    assert [(r["file_ref"], r["size"]) for r in rows.collect()] == [("d-1", 2)] and {r["child_ref"] for r in children.collect()} == {"f-1", "f-2"}
    assert ingest.missing_parts(s.where("ref <> 'b-2'")).collect()[0][:] == ("y-1", "b-2")


def test_chunk_bounds():
    import random

    data = random.Random(1).randbytes(3 << 20)
    ends = ingest.chunk_bounds(data)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(data) and max(sizes) <= ingest.MAX_CHUNK and sizes[0] >= ingest.FIRST_CHUNK and min(sizes[1:-1]) >= ingest.MIN_CHUNK
    moved = ingest.chunk_bounds(data[:700_000] + b"!" + data[700_000:])
    assert len({x - 1 for x in moved} & set(ends)) >= len(ends) // 2  # an insertion moves the bounds behind it only
    assert ingest.chunk_bounds(b"") == [] and ingest.chunk_bounds(b"x") == [1]


def test_stores(spark, tmp_path):
    import hashlib

    good = b"some bytes"
    ref = "sha1-" + hashlib.sha1(good).hexdigest()
    (tmp_path / f"{ref}.dat").write_bytes(good)
    rows = stores.read(spark, "filesystem", path=f"file://{tmp_path}")
    got = stores.received(rows.unionAll(rows).unionByName(rows.withColumn("ref", F.lit("sha1-" + "0" * 40)))).collect()
    assert [(r["ref"], r["size"]) for r in got] == [(ref, len(good))]
    locked = stores.encrypted(rows, b"0123456789abcdef").cache()
    assert bytes(stores.decrypted(locked, b"0123456789abcdef").first()["data"]) == good
    assert stores.decrypted(locked, b"fedcba9876543210").first()["data"] is None


def test_projected_store_is_read_where_it_lies(spark, data, monkeypatch):
    """No table is written for a query, and a condition on an attribute leaves the sources that can have it."""
    monkeypatch.setattr(projection, "_stores", {})
    monkeypatch.setattr(Store, "save", lambda *_: pytest.fail("written"))
    s = projection.store(spark, data)
    assert s.blob_meta.where("camli_type = 'directory'").count() == 5 + 25 + 150
    assert {f.rsplit("/", 1)[1] for f in s.claims.where("attr = 'price'").inputFiles()} == {"part.parquet"}


def test_more_rows_more_tasks(spark, data, monkeypatch):
    """Partitions follow the rows of the tables, and are never fewer than the session asks for."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        runtime.fit_tasks(spark, data, "lineitem")
        assert [spark.conf.get(n) for n in names] == before
        monkeypatch.setattr(runtime, "ROWS_A_TASK", 100)
        runtime.fit_tasks(spark, data, "lineitem")
        assert int(spark.conf.get(names[0])) == spark.read.parquet(f"{data}/lineitem.parquet").count() // 100
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def test_set_queries_fit_tasks(spark, data, monkeypatch):
    """Queries on two stores of line items raise the number of partitions with the rows."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        monkeypatch.setattr(runtime, "ROWS_A_TASK", 100)
        queries.QUERIES["set_union_set_01_sto_07_sto_08"](spark, data)
        assert int(spark.conf.get(names[0])) == spark.read.parquet(f"{data}/lineitem.parquet").count() // 100
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def test_store_tables_round_trip(spark, data, tmp_path):
    s = projection.store(spark, data)
    s.save(str(tmp_path / "s"))
    again = Store.load(spark, str(tmp_path / "s"))
    assert again.blob_meta.count() == s.blob_meta.count() and again.claims.count() == s.claims.count()


def test_streams(spark, tmp_path):
    claims = projection.store(spark, "/root/testdata/sf0.001").claims.where("permanode like 'user-%'")
    key = lambda df: sorted((r["permanode"], r["attr"], tuple(r["vals"])) for r in df.collect())
    assert key(live.replay_as_stream(spark, claims)) == key(replay.attributes(claims))
    pending = spark.createDataFrame([("f-1", "b-1"), ("f-1", "b-2"), ("f-2", "b-1")], "ref string, needed string")
    rest, ready = live.Parking(pending).arrived(spark.createDataFrame([("b-1",)], "ref string"))
    assert [tuple(r) for r in rest.collect()] == [("f-1", "b-2")] and [r["ref"] for r in ready.collect()] == ["f-2"]


def test_a_batch_of_a_stream_has_many_files(spark, data, monkeypatch):
    seen, stream = [], live.claim_stream
    monkeypatch.setattr(live, "claim_stream", lambda spark, folder, n: seen.append((len(spark.read.parquet(folder).inputFiles()), n)) or stream(spark, folder, n))
    claims = projection.store(spark, data).claims.where("permanode like 'user-%'")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    live.replay_as_stream(spark, claims, batches=2)
    assert seen == [(parts, parts // 2)]


def test_a_stream_ends_with_one_shuffle(spark, data, monkeypatch):
    seen, attributes = [], live.replay.attributes
    monkeypatch.setattr(live.replay, "attributes", lambda *a, **k: seen.append(attributes(*a, **k)) or seen[-1])
    claims = projection.store(spark, data).claims.where("permanode like 'user-%' and attr = 'tag'")
    key = lambda df: sorted((r["permanode"], r["attr"], tuple(r["vals"])) for r in df.collect())
    got = live.replay_as_stream(spark, claims.unionAll(claims))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert key(got) == key(attributes(claims))


def test_waiting_for_blobs(spark, tmp_path):
    make = lambda *refs: spark.createDataFrame([(r,) for r in refs], "ref string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("ref string").parquet(str(tmp_path / "in"))
    make("b-1")
    wanted = spark.createDataFrame([("b-9",)], "ref string")
    assert not live.wait_for_any(stream(), str(tmp_path / "c1"), wanted, 3)
    make("b-9", "b-8")
    assert live.wait_for_any(stream(), str(tmp_path / "c1"), wanted, 60)
    assert live.wait_for_any(stream(), str(tmp_path / "c2"), None, 60)


def test_touched_objects_only(spark, tmp_path):
    """A batch replays what it touches from all batches; a batch that comes again changes nothing."""
    rows = lambda *c: spark.createDataFrame([(f"c-{n}", p, "s", datetime(2020, 1, n), "add-attribute", "tag", v) for n, p, v in c], SCHEMAS["claims"])
    heard = []
    t = live.ClaimTable(spark, str(tmp_path / "t"), lambda df, n: heard.append((n, sorted((r["permanode"], tuple(r["vals"])) for r in df.collect()))))
    t.write(rows((1, "p-1", "a"), (3, "p-2", "b")), 0)
    t.write(rows((2, "p-1", "z")), 1)
    t.write(rows((2, "p-1", "z")), 1)
    assert heard == [(0, [("p-1", ("a",)), ("p-2", ("b",))]), (1, [("p-1", ("a", "z"))]), (1, [("p-1", ("a", "z"))])]
    assert t.claims().count() == 3


@pytest.mark.parametrize("seed", range(3))
def test_deletions_are_kept_up(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"x-{a}", f"x-{b}") for a, b in ((rng.randint(0, 30), rng.randint(0, 30)) for _ in range(40)) if a < b})
    known, new = edges[::2], edges[1::2]
    make = lambda rows: spark.createDataFrame(rows, SCHEMAS["deletions"])
    got = replay.update_deleted(replay.deleted(make(known)), make(known), make(new))
    assert {r["ref"] for r in got.collect()} == {r["ref"] for r in replay.deleted(make(edges)).collect()}


def test_content_is_what_the_last_set_left(spark):
    log = [("p-1", "set", "a-1"), ("p-1", "add", "a-2"), ("p-2", "set", "a-1"), ("p-2", "del", "a-9"), ("p-3", "add", "a-1"), ("p-4", "set", "a-1"), ("p-4", "set", "no reference"), ("p-5", "del", ""), ("p-5", "set", "a-5")]
    claims = spark.createDataFrame([(f"c-{i}", p, "s", datetime(2020, 1, 1 + i), f"{op}-attribute", "camliContent", v) for i, (p, op, v) in enumerate(log)], SCHEMAS["claims"])
    assert {(r["permanode"], r["value"]) for r in replay.contents(claims).collect()} == {("p-1", "a-1"), ("p-5", "a-5")}


def test_places_by_reference(spark):
    """Only objects of the type refer to a place, and what they refer to may have it from a photo, but not from a third object."""
    first = lambda *rows: spark.createDataFrame(list(rows), "permanode string, attr string, value string")
    visit = lambda p, to, kind="foursquare.com:checkin": [(p, "camliNodeType", kind), (p, "foursquareVenuePermanode", to)]
    rows = first(("a-1", "latitude", "1"), ("a-1", "longitude", "2"), ("a-2", "camliContent", "f-2"), *visit("b-1", "a-1"), *visit("b-2", "a-2"), *visit("b-3", "b-1"), *visit("b-4", "a-1", "other"), *visit("b-5", "gone-1"), ("b-5", "camliContent", "f-2"), ("a-3", "latitude", "x"), ("a-3", "longitude", "2"), ("a-3", "camliContent", "f-2"), *visit("b-6", "a-3"))
    files = spark.createDataFrame([("f-2", "w-2")], "file_ref string, whole_ref string")
    gps = spark.createDataFrame([("w-2", 5.0, 6.0)], "whole_ref string, lat double, long double")
    got = {r["ref"]: (r["lat"], r["long"]) for r in geo.object_places(rows, files, gps).collect()}
    assert got == {"a-1": (1.0, 2.0), "a-2": (5.0, 6.0), "b-1": (1.0, 2.0), "b-2": (5.0, 6.0), "b-5": (5.0, 6.0)}


def test_standing_queries(spark):
    make = lambda values: Store.of(spark, blob_meta=spark.createDataFrame([("a-1", 1, "permanode")], SCHEMAS["blob_meta"]), signers=spark.createDataFrame([("s", "ka")], SCHEMAS["signers"]), claims=spark.createDataFrame([(f"c-{i}", "a-1", "s", datetime(2020, 1, 1 + i), "set-attribute", "tag", v) for i, v in enumerate(values)], SCHEMAS["claims"]))
    heard = []
    live_queries = live.StandingQueries()
    live_queries.subscribe("t", {"expression": "tag:x"})
    push = lambda tag, rows: heard.append((tag, rows.count()))
    assert live_queries.refresh(make(["x"]), None, push) == ["t"]
    schema_blob, other = spark.createDataFrame([("c-9", 1, "claim")], SCHEMAS["blob_meta"]), spark.createDataFrame([("b-9", 1, "")], SCHEMAS["blob_meta"])
    assert live_queries.refresh(make(["x"]), schema_blob, push) == []
    assert live_queries.refresh(make(["x", "y"]), other, push) == []
    assert live_queries.refresh(make(["x", "y"]), schema_blob, push) == ["t"]
    assert heard == [("t", 1), ("t", 0)]


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["ref", "time"]
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def _rows(frame):
    columns = sorted(frame.columns)
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(plain(v) for v in row) for row in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)), key=repr)


SAMPLE = ["attr_describe_dedup_agg_06", "permanode_any_time_time_02_time_03", "tag_newest", "logical_xor_pred_17", "dir_recursive_pred_51_join_07", "relation_all_join_03c", "page_around_sort_09_win_05", "map_spread_sort_10_sort_11_win_06", "gc_garbage_set_12", "set_validation_set_10", "expr_negation_groups_expr_06_expr_07", "describe_depth2_desc_02", "content_claim_win_07", "place_by_reference_join_17", "archives_sto_23_win_08", "stored_searches_ep_11_ext_02"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    assert _rows(queries.QUERIES[name](spark, data).toPandas()) == _rows(con.execute(queries.SQL[name]).df())
