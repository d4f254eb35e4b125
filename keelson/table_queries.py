"""More queries of the registry: ingestion from documents, stores, streams, shares, and refusals.

Documents are made from the driver's tables as JSON, and what ingestion makes of
them is compared with SQL over the same tables.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import scalar as S
from keelson.model import SCHEMAS, Store
from keelson.operators import describe, geo, lookup, replay, sets
from keelson.plans import constraints as K
from keelson.plans.compile import Derived
from keelson.plans.expressions import _range, default_keywords, parse
from keelson.plans.search import Search, page_size
from keelson.queries import _claim_documents, _held, dead_of, found, on_store, query, with_
from keelson.runtime import QueryError, shared_dir, table
from keelson.sources import ingest, projection, stores
from keelson.streaming import live


def ref(kind: str, key: str, width: int = 8) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.lpad(F.col(key).cast("string"), width, "0"))


def documents(rows: DataFrame, name: Column, **fields: Column) -> DataFrame:
    """(ref, data) of schema documents with the given fields."""
    return rows.select(name.alias("ref"), F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))).cast("binary").alias("data"))


# delete claims, directories, static sets


def _deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims, deletes of claims, and deletes of files, which do not count."""
    events = table(spark, sf_dir, "events")
    docs = table(spark, sf_dir, "documents")
    kind = {"camliType": F.lit("claim"), "claimType": F.lit("delete")}
    good = documents(events.where("event_id > 100 and event_id % 11 = 0"), ref("deletes", "event_id", 10), **kind, target=F.concat(F.lit("claim-"), F.lpad((F.col("event_id") - 7).cast("string"), 10, "0")))
    bad = documents(docs.where("doc_id % 3 = 0"), ref("deletef", "doc_id", 10), **kind, target=ref("doc", "doc_id"))
    files = documents(docs, ref("doc", "doc_id"), camliType=F.lit("file"), fileName=F.col("source"))
    return ingest.sniff(_claim_documents(spark, sf_dir).unionAll(good).unionAll(bad).unionAll(files))


query(
    "ingest_deletions_src_03",
    "SELECT 'claim-' || lpad(CAST(event_id - 7 AS VARCHAR), 10, '0') AS target, 'deletes-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS deleter FROM events WHERE event_id > 100 AND event_id % 11 = 0 AND event_id - 7 IN (SELECT event_id FROM events)",
)(lambda spark, sf_dir: ingest.deletions(_deletes(spark, sf_dir)))


def _directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of regions; their sets name even nations and take the odd ones from another set."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    members = lambda odd: nations.where(F.col("n_nationkey") % 2 == odd).groupBy("n_regionkey").agg(F.sort_array(F.collect_list(ref("nation", "n_nationkey"))).alias("m"))
    dirs = documents(regions, ref("region", "r_regionkey"), camliType=F.lit("directory"), fileName=F.col("r_name"), entries=ref("seta", "r_regionkey"))
    outer = documents(regions.join(members(0), F.col("r_regionkey") == F.col("n_regionkey"), "left"), ref("seta", "r_regionkey"), camliType=F.lit("static-set"), members=F.col("m"), mergeSets=F.array(ref("setb", "r_regionkey")))
    inner = documents(regions.join(members(1), F.col("r_regionkey") == F.col("n_regionkey"), "left"), ref("setb", "r_regionkey"), camliType=F.lit("static-set"), members=F.col("m"))
    return ingest.sniff(dirs.unionAll(outer).unionAll(inner))


query("ingest_directories_src_05_agg_10", "SELECT 'region-' || lpad(CAST(r_regionkey AS VARCHAR), 8, '0') AS file_ref, r_name AS file_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS size FROM region")(lambda spark, sf_dir: ingest.directories(_directories(spark, sf_dir))[0])
query("ingest_children_src_09", "SELECT 'region-' || lpad(CAST(n_regionkey AS VARCHAR), 8, '0') AS dir_ref, 'nation-' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0') AS child_ref FROM nation")(lambda spark, sf_dir: ingest.directories(_directories(spark, sf_dir))[1])

# files of parts: the first half of a text, some zeros, and the rest by way of a bytes document


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"), F.octet_length("text").cast("bigint").alias("n"))
    half = F.floor(F.col("n") / 2)
    blobs = docs.select(ref("b10b", "doc_id").alias("ref"), "data")
    none = F.lit(None).cast("string")
    part = lambda size, blob, inner, offset: F.struct(size.alias("size"), blob.alias("blobRef"), inner.alias("bytesRef"), offset.alias("offset"))
    whole = documents(docs, ref("doc", "doc_id"), camliType=F.lit("file"), fileName=F.lit("f"), parts=F.array(part(half, ref("b10b", "doc_id"), none, F.lit(0).cast("bigint")), part(F.col("doc_id") % 5, none, none, F.lit(0).cast("bigint")), part(F.col("n") - half, none, ref("c0de", "doc_id"), F.lit(0).cast("bigint"))))
    rest = documents(docs, ref("c0de", "doc_id"), camliType=F.lit("bytes"), parts=F.array(part(F.col("n") - half, ref("b10b", "doc_id"), none, half)))
    return ingest.sniff(whole.unionAll(rest)), blobs


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    sniffed, blobs = _files(spark, sf_dir)
    return ingest.file_pieces(ingest.file_chunks(sniffed), blobs)


_HALVES = "WITH d AS (SELECT doc_id, 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS file_ref, hex(encode(text)) AS h, CAST(strlen(text) AS BIGINT) AS n, CAST(strlen(text) // 2 AS BIGINT) AS f FROM documents) "
query("file_pieces_src_08", _HALVES + 'SELECT file_ref, CAST(0 AS BIGINT) AS "start", f AS size, sha256(unhex(substr(h, 1, CAST(2 * f AS INT)))) AS digest FROM d UNION ALL SELECT file_ref, f, doc_id % 5, NULL FROM d UNION ALL SELECT file_ref, f + doc_id % 5, n - f, sha256(unhex(substr(h, CAST(2 * f + 1 AS INT)))) FROM d')(lambda spark, sf_dir: _pieces(spark, sf_dir).select("file_ref", "start", "size", F.sha2("data", 256).alias("digest")))
query("file_whole_agg_16", _HALVES + "SELECT file_ref, n + doc_id % 5 AS size, 'sha256-' || sha256(unhex(substr(h, 1, CAST(2 * f AS INT)) || repeat('00', CAST(doc_id % 5 AS INT)) || substr(h, CAST(2 * f + 1 AS INT)))) AS whole_ref FROM d")(lambda spark, sf_dir: ingest.whole_refs(_pieces(spark, sf_dir), "sha256"))
query("file_sizes_agg_14", _HALVES + "SELECT file_ref AS ref, n + doc_id % 5 AS size FROM d UNION ALL SELECT 'c0de-' || substr(file_ref, 5), n - f FROM d")(lambda spark, sf_dir: ingest.file_sizes(_files(spark, sf_dir)[0]))
query("parked_str_05", "SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS ref FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0")(
    lambda spark, sf_dir: live.Parking(table(spark, sf_dir, "documents").select(ref("doc", "doc_id").alias("ref"), F.explode(F.array(ref("b10b", "doc_id"), ref("c0de", "doc_id"))).alias("needed"))).arrived(
        table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(ref("b10b", "doc_id").alias("ref")).unionAll(table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(ref("c0de", "doc_id").alias("ref")))
    )[1]
)



def _audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio files of parts: frames at the beginning, and every second one with fields at the end."""
    bytes_of = lambda c: F.encode(c, "UTF-8")
    number = lambda c: F.unhex(F.lpad(F.hex(c.cast("bigint")), 8, "0"))

    def frame(name: str, text: Column) -> Column:
        return F.concat(F.lit(name.encode()), number(F.octet_length(text) + 1), F.lit(b"\0\0\3"), bytes_of(text))

    p = table(spark, sf_dir, "part")
    frames = F.concat(frame("TIT2", F.col("p_name")), frame("TPE1", F.concat(F.lit("é"), "p_brand")), frame("TCON", F.col("p_type")), frame("TRCK", F.concat_ws("/", "p_size", F.lit("60"))), frame("TPOS", (F.col("p_partkey") % 3).cast("string")), frame("TXXX", F.concat(F.lit("MusicBrainz Album Id\0"), F.col("p_partkey").cast("string"))))
    size = F.octet_length(frames)
    head = F.concat(F.lit(b"ID3\3\0\0\0\0"), F.unhex(F.lpad(F.hex(F.floor(size / 128) * 256 + size % 128), 4, "0")))
    tail = F.concat(F.lit(b"TAG"), F.unhex(F.rpad(F.hex(bytes_of(F.lit("other title"))), 60, "0")), F.unhex(F.lit("00" * 30)), F.unhex(F.rpad(F.hex(bytes_of(F.concat(F.lit("album"), F.col("p_partkey").cast("string")))), 60, "0")), F.lit(b"1999"), F.unhex(F.lit("00" * 31)))
    audio = bytes_of(F.concat(F.lit("sound"), F.col("p_partkey").cast("string")))
    data = F.concat(head, frames, audio, F.when(F.col("p_partkey") % 2 == 0, tail).otherwise(F.lit(b"")))
    return ingest.audio_tags(p.select(ref("item", "p_partkey").alias("ref"), data.alias("data")), "sha256")


query(
    "audio_tags_src_07",
    "WITH p AS (SELECT *, 'item-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS ref FROM part), a AS ("
    + " UNION ALL ".join(
        f"SELECT ref, '{tag}' AS tag, {value} AS value FROM p WHERE {where}"
        for tag, value, where in (
            ("title", "p_name", "true"), ("artist", "'é' || p_brand", "true"), ("genre", "p_type", "true"), ("track", "CAST(p_size AS VARCHAR)", "true"), ("disc", "CAST(p_partkey % 3 AS VARCHAR)", "p_partkey % 3 <> 0"), ("musicbrainzalbumid", "CAST(p_partkey AS VARCHAR)", "p_partkey <> 0"),
            ("album", "'album' || p_partkey", "p_partkey % 2 = 0"), ("year", "'1999'", "p_partkey % 2 = 0"), ("mediaref", "'sha256-' || sha256('sound' || p_partkey)", "true"),
        )
    )
    + ") SELECT * FROM a",
)(_audio)

# claims: first-seen order, deletions kept up, places by reference, stored searches, descriptions of results

on_store("first_seen_win_04", lambda s: replay.first_seen(s.claims.where("attr = 'tag'"), "value").select("value", "claim_ref"), with_("claims") + "SELECT value, first(claim_ref ORDER BY date, claim_ref) AS claim_ref FROM claims WHERE attr = 'tag' GROUP BY 1")


def _kept_up(s) -> DataFrame:
    known, new = s.deletions.where("hash(deleter) % 3 <> 0"), s.deletions.where("hash(deleter) % 3 = 0")
    return replay.update_deleted(replay.deleted(known), known, new)


on_store("deletions_kept_up_str_11", _kept_up, with_("dead") + "SELECT ref FROM dead")
on_store("place_by_reference_join_17", lambda s: Derived(s).places.where("ref like 'order-%'"), with_("places") + "SELECT ref, lat, long FROM places WHERE ref LIKE 'order-%'")
found("location_as_of_join_17_time_01", {"permanode": {"at": "2019-01-01T00:00:00Z", "location": {"any": True}}}, with_("places") + "SELECT ref FROM places WHERE false", sort="unsorted")
_TEXTS = "SELECT 'image-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS ref, 'tag:' || p_brand AS text FROM part"
_NAMED = with_("own", "ownlive", "times", "dead") + f", n AS ({_held('own')}), o AS ({_held('ownlive')}), k AS (SELECT DISTINCT n.permanode, n.value AS name FROM n WHERE attr = 'camliNamedSearch' AND permanode NOT IN (SELECT ref FROM dead)), l AS (SELECT name, first(k.permanode ORDER BY any_time DESC, k.permanode DESC) AS permanode FROM k JOIN times t ON t.ref = k.permanode WHERE any_time IS NOT NULL GROUP BY 1), c AS (SELECT permanode, first(value ORDER BY date, claim_ref) AS ref FROM o WHERE attr = 'camliContent' AND value <> '' GROUP BY 1), b AS ({_TEXTS}) SELECT l.name, l.permanode, b.text FROM l LEFT JOIN c ON c.permanode = l.permanode LEFT JOIN b ON b.ref = c.ref"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = projection.store(spark, sf_dir)
    blobs = table(spark, sf_dir, "part").select(ref("image", "p_partkey").alias("ref"), F.concat(F.lit("tag:"), "p_brand").cast("binary").alias("data"))
    return lookup.stored_searches(s, Derived(s).times, dead_of(s), blobs)


query("stored_searches_ep_11_ext_02", _NAMED)(_stored)
on_store(
    "describe_results_desc_08",
    lambda s: describe.with_results(s, Search(s).query({"constraint": {"permanode": {"attr": "camliNodeType", "value": "BUILDING"}}, "sort": "unsorted", "limit": -1}), dead_of(s), 2).select("ref", "result", describe.title(F.col("attrs"), F.lit("")).alias("title")),
    with_("held", "ownlive", "blob_meta") + f", o AS ({_held('ownlive')}), r AS (SELECT DISTINCT permanode AS ref FROM held WHERE attr = 'camliNodeType' AND value = 'BUILDING'), a AS (SELECT ref, true AS result FROM r UNION ALL SELECT DISTINCT value, false FROM o WHERE attr = 'camliMember' AND permanode IN (SELECT ref FROM r)), t AS (SELECT permanode, first(value ORDER BY date, claim_ref) AS title FROM o WHERE attr = 'title' AND value <> '' GROUP BY 1) SELECT a.ref, a.result, coalesce(t.title, '') AS title FROM a LEFT JOIN t ON t.permanode = a.ref",
)
found("edge_type_join_03a", {"permanode": {"relation": {"relation": "child", "edgeType": "camliMember", "any": {"blobRefPrefix": "order-0000003"}}}}, with_("heldall") + "SELECT DISTINCT permanode AS ref FROM heldall WHERE attr = 'camliMember' AND value LIKE 'order-0000003%'", sort="unsorted")
found("types_of_either_set_08", {"camliType": "permanode", "logical": {"op": "or", "a": {"permanode": {"attr": "camliNodeType", "value": "BUILDING"}}, "b": {"permanode": {"attr": "camliNodeType", "value": "twitter.com:like"}}}}, with_("held") + "SELECT DISTINCT permanode AS ref FROM held WHERE attr = 'camliNodeType' AND value IN ('BUILDING', 'twitter.com:like')", sort="blobref")
found("around_without_order_sort_09b", {"anyCamliType": True}, with_("blob_meta") + ", r AS (SELECT ref, row_number() OVER (ORDER BY ref) AS n FROM blob_meta WHERE camli_type <> '') SELECT ref FROM r, (SELECT n AS p FROM r WHERE ref = 'image-00000050') WHERE n BETWEEN p - 4 AND p + 4", sort="unsorted", around="image-00000050", limit=9)


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 20.0).alias("north"), F.lit(-90.0).alias("west"), (F.col("n_nationkey") - 20.0).alias("south"), F.lit(90.0).alias("east"))
    words = default_keywords(geo.gazetteer(boxes))
    return Search(projection.store(spark, sf_dir), words).query({"expression": "loc:nation_7", "limit": -1}).select("ref")


query("gazetteer_geo_05", with_("objects", "times", "dead", "places") + ", x AS (SELECT CAST(n_nationkey AS DOUBLE) AS k FROM nation WHERE lower(n_name) = 'nation_7') SELECT o.ref FROM objects o JOIN times t ON t.ref = o.ref JOIN places p ON p.ref = o.ref, x WHERE t.any_time IS NOT NULL AND o.ref NOT IN (SELECT ref FROM dead) AND p.lat BETWEEN k - 20 AND k + 20 AND p.long BETWEEN -90 AND 90")(_located)

# stores


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One blob a document, named by the digest of its id and text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text").cast("binary").alias("data"))
    return rows.select(S.ref_of(F.col("data"), "sha256").alias("ref"), F.octet_length("data").cast("bigint").alias("size"), "data", "doc_id")


_BLOBS = "WITH b AS (SELECT doc_id, 'sha256-' || sha256(doc_id || ':' || text) AS ref, CAST(strlen(doc_id || ':' || text) AS BIGINT) AS size, sha256(doc_id || ':' || text) AS digest FROM documents) "


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs through a packed store, compaction and encryption, and back."""
    folder = f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    key = b"0123456789abcdef"
    rows = _texts(spark, sf_dir)
    stores.write_packed(rows, f"{folder}/store")
    back = stores.read(spark, "packed", path=f"{folder}/store")
    stores.compact(back, rows.select(F.col("ref").alias("blob_ref"), (F.col("doc_id") % 7).cast("string").alias("whole_ref"), F.col("doc_id").alias("pos")), f"{folder}/compact")
    again = spark.read.parquet(f"{folder}/compact/data").select("ref", "data").join(spark.read.parquet(f"{folder}/compact/manifest").select("ref", "size", "whole_ref"), "ref")
    open_ = stores.decrypted(stores.encrypted(again.select("ref", "data"), key), key)
    return again.select("ref", "size", "whole_ref").join(open_, "ref").select("ref", "size", "whole_ref", F.sha2("data", 256).alias("digest"))


query("packed_sto_03_sto_04_sto_05", _BLOBS + "SELECT ref, size, CAST(doc_id % 7 AS VARCHAR) AS whole_ref, digest FROM b")(_packed)
query("removed_ep_14", _BLOBS + "SELECT ref, size FROM b WHERE doc_id % 3 <> 0")(lambda spark, sf_dir: stores.removed(_texts(spark, sf_dir), _texts(spark, sf_dir).where("doc_id % 3 = 0")).select("ref", "size"))
query("received_sto_01_scan_15", _BLOBS + "SELECT ref, size FROM b WHERE doc_id % 4 <> 0")(lambda spark, sf_dir: stores.received(_texts(spark, sf_dir).select("ref", F.when(F.col("doc_id") % 4 == 0, F.reverse(F.col("data").cast("string")).cast("binary")).otherwise(F.col("data")).alias("data"))).select("ref", "size"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir)
    target = rows.where("doc_id % 7 <> 0").select("ref", F.when(F.col("doc_id") % 10 == 0, F.lit(b"spoiled")).otherwise(F.col("data")).alias("data"))
    return sets.verify_sample(rows, target, 1.0)


query("verified_sample_set_11", _BLOBS + "SELECT ref, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'digest' END AS problem FROM b WHERE doc_id % 7 = 0 OR doc_id % 10 = 0")(_compared)


def _copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}"
    _texts(spark, sf_dir).select("ref", "size").write.parquet(f"{folder}/in")
    live.copy_queue(spark.readStream.schema("ref string, size bigint").parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("ref string, size bigint").parquet(f"{folder}/out")


query("copy_queue_str_09", _BLOBS + "SELECT ref, size FROM b")(_copied)


def _heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What standing queries push: at first, after a batch without change, after a change, after leaving."""
    s = projection.store(spark, sf_dir)
    later = Store(**{f: getattr(s, f) for f in SCHEMAS} | {"claims": s.claims.where("value <> 't1'")}, owner_key=s.owner_key)
    blob = s.blob_meta.limit(1).withColumn("camli_type", F.lit("claim"))
    heard: list[tuple[int, str, int]] = []
    standing = live.StandingQueries()
    standing.subscribe("t1", {"constraint": {"permanode": {"attr": "tag", "value": "t1"}}, "sort": "blobref", "limit": -1})
    standing.subscribe("t2", {"constraint": {"permanode": {"attr": "tag", "value": "t2"}}, "sort": "blobref", "limit": -1})
    for step, (now, batch) in enumerate(((s, None), (s, blob), (later, blob.withColumn("camli_type", F.lit(""))), (later, blob))):
        standing.refresh(now, batch, lambda tag, rows, step=step: heard.append((step, tag, rows.count())))
    standing.subscribe("t2", None)
    standing.refresh(s, blob, lambda tag, rows: heard.append((4, tag, rows.count())))
    return spark.createDataFrame(heard, "step int, tag string, n bigint")


_N = "(SELECT count(DISTINCT permanode) FROM {0} WHERE attr = 'tag' AND value = '{1}')"
_NEVER = f", never AS ({_held('(SELECT * FROM own WHERE value <> {0})'.format(chr(39) + 't1' + chr(39)))})"
query("standing_str_06_str_07", with_("held", "own") + _NEVER + f" SELECT 0 AS step, 't1' AS tag, {_N.format('held', 't1')} AS n UNION ALL SELECT 0, 't2', {_N.format('held', 't2')} UNION ALL SELECT 3, 't1', 0 UNION ALL SELECT 3, 't2', {_N.format('never', 't2')} WHERE {_N.format('never', 't2')} <> {_N.format('held', 't2')} UNION ALL SELECT 4, 't1', {_N.format('held', 't1')}")(_heard)

# shares and domains: an order is shared, its customer lies behind it


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    now = datetime(2024, 1, 1, tzinfo=UTC)
    shares = o.select(ref("5a", "o_orderkey").alias("ref"), ref("order", "o_orderkey").alias("target"), (F.col("o_orderkey") % 2 == 0).alias("transitive"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(datetime(2020, 1, 1, tzinfo=UTC))).alias("expires"), (F.col("o_orderkey") % 7 == 0).alias("deleted"))
    links = o.where("o_orderkey % 3 <> 0").select(ref("order", "o_orderkey").alias("ref"), ref("place", "o_custkey").alias("next"))
    chains = o.select(F.col("o_orderkey").alias("chain_id"), F.when(F.col("o_orderkey") % 4 == 0, F.array(ref("5a", "o_orderkey"))).when(F.col("o_orderkey") % 4 == 1, F.array(ref("5a", "o_orderkey"), ref("order", "o_orderkey"))).otherwise(F.array(ref("5a", "o_orderkey"), ref("order", "o_orderkey"), ref("place", "o_custkey"))).alias("chain"))
    return sets.shares_allow(shares, links, chains, now)


query("share_chains_set_13", "SELECT o_orderkey AS chain_id, o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND (o_orderkey % 4 = 1 OR (o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0)) AS allowed FROM orders")(_shares)
on_store("outside_domain_join_16", lambda s: sets.outside_domain(s.blob_meta.where("size = 270"), s.claims.where("attr = 'customer' and value like 'place-0000000%'").select(F.col("permanode").alias("ref"))), with_("blob_meta", "claims") + "SELECT ref FROM blob_meta WHERE size = 270 AND ref NOT IN (SELECT permanode FROM claims WHERE attr = 'customer' AND value LIKE 'place-0000000%')")

# functions

query("fold_fn_01", "SELECT c_custkey, contains(lower(c_name), 'mer#0') AS has, starts_with(lower(c_mktsegment), 'bui') AS begins, ends_with(lower(c_mktsegment), 'nery') AS ends, lower(c_mktsegment) = 'household' AS same FROM customer")(
    lambda spark, sf_dir: table(spark, sf_dir, "customer").select("c_custkey", S.string_test(F.col("c_name"), {"contains": "MER#0", "caseInsensitive": True}).alias("has"), S.string_test(F.col("c_mktsegment"), {"hasPrefix": "Bui", "caseInsensitive": True}).alias("begins"), S.string_test(F.col("c_mktsegment"), {"hasSuffix": "NeRy", "caseInsensitive": True}).alias("ends"), S.string_test(F.col("c_mktsegment"), {"equals": "Household", "caseInsensitive": True}).alias("same"))
)
_REFS = "CASE doc_id % 6 WHEN 0 THEN 'sha1-' || sha1(text) WHEN 1 THEN 'sha256-' || sha256(text) WHEN 2 THEN 'sha1-' || sha256(text) WHEN 3 THEN 'own-' || doc_id WHEN 4 THEN 'Sha1-' || sha1(text) ELSE 'sha1' || sha1(text) END"
query("ref_parse_fn_07", "SELECT doc_id, doc_id % 6 IN (0, 1, 3) AS valid FROM documents")(lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", S.is_ref(F.expr(_REFS.replace("sha256(text)", "sha2(text, 256)"))).alias("valid")))
query("url_decode_fn_12", "SELECT o_orderkey AS k, o_orderpriority AS suffix FROM orders")(
    lambda spark, sf_dir: ingest.paths(table(spark, sf_dir, "orders").select(F.lit("s").alias("signer"), ref("place", "o_custkey").alias("permanode"), F.concat(F.lit("camliPath:"), F.expr("url_encode(o_orderpriority)")).alias("attr"), F.col("o_orderdate").alias("date"), F.col("o_orderkey").cast("string").alias("claim_ref"), F.lit("add-attribute").alias("ctype"), F.lit("x-1").alias("value"))).select(F.col("claim_ref").cast("bigint").alias("k"), "suffix")
)

# what is refused, and what is chosen without data: a row a case


def cases(name: str, make, rows: list[tuple[str, object]], expected: list[str]) -> None:
    """A query of a row for each case, with its outcome or the refusal's text."""

    def outcome(value) -> str:
        try:
            return str(make(value))
        except QueryError as e:
            return str(e)

    texts = ", ".join("('" + k + "', '" + e.replace("'", "''") + "')" for (k, _), e in zip(rows, expected, strict=True))
    query(name, f"SELECT * FROM (VALUES {texts}) AS t(case_name, outcome)")(lambda spark, sf_dir: spark.createDataFrame([(k, outcome(v)) for k, v in rows], "case_name string, outcome string"))


cases("page_size_sort_12", page_size, [("none", 0), ("negative", -3), ("some", 17), ("most", 1000), ("more", 1001)], ["50", "50", "17", "1000", "50"])
cases("range_parse_fn_06", lambda t: sorted(_range(t).items()), [("both", "3-8"), ("low", "3-"), ("high", "-8"), ("one", "8"), ("zero", "0-0"), ("words", "many")], ["[('max', 8), ('min', 3)]", "[('min', 3)]", "[('max', 8)]", "[('max', 8), ('min', 8)]", "[('zeroMax', True), ('zeroMin', True)]", 'Unable to parse "many" as range, wanted something like 480-1024, 480-, -1024 or 1024'])
cases(
    "source_choice_scan_09",
    lambda c: K.source_name(c[0], c[1]),
    [("newest", ({"permanode": {"skipHidden": True}}, "-created")), ("changed", ({"permanode": {"skipHidden": True}}, "-mod")), ("types", ({"camliType": "permanode", "permanode": {"attr": "camliNodeType", "value": "x"}}, "blobref")), ("content", ({"file": {"wholeRef": "sha1-" + "3" * 40}}, "")), ("files", ({"file": {"fileName": {"equals": "x"}}}, "")), ("kind", ({"camliType": "directory"}, "")), ("all", ({"anything": True}, ""))],
    ["corpus_permanode_created", "corpus_permanode_lastmod", "corpus_permanode_types", "corpus_file_meta", "index_blob_meta", "corpus_blob_meta", "index_blob_meta"],
)
cases(
    "expression_refusals_expr_01_expr_02_expr_03_expr_08_expr_09",
    lambda t: parse(t, default_keywords()),
    [("word", "sunset"), ("or", "tag:kept  or"), ("quoted", 'tag:kept "red sky"'), ("open", "-(tag:kept or (ref:doc-7)"), ("close", "ref:doc-7) tag:kept"), ("minus", "tag:kept and -"), ("quote", 'title:"never closed'), ("colon", "tag:kept :"), ("arity", "locrect:1,2,3,4:5"), ("unknown", "colour:red"), ("glob", "filename:x*y*z"), ("time", "before:yesterday"), ("place", "loc:atlantis")],
    [
        'No support for literals yet at position 0, token: "sunset"', 'No support for literals yet at position 10, token: "or"', 'No support for quoted literals yet at position 9, token: "\\"red sky\\""', 'No matching closing parenthesis at position 1, token: "("', 'No matching opening parenthesis at position 9, token: ")"', 'Expected an atom at position 14, token: ""',
        'Unclosed quote at position 6, token: "Unclosed quote"', 'Predicates do not start with a colon at position 9, token: ":"', 'Wrong number of arguments for "locrect", given 2, expected 1 at position 0, token: "locrect:1,2,3,4:5"', 'Unknown search predicate: "colour:red" at position 0, token: "colour:red"', 'unsupported glob wildcard in filename search predicate at position 0, token: "filename:x*y*z"',
        'parsing time "yesterday1T00:00:00Z" as "2006-01-02T15:04:05Z07:00" at position 0, token: "before:yesterday"', 'No location found for "atlantis" at position 0, token: "loc:atlantis"',
    ],
)


def _checked(constraint: dict) -> str:
    K.check(K.decode(constraint))
    return "valid"


_ANY = {"anything": True}
cases(
    "constraint_refusals_pred_08_pred_13_pred_14_pred_19_pred_36_pred_52_pred_54_join_03d",
    _checked,
    [
        ("claim", {"claim": {}}), ("exif", {"file": {"exif": {}}}), ("two", {"logical": {"op": "or", "a": _ANY}}), ("operation", {"logical": {"op": "nor", "a": _ANY}}), ("one", {"logical": {"op": "not"}}), ("attribute", {"permanode": {"attr": "colour"}}), ("everything", {"permanode": {"attr": "colour", "numValue": {"zeroMin": True}}}), ("nothing", {"permanode": {"attr": "colour", "value": "blue", "numValue": {"zeroMax": True}}}),
        ("progeny", {"permanode": {"relation": {"relation": "progeny", "any": _ANY}}}), ("quantifier", {"permanode": {"relation": {"relation": "parent"}}}), ("order", {"blobSize": {"min": 30, "max": 20}}), ("zero", {"blobSize": {"zeroMin": True, "min": 20}}), ("contains", {"dir": {"contains": {"camliType": "file"}}}), ("depth", {"dir": {"contains": {"blobRefPrefix": "z-1"}, "recursiveContains": {"blobRefPrefix": "z-2"}}}), ("field", {"colour": 1}), ("type", {"blobRefPrefix": 1}), ("right", {"blobSize": {"min": 20, "max": 30}}),
    ],
    [
        "a ClaimConstraint is not supported", "valid", "In LogicalConstraint, need both A and B set", 'In LogicalConstraint, unknown operation "nor"', "In LogicalConstraint, need to set A", "PermanodeConstraint with Attr requires also setting NumValue or a value-matching constraint", "NumValue with ZeroMin makes no sense; matches everything", "NumValue with ZeroMax makes no sense in conjunction with a value-matching constraint; matches nothing",
        'only RelationConstraint.Relation of "parent" or "child" is currently supported', "exactly one of RelationConstraint Any or All must be defined", "in IntConstraint, min is greater than max", "in IntConstraint, can't set both ZeroMin and Min", "(Recursive)Contains supports only a reference prefix, file, dir or logical constraint", "Contains and RecursiveContains in a DirConstraint are mutually exclusive", 'json: unknown field "colour"', "cannot use 1 as str", "valid",
    ],
)


@query("plan_refusals_sort_02_sort_06_pred_53", "SELECT * FROM (VALUES ('mod', 'unsupported sort+query combination'), ('created', 'can only sort by ctime when all results are permanodes'), ('both', 'Constraint and Expression are mutually exclusive in a search query'), ('around', 'Continue and Around parameters are mutually exclusive'), ('default', '-created'), ('files', ''), ('limit', '200')) AS t(case_name, outcome)")
def plan_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    search = Search(projection.store(spark, sf_dir))
    objects = {"permanode": {"skipHidden": True}}

    def outcome(q: dict, field: str = "sort") -> str:
        try:
            return str(getattr(search.plan(q), field))
        except QueryError as e:
            return str(e)

    rows = [("mod", {"constraint": objects, "sort": "mod"}), ("created", {"constraint": {"camliType": "file"}, "sort": "created"}), ("both", {"constraint": objects, "expression": "tag:x"}), ("around", {"constraint": objects, "around": "x-1", "continue": "pn:1:x-1"}), ("default", {"constraint": objects}), ("files", {"constraint": {"camliType": "file"}})]
    return spark.createDataFrame([*((k, outcome(q)) for k, q in rows), ("limit", outcome({"constraint": objects}, "limit"))], "case_name string, outcome string")
