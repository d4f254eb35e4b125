"""Descriptions find claims once, and only those that their results can depend on."""

from datetime import UTC, datetime, timedelta

from keelson.model import SCHEMAS, Store
from keelson.operators import describe, replay

_T0 = datetime(2020, 1, 1, tzinfo=UTC)


def _store(spark, tmp_path, claims):
    rows = [(f"claim-{n:02x}", obj, "signer-0", _T0 + timedelta(seconds=n // 2), ctype, attr, value) for n, (obj, ctype, attr, value) in enumerate(claims)]
    spark.createDataFrame(rows, "claim_ref string, permanode string, signer string, date timestamp, ctype string, attr string, value string").write.parquet(f"{tmp_path}/claims")
    refs = sorted({obj for obj, *_ in claims} | {value for *_, value in claims if value.startswith("obj-")})
    return Store.of(
        spark,
        claims=spark.read.parquet(f"{tmp_path}/claims"),
        blob_meta=spark.createDataFrame([(r, 10, "permanode") for r in refs], SCHEMAS["blob_meta"]),
        signers=spark.createDataFrame([("signer-0", "ka")], SCHEMAS["signers"]),
    )


_LINKS = [("obj-0a", "add-attribute", "camliMember", "obj-0b"), ("obj-0b", "add-attribute", "custom", "obj-0c"), ("obj-0c", "add-attribute", "custom", "obj-0d"), ("obj-0b", "add-attribute", "note", "obj-0e"), ("obj-0d", "add-attribute", "custom", "obj-0a")]


def _dead(spark):
    return spark.createDataFrame([], "ref string")


def test_claims_are_found_once_and_replayed_as_before(spark, tmp_path, monkeypatch):
    import random

    rng = random.Random(5)
    kinds = ["set-attribute", "add-attribute", "add-attribute", "add-attribute", "del-attribute"]
    store = _store(spark, tmp_path, [(rng.choice(["obj-0a", "obj-0b"]), rng.choice(kinds), rng.choice("xy"), rng.choice(["", "1", "2", "3"])) for _ in range(400)])
    refs = store.blob_meta.where("ref = 'obj-0b'").select("ref")
    for limit in (replay.BROADCAST_REFS, 0):  # broadcast, and hashed in shuffled tasks
        monkeypatch.setattr(replay, "BROADCAST_REFS", limit)
        got = describe.described_values(store, _dead(spark), refs=refs)
        assert got._jdf.queryExecution().optimizedPlan().toString().count(" parquet") == 1
        want = replay.held_values(store.claims.where("permanode = 'obj-0b'"), dedupe=True)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_reach_replays_only_what_has_depth_left(spark, tmp_path, monkeypatch):
    store, asked = _store(spark, tmp_path, _LINKS), []
    mentions = describe.mentions
    monkeypatch.setattr(describe, "mentions", lambda s, dead, at=None, refs=None: asked.append({r["ref"] for r in refs.collect()}) or mentions(s, dead, at, refs))
    got = describe.reach(store, store.blob_meta.where("ref = 'obj-0a'"), 2, _dead(spark))
    assert {tuple(r) for r in got.collect()} == {("obj-0a", 2), ("obj-0b", 1)}
    assert asked == [{"obj-0a"}]


def test_rules_replay_only_where_a_rule_may_follow(spark, tmp_path, monkeypatch):
    store, read = _store(spark, tmp_path, _LINKS), set()
    values = describe.described_values

    def watched(*args, **named):
        out = values(*args, **named)
        read.update((r["permanode"], r["attr"]) for r in out.collect())
        return out

    monkeypatch.setattr(describe, "described_values", watched)
    rules = (describe.Rule(("camliMember",), if_result_root=True, rules=(describe.Rule(("cust*",)),)),)
    got = describe.by_rules(store, store.blob_meta.where("ref = 'obj-0a'"), rules, _dead(spark))
    assert sorted(r["ref"] for r in got.collect()) == ["obj-0a", "obj-0b", "obj-0c"]
    assert read == {("obj-0a", "camliMember"), ("obj-0b", "custom"), ("obj-0c", "custom")}  # not the note
