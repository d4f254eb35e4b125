"""Claim replay and deletion on logs of several signers, against a fold over the claims one by one."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from keelson.model import SCHEMAS, Store
from keelson.operators import describe, replay

START = datetime(2021, 6, 1, tzinfo=UTC)
KINDS = {"set": "set-attribute", "add": "add-attribute", "del": "del-attribute"}


def at(seconds):
    return START + timedelta(seconds=seconds)


def make(spark, log):
    return spark.createDataFrame([(f"c-{i:04x}", "pn-0", f"signer-{g}", at(t), KINDS[op], a, v) for i, (t, op, a, v, g) in enumerate(log)], SCHEMAS["claims"])


def fold(log, show):
    """Attributes by replaying one claim after the other; ``show``: as descriptions do."""
    held, mod = {}, None
    for t, op, a, v, _ in log:
        vals = held.setdefault(a, [])
        if op == "del":
            held[a] = [x for x in vals if v and x != v]
        else:
            if op == "set":
                held[a] = vals = []
            if show and (not v or v in vals):
                continue
            vals.append(v)
        mod = t
    return {a: v for a, v in held.items() if v}, mod


def random_log(seed, n, signers):
    """Claims at rising times: many additions, some that set, delete a value, or delete all."""
    rng = random.Random(seed)
    return [(10 * i, rng.choice(["set", "add", "add", "add", "del"]), rng.choice("pq"), rng.choice(["", "x", "y", "z"]), rng.choice(signers)) for i in range(n)]


def held(rows, **options):
    return {r["attr"]: r["vals"] for r in replay.attributes(rows, **options).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_logs_equal_a_fold(spark, seed):
    log = random_log(seed, 60, [1])
    rows = make(spark, log)
    assert held(rows) == fold(log, False)[0]
    shown, mod = fold(log, True)
    assert held(rows, dedupe=True) == shown
    store = Store.of(spark, claims=rows, signers=spark.createDataFrame([("signer-1", "ka")], SCHEMAS["signers"]))
    assert describe.described_modtimes(store, replay.deleted(store.deletions)).first()["mod"].replace(tzinfo=UTC) == at(mod)


@pytest.mark.parametrize("seed", range(10, 13))
def test_replay_of_a_signer_at_a_time(spark, seed):
    """Only claims of the signers asked for and up to the time count, as if there were no others."""
    log = random_log(seed, 50, [1, 2, 3])
    rows = make(spark, log).cache()
    for signers in ({1}, {2, 3}, {1, 2, 3}):
        mine = rows.where(rows["signer"].isin(*(f"signer-{g}" for g in signers)))
        for end in (-5, 0, 115, 250, 10**6):
            expected = fold([x for x in log if x[4] in signers and x[0] <= end], False)[0]
            now = replay.until(mine, at(end))
            assert held(now) == expected
            assert {r["attr"]: r["value"] for r in replay.first_values(now).collect()} == {a: v[0] for a, v in expected.items()}
            assert replay.has_value(now, "p", "x").count() == ("x" in expected.get("p", []))


def test_a_reset_spares_what_comes_after_it(spark):
    log = [(1, "add", "shelf", "left", 1), (2, "add", "shelf", "right", 2), (3, "set", "shelf", "top", 1), (4, "add", "shelf", "left", 2), (5, "del", "shelf", "top", 2), (6, "add", "lamp", "on", 1), (7, "del", "lamp", "", 2)]
    assert held(make(spark, log)) == {"shelf": ["left"]}
    assert held(make(spark, log[:4])) == {"shelf": ["top", "left"]}
    assert held(make(spark, [x for x in log if x[4] == 1])) == {"shelf": ["top"], "lamp": ["on"]}


@pytest.mark.parametrize(("edges", "dead"), [([], set()), ([("c1", "d1")], {"c1"}), ([("c1", "d1"), ("d1", "d2")], {"d1"}), ([("c1", "d1"), ("d1", "d2"), ("d2", "d3")], {"c1", "d2"}), ([("c1", "d1"), ("c1", "e1"), ("d1", "d2")], {"c1", "d1"})])
def test_deletion_can_be_deleted(spark, edges, dead):
    assert {r["ref"] for r in replay.deleted(spark.createDataFrame(edges, SCHEMAS["deletions"])).collect()} == dead


@pytest.mark.parametrize(("most", "join"), [(10, "BroadcastHashJoin"), (1, "ShuffledHashJoin")])
def test_rows_are_not_sorted_to_leave_out_the_deleted(spark, monkeypatch, capsys, most, join):
    monkeypatch.setattr(replay, "BROADCAST_REFS", most)
    rows = make(spark, random_log(1, 20, [1]))
    dead = spark.createDataFrame([("c-0003",), ("c-0007",)], "ref string")
    live = replay.not_deleted(rows, dead, "claim_ref")
    assert {r["claim_ref"] for r in live.collect()} == {f"c-{i:04x}" for i in range(20)} - {"c-0003", "c-0007"}
    live.explain()
    plan = capsys.readouterr().out
    assert join in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("most", [replay.BROADCAST_REFS, 0])
def test_only_objects_with_more_than_one_claim_are_replayed(spark, monkeypatch, most):
    """First values as columns equal a fold, and a single claim never meets the replay."""
    monkeypatch.setattr(replay, "BROADCAST_REFS", most)
    replayed = []
    whole = replay.held_values
    monkeypatch.setattr(replay, "held_values", lambda claims, dedupe=False: (replayed.extend(r["permanode"] for r in claims.collect()), whole(claims, dedupe))[1])
    logs = {f"pn-{k}": random_log(k, k % 7, [1]) for k in range(40)}
    logs |= {"one-1": [(0, "set", "p", "x", 1), (10, "add", "q", "y", 1)], "one-2": [(0, "del", "p", "", 1)], "one-3": [(0, "del", "q", "x", 1), (10, "add", "p", "", 1)]}
    rows = [(f"c-{i:04x}", name, f"signer-{g}", at(t), KINDS[op], a, v) for name, log in logs.items() for i, (t, op, a, v, g) in enumerate(log)]
    got = replay.pivoted(spark.createDataFrame(rows, SCHEMAS["claims"]), ["p", "q"]).collect()
    want = {name: fold(log, False)[0] for name, log in logs.items()}
    want = {name: (w.get("p", [None])[0], w.get("q", [None])[0]) for name, w in want.items() if w}
    assert len(got) == len(want) and {r["permanode"]: (r["p"], r["q"]) for r in got} == want
    single = {name for name, log in logs.items() if all([a for _, _, a, _, _ in log].count(x) < 2 for x in "pq")}
    assert replayed and not single & set(replayed)


def union_of_signers(spark):
    """Claims of which one part has a column of signers and one part a single signer."""
    many = make(spark, [(t, "add", "tag", f"v{t}", t % 3) for t in range(6)])
    return many.unionAll(many.selectExpr("concat(claim_ref, 'f')", "permanode", "'signer-0'", "date", "ctype", "attr", "value"))


def test_claims_of_a_key_are_never_broadcast(spark, monkeypatch):
    signers = spark.createDataFrame([("signer-0", "ka"), ("signer-1", "ka"), ("signer-1", "ka"), ("signer-2", "kb")], SCHEMAS["signers"])
    claims = union_of_signers(spark)
    wanted = sorted(r["claim_ref"] for r in claims.collect() if r["signer"] != "signer-2")
    for few in (replay.KEY_SIGNERS, 1):
        monkeypatch.setattr(replay, "KEY_SIGNERS", few)
        for refs in (replay.BROADCAST_REFS, 1):
            monkeypatch.setattr(replay, "BROADCAST_REFS", refs)
            mine = replay.of_key(claims, signers, "ka")
            assert "NestedLoop" not in mine._jdf.queryExecution().executedPlan().toString()
            assert sorted(r["claim_ref"] for r in mine.collect()) == wanted
    assert replay.of_key(claims, signers, "kc").isEmpty()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("dedupe", [False, True])
def test_lists_shuffle_claims_once(spark, dedupe):
    ops, attrs, values = ["set", "add", "add", "del"], ["tag", "title", None], ["", "a", "b", None]
    rng = random.Random(5)
    log = make(spark, [(rng.randrange(40), rng.choice(ops), rng.choice(attrs), rng.choice(values), 0) for _ in range(300)])
    lists = replay.attributes(log, dedupe)
    assert exchanges(lists) == 1
    by_join = {}
    for r in sorted(replay.held_values(log, dedupe).collect(), key=lambda r: (r["date"], r["claim_ref"])):
        by_join.setdefault(r["attr"], []).append(r["value"])
    assert {r["attr"]: r["vals"] for r in lists.collect()} == by_join
    twice = replay.attributes(log.unionAll(log), dedupe, again=True)
    assert {r["attr"]: r["vals"] for r in twice.collect()} == by_join
