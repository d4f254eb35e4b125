"""Operators over whole corpora against brute force, with odd inputs, and the pipeline."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keelson.llm import bcr, dedup, forest, graph, queries, warc


@pytest.fixture(scope="module")
def corpus(data):
    """Documents, near copies of one, passages of 40 to 60 bytes, and odd rows."""
    rng = random.Random(3)
    rows = list(pd.read_parquet(f"{data}/documents.parquet")[["doc_id", "text"]].itertuples(index=False, name=None))
    base = rows[5][1]
    for k in range(30):
        at = rng.randint(0, len(base) - 60)
        rows.append((2000 + k, "xy" * rng.randint(0, 30) + base[at : at + rng.randint(40, 60)] + "é" * rng.randint(0, 40)))
    words = next(t for _, t in rows if 250 < len(t.split()) < 500).split()
    for k in range(80):
        w = list(words)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"zz{rng.randint(0, 10**6)}"
        rows.append((3000 + k, " ".join(w)))
    rows += [(4000, None), (4001, ""), (4002, "a" * 300), (4003, "a" * 49), (4004, "a" * 50), (4005, "ab" * 400), (4006, "ab" * 26), (7, rows[7][1]), (4007, "a b"), (4008, " a  b "), (4009, "a b c d e"), (4010, " ")]
    return rows


@pytest.fixture(scope="module")
def frame(spark, corpus):
    rows = pd.DataFrame(corpus, columns=["doc_id", "text"]).assign(key=1, n_links="clash", kept="clash")
    return spark.createDataFrame(rows).cache()


@pytest.mark.parametrize("block", [1 << 16, 5])
def test_suffixes_equal_sorting(monkeypatch, block):
    monkeypatch.setattr(bcr, "BLOCK", block)
    rng = np.random.RandomState(0)
    for _ in range(60):
        n, m, a = rng.randint(1, 8), rng.randint(1, 8), rng.randint(1, 3)
        x = rng.randint(0, a + 1, (n, m)).astype(np.uint16)
        row, start, lcp = bcr.suffixes(x, np.ones(m + 1, np.int64))
        got = [tuple(x[r, s:]) for r, s in zip(row, start, strict=True)]
        assert got == [t[:-1] for t in sorted((*x[r, s:], -1) for r in range(n) for s in range(m + 1))]
        for k in range(1, len(got)):
            common = next((i for i, (p, q) in enumerate(zip(got[k - 1], got[k], strict=False)) if p != q), min(len(got[k - 1]), len(got[k])))
            assert lcp[k] == common


def plain_removal(rows, length=50):
    first = {}
    for i, t in rows:
        t = (t or "").encode()
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            first[w] = min(first.get(w, 1 << 62), i)
    out = defaultdict(list)
    for i, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i].append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("block", [8 << 20, 1 << 16])
def test_removal_equals_brute_force(frame, corpus, monkeypatch, block):
    monkeypatch.setattr(dedup, "BLOCK_BYTES", block)
    got = defaultdict(list)
    rows = dedup.remove_repeats(frame, keep_others=True)
    assert rows.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "key", "n_links", "kept"]
    for r in rows.toDF("doc_id", "n_bytes", "n_removed", "n_spans", "cut", "key", "n_links", "kept").collect():
        assert (r["key"], r["n_links"]) == (1, "clash")
        got[r["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["cut"]).hexdigest()))
    assert {i: sorted(v) for i, v in got.items()} == plain_removal(corpus)


@pytest.mark.parametrize("limits", [{"COLLECTION_ROWS": 50}, {"HOT_BLOCKS": 0, "BLOCK_BYTES": 1 << 15}, {"FAN": 3, "GATHER_BYTES": 1 << 14, "BLOCK_BYTES": 1 << 15, "HOT_BLOCKS": 2}])
def test_bounds_do_not_change_results(frame, corpus, monkeypatch, limits):
    """Small collections, all anchors split by the bytes beside them, and buckets in two levels."""
    for name, value in limits.items():
        monkeypatch.setattr(dedup, name, value)
    assert dedup.remove_repeats(frame).agg(F.sum("n_removed")).first()[0] == sum(x[1] for v in plain_removal(corpus).values() for x in v)


def test_rows_without_id_are_kept(spark):
    text = "the same passage of text, that is long enough to be found again"
    rows = spark.createDataFrame([(None, text), (5, text), (9, text), (None, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_removed"]) for r in dedup.remove_repeats(rows).collect()}
    assert got == {(None, 0), (5, 0), (9, len(text))}


def plain_links(rows):
    """(doc_id, doc_id, linked) of neighbouring rows that are not equal."""
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for i, w in ((i, t.split()) for i, t in rows)]
    return [(i, j, 5 * len(a & b) >= 4 * len(a | b)) for (i, a), (j, b) in zip(sets[::2], sets[1::2], strict=True) if a != b]


def plain_classes(rows):
    ids, sets = [], []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        ids.append(i)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    root, links = list(range(len(ids))), [0] * len(ids)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for o in holders[x]:
                common[o] += o > k
        for o, n in common.items():
            if n and 5 * n >= 4 * (len(s) + len(sets[o]) - n):
                links[k] += 1
                links[o] += 1
                root[find(o)] = find(k)
    least = {}
    for k in range(len(ids)):
        least[find(k)] = min(least.get(find(k), 1 << 62), ids[k])
    return sorted((ids[k], least[find(k)], links[k]) for k in range(len(ids)))


@pytest.mark.parametrize("part", [256, 16])
def test_classes_equal_brute_force(frame, corpus, part):
    got = forest.jaccard_classes(frame, forest.ForestParams(part_rows=part, task_rows=300, task_bytes=1 << 18))
    assert sorted(tuple(r) for r in got.collect()) == plain_classes(corpus)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(8)
    one, two = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(2))
    rows = [(1, one), (1, two), (5, two), (6, one + " more"), (None, one), (1, one), (9, None), (9, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in forest.jaccard_classes(frame).collect()), key=repr)
    assert got == sorted([(1, 1, 2), (1, 1, 1), (5, 1, 1), (6, 1, 2), (None, None, 0), (1, 1, 2), (9, 9, 0), (9, 9, 0)], key=repr)
    kept = sorted((tuple(r) for r in corpus_pipeline.jaccard_join(spark, frame, "").collect()), key=repr)
    assert kept == sorted([(1, one), (1, two), (None, one), (9, None), (9, None)], key=repr)


@pytest.fixture(scope="module")
def near_copies(spark):
    """Sets at known similarities to their bases, in steps over the threshold."""
    rng = random.Random(11)
    rows = []
    for b in range(300):
        words = [f"b{b}w{k}" for k in range(204)]
        changed = list(words)
        for k in rng.sample(range(0, 200, 5), b % 5):
            changed[k] = f"c{b}w{k}"
        rows += [(2 * b, " ".join(words)), (2 * b + 1, " ".join(changed))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").cache()


def forest_sets(frame, p):
    marked = forest.signatures(frame.withColumn("h", F.lit(0).cast("long")), p)
    return marked.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("node"), F.first("labels").alias("labels")).select("node", "n", "labels").cache()


def test_descent_ends_where_what_was_found_is_found_with_the_recall(near_copies):
    """Far copies need shorter prefixes than near ones; the recall at each end is measured."""
    rows, frame = near_copies
    p = forest.ForestParams()
    assert p.recall(0.8, p.least_depth()) >= p.target_recall > p.recall(0.8, p.least_depth() + 1)
    _, near_depth, near = forest.descend(forest_sets(frame.where("doc_id % 10 < 4"), p), p)
    members, far_depth, far = forest.descend(forest_sets(frame, p), p)
    assert near_depth > far_depth >= p.least_depth() and min(near) > min(far)
    assert p.recall(min(a for a in far if a >= 0.8 * p.values) / p.values, far_depth) >= p.target_recall
    groups = {}
    for r in members.collect():
        groups.setdefault(tuple(r[c] for c in ("tree", "depth", "prefix", "low", "high", "root")), set()).add(r["node"])
    links = [(i, j) for i, j, n in plain_links(rows) if n]
    missed = [x for x in links if not any({*x} <= g for g in groups.values())]
    print(f"recall at depth {far_depth}: {1 - len(missed) / len(links):.5f} of {len(links)} links")
    assert len(links) > 150 and not missed


def test_a_set_of_a_large_node_travels_once(spark):
    p = forest.ForestParams()
    rows = [(i, 100, tree, i % 2) for i in range(1500) for tree in (0, 1)] + [(i, 100, 0, 1 << 60 | i % 2) for i in range(1500, 1510)]
    near = spark.createDataFrame(rows, "node long, n long, tree int, label long").withColumn("labels", F.array(F.lit(0).cast("long")))
    nodes = forest.branching(near, forest.DEPTH - 1)
    dealt = forest.deal(near, nodes, forest.DEPTH - 1, p).cache()
    assert {r["tree"]: r["count"] for r in dealt.groupBy("tree").count().collect()} == {0: 1510, 1: 1500}
    assert sorted(r["count"] for r in dealt.groupBy("task").count().collect()) == [10, 1500, 1500]
    cut = forest.deal(near, nodes, forest.DEPTH - 1, forest.ForestParams(part_rows=500))
    assert cut.where("prefix = 0").count() == 3 * 3000 and cut.where("prefix = 0").select("task").distinct().count() == 12


def test_similarity_is_decided_by_whole_numbers():
    a, b = np.arange(10, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    assert forest.linked([a], [b[:8]], Fraction(4, 5))[0, 0] and not forest.linked([a], [b[:7]], Fraction(4, 5))[0, 0]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(9, 9)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


PAGES = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://d", ""), (5, "u v\n", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n tail"), (6, "http://f", "WARC/1.1\r\n"), (7, "http://g", "x" * 100_000), (7, "http://g", "x" * 100_000), (None, "http://n", "same")]


@pytest.mark.parametrize("records", [1000, 2])
def test_archives_come_back(spark, monkeypatch, records):
    monkeypatch.setattr(warc, "FILE_RECORDS", records)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=repr)
    best = {}
    for i, _, html in PAGES:
        if i is not None:
            best[html or ""] = max(best.get(html or "", -1), i)
    expected = []
    for i, _, html in PAGES:
        html = html or ""
        to = None if i is None or best[html] == i else best[html]
        expected.append((i, len(html.encode()), warc.digest32(html.encode()), "response" if to is None else "revisit", to))
    assert got == sorted(expected, key=repr)


def test_large_pages_get_files_of_their_own(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "SMALL_BYTES", 1000)
    monkeypatch.setattr(warc, "FILE_RECORDS", 8)
    pages = spark.createDataFrame([(i, "http://a/", f"{i}" + "x" * (i * 400)) for i in range(24)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"))
    sizes = [f.stat().st_size for f in tmp_path.glob("w/*/part*")]
    assert max(sizes) < 8 * 1000 + 8 * 400 + 2 * 9600 and len(sizes) > 8
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 24


def test_a_broken_chain_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://a/", f"page {i}") for i in range(9)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"))
    (part,) = tmp_path.glob("w/*/part*")
    good = part.read_bytes()
    other = tmp_path / "bad" / "x"
    other.mkdir(parents=True)
    for bad in (good.replace(b"page 4", b"page 4, longer"), good[:-9], b"z" + good):
        (other / "one.warc").write_bytes(bad)
        with pytest.raises(warc.ArchiveError, match="one.warc"):
            warc.read_archives(spark, str(tmp_path / "bad"))


def test_payloads_of_one_id_are_told_apart(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "b"), (2, "u", "a")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    assert got == sorted([(1, warc.digest32(b"a"), "revisit", 2), (1, warc.digest32(b"b"), "response", None), (2, warc.digest32(b"a"), "response", None)])


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame(PAGES[:2], "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.round_trip(pages, min_bytes=5).collect()} == {"response"}


def test_fakes_with_odd_fields_are_rejected(spark):
    def fake(**fields):
        return "x\r\n\r\n" + warc.MAGIC.decode() + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items()) + "\r\n\r\n\r\n and more"

    html = [
        fake(WARC_Type="revisit", Content_Length=0, WARC_Payload_Length="abc", WARC_Record_ID=f"<urn:page:{'9' * 30}>"),
        fake(WARC_Type="revisit", Content_Length=0, WARC_Payload_Length="9" * 25, WARC_Refers_To=f"<urn:page:-{'9' * 19}>"),
        fake(WARC_Type="response", Content_Length="9" * 5000),
        fake(WARC_Type="response", Content_Length=0, WARC_Record_ID="<urn:page:1>"),
    ]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").withColumn("url", F.lit("http://a/"))
    got = sorted(tuple(r) for r in warc.round_trip(pages).collect())
    assert got == [(i, len(h), warc.digest32(h.encode()), "response", None) for i, h in enumerate(html)]


def test_archives_equal_their_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    expected = {(r[0], *r[1:4], r[4]) for r in con.execute(queries.SQL["op10_warc_chain"]).fetchall()}
    assert {tuple(r) for r in queries.QUERIES["op10_warc_chain"](spark, data).collect()} == expected


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert dedup.remove_repeats(none, keep_others=True).count() == 0 and forest.jaccard_classes(none).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, data):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["quality_classifier", "jaccard_join", "suffix_dedup", "pii_surrogates", "best_fit_packing"]
    kept = c.quality_classifier(spark, docs, data).cache()
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() < docs.count() and kept.exceptAll(docs).isEmpty()
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "a b c d e f g", "en", "s", 13), (10**6 + 2, "a b c d e f g", "en", "s", 13)], docs.schema)
    kept = kept.unionByName(odd).cache()
    joined = c.jaccard_join(spark, kept, data).cache()
    classes = plain_classes([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert sorted(r["doc_id"] for r in joined.collect()) == sorted({root for _, root, _ in classes})
    cut = c.suffix_dedup(spark, joined, data).cache()
    removal = plain_removal([(r["doc_id"], r["text"]) for r in joined.collect()])
    assert cut.columns == docs.columns and cut.count() == joined.count()
    assert all(not removal[r["doc_id"]][0][1] or len(r["text"].encode()) <= removal[r["doc_id"]][0][0] - removal[r["doc_id"]][0][1] for r in cut.collect())
    masked = c.surrogates(spark, cut, data)
    assert masked.columns == docs.columns and masked.where("text rlike '[a-z][.][0-9]+@mail[0-9]+[.]example[.]com'").isEmpty()
    assert masked.where("n_chars <> char_length(text)").isEmpty()
    packed = c.best_fit(spark, masked, data)
    assert packed.agg(F.sum("length")).first()[0] == masked.agg(F.sum(F.octet_length("text"))).first()[0]
    assert c.run(spark, data).count() > 0


def test_stages_keep_rows_without_text_and_other_columns(spark):
    """Names of columns that stages use for themselves do not clash; nothing is made of nothing."""
    rows = [(1, "one text of some words that is long enough to be found in another row", 1, 2, 3, "a"), (2, None, 4, 5, 6, "b"), (3, "", 7, 8, 9, "c"), (None, None, 0, 0, 0, "d"), (4, "a row with many other words in front, so that it is no near copy of the first one: one text of some words that is long enough to be found in another row", 1, 2, 3, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long, key long, kinds long, kept string")
    for stage in (corpus_pipeline.jaccard_join, corpus_pipeline.suffix_dedup, corpus_pipeline.surrogates):
        got = stage(spark, docs, "")
        assert got.columns == docs.columns and got.count() == 5
        assert sorted((r["kept"], r["text"], r["h"], r["key"]) for r in got.where("coalesce(text, '') = ''").collect()) == [("b", None, 4, 5), ("c", "", 7, 8), ("d", None, 0, 0)]
        assert stage(spark, docs.limit(0), "").count() == 0


def test_cuts_leave_replacement_characters_of_the_text(spark):
    """Only what a cut leaves of a character goes; U+FFFD of the text itself stays."""
    passage = "\u00e9" + "".join(chr(97 + i * 7 % 26) for i in range(60)) + "\u00e9"
    rows = [(1, "x" + passage + "y"), (2, "own \ufffd \u0269" + passage[1:-1] + "\u00e8 \ufffd end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = {r["doc_id"]: r for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    assert got[1]["text"] == rows[0][1]
    assert (got[2]["text"], got[2]["n_chars"]) == ("own \ufffd  \ufffd end", 12)
