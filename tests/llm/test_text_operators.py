"""Operators on single texts against plain Python, with odd inputs."""

import hashlib
import random
import re
import signal
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from keelson.llm import bpe, common, licenses, llr, ogg, packing, pii, qda

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a\n\na\nb\n a\n"), (5, "the cat sat on the cat sat on the cat sat"), (6, "é" * 300 + " #*$ <|>&%"), (7, "x" * 70_000), (8, "Licensed under the Apache License, Version 2.0. MIT license; GNU General-Public\nLicense"),
    (9, "CC BY-SA 4.0 and cc by. SPDX-License-Identifier: MIT"), (9, "CC BY-SA 4.0 and cc by. SPDX-License-Identifier: MIT"), (10, "Schreiben mit license"), (None, "no id here"), (11, "漢字 テスト  line\x85sep\x1c"), (12, "it's 3'll 12 34,  ...\r\n end "),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns whose names the operators use for themselves."""
    rows = [(i, t, "x", 1.5, None) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, score double, kept string").cache()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet").cache()


def records(df):
    return df.toPandas().to_dict("records")


def texts_of(docs, odd):
    return docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 10**6))


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_base_rules_equal_plain_counts(spark, docs, odd, labels):
    all_docs = texts_of(docs, odd)
    got = by_id(llr.quality_rules(all_docs, labels.where("quality = 1").select("doc_id")))
    for i, text in ((r["doc_id"], r["text"] or "") for r in all_docs.collect()):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        cover = set()
        for k in range(len(words) - 2):
            if windows[tuple(words[k : k + 3])] > 1:
                cover |= {k, k + 1, k + 2}
        failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
        for r in got[i]:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed)
            assert r["kept"] == (not failed and r["llr"] >= llr.LlrParams().threshold)
    assert sum(map(len, got.values())) == all_docs.count()


def test_log_ratio_equals_plain_counts(spark):
    rows = [(1, "abcdabcd", True), (2, "abcdxyzw", False), (3, None, True)]
    p = llr.LlrParams(n=4, buckets=64)
    counts = llr.count_grams(spark.createDataFrame(rows, "doc_id long, text string, trusted boolean"), p)
    bucket = lambda g: int(llr.gram_buckets(np.frombuffer(g.encode(), np.uint8), np.array([0, 4]), 4, 64)[0][0])
    expected = np.zeros((2, 64), int)
    for _, text, trusted in rows:
        for k in range(len(text or "") - 3):
            expected[1, bucket(text[k : k + 4])] += 1
            expected[0, bucket(text[k : k + 4])] += trusted
    assert (counts == expected).all()
    ratio = llr.log_ratio(counts, p)
    score = {r["doc_id"]: r["llr"] for r in llr.score_rules(spark.createDataFrame(rows, "doc_id long, text string, trusted boolean"), ratio, p).collect()}
    assert score[1] == pytest.approx(np.mean([ratio[bucket("abcdabcd"[k : k + 4])] for k in range(5)]), abs=1e-8) and score[3] == 0


def test_rules_separate_labels_that_they_were_not_made_from(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    even = labels.where("quality = 1 and doc_id % 2 = 0").select("doc_id")
    rows = llr.quality_rules(docs, even).join(labels, "doc_id").where("not base_failed and doc_id % 2 = 1").toPandas()
    assert rows[rows.quality == 1].kept.mean() > 0.95
    assert not len(rows[rows.quality == 0]) or rows[rows.quality == 0].kept.mean() < 0.5


def test_rules_do_not_depend_on_how_labels_are_joined(docs, labels, monkeypatch):
    trusted = labels.where("quality = 1").select("doc_id")
    one = sorted(tuple(r) for r in llr.quality_rules(docs, trusted).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in llr.quality_rules(docs, trusted).collect()) == one


def plain_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, found = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        places += at
        found |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))


def test_phrases_equal_plain_search(docs, odd):
    all_docs = texts_of(docs, odd)
    got = by_id(licenses.scan_licenses(all_docs))
    for r in all_docs.collect():
        for g in got[r["doc_id"]]:
            assert tuple(g)[1:6] == plain_places(r["text"])
            assert set(filter(None, g["base_labels"].split(","))) <= set(filter(None, g["labels"].split(","))) and 0 <= g["score"] <= 1


def sample(parsed, rng):
    """Some text that a parsed pattern matches, without look-arounds."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "SUBPATTERN":
            out += sample(arg[3], rng)
        elif op == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sample(arg[2], rng) for _ in range(rng.randint(arg[0], min(int(arg[1]), arg[0] + 2))))
        elif op == "ANY":
            out += "x"
        elif op == "IN":
            kind, x = rng.choice([a for a in arg if str(a[0]) != "NEGATE"])
            negated = str(arg[0][0]) == "NEGATE"
            out += "x" if negated else chr(x) if str(kind) == "LITERAL" else chr(x[0]) if str(kind) == "RANGE" else {"CATEGORY_SPACE": " ", "CATEGORY_WORD": "w", "CATEGORY_NOT_SPACE": "x", "CATEGORY_DIGIT": "7"}[str(x)]
    return out


def plain_detect(text, rules):
    found = []
    for r in rules:
        now = [(*m.span(), r.label, r.score) for m in r.pattern.finditer(text) if m.end() > m.start()]
        found += [x for x in now if not any(a <= x[0] and x[1] <= b for a, b, _, _ in found)]
    return sorted(found)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_signature_rules():
    rules = licenses.default_rules()
    assert len(rules) > 250 and all(r.keywords for r in rules)
    found = lambda t: [x[2] for x in licenses.detect(t, rules)]
    assert found("licensed under the apache license, version 2.0 and the mit license") == ["apache-2.0", "mit"]
    assert found("gnu lesser general public license v3") == ["lgpl"]
    assert found("cc by-nc-sa 4.0") == ["cc-by-nc-sa"]
    assert found("license = 'mit', see http://www.gnu.org/licenses/agpl-3.0.html") == ["mit", "agpl", "agpl"]
    assert found("the license of a driver") == [] and found("") == []
    assert licenses.keywords("a(?:bcde|d(?:efg)?)hello+xy?(?:zz|)") == ({("hell", False)},)
    assert licenses.keywords("x?(?:abc|defg)[hi]") == ({("abc", False), ("defg", False)},) and licenses.keywords("[ab]c*|x") == ()
    assert licenses.rule("x", "cc[ -]by", 1).keywords == ({("cc", True)},)
    assert licenses.rule("x", "apache (?:software )?licen[sc]e", 1).keywords == ({("apache", True)}, {("licen", False)})


def test_every_match_of_every_rule_passes_the_gate():
    """Generated matches: the automaton lets the rule through, and the pattern does match."""
    rng = random.Random(6)
    rules = licenses.default_rules()
    gate = licenses.Gate(rules)
    for i, r in enumerate(rules):
        for _ in range(6):
            text = sample(re._parser.parse(r.pattern.pattern), rng)
            raw = f"é. {text} é".encode()
            assert any(m for m in r.pattern.finditer(raw.decode())), (r.pattern.pattern, text)
            assert i in gate.open(raw, np.array([0, len(raw)]))[0], (r.pattern.pattern, text)


def test_scan_equals_rules_without_gate(spark):
    """Licence names beside bytes that are not ASCII, across texts, and generated texts of all rules mixed."""
    rng = random.Random(7)
    rules = licenses.default_rules()
    texts = ["“MIT License”", "«Apache License»", "mit license—see", "MIT License™", "the mit\u00a0license.", "“GPLv2”", "gplv1 lgplv1", "agplv2", "gplv4 or lgpl9", "“cc0”", "cc\u00a0by", "„All Rights Reserved“", "“Released into the public domain”", "“SPDX-License-Identifier: MIT”", "mit lic", "ense", None, ""]
    for _ in range(300):
        texts.append(rng.choice([" ", " and ", "\n", ""]).join(sample(re._parser.parse(r.pattern.pattern), rng) for r in rng.choices(rules, k=rng.randint(1, 6))))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spans=True).collect()}
    for i, text in enumerate(texts):
        low = lower(text or "")
        found = plain_detect(low, rules)
        assert [tuple(x) for x in got[i]["detections"]] == [x[:3] for x in found], text
        assert set(got[i]["labels"].split(",")) - {""} == {x[2] for x in found} | set(filter(None, got[i]["base_labels"].split(","))), text
        assert got[i]["score"] == max([0.5 * (got[i]["n_base"] > 0), *(x[3] for x in found)]), text
    own = (licenses.rule("x", "zebra", 1.0), licenses.rule("y", "[0-9]", 0.5))
    assert [r["labels"] for r in licenses.scan_licenses(spark.createDataFrame([(1, "a zebra"), (2, "7")], "doc_id long, text string"), own).orderBy("doc_id").collect()] == ["x", "y"]


def test_containment_is_linear_in_detections():
    rules = licenses.default_rules()
    spent = []
    for n in (2500, 10_000):
        text = "mit license, gplv2. released under the bsd license! cc by-nc 4.0 " * n
        began = time.process_time()
        assert len(licenses.detect(text, rules)) == 4 * n
        spent.append(time.process_time() - began)
    assert spent[1] < 8 * spent[0]


def test_surrogates(spark, odd):
    mails = "Write to Anna.Low@mail1.example.com or anna.low@MAIL1.example.com; call +1 (743) 555-3824, 743-555-3824; card 4111 1111 1111 1111; 192.168.3.77; Mr John Smith and Mrs Jane Smith; token = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\"; г-н Иванов"
    rows = spark.createDataFrame([(100, mails, "k"), (101, "number 4111111111111112 stays, so does 1.2.3", "k"), (102, "ask anna.low@mail1.example.com", "k")], "doc_id long, text string, kinds string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(rows, b"key").collect()}
    text = got[100]["text"]
    for old in ("nna.", "743", "4111", "192.168.3.77", "John", "Smith", "9b0b3c6a", "Иванов"):
        assert old not in text
    new_mail = re.search(r"ask (\S+)", got[102]["text"])[1]
    assert text.lower().count(new_mail) == 2 and new_mail.endswith(".com")
    first, second = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4}), (\d{3}-\d{3}-\d{4})", text)[0].split(", ")
    assert re.sub(r"\D", "", first)[1:] == re.sub(r"\D", "", second)
    card = re.search(r"card ([\d ]+)", text)[1]
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", card) and pii.luhn(card.replace(" ", "")) and card[0] == "4"
    man, woman = re.search(r"Mr (\w+) \w+ and Mrs (\w+)", text).groups()
    assert man.endswith(pii.ENDINGS["latin"]["m"]) and woman.endswith(pii.ENDINGS["latin"]["f"])
    assert re.search(r"г-н [А-Я][а-я]+", text)
    assert got[101]["text"] == "number 4111111111111112 stays, so does 1.2.3" and got[101]["n_entities"] == 0
    kept = {r["doc_id"]: r["text"] for r in pii.pseudonymise(odd, b"key").where("doc_id in (1, 2, 7)").collect()}
    assert kept == {1: None, 2: "", 7: "x" * 70_000}
    assert pii.pseudonymise(odd, b"key", keep_others=True).columns == ["doc_id", "text", "n_entities", "kinds", "n_words", "score", "kept"]


def test_numbers_that_stand_beside_each_other():
    kinds = lambda t: [(k, t[a:b]) for a, b, k, _ in pii.entities(t)]
    assert kinds("+1 (826) 555-4081 4111111111111111") == [("phone", "+1 (826) 555-4081"), ("card", "4111111111111111")]
    assert kinds("7536784127813051 4111111111111111 12") == [("card", "4111111111111111")]
    assert kinds("12 4111 1111 1111 1111, 4111 1111 1111 1112") == [("card", "4111 1111 1111 1111")]
    assert kinds("+49 30 1234567 and (743) 555-3824.") == [("phone", "+49 30 1234567"), ("phone", "(743) 555-3824")]
    assert kinds("1.2.3.4.5 and 300.1.1.1 or 10.0.0.255") == [("ip", "10.0.0.255")]


def test_title_across_two_texts():
    """'...D' and 'on the way' form a title that is in neither text; the search ends."""
    texts = ["LAND", "on the way", "Don Carlo", "M", "", "r Low, Mr Low", "D", "r. "]
    raw = [t.encode() for t in texts]
    old = signal.signal(signal.SIGALRM, lambda *_: pytest.fail("the search for titles does not end"))
    signal.alarm(20)
    try:
        at = pii._suspects(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, old)
    assert at.tolist() == [2, 5]


def test_every_entity_passes_the_prefilter(spark):
    """Entities alone in a text, with few or no ASCII digits, are found as by entities()."""
    alone = ["10.0.0.1", "8.8.8.8", "sk-" + "abcdefghij" * 2, "AKIA" + "ABCDEFGHIJKLMNOP", "ASIA" + "ABCDEFGHIJKLMNOP", *(f"gh{c}_" + "abcdefghijkl" * 3 for c in "pousr"), "deadbeef" * 4, "DEADBEEF" * 4, "١٢٣-٤٥-٦٧٨٩", "１２３-４５-６７８９", "𝟏" * 3 + "-" + "𝟏" * 2 + "-" + "𝟏" * 4, "a@b.cd", "Prof. Low"]
    alone.append(next(x for x in (f"GB{d:02d}ABCDEFGHIJKLMNOP" for d in range(100)) if pii.iban_check(x) == 1))
    rows = [(i, f"{'x' * (i % 17)} see {t} now") for i, t in enumerate(alone)]
    assert all(pii.entities(t) for _, t in rows)
    got = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), b"key").collect()}
    for i, text in rows:
        found = pii.entities(text)
        assert (got[i]["n_entities"], got[i]["kinds"]) == (len(found), ",".join(sorted({x[2] for x in found}))), text
        assert alone[i] not in got[i]["text"]
    assert pii._suspects(np.frombuffer("plain words, 3.5 times 10.".encode(), np.uint8), np.array([0, 26])).size == 0


def test_persons_stay_the_same_however_they_are_named(spark):
    texts = [
        "Mr John Smith met Mrs Smith. Dr John Smith said: John Smith and Mr SMITH left, Smith's dog too; Johnson, Smithy and john smith are others",
        "Prof. John Smith, Mrs Anna-Lena Low",
        "Dr Kim Ray, Mr Kim Ray, Mrs Kim Ray",
        "John Smith without a title",
        "Don Carlo, then Carlo; г-жа Анна Иванова и Иванова",
        "Mr Ab Cd Ef, Cd Ef",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(rows, b"key").collect()}
    john, smith = re.match(r"Mr (\w+) (\w+) met", got[0]["text"]).groups()
    assert john.endswith(pii.ENDINGS["latin"]["m"])
    assert got[0]["text"] == f"Mr {john} {smith} met Mrs {smith}. Dr {john} {smith} said: {john} {smith} and Mr {smith.upper()} left, {smith}'s dog too; Johnson, Smithy and john smith are others"
    assert (got[0]["n_entities"], got[0]["kinds"]) == (6, "person")
    assert got[1]["text"].startswith(f"Prof. {john} {smith}, Mrs ") and "Low" not in got[1]["text"] and "Lena" not in got[1]["text"]
    kims = re.match(r"Dr (\w+) (\w+), Mr (\w+) \2, Mrs (\w+) \2$", got[2]["text"]).groups()
    assert len({kims[0], kims[2], kims[3]}) == 3  # Dr could be either
    assert got[3]["text"] == texts[3]
    carlo = re.match(r"Don (\w+), then \1; г-жа (\w+) (\w+) и \3$", got[4]["text"])
    assert carlo and carlo[1].endswith(pii.ENDINGS["latin"]["m"]) and carlo[2].endswith(pii.ENDINGS["cyrillic"]["f"])
    assert re.match(r"Mr \w+ (\w+ \w+), \1$", got[5]["text"])


def test_addresses_of_one_domain_keep_one_domain(spark):
    rows = spark.createDataFrame([(1, "bob@corp.com amy@corp.com bob@other.com"), (2, "BOB@Corp.com")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(rows, b"key").collect()}
    (bob, corp), (amy, corp2), (_, other) = (x.split("@") for x in got[1].split())
    assert corp == corp2 != other and bob != amy and got[2].lower() == f"{bob}@{corp}"


def test_names_of_both_kinds_do_not_meet(spark, monkeypatch):
    draws = {"m/latin/Bo": ["Mila", "Nora", "Vera"], "latin/Ka": ["Mila"], "latin/Lu": ["Ka", "Nora", "Tara"]}
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, canon, attempt: draws[canon][attempt])
    known = spark.createDataFrame([("given" if c[0] == "m" else "family", c) for c in draws], "kind string, canon string")
    again = {r["canon"]: r["attempt"] for r in pii.redraws(known, b"k").collect()}
    assert len({draws[c][again.get(c, 0)] for c in draws} - {"Ka"}) == 3


def test_redraws_end_where_a_form_is_full(spark):
    """All one-digit names of all one-digit domains, all of one-letter names: longer surrogates are drawn."""
    mails = [f"{a}@{b}.co" for a in range(10) for b in range(10)]
    rows = spark.createDataFrame([(1, " ".join(mails))], "doc_id long, text string")
    new = pii.pseudonymise(rows, b"key").first()["text"].split()
    assert len(set(new)) == 100 and not set(new) & set(mails) and len({x.split("@")[1] for x in new}) == 10
    for kind, canon in (("card", "4111111111111111"), ("iban", "GB82WEST12345698765432"), ("ip", "1.2.3.4"), ("secret", "ab" * 16), ("ssn", "123456789"), ("phone", "7435553824"), ("family", "latin/Low"), ("given", "f/greek/Άννα"), ("local", "a@b.c"), ("domain", "a.b.c")):
        forms = [pii.surrogate(b"k", kind, canon, n) for n in (0, 7, 8, 80)]
        assert len(set(forms)) == 4 and (len(forms[3]) > len(forms[0]) or kind == "card"), kind
        assert kind != "card" or all(map(pii.luhn, forms))
        assert kind != "iban" or all(pii.iban_check(f) == 1 for f in forms)


def test_mails_equal_one_pattern_and_are_linear():
    pattern = re.compile(r"[\w.+-]*\w@\w[\w-]*(?:\.\w[\w-]*)+")
    rng = np.random.RandomState(4)
    for _ in range(4000):
        text = "".join(rng.choice(list("aé1.+-@@ "), rng.randint(0, 24)))
        assert list(pii.mails(text)) == [m.span() for m in pattern.finditer(text)], text
    for text in ("x" * 2_000_000 + " a@b.cd", "x.y-" * 500_000 + " a@b.cd", "@x.y " * 300_000 + "a@b.cd", "a@b.cd " * 100_000, "a@" + "b-" * 500_000 + " a@b.cd"):
        began = time.process_time()
        assert [x[3] for x in pii.entities(text)[-1][3]] == ["a@b.cd", "b.cd"]
        assert time.process_time() - began < 20


def test_surrogates_are_distinct(spark, monkeypatch):
    """With a domain so small that draws collide, every entity still gets one of its own."""
    draws = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, canon, attempt: f"{int(hashlib.sha256(f'{canon}/{attempt}'.encode()).hexdigest(), 16) % 400:03d}")
    known = spark.createDataFrame([("ssn", f"{i:03d}") for i in range(150)], "kind string, canon string")
    again = {r["canon"]: r["attempt"] for r in pii.redraws(known, b"k").collect()}
    final = [pii.surrogate(b"k", "ssn", f"{i:03d}", again.get(f"{i:03d}", 0)) for i in range(150)]
    assert len(set(final)) == 150 and not set(final) & {f"{i:03d}" for i in range(150)} and again
    assert draws(b"k", "ip", "1.2.3.4", 0) != draws(b"k", "ip", "1.2.3.4", 1)


def test_merges_equal_the_tokenizer(spark, docs, odd):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        tokens = bpe.parse_ranks(f.read())
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    all_docs = texts_of(docs.limit(60), odd)
    got = by_id(bpe.encode_digests(all_docs, path, public_tokenizers.PATTERN))
    for r in all_docs.collect():
        ids = np.array(plain.encode_ordinary(r["text"] or ""), "<u4")
        for g in got[r["doc_id"]]:
            assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    ids = bpe.encode_documents(odd, path, public_tokenizers.PATTERN).where("doc_id = 12").first()["ids"]
    assert plain.decode(ids) == ODD[-1][1]


def plain_best_fit(lengths, allowed, p):
    def rate(size, i):
        inside = lengths[i]
        for y in lengths[i + 1 :]:
            inside += y * (inside + y <= size)
        return p.cost(min(s for s in p.sizes if s >= inside)) / inside, size

    sizes, filled, bins = [], [], []
    for i, x in enumerate(lengths):
        fits = [(sizes[b] - filled[b], b) for b in range(len(sizes)) if sizes[b] - filled[b] >= x]
        if fits:
            b = min(fits)[1]
        else:
            b = len(sizes)
            sizes.append(min(rate(s, i) for s in [s for s in allowed if s >= x] or [min(s for s in p.sizes if s >= x)])[1])
            filled.append(0)
        bins.append(b)
        filled[b] += x
    return bins, [min(s for s in p.sizes if s >= f) for f in filled]


def test_best_fit_equals_a_linear_search():
    rng = np.random.RandomState(0)
    for n in (0, 1, 5, 300):
        lengths = sorted(rng.randint(1, 101, n).tolist(), reverse=True)
        p = packing.PackParams(sizes=(30, 60, 100), overhead=4, square=150)
        for allowed in ((30,), (60,), (100,), (30, 60), (60, 100), (30, 60, 100)):
            got = packing.pack_with(lengths, allowed, p)
            assert (got.bins, got.sizes) == plain_best_fit(lengths, allowed, p)
            assert got.cost == pytest.approx(sum(map(p.cost, got.sizes)))


def test_several_sizes_are_cheaper_than_the_best_single_one():
    """The joint choice never costs more than to prefer one size, and less where lengths ask for several."""
    rng = np.random.RandomState(1)
    p = packing.PackParams()
    for name, lengths, mixed in (
        ("two kinds", np.concatenate((rng.randint(3900, 4097, 3000), rng.randint(2300, 2700, 6000))), True),
        ("log-normal", np.clip(np.exp(rng.normal(7.5, 1.1, 20_000)), 1, max(p.sizes)).astype(int), False),
    ):
        lengths = sorted(lengths.tolist(), reverse=True)
        joint = packing.best_fit(lengths, p)
        single = [packing.pack_with(lengths, (s,), p).cost for s in p.sizes]
        print(f"{name}: cost a unit {joint.cost / sum(lengths):.4f}, of single sizes {[round(x / sum(lengths), 4) for x in single]}; bins {Counter(joint.sizes)}")
        assert joint.cost <= min(single) and (joint.cost < 0.99 * min(single) or not mixed)


def test_repeated_rows_spread_over_shards(spark):
    rows = spark.range(5000).selectExpr("7L as doc_id", "repeat('x', 100) as text").unionByName(spark.createDataFrame([(8, "y"), (None, None)], "doc_id long, text string"))
    got = packing.pack(rows, packing.PackParams(shard_rows=500)).toPandas()
    assert len(got) == 5002 and got.length.sum() == 500_001
    assert (got[got.doc_id == 7].bin_id.astype("int64") // 2**32).value_counts().max() < 1000


def test_packing_places_every_byte_once(docs, odd):
    all_docs = texts_of(docs, odd)
    rows = packing.pack(all_docs, packing.PackParams(sizes=(512, 1024, 2048), shard_rows=50)).toPandas()
    lengths = all_docs.selectExpr("doc_id", "coalesce(octet_length(text), 0) n").toPandas()
    assert rows.groupby("doc_id", dropna=False).length.sum().sum() == lengths.n.sum()
    full = rows[rows.length > 0]
    for _, b in full.groupby("bin_id"):
        b = b.sort_values("bin_offset")
        assert (b.bin_offset.values == np.concatenate(([0], b.length.cumsum().values[:-1]))).all() and b.length.sum() <= b.bin_size.iloc[0]
        assert b.bin_size.iloc[0] == min(s for s in (512, 1024, 2048) if s >= b.length.sum())
    assert rows[rows.length == 0].bin_id.isna().all() and (full.length.sum() / full.groupby("bin_id").bin_size.first().sum()) > 0.85


def test_ogg_round_trip(docs, odd):
    all_docs = texts_of(docs.limit(50), odd)
    got = by_id(ogg.ogg_media(all_docs, keep_media=True))
    for r in all_docs.collect():
        text = (r["text"] or "").encode()
        payload = text + b"\xff" * ((-len(text)) % 576 if text else 576)
        for g in got[r["doc_id"]]:
            media = bytes(g["media"])
            assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
            assert (g["media_bytes"], g["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest()) and f"seconds={len(payload) / 8000:.6f}" in g["feature"]


def plain_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_pages_are_verified():
    assert all(ogg.page_crc(d) == plain_crc(d) for d in (b"", b"OggS", bytes(range(256))))
    media = ogg.write_ogg(ogg.payload_of(b"abc" * 40_000))
    for bad in (media[:-1], media[:100] + b"\0" + media[101:], media[5:], media.replace(b"PCM8", b"PCM9", 1)):
        with pytest.raises(ogg.OggError):
            ogg.read_ogg(bad)
    pages = [ogg.page(2, 0, 7, 0, b"\xff\xff", b"a" * 510), ogg.page(5, 9, 7, 1, b"\x03\x00", b"xyz")]
    stream = ogg.read_ogg(b"".join(pages))[7]
    assert stream["packets"] == [b"a" * 510 + b"xyz", b""] and stream["times"][-1] == (9, 9 / 8000)
    with pytest.raises(ogg.OggError):
        ogg.read_ogg(pages[1])


def test_classifier_on_held_out_rows(spark, labels):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = qda.classify(docs, qda.train(docs, labels)).join(labels, "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    out = got[got.held_out]
    assert (out.predicted == out.quality).mean() > 0.97


def test_classifier_scores_equal_plain_densities(spark):
    rng = np.random.RandomState(3)
    x = [rng.normal(k, 1 + k, (40, qda.D)) for k in (0, 1)]
    p = qda.QdaParams()
    model = qda.fit({k: (len(a), a.sum(0), a.T @ a) for k, a in enumerate(x)}, p)
    covs = [np.cov(a.T, bias=True) for a in x]
    pooled = (covs[0] + covs[1]) / 2
    logs = []
    for a, cov in zip(x, covs, strict=True):
        cov = (1 - p.to_pooled) * cov + p.to_pooled * pooled
        cov = (1 - p.to_identity) * cov + p.to_identity * np.trace(cov) / qda.D * np.eye(qda.D)
        z = x[1] - a.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) - 0.5 * np.linalg.slogdet(cov)[1])
    assert model.score(x[1]) == pytest.approx(1 / (1 + np.exp(-(logs[1] - logs[0]) / p.temperature)), rel=1e-6)


def test_classifier_without_training_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in qda.classify(odd, qda.train(odd, none)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(1, 10)], "doc_id long, quality int")
    assert {r["predicted"] for r in qda.classify(odd, qda.train(odd, one)).collect()} == {1}
    assert qda.keep_good(odd, qda.train(odd, one)).columns == odd.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    ids = spark.createDataFrame([], "doc_id long")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for df in (llr.quality_rules(none, ids), licenses.scan_licenses(none), pii.pseudonymise(none, b"k"), bpe.encode_digests(none, path, public_tokenizers.PATTERN), packing.pack(none), ogg.ogg_media(none)):
        assert df.count() == 0


def test_slices_cover_all_rows():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(6)), pa.array(["ab", None, "", "x" * 50, "é", "z"])], names=["doc_id", "text"])
    cuts = list(common.slices(iter([batch]), 4))
    assert sum(b.num_rows for b, _, _ in cuts) == 6 and b"".join(buf.tobytes() for _, buf, _ in cuts) == ("ab" + "x" * 50 + "éz").encode()
    assert pd.Series([offs[-1] for _, _, offs in cuts]).sum() == 55
