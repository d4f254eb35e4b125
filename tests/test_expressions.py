"""The expression language: trees, keywords and errors."""

import random

import pytest

from keelson.functions.scalar import time_of_prefix
from keelson.plans import constraints as K
from keelson.plans.expressions import BASE, _range, default_keywords, logical, parse
from keelson.runtime import QueryError

WORDS = default_keywords(lambda n: [{"north": 9.0, "west": 4.0, "south": 7.0, "east": 6.0}, {"north": 1.0, "west": 0.0, "south": 0.0, "east": 1.0}][: {"bay": 1, "bays": 2}.get(n, 0)], {"mine": "tag:kept or ref:doc-7"}.__getitem__)
#: Operands by their text.
LEAVES = {
    "tag:kept": {"permanode": {"attr": "tag", "skipHidden": True, "value": "kept"}},
    "ref:doc-7": {"blobRefPrefix": "doc-7"},
    "has:location": {"permanode": {"location": {"any": True}}},
    "childrenof:album-3": {"permanode": {"relation": {"relation": "parent", "any": {"blobRefPrefix": "album-3"}}}},
    'title:"two words"': {"permanode": {"attr": "title", "skipHidden": True, "valueMatches": {"contains": "two words", "caseInsensitive": True}}},
}
KEPT, DOC, PLACED, CHILD, TITLED = LEAVES.values()


def tree(text):
    got = parse(text, WORDS)
    assert got["logical"]["a"] == BASE
    return got["logical"]["b"]


def both(*parts):
    out = parts[0]
    for p in parts[1:]:
        out = logical("and", out, p)
    return out


def either(*parts):
    out = parts[0]
    for p in parts[1:]:
        out = logical("or", out, p)
    return out


def without(a):
    return logical("not", a)


def random_tree(rng, depth):
    """A tree and a text of it in which every operation is in parentheses."""
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([(v, k) for k, v in LEAVES.items()])
    a, x = random_tree(rng, depth - 1)
    op = rng.choice(["and", "or", "beside", "not"])
    if op == "not":
        return without(a), rng.choice(["-", "- "]) + f"({x})"
    b, y = random_tree(rng, depth - 1)
    word = {"and": " and ", "or": " or ", "beside": rng.choice([" ", "\t", "  "])}[op]
    return (either if op == "or" else both)(a, b), f"({x}){word}({y})"


@pytest.mark.parametrize("seed", range(40))
def test_printed_trees_are_read_back(seed):
    rng = random.Random(seed)
    expected, text = random_tree(rng, 4)
    assert tree(text) == expected


@pytest.mark.parametrize("n", range(1, 6))
def test_chains_group_from_the_left(n):
    texts = list(LEAVES)[:n]
    for word, join in ((" and ", both), (" ", both), (" or ", either)):
        assert tree(word.join(texts)) == join(*(LEAVES[t] for t in texts))


def test_operations_without_parentheses():
    a, b, c, d, e = LEAVES
    assert tree(f"{a} {b} or {c}") == either(both(KEPT, DOC), PLACED)
    assert tree(f"{a} or {b} {c}") == either(KEPT, both(DOC, PLACED))
    # a second operand that only stands beside an alternative is another alternative
    assert tree(f"{a} or {b} {c} {d}") == either(KEPT, both(DOC, PLACED), CHILD)
    assert tree(f"{a} or {b} and {c} and {d} {e}") == either(KEPT, both(DOC, PLACED, CHILD), TITLED)
    assert tree(f"{a} or -{b} or {c} -{d}") == either(KEPT, without(DOC), both(PLACED, without(CHILD)))
    assert tree(f"-{a} -{b}") == both(without(KEPT), without(DOC))
    assert tree(f"-({a} or {b}) and({c})") == both(without(either(KEPT, DOC)), PLACED)
    for minus in range(5):
        assert tree("-" * minus + a) == (without(KEPT) if minus % 2 else KEPT)


def test_blank_is_the_base():
    assert parse(" \n ", WORDS) == BASE


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("sunset", "No support for literals yet at position 0"), ("tag:kept  or", "No support for literals"), ('tag:kept "red sky"', "No support for quoted literals yet at position 9"), ("-(tag:kept or (ref:doc-7)", "No matching closing parenthesis at position 1"),
        ("ref:doc-7) tag:kept", "No matching opening parenthesis"), ("tag:kept and", "No support for literals"), ("tag:kept and -", "Expected an atom"), ('title:"never closed', "Unclosed quote at position 6"), ("tag:kept :", "Predicates do not start with a colon"),
        ("locrect:1,2,3,4:5", 'Wrong number of arguments for "locrect", given 2, expected 1 at position 0, token: "locrect:1,2,3,4:5"'), ("tag:kept attr:colour", 'Wrong number of arguments for "attr", given 1, expected 2 at position 9'),
        ("height:3to4", 'Unable to parse "3to4" as range, wanted something like 480-1024, 480-, -1024 or 1024 at position 0'), ("before:yesterday", 'as "2006'), ("colour:red", "Unknown search predicate"), ("filename:x*y*z", "unsupported glob"),
        ("format:xyz", "Unknown format: xyz"), ("loc:atlantis", "No location found"), ("locrect:5,6", "got 2 coordinates"),
    ],
)
def test_errors(text, message):
    with pytest.raises(QueryError) as e:
        parse(text, WORDS)
    assert message in str(e.value)


def content(test):
    return {"permanode": {"attr": "camliContent", "valueInSet": {"file": test}}}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("attr:colour:", {"permanode": {"attr": "colour", "skipHidden": True, "valueMatches": {"empty": True}}}), ("attr:colour:~BLUE", {"permanode": {"attr": "colour", "valueMatches": {"contains": "BLUE", "caseInsensitive": True}}}),
        ('attr:note:"a \\"q\\" and a \\\\"', {"permanode": {"attr": "note", "skipHidden": True, "value": 'a "q" and a \\'}}), ("parentof:page-1", {"permanode": {"relation": {"relation": "child", "any": {"blobRefPrefix": "page-1"}}}}),
        ("loc:bay", {"permanode": {"location": {"north": 9.0, "west": 4.0, "south": 7.0, "east": 6.0}}}), ("loc:bays", either({"permanode": {"location": {"north": 9.0, "west": 4.0, "south": 7.0, "east": 6.0}}}, {"permanode": {"location": {"north": 1.0, "west": 0.0, "south": 0.0, "east": 1.0}}})),
        ("locrect:8.5,-3,2,4", {"permanode": {"location": {"north": 8.5, "west": -3.0, "south": 2.0, "east": 4.0}}}), ("named:mine", either(KEPT, DOC)),
        ("filename:notes*", content({"fileName": {"hasPrefix": "notes"}})), ("filename:*.csv", content({"fileName": {"hasSuffix": ".csv"}})), ("filename:*draft*", content({"fileName": {"contains": "draft"}})), ("filename:plan.txt", content({"fileName": {"equals": "plan.txt"}})),
        ("height:0-90", content({"isImage": True, "height": {"zeroMin": True, "max": 90}})), ("width:33", content({"isImage": True, "width": {"min": 33, "max": 33}})), ("format:image/webp", content({"mimeType": {"equals": "image/webp"}})),
    ],
)
def test_keywords(text, expected):
    assert tree(text) == expected


def test_ranges_and_time_prefixes():
    for low in ("", "0", "7", "1234567890"):
        for high in ("", "0", "12", "9876543210"):
            bound = lambda name, x: {} if not x else {f"zero{name.title()}": True} if x == "0" else {name: int(x)}
            assert _range(f"{low}-{high}") == bound("min", low) | bound("max", high)
    for bad in ("", "-3-", "12345678901", "1.5", "x-2"):
        with pytest.raises(QueryError):
            _range(bad)
    for text, full in (("1987", "1987-01-01T00:00:00"), ("1987-11", "1987-11-01T00:00:00"), ("1987-11-23", "1987-11-23T00:00:00")):
        assert time_of_prefix(text).isoformat() == f"{full}+00:00"


@pytest.mark.parametrize(
    ("constraint", "message"),
    [
        ({"claim": {}}, "ClaimConstraint"), ({"logical": {"op": "or", "a": {"anything": True}}}, "need both A and B"), ({"logical": {"op": "nor", "a": {"anything": True}}}, "unknown operation"), ({"logical": {"op": "not"}}, "need to set A"),
        ({"permanode": {"attr": "colour"}}, "requires also setting"), ({"permanode": {"attr": "colour", "numValue": {"zeroMin": True}}}, "matches everything"), ({"permanode": {"attr": "colour", "value": "blue", "numValue": {"zeroMax": True}}}, "matches nothing"),
        ({"permanode": {"relation": {"relation": "progeny", "any": {"anything": True}}}}, "parent"), ({"permanode": {"relation": {"relation": "parent"}}}, "exactly one"), ({"blobSize": {"min": 30, "max": 20}}, "greater"), ({"blobSize": {"zeroMin": True, "min": 20}}, "both ZeroMin and Min"),
        ({"dir": {"contains": {"camliType": "file"}}}, "supports only"), ({"dir": {"contains": {"blobRefPrefix": "z-1"}, "recursiveContains": {"blobRefPrefix": "z-2"}}}, "mutually exclusive"), ({"colour": 1}, "unknown field"), ({"blobRefPrefix": 1}, "cannot use"),
    ],
)
def test_validity(constraint, message):
    with pytest.raises(QueryError) as e:
        K.check(K.decode(constraint))
    assert message in str(e.value)


def test_source_choice():
    visible = {"permanode": {"skipHidden": True}}
    assert K.source_name(visible, "-created") == "corpus_permanode_created"
    assert K.source_name(visible, "-mod") == "corpus_permanode_lastmod"
    kind = {"permanode": {"attr": "camliNodeType", "value": "book"}}
    assert K.source_name(either(kind, kind) | {"camliType": "permanode"}, "blobref") == "corpus_permanode_types"
    assert K.source_name({"blobRefPrefix": "sha1-" + "9" * 40}, "") == "one_blob"
    assert K.source_name({"file": {"wholeRef": "sha1-" + "9" * 40}}, "") == "corpus_file_meta"
    assert K.source_name({"camliType": "file"}, "") == "corpus_blob_meta"
    assert K.source_name({"anything": True}, "") == "index_blob_meta"
    assert not K.only_permanodes(either(visible, visible)) and K.only_permanodes(both({"anything": True}, visible))
