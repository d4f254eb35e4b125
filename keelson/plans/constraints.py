"""Constraint trees in their JSON form: strict decoding and validity."""

from __future__ import annotations

import json
from typing import Any

from keelson.functions.scalar import time_of_prefix
from keelson.runtime import QueryError

MAX_QUERY_BYTES = 1 << 20

#: Fields by kind of node; a kind's name, or a type's.
NODES: dict[str, dict[str, str]] = {
    "constraint": {"logical": "logical", "anything": "bool", "camliType": "str", "anyCamliType": "bool", "blobRefPrefix": "str", "file": "file", "dir": "dir", "claim": "claim", "blobSize": "int", "permanode": "permanode"},
    "logical": {"op": "str", "a": "constraint", "b": "constraint"},
    "file": {"fileSize": "int", "fileName": "string", "mimeType": "string", "time": "time", "modTime": "time", "wholeRef": "str", "parentDir": "dir", "isImage": "bool", "exif": "exif", "width": "int", "height": "int", "widthHeightRation": "float", "location": "location", "mediaTag": "mediatag"},
    "mediatag": {"tag": "str", "string": "string", "int": "int"},
    "dir": {"fileName": "string", "blobRefPrefix": "str", "parentDir": "dir", "topFileCount": "int", "recursiveContains": "constraint", "contains": "constraint"},
    "int": {"min": "number", "max": "number", "zeroMin": "bool", "zeroMax": "bool", "equals": "number"},
    "float": {"min": "number", "max": "number", "zeroMin": "bool", "zeroMax": "bool"},
    "string": {"empty": "bool", "equals": "str", "contains": "str", "hasPrefix": "str", "hasSuffix": "str", "byteLength": "int", "caseInsensitive": "bool", "regexp": "str"},
    "time": {"before": "moment", "after": "moment", "inLast": "number"},
    "location": {"any": "bool", "north": "number", "south": "number", "west": "number", "east": "number"},
    "claim": {"signedBy": "str", "signedAfter": "moment", "signedBefore": "moment"},
    "exif": {},
    "permanode": {"at": "moment", "modTime": "time", "time": "time", "attr": "str", "skipHidden": "bool", "numValue": "int", "valueAllMatch": "bool", "value": "str", "valueMatches": "string", "valueMatchesInt": "int", "valueMatchesFloat": "float", "valueInSet": "constraint", "relation": "relation", "location": "location"},
    "relation": {"relation": "str", "edgeType": "str", "any": "constraint", "all": "constraint"},
    "query": {"expression": "str", "constraint": "constraint", "limit": "number", "sort": "sort", "around": "str", "continue": "str", "describe": "any"},
}
#: Sort orders by name.
SORTS = ("unsorted", "-mod", "mod", "-created", "created", "blobref", "map")
VALUE_TESTS = ("value", "valueMatches", "valueMatchesInt", "valueMatchesFloat", "valueInSet")
_PLAIN = {"bool": bool, "str": str, "number": (int, float)}


def decode(value: Any, kind: str = "constraint") -> Any:
    """A checked copy of decoded JSON: unknown fields and wrong types are refused, zero values dropped."""
    if kind in _PLAIN:
        if not isinstance(value, _PLAIN[kind]) or (kind == "number" and isinstance(value, bool)):
            raise QueryError(f"cannot use {value!r} as {kind}")
        return value
    if kind == "moment":
        return value if hasattr(value, "year") else time_of_prefix(value) if value else None
    if kind == "sort":
        name = value or ""
        if name and name not in SORTS:
            raise QueryError("invalid sort type")
        return name
    if kind == "any":
        return value
    if not isinstance(value, dict):
        raise QueryError(f"cannot use {value!r} as {kind}")
    fields = NODES[kind]
    for name in value:
        if name not in fields:
            raise QueryError(f'json: unknown field "{name}"')
    out = {name: decode(v, fields[name]) for name, v in value.items() if v is not None}
    return {k: v for k, v in out.items() if v not in ("", None) and (v is not False) and not (v == 0 and k != "equals" and not isinstance(v, (bool, dict)))}


def from_json(text: str | bytes, kind: str = "query") -> dict:
    if len(text if isinstance(text, bytes) else text.encode()) > MAX_QUERY_BYTES:
        raise QueryError("query is larger than 1 MiB")
    try:
        return decode(json.loads(text), kind)
    except json.JSONDecodeError as e:
        raise QueryError(str(e)) from None


def check(c: dict) -> None:
    """Raise unless the constraint is valid, with all below it."""
    if "claim" in c:
        raise QueryError("a ClaimConstraint is not supported")
    _range(c.get("blobSize"), "IntConstraint")
    if (node := c.get("logical")) is not None:
        _logical(node)
    if (node := c.get("file")) is not None:
        _file(node)
    if (node := c.get("dir")) is not None:
        _dir(node)
    if (node := c.get("permanode")) is not None:
        _permanode(node)


def _range(c: dict | None, name: str) -> None:
    if c is None:
        return
    if c.get("zeroMin") and c.get("min"):
        raise QueryError(f"in {name}, can't set both ZeroMin and Min")
    if c.get("zeroMax") and c.get("max"):
        raise QueryError(f"in {name}, can't set both ZeroMax and Max")
    low = c.get("min", 0 if c.get("zeroMin") else None)
    high = c.get("max", 0 if c.get("zeroMax") else None)
    if low is not None and high is not None and low > high:
        raise QueryError(f"in {name}, min is greater than max")


def _logical(c: dict) -> None:
    if "a" not in c:
        raise QueryError("In LogicalConstraint, need to set A")
    check(c["a"])
    op = c.get("op", "")
    if op in ("and", "or", "xor"):
        if "b" not in c:
            raise QueryError("In LogicalConstraint, need both A and B set")
        check(c["b"])
    elif op != "not":
        raise QueryError(f'In LogicalConstraint, unknown operation "{op}"')


def _file(c: dict) -> None:
    for name in ("fileSize", "width", "height"):
        _range(c.get(name), "IntConstraint")
    _range(c.get("widthHeightRation"), "FloatConstraint")
    if "parentDir" in c:
        _dir(c["parentDir"])


def _dir(c: dict) -> None:
    if "contains" in c and "recursiveContains" in c:
        raise QueryError("Contains and RecursiveContains in a DirConstraint are mutually exclusive")
    _range(c.get("topFileCount"), "IntConstraint")
    if "parentDir" in c:
        _dir(c["parentDir"])
    inner = c.get("contains") or c.get("recursiveContains")
    if inner:
        if not set(inner) <= {"file", "dir", "logical", "blobRefPrefix"}:
            raise QueryError("(Recursive)Contains supports only a reference prefix, file, dir or logical constraint")
        check(inner)


def _permanode(c: dict) -> None:
    tests = [t for t in VALUE_TESTS if t in c]
    if "attr" in c:
        number = c.get("numValue")
        if number is None and not tests:
            raise QueryError("PermanodeConstraint with Attr requires also setting NumValue or a value-matching constraint")
        if number is not None:
            if number.get("zeroMin"):
                raise QueryError("NumValue with ZeroMin makes no sense; matches everything")
            if number.get("zeroMax") and tests:
                raise QueryError("NumValue with ZeroMax makes no sense in conjunction with a value-matching constraint; matches nothing")
            if number.get("min", 0) < 0 or number.get("max", 0) < 0:
                raise QueryError("NumValue with negative Min or Max makes no sense")
            _range(number, "IntConstraint")
    _range(c.get("valueMatchesInt"), "IntConstraint")
    _range(c.get("valueMatchesFloat"), "FloatConstraint")
    if "valueInSet" in c:
        check(c["valueInSet"])
    relation = c.get("relation")
    if relation is not None:
        if relation.get("relation") not in ("parent", "child"):
            raise QueryError('only RelationConstraint.Relation of "parent" or "child" is currently supported')
        if ("any" in relation) == ("all" in relation):
            raise QueryError("exactly one of RelationConstraint Any or All must be defined")
        check(relation.get("any") or relation["all"])


def only_permanodes(c: dict) -> bool:
    """Whether the constraint can match objects only; alternatives are not looked into."""
    if "permanode" in c or c.get("camliType") == "permanode":
        return True
    logical = c.get("logical")
    return bool(logical) and logical.get("op") == "and" and (only_permanodes(logical["a"]) or only_permanodes(logical["b"]))


def node_types(c: dict) -> list[str]:
    """Values of camliNodeType outside of which nothing can match; none if that is not known."""
    p = c.get("permanode")
    if p and p.get("attr") == "camliNodeType" and "value" in p and "at" not in p:
        return [p["value"]]
    logical = c.get("logical")
    if logical and logical.get("op") in ("and", "or") and "b" in logical:
        a, b = node_types(logical["a"]), node_types(logical["b"])
        if logical["op"] == "or":
            return a + b if a and b else []
        return a or b
    return []


def single_ref(c: dict) -> str | None:
    prefix = c.get("blobRefPrefix", "")
    name, _, digits = prefix.partition("-")
    if len(digits) == {"sha1": 40, "sha224": 56, "sha256": 64}.get(name):
        return prefix
    logical = c.get("logical")
    if logical and logical.get("op") == "and":
        return single_ref(logical["a"]) or single_ref(logical["b"])
    return None


def by_whole_ref(c: dict) -> bool:
    if c.get("file", {}).get("wholeRef"):
        return True
    logical = c.get("logical")
    return bool(logical) and logical.get("op") == "and" and (by_whole_ref(logical["a"]) or by_whole_ref(logical["b"]))


def source_name(c: dict, sort: str) -> str:
    """Which rows the search starts from."""
    if only_permanodes(c):
        if sort in ("-mod", "-created"):
            return "corpus_permanode_lastmod" if sort == "-mod" else "corpus_permanode_created"
        if node_types(c):
            return "corpus_permanode_types"
    if single_ref(c):
        return "one_blob"
    if by_whole_ref(c):
        return "corpus_file_meta"
    if c.get("anyCamliType") or c.get("camliType"):
        return "corpus_blob_meta"
    return "index_blob_meta"
