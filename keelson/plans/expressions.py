"""Search expressions: words with keywords, joined by and, or, minus and parentheses."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from keelson.functions.scalar import go_text, time_of_prefix
from keelson.runtime import QueryError

Node = dict
_SPACE = "\t\n\f\v\r "


@dataclass(frozen=True)
class Token:
    kind: str  # and, or, not, open, close, word, quoted, atom, colon, error, end
    text: str
    start: int
    args: tuple[str, ...] = ()


def _fail(message: str, token: Token) -> QueryError:
    return QueryError(f"{message} at position {token.start}, token: {go_text(token.text)}")


def _unquote(text: str) -> str:
    escapes = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
    if re.search(r"\\(?![abfnrtv\\\"]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3})", text) or "\n" in text:
        raise QueryError("invalid syntax")

    def one(m: re.Match) -> str:
        e = m[1]
        return chr(int(e[1:], 16)) if e[0] in "xuU" else chr(int(e, 8)) if e[0] in "01234567" else escapes.get(e, e)

    return re.sub(r"\\(x..|u....|U........|[0-7]{3}|.)", one, text[1:-1])


_WORD = r"[^\s:()]*"
_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)


def tokens(text: str) -> list[Token]:
    """All tokens; 'and' and 'or' are operators only between operands and before a space or '('."""
    out: list[Token] = []
    at, operand_next = 0, True
    while True:
        while at < len(text) and text[at] in _SPACE:
            at += 1
        if at >= len(text):
            return [*out, Token("end", "", len(text))]
        c = text[at]
        if c == "(":
            out.append(Token("open", c, at))
            at, operand_next = at + 1, True
        elif c == ")":
            out.append(Token("close", c, at))
            at, operand_next = at + 1, False
        elif not operand_next and (m := re.compile(r"(and|or)(?=[\s(])").match(text, at)):
            out.append(Token(m[1], m[1], at))
            at, operand_next = m.end(), True
        elif c == "-":
            out.append(Token("not", c, at))
            at, operand_next = at + 1, True
        elif c == '"':
            m = _QUOTED.match(text, at)
            if not m:
                return [*out, Token("error", "Unclosed quote", at)]
            out.append(Token("quoted", m[0], at))
            at, operand_next = m.end(), False
        else:
            start, m = at, re.compile(r"([^\W\d_]*):").match(text, at)
            if not m:
                word = re.compile(_WORD).match(text, at)[0]
                if not word:  # a colon that follows no letters
                    out.append(Token("colon", c, at))
                    at += 1
                else:
                    out.append(Token("word", word, at))
                    at += len(word)
                operand_next = False
                continue
            if not m[1]:
                out.append(Token("colon", ":", at))
                at, operand_next = at + 1, False
                continue
            at, args = m.end(), []
            while True:
                if at < len(text) and text[at] == '"':
                    q = _QUOTED.match(text, at)
                    if not q:
                        return [*out, Token("error", "Unclosed quote", at)]
                    args.append(_unquote(q[0]))
                    at = q.end()
                else:
                    word = re.compile(_WORD).match(text, at)[0]
                    args.append(word)
                    at += len(word)
                if at < len(text) and text[at] == ":":
                    at += 1
                    continue
                break
            out.append(Token("atom", text[start:at], start, (m[1], *args)))
            operand_next = False


def logical(op: str, a: Node, b: Node | None = None) -> Node:
    return {"logical": {"op": op, "a": a} | ({"b": b} if b is not None else {})}


@dataclass
class Keywords:
    """Keywords by name. A handler gets the arguments and returns a constraint.

    ``arity`` 0 stands for a whole word such as is:image.
    """

    known: dict[tuple[str, int], tuple[Callable[..., Node], str]] = field(default_factory=dict)

    def register(self, name: str, arity: int, make: Callable[..., Node], help: str = "") -> None:
        self.known[name, arity] = make, help

    def resolve(self, token: Token) -> Node:
        name, *args = token.args
        whole = ":".join(token.args)
        if (whole, 0) in self.known:
            return self.known[whole, 0][0]()
        counts = [n for k, n in self.known if k == name and n > 0]
        if not counts:
            raise _fail(f"Unknown search predicate: {go_text(token.text)}", token)
        if len(args) not in counts:
            raise _fail(f'Wrong number of arguments for "{name}", given {len(args)}, expected {counts[0]}', token)
        try:
            return self.known[name, len(args)][0](*args)
        except QueryError as e:
            raise _fail(str(e), token) from None

    def descriptions(self) -> list[tuple[str, str]]:
        return [(name, text) for (name, _), (_, text) in self.known.items()]


class _Parser:
    """Operands joined by 'and', or by standing side by side, until the first 'or'.

    After an 'or', alternatives follow: an operand and at most one that stands
    beside it, each with further ones joined by a written 'and'. A further operand
    that only stands beside starts another alternative.
    """

    def __init__(self, text: str, keywords: Keywords):
        self.tokens, self.at, self.keywords = tokens(text), 0, keywords

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def skip(self, kind: str) -> bool:
        found = self.now.kind == kind
        self.at += found
        return found

    def expression(self) -> Node | None:
        if self.now.kind == "end":
            return None
        tree = self.operand()
        while self.now.kind not in ("close", "end"):
            if self.skip("or"):
                return self.alternatives(tree)
            self.skip("and")
            tree = logical("and", tree, self.operand())
        return tree

    def alternatives(self, tree: Node) -> Node:
        while True:
            tree = logical("or", tree, self.alternative())
            if not self.skip("or") and self.now.kind in ("and", "close", "end"):
                return tree

    def alternative(self) -> Node:
        tree = self.operand()
        if self.now.kind not in ("or", "close", "end"):
            self.skip("and")
            tree = logical("and", tree, self.operand())
            while self.skip("and"):
                tree = logical("and", tree, self.operand())
        return tree

    def operand(self) -> Node:
        negative = False
        while self.skip("not"):
            negative = not negative
        token = self.now
        self.at += token.kind != "end"
        if token.kind == "open":
            tree = self.expression()
            if not self.skip("close"):
                raise _fail("No matching closing parenthesis", token)
            if tree is None:
                raise _fail("Expected an atom", token)
        elif token.kind == "atom":
            tree = self.keywords.resolve(token)
        else:
            messages = {"error": token.text, "end": "Expected an atom", "close": "No matching opening parenthesis", "word": "No support for literals yet", "quoted": "No support for quoted literals yet", "colon": "Predicates do not start with a colon"}
            raise _fail(messages.get(token.kind, "Expected an atom"), token)
        return logical("not", tree) if negative else tree


BASE: Node = {"permanode": {"skipHidden": True}}


def parse(text: str, keywords: Keywords) -> Node:
    """The constraint of an expression, always within visible objects."""
    text = text.strip()
    if not text:
        return BASE
    p = _Parser(text, keywords)
    tree = p.expression()
    if p.now.kind != "end":
        raise _fail("No matching opening parenthesis" if p.now.kind == "close" else "After parsing finished there is still input left", p.now)
    return BASE if tree is None else logical("and", BASE, tree)


def _attr(name: str, value: str) -> Node:
    test = {"value": value} if value else {"valueMatches": {"empty": True}}
    return {"permanode": {"attr": name, "skipHidden": True} | test}


def _file(c: Node) -> Node:
    return {"permanode": {"attr": "camliContent", "valueInSet": {"file": c}}}


def _range(text: str) -> Node:
    m = re.fullmatch(r"(\d{0,10})-(\d{0,10})", text) or re.fullmatch(r"(\d{1,10})", text)
    if not m:
        raise QueryError(f"Unable to parse {go_text(text)} as range, wanted something like 480-1024, 480-, -1024 or 1024")
    out: Node = {}
    for bound, zero, digits in (("min", "zeroMin", m[1]), ("max", "zeroMax", m[m.lastindex])):
        if digits == "0":
            out[zero] = True
        elif digits:
            out[bound] = int(digits)
    return out


#: Short names of formats.
FORMATS = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "png": "image/png", "pdf": "application/pdf"}


def _format(name: str) -> Node:
    mime = name if "/" in name else FORMATS.get(name)
    if mime is None:
        raise QueryError(f"Unknown format: {name}")
    return _file({"mimeType": {"equals": mime}})


def _filename(glob: str) -> Node:
    inner = glob.removeprefix("*").removesuffix("*") if len(glob) > 1 else glob.removeprefix("*")
    if "*" in inner:
        raise QueryError("unsupported glob wildcard in filename search predicate")
    if "*" not in glob:
        test = {"equals": glob}
    elif glob.startswith("*") and "*" not in glob[1:]:
        test = {"hasSuffix": inner}
    elif glob.startswith("*"):
        test = {"contains": inner}
    else:
        test = {"hasPrefix": inner}
    return _file({"fileName": test})


def _rectangle(text: str) -> Node:
    parts = text.split(",")
    if len(parts) != 4:
        raise QueryError(f"got {len(parts)} coordinates for location area, expected 4")
    try:
        n, w, s, e = map(float, parts)
    except ValueError as error:
        raise QueryError(f"could not convert location area coordinate as a float: {error}") from None
    return {"permanode": {"location": {"north": n, "west": w, "south": s, "east": e}}}


def _attribute(name: str, value: str) -> Node:
    if value.startswith("~"):
        return {"permanode": {"attr": name, "valueMatches": {"contains": value[1:], "caseInsensitive": True}}}
    return _attr(name, value)


def _with(name: str) -> Node:
    part = {"contains": name, "caseInsensitive": True}
    named = logical("or", {"permanode": {"attr": "givenName", "valueMatches": part}}, {"permanode": {"attr": "familyName", "valueMatches": part}})
    person = {"permanode": {"attr": "camliNodeType", "value": "foursquare.com:person"}}
    return {"permanode": {"attr": "with", "skipHidden": True, "valueInSet": logical("and", person, named)}}


def default_keywords(gazetteer: Callable[[str], list[dict]] | None = None, named: Callable[[str], str] | None = None) -> Keywords:
    """The core keywords. ``gazetteer`` gives rectangles of a place name; ``named`` stored searches."""
    k = Keywords()
    k.register("after", 1, lambda t: {"permanode": {"time": {"after": time_of_prefix(t)}}}, "objects of this time or later; a year, month or day is enough")
    k.register("before", 1, lambda t: {"permanode": {"time": {"before": time_of_prefix(t)}}}, "objects of an earlier time; a year, month or day is enough")
    k.register("attr", 2, _attribute, "objects with this value of an attribute; ~ before the value finds parts of values in any case")
    k.register("childrenof", 1, lambda p: {"permanode": {"relation": {"relation": "parent", "any": {"blobRefPrefix": p}}}}, "members of the objects whose reference begins so")
    k.register("parentof", 1, lambda p: {"permanode": {"relation": {"relation": "child", "any": {"blobRefPrefix": p}}}}, "objects of which one whose reference begins so is a member")
    k.register("format", 1, _format, "objects with a file of a type, by a short name or in full")
    k.register("tag", 1, lambda t: _attr("tag", t), "objects with this tag")
    k.register("title", 1, lambda s: {"permanode": {"attr": "title", "skipHidden": True, "valueMatches": {"contains": s, "caseInsensitive": True}}}, "objects whose title has this in it, in any case")
    k.register("ref", 1, lambda p: {"blobRefPrefix": p}, "objects whose reference begins so")
    k.register("is:image", 0, lambda: _file({"isImage": True}), "objects with a picture")
    k.register("height", 1, lambda r: _file({"isImage": True, "height": _range(r)}), "pictures with so many pixels from top to bottom; either end of a range may be left out")
    k.register("is:landscape", 0, lambda: _file({"isImage": True, "widthHeightRation": {"min": 1.0}}), "pictures that are at least as wide as high")
    k.register("is:pano", 0, lambda: _file({"isImage": True, "widthHeightRation": {"min": 2.0}}), "pictures that are at least twice as wide as high")
    k.register("is:portrait", 0, lambda: _file({"isImage": True, "widthHeightRation": {"max": 1.0}}), "pictures that are at least as high as wide")
    k.register("width", 1, lambda r: _file({"isImage": True, "width": _range(r)}), "pictures with so many pixels from left to right; either end of a range may be left out")
    k.register("filename", 1, _filename, "objects with a file of this name; a * at an end stands for anything")
    k.register("is:post", 0, lambda: _attr("camliNodeType", "twitter.com:tweet"), "short messages")
    k.register("is:like", 0, lambda: _attr("camliNodeType", "twitter.com:like"), "short messages that somebody liked")
    k.register("is:checkin", 0, lambda: _attr("camliNodeType", "foursquare.com:checkin"), "visits of places")
    k.register("is:untagged", 0, lambda: logical("not", {"permanode": {"attr": "tag", "skipHidden": True, "valueMatches": {"byteLength": {"min": 1}}}}), "objects that have no tag, or only blank ones")
    k.register("has:location", 0, lambda: {"permanode": {"location": {"any": True}}}, "objects whose place is known")

    def located(name: str) -> Node:
        boxes = gazetteer(name) if gazetteer else []
        if not boxes:
            raise QueryError(f"No location found for {go_text(name)}")
        tree: Node | None = None
        for box in boxes:
            one = {"permanode": {"location": box}}
            tree = one if tree is None else logical("or", tree, one)
        return tree

    k.register("loc", 1, located, 'objects in a place with this name; names of several words go into quotes')
    k.register("locrect", 1, _rectangle, "objects in a rectangle: its north, west, south and east ends, with commas")
    k.register("with", 1, _with, "objects with people whose given or family name has this in it")
    if named:
        k.register("named", 1, lambda n: parse_inner(named(n), k), "what a search kept under this name finds")
    return k


def parse_inner(text: str, keywords: Keywords) -> Node:
    """The constraint of a stored search, without the base."""
    p = _Parser(text.strip(), keywords)
    tree = p.expression()
    if tree is None or p.now.kind != "end":
        raise QueryError(f"cannot use stored search {go_text(text)}")
    return tree
