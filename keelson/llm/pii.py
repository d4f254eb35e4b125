"""Surrogates for personal data, keyed, consistent and free of collisions.

Detected entities (mail, phone, card, IP, national number, bank account, secret,
person after a title) are replaced by keyed surrogates of the same kind and
format: digits by digits, letters by letters of the same case and script, cards
and accounts with right check digits, given names by names with an ending of the
title's gender, all names in the script of the original. An entity is made of
parts that have surrogates of their own: a mail address of its domain and of the
name in it, a person of given and family names. So all addresses of a domain keep
one domain, and a person is the same with any title of one gender, with the family
name alone, and - in a text where a title tells that it is a name - without title.
A given name after a neutral title has the gender that this name has elsewhere in
the text or else in the corpus, if that is one alone.

One part, however it is written, has one surrogate in the whole corpus. A collision
check over the distinct parts redraws a surrogate that another part also drew or
that is itself a part in the corpus, until none is left; given and family names
must not meet either. Lengths are those of the originals, unless eight draws
failed: then each eight draws make the form longer by one, so that the redraws end
where a form has no free value left. Tasks compute first draws themselves; only
parts that are redrawn or that stand for another travel.

Defined results: a null text stays null and an empty one empty, with no
entities. Equal texts get equal results.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm import common as C

#: Titles by the gender that they tell.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "г-жа", "Госпожа", "Κυρία"),
    "n": ("Mx", "Dr", "Prof"),
}
#: Titles that stand before a given name.
GIVEN_TITLES = ("Don", "Doña")
#: Endings of surrogate given names by script and gender ("n": told by no title).
ENDINGS = {
    "latin": {"m": ("o", "us", "an", "el", "or", "ik", "ard", "en"), "f": ("a", "ia", "ina", "elle", "is", "ette", "ane", "ora"), "n": ("i", "e", "y", "ey")},
    "cyrillic": {"m": ("ан", "ин", "ор", "ий", "ей", "ил", "ет", "ас"), "f": ("а", "я", "ия", "ина", "ела", "ора", "ика", "ета"), "n": ("и", "е", "у", "о")},
    "greek": {"m": ("ος", "ας", "ης", "ων", "ιος", "ικος"), "f": ("α", "η", "ια", "ω", "ινα", "ουλα"), "n": ("ι", "υ", "ε", "ου")},
}
#: Syllables of which surrogate family names are made.
SYLLABLES = {
    "latin": "ba be bo da de do fa fi ga go ka ke la le lo ma me mi na ne no pa pe ra re ro sa se ta te to va".split(),
    "cyrillic": "ба бе бо да де до ва ви га го ка ке ла ле ло ма ме ми на не но па пе ра ре ро са се та те то за".split(),
    "greek": "βα βε βο δα δε δο φα φι γα γο κα κε λα λε λο μα με μι να νε νο πα πε ρα ρε ρο σα σε τα τε το ζα".split(),
}
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ][\w'’-]+"
_WORD = re.compile(rf"(?<!\w){_NAME}")
#: What a name may end in that is not part of it: genitives and dashes.
_TAIL = re.compile(r"(?:['’]\w{0,2}|[-'’]+)$")
_TITLE = "|".join(re.escape(t) for g in TITLES.values() for t in g)

#: The part of a mail address from the @ on, and the part before it, read backwards.
_DOMAIN = re.compile(r"@\w[\w-]*(?:\.\w[\w-]*)+")
_LOCAL = re.compile(r"\w[\w.+-]*")
#: All kinds but mail addresses, whose search starts at the @.
PATTERNS = (
    ("secret", re.compile(r"(?<![^\W_])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z_-]{20,})(?![^\W_])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?!\w|\.\d)")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.])(?:(?:\+?1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|(?:\+?1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11})(?!\w)")),
    ("person", re.compile(rf"(?<!\w)({_TITLE})\.? ({_NAME}(?: {_NAME}){{0,2}})")),
)

#: What secrets that need not be hex begin with, and titles as they stand before a name.
_MARKS = tuple(m.encode() for m in ("AKIA", "ASIA", *(f"gh{c}_" for c in "pousr"), "sk-", *(f"{t}{stop} " for g in TITLES.values() for t in g for stop in ("", "."))))
#: First bytes of digits that are not ASCII: both of two, or three; planes from 2 on have none.
_DIGIT_HEADS = np.array(sorted({int.from_bytes(chr(c).encode()[:3], "big") for c in range(0x80, 0x20000) if chr(c).isdecimal()}))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban_check(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def script(word: str) -> str:
    return next((s for lo, hi, s in ((0x370, 0x3FF, "greek"), (0x1F00, 0x1FFF, "greek"), (0x400, 0x52F, "cyrillic")) if lo <= ord(word[0]) <= hi), "latin")


def mails(text: str) -> Iterator[tuple[int, int]]:
    """Places of mail addresses; the time is linear in the text, however long its words are."""
    end = 0
    for m in _DOMAIN.finditer(text):
        low = max(end, text.rfind("@", end, m.start()) + 1)
        local = _LOCAL.match(text[low : m.start()][::-1])
        if local:
            end = m.end()
            yield m.start() - local.end(), end


Part = tuple[int, int, str, str]


def entities(text: str) -> list[tuple[int, int, str, list[Part]]]:
    """(start, end, kind, parts) of entities that do not overlap, by place.

    Parts are (start, end, kind, canonical form). Of overlapping candidates the
    one whose kind comes first stays: mail addresses, then in the order of
    PATTERNS. Canonical forms of given names have gender, script and name, those of
    family names script and name.
    """
    found: list[tuple[int, int, str, list[Part]]] = []
    for s, e in mails(text):
        at = text.index("@", s)
        domain = text[at + 1 : e].lower()
        found.append((s, e, "email", [(s, at, "local", f"{text[s:at].lower()}@{domain}"), (at + 1, e, "domain", domain)]))

    def place(s: int, e: int, kind: str, parts: list[Part]) -> None:
        i = bisect_left(found, (s,))
        if (i == 0 or found[i - 1][1] <= s) and (i == len(found) or found[i][0] >= e):
            found.insert(i, (s, e, kind, parts))

    titled = []
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text):
            if kind == "person":
                titled.append(m)
                continue
            s, e = m.span()
            value = text[s:e]
            bare = re.sub(r"\D", "", value)
            if kind == "card":
                if not (13 <= len(bare) <= 19 and luhn(bare)):
                    continue
                canon = bare
            elif kind == "iban":
                canon = value.replace(" ", "")
                if not 15 <= len(canon) <= 34 or iban_check(canon) != 1:
                    continue
            elif kind == "phone":
                if not 7 <= len(bare) <= 15:
                    continue
                canon = bare[-10:] if len(bare) == 11 and bare[0] == "1" else bare
            elif kind == "secret":
                if value.isdigit():
                    continue
                canon = value
            else:
                canon = value if kind == "ip" else bare
            place(s, e, kind, [(s, e, kind, canon)])
    if titled:
        for s, e, parts in persons(text, titled):
            place(s, e, "person", parts)
    return found


def _name(m: re.Match, base: int = 0) -> tuple[int, int, str]:
    """Start, end and common form of a name without what it may end in."""
    core = _TAIL.sub("", m[0]) or m[0]
    return base + m.start(), base + m.start() + len(core), core.capitalize()


def persons(text: str, titled: list[re.Match]) -> Iterator[tuple[int, int, list[Part]]]:
    """Persons after titles, and the same names wherever they stand in the text."""
    mentions = []
    genders: dict[str, set[str]] = {}
    families: set[str] = set()
    for m in titled:
        gender = next(g for g, t in TITLES.items() if m[1] in t)
        names = [_name(w, m.start(2)) for w in _WORD.finditer(m[2])]
        mentions.append((gender, names, m[1] in GIVEN_TITLES))
        if len(names) > 1:
            families.add(names[-1][2])
        for _, _, name in names[:-1] if len(names) > 1 else names if m[1] in GIVEN_TITLES else ():
            genders.setdefault(name, set()).add(gender)

    def given(s: int, e: int, name: str, gender: str = "n") -> Part:
        known = genders.get(name, set()) - {"n"}
        gender = next(iter(known)) if gender == "n" and len(known) == 1 else gender
        return s, e, "given", f"{gender}/{script(name)}/{name}"

    def family(s: int, e: int, name: str) -> Part:
        return s, e, "family", f"{script(name)}/{name}"

    out = []
    for gender, names, before_given in mentions:
        if len(names) > 1:
            parts = [*(given(*n, gender) for n in names[:-1]), family(*names[-1])]
        elif before_given or (names[0][2] in genders and names[0][2] not in families):
            parts = [given(*names[0], gender)]
        else:
            parts = [family(*names[0])]
            families.add(names[0][2])
        out.append((parts[0][0], parts[-1][1], parts))
    yield from out
    run: list[tuple[int, int, str]] = []
    for w in [*_WORD.finditer(text), None]:  # names that stand without a title
        name = _name(w) if w else None
        if name and name[2] not in genders and name[2] not in families:
            name = None
        if run and not (name and name[0] == run[-1][1] + 1 and text[run[-1][1]] == " "):
            last = len(run) - 1
            parts = [family(*n) if n[2] in families and (k == last or n[2] not in genders) else given(*n) for k, n in enumerate(run)]
            yield run[0][0], run[-1][1], parts
            run = []
        if name:
            run.append(name)


class Stream:
    """Numbers drawn from a key and a message."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.message, self.n, self.pool = key, "\0".join(parts).encode(), 0, 0
        self.left = 0

    def below(self, k: int) -> int:
        if self.left < 64:
            block = hmac.new(self.key, self.message + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.pool, self.left, self.n = int.from_bytes(block, "big"), 256, self.n + 1
        got, self.pool, self.left = self.pool & 0xFFFFFFFFFF, self.pool >> 40, self.left - 40
        return got % k


def _letters(value: str, draw: Stream) -> str:
    """Digits become digits and letters letters of the same case and script; the rest stays."""
    out = []
    for c in value:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            first, n = {"latin": (97, 26), "cyrillic": (0x430, 32), "greek": (0x3B1, 17)}[script(c)]
            new = chr(first + draw.below(n))
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """Canonical form of the part's replacement; other attempts give other draws, each eight a longer one."""
    draw, more = Stream(key, kind, canon, str(attempt)), attempt // 8

    def digits(n: int) -> str:
        return "".join(str(draw.below(10)) for _ in range(n))

    if kind == "local":
        return _letters(canon.partition("@")[0] + "a" * more, draw)
    if kind == "domain":
        host, dot, top = canon.rpartition(".")
        return f"{_letters(host + 'a' * more, draw)}{dot}{top}"
    if kind == "card":
        body = canon[0] + digits(min(19, len(canon) + more) - 2)
        return next(body + d for d in "0123456789" if luhn(body + d))
    if kind == "iban":
        body = _letters(canon[4:], draw) + digits(min(more, 34 - len(canon)))
        return f"{canon[:2]}{98 - iban_check(canon[:2] + '00' + body):02d}{body}"
    if kind == "ip":
        if more:  # no free address of the short form was found
            return "2001:db8:" + ":".join(f"{draw.below(65536):x}" for _ in range(6))
        return ".".join(str(x) for x in (1 + draw.below(223), draw.below(256), draw.below(256), 1 + draw.below(254)))
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canon):
            new = "".join("0123456789abcdef"[draw.below(16)] for _ in range(len(canon) + more))
            return new.upper() if canon == canon.upper() else new
        head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|", canon)[0]
        return head + _letters(canon[len(head) :] + "a" * more, draw)
    if kind == "family":
        return "".join(SYLLABLES[canon.split("/")[0]][draw.below(32)] for _ in range(4 + more)).capitalize()
    if kind == "given":
        gender, alphabet, _ = canon.split("/", 2)
        ends = ENDINGS[alphabet][gender]
        return ("".join(SYLLABLES[alphabet][draw.below(32)] for _ in range(2 + more)) + ends[draw.below(len(ends))]).capitalize()
    start = canon[:1] * (kind == "phone" and len(canon) > 10)
    return start + digits(len(canon) - len(start) + more)


def rendered(kind: str, found: str, new: str) -> str:
    """The replacement in the form in which the part was written."""
    if kind in ("given", "family"):
        return new.upper() if found.isupper() else new
    if kind in ("card", "ssn", "phone", "iban"):
        left = list(new)
        skip = sum(c.isalnum() for c in found) - len(new)  # a country code that is not part of the canonical form
        out = []
        for c in found:
            if c.isalnum() and skip > 0:
                skip -= 1
                out.append(c)
            else:
                out.append(left.pop(0) if c.isalnum() else c)
        return "".join(out + left)
    if kind in ("local", "domain") and found != found.lower():
        return "".join(n.upper() if f.isupper() else n for f, n in zip(found, new, strict=True)) if len(found) == len(new) else new
    return new


def replace(text: str, key: bytes, changes: dict[tuple[str, str], tuple[str, int]], cache: dict | None = None) -> tuple[str, list[tuple[int, int, str, list[Part]]]]:
    """The text with surrogates, and what was replaced; ``changes`` has (canonical form, attempt) of parts that do not have the first draw of their own."""
    found, out, at = entities(text), [], 0
    for _, _, _, parts in found:
        for s, e, kind, canon in parts:
            tried = (kind, *changes.get((kind, canon), (canon, 0)))
            new = cache.get(tried) if cache is not None else None
            if new is None:
                new = surrogate(key, *tried)
                if cache is not None and len(cache) < 100_000:
                    cache[tried] = new
            out += [text[at:s], rendered(kind, text[s:e], new)]
            at = e
    return "".join(out) + text[at:], found


def _holds(raw: bytes, offs: np.ndarray, mark: bytes) -> Iterator[int]:
    """Documents that hold ``mark``; what lies across a boundary does not count."""
    at = raw.find(mark)
    while at >= 0:
        d = int(np.searchsorted(offs, at, side="right")) - 1
        end = int(offs[d + 1])
        if at + len(mark) <= end:
            yield d
        at = raw.find(mark, end)


def _suspects(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Documents that may hold an entity: each pattern needs one of these.

    Mail an @; phone, card and national number seven digits; IP three times a dot
    between digits; account two capitals and two digits; secret a head or 32 hex
    characters in a row, thus an aligned block of 16; person a title. Digits that
    are not ASCII, which patterns also take, suffice alone.
    """
    padded = np.concatenate((buf, np.zeros(3, np.uint8)))
    digit, upper = (padded >= 48) & (padded <= 57), (padded >= 65) & (padded <= 90)
    dotted = digit[:-3] & (padded[1:-2] == 46) & digit[2:-1]
    sure = (C.per_doc_sum(digit[:-3], offs) >= 7) | (C.per_doc_sum(buf == 64, offs) > 0) | (C.per_doc_sum(dotted, offs) >= 3)
    letter = padded | 32
    hexes = (digit | (letter >= 97) & (letter <= 102))[: len(buf) // 16 * 16].reshape(-1, 16).all(axis=1)
    heads = np.flatnonzero(buf >= 0xC2)
    two = padded[heads].astype(np.int64) << 8 | padded[heads + 1]
    heads = heads[np.isin(two, _DIGIT_HEADS) | np.isin(two << 8 | padded[heads + 2], _DIGIT_HEADS)]
    for at in (np.flatnonzero(upper[:-3] & upper[1:-2] & digit[2:-1] & digit[3:]), 16 * np.flatnonzero(hexes), heads):
        sure[np.searchsorted(offs, at, side="right") - 1] = True
    raw = buf.tobytes()
    for mark in _MARKS:
        for d in _holds(raw, offs, mark):
            sure[d] = True
    return np.flatnonzero(sure)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, np.ndarray]]:
    for batch, buf, offs in C.slices(batches):
        at = _suspects(buf, offs)
        yield batch, batch.column(1).to_pylist(), at


def find_entities(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, canon): the distinct parts of entities of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text, at in _each(batches):
            ids = batch.column(0).to_pylist()
            rows = [(ids[i], *x) for i in at for x in sorted({(k, c) for found in entities(text[i] or "") for _, _, k, c in found[3]})]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "kind", "canon"])

    return docs.mapInArrow(run, "doc_id long, kind string, canon string")


#: Kinds of parts that are compared with each other.
_NAMES = ("given", "family")


def _group(kind: str) -> Column:
    return F.when(F.col(kind).isin(*_NAMES), "name").otherwise(F.col(kind))


def same_persons(known: DataFrame) -> DataFrame:
    """(kind, canon, entity) of given names without gender that one gender alone has, and the name of this gender."""
    neutral = F.col("canon").startswith("n/")
    names = known.where("kind = 'given'").groupBy("kind", F.substring_index("canon", "/", -2).alias("name"))
    names = names.agg(F.min(F.when(neutral, F.col("canon"))).alias("canon"), F.min(F.when(~neutral, F.col("canon"))).alias("entity"), F.max(F.when(~neutral, F.col("canon"))).alias("other"))
    return names.where("canon is not null and entity = other").select("kind", "canon", "entity")


def redraws(known: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, attempt) of parts whose first surrogate collides.

    ``known`` (kind, canon) has each part once. A draw stands if nothing in the
    corpus has this form, no earlier winner has it, and among equal draws the
    smallest part drew it; the others draw again until no loser is left. Names are
    compared as they are written, names in mail addresses inside their domain.
    """

    def drawn(df: DataFrame, attempt: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
                new = [surrogate(key, k, c, attempt) + ("@" + c.partition("@")[2] if k == "local" else "") for k, c in rows]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(new, pa.string())], names=["kind", "canon", "value"])

        return df.select("kind", "canon").mapInArrow(run, "kind string, canon string, value string").withColumn("grp", _group("kind"))

    taken = known.select(_group("kind").alias("grp"), F.when(F.col("kind").isin(*_NAMES), F.substring_index("canon", "/", -1)).otherwise(F.col("canon")).alias("value"))
    pending, won, attempt = known, None, 0
    while True:
        free = drawn(pending, attempt).join(taken, ["grp", "value"], "left_anti")
        if won is not None:
            free = free.join(won.select("grp", "value"), ["grp", "value"], "left_anti")
        best = free.groupBy("grp", "value").agg(F.min(F.struct("kind", "canon")).alias("first"))
        best = C.cut(best.select("grp", "value", "first.kind", "first.canon", F.lit(attempt).alias("attempt")))
        won = best if won is None else won.unionByName(best)
        pending = C.cut(pending.join(best.select("kind", "canon"), ["kind", "canon"], "left_anti"))
        attempt += 1
        if pending.isEmpty():
            return won.where("attempt > 0").select("kind", "canon", "attempt")


def pseudonymise(documents: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", keep_others: bool = False) -> DataFrame:
    """(doc_id, text, n_entities, kinds): every text with its entities replaced.

    With ``keep_others`` the other columns of the input follow, as they are.
    """
    docs, others = C.with_others(documents, id_col, text_col)
    others = others if keep_others else []
    docs = docs.select("doc_id", "text", *(f"other_{i}" for i in range(len(others))))
    hits = C.cut(find_entities(docs.select("doc_id", "text")))  # small rows, so that texts are searched once before they are replaced
    known = C.cut(hits.select("kind", "canon").distinct())
    same = C.cut(same_persons(known))
    again = redraws(known.join(same, ["kind", "canon"], "left_anti"), key)
    attempts = again.select("kind", F.col("canon").alias("entity"), "attempt")
    again = again.select("kind", "canon", F.col("canon").alias("entity"), "attempt").unionByName(same.join(attempts, ["kind", "entity"], "left").select("kind", "canon", "entity", F.coalesce("attempt", F.lit(0)).alias("attempt")))
    if again.isEmpty():
        docs = docs.withColumn("again", F.lit(None).cast("array<struct<kind:string,canon:string,entity:string,attempt:int>>"))
    else:  # only documents with such an entity need more than the key
        changed = C.cut(hits.join(again, ["kind", "canon"]))
        per_doc = changed.groupBy("doc_id").agg(F.collect_set(F.struct("kind", "canon", "entity", "attempt")).alias("again"))
        docs = docs.join(F.broadcast(per_doc) if changed.count() <= C.BROADCAST_ROWS else per_doc, "doc_id", "left")
    names = [f"other_{i}" for i in range(len(others))]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_entities", T.LongType()), T.StructField("kinds", T.StringType()), *(T.StructField(n, f.dataType) for n, f in zip(names, others, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch, text, at in _each(batches):
            n, kinds = np.zeros(len(text), np.int64), [""] * len(text)
            redrawn = batch.column("again")
            for i in at:
                if text[i]:
                    changes = {(x["kind"], x["canon"]): (x["entity"], x["attempt"]) for x in redrawn[int(i)].as_py() or ()}
                    text[i], found = replace(text[i], key, changes, cache)
                    n[i], kinds[i] = len(found), ",".join(sorted({x[2] for x in found}))
            yield pa.record_batch([batch.column("doc_id"), pa.array(text, pa.string()), pa.array(n), pa.array(kinds, pa.string()), *(batch.column(x) for x in names)], names=["doc_id", "text", "n_entities", "kinds", *names])

    out = docs.select("doc_id", "text", "again", *names).mapInArrow(run, schema)
    return out.select("doc_id", "text", "n_entities", "kinds", *(F.col(n).alias(f.name) for n, f in zip(names, others, strict=True)))
