"""Licence scans by ordered signature rules.

Each rule is a hand-written regular expression over the lower-cased text
(``signatures``), in order of priority. It is gated by keywords that are derived
from its pattern: sets of pieces of text of each of which every match must hold
one, so the gate never loses a detection. One automaton finds the keywords of all
rules in a block of texts, and a rule runs only on texts that hold what it needs.

Detections are resolved in rule order: one whose interval lies inside that of an
earlier rule's detection is suppressed. Earlier detections are kept sorted by
their start with the largest end so far, so that containment is a bisection.

Defined results: null and empty texts have no words, places or labels and score
0. Repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keelson.llm import common as C
from keelson.llm.signatures import GROUPS

#: Phrases whose places are counted, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Lower-case words: all but 00-2F, 3A-60 and 7B-7F (after A-Z became a-z).
MEMBER = np.ones(256, bool)
MEMBER[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
#: ASCII letters (lower-case) and digits.
MEMBER_ASCII = MEMBER.copy()
MEMBER_ASCII[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Sets of keywords that a rule is gated by at most.
GATES = 3
#: Length of the pieces of all sets but the first; shorter ones are common and keep little out.
RARE = 4
#: A piece of text, and whether no ASCII letter or digit stands before it.
Keyword = tuple[str, bool]


def keywords(pattern: str) -> tuple[frozenset[Keyword], ...]:
    """Sets of pieces of text; every match of the pattern holds a piece of each set.

    A sequence needs the literals that stand in a row in it, and what its parts
    need that cannot be left out; an alternative needs a piece of each of its
    branches. The sets with the longest pieces are taken. A piece that begins the
    pattern, behind a look-behind for letters, or that follows white space is the
    beginning of a word.
    """

    def weight(pieces: frozenset[Keyword]) -> tuple:
        return min((len(w) + 2 * begins for w, begins in pieces), default=0), -len(pieces)

    def gap(op: object, arg: object) -> bool:
        """Whether something stands here for sure that is neither a letter nor a digit."""
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            return arg[0] > 0 and len(arg[2]) == 1 and gap(*arg[2][0])
        return op is sre.IN and all((o is sre.LITERAL and x < 128 and not chr(x).isalnum()) or (o, x) == (sre.CATEGORY, sre.CATEGORY_SPACE) for o, x in arg)

    def needed(parsed: Iterable, first: bool) -> list[frozenset[Keyword]]:
        found: list[frozenset[Keyword]] = []
        run, begins = "", False
        for op, arg in [*parsed, (None, None)]:
            if op is sre.LITERAL:
                if not run:
                    begins = first
                run, first = run + chr(arg), False
                continue
            if run:
                found.append(frozenset({(run, begins)}))
                run = ""
            if op is sre.SUBPATTERN:
                found += needed(arg[3], first)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0]:
                found += needed(arg[2], first)
            elif op is sre.ATOMIC_GROUP:
                found += needed(arg, first)
            elif op is sre.BRANCH:
                branches = [max(needed(b, first), key=weight, default=frozenset()) for b in arg[1]]
                found.append(frozenset().union(*branches) if all(branches) else frozenset())
            first = (first and op in (sre.ASSERT, sre.ASSERT_NOT, sre.AT)) or gap(op, arg)
        return [f for f in found if f]

    parsed = sre_parser.parse(pattern)
    every = sorted(needed(parsed, pattern.startswith(_BEGIN)), key=weight, reverse=True)
    return tuple(dict.fromkeys(f for k, f in enumerate(every) if k == 0 or min(len(w) for w, _ in f) >= RARE))[:GATES]


#: Look-arounds that keep matches from beginning or ending inside a word.
_BEGIN, _END = r"(?<![^\W_])", r"(?![^\W_])"


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    score: float
    #: One of each set is in every match; without any the rule runs on every text.
    keywords: tuple[frozenset[Keyword], ...]


def rule(label: str, pattern: str, score: float) -> Rule:
    """A rule whose matches neither begin nor end inside a word."""
    spaced = pattern.replace(" ", r"\s+").replace(r"\s+*", r"\s*").replace(r"\s+?", r"\s*")
    whole = f"{_BEGIN}(?:{spaced}){_END}"
    return Rule(label, re.compile(whole), score, keywords(whole))


def default_rules() -> tuple[Rule, ...]:
    """All rules in order of priority."""
    return tuple(rule(label, pattern, score) for group, score in GROUPS for label, pattern in group)


class Gate:
    """Which rules may match which texts of a block of UTF-8 bytes."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.always = frozenset(i for i, r in enumerate(rules) if not r.keywords)
        words = sorted({w for r in rules for s in r.keywords for w, _ in s})
        place = {w: k for k, w in enumerate(words)}
        # what a rule needs, as numbers of words; twice the number plus one: as the beginning of a word
        self.needs = [[{2 * place[w] + begins for w, begins in s} for s in r.keywords] for r in rules]
        self.rules_of: dict[int, set[int]] = {}
        for i, sets in enumerate(self.needs):
            for k in sets[0] if sets else ():
                self.rules_of.setdefault(k, set()).add(i)
        self.automaton = ahocorasick.Automaton() if words else None
        for w, k in place.items():
            # one character a byte, as in the texts below
            self.automaton.add_word(w.encode().decode("latin-1"), (k, len(w.encode())))
        if words:
            self.automaton.make_automaton()

    def open(self, raw: bytes, offs: np.ndarray) -> dict[int, set[int]]:
        """Numbers of rules by text; texts without any are left out. Bytes are lower-case."""
        out: dict[int, set[int]] = {d: set(self.always) for d in range(len(offs) - 1)} if self.always else {}
        hits = np.array([(end, k, n) for end, (k, n) in self.automaton.iter(raw.decode("latin-1"))], np.int64).reshape(-1, 3) if self.automaton else np.zeros((0, 3), np.int64)
        if len(hits):
            start = hits[:, 0] - hits[:, 2] + 1
            doc = np.searchsorted(offs, hits[:, 0], side="right") - 1
            before = np.frombuffer(raw, np.uint8)[np.maximum(start - 1, 0)]
            begins = (start == offs[doc]) | ~MEMBER_ASCII[before]
            word = 2 * hits[:, 1]
            seen = np.concatenate((np.column_stack((doc, word)), np.column_stack((doc, word + 1))[begins]))
            inside = np.concatenate((start >= offs[doc], (start >= offs[doc])[begins]))  # words across two texts do not count
            seen = np.unique(seen[inside], axis=0)
            for d, part in zip(*self._by_text(seen), strict=True):
                have = set(part)
                live = {i for k in part for i in self.rules_of.get(k, ()) if all(not have.isdisjoint(s) for s in self.needs[i])}
                if live:
                    out.setdefault(d, set()).update(live)
        return out

    @staticmethod
    def _by_text(seen: np.ndarray) -> tuple[list[int], list[list[int]]]:
        docs, first = np.unique(seen[:, 0], return_index=True)
        return docs.tolist(), [x.tolist() for x in np.split(seen[:, 1], first[1:])]


def detect(text: str, rules: tuple[Rule, ...], open_rules: Iterable[int] | None = None) -> list[tuple[int, int, str, float]]:
    """Surviving (start, end, label, score) of lower-case ``text``, in order of place.

    ``open_rules`` are the rules that the gate let through (default: all). Matches
    of one rule never lie inside each other, so they are compared with those of
    earlier rules all at once.
    """
    found: list[tuple[int, int, str, float]] = []
    starts, ends, most = (np.zeros(0, np.int64) for _ in range(3))
    for i in sorted(open_rules) if open_rules is not None else range(len(rules)):
        spans = np.array([m.span() for m in rules[i].pattern.finditer(text)], np.int64).reshape(-1, 2)
        spans = spans[spans[:, 0] < spans[:, 1]]
        before = np.searchsorted(starts, spans[:, 0], side="right") - 1
        free = (before < 0) | (most[before] < spans[:, 1]) if len(starts) else np.ones(len(spans), bool)
        spans = spans[free]
        if len(spans):
            found += [(s, e, rules[i].label, rules[i].score) for s, e in spans.tolist()]
            starts, ends = np.concatenate((starts, spans[:, 0])), np.concatenate((ends, spans[:, 1]))
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]
            most = np.maximum.accumulate(ends)
    return sorted(found)


def scan_licenses(documents: DataFrame, rules: tuple[Rule, ...] | None = None, spans: bool = False) -> DataFrame:
    """Phrase places, labels and score of every whole text; with ``spans`` the detections too.

    Rows stay in their scan partition; nothing is shuffled.
    """
    docs = C.texts(documents)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    schema += ", detections array<struct<start:int,end:int,label:string>>" * spans
    names = re.findall(r"(\w+) (?:long|string|double|array)", schema)
    own = rules
    words_of = [p.split() for p, _ in PHRASES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = own if own is not None else default_rules()
        gate = Gate(rules)
        phrases = [[np.uint64(C.word_hash(w)) for w in p] for p in words_of]
        for batch, buf, offs in C.slices(batches):
            n = batch.num_rows
            low = _LOWER[buf]
            starts, ends, doc = C.word_spans(low, offs, MEMBER)
            h = C.span_hash(C.prefix_hash(low), starts, ends)
            runs = C.runs_of(doc, n)
            at_all, doc_all, labels_all = [], [], [set() for _ in range(n)]
            for (phrase, label), hashes in zip(PHRASES, phrases, strict=True):
                at = np.flatnonzero(h == hashes[0])
                for k, x in enumerate(hashes):
                    at = at[at + k < len(h)]
                    at = at[(h[at + k] == x) & (doc[at + k] == doc[at])]
                at_all.append(at)
                doc_all.append(doc[at])
                for d in np.unique(doc[at]):
                    labels_all[d].add(label)
            at, where = np.concatenate(at_all), np.concatenate(doc_all)
            n_base = np.bincount(where, minlength=n)
            first, last = np.full(n, 1 << 62), np.full(n, -1)
            np.minimum.at(first, where, at - runs[where])
            np.maximum.at(last, where, at - runs[where])
            score, labels, found = np.zeros(n), [], [[] for _ in range(n)]
            raw = low.tobytes()
            for d, live in gate.open(raw, offs).items():
                found[d] = detect(raw[offs[d] : offs[d + 1]].decode("utf-8", "replace"), rules, live)
            for d in range(n):
                labels.append(",".join(sorted(labels_all[d] | {x[2] for x in found[d]})))
                score[d] = max([0.5 * (n_base[d] > 0), *(x[3] for x in found[d])])
            none = n_base == 0
            cols = [batch.column(0), C.long_column(np.diff(runs)), C.long_column(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([",".join(sorted(x)) for x in labels_all]), pa.array(labels), pa.array(score)]
            if spans:
                cols.append(pa.array([[{"start": a, "end": b, "label": c} for a, b, c, _ in x] for x in found], pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32(), "label": pa.string()}))))
            yield pa.record_batch(cols, names=names)

    return docs.mapInArrow(run, schema)
