"""License scans: an Aho-Corasick automaton over normalized words, and a shunting-yard parser for license expressions.

The automaton finds phrases and the words of identifier tags in one pass over the words; where it finds a tag, the rest of that line is
read as an expression. Phrases, tags and how much an identifier restricts are the caller's; the tables here are defaults.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import takewhile

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import bounded_batches

#: Phrases of the base scan and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notice phrases of the method and the identifier each stands for.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache-2.0",
    "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd-3-clause",
    "isc license": "isc",
    "mozilla public license": "mpl-2.0",
    "eclipse public license": "epl-2.0",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "cc0": "cc0-1.0",
    "public domain": "public-domain",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "proprietary and confidential": "proprietary",
}

#: Words of an identifier tag; the expression follows it in its line.
TAG = "spdx license identifier"

#: How much each family of identifiers restricts use, 0 to 1; the longest fitting start of an identifier counts.
RESTRICTS = {
    "cc0": 0.0, "public-domain": 0.0, "unlicense": 0.0, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "apache": 0.15, "cc-by": 0.2, "mpl": 0.4,
    "epl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.7, "agpl": 0.8, "cc-by-nd": 0.8, "cc-by-nc": 0.9, "proprietary": 1.0, "reserved": 1.0,
}
UNKNOWN_RESTRICTS = 0.5
#: An exception named by "with" halves what its license restricts.
EXCEPTION = 0.5

_BINDS = {"or": 1, "and": 2, "with": 3}
#: What follows a tag's words: a sign that an expression comes, and the line's rest.
_REST = re.compile(rb"[ \t]*([:=]?)[ \t]*([^\r\n]*)")
_WORD = re.compile(rb"[^ ]+")
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:_-]*")
#: A-Z to a-z, other ASCII characters but digits and letters to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def family(identifier: str, table: dict[str, float] = RESTRICTS) -> str | None:
    """The longest listed family that the identifier is, or starts with before a hyphen."""
    parts = identifier.split("-", 1 + max((k.count("-") for k in table), default=0))
    return next((name for n in range(len(parts), 0, -1) if (name := "-".join(parts[:n])) in table), None)


def restricts(identifier: str, table: dict[str, float] = RESTRICTS) -> float:
    found = family(identifier, table)
    return UNKNOWN_RESTRICTS if found is None else table[found]


def postfix(expression: str, table: dict[str, float] | None = None) -> list[str] | None:
    """Shunting-yard: the longest well-formed start of a lower-case expression in postfix order; None if there is none.

    ``with`` binds more than ``and``, which binds more than ``or``. Reading stops at the first token that does not fit,
    such as the words of a comment after the expression; with a ``table``, also at the first identifier of no listed family.
    As many parentheses at the very start as never close are passed over.
    """
    tokens = _TOKEN.findall(expression)
    if table is not None:
        tokens = [*takewhile(lambda x: x in "()" or x in _BINDS or family(x, table) is not None, tokens)]
    skip, good = _extent(tokens)
    return _yard(tokens[skip:good]) if good else None


def _extent(tokens: list[str]) -> tuple[int, int]:
    """How many opening parentheses to pass over, the fewest that leave a well-formed start, and where that ends (0: nowhere)."""
    lead = next((i for i, token in enumerate(tokens) if token != "("), len(tokens))
    depth = low = good = 0  # of parentheses behind the leading ones; where operands end deepest, the last time
    operand = False
    for n, token in enumerate(tokens[lead:], lead + 1):
        if token == "(":
            if operand:
                break
            depth += 1
        elif token == ")":
            if not operand or depth == -lead:
                break
            depth -= 1
        elif token in _BINDS:
            if not operand:
                break
            operand = False
        else:
            if operand:
                break
            operand = True
        if operand and depth <= low:
            low, good = depth, n
    return lead + low, good


def _yard(tokens: list[str]) -> list[str]:
    """The tokens of a well-formed expression in postfix order."""
    out: list[str] = []
    stack: list[str] = []
    for token in tokens:
        if token == "(":
            stack.append(token)
        elif token == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif token in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
        else:
            out.append(token)
    return out + stack[::-1]


def evaluate(tokens: list[str], table: dict[str, float] = RESTRICTS) -> tuple[set[str], float]:
    """Identifiers that take effect and how much they restrict: ``or`` takes the freer side (of equals the one whose sorted identifiers come first), ``and`` both sides."""
    stack: list[tuple[set[str], float, str]] = []  # with the first identifier
    for token in tokens:
        if token not in _BINDS:
            name = token.replace(":", "-")
            stack.append(({name}, restricts(token, table), name))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "or":
            if left[1:] == right[1:]:
                stack.append(min(left, right, key=lambda x: sorted(x[0])))
            else:
                stack.append(min(left, right, key=lambda x: x[1:]))
            continue
        large, small = (left, right) if len(left[0]) >= len(right[0]) else (right, left)
        large[0].update(small[0])  # no one else holds it
        stack.append((large[0], max(left[1], right[1]) if token == "and" else left[1] * EXCEPTION, min(left[2], right[2])))
    return stack[-1][:2]


class Scanner:
    """The automaton of a set of phrases and tags, and what its finds mean."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], tags: tuple[str, ...], table: dict[str, float]):
        self.base, self.notices, self.tags, self.table = base, notices, frozenset(tags), table
        self.automaton = ahocorasick.Automaton()
        for phrase in {*base, *notices, *tags}:
            self.automaton.add_word(f" {phrase} ", phrase)
        self.automaton.make_automaton()

    def scan(self, text: str) -> dict:
        raw = text.encode("utf-8", "surrogatepass")
        folded = raw.translate(_FOLD)
        words = folded.split()
        line = b" ".join([b"", *words, b""]).decode("utf-8", "replace")
        places, base, labels, score, tagged = [], set(), set(), 0.0, []
        at, n = 0, 0
        for end, phrase in sorted((x for x in self.automaton.iter(line)), key=lambda x: x[0] - len(x[1])):
            start = end - len(phrase) - 1
            n += line.count(" ", at, start)
            at = start
            if phrase in self.base:
                places.append(n)
                base.add(self.base[phrase])
            if phrase in self.notices:
                labels.add(self.notices[phrase])
            if phrase in self.tags:
                tagged.append(n + phrase.count(" "))  # the tag's last word
        labels |= base
        score = max((restricts(x, self.table) for x in labels), default=0.0)
        for expression, signed in self._expressions(raw, folded, tagged):
            if tokens := postfix(expression, None if signed else self.table):
                ids, value = evaluate(tokens, self.table)
                labels |= ids
                score = max(score, value)
        return {"n_words": len(words), "places": sorted(places), "base_labels": sorted(base), "labels": sorted(labels), "score": score}

    @staticmethod
    def _expressions(raw: bytes, folded: bytes, tagged: list[int]) -> Iterator[tuple[str, bool]]:
        """What follows the given words in their lines, in lower case, and whether a sign stands before it."""
        words, n = _WORD.finditer(folded), -1
        for last in sorted(set(tagged)):
            while n < last:
                word, n = next(words), n + 1
            rest = _REST.match(raw, word.end())
            yield rest[2].translate(_LOWER).decode("utf-8", "replace"), bool(rest[1])


def find_licenses(docs: DataFrame, text: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = (TAG,), table: dict[str, float] = RESTRICTS) -> DataFrame:
    """Every row without its text, with ``n_words``, ``places`` (word indexes of base phrases), ``base_labels``, ``labels``, ``score``.

    A-Z count as a-z; words are runs of letters, digits and non-ASCII characters. Phrases match whole words wherever they
    stand, so one place can carry several phrases. An identifier tag's expression reaches to the end of its line; a
    malformed one counts as far as it is well formed. ``score`` is how much the strictest of all expressions, notices and
    base phrases restricts use, 0 without any; an expression counts by its value, which is the freer side of an ``or``. A null or empty text has no words and no labels. Other columns pass unchanged; new ones replace their namesakes.
    """
    bounded_batches(docs.sparkSession)
    new = "n_words long, places array<long>, base_labels array<string>, labels array<string>, score double"
    kinds = {"n_words": pa.int64(), "places": pa.list_(pa.int64()), "base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string()), "score": pa.float64()}
    keep = [f for f in docs.schema if f.name not in (text, *kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, tags, table)
        for batch in batches:
            found = [scanner.scan(x.as_py() or "") for x in batch.column(text)]
            out = [batch.column(f.name) for f in keep] + [pa.array([x[k] for x in found], kind) for k, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays(out, [*(f.name for f in keep), *kinds])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), new])
    return docs.select(text, *(f"`{f.name}`" for f in keep)).mapInArrow(run, schema)
