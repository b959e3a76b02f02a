"""Secret scans with multipart credential linking.

Base patterns find assignments, access identifiers and long hexadecimal strings. Weak candidates - named identifiers,
endpoints and unlabelled key material - mean little alone. They are interval-joined with complementary parts: a part's
reach is ``REACH`` characters on either side, cut at the blank lines around it (its scope), and a weak candidate is
reported only if a complementary part lies within its reach. All parts of a join are in one text, so it runs where the
text is and shuffles nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "linked_id", "linked_secret", "linked_endpoint")
#: Characters on either side of a part in which a complementary part counts.
REACH = 300

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ID = re.compile(r"""(?:access_?key(?:_?id)?|client_?id|user_?name|account_?(?:id|name)|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}""", re.I | re.A)
#: After '.', '-' or '_' only where no key material stands before them: those join the parts of host names and tokens.
_KEY = re.compile(r"(?<![A-Za-z0-9+/])(?<![A-Za-z0-9+/][_.-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}={0,2}", re.A)
_URL = re.compile(r"""[A-Za-z][A-Za-z0-9+]{1,9}://[^\s"'<>;]+""", re.A)
#: A port and, before it, the dotted name of a host.
_PORT, _HOST = re.compile(r"(?<=[A-Za-z]):[0-9]{2,5}\b", re.A), re.compile(r"(?<![A-Za-z0-9.-])[A-Za-z0-9.-]{1,230}\.[A-Za-z]{2,22}\Z", re.A)
#: The end of what stands before key material that a name with "secret" labels.
_LABEL = re.compile(r"""secret[A-Za-z0-9_.-]{0,64}["']?\x20*[:=]\x20*["']?\Z""", re.I | re.A)
_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-"
#: Characters before a part in which its name is looked for.
_BEFORE = 128
_BLANK = re.compile(r"\n[ \t\r]*\n")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak candidates with a complementary part within reach and scope: identifiers and endpoints need a secret, key material an identifier or an endpoint.

    A name with "secret" names no identifier; key material that it stands directly before needs no other part.
    """
    ids = [m.span() for m in _ID.finditer(text) if not _names_secret(text, m.start())] if "=" in text or ":" in text else []
    ends = endpoints(text) if ":" in text else []
    strong_ids = [x[1:] for x in base if x[0] == "access"]
    if not (ids or ends or strong_ids or "secret" in text.lower()):
        return []
    by_kind = [[x[1:] for x in base if x[0] == k] for k in ("assign", "hex")]
    keys = [m.span() for m in _KEY.finditer(text)]
    keys = [x for x in keys if not any(_overlaps(parts, *x) for parts in (*by_kind, strong_ids, ends))]
    breaks = [m.start() for m in _BLANK.finditer(text)]

    def meets(part: tuple[int, int], *others: list[tuple[int, int]]) -> bool:
        k = bisect_right(breaks, part[0])
        low = max(part[0] - reach, breaks[k - 1] if k else 0)
        high = min(part[1] + reach, breaks[k] if k < len(breaks) else len(text))
        for parts in others:  # of one kind: disjoint and in order
            i = bisect_right(parts, low, key=lambda x: x[1])
            if i < len(parts) and parts[i][0] < high and parts[i] != part:
                return True
        return False

    found = [("linked_id", *x) for x in ids if meets(x, *by_kind, keys)]
    found += [("linked_secret", *x) for x in keys if meets(x, ids, strong_ids, ends) or _LABEL.search(text, max(0, x[0] - _BEFORE), x[0])]
    return found + [("linked_endpoint", *x) for x in ends if meets(x, *by_kind, keys)]


def _names_secret(text: str, start: int) -> bool:
    """Whether the name that runs on to ``start`` has "secret" in it."""
    before = text[max(0, start - _BEFORE) : start]
    return "secret" in before[len(before.rstrip(_NAME)) :].lower()


def _overlaps(parts: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the parts, disjoint and in order, shares a character with the stretch."""
    i = bisect_right(parts, start, key=lambda x: x[1])
    return i < len(parts) and parts[i][0] < end


def endpoints(text: str) -> list[tuple[int, int]]:
    """URLs, and hosts with a port outside them, in order."""
    urls = [m.span() for m in _URL.finditer(text)]
    hosts = [(h.start(), m.end()) for m in _PORT.finditer(text) if (h := _HOST.search(text, max(0, m.start() - 254), m.start()))]
    return sorted(urls + [x for x in hosts if not _overlaps(urls, *x)])


def find_secrets(docs: DataFrame, text: str = "text", redact: str | None = None) -> DataFrame:
    """Every row with ``spans``: an array of (kind, start, end) by start, then kind as in KINDS; code points, end exclusive.

    The text is dropped, or, with ``redact``, kept with each stretch covered by spans replaced by that string. A null or
    empty text has no spans (null stays null). Texts are scanned whole. Other columns pass unchanged; ``spans`` is replaced.
    """
    bounded_batches(docs.sparkSession)
    keep = [f for f in docs.schema if f.name not in (text, "spans")]
    span_type = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    order = {k: i for i, k in enumerate(KINDS)}

    def cover(value: str, spans: list[Span]) -> str:
        out, at = [], 0
        for _, start, end in spans:
            if start >= at:
                out += [value[at:start], redact]
            at = max(at, end)
        return "".join([*out, value[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for x in batch.column(text):
                value = x.as_py()
                base = base_spans(value or "")
                spans = sorted(base + linked_spans(value or "", base), key=lambda s: (s[1], order[s[0]], s[2]))
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                if redact is not None:
                    texts.append(cover(value, spans) if spans else value)
            out = [batch.column(f.name) for f in keep] + ([pa.array(texts, pa.string())] if redact is not None else []) + [pa.array(found, pa.list_(span_type))]
            yield pa.RecordBatch.from_arrays(out, names)

    names = [*(f.name for f in keep), *([text] if redact is not None else []), "spans"]
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ([f"`{text}` string"] if redact is not None else [])
    return docs.select(text, *(f"`{f.name}`" for f in keep)).mapInArrow(run, ", ".join([*schema, "spans array<struct<kind:string,start:bigint,end:bigint>>"]))


def spans_text(spans: Column) -> Column:
    """The spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
