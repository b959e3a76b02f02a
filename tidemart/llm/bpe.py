"""Byte-level BPE by monoid tree reduction.

A text is halved until its parts are short, each part is encoded alone, match by match of the split pattern, and
neighbours are joined up the tree. A join
re-encodes only a window around the seam. The window's ends are *cuts*: places where a white-space character follows
another character. The split pattern never matches across such a place, whatever stands further left or right, so tokens
outside the window are those of the joined text. The window doubles until it holds a cut on each side, or reaches the
ends. One match longer than ``LONG`` bytes has no cuts; it is reduced over its bytes, where two parts fit together once
the tokens at both window ends are what their two byte strings give when encoded as a pair. Decoding concatenates halves
up the same kind of tree.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import bounded_batches

#: Characters of a part that is encoded alone; bytes of the parts to which a longer match is reduced.
LEAF = 1024
PIECE = 64
#: Matches whose tokens are remembered, and characters of the longest such match.
CACHE, SHORT = 1 << 18, 32
#: Characters of the first window on each side of a seam.
WINDOW = 48


class _Tokens(dict):
    """Tokens of matches, encoded when first asked for; short ones are remembered until there are CACHE of them."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, match: str) -> list[int]:
        found = self.encode(match)
        if len(match) <= SHORT:
            if len(self) >= CACHE:
                self.clear()
            self[match] = found
        return found


class Vocabulary:
    """Ranks of byte strings and the split pattern; encodes and decodes whole texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = dict(zip(self.ranks.values(), self.ranks, strict=True))
        self.far = 1 + max(self.bytes_of, default=0)  # ranks no pair of parts
        self.pattern = regex.compile(pattern)
        self.tokens = _Tokens(self.encode_match)
        self.pair = lru_cache(65536)(lambda a, b: tuple(self.merge(self.bytes_of[a] + self.bytes_of[b])))

    # one match of the pattern, as bytes

    def merge(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of the lowest rank, the leftmost of equals, while there is one."""
        get, far = self.ranks.get, self.far
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [get(piece[i : i + 2], far) for i in range(len(piece) - 1)]
        while ranks and (least := min(ranks)) < far:
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], far)
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], far)
        return [self.ranks[x] for x in parts]

    def join_pieces(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of two adjoining parts of one match: widen the window until its edges fit their neighbours."""
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.merge(b"".join(self.bytes_of[t] for t in left[i:] + right[:j]))
            fits_left = i == 0 or self.pair(left[i - 1], window[0]) == (left[i - 1], window[0])
            fits_right = j == len(right) or self.pair(window[-1], right[j]) == (window[-1], right[j])
            if fits_left and fits_right:
                return left[:i] + window + right[j:]
            width *= 2

    def encode_piece(self, piece: bytes) -> list[int]:
        if len(piece) <= PIECE:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join_pieces(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def encode_match(self, match: str) -> list[int]:
        """Tokens of one match: itself if it is a token, else the merges of its bytes."""
        piece = match.encode()
        return [self.ranks[piece]] if piece in self.ranks else self.encode_piece(piece)

    # texts

    def encode_window(self, text: str) -> list[int]:
        """A stretch of text encoded match by match."""
        return list(chain.from_iterable(map(self.tokens.__getitem__, self.pattern.findall(text))))

    def encode(self, text: str) -> np.ndarray:
        """Token ids of the whole text."""
        return np.array(list(chain.from_iterable(self._reduce(text, 0, len(text)))), np.uint32)

    def _reduce(self, text: str, a: int, b: int) -> list[list[int]]:
        if b - a <= LEAF:
            return [self.encode_window(text[a:b])]
        seam = (a + b) // 2
        low, high = _cut_before(text, a, seam), _cut_after(text, seam, b)
        if low == a and high == b:  # nothing outside the window: the halves would be encoded for nothing
            return [self.encode_window(text[a:b])]
        left, right = self._reduce(text, a, seam), self._reduce(text, seam, b)
        self._trim(left, len(text[low:seam].encode()), -1)
        self._trim(right, len(text[seam:high].encode()), 0)
        return [*left, self.encode_window(text[low:high]), *right]

    def _trim(self, parts: list[list[int]], n_bytes: int, end: int) -> None:
        """Take the tokens of ``n_bytes`` bytes from the start (0) or the end (-1) of the parts."""
        while n_bytes:
            ids, k = parts[end], 0
            while n_bytes and k < len(ids):
                n_bytes -= len(self.bytes_of[ids[k if end == 0 else -1 - k]])
                k += 1
            if k == len(ids):
                parts.pop(end)
            else:
                parts[end] = ids[k:] if end == 0 else ids[: len(ids) - k]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, halves concatenated up the tree."""
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_space = regex.compile(r"\s")


def _is_cut(text: str, p: int) -> bool:
    return bool(_space.match(text, p)) and not _space.match(text, p - 1)


def _cut_before(text: str, a: int, seam: int) -> int:
    """The last cut within a doubling window before the seam, or ``a``."""
    width, top = WINDOW, seam - 1
    while True:
        low = max(a, seam - width)
        for p in range(top, low, -1):
            if _is_cut(text, p):
                return p
        if low == a:
            return a
        width, top = 2 * width, low


def _cut_after(text: str, seam: int, b: int) -> int:
    """The first cut within a doubling window after the seam, or ``b``."""
    width, start = WINDOW, seam + 1
    while True:
        high = min(b, seam + width)
        for p in range(start, high):
            if _is_cut(text, p):
                return p
        if high == b:
            return b
        width, start = 2 * width, high


@lru_cache(4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Loaded once per Python worker; ``path`` is a file that every worker has."""
    return Vocabulary(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Every row without its text, with ``ids`` (little-endian unsigned 32-bit token ids as binary) and ``n_tokens``.

    ``decoded`` adds the bytes that the ids give back. Null counts as empty: no tokens. Special tokens' strings are ordinary
    text. Long texts and long runs without white space are encoded whole; other columns pass unchanged, repeated rows
    repeat, an empty table gives no rows. New columns replace columns of the same name.
    """
    bounded_batches(docs.sparkSession)
    new = ["ids", "n_tokens"] + ["decoded"] * decoded
    keep = [f for f in docs.schema if f.name not in (text, *new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                ids = [vocab.encode(x.as_py() or "") for x in batch.column(text)]
                out = [batch.column(f.name) for f in keep]
                out += [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())]
                out += [pa.array([vocab.decode(x) for x in ids], pa.binary())] * decoded
                yield pa.RecordBatch.from_arrays(out, [*(f.name for f in keep), *new])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["ids binary", "n_tokens long"] + ["decoded binary"] * decoded
    return docs.select(text, *(f"`{f.name}`" for f in keep)).mapInArrow(run, ", ".join(schema))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Every row with ``decoded``, the bytes of ``ids``; null ids give empty bytes."""
    bounded_batches(encoded.sparkSession)
    keep = [f for f in encoded.schema if f.name != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            out = [vocab.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(out, pa.binary())], [*(f.name for f in keep), "decoded"])

    return encoded.select(*(f"`{f.name}`" for f in keep)).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "decoded binary"]))
