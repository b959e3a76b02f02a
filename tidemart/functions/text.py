"""Words of search texts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LATIN = r"[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]]+"
_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; of a run of CJK characters every pair, or its only character."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"({_CJK}|{_LATIN})"), F.lit(1))
    pairs = lambda run: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - 1)), lambda i: F.substring(run, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda run: F.when(run.rlike(f"^{_CJK}$"), pairs(run)).otherwise(F.array(run))))


class Lexicon:
    """Words found in texts by an automaton: a trie whose nodes also name the longest of their ends that starts a word, so that a text is read once."""

    def __init__(self, words: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.word = [0]  # the length of the word that ends at a node, 0: none
        for word in words:
            node = 0
            for c in word.lower():
                at = self.next[node].get(c)
                if at is None:
                    at = self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.word.append(0)
                node = at
            if node:
                self.word[node] = len(word.lower())
        # by length: the node of the longest proper end that is a start of a word, and the next one on that way where a word ends
        self.back, self.hit = [0] * len(self.next), [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for node in level:
                for c, at in self.next[node].items():
                    below.append(at)
                    if node:
                        back = self.back[node]
                        while back and c not in self.next[back]:
                            back = self.back[back]
                        self.back[at] = back = self.next[back].get(c, 0)
                        self.hit[at] = back if self.word[back] else self.hit[back]
            level = below

    def find(self, text: str) -> list[tuple[int, int]]:
        """Start and end of every word in a lower-case text, overlapping ones too; by start, longer ones first."""
        out, node = [], 0
        for i, c in enumerate(text):
            while node and c not in self.next[node]:
                node = self.back[node]
            node = at = self.next[node].get(c, 0)
            while at:
                if self.word[at]:
                    out.append((i + 1 - self.word[at], i + 1))
                at = self.hit[at]
        return sorted(out, key=lambda x: (x[0], -x[1]))

    def longest(self, text: str) -> list[tuple[int, int]]:
        """From left to right the longest word, and on behind it."""
        out, at = [], 0
        for a, b in self.find(text):
            if a >= at:
                out.append((a, b))
                at = b
        return out

    def every(self, text: str) -> list[tuple[int, int]]:
        """All words but those inside a run of other letters or digits than CJK."""
        cut = lambda i: 0 < i < len(text) and _latin(text[i - 1]) and _latin(text[i])
        return [(a, b) for a, b in self.find(text) if not cut(a) and not cut(b)]


def _latin(c: str) -> bool:
    return c.isalnum() and not _CJK_CHARACTER.match(c)


_CJK_CHARACTER = re.compile("[\u2e80-\u2fdf\u3005\u3007\u3021-\u3029\u3038-\u303b\u3041-\u30ff\u3131-\u318e\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua960-\ua97c\uac00-\ud7fb\uf900-\ufad9\uff66-\uffdc\U0001b000-\U0001b2ff\U00020000-\U000323af]")
#: The automaton that a worker has built last.
_BUILT: dict[str, Lexicon] = {}


def explode_words(df: DataFrame, text: str, word: str = "keyword", lexicon: Iterable[str] | None = None, fine: bool = False) -> DataFrame:
    """A row for each word of ``text``; rows without words, or with a null text, vanish.

    With a ``lexicon`` (a bounded list of the user's), its longest words are cut out first, from left to right, and ``tokens`` takes the rest.
    With ``fine`` too, all its words come out, those inside and across others as well, but none inside a run of Latin letters; ``tokens`` takes what
    none covers. The lexicon is sent to each worker once and made an automaton there; texts are read in one pass.
    """
    if lexicon is None:
        return df.withColumn(word, F.explode(tokens(F.col(text))))
    shipped, name = df.sparkSession.sparkContext.broadcast(sorted({x.lower() for x in lexicon})), uuid.uuid4().hex

    @F.pandas_udf("array<struct<word: string, known: boolean>>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Lexicon(shipped.value)
        found = _BUILT[name].every if fine else _BUILT[name].longest

        def parts(value: str | None) -> list[dict]:
            value, out, covered = (value or "").lower(), [], 0
            for a, b in found(value):
                if a > covered:
                    out.append({"word": value[covered:a], "known": False})
                out.append({"word": value[a:b], "known": True})
                covered = max(covered, b)
            return out + ([{"word": value[covered:], "known": False}] if covered < len(value) else [])

        for batch in texts:
            yield batch.map(parts)

    words = F.flatten(F.transform(cut(F.col(text)), lambda x: F.when(x["known"], F.array(x["word"])).otherwise(tokens(x["word"]))))
    return df.withColumn(word, F.explode(words))
