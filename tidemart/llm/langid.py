"""Language identification by rank-order profiles.

A text's letters are lower-cased and everything else is a word boundary; its 1- to 3-grams inside words and across one
boundary are ranked by count. A language's profile is the same ranking over its labelled texts. A text goes to the
language with the smallest out-of-place distance: the sum, over the text's top grams, of how far each stands from its
place in the profile, where an absent gram costs the profile's length.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches

#: Grams in a profile.
PROFILE = 400
#: Most languages that may be learned: bounds what the driver and the tasks hold (MAX_LANGUAGES * PROFILE ranks).
MAX_LANGUAGES = 1000
UNKNOWN = "und"

_BOUNDARY = np.uint64(1)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)]))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """Codes of all grams of a text: 21 bits a character, boundaries as 1; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return np.zeros(0, np.uint64)
    edge = ~letter
    edge[1:] &= letter[:-1]  # the first of a run of other characters stands for the run
    keep = letter | edge
    c = np.where(letter, points, 1)[keep].astype(np.uint64)
    c = np.concatenate([c[:0] if c[0] == 1 else [_BOUNDARY], c, c[:0] if c[-1] == 1 else [_BOUNDARY]]).astype(np.uint64)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = ((two[:-1] << np.uint64(21)) | c[2:])[c[1:-1] != _BOUNDARY]
    return np.concatenate([c[c != _BOUNDARY], two, three])


def _ranked(text: str, size: int) -> np.ndarray:
    """The text's most frequent grams, most frequent first, ties by code."""
    found = grams(text)
    if not len(found):
        return found
    codes, counts = np.unique(found, return_counts=True)
    return codes[np.argsort(-counts, kind="stable")[:size]]


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """``(lang, gram, place)``: the ``size`` most frequent grams of each language over all labelled texts.

    Rows with a null text or language teach nothing. Gram counts are summed per batch in the tasks and then by Spark; the
    ranking first keeps the best of each of 16 parts of a language, so that no task ranks a whole language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = np.array(batch.column(lang).to_pylist(), object), batch.column(text)
            for one in sorted(set(langs)):
                rows = np.flatnonzero(langs == one)
                found: list[np.ndarray] = []
                for start in range(0, len(rows), 500):
                    codes, counts = np.unique(np.concatenate([grams(texts[int(i)].as_py()) for i in rows[start : start + 500]]), return_counts=True)
                    found += [codes, counts.astype(np.uint64)]
                codes, where = np.unique(np.concatenate(found[::2]), return_inverse=True)
                sums = np.bincount(where, weights=np.concatenate(found[1::2])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(sums)], ["lang", "gram", "n"])

    bounded_batches(labelled.sparkSession)
    known = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias(lang), F.col(text).alias(text))
    sums = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = [F.desc("n"), F.asc("gram")]
    part = Window.partitionBy("lang", F.pmod(F.hash("gram"), F.lit(16))).orderBy(*by)
    best = sums.withColumn("place", F.row_number().over(part)).where(F.col("place") <= size)
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("place") <= size)
    return best.select("lang", "gram", (F.col("place") - 1).alias("place"))


def identify(docs: DataFrame, learned: DataFrame, text: str = "text", size: int = PROFILE, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """Every row without its text, with ``lang_pred`` and ``score`` (0 to 1: one less the mean share of the largest distance).

    ``und`` with score 0 for null texts, texts without letters, and if nothing was learned. Ties go to the language that
    sorts first. Texts are used whole. Other columns pass unchanged, but ``lang_pred`` and ``score`` are replaced.
    """
    bounded_batches(docs.sparkSession)
    rows = learned.limit(max_languages * size + 1).collect()
    if len(rows) > max_languages * size:
        raise ValueError(f"more than {max_languages} languages")
    langs = sorted({x["lang"] for x in rows})
    codes = np.unique(np.array([x["gram"] for x in rows], np.int64)).astype(np.uint64)
    codes.sort()
    place = np.full((len(codes) + 1, len(langs)), -1, np.int32)
    for x in rows:
        place[np.searchsorted(codes, np.uint64(x["gram"])), langs.index(x["lang"])] = x["place"]
    keep = [f for f in docs.schema if f.name not in (text, "lang_pred", "score")]

    def judge(value: str | None) -> tuple[str, float]:
        top = _ranked(value, size) if value and langs else []
        if not len(top):
            return UNKNOWN, 0.0
        at = np.searchsorted(codes, top)
        at[at == len(codes)] = 0
        at = np.where(codes[at] == top, at, len(codes))
        there = place[at]
        far = np.where(there < 0, size, np.abs(there - np.arange(len(top))[:, None])).sum(0)
        best = int(far.argmin())
        return langs[best], 1 - float(far[best]) / (size * len(top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(x.as_py()) for x in batch.column(text)]
            out = [batch.column(f.name) for f in keep] + [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(out, [*(f.name for f in keep), "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "lang_pred string", "score double"])
    return docs.select(text, *(f"`{f.name}`" for f in keep)).mapInArrow(run, schema)
