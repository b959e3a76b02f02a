"""Target-distribution importance resampling over hashed word runs, whose CRC-32 comes from a position table.

A CRC without its start and end values is linear: it is the exclusive or of what each byte contributes at its distance from
the end of the message, and the start and end values add a constant of the length. The contributions of a byte at the
first ``REACH`` distances are precomputed, so the features of many texts are hashed at once: contributions are looked up for all bytes and
joined by ``bitwise_xor.reduceat`` over the features' spans. A longer span is cut into blocks of ``REACH`` bytes from its end;
neighbouring blocks are folded by moving the left one over the right one's bytes, until one is left.

The corpus' and the target's feature counts by bucket give each bucket a gain, a document's weight is the mean gain of its
features, and documents are drawn without repeats by weight and a Gumbel value that hangs on their id alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, land

BUCKETS = 10_000
#: Documents of fewer words are not drawn; the share of the others that is; most words of a feature; the seed of the draw.
LEAST_WORDS, PERCENT, RUN, SEED = 20, 10, 1, "2024"
#: Distances from the end for which contributions are tabled.
REACH = 64
#: Bytes of text hashed at once, and of features looked up at once.
CHUNK, LOOKUP = 500_000, 1 << 20

#: A-Z to a-z, and 0 for what is not part of a word: ASCII but digits and letters.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 0 for c in range(256)], np.uint8)


@lru_cache(1)
def _contributions() -> tuple[np.ndarray, np.ndarray]:
    """What a byte contributes at each distance from the end, and the constant of each length up to REACH."""
    constants = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)
    table = [[zlib.crc32(bytes([b]) + bytes(d)) ^ int(constants[d + 1]) for b in range(256)] for d in range(REACH)]
    return np.array(table, np.uint32), constants


@lru_cache(40)
def _moves(level: int) -> np.ndarray:
    """Four tables of 256 values that move a value over REACH * 2**level zero bytes."""
    if level == 0:
        one = [1 << i for i in range(32)]
        for _ in range(8 * REACH):
            one = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in one]
        moved = np.array(one, np.uint32)
    else:
        before = _moves(level - 1)
        moved = _moved(before, _moved(before, np.uint32(1) << np.arange(32, dtype=np.uint32)))
    bits = np.arange(256)[:, None] >> np.arange(8) & 1
    return np.stack([np.bitwise_xor.reduce(np.where(bits, moved[8 * k : 8 * k + 8], np.uint32(0)), 1) for k in range(4)])


def _moved(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    return tables[0][values & 255] ^ tables[1][values >> 8 & 255] ^ tables[2][values >> 16 & 255] ^ tables[3][values >> 24]


def _blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The linear part of the CRC of spans of 1 to REACH bytes."""
    table, _ = _contributions()
    out = np.zeros(len(starts), np.uint32)
    size = ends - starts
    upto = np.cumsum(size)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] - size[a] + LOOKUP, "right")))
        n = size[a:b]
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        found = table[np.repeat(n - 1, n) - inside, data[np.repeat(starts[a:b], n) + inside]]
        out[a:b] = np.bitwise_xor.reduceat(found, first)
        a = b
    return out


def crc_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes ``data[start:end]``; an empty span has CRC 0."""
    size, (_, constants) = ends - starts, _contributions()
    out = np.zeros(len(starts), np.uint32)
    short = np.flatnonzero((size > 0) & (size <= REACH))
    out[short] = _blocks(data, starts[short], ends[short]) ^ constants[size[short]]
    for i in np.flatnonzero(size > REACH).tolist():
        cuts = np.arange(int(ends[i]), int(starts[i]), -REACH)[::-1]  # the blocks' ends; the first block can be shorter
        values, level = _blocks(data, np.maximum(cuts - REACH, starts[i]), cuts), 0
        while len(values) > 1:
            values = np.concatenate([np.zeros(len(values) % 2, np.uint32), values])
            values = _moved(_moves(level), values[::2]) ^ values[1::2]
            level += 1
        out[i] = values[0] ^ np.uint32(_constant(int(size[i])))
    return out


@lru_cache(4096)
def _constant(length: int) -> int:
    return zlib.crc32(bytes(length))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts in UTF-8 (text i is ``data[offsets[i]:offsets[i + 1]]``) joined by one space: bytes, starts and ends of words, words of each text."""
    data = _FOLD[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = data > 0
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True  # words end with their text
    first = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | border[:-1])) if len(data) else np.zeros(0, np.int64)
    last = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | border[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    size = last - first
    ends = np.cumsum(size + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[inside]
    return out, ends - size, ends, np.bincount(np.searchsorted(offsets[1:], first, "right"), minlength=len(offsets) - 1)


def features(data: np.ndarray, offsets: np.ndarray, run: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each number of words up to ``run``: each feature's text and bucket, repeats included, in order."""
    joined, starts, ends, n = words(data, offsets)
    of = np.repeat(np.arange(len(n)), n)
    for k in range(1, run + 1):
        whole = np.flatnonzero(of[: max(0, len(of) - k + 1)] == of[k - 1 :]) if len(of) >= k else np.zeros(0, np.int64)
        yield of[whole], crc_spans(joined, starts[whole], ends[whole + k - 1]) % np.uint32(buckets)


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about CHUNK bytes with their bytes and offsets; null counts as empty."""
    text = pa.concat_arrays([batch.column(column).cast(pa.large_string())])
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(text) + 1, text.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        yield a, b, data, offsets[a : b + 1]
        a = b


def bucket_counts(docs: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` of the features of all texts; a task gives one row a bucket. Buckets that no feature has are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in _chunks(batch, text):
                for _, bucket in features(data, offsets, run, buckets):
                    n += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    bounded_batches(docs.sparkSession)
    return docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, gain)`` for every bucket from both sides' ``bucket_counts``: 1000 times the logarithm of the smoothed ratio, rounded down."""
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    for name, counts in (("s", corpus), ("t", target)):
        every = every.join(counts.withColumnRenamed("n", name), "bucket", "left").fillna(0, name)
    every = every.withColumns({f"all_{name}": F.sum(name).over(Window.partitionBy(F.lit(0))) for name in ("s", "t")})  # one row a bucket
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    return every.select("bucket", F.floor(1000 * F.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).cast("long").alias("gain"))


def weights(docs: DataFrame, gain: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """Every row without its text, with ``n_words``, ``n_features`` and ``weight``, the mean gain of its features rounded down (none: 0).

    The driver hands ``buckets`` gains to each task, a bound that the caller sets. The three new columns replace their namesakes.
    """
    table = np.zeros(buckets, np.int64)
    for r in gain.collect():  # one row a bucket
        table[r["bucket"]] = r["gain"]
    new = ["n_words", "n_features", "weight"]
    kept = [f for f in docs.schema if f.name not in (text, *new)]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _chunks(batch, text):
                n, sums, n_words = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for k, (of, bucket) in enumerate(features(data, offsets, run, buckets)):
                    count = np.bincount(of, minlength=b - a)
                    n, n_words = n + count, n_words if k else count
                    np.add.at(sums, of, table[bucket])
                out = [n_words, n, np.where(n > 0, sums // np.maximum(n, 1), 0)]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(a, b - a) for f in kept), *map(pa.array, out)], [*(f.name for f in kept), *new])

    bounded_batches(docs.sparkSession)
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{c} long" for c in new]
    return docs.select(text, *(f"`{f.name}`" for f in kept)).mapInArrow(weigh, ", ".join(schema))


def gumbel(id_: Column, seed: str = SEED) -> Column:
    """A thousandfold Gumbel value of the id (null: as an empty text), rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, run: int = RUN, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Every row's ``id_col, n_features, weight, score, rank``; ``rank`` counts the drawn ones from 1 and is null for the others.

    Words are runs of digits, letters and characters beyond ASCII, A-Z as a-z; features are runs of 1 to ``run`` words joined by a
    space. Of the N rows with ``least_words`` words or more, the floor(percent * N / 100) highest scores are drawn, ties to the smaller
    id, null ids last. A null or empty text has no features, weight 0 and is never drawn. Rows of equal id and score take their
    ranks one after the other. Extra columns are ignored. An empty target smooths all gains by the corpus alone; an empty table gives no rows.

    Ranks come from a range partitioning by score: each row's place in its part and the sizes of the parts before it.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    gain = gains(bucket_counts(docs, "text", run, buckets), bucket_counts(target.select(F.col(target_text).alias("text")), "text", run, buckets), buckets)
    rows = weights(docs, gain, "text", run, buckets).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    rows = land(rows.withColumn("row", F.monotonically_increasing_id()), "weights")
    able = rows.where(F.col("n_words") >= least_words)
    most = able.count() * percent // 100
    by = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    # an ordered part's rows are numbered from 2**33 times the part's number on
    parts = able.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    parts = land(parts.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "ordered")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a part
    rank = F.col("at") - F.shiftleft("part", 33) + F.col("before") + 1
    ranked = parts.join(sizes.select("part", before.alias("before")), "part").withColumn("rank", F.when(rank <= most, rank))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(*columns))
