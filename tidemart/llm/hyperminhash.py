"""Near-duplicate documents by HyperMinHash sketches.

A document's distinct word shingles are hashed once. The leading bits of a hash name a bucket; of each bucket's smallest
hash a 16-bit register keeps the number of leading zeros (6 bits) and the next 10 bits (mantissa). Empty buckets borrow
the register of the first full bucket in a fixed random order of their own. Bands of registers make candidates, the share
of equal registers, corrected for chance collisions, estimates the Jaccard similarity, and what may reach the threshold
is confirmed on the full sets.

No bucket emits all its pairs. Equal sets are folded first. Then every member of a band meets the band's smallest member
only; components of the confirmed links follow. Members of one band that are still in different components then meet each
other inside tasks, in blocks, and only links that connect components come out. Two documents that share a band are
therefore either compared or already connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import bounded_batches, free_shuffles, land, scratch

BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
#: Chance of missing a band at the threshold; sets the registers of a band.
MISS = 1e-6
#: Standard deviations below the threshold at which an estimate rules a pair out.
MARGIN = 5.0
#: Members of a band compared in one block, and bytes of their sets, about.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Ids of at most so many texts are broadcast to find the texts (some 50 MB); more are joined by shuffling.
BROADCAST_ROWS = 1_000_000
#: Bytes of text hashed at once.
CHUNK = 500_000

_U = np.uint64
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_TABLE[65:91] = _TABLE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) | _U(1)
_ORDER = np.stack([_rng.permutation(BUCKETS) for _ in range(BUCKETS)])
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        _powers[:] = [
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 2**64))
        ]
    return _powers[0], _powers[1]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, concatenated, and their offsets.

    ``data`` holds UTF-8 bytes; text i is ``data[offsets[i]:offsets[i + 1]]``.
    """
    n_docs, base = len(offsets) - 1, offsets[0]
    offsets = offsets.astype(np.int64) - base
    data = data[base : base + offsets[-1]]
    word = ~_SPACE[data]
    first, last = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
    before, after = np.empty_like(word), np.empty_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[first], after[last] = False, False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    power, inverse = _power_tables(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * power[: len(data)])])
    words = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MIX[-1])
    doc = np.searchsorted(offsets[1:], starts, "right")
    counts = np.bincount(doc, minlength=n_docs)
    at = np.concatenate([[0], np.cumsum(counts)])

    n = max(0, len(words) - width + 1)
    whole = doc[:n] == doc[width - 1 :] if n else np.zeros(0, bool)
    hashes = sum((words[i : i + n] * _MIX[i] for i in range(width)), np.zeros(n, np.uint64))[whole] if n else np.zeros(0, np.uint64)
    of = doc[:n][whole] if n else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.array([sum(int(words[at[i] + j]) * int(_MIX[j + 32]) for j in range(counts[i])) % 2**64 for i in short], np.uint64)
        hashes, of = np.concatenate([hashes, extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    hashes = _mix(hashes)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n_docs))])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=n_docs))])


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set: equal for equal sets, and for others with a chance of about 2**-128."""
    sums = np.stack([np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(hashes * _MIX[40 + i]))]) for i in (0, 1)], 1)
    return sums[bounds[1:]] - sums[bounds[:-1]]


def registers(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``BUCKETS`` 16-bit registers for each set of sorted hashes (all zero for an empty set)."""
    n_docs = len(bounds) - 1
    of = np.repeat(np.arange(n_docs), np.diff(bounds))
    cell = of * BUCKETS + (hashes >> _U(64 - BUCKET_BITS)).astype(np.int64)
    least = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    rest = (hashes[least] << _U(BUCKET_BITS)) >> _U(11)  # 53 bits: exact as a double
    zeros = 53 - np.frexp(rest.astype(np.float64))[1]
    zeros[rest == 0] = 53
    mantissa = ((rest << (zeros + 1).astype(np.uint64)) & _U(2**53 - 1)) >> _U(53 - MANTISSA_BITS)
    out, full = np.zeros((n_docs, BUCKETS), np.uint16), np.zeros((n_docs, BUCKETS), bool)
    out.reshape(-1)[cell[least]] = (zeros.astype(np.uint16) << np.uint16(MANTISSA_BITS)) | mantissa.astype(np.uint16)
    full.reshape(-1)[cell[least]] = True
    rows = np.flatnonzero(full.any(1) & ~full.all(1))
    missing = ~full[rows]
    for t in range(BUCKETS):
        if not len(rows):
            break
        donor = _ORDER[:, t]
        r, b = np.nonzero(missing & full[rows][:, donor])
        out[rows[r], b] = out[rows[r], donor[b]]
        missing[r, b] = False
        left = missing.any(1)
        rows, missing = rows[left], missing[left]
    return out


def _text_chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about CHUNK bytes with their bytes and offsets; null counts as empty."""
    for low in range(0, batch.num_rows, 512):
        text = pa.concat_arrays([batch.column(column).slice(low, 512).cast(pa.large_string())])  # offsets from 0
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(text) + 1, text.offset * 8)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        start = 0
        while start < len(text):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK, "right")) - 1)
            yield low + start, low + end, data, offsets[start : end + 1]
            start = end


def _pack(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(values).tobytes()
    step = values.itemsize * (values.shape[1] if values.ndim == 2 else 1)
    return pa.array([raw[a * step : b * step] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())


def sketch(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """Every row with ``n_shingles``, ``sig`` (128-bit fingerprint of the set, null if empty) and ``registers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _text_chunks(batch, text):
                hashes, bounds = shingle_sets(data, offsets, shingle)
                size = np.diff(bounds)
                regs = registers(hashes, bounds)
                one = np.arange(b - a + 1)
                empty = pa.array(size == 0)
                blank = lambda x: pa.compute.if_else(empty, pa.scalar(None, pa.binary()), x)  # noqa: B023, E731
                rest = batch.slice(a, b - a)
                keep = [rest.column(i) for i, f in enumerate(rest.schema) if f.name != text]
                yield pa.RecordBatch.from_arrays(
                    [*keep, pa.array(size, pa.int64()), blank(_pack(fingerprints(hashes, bounds), one)), blank(_pack(regs, one))],
                    [*(f.name for f in rest.schema if f.name != text), "n_shingles", "sig", "registers"],
                )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text]
    return docs.mapInArrow(run, ", ".join([*kept, "n_shingles long, sig binary, registers binary"]))


def band_width(threshold: float) -> int:
    """Most registers a band can have with a miss chance of at most MISS at the threshold."""
    return max(r for r in range(1, 17) if (1 - threshold**r) ** (BUCKETS // r) <= MISS or r == 1)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of register rows, without the matches expected by chance."""
    big, small = np.maximum(n_a, n_b), np.minimum(n_a, n_b)
    ratio = small / big
    chance = 0.169919487159739 * 4 * ratio / (1 + ratio) ** 2 / 2**MANTISSA_BITS
    return ((a == b).mean(-1) - chance) / (1 - chance)


def _may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, t: float) -> np.ndarray:
    """False only where sizes or the estimate rule the threshold out."""
    least = np.minimum(n_a, n_b)
    slack = MARGIN * np.sqrt(t * (1 - t) / np.minimum(least, BUCKETS))
    return (least >= t * np.maximum(n_a, n_b) - 1e-9) & (estimate(a, b, n_a, n_b) >= t - slack)


def _promising(pairs: DataFrame, reps: DataFrame, t: float) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("sig").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("registers").alias(f"r_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                rows = {s: np.frombuffer(b"".join(x.column(f"r_{s}").to_pylist()), np.uint16).reshape(-1, BUCKETS) for s in "ab"}
                ok = _may_reach(rows["a"], rows["b"], x.column("n_a").to_numpy(), x.column("n_b").to_numpy(), t)
                yield x.select(["a", "b"]).filter(pa.array(ok))

    return pairs.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a binary, b binary")


def _reach(a: bytes, b: bytes, percent: int) -> bool:
    """Whether two sets of sorted hashes reach the threshold."""
    both = np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _full_sets(wanted: DataFrame, docs: DataFrame, reps: DataFrame, text: str, shingle: int) -> DataFrame:
    """``(sig, hashes)``, the whole sets, read again from the texts of the wanted ``sig`` only."""
    rows = land(wanted.distinct().join(reps.select("sig", "_row"), "sig").select("_row"), "wanted")
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _text_chunks(batch, text):
                hashes, bounds = shingle_sets(data, offsets, shingle)
                own = _pack(fingerprints(hashes, bounds), np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([own, _pack(hashes, bounds)], ["sig", "hashes"])

    found = docs.select("_row", text).join(rows, "_row").select(text).mapInArrow(sets, "sig binary, hashes binary")
    return land(found, "sets")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = [_reach(a.as_buffer(), b.as_buffer(), percent) for a, b in zip(x.column("h_a"), x.column("h_b"), strict=True)]
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    for side in ("a", "b"):
        pairs = pairs.join(full.select(F.col("sig").alias(side), F.col("hashes").alias(f"h_{side}")), side)
    return pairs.select("a", "b", "h_a", "h_b").mapInArrow(run, "a binary, b binary")


def _inside_bands(members: DataFrame, percent: int, width: int) -> DataFrame:
    """Confirmed links between different components within a band.

    A band of many members, or of large sets, is compared in pairs of blocks, so that a task holds two blocks' sets. A pair is compared in the first band it shares, on the full
    sets if the estimate allows it, and a block gives at most the links that connect its components.
    """
    sizes = land(members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.col("n_shingles")).alias("bytes")), "open")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    placed = members.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("sig"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("band", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sig", "component", "n_shingles", "registers", "hashes")
    placed = placed.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    used = BUCKETS // width * width

    def compare(group: list[dict]) -> Iterator[pa.RecordBatch]:
        i, j, k = (group[0][x] for x in "ijk")
        left, right = [x for x in group if x["own"] == i], [x for x in group if x["own"] == j]
        regs = np.frombuffer(b"".join(x["registers"] for x in right), np.uint16).reshape(-1, BUCKETS)
        size = np.array([x["n_shingles"] for x in right])
        root = {x["component"]: x["component"] for x in group}

        def find(c: bytes) -> bytes:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for at, x in enumerate(left):
            start = at + 1 if i == j else 0
            own = np.frombuffer(x["registers"], np.uint16)[None]
            to = start + np.flatnonzero(_may_reach(own, regs[start:], np.full(len(right) - start, x["n_shingles"]), size[start:], percent / 100))
            shared = (own[:, :used] == regs[to, :used]).reshape(len(to), used // width, width).all(2)
            for q in to[shared[:, k] & ~shared[:, :k].any(1)]:
                y = right[q]
                a, b = find(x["component"]), find(y["component"])
                if a != b and _reach(x["hashes"], y["hashes"], percent):
                    root[a] = b
                    yield pa.RecordBatch.from_arrays([pa.array([x["sig"]], pa.binary()), pa.array([y["sig"]], pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = [], None
        for x in batches:
            for row in x.to_pylist():
                if (row["band"], row["i"], row["j"]) != key:
                    if group:
                        yield from compare(group)
                    group, key = [], (row["band"], row["i"], row["j"])
                group.append(row)
        if group:
            yield from compare(group)

    return placed.mapInArrow(run, "a binary, b binary")


def numbered(docs: DataFrame) -> DataFrame:
    """The rows, landed with a number of their own as ``_row``, which tells apart what ids and texts do not."""
    return land(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id, kept``.

    Documents are linked where 100 * common shingles >= ``percent`` * all shingles of both; ``component_id`` is the smallest
    id reachable by links. A-Z count as a-z; words are runs without ASCII white space; a text of fewer words than
    ``shingle`` is one shingle. Null or empty texts and texts of white space have no shingles, are linked with nothing and
    kept. Rows with equal texts always share a component. A null id never becomes a component's id; a row with a null id
    that shares a component with an id is not kept; of a component of null ids only, one row is kept and the component is
    null. Rows repeating an id stand for themselves by their texts; ``kept`` says that a row has its component's id, so rows
    that repeat it are all kept (``duplicates`` leaves one). Extra columns are ignored. An empty table gives no rows.
    """
    out = _grouped(numbered(docs.select(F.col(id_col).alias("_id"), F.col(text).alias(text))), text, shingle, percent)
    gone = _gone(out.where("_id IS NULL AND component_id IS NULL"))
    out = out.join(gone.withColumn("gone", F.lit(True)), "_row", "left")
    kept = F.coalesce(F.col("_id") == F.col("component_id"), F.col("component_id").isNull()) & F.col("gone").isNull()
    return out.select(F.col("_id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def duplicates(rows: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``_row`` of all but one of each component of ``numbered`` rows; links as in ``near_duplicates``.

    The row with the smallest id stays, null last, and of rows that repeat it the one with the smallest number.
    """
    with scratch(rows.sparkSession):
        return _gone(_grouped(rows.select(F.col(id_col).alias("_id"), F.col(text).alias(text), "_row"), text, shingle, percent))


def _gone(grouped: DataFrame) -> DataFrame:
    first = F.min(F.when(F.col("_id").eqNullSafe(F.col("component_id")), F.col("_row")))
    large = grouped.where("sig IS NOT NULL").groupBy("component").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return land(grouped.join(land(large.select("component", "first"), "first"), "component").where("_row != first").select("_row"), "gone", keep=True)


def _grouped(own: DataFrame, text: str, shingle: int, percent: int) -> DataFrame:
    """``_id, text, _row`` -> ``_row, _id, n_shingles, sig, component, component_id``; a text without shingles has a null ``sig`` and ``component``."""
    bounded_batches(own.sparkSession)
    sketched = land(sketch(own.select("_row", "_id", text), text, shingle), "sketches")
    with scratch(own.sparkSession):
        ids = _components(own, sketched, text, shingle, percent)
    out = sketched.join(ids, "sig", "left").withColumn("component_id", F.when(F.col("sig").isNull(), F.col("_id")).otherwise(F.col("component_id")))
    return out.select("_row", "_id", "n_shingles", "sig", "component", "component_id")


def _components(own: DataFrame, sketched: DataFrame, text: str, shingle: int, percent: int) -> DataFrame:
    """``sig, component, component_id``: the component of each set, named by its smallest ``sig``, and the smallest id in it."""
    t = percent / 100
    reps = land(sketched.where("n_shingles > 0").groupBy("sig", "registers", "n_shingles").agg(F.min("_id").alias("first_id"), F.min("_row").alias("_row")), "sets")
    free_shuffles(own.sparkSession)
    width = band_width(t)
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("registers", 1 + 2 * width * i, 2 * width)) for i in range(BUCKETS // width)))
    entries = reps.select("sig", F.posexplode(keys).alias("k", "band"))
    bands = land(entries.groupBy("band").agg(F.min("sig").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    free_shuffles(own.sparkSession)
    shared = land(entries.join(bands, "band").where("sig != pivot").select("k", "band", "sig", "pivot", "n"), "entries")
    free_shuffles(own.sparkSession)
    star = land(_promising(shared.select(F.col("pivot").alias("a"), F.col("sig").alias("b")).distinct(), reps, t), "pairs")
    full = _full_sets(star.select(F.col("a").alias("sig")).union(star.select("b")), own, reps, text, shingle)
    links = land(_confirmed(star, full, percent), "links")
    free_shuffles(own.sparkSession)
    labels = connected_components(links, "a", "b").withColumnRenamed("node", "sig")
    members = shared.where("n > 2").select("k", "band", "sig").join(labels, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    crossing = land(members.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("band"), "crossing")
    if not crossing.isEmpty():
        members = land(members.join(crossing, "band"), "members")
        full = _full_sets(members.select("sig"), own, reps, text, shingle)
        members = members.join(full.join(reps.select("sig", "n_shingles", "registers"), "sig"), "sig")
        more = land(_inside_bands(members, percent, width), "links")
        if not more.isEmpty():
            labels = connected_components(links.union(more), "a", "b").withColumnRenamed("node", "sig")
    free_shuffles(own.sparkSession)
    by_set = reps.select("sig", "first_id").join(labels, "sig", "left").select("sig", "first_id", F.coalesce("component", "sig").alias("component"))
    by_set = land(by_set, "members")
    least = land(by_set.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    return land(by_set.join(least, "component").select("sig", "component", "component_id"), "ids", keep=True)
