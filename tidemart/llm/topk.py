"""Exact top-k by inner product with no-random-access aggregation.

Candidates are ordered by the two coarse centres nearest to them, so that similar ones stand together, and packed into
blocks; a block holds, for each dimension, the list of its candidates sorted by their component. A query reads a list
from its better end: downwards where the query's component is positive, upwards where it is negative. After each round of
sequential reads every candidate has a lower bound (unread components at their list's worst) and an upper bound (unread
components at their list's last read value). Reading stops for all but those whose upper bound can still reach the k-th
lower bound; their final scores are resolved by reading on for them alone.

The bar, a lower bound of a query's k-th score, is shared: a first pass reads for each query one block of its own cell,
and its k-th score there is known to all tasks of the second pass. A block whose heads, the first entries of its lists,
add up to less than the bar is not opened, and a group of such blocks is not even sent its queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, land

#: Candidates of a block, queries of a batch, blocks of a group, batches that one task reads for a group, groups whose heads one task holds.
BLOCK, QUERIES, RUN, BATCHES, HEADS = 1024, 128, 8, 32, 256
#: Shares of the lists after which bounds are tested.
ROUNDS = (1 / 8, 1 / 4, 1 / 2, 3 / 4, 1)
#: Vectors that serve as coarse centres: those of the smallest hashes.
CENTRES = 64
SCALE = 1024
_NONE = np.iinfo(np.int64).min


def valid(column: str) -> Column:
    """Not null, with components, none of them null or not finite."""
    return F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """Stretches of a batch with vectors ``v`` of one length: first row, end, and the vectors as a matrix."""
    sizes, flat = pc.list_value_length(batch.column("v")).to_numpy(), batch.column("v").flatten().to_numpy()
    ends = np.cumsum(sizes)
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)] if len(sizes) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield a, b, flat[ends[a] - sizes[a] : ends[b - 1]].reshape(b - a, -1)


def _with_cells(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``(id, v)`` with ``dim`` and ``cell``, which names the nearest and the second nearest centre by direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in _matrices(batch):
                c, cell = centres.get(x.shape[1]), np.zeros(b - a, np.int32)
                if c is not None:
                    near = x.astype(np.float64) @ c.T
                    first = near.argmax(1)
                    near[np.arange(b - a), first] = -np.inf
                    cell = (first * CENTRES + near.argmax(1)).astype(np.int32)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(b - a, x.shape[1], np.int32)), pa.array(cell)], ["id", "v", "dim", "cell"])

    return rows.mapInArrow(run, "id long, v array<long>, dim int, cell int")


def _centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """Directions of at most CENTRES different vectors of the smallest hashes, by length; lengths that none has get no centres."""
    found: dict[int, list[list[int]]] = {}
    for r in rows.select("v").orderBy(F.xxhash64("v")).limit(CENTRES).collect():
        found.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for dim, vectors in found.items():
        x = np.unique(np.array(vectors, np.float64), axis=0)
        out[dim] = x / np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))
    return out


def _packed(batches: Iterator[pa.RecordBatch], per_block: int) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Consecutive rows of one vector length, at most ``per_block`` together: their other columns and their vectors."""
    held: list[tuple[dict[str, np.ndarray], np.ndarray]] = []
    n = 0

    def together() -> tuple[dict[str, np.ndarray], np.ndarray]:
        return {c: np.concatenate([h[0][c] for h in held]) for c in held[0][0]}, np.concatenate([h[1] for h in held])

    for batch in batches:
        others = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "v"}
        for a, b, x in _matrices(batch):
            if held and held[0][1].shape[1] != x.shape[1]:
                yield together()
                held, n = [], 0
            while a < b:
                take = min(b - a, per_block - n)
                held.append(({c: o[a : a + take] for c, o in others.items()}, x[:take]))
                a, n, x = a + take, n + take, x[take:]
                if n == per_block:
                    yield together()
                    held, n = [], 0
    if held:
        yield together()


_BLOCKS = "block long, g int, dim int, n int, wide boolean, ids binary, values binary, places binary, hi binary, lo binary, cells array<int>"


def _blocks(rows: DataFrame) -> DataFrame:
    """Landed blocks of the rows of each partition, with a sorted list a dimension and the lists' first and last values."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = TaskContext.get().partitionId()
        for i, (other, x) in enumerate(_packed(batches, BLOCK)):
            places = np.argsort(x.T, 1, kind="stable")
            values = np.take_along_axis(x.T, places, 1)
            wide = bool(np.abs(values).max() >= 2**31)
            raw = [other["id"], values.astype(np.int64 if wide else np.int32), places.astype(np.int16), values[:, -1].copy(), values[:, 0].copy()]
            columns = [[(g << 32) + i], [g], [x.shape[1]], [len(x)], [wide], *([r.tobytes()] for r in raw), [np.unique(other["cell"]).tolist()]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 5, pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _BLOCKS.split(", ")])

    return land(rows.select("id", "v", "cell").mapInArrow(pack, _BLOCKS), "blocks")


def _batches(rows: DataFrame) -> DataFrame:
    """Landed batches of queries with the blocks that they read first (-1: none)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, (other, x) in enumerate(_packed(batches, QUERIES)):
            first = np.unique(other["seed"])
            columns = [[(part << 32) + i], [x.shape[1]], [other["id"].tobytes()], [x.tobytes()], [other["seed"].tobytes()], [first[first >= 0].tolist()]]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["asked", "dim", "q_ids", "q", "seeds", "first"])

    return land(rows.select("id", "v", "seed").mapInArrow(pack, "asked long, dim int, q_ids binary, q binary, seeds binary, first array<long>"), "batches")


def _exact(q: np.ndarray, x: np.ndarray) -> type:
    """Doubles where every sum of products stays below 2**53, which makes them exact, else integers."""
    small = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2.0**53
    return np.float64 if small else np.int64


def _sides(q: np.ndarray) -> np.ndarray:
    """Positive components, which read lists downwards, beside negative ones, which read them upwards."""
    return np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], 1)


def heads_of(q: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The most that any candidate of a block (a row of ``hi`` and ``lo``) can score for each query: the sum of its lists' heads."""
    kind = _exact(q, np.concatenate([hi, lo]))
    return (_sides(q.astype(kind)) @ np.concatenate([hi, lo], 1).T.astype(kind)).astype(np.int64)


def read_lists(q: np.ndarray, values: np.ndarray, places: np.ndarray, bar: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs of a query and a candidate that can be among the query's k best: query rows, candidates, exact scores; and the depth read.

    ``values`` and ``places`` hold a list a dimension, ascending; ``bar`` holds what each query's k-th score is known to
    reach; where it is unknown, it comes from the lower bounds. ``skip`` marks pairs that do not take part. Bounds are exact.
    """
    d, n = values.shape
    kind = _exact(q, values[:, [0, -1]])
    values, q, bar = values.astype(kind), q.astype(kind), bar.astype(kind)
    sides, at = _sides(q), np.arange(d)[:, None]
    read, seen = np.zeros((2 * d, n), kind), np.zeros((2 * d, n), bool)
    worst = np.concatenate([values[:, 0], values[:, -1]])[:, None]
    live, end = ~skip, 0
    unknown = np.flatnonzero(bar == _NONE) if n > k else np.zeros(0, np.int64)
    for share in ROUNDS:
        start, end = end, int(np.ceil(n * share))
        for half, stretch in ((0, slice(n - end, n - start)), (d, slice(start, end))):
            read[half + at, places[:, stretch]] = values[:, stretch]
            seen[half + at, places[:, stretch]] = True
        if end == n:
            break
        last = np.concatenate([values[:, n - end], values[:, end - 1]])[:, None]
        most = sides @ np.where(seen, read, last)
        if len(unknown):
            least = np.where(skip[unknown], _NONE, sides[unknown] @ np.where(seen, read, worst))
            bar[unknown] = np.maximum(bar[unknown], np.partition(least, n - k, 1)[:, n - k])
        live &= most >= bar[:, None]
        if 64 * live.sum() <= live.size:
            break
    rows, chosen = np.nonzero(live)
    if end < n:  # the outsiders cannot qualify: read on for the rest alone
        for a, b in ((0, n - end), (n - end, n)):
            read[at, places[:, a:b]] = values[:, a:b]
    kept, where = np.unique(chosen, return_inverse=True)
    return rows, chosen, (q @ read[:d, kept])[rows, where].astype(np.int64), end


class _Best:
    """The k best candidates found so far for each query of a batch."""

    def __init__(self, n: int, k: int, bar: np.ndarray):
        self.k, self.bar = k, bar
        self.rows, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.n = n

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, ids, scores = (np.concatenate(x) for x in ((self.rows, rows), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        self.rows, self.ids, self.scores = rows[keep], ids[keep], scores[keep]
        last = place == self.k - 1
        self.bar[rows[last]] = np.maximum(self.bar[rows[last]], scores[last])


def _numbers(raw: bytes, width: int, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(-1, width)


def _lists(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, values and places of a block."""
    values = _numbers(row["values"], row["n"], np.int64 if row["wide"] else np.int32).astype(np.int64)
    return np.frombuffer(row["ids"], np.int64), values, _numbers(row["places"], row["n"], np.int16).astype(np.int64)


def _first_bars(asked: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """``(asked, b_ids, bars)``: k-th scores of the queries in the blocks that they read first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                mine = np.frombuffer(x["seeds"], np.int64) == x["block"]
                q_ids, q = np.frombuffer(x["q_ids"], np.int64)[mine], _numbers(x["q"], x["dim"])[mine]
                ids, values, places = _lists(x)
                best = _Best(len(q), k, np.full(len(q), _NONE))
                rows, at, scores, _ = read_lists(q, values, places, best.bar, k, ids == q_ids[:, None])
                best.add(rows, ids[at], scores)
                known = best.bar > _NONE
                yield pa.RecordBatch.from_arrays([pa.array(np.full(known.sum(), x["asked"])), pa.array(q_ids[known]), pa.array(best.bar[known])], ["asked", "id", "bar"])

    first = asked.select("asked", "q_ids", "q", "seeds", F.explode("first").alias("block"))
    met = first.join(lists, "block").select("asked", "q_ids", "q", "seeds", "block", "dim", "n", "wide", "ids", "values", "places")
    bars = land(met.mapInArrow(run, "asked long, id long, bar long"), "bars")
    return bars.groupBy("asked").agg(F.collect_list(F.struct("id", "bar")).alias("bars"))  # at most QUERIES


def _bars(row: dict) -> np.ndarray:
    """A batch's bars in the order of its queries."""
    known = {b["id"]: b["bar"] for b in row["bars"] or []}
    return np.array([known.get(i, _NONE) for i in np.frombuffer(row["q_ids"], np.int64).tolist()], np.int64)


def _meetings(asked: DataFrame, lists: DataFrame, groups: int, shares: int) -> DataFrame:
    """``(asked, g)``: the groups with a block whose heads reach the bar of a query of the batch.

    A grid of cells: a task holds the heads of HEADS groups and reads a share of the batches past them, so that neither side meets in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for x in batch.to_pylist():
                if (x["h"], x["share"]) != now:
                    now, held = (x["h"], x["share"]), {}
                if x["asked"] < 0:
                    held.setdefault(x["dim"], []).append((x["g"], x["hi"], x["lo"]))
                    continue
                own = held.get(x["dim"], [])
                if own and isinstance(own, list):  # all heads of the cell stand before its batches
                    own = held[x["dim"]] = (np.array([g for g, _, _ in own], np.int32), *(_numbers(b"".join(o[i] for o in own), x["dim"]) for i in (1, 2)))
                if not len(own):
                    continue
                some = (heads_of(_numbers(x["q"], x["dim"]), own[1], own[2]) >= _bars(x)[:, None]).any(0)
                found = np.unique(own[0][some])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), x["asked"])), pa.array(found)], ["asked", "g"])

    cells = -(-groups // HEADS)
    blank = lambda df, columns: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns]
    head, ask = ["g", "hi", "lo"], ["q_ids", "q", "bars"]
    heads = lists.select(F.floor(F.col("g") / HEADS).cast("int").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "dim", F.lit(-1).cast("long").alias("asked"), *head, *blank(asked, ask))
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("h"), _share(shares).alias("share"), "dim", "asked", *blank(lists, head), *ask)
    both = heads.unionByName(sent).repartition(4 * cells * shares, "h", "share").sortWithinPartitions("h", "share", "asked")
    return land(both.mapInArrow(run, "asked long, g int"), "meetings")


def _share(shares: int) -> Column:
    """Which of so many shares a batch belongs to."""
    return F.pmod(F.xxhash64("asked"), F.lit(shares)).cast("int")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the k best rows of ``vectors`` by integer inner product.

    Components become floor(scale * x). A query is not compared with rows of its own id; ties go to the smaller id. Rows
    with a null id or an invalid vector (null, empty, a null or non-finite component) take no part, and vectors meet only
    vectors of the same length. Scores must fit 64 bits. Repeated rows are candidates each and repeated queries answer
    once. Fewer than k candidates are all returned; empty tables give no rows. Extra columns are ignored.
    """

    def rows(df: DataFrame) -> DataFrame:
        whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
        return df.where(valid(vector) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))

    bounded_batches(vectors.sparkSession)
    centres = _centres(rows(vectors))
    candidates = land(_with_cells(rows(vectors), centres), "candidates")
    groups = max(1, -(-candidates.count() // (BLOCK * RUN)))
    by = ["dim", "cell", F.xxhash64("id", "v")]
    lists = _blocks(candidates.repartitionByRange(groups, *by).sortWithinPartitions(*by))

    # a query reads first one of the blocks with its own cell, so that blocks of a large cell share its queries
    cells = lists.select("dim", "block", F.explode("cells").alias("cell"))
    slot = (F.row_number().over(Window.partitionBy("dim", "cell").orderBy("block")) - 1).cast("long").alias("slot")
    cells = cells.select("dim", "cell", "block", slot)
    sizes = cells.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("blocks"))
    known = _with_cells(rows(queries).groupBy("id").agg(F.min("v").alias("v")), centres).join(sizes, ["dim", "cell"], "left")
    known = known.withColumn("slot", F.pmod(F.xxhash64("id"), "blocks")).join(cells, ["dim", "cell", "slot"], "left")
    known = land(known.select("id", "v", "dim", F.coalesce("block", F.lit(-1).cast("long")).alias("seed")), "queries")
    parts = max(1, -(-known.count() // (QUERIES * BATCHES)))
    asked = _batches(known.repartitionByRange(parts, "dim", "seed", "id").sortWithinPartitions("dim", "seed", "id"))
    asked = asked.join(_first_bars(asked, lists, k), "asked", "left").select("asked", "dim", "q_ids", "q", "bars")

    # a task holds the blocks of a group and reads them for its share of the batches that meet the group
    shares = parts  # of about BATCHES batches
    met = _meetings(asked, lists, groups, shares).join(asked, "asked")
    blank = lambda df, columns: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns]
    block, ask = ["n", "wide", "ids", "values", "places", "hi", "lo"], ["q_ids", "q", "bars"]
    sent = met.select("g", _share(shares).alias("share"), "dim", "asked", *ask, *blank(lists, block))
    held = lists.join(sent.select("g", "share").distinct(), "g").select("g", "share", "dim", F.lit(-1).cast("long").alias("asked"), *blank(asked, ask), *block)
    both = held.unionByName(sent).repartition(4 * groups * shares, "g", "share").sortWithinPartitions("g", "share", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            for x in batch.to_pylist():
                if (x["g"], x["share"]) != now:
                    now, blocks = (x["g"], x["share"]), []
                if x["asked"] < 0:
                    blocks.append((x["dim"], *_lists(x), _numbers(x["hi"], x["dim"]), _numbers(x["lo"], x["dim"])))
                    continue
                own = [b for b in blocks if b[0] == x["dim"]]
                q_ids, q = np.frombuffer(x["q_ids"], np.int64), _numbers(x["q"], x["dim"])
                best = _Best(len(q), k, _bars(x))
                reach = heads_of(q, *(np.concatenate([b[i] for b in own]) for i in (4, 5)))
                for j in np.argsort(-reach.max(0)):
                    _, ids, values, places, _, _ = own[j]
                    open_ = np.flatnonzero(reach[:, j] >= best.bar)
                    if len(open_):
                        found, at, scores, _ = read_lists(q[open_], values, places, best.bar[open_], k, ids == q_ids[open_, None])
                        best.add(open_[found], ids[at], scores)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[best.rows]), pa.array(best.ids), pa.array(best.scores)], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
