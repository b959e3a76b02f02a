"""Near-duplicate vectors by hierarchical navigable small-world graphs, one a shard.

Equal vectors are folded first. The vectors of a label are dealt into shards of at most about ``SHARD``; a task builds a
shard's graph and stores it as a row. Every shard of a label is queried with every shard's vectors: a task holds the graphs of
a tile of shards and reads the vectors of a tile past them. A query's beam is widened while much of it are links, and a block's first
beam is widened until an audit, a fixed number of its queries compared with the whole shard, finds enough of their true
nearest vectors, which every query has, and of the true links, which may be rare. There is no other way than the graph; a
beam that has grown to a shard's size holds all of it. Links are verified by cosine in double precision and counted where
they are found; out of a task come the counts, the audits and the links that connect components.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import bounded_batches, land

#: Vectors of a shard, about, and bytes of their components; links of a vector in a layer (twice as many in the lowest); beam while building.
SHARD, SHARD_BYTES, LINKS, BUILD_BEAM = 8192, 32 << 20, 16, 48
#: First beam of a query, queries searched or inserted at once, audited queries of a block, recall an audit must find.
BEAM, BATCH, AUDITS, RECALL = 24, 256, 64, 0.995
#: Nearest vectors of an audited query that count, without those of its own direction.
NEAREST = 10
#: Shards in a tile: so many graphs are held by one task, and so many shards' vectors read past them.
TILE = 4
#: A beam that would be wider than this part of a shard takes in all of it.
WIDEST = 1 / 16
#: Makes every id a number that is not negative.
_OFFSET = Decimal(2**63)


def _beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each query from its entry nodes (-1: none), with similarities; not in order."""
    n = len(q)
    if beam >= len(x):  # all nodes fit
        return np.broadcast_to(np.arange(len(x), dtype=np.int32), (n, len(x))), q @ x.T
    seen = np.zeros((n, len(x)), bool)
    width = max(4, beam // 16)
    ids = np.full((n, beam), -1, np.int32)
    sims = np.full((n, beam), -np.inf, np.float32)
    open_ = np.zeros((n, beam), bool)

    def add(who: np.ndarray, found: np.ndarray) -> None:
        """Offer nodes (-1: none) to the beams of ``who``."""
        found = np.sort(found, 1)
        fresh = found >= 0
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        fresh &= ~seen[who[:, None], np.where(found < 0, 0, found)]
        r, c = np.nonzero(fresh)
        if not len(r):
            return
        seen[who[r], found[r, c]] = True
        s = np.full(found.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("ij,ij->i", q[who[r]], x[found[r, c]])
        all_ids, all_sims = np.concatenate([ids[who], found], 1), np.concatenate([sims[who], s], 1)
        all_open = np.concatenate([open_[who], fresh], 1)
        keep = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
        at = np.arange(len(who))[:, None]
        ids[who], sims[who], open_[who] = all_ids[at, keep], all_sims[at, keep], all_open[at, keep]

    add(np.arange(n), entry)
    while True:
        who = np.flatnonzero(open_.any(1))
        if not len(who):
            return np.where(np.isfinite(sims), ids, -1), sims
        s = np.where(open_[who], sims[who], -np.inf)
        best = np.argpartition(-s, min(width, beam) - 1, 1)[:, : min(width, beam)] if beam > width else np.broadcast_to(np.arange(beam), s.shape)
        at = np.arange(len(who))[:, None]
        use = np.isfinite(s[at, best])
        open_[who[:, None], best] = False
        near = links[np.where(use, ids[who[:, None], best], 0)]
        add(who, np.where(use[:, :, None], near, -1).reshape(len(who), -1))


def _choose(x: np.ndarray, q: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Of each query's candidates (-1: none), nearest first, those nearer to it than to any chosen one; -1 fills up."""
    sims = np.where(ids >= 0, (x[np.where(ids < 0, 0, ids)] @ q[:, :, None])[:, :, 0], -np.inf)
    order = np.argsort(-sims, 1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    v = x[np.where(ids < 0, 0, ids)]
    between = v @ v.transpose(0, 2, 1)
    chosen = np.zeros(ids.shape, bool)
    for k in range(ids.shape[1]):
        closest = np.where(chosen, between[:, k], -np.inf).max(1)
        chosen[:, k] = (ids[:, k] >= 0) & (sims[:, k] > closest) & (chosen.sum(1) < most)
    # room that is left goes to the nearest of the others, which keeps dense groups together
    spare = (ids >= 0) & ~chosen
    chosen |= spare & (np.cumsum(spare, 1) <= (most - chosen.sum(1))[:, None])
    out = np.full((len(ids), most), -1, np.int32)
    place = np.cumsum(chosen, 1) - 1
    r, c = np.nonzero(chosen)
    out[r, place[r, c]] = ids[r, c]
    return out


def _layer(x: np.ndarray, nodes: np.ndarray, entries: np.ndarray, most: int) -> np.ndarray:
    """Links of the nodes of one layer, inserted in order; ``entries``: for each, the nearest nodes of the layer above."""
    links = np.full((len(x), most), -1, np.int32)
    for start in range(0, len(nodes), BATCH):
        new = nodes[start : start + BATCH]
        q = x[new]
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        k = min(16, len(new) - 1)
        found = new[np.argpartition(-own, k - 1, 1)[:, :k]] if k > 0 else np.full((len(new), 1), -1, np.int32)
        if start:
            at = entries[start : start + BATCH]
            at = np.where((at >= 0) & np.isin(at, nodes[:start]), at, nodes[0])
            found = np.concatenate([found, _beam_search(x, links, q, at, BUILD_BEAM)[0]], 1)
        links[new] = _choose(x, q, found.astype(np.int32), most)
        back, to = np.repeat(new, most), links[new].reshape(-1)
        back, to = back[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        back, to = back[order], to[order]
        hit, first, count = np.unique(to, return_index=True, return_counts=True)
        if len(hit):
            offered = np.full((len(hit), int(count.max())), -1, np.int32)
            offered[np.repeat(np.arange(len(hit)), count), np.arange(len(to)) - np.repeat(first, count)] = back
            offered[(offered[:, :, None] == links[hit][:, None, :]).any(2)] = -1
            both = np.concatenate([links[hit], offered], 1)
            room = (both >= 0).sum(1) <= most
            full = np.flatnonzero(~room)
            links[hit[room]] = -np.sort(-both[room], 1)[:, :most]  # all of them, -1 last
            for a in range(0, len(full), BATCH):
                who = hit[full[a : a + BATCH]]
                links[who] = _choose(x, x[who], both[full[a : a + BATCH]], most)
    return links


def build(x: np.ndarray, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the highest down, each as its nodes and the links of all vectors in it (-1: none)."""
    order = np.random.default_rng([seed, len(x)]).permutation(len(x)).astype(np.int32)
    sizes = [len(x)]
    while sizes[-1] > 4 * LINKS:
        sizes.append(-(-sizes[-1] // LINKS))
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(len(sizes) - 1, -1, -1):
        nodes = order[: sizes[level]]
        layers.append((nodes, _layer(x, nodes, _descend(x, layers, x[nodes], 4), LINKS * (1 if level else 2))))
    return layers


def _descend(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, beam: int) -> np.ndarray:
    entry = np.full((len(q), 1), -1, np.int32)
    for nodes, links in layers:
        entry = np.where(entry < 0, nodes[0], entry)
        entry = np.concatenate([_beam_search(x, links, q[a : a + BATCH], entry[a : a + BATCH], beam)[0] for a in range(0, len(q), BATCH)]) if len(q) else entry
    return entry


def search(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, least: float, beam: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each query with the nodes found with a similarity of ``least`` or more, in no order; its beam widens while a quarter of it or more is found."""
    waiting, beam = np.arange(len(q)), min(beam, len(x))
    top = _entries(x, layers, q)
    while len(waiting):
        again = []
        for a in range(0, len(waiting), BATCH):
            who = waiting[a : a + BATCH]
            ids, sims = _beam_search(x, layers[-1][1], q[who], top[who], beam)
            ok = sims >= least
            wider = (4 * ok.sum(1) >= beam) & (beam < len(x))
            for i in np.flatnonzero(~wider).tolist():
                yield int(who[i]), ids[i, ok[i]]
            again.append(who[wider])
        waiting, beam = np.concatenate(again), _wider(beam, 4, len(x))


def _wider(beam: int, times: int, n: int) -> int:
    return times * beam if times * beam <= n * WIDEST else n


def _entries(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray) -> np.ndarray:
    top = _descend(x, layers[:-1], q, 4)
    return np.where(top < 0, layers[-1][0][0], top)


def audit(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, least: float, own: np.ndarray) -> tuple[int, int, int]:
    """The first beam that passes the audit, and how many of the nearest vectors the audit found and looked for.

    A sample of the queries must find RECALL of its nearest vectors and of its true links. ``own``: each query's own node
    (-1: not in the shard), which counts as neither.
    """
    sample = np.random.default_rng([13, len(q), len(x)]).permutation(len(q))[:AUDITS]
    sims = q[sample] @ x.T
    at = np.flatnonzero(own[sample] >= 0)
    sims[at, own[sample][at]] = -np.inf
    true = sims >= least
    sims[sims > 1 - 1e-6] = -np.inf
    k = min(NEAREST, len(x))
    near = np.argpartition(-sims, k - 1, 1)[:, :k].astype(np.int32)
    near[~np.isfinite(np.take_along_axis(sims, near, 1))] = -2
    of, top, beam = int((near >= 0).sum()), _entries(x, layers, q[sample]), min(BEAM, len(x))
    while True:
        ids = _beam_search(x, layers[-1][1], q[sample], top, beam)[0]
        met = int((ids[:, None, :] == near[:, :, None]).any(2).sum())
        if beam == len(x):
            break
        if met >= RECALL * of:
            hits = sum(int(true[i, f].sum()) for i, f in search(x, layers, q[sample], least, beam))
            if hits >= RECALL * true.sum():
                break
        beam = _wider(beam, 2, len(x))
    return beam, met, of


_INDEX = "label long, shard int, dim int, nodes array<string>, copies binary, x binary, layers array<binary>"


def _shards(vectors: DataFrame, shard: int) -> DataFrame:
    """A landed index row for each shard of each label and length."""
    most = F.greatest(F.lit(1), F.least(F.lit(shard), F.floor(SHARD_BYTES / (8 * F.col("dim")))))
    sizes = land(vectors.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("shards")), "labels")
    n = sizes.agg(F.sum("shards")).first()[0] or 1
    by = ["label", "dim", "shard"]
    rows = vectors.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("h"), F.col("shards")).cast("int"))
    rows = rows.select(*by, "node", "copies", "embedding").repartition(2 * n, *by).sortWithinPartitions(*by, "node")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def index() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            x = whole["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)
            x /= np.abs(x).max(1, keepdims=True)
            unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            layers = [y.astype(np.int32).tobytes() for pair in build(unit) for y in pair]
            row = {"label": now[0], "shard": now[2], "dim": now[1], "nodes": whole["node"].to_pylist(), "copies": whole["copies"].to_numpy().astype(np.int64).tobytes(), "x": x.tobytes(), "layers": layers}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("label", pa.int64()), ("shard", pa.int32()), ("dim", pa.int32()), ("nodes", pa.list_(pa.string())), ("copies", pa.binary()), ("x", pa.binary()), ("layers", pa.list_(pa.binary()))])
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in by], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(keys[a].tolist()) != now:
                    yield index()
                    held = []
                now = tuple(keys[a].tolist())
                held.append(batch.slice(a, b - a))
        if held:
            yield index()

    return land(rows.mapInArrow(pack, _INDEX), "shards")


def _links(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], copies: np.ndarray, q: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]], int, int]:
    """Verified links of each query, copies counted, and those (query, node) that connect components; with the audit's figures.

    What a query has found is verified, counted and united at once, and forgotten: a dense group is as many links as pairs.
    """
    length, q_length = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    unit, q_unit = (x / length[:, None]).astype(np.float32), (q / q_length[:, None]).astype(np.float32)
    beam, met, of = audit(unit, layers, q_unit, threshold - 1e-4, np.arange(len(q)) if same else np.full(len(q), -1))
    counts, ends = np.zeros(len(q), np.int64), []
    far = 0 if same else len(q)  # nodes stand behind the queries, or are the queries
    group = np.arange(len(q) + (0 if same else len(x)))
    for i, to in search(unit, layers, q_unit, threshold - 1e-4, beam):
        dots = (x @ q[i])[to] if 2 * len(to) > len(x) else x[to] @ q[i]
        to = to[dots / (length[to] * q_length[i]) >= threshold]
        to = to[to != i] if same else to
        counts[i] = copies[to].sum()
        apart = np.flatnonzero(group[far + to] != group[i])
        if len(apart):
            others, first = np.unique(group[far + to[apart]], return_index=True)
            ends += [(i, int(j)) for j in to[apart[first]]]
            group[np.isin(group, others)] = group[i]
    return counts, ends, met, of


def _found(shards: DataFrame, threshold: float) -> DataFrame:
    """Landed counts ``(node, n)``, connecting links ``(node, peer)`` and audits ``(label, dim, met, of)``."""
    by = ["label", "dim", "tile", "part"]
    tiles = shards.groupBy("label", "dim").agg(F.floor(F.max("shard") / TILE).cast("int").alias("last"))
    tasks = tiles.agg(F.sum((F.col("last") + 1) * (F.col("last") + 1))).first()[0] or 1
    placed = shards.join(tiles, ["label", "dim"]).withColumn("own", F.floor(F.col("shard") / TILE).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    columns = [*by, "read", "shard", "nodes", "copies", "x", "layers"]
    held = placed.withColumns({"tile": F.col("own"), "part": F.col("other"), "read": F.lit(False)})
    read = placed.withColumns({"tile": F.col("other"), "part": F.col("own"), "read": F.lit(True), "layers": F.lit(None).cast("array<binary>")})
    both = held.select(*columns).unionByName(read.select(*columns)).repartition(2 * tasks, *by).sortWithinPartitions(*by, "read", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.string()), ("n", pa.int64()), ("peer", pa.string()), ("label", pa.int64()), ("dim", pa.int32()), ("met", pa.int64()), ("of", pa.int64())])
        now, graphs = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                if tuple(r[c] for c in by) != now:
                    now, graphs = tuple(r[c] for c in by), []
                vectors = np.frombuffer(r["x"], np.float64).reshape(-1, r["dim"])
                if not r["read"]:
                    raw = [np.frombuffer(y, np.int32) for y in r["layers"]]
                    layers = [(a, b.reshape(len(r["nodes"]), -1)) for a, b in zip(raw[::2], raw[1::2], strict=True)]
                    graphs.append((r["shard"], r["nodes"], np.frombuffer(r["copies"], np.int64), vectors, layers))
                    continue
                for shard, nodes, copies, x, layers in graphs:
                    counts, ends, met, of = _links(x, layers, copies, vectors, r["shard"] == shard, threshold)
                    some = np.flatnonzero(counts)
                    out = {c: [None] * (1 + len(some) + len(ends)) for c in schema.names}
                    out["label"][0], out["dim"][0], out["met"][0], out["of"][0] = r["label"], r["dim"], met, of
                    out["node"][1:] = [r["nodes"][i] for i in some] + [r["nodes"][i] for i, _ in ends]
                    out["n"][1 : 1 + len(some)] = counts[some].tolist()
                    out["peer"][1 + len(some) :] = [nodes[j] for _, j in ends]
                    yield pa.RecordBatch.from_pydict(out, schema)

    return land(both.mapInArrow(run, "node string, n long, peer string, label long, dim int, met long, of long"), "links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, shard: int = SHARD) -> DataFrame:
    """One row per vector: ``id_col, n_links, component_id, kept, recall``; ids are integers.

    Vectors of one label and length are linked where their cosine is at least ``threshold``. A null label, a null or empty
    vector, one of zeros only, or with a null or non-finite component has no links and is kept. Copies are linked with
    each other and counted one by one. Links are found by search: none is false. ``recall`` is the share of their true
    nearest vectors that audited queries of the row's label and length have found (null: nothing to find); audits are samples
    that estimate what is missed and no bound (figures: README).
    A null id is never a component's id. Extra columns are ignored. An empty table gives no rows.
    """
    bounded_batches(vectors.sparkSession)
    ok = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label).cast("long").alias("label"), F.when(F.coalesce(ok, F.lit(False)), F.col(vector)).alias("v"))
    valid = rows.where("v IS NOT NULL").withColumn("h", F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(i), "label", "v")), 16, "0") for i in (1, 2))))
    nodes = valid.groupBy("h", "label", F.col("v").alias("embedding"), F.size("v").alias("dim")).agg(F.min(F.col("_id").cast("long")).alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = land(nodes.withColumn("node", _node(F.col("first"), F.col("h"))), "vectors")
    found = _found(_shards(nodes, shard), threshold)
    counts = found.where("n IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("peer IS NOT NULL"), "node", "peer")
    audits = found.where("of > 0").groupBy("label", "dim").agg((F.sum("met") / F.sum("of")).alias("recall"))
    by_node = nodes.select("h", "node", "copies", "label", "dim").join(counts, "node", "left").join(groups, "node", "left").join(audits, ["label", "dim"], "left")
    ids = land(by_node.select("h", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), _first_id(F.coalesce("component", "node")).alias("component_id"), "recall"), "ids")
    kept = F.coalesce(F.col("_id") == F.col("component_id"), F.col("component_id").isNull())
    linked = valid.select("_id", "h").join(ids, "h").select("_id", "n_links", "component_id", kept.alias("kept"), "recall")
    alone = rows.where("v IS NULL").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").cast("long").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("double").alias("recall"))
    return linked.unionByName(alone).withColumnRenamed("_id", id_col)


def _node(first: Column, h: Column) -> Column:
    """A text that sorts by the smallest id of equal vectors, null last, and names them."""
    digits = F.lpad((first.cast("decimal(20,0)") + F.lit(_OFFSET)).cast("decimal(20,0)").cast("string"), 20, "0")
    return F.concat(F.coalesce(digits, F.lit("~" * 20)), h)


def _first_id(node: Column) -> Column:
    digits = F.substring(node, 1, 20)
    return F.when(~digits.startswith("~"), digits.cast("decimal(20,0)") - F.lit(_OFFSET)).cast("long")
