"""Connected components by hooking and contraction, as joins and partial aggregates over landed tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import land

#: So many edges, or fewer, are contracted by one task; with nodes of at most some 60 bytes, as vectors' and documents' are, that is some 100 MB.
LAST_EDGES = 200_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", last_edges: int = LAST_EDGES) -> DataFrame:
    """``(node, component)`` for every node that occurs in an edge; ``component`` is the smallest node reachable.

    Each round every component hooks onto its smallest smaller neighbour, the hooks are followed to their roots by
    pointer jumping, and the edges are rewritten between roots; edges inside a root vanish. Once few edges are left, one
    task unites their ends, which ends the rounds. Hubs are safe: minima are partial aggregates and both sides of each join
    are landed tables, whose hot keys Spark splits at run time. With ``last_edges`` 0 the rounds go on to the end, in
    DataFrame functions only; take that for nodes of unbounded length, too. Nodes can be of any type that sorts alike in Spark and in
    Python: integers, text, bytes. Edges with a null end and loops are ignored; repeated edges count once; no edges, no rows.
    """
    e = edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).where(
        F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
    )
    e = land(e.distinct(), "edges")
    labels = e.select(F.col("u").alias("node")).union(e.select("v")).distinct().withColumn("component", F.col("node"))
    labels = land(labels, "labels")
    while left := e.count():
        hooks = land(_united(e) if left <= last_edges else _hooked(e), "hooks")
        labels = land(
            labels.join(hooks, labels["component"] == hooks["c"], "left").select("node", F.coalesce("p", "component").alias("component")),
            "labels",
        )
        if left <= last_edges:
            break
        for end in ("u", "v"):
            to = hooks.select(F.col("c").alias(end), F.col("p").alias("root"))
            e = e.join(to, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        e = land(e.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    return labels


def _hooked(e: DataFrame) -> DataFrame:
    """``(c, p)``: the root that each component with a smaller neighbour hangs from."""
    hooks = land(e.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("p")), "hooks")
    while True:
        above = hooks.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        if hooks.join(above, "p", "left_semi").isEmpty():
            return hooks
        hooks = land(hooks.join(above, "p", "left").select("c", F.coalesce("pp", "p").alias("p")), "hooks")


def _united(e: DataFrame) -> DataFrame:
    """``(c, p)``: the smallest node that each other node reaches, from few edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x: object) -> object:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field("u").type
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = find(u), find(v)
                root[max(a, b)] = min(a, b)
        below = [x for x in root if find(x) != x]
        if below:
            yield pa.RecordBatch.from_arrays([pa.array(below, kind), pa.array(map(find, below), kind)], ["c", "p"])

    kind = e.schema["u"].dataType.simpleString()
    return e.coalesce(1).mapInArrow(run, f"c {kind}, p {kind}")
