"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents are dealt by a hash, which also tells rows of one key apart, into blocks of about a sixteenth of a
shard; the hash order of the blocks is the source's random permutation. A source's quota is a number of whole epochs of its
blocks and a last, partial epoch. A binary tree then splits the quotas of all sources between output shards: a node passes
each half of its draws by a multivariate hypergeometric draw over its sources, so every split is exact and the shards
together hold exactly the quotas. A shard draws the next stretch of each source's permuted blocks, disjoint from all
others', and its rows are shuffled inside it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_shuffles, land

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a shard, about, and the least number of shards, about, that smaller ones make up; blocks of a shard.
SHARD_WORDS, LEAST_SHARDS, SHARD_BLOCKS = 4_000_000, 64, 16
#: Levels of the tree that one task splits for one node.
LEVELS = 4
CYCLE = (5.0, 2.0, 1.0)
#: Most of a source's words that its target can be.
MOST = 2.0
#: Rows that one task numbers at once in a running sum.
STRETCH = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, cycle: tuple[float, ...] = CYCLE, most: float = MOST) -> DataFrame:
    """``(source, size)`` with ``target``: weights repeat over the sources in code point order, null last.

    Sources share ``share`` of all words by weight; none gets more than ``most`` times its size, and what is left is shared
    again. That is min(most * size, level * weight) for one level, which is found in order of size by weight. One row a source.
    """
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*map(F.lit, cycle)), (rank % len(cycle) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("size")).withColumn("total", share * F.sum("size").over(every))
    up = every.orderBy(F.col("cap") / F.col("weight"), F.col("weight"), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(up), F.lit(0.0))).withColumn("free", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    # the level at which this source and all later ones are below their caps, if it is
    level = (F.col("total") - F.col("capped")) / F.col("free")
    rows = rows.withColumn("level", level).withColumn("stands", F.col("level") * F.col("weight") <= F.col("cap"))
    chosen = F.min(F.when(F.col("stands"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"]
    return rows.select("source", "size", F.least("cap", F.coalesce(chosen * F.col("weight"), "cap")).alias("target"))


def split_counts(counts: np.ndarray, levels: int, rng: np.random.Generator) -> np.ndarray:
    """Rows of counts for 2**levels equal shards, from the counts of one node."""
    rows = [counts]
    for _ in range(levels):
        halves = []
        for c in rows:
            left = _draw(c, int(c.sum()) // 2, rng)
            halves += [left, c - left]
        rows = halves
    return np.stack(rows)


def _draw(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate hypergeometric draw, source by source."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        rest -= c
        out[i] = min(c, n) if not rest else max(0, n - rest) if min(c, n) == max(0, n - rest) else _hypergeometric(c, rest, n, rng)
        n -= int(out[i])
    return out


def _hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` draws are good: by the distribution function around its mode, from the ratios of neighbouring chances.

    The chances further than twelve standard deviations from the mode add up to less than a double resolves.
    """
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 12 + int(12 * np.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))))
    low, high = max(0, n - bad, mode - reach), min(good, n, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    chance = np.concatenate([[0.0], np.cumsum(np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1))])
    upto = np.cumsum(np.exp(chance - chance.max()))
    return low + int(np.searchsorted(upto, rng.random() * upto[-1], "right"))


def running(rows: DataFrame, key: str, order: str, **sums: str) -> DataFrame:
    """Rows with, for each ``name=column``, the sum of the column over the key's earlier rows by ``order`` (a number, unique in its key).

    Sums of stretches are added up first and rows inside their stretch then, so that no task orders all rows of a key.
    """
    rows = rows.withColumn("_k", F.floor(F.col(order) / STRETCH))
    parts = rows.groupBy(key, "_k").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    inside, before = (Window.partitionBy(key, *more).orderBy(by).rowsBetween(Window.unboundedPreceding, -1) for more, by in ((["_k"], order), ([], "_k")))
    parts = parts.select(key, "_k", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    out = rows.join(parts, [key, "_k"]).withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{n}") for n, c in sums.items()})
    return out.drop("_k", *(f"_{n}" for n in sums))


def _splitter(step: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_key")
        node = int(rows["node"].iloc[0])
        parts = split_counts(rows["n"].to_numpy(np.int64), step, np.random.default_rng([seed, step, node]))
        return pd.concat(pd.DataFrame({"source_key": rows["source_key"], "node": (node << step) + i, "n": c}) for i, c in enumerate(parts))

    return split


def shard_ranges(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """``(source_key, n)`` -> ``(source_key, shard, first, n)``: each shard's stretch of the source's permuted blocks."""
    nodes = quotas.withColumn("node", F.lit(0).cast("long"))
    while depth > 0:
        step = min(LEVELS, depth)
        depth -= step

        nodes = nodes.groupBy("node").applyInPandas(_splitter(step, seed), "source_key long, node long, n long").where("n > 0")
        nodes = land(nodes, "split")
    return running(nodes.withColumnRenamed("node", "shard"), "source_key", "shard", first="n").select("source_key", "shard", "first", "n")


def mix(docs: DataFrame, key: list[str], size: str, source: str = "source", share: float = 1.5, cycle: tuple[float, ...] = CYCLE, most: float = MOST, seed: int = 7, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every row with ``source_size``, ``target`` and ``shards``: one output shard for each time that the mix takes it, or none.

    ``key`` are the columns whose hash orders a source; rows equal in them are told apart by the number they land with, so
    that they are dealt and taken one by one. ``size`` holds a row's words. A row is taken
    floor(target / source_size) times, and once more if it stands in the part of its source's hash order that fills what
    is left; the row at its end is taken if that comes nearer, so a source misses its target by half a row at most. Sources without
    words have target 0 and their rows are taken not at all. A null source is a source of its own. Reruns give the same;
    where rows are equal in ``key``, as long as the table is read in the same partitions.
    An empty table gives no rows. Other columns pass unchanged, but the three new ones are replaced.
    """
    kept = [c for c in docs.columns if c not in ("source_size", "target", "shards")]
    docs = land(docs.select(*(f"`{c}`" for c in kept)).withColumn("_r", F.monotonically_increasing_id()), "numbered")
    own = F.xxhash64(F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in key))
    source_key = F.xxhash64(F.lit(seed), F.col(source).isNull(), source)
    rows = land(docs.select("_r", own.alias("_h"), source_key.alias("_s"), F.col(size).alias("size"), F.col(source).alias("source")), "sizes")
    ties = land(rows.groupBy("_s", "_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_s", "_h", F.lit(True).alias("_tie")), "ties")
    docs = docs.select(F.struct(*(f"`{c}`" for c in kept)).alias("_doc"), "_r", own.alias("_h"), source_key.alias("_s"))
    if not ties.isEmpty():
        apart = F.when(F.col("_tie"), F.xxhash64("_h", "_r")).otherwise(F.col("_h"))
        rows, docs = (x.join(ties, ["_s", "_h"], "left").withColumn("_h", apart).drop("_tie") for x in (rows, docs))
    lean = rows.groupBy("_s").agg(F.first("source").alias("source"), F.sum("size").alias("size"))
    plan = targets(lean.select("source", "size"), share, cycle, most).withColumn("_s", F.xxhash64(F.lit(seed), F.col("source").isNull(), "source"))
    plan = plan.withColumn("epochs", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("int"))
    plan = land(plan.select("_s", F.col("size").alias("source_size"), "target", "epochs", (F.col("target") - F.col("epochs") * F.col("size")).alias("rest")), "targets")
    total = plan.agg(F.sum("target")).first()[0] or 0
    shard = max(1.0, min(shard_words, total / LEAST_SHARDS))
    depth = int(np.ceil(np.log2(max(1.0, total / shard))))
    # the hash's top 32 bits order a source; a block is an equal stretch of them
    blocks = F.ceil(F.col("source_size") / (shard / SHARD_BLOCKS)).cast("long")
    order = F.shiftrightunsigned("_h", 32)
    rows, docs = (x.join(plan, "_s").withColumn("_b", F.floor(order * blocks / F.lit(1 << 32)).cast("long")) for x in (rows, docs))
    rows = land(rows.select("_s", "_h", "_b", "size", "epochs", "rest"), "dealt")
    blocks = rows.groupBy("_s", "_b").agg(F.sum("size").alias("words"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"))
    blocks = running(blocks.withColumn("one", F.lit(1).cast("long")).withColumn("words", F.coalesce("words", F.lit(0))), "_s", "_b", place="one", sum="words")
    blocks = blocks.withColumn("room", F.col("rest") - F.col("sum")).withColumn("part", F.col("room") > 0)
    blocks = land(blocks.select("_s", "_b", "place", "words", "epochs", "room", "part"), "blocks")
    n = F.count(F.lit(1)) * F.max("epochs") + F.count_if("part")
    quotas = land(blocks.groupBy(F.col("_s").alias("source_key")).agg(n.cast("long").alias("n"), F.count(F.lit(1)).alias("cycle")).where("n > 0"), "quotas")
    drawn = shard_ranges(quotas.select("source_key", "n"), depth, seed)
    drawn = drawn.select("source_key", "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("at"))
    drawn = drawn.join(quotas.select("source_key", "cycle"), "source_key").withColumn("place", F.col("at") % F.col("cycle"))
    drawn = drawn.groupBy(F.col("source_key").alias("_s"), "place").agg(F.array_sort(F.collect_list(F.struct("at", "shard")))["shard"].alias("drawn"))
    dealt = blocks.join(drawn, ["_s", "place"], "left").select("_s", "_b", "room", "part", F.col("words").alias("_words"), F.coalesce("drawn", F.array().cast("array<long>")).alias("drawn"))
    dealt = land(dealt, "drawn")
    # in the block where the source's room ends, the rows in hash order up to the nearest place
    ends = dealt.where(F.col("part") & (F.col("room") < F.col("_words"))).select("_s", "_b", "room")
    edge = rows.join(ends, ["_s", "_b"]).groupBy("_s", "_h", "room").agg(F.sum("size").alias("size"))
    fits = edge.withColumn("sum", F.sum("size").over(Window.partitionBy("_s").orderBy("_h")))
    fits = land(fits.where("sum - size / 2 <= room").select("_s", "_h", F.lit(True).alias("fits")), "edge")
    free_shuffles(docs.sparkSession)
    docs = docs.join(dealt, ["_s", "_b"]).join(fits, ["_s", "_h"], "left")
    whole = F.col("part") & ((F.col("room") >= F.col("_words")) | F.col("fits"))
    taken = F.col("epochs") + F.when(whole, 1).otherwise(0)
    return docs.select(*(F.col(f"_doc.`{c}`") for c in kept), "source_size", "target", F.slice("drawn", 1, taken).alias("shards"))


def shuffled(mixed: DataFrame, key: list[str], seed: int = 7) -> DataFrame:
    """The mix itself: a row for each time that one is taken, with its ``shard`` and, from 0, its ``place`` in the shard's own random order.

    The rows of a shard stand together and in that order.
    A row that the mix does not take gives none, and so does an empty table. Null keys count as a value of their own; rows
    equal in ``key`` stand next to each other. ``shard`` and ``place`` replace columns of these names.
    """
    rows = mixed.drop("shard", "place").withColumn("shard", F.explode("shards"))
    order = F.xxhash64(F.lit(seed), "shard", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in key))
    rows = rows.withColumn("_order", order).repartition("shard").sortWithinPartitions("shard", "_order")
    place = F.row_number().over(Window.partitionBy("shard").orderBy("_order")) - 1  # which deals and sorts no further
    return rows.withColumn("place", place).drop("_order", "shards")
