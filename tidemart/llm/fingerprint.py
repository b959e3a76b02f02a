"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

Every shingle of ``shingle`` consecutive words has a 64-bit hash; a sketch holds the ``k`` smallest distinct ones in order.
The ``k`` smallest of two sketches together are the sketch of both texts' shingles, so a long text is sketched in stretches and
parts of a document, or documents of a group, are merged without their texts. The smallest hashes of a union are a
random sample of it: the share of them that both sides hold estimates the resemblance, those below both sides' bounds the
containment, and the place of the k-th among all hashes the number of distinct shingles. Sketches of fewer than ``k`` hashes
are whole sets, and what they give is exact.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import land

#: Hashes of a sketch, and words of a shingle.
K, SHINGLE = 128, 5
#: Shingles that are hashed before the smallest are taken.
STRETCH = 4096
#: Ranges of the order of ids for each shuffle partition; rows of a repeated document that one row is expanded into.
RANGES, COPIES = 4, 1024

_WORD = r"[^\x20\x09-\x0D]+"
#: Up to 65,536 characters that end with a word, or one longer word; so that only a piece's words stand as texts at a time.
_PIECE = r"(?s)[\x20\x09-\x0D]*+(?:.{0,65535}[^\x20\x09-\x0D](?=[\x20\x09-\x0D]|\z)|[^\x20\x09-\x0D]++|\z)"
_NONE = "array<bigint>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bottom(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The sketch of a text as an ascending array of at most ``k`` hashes.

    Words are runs without ASCII white space, in lower case. A text of fewer words than ``shingle`` is one shingle; a null text and one
    without words have an empty sketch. Equal texts have equal sketches. Long texts are read whole, in stretches of shingles
    of which each keeps its ``k`` smallest.
    """
    words = lambda piece: F.transform(F.regexp_extract_all(F.lower(piece), F.lit(_WORD), F.lit(0)), lambda w: F.xxhash64(w))
    hashes = F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECE), F.lit(0)), words))

    def stretches(h: Column) -> Column:
        last = F.size(h) - shingle  # the place of the last shingle
        of = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(shingle)))
        part = lambda p: _bottom(F.transform(F.sequence(p * STRETCH, F.least(p * STRETCH + STRETCH - 1, last)), of), k)
        return _bottom(F.flatten(F.transform(F.sequence(F.lit(0), F.floor(last / STRETCH).cast("int")), part)), k)

    few = lambda h: F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast(_NONE))
    return _let(hashes, lambda h: F.when(F.size(h) >= shingle, stretches(h)).otherwise(few(h)))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both sides' shingles."""
    return _bottom(F.concat(a, b), k)


def merge_groups(rows: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """``keys`` with one sketch a group, merged from the group's sketches; null keys are a group, null sketches count as empty.

    Equal hashes of a group are united where they are read and then by key and hash, so that a group of any size is spread;
    each task then passes on at most ``k`` hashes of a group.
    """
    every = rows.select(*keys).distinct()
    hashes = rows.select(*keys, F.explode(column).alias("_h")).distinct()
    first = hashes.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_n") <= k)
    found = first.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys))).agg(F.sort_array(F.collect_list("_h")).alias("_s"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return every.join(found, same, "left").select(*keys, F.coalesce("_s", F.array().cast(_NONE)).alias(column))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """About how many distinct shingles the sketched text has; exact below ``k``."""
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """About the share of all shingles of both that both have, 0 to 1; two empty sketches are alike."""
    share = lambda m: F.when(F.size(m) > 0, F.size(F.array_intersect(F.array_intersect(m, a), b)) / F.size(m)).otherwise(1.0)
    return _let(merged(a, b, k), share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """About the share of the shingles of ``a`` that ``b`` has, 0 to 1; an empty sketch is contained in each."""
    bound = lambda x: F.when(F.size(x) >= k, F.element_at(x, -1))
    low = F.least(bound(a), bound(b))  # null: both are whole sets
    known = F.filter(a, lambda x: low.isNull() | (x <= low))
    return _let(known, lambda x: F.when(F.size(x) > 0, F.size(F.array_intersect(x, b)) / F.size(x)).otherwise(1.0))


def as_text(a: Column) -> Column:
    """A sketch as hexadecimal digits, 16 a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def edited(text: Column, following: Column) -> Column:
    """A text whose last half, rounded down, is replaced by as many first characters of the following one, or all."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``id_col``, ``text``, ``edited``, and the sketches ``own``, ``changed`` (of the edited text) and ``following``.

    The next document is that of the next greater id, an integer; after the last comes the first, and a single document follows itself. Null ids come
    first. Rows of one id follow each other in the order of their texts' digests; rows that repeat id and text are all returned, each but the
    last followed by its like. A null text is empty. Extra columns are ignored. An empty table gives no rows.

    Ids are dealt into ranges by bounds of which the driver holds RANGES a shuffle partition, as a sort would. A text moves once, to its range, and the first one
    of each range moves to the range before, too. Repeated rows move once for all their copies.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.concat(F.coalesce(F.lpad(F.hex(F.col("id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit("!")), F.md5("text")))
    spark = docs.sparkSession
    keys = land(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")), "keys")
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = keys.select("key").repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id())
    bounds = sorted(r["first"] for r in found.groupBy("part").agg(F.min("key").alias("first")).collect())
    once, repeated = rows.withColumn("copies", F.lit(1).cast("long")), keys.where("copies > 1")
    again = not repeated.isEmpty()
    if again:
        whole = rows.join(repeated, "key").groupBy("key", "copies").agg(F.max("id").alias("id"), F.max("text").alias("text"))
        whole = land(whole.select("id", "text", "key", "copies"), "repeated")
        once = once.join(repeated.select("key"), "key", "left_anti").select(*whole.columns).unionByName(whole)
    if not bounds:
        bounds = [""]

    # the last bound that is not above the key, looked up among every so many bounds and then among those between
    step = math.isqrt(len(bounds)) + 1
    nested = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    as_lit = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    upto = lambda items: F.size(F.filter(items, lambda x: x <= F.col("key")))
    once = once.withColumn("outer", upto(as_lit([x[0] for x in nested], "array<string>")))
    once = once.withColumn("group", F.element_at(as_lit(nested, "array<array<string>>"), F.col("outer"))).withColumn("inner", upto(F.col("group")))
    at = ((F.col("outer") - 1) * step + F.col("inner") - 1).cast("int")
    home = F.struct(F.lit(False).alias("guest"), at.alias("range"))
    before = F.struct(F.lit(True).alias("guest"), F.pmod(at - 1, F.lit(len(bounds))).alias("range"))
    first = F.element_at("group", F.col("inner")) == F.col("key")
    placed = once.select("id", "text", "key", F.explode(F.when(first, F.array(home, before)).otherwise(F.array(home))).alias("p")).select("id", "text", "key", "p.*")
    w = Window.partitionBy("range").orderBy("guest", "key")
    paired = placed.withColumn("next_text", F.lead("text").over(w)).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    paired = paired.withColumns({"own": sketch(F.col("text"), k, shingle), "changed": sketch(F.col("edited"), k, shingle)})
    out = paired.withColumn("following", F.lead("own").over(w)).where("NOT guest").select("id", "text", "edited", "own", "changed", "following")
    if again:
        alike = whole.withColumn("edited", edited(F.col("text"), F.col("text")))
        alike = alike.withColumns({"own": sketch(F.col("text"), k, shingle), "changed": sketch(F.col("edited"), k, shingle)})
        alike = alike.withColumn("left", F.explode(F.expr(f"sequence(1L, copies - 1, {COPIES}L)"))).withColumn("n", F.least(F.lit(COPIES), F.col("copies") - F.col("left")))
        alike = alike.repartition("key", "left").withColumn("_", F.explode(F.expr("sequence(1L, n)")))
        out = out.unionByName(alike.select("id", "text", "edited", "own", "changed", F.col("own").alias("following")))
    return out.withColumnRenamed("id", id_col)
