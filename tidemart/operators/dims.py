"""Enrichment of facts and summaries by dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich_sku(rows: DataFrame, sku: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows with the spu, trademark and category of their sku; rows of an unknown sku go. Spark picks the join by the table's size.

    ``partitions`` are those of a join with more skus than can be broadcast.
    """
    rows = rows.repartition(partitions, "sku_id") if partitions else rows
    return rows.join(sku.select(F.col("id").alias("sku_id"), "spu_id", F.col("tm_id").alias("trademark_id"), "category3_id"), "sku_id")


def category_chain(category3: DataFrame, category2: DataFrame, category1: DataFrame) -> DataFrame:
    """Categories of the third level with their parents' ids and names, joined once for all summaries."""
    second = category2.select(F.col("id").alias("category2_id"), F.col("name").alias("category2_name"), "category1_id")
    first = category1.select(F.col("id").alias("category1_id"), F.col("name").alias("category1_name"))
    third = category3.select(F.col("id").alias("category3_id"), F.col("name").alias("category3_name"), "category2_id")
    return third.join(second, "category2_id").join(first, "category1_id")


def name_of(rows: DataFrame, dim: DataFrame, key: str, name: str, column: str = "name") -> DataFrame:
    """Rows with the ``name`` of the dimension row that ``key`` names; rows without one go."""
    return rows.join(dim.select(F.col("id").alias(key), F.col(column).alias(name)), key)
