"""From documents to token ids in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.llm import bpe, hyperminhash, langid, mixing, secrets
from tidemart.llm.shared import land

#: Texts whose best language fits less than this are noise; clean prose of a few words stays well above.
LEAST_SCORE = 0.1


def _as_one(docs: DataFrame) -> DataFrame:
    """The rows as one struct, so that no operator's column meets one of their own."""
    return docs.select(F.struct("*").alias("_doc"))


def of_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: learned from all labelled texts; documents of no language, or of none with any likeness, go."""
    learned = langid.profiles(docs.select("text", "lang"), "text", "lang")
    found = langid.identify(_as_one(docs).withColumn("_text", F.col("_doc.text")), learned, "_text")
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("_doc.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates at five words and 0.8: of each group the document with the smallest id stays, and one row of it."""
    rows = hyperminhash.numbered(_as_one(docs))
    gone = hyperminhash.duplicates(rows.select("_row", "_doc.doc_id", "_doc.text"), "doc_id", "text", shingle=5, percent=80)
    return rows.join(gone, "_row", "left_anti").select("_doc.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: base and linked spans are replaced in the text, and ``n_chars`` follows."""
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns if c != "text")).alias("_doc"), F.col("text").alias("_text"))
    found = secrets.find_secrets(rows, "_text", redact="[SECRET]").withColumn("_doc", F.col("_doc").withField("text", F.col("_text")))
    length = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return found.select(F.col("_doc").withField("n_chars", length).alias("_doc")).select(*(F.col(f"_doc.`{c}`") for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a row for each time that the mix takes a document, in the order of its shard."""
    key = {"_id": F.col("doc_id"), "_digest": F.xxhash64("text")}
    sized = docs.select(F.struct("*").alias("_doc"), *(c.alias(n) for n, c in key.items()), "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.shuffled(mixing.mix(sized, key=[*key], size="size"), [*key]).select("_doc.*")


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the documents with their token ids; each text must come back from its ids."""
    rows = docs.select("doc_id", "source", "lang", "text", F.col("text").alias("_text"))
    coded = bpe.encode(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "_text", decoded=True)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "source", "lang", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("language ID", of_a_language),
    ("MinHash near-dedup", one_of_each_group),
    ("secret scans", without_secrets),
    ("mixing", mixed),
    ("byte-level BPE", as_tokens),
]

#: SQL expresses neither the profiles' ranking nor the byte-pair merges; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
