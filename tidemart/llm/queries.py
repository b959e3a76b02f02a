"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, fingerprint, hnsw, hyperminhash, langid, licenses, mixing, resample, secrets, topk, urlfilter, warc
from .shared import land, new_path


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a page written to archives, and what the archives say of each page when read back."""
    path = new_path(spark, "warc")
    warc.write_archives(warc.plan_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    return warc.page_records(warc.read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: counts and digest of the base patterns' spans, and all spans with the linked ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = secrets.find_secrets(docs)
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE_KINDS))

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(n, secrets.BASE_KINDS), F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op3_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles overlap by 85 of 100."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return hyperminhash.near_duplicates(docs, "doc_id", "text", shingle=3, percent=85)


def op4_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label with a cosine of 0.98 or more."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hnsw.near_duplicates(vectors, "vec_id", "embedding", "label", 0.98).drop("recall")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's size and target, the words the mix takes of it, and the shards and places of its draws."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("row"))
    mixed = land(mixing.mix(sized, key=["doc_id", "digest"], size="size"), "mixed")
    draws = mixing.shuffled(mixed.select("row", "doc_id", "digest", "size", "shards"), ["doc_id", "digest"])
    draws = draws.groupBy("row").agg(F.sum("size").cast("long").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "place"))).alias("draws"))
    taken = F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    # what was taken, and where: shards and places in their order
    where = [F.coalesce(F.col("draws")[c], F.array().cast("array<long>")).cast("array<long>").alias(f"{c}s") for c in ("shard", "place")]
    return mixed.join(draws, "row", "left").select("doc_id", "size", "source_size", "target", taken, *where)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language from profiles of those that are not held out; a null id is neither learned from nor held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    learned = langid.profiles(docs.where(remainder != 0), "text", "lang")
    return langid.identify(docs.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "text"), learned)


#: Rules of the URL filter query: kind, and host with the start of the path.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows by integer inner product for every hundredth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, places of base phrases, labels and score of every text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    places = F.size("places")
    return licenses.find_licenses(docs).select(
        "doc_id",
        "n_words",
        places.cast("long").alias("n_base"),
        F.when(places > 0, F.element_at("places", 1)).alias("first_word"),
        F.when(places > 0, F.element_at("places", -1)).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    own, changed, following = map(F.col, ("own", "changed", "following"))
    return fingerprint.with_next(docs).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint.as_text(own).alias("fingerprint"),
        fingerprint.as_text(changed).alias("edited_fingerprint"),
        fingerprint.resemblance(own, changed).alias("near_edited"),
        fingerprint.resemblance(own, following).alias("near_next"),
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document by how much its words are those of the benchmark, and the ranks of the tenth that is drawn."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample.resample(docs, target, "doc_id", "text", "text", percent=10, least_words=20, run=1, buckets=10_000, seed="2024")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text's digest of every conversation after damage that hangs on its turns' checksums."""
    damaged = conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.report(damaged, gone="gone")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


#: CRC-32 in SQL: its table as a list, and the sum of a blob ``e`` beside that table.
_TABLE = """
    tab AS (
        SELECT list(c ORDER BY b) AS crc
        FROM (SELECT b, list_reduce([CAST(b AS BIGINT)] || [CAST(0 AS BIGINT) FOR i IN range(8)],
                                    lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)) AS c FROM range(256) t(b)))"""
_CRC = """xor(list_reduce([4294967295::BIGINT] || [CAST('0x' || substr(hex(e), 2 * i + 1, 2) AS BIGINT) FOR i IN range(octet_length(e))],
                        lambda c, b: xor(c >> 8, tab.crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"""

SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS stored FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> stored THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> stored THEN stored END AS refers_to
        FROM m""",
    "op3_hyperminhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN [array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)]
                                                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
        links AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT id, y FROM reach JOIN links ON x = r),
        c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
        SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept
        FROM c LEFT JOIN n ON n.doc_id = id""",
    "op4_hnsw_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
              AND len([x FOR x IN embedding IF x <> 0]) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (
            SELECT vec_id AS id, vec_id AS r FROM embeddings
            UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
        c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept
        FROM c LEFT JOIN n ON n.a = c.id""",
    # the pages have no canonical or refresh tags, so rules alone decide; aliases are tested against brute force
    "op7_url_filters": """
        WITH u AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*(/[^?#]*)', 1) AS path
            FROM pages),
        r AS (
            SELECT *, CASE
                WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
            END AS rule FROM u)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
        FROM r""",
    "op8_exact_top_k": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op12_importance_resampling": rf"""
        WITH {_TABLE},
        d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM documents),
        t AS (
            SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
            FROM benchmark),
        s AS (SELECT doc_id, unnest(ws) AS word FROM d),
        v AS (SELECT word, encode(word) AS e FROM (SELECT word FROM s UNION SELECT word FROM t)),
        h AS (SELECT word, {_CRC} % 10000 AS bucket FROM v, tab),
        n AS (
            SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
            FROM (SELECT word, 0 AS side FROM s UNION ALL SELECT word, 1 FROM t) JOIN h USING (word) GROUP BY bucket),
        a AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t FROM n),
        g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(n.t AS DOUBLE) + 1) * (a.s + 10000) / ((CAST(n.s AS DOUBLE) + 1) * (a.t + 10000)))) AS BIGINT) AS gain FROM n, a),
        w AS (SELECT doc_id, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM s JOIN h USING (word) JOIN g USING (bucket) GROUP BY doc_id),
        u AS (
            SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                   CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
            FROM d LEFT JOIN w USING (doc_id)),
        r AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM u),
        p AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE n_features >= 20)
        SELECT r.doc_id, n_features, weight, score, p.rank FROM r LEFT JOIN p ON p.doc_id = r.doc_id AND p.rank <= 10 * p.n // 100""",
    "op13_conversation_repair": rf"""
        WITH RECURSIVE {_TABLE},
        k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS e
            FROM conversations),
        f AS (SELECT k.*, {_CRC} % 20 AS x FROM k, tab),
        r AS (
            SELECT conv_id, turn, CASE x WHEN 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE x WHEN 0 THEN CAST([] AS INTEGER[]) WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM f),
        q AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
                   NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut
            FROM r),
        o AS (SELECT *, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair FROM q),
        c AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate,
                   count(*) FILTER (cut AND NOT seen AND NOT blank) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM o GROUP BY conv_id),
        -- the cheapest edits for each state: nothing yet, after s, after u, after a
        b AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS n, s, {{'cost': cost, 'audit': audit, 'lines': lines}} AS best
            FROM (SELECT DISTINCT conv_id FROM conversations),
                 (VALUES (0, 0, '', CAST([] AS VARCHAR[])), (2, 5, 'I', ['user:']), (3, 10, 'II', ['user:', 'assistant:'])) v(s, cost, audit, lines)
            UNION ALL
            SELECT conv_id, n, t, min({{'cost': cost, 'audit': audit, 'lines': lines}})
            FROM (
                SELECT conv_id, n, CASE WHEN i = 0 THEN t WHEN (t = 2) = (i = 1) THEN 3 ELSE 2 END AS t, cost + 5 * i AS cost, audit || repeat('I', CAST(i AS INTEGER)) AS audit,
                       lines || (CASE WHEN t = 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END)[1:i] AS lines
                FROM (
                    SELECT conv_id, n, CASE WHEN e.to = 'D' THEN s WHEN e.to = 's' AND s = 0 THEN 1 WHEN e.to = 'u' AND s <> 2 THEN 2 WHEN e.to = 'a' AND s = 2 THEN 3 END AS t,
                           best.cost + e.cost AS cost, best.audit || e.letter AS audit, best.lines || e.line AS lines
                    FROM (
                        SELECT b.conv_id, o.n, b.s, b.best, unnest([{{'letter': 'D', 'to': 'D', 'cost': 2, 'line': CAST([] AS VARCHAR[])}}] || CASE WHEN o.blank OR o.seen THEN [] ELSE [
                            {{'letter': 'K', 'to': CASE WHEN o.role[1] IN ('s', 'u', 'a') THEN o.role[1] ELSE '' END, 'cost': CASE WHEN o.cut THEN 5 ELSE 0 END, 'line': [o.role || ':' || o.text]}},
                            {{'letter': 'R', 'to': 'u', 'cost': CASE WHEN o.cut THEN 6 ELSE 1 END, 'line': ['user:' || o.text]}},
                            {{'letter': 'R', 'to': 'a', 'cost': CASE WHEN o.cut THEN 6 ELSE 1 END, 'line': ['assistant:' || o.text]}}] END) AS e
                        FROM b JOIN o ON o.conv_id IS NOT DISTINCT FROM b.conv_id AND o.n = b.n + 1)),
                    range(3) z(i)
                WHERE t IS NOT NULL)
            GROUP BY conv_id, n, t),
        m AS (
            SELECT b.conv_id, min(best) AS best
            FROM b JOIN (SELECT k.conv_id, coalesce(max(c.n), 0) AS n FROM k LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY k.conv_id) z
              ON z.conv_id IS NOT DISTINCT FROM b.conv_id AND z.n = b.n
            WHERE s IN (0, 3) GROUP BY b.conv_id)
        SELECT m.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
        FROM m LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM m.conv_id""",
}
