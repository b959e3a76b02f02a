"""The registered queries and the pipeline's stages on the smallest generated tables, against SQL or brute force."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from tests.test_queries import rows
from tidemart.llm import langid, licenses, queries, secrets

from .test_small import PATH, PATTERN, naive_set

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").toPandas().set_index("doc_id")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got, expected = queries.queries()[name](spark, DATA).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)


def test_secret_spans(spark, docs):
    kinds = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    for r in queries.op2_secret_scans(spark, DATA).collect():
        found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, ok) in enumerate(kinds) for m in p.finditer(docs.text[r.doc_id]) if ok(m)]
        text = ",".join(x for _, _, x in sorted(found))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r.spans.split(","))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(i == k for _, k, _ in found) for i in range(3)]


def test_linked_secret_spans(spark, docs):
    """The method's half: every candidate against every other part of its text."""
    texts = [*docs.text, "client_id: abc99\nkey wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEYab, DB.Example.dev:5432\n\npassword=hunter22 a://b"]
    for text in texts:
        base = secrets.base_spans(text)
        plain = [x[1:] for x in base if x[0] != "access"]
        strong = [x[1:] for x in base if x[0] == "access"]
        named = lambda m: "secret" in re.search(r"[A-Za-z0-9_.-]*\Z", text[max(0, m.start() - 128) : m.start()])[0].lower()  # noqa: B023, E731
        ids = [m.span() for m in secrets._ID.finditer(text) if not named(m)]
        hit = lambda x, parts: any(a < x[1] and x[0] < b for a, b in parts)
        keys = [m.span() for m in secrets._KEY.finditer(text)]
        ends = secrets.endpoints(text)
        keys = [x for x in keys if not hit(x, plain + strong + ends)]
        breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]

        def meets(x, others):
            low = max([x[0] - 300, *(b for b in breaks if b <= x[0])])
            high = min([x[1] + 300, *(b for b in breaks if b > x[0])])
            return any(y != x and y[1] > low and y[0] < high for y in others)

        labelled = lambda x: re.search(r"""(?ai)secret[a-z0-9_.-]{0,64}["']?\x20*[:=]\x20*["']?\Z""", text[max(0, x[0] - 128) : x[0]])  # noqa: B023, E731
        wanted = {("linked_id", *x) for x in ids if meets(x, plain + keys)} | {("linked_endpoint", *x) for x in ends if meets(x, plain + keys)}
        wanted |= {("linked_secret", *x) for x in keys if meets(x, ids + strong + ends) or labelled(x)}
        assert set(secrets.linked_spans(text, base)) == wanted
    assert {k for k, *_ in wanted} == {"linked_id", "linked_secret", "linked_endpoint"}


def test_license_places(spark, docs):
    phrases = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
    for r in queries.op9_license_scans(spark, DATA).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", docs.text[r.doc_id].translate({c: c + 32 for c in range(65, 91)}))
        found = [(i, label) for p, label in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(found), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def naive_expression(tokens):
    """Identifiers and value of a whole expression by recursive descent, or None."""

    def primary(i):
        if i < len(tokens) and tokens[i] == "(":
            got = either(i + 1)
            return (got[0], got[1] + 1) if got and got[1] < len(tokens) and tokens[got[1]] == ")" else None
        ok = i < len(tokens) and tokens[i] not in ("(", ")", "or", "and", "with")
        return (({tokens[i].replace(":", "-")}, licenses.restricts(tokens[i])), i + 1) if ok else None

    def chain(word, below, join):
        def run(i):
            got = below(i)
            while got and got[1] < len(tokens) and tokens[got[1]] == word:
                more = below(got[1] + 1)
                if not more:
                    return None
                got = (join(got[0], more[0]), more[1])
            return got

        return run

    halved = chain("with", primary, lambda a, b: (a[0] | b[0], a[1] / 2))
    both = chain("and", halved, lambda a, b: (a[0] | b[0], max(a[1], b[1])))
    either = chain("or", both, lambda a, b: min(a, b, key=lambda x: (x[1], sorted(x[0]))))
    got = either(0)
    return got[0] if got and got[1] == len(tokens) else None


def test_license_labels(spark, docs):
    """The method's half: notices word by word, expressions by trying every start from the longest."""
    extra = {-1: "SPDX-License-Identifier: (MIT OR (GPL-2.0 AND Apache-2.0\nMozilla Public License", -2: "SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0 OR proprietary and more\nSPDX-License-Identifier: ISC AND ("}
    rows = spark.createDataFrame(list({**docs.text.to_dict(), **extra}.items()), "doc_id long, text string")
    tagged = 0
    for r in licenses.find_licenses(rows).collect():
        text = (extra | docs.text.to_dict())[r.doc_id].translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        line = " " + " ".join(words) + " "
        found = {label for phrase, label in [*licenses.BASE.items(), *licenses.NOTICES.items()] if f" {phrase} " in line}
        score, labels = max(map(licenses.restricts, found), default=0.0), set(found)
        for rest in re.findall(r"spdx-license-identifier:[ \t]*([^\r\n]*)", text):
            tokens = re.findall(r"[()]|[a-z0-9][a-z0-9.+:_-]*", rest)
            while tokens:
                got = next((x for n in range(len(tokens), 0, -1) if (x := naive_expression(tokens[:n]))), None)
                if got:
                    labels, score, tagged = labels | got[0], max(score, got[1]), tagged + 1
                if got or tokens[0] != "(":
                    break
                tokens = tokens[1:]
        assert (r.labels, r.score) == (sorted(labels), score)
    assert tagged >= 3


def test_tokens(spark, docs):
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op10_byte_level_bpe(spark, DATA).collect():
        ids = own.encode_ordinary(docs.text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs.text[r.doc_id].encode()).hexdigest()


def test_language(spark, docs):
    got = queries.op6_language_id(spark, DATA).toPandas().set_index("doc_id")
    assert len(got) == len(docs) and all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in docs.index)
    assert set(got.lang_pred) <= {*docs.lang, "und"} and got.score.between(0, 1).all()


def naive_grams(text):
    """Letters, pairs and triples of a text whose other runs of characters are one boundary; triples do not reach across one."""
    line = "_" + "_".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + "_"
    found = Counter(c for c in line if c != "_")
    if not found:
        return found
    found.update(line[i : i + 2] for i in range(len(line) - 1))
    found.update(line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != "_")
    return found


def test_language_by_rank_order(spark, docs):
    """Profiles, distances and scores with counters and lists."""

    def ranked(counts):  # ties by the characters' numbers, shorter grams first, boundaries first
        key = lambda g: sum((1 if c == "_" else ord(c)) << (21 * i) for i, c in enumerate(reversed(g)))
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], key(x[0])))][: langid.PROFILE]

    sums: dict = {}
    for i, text, lang in zip(docs.index, docs.text, docs.lang, strict=True):
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 5:
            sums.setdefault(lang, Counter()).update(naive_grams(text))
    places = {lang: {g: n for n, g in enumerate(ranked(c))} for lang, c in sums.items()}
    for r in queries.op6_language_id(spark, DATA).collect():
        top = ranked(naive_grams(docs.text[r.doc_id]))
        if not top:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        far = {lang: sum(abs(place[g] - n) if g in place else langid.PROFILE for n, g in enumerate(top)) for lang, place in places.items()}
        best = min(sorted(far), key=far.get)
        assert r.lang_pred == best and abs(r.score - (1 - far[best] / (langid.PROFILE * len(top)))) < 1e-9


def test_mix(spark, docs):
    got = queries.op5_mixing(spark, DATA).toPandas().set_index("doc_id")
    got["source"] = docs.source
    assert got["size"].to_dict() == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in docs.text.items()}
    size, taken, target = got.groupby("source")["size"].sum(), got.groupby("source").taken.sum(), got.groupby("source").target.first()
    assert (got.taken <= 2 * got["size"]).all() and (target <= 2 * size + 1e-6).all() and abs(target.sum() - 1.5 * size.sum()) < 1
    assert (abs(taken - target) <= got.groupby("source")["size"].max() / 2 + 1).all()
    # water is filled in small steps: the lowest level by weight among those with room
    order = sorted({s for s in docs.source if s is not None}) + [None] * int(docs.source.isna().any())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    room, left = {s: 2.0 * size[s] for s in order if s in size}, 1.5 * size.sum()
    level = dict.fromkeys(room, 0.0)
    while left > 1e-6:
        open_ = [s for s in room if level[s] < room[s] - 1e-9]
        step = min(left / sum(weight[s] for s in open_), *((room[s] - level[s]) / weight[s] for s in open_))
        for s in open_:
            level[s] += step * weight[s]
        left -= step * sum(weight[s] for s in open_)
    assert all(abs(target[s] - level[s]) < 1e-3 for s in room) and (got.groupby("source").source_size.first() == size).all()
    # what is taken are the draws of the shards, whose places are a permutation
    assert (got.taken == got.shards.map(len) * got["size"]).all()
    places: dict = {}
    for shards, found in zip(got.shards, got.places, strict=True):
        for s, p in zip(shards, found, strict=True):
            places.setdefault(s, []).append(p)
    assert len(places) >= 32 and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_pipeline_stages(spark, docs):
    first, near, secret, mix, last = (stage for _, stage in corpus_pipeline.STAGES)
    start = spark.read.parquet(f"{DATA}/documents.parquet")
    read = lambda df: df.toPandas().set_index("doc_id")
    one = first(spark, start, DATA).cache()
    kept = read(one)
    assert one.columns == start.columns and all(any(c.isalpha() for c in docs.text[i]) for i in kept.index) and len(kept) >= 0.97 * len(docs)
    two = near(spark, one, DATA).cache()
    sets, root = {i: naive_set(t, 5) for i, t in kept.text.items()}, {i: i for i in kept.index}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert set(read(two).index) == {i for i in sets if find(i) == i}
    three = secret(spark, two, DATA).cache()
    clean = read(three)
    assert three.columns == start.columns and not clean.text.str.contains(r'token = "[0-9a-f]{24}').any() and (clean.n_chars == clean.text.str.len()).all()
    four = mix(spark, three, DATA).cache()
    assert four.columns == start.columns and 1.3 < four.count() / three.count() < 1.8
    five = last(spark, four, DATA).collect()
    assert len(five) == four.count() and all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in five)


def test_pipeline_of_nulls_and_clashing_columns(spark):
    """Nulls in every column, and columns with the operators' names, which keep their values."""
    prose = [t for t in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) BETWEEN 300 AND 3000").limit(40).toPandas().text]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", None][i % 2], len(t)) for i, t in enumerate(prose)] + [(None, prose[0] + " and so on", None, None, None), (99, None, "en", "a", None), (98, "", "en", "a", 0), (1, prose[1], None, None, None)]
    names = ["spans", "shards", "shard", "score", "lang_pred", "size", "target", "source_size", "place", "_text", "_row", "_doc", "ids", "sig", "component"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*r, *(f"{n} {i}" for n in names)) for i, r in enumerate(rows)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        got = docs.collect()
        assert docs.columns == schema_names(schema) and all(r[n].split()[0] == n for r in got for n in names) and got, name
    ids = {r.doc_id for r in got}
    assert 99 not in ids and 98 not in ids
    assert len(corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()) == len(got)


def schema_names(schema):
    return [x.split()[0].strip("`") for x in schema.split(", ")]


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
