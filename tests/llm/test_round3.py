"""Fingerprints, importance resampling and conversation repair: edge rows, known values and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemart.llm import components, conversations, fingerprint, licenses, queries, resample, urlfilter, warc
from tidemart.llm.shared import land

DATA = "/root/testdata/sf0.001"


def signed(n):
    return n - 2**64 if n >= 2**63 else n


def naive_shingles(text, shingle=5):
    """All shingle hashes of a text: a chain of the words' hashes."""
    words = [xxhash.xxh64(w.lower().encode(), seed=42).intdigest() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]

    def chain(part):
        seed = 42
        for x in part:
            seed = xxhash.xxh64(x.to_bytes(8, "little"), seed=seed).intdigest()
        return signed(seed)

    whole = [words] if 0 < len(words) < shingle else [words[i : i + shingle] for i in range(len(words) - shingle + 1)]
    return {chain(part) for part in whole}


def naive_edit(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def naive_resemblance(a, b, k=fingerprint.K):
    both = sorted(a | b)[:k]
    return sum(x in a and x in b for x in both) / len(both) if both else 1.0


def test_fingerprints_of_all_documents(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op11_document_fingerprints(spark, DATA).collect()}
    assert len(got) == len(docs)
    digits = lambda s: "".join(f"{x % 2**64:016x}" for x in sorted(s)[: fingerprint.K])
    for i, (doc_id, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        edited, r = naive_edit(text, following), got[doc_id]
        own, changed, after = map(naive_shingles, (text, edited, following))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (digits(own), digits(changed))
        assert (r.near_edited, r.near_next) == (naive_resemblance(own, changed), naive_resemblance(own, after))


def test_fingerprints_of_edge_rows(spark):
    """Null and repeated ids, null and empty texts, one hot row, long words and long white space."""
    giant, blank = "x" * 150_000, " " * 140_000
    docs = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "n u l l"), (7, None), (8, ""), (-2, "One two three four five six seven"), (9, f"{giant} b {blank}c d e f\t"), (10, blank), (3, "another text of id three"), *[(5, "hot row of a table with one of them")] * 1500]
    df = spark.createDataFrame([(i, t, "p", "q") for i, t in docs], "doc_id long, text string, range string, key string")
    got = fingerprint.with_next(df).collect()
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    wanted = Counter()
    for i, (doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1] or ""
        edited = naive_edit(text or "", following)
        wanted[doc_id, text or "", edited, *(tuple(sorted(naive_shingles(x))[: fingerprint.K]) for x in (text, edited, following))] += 1
    assert Counter((r.doc_id, r.text, r.edited, tuple(r.own), tuple(r.changed), tuple(r.following)) for r in got) == wanted
    assert fingerprint.with_next(df.limit(0)).collect() == []
    (alone,) = fingerprint.with_next(df.where("doc_id = 7")).collect()
    assert (alone.text, alone.edited, alone.own, alone.following) == ("", "", [], [])


def test_sketches_merge_and_estimate(spark):
    """Parts merged equal the whole; estimates are near what they stand for."""
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(9000)]
    a, b = " ".join(words[:6000]), " ".join(words[2000:])
    sets = [naive_shingles(x) for x in (a, b)]
    df = spark.createDataFrame([(a, b)], "a string, b string").select(*(fingerprint.sketch(F.col(c)).alias(c) for c in "ab"))
    row = df.select("a", "b", fingerprint.merged(F.col("a"), F.col("b")).alias("m"), fingerprint.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprint.containment(F.col("a"), F.col("b")).alias("c"), fingerprint.distinct_shingles(F.col("a")).alias("n")).first()
    assert row.a == sorted(sets[0])[: fingerprint.K] and row.m == sorted(sets[0] | sets[1])[: fingerprint.K]
    assert abs(row.r - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.15 and abs(row.c - len(sets[0] & sets[1]) / len(sets[0])) < 0.2 and abs(row.n / len(sets[0]) - 1) < 0.3
    parts = [(i % 3 if i % 3 else None, " ".join(words[100 * i : 100 * i + 90])) for i in range(60)] + [(9, None)]
    rows = spark.createDataFrame(parts, "g long, text string").select("g", fingerprint.sketch(F.col("text")).alias("s"))
    got = {r.g: r.s for r in fingerprint.merge_groups(rows, ["g"], "s").collect()}
    for g in (None, 1, 2):
        assert got[g] == sorted(set().union(*(naive_shingles(t) for k, t in parts if k == g)))[: fingerprint.K]
    assert got[9] == [] and len(got) == 4


def test_fingerprints_run_no_python(spark):
    plan = fingerprint.with_next(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow|MapPartitions|BatchEval", plan)


def test_crc_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 200_000).astype(np.uint8)
    starts = rng.integers(0, 100_000, 400)
    ends = starts + np.concatenate([np.arange(200), rng.integers(1000, 100_000, 200)])
    assert resample.crc_spans(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("run", [1, 3])
def test_features(run):
    texts = ["", "  !", "A b", "éÀ x1\x00Y", "z" * 300 + " a", "one. two. three. four", "漢字 kana　x"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    got = [Counter(zip(of.tolist(), bucket.tolist(), strict=True)) for of, bucket in resample.features(data, offsets, run, 997)]
    for k in range(1, run + 1):
        wanted = Counter()
        for i, t in enumerate(texts):
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
            wanted.update((i, zlib.crc32(" ".join(words[j : j + k]).encode()) % 997) for j in range(len(words) - k + 1))
        assert got[k - 1] == wanted


def test_resampling_of_edge_rows(spark):
    """Null, empty and repeated rows; brute force with other parameters; an empty target and an empty table."""
    rnd = random.Random(8)
    texts = [" ".join(rnd.choices("The quick, brown fox é jumps over 2 lazy dogs".split(), k=rnd.randrange(12))) for _ in range(80)]
    docs = [(i // 2, t) for i, t in enumerate(texts)] + [(None, texts[3] + " a b c d"), (90, None), (91, ""), (92, "?!"), *[(93, "the fox jumps over it")] * 3]
    target = ["the lazy fox jumps", None, "over over"]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, score int, bucket string")
    bench = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string")
    find = lambda t, k: [" ".join(w[i : i + j]) for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))] for j in range(1, k + 1) for i in range(len(w) - j + 1)]
    for wanted_target in (target, []):
        place = lambda x: zlib.crc32(x.encode()) % 50
        s, t = Counter(place(x) for _, y in docs for x in find(y, 2)), Counter(place(x) for y in wanted_target for x in find(y, 2))
        gain = [math.floor(1000 * math.log((t[i] + 1) * (s.total() + 50) / ((s[i] + 1) * (t.total() + 50)))) for i in range(50)]
        rows = []
        for i, y in docs:
            found = [gain[place(x)] for x in find(y, 2)]
            h = int(hashlib.sha256(f"z:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
            weight = sum(found) // len(found) if found else 0
            rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(find(y, 1)) >= 3))
        able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
        drawn = Counter((*r[:4], n + 1 if n < 30 * len(able) // 100 else None) for n, r in enumerate(able)) + Counter((*r[:4], None) for r in rows if not r[4])
        got = resample.resample(df, bench(wanted_target), percent=30, least_words=3, run=2, buckets=50, seed="z")
        assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == drawn
    assert resample.resample(df.limit(0), bench(target)).collect() == []


def naive_repair(rows):
    """Every edit sequence with up to two insertions at each place; rows: role, text, gone, truncated."""
    best = None

    def go(i, cost, letters, out):
        nonlocal best
        if best and cost > best[0]:
            return
        for more in ((), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")):
            c, word, kept = cost + 5 * len(more), letters + "I" * len(more), out + tuple((r, "") for r in more)
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept)) and (best is None or (c, word) < best[:2]):
                    best = (c, word, kept)
                continue
            role, text, gone, cut = rows[i]
            go(i + 1, c + 2, word + "D", kept)
            if not gone:
                go(i + 1, c + 5 * cut, word + "K", (*kept, (role, text)))
                for r in ("user", "assistant"):
                    go(i + 1, c + 5 * cut + 1, word + "R", (*kept, (r, text)))

    go(0, 0, "", ())
    return best


def carried(rows):
    """Whole edit strings carried for each state."""
    step = conversations._NEXT

    def insert(best):
        for _ in range(4):
            for s, (c, w, out) in list(best.items()):
                for r in ("user", "assistant"):
                    if (t := step.get((s, r[0]))) is not None and (t not in best or (c + 5, w + "I") < best[t][:2]):
                        best[t] = (c + 5, w + "I", (*out, (r, "")))
        return best

    best = insert({0: (0, "", ())})
    for role, text, gone, cut in rows:
        new = {}
        for s, (c, w, out) in best.items():
            edits = [(s, c + 2, "D", ())]
            if not gone:
                edits += [(step.get((s, role[:1])), c + 5 * cut, "K", ((role, text),))] + [(step.get((s, r[0])), c + 5 * cut + 1, "R", ((r, text),)) for r in ("user", "assistant")]
            for t, cost, letter, line in edits:
                if t is not None and (t not in new or (cost, w + letter) < new[t][:2]):
                    new[t] = (cost, w + letter, out + line)
        best = insert(new)
    return min((best[s] for s in (0, 3) if s in best), key=lambda x: x[:2])


def searched(rows):
    out, most = [], 0
    search = conversations.Search(lambda letter, row: out.append((letter, row)))
    for r in rows:
        search.add(*r)
        most = max(most, max(node.depth for _, node in search.survivors.values()) - search.root.depth)
    cost = search.end()
    return (cost, "".join(x for x, _ in out), tuple(r for _, r in out if r)), most


def test_repair_search():
    rnd = random.Random(5)
    for n in range(1500):
        size = rnd.randrange(4 if n < 200 else 60)
        roles = rnd.choice([["user", "assistant", "system"], ["user"], ["user", "assistant"], ["tool", "assistant", "system", "user", " "], ["system", "user"], ["assistant"]])
        rows = [(rnd.choice(roles), str(i), rnd.random() < 0.2, rnd.random() < 0.2) for i in range(size)]
        if n % 5 == 0:
            rows = [r if rnd.random() < 0.1 else (("user", "assistant")[i % 2], *r[1:]) for i, r in enumerate(rows)]
        assert searched(rows)[0] == (naive_repair(rows) if n < 200 else carried(rows))


def test_repair_emits_what_is_certain():
    rnd = random.Random(6)
    mixed = [(rnd.choice(("user", "assistant", "system")), "x", rnd.random() < 0.1, rnd.random() < 0.1) for _ in range(5000)]
    got, most = searched(mixed)
    assert got == carried(mixed) and most < 300
    tied = [("user", "x", False, False)] * 500  # two ways whose suffixes stay tied to the end
    assert searched(tied)[0] == carried(tied)


def test_repair_of_edge_rows(spark):
    """Null keys, turns, roles and texts, repeated and lost rows, and columns with names of the operator's own."""
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 4, "user", "cut"), (1, None, "system", "Be kind."), (2, 0, None, None), (None, 3, "user", "a."), (None, 3, "user", "a."), (None, 4, "assistant", "b?\t"), (3, 9, "assistant", "Only me!")]
    df = spark.createDataFrame([(*r, False, "x", "y") for r in rows] + [(4, 0, "user", "lost", True, "x", "y")], "conv_id long, turn long, role string, text string, gone boolean, seen string, place string")
    got = {r.conv_id: tuple(r)[1:] for r in conversations.report(df, gone="gone").collect()}
    sha = lambda *lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert got == {
        1: (2, 0, 0, 1, 0, 2, "KKKD", sha("system:Be kind.", "user:Hi.", "assistant:Yes.")),
        2: (0, 1, 0, 0, 0, 2, "D", sha()),
        None: (0, 0, 1, 0, 1, 2, "KDK", sha("user:a.", "assistant:b?\t")),
        3: (0, 0, 0, 0, 0, 2, "D", sha()),
        4: (0, 0, 0, 0, 0, 0, "", sha()),
    }
    edits = conversations.repair(df, gone="gone").where("conv_id = 1").orderBy("place").collect()
    assert [tuple(r)[1:] for r in edits] == [(0, "K", "system", "Be kind."), (1, "K", "user", "Hi."), (2, "K", "assistant", "Yes."), (3, "D", None, None)]
    assert conversations.report(df.limit(0)).collect() == []
    long = spark.createDataFrame([(7, i, ("user", "assistant")[i % 2], f"{i} " + "w " * 2000 + ".") for i in range(3000)], "conv_id long, turn long, role string, text string")
    (r,) = conversations.report(long).collect()
    assert (r.cost, r.audit, r.gaps) == (0, "K" * 3000, 0)
    assert [(x.place, x.edit) for x in conversations.repair(long).orderBy("place").collect()] == [(i, "K") for i in range(3000)]


def archive(record, payload, level=6, head=b"", http=b"", extra=b"", length=None):
    """A gzip member of one record; level 0 stores it as it is, ``extra`` goes into the gzip header."""
    block = b"HTTP/1.1 200 OK\r\n" + http + b"\r\n" + payload
    size = str(len(block)).encode() if length is None else length
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\n%sContent-Length: %s\r\n\r\n%s\r\n\r\n" % (record, head, size, block)
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    flags, more = (4, len(extra).to_bytes(2, "little") + extra) if extra else (0, b"")
    return b"\x1f\x8b\x08" + bytes([flags]) + b"\0\0\0\0\0\xff" + more + deflate.compress(raw) + deflate.flush() + zlib.crc32(raw).to_bytes(4, "little") + (len(raw) % 2**32).to_bytes(4, "little")


def read_in_ranges(spark, path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return {int(r.record_id[10:-1]): r for r in warc.read_archives(spark, str(path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [10**6, 400])
def test_warc_of_archives_in_archives(spark, tmp_path, size):
    """Blocks stored as they are that hold whole archives; members that are damaged, cut off, and of long gzip headers; in ranges of any size."""
    noise = random.Random(size).randbytes
    inner = archive(77, b"inner" * 30) + archive(78, b"more " * 30)
    parts = [archive(0, b"a" * 50), archive(1, b"b" + inner + b"c" * 100, level=0), archive(2, noise(900)), archive(3, noise(80), extra=noise(20_000)), archive(4, b"x" + inner + inner, level=0)]
    damaged = bytearray(archive(5, noise(400), level=0))
    damaged[-6] ^= 1
    parts += [bytes(damaged), archive(6, b"after"), archive(7, noise(600))[:300], archive(8, b"behind the cut"), archive(9, noise(300)), archive(10, b"end")[:-9]]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"before the first" + b"".join(parts))
    (tmp_path / "w" / "b.warc.gz").write_bytes(archive(20, b"sound") + archive(21, noise(500)))
    got = read_in_ranges(spark, tmp_path / "w", size)
    assert sorted(got) == [0, 1, 2, 3, 4, 6, 8, 9, 20, 21]
    assert got[1].payload == b"b" + inner + b"c" * 100 and got[4].payload == b"x" + inner + inner


def test_warc_of_unreadable_lengths(spark, tmp_path):
    (tmp_path / "w").mkdir()
    parts = [archive(0, b"zero", length=b"abc"), archive(1, b"one", http=b"Content-Length: 3, 3\r\n"), archive(2, b"two", http=b"Content-Length: 3, 4\r\n"), archive(3, b"three", http=b"Content-Length: -5\r\n", length=b""), archive(4, b"four", http="Content-Length: ٣\r\n".encode(), length=b"9" * 30), archive(5, b"five", length=b"12")]
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(parts))
    got = read_in_ranges(spark, tmp_path / "w", 10**6)
    assert [(bytes(got[i].payload), got[i].http_length) for i in range(5)] == [(b"zero", None), (b"one", 3), (b"two", None), (b"three", None), (b"four", None)]
    assert len(got) == 6


def test_url_filters_run_no_python(spark, monkeypatch):
    """Every plan of a judgement with aliases, over chains, stars and rings of some hundred pages; and what brute force says."""
    plans = []

    def landed(df, name, *rest):
        plans.append(df._jdf.queryExecution().toString())
        return land(df, name, *rest)

    monkeypatch.setattr(urlfilter, "land", landed)
    monkeypatch.setattr(components, "land", landed)
    rnd = random.Random(2)
    urls = [f"http://{rnd.choice(('a.com', 'b.net', 'c.org'))}/{rnd.choice(('en', 'es', 'x'))}/{i}" for i in range(400)]
    aliases = {i: i - 1 for i in range(1, 90)} | {i: 90 for i in range(91, 150)} | {i: rnd.randrange(150, 400) for i in range(150, 400, 2)}
    tag = lambda to: f'<html><head><link href="{to}" rel="canonical"></head>' if rnd.random() < 0.5 else f"<meta http-equiv=refresh content='0; url={to}'>"
    html = [tag(urls[aliases[i]]) if i in aliases else "<p>" for i in range(400)]
    html[3] += "<link rel=canonical " * 20_000 + "<meta http-equiv='refresh' content='" * 5000  # tags that never close
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").join(spark.createDataFrame(list(enumerate(html)), "page_id long, html string"), "page_id")
    rules = [("block", "net/es/"), ("allow", "com/"), ("block", "org/en/")]
    judged = urlfilter.judge(pages, rules)
    plans.append(judged._jdf.queryExecution().toString())
    root = list(range(400))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in aliases.items():
        root[find(i)] = find(j)
    rule = lambda u: "allow" if ".com/" in u else "block" if ".net/es/" in u or ".org/en/" in u else None
    bad = {find(i) for i, u in enumerate(urls) if rule(u) == "block"}
    assert {r.page_id: r.verdict for r in judged.collect()} == {i: rule(u) or ("block" if find(i) in bad else "allow") for i, u in enumerate(urls)}
    assert len(plans) > 8 and not any(re.search("Python|Pandas|InArrow|MapPartitions|BatchEval", p) for p in plans)


def test_license_expressions_of_any_length():
    """Long runs of brackets and of identifiers take time in proportion; what is passed over stays the least."""
    scanner = licenses.Scanner(licenses.BASE, licenses.NOTICES, (licenses.TAG,), licenses.RESTRICTS)
    labels = lambda text: scanner.scan(f"SPDX-License-Identifier: {text}")["labels"]
    began = time.thread_time()
    n = 100_000
    assert labels("(" * n) == [] and labels("(" * n + "MIT") == ["mit"] and labels("(" * n + "MIT" + ")" * n) == ["mit"] and labels("(" * n + "MIT" + ")" * 7 + " and ISC and (") == ["isc", "mit"]
    assert labels(" and ".join(f"x{i}" for i in range(n))) == sorted(f"x{i}" for i in range(n)) and labels(" or ".join(f"x{i}" for i in range(n))) == ["x0"]
    assert labels("-".join(["gpl"] * n)) == ["-".join(["gpl"] * n)] and labels("mit " + "(a)" * n) == ["mit"]
    assert time.thread_time() - began < 20

    def slowly(tokens):  # drops one leading bracket after the other
        def good(t):
            return any(t) and not re.search(r"\( \)", " ".join(t)) and _balanced(t)

        def _balanced(t):
            depth, operand = 0, False
            for x in t:
                if x == "(":
                    if operand:
                        return False
                    depth += 1
                elif x == ")":
                    if not operand or not depth:
                        return False
                    depth -= 1
                elif x in ("and", "or", "with"):
                    if not operand:
                        return False
                    operand = False
                else:
                    if operand:
                        return False
                    operand = True
            return operand and not depth

        while tokens:
            found = next((tokens[:k] for k in range(len(tokens), 0, -1) if good(tokens[:k])), None)
            if found or tokens[0] != "(":
                return found
            tokens = tokens[1:]
        return None

    rnd = random.Random(3)
    for _ in range(4000):
        tokens = ["("] * rnd.randrange(4) + rnd.choices(["(", ")", "a", "b", "and", "or", "with"], [2, 3, 4, 2, 2, 2, 1], k=rnd.randrange(9))
        wanted = slowly(tokens)
        got = licenses.postfix(" ".join(tokens))
        assert got == (licenses._yard(wanted) if wanted else None), tokens


def test_license_phrases_of_the_caller(spark):
    rows = [(1, "SPDX License Identifier MIT or more"), (2, "the SPDX license identifier is a tag"), (3, "spdx-license-identifier =\tGPL-2.0+ // x\nSPDX-License-Identifier: Zlib"), (4, "Acme house rules; X-Lic: acme-1 OR mit\r\n"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.base_labels, r.labels, r.score) for r in licenses.find_licenses(docs).collect()}
    assert got == {1: ([], ["mit"], 0.1), 2: ([], [], 0.0), 3: ([], ["gpl-2.0+", "zlib"], 0.7), 4: ([], [], 0.0), 5: ([], [], 0.0)}
    own = licenses.find_licenses(docs, base={"house rules": "house"}, notices={"acme": "acme"}, tags=("x lic",), table={"acme": 0.9, "house": 0.2, "mit": 0.1})
    got = {r.doc_id: (r.base_labels, r.labels, r.score) for r in own.collect()}
    assert got[4] == (["house"], ["acme", "house", "mit"], 0.9) and got[1] == ([], [], 0.0)
