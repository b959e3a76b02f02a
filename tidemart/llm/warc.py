"""WARC archives written and read by Spark, one gzip member a record.

Archives are written by Spark's text writer, whose commit protocol keeps lost and repeated tasks from leaving partial
files, and read by its text reader with the gzip magic as the line separator: each task scans its byte range for the
magic and owns what starts inside. A stretch between two magics is only a candidate: the magic also occurs by chance in
compressed data, and in blocks that are stored as they are, which can hold whole archives. A candidate starts a record if
no member is open before it, and the rest of the gzip header and the WARC version decode; while a member has not
ended, all that follows belongs to it. A member that turns out to be damaged is dropped, and what it had taken is looked at anew.

Records that are still open at the end of a range are joined with the first stretches of the ranges after it, which are set
aside with their order; there are few, as a chance magic must fall into the record that crosses the border. Where such a record does
not end there either, what the next range took for records may stand inside it: then that file is read again from its start by one task, in order and record by record.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, land

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this many bytes are stored each time.
REVISIT_BYTES = 1000
VERSION = b"WARC/1.1\r\n"
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The writer's line separator. The last byte of a member, the high byte of its length, is left out where it equals it.
_END = "\x00"


def _as_stored(spark: SparkSession) -> dict[str, str]:
    """Reader options under which files named ``*.gz`` are read as stored, and so in ranges.

    Readers take the codec of the greatest known ending, spelled backwards, that is not behind the name; one that is just
    behind ".gz" and ends no name hides it. The option's name differs between builds of the reader's library.
    """
    codec = spark.sparkContext._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    return {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec", codec.OPT_EXTENSION: ".!.gz"}


def plan_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Pages with ``payload`` (null html: empty), ``payload_bytes``, ``payload_digest`` and ``refers_to``.

    Of equal payloads of at least ``revisit_bytes`` the one with the largest id is stored and the others refer to it. Rows
    that repeat that id are stored too; a null id refers to the largest, and is stored if all are null.
    """
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    large = rows.where(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_digest")
    stored = land(large.agg(F.max("page_id").alias("stored"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "stored"), "payloads")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("stored"))
    return rows.join(stored, "payload_digest", "left").withColumn("refers_to", F.when(other, F.col("stored"))).drop("stored")


def _member(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>"}
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    head["WARC-Date"] = "1970-01-01T00:00:00Z"
    head["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    if refers_to is not None:
        head |= {"WARC-Profile": _IDENTICAL, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += b"" if refers_to is not None else payload
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    raw = VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def write_archives(records: DataFrame, path: str) -> None:
    """Write a gzip member for each row of ``plan_records``; part files keep Spark's names, as a .gz name would stop readers from splitting them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                out = []
                for row in zip(*(rows.column(c).to_pylist() for c in names), strict=True):
                    member = _member(*row)
                    out.append(member[:-1] if member[-1:] == _END.encode() else member)  # else padding, which readers skip
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    bounded_batches(records.sparkSession)
    names = ["page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to"]
    members = records.select(*names).mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", _END).text(path)


def _starts(candidate: bytes) -> bool:
    """Whether the gzip header after the magic and the WARC version decode, as far as the candidate goes."""
    for size in (4096, len(candidate)):  # headers can be longer, but few are
        found = zlib.decompressobj(31)
        try:
            out = found.decompress(MAGIC + candidate[:size], len(VERSION))
        except zlib.error:
            return False
        if out or found.eof or size >= len(candidate):
            break
    return out.startswith(b"WARC/1.") or not found.eof and b"WARC/1.".startswith(out)


class _Members:
    """Records from the stretches of a file, in order; ``strays`` are stretches that belong to none."""

    def __init__(self) -> None:
        self.pieces: list[bytes] = []
        self.content: list[bytes] = []
        self.inflate = zlib.decompressobj(31)

    def feed(self, piece: bytes) -> tuple[list[bytes], list[bytes]]:
        """The contents of the records that end with this stretch, and the strays."""
        records, strays, waiting = [], [], [piece]
        while waiting:
            now = waiting.pop()
            if not self.pieces and not _starts(now):
                strays.append(now)
                continue
            self.pieces.append(now)
            try:
                self.content.append(self.inflate.decompress(MAGIC + now))
            except zlib.error:
                strays.append(self.pieces[0])
                waiting += self.drop()
                continue
            if self.inflate.eof:  # what follows the member's end is padding
                content = b"".join(self.content)
                if content.startswith(b"WARC/1."):
                    records.append(content)
                self.drop()
        return records, strays

    def drop(self) -> list[bytes]:
        """Give up the open member; all its stretches but the first, the last one first."""
        rest = self.pieces[:0:-1]
        self.pieces, self.content, self.inflate = [], [], zlib.decompressobj(31)
        return rest

    def end(self) -> list[bytes]:
        """The records among the stretches that a member took which does not end with its file."""
        records = []
        while self.pieces:
            for piece in reversed(self.drop()):
                records += self.feed(piece)[0]
        return records


def _number(text: str | None) -> int | None:
    """A length of a header, which can be said several times; None if it is no number or has more than 18 digits."""
    found = re.fullmatch(r"\s*([0-9]{1,18})\s*(?:,\s*\1\s*)*", text or "", re.ASCII)
    return int(found[1]) if found else None


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a record: the block's body if the block is an HTTP response.

    A block of missing or unreadable length reaches to the record's end.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    length = _number(fields.get("content-length"))
    block = rest.removesuffix(b"\r\n\r\n") if length is None else rest[:length]
    http, _, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    fields |= {"http-" + k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return fields, body


_READ = "record_id string, type string, url string, digest string, refers_to string, http_length long, payload binary"
_NAMES = ["record_id", "type", "url", "digest", "refers_to", "http_length", "payload"]


def _row(content: bytes) -> tuple:
    head, body = parse_record(content)
    return (*(head.get(f"warc-{c}") for c in ("record-id", "type", "target-uri", "payload-digest", "refers-to")), _number(head.get("http-content-length")), body)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: ``record_id, type, url, digest, refers_to, http_length, payload``, as its headers say.

    Files of gzip members are read in byte ranges whatever their names, ``*.warc.gz`` included. Bytes before a file's first
    magic are ignored, and so are members that are not WARC records. A record whose member is damaged or cut off is dropped, the ones behind it
    are not. All types of records come out (warcinfo, request, metadata, ...); of a header that repeats, the last value
    counts; a length that cannot be read is null, and a block of such a length reaches to its record's end; a payload is what is
    stored, in chunks if the server sent chunks. A file without records, or an empty folder of files, gives no rows.
    """
    bounded_batches(spark)
    stretches = _stretches(spark, path)
    blank = [None] * len(_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records, and as (file, block, part, raw) what may belong together across ranges: parts from -2**31 are the stretches of a
        record that is open at its range's end, parts from 0 those before the range's first record."""
        out: list[tuple] = []
        now, members, n, first = None, _Members(), 0, True  # n: strays so far

        def close() -> None:
            out.extend((*now, i - 2**31, raw, *blank) for i, raw in enumerate(members.pieces))
            members.drop()

        for batch in batches:
            for file, block, raw in zip(*(batch.column(c).to_pylist() for c in ("file_path", "file_block_start", "raw")), strict=True):
                if (file, block) != now:
                    if now:
                        close()
                    now, n, first = (file, block), 0, True
                    if block == 0:
                        continue  # what stands before the file's first magic
                records, strays = members.feed(raw)
                first &= not records
                out.extend((file, block, None, None, *_row(x)) for x in records)
                if first:
                    out.extend((file, block, n + i, x, *blank) for i, x in enumerate(strays))
                n += len(strays)
                if len(out) >= 256:
                    yield _found(out)
        if now:
            close()
        if out:
            yield _found(out)

    found = land(stretches.mapInArrow(run, _FOUND), "records")
    whole, pieces = found.where("part IS NULL"), found.where("part IS NOT NULL")
    if pieces.where("part < 0").isEmpty():
        return whole.select(*_NAMES)
    joined = land(_across(pieces), "across")
    unsure = joined.where("block = -1").select("file").distinct()
    whole, joined = (x.join(unsure, "file", "left_anti").select(*_NAMES) for x in (whole, joined))
    if unsure.isEmpty():
        return whole.union(joined)
    again = stretches.join(unsure.withColumnRenamed("file", "file_path"), "file_path", "left_semi")
    return whole.union(joined).union(_in_order(again).select(*_NAMES))


def _stretches(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, file_block_start, at, raw``: what stands between two gzip magics, in order."""
    lines = spark.read.options(**_as_stored(spark)).option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    place = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start")]
    return lines.select(*place, F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("raw"))


_FOUND = "file string, block long, part int, raw binary, " + _READ
_KINDS = {"file": pa.string(), "block": pa.int64(), "part": pa.int32(), "raw": pa.binary(), **dict.fromkeys(_NAMES, pa.string()), "http_length": pa.int64(), "payload": pa.binary()}


def _found(out: list[tuple]) -> pa.RecordBatch:
    """The rows as a batch of _FOUND, which empties the list."""
    done = pa.RecordBatch.from_pylist([dict(zip(_KINDS, x, strict=True)) for x in out], pa.schema(list(_KINDS.items())))
    out.clear()
    return done


def _across(pieces: DataFrame) -> DataFrame:
    """Records from the stretches of an open one and those that follow it in its file, up to the next open one; ``block`` -1: it ends in none of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, now, out = _Members(), None, []
        for batch in batches:
            for file, block, part, raw in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "part", "raw")), strict=True):
                if part == -(2**31) or file != now:
                    if members.pieces:
                        out.append((now, -1, *[None] * (2 + len(_NAMES))))
                    members.drop()
                    now = file
                if part < 0 or members.pieces:
                    out.extend((file, block, None, None, *_row(x)) for x in members.feed(raw)[0])
                if len(out) >= 256:
                    yield _found(out)
        if members.pieces:
            out.append((now, -1, *[None] * (2 + len(_NAMES))))
        if out:
            yield _found(out)

    # within a range its first stretches stand before the record that is open at its end
    ordered = pieces.withColumn("last", F.col("part") < 0).repartition("file").sortWithinPartitions("file", "block", "last", "part")
    return ordered.select("file", "block", "part", "raw").mapInArrow(run, _FOUND)


def _in_order(stretches: DataFrame) -> DataFrame:
    """The records of whole files, one task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, now, out = _Members(), None, []
        for batch in batches:
            for file, block, raw in zip(*(batch.column(c).to_pylist() for c in ("file_path", "file_block_start", "raw")), strict=True):
                if file != now:
                    out.extend((now, block, None, None, *_row(x)) for x in members.end())
                    now = file
                    if block == 0:
                        continue  # what stands before the file's first magic
                out.extend((file, block, None, None, *_row(x)) for x in members.feed(raw)[0])
                if len(out) >= 256:
                    yield _found(out)
        out.extend((now, None, None, None, *_row(x)) for x in members.end())
        if out:
            yield _found(out)

    ordered = stretches.repartition("file_path").sortWithinPartitions("file_path", "file_block_start", "at")
    return ordered.select("file_path", "file_block_start", "raw").mapInArrow(run, _FOUND)


def page_records(records: DataFrame) -> DataFrame:
    """What the archives of ``write_archives`` say of each page: ``page_id, payload_bytes, payload_digest, record_type, refers_to``, with url and payload.

    Digest and length of a response are taken anew from its payload; those of a revisit are in its headers.
    """
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:([0-9-]*)>', 1) AS BIGINT)")
    base32 = F.regexp_replace("digest", "^sha1:", "")
    is_response = F.col("type") == "response"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [None if x is None else base64.b32decode(x).hex() for x in batch.column("said").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said, pa.string())], [*batch.schema.names[:-1], "said"])

    revisits = records.where(~is_response).select(number("record_id").alias("page_id"), "url", "http_length", "type", number("refers_to").alias("refers_to"), base32.alias("said"))
    revisits = revisits.mapInArrow(run, "page_id long, url string, http_length long, type string, refers_to long, said string")
    responses = records.where(is_response).select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "url", "payload")
    return responses.union(revisits.select("page_id", F.col("http_length").alias("payload_bytes"), F.col("said").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "url", F.lit(None).cast("binary").alias("payload")))
