"""Operator 8, WARC archives: one record a page, written and read back with salvage.

``write_archives`` writes uncompressed WARC 1.1 files with Spark's own text
sink (its line separator is the blank lines that end a record), under its commit
protocol. Of pages with equal payloads the one with the largest id is a response,
the others are revisit records that refer to it. ``read_archives`` reads whole
files, of bounded size, as binary rows.

The salvage reader also takes gzip members. When a check fails (version line,
length, end of record, digest of block, header or payload, a number that is none or beyond its
range, sizes that differ, gzip CRC) it searches for the
next valid member or version line, goes on with the records after it, and logs
the bytes between as a quarantined gap. A digest in the header's last line covers the lines
before it, so that an altered byte of ids or sizes is found too; a revisit's size stands in its block.

A file holds ``RECORDS_A_FILE`` records of up to ``SMALL_PAGE`` bytes, or as many larger
ones as keep it under ``FILE_BYTES``, so that it fits one binary row; tables with
larger pages take a second pass for them. Which pages revisit others is found on ids and digests
alone, as revisit records hold no payload. A Bloom filter of repeated digests and
their responses, and one of the digests that pass the first by chance, let pages whose record is
certain go straight to the writer; only responses of repeated payloads, and the few that
both filters can't tell, are deflated and shuffled to an exact join.

Defined cases: null html is an empty payload; very long html is one record; a null url
gives no target URI and blanks in one are escaped; a null id, or one that is no whole
number, is written as ``null`` and read back as null; rows that repeat an
id with the same payload have the same type; among equal payloads the largest id
wins, and rows that share it are all responses; an empty table gives no records; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalspark.llm.common import map_batches, materialise, scratch_path, text_or_empty
from shoalspark.llm.urls import bloom_blocks, blocks_for, flagged

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_A_FILE, SMALL_PAGE, FILE_BYTES = 1000, 1 << 18, 1 << 28
#: Pages that share a payload from which its digest is broadcast, and how many such digests there can be.
HOT, MAX_HOT = 100_000, 10_000

_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_HTTP = b"\r\n\r\n"
#: Bytes of a gzip member that are inflated at a time.
GULP = 1 << 16


def sha1_base32(column: Column) -> Column:
    """Bare upper-case base32 of a column's SHA-1; lambdas name what is used more than once, so that plans stay small."""
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    eight = lambda forty: F.concat(*(F.substring(F.lit(BASE32), (F.shiftright(forty, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(8)))
    return bound(F.sha1(column), lambda digest: F.concat(*(bound(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 10).cast("long"), eight) for i in range(4))))


def _mapped(df: DataFrame, name: str, kind: str, fn: Callable[[bytes], bytes]) -> DataFrame:
    """``df`` whose column ``name`` went through ``fn``, as ``kind``, batch by batch."""
    names = df.columns
    at = names.index(name)
    schema = ", ".join(f"`{c}` {kind if c == name else t}" for c, t in df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            new = [fn(x) for x in b.column(at).cast(pa.binary()).to_pylist()]
            yield {c: new if i == at else b.column(i) for i, c in enumerate(names)}

    return map_batches(df, run, schema)


def _revisits() -> Column:
    """Whether a page's record refers to another's; ids may be null."""
    return F.coalesce(F.col("response") > F.coalesce(F.col("id"), F.lit(-(1 << 63))), F.lit(False))


def payload_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, hot: int = HOT, max_hot: int = MAX_HOT, most_blocks: int | None = None
) -> DataFrame:
    """``(id, url, size, digest, response, payload)``: ``response`` is the id whose record holds the payload, which is null in revisits.

    ``most_blocks`` bounds the filters; a fuller one sends more payloads through the shuffle, with the same rows.
    """
    p = pages.select(F.col(id_col).try_cast("long").alias("id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("payload"))
    p = p.withColumn("digest", sha1_base32(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload"))
    columns = ["id", "url", "size", "digest", "response", "payload"]
    light = materialise(p.select("id", "url", "size", "digest"), "page-digests")
    counted = light.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = materialise(counted, "digests")
    keys, rows = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bound = max(hot, rows // max_hot)  # at most max_hot digests can have more
    often = repeated.where(F.col("n") > bound).select("digest", "response", F.lit(True).alias("often"))
    seldom = repeated.where(F.col("n") <= bound).select("digest", "response", F.lit(True).alias("repeats"))

    limit = {} if most_blocks is None else {"max_blocks": most_blocks}
    digest = [F.lit(0).alias("kind"), F.col("digest").alias("key")]
    of_response = lambda c: [F.lit(1).alias("kind"), F.concat("digest", F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit("null"))).alias("key")]
    first_blocks = blocks_for(2 * keys, **limit)
    first = materialise(bloom_blocks(seldom.select(*digest).unionByName(seldom.select(*of_response("response"))), first_blocks), "repeats-filter")

    def met(df: DataFrame) -> DataFrame:
        """Rows whose payload may repeat, with those of very common payloads settled."""
        held = df.where(F.col("size") >= least_bytes).join(F.broadcast(often), "digest", "left")
        return flagged(held.select("*", *digest), first, first_blocks, "maybe")

    asked = met(light)
    exact = asked.where("often is null and maybe").drop("often", "response").join(seldom, "digest", "left").select("id", "url", "size", "digest", "response", "repeats")
    exact = materialise(exact, "possible-repeats")
    again = materialise(exact.where("repeats is null").select("digest").distinct(), "false-repeats")
    second_blocks = blocks_for(again.count(), **limit)
    second = materialise(bloom_blocks(again.select(*digest), second_blocks), "false-repeats-filter")
    light_columns = ["id", "url", "size", "digest", "response"]
    revisits = asked.where("often").select(light_columns).unionByName(exact.where("repeats").select(light_columns)).where(_revisits())

    pages_met = met(p)
    pages_met = flagged(pages_met.select("*", *of_response("id")), first, first_blocks, "mine")
    pages_met = flagged(pages_met.select("*", *digest), second, second_blocks, "false_repeat")
    common = pages_met.where("often").where(~_revisits())
    single = pages_met.where("often is null and not maybe").withColumn("response", F.col("id"))
    small = p.where(F.col("size") < least_bytes).withColumn("response", F.col("id"))
    unsure = pages_met.where("often is null and maybe and (mine or false_repeat)").select("id", "url", "size", "digest", "payload")
    packed = _mapped(unsure, "payload", "binary", lambda x: zlib.compress(x, 1))
    joined = packed.join(seldom, "digest", "left").withColumn("response", F.when(F.col("repeats"), F.col("response")).otherwise(F.col("id"))).where(~_revisits()).select(columns)
    joined = _mapped(joined, "payload", "string", lambda x: zlib.decompress(x).decode("utf-8", "surrogatepass"))
    parts = [single, common, joined, revisits.withColumn("payload", F.lit(None).cast("string"))] + ([small] if least_bytes > 0 else [])
    return reduce(DataFrame.unionByName, (x.select(columns) for x in parts))


def warc_record(date: str = "1970-01-01T00:00:00Z") -> Column:
    """Text of one record, without the blank lines that end it."""
    eol = "\r\n"
    revisit = _revisits()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    size = F.col("size")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), size.cast("string"), F.lit(eol * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    uri = F.regexp_replace(F.regexp_replace("url", r"[\r\n\t]+", "%0A"), " ", "%20")
    head = F.concat(
        F.lit(f"WARC/1.1{eol}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{eol}WARC-Record-ID: "), name(F.col("id")),
        F.lit(f"{eol}WARC-Date: {date}"),
        F.coalesce(F.concat(F.lit(f"{eol}WARC-Target-URI: "), uri), F.lit("")),
        F.when(revisit, F.concat(F.lit(f"{eol}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{eol}WARC-Refers-To: "), name(F.col("response")))).otherwise(F.lit("")),
        F.lit(f"{eol}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit(f"{eol}WARC-Block-Digest: sha1:"), sha1_base32(block.cast("binary")),
        F.lit(f"{eol}Content-Type: application/http; msgtype=response{eol}X-Payload-Length: "), size.cast("string"),
        F.lit(f"{eol}Content-Length: "), F.octet_length(block).cast("string"),
    )
    return F.concat(head, F.lit(f"{eol}X-Header-Digest: sha1:"), sha1_base32(head.cast("binary")), F.lit(eol * 2), block)


def write_archives(pages: DataFrame, path: str, records_a_file: int = RECORDS_A_FILE, **columns) -> str:
    """Archives of all pages in the folders ``small`` and, if there are such pages, ``large`` under ``path``."""
    records = payload_records(pages, **columns)
    largest = pages.agg(F.max(F.octet_length(columns.get("html_col", "html")))).first()[0] or 0

    def write(part: DataFrame, name: str, most: int) -> None:
        part.select(warc_record().alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).text(posixpath.join(path, name))

    small = (F.col("size") <= SMALL_PAGE) | F.col("payload").isNull()
    write(records.where(small), "small", records_a_file)
    if largest > SMALL_PAGE:
        write(records.where(~small), "large", max(1, min(records_a_file, FILE_BYTES // largest)))
    return path


class Damage(ValueError):
    """A check on a record failed."""


def whole_number(value: str | None, name: str) -> int:
    """A number of at most 18 digits; raises Damage."""
    if not re.fullmatch("[0-9]{1,18}", value or ""):
        raise Damage(f"no valid {name}")
    return int(value)


def _digest_of(block: bytes) -> str:
    return base64.b32encode(hashlib.sha1(block).digest()).decode()


class Archive:
    """Bytes of a file with the places of its records."""

    def __init__(self, data: bytes) -> None:
        self.data, self.view = data, memoryview(data)
        self.blank = -1  # place of an empty line: the first one after all places before it that were asked for

    def _header_end(self, at: int) -> int:
        if self.blank < at:
            self.blank = self.data.find(_HTTP, at)
            if self.blank < 0:
                self.blank = len(self.data)
        return self.blank

    def _member(self, at: int) -> tuple[bytes, int]:
        """``(plain bytes, end)`` of the gzip member at ``at``."""
        d, out, end = zlib.decompressobj(31), [], at
        try:
            while not d.eof and end < len(self.data):
                out.append(d.decompress(self.view[end : end + GULP]))
                end += GULP
        except zlib.error as e:
            raise Damage(f"gzip member: {e}") from None
        if not d.eof:
            raise Damage("gzip member is cut short")
        return b"".join(out), min(end, len(self.data)) - len(d.unused_data)

    def record(self, at: int) -> tuple[dict[str, str], bytes, int]:
        """``(fields, block, end)`` of the record or gzip member at ``at``; raises Damage."""
        data = self.data
        if data[at : at + 3] == b"\x1f\x8b\x08":
            plain, member_end = self._member(at)
            fields, block, end = Archive(plain).record(0)
            if end != len(plain):
                raise Damage("gzip member holds more than a record")
            return fields, block, member_end
        if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), at):
            raise Damage("no version line")
        stop = self._header_end(at)
        if stop == len(data):
            raise Damage("header does not end")
        fields, line = {}, data.index(b"\r\n", at) + 2
        while line < stop:  # line by line: a version line ends it, so that no part of a header is read again and again
            ends = data.index(b"\r\n", line)
            key, colon, value = data[line:ends].decode("utf-8", "replace").partition(":")
            if not colon:
                raise Damage("header line without a colon")
            key = key.strip().lower()
            fields[key] = value.strip()
            if key == "x-header-digest" and fields[key] != f"sha1:{_digest_of(data[at : line - 2])}":
                raise Damage("header digest differs")
            line = ends + 2
        if "x-payload-length" in fields and "x-header-digest" not in fields:
            raise Damage("header digest is missing")
        begin = stop + 4
        end = begin + whole_number(fields.get("content-length"), "content length")
        if data[end : end + 4] != _HTTP:
            raise Damage("record does not end where its length says")
        block = data[begin:end]
        stated = fields.get("warc-block-digest", "")
        if stated.startswith("sha1:") and stated[5:] != _digest_of(block):
            raise Damage("block digest differs")
        return fields, block, end + 4


def salvage(data: bytes) -> Iterator[tuple]:
    """``("record", begin, end, fields, block)`` and ``("gap", begin, end, reason, None)``, in order."""
    archive, at = Archive(data), 0
    while at < len(data):
        try:
            fields, block, end = archive.record(at)
        except Damage as e:
            reason, gap, search = str(e), at, at + 1
            while True:  # the next place from which a whole record can be read
                m = _START.search(data, search)
                if not m:
                    yield "gap", gap, len(data), reason, None
                    return
                try:
                    fields, block, end = archive.record(m.start())
                    break
                except Damage:
                    search = m.start() + 1
            at = m.start()
            yield "gap", gap, at, reason, None
        yield "record", at, end, fields, block
        at = end


def _page(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", name or "")
    if m and (len(m[1]) > 20 or not -(1 << 63) <= int(m[1]) < 1 << 63):
        raise Damage("page id beyond 64 bits")
    return int(m[1]) if m else None


def _row(what: tuple) -> tuple:
    kind, begin, end, fields, block = what
    if kind == "record":
        try:
            return _record_row(begin, end, fields, block)
        except Damage as e:
            fields = str(e)
    return "gap", begin, end, fields, None, None, None, None, None, None


def _record_row(begin: int, end: int, fields: dict[str, str], block: bytes) -> tuple:
    payload = block.partition(_HTTP)[2] if fields.get("content-type", "").startswith("application/http") else block
    response = fields.get("warc-type") != "revisit"
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if response:
        found = _digest_of(payload)
        if digest and digest != found:
            raise Damage("payload digest differs")
        size, digest = len(payload), found
    else:  # its block, which is under a digest, ends with the size of the response's payload
        stated = re.search(rb"\r\nContent-Length: ([^\r\n]*)\r\n", block)
        size = whole_number(stated[1].decode("ascii", "replace") if stated else fields.get("x-payload-length"), "payload length")
    if "x-payload-length" in fields and size != whole_number(fields["x-payload-length"], "payload length"):
        raise Damage("payload length differs")
    return "record", begin, end, None, _page(fields.get("warc-record-id")), fields.get("warc-type"), size, digest, _page(fields.get("warc-refers-to")), payload if response else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of records and gaps: ``kind, file, begin, end, reason, page_id, record_type, payload_bytes, payload_digest, refers_to, payload``."""
    names = ("kind", "begin", "end", "reason", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [_row(x) for x in salvage(data)]
                yield {"file": [file] * len(rows)} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return map_batches(files, run, "kind string, file string, begin long, end long, reason string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def archive_round_trip(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Records of ``pages`` as read back from archives in the shared folder."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, path or scratch_path(spark, "warc"), **columns))
