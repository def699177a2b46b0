"""WARC archives (operator 7): write captures, read them back, and assemble each capture's records.

A capture is three records: a request, a response (or a revisit that refers to an earlier response with the same
payload), and metadata; the last two name the request in WARC-Concurrent-To. Archives are written by Spark's text
writer, whose record separator is the two line ends that close a WARC record, so they go through Spark's commit
protocol to whatever store the shared folder is in. Reading takes whole compressed files as binary, so the writer bounds
a file by `file_bytes` of payload; a file's records are inflated and parsed as a stream, one after the other.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n"
#: Payloads of fewer bytes are never stored as revisits.
LEAST_REVISIT = 1000


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, ident: Column, uri: Column, content: str, block: Column, *more: Column) -> Column:
    head = [F.lit(f"WARC/1.1{END}WARC-Type: {kind}{END}WARC-Record-ID: "), ident, F.lit(f"{END}WARC-Date: 2024-01-01T00:00:00Z{END}WARC-Target-URI: "), uri]
    for m in more:
        head += [F.lit(END), m]
    return F.concat(*head, F.lit(f"{END}Content-Type: {content}{END}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END * 2), block)


def _head(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def plan_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(id, url, payload, digest, refers_to) of every page; refers_to is the id of the response that a revisit points to.

    Payload null counts as empty, a null url becomes urn:page:<id>; line ends and spaces in a url are percent-encoded.
    Of equal payloads of at least `least` bytes the page with the largest id is the response; rows that repeat that id
    are responses too, and so are all rows of a group whose ids are all null. Copies are counted before they move, and
    only digests that occur twice are joined back.
    """
    me = F.col(f"`{id_col}`").cast("long")
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    url = F.coalesce(F.col(f"`{url_col}`"), F.concat(F.lit("urn:page:"), F.coalesce(me.cast("string"), F.lit("null"))))
    for char, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (" ", "%20")):
        url = F.replace(url, F.lit(char), F.lit(code))
    rows = pages.select(me.alias("id"), url.alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    refers = F.when((F.octet_length("payload") >= least) & (F.coalesce("id", F.lit(-(2**63))) != F.col("last")), F.col("last"))
    return rows.join(groups, "digest", "left").select("id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(captures: DataFrame, path: str, file_bytes: int = 256 << 20, captures_per_file: int = 5000) -> None:
    """Writes the three records of each capture of plan_captures as gzipped WARC files below path.

    A file holds at most captures_per_file captures and about file_bytes of payload: captures are written by classes of
    payload size (a factor of 16 wide), each with as many to a file as its largest payload allows; a larger one has a
    file of its own. Classes that don't occur aren't run; most corpora have one or two.
    """
    size = F.octet_length("payload")
    small = file_bytes // captures_per_file
    width = lambda k: small * 16**k
    place = F.when(size <= small, 0)
    for k in range(1, 9):
        place = place.when(size <= width(k), k)
    place = place.otherwise(9)
    classes = sorted(r["k"] for r in captures.select(place.alias("k")).distinct().collect())
    for k in classes:
        _write(captures if len(classes) == 1 else captures.where(place == k), path, max(1, min(captures_per_file, file_bytes // width(k))))


def _write(captures: DataFrame, path: str, captures_per_file: int) -> None:
    key, empty = F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit("")
    rows = captures.withColumn("row", F.uuid())
    request = _uuid(F.lit("request"), F.col("row"))
    response = _uuid(F.lit("response"), key, F.col("digest"))
    origin = _uuid(F.lit("response"), F.col("refers_to").cast("string"), F.col("digest"))
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size, F.lit(END * 2))
    digest, with_request = _head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), _head("WARC-Concurrent-To", request)
    get = F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{END}{END}"))
    full = _record("response", response, F.col("url"), "application/http; msgtype=response", F.concat(http, F.col("payload")), with_request, digest)
    again = _record(
        "revisit", _uuid(F.lit("revisit"), F.col("row")), F.col("url"), "application/http; msgtype=response", http, with_request, digest, _head("WARC-Refers-To", origin),
        _head("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    )
    fields = F.concat(F.lit("pageId: "), F.coalesce(F.col("id").cast("string"), empty), F.lit(f"{END}payloadLength: "), size, F.lit(f"{END}refersToPage: "), F.coalesce(F.col("refers_to").cast("string"), empty), F.lit(END))
    meta = _record("metadata", _uuid(F.lit("metadata"), F.col("row")), F.col("url"), "application/warc-fields", fields, with_request)
    records = F.array(_record("request", request, F.col("url"), "application/http; msgtype=request", get), F.when(F.col("refers_to").isNull(), full).otherwise(again), meta)
    out = rows.select(F.explode(records).alias("value"))
    out.write.mode("append").option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * captures_per_file).text(path)


class _Members(io.RawIOBase):
    """The plain bytes of a gzip file of any number of members; ends where the file is cut short or broken."""

    def __init__(self, data: bytes, step: int = 1 << 16):
        self.data, self.step, self.at = data, step, 0
        self.inflate, self.rest = zlib.decompressobj(31), memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.rest:
            if self.inflate.eof:
                self.at -= len(self.inflate.unused_data)
                self.inflate = zlib.decompressobj(31)
            piece = self.data[self.at : self.at + self.step]
            self.at += len(piece)
            try:
                self.rest = memoryview(self.inflate.decompress(piece))
            except zlib.error:
                return 0
            if not piece:
                break
        n = min(len(out), len(self.rest))
        out[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _opened(data: bytes) -> BinaryIO:
    """The file's plain bytes as a stream, if it is plain, gzipped as one member, or in a member for each record."""
    return io.BufferedReader(_Members(data), 1 << 20) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def parse_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by Content-Length. Stops at what isn't a record, or where the file is cut short."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line.startswith(b"WARC/"):
            return
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        size = head.get("content-length", "")
        if not size.isdigit():
            return
        block = stream.read(int(size))
        if len(block) < int(size):
            return
        yield head, block


RECORD = "record_id string, concurrent_to string, warc_type string, target_uri string, payload_digest string, refers_to string, http_head string, payload binary, payload_bytes long, payload_sha1 string"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    for batch in batches:
        for raw in batch.column("content"):
            rows, held = [], 0
            for head, block in parse_records(_opened(raw.as_py())):
                http, payload = None, block
                if head.get("content-type", "").startswith("application/http"):
                    a, _, payload = block.partition(b"\r\n\r\n")
                    http = a.decode("utf-8", "replace")
                rows.append((head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-payload-digest"), head.get("warc-refers-to"), http, payload, len(payload), hashlib.sha1(payload).hexdigest()))
                held += len(payload)
                if held > 8 << 20:
                    yield _batch(rows, names)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, names)


def _batch(rows: list, names: list) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, {"payload": pa.binary(), "payload_bytes": pa.int64()}.get(n, pa.string())) for c, n in zip(cols, names)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the WARC files (plain or gzipped) below path; none if there are no files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(_parsed, RECORD)


def assemble(records: DataFrame, payloads: bool = True) -> DataFrame:
    """One nested row for each capture: its request, response or revisit, and metadata, joined by WARC-Concurrent-To.

    Without payloads those of responses stay behind; their sizes and digests, taken from them when they are read, come.

    A record that names no other starts its own capture; a part that isn't there is null. Of two records of one kind in
    a capture the one with the larger record id counts.
    """
    key = F.coalesce("concurrent_to", "record_id").alias("capture_id")
    rows = records.withColumn("capture_id", key)
    if not payloads:
        rows = rows.withColumn("payload", F.when(F.col("warc_type") != "response", F.col("payload")))
    part = lambda *kinds: F.max(F.when(F.col("warc_type").isin(*kinds), F.struct("record_id", "warc_type", "target_uri", "payload_digest", "refers_to", "http_head", "payload", "payload_bytes", "payload_sha1")))
    return rows.groupBy("capture_id").agg(part("request").alias("request"), part("response", "revisit").alias("reply"), part("metadata").alias("metadata"))


def captures_of(records: DataFrame, payloads: bool = True) -> DataFrame:
    """capture_id, page_id, url, payload_bytes, payload_digest, record_type, refers_to and the nested parts of each capture.

    Size and digest of a stored payload are taken from the payload itself, those of a revisit from its headers.
    """
    kind = F.col("reply.warc_type")
    field = lambda name: F.regexp_extract(F.col("metadata.payload").cast("string"), rf"(?m)^{name}: *(\S*)", 1)
    number = lambda name: F.when(field(name) != "", field(name).cast("long"))
    return assemble(records, payloads).where("reply is not null").select(
        "capture_id", number("pageId").alias("page_id"), F.col("reply.target_uri").alias("url"),
        F.when(kind == "response", F.col("reply.payload_bytes")).otherwise(number("payloadLength")).alias("payload_bytes"),
        F.when(kind == "response", F.col("reply.payload_sha1")).otherwise(F.regexp_extract("reply.payload_digest", "^sha1:(.*)$", 1)).alias("payload_digest"),
        kind.alias("record_type"), number("refersToPage").alias("refers_to"), "request", "reply", "metadata",
    )
