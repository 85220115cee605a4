"""WARC archives: write captures with payload revisits, read records, assemble transactions."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.llm.storage import hand_over

RECORDS_PER_FILE = 6000
#: Uncompressed bytes of pages that a file holds (a larger page has a file of its own), and the
#: bytes of page and address up to which a capture belongs to a size class; the last has no end.
FILE_BYTES = 1 << 28
SIZE_CLASSES = (1 << 17, 1 << 20, 1 << 23, 1 << 26)
#: Fixed values of the format: version line, profile of revisits by digest, base32 letters.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DATE = "1970-01-01T00:00:00Z"
_NL = "\r\n"
RECORDS = (
    "record_id string, kind string, concurrent_to string, refers_to string, target_uri string, "
    "digest string, block_bytes bigint, fields map<string,string>, payload string"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: five hex digits make four letters."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), digits, BASE32)


def _record(kind: Column | str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines, an empty line and the block; the line separator of the file ends the record.

    A record ends with two line breaks: one is written here, the writer adds the other.
    A header whose value is null is left out.
    """
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind),
        F.lit(f"WARC-Date: {_DATE}"),
        *[F.concat(F.lit(f"{name}: "), value) for name, value in headers],
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(_NL, *lines), F.lit(_NL + _NL), block, F.lit(_NL))


def _urn(role: str) -> Column:
    return F.concat(F.lit("<urn:capture:"), F.col("__capture"), F.lit(f":{role}>"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", records_per_file: int = RECORDS_PER_FILE,
                   file_bytes: int = FILE_BYTES) -> None:
    """Write a request, a response or revisit, and a metadata record for every row of ``pages``.

    Files are gzip-compressed, hold at most ``records_per_file`` records and are written by
    Spark to ``path``. Captures are written by size class, each with as many records a file as
    keep it within about ``file_bytes`` uncompressed; there are five classes at most, and one
    pass if all pages are small. The payload is the html in UTF-8, null as empty. Of rows with equal
    payloads, those with the largest id are responses (one, unless the row repeats); the others
    are revisits that refer to its id and carry the digest, but not the payload. A null id is
    smaller than any other and is written as no id.

    The html is joined to the winners of repeated payloads only, which adaptive execution
    broadcasts or splits; a payload that a third of all rows share is no single task's.
    """
    rows = pages.select(
        F.col(id_col).alias("__id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", " ").alias("__url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("__html"),
    ).withColumn("__digest", base32_sha1(F.col("__html").cast("binary")))
    winners = (
        rows.groupBy("__digest")
        .agg(F.max("__id").alias("__winner"), F.count("*").alias("n"))
        .where("n > 1")
        .select("__digest", "__winner")
    )
    size = F.octet_length("__html") + 2 * F.octet_length("__url")
    rows = rows.withColumn("__class", sum((size > end).cast("int") for end in SIZE_CLASSES))
    present = sorted(r[0] for r in rows.select("__class").distinct().collect())  # five at most
    rows = rows.join(hand_over(winners, "winners"), "__digest", "left")
    for k, held in enumerate(present or [0]):
        # A class holds captures up to its end; three records each.
        fitting = 3 * (file_bytes // SIZE_CLASSES[held]) if held < len(SIZE_CLASSES) else 3
        per_file = max(3, min(records_per_file, fitting))
        # A folder for each class; written so, tasks without captures leave no file.
        records = _records(rows.where(F.col("__class") == held)).withColumn("size", F.lit(held))
        (
            records.write.mode("append" if k else "errorifexists")
            .partitionBy("size")
            .option("lineSep", _NL)
            .option("compression", "gzip")
            .option("maxRecordsPerFile", per_file)
            .text(path)
        )


def _records(rows: DataFrame) -> DataFrame:
    """The three records of every capture, as ``value``."""
    # A name for the capture that no other row has; its three records are written together.
    rows = rows.withColumn(
        "__capture",
        F.concat_ws(
            "-", F.coalesce(F.col("__id").cast("string"), F.lit("none")), "__class",
            F.hex(F.monotonically_increasing_id()),
        ),
    )
    revisit = F.col("__winner").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__winner"))
    uri = ("WARC-Target-URI", F.col("__url"))
    request = _record(
        "request",
        [("WARC-Record-ID", _urn("request")), ("WARC-Concurrent-To", _urn("response")), uri,
         ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.col("__url"), F.lit(f" HTTP/1.1{_NL}{_NL}")),
    )
    http = F.lit(f"HTTP/1.1 200 OK{_NL}Content-Type: text/html; charset=utf-8{_NL}{_NL}")
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        [("WARC-Record-ID", _urn("response")), uri,
         ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("__digest"))),
         ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
         ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("__winner").cast("string"), F.lit(">")))),
         ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.when(revisit, http).otherwise(F.concat(http, F.col("__html"))),
    )
    metadata = _record(
        "metadata",
        [("WARC-Record-ID", _urn("metadata")), ("WARC-Concurrent-To", _urn("response")), uri,
         ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(
            F.coalesce(F.concat(F.lit("pageId: "), F.col("__id").cast("string"), F.lit(_NL)), F.lit("")),
            F.lit("payloadBytes: "), F.octet_length("__html").cast("string"), F.lit(_NL),
        ),
    )
    return rows.select(F.explode(F.array(request, response, metadata)).alias("value"))


class _Stream:
    """Bytes of a gzip file, decompressed as they are asked for."""

    def __init__(self, content: bytes):
        self.raw, self.at = content, 0
        self.gzip = zlib.decompressobj(31)
        self.held = bytearray()

    def _more(self) -> bool:
        while True:
            if self.gzip.eof and self.gzip.unused_data:  # archives may hold several members
                self.raw, self.at = self.gzip.unused_data + self.raw[self.at :], 0
                self.gzip = zlib.decompressobj(31)
            if self.at >= len(self.raw):
                return False
            piece = self.raw[self.at : self.at + (1 << 16)]
            self.at += len(piece)
            if out := self.gzip.decompress(piece):
                self.held += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (found := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("an archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and blocks of a gzip archive, framed by Content-Length alone."""
    stream = _Stream(content)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        version, *lines = head.decode("utf-8", "replace").split(_NL)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = stream.take(int(headers["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, block


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives under ``path`` (columns as in ``RECORDS``).

    ``digest`` is computed from the payload for responses and taken from the header for
    revisits; ``fields`` are the lines of a metadata block. Without ``payloads`` the payload
    column is null. Bytes that are not UTF-8 read as U+FFFD; digest and ``block_bytes`` are those
    of the bytes. A task holds a compressed file and one record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, pa.string()) for n in ("record_id", "kind", "concurrent_to", "refers_to", "target_uri", "digest")]
            + [("block_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.string())]
        )
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for headers, block in parse_archive(batch.column(0)[i].as_py()):
                    rows.append(_describe(headers, block, payloads))
                    held += len(block) if payloads else 64
                    if len(rows) >= 4096 or held >= 1 << 25:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def _describe(headers: dict[str, str], block: bytes, payloads: bool) -> dict:
    kind = headers["warc-type"]
    row = {
        "record_id": headers["warc-record-id"], "kind": kind,
        "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"),
        "target_uri": headers.get("warc-target-uri"),
        "digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "block_bytes": len(block), "fields": None, "payload": None,
    }
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        row["digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        row["block_bytes"] = len(payload)
        row["payload"] = payload.decode("utf-8", "replace") if payloads else None
    elif kind == "metadata":
        pairs = re.findall(r"([^:\r\n]+): ([^\r\n]*)\r\n", block.decode("utf-8", "replace"))
        row["fields"] = pairs
    return row


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture``, ``request``, ``response``, ``metadata``.

    Requests and metadata name the response (or revisit) that they are concurrent to; three
    sides are joined by that identifier, which is unique to a capture. A response without a
    request or metadata keeps null there; requests and metadata without a response are no
    capture.
    """
    body = F.struct("record_id", "kind", "refers_to", "target_uri", "digest", "block_bytes", "payload")
    response = records.where("kind in ('response', 'revisit')").select(F.col("record_id").alias("capture"), body.alias("response"))
    request = records.where("kind = 'request'").select(
        F.col("concurrent_to").alias("capture"), F.struct("record_id", "target_uri").alias("request")
    )
    metadata = records.where("kind = 'metadata'").select(
        F.col("concurrent_to").alias("capture"), F.struct("record_id", "fields").alias("metadata")
    )
    joined = response.join(request, "capture", "left").join(metadata, "capture", "left")
    return joined.select("capture", "request", "response", "metadata")
