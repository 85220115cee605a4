import base64
import gzip
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from meterwise.llm import warc
from meterwise.session import checkpoint_dir

SCHEMA = "page_id long, url string, html string, capture string, n int"
ROWS = [
    (1, "http://a/", "<p>same</p>"), (5, "http://b/", "<p>same</p>"), (3, "http://c/", "<p>same</p>"), (2, None, None), (4, "http://d/\r\nX: y", ""),
    (6, "http://e/", "ünï😀\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (7, "http://f/", "long " * 200_000), (None, "http://g/", "<p>same</p>"),
    (None, "http://h/", "alone without id"), (8, "http://i/", "twice"), (8, "http://i/", "twice"), (9, "http://j/", "\r\n"), (10, "http://k/", "a:b\r\nc: d\r\n"),
]


@pytest.fixture(scope="module")
def written(spark):
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA).repartition(3)
    warc.write_archives(df, path, records_per_file=5)
    return path


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_captures_hold_what_was_written(spark, written):
    got = warc.assemble(warc.read_archives(spark, written)).collect()
    assert len(got) == len(ROWS)
    largest = {}
    for p, _, html in ROWS:
        largest[html or ""] = max(-1 if p is None else p, largest.get(html or "", -1))
    want = []
    for p, url, html in ROWS:
        html, url = html or "", (url or "").replace("\r", " ").replace("\n", " ")
        revisit = p != largest[html] and not (p is None and largest[html] == -1)
        want.append((str(p), url, "revisit" if revisit else "response", digest(html), None if revisit else html,
                     f"<urn:page:{largest[html]}>" if revisit else None, str(len(html.encode()))))
    found = [(r.metadata.fields.get("pageId", "None"), r.request.target_uri, r.response.kind, r.response.digest, r.response.payload,
              r.response.refers_to, r.metadata.fields["payloadBytes"]) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_archives_are_framed_by_length(spark, written):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(written).collect()
    assert len(files) > 3
    kinds = []
    for f in files:
        records = list(warc.parse_archive(bytes(f.content)))
        assert len(records) <= 5
        kinds += [h["warc-type"] for h, _ in records]
        whole = gzip.decompress(bytes(f.content))
        assert sum(len(b) for _, b in records) < len(whole)
    assert len(kinds) == 3 * len(ROWS) and kinds.count("request") == kinds.count("metadata") == len(ROWS)


def test_files_are_bounded_by_bytes(spark):
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = [(i, "http://s/", f"small {i}") for i in range(30)] + [(100 + i, "http://m/", f"{i}" * 200_000) for i in range(10, 20)]
    pages += [(200 + i, "http://l/", "xyz"[i] * 1_500_000) for i in range(3)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in pages], SCHEMA).coalesce(1)
    warc.write_archives(df, path, file_bytes=1 << 22)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()
    sizes = sorted(len(gzip.decompress(bytes(f.content))) for f in files)
    # 30 small captures fill one file, four of up to 1 MB another, each larger one has its own.
    assert len(sizes) == 1 + 3 + 3 and sizes[-1] < 1 << 22
    got = warc.assemble(warc.read_archives(spark, path)).collect()
    assert len({r.capture for r in got}) == len(pages)
    assert sorted((int(r.metadata.fields["pageId"]), r.response.payload) for r in got) == sorted((p, h) for p, _, h in pages)


def test_foreign_payloads_that_are_not_utf8():
    headers = {"warc-type": "response", "warc-record-id": "<urn:x>"}
    body = b"caf\xe9 \xff"
    row = warc._describe(headers, b"HTTP/1.1 200 OK\r\n\r\n" + body, True)
    assert row["payload"] == "caf\ufffd \ufffd" and row["block_bytes"] == len(body)
    assert row["digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert warc._describe({**headers, "warc-type": "metadata"}, b"a: \xff\r\n", True)["fields"] == [("a", "\ufffd")]


def test_members_and_broken_archives():
    record = lambda n: f"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: {n}\r\n\r\n".encode()
    one, two = record(3) + b"abc\r\n\r\n", record(0) + b"\r\n\r\n"
    assert [b for _, b in warc.parse_archive(gzip.compress(one) + gzip.compress(two))] == [b"abc", b""]
    with pytest.raises(ValueError):
        list(warc.parse_archive(gzip.compress(record(9) + b"abc\r\n\r\n")))


def test_base32_and_empty_table(spark):
    df = spark.createDataFrame([("",), ("x",), ("ünï",)], "t string").select("t", warc.base32_sha1(F.col("t").cast("binary")).alias("d"))
    assert all(r.d == digest(r.t) for r in df.collect())
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.assemble(warc.read_archives(spark, path)).count() == 0
