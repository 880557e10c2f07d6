import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from quillstone.llm import warc
from quillstone.llm.common import shared_path

PAGES = "page_id long, url string, html string"
#: A whole record as it would stand in an archive, to be put inside payloads.
INNER = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1a2b>\r\nWARC-Target-URI: http://x/\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
#: Headers that no reader should stumble over.
ODD = [
    "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1a2b>\r\nContent-Length: \u00b2\r\n\r\nhello\r\n\r\n", "WARC/1.0\r\nContent-Length: -5\r\n\r\n", "WARC/1.0\r\nContent-Length: " + "9" * 30 + "\r\n\r\n",
    "WARC/1.0\r\nno field\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "WARC/1.0\r\n\r\n\r\n", "WARC/1.0\r\nWARC-Type: revisit\r\nX-Payload-Length: many\r\nContent-Length: 0\r\n\r\n\r\n\r\n", "WARC/1.0\r\na: WARC/1.0\r\nb: WARC/1.0\r\nContent-Length: 2\r\n\r\nok\r\n\r\n",
]


def rows():
    out = [(i, f"http://host/{i}", f"<p>{i} " + "text " * (i % 50)) for i in range(200)]
    out += [(300 + i, "http://same/", "<p>the same page") for i in range(40)]
    out += [(400, "u", "before " + INNER + INNER + " after"), (401, "u", INNER), (402, None, None), (403, "", ""), (404, 'q"uo\\te\r\nü', "ünï\r\n\r\ncode\r\n\r\nWARC/1.0\r\n"), (405, "u", "WARC/1.0\r\n" * 5), (406, "u", "\r\n\r\n" + "y" * 50_000), (407, "u", "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n")]
    out += [(500 + i, f"http://host/{i}/WARC/1.0", t) for i, t in enumerate(ODD)]
    return out + [(600, "urn:row:5", "a"), (601, "http://h/%41+b?c", "b"), (602, "http://h/\n", "c"), (603, "mailto:a b", "d"), (604, "urn:no-row:x", "e")]


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def expected(pages, least=0):
    heads = {}
    for i, _, t in pages:
        if i is not None:
            heads[t or ""] = max(heads.get(t or "", i), i)
    out = []
    for i, u, t in pages:
        head = heads.get(t or "")
        old = i is not None and i < head and len((t or "").encode()) >= least
        out.append((None if i is None else str(i), u, len((t or "").encode()), digest(t), "revisit" if old else "response", str(head) if old else None))
    return out


def archived(spark, pages, compression, least=0, parts=3, **options):
    at = shared_path(spark, "test-archives")
    warc.write(spark.createDataFrame(pages, PAGES).repartition(parts), at, least_bytes=least, compression=compression, **options)
    return at


@pytest.mark.parametrize(("compression", "split", "least"), [("gzip", None, 0), (None, None, 1), (None, "3000", 0), (None, "70000", 100)])
def test_round_trip(spark, compression, split, least):
    pages = rows()
    at = archived(spark, pages, compression, least)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        out = warc.read(spark, at).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert sorted(((r.record_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == sorted(expected(pages, least), key=str)
    text = {str(i): (t or "").encode() for i, _, t in pages}
    assert all(bytes(r.payload) == text[r.record_id] and r.verified for r in out if r.record_type == "response") and all(r.payload is None and r.verified is None for r in out if r.record_type == "revisit")


def test_null_ids_repeated_rows_and_clash(spark):
    pages = [(None, "a", "x"), (None, "b", "x"), (5, "c", "x"), (5, "c", "x"), (6, "d", "x")]
    out = warc.read(spark, archived(spark, pages, "gzip")).collect()
    assert sorted(((r.record_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == sorted(expected(pages), key=str)
    at = shared_path(spark, "test-archives")
    warc.write(spark.createDataFrame(pages, PAGES).withColumn("Record_Type", F.lit("old")).drop("url"), at)
    assert {r.record_type for r in warc.read(spark, at).collect()} == {"response", "revisit"}


def test_empty_table(spark):
    assert warc.read(spark, archived(spark, [], "gzip", parts=1)).count() == 0


def record(kind, uid, body, *lines, length=None):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uid}>", "WARC-Date: 2024-01-01T00:00:00Z", *lines, f"Content-Length: {len(body) if length is None else length}"]
    return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_archive_of_another_writer(spark, tmp_path):
    page, binary = b"<p>x</p>\r\n\r\n" + INNER.encode(), bytes(range(256)) * 3
    http = b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n" + page
    b32 = base64.b32encode(hashlib.sha1(page).digest()).decode()
    parts = [
        record("warcinfo", "0", b"software: test\r\n", "Content-Type: application/warc-fields"), record("request", "1", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("response", "2", http, "WARC-Target-URI: http://h/WARC/1.0", f"WARC-Payload-Digest: sha1:{b32}", "Content-Type: application/http; msgtype=response"),
        record("resource", "3", binary, "X-Folded: one", " two", f"WARC-Payload-Digest: sha1:{hashlib.sha1(b'other').hexdigest()}"), record("revisit", "4", b"", "WARC-Refers-To: <urn:uuid:2>", f"WARC-Payload-Digest: sha1:{b32}"),
        record("conversion", "5", b"", "WARC-Payload-Digest: blake: none"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "cut.warc").write_bytes(parts[0] + record("resource", "6", b"short", length=99))
    (tmp_path / "no.warc").write_bytes(b"not an archive " + parts[0])
    (tmp_path / "none.warc").write_bytes(b"")
    got = sorted(((r.record_id, r.record_type, r.url, r.refers_to, bytes(r.payload or b""), r.payload_bytes, r.verified) for r in warc.read(spark, str(tmp_path)).collect()), key=str)
    want = [("urn:uuid:0", "warcinfo", None, None, b"software: test\r\n", 16, None), ("urn:uuid:1", "request", None, None, b"GET / HTTP/1.1\r\n\r\n", 18, None), ("urn:uuid:2", "response", "http://h/WARC/1.0", None, page, len(page), True), ("urn:uuid:3", "resource", None, None, binary, 768, False), ("urn:uuid:4", "revisit", None, "urn:uuid:2", b"", None, None), ("urn:uuid:5", "conversion", None, None, b"", 0, None)]
    assert got == sorted(want * 2 + want[:1], key=str)


def test_headers_are_those_of_the_standard(spark):
    at = archived(spark, [(1, "http://h/1", "x"), (2, None, "x"), (3, "no uri", b"\xff\xfe".decode("latin-1"))], None, date="2024-05-06T07:08:09Z", parts=1)
    text = "".join(r.value for r in spark.read.text(at, wholetext=True).collect())
    heads = [dict(line.split(": ", 1) for line in part.split("\r\n\r\n")[0].split("\r\n")) for part in text.split("WARC/1.0\r\n")[1:]]
    assert sorted(x["WARC-Record-ID"] for x in heads) == ["<urn:row:1>", "<urn:row:2>", "<urn:row:3>"] and {x["WARC-Date"] for x in heads} == {"2024-05-06T07:08:09Z"}
    by = {x["WARC-Record-ID"]: x for x in heads}
    assert by["<urn:row:1>"]["WARC-Refers-To"] == "<urn:row:2>" and by["<urn:row:1>"]["WARC-Profile"] == warc.PROFILE and by["<urn:row:1>"]["WARC-Target-URI"] == "http://h/1" and "WARC-Target-URI" not in by["<urn:row:2>"] and by["<urn:row:3>"]["WARC-Target-URI"] == "urn:row:no+uri"


@pytest.mark.parametrize("most", [warc.MOST_GUIDES, 0])
def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, most):
    n = 20_000
    with open(tmp_path / "big.warc", "wb") as f:
        for i in range(n):
            f.write(record("resource", str(i), (INNER * (i % 3) + f"page {i}").encode() + (b"z" * 150_000 + b"\r\n" + INNER.encode() * 9 if i % 5000 == 7 else b"")))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        out = warc.read(spark, str(tmp_path), most_guides=most)
        assert not most or out.rdd.getNumPartitions() >= 8
        got = {r.record_id: r.payload_bytes for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == n and all(got[f"urn:uuid:{i}"] == len(INNER) * (i % 3 + (9 if i % 5000 == 7 else 0)) + len(f"page {i}") + (150_002 if i % 5000 == 7 else 0) for i in range(n))


def test_base32_and_header(spark):
    got = spark.createDataFrame([("a",), ("",)], "t string").select(warc.base32(F.sha1("t"))).collect()
    assert [r[0] for r in got] == [digest("a"), digest("")]
    assert warc.content_length(INNER.encode()[len(warc.MAGIC) :]) == len(INNER) - len(warc.MAGIC) - 4
    assert warc.content_length(b"junk") is None and warc.content_length(b"no colon\r\n\r\n") is None and warc.parse(b"Content-Length: 9\r\n\r\nshort", True) is None
