"""WARC archives: writing records with revisits, and reading them by boundary-chain verification.

Archives are text files of Spark's own writer, a record after the other, so any store will do and a
lost executor's files are written again. Reading, tasks cut their splits at the record magic
``WARC/1.0``; each piece that begins with a header is a candidate record and has the offset of the
record that must come next. Magic inside a payload makes candidates too. Pointer jumping along these
offsets, within each split and then from split to split, starts at the beginning of each file; what it
reaches are the records, and the other pieces are parts of the payloads they lie in. Nothing else is
parsed. A file of any size is read by as many tasks as it has splits.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import groupby
from urllib.parse import unquote_plus

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm.common import discard, materialize, without

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: What stands for text that is no URI, percent-encoded, and for a null id.
TEXT, NOTHING = "urn:row:", "urn:no-row:"
# Fixed value: the profile that the standard names for revisits by digest.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Splits whose entries are broadcast, a few hundred bytes each; with more, pieces are sorted to meet them.
MOST_GUIDES = 100_000


def base32(digest_hex: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hex: 40 bits, ten hex digits, make eight characters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def piece(i: int) -> Column:
        bits = F.conv(F.substring(digest_hex, 10 * i + 1, 10), 16, 10).cast("long")
        return F.concat(*[F.substr(letters, (F.shiftright(bits, 35 - 5 * j).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for j in range(8)])

    return F.concat(*[piece(i) for i in range(4)])


def plan_revisits(df: DataFrame, id_col: str, payload: Column, least_bytes: int = 0) -> DataFrame:
    """df with __bytes (payload), __digest, record_type and refers_to.

    Of rows with equal payloads of at least least_bytes that with the largest id is the response; the
    others revisit it. A row with a null id is a response, to which nothing refers.
    """
    body = F.coalesce(payload.cast("binary"), F.lit("").cast("binary"))
    # for equality SHA-1 goes with SHA-256 and the length
    rows = df.withColumn("__bytes", body).withColumn("__digest", base32(F.sha1(body))).withColumn("__same", F.concat(F.sha1(body), F.sha2(body, 256), F.octet_length(body).cast("string")))
    heads = rows.where(F.octet_length("__bytes") >= least_bytes).groupBy("__same").agg(F.max(id_col).alias("__head"), F.count(id_col).alias("__n")).where("__n > 1").select(F.col("__same").alias("__s"), "__head")
    heads = materialize(heads, "heads")
    old = F.col("__head").isNotNull() & (F.col(id_col) < F.col("__head"))
    out = rows.join(heads, F.col("__same") == F.col("__s"), "left")
    return out.withColumn("record_type", F.when(old, "revisit").otherwise("response")).withColumn("refers_to", F.when(old, F.col("__head"))).drop("__same", "__s", "__head")


def uri(text: Column) -> Column:
    """A header value for any text: an absolute URI as it is, other text percent-encoded behind TEXT."""
    plain = text.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:[\x21-\x7E]+\z") & ~text.contains("WARC/1.0") & ~text.startswith(TEXT) & ~text.startswith(NOTHING)
    return F.when(plain, text).otherwise(F.concat(F.lit(TEXT), F.url_encode(text)))


def text_of(value: str | None) -> str | None:
    """What uri() made a header value of; any other value as it is. Never raises."""
    if value is None:
        return None
    if value[:1] == "<" and value[-1:] == ">":
        value = value[1:-1]
    if value.startswith(NOTHING):
        return None
    return unquote_plus(value[len(TEXT) :]) if value.startswith(TEXT) else value


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, compression: str | None = "gzip", records_per_file: int = 20_000, date: str | None = None) -> None:
    """Archive df at path, in WARC 1.0: a record for each row, `response` or `revisit`.

    Payloads are strings in UTF-8, or binary; null is empty. Ids and urls that are no URIs are written
    percent-encoded, so that any text comes back as it was; a null url has no header, and a null id one
    that reads as null. Rows that repeat an id are records of their own; of equal payloads all those of
    the largest id are responses. Columns named like a result are not read, others are left out. An
    empty table makes an archive without records. Files hold records_per_file records at most; date is
    that of all records, by default the present time.
    """
    df = without(df, "record_type", "refers_to")
    p = plan_revisits(df, id_col, F.col(payload_col), least_bytes)
    when = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    some = lambda test, *lines: F.when(test, F.concat(*lines)).otherwise("")
    named = lambda c: F.concat(F.lit("<"), F.coalesce(uri(c.cast("string")), F.concat(F.lit(NOTHING), F.col("__digest"))), F.lit(">"))
    body = F.when(F.col("record_type") == "response", F.col("__bytes")).otherwise(F.lit("").cast("binary"))
    url = F.col(url_col).cast("string") if url_col in df.columns else F.lit(None).cast("string")
    header = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", named(F.col(id_col))), line("WARC-Date", F.lit(when)), some(url.isNotNull(), line("WARC-Target-URI", uri(url))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("__digest"))), some(F.col("refers_to").isNotNull(), line("WARC-Refers-To", named(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE))),
        line("X-Payload-Length", F.octet_length("__bytes").cast("string")), line("Content-Type", F.lit("application/octet-stream")), F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(END),
    )
    # the writer ends every line with the second half of a record's end
    record = F.concat(header.cast("binary"), body, F.lit("\r\n").cast("binary")).cast("string")
    writer = p.select(record.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file)
    (writer.option("compression", compression) if compression else writer).text(path)


FIELDS = "record_type string, record_id string, url string, payload_digest string, refers_to string, payload_bytes long, payload binary, verified boolean"
_FIELDS = pa.struct([("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("verified", pa.bool_())])
_MAGIC, _END = MAGIC.encode(), END.encode()
_STEP = len(_END) + len(_MAGIC)


def number(text: str | None) -> int | None:
    """A header's number: ASCII digits that a long holds."""
    return int(text) if text and re.fullmatch("[0-9]{1,18}", text) else None


def header_of(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields (names in lower case) at the start of raw, and where the payload begins.

    A line that begins with white space continues the one before. None if a line is no field.
    """
    end = raw.find(_END)
    if end < 0:
        return None
    fields, last = {}, None
    for line in raw[:end].split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and last is not None:
            fields[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        last = name.strip().lower().decode("utf-8", "replace")
        fields[last] = value.strip().decode("utf-8", "replace")
    return fields, end + len(_END)


def content_length(raw: bytes) -> int | None:
    """The whole length of header and block, if raw begins with a header that says so."""
    found = header_of(raw)
    n = found and number(found[0].get("content-length"))
    return None if n is None else found[1] + n


def _agrees(digest: str | None, body: bytes) -> bool | None:
    """Whether a header's digest, in base32 or hex, is that of body; None if it can't be told."""
    kind, colon, value = (digest or "").partition(":")
    if not colon or kind.strip().lower() not in ("md5", "sha1", "sha256"):
        return None
    own = hashlib.new(kind.strip().lower(), body).digest()
    return value.strip().upper().rstrip("=") in (base64.b32encode(own).decode().rstrip("="), own.hex().upper())


def parse(raw: bytes, with_payload: bool) -> dict | None:
    """A record's fields; None unless raw holds a whole record. Never raises."""
    length = content_length(raw)
    if length is None or len(raw) < length:
        return None
    h, begin = header_of(raw)
    kind, digest, body = h.get("warc-type"), h.get("warc-payload-digest"), raw[begin:length]
    out = {"record_type": kind, "record_id": text_of(h.get("warc-record-id")), "url": text_of(h.get("warc-target-uri")), "refers_to": text_of(h.get("warc-refers-to"))}
    if kind == "revisit":
        return out | {"payload_digest": digest and digest.partition(":")[2], "payload_bytes": number(h.get("x-payload-length")), "payload": None, "verified": None}
    if kind == "response" and h.get("content-type", "").lower().startswith("application/http") and (at := body.find(_END)) >= 0:
        body = body[at + len(_END) :]
    own = base64.b32encode(hashlib.sha1(body).digest()).decode()
    return out | {"payload_digest": own, "payload_bytes": len(body), "payload": body if with_payload else None, "verified": _agrees(digest, body)}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for whole in batches:
        for i in range(0, whole.num_rows, 200):
            yield from zip(*(c.to_pylist() for c in whole.slice(i, 200).columns), strict=True)


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((file, split), rows) of pieces that stand in order."""
    return groupby(_rows(batches), lambda r: (r[1], r[2]))


def _lines_of_fields(raw: bytes) -> bool:
    """Whether raw could be the first lines of a header, with the magic in the last."""
    lines = raw.split(b"\r\n")
    return bool(lines[-1]) and all(b":" in x or x[:1] in (b" ", b"\t") for x in lines)


class _Cut:
    """Headers with a line that ends like the magic: cut there, they go over several pieces."""

    def __init__(self):
        self.starts, self.text = [], bytearray()

    def add(self, raw: bytes, at: int) -> Iterator[tuple[int, int]]:
        """The next piece; what it completes as (start, offset of the next record)."""
        if self.starts:
            self.text += _MAGIC + raw
        whole = _END in raw
        if whole and self.starts:
            end, place, length, pos = self.text.find(_END), -1, None, 0
            for line in bytes(self.text[:end]).split(b"\r\n"):
                name, colon, value = line.partition(b":")
                if not colon and line[:1] not in (b" ", b"\t"):
                    length = None
                    break
                if name.strip().lower() == b"content-length":
                    place, length = pos, number(value.strip().decode("utf-8", "replace"))
                pos += len(line) + 2
            if length is not None:
                first = self.starts[0]
                yield from ((s, first + end + len(_END) + length + _STEP) for s in self.starts if s - first <= place)
        if whole or not _lines_of_fields(raw):
            self.starts, self.text = [], bytearray()
        else:
            self.text = self.text or bytearray(raw)
            self.starts.append(at)


CANDIDATES = "file string, split long, at long, exit long, last long, size long"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, at, exit, last) of each candidate record, and (file, split, size) of each split.

    Offsets are within the split. last: the last candidate that the chain from this one comes to in the
    split; exit: where that one's successor is.
    """

    def rows(key: tuple, *columns) -> pa.RecordBatch:
        n = max(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.array([k] * n, t) for k, t in zip(key, (pa.string(), pa.int64()), strict=True)] + [pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], ["file", "split", "at", "exit", "last", "size"])

    for key, pieces in _by_split(batches):
        at, cut, starts, nexts = 0, _Cut(), array("q"), array("q")
        for raw, *_ in pieces:
            for start, after in cut.add(raw, at):
                starts.append(start)
                nexts.append(after)
            if (length := content_length(raw)) is not None:
                starts.append(at)
                nexts.append(at + length + _STEP)
            at += len(raw) + len(_MAGIC)
        yield rows(key, None, None, None, [at])
        if not starts:
            continue
        start, after = np.frombuffer(starts, np.int64), np.frombuffer(nexts, np.int64)
        order = np.argsort(start)
        start, after = start[order], after[order]
        to = np.minimum(np.searchsorted(start, after), len(start) - 1)
        to = np.where(start[to] == after, to, np.arange(len(start)))
        while not np.array_equal(jump := to[to], to):
            to = jump
        for i in range(0, len(start), 50_000):
            part = to[i : i + 50_000]
            yield rows(key, start[i : i + 50_000], after[part], start[part], None)


def _records(with_payload: bool):
    """Pieces with their split's guide to the records that begin and end in the split."""

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out, _FIELDS)], ["r"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for _, pieces in _by_split(batches):
            for parts, _, _ in _walk(pieces):
                if parts is not None and (found := parse(_MAGIC.join(raw for _, raw in parts), with_payload)):
                    out.append(found)
                    size += len(found["payload"] or b"") + 500
                    if size > 8 << 20:
                        yield batch(out)
                        out, size = [], 0
        if out:
            yield batch(out)

    return run


def _walk(pieces) -> Iterator[tuple]:
    """(parts, None, None) for each whole record of a split, parts being (offset, bytes); and (None,
    owner, part) for pieces of a record that goes over the split's end or comes from an earlier one."""
    at, want, parts, length = 0, None, None, None
    for raw, _, _, base, entry, owner, until in pieces:
        if not at:
            want = entry
        if owner is not None and at < until:
            yield None, owner, (base + at, raw)
        elif at == want:
            parts, length, total = [(at, raw)], content_length(raw), len(raw)
        elif parts is not None:
            parts.append((at, raw))
            total += len(_MAGIC) + len(raw)
            if length is None:
                length = content_length(_MAGIC.join(x for _, x in parts))
        if parts is not None and length is not None and total >= length:
            yield parts, None, None
            want, parts = parts[0][0] + length + _STEP, None
        at += len(raw) + len(_MAGIC)
    for place, raw in parts or ():
        yield None, base + parts[0][0], (base + place, raw)


PARTS = "file string, owner long, at long, raw binary"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of records that go over a split's end."""
    for (file, _), pieces in _by_split(batches):
        for parts, owner, part in _walk(pieces):
            if parts is None:
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([owner]), pa.array([part[0]]), pa.array([part[1]], pa.binary())], ["file", "owner", "at", "raw"])


def reachable(links: DataFrame) -> DataFrame:
    """(file, at) of the nodes that the chain from each file's start reaches, by pointer jumping.

    links: (file, at, next), at being the node's offset in its file; a file's first record follows the
    magic at its start. After round k the nodes within 2^k steps of the start are known, and each link
    spans 2^k nodes; rounds grow with the logarithm of the nodes in a file.
    """
    at = links.select("file", F.col("at").alias("next"))
    jump = materialize(links.where("next is not null").select("file", "at", "next").join(at, ["file", "next"], "left_semi").select("file", "at", "next"), "jumps")
    known = links.where(F.col("at") == len(MAGIC)).select("file", "at")
    while True:
        step = materialize(jump.join(known, ["file", "at"]).select("file", F.col("next").alias("at")), "step")
        if step.isEmpty():
            return known
        known = known.unionByName(step)
        b = jump.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        longer = materialize(jump.join(b, ["file", "next"]).select("file", "at", F.col("after").alias("next")), "jumps")
        discard(jump)
        jump = longer


def _guides(lines: DataFrame) -> DataFrame:
    """For each split (f, s): base, its offset in the file; entry, the offset in the split of the first
    record that begins there; owner, the record from earlier splits that goes on in it, and until, where
    the next one begins; over: whether its last record goes over its end."""
    cuts = materialize(lines.mapInArrow(_candidates, CANDIDATES), "candidates")
    in_order = Window.partitionBy("file").orderBy("split")
    splits = cuts.where("at is null").select("file", "split", "size", (F.sum("size").over(in_order) - F.col("size")).alias("base"))
    splits = materialize(splits, "splits")
    links = cuts.where("at is not null").join(splits.select("file", "split", "base"), ["file", "split"]).select("file", "split", *[(F.col(c) + F.col("base")).alias(c) for c in ("at", "exit", "last")])
    # chains come into a split where those of other splits leave them: only these candidates are linked across splits
    doors = links.groupBy("file", F.col("exit").alias("at")).agg(F.min("split").alias("of"))
    inner = links.join(doors, ["file", "at"]).where("of < split").select("file", "split", "at", "exit", "last")
    nodes = materialize(links.where(F.col("at") == len(MAGIC)).unionByName(inner), "nodes")
    chain = nodes.join(reachable(nodes.select("file", "at", F.col("exit").alias("next"))), ["file", "at"], "left_semi")
    seen = splits.join(chain, ["file", "split"], "left")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("owner", F.last("last", True).over(before)).withColumn("upto", F.last("exit", True).over(before))
    goes_on = F.col("upto") > F.col("base")
    return materialize(
        seen.select(
            F.col("file").alias("f"), F.col("split").alias("s"), "base", (F.col("at") - F.col("base")).alias("entry"), F.when(goes_on, F.col("owner")).alias("owner"), F.when(goes_on, F.col("upto") - F.col("base")).alias("until"),
            F.coalesce(F.col("exit") > F.col("base") + F.col("size"), F.lit(False)).alias("over"),
        ), "guides",
    )


def read(spark: SparkSession, path: str, with_payload: bool = True, most_guides: int = MOST_GUIDES) -> DataFrame:
    """The records of the archives at path: record_type, record_id, url, payload_digest, refers_to,
    payload_bytes, payload and verified.

    Any WARC 1.0 files will do, whole or compressed. Payload and digest of a record are those of what was
    read (of an HTTP response the body); verified tells whether the header's digest agrees, null if it has
    none. A revisit has the digest and length of its header, and no payload. Headers that are missing are
    null. What the chain from a file's start doesn't reach is no record, whatever it looks like; a chain
    ends at the first record that isn't followed by another, and a record that its file doesn't hold
    wholly is left out. A header is read over a magic at the end of one of its lines, within a split.

    The files' splits must stay the same until the result has been read: the number of partitions that
    Spark plans them for is set in the session (spark.sql.files.minPartitionNum) if it wasn't, as the
    default would change with executors that come or go.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    lines = spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    guides = _guides(lines)
    here = (F.col("file") == F.col("f")) & (F.col("split") == F.col("s"))
    many = guides.count() > most_guides

    def guided(some: DataFrame) -> DataFrame:
        columns = ("raw", "file", "split", "base", "entry", "owner", "until")
        if not many:
            return lines.join(F.broadcast(some), here).select(*columns)
        placed = lines.withColumn("__n", F.monotonically_increasing_id()).join(some, here)
        return placed.repartition("file", "split").sortWithinPartitions("file", "split", "__n").select(*columns)

    whole = guided(guides.where("entry is not null")).mapInArrow(_records(with_payload), f"r struct<{FIELDS}>").select("r.*")
    cut = guides.where("owner is not null or over")
    if cut.isEmpty():
        return whole
    listed = guided(cut).mapInArrow(_parts, PARTS).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "raw"))).alias("pieces"))

    @F.arrow_udf(f"struct<{FIELDS}>")
    def join(pieces: pa.Array) -> pa.Array:
        return pa.array([parse(_MAGIC.join(p["raw"] for p in ps), with_payload) for ps in pieces.to_pylist()], _FIELDS)

    return whole.unionByName(listed.select(join("pieces").alias("r")).where("r is not null").select("r.*"))
