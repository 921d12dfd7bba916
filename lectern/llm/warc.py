"""WARC archives of pages: segmented records with chunked bodies on the way out, reassembly on the way in."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices, stored

#: Bytes of a record's block before it goes on in a continuation, and of a chunk of its body; records in a file.
SEGMENT, CHUNK, RECORDS = 64 << 10, 16 << 10, 4096
_NAMES = uuid.UUID("5b0c4a52-8a1e-4f0e-9d5b-6f1f5a1a7c11")
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_CONTROL = re.compile("[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, name)}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """A body in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[k : k + size]), payload[k : k + size]) for k in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing, chunk extensions and trailers left out. A ValueError where the
    framing breaks or breaks off."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk without a size")
        written = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", written):
            raise ValueError("a chunk without a size")
        size, at = int(written, 16), end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk that breaks off")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without its last line break, which the writer sets."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n"


def page_records(page_id: int | None, url: str | None, payload: bytes, name: str, first_name: str | None, date: str, segment: int) -> Iterator[bytes]:
    """The records of a page: a response, which goes on in continuations beyond `segment` bytes, or a revisit."""
    target = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    common = [("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Page-ID", page_id)]
    own = _record_id(name)
    if first_name is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", _IDENTICAL), ("WARC-Refers-To", _record_id(first_name))], b"")
        return
    block = _HTTP + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("Content-Type", "application/http;msgtype=response")], block)
        return
    for k, at in enumerate(range(0, len(block), segment), 1):
        last = [("WARC-Segment-Total-Length", len(block))] if at + segment >= len(block) else []
        if k == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", 1)]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", _record_id(f"{name}/{k}")), ("WARC-Date", date), ("WARC-Segment-Number", k), ("WARC-Segment-Origin-ID", own), *last]
        yield _record(fields, block[at : at + segment])


def _written(date: str, segment: int):
    def rows(batches):
        for b in slices(batches, 2):
            pages, urls, payloads, names, firsts = b.columns
            held, size = [], 0
            for k in range(b.num_rows):
                for record in page_records(pages[k].as_py(), urls[k].as_py(), payloads[k].as_py(), names[k].as_py(), firsts[k].as_py(), date, segment):
                    held.append(record)
                    size += len(record)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                        held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    return lean(rows)


def write_warc(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", segment: int = SEGMENT, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> None:
    """Write a record for each row of pages under a path, as gzip files of WARC/1.1.

    Of rows with equal payloads of at least `least` bytes, the one of the largest id is a response, the others are
    revisits that refer to it; of rows that share that id too, one. A row without an id loses to those with one. Null html
    is an empty payload, a null url about:blank; control characters in urls are escaped. A response of over `segment`
    bytes goes on in continuation records, however long it is. Each row is a record, repeated ones too; an empty table
    writes no record. Other columns are ignored, whatever their names.

    Nothing but digests is shuffled: who is a response is a narrow table that joins the pages, broadcast only below the
    session's limit. Records go to files where pages are read, RECORDS at most in a file, so that files stay small enough
    to be read whole; Spark commits them, so a task that is lost leaves none. Rows are named by their place in the table,
    which has to be one that Spark reads in the same order again (files do).
    """
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), data.alias("payload"))
    rows = rows.withColumn("name", F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.monotonically_increasing_id().cast("string")))
    key = F.concat(F.sha2("payload", 256), F.octet_length("payload").cast("string"))
    named = rows.select(key.alias("key"), F.octet_length("payload").alias("bytes"), "page_id", "name").where(F.col("bytes") >= least)
    groups = named.groupBy("key").agg(F.max(F.struct("page_id", "name")).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = stored(groups.select("key", F.col("first.name").alias("first_name")), "groups")
    dealt = rows.withColumn("key", key).join(groups, "key", "left")
    first = F.when((F.col("first_name") != F.col("name")) & (F.octet_length("payload") >= least), F.col("first_name"))
    records = dealt.select("page_id", "url", "payload", "name", first.alias("first_name")).mapInArrow(_written(date, segment), "record binary")
    # Each record ends with a line break of its own and the writer's.
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


class _Bytes(io.RawIOBase):
    """A buffer as a file, without a copy of it."""

    def __init__(self, data):
        self.data, self.at = memoryview(data).cast("B"), 0

    def readable(self):
        return True

    def readinto(self, into):
        n = min(len(into), len(self.data) - self.at)
        into[:n] = self.data[self.at : self.at + n]
        self.at += n
        return n


def parsed(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC file, plain or gzipped in one member or many: header fields by lower-case name, and block. What
    follows a record that breaks off, or that isn't one, is left out: it has no beginning that could be trusted."""
    raw = io.BufferedReader(_Bytes(data), 1 << 16)
    file = gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw
    try:
        while True:
            line = file.readline()
            while line in (b"\r\n", b"\n"):
                line = file.readline()
            if not line.startswith(b"WARC/"):
                return
            fields: dict[str, str] = {}
            name = None
            while (line := file.readline()) not in (b"\r\n", b"\n", b""):
                if line[:1] in b" \t" and name:
                    fields[name] += " " + line.decode("utf-8", "replace").strip()
                    continue
                name, _, value = line.decode("utf-8", "replace").partition(":")
                name = name.strip().lower()
                fields[name] = value.strip()
            if not fields.get("content-length", "").isdigit():
                return
            n = int(fields["content-length"])
            block = file.read(n)
            if len(block) < n:
                return
            yield fields, block
    except (EOFError, OSError, gzip.zlib.error):
        return


_FIELDS = ("warc-record-id", "warc-type", "warc-target-uri", "warc-payload-digest", "warc-refers-to", "warc-segment-origin-id")
_COUNTS = ("x-page-id", "warc-segment-number", "warc-segment-total-length")
RECORD = "record_id string, kind string, uri string, stated string, refers_to string, origin string, page_id long, segment long, total long, block binary"


def _count(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"-?[0-9]{1,18}", text) else None


@lean
def _read(batches):
    def made(held):
        columns = [pa.array([f.get(k) for f, _ in held], pa.string()) for k in _FIELDS]
        columns += [pa.array([_count(f.get(k)) for f, _ in held], pa.int64()) for k in _COUNTS]
        return pa.RecordBatch.from_arrays([*columns, pa.array([b for _, b in held], pa.binary())], names=[x.split()[0] for x in RECORD.split(", ")])

    for b in batches:
        for content in b.column(0):
            held, size = [], 0
            for fields, block in parsed(content.as_buffer()):
                held.append((fields, block))
                size += len(block) + 512
                if size > 8 << 20:
                    yield made(held)
                    held, size = [], 0
            if held:
                yield made(held)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under a path, as RECORD says. A file is one task's, read as a stream."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(_read, RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """Records with whole blocks: (record_id, kind, uri, stated, refers_to, page_id, block, whole).

    Continuations are grouped by their origin's id and put behind it by segment number; whole says that numbers go from 1
    without a gap, that one block has each, and that the lengths add up to the total that the last one states. A segment
    that comes twice alike counts once; continuations without an origin have a row whose other fields are null. Records
    that aren't segmented pass by: only segments are shuffled, and a group is one record, however many files it is in.
    """
    one = ["record_id", "kind", "uri", "stated", "refers_to", "page_id"]
    lone = records.where("segment is null and kind <> 'continuation'").select(*one, "block", F.lit(True).alias("whole"))
    parts = records.where("segment is not null or kind = 'continuation'").withColumn("record_id", F.coalesce("origin", "record_id"))
    head = F.col("kind") != "continuation"
    piece = F.struct(F.coalesce("segment", F.lit(-1).cast("long")).alias("segment"), "total", "block")
    grouped = parts.groupBy("record_id").agg(*[F.first(F.when(head, F.col(c)), ignorenulls=True).alias(c) for c in one[1:]], F.array_sort(F.collect_set(piece)).alias("pieces"))
    numbers = F.transform("pieces", lambda p: p["segment"])
    size = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    in_order = F.col("kind").isNotNull() & (numbers == F.sequence(F.lit(1).cast("long"), F.size("pieces").cast("long")))
    whole = F.coalesce(in_order & (F.element_at("pieces", -1)["total"] == size), F.lit(False))
    # Bytes joined as strings, which Spark takes as they are.
    block = F.array_join(F.transform("pieces", lambda p: p["block"].cast("string")), "").cast("binary")
    return lone.unionByName(grouped.select(*one, block.alias("block"), whole.alias("whole")))


def _payload(block: bytes) -> bytes:
    """The payload of an HTTP response: what follows its header, out of chunked framing where it is in that."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the header")
    framed = re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head)
    return unchunked(body) if framed else body


@lean
def _decoded(batches):
    for b in slices(batches, 6, size=8 << 20):
        payloads, digests, fine = [], [], []
        for kind, stated, block, whole in zip(b.column(1), b.column(3), b.column(6), b.column(7), strict=True):
            payload = None
            if kind.as_py() == "response" and whole.as_py():
                try:
                    payload = _payload(block.as_py())
                except ValueError:
                    payload = None
            payloads.append(payload)
            digests.append(None if payload is None else digest(payload))
            said = stated.as_py()
            fine.append(whole.as_py() and (kind.as_py() != "response" or payload is not None and said in (None, f"sha1:{digests[-1]}")))
        yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(payloads, pa.binary()), pa.array(digests, pa.string()), pa.array(fine, pa.bool_())], names=["record_id", "kind", "uri", "stated", "refers_to", "page_id", "payload", "digest", "complete"])


def payloads(records: DataFrame) -> DataFrame:
    """(record_id, kind, uri, stated, refers_to, page_id, payload, digest, complete) of whole records: responses' payloads
    out of chunked framing, with their digest. complete is false where segments are missing or don't add up, the framing
    breaks, or the payload isn't what the stated digest says."""
    return reassembled(records).mapInArrow(_decoded, "record_id string, kind string, uri string, stated string, refers_to string, page_id long, payload binary, digest string, complete boolean")


def archived_pages(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, complete) of the responses and revisits among
    records. A revisit has the size of the response that it refers to, found by record id, and refers_to is its page; it is
    complete if that one is and both state the same digest. Without that response, size and refers_to are null."""
    read = payloads(records).where("kind in ('response', 'revisit')")
    narrow = stored(read.select("record_id", "kind", "refers_to", "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.coalesce("digest", F.regexp_replace("stated", "^sha1:", "")).alias("payload_digest"), "complete"), "read")
    own = narrow.where("kind = 'response'").select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "complete")
    asked = narrow.where("kind = 'revisit'").select("refers_to", "page_id", "payload_digest")
    first = narrow.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("of"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("first_digest"), "complete")
    met = asked.join(first, "refers_to", "left").select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), F.col("of").alias("refers_to"), F.coalesce(F.col("complete") & (F.col("first_digest") == F.col("payload_digest")), F.lit(False)).alias("complete"))
    return own.union(met)
