"""WARC archives: written with segments and revisits, read back by reassembly.

Large records are cut into a first segment and continuation records. Reading
groups those by the identifier of their origin, orders them by segment number,
verifies the total length and decodes the chunked transfer framing. Records that
were not cut skip the shuffle. A file holds at most ``FILE_RECORDS`` records of at
most ``SEGMENT_BYTES``, so that a reader's memory is bounded.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_BYTES = 1 << 14
FILE_RECORDS = 2048
CHUNK_BYTES = 1 << 12
#: Payloads of fewer bytes are stored again and again.
REVISIT_BYTES = 1000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BrokenArchive(ValueError):
    """A record that does not hold what its headers say."""


def chunked(body: bytes) -> bytes:
    parts = [body[i : i + CHUNK_BYTES] for i in range(0, len(body), CHUNK_BYTES)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        n = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if framed[at + n : at + n + 2] != b"\r\n":
            raise BrokenArchive("a chunk is longer or shorter than its size says")
        out.append(framed[at : at + n])
        at += n + 2


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}:{digest}"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, response: int | None, serial: int) -> Iterator[bytes]:
    """The records of a page: one revisit, or a response in as many segments as it needs.

    The serial keeps rows apart that repeat an id and a payload, so that each is put
    together on its own; a revisit names its response without it.
    """
    name = f"{record_id(page_id, digest)}:{serial}"
    first = [("WARC-Record-ID", f"<{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        first.append(("WARC-Target-URI", "".join(c for c in url if c not in "\r\n")))
    if response is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{record_id(response, digest)}>"), *first], _HTTP)
        return
    block = _HTTP + chunked(payload)
    parts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    if len(parts) == 1:
        yield _record([("WARC-Type", "response"), *first], block)
        return
    yield _record([("WARC-Type", "response"), *first, ("WARC-Segment-Number", "1")], parts[0])
    for i, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        more = [("WARC-Record-ID", f"<{name}:{i}>"), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(i)), *total]
        yield _record([("WARC-Type", "continuation"), *more], part)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write the pages as gzipped WARC files under ``path``.

    Null html is an empty payload. Of equal payloads of at least ``REVISIT_BYTES``
    the row with the largest id is the response and others revisit it; without any
    id all are responses. Repeated rows are written each; an empty table gives an
    archive without records. A record is held in memory as a whole by the task that
    writes or reads it, as its segments are by the task that puts them together.
    """
    html = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"), F.sha1(html).alias("digest"))
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    # Named by the reversed digest, so that the join deals both sides anew and a hot payload may be split.
    first = large.groupBy("digest").agg(F.max("page_id").alias("response")).select(F.reverse("digest").alias("tsegid"), "response")
    rows = rows.join(first, F.col("digest") == F.reverse("tsegid"), "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id").eqNullSafe(F.col("response")), None).otherwise(F.col("response")).alias("response"), F.monotonically_increasing_id().alias("serial"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for row in zip(*(c.to_pylist() for c in b.columns)) for x in records(*row)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise BrokenArchive(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:])
        start, n = end + 4, int(headers["Content-Length"])
        if data[start + n : start + n + 4] != b"\r\n\r\n":
            raise BrokenArchive(f"the record at byte {at} is longer or shorter than its length says")
        yield headers, data[start : start + n]
        at = start + n + 4


def payload_of(block: bytes, digest: str) -> bytes:
    head, _, framed = block.partition(b"\r\n\r\n")
    body = unchunked(framed) if b"transfer-encoding: chunked" in head.lower() else framed
    if hashlib.sha1(body).hexdigest() != digest:
        raise BrokenArchive("a payload does not have the digest of its record")
    return body


_READ = "name string, kind string, number int, total long, refers string, digest string, block binary, payload binary"
_TYPES = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, record_type, refers_to, payload_digest, payload)`` of each response and revisit under ``path``.

    A revisit has a null payload; an archive without records gives no rows. A record whose segments are missing or do not
    add up, or whose payload has another digest, fails the job.
    """
    names = [x.split()[0] for x in _READ.split(", ")]

    def rows(data: bytes) -> Iterator[tuple]:
        for h, block in parse(data):
            kind, number, digest = h["WARC-Type"], int(h.get("WARC-Segment-Number", 0)), h.get("WARC-Payload-Digest", "sha1:")[5:]
            name = (h.get("WARC-Segment-Origin-ID") or h["WARC-Record-ID"]).strip("<>")
            whole = kind == "response" and not number
            total = int(h["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in h else None
            yield name, kind, number, total, h.get("WARC-Refers-To", "").strip("<>") or None, digest, block if number else None, payload_of(block, digest) if whole else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                out = list(rows(gzip.decompress(b.column(0)[i].as_py())))
                for at in range(0, len(out), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 256]), _TYPES)], names=names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                block = b"".join(p["block"] for p in parts)
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                    raise BrokenArchive(f"{name}: segments are missing, repeated or do not add up")
                digest = parts[0]["digest"]
                cols = ([name], ["response"], [None], [digest], [payload_of(block, digest)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(),) * 4 + (pa.binary(),))], names=["name", "kind", "refers", "digest", "payload"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = files.mapInArrow(read, _READ)
    cut_up = found.where("number > 0").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("number", "total", "digest", "block"))).alias("parts"))
    whole = cut_up.mapInArrow(join, "name string, kind string, refers string, digest string, payload binary")
    both = found.where("number = 0").select("name", "kind", "refers", "digest", "payload").union(whole)
    page = lambda c: F.nullif(F.split_part(c, F.lit(":"), F.lit(3)), F.lit("")).cast("long")
    return both.select(page(F.col("name")).alias("page_id"), F.col("kind").alias("record_type"), page(F.col("refers")).alias("refers_to"), F.col("digest").alias("payload_digest"), "payload", "name", F.col("refers").alias("refers_name"))


def round_trip(pages: DataFrame, path: str, **columns) -> DataFrame:
    """Write the pages to ``path``, read them back, and describe each: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    An empty table gives no rows; other columns of ``pages`` are not read.
    """
    write_archive(pages, path, **columns)
    back = read_archive(pages.sparkSession, path)
    n = F.octet_length("payload").cast("long")
    responses = back.where("record_type = 'response'")
    told = responses.select("page_id", n.alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    first = responses.groupBy(F.substring_index("name", ":", 4).alias("name")).agg(F.max(n).alias("payload_bytes")).select(F.reverse("name").alias("eman"), "payload_bytes")
    revisits = back.where("record_type = 'revisit'").join(first, F.col("refers_name") == F.reverse("eman"))
    return told.unionByName(revisits.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
