"""WARC archives: writing with revisit records and segments, reading with segment reassembly.

Archives are text files of whole records, written by Spark's committed text writer
(gzip) to any file system, and read back by splitting at the version line.  The writer
frames payloads as HTTP chunks and cuts a chunk inside every "WARC/1.1" of the payload,
so the version line only ever begins a record.  Blocks longer than a segment go on in
continuation records; the reader groups records by the origin's identifier, orders them
by segment number, verifies the total length and undoes the chunk framing.

Null payloads count as the empty text; null ids and addresses are kept as nulls.
Of equal payloads of ``least_bytes`` or more the largest id is stored and the others
revisit it; rows that repeat that id with that payload are stored too.  Other columns are
not archived.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.llm.common import new_path, salted_left_join

VERSION = "WARC/1.1"
CHUNK_BYTES = 8192
SEGMENT_BYTES = 32768
LEAST_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
_CUT = re.compile("(?<=WARC)(?=/1[.]1)")
#: Rows (records) in one archive file at most.
RECORDS_PER_FILE = 50_000


def _cuts(data: bytes, size: int) -> list[bytes]:
    """Pieces of at most ``size`` bytes (``size`` over 3), cut between characters."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: str) -> bytes:
    """HTTP/1.1 chunk framing."""
    out = []
    for part in _CUT.split(payload):
        for piece in _cuts(part.encode(), CHUNK_BYTES):
            out.append(b"%x\r\n%b\r\n" % (len(piece), piece))
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        eol = body.index(b"\r\n", at)
        size = int(body[at:eol].split(b";")[0], 16)
        at = eol + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> str:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block.decode() + "\r\n\r\n"


def _urn(page_id: int | None, own: str) -> str:
    return f"<urn:plait:page:{'' if page_id is None else page_id}:{own}>"


def records(uid: str | None, page_id: int | None, url: str | None, payload: str, digest: str, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES) -> list[str]:
    """The records of one page: a response with its continuations, or a revisit if ``refers_to`` is given.

    Their id is that of the page and ``uid``; without one it is the payload's digest, which revisits refer to.
    """
    own = _urn(page_id, uid or digest)
    common = [("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        common.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if refers_to is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload.encode())}\r\n\r\n"
        extra = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to, digest))]
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, *extra, ("Content-Type", "application/http;msgtype=response")], head.encode())]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first, *rest = _cuts(block, segment_bytes)
    number = [("WARC-Segment-Number", "1")] if rest else []
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *number, ("Content-Type", "application/http;msgtype=response")], first)]
    for k, piece in enumerate(rest, 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(rest) + 1 else []
        ids = [("WARC-Record-ID", f"{own[:-1]}:{k}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k))]
        out.append(_record([("WARC-Type", "continuation"), *ids, *common, *total], piece))
    return out


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Add digest, n_bytes, refers_to (null: the row is stored itself) and is_target (revisits refer to this row, and no other row has its key and payload)."""
    known = pages.withColumn(payload, F.coalesce(F.col(payload), F.lit("")))
    known = known.withColumn("digest", F.sha1(F.col(payload).cast("binary"))).withColumn("n_bytes", F.octet_length(payload).cast("long"))
    each = known.filter(F.col("n_bytes") >= least_bytes).groupBy("digest", key).agg(F.count(F.lit(1)).alias("_n"))
    largest = each.groupBy("digest").agg(F.max(F.struct(F.col(key).alias("_keep"), F.col("_n").alias("_times"))).alias("_m"), F.sum("_n").alias("_n"))
    repeated = largest.filter("_n > 1").select("digest", "_m.*")
    joined = salted_left_join(known, repeated, "digest", key)
    joined = joined.withColumn("is_target", F.coalesce((F.col(key) == F.col("_keep")) & (F.col("_times") == 1), F.lit(False)))
    return joined.withColumn("refers_to", F.when(~F.col(key).eqNullSafe(F.col("_keep")), F.col("_keep"))).drop("_keep", "_times")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write ``pages`` as gzip WARC files into the folder ``path``."""
    rows = with_revisits(pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html")), "page_id", "html")

    def compose(it):
        part, n = TaskContext.get().partitionId(), 0
        for b in it:
            out = []
            for page_id, address, html, digest, refers_to, target in zip(*(b.column(i) for i in range(6)), strict=True):
                n += 1
                out += records(None if target.as_py() else f"{part}-{n}", page_id.as_py(), address.as_py(), html.as_py(), digest.as_py(), refers_to.as_py(), segment_bytes)
            # the writer ends each row with the line feed that ends the record
            yield pa.RecordBatch.from_arrays([pa.array([r[:-1] for r in out], pa.string())], names=["value"])

    lines = rows.select("page_id", "url", "html", "digest", "refers_to", "is_target").mapInArrow(compose, "value string")
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


PARSED = "origin string, type string, page_id long, refers_to long, n_bytes long, digest string, segment int, total long, block binary"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page_of(urn: str) -> int | None:
    found = urn.strip("<>").split(":")[3]
    return int(found) if found else None


def _parsed(value: bytes) -> tuple:
    """One row of PARSED from a record's text after its version line."""
    head, _, rest = value.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    size = int(h["Content-Length"])
    if rest[size:] not in (b"\r\n\r\n", b"\r\n\r"):
        raise ValueError(f"record {h['WARC-Record-ID']} doesn't have the length it states")
    block, digest, kind = rest[:size], h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
    origin = h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"])
    segment, total = int(h.get("WARC-Segment-Number", 0)), h.get("WARC-Segment-Total-Length")
    page_id = _page_of(origin)
    if kind == "revisit":
        n = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", block)[1])
        return origin, kind, page_id, _page_of(h["WARC-Refers-To"]), n, digest, 0, None, None
    if not segment:
        n = _payload(block, digest)
        return origin, kind, page_id, None, n, digest, 0, None, None
    return origin, kind, page_id, None, None, digest, segment, int(total) if total else None, block


def _payload(block: bytes, digest: str) -> int:
    head, _, body = block.partition(b"\r\n\r\n")
    payload = dechunked(body) if b"\r\nTransfer-Encoding: chunked" in head else body
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload doesn't have the digest its record states")
    return len(payload)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """PAGE rows of the archives in ``path``; payloads of many segments are put together one page at a time."""
    raw = spark.read.option("lineSep", VERSION + "\r\n").text(path).filter("value <> ''").select(F.col("value").cast("binary").alias("value"))
    names = [x.split()[0] for x in PARSED.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in PARSED.split(", ")]

    def parse(it):
        for b in it:
            rows = [_parsed(v.as_py()) for v in b.column(0)]
            cols = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    parsed = raw.mapInArrow(parse, PARSED)
    grouped = parsed.groupBy("origin").agg(
        F.max(F.when(F.col("type") != "continuation", F.col("type"))).alias("type"),
        *(F.max(c).alias(c) for c in ("page_id", "refers_to", "n_bytes", "digest", "total")),
        F.collect_list(F.when(F.col("segment") > 0, F.struct("segment", "block"))).alias("parts"),
    )

    def reassemble(it):
        for b in it:
            out = []
            for r in b.to_pylist():
                n = r["n_bytes"]
                if r["parts"]:
                    parts = sorted(r["parts"], key=lambda p: p["segment"])
                    block = b"".join(p["block"] for p in parts)
                    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or len(block) != r["total"]:
                        raise ValueError(f"segments of {r['origin']} are missing or don't have the total length stated")
                    n = _payload(block, r["digest"])
                out.append({"page_id": r["page_id"], "payload_bytes": n, "payload_digest": r["digest"], "record_type": r["type"], "refers_to": r["refers_to"]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return grouped.mapInArrow(reassemble, PAGE)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)


DUCKDB_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest,
  CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM p LEFT JOIN k ON p.h = k.h"""
