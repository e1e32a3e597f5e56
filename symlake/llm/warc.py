"""WARC archives, index first.

``write`` puts one gzip member per record into archive files in the shared folder and returns an index:
file, offset, length, URL and digest of each record. ``read_back`` takes any selection of index rows,
sorts it by file and offset, merges neighbouring byte ranges into long reads and parses the records.

Equal payloads are found by (SHA-1, length), which alone are shuffled; the row with the smallest id
becomes the response record, the others become revisit records that refer to it and carry only the HTTP
header. A group of equal payloads may be any share of the rows: ids are combined before the shuffle, and
the join back is salted for digests that repeat.

Defined cases: a null payload is an empty one; rows with the smallest id of their group are responses
even if that id repeats; a null id is never the smallest unless all are null; a null URL is written as
the record's own id; an empty table gives no records and no files; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm.common import fs_of, read, released, shared_dir, table

MAX_ARCHIVE = 1 << 30
MAX_READ = 8 << 20
MAX_GAP = 64 << 10
SALTS = 32
DATE = "2026-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def b32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def with_heads(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, html, __head: the id that stands for all rows with this payload, if it repeats."""
    body = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha1(body.cast("binary")).alias("__sha"), F.octet_length(body).alias("__len"))
    heads = (
        keyed.where(F.col("__len") >= min_payload)
        .groupBy("__sha", "__len")
        .agg(F.min("page_id").alias("__head"), F.count("*").alias("__rows"))
        .where("__rows > 1")
        .select("__sha", "__len", "__head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    )
    keyed = keyed.withColumn("__salt", F.pmod(F.hash("page_id", "url"), F.lit(SALTS)))
    return keyed.join(heads, ["__sha", "__len", "__salt"], "left").select("page_id", "url", "html", "__head")


def _name(page_id) -> str:
    return f"urn:x-page:{'null' if page_id is None else page_id}"


def record(page_id, url, payload: bytes, head, digest: str, date: str = DATE) -> tuple[str, bytes]:
    """Type and bytes of a record; head: the id of the response to refer to, if this is a revisit."""
    revisit = head is not None and head != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else _name(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_name(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_name(head)}>"]
    return lines[1][11:], "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, min_payload: int = 0, max_archive: int = MAX_ARCHIVE) -> DataFrame:
    """Write the archives; return the index, itself a table under folder.

    A task that runs again writes files with other names; the index, written once all tasks are done,
    names only the files of the attempts that count.
    """
    spark = pages.sparkSession

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = out = None
        try:
            for b in batches:
                rows: list[tuple] = []
                for page_id, url, html, head in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "__head")), strict=True):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    digest = b32(hashlib.sha1(payload).digest())
                    kind, data = record(page_id, url, payload, head, digest)
                    if out is None or at >= max_archive:  # noqa: F821
                        if out is not None:
                            out.close()
                        name = f"{folder}/archive-{uuid.uuid4().hex}.warc.gz"
                        fs, path = fs_of(name)
                        out, at = fs.open_output_stream(path, compression=None, buffer_size=1 << 20), 0
                    data = gzip.compress(data, 1, mtime=0)
                    out.write(data)
                    rows.append((name, at, len(data), url, digest, kind, page_id))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _INDEX_TYPES, strict=True)], names=_INDEX_NAMES) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in _INDEX_TYPES], names=_INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    return table(spark, with_heads(pages, min_payload).mapInArrow(released(put), INDEX), f"{folder}/index")


_INDEX_NAMES = ["file", "offset", "length", "url", "digest", "record_type", "page_id"]
_INDEX_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)\r?$", re.M)


def parse(member: bytes) -> tuple:
    """page_id, url, type, refers_to, payload_bytes, payload_digest, payload (None for a revisit) of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    field = {k.lower(): v for k, v in _FIELD.findall(head)}
    block = rest[: int(field[b"content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != int(field[b"content-length"]):
        raise ValueError("a record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = {k.lower(): v for k, v in _FIELD.findall(http)}
    number = lambda x: None if x == b"null" else int(x)
    page_id = number(field[b"warc-record-id"][1:-1].rpartition(b":")[2])
    size, digest = int(inner[b"content-length"]), field[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
    kind, refers = field[b"warc-type"].decode(), None
    if kind == "revisit":
        refers, payload = number(field[b"warc-refers-to"][1:-1].rpartition(b":")[2]), None
    elif len(payload) != size or b32(hashlib.sha1(payload).digest()) != digest:
        raise ValueError("a payload differs from its digest")
    return page_id, field[b"warc-target-uri"].decode(), kind, refers, size, digest, payload


def ranges(spots: list[tuple[int, int]], max_gap: int = MAX_GAP, max_read: int = MAX_READ) -> list[list[tuple[int, int]]]:
    """Sorted (offset, length) spots in groups that one read fetches."""
    out: list[list[tuple[int, int]]] = []
    for at, n in spots:
        if out and at - sum(out[-1][-1]) <= max_gap and at + n - out[-1][0][0] <= max_read:
            out[-1].append((at, n))
        else:
            out.append([(at, n)])
    return out


def read_back(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows, by coalesced reads; a large archive is read in parts by several tasks."""
    spark = index.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spots = (
        index.select("file", "offset", "length", F.floor(F.col("offset") / (64 << 20)).alias("__part"))
        .repartition(n, "file", "__part")
        .sortWithinPartitions("file", "offset")
    )
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [f.split()[0] for f in RECORD.split(", ")]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            lo = 0
            while lo < len(rows):
                hi = lo
                while hi < len(rows) and rows[hi][0] == rows[lo][0]:
                    hi += 1
                fs, path = fs_of(rows[lo][0])
                with fs.open_input_file(path) as f:
                    for group in ranges([r[1:] for r in rows[lo:hi]]):
                        start = group[0][0]
                        data = f.read_at(sum(group[-1]) - start, start)
                        got = [parse(data[at - start : at - start + k]) for at, k in group]
                        cols = list(zip(*got, strict=True))
                        if not with_payload:
                            cols[6] = [None] * len(got)
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)
                lo = hi

    return spots.mapInArrow(released(fetch), RECORD)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write(read(spark, sf_dir, "pages").select("page_id", "url", "html"), shared_dir(spark, "warc"))
    return read_back(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op7_warc": op7_warc}

ORACLE = {
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS h FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS head FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    ((('0x' || substr(h, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> ((3 - i % 4) * 5)::BIGINT) & 31) + 1]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM head OR head IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM head OR head IS NULL THEN NULL ELSE head END::BIGINT AS refers_to
FROM r
"""
}
