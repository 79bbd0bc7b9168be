"""9. WARC archives, index first.

Writing: each task streams its pages to one archive of gzip members in the shared
folder and returns an index row (file, offset, length, URL, digest) per record. An
archive's name is its task attempt's own, so an attempt that is lost or repeated
leaves at most a file that no index row names; the index is committed by Spark.

Reading: index rows (all, or any selection) are dealt by file and region to a number
of tasks that follows the bytes they name, sorted by offset, and neighbouring byte
ranges are coalesced into reads of at most ``READ`` bytes; records are then inflated
and parsed one by one, and handed on whenever their payloads come to ``READ`` bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, arrow_rows, materialize, shared_dir, slices, table

#: Payloads below this size are never stored as revisits.
LEAST_REVISIT = 0
#: Largest coalesced read, and largest gap that is read over.
READ, GAP = 8 << 20, 64 << 10
#: Payloads that occur more than once, up to which number they are broadcast (40 bytes each).
KNOWN = 200_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def encode(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    block = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode(record: bytes) -> dict:
    """The reverse of encode(); raises ValueError for a damaged record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    revisit = h["WARC-Type"] == "revisit"
    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
    digest, n = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or payload is not None and (len(payload) != n or sha1_base32(payload) != digest):
        raise ValueError(f"damaged record {h.get('WARC-Record-ID')}")
    page = lambda k: None if h[k] == "<urn:x-page:none>" else int(h[k][12:-1])
    url = h.get("WARC-Target-URI")
    return {"page_id": page("WARC-Record-ID"), "url": url and re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url), "payload": payload, "payload_bytes": n, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": page("WARC-Refers-To") if revisit else None}


def plan(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, first): first is the smallest page_id with an equal payload, null where there is no other row with it."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = materialize(firsts.where("n > 1").select("sha", "first"), "firsts")
    if firsts.count() <= KNOWN:
        firsts = F.broadcast(firsts)  # else a shuffled join, both sides of which come from files
    return rows.join(firsts, "sha", "left").select("page_id", "url", "payload", "first")


def write(planned: DataFrame, path: str) -> DataFrame:
    """Writes archives under ``path`` and returns their committed index."""
    target, pack = arrow_rows(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in slices(batches):
            if out is None:
                fs, root = arrow_fs.FileSystem.from_uri(path)
                fs.create_dir(root, recursive=True)
                name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            cols: dict[str, list] = {f.name: [] for f in target}
            for page_id, url, payload, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "first")), strict=True):
                revisit = first is not None and first != page_id
                digest = sha1_base32(payload)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                record = z.compress(encode(page_id, url, payload, digest, first, revisit)) + z.flush()
                out.write(record)
                for c, v in zip(cols, (name, at, len(record), url, digest, page_id, "revisit" if revisit else "response"), strict=True):
                    cols[c].append(v)
                at += len(record)
            yield pack(cols)
        if out is not None:
            out.close()

    return materialize(planned.mapInArrow(run, target), "warc-index")


def coalesce_ranges(ranges: list[tuple[int, int]], read: int = READ, gap: int = GAP) -> list[list[tuple[int, int]]]:
    """Sorted (offset, length) ranges in groups, each read as one."""
    out: list[list[tuple[int, int]]] = []
    for offset, length in ranges:
        if out and offset - (sum(out[-1][-1])) <= gap and offset + length - out[-1][0][0] <= read:
            out[-1].append((offset, length))
        else:
            out.append([(offset, length)])
    return out


def read(index: DataFrame, path: str) -> DataFrame:
    """The records that ``index`` (a selection of write()'s rows) names, as ``RECORD``."""
    target, pack = arrow_rows(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = arrow_fs.FileSystem.from_uri(path)
        for b in batches:
            files: dict[str, list[tuple[int, int]]] = {}
            for name, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                files.setdefault(name, []).append((offset, length))
            for name, ranges in files.items():
                with fs.open_input_file(f"{root}/{name}") as f:
                    for group in coalesce_ranges(sorted(ranges)):
                        start, end = group[0][0], sum(group[-1])
                        data = f.read_at(end - start, start)
                        rows, held = [], 0
                        for o, n in group:
                            rows.append(decode(zlib.decompress(data[o - start : o - start + n], 31)))
                            held += len(rows[-1]["payload"] or b"")
                            if held >= READ or len(rows) == BATCH_ROWS:
                                yield pack({k.name: [r[k.name] for r in rows] for k in target})
                                rows, held = [], 0
                        if rows:
                            yield pack({k.name: [r[k.name] for r in rows] for k in target})

    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // READ))
    region = F.floor(F.col("offset") / READ).alias("region")
    dealt = index.select("file", "offset", "length", region).repartition(tasks, "file", "region").sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInArrow(run, target)


def archive(pages: DataFrame, least: int = LEAST_REVISIT, path: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from the archives.

    One record per row of ``pages``, payload the html in UTF-8 (null: empty). Of
    equal payloads of at least ``least`` bytes, the smallest page_id is stored as
    response and others as revisits of it; smaller payloads are always responses.
    Rows that repeat the smallest page_id are all responses; a null page_id is a
    revisit if a row with an id has its payload. A null url has no target URI.
    Other columns are not read; an empty table writes nothing.
    """
    path = path or shared_dir(pages.sparkSession, "warc")
    index = write(plan(pages, least), path)
    return read(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, payload, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p
), b AS (
  SELECT *, list_transform(range(0, 8), lambda k: ('0x' || h[5 * k + 1:5 * k + 5])::INTEGER) AS v FROM d
)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(x >> s) % 32 + 1]), '')), '') AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
