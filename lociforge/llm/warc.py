"""WARC archives by way of a chunked record table.

A payload is never held whole by a Python task: Spark cuts it into rows (record, chunk number, bytes) that the writer
appends to a gzip member as they come, and the reader gives back rows of the same kind, each with the payload's length
and SHA-1 so far. Equal payloads of some length are stored once; the other records revisit the stored one.

Extension fields: X-Page-ID (the record's page), X-Refers-To-Page and X-Payload-Length (of revisits, which have no
payload of their own).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, new_path, open_file, shuffle_partitions, written

CHUNK = 1 << 20
#: An archive is closed and the next one begun beyond so many bytes.
ARCHIVE_BYTES = 1 << 28
CHUNK_ROWS = "page_id long, record_type string, refers_to long, chunk int, n_bytes long, payload_bytes long, sha1 string, last boolean, data binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def plan_records(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload (UTF-8), payload_bytes, sha1 and refers_to: null for responses, else the page that is stored.

    Of equal payloads of at least `min_bytes` the one with the largest page id is stored. Only ids and digests meet to
    find it; payloads are dealt out by page, not by digest, so that a common payload stays spread.
    """
    p = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.encode(F.col(f"`{html_col}`"), "UTF-8"), F.encode(F.lit(""), "UTF-8")).alias("payload"))
    p = p.withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    small = p.where(F.col("payload_bytes") >= min_bytes).select("page_id", "sha1")
    stored = small.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    again = small.distinct().join(stored, "sha1").where("page_id is null or page_id < refers_to")
    again = again.select(F.col("sha1").alias("r_sha1"), F.col("page_id").alias("r_page"), "refers_to")
    return p.join(again, (p.sha1 == again.r_sha1) & p.page_id.eqNullSafe(again.r_page) & (p.payload_bytes >= min_bytes), "left").drop("r_sha1", "r_page")


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of what is to be written: revisits have one empty chunk."""
    own = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0)
    r = records.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil(own / chunk) - 1).cast("int")))))
    piece = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk)))
    return r.select("page_id", "url", "refers_to", "payload_bytes", "sha1", "chunk", piece.alias("data"))


def _header(page, url, refers_to, n: int, sha1: str, date: str) -> tuple[bytes, bytes]:
    """The WARC header and the start of the block."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}:{sha1}")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    block = HTTP % n
    if refers_to is not None:
        target = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{refers_to}:{sha1}")
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{target}>", f"X-Refers-To-Page: {refers_to}", f"X-Payload-Length: {n}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block) + (n if refers_to is None else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), block


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", chunk: int = CHUNK) -> DataFrame:
    """Writes gzipped archives, a member for each record, and returns their manifest (path, records, bytes), itself written
    to the shared folder. Files that lost or repeated tasks left are not in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records_, size, pack = None, None, 0, 0, None

        def row() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records_], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "refers_to", "payload_bytes", "sha1", "chunk", "data")]
            for i in range(batch.num_rows):
                page, url, refers, n, sha1, k, data = (c[i].as_py() for c in cols)
                if k == 0:
                    if out is not None and size > ARCHIVE_BYTES:
                        yield row()
                        out = None
                    if out is None:
                        path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out, records_, size = open_file(path, "w"), 0, 0
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    head, block = _header(page, url, refers, n, sha1, date)
                    made = pack.compress(head + block)
                else:
                    made = b""
                made += pack.compress(data or b"")
                if refers is not None or (k + 1) * chunk >= n:
                    made += pack.compress(b"\r\n\r\n") + pack.flush()
                    records_ += 1
                out.write(made)
                size += len(made)
        if out is not None:
            yield row()

    return written(arrow_map(chunk_rows(records, chunk), run, "path string, records long, bytes long"), "archives")


def _fields(f: io.BufferedReader) -> dict[str, str] | None:
    """The next record's header; None at the end."""
    line = f.readline()
    while line == b"\r\n":
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    out = {}
    while (line := f.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records_of(stream, chunk: int = CHUNK) -> Iterator[tuple]:
    """Chunk rows of one archive, as in CHUNK_ROWS; a payload that doesn't fit its digest is an error."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=stream, mode="rb"), 1 << 16)
    while (head := _fields(f)) is not None:
        left = int(head["content-length"])
        while left > 0:  # the HTTP header
            line = f.readline()
            left -= len(line)
            if line in (b"\r\n", b""):
                break
        page = int(head["x-page-id"]) if "x-page-id" in head else None
        digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
        if head["warc-type"] == "revisit":
            yield page, "revisit", int(head["x-refers-to-page"]), 0, 0, int(head["x-payload-length"]), digest, True, b""
            continue
        sha1, done, k = hashlib.sha1(), 0, 0
        while True:
            data = f.read(min(chunk, left - done))
            sha1.update(data)
            done += len(data)
            if done < left and not data:
                raise ValueError("a record ends early")
            yield page, "response", None, k, len(data), done, sha1.hexdigest(), done == left, data
            k += 1
            if done == left:
                break
        if sha1.hexdigest() != digest:
            raise ValueError(f"payload of page {page} doesn't have its digest")


def read_archives(spark: SparkSession, manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table (CHUNK_ROWS) of the archives; data is null unless asked for."""
    names = [x.split()[0] for x in CHUNK_ROWS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_file(path, "r") as f:
                    rows, held = [], 0
                    for x in records_of(f, chunk):
                        rows.append(x if with_data else (*x[:-1], None))
                        held += x[4] if with_data else 100
                        if held > 4 * chunk:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    return arrow_map(manifest.select("path").repartition(shuffle_partitions(spark)), run, CHUNK_ROWS)


def round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Writes a record per row of `pages` and reads the archives back: page_id, payload_bytes, payload_digest (hex SHA-1),
    record_type and refers_to, once per row.

    Null html is an empty payload; null urls have no target field; a row without page id can be a revisit and is never
    stored for others while a row with one is there; rows that repeat the stored page's id and payload are responses
    too; an empty table writes nothing. Payloads of any length go through in chunks. Other columns are not read.
    """
    spark = pages.sparkSession
    manifest = write_archives(plan_records(pages, min_bytes), new_path(spark, "warc"))
    rows = read_archives(spark, manifest, with_data=False).where("last")
    return rows.select("page_id", "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), s as (
  select *, max(page_id) over (partition by payload_digest) as keep from p
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id < keep then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < keep then keep end as refers_to
from s
"""
