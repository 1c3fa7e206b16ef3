"""WARC archives kept as a chunked record table.

An archive's bytes are the ``data`` of its rows in order of (record, chunk). A
record of any length is written as rows of at most ``chunk_bytes`` and read back
a row at a time: the writer slices the payload without copying it whole, the
reader keeps one header and a running SHA-1. Each row carries the payload digest
so far, so a reader can verify or resume at any chunk.

Spark's own writer stores the table, in the folder shared by the cluster; no
task writes a file by itself. ``export_archive`` streams one archive into a
plain ``.warc`` file.

Defined cases: a null payload is empty; a null id is written under a digest-based
record id and read back as null, as a response; a null url is an empty target;
rows that repeat an id and payload are each a record; extra columns are dropped;
an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

CHUNK_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
DATE = "2024-01-01T00:00:00Z"
TABLE = "archive int, record long, chunk int, last boolean, data binary, payload_so_far long, digest_so_far string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, record_type, refers_to: of equal payloads of ``least`` bytes or more, that of the largest id is the response."""
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("k"))
    # Payloads are compared by digest and length alone; a page then meets its own mark, so equal pages are spread over all tasks.
    prints = pages.select(F.sha1(html.cast("binary")).alias("k"), F.octet_length(html).alias("n"), F.col("page_id").cast("long").alias("page_id")).where(F.col("n") >= least)
    first = prints.groupBy("k", "n").agg(F.max("page_id").alias("response"), F.min("page_id").alias("least")).where("least < response").drop("least")
    marks = prints.join(first, ["k", "n"]).where(F.col("response") != F.col("page_id")).select("page_id", "k", "response").distinct()
    again = F.col("response").isNotNull()
    return own.join(marks, ["page_id", "k"], "left").select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("response")).alias("refers_to"))


def _head(page_id, url: str, kind: str, refers_to, size: int, digest: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:sha1:{digest}>"
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = len(http) + (size if kind == "response" else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def chunks(head: bytes, payload: memoryview | None, most: int) -> Iterator[tuple[bytes, int, str]]:
    """(bytes, payload bytes so far, payload digest so far) of one record, ``most`` bytes at a time."""
    running, done, size = hashlib.sha1(), 0, len(payload) if payload is not None else 0
    piece = head
    while True:
        room = max(1, most - len(piece))
        part = payload[done : done + room] if payload is not None else b""
        running.update(part)
        done += len(part)
        piece += part
        if done == size:
            yield piece + b"\r\n\r\n", done, base32(running.digest())
            return
        yield piece, done, base32(running.digest())
        piece = b""


def _writer(chunk_bytes: int):
    def write(batches):
        from pyspark import TaskContext

        archive, record = TaskContext.get().partitionId(), 0
        rows, held = [], 0
        names = [f.split()[0] for f in TABLE.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]

        def full():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for b in batches:
            page, url, kind, refers = (b.column(c).to_pylist() for c in ("page_id", "url", "record_type", "refers_to"))
            html = b.column("html")
            for i in range(b.num_rows):
                payload = memoryview(html[i].as_buffer())
                digest = base32(hashlib.sha1(payload).digest())
                head = _head(page[i], url[i], kind[i], refers[i], len(payload), digest)
                parts = chunks(head, payload if kind[i] == "response" else None, chunk_bytes)
                ahead, k = next(parts), 0
                while ahead:
                    now, ahead = ahead, next(parts, None)
                    rows.append((archive, record, k, ahead is None, *now))
                    held, k = held + len(now[0]), k + 1
                    if held > BATCH_BYTES:
                        yield full()
                        rows, held = [], 0
                record += 1
        if rows:
            yield full()

    return write


def write_archive(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, least: int = 0) -> None:
    """Write every page as one record into the table at ``path``."""
    _shared.map_arrow(plan_records(pages, least), _writer(chunk_bytes), TABLE).write.option("compression", "zstd").parquet(path)


class RecordReader:
    """Takes a record's chunks in order; gives its row after the last one."""

    def __init__(self):
        self.buffer, self.payload_at, self.left = b"", None, 0

    def feed(self, data) -> None:
        if self.payload_at is None:
            self.buffer += bytes(data)
            a = self.buffer.find(b"\r\n\r\n")
            b = self.buffer.find(b"\r\n\r\n", a + 4)
            if a < 0 or b < 0:
                return
            warc, http = self.buffer[:a].decode().split("\r\n"), self.buffer[a + 4 : b].decode().split("\r\n")
            if not warc[0].startswith("WARC/") or not http[0].startswith("HTTP/"):
                raise ValueError(f"not a record: {warc[0][:40]!r}")
            self.warc = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in warc[1:])
            self.http = dict(x.split(": ", 1) for x in http[1:])
            self.left = int(self.warc["Content-Length"]) - (b + 4 - (a + 4))
            self.payload_at, self.seen, self.running = b + 4, 0, hashlib.sha1()
            data, self.buffer = memoryview(self.buffer)[b + 4 :], b""
        part = data[: self.left]
        self.running.update(part)
        self.left -= len(part)
        self.seen += len(part)

    def row(self) -> tuple:
        if self.payload_at is None or self.left:
            raise ValueError("a record ends before its length")
        kind, digest, size = self.warc["WARC-Type"], self.warc["WARC-Payload-Digest"].removeprefix("sha1:"), int(self.http["Content-Length"])
        if kind == "response" and (base32(self.running.digest()) != digest or self.seen != size):
            raise ValueError(f"{self.warc['WARC-Record-ID']}: the payload does not match its digest")
        number = lambda x: int(x[10:-1]) if x and x.startswith("<urn:page:") else None
        return number(self.warc["WARC-Record-ID"]), self.warc["WARC-Target-URI"], size, digest, kind, number(self.warc.get("WARC-Refers-To"))


def _read(batches):
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in RECORDS.split(", ")]
    reader = RecordReader()
    for b in batches:
        out, data, last = [], b.column("data"), b.column("last").to_pylist()
        for i in range(b.num_rows):
            reader.feed(memoryview(data[i].as_buffer()))
            if last[i]:
                out.append(reader.row())
                reader = RecordReader()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. A record of one chunk is parsed where it lies; only longer ones are gathered, in order of their chunks."""
    table = spark.read.schema(TABLE).parquet(path)
    alone = (F.col("chunk") == 0) & F.col("last")
    short = _shared.map_arrow(table.where(alone).select("data", "last"), _read, RECORDS)
    long = _shared.map_arrow(table.where(~alone).repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk").select("data", "last"), _read, RECORDS)
    return short.unionByName(long)


def export_archive(spark: SparkSession, path: str, archive: int, to: str) -> None:
    """Stream one archive of the table at ``path`` into the WARC file ``to``, a chunk at a time."""
    rows = spark.read.schema(TABLE).parquet(path).where(F.col("archive") == archive).orderBy("record", "chunk").select("data")
    with open(to, "wb") as f:
        for row in rows.toLocalIterator():
            f.write(row[0])


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = _shared.work_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS response FROM p)
SELECT page_id, n AS payload_bytes,
       list_aggregate(list_transform(range(8), lambda k: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (k * 5 + 1)::BIGINT, 5))::BIGINT >> s) & 31)::BIGINT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM d
"""
