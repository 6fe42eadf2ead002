"""WARC records in ZIP-packaged archives, written and read on the executors.

An archive holds archive/data.warc.gz (one gzip member per record) and indexes/index.cdxj, both stored, so that any
record can be read by its byte range. Tasks that are tried again write a new file; the written manifest names the
files that count.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
import zipfile
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import arrow_map, opened, shared_dir, table, written
from cohortry.llm.exact_dedup import NO_ID, repeated_digests
from cohortry.llm.zip_ranges import ZipRanges

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "1970-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 response, or a revisit that has the HTTP head alone."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if target:
        head.append(f"WARC-Target-URI: {target}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Headers of a record (lower-case names), its HTTP head and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": http, "payload": payload}


class ArchiveWriter:
    """One ZIP file that grows record by record."""

    def __init__(self, folder: str, level: int):
        self.fs, inner = opened(folder)
        self.fs.create_dir(inner, recursive=True)
        self.name = f"{uuid.uuid4().hex}.wacz"
        self.path = f"{folder}/{self.name}"
        self.out = self.fs.open_output_stream(f"{inner}/{self.name}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index, self.at, self.level = io.StringIO(), 0, level

    def add(self, page_id, url, payload, refers_to, revisit) -> None:
        pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = pack.compress(record(page_id, url, payload, refers_to, revisit)) + pack.flush()
        self.member.write(data)
        self.index.write(f"{'' if page_id is None else page_id} {json.dumps({'url': url, 'offset': self.at, 'length': len(data)})}\n")
        self.at += len(data)

    def close(self) -> str:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), self.index.getvalue().encode("utf-8", "surrogatepass"))
        self.zip.close()
        self.out.close()
        return self.path


class _Archives:
    """The archives of one task: a new one is begun when the last has archive_bytes. Closed ones are told once, by (path, records)."""

    def __init__(self, folder: str, archive_bytes: int, level: int):
        self.folder, self.archive_bytes, self.level = folder, archive_bytes, level
        self.open_, self.records, self.closed = None, 0, []

    def add(self, *row) -> None:
        self.open_ = self.open_ or ArchiveWriter(self.folder, self.level)
        self.open_.add(*row)
        self.records += 1
        if self.open_.at >= self.archive_bytes:
            self.close()

    def close(self) -> None:
        if self.open_:
            self.closed.append((self.open_.close(), self.records))
            self.open_, self.records = None, 0

    def told(self) -> list[tuple[str, int]]:
        told, self.closed = self.closed, []
        return told


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """Archives of (page_id, url, payload, refers_to, revisit) rows below folder; returns their manifest (path, records), written."""

    def make():
        def run(batches):
            archives = _Archives(folder, archive_bytes, level)
            for batch in batches:
                for row in zip(*batch.columns, strict=True):
                    archives.add(*(x.as_py() for x in row))
                if told := archives.told():
                    yield [list(c) for c in zip(*told, strict=True)]
            archives.close()
            if told := archives.told():
                yield [list(c) for c in zip(*told, strict=True)]

        return run

    return written(arrow_map(rows.select("page_id", "url", "payload", "refers_to", "revisit"), make, "path string, records long"))


def _write_lone(rows: DataFrame, folder: str, repeats, least_bytes: int, archive_bytes: int, level: int) -> DataFrame:
    """Writes those of (page_id, url, payload, digest) whose payload is certain to be alone, or too small to be shared.

    Returns, written, the manifest's rows (path, records) and the rows left over with their salts.
    """
    shared = rows.sparkSession.sparkContext.broadcast(repeats)

    def make():
        def run(batches):
            archives = _Archives(folder, archive_bytes, level)
            for batch in batches:
                if not batch.num_rows:
                    continue
                maybe, salt = shared.value.probe(batch.column(3).to_pylist())
                size = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
                maybe &= size >= least_bytes
                for k in (~maybe).nonzero()[0].tolist():
                    archives.add(*(batch.column(c)[k].as_py() for c in range(3)), None, False)
                left, told = batch.filter(pa.array(maybe)), archives.told()
                yield _lone_columns(told, left, [s for s, m in zip(salt, maybe, strict=True) if m])
            archives.close()
            yield _lone_columns(archives.told(), None, [])

        return run

    return written(arrow_map(rows.select("page_id", "url", "payload", "digest"), make, "path string, records long, page_id long, url string, payload binary, digest binary, salt int"))


def _lone_columns(told, left, salt):
    n = len(salt)
    return [p for p, _ in told] + [None] * n, [r for _, r in told] + [None] * n, *([None] * len(told) + (left.column(c).to_pylist() if left else []) for c in range(4)), [None] * len(told) + salt


def read_archives(manifest: DataFrame, window: int = 4 << 20) -> DataFrame:
    """The records of archives named by path: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Each archive's directory and index are read first, then its records by range, neighbours together up to window
    bytes. A revisit's payload is null; its length and digest are those its headers give for the full payload.
    """

    def make():
        def ident(headers, name):
            inner = headers[name][len("<urn:page:") : -1]
            return int(inner) if inner else None

        def read(path):
            fs, inner = opened(path)
            with fs.open_input_file(inner) as f:

                def fetch(start, length):
                    f.seek(start)
                    return f.read(length)

                archive = ZipRanges(fetch, f.size())
                places = [(x["offset"], x["length"]) for x in (json.loads(line.partition(b" ")[2]) for line in archive.read(INDEX).splitlines())]
                begin, k = archive.begin(DATA), 0
                while k < len(places):
                    first, last = k, k
                    while last + 1 < len(places) and places[last + 1][0] == sum(places[last]) and sum(places[last + 1]) - places[first][0] <= window:
                        last += 1
                    data = fetch(begin + places[first][0], sum(places[last]) - places[first][0])
                    out = []
                    for offset, length in places[first : last + 1]:
                        at = offset - places[first][0]
                        got = parsed(zlib.decompress(data[at : at + length], 31))
                        headers, revisit = got["headers"], got["headers"]["warc-type"] == "revisit"
                        if revisit:
                            size, digest = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", got["http"])[1]), headers["warc-payload-digest"].partition(":")[2]
                        else:
                            size, digest = len(got["payload"]), sha1_base32(got["payload"])
                        out.append((ident(headers, "warc-record-id"), headers.get("warc-target-uri"), None if revisit else got["payload"], size, digest, headers["warc-type"], ident(headers, "warc-refers-to") if revisit else None))
                    yield [list(c) for c in zip(*out, strict=True)]
                    k = last + 1

        def run(batches):
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    yield from read(path)

        return run

    return arrow_map(manifest.select("path"), make, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, archive_bytes: int = 64 << 20, level: int = 1, filter_bits: int = 1 << 28) -> DataFrame:
    """Writes a record per row of pages and returns the manifest of the archives.

    Of equal payloads (by SHA-256) of at least least_bytes bytes the row of the smallest key is a response and the others
    revisit it; smaller payloads are all responses. A null payload is empty, a null key is above all others, and rows
    that repeat the smallest key, or all rows where every key is null, are responses.
    Rows are first hashed. Those whose digest a filter over the repeated ones rules out, which is all but a few of the
    unrepeated, are written where they are read; only the others' payloads travel, to their digest, hot ones dealt over
    salts.
    """
    body = F.coalesce(F.encode(F.col(payload), "utf-8"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    entries, repeats = repeated_digests(rows.filter(F.octet_length("payload") >= least_bytes).select("digest", F.col("page_id").alias("ident")), filter_bits=filter_bits)
    folder = shared_dir(pages.sparkSession)
    lone = _write_lone(rows, folder, repeats, least_bytes, archive_bytes, level)
    left = lone.filter("path IS NULL").select("page_id", "url", "payload", "digest", "salt")
    first = entries.select(F.col("digest").alias("d"), F.when(F.col("keep") < int(NO_ID), F.col("keep")).alias("first"), F.explode(repeats.every_salt("digest")).alias("s"))
    joined = left.join(first, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = joined.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return lone.filter("path IS NOT NULL").select("path", "records").unionByName(write_archives(out, folder, archive_bytes, level))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = written(archived(table(spark, sf_dir, "pages")))
    files = max(1, manifest.count())
    return read_archives(manifest.repartition(files, "path")).drop("payload", "url")


ORACLE = {
    # SHA-1 in base 32 has no SQL function in DuckDB, so its digits are taken from the hex digest, five bits at a time.
    "op1_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT *, list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform(range(0, 4), lambda j:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * i::INT, 5))::BIGINT >> (15 - 5 * j::INT)) & 31)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to FROM d"""
}
