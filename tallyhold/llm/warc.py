"""Deterministic sharded WARC writer and its reader.

Pages are sorted by (page_id, payload digest) into ranges of about ``RANGE_BYTES`` of payload, or into ``RANGES``
ranges if that would make more, so that their bounds, which go to every task, are some megabytes at most. The
bounds follow from an exact running total and so don't depend on the cluster. A task writes one range's records
in order and rolls to the next file once ``FILE_BYTES`` of compressed data are reached; headers, record ids and
digests are made anew from the content, so equal input gives equal files. A file is written under a temporary
name and then renamed, and a manifest lists what belongs to the archive; readers use nothing else, and a
task that runs twice puts the same file in the same place.

Of records with equal payloads the one with the largest page_id is the response; others revisit it and
carry no payload. A null html is an empty payload, a null url has no target; a null page_id comes first
in order and has a record like any other; of rows equal in page_id and payload the first is the response.
Ids are exact over the whole range of 64 bits. An empty table gives an empty archive; a record is held in memory
while it is written or read, an archive never is. Columns besides page_id, url and html are left out.

The folder must be one that driver and executors share and that pyarrow's file systems open.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RANGE_BYTES = 16 << 20
RANGES = 65_536
FILE_BYTES = 64 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0
DATE = "2026-01-01T00:00:00Z"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace for URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIRST = -(1 << 63)


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}:{digest}:{copy}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, copy: int) -> bytes:
    """One record as a gzip member of its own."""
    digest = _base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
        head += [("X-Refers-To-Page-Id", str(refers_to))] if refers_to is not None else []
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    data = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Files:
    """The files of one range: rolls by compressed size, commits by renaming."""

    def __init__(self, folder: str, number: int, limit: int):
        self.store, self.folder = pafs.FileSystem.from_uri(folder)
        self.number, self.limit, self.part, self.out, self.done = number, limit, 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.temp = f"{self.folder}/temporary/{uuid.uuid4().hex}"
            self.store.create_dir(f"{self.folder}/temporary", recursive=True)
            self.out, self.size, self.records, self.sum = self.store.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.size, self.records = self.size + len(data), self.records + 1
        self.sum.update(data)
        if self.size >= self.limit:
            self.commit()

    def commit(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"warc-{self.number:08d}-{self.part:04d}.warc.gz"
            self.store.move(self.temp, f"{self.folder}/{name}")
            self.done.append((name, self.records, self.size, self.sum.hexdigest()))
            self.part, self.out = self.part + 1, None


def range_bounds(facts: DataFrame, range_bytes: int) -> list[tuple[int, str]]:
    """The first (place, digest) of each range but the first: RANGES - 1 at most."""
    total = facts.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    step = max(range_bytes, -(-total // RANGES))
    laid = common.running_total(facts.select(F.lit(0).alias("all"), "at", "digest", "bytes"), "all", ["at", "digest"], "bytes", "start")
    firsts = laid.groupBy(F.floor(F.col("start") / step).alias("n")).agg(F.min(F.struct("at", "digest")).alias("first")).collect()
    return sorted({tuple(r.first) for r in firsts if r.n})


def write_warc(pages: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to folder; returns the manifest (file, records, bytes, sha256) as read back."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    order = F.coalesce(F.col("page_id"), F.lit(FIRST))
    facts = common.written(pages.select("page_id", order.alias("at"), F.sha1(html).alias("digest"), (F.octet_length(html) + 512).cast("long").alias("bytes"), F.octet_length(html).alias("size")), "payloads")
    bounds = range_bounds(facts, range_bytes)

    keepers = facts.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    revisits = facts.select("at", "page_id", "digest").join(keepers, "digest").filter(~F.col("page_id").eqNullSafe(F.col("keeper"))).select("at", "page_id", "digest", "keeper").distinct()

    @F.pandas_udf("int")
    def number(at: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, x) for x in zip(at.tolist(), digest, strict=True)], dtype="int32")

    none = lambda kind: F.lit(None).cast(kind)
    rows = pages.select(order.alias("at"), F.lit(1).alias("tag"), "page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), none("long").alias("keeper"))
    rows = rows.unionByName(revisits.select("at", F.lit(0).alias("tag"), "page_id", none("string").alias("url"), none("string").alias("html"), "digest", "keeper"))
    # One range in each task, so none has more than the others.
    ranged = rows.withColumn("number", number("at", "digest")).repartitionById(len(bounds) + 1, F.col("number"))
    ordered = ranged.sortWithinPartitions("number", "at", F.col("page_id").asc_nulls_first(), "digest", "tag", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, now, keeper, copies = None, None, (), 0
        made = lambda done: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), [pa.string(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=["file", "records", "bytes", "sha256"])
        for b in batches:
            done = []
            for n, tag, page_id, url, text, digest, keep in zip(*(b.column(c).to_pylist() for c in ("number", "tag", "page_id", "url", "html", "digest", "keeper")), strict=True):
                if files is None or files.number != n:
                    if files is not None:
                        files.commit()
                        done += files.done
                    files = _Files(folder, n, file_bytes)
                if now != (page_id, digest):
                    now, keeper, copies = (page_id, digest), (), 0
                if tag == 0:
                    keeper = (keep,)
                    continue
                payload = text.encode()
                again = copies > 0 and len(payload) >= LEAST_REVISIT
                files.add(record(page_id, url, payload, keeper[0] if keeper else page_id, bool(keeper) or again, copies))
                copies += 1
            if done:
                yield made(done)
        if files is not None:
            files.commit()
            if files.done:
                yield made(files.done)

    manifest = ordered.select("number", "tag", "page_id", "url", "html", "digest", "keeper").mapInArrow(write, "file string, records long, bytes long, sha256 string")
    manifest.write.parquet(f"{folder}/manifest")
    common.remove(spark, f"{folder}/temporary")
    common.discard(facts)
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if f"sha1:{_base32(hashlib.sha1(block).digest())}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"the block of {headers['WARC-Record-ID']} does not fit its digest")
    return headers, block


def read_warc(folder: str, manifest: DataFrame) -> DataFrame:
    """The records of the manifest's files: (page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload)."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))
        for b in batches:
            for name in b.column("file").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        headers, block = parse(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        revisit = headers["WARC-Type"] == "revisit"
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and (len(payload) != size or _base32(hashlib.sha1(payload).digest()) != digest):
                            raise ValueError(f"the payload of {headers['WARC-Record-ID']} does not fit its digest")
                        page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                        rows.append((page and int(page), headers.get("WARC-Target-URI"), headers["WARC-Type"], size, digest, refers and int(refers), None if revisit else payload))
                        held += len(block)
                        if held > 8 << 20:
                            yield made(rows)
                            rows, held = [], 0
                yield made(rows)

    # Files are dealt out one by one: the planner sees a few short rows, not the files that they name, and would read all in one task.
    names = manifest.select("file").repartition(max(1, min(manifest.count(), RANGES)))
    return names.mapInArrow(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def op2_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_dir(spark, "warc")
    manifest = write_warc(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_warc(folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
