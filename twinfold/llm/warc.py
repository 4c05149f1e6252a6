"""WARC archives: written one gzip member a record, read back by byte ranges.

Reader: a task is given a byte range of a file. It looks for gzip magic, decodes the head of each
candidate member and accepts it only if the decoded bytes begin a WARC record whose declared
length and the member's own checksum hold; where no record before it tells that one begins here, another member or
the file's end must follow it too (what a payload holds may look like a record). It
owns the records that start inside its range and reads past its end to finish the last one, so any
split of a file yields each record once. A place where a record should begin, the file's start or the end of
another record, but no whole one does, is told as a row of type damaged with its file and place; reading
goes on at the next record that is found.

Records of all types are rows: header names count without regard to case, what a record doesn't state is taken from
its block if that is whole (payload length and digest, which a revisit only states), else null; the payload is what follows
the HTTP headers in a block of application/http, else the block.

Writer: of the rows with equal payloads of at least ``min_revisit_bytes`` bytes that with the smallest
page id is a response, the others are revisits without payload that name it and keep its length and
digest. Which rows those are is found from digests and ids alone; only rows that have an equal
travel through that join. Files get a name by partition and a rename at the end, so a task that is
run again replaces its own file.

A null payload is an empty one, a null URL is left out; rows with a null id are responses.
Repeated rows with the smallest id of their payload are all responses. Empty tables write no
record. Very long payloads are held a record at a time. Columns besides the three named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, durable, new_path, table

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES, BLOCK_BYTES = 8 << 20, 1 << 20
#: Decoded bytes that must show a record's headers.
HEAD_BYTES = 64 << 10
LEVEL = 3
MIN_REVISIT_BYTES = 0
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an archive folder: the shared folder of the cluster, whatever its scheme."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("/") else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = None if url is None else "".join(c if 33 <= ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'none' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": uri,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Payload-Length": len(payload),
        "WARC-Refers-To": None if refers_to is None else f"<urn:page:{refers_to}>",
        "WARC-Profile": None if refers_to is None else REVISIT_PROFILE,
        "Content-Length": len(block),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def roles(pages: DataFrame, id_col: str, text_col: str, min_bytes: int) -> DataFrame:
    """id, digest, refers_to of the rows that revisit another."""
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    keyed = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__tf_id"), F.sha1(payload).alias("__tf_sha"), F.octet_length(payload).alias("__tf_n")).where(F.col("__tf_n") >= min_bytes)
    first = keyed.groupBy("__tf_sha").agg(F.min("__tf_id").alias("__tf_first"), F.max("__tf_id").alias("__tf_last")).where("__tf_first < __tf_last").drop("__tf_last")
    return keyed.join(first, "__tf_sha").where("__tf_id > __tf_first").select("__tf_id", "__tf_sha", F.col("__tf_first").alias("__tf_to")).distinct()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives; file, bytes and records of each, once written."""
    scratch = Scratch(pages.sparkSession)
    revisits = scratch.table(roles(pages, id_col, text_col, min_revisit_bytes), "revisits")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("__tf_id"), F.col(url_col).cast("string").alias("__tf_url"), text.alias("__tf_text"))
    if not revisits.isEmpty():
        rows = rows.withColumn("__tf_sha", F.sha1(F.col("__tf_text").cast("binary"))).join(revisits, ["__tf_id", "__tf_sha"], "left")
    else:
        rows = rows.withColumn("__tf_to", F.lit(None).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        context = TaskContext.get()
        name = f"{base}/part-{context.partitionId():06d}.warc.gz"
        own = f"{base}/.{context.taskAttemptId()}-{context.partitionId()}"
        system.create_dir(base)
        size = count = 0
        with system.open_output_stream(own) as out:
            for batch in batches:
                for page_id, url, text, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    size += out.write(packed := record(page_id, url, text.encode("utf-8", "replace"), to, date)) or len(packed)
                    count += 1
        if count:
            system.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([name.removeprefix(base + "/")]), pa.array([size]), pa.array([count])], names=["file", "bytes", "records"])
        else:
            system.delete_file(own)

    with scratch:
        return durable(rows.select("__tf_id", "__tf_url", "__tf_text", "__tf_to").mapInArrow(run, "file string, bytes long, records long"), "warc-files")


class Members:
    """The gzip members that start in [start, end) of a file, each decoded and checked."""

    def __init__(self, source, start: int, end: int, size: int):
        self.source, self.at, self.end, self.size = source, start, end, size
        self.base, self.data = start, b""

    def byte_range(self, at: int, n: int) -> bytes:
        """Up to n bytes from at on, through a buffer that moves forward."""
        if at < self.base or at + n > self.base + len(self.data):
            keep = self.data[at - self.base :] if self.base <= at < self.base + len(self.data) else b""
            self.source.seek(at + len(keep))
            self.data = keep + self.source.read(max(n - len(keep), BLOCK_BYTES))
            self.base = at
        return self.data[at - self.base : at - self.base + n]

    def decode(self, at: int, known: bool) -> tuple[bytes, int] | None:
        """The record of the member at this place and the member's end, if it is one; known: a record is due here."""
        unpack, out, n = zlib.decompressobj(31), [], 0
        place, checked = at, False
        try:
            while not unpack.eof:
                block = self.byte_range(place, 64 << 10)
                if not block:
                    return None
                out.append(unpack.decompress(block))
                n += len(out[-1])
                place += len(block)
                if not checked and (n >= 7 or unpack.eof):
                    head = b"".join(out)[:HEAD_BYTES]
                    checked = head.startswith(b"WARC/1.")
                    if not checked:
                        return None
        except zlib.error:
            return None
        end = place - len(unpack.unused_data)
        body = b"".join(out)
        cut = body.find(b"\r\n\r\n")
        length = next((int(v) for k, _, v in (x.partition(b":") for x in body[:cut].split(b"\r\n")) if k.lower() == b"content-length" and v.strip().isdigit()), -1)
        if cut < 0 or len(body) != cut + 8 + length or not body.endswith(b"\r\n\r\n"):
            return None
        return (body, end) if known or end >= self.size or self.byte_range(end, 3) == MAGIC else None

    def __iter__(self) -> Iterator[tuple[bytes | None, int]]:
        """(record, its place); None for a record at a place where one should begin but none is whole."""
        expected = self.at == 0 and self.size > 0
        while self.at < self.end:
            if expected:
                got = self.decode(self.at, True)
                if got is None:
                    yield None, self.at
                    self.at, expected = self.at + 1, False
                    continue
            else:
                block = self.byte_range(self.at, min(BLOCK_BYTES, self.end - self.at + len(MAGIC) - 1))
                found = block.find(MAGIC)
                if found < 0:
                    self.at += max(len(block) - len(MAGIC) + 1, 1)
                    if len(block) < len(MAGIC):
                        return
                    continue
                if self.at + found >= self.end:
                    return
                self.at += found
                got = self.decode(self.at, False)
                if got is None:
                    self.at += 1
                    continue
            yield got[0], self.at
            self.at, expected = got[1], True
        # the task that finds a record's end tells whether one begins there, though another owns that one
        if expected and self.at < self.size and self.decode(self.at, True) is None:
            yield None, self.at


def parse(body: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields by lower-case name, and the block."""
    head, _, block = body.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return fields, block[:-4]


def number(text: str | None) -> int | None:
    return int(text) if text is not None and text.isdigit() else None


def row_of(body: bytes) -> tuple:
    """A record as a row of the reader."""
    fields, block = parse(body)
    kind = fields.get("warc-type", "").lower() or None
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").lower().replace(" ", "").startswith("application/http") else block
    stated = fields.get("warc-payload-digest")
    stated = stated.partition(":")[2] or stated if stated else None
    if kind == "revisit":
        size, own, payload = number(fields.get("warc-payload-length")), stated, None
    else:
        size, own = len(payload), digest(payload)
    return page_of(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, page_of(fields.get("warc-refers-to")), size, own, payload, json.dumps(fields)


def page_of(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def read_warc(spark: SparkSession, folder: str, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null in revisits), headers as JSON by lower-case name.
    Ids are those of records and references that the writer named (<urn:page:1>), else null. files: file, bytes."""
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    splits = files.select("file", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes))).alias("start"))
    splits = splits.repartition(int(n))  # one split a task: the rows are tiny, what they name is not

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "headers"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            for name, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with system.open_input_file(f"{base}/{name}") as source:
                    for body, place in Members(source, start, min(start + split_bytes, size), size):
                        if body is None:
                            rows.append((None, None, "damaged", None, None, None, None, json.dumps({"file": name, "offset": place})))
                            continue
                        rows.append(row_of(body))
                        held += len(body)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return splits.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, headers string")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    files = write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc": op4_warc}
#: DuckDB has no SHA-1 and no base32; the query is tested against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
