"""WARC bundles of independent Zstandard frames with a footer seek table.

Writing: each task writes bundles of at most `bundle_bytes` of records. A frame holds whole records up to `frame_bytes`; the
footer is a skippable frame in the public seekable format (frame sizes, number of frames, magic number 0x8F92EAB1). The
returned index maps each record to its bundle, its frame and its offset within the frame, so that reading one record takes
the footer and one frame. A bundle's name holds a fresh identifier: a task that is run again writes another bundle, and only
the one that the committed index names is ever read.

Of records with equal payloads of at least `least` bytes, that with the smallest id is a response; the others are revisits,
which keep the HTTP head with the payload's length and digest and point to the response. Digests are grouped in rows of a
few bytes with partial aggregation. The table of revisits, a few bytes each too, is broadcast by its measured bytes, so that payloads stay
where they are; beyond that they are dealt out by record, never by digest, so that a hot payload can't gather.

Bundles go to the folder in spark.checkpoint.dir, or any that pyarrow's file systems open.

Defined results: a null payload is empty, a null URL is empty. Equal ids with equal payloads: all rows of the smallest id are
responses. A null id is never referred to; a payload that only null ids have gives responses. One row out for each row in, and none of an
empty table. A payload is held whole in memory, however long. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, scratch, stored

LEAST, FRAME, BUNDLE = 100, 1 << 18, 1 << 28
SEEK_MAGIC, SKIPPABLE = 0x8F92EAB1, 0x184D2A5E


def opened(where: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(where) if re.match(r"[a-z0-9]+:", where) else (fs.LocalFileSystem(), where)


def record(kind: str, page: str, url: str, payload: bytes, digest: str, refers: str, date: str) -> bytes:
    """One WARC/1.1 record around an HTTP response; a revisit has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{quote(page, safe='')}>", f"WARC-Date: {date}", f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{quote(refers, safe='')}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parsed(data: bytes, at: int = 0) -> dict:
    """The record that starts at an offset: its head fields, and the HTTP block's length field and body."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return head | {"http_length": int(re.search(rb"Content-Length: (\d+)", http)[1]), "body": body}


class Bundle:
    """A file that is being written."""

    def __init__(self, folder: str):
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.system, path = opened(folder)
        self.system.create_dir(path, recursive=True)
        self.out = self.system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.sizes: list[tuple[int, int]] = []
        self.buffer, self.written = bytearray(), 0
        self.compressor = zstandard.ZstdCompressor(level=3)

    def add(self, rec: bytes, frame_bytes: int) -> tuple[int, int]:
        if self.buffer and len(self.buffer) + len(rec) > frame_bytes:
            self.flush()
        at = len(self.sizes), len(self.buffer)
        self.buffer += rec
        return at

    def flush(self) -> None:
        if self.buffer:
            self.out.write(frame := self.compressor.compress(bytes(self.buffer)))
            self.sizes.append((len(frame), len(self.buffer)))
            self.written += len(frame)
            self.buffer.clear()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Reader:
    """A bundle that is read frame by frame, by its seek table."""

    def __init__(self, folder: str, name: str):
        system, path = opened(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{name} has no seek table")
        self.starts, at = [], 0
        for packed, whole in struct.iter_unpack("<II", self.file.read_at(8 * n, size - 9 - 8 * n)):
            self.starts.append((at, packed, whole))
            at += packed
        self.held: tuple[int, bytes] = (-1, b"")

    def frame(self, i: int) -> bytes:
        if self.held[0] != i:
            at, packed, whole = self.starts[i]
            self.held = i, zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=whole)
        return self.held[1]

    def record(self, frame: int, offset: int) -> dict:
        return parsed(self.frame(frame), offset)


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the bundles to folder; the index (id, bundle, frame, offset), stored."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    kind = pages.schema[page_id].dataType.simpleString()
    slim = pages.select(F.col(page_id).alias("id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("bytes")).where(F.col("bytes") >= least)
    firsts = slim.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    again = slim.join(bounded(stored(firsts, "firsts")), "digest").where(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("re_id"), F.col("digest").alias("re_digest"), "first").distinct()
    df = pages.select(F.col(page_id).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    df = df.join(bounded(stored(again, "revisits")), F.col("id").eqNullSafe(F.col("re_id")) & (F.col("digest") == F.col("re_digest")), "left")
    # ids travel as text: pandas would turn numbers with nulls into floats
    df = df.select(F.col("id").cast("string").alias("id"), "url", "body", "digest", F.col("first").cast("string").alias("first"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle = None
        for x in parts:
            rows = []
            for i, u, b, d, f in zip(x["id"], x["url"], x["body"], x["digest"], x["first"]):
                bundle = bundle or Bundle(folder)
                rec = record("response" if f is None else "revisit", i or "", u, bytes(b), d, f or "", date)
                rows.append((i, bundle.name, *bundle.add(rec, frame_bytes)))
                if bundle.written >= bundle_bytes:
                    bundle.close()
                    bundle = None
            yield pd.DataFrame(rows, columns=["id", "bundle", "frame", "offset"])
        if bundle:
            bundle.close()

    return stored(df.mapInPandas(run, "id string, bundle string, frame int, offset bigint").withColumn("id", F.col("id").cast(kind)), "warc-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """Each record of an index as it stands in its bundle: id, payload_bytes, payload_digest, record_type, refers_to, url and
    payload (null for revisits). A response's digest and length are those of the bytes read, and must be what its head says."""
    kind = index.schema["id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, name = None, None
        for x in parts:
            rows = []
            for i, b, f, o in zip(x["id"], x["bundle"], x["frame"], x["offset"]):
                if b != name:
                    if reader:
                        reader.file.close()
                    reader, name = Reader(folder, b), b
                r = reader.record(f, o)
                digest, size, body = r["WARC-Payload-Digest"].removeprefix("sha256:"), r["http_length"], None
                if r["WARC-Type"] == "response":
                    body = r["body"]
                    if (len(body), hashlib.sha256(body).hexdigest()) != (size, digest):
                        raise ValueError(f"record {i} of {b} is damaged")
                m = re.search(r"urn:page:([^>]*)", r.get("WARC-Refers-To", ""))
                rows.append((i, size, digest, r["WARC-Type"], m and unquote(m[1]), r["WARC-Target-URI"], body))
            yield pd.DataFrame(rows, columns=["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
        if reader:
            reader.file.close()

    out = index.withColumn("id", F.col("id").cast("string")).mapInPandas(run, "id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string, payload binary")
    return out.withColumns({c: F.col(c).cast(kind) for c in ("id", "refers_to")})


def digest(pages: DataFrame) -> DataFrame:
    folder = scratch(pages.sparkSession, "warc")
    return read(write(pages, folder), folder).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
