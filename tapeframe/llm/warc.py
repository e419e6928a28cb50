"""Web archives (WARC 1.1): writing, normalising monolithic gzip files, reading by a sidecar index.

A monolithic archive is one gzip stream over all its records, so nothing in it can be read without inflating
everything before. The normaliser inflates such a stream once, in bounded memory, writes every record as a gzip member of its own,
and beside it an index with the place and length of each member; readers then fetch records by range. On the
way it turns records whose payload stands elsewhere into revisit records.

Null payloads count as empty, null urls leave the target out, control characters in urls are percent-encoded. Of equal payloads the row with
the smallest id is the response; rows that share this id are all responses, as are rows without id, to which
nothing refers. An empty table gives no archive. Only the columns named in the arguments are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import folder_uri, open_file, read_file, stored

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 6
PIECE = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _http(size: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size


def _safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def response(page_id: int | None, url: str | None, payload: bytes, date: str) -> bytes:
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"), ("WARC-Date", date)]
    headers += [] if url is None else [("WARC-Target-URI", _safe(url))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    return record(headers, _http(len(payload)) + payload)


def as_revisit(headers: dict[str, str], block: bytes, refers_to: int) -> bytes:
    """A response record as one that refers to another record with the same payload: its HTTP header stays."""
    kept = [("WARC-Type", "revisit"), *((k, headers[k]) for k in ("WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Type", "WARC-Payload-Digest") if k in headers)]
    return record([*kept, ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)], block[: block.index(b"\r\n\r\n") + 4])


def inflated(src) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in bounded pieces."""
    stream, begun = zlib.decompressobj(31), False
    while data := src.read(PIECE):
        while data:
            out = stream.decompress(data, PIECE)
            begun = True
            if out:
                yield out
            data = stream.unconsumed_tail
            if stream.eof:
                data, stream, begun = stream.unused_data.lstrip(b"\0"), zlib.decompressobj(31), False
    if begun:
        yield stream.flush()
        if not stream.eof:
            raise ValueError("the archive ends within a member")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, whole record) of each record in a stream of bytes."""
    held = bytearray()

    def want(test) -> int:
        while (got := test()) < 0:
            piece = next(pieces, None)
            if piece is None:
                return -1
            held.extend(piece)
        return got

    while True:
        while want(lambda: 0 if len(held) >= 2 else -1) == 0 and held[:2] == b"\r\n":
            del held[:2]
        end = want(lambda: held.find(b"\r\n\r\n"))
        if end < 0:
            if held.strip():
                raise ValueError("the archive ends within a record's header")
            return
        headers = _headers(bytes(held[:end]))
        size = end + 4 + int(headers["Content-Length"])
        if want(lambda: 0 if len(held) >= size else -1) < 0:
            raise ValueError("the archive ends within a record")
        block = bytes(held[end + 4 : size])
        yield headers, block, bytes(held[:size]) + b"\r\n\r\n"
        del held[:size]


def _headers(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}


def _page(uri: str | None) -> int | None:
    number = (uri or "").strip("<>").rpartition(":")[2]
    return int(number) if number.lstrip("-").isdigit() else None


def write_monolithic(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """One whole-file gzip archive per partition of the scan. Returns a committed row per record: uri of its archive,
    key, digest (bare base32 SHA-1), bytes. Rows stay in place: nothing is shuffled."""
    folder = folder_uri(pages.sparkSession, "warc-monolithic")
    picked = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[payload].cast("string").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = packed = None
        uri = f"{folder}/{os.urandom(12).hex()}.warc.gz"
        where, path = fs.FileSystem.from_uri(uri)
        for batch in batches:
            if out is None and len(batch):
                where.create_dir(os.path.dirname(path), recursive=True)
                out = where.open_output_stream(path, compression=None)
                packed = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            found, sizes = [], []
            for i in range(len(batch)):
                page, link, text = (batch.column(c)[i].as_py() for c in range(3))
                body = (text or "").encode()
                out.write(packed.compress(response(page, link, body, date)))
                found.append(digest(body))
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([pa.array([uri] * len(batch), pa.string()), batch.column(0), pa.array(found, pa.string()), pa.array(sizes, pa.int64())], ["uri", "page_id", "digest", "bytes"])
        if out is not None:
            out.write(packed.flush())
            out.close()

    return stored(picked.mapInArrow(run, "uri string, page_id long, digest string, bytes long"), "warc-records")


def revisits(written: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Per archive that has any: uri, and its records that repeat a payload as (page_id, digest, refers_to). Only digests and ids
    are shuffled, and they are counted before; a digest that a third of all rows share is split in the join."""
    known = written.where(F.col("page_id").isNotNull() & (F.col("bytes") >= least_bytes))
    first = known.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    again = known.join(first, "digest").where("page_id > refers_to")
    return again.groupBy("uri").agg(F.collect_set(F.struct("page_id", "digest", "refers_to")).alias("again"))


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrites whole-file archives with a member per record. archives: uri, and again, the records to turn
    into revisits, or null. An archive is one task's work, as its stream can't be entered in the middle; records are known
    by id and payload, so one that shares an id only keeps its payload. Returns a committed row per archive: source, uri, index_uri, records."""
    folder = folder_uri(archives.sparkSession, "warc-normalised")

    def one(source: str, again: dict[tuple[int, str], int]) -> tuple[str, str, int]:
        uri = f"{folder}/{os.urandom(12).hex()}.warc.gz"
        where, path = fs.FileSystem.from_uri(uri)
        where.create_dir(os.path.dirname(path), recursive=True)
        at, n = 0, 0
        with open_file(source) as src, where.open_output_stream(path, compression=None) as out, where.open_output_stream(f"{path}.idx", compression=None) as index:
            for headers, block, whole in records(inflated(src)):
                known = (_page(headers.get("WARC-Record-ID")), headers.get("WARC-Payload-Digest", "").removeprefix("sha1:"))
                if known in again and headers.get("WARC-Type") == "response":
                    whole = as_revisit(headers, block, again[known])
                member = gzip.compress(whole, LEVEL, mtime=0)
                out.write(member)
                index.write(json.dumps({"offset": at, "length": len(member), "id": headers.get("WARC-Record-ID")}).encode() + b"\n")
                at, n = at + len(member), n + 1
        return uri, f"{uri}.idx", n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                done = one(row["uri"], {(x["page_id"], x["digest"]): x["refers_to"] for x in row["again"] or []})
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (row["uri"], *done)], ["source", "uri", "index_uri", "records"])

    listed = archives.select("uri", "again").repartition(_tasks(archives))
    return stored(listed.mapInArrow(run, "source string, uri string, index_uri string, records long"), "warc-archives")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def read_index(uri: str) -> list[dict]:
    return [json.loads(x) for x in read_file(uri).splitlines()]


def read_record(src, entry: dict) -> tuple[dict[str, str], bytes]:
    """The record at an index entry, by one range read."""
    src.seek(entry["offset"])
    headers, block, _ = next(records(iter([gzip.GzipFile(fileobj=io.BytesIO(src.read(entry["length"]))).read()])))
    return headers, block


def read_archives(archives: DataFrame) -> DataFrame:
    """Per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits). Size and digest
    are those of the full payload, also for revisits: taken from the payload itself where it is there."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    schema = pa.schema([pa.field(n, t) for n, t in zip(names, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()], strict=True)])

    def rows(uri: str, index_uri: str) -> Iterator[tuple]:
        with open_file(uri) as src:
            for entry in read_index(index_uri):
                headers, block = read_record(src, entry)
                kind, cut = headers["WARC-Type"], block.index(b"\r\n\r\n") + 4
                said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response":
                    body = block[cut:]
                    size, found = len(body), digest(body)
                    if found != said:
                        raise ValueError(f"{headers['WARC-Record-ID']} in {uri} is damaged")
                else:
                    http = dict(x.split(b": ", 1) for x in block[:cut].split(b"\r\n")[1:] if x)
                    body, size, found = None, int(http[b"Content-Length"]), said
                yield _page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), size, found, kind, _page(headers.get("WARC-Refers-To")), body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, index_uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                size = 0
                for row in rows(uri, index_uri):
                    held.append(row)
                    size += row[2]
                    if size > 4 * PIECE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    listed = archives.select("uri", "index_uri").repartition(_tasks(archives))
    return listed.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame, *, least_bytes: int = 0, **columns: str) -> DataFrame:
    """Writes monolithic archives of pages and normalises them, repeated payloads as revisits; returns the
    committed table of archives."""
    written = write_monolithic(pages, **columns)
    return normalise(written.select("uri").distinct().join(revisits(written, least_bytes=least_bytes), "uri", "left"))
