"""WARC archives: an index is written first, records are read back by coalesced byte ranges.

``write`` stores one record per page, each its own gzip member, in files of about ``file_bytes`` in a shared folder; its index
has file, offset, length, url and digest of every record. Of pages with equal payloads of at least ``least`` bytes the one with
the largest page_id is a response record and the others revisit it. ``read`` sorts the selected index rows by file and offset,
joins ranges with small gaps between them and reads each such block at once.

The choice of response is made on digests alone, so a payload that a third of all pages share is counted before it is
shuffled and its pages are dealt over several tasks; payloads are shuffled by page. Null html is an empty payload, a null url leaves out the target header, null page
ids are responses. Rows repeated whole have the same page_id: each becomes a record, and all those of the largest id are
responses. Files of lost or repeated tasks are not in the index and so are never read. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_apart, materialize, new_path

DATE = "1970-01-01T00:00:00Z"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a path or URI that driver and executors share."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """One WARC record; a revisit carries the HTTP header of its response but not the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    if refers_to is None:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields; the payload of a revisit is None, its length that of the full payload. Damage raises ValueError."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"payload differs from digest {digest}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("WARC-Page-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To-Page-ID"), "payload": payload if kind == "response" else None}


INDEX = "file string, offset long, length long, url string, page_id long, payload_digest string, record_type string, refers_to long"


def _write(folder: str, file_bytes: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, where, rows = None, "", []
        store, top = filesystem(folder)

        def flush():
            got = pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
            rows.clear()
            return pa.RecordBatch.from_pandas(got, schema=pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in INDEX.split(", ")]), preserve_index=False)

        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = html or b""
                digest = base32(hashlib.sha1(payload).digest())
                if out is None:
                    where = f"{uuid.uuid4().hex}.warc.gz"
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{top}/{where}", compression=None)
                pack = zlib.compressobj(level, wbits=31)
                data = pack.compress(record(page_id, url, payload, digest, refers, date)) + pack.flush()
                rows.append((f"{folder}/{where}", out.tell(), len(data), url, page_id, digest, "response" if refers is None else "revisit", refers))
                out.write(data)
                if out.tell() >= file_bytes:  # a file is whole before its index rows leave
                    out.close()
                    out = None
                    yield flush()
        if out is not None:
            out.close()
            yield flush()

    return run


def write(pages: DataFrame, folder: str | None = None, least: int = 0, file_bytes: int = 64_000_000, level: int = 3, date: str = DATE) -> DataFrame:
    """Write the archives and return their index, which is a table in the shared folder."""
    folder = folder or new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html"))
    ids = rows.where(F.length("html") >= least).select("page_id", "sha1")
    kept = materialize(ids.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1"), "warc-equal")
    revisits = joined_apart(ids, kept.drop("n"), "sha1", kept.select("sha1", "n")).where("page_id <> refers_to").select("page_id", "sha1", "refers_to").distinct()
    return materialize(rows.join(revisits, ["page_id", "sha1"], "left").select("page_id", "url", "html", "refers_to").mapInArrow(_write(folder, file_bytes, level, date), INDEX), "warc-index")


def _read(gap: int, block_bytes: int, payloads: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, name = None, None

        def load(name, ranges):
            nonlocal opened
            if opened is None or opened[0] != name:
                if opened:
                    opened[1].close()
                store, path = filesystem(name)
                opened = (name, store.open_input_file(path))
            start = ranges[0][0]
            data = opened[1].read_at(ranges[-1][0] + ranges[-1][1] - start, start)
            return [parse(zlib.decompress(data[o - start : o - start + n], wbits=31)) | {"url": u} for o, n, u in ranges]

        held, size = [], 0
        for f in frames:
            got = []
            for file, offset, n, url in zip(f["file"], f["offset"], f["length"], f["url"], strict=True):
                if held and (file != name or offset - (held[-1][0] + held[-1][1]) > gap or offset + n - held[0][0] > block_bytes):
                    got += load(name, held)
                    held = []
                name = file
                held.append((offset, n, url))
            if got:
                yield frame(got, payloads)
        if held:
            yield frame(load(name, held), payloads)
        if opened:
            opened[1].close()

    return run


def frame(records: list[dict], payloads: bool) -> pd.DataFrame:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    return pd.DataFrame([[r[c] for c in names] for r in records], columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def read(index: DataFrame, gap: int = 64_000, block_bytes: int = 8_000_000, payloads: bool = True) -> DataFrame:
    """The records of the index rows given (all, or a selection of them), each checked against its digest."""
    part = (F.col("offset") / F.lit(4 * block_bytes)).cast("long")
    rows = index.select("file", "offset", "length", "url").repartition("file", part).sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return rows.mapInPandas(_read(gap, block_bytes, payloads), schema + ", payload binary" * payloads)
