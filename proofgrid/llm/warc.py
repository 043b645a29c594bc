"""WARC archives: writing pages with revisit records, and reading archives back in splits.

Each record is a gzip member of its own. A reader task scans its byte range for the gzip magic, takes a place for a record
only if its header decodes to a WARC header and the member ends where another begins or the file ends, and owns
the records that start inside its range, reading past the end for the last one. Files are written under names that no
other attempt uses, and only those that a finished task reported are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.session import cut_lineage, shared_folder

FILE_BYTES = 64 << 20
SPLIT_BYTES = 8 << 20
LEVEL = 6
MAGIC = b"\x1f\x8b\x08"
BLOCK = 16 << 10
AHEAD = 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def _page(name: str | None) -> int | None:
    tail = (name or "").strip("<>").rpartition(":")[2]
    return int(tail) if re.fullmatch(r"-?\d+", tail) else None


def record(page: int | None, url: str | None, payload: bytes, digest: str, owner: int | None) -> bytes:
    """One record: a response, or a revisit of `owner`'s where that is another page."""
    revisit = owner is not None and owner != page
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {_name(owner)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parsed(data: bytes, payloads: bool = True) -> dict:
    """A record's columns. A revisit has its payload's size and digest from its headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    if kind == "revisit":
        size, digest, payload = int(_fields(http.decode("latin-1").split("\r\n")[1:])["content-length"]), fields["warc-payload-digest"].partition(":")[2], None
    else:
        size, digest = len(payload), base32_sha1(payload)
    return {
        "page_id": _page(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload": payload if payloads else None,
    }


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record per row and return the files: path, bytes, records.

    Of rows with equal payloads of at least `least_bytes`, the one with the largest id is the response and others revisit
    it. A null payload is empty, a null id is smaller than any other (and is a response if there's no other), a null url is
    left out. Repeated rows give repeated records. Ids of one value are one page. An empty table writes no file.
    """
    clean = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).cast("string").alias("url"), clean.alias("payload"), F.sha1(clean).alias("digest"))
    # Only groups are looked up; written first, so that the pages of a very large group are split between tasks.
    shared = rows.select("page", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= least_bytes)
    owners = cut_lineage(shared.groupBy("digest").agg(F.max("page").alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner"))
    folder = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"

    def write(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        out, files, size, count, path = None, [], 0, 0, ""
        for batch in source:
            columns = [batch.column(c) for c in ("page", "url", "payload", "digest", "owner")]
            for page, link, data, digest, owner in zip(*columns, strict=True):
                if out is None:
                    name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(files)}-{uuid.uuid4().hex}.warc.gz"
                    store.create_dir(root, recursive=True)
                    out, size, count, path = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0, f"{folder}/{name}"
                body = data.as_py()
                code = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                member = gzip.compress(record(page.as_py(), link.as_py(), body, code, owner.as_py()), LEVEL, mtime=0)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    files.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            files.append((path, size, count))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "bytes", "records"), f, strict=True)) for f in files], SCHEMA)

    return cut_lineage(rows.join(owners, "digest", "left").mapInArrow(write, "path string, bytes long, records long"))


SCHEMA = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
COLUMNS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def members(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records of a file that start in [start, end)."""
    buffer = file.read_at(min(size, end + AHEAD) - start, start)
    at = 0
    while True:
        at = buffer.find(MAGIC, at)
        if at < 0 or start + at >= end:
            return
        decoder, i, out, good = zlib.decompressobj(31), at, [], True
        while good and not decoder.eof:
            block = buffer[i : i + BLOCK]
            if not block:
                more = file.read_at(min(len(buffer), size - start - len(buffer)), start + len(buffer)) if start + len(buffer) < size else b""
                if not more:
                    good = False
                buffer += more
                continue
            try:
                out.append(decoder.decompress(block))
            except zlib.error:
                good = False
            i += len(block)
            if len(out) == 1 and len(out[0]) >= 7 and not out[0].startswith(b"WARC/1."):
                good = False
        after = i - len(decoder.unused_data)
        if good and start + after < size:
            if len(buffer) < after + 3:
                buffer += file.read_at(min(AHEAD, size - start - len(buffer)), start + len(buffer))
            good = buffer[after : after + 3] == MAGIC
        data = b"".join(out)
        if good and data.startswith(b"WARC/1."):
            yield data
            at = after
        else:
            at += 1


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of archives (path, bytes): page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Payload is null for revisits, and for all records unless `payloads`. Archives are cut into ranges of `split_bytes`, dealt
    out evenly; a lost task reads its range again.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    splits = files.where("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    parts = max(files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0, 1)

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(path) as file:
                    found, held = [], 0
                    for data in members(file, row["bytes"], row["start"], min(row["start"] + split_bytes, row["bytes"])):
                        found.append(parsed(data, payloads))
                        held += len(data)
                        if len(found) >= 4096 or held >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(found, COLUMNS)
                            found, held = [], 0
                    if found:
                        yield pa.RecordBatch.from_pylist(found, COLUMNS)

    return splits.repartition(int(min(parts, 100_000)), "path", "start").mapInArrow(read, RECORD)


def archive_folder(spark) -> str:
    """Where archives go unless a folder is given: beside the checkpoints, which all executors see."""
    return f"{shared_folder(spark).rstrip('/')}/proofgrid/warc"
