"""WARC archives of individually compressed records that share a Zstandard dictionary.

Each task writes archives of bounded size to the shared folder.  A dictionary is built from
records of the archive, embedded in a leading skippable frame, and every record is one
Zstandard frame after it.  Records whose payload stands elsewhere are revisits: they hold
the HTTP header and refer to the response.  Files have names of their own for each attempt
and only those a finished task has reported are read, so a repeated task does no harm.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, broadcast_if_small

#: The skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes of records in one archive, of the records its dictionary is built from, and of the dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 32 << 20, 2 << 20, 64 << 10
#: Tasks that archives are read back in, at most.
READ_TASKS = 10_000


def record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: bytes, refers_to: int | None) -> bytes:
    """One record: a response, or a revisit (whose payload is left out) if it refers to a page."""
    name = lambda page: f"<urn:page:{'' if page is None else page}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    kind = fields["WARC-Type"]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if kind == "response" and hashlib.sha1(payload).digest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't agree with its digest")
    size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest.hex(), "record_type": kind, "refers_to": page(fields.get("WARC-Refers-To")), "payload": payload}


def pack(records: list[bytes]) -> bytes:
    """An archive; without a dictionary frame if the records are too few or small to build one from."""
    sample, held = [], 0
    for r in records:
        sample.append(r[: 64 << 10])
        held += len(sample[-1])
        if held > SAMPLE_BYTES:
            break
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, held // 8)), sample, k=256, d=8)
    except zstandard.ZstdError:
        trained = None
    writer = zstandard.ZstdCompressor(level=3, write_checksum=True, **({"dict_data": trained} if trained else {}))
    frames = [writer.compress(r) for r in records]
    if trained:
        body = zstandard.ZstdCompressor(level=3).compress(trained.as_bytes())
        frames.insert(0, struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
    return b"".join(frames)


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one after the other."""
    settings = {}
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICTIONARY_MAGIC:
        (size,) = struct.unpack_from("<I", archive, 4)
        body, archive = archive[8 : 8 + size], archive[8 + size :]
        settings["dict_data"] = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body) if body[:4] == zstandard.FRAME_HEADER else body)
    reader, view, at, step = zstandard.ZstdDecompressor(**settings), memoryview(archive), 0, 64 << 10
    while at < len(view):
        frame, parts, fed = reader.decompressobj(), [], at
        while not frame.eof:
            if fed >= len(view):
                raise ValueError("the archive ends inside a frame")
            parts.append(frame.decompress(view[fed : fed + step]))
            fed += step
        at = min(fed, len(view)) - len(frame.unused_data)
        yield b"".join(parts)


def _store(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    place, folder = fs.FileSystem.from_uri(root)
    place.create_dir(folder, recursive=True)

    def write(records: list[bytes]) -> pa.RecordBatch:
        name = f"{uuid.uuid4().hex}.warc.zst"
        packed = pack(records)
        with place.open_output_stream(f"{folder}/{name}") as out:
            out.write(packed)
        return pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"]), pa.array([len(records)], pa.int64()), pa.array([len(packed)], pa.int64())], ["path", "records", "bytes"])

    held, size = [], 0
    for batch in batches:
        ids, urls, pages, sizes, digests, refers = batch.columns
        for i in range(batch.num_rows):
            page = pages[i].as_buffer().to_pybytes()
            held.append(record(ids[i].as_py(), urls[i].as_py(), page, sizes[i].as_py(), bytes.fromhex(digests[i].as_py()), refers[i].as_py()))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield write(held)
                held, size = [], 0
    if held:
        yield write(held)


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """Writes archives below ``root`` (a URI that all executors reach) as the result is computed: (path, records, bytes).

    Of records with equal payloads of at least ``least`` bytes, that with the largest id is
    a response and the others are revisits of it; smaller ones are all responses.  A null
    page counts as empty, a null URL is left out.  Records with a null id are revisits if
    another with an id has their payload.  Rows that repeat an id with its payload are
    equal records.  Other columns are ignored; an empty table gives no archive.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha1(html).alias("sha1"))
    chosen = base.where(F.col("size") >= least).groupBy("sha1").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = base.join(broadcast_if_small(chosen, row_bytes=96), "sha1", "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("response")), F.col("response"))
    return joined.select("id", "url", "html", "size", "sha1", refers.alias("refers_to")).mapInArrow(functools.partial(_store, root=root), "path string, records long, bytes long")


def _load(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else [])])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            place, name = fs.FileSystem.from_uri(path)
            with place.open_input_stream(name) as file:
                rows = [{k: v for k, v in parse_record(r).items() if payloads or k != "payload"} for r in unpack(file.read())]
            yield from pa.Table.from_pylist(rows, schema).to_batches()


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of archives (path): page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    ``payloads`` adds the payload (empty for revisits).  A payload that its digest doesn't
    fit is an error.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return archives.select("path").mapInArrow(functools.partial(_load, payloads=payloads), schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives of ``pages`` below the shared folder and reads them back."""
    tables = Tables(pages.sparkSession)
    root = tables.root if "://" in tables.root or tables.root.startswith("file:") else f"file://{tables.root}"
    written = tables.keep(write_archives(pages, f"{root}/archives"), "listing")
    return read_archives(written.repartition(min(written.count() or 1, READ_TASKS), "path"))
