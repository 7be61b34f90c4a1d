"""Media columns: MPEG transport streams (ISO/IEC 13818-1) written and parsed in Arrow batches.

A payload is cut into access units of ``UNIT`` bytes.  Each becomes one elementary packet
with a presentation time stamp, spread over 188-byte transport packets.  Every
``RAP_EVERY``-th unit is a random-access point: the program association and map tables
stand before it, and its first packet has the indicator and a clock reference.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches

PACKET, UNIT, RAP_EVERY, TICKS = 188, 6144, 8, 3600
PAT_PID, PMT_PID, STREAM_PID, PROGRAM = 0, 0x1000, 0x100, 1
#: Stream type and id of private data in elementary packets.
PRIVATE_TYPE, PRIVATE_ID = 0x06, 0xBD
PES_HEADER = 14


@lru_cache(64)
def crc32_mpeg(section: bytes) -> int:
    """The CRC of program tables; 0 over a section that ends in its own."""
    crc = 0xFFFFFFFF
    for byte in section:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _table(pid: int, table_id: int, number: int, body: bytes) -> np.ndarray:
    """A packet, of continuity counter 0, with one section."""
    head = bytes([table_id, 0xB0, len(body) + 9]) + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    section = head + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    packet = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(packet.ljust(PACKET, b"\xff"), np.uint8)


@cache
def _tables() -> np.ndarray:
    pat = _table(PAT_PID, 0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    streams = bytes([PRIVATE_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _table(PMT_PID, 2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + streams)
    return np.concatenate([pat, pmt])


@cache
def _layout(size: int, random_access: bool) -> tuple[np.ndarray, np.ndarray]:
    """The packets of an access unit without data, times and counters, and where its data go."""
    pes, out, places, first = PES_HEADER + size, [], [], True
    rest = pes
    while rest:
        field = b""
        if first and random_access:
            field = bytes([7, 0x50]) + bytes(6)
        room = PACKET - 4 - len(field)
        if rest < room:  # stuffing
            spare = room - rest
            if field:
                field = bytes([7 + spare, 0x50]) + bytes(6) + b"\xff" * spare
            else:
                field = bytes([spare - 1]) + (b"\x00" + b"\xff" * (spare - 2) if spare > 1 else b"")
            room = rest
        flags = (0x40 if first else 0) | STREAM_PID >> 8
        packet = bytes([0x47, flags, STREAM_PID & 255, 0x30 if field else 0x10]) + field
        places.append(np.arange(len(packet), PACKET) + PACKET * len(out))
        out.append(packet.ljust(PACKET, b"\x00"))
        rest, first = rest - room, False
    packets, place = np.frombuffer(b"".join(out), np.uint8).copy(), np.concatenate(places)
    length = PES_HEADER - 6 + size
    head = b"\x00\x00\x01" + bytes([PRIVATE_ID]) + length.to_bytes(2, "big") + bytes([0x80, 0x80, 5]) + bytes(5)
    packets[place[:PES_HEADER]] = np.frombuffer(head, np.uint8)
    return packets, place


def _stamp(pts: int) -> bytes:
    pts &= (1 << 33) - 1
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 0xFE | 1, pts >> 7 & 255, pts << 1 & 0xFE | 1])


def write_stream(payload: bytes) -> bytes:
    """The transport stream of a payload; its units' times are multiples of ``TICKS``."""
    data, parts, tables, counter = np.frombuffer(payload, np.uint8), [], 0, 0
    for k, at in enumerate(range(0, len(data), UNIT)):
        unit, access = data[at : at + UNIT], k % RAP_EVERY == 0
        if access:
            two = _tables().copy()
            two[[3, PACKET + 3]] |= tables & 15
            tables += 1
            parts.append(two)
        packets, place = _layout(len(unit), access)
        packets = packets.copy()
        packets[place[PES_HEADER:]] = unit
        packets[place[PES_HEADER - 5 : PES_HEADER]] = np.frombuffer(_stamp(k * TICKS), np.uint8)
        if access:
            clock = (k * TICKS & (1 << 33) - 1) << 15 | 0x7E00  # 33 bits of base, 6 reserved, 9 of extension
            packets[6:12] = np.frombuffer(clock.to_bytes(6, "big"), np.uint8)
        n = len(packets) // PACKET
        packets[3::PACKET] |= (np.arange(counter, counter + n) & 15).astype(np.uint8)
        counter += n
        parts.append(packets)
    return np.concatenate(parts).tobytes() if parts else b""


def parse_stream(stream: bytes) -> dict:
    """Program map, continuity errors, and the first elementary stream: payload, times and random-access times.

    Bytes after the last whole packet are not looked at.  Packets without the sync byte are
    counted in ``bad_sync`` and skipped; a stream without valid tables has no elementary
    stream and an empty payload.
    """
    packets = np.frombuffer(stream, np.uint8)[: len(stream) // PACKET * PACKET].reshape(-1, PACKET)
    good = packets[:, 0] == 0x47
    bad_sync, packets = int((~good).sum()), packets[good]
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    unit_start, field, has_data = packets[:, 1] & 0x40 != 0, packets[:, 3] & 0x20 != 0, packets[:, 3] & 0x10 != 0
    start = 4 + np.where(field, packets[:, 4].astype(np.int32) + 1, 0)

    def sections(of: int) -> Iterator[bytes]:
        for i in np.flatnonzero((pid == of) & unit_start & has_data & (start < PACKET - 4)).tolist():
            body = packets[i].tobytes()[start[i] :]
            body = body[1 + body[0] :]
            body = body[: 3 + ((body[1] & 15) << 8 | body[2])] if len(body) > 2 else b""
            if len(body) > 12 and crc32_mpeg(body) == 0:
                yield body

    programs, streams = {}, {}
    for s in sections(PAT_PID):
        programs |= {int.from_bytes(s[i : i + 2], "big"): int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(s) - 4, 4)}
    for map_pid in {p for n, p in programs.items() if n}:
        for s in sections(map_pid):
            i = 12 + ((s[10] & 15) << 8 | s[11])
            while i + 5 <= len(s) - 4:
                streams[int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = s[i]
                i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])

    errors = 0
    for p in np.unique(pid[has_data]).tolist():
        counters = packets[(pid == p) & has_data, 3] & 15
        errors += int(((counters[1:] - counters[:-1]) & 15 != 1).sum())

    found = {"programs": programs, "streams": streams, "continuity_errors": errors, "bad_sync": bad_sync, "packets": len(packets), "times": [], "random_access": [], "payload": b""}
    if streams:
        own = (pid == min(streams)) & has_data & (start < PACKET)
        rows, start, heads = packets[own], start[own].copy(), unit_start[own]
        access = (field[own] & (rows[:, 4] > 0) & (rows[:, 5] & 0x40 != 0))[heads]
        at = start[heads]
        head = rows[heads][np.arange(len(at))[:, None], np.minimum(at[:, None] + np.arange(PES_HEADER), PACKET - 1)].astype(np.int64)
        stamped = head[:, 7] & 0x80 != 0
        times = (head[:, 9] & 0x0E) << 29 | head[:, 10] << 22 | (head[:, 11] & 0xFE) << 14 | head[:, 12] << 7 | head[:, 13] >> 1
        start[heads] += 9 + head[:, 8].astype(np.int32)
        started = np.cumsum(heads) > 0
        found |= {"times": times[stamped].tolist(), "random_access": times[stamped & access].tolist(), "payload": rows[started][np.arange(PACKET) >= start[started][:, None]].tobytes()}
    return found


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, size, out, held = [], [], [], 0
        for key, value in zip(batch.column(0), batch.column(1)):
            payload = value.as_buffer().to_pybytes()
            out.append(write_stream(payload + b" " * (max(192, -(-len(payload) // 192) * 192) - len(payload))))
            ids.append(key.as_py())
            size.append(len(payload))
            held += len(out[-1])
            if held > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(out, pa.binary())], ["id", "n_bytes", "media"])
                ids, size, out, held = [], [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(out, pa.binary())], ["id", "n_bytes", "media"])


def text_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as a transport stream.

    The payload is the text's UTF-8 bytes (null: none) and spaces up to a positive multiple
    of 192.  Null ids, repeated rows and empty tables pass through; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(_written, "id long, n_bytes long, media binary")


PARSED = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<long>, random_access array<long>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PARSED.split(", ")]
    for batch in batches:
        rows = []
        for media in batch.column(2):
            stream = media.as_buffer().to_pybytes() if media.is_valid else b""
            got = parse_stream(stream)
            payload, times = got["payload"], got["times"]
            kinds = ",".join(f"{p}:{t}" for p, t in sorted(got["streams"].items()))
            span = f"{times[0]}-{times[-1]}" if times else ""
            feature = f"streams={kinds};packets={got['packets']};bad_sync={got['bad_sync']};continuity_errors={got['continuity_errors']};units={len(times)};pts={span};random_access={len(got['random_access'])}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, times, got["random_access"]))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)


def media_features(media: DataFrame) -> DataFrame:
    """Parses (id, n_bytes, media) back; see ``PARSED``.

    ``times`` are the units' presentation times and ``random_access`` those at which
    decoding can start.  Null media counts as an empty stream, whose payload is empty.
    """
    return media.select("id", "n_bytes", "media").mapInArrow(_parsed, PARSED)
