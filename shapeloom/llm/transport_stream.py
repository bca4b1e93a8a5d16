"""A media column of MPEG transport streams.

``mux`` stores bytes as access units in PES packets with presentation times, cut into 188-byte transport packets, with program
tables and a clock reference before each random-access unit. ``demux`` parses association and map tables (their CRC-32/MPEG-2
is checked), follows the map to the stream, checks continuity counters and reassembles the packets; a lost or doubled packet, a
wrong table or a short unit is an error.

Defined results: a null text is the empty text, stored as one block of spaces; null and repeated ids come out row by row;
equal texts give equal bytes; very long texts are one long stream; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, materialise, table, whole_text

PACKET = 188
MAP_PID, STREAM_PID, NULL_PID = 0x1000, 0x0100, 0x1FFF
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
#: Bytes of an access unit, units from one random-access point to the next, and 90 kHz ticks a unit.
UNIT_BYTES, RANDOM_EVERY, TICKS = 3072, 8, 3600
BLOCK = 192


def crc_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


@lru_cache(8)
def _tables(program: int = 1) -> tuple[bytes, bytes]:
    association = _section(0x00, 1, struct.pack(">HH", program, 0xE000 | MAP_PID))
    body = struct.pack(">HH", 0xE000 | STREAM_PID, 0xF000) + struct.pack(">BHH", PRIVATE_TYPE, 0xE000 | STREAM_PID, 0xF000)
    return association, _section(0x02, program, body)


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (struct.pack(">BHBB", 0x47, 0x4000 | pid, 0x10 | counter, 0) + section).ljust(PACKET, b"\xff")


def _time(prefix: int, ticks: int) -> bytes:
    return struct.pack(">BHH", prefix << 4 | (ticks >> 29 & 0x0E) | 1, (ticks >> 14 & 0xFFFE) | 1, (ticks << 1 & 0xFFFE) | 1)


def mux(payload: bytes) -> bytes:
    association, program = _tables()
    out, tables, counter = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        unit, ticks, jump = payload[at : at + UNIT_BYTES], k * TICKS & (2**33 - 1), k % RANDOM_EVERY == 0
        if jump:
            out.append(_table_packet(0, association, tables & 15))
            out.append(_table_packet(MAP_PID, program, tables & 15))
            tables += 1
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(unit) + 8, 0x84, 0x80, 5) + _time(2, ticks) + unit
        field = struct.pack(">BIH", 0x50, ticks >> 1, (ticks & 1) << 15 | 0x7E00) if jump else b""
        done, first = 0, True
        while done < len(pes):
            room = 183 - len(field) if field else 184
            part = pes[done : done + room]
            done += len(part)
            if len(part) < room:  # an adaptation field fills the packet
                lack = room - len(part)
                field = field + b"\xff" * lack if field else (b"" if lack == 1 else b"\0" + b"\xff" * (lack - 2))
                control, extra = 0x30, bytes([len(field)]) + field
            elif field:
                control, extra = 0x30, bytes([len(field)]) + field
            else:
                control, extra = 0x10, b""
            out.append(struct.pack(">BHB", 0x47, (0x4000 if first else 0) | STREAM_PID, control | counter & 15) + extra + part)
            counter, first, field = counter + 1, False, b""
    return b"".join(out)


class Unit(NamedTuple):
    data: bytes
    ticks: int
    random_access: bool
    packet: int


class Demuxed(NamedTuple):
    units: list[Unit]
    packets: int
    pid: int
    stream_type: int


@lru_cache(64)
def _read_section(data: bytes) -> tuple[int, bytes]:
    table_id, length = data[0], struct.unpack(">H", data[1:3])[0] & 0x0FFF
    section = data[: 3 + length]
    if len(section) != 3 + length or crc_mpeg(section) != 0:
        raise ValueError("a program table is damaged")
    return table_id, section[8:-4]


def demux(stream: bytes) -> Demuxed:
    if len(stream) % PACKET:
        raise ValueError("the stream ends within a packet")
    map_pid = pid = kind = -1
    counters: dict[int, int] = {}
    parts: list[bytes] = []
    units: list[Unit] = []
    jump, first = False, 0

    def close() -> None:
        if not parts:
            return
        pes = b"".join(parts)
        prefix, length, _, flags, extra = struct.unpack(">IHBBB", pes[:9])
        if prefix >> 8 != 1 or length != len(pes) - 6 or not flags & 0x80:
            raise ValueError("a unit is incomplete")
        a, b, c = struct.unpack(">BHH", pes[9:14])
        units.append(Unit(pes[9 + extra :], (a & 0x0E) << 29 | (b & 0xFFFE) << 14 | c >> 1, jump, first))
        parts.clear()

    for at in range(0, len(stream), PACKET):
        sync, head, control = stream[at], stream[at + 1] << 8 | stream[at + 2], stream[at + 3]
        this = head & 0x1FFF
        if sync != 0x47 or head & 0x8000:
            raise ValueError("lost synchronisation")
        if this == NULL_PID:
            continue
        begin, random_access = at + 4, False
        if control & 0x20:
            length = stream[begin]
            random_access = length > 0 and bool(stream[begin + 1] & 0x40)
            begin += 1 + length
        if control & 0x10:
            if this in counters and control & 15 != (counters[this] + 1) & 15:
                raise ValueError(f"packets are missing on stream {this}")
            counters[this] = control & 15
        data = stream[begin : at + PACKET]
        if this == 0:
            table_id, body = _read_section(data[1 + data[0] :])
            for i in range(0, len(body), 4):
                number, where = struct.unpack(">HH", body[i : i + 4])
                if table_id == 0 and number:
                    map_pid = where & 0x1FFF
        elif this == map_pid:
            table_id, body = _read_section(data[1 + data[0] :])
            i = 4 + (struct.unpack(">H", body[2:4])[0] & 0x0FFF)
            while table_id == 2 and i < len(body):
                kind, where, info = struct.unpack(">BHH", body[i : i + 5])
                pid, i = where & 0x1FFF, i + 5 + (info & 0x0FFF)
        elif this == pid:
            if head & 0x4000:
                close()
                jump, first = random_access, at // PACKET
            parts.append(data)
    close()
    return Demuxed(units, len(stream) // PACKET, pid, kind)


def padded(text: bytes) -> bytes:
    """Spaces up to a positive multiple of 192 bytes."""
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b" ")


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): the text as a transport stream."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        return pa.record_batch(
            [batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([mux(padded(x)) for x in texts], pa.binary())],
            names=[id_col, "n_bytes", "media"],
        )

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), whole_text(text_col).alias("text"))
    return map_batches(rows, run, f"`{id_col}` long, n_bytes long, media binary")


def read_media(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per stored stream, from its bytes: digests and features of the payload, the presentation time of every access unit, and the
    random-access points as (ticks, packet), the packet that a reader may start from."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(8)]
        for media in batch.column(2).to_pylist():
            found = demux(media)
            payload = b"".join(u.data for u in found.units)
            times = [u.ticks for u in found.units]
            jumps = [{"ticks": u.ticks, "packet": u.packet} for u in found.units if u.random_access]
            feature = f"pid={found.pid};type={found.stream_type};packets={found.packets};units={len(found.units)};random={len(jumps)};last={times[-1]};mean={sum(payload) / len(payload):.4f}"
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, times, jumps)
            for column, x in zip(out, row, strict=True):
                column.append(x)
        point = pa.list_(pa.struct([("ticks", pa.int64()), ("packet", pa.int64())]))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), point]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "random_access"]
        return pa.record_batch([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=[id_col, "n_bytes", *names])

    schema = (
        f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        "timestamps array<long>, random_access array<struct<ticks: long, packet: long>>"
    )
    return map_batches(stored.select(id_col, "n_bytes", "media"), run, schema)


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(materialise(with_media(table(spark, sf_dir, "documents")), "media"))
