"""Media columns: MPEG transport streams (operator 7).

A payload is stored as one elementary stream of private data: program tables (PAT, PMT) first, then one elementary
packet (PES) with a timestamp for each access unit, in 188-byte transport packets with continuity counters. The reader
parses the tables, checks their CRC and the counters, reassembles the elementary packets and returns their timestamps
and random-access points. Formats as published in ITU-T H.222.0 | ISO/IEC 13818-1.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes, text_chunks

# Fixed values of the format.
PACKET = 188
SYNC = 0x47
PAT_PID = 0
PRIVATE_DATA_TYPE = 0x06
PRIVATE_STREAM = 0xBD
CLOCK = 90_000

PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x100, 1
#: Payload bytes of a unit that texts are padded to, and of an access unit; every KEY_EVERY-th one is a random-access point.
UNIT = 576
ACCESS_UNIT = 16 * UNIT
KEY_EVERY = 4
#: Clock ticks between access units: 25 a second.
TICKS = CLOCK // 25


class BadStream(ValueError):
    """The bytes are no sound transport stream."""


def _crc_table() -> list[int]:
    rows = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        rows.append(crc)
    return rows


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ byte]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    """A program table's section in a packet's payload, its CRC last."""
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return b"\0" + head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10])
    return (head + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(
    PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
) + _table_packet(
    PMT_PID,
    _section(
        2,
        PROGRAM,
        (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_DATA_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0",
    ),
)


def _timestamp(ticks: int) -> bytes:
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 255, 0x01 | ticks >> 14 & 0xFE, ticks >> 7 & 255, 0x01 | ticks << 1 & 0xFE])


def _clock(ticks: int) -> bytes:
    return (ticks << 15 | 0x3F << 9).to_bytes(6, "big")


def mux(payload: bytes | np.ndarray) -> bytes:
    """The transport stream that holds a payload."""
    out, counter = [_TABLES], 0
    data = payload.tobytes() if isinstance(payload, np.ndarray) else payload
    for n, at in enumerate(range(0, len(data), ACCESS_UNIT)):
        unit = data[at : at + ACCESS_UNIT]
        ticks = n * TICKS % (1 << 33)
        size = len(unit) + 8
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + size.to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(ticks) + unit
        adapt = bytes([0x10 | (0x40 if n % KEY_EVERY == 0 else 0)]) + _clock(ticks)
        room = PACKET - 4 - 1 - len(adapt)
        packets = 1 + max(0, -(-(len(pes) - room) // (PACKET - 4)))
        spare = room + (packets - 1) * (PACKET - 4) - len(pes)
        block = np.full((packets, PACKET), 0xFF, np.uint8)
        block[:, 0] = SYNC
        block[:, 1] = DATA_PID >> 8
        block[0, 1] |= 0x40
        block[:, 2] = DATA_PID & 255
        block[:, 3] = 0x10 | (np.arange(counter, counter + packets) & 15)
        counter += packets
        # the first packet's adaptation field holds the clock; the last one's makes up for what is missing
        field = 1 + len(adapt) + (spare if packets == 1 else 0)
        block[0, 3] |= 0x20
        block[0, 4 : 4 + 1 + len(adapt)] = np.frombuffer(bytes([field - 1]) + adapt, np.uint8)
        flat = np.frombuffer(pes, np.uint8)
        first = PACKET - 4 - field
        block[0, 4 + field :] = flat[:first]
        if packets > 1:
            last = len(flat) - first - (packets - 2) * (PACKET - 4)
            block[1:-1, 4:] = flat[first : len(flat) - last].reshape(packets - 2, PACKET - 4)
            block[-1, PACKET - last :] = flat[len(flat) - last :]
            if spare:
                block[-1, 3] |= 0x20
                block[-1, 4] = spare - 1
                if spare > 1:
                    block[-1, 5] = 0
        out.append(block.tobytes())
    return b"".join(out)


@dataclass
class Program:
    """What a stream holds: the payload, the timestamp of each access unit, and (timestamp, byte) of random access."""

    payload: bytes
    timestamps: list[int]
    random_access: list[tuple[int, int]]
    packets: int


def _read_section(payload: bytes, table_id: int) -> bytes:
    at = 1 + payload[0]
    length = 3 + ((payload[at + 1] & 15) << 8 | payload[at + 2])
    section = payload[at : at + length]
    if len(section) != length or section[0] != table_id or crc32_mpeg(section):
        raise BadStream(f"no sound table {table_id}")
    return section[8:-4]


_KNOWN_TABLES: dict[bytes, int] = {}


def _data_pid(pat: bytes, pmt_of: dict[int, bytes]) -> int:
    body = _read_section(pat, 0)
    for at in range(0, len(body), 4):
        program, pid = int.from_bytes(body[at : at + 2], "big"), int.from_bytes(body[at + 2 : at + 4], "big") & 0x1FFF
        if program and pid in pmt_of:
            streams = _read_section(pmt_of[pid], 2)
            at = 4 + (int.from_bytes(streams[2:4], "big") & 0xFFF)
            while at < len(streams):
                if streams[at] == PRIVATE_DATA_TYPE:
                    return int.from_bytes(streams[at + 1 : at + 3], "big") & 0x1FFF
                at += 5 + (int.from_bytes(streams[at + 3 : at + 5], "big") & 0xFFF)
    raise BadStream("no program with a data stream")


def demux(stream: bytes) -> Program:
    """Reads a transport stream back. Raises BadStream where tables, counters or packets aren't sound."""
    if len(stream) % PACKET:
        raise BadStream("not a whole number of packets")
    block = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (block[:, 0] != SYNC).any():
        raise BadStream("lost synchronisation")
    pids = (block[:, 1] & 0x1F).astype(np.int64) << 8 | block[:, 2]
    starts = block[:, 1] & 0x40 > 0
    control = block[:, 3] >> 4 & 3
    begin = np.where(control & 2, 5 + block[:, 4].astype(np.int64), 4)
    if (begin > PACKET).any():
        raise BadStream("an adaptation field is longer than its packet")
    tables = np.flatnonzero(starts & (pids == PAT_PID))
    if not len(tables):
        raise BadStream("no program association table")
    pat = block[tables[0], begin[tables[0]] :].tobytes()
    others = {int(pids[k]): block[k, begin[k] :].tobytes() for k in np.flatnonzero(starts)[:16][::-1] if pids[k] != PAT_PID}
    heads = pat + b"".join(others[p] for p in sorted(others) if others[p][:3] != b"\0\0\1")
    if (pid := _KNOWN_TABLES.get(heads)) is None:
        pid = _data_pid(pat, others)
        if len(_KNOWN_TABLES) < 64:
            _KNOWN_TABLES[heads] = pid
    mine = np.flatnonzero((pids == pid) & (control & 1 > 0))
    counters = block[mine, 3] & 15
    if ((counters[1:] - counters[:-1] & 15) != 1).any():
        raise BadStream("a packet is missing: continuity counters don't follow each other")
    if not len(mine):
        return Program(b"", [], [], len(block))
    if not starts[mine[0]]:
        raise BadStream("the first elementary packet has no beginning")
    rows, from_ = block[mine], begin[mine]
    data = rows[np.arange(PACKET) >= from_[:, None]]
    at = np.append(0, np.cumsum(PACKET - from_))
    heads_at = np.flatnonzero(starts[mine])
    payload, timestamps, points, done = [], [], [], 0
    for a, b in zip(heads_at.tolist(), [*heads_at[1:].tolist(), len(mine)], strict=True):
        pes = data[at[a] : at[b]].tobytes()
        if pes[:3] != b"\0\0\1" or pes[3] != PRIVATE_STREAM or int.from_bytes(pes[4:6], "big") + 6 != len(pes):
            raise BadStream("an elementary packet isn't whole")
        p = pes[9:14]
        ticks = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1
        timestamps.append(ticks)
        if control[mine[a]] & 2 and rows[a, 4] and rows[a, 5] & 0x40:
            points.append((ticks, done))
        unit = pes[9 + pes[8] :]
        payload.append(unit)
        done += len(unit)
    return Program(b"".join(payload), timestamps, points, len(block))


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """The bytes and then bytes 255 up to a positive multiple of ``unit``."""
    return data.ljust(max(1, -(-len(data) // unit)) * unit, b"\xff")


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary, timestamps array<long>, random_access array<struct<ticks: long, at: long>>"
DIGEST_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        for begin, end in text_chunks(batch):
            part = batch.slice(begin, end - begin)
            data, at = text_bytes(part.column("text"))
            whole, at = data.tobytes(), at.tolist()
            yield part.column("doc_id").to_pylist(), [whole[a:b] for a, b in zip(at, at[1:], strict=False)]


def media_columns(docs: DataFrame) -> DataFrame:
    """MEDIA_SCHEMA: the transport stream of each text of ``docs`` (doc_id, text), with its timestamps and access points.

    A null or empty text is one unit of bytes 255. Repeated rows give repeated rows; other columns are left out; an
    empty table gives no rows. ``payload_of`` gives the payload of a stream back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _streams(batches):
            media = [mux(padded(t)) for t in texts]
            read = [demux(m) for m in media]
            access = pa.array([[{"ticks": t, "at": a} for t, a in p.random_access] for p in read], pa.list_(pa.struct([("ticks", pa.int64()), ("at", pa.int64())])))
            columns = [pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())]
            columns += [pa.array([p.timestamps for p in read], pa.list_(pa.int64())), access]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media", "timestamps", "random_access"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MEDIA_SCHEMA)


def payload_of(stream: bytes) -> bytes:
    return demux(stream).payload


def feature(program: Program) -> str:
    """Packets, access units, random-access points as ticks@byte, and the payload's mean byte and entropy."""
    counts = np.bincount(np.frombuffer(program.payload, np.uint8), minlength=256)
    share = counts[counts > 0] / max(1, counts.sum())
    points = ",".join(f"{t}@{a}" for t, a in program.random_access)
    mean = float(counts @ np.arange(256)) / max(1, int(counts.sum()))
    return f"packets={program.packets};units={len(program.timestamps)};last={program.timestamps[-1]};access={points};mean={mean:.4f};entropy={-(share * np.log2(share)).sum():.4f}"


def stream_digest(media: DataFrame) -> DataFrame:
    """DIGEST_SCHEMA of the rows of ``media_columns``, everything read back from the stored streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            stored = batch.column("media").to_pylist()
            for doc_id, n, stream in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), stored, strict=True):
                program = demux(stream)
                payload = program.payload
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), feature(program)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return media.mapInArrow(run, DIGEST_SCHEMA)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_digest(media_columns(table(spark, sf_dir, "documents")))
