"""MPEG transport streams: multiplex a payload, and take streams apart again.

:func:`demux` reads any transport stream of 188-byte packets: it finds the sync byte,
parses the program association and map tables (checked by their CRC), follows each
stream's continuity counter, puts elementary packets together over packets, and notes
every access unit's timestamp and whether decoding can start there.

:func:`mux` makes the streams that the corpus query stores: one program, one stream of
private data, a table pair and a clock reference at every random-access point.

Defined results: null or empty bytes have no packets, tables or units; bytes before a
sync byte are skipped and counted; a packet with the error flag, a scrambled one or one
of an unknown stream is counted and left out; a packet repeated once is no error; a gap
in the counters counts as one and drops the unit that it falls into; a last packet that
is cut short is skipped. Rows of repeated texts have equal streams and features; very long texts become many
units, and a task holds one stream and what it is made of at a time beside its batch; an empty table gives an empty one; other columns
than the id and the content are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.batches import bounded_batches
from lumenfold.session import stored

# Fixed values of ISO/IEC 13818-1.
PACKET = 188
SYNC = 0x47
PAT_PID = 0x0000
NULL_PID = 0x1FFF
PRIVATE_STREAM_1 = 0xBD
PRIVATE_DATA = 0x06
CLOCK = 90_000
WRAP = 1 << 33

# This module's own choices.
PMT_PID = 0x1000
DATA_PID = 0x0100
PROGRAM = 1
UNIT_BYTES = 16_320
UNIT_TICKS = CLOCK // 25
UNITS_TO_RANDOM_ACCESS = 4


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        table.append(c)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """The CRC of table sections; 0 over a section with its own CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF]) + ext.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0])
    return (head + section).ljust(PACKET, b"\xff")


_PAT = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(
    0x02,
    PROGRAM,
    (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00",
)


def _stamp(ticks: int, mark: int) -> bytes:
    """33 bits in five bytes, with marker bits."""
    return bytes([
        mark << 4 | (ticks >> 29 & 0x0E) | 1, ticks >> 22 & 0xFF, (ticks >> 14 & 0xFE) | 1, ticks >> 7 & 0xFF, (ticks << 1 & 0xFE) | 1,
    ])


def mux(payload: bytes) -> bytes:
    """``payload`` as a transport stream; :func:`demux` gives it back byte for byte."""
    out: list[bytes] = []
    counter = tables = 0
    for n, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        ticks = n * UNIT_TICKS % WRAP
        data = payload[at : at + UNIT_BYTES]
        unit = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks, 2) + data
        field_bytes = b""
        if n % UNITS_TO_RANDOM_ACCESS == 0:
            out += [_table_packet(PAT_PID, _PAT, tables), _table_packet(PMT_PID, _PMT, tables)]
            tables += 1
            # Random access and a clock reference: base, reserved bits, extension 0.
            field_bytes = b"\x50" + (ticks << 15 | 0x7E00).to_bytes(6, "big")
        start, sent = 0x40, 0
        while sent < len(unit):
            room = PACKET - 4 - (len(field_bytes) + 1 if field_bytes else 0)
            body = unit[sent : sent + room]
            spare = room - len(body)
            if spare and not field_bytes:  # a field of stuffing: its length byte, flags, then filler
                field_bytes, spare = (b"\x00", spare - 2) if spare > 1 else (b"", -1)
                adaptation = b"\x00" if spare < 0 else bytes([1 + spare]) + field_bytes + b"\xff" * spare
            else:
                adaptation = bytes([len(field_bytes) + spare]) + field_bytes + b"\xff" * spare if field_bytes else b""
            out.append(bytes([SYNC, start | DATA_PID >> 8, DATA_PID & 0xFF, (0x30 if adaptation else 0x10) | counter]) + adaptation + body)
            counter = counter + 1 & 15
            sent += len(body)
            start, field_bytes = 0, b""
    return b"".join(out)


@dataclass
class Unit:
    """One elementary packet put together: its stream, timestamps, start in the file, data."""

    pid: int
    pts: int | None
    dts: int | None
    random_access: bool
    offset: int
    data: bytes


@dataclass
class Stream:
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)
    clock: list[int] = field(default_factory=list)
    packets: int = 0
    skipped_bytes: int = 0
    left_out: int = 0
    continuity_errors: int = 0
    table_errors: int = 0

    def payload(self, pid: int | None = None) -> bytes:
        return b"".join(u.data for u in self.units if pid is None or u.pid == pid)


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _sections(out: Stream, buffer: bytearray) -> Iterator[bytes]:
    """Whole sections at the buffer's front; what is left stays."""
    while len(buffer) >= 3 and buffer[0] != 0xFF:
        size = 3 + ((buffer[1] & 0x0F) << 8 | buffer[2])
        if len(buffer) < size:
            return
        section = bytes(buffer[:size])
        del buffer[:size]
        if size < 12 or crc32_mpeg(section):
            out.table_errors += 1
        elif section[5] & 1:  # in force now
            yield section
    if buffer[:1] == b"\xff":
        buffer.clear()


def _unit(pid: int, raw: bytes, random_access: bool, offset: int) -> Unit | None:
    if len(raw) < 6 or raw[:3] != b"\x00\x00\x01":
        return None
    length = int.from_bytes(raw[4:6], "big")
    if length and len(raw) < 6 + length:
        return None
    end = 6 + length if length else len(raw)
    # These stream ids have no optional header.
    if raw[3] in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF):
        return Unit(pid, None, None, random_access, offset, raw[6:end])
    if len(raw) < 9:
        return None
    flags, start = raw[7] >> 6, 9 + raw[8]
    pts = _ticks(raw[9:14]) if flags & 2 and start >= 14 <= len(raw) else None
    dts = _ticks(raw[14:19]) if flags == 3 and start >= 19 <= len(raw) else pts
    return Unit(pid, pts, dts, random_access, offset, raw[start:end])


def demux(ts: bytes | None) -> Stream:
    """Tables, units, clock references and faults of a transport stream."""
    out = Stream()
    ts = ts or b""
    at, size = 0, len(ts)
    last: dict[int, int] = {}
    repeated: dict[int, bool] = {}
    tables: dict[int, bytearray] = {}
    open_units: dict[int, tuple[list[bytes], bool, int]] = {}

    def close(pid: int) -> None:
        parts, random_access, offset = open_units.pop(pid)
        if unit := _unit(pid, b"".join(parts), random_access, offset):
            out.units.append(unit)
        else:
            out.left_out += 1

    while at + PACKET <= size:
        if ts[at] != SYNC or at + PACKET < size and ts[at + PACKET] != SYNC:
            nxt = ts.find(b"\x47", at + 1)
            step = (nxt if nxt >= 0 else size) - at
            out.skipped_bytes += step
            at += step
            continue
        b1, pid = ts[at + 1], (ts[at + 1] & 0x1F) << 8 | ts[at + 2]
        b3, begin, offset = ts[at + 3], at + 4, at
        at += PACKET
        out.packets += 1
        if b1 & 0x80 or b3 & 0xC0 or pid == NULL_PID:
            out.left_out += 1
            continue
        random_access = jump = False
        if b3 & 0x20:
            length = ts[begin]
            if length:
                flags = ts[begin + 1]
                jump, random_access = bool(flags & 0x80), bool(flags & 0x40)
                if flags & 0x10 and length >= 7:
                    clock = int.from_bytes(ts[begin + 2 : begin + 8], "big")
                    out.clock.append((clock >> 15) * 300 + (clock & 0x1FF))
            begin += 1 + length
        if not b3 & 0x10 or begin >= at:
            continue
        counter, before = b3 & 15, last.get(pid)
        if before is not None and not jump and counter != (before + 1 & 15):
            if counter == before and not repeated.get(pid):
                repeated[pid] = True
                continue
            out.continuity_errors += 1
            tables.pop(pid, None)
            if open_units.pop(pid, None):
                out.left_out += 1
        last[pid], repeated[pid] = counter, False
        body, start = ts[begin:at], b1 & 0x40
        if pid == PAT_PID or pid in out.programs.values():
            if start:
                pointer = body[0]
                if pid in tables:
                    tables[pid] += body[1 : 1 + pointer]
                    list(_take(out, pid, tables[pid]))
                tables[pid] = bytearray(body[1 + pointer :])
            elif pid in tables:
                tables[pid] += body
            if pid in tables:
                list(_take(out, pid, tables[pid]))
        elif pid in out.streams:
            if start:
                if pid in open_units:
                    close(pid)
                open_units[pid] = ([body], random_access, offset)
            elif pid in open_units:
                open_units[pid][0].append(body)
            else:
                out.left_out += 1
        else:
            out.left_out += 1
    out.skipped_bytes += size - at if at < size else 0
    for pid in list(open_units):
        close(pid)
    out.units.sort(key=lambda u: u.offset)
    return out


def _take(out: Stream, pid: int, buffer: bytearray) -> Iterator[None]:
    """Enter the sections of a program association or map table."""
    for s in _sections(out, buffer):
        if pid == PAT_PID and s[0] == 0x00:
            for i in range(8, len(s) - 4, 4):
                if number := int.from_bytes(s[i : i + 2], "big"):
                    out.programs[number] = int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
        elif s[0] == 0x02:
            i = 12 + (int.from_bytes(s[10:12], "big") & 0x0FFF)
            while i + 5 <= len(s) - 4:
                out.streams[int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = s[i]
                i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0x0FFF)
        yield


def feature(stream: Stream) -> str:
    """What the stream and its payload hold, in one line."""
    data = stream.payload()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / max(1, len(data))
    # Each random-access point by its time, its place in the file and the checksum of what can be read from there up to the next.
    points, crc = [], 0
    for u in stream.units:
        if u.random_access:
            points.append([u.pts, u.offset, 0])
        if points:
            points[-1][2] = zlib.crc32(u.data, points[-1][2])
    for point in points:
        crc = zlib.crc32(repr(point).encode(), crc)
    stamps = [u.pts for u in stream.units if u.pts is not None]
    kinds = ",".join(f"{pid}:{kind}" for pid, kind in sorted(stream.streams.items()))
    return (
        f"programs={len(stream.programs)};streams={kinds};packets={stream.packets};units={len(stream.units)};"
        f"random_access={sum(u.random_access for u in stream.units)};first_pts={min(stamps, default=-1)};"
        f"last_pts={max(stamps, default=-1)};clock={len(stream.clock)};continuity_errors={stream.continuity_errors};"
        f"table_errors={stream.table_errors};left_out={stream.left_out};bytes={len(data)};crc32={zlib.crc32(data):08x};"
        f"entropy={max(0.0, -float((share * np.log2(share)).sum())):.4f};distinct_bytes={len(share)};access_points={crc:08x}"
    )


INDEX_SCHEMA = (
    "pid int, stream_type int, unit_no int, pts long, dts long, random_access boolean, byte_offset long, n_bytes long"
)


def index_streams(media: DataFrame, id_col: str = "media_id", content_col: str = "content") -> DataFrame:
    """One row for each access unit of every stream: timestamps, random access, place in the file."""
    bounded_batches(media.sparkSession, 64)
    kind = dict(media.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [id_col, *[x.split()[0] for x in INDEX_SCHEMA.split(", ")]]
        for pdf in batches:
            rows = []
            for key, content in zip(pdf[id_col], pdf[content_col], strict=True):
                stream = demux(bytes(content) if content is not None else None)
                rows += [
                    (key, u.pid, stream.streams.get(u.pid), n, u.pts, u.dts, u.random_access, u.offset, len(u.data))
                    for n, u in enumerate(stream.units)
                ]
            yield pd.DataFrame(rows, columns=names).astype({"pts": "Int64", "dts": "Int64", "stream_type": "Int32"})

    return media.select(id_col, content_col).mapInPandas(run, f"{id_col} {kind}, {INDEX_SCHEMA}")


def padded(text: str | None) -> bytes:
    """UTF-8 bytes, and bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\x00")


def streams_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``content``: every whole text as a transport stream, a media column that :func:`index_streams` reads too."""
    bounded_batches(docs.sparkSession, 64)

    @F.pandas_udf("n_bytes long, content binary")
    def muxed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({
            "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in texts], "content": [mux(padded(t)) for t in texts],
        })

    return docs.select("doc_id", muxed(F.col("text")).alias("m")).select("doc_id", "m.*")


READ_SCHEMA = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, unit_pts array<long>, random_access_pts array<long>"
)


def read_streams(media: DataFrame) -> DataFrame:
    """``doc_id`` and ``n_bytes`` of stored streams, with what reading them back gives: digests, features, timestamps and random-access points."""
    bounded_batches(media.sparkSession, 64)
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]

    @F.pandas_udf(READ_SCHEMA)
    def read(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for content in contents:
            content = bytes(content)
            stream = demux(content)
            back = stream.payload(DATA_PID)
            rows.append((
                len(back),
                hashlib.sha256(back).hexdigest(),
                zlib.crc32(back[-64:]),
                len(content),
                hashlib.sha256(content).hexdigest(),
                feature(stream),
                [u.pts for u in stream.units],
                [u.pts for u in stream.units if u.random_access],
            ))
        return pd.DataFrame(rows, columns=names)

    return media.select("doc_id", "n_bytes", read(F.col("content")).alias("s")).select("doc_id", "n_bytes", "s.*")


def store_texts(docs: DataFrame) -> DataFrame:
    """Every text stored as a transport stream in a table of the shared folder, and read back from there."""
    return read_streams(stored(streams_of(docs)))
