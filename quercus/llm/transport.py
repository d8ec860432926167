"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

mux packs a payload as private-data packets of one programme; demux parses any stream: programme tables (with their CRC),
continuity counters, elementary packets with time stamps, and random-access points.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, NULL_PID = 0, 0x1000, 0x0100, 0x1FFF
PROGRAM, PRIVATE_DATA, PRIVATE_STREAM_1 = 1, 0x06, 0xBD
#: Payload bytes of one elementary packet, ticks (90 kHz) between packets, packets from one random-access point to the next.
UNIT, TICKS, RANDOM_ACCESS_EVERY = 16384, 3600, 8
#: Stream ids whose packets have no header after their length (13818-1, table 2-21).
_BARE_STREAMS = frozenset({0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF})


@functools.cache
def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


@functools.lru_cache(4096)
def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2; zero over a section with its own CRC."""
    table, c = _crc_table(), 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


@functools.cache
def _tables() -> bytes:
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    return b"".join(bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + s + b"\xff" * (PACKET - 5 - len(s)) for pid, s in ((PAT_PID, pat), (PMT_PID, pmt)))


def _stamp(prefix: int, t: int) -> bytes:
    return bytes([prefix << 4 | t >> 29 & 0x0E | 1, t >> 22 & 255, t >> 14 & 0xFE | 1, t >> 7 & 255, t << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """A stream that holds payload losslessly; equal payloads give equal streams. An empty payload gives the tables alone."""
    out, counter = [_tables()], 0
    high, low = DATA_PID >> 8, DATA_PID & 255
    for n, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        time = n * TICKS & (1 << 33) - 1
        data = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, time) + unit
        field_bytes = b""
        if n % RANDOM_ACCESS_EVERY == 0:
            clock = time << 15 | 0x7E00
            field_bytes = b"\x50" + clock.to_bytes(6, "big")
        place, first = 0, 0x40
        while place < len(data):
            room = PACKET - 4 - (len(field_bytes) + 1 if field_bytes else 0)
            left = len(data) - place
            if left < room:  # stuffing in the adaptation field
                short = room - left
                if field_bytes:
                    field_bytes += b"\xff" * short
                else:
                    field_bytes = b"" if short == 1 else b"\x00" + b"\xff" * (short - 2)
                    room = left
                    out.append(bytes([SYNC, first | high, low, 0x30 | counter, len(field_bytes)]) + field_bytes + data[place:])
                    place, field_bytes = len(data), b""
                    counter = counter + 1 & 15
                    continue
                room = left
            if field_bytes:
                out.append(bytes([SYNC, first | high, low, 0x30 | counter, len(field_bytes)]) + field_bytes + data[place : place + room])
            else:
                out.append(bytes([SYNC, first | high, low, 0x10 | counter]) + data[place : place + room])
            place += room
            counter, first, field_bytes = counter + 1 & 15, 0, b""
    return b"".join(out)


@dataclass
class Unit:
    """One elementary packet: its stream's PID, time stamps (90 kHz; None without), data, the offset of its first transport packet, whether decoding can start there."""

    pid: int
    pts: int | None
    dts: int | None
    data: bytes
    offset: int
    random_access: bool


@dataclass
class Stream:
    """What a transport stream holds. streams: PID -> stream type; errors by kind."""

    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)
    packets: int = 0
    discontinuities: int = 0
    sync_errors: int = 0
    table_errors: int = 0
    cut_units: int = 0


def _read_stamp(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def demux(data: bytes) -> Stream:
    """Parses a whole stream. Bytes out of sync are skipped up to the next sync byte and counted; a duplicate packet counts once."""
    s = Stream()
    counters: dict[int, int] = {}
    last: dict[int, bytes] = {}
    sections: dict[int, bytes] = {}
    open_units: dict[int, list] = {}

    def table(pid: int) -> None:
        """Takes in the sections that are complete."""
        buffer = sections[pid]
        while len(buffer) >= 3 and buffer[0] != 0xFF:
            length = 3 + (int.from_bytes(buffer[1:3], "big") & 0xFFF)
            if len(buffer) < length:
                break
            part, buffer = buffer[:length], buffer[length:]
            if length < 12 or crc32_mpeg(part):
                s.table_errors += 1
            elif part[0] == 0 and pid == PAT_PID:
                for i in range(8, length - 4, 4):
                    number = int.from_bytes(part[i : i + 2], "big")
                    if number:
                        s.programs[number] = int.from_bytes(part[i + 2 : i + 4], "big") & 0x1FFF
            elif part[0] == 2:
                i = 12 + (int.from_bytes(part[10:12], "big") & 0xFFF)
                while i + 5 <= length - 4:
                    s.streams[int.from_bytes(part[i + 1 : i + 3], "big") & 0x1FFF] = part[i]
                    i += 5 + (int.from_bytes(part[i + 3 : i + 5], "big") & 0xFFF)
        sections[pid] = b"" if buffer[:1] == b"\xff" else buffer

    def close(pid: int) -> None:
        if pid not in open_units:
            return
        offset, random_access, parts = open_units.pop(pid)
        raw = b"".join(parts)
        if len(raw) < 6 or raw[:3] != b"\x00\x00\x01":
            s.cut_units += 1
            return
        length = int.from_bytes(raw[4:6], "big")
        body = raw[6 : 6 + length] if length else raw[6:]
        if length and len(body) < length:
            s.cut_units += 1
        pts = dts = None
        if raw[3] not in _BARE_STREAMS and len(body) >= 3:
            head = body[3 : 3 + body[2]]
            if body[1] & 0x80 and len(head) >= 5:
                pts = _read_stamp(head)
            if body[1] & 0xC0 == 0xC0 and len(head) >= 10:
                dts = _read_stamp(head[5:])
            body = body[3 + body[2] :]
        s.units.append(Unit(pid, pts, dts, body, offset, random_access))

    at, end = 0, len(data)
    while at + PACKET <= end:
        if data[at] != SYNC:
            s.sync_errors += 1
            at = data.find(SYNC, at + 1)
            if at < 0:
                break
            continue
        b1, b3 = data[at + 1], data[at + 3]
        pid = (b1 & 0x1F) << 8 | data[at + 2]
        s.packets += 1
        offset, at = at, at + PACKET
        if pid == NULL_PID or b1 & 0x80:
            continue
        place, random_access, announced = offset + 4, False, False
        if b3 & 0x20:
            size = data[place]
            if size:
                random_access, announced = bool(data[place + 1] & 0x40), bool(data[place + 1] & 0x80)
            place += 1 + size
        if not b3 & 0x10:
            continue
        counter = b3 & 15
        before = counters.get(pid)
        if before is not None and not announced and counter != before + 1 & 15:
            packet = data[offset:at]
            if counter == before and last.get(pid) == packet:
                continue
            s.discontinuities += 1
        counters[pid] = counter
        last[pid] = data[offset:at]
        payload = data[place:at]
        if pid == PAT_PID or pid in s.programs.values():
            if b1 & 0x40 and payload:
                sections[pid] = sections.get(pid, b"") + payload[1 : 1 + payload[0]]
                table(pid)
                sections[pid] = payload[1 + payload[0] :]
            else:
                sections[pid] = sections.get(pid, b"") + payload
            table(pid)
        elif pid in s.streams:
            if b1 & 0x40:
                close(pid)
                open_units[pid] = [offset, random_access, [payload]]
            elif pid in open_units:
                open_units[pid][2].append(payload)
    s.sync_errors += end - at if 0 < end - at < PACKET and at >= 0 else 0
    for pid in list(open_units):
        close(pid)
    s.units.sort(key=lambda u: u.offset)
    return s


def described(s: Stream) -> str:
    """A stream's features in one line."""
    stamps = [u.pts for u in s.units if u.pts is not None]
    points = [u for u in s.units if u.random_access]
    return (
        f"programs={len(s.programs)};streams={','.join(f'{p:#06x}:{t:#04x}' for p, t in sorted(s.streams.items()))};packets={s.packets};units={len(s.units)};"
        f"pts={min(stamps, default='')}-{max(stamps, default='')};random_access={','.join(f'{u.pts}@{u.offset}' for u in points)};"
        f"discontinuities={s.discontinuities};errors={s.sync_errors + s.table_errors + s.cut_units}"
    )


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 or (0 if data else 64))


UNITS = "array<struct<pid:int,pts:bigint,dts:bigint,n_bytes:bigint,offset:bigint,random_access:boolean>>"


def stored(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with its text replaced by n_bytes (of its UTF-8) and the media column: the padded text as a transport stream.

    Null and empty texts are 64 zero bytes. Columns of these names are replaced, all others stay. No shuffle.
    """
    kept = [c for c in df.columns if c not in ("n_bytes", media) and c != text]
    source = df.select(*(df[f"`{c}`"] for c in kept), df[f"`{text}`"].alias("__text"))
    place = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 512):  # smaller batches: streams are larger than texts
                part = batch.slice(at, 512)
                texts = [t.as_py() or b"" for t in part.column(place).cast(pa.binary())]
                media_column = pa.array([mux(padded(t)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:place], pa.array([len(t) for t in texts], pa.int64()), media_column], names=[*kept, "n_bytes", media])

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:place]]
    return source.mapInArrow(run, ", ".join([*columns, "n_bytes bigint", f"`{media}` binary"]))


def indexed(df: DataFrame, media: str = "media") -> DataFrame:
    """df with, in place of the media, what the streams hold.

    payload_bytes, payload_sha256, tail_crc32 (last 64 bytes) of the elementary data put together; media_bytes and
    media_sha256 of the stream; feature; units (time stamps, sizes, offsets, random-access points). A null stream counts as
    empty. Columns of these names are replaced, all others stay. No shuffle.
    """
    new = {"payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string", "units": UNITS}
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    unit_kind = pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("n_bytes", pa.int64()), ("offset", pa.int64()), ("random_access", pa.bool_())]))
    kept = [c for c in df.columns if c not in new and c != media]
    source = df.select(*(df[f"`{c}`"] for c in kept), df[f"`{media}`"].alias("__media"))
    place = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, units = [], []
            for m in batch.column(place):
                data = m.as_py() or b""
                found = demux(data)
                payload = b"".join([u.data for u in found.units])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), described(found)))
                units.append([{"pid": u.pid, "pts": u.pts, "dts": u.dts, "n_bytes": len(u.data), "offset": u.offset, "random_access": u.random_access} for u in found.units])
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], *columns, pa.array(units, unit_kind)], names=[*kept, *new])

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:place]]
    return source.mapInArrow(run, ", ".join([*columns, *(f"`{n}` {k}" for n, k in new.items())]))
