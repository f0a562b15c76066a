"""MPEG transport streams as binary columns: writing, parsing and reassembly.

A stream holds one program. Its tables (program association and program map)
are repeated before every random-access point; payload bytes travel in packets
of one elementary stream, each with a presentation time stamp.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, raw_texts, schema_of, slices

# Fixed values of the transport stream format.
PACKET = 188
SYNC = 0x47
PAT_PID = 0x0000
NULL_PID = 0x1FFF
PRIVATE_STREAM = 0xBD
PRIVATE_TYPE = 0x06
CLOCK = 90_000

# Choices of this writer.
PROGRAM = 1
PMT_PID = 0x1000
DATA_PID = 0x0100
UNIT = 8192
STEP = 3600
RANDOM_EVERY = 8


def _section_crc(data: bytes) -> int:
    """CRC-32 of program tables: polynomial 0x04C11DB7, most significant bit first."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = len(body) + 9
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0])
    return head + body + _section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


def _tables() -> np.ndarray:
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    return np.stack([_table_packet(PAT_PID, pat), _table_packet(PMT_PID, pmt)])


_TABLES = _tables()


def _stamp(mark: int, pts: int) -> bytes:
    """33 bits of time in five bytes, with marker bits."""
    return bytes([mark << 4 | (pts >> 30 & 7) << 1 | 1, pts >> 22 & 0xFF, (pts >> 15 & 0x7F) << 1 | 1, pts >> 7 & 0xFF, (pts & 0x7F) << 1 | 1])


def _unstamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _adaptation(size: int, flags: int = 0, clock: bytes = b"") -> bytes:
    """An adaptation field of ``size`` bytes, its length byte included."""
    return bytes([size - 1]) + (bytes([flags]) + clock).ljust(size - 1, b"\xff") if size > 1 else b"\x00"


def _packets(data: bytes, pts: int, random: bool, counter: int) -> np.ndarray:
    """Transport packets of one elementary packet."""
    first = b""
    if random:  # random access, with a program clock reference
        pcr = pts << 15 | 0x3F << 9
        first = _adaptation(8, 0x50, pcr.to_bytes(6, "big"))
    room = PACKET - 4 - len(first)
    if len(data) < room:
        first = _adaptation(PACKET - 4 - len(data), 0x50 if random else 0, first[2:8])
        room = len(data)
    full, rest = divmod(len(data) - room, PACKET - 4)
    count = 1 + full + (rest > 0)
    out = np.empty((count, PACKET), np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
    out[:, 3] = 0x10 | (counter + np.arange(count)) & 15
    out[0, 1] |= 0x40
    if first:
        out[0, 3] |= 0x20
        out[0, 4 : 4 + len(first)] = np.frombuffer(first, np.uint8)
    body = np.frombuffer(data, np.uint8)
    out[0, 4 + len(first) :] = body[:room]
    out[1 : 1 + full, 4:] = body[room : room + full * (PACKET - 4)].reshape(full, PACKET - 4)
    if rest:
        stuffing = _adaptation(PACKET - 4 - rest)
        out[-1, 3] |= 0x20
        out[-1, 4 : PACKET - rest] = np.frombuffer(stuffing, np.uint8)
        out[-1, PACKET - rest :] = body[len(body) - rest :]
    return out


def mux(payload: bytes, unit: int = UNIT, step: int = STEP, random_every: int = RANDOM_EVERY) -> bytes:
    """A payload as a transport stream: ``unit`` bytes to an elementary packet, ``step`` ticks apart."""
    parts, counter, tables = [], 0, 0
    for n, at in enumerate(range(0, len(payload), unit)):
        random = n % random_every == 0
        pts = n * step & (1 << 33) - 1
        if random:
            psi = _TABLES.copy()
            psi[:, 3] |= tables & 15
            tables += 1
            parts.append(psi)
        body = payload[at : at + unit]
        head = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, pts)
        packets = _packets(head + body, pts, random, counter)
        counter += len(packets)
        parts.append(packets)
    return np.concatenate(parts).tobytes() if parts else b""


@dataclass
class Stream:
    """What a parsed stream holds."""

    pid: int | None = None
    payload: bytes = b""
    pts: list[int | None] = field(default_factory=list)
    random: list[bool] = field(default_factory=list)
    packet: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    continuity_errors: int = 0
    broken: int = 0


def _payload_at(packets: np.ndarray) -> np.ndarray:
    """Where each packet's payload begins; 188 if it has none."""
    control = packets[:, 3] >> 4 & 3
    start = np.where(control & 2, 5 + packets[:, 4].astype(int), 4)
    return np.where(control & 1, np.minimum(start, PACKET), PACKET)


def _sections(packets: np.ndarray, pid: int, table_id: int) -> bytes | None:
    """The first sound section of a table; its CRC must hold."""
    for p in packets[_pids(packets) == pid]:
        if not p[1] & 0x40:
            continue
        body = p[_payload_at(p[None])[0] :].tobytes()
        body = body[1 + body[0] :] if body else b""
        if len(body) < 12 or body[0] != table_id:
            continue
        whole = body[: 3 + ((body[1] & 0x0F) << 8 | body[2])]
        if _section_crc(whole) == 0:
            return whole[8:-4]
    return None


def _pids(packets: np.ndarray) -> np.ndarray:
    return (packets[:, 1].astype(int) & 0x1F) << 8 | packets[:, 2]


def _elementary_pid(packets: np.ndarray) -> int | None:
    """Program association leads to the program map, which names the elementary stream."""
    pat = _sections(packets, PAT_PID, 0x00)
    programs = {pat[i] << 8 | pat[i + 1]: (pat[i + 2] & 0x1F) << 8 | pat[i + 3] for i in range(0, len(pat) - 3, 4)} if pat else {}
    programs.pop(0, None)
    for pmt_pid in programs.values():
        body = _sections(packets, pmt_pid, 0x02)
        if body and len(body) >= 9:
            at = 4 + ((body[2] & 0x0F) << 8 | body[3])
            if at + 5 <= len(body):
                return (body[at + 1] & 0x1F) << 8 | body[at + 2]
    return None


def demux(stream: bytes | None) -> Stream:
    """Parses a transport stream.

    ``broken`` counts packets without the sync byte or flagged as damaged, a
    partial packet at the end, and elementary packets with an unsound header or
    length. A repeated continuity counter is a duplicate and is skipped; any
    other step but one is an error, unless a discontinuity is announced.
    """
    out = Stream()
    if not stream:
        return out
    whole = len(stream) // PACKET
    out.broken = int(len(stream) % PACKET > 0)
    packets = np.frombuffer(stream, np.uint8, whole * PACKET).reshape(-1, PACKET)
    sound = (packets[:, 0] == SYNC) & (packets[:, 1] & 0x80 == 0)
    out.broken += int((~sound).sum())
    out.pid = _elementary_pid(packets[sound])
    if out.pid is None:
        return out
    place = np.flatnonzero(sound & (_pids(packets) == out.pid))
    own = packets[place]
    start = _payload_at(own)
    own, place, start = own[start < PACKET], place[start < PACKET], start[start < PACKET]
    if not len(own):
        return out
    step = np.diff(own[:, 3].astype(int) & 15) & 15
    adapted = (own[:, 3] & 0x20 > 0) & (own[:, 4] > 0)
    announced = adapted & (own[:, 5] & 0x80 > 0)
    again = np.r_[False, step == 0]
    out.continuity_errors = int((np.r_[False, step > 1] & ~announced).sum())
    own, place, start, adapted = own[~again], place[~again], start[~again], adapted[~again]
    data = own[np.arange(PACKET) >= start[:, None]]
    ends = np.cumsum(PACKET - start)
    begins = np.flatnonzero(own[:, 1] & 0x40)
    bodies = []
    for n, row in enumerate(begins):
        low = ends[row - 1] if row else 0
        high = ends[begins[n + 1] - 1] if n + 1 < len(begins) else ends[-1]
        head = data[low : low + 14].tobytes()
        size = high - low
        if size < 9 or head[:3] != b"\x00\x00\x01" or size < 9 + head[8] or (declared := head[4] << 8 | head[5]) and declared + 6 != size:
            out.broken += 1
            continue
        body = data[low + 9 + head[8] : high]
        bodies.append(body)
        out.pts.append(_unstamp(head[9:14]) if head[7] & 0x80 and size >= 14 else None)
        out.random.append(bool(adapted[row] and own[row, 5] & 0x40))
        out.packet.append(int(place[row]))
        out.sizes.append(len(body))
    out.payload = np.concatenate(bodies).tobytes() if bodies else b""
    return out


def padded(raw: bytes, multiple: int = 64) -> bytes:
    """Zero bytes up to a positive multiple."""
    return raw.ljust(max(1, -(-len(raw) // multiple)) * multiple, b"\x00")


def to_streams(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text's padded UTF-8 bytes as a transport stream.

    A null text counts as empty and gives 64 zero bytes. Repeated rows and null
    ids pass through; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = raw_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([mux(padded(r)) for r in raw], pa.binary())], names=[id_col, "n_bytes", "media"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, schema_of(df, id_col, "n_bytes long, media binary"))


_UNITS = pa.list_(pa.struct([("pts", pa.int64()), ("random_access", pa.bool_()), ("packet", pa.int64()), ("size", pa.int64())]))


def from_streams(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Parses a column of transport streams; all columns stay, and these follow.

    payload, the reassembled bytes; pid, null without sound tables;
    continuity_errors; broken; units, each with its time stamp, random-access
    flag, first packet's number and size. A null or empty stream has none. Names
    of new columns must not be taken (``ValueError``).
    """
    new = ["payload", "pid", "continuity_errors", "broken", "units"]
    if taken := set(new) & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(taken)}")
    at = df.columns.index(media_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [demux(m) for m in batch.column(at).to_pylist()]
            units = [[{"pts": p, "random_access": r, "packet": k, "size": s} for p, r, k, s in zip(x.pts, x.random, x.packet, x.sizes)] for x in found]
            more = [pa.array([x.payload for x in found], pa.binary()), pa.array([x.pid for x in found], pa.int32()), *(pa.array([getattr(x, k) for x in found], pa.int64()) for k in new[2:4]), pa.array(units, _UNITS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *new])

    fields = "payload binary, pid int, continuity_errors long, broken long, units array<struct<pts: long, random_access: boolean, packet: long, size: long>>"
    schema = df.schema
    for f in schema_of(df, media_col, fields).fields[1:]:
        schema = type(schema)([*schema.fields, f])
    return df.mapInArrow(run, schema)


def feature(units: Column, pid: Column, errors: Column) -> Column:
    """A stream's stored times and random-access points in one line."""
    points = F.filter(units, lambda u: u["random_access"])
    text = F.array_join(F.transform(points, lambda u: F.concat_ws("@", u["pts"].cast("string"), u["packet"].cast("string"))), ",")
    first, last = (F.coalesce(F.try_element_at(units, F.lit(i))["pts"].cast("string"), F.lit("-")) for i in (1, -1))
    return F.concat_ws(";", F.concat(F.lit("pid="), pid.cast("string")), F.concat(F.lit("units="), F.size(units).cast("string")), F.concat(F.lit("pts="), first, F.lit("-"), last), F.concat(F.lit("random="), text), F.concat(F.lit("continuity_errors="), errors.cast("string")))
