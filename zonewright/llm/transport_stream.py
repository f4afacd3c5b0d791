r"""MPEG transport streams as a media column: multiplexing, demultiplexing, timestamps and random-access points.

`mux` packs a payload into 188-byte packets: a PAT, a PMT, and one elementary stream (private data, stream type 0x06) whose
access units of `unit` bytes each go into one PES packet with a PTS; the first packet of a unit carries an adaptation field
with the PCR, and the random-access indicator on every `gop`-th unit. `demux` reads any such stream back: it parses the
program tables (CRC-checked, over as many packets as a section takes), checks the continuity counters of each PID, reassembles the PES packets
and reports timestamps and random-access points. Damaged streams give counts of errors and what can be read.

Defined results: a null text counts as an empty one; an empty payload is padded to one block; equal payloads give equal
streams. Rows are independent: ties, repeated rows, empty tables and other columns of the input do not matter. Each row's
work is proportional to its own length, one text at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET = 188
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE = 0x1000, 0x0100, 1, 0x06
PTS_HZ = 90_000
#: Payload bytes of one access unit, units from one random-access point to the next, ticks between units.
UNIT, GOP, TICKS = 11_520, 8, 3_600
_PES_HEADER = 14

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC[_i] = _c


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ int(_CRC[(c >> 24) ^ b])
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    head = b"\x00" + head + crc32_mpeg(head).to_bytes(4, "big")  # pointer field first
    return head + b"\xff" * (PACKET - 4 - len(head))


_PAT = b"\x47\x40\x00\x10" + _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = (0x47400010 | PMT_PID << 8).to_bytes(4, "big") + _section(
    0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
)


def _stamp(prefix: int, t: int) -> bytes:
    return bytes([prefix << 4 | (t >> 29 & 0x0E) | 1, t >> 22 & 0xFF, (t >> 14 & 0xFE) | 1, t >> 7 & 0xFF, (t << 1 & 0xFE) | 1])


def _read_stamp(b) -> int:
    return (int(b[0]) >> 1 & 7) << 30 | int(b[1]) << 22 | int(b[2]) >> 1 << 15 | int(b[3]) << 7 | int(b[4]) >> 1


def _pcr_field(t: int, random_access: bool) -> bytes:
    base = t & 0x1FFFFFFFF
    return bytes([0x50 if random_access else 0x10]) + (base << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes, unit: int = UNIT, gop: int = GOP, ticks: int = TICKS) -> bytes:
    """A transport stream with the payload as its only elementary stream."""
    out, count = [_PAT, _PMT], 0
    head = np.array([0x47, ES_PID >> 8, ES_PID & 0xFF, 0x10], np.uint8)
    for k, at in enumerate(range(0, len(payload), unit)):
        data = payload[at : at + unit]
        pts = k * ticks + PTS_HZ & 0x1FFFFFFFF
        length = len(data) + _PES_HEADER - 6
        pes = b"\x00\x00\x01\xbd" + (length if length < 65536 else 0).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, pts) + data
        pcr = _pcr_field(k * ticks, k % gop == 0)
        room = PACKET - 4 - 1 - len(pcr)
        first, rest = pes[:room], pes[room:]
        stuffing = room - len(first)
        field_ = bytes([len(pcr) + stuffing]) + pcr + b"\xff" * stuffing
        out.append(bytes([0x47, 0x40 | ES_PID >> 8, ES_PID & 0xFF, 0x30 | count]) + field_ + first)
        count = count + 1 & 15
        n, left = divmod(len(rest), PACKET - 4)
        if n:
            body = np.empty((n, PACKET), np.uint8)
            body[:, :4] = head
            body[:, 3] |= (np.arange(count, count + n) & 15).astype(np.uint8)
            body[:, 4:] = np.frombuffer(rest, np.uint8, n * (PACKET - 4)).reshape(n, -1)
            out.append(body.tobytes())
            count = count + n & 15
        if left:
            pad = PACKET - 4 - left
            field_ = b"\x00" if pad == 1 else bytes([pad - 1, 0]) + b"\xff" * (pad - 2)
            out.append(bytes([0x47, ES_PID >> 8, ES_PID & 0xFF, 0x30 | count]) + field_ + rest[-left:])
            count = count + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What demux() finds. programs: program number to PMT PID; streams: PID to stream type; payload: PID to bytes."""

    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    payload: dict[int, bytes] = field(default_factory=dict)
    timestamps: dict[int, list[int]] = field(default_factory=dict)
    random_access: dict[int, list[int]] = field(default_factory=dict)  # indexes of PES packets
    packets: int = 0
    continuity_errors: int = 0
    crc_errors: int = 0
    sync_errors: int = 0
    pes_errors: int = 0


def _payloads(p: np.ndarray, s: Stream) -> tuple[np.ndarray, np.ndarray]:
    """The packets of one PID that carry a payload, without repeated ones, and where their payloads begin. Counts breaks in their continuity counters."""
    control = p[:, 3] >> 4 & 3
    start = np.where(control == 3, 5 + p[:, 4].astype(np.int64), 4)
    bad = (control & 1 == 1) & (start > PACKET)  # an adaptation field beyond its packet
    s.sync_errors += int(bad.sum())
    has = (control & 1 == 1) & ~bad
    p, start = p[has], start[has]
    count = (p[:, 3] & 15).astype(np.int16)
    repeat = np.append(False, (np.diff(count) == 0) & (p[1:] == p[:-1]).all(1)) if len(p) > 1 else np.zeros(len(p), bool)
    p, start, count = p[~repeat], start[~repeat], count[~repeat]
    s.continuity_errors += int(((np.diff(count) & 15) != 1).sum())
    return p, start


def _sections(p: np.ndarray, s: Stream):
    """Yields the whole sections of one PID whose CRC holds, over as many packets as they take; counts the others."""
    p, start = _payloads(p, s)
    buffer: bytes | None = None  # None: not within a section

    def cut():
        nonlocal buffer
        while buffer and buffer[0] != 0xFF and len(buffer) >= 3:
            size = 3 + (int.from_bytes(buffer[1:3], "big") & 0xFFF)
            if len(buffer) < size:
                return
            whole, buffer = buffer[:size], buffer[size:]
            if size < 12 or crc32_mpeg(whole):
                s.crc_errors += 1
            else:
                yield whole
        if buffer is not None and (not buffer or buffer[0] == 0xFF):
            buffer = None

    for row, at in zip(p, start.tolist()):
        data = row[at:].tobytes()
        if row[1] & 0x40 and data:
            if buffer is not None:
                buffer += data[1 : 1 + data[0]]
                yield from cut()
                s.crc_errors += buffer is not None
            buffer = data[1 + data[0] :]
        elif buffer is not None:
            buffer += data
        yield from cut()
    s.crc_errors += buffer is not None


def demux(data: bytes) -> Stream:
    """Any bytes: what can't be read is counted, nothing raises."""
    s = Stream()
    n = len(data) // PACKET
    p = np.frombuffer(data, np.uint8, n * PACKET).reshape(n, PACKET)
    ok = p[:, 0] == 0x47
    s.sync_errors = int(n - ok.sum()) + (len(data) % PACKET > 0)
    p = p[ok]
    s.packets = len(p)
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    for x in _sections(p[pid == 0], s):
        if x[0] == 0:
            for i in range(8, len(x) - 7, 4):
                if number := int.from_bytes(x[i : i + 2], "big"):
                    s.programs[number] = int.from_bytes(x[i + 2 : i + 4], "big") & 0x1FFF
    for table_pid in sorted(set(s.programs.values())):
        for x in _sections(p[pid == table_pid], s):
            if x[0] == 2:
                i = 12 + (int.from_bytes(x[10:12], "big") & 0xFFF)
                while i + 5 <= len(x) - 4:
                    s.streams[int.from_bytes(x[i + 1 : i + 3], "big") & 0x1FFF] = x[i]
                    i += 5 + (int.from_bytes(x[i + 3 : i + 5], "big") & 0xFFF)
    for es in s.streams:
        _elementary(p[pid == es], es, s)
    return s


#: Stream ids whose PES packets have no optional header.
_BARE = frozenset([0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF])


def _elementary(p: np.ndarray, es: int, s: Stream) -> None:
    """Reassembly, timestamps and random-access points of one PID. A PES packet that is too short for what its header says counts as an error."""
    p, start = _payloads(p, s)
    flat = p[np.arange(PACKET)[None, :] >= start[:, None]]
    at = np.append(0, np.cumsum(PACKET - start))
    begins = np.flatnonzero(p[:, 1] & 0x40)
    s.timestamps[es], s.random_access[es], parts = [], [], []
    flat = flat.tobytes()
    for k, b in enumerate(begins):
        pes = flat[at[b] : at[begins[k + 1]] if k + 1 < len(begins) else len(flat)]
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 6:
            s.pes_errors += 1
            continue
        length = int.from_bytes(pes[4:6], "big")
        body = pes[6 : 6 + length] if length else pes[6:]
        s.pes_errors += len(body) < length
        if pes[3] not in _BARE:
            if len(body) < 3 or len(body) < 3 + body[2] or (body[1] & 0x80 and body[2] < 5):
                s.pes_errors += len(body) >= length
                continue
            if body[1] & 0x80:
                s.timestamps[es].append(_read_stamp(body[3:8]))
            body = body[3 + body[2] :]
        elif pes[3] == 0xBE:  # padding
            continue
        if p[b, 3] & 0x20 and p[b, 4] and p[b, 5] & 0x40:
            s.random_access[es].append(len(parts))
        parts.append(body)
    s.payload[es] = b"".join(parts)


def padded(text: bytes, block: int = 576) -> bytes:
    """The text with bytes 255 up to a positive multiple of block."""
    return text + b"\xff" * (-len(text) % block if text else block)


def media_column(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), block: int = 576) -> DataFrame:
    """Adds media (binary): the transport stream of each padded text. Keeps the columns named."""
    names = list(keep)
    cols = docs.select(*names, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_payload"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema if f.name != "_payload") + ", n_bytes long, media binary"

    def run(batches):
        for b in batches:
            texts = b.column("_payload")
            rows = [mux(padded(t.as_py(), block)) for t in texts]
            sizes = [len(t.as_py()) for t in texts]
            kept = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())], names=[*names, "n_bytes", "media"])

    return cols.mapInArrow(run, schema)


def stream_index(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), column: str = "media") -> DataFrame:
    """Reads each stream back: digests of payload and stream, program tables, error counts, timestamps, random-access points."""
    names = list(keep)
    cols = media.select(*names, F.col(column).alias("_media"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema if f.name != "_media")
    schema += (
        ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, packets long, continuity_errors long, "
        "crc_errors long, sync_errors long, pes_errors long, timestamps array<long>, random_access array<long>, feature string"
    )
    out = schema.split(", ", len(names))[len(names)]
    fields = [x.split(" ")[0] for x in out.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[x.split(" ")[1]] for x in out.split(", ")]

    def row(data: bytes) -> tuple:
        s = demux(data)
        es = min(s.streams, default=-1)
        payload, pts, rap = s.payload.get(es, b""), s.timestamps.get(es, []), s.random_access.get(es, [])
        at = hashlib.sha256(payload).hexdigest()
        feature = (
            f"programs={len(s.programs)};pid={es};type={s.streams.get(es, -1)};packets={s.packets};pes={len(pts)};cc={s.continuity_errors}"
            f";pts={pts[0] if pts else -1}-{pts[-1] if pts else -1};rap={len(rap)}"
        )
        return (len(payload), at, zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), s.packets, s.continuity_errors, s.crc_errors, s.sync_errors, s.pes_errors, pts, rap, feature)

    def run(batches):
        for b in batches:
            rows = [row(x.as_py() or b"") for x in b.column("_media")]
            cols_ = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *cols_], names=[*names, *fields])

    return cols.mapInArrow(run, schema)
