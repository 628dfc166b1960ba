"""Media columns: MPEG transport streams.

A payload is written as one programme with one private elementary stream (PAT, PMT, PES with PTS, PCR and, at every
ACCESS-th unit, a random-access flag), and read back by parsing the programme tables, checking every continuity
counter, reassembling the PES packets of each stream by its PID and keeping the timestamps with their random-access
points. The reader takes any number of interleaved streams, tables over several packets, repeated packets, announced
discontinuities, packets without payload and PES packets without timestamps.

Null text counts as empty; an empty text is a payload of 64 zero bytes; repeated rows give repeated results, ties
don't matter, as each row is handled alone; an empty table gives an empty one; other columns, whatever their names,
are not read. Nothing is shuffled, and the largest thing in memory is one Arrow batch, or one very long text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, written

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID, NULL_PID, PROGRAMME = 0, 0x1000, 0x100, 0x1FFF, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
TICKS = 3600  # 90 kHz ticks between access units
FULL_PACKETS = 88
#: Bytes of an access unit whose packets are all full: the first packet also carries PCR and the PES header.
UNIT = PACKET - 4 - 8 - 14 + FULL_PACKETS * (PACKET - 4)
TABLES_EVERY = 16
ACCESS = 4  # units from one random-access point to the next
#: Stream ids whose PES packets have no optional header.
BARE = frozenset([0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF])


class StreamError(ValueError):
    pass


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


@lru_cache(256)
def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


_PAT = _section(0, 1, struct.pack(">HH", PROGRAMME, 0xE000 | PMT_PID))


@lru_cache(64)
def _pmt(pids: tuple[int, ...]) -> bytes:
    return _section(2, PROGRAMME, struct.pack(">HH", 0xE000 | pids[0], 0xF000) + b"".join(struct.pack(">BHH", STREAM_TYPE, 0xE000 | p, 0xF000) for p in pids))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | counter & 15) + (b"\0" + section).ljust(PACKET - 4, b"\xff")


def _stamp(prefix: int, t: int) -> bytes:
    return struct.pack(">BHH", prefix << 4 | (t >> 29) & 0xE | 1, (t >> 14) & 0xFFFE | 1, (t << 1) & 0xFFFE | 1)


def _units(payload: bytes, pid: int = ES_PID):
    """The packets of each access unit of a payload, a list for each."""
    counter = 0
    middle = [struct.pack(">BHB", SYNC, pid, 0x10 | c) for c in range(16)]
    for unit, at in enumerate(range(0, len(payload), UNIT) if payload else [0]):
        out = []
        pts = unit * TICKS & 0x1FFFFFFFF
        data = payload[at : at + UNIT]
        pes = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(data) + 8, 0x84, 0x80, 5) + _stamp(2, pts) + data
        room = PACKET - 4 - 8
        stuffing = max(0, room - len(pes))
        field_ = struct.pack(">BB", 7 + stuffing, 0x10 if unit % ACCESS else 0x50) + struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00) + b"\xff" * stuffing
        out.append(struct.pack(">BHB", SYNC, 0x4000 | pid, 0x30 | counter) + field_ + pes[:room])
        counter = counter + 1 & 15
        whole = room + max(0, len(pes) - room) // (PACKET - 4) * (PACKET - 4)
        for i in range(room, whole, PACKET - 4):
            out.append(middle[counter] + pes[i : i + PACKET - 4])
            counter = counter + 1 & 15
        if rest := pes[max(whole, room) :]:
            n = PACKET - 4 - len(rest)
            pad = b"\0" if n == 1 else struct.pack(">BB", n - 1, 0) + b"\xff" * (n - 2)
            out.append(struct.pack(">BHB", SYNC, pid, 0x30 | counter) + pad + rest)
            counter = counter + 1 & 15
        yield out


def _tables_at(number: int, pids: tuple[int, ...]) -> list[bytes]:
    return [_table_packet(PAT_PID, _PAT, number), _table_packet(PMT_PID, _pmt(pids), number)]


def write_stream(payload: bytes) -> bytes:
    """``payload`` as a transport stream; the same bytes always give the same stream."""
    out: list[bytes] = []
    for number, packets in enumerate(_units(payload)):
        if number % TABLES_EVERY == 0:
            out += _tables_at(number // TABLES_EVERY, (ES_PID,))
        out += packets
    return b"".join(out)


def write_streams(payloads: dict[int, bytes]) -> bytes:
    """Several payloads by PID in one transport stream, packet by packet in turn."""
    queues = {pid: [p for unit in _units(data, pid) for p in unit] for pid, data in payloads.items()}
    out, tables = [], 0
    for turn in range(max(map(len, queues.values()))):
        if turn % (TABLES_EVERY * FULL_PACKETS) == 0:
            out += _tables_at(tables, tuple(payloads))
            tables += 1
        out += [q[turn] for q in queues.values() if turn < len(q)]
    return b"".join(out)


@dataclass
class Stream:
    payloads: dict[int, bytes] = field(default_factory=dict)
    packets: int = 0
    table_packets: int = 0
    stuffing: int = 0
    repeated: int = 0
    gaps: int = 0  # announced ones
    streams: dict[int, int] = field(default_factory=dict)  # PID -> stream type
    units: list[tuple[int, int, int | None, bool]] = field(default_factory=list)  # PID, packet number, PTS, random access

    @property
    def payload(self) -> bytes:
        return b"".join(self.payloads[pid] for pid in sorted(self.payloads))

    @property
    def pts(self) -> list[int | None]:
        return [u[2] for u in self.units]

    @property
    def random_access(self) -> list[int]:
        """Packet number of each random-access point."""
        return [u[1] for u in self.units if u[3]]

    def feature(self) -> str:
        kinds = ",".join(f"{pid:x}/{kind:x}" for pid, kind in sorted(self.streams.items()))
        stamps = [t for t in self.pts if t is not None] or [0]
        points = zlib.crc32(b"".join(struct.pack("<HQq", pid, number, -1 if t is None else t) for pid, number, t, access in self.units if access))
        return f"es={kinds};packets={self.packets};tables={self.table_packets};stuffing={self.stuffing};units={len(self.units)};pts={stamps[0]}-{stamps[-1]};rap={len(self.random_access)}:{points:08x}"


def _section_body(section: bytes, table_id: int) -> bytes:
    if section[0] != table_id or crc32_mpeg(section[:-4]) != int.from_bytes(section[-4:]):
        raise StreamError(f"table {table_id} is damaged")
    return section[8:-4]


class _Sections:
    """Sections of one PID, whole ones out of the payloads of its packets."""

    def __init__(self) -> None:
        self.data: bytes | None = None

    def take(self, payload: bytes, first: bool) -> list[bytes]:
        found = []
        if first:
            pointer = payload[0]
            if self.data is not None and pointer:
                self.data += payload[1 : 1 + pointer]
                found += self._whole()
            self.data = payload[1 + pointer :]
        elif self.data is not None:
            self.data += payload
        return found + self._whole()

    def _whole(self) -> list[bytes]:
        out = []
        while self.data and len(self.data) >= 3 and self.data[0] != 0xFF:
            size = 3 + ((self.data[1] & 0xF) << 8 | self.data[2])
            if len(self.data) < size:
                break
            out.append(bytes(self.data[:size]))
            self.data = self.data[size:]
        return out


def _pes(unit: bytes) -> tuple[int | None, bytes]:
    """PTS, if there is one, and data of a PES packet."""
    size = unit[4] << 8 | unit[5] if len(unit) >= 6 else -1
    if size < 0 or unit[:3] != b"\0\0\1" or (size and size + 6 != len(unit)):
        raise StreamError("PES packet is damaged")
    if unit[3] in BARE:
        return None, unit[6:]
    if len(unit) < 9 or unit[6] >> 6 != 2:
        raise StreamError("PES packet is damaged")
    if not unit[7] & 0x80:
        return None, unit[9 + unit[8] :]
    a, b, c, d, e = unit[9:14]
    return (a >> 1 & 7) << 30 | b << 22 | c >> 1 << 15 | d << 7 | e >> 1, unit[9 + unit[8] :]


def read_stream(media: bytes) -> Stream:
    """Parse a stream; raises StreamError on lost sync, a counter gap that isn't announced, a damaged table or PES packet.

    A packet that repeats the last one of its PID is passed over, once.
    """
    if len(media) % PACKET:
        raise StreamError("not whole packets")
    s = Stream(packets=len(media) // PACKET)
    counters: dict[int, int] = {}
    before: dict[int, int] = {}  # start of the last packet of a PID, -1 once it was repeated
    sections: dict[int, _Sections] = {PAT_PID: _Sections()}
    pmts: set[int] = set()
    parts: dict[int, list[list[bytes]]] = {}
    for number, at in enumerate(range(0, len(media), PACKET)):
        if media[at] != SYNC:
            raise StreamError(f"no sync byte in packet {number}")
        head, control = media[at + 1], media[at + 3]
        pid = (head & 0x1F) << 8 | media[at + 2]
        if pid == NULL_PID:
            continue
        if head & 0x80 or control & 0xC0:
            raise StreamError(f"packet {number} is marked as damaged or is scrambled")
        start, end, access, announced = at + 4, at + PACKET, False, False
        if control & 0x20:
            n = media[at + 4]
            if n > PACKET - 5:
                raise StreamError(f"adaptation field of packet {number} is too long")
            flags = media[at + 5] if n else 0
            access, announced = bool(flags & 0x40), bool(flags & 0x80)
            s.stuffing += max(0, n - 1 - 6 * bool(flags & 0x10)) if n else 0
            start += 1 + n
        counter, last = control & 15, counters.get(pid)
        if last is not None:
            if control & 0x10 and counter == last and before[pid] >= 0 and media[start:end] == media[before[pid] + start - at : before[pid] + PACKET]:
                s.repeated += 1
                before[pid] = -1
                continue
            if counter != (last + 1 & 15 if control & 0x10 else last):
                if not announced:
                    raise StreamError(f"continuity counter of {pid:#x} jumps in packet {number}")
                s.gaps += 1
        counters[pid], before[pid] = counter, at
        if not control & 0x10:
            continue
        first = bool(head & 0x40)
        if pid in sections:
            s.table_packets += 1
            for section in sections[pid].take(media[start:end], first):
                if pid == PAT_PID:
                    body = _section_body(section, 0)
                    pmts = {(body[i + 2] & 0x1F) << 8 | body[i + 3] for i in range(0, len(body), 4) if body[i] << 8 | body[i + 1]}
                    sections = {p: sections.get(p) or _Sections() for p in (PAT_PID, *pmts)}
                else:
                    body = _section_body(section, 2)
                    i = 4 + ((body[2] & 0xF) << 8 | body[3])
                    while i < len(body):
                        s.streams[(body[i + 1] & 0x1F) << 8 | body[i + 2]] = body[i]
                        i += 5 + ((body[i + 3] & 0xF) << 8 | body[i + 4])
        elif pid in s.streams:
            if first:
                parts.setdefault(pid, []).append([])
                s.units.append((pid, number, None, access))
            elif pid not in parts:
                raise StreamError("elementary data before a unit start")
            parts[pid][-1].append(media[start:end])
    read = {pid: [_pes(b"".join(unit)) for unit in units] for pid, units in parts.items()}
    stamps = {pid: iter(units) for pid, units in read.items()}
    s.units = [(pid, number, next(stamps[pid])[0], access) for pid, number, _, access in s.units]
    s.payloads = {pid: b"".join(data for _, data in units) for pid, units in read.items()}
    return s


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % 64 if raw else 64)


def to_media(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each text as a stored transport stream."""

    def run(batches):
        for b in batches:
            for i, j in slices(b.column(1)):
                rows = [padded(t) for t in b.column(1).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([n for n, _ in rows], pa.int64()), pa.array([write_stream(p) for _, p in rows], pa.binary())], ["doc_id", "n_bytes", "media"])

    return df.select(df[key].cast("long"), df[text]).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """The stored streams of ``to_media`` read back, with payload, timestamps and random-access points."""

    def run(batches):
        for b in batches:
            got = [read_stream(m) for m in b.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s.payload for s in got], pa.binary()), pa.array([s.pts for s in got], pa.list_(pa.int64())), pa.array([s.random_access for s in got], pa.list_(pa.int64())), pa.array([s.feature() for s in got])], ["doc_id", "payload", "pts", "random_access", "feature"])

    return media.mapInArrow(run, "doc_id long, payload binary, pts array<long>, random_access array<long>, feature string")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(media: DataFrame) -> DataFrame:
    """Sizes, hashes and features of stored streams, each parsed."""

    def run(batches):
        for b in batches:
            out = []
            for m in b.column("media"):
                raw = m.as_buffer().to_pybytes()
                payload = (s := read_stream(raw)).payload
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), s.feature()))
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))], [x.split()[0] for x in DIGEST.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)


def media_digest(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store the texts as transport streams in the shared folder, read them back and digest them."""
    return digest(written(to_media(df, text, key), "media", compression="zstd"))
