"""Media columns: payloads as MPEG transport streams, and what a parser reads back from them.

``pack`` writes a payload as one private elementary stream: access units of ``UNIT`` bytes, each a PES packet with a
presentation timestamp, cut into 188-byte packets; program tables are repeated before every random-access point.
``unpack`` follows the program tables to the stream, checks section CRCs and continuity counters, reassembles the PES
packets and lists timestamps with their random-access flags.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKET, BODY = 188, 184
PMT_PID, STREAM_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 0x06, 0xBD
UNIT = 4096  # payload bytes of an access unit
TICKS = 3600  # 90 kHz ticks between access units
GROUP = 8  # every GROUP-th access unit is a random-access point


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


_PAT = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (b"\x47" + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | counter & 15, 0]) + section).ljust(PACKET, b"\xff")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def pack(payload: bytes) -> bytes:
    """The payload as a transport stream; an empty payload gives the program tables alone."""
    out, counter, tables = [], 0, 0
    if not payload:
        return _table_packet(0, _PAT, 0) + _table_packet(PMT_PID, _PMT, 0)
    for n, at in enumerate(range(0, len(payload), UNIT)):
        access = n % GROUP == 0
        if access:
            out += [_table_packet(0, _PAT, tables), _table_packet(PMT_PID, _PMT, tables)]
            tables += 1
        unit = payload[at : at + UNIT]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(n * TICKS & (1 << 33) - 1) + unit
        pos = 0
        while pos < len(pes):
            first = pos == 0
            flags = b"\x40" if access and first else b""
            room = BODY - (1 + len(flags) if flags else 0)
            part = pes[pos : pos + room]
            pos += len(part)
            if len(part) < room or flags:
                size = BODY - 1 - len(part)
                field = b"" if size == 0 else (flags or b"\x00").ljust(size, b"\xff")
                out.append(b"\x47" + ((0x4000 if first else 0) | STREAM_PID).to_bytes(2, "big") + bytes([0x30 | counter, size]) + field + part)
            else:
                out.append(b"\x47" + ((0x4000 if first else 0) | STREAM_PID).to_bytes(2, "big") + bytes([0x10 | counter]) + part)
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """An elementary stream: its program's number, its PID and type, the PES packets' bodies and their timestamps."""

    program: int
    pid: int
    stream_type: int
    units: list[bytes] = field(default_factory=list)
    stamps: list[tuple[int, bool]] = field(default_factory=list)  # presentation time, random access
    pes: list[bytes] | None = None  # the open PES packet
    access: bool = False


@dataclass
class Parsed:
    """All elementary streams in the order of the program tables; the properties tell of the first one."""

    streams: list[Stream] = field(default_factory=list)
    programs: dict[int, int] = field(default_factory=dict)  # number -> PID of its table
    gaps: int = 0  # continuity counters that don't follow
    errors: int = 0  # lost synchronisation, broken packets, sections or PES packets

    @property
    def first(self) -> Stream | None:
        order = list(self.programs)
        return min(self.streams, key=lambda s: (order.index(s.program) if s.program in self.programs else len(order)), default=None)

    @property
    def payload(self) -> bytes:
        return b"".join(self.first.units) if self.first else b""

    @property
    def program(self) -> int | None:
        return self.first.program if self.first else next(iter(self.programs), None)

    @property
    def pid(self) -> int | None:
        return self.first.pid if self.first else None

    @property
    def stream_type(self) -> int | None:
        return self.first.stream_type if self.first else None

    @property
    def stamps(self) -> list[tuple[int, bool]]:
        return self.first.stamps if self.first else []


#: Stream ids whose PES packets have no header beyond the length (ISO/IEC 13818-1).
PLAIN_IDS = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))


class _Demultiplexer:
    def __init__(self, media: bytes):
        self.media, self.out = media, Parsed()
        self.last: dict[int, tuple[int, bytes, bool]] = {}  # counter, packet, whether it has been repeated
        self.sections: dict[int, bytearray] = {}  # open sections of program table PIDs
        self.tables: dict[int, int] = {}  # PID of a program table -> program number
        self.by_pid: dict[int, Stream] = {}
        self.known: dict[bytes, bool] = {}  # sections that were checked

    def synchronised(self, at: int) -> int:
        """The first place from ``at`` on where packets follow each other, else the end."""
        media = self.media
        while (at := media.find(b"\x47", at)) >= 0:
            if all(media[x] == 0x47 for x in (at + PACKET, at + 2 * PACKET) if x < len(media)):
                return at
            at += 1
        return len(media)

    def run(self) -> Parsed:
        media, at = self.media, 0
        while at < len(media):
            if media[at] != 0x47:
                self.out.errors += 1
                at = self.synchronised(at)
                continue
            if at + PACKET > len(media):
                self.out.errors += 1
                break
            self.packet(media[at : at + PACKET])
            at += PACKET
        for s in self.out.streams:
            self.close(s)
        return self.out

    def packet(self, p: bytes) -> None:
        pid, control, start = (p[1] & 0x1F) << 8 | p[2], p[3], 4
        if pid == 0x1FFF:
            return
        if p[1] & 0x80 or control & 0xC0:  # damaged on the way, or scrambled
            self.out.errors += 1
            return
        jump = access = False
        if control & 0x20:
            start += 1 + p[4]
            if start > PACKET or start == PACKET and control & 0x10:
                self.out.errors += 1
                return
            if p[4]:
                jump, access = bool(p[5] & 0x80), bool(p[5] & 0x40)
        if not control & 0x10:
            return
        counter = control & 15
        if pid in self.last and not jump:
            before, same, twice = self.last[pid]
            if counter == before and not twice and same == p:
                self.last[pid] = (counter, p, True)  # one repeat of a packet is legal
                return
            if counter != before + 1 & 15:
                self.out.gaps += 1
                self.sections.pop(pid, None)
        self.last[pid] = (counter, p, False)
        begins, body = bool(p[1] & 0x40), p[start:]
        if pid in self.by_pid:
            stream = self.by_pid[pid]
            if begins:
                self.close(stream)
                stream.pes, stream.access = [], access
            if stream.pes is not None:
                stream.pes.append(body)
        elif pid == 0 or pid in self.tables:
            self.section_bytes(pid, begins, body)

    def section_bytes(self, pid: int, begins: bool, body: bytes) -> None:
        """Sections may begin anywhere in a packet and go on over several."""
        if begins:
            skip = 1 + body[0]
            if skip > len(body):
                self.out.errors += 1
                self.sections.pop(pid, None)
                return
            if pid in self.sections:
                self.sections[pid] += body[1:skip]
                self.sections_of(pid)
            if self.sections.pop(pid, None):
                self.out.errors += 1  # a section that its packets don't complete
            self.sections[pid] = bytearray(body[skip:])
        elif pid in self.sections:
            self.sections[pid] += body
        self.sections_of(pid)

    def sections_of(self, pid: int) -> None:
        while (held := self.sections.get(pid)) is not None:
            if held[:1] in (b"", b"\xff"):  # stuffing up to the next beginning
                del self.sections[pid]
                return
            size = 3 + (int.from_bytes(held[1:3], "big") & 0xFFF) if len(held) >= 3 else PACKET
            if len(held) < size:
                return
            section = bytes(held[:size])
            del held[:size]
            if section not in self.known:
                self.known[section] = size >= 12 and section_crc(section) == 0
            if not self.known[section]:
                self.out.errors += 1
            elif pid == 0 and section[0] == 0:
                self.program_list(section)
            elif pid and section[0] == 2:
                self.program_table(pid, section)

    def program_list(self, section: bytes) -> None:
        for at in range(8, len(section) - 7, 4):
            number, pid = int.from_bytes(section[at : at + 2], "big"), int.from_bytes(section[at + 2 : at + 4], "big") & 0x1FFF
            if number:  # 0 names the network table
                self.out.programs[number] = pid
                self.tables[pid] = number

    def program_table(self, pid: int, section: bytes) -> None:
        number, end = int.from_bytes(section[3:5], "big"), len(section) - 4
        at = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
        while at + 5 <= end:
            kind, own = section[at], int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF
            if own not in self.by_pid and own not in self.tables and own:
                self.by_pid[own] = Stream(number, own, kind)
                self.out.streams.append(self.by_pid[own])
            at += 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0xFFF)
        if at != end:
            self.out.errors += 1

    def close(self, stream: Stream) -> None:
        if not stream.pes:
            return
        whole, stream.pes = b"".join(stream.pes), None
        if len(whole) < 6 or whole[:3] != b"\x00\x00\x01":
            self.out.errors += 1
            return
        length = int.from_bytes(whole[4:6], "big")
        end = 6 + length if length else len(whole)  # length 0: up to the next packet
        start = 6 if whole[3] in PLAIN_IDS else 9 + whole[8] if len(whole) > 8 else end + 1
        if start > end or start > len(whole):
            self.out.errors += 1
            return
        if len(whole) < end:
            self.out.errors += 1
        if whole[3] not in PLAIN_IDS and whole[7] & 0x80:
            b = whole[9:14]
            if start >= 14 and b[0] & 1 and b[2] & 1 and b[4] & 1:
                stream.stamps.append(((b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1, stream.access))
            else:
                self.out.errors += 1
        stream.units.append(whole[start:end])


def unpack(media: bytes | None) -> Parsed:
    """Parse a transport stream of any writer; damage is counted, never raised. Null and empty streams give an empty payload.

    Synchronisation is found again after foreign bytes; a packet that comes twice counts once; a set discontinuity
    indicator starts the counter anew; sections may span packets; all programs' streams are read.
    """
    return _Demultiplexer(media or b"").run()


def payload_of(text: str | None, multiple: int = 64) -> tuple[int, bytes]:
    """Length of the UTF-8 bytes (null: 0), and these padded by 0 to a positive multiple of ``multiple``."""
    raw = (text or "").encode("utf-8")
    size = max(1, -(-len(raw) // multiple)) * multiple
    return len(raw), raw.ljust(size, b"\x00")


@F.pandas_udf(T.BinaryType())
def _pack_texts(texts: pd.Series) -> pd.Series:
    return pd.Series([pack(payload_of(t)[1]) for t in texts], dtype=object)


FEATURES = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("program", T.IntegerType()),
        T.StructField("pid", T.IntegerType()),
        T.StructField("stream_type", T.IntegerType()),
        T.StructField("pts", T.ArrayType(T.LongType())),
        T.StructField("random_access", T.ArrayType(T.BooleanType())),
        T.StructField("gaps", T.LongType()),
        T.StructField("errors", T.LongType()),
    ]
)


@F.pandas_udf(FEATURES)
def _read_media(media: pd.Series) -> pd.DataFrame:
    rows = []
    for m in media:
        m = m or b""
        p = unpack(m)
        payload = p.payload
        digests = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest())
        rows.append((*digests, p.program, p.pid, p.stream_type, [t for t, _ in p.stamps], [a for _, a in p.stamps], p.gaps, p.errors))
    return pd.DataFrame(rows, columns=FEATURES.names)


def store_texts(docs: DataFrame, text: str = "text", column: str = "media") -> DataFrame:
    """Add a binary column with each whole text (null: empty) as a transport stream; equal texts give equal streams.

    A column of that name is replaced; all others stay. An empty table gives an empty result.
    """
    return docs.withColumn(column, _pack_texts(F.col(f"`{text}`")))


def read_media(df: DataFrame, media: str = "media", column: str = "stream") -> DataFrame:
    """Add a struct of what the parser finds in a stream column: the first stream of the first program.

    A null stream has an empty payload. A column of that name is replaced; all others stay.
    """
    return df.withColumn(column, _read_media(F.col(f"`{media}`")))


def feature_text(stream: Column) -> Column:
    access = F.filter(F.arrays_zip(stream["pts"].alias("t"), stream["random_access"].alias("a")), lambda x: x["a"])
    return F.concat_ws(
        ";",
        F.concat(F.lit("program="), stream["program"].cast("string")), F.concat(F.lit("pid="), stream["pid"].cast("string")),
        F.concat(F.lit("units="), F.size(stream["pts"]).cast("string")), F.concat(F.lit("last_pts="), F.array_max(stream["pts"]).cast("string")),
        F.concat(F.lit("access="), F.array_join(F.transform(access, lambda x: x["t"].cast("string")), ",")),
        F.concat(F.lit("gaps="), stream["gaps"].cast("string")), F.concat(F.lit("errors="), stream["errors"].cast("string")),
    )
