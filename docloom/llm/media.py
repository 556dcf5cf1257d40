"""Media columns: MPEG transport streams.

``mux`` stores bytes as a transport stream: a program association table, a program
map table and one elementary stream of private data, cut into access units that
each become a packetised elementary packet with a presentation timestamp. Every
access unit begins with a random-access point; tables come again before it.

``demux`` parses stored streams: program tables (with their checksums), continuity
counters, elementary packets and their timestamps, and gives the payload with an
index of access units.

Results for odd input: null media give null columns; media that is no transport
stream give an empty payload, with the bytes that could not be read counted in
``lost_bytes``; duplicates of a packet are dropped as the standard allows; a gap in
a continuity counter is counted and the unit that it hits is marked broken.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped

PACKET, SYNC, PAT_PID = 188, 0x47, 0
PMT_PID, DATA_PID, PROGRAM, PRIVATE_PES, PRIVATE_STREAM_1 = 0x1000, 0x100, 1, 0x06, 0xBD
#: Bytes of payload in an access unit, and the ticks of the 90 kHz clock from one to the next.
UNIT, TICKS = 32_768, 3_600

_COUNTS = ("packets", "programs", "streams", "gaps", "duplicates", "bad_tables", "lost_bytes")
_UNIT = T.StructType([T.StructField(n, t()) for n, t in (("pid", T.IntegerType), ("pts", T.LongType), ("offset", T.LongType), ("size", T.LongType), ("random_access", T.BooleanType), ("broken", T.BooleanType))])
_STREAM = T.StructType([T.StructField("payload", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in _COUNTS), T.StructField("units", T.ArrayType(_UNIT))])


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2; zero over a section with its own checksum."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (5 + len(body) + 4), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc_mpeg(head + body))


_PAT = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
_PMT = _section(2, PROGRAM, struct.pack(">HH", 0xE000 | DATA_PID, 0xF000) + struct.pack(">BHH", PRIVATE_PES, 0xE000 | DATA_PID, 0xF000))


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | counter) + b"\0" + section).ljust(PACKET, b"\xff")


def _timestamp(marker: int, pts: int) -> bytes:
    return struct.pack(">BHH", marker << 4 | (pts >> 29) & 0x0E | 1, (pts >> 14) & 0xFFFE | 1, (pts << 1) & 0xFFFE | 1)


def mux_bytes(payload: bytes, unit: int = UNIT, ticks: int = TICKS) -> bytes:
    """``payload`` as a transport stream. ``unit`` is at most 65,000 bytes, as a packet's length has 16 bits."""
    out: list[bytes] = []
    counter = 0
    for n, start in enumerate(range(0, max(len(payload), 1), unit)):
        data, pts = payload[start : start + unit], n * ticks & 0x1FFFFFFFF
        out.append(_table_packet(PAT_PID, n & 15, _PAT))
        out.append(_table_packet(PMT_PID, n & 15, _PMT))
        pes = b"\0\0\1" + struct.pack(">BHBBB", PRIVATE_STREAM_1, len(data) + 8, 0x84, 0x80, 5) + _timestamp(2, pts) + data
        # random access and the program clock in the unit's first packet
        field = struct.pack(">BBIBB", 7, 0x50, pts >> 1, (pts & 1) << 7 | 0x7E, 0)
        at, flags = 0, 0x4000 | DATA_PID
        while at < len(pes):
            room = PACKET - 4 - len(field)
            piece = pes[at : at + room]
            if (lack := room - len(piece)) > 0:  # stuffing stands in the adaptation field
                if field:
                    field = bytes([field[0] + lack]) + field[1:] + b"\xff" * lack
                else:
                    field = b"\0" if lack == 1 else bytes([lack - 1, 0]) + b"\xff" * (lack - 2)
            out.append(struct.pack(">BHB", SYNC, flags, (0x30 if field else 0x10) | counter) + field + piece)
            at, counter, field, flags = at + len(piece), counter + 1 & 15, b"", DATA_PID
    return b"".join(out)


class Demuxed:
    """What ``demux_bytes`` found in a stream."""

    def __init__(self):
        self.payload = b""
        self.packets = self.programs = self.streams = self.gaps = self.duplicates = self.bad_tables = self.lost_bytes = 0
        self.units: list[tuple] = []


def demux_bytes(media: bytes) -> Demuxed:
    out, end = Demuxed(), len(media)
    last: dict[int, tuple[int, bytes]] = {}
    sections: dict[int, bytearray] = {}
    programs: dict[int, int] = {}
    streams: dict[int, int] = {}
    open_units: dict[int, list] = {}
    payloads: dict[int, list[bytes]] = {}
    sizes: dict[int, int] = {}

    def close(pid: int) -> None:
        if not (unit := open_units.pop(pid, None)):
            return
        data, access, broken = b"".join(unit[0]), unit[1], unit[2]
        if len(data) < 9 or data[:3] != b"\0\0\1":
            out.lost_bytes += len(data)
            return
        length, flags, head = data[4] << 8 | data[5], data[7], data[8]
        pts = None
        if flags & 0x80 and len(data) >= 14:
            pts = (data[9] & 0x0E) << 29 | data[10] << 22 | (data[11] & 0xFE) << 14 | data[12] << 7 | data[13] >> 1
        body = data[9 + head : 6 + length if length else None]
        broken = broken or bool(length) and len(data) < 6 + length
        out.units.append((pid, pts, sizes.get(pid, 0), len(body), access, broken))
        payloads.setdefault(pid, []).append(body)
        sizes[pid] = sizes.get(pid, 0) + len(body)

    def table(pid: int, section: bytes) -> None:
        if crc_mpeg(section):
            out.bad_tables += 1
        elif pid == PAT_PID and section[0] == 0:
            for i in range(8, len(section) - 4, 4):
                number, where = struct.unpack_from(">HH", section, i)
                if number:
                    programs[number] = where & 0x1FFF
        elif section[0] == 2 and pid in programs.values():
            i = 12 + (struct.unpack_from(">H", section, 10)[0] & 0xFFF)
            while i + 5 <= len(section) - 4:
                kind, where, info = struct.unpack_from(">BHH", section, i)
                streams[where & 0x1FFF] = kind
                i += 5 + (info & 0xFFF)

    def in_step(i: int) -> bool:
        return media[i] == SYNC and (i + PACKET >= end or media[i + PACKET] == SYNC)

    at = 0
    while at + PACKET <= end:
        if not in_step(at):  # go on at the next sync byte that another one follows a packet later
            back = media.find(SYNC, at + 1)
            while 0 <= back and not in_step(back):
                back = media.find(SYNC, back + 1)
            step = (back if back >= 0 else end) - at
            out.lost_bytes += step
            at += step
            continue
        packet = media[at : at + PACKET]
        at += PACKET
        out.packets += 1
        flags, control = packet[1] << 8 | packet[2], packet[3]
        pid, begins, counter = flags & 0x1FFF, flags & 0x4000, control & 15
        start, access, jump = 4, False, False
        if control & 0x20:
            start = 5 + packet[4]
            if packet[4]:
                access, jump = bool(packet[5] & 0x40), bool(packet[5] & 0x80)
        if pid == 0x1FFF or not control & 0x10 or start >= PACKET:
            continue
        body = packet[start:]
        if pid in last and not jump:
            before, same = last[pid]
            if counter == before and same == body:
                out.duplicates += 1
                continue
            if counter != (before + 1) & 15:
                out.gaps += 1
                if pid in open_units:
                    open_units[pid][2] = True
                sections.pop(pid, None)
        last[pid] = (counter, body)
        if pid == PAT_PID or pid in programs.values():
            if begins:
                body = body[1 + body[0] :]
                sections[pid] = bytearray()
            if pid in sections:
                sections[pid] += body
                got = sections[pid]
                while len(got) >= 3 and got[0] != 0xFF and len(got) >= (size := 3 + ((got[1] & 15) << 8 | got[2])):
                    table(pid, bytes(got[:size]))
                    del got[:size]
        elif pid in streams:
            if begins:
                close(pid)
                open_units[pid] = [[body], access, False]
            elif pid in open_units:
                open_units[pid][0].append(body)
            else:
                out.lost_bytes += len(body)
        else:
            out.lost_bytes += len(body)  # of no stream that a table names
    out.lost_bytes += end - at
    for pid in list(open_units):
        close(pid)
    out.programs, out.streams = len(programs), len(streams)
    out.payload = b"".join(b"".join(payloads[pid]) for pid in sorted(payloads))
    return out


def mux(df: DataFrame, payload: str, out: str = "media") -> DataFrame:
    """``df`` with a binary column ``out``, in place of one of that name: ``payload`` as a transport stream (null: null)."""

    @F.arrow_udf("binary")
    def run(payloads: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in payloads:
            yield mapped(batch, pa.binary(), mux_bytes)

    return df.withColumn(out, run(F.col(payload)))


def demux(df: DataFrame, media: str = "media", out: str = "stream") -> DataFrame:
    """``df`` with a struct column ``out``, in place of one of that name: the payload, counts, and the index of access units with timestamps."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(_STREAM)

    def row(x: bytes) -> dict:
        d = demux_bytes(x)
        return {"payload": d.payload, "units": [dict(zip(_UNIT.names, u, strict=True)) for u in d.units]} | {k: getattr(d, k) for k in _COUNTS}

    @F.arrow_udf(_STREAM)
    def run(streams: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in streams:
            yield mapped(batch, kind, row)

    return df.withColumn(out, run(F.col(media)))


def padded(payload: F.Column, unit: int = 64) -> F.Column:
    """Bytes, with bytes 0 after them up to a positive multiple of ``unit``."""
    size = F.octet_length(payload)
    lack = F.when(size == 0, unit).otherwise(F.pmod(-size, F.lit(unit)))
    return F.concat(payload, F.substring(F.lit(bytes(unit)), F.lit(1), lack))


def op9_media(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as a transport stream and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    stored = mux(docs.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), padded(F.col("raw")).alias("payload")), "payload").drop("payload")
    back, s = demux(stored), F.col("stream")
    unit = s["units"]
    feature = F.concat_ws(
        ";", F.lit("ts"), F.concat(F.lit("packets="), s["packets"]), F.concat(F.lit("programs="), s["programs"]), F.concat(F.lit("streams="), s["streams"]), F.concat(F.lit("gaps="), s["gaps"]),
        F.concat(F.lit("units="), F.size(unit)), F.concat(F.lit("access_points="), F.size(F.filter(unit, lambda u: u["random_access"]))), F.concat(F.lit("last_pts="), F.element_at(unit, -1)["pts"]), F.concat(F.lit("lost="), s["lost_bytes"]),
    )
    return back.select(
        "doc_id", "n_bytes", F.octet_length(s["payload"]).cast("long").alias("payload_bytes"), F.sha2(s["payload"], 256).alias("payload_sha256"), F.crc32(F.substring(s["payload"], -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
