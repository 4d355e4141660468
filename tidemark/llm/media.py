"""Media columns in Ogg: multiplexing writer, checking reader, features.

The writer lays logical streams of packets out in pages (lacing values, granule positions, page numbers, checksums)
and interleaves them. The reader verifies the checksum and number of each page, reassembles packets from lacing
values across pages, demultiplexes the logical streams by serial number, and derives a packet's time from the granule
position of the page on which it ends.

A text is stored as two streams: `samples`, unsigned 8-bit mono PCM at 8,000 Hz in packets of `PACKET` samples, whose
granule position is the number of samples so far, and `marks`, one packet of 8 bytes (first sample, level) per sample
packet, whose granule position is the sample at which the packet starts.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal values in all columns but doc_id;
each row is handled alone, whatever the id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import batch_rows, table

RATE = 8000
PACKET = 4000
UNIT = 64
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """The container's CRC-32 (polynomial 0x04C11DB7, most significant bit first, no inversions) by way of zlib's, which is its mirror image."""
    x = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_MIRROR), "big")


def pages(packets: list[tuple[bytes, int]], serial: int) -> list[tuple[int, bytes]]:
    """(granule for the order of interleaving, page) of one logical stream of (packet, granule position)."""
    segments: list[tuple[bytes, int, bool]] = []  # data, granule, ends a packet
    for data, granule in packets:
        for at in range(0, len(data) + 1, 255):
            part = data[at : at + 255]
            segments.append((part, granule, len(part) < 255))
    out, going, order = [], False, 0
    for number, at in enumerate(range(0, len(segments), 255)):
        mine = segments[at : at + 255]
        ended = [g for _, g, end in mine if end]
        order = ended[-1] if ended else order
        last = at + 255 >= len(segments)
        head = struct.pack("<4sBBqIII", b"OggS", 0, going | 2 * (at == 0) | 4 * last, ended[-1] if ended else -1, serial, number, 0) + bytes([len(mine), *(len(d) for d, _, _ in mine)])
        body = head + b"".join(d for d, _, _ in mine)
        out.append((-1 if at == 0 else order, body[:22] + struct.pack("<I", page_crc(body)) + body[26:]))
        going = not mine[-1][2]
    return out


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """All streams' pages in the order of time, first pages first."""
    found = [(granule, serial, k, page) for serial, packets in streams.items() for k, (granule, page) in enumerate(pages(packets, serial))]
    return b"".join(x[3] for x in sorted(found, key=lambda x: x[:3]))


def demux(data: bytes, rate: int = RATE) -> dict[int, list[tuple[bytes, int | None, float | None]]]:
    """By serial number: (packet, granule position, seconds); position and time are those of the page if the packet is the last that ends there, else None."""
    out: dict[int, list] = {}
    part: dict[int, list[bytes]] = {}
    number: dict[int, int] = {}
    at = 0
    while at < len(data):
        magic, version, flags, granule, serial, n, crc, count = struct.unpack_from("<4sBBqIIIB", data, at)
        if magic != b"OggS" or version:
            raise ValueError("not an Ogg page")
        lacing = data[at + 27 : at + 27 + count]
        body = at + 27 + count
        end = body + sum(lacing)
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"checksum of page {n} of stream {serial}")
        if n != number.get(serial, -1) + 1 or bool(flags & 2) != (n == 0) or bool(flags & 1) != bool(part.get(serial)):
            raise ValueError(f"page {n} of stream {serial} is out of order")
        number[serial] = n
        packets, open_ = out.setdefault(serial, []), part.setdefault(serial, [])
        ended = len(packets)
        for size in lacing:
            open_.append(data[body : body + size])
            body += size
            if size < 255:
                packets.append((b"".join(open_), None, None))
                open_.clear()
        if len(packets) > ended and granule >= 0:
            packets[-1] = (packets[-1][0], granule, granule / rate)
        at = end
    if any(part.values()):
        raise ValueError("a packet does not end")
    return out


def store(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as samples and marks; serial numbers follow from the payload."""
    serial = zlib.crc32(payload)
    other = serial ^ 1
    samples, marks, at = [(b"\x80pcm8" + struct.pack("<II", rate, 1), 0)], [(b"\x80mark" + struct.pack("<I", rate), 0)], 0
    for at in range(0, len(payload), PACKET):
        part = payload[at : at + PACKET]
        samples.append((part, at + len(part)))
        marks.append((struct.pack("<II", at, sum(part) // len(part)), at))
    return mux({serial: samples, other: marks})


def load(data: bytes) -> tuple[bytes, list[tuple[int, int]], float, int]:
    """Samples, marks, duration in seconds and number of packets, of what store() wrote."""
    streams = demux(data)
    main = next(p for p in streams.values() if p[0][0][:5] == b"\x80pcm8")
    marks = next(p for p in streams.values() if p[0][0][:5] == b"\x80mark")
    return b"".join(p for p, _, _ in main[1:]), [struct.unpack("<II", p) for p, _, _ in marks[1:]], main[-1][2] or 0.0, sum(map(len, streams.values()))


def feature(samples: bytes, marks: list[tuple[int, int]], seconds: float, packets: int) -> str:
    """Duration, packets, mean, deviation, zero crossings about the middle level, and the loudest mark."""
    x = np.frombuffer(samples, np.uint8)
    levels = np.bincount(x, minlength=256)
    total, value = len(x), np.arange(256)
    mean = int((levels * value).sum()) / total
    spread = max(0.0, int((levels * value * value).sum()) / total - mean * mean) ** 0.5
    crossings = int(np.count_nonzero((x[1:] < 128) != (x[:-1] < 128)))
    loudest = max(marks, key=lambda m: (m[1], -m[0]))
    return f"seconds={seconds:.6f};packets={packets};mean={mean:.6f};deviation={spread:.6f};crossings={crossings};loudest={loudest[0]}:{loudest[1]}"


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(docs: DataFrame) -> DataFrame:
    def work(batches):
        for b in batches:
            rows = []
            for i, doc_id in enumerate(b.column(0).to_pylist()):
                text = (b.column(1)[i].as_py() or "").encode()
                data = store(text + bytes(-len(text) % UNIT if text else UNIT))
                samples, marks, seconds, packets = load(data)
                rows.append((doc_id, len(text), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples, marks, seconds, packets)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (3, 6, 7) else pa.int64()) for k, c in enumerate(cols)], names=[x.split()[0] for x in OUT.split(", ")])

    batch_rows(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(work, OUT)


def op9_ogg_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
