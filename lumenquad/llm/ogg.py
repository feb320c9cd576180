"""Media columns in Ogg: bytes as 8-bit samples in pages, and back again with every check the container offers.

`stored` writes one physical stream a row. The payload is cut into frames of 576 samples, dealt in turn to two logical
streams (tracks) of their own clocks; each starts with a header packet on a page of its own. Packets flow over page
borders: a page ends with its last lacing value, not with a packet. `read` takes such a column (or any Ogg bytes) and
verifies each page's checksum, version and sequence, reassembles packets from lacing values (255: it goes on), tells
logical streams apart by serial number, and derives each packet's time from its page's granule position: the last packet
that ends on a page ends there, and those before it end where the next begins. A frame's place in the payload follows
from its time and track alone.

Both are one pass over rows where they lie, no shuffle; a row's bytes are held about four times (text, pages, payload).

Defined cases: a null or empty text is one frame of the byte 255 with n_bytes 0; a text whose length is a positive
multiple of the frame gets no padding; very long texts are whole, in one row; repeated rows are rows of their own and
equal texts have equal values; a null doc_id stays null; an empty table gives no rows; other columns are ignored,
whatever their names. Bytes that fail a check give nulls and the reason in `error`; null media is such a case.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32, pieces, text_bytes

FRAME, TRACKS, RATE, PAD = 576, 2, 8000, b"\xff"
#: Lacing values of a page here (255 at most); no multiple of a frame's three, so that packets go on over borders.
SEGMENTS = 32
#: Fixed values of the container: page header, flags, the granule position of a page on which no packet ends.
PAGE = struct.Struct("<4sBBqIIIB")
CAPTURE, CONTINUED, BEGIN, END, NONE_ENDS = b"OggS", 1, 2, 4, -1
#: Header packet of a track: mark, track, tracks, rate, frame, bytes of the text.
HEADER = struct.Struct("<8sBBIHQ")
MARK = b"\x01pcm-u8\0"

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def checksum(*parts: bytes) -> int:
    """The container's CRC-32: the usual polynomial, highest bit first, from 0, without a final complement.

    Bit for bit it mirrors zlib's, which starts at and ends with a complement.
    """
    crc = 0xFFFFFFFF
    for part in parts:
        crc = zlib.crc32(part.translate(_REVERSED), crc)
    return int.from_bytes((crc ^ 0xFFFFFFFF).to_bytes(4, "little").translate(_REVERSED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = PAGE.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing))
    return head[:22] + checksum(head, lacing, body).to_bytes(4, "little") + head[26:] + lacing + body


def pages_of(packets: Iterable[bytes], serial: int, segments: int = SEGMENTS) -> Iterator[bytes]:
    """Pages of one logical stream: its first packet (the header) alone, then the others; a granule is a sample (byte)."""
    packets = iter(packets)
    header = next(packets)
    held: tuple | None = None  # the last page but its end flag
    number, granule, ends = 1, 0, False
    lacing, body, continued = bytearray(), [], 0
    first = page(BEGIN, 0, serial, 0, b"\xff" * (len(header) // 255) + bytes([len(header) % 255]), header)
    for packet in packets:
        left, at, begun = len(packet) // 255 + 1, 0, False
        while left:
            if len(lacing) == segments:
                if first:
                    yield first
                    first = b""
                yield page(continued, granule if ends else NONE_ENDS, serial, number, bytes(lacing), b"".join(body))
                number, ends, continued = number + 1, False, CONTINUED if begun else 0
                lacing, body = bytearray(), []
            take = min(left, segments - len(lacing))
            begun = True
            if take == left:
                lacing += b"\xff" * (take - 1) + bytes([len(packet) % 255])
                body.append(packet[at:])
                granule, ends = granule + len(packet), True
            else:
                lacing += b"\xff" * take
                body.append(packet[at : at + 255 * take])
                at += 255 * take
            left -= take
    held = (continued | END, granule if ends else NONE_ENDS, serial, number, bytes(lacing), b"".join(body))
    if first and not lacing:  # nothing but a header
        first = page(BEGIN | END, 0, serial, 0, b"\xff" * (len(header) // 255) + bytes([len(header) % 255]), header)
    if first:
        yield first
    if lacing:
        yield page(*held)


def encode(raw: bytes) -> bytes:
    """A text's bytes, padded to frames, as the pages of all tracks in turn; each track's first page comes before others."""
    size = max(1, -(-len(raw) // FRAME)) * FRAME
    payload = raw + PAD * (size - len(raw))
    serial = crc32(payload) & ~(TRACKS - 1)

    def track(t: int) -> Iterator[bytes]:
        yield HEADER.pack(MARK, t, TRACKS, RATE, FRAME, len(raw))
        for at in range(t * FRAME, size, TRACKS * FRAME):
            yield payload[at : at + FRAME]

    streams = [pages_of(track(t), serial + t) for t in range(TRACKS)]
    out = []
    while streams:
        going = []
        for s in streams:
            if (p := next(s, None)) is not None:
                out.append(p)
                going.append(s)
        streams = going
    return b"".join(out)


@dataclass
class Packet:
    serial: int
    number: int
    data: bytes
    #: First sample by the granule position; None for a header.
    start: int | None


@dataclass
class _Stream:
    sequence: int = 0
    packets: int = 0
    open: list[bytes] = field(default_factory=list)
    going_on: bool = False
    ended: bool = False


@dataclass
class Reader:
    """Packets of all logical streams in the order in which they end; counts pages as it goes."""

    raw: bytes
    pages: int = 0
    streams: dict[int, _Stream] = field(default_factory=dict)

    def __iter__(self) -> Iterator[Packet]:
        at, raw = 0, self.raw
        while at < len(raw):
            if len(raw) - at < PAGE.size:
                raise OggError("a page header is cut off")
            capture, version, flags, granule, serial, sequence, crc, n = PAGE.unpack_from(raw, at)
            if capture != CAPTURE or version:
                raise OggError("no page where one should begin")
            lacing = raw[at + PAGE.size : at + PAGE.size + n]
            begin = at + PAGE.size + n
            end = begin + sum(lacing)
            if len(lacing) < n or end > len(raw):
                raise OggError("a page is cut off")
            if checksum(raw[at : at + 22], b"\0\0\0\0", raw[at + 26 : end]) != crc:
                raise OggError(f"checksum of page {self.pages}")
            yield from self._page(flags, granule, serial, sequence, lacing, raw[begin:end])
            at, self.pages = end, self.pages + 1
        if any(not s.ended or s.going_on for s in self.streams.values()):
            raise OggError("a stream has no end")

    def _page(self, flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> list[Packet]:
        if flags & BEGIN:
            if serial in self.streams:
                raise OggError("a stream begins twice")
            self.streams[serial] = _Stream()
        s = self.streams.get(serial)
        if s is None or s.ended:
            raise OggError("a page outside its stream")
        if sequence != s.sequence:
            raise OggError(f"page {s.sequence} of a stream is missing")
        if bool(flags & CONTINUED) != s.going_on:
            raise OggError("a packet goes on where none is open, or the other way round")
        s.sequence, s.ended = sequence + 1, bool(flags & END)
        done, at, size = [], 0, 0
        for value in lacing:
            size += value
            if value < 255:
                done.append(b"".join([*s.open, body[at : at + size]]) if s.open else body[at : at + size])
                s.open = []
                at, size = at + size, 0
        s.going_on = bool(lacing) and lacing[-1] == 255
        if s.going_on:
            s.open.append(body[at:])
        if not done:
            if granule != NONE_ENDS and lacing:
                raise OggError("a granule position where no packet ends")
            return []
        out, end = [], granule
        for k in range(len(done) - 1, -1, -1):
            number = s.packets + k
            out.append(Packet(serial, number, done[k], end - len(done[k]) if number else None))
            end -= len(done[k]) if number else 0
        if end < 0 or granule < 0:
            raise OggError("packets begin before their stream")
        s.packets += len(done)
        return out[::-1]


def decode(raw: bytes) -> tuple[bytes, dict[str, int]]:
    """The payload, and what the container and the samples tell: counts, times in microseconds, loudness."""
    reader = Reader(raw)
    tracks: dict[int, int] = {}
    frames: list[tuple[int, int, bytes]] = []
    header = None
    for p in reader:
        if p.start is None:
            if len(p.data) != HEADER.size or p.data[:8] != MARK:
                raise OggError("a header of another kind")
            _, track, *header = HEADER.unpack(p.data)
            tracks[p.serial] = track
        else:
            frames.append((p.start, tracks[p.serial], p.data))
    if header is None:
        raise OggError("no stream")
    count, rate, frame, n_bytes = header
    if sorted(tracks.values()) != list(range(count)):
        raise OggError("tracks are missing")
    payload = bytearray(len(frames) * frame)
    places = set()
    for start, track, data in frames:
        at = start * count + track * frame
        if start % frame or len(data) != frame or at >= len(payload) or at in places:
            raise OggError("a frame out of its time")
        places.add(at)
        payload[at : at + frame] = data
    payload = bytes(payload)
    samples = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    energy = np.einsum("ij,ij->i", *[samples.reshape(-1, frame).astype(np.int64)] * 2)
    loudest = int(energy.argmax())
    told = {
        "n_bytes": n_bytes, "streams": len(tracks), "pages": reader.pages, "packets": len(frames) + len(tracks),
        "end_us": max(start + frame for start, *_ in frames) * 1_000_000 // rate, "loudest_us": loudest // count * frame * 1_000_000 // rate,
        "energy": int(energy.sum()), "peak": int(energy[loudest]), "crossings": int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0))),
    }
    return payload, told


def stored(docs: DataFrame) -> DataFrame:
    """doc_id and media, the Ogg bytes of each row's text: a column to be written as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            media = [encode(raw) for raw in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def features_of(raw: bytes | None) -> dict[str, object]:
    if raw is None:
        return {"error": "no media"}
    out: dict[str, object] = {"media_bytes": len(raw), "media_sha256": hashlib.sha256(raw).hexdigest()}
    try:
        payload, told = decode(raw)
    except OggError as e:
        return out | {"error": str(e)}
    return out | {
        "n_bytes": told.pop("n_bytes"), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": crc32(payload[-32:]),
        "feature": " ".join(f"{k}={v}" for k, v in told.items()),
    }


def read(media: DataFrame) -> DataFrame:
    """What is read back of each row's media, or why it can't be read."""
    kinds = {name: pa.string() if kind == "string" else pa.int64() for name, kind in (c.split() for c in FEATURES.split(", "))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            rows = [features_of(m) for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r.get(k) for r in rows], kind) for k, kind in kinds.items() if k != "doc_id")], names=list(kinds))

    return media.select("doc_id", "media").mapInArrow(run, FEATURES)


def op13_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(stored(spark.read.parquet(f"{sf_dir}/documents.parquet")))
