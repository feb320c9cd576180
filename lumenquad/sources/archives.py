"""Zip archives as a source: their members by range reads of the central directory, and members' bytes on demand.

format("zip_index") lists archives on the driver and makes each a partition, whose task reads the archive's last bytes
for the end record (its zip64 form as well) and then the central directory alone, in ranges of a megabyte. Archives lie
on any file system that pyarrow can open, or behind http(s) where the server answers range requests. One that can't be
read gives a row with its error and no member. `extracted` reads members of such an index back, checked.
"""

from __future__ import annotations

import struct
import urllib.request
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Records of the format with their marks and the lengths before names.
END, END64, LOCATOR, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
END_RECORD, LOCATOR_RECORD, END64_RECORD, ENTRY_RECORD, LOCAL_RECORD = (struct.Struct(x) for x in ("<4s4H2IH", "<4sIQI", "<4sQ2H2I4Q", "<4s6H3I5H2I", "<4s5H3I2H"))
FULL16, FULL32, ZIP64_FIELD, UTF8_NAMES, ENCRYPTED = 0xFFFF, 0xFFFFFFFF, 1, 0x800, 1
STORED, DEFLATED = 0, 8

INDEX = "zip string, pos long, member string, size long, packed long, method int, crc long, at long, error string"
RANGE = 1 << 20

#: Reads n bytes (fewer at the end) from a place.
Read = Callable[[int, int], bytes]


class ZipError(ValueError):
    pass


def opened(uri: str) -> tuple[Read, int]:
    """Range reads of a file, and its size."""
    if uri.startswith(("http://", "https://")):

        def fetch(at: int, n: int) -> bytes:
            if n <= 0:
                return b""
            request = urllib.request.Request(uri, headers={"Range": f"bytes={at}-{at + n - 1}"})
            with urllib.request.urlopen(request, timeout=60) as answer:
                if answer.status != 206:
                    raise ZipError("the server answers no range requests")
                return answer.read()

        with urllib.request.urlopen(urllib.request.Request(uri, method="HEAD"), timeout=60) as answer:
            return fetch, int(answer.headers["Content-Length"])
    system, path = _system(uri)
    file = system.open_input_file(path)

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return read, file.size()


def _system(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    uri = f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return arrow_fs.FileSystem.from_uri(uri) if "://" in uri else (arrow_fs.LocalFileSystem(), uri)


def directory(read: Read, size: int) -> tuple[int, int, int, int]:
    """Place, length and entries of the central directory, and how far offsets are shifted by bytes in front."""
    tail_at = max(0, size - END_RECORD.size - FULL16)
    tail = read(tail_at, size - tail_at)
    # The last record whose comment ends with the file; else (bytes behind the archive) the last that can be one.
    at = maybe = -1
    found = tail.rfind(END)
    while found >= 0 and at < 0:
        if found + END_RECORD.size <= len(tail):
            comment = END_RECORD.unpack_from(tail, found)[-1]
            room = len(tail) - found - END_RECORD.size - comment
            at = found if room == 0 else -1
            maybe = found if room > 0 and maybe < 0 else maybe
        found = tail.rfind(END, 0, found)
    at = at if at >= 0 else maybe
    if at < 0:
        raise ZipError("no end record")
    *_, entries, length, start, _ = END_RECORD.unpack_from(tail, at)
    end_at = tail_at + at
    # The zip64 record stands before its locator, and that before the end record, whether needed or not.
    locator_at = end_at - LOCATOR_RECORD.size
    raw = read(locator_at, LOCATOR_RECORD.size) if locator_at >= 0 else b""
    if len(raw) == LOCATOR_RECORD.size and raw[:4] == LOCATOR:
        # Bytes in front of the archive shift it; it's then sought right before the locator.
        for place in (LOCATOR_RECORD.unpack(raw)[2], locator_at - END64_RECORD.size):
            record = read(place, END64_RECORD.size) if 0 <= place < size else b""
            if record[:4] == END64 and len(record) == END64_RECORD.size:
                break
        else:
            raise ZipError("no zip64 end record")
        *_, entries, length, start = END64_RECORD.unpack(record)
        end_at = place
    shift = end_at - length - start
    if shift < 0:
        raise ZipError("a central directory of impossible length")
    return start + shift, length, entries, shift


def members(read: Read, size: int) -> Iterator[tuple]:
    """(pos, member, size, packed, method, crc, place of the local header) of each entry, folders left out."""
    at, length, entries, shift = directory(read, size)
    end, held, base = at + length, b"", 0
    for pos in range(entries):
        # Entries are met in order: what is held moves on by a range once less than an entry's greatest length is left.
        if len(held) - base < ENTRY_RECORD.size + 3 * FULL16 and at < end:
            fresh = read(at, min(RANGE, end - at))
            held, base, at = held[base:] + fresh, 0, at + len(fresh)
        if len(held) - base < ENTRY_RECORD.size or held[base : base + 4] != ENTRY:
            raise ZipError(f"entry {pos} of {entries} is broken")
        _, _, _, flags, method, _, _, crc, packed, plain, n_name, n_extra, n_comment, _, _, _, start = ENTRY_RECORD.unpack_from(held, base)
        name_at = base + ENTRY_RECORD.size
        name, extra = held[name_at : name_at + n_name], held[name_at + n_name : name_at + n_name + n_extra]
        base = name_at + n_name + n_extra + n_comment
        if base > len(held):
            raise ZipError(f"entry {pos} of {entries} is cut off")
        plain, packed, start = _wide(extra, plain, packed, start)
        text = name.decode("utf-8" if flags & UTF8_NAMES else "cp437", "replace")
        if not text.endswith("/"):
            yield pos, text, plain, packed, -1 if flags & ENCRYPTED else method, crc, start + shift


def _wide(extra: bytes, *values: int) -> list[int]:
    """Sizes and place with those that don't fit 32 bits from the zip64 field, which holds just these, in order."""
    out, at = list(values), 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == ZIP64_FIELD:
            place = at + 4
            for k, v in enumerate(values):
                if v == FULL32 and place + 8 <= at + 4 + n:
                    (out[k],) = struct.unpack_from("<Q", extra, place)
                    place += 8
            break
        at += 4 + n
    return out


def member_bytes(read: Read, at: int, packed: int, size: int, method: int, crc: int) -> bytes:
    """A member's content, checked. Its own header tells where the bytes begin."""
    head = read(at, LOCAL_RECORD.size)
    if len(head) < LOCAL_RECORD.size or head[:4] != LOCAL:
        raise ZipError("no member where the index says")
    n_name, n_extra = LOCAL_RECORD.unpack(head)[-2:]
    raw = read(at + LOCAL_RECORD.size + n_name + n_extra, packed)
    if method not in (STORED, DEFLATED):
        raise ZipError("an encryption or a method that isn't read")
    try:
        out = zlib.decompress(raw, -15) if method == DEFLATED else raw
    except zlib.error as e:
        raise ZipError(str(e)) from e
    if len(out) != size or zlib.crc32(out) != crc:
        raise ZipError("a member's checksum")
    return out


def listed(path: str, prefix: str = "") -> list[str]:
    """The archives of a folder by name, or what a comma-separated list names."""
    out = []
    for part in filter(None, (p.strip() for p in path.split(","))):
        if part.endswith(".zip"):
            out.append(part)
            continue
        system, folder = _system(part)
        scheme = part[: len(part) - len(folder)] if part.endswith(folder) else ""
        found = system.get_file_info(arrow_fs.FileSelector(folder.rstrip("/")))
        out += [scheme + f.path for f in found if f.type == arrow_fs.FileType.File and f.base_name.startswith(prefix) and f.base_name.endswith(".zip")]
    return sorted(out)


class ZipIndexReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.prefix = options["path"], options.get("prefix", "")

    def partitions(self) -> list[InputPartition]:
        # No archives are one partition without rows: Spark would read None as a partition instead.
        return [InputPartition(x) for x in listed(self.path, self.prefix)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        uri = partition.value
        if uri is None:
            return
        try:
            for pos, *rest in members(*opened(uri)):
                yield (uri, pos, *rest, None)
        except (OSError, ZipError, struct.error) as e:
            yield (uri, *[None] * 7, f"{type(e).__name__}: {e}")


class ZipIndexSource(DataSource):
    """format("zip_index") with load(path): a folder of archives (option prefix: of what names), or a list of them."""

    @classmethod
    def name(cls) -> str:
        return "zip_index"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ZipIndexReader(self.options)


def extracted(index: DataFrame) -> DataFrame:
    """Rows of an index with `content` (null and an error where it can't be read). Group rows by archive to open it once."""
    schema = T.StructType([*[f for f in index.schema.fields if f.name != "error"], T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, read = None, None
        for batch in batches:
            for k in range(batch.num_rows):  # a member at a time is held
                row = batch.slice(k, 1)
                r = row.to_pylist()[0]
                content, error = None, r.get("error")
                if r["member"] is not None:
                    try:
                        if uri != r["zip"]:
                            read, uri = opened(r["zip"])[0], r["zip"]
                        content = member_bytes(read, r["at"], r["packed"], r["size"], r["method"], r["crc"])
                    except (OSError, ZipError, struct.error) as e:
                        error = f"{type(e).__name__}: {e}"
                columns = [row.column(i) for i, f in enumerate(row.schema) if f.name != "error"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], names=schema.names)

    return index.mapInArrow(run, schema)
