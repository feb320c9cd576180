"""Shared helpers of the training-data operators: the shared folder, staged tables, words and hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import os
import time
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import new_path, shared_dir, written  # noqa: F401

#: ASCII white space, which separates words (bytes.split() takes the same set), and the symbols that rules count.
SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"


#: Paths of the tables staged in the current scope, where there is one.
_scope: ContextVar[list[str] | None] = ContextVar("staged tables", default=None)


@contextmanager
def scope(paths: list[str]) -> Iterator[None]:
    """Notes in `paths` what is staged inside, for remove() once nothing reads it any more."""
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)


def remove(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_unused(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more, and lets Spark's cleaner drop the shuffle files of finished jobs."""
    for table in tables:
        paths = {path.rsplit("/", 1)[0] for path in table.inputFiles()}
        if (noted := _scope.get()) is not None:
            noted[:] = [x for x in noted if not any(p.endswith(x.split("://")[-1].lstrip("/")) for p in paths)]
        remove(spark, list(paths))
    for _ in range(2):  # plans stay alive in Python's cycles, and a while in the events that tell of their end
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.7)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, which cuts its lineage.

    The files outlive lost executors. They stay until the folder is cleared or their scope removed: a lazy result may
    read them late.
    """
    path = new_path(df.sparkSession, name)
    if (paths := _scope.get()) is not None:
        paths.append(path)
    return written(df, path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The rows of a string column as UTF-8 bytes; null reads as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of a sequence of word hashes; fewer words: the whole sequence as one."""
    if not len(h):
        return np.empty(0, np.uint64)
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def crc32(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; TOKENIZER_DIR overrides the installed package."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_BYTE_NAMES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


#: Bytes whose words are hashed at once; longer texts are cut between words.
STRETCH = 1 << 20


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each; up to STRETCH are kept per worker."""
    if _powers and len(_powers[0]) >= n:
        return _powers
    size = max(1 << 17, n)
    found = [np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)), dtype=np.uint64) for b in (_BASE, _BASE_INVERSE)]
    if size <= STRETCH + 1:
        _powers[:] = found
    return found


def stretches_of(raw: bytes) -> Iterator[bytes]:
    """A text in parts of about STRETCH bytes, cut after white space; a longer word stays whole."""
    at = 0
    while at < len(raw):
        end = at + STRETCH
        if end < len(raw):
            end = max(raw.rfind(x, at, end) for x in map(chr_byte, SPACES)) + 1 or _next_space(raw, end)
        yield raw[at:end] if at or end < len(raw) else raw
        at = end


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, a stretch at a time."""
    parts = [_hashes_of(x) for x in stretches_of(raw)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64)


def chr_byte(x: int) -> bytes:
    return bytes([x])


def _next_space(raw: bytes, at: int) -> int:
    found = [i for i in (raw.find(x, at) for x in map(chr_byte, SPACES)) if i >= 0]
    return min(found) if found else len(raw)


def _hashes_of(raw: bytes) -> np.ndarray:
    """Hashes of words as differences of prefix sums of a polynomial over the bytes."""
    if not raw:
        return np.empty(0, np.uint64)
    a = np.frombuffer(raw + b" ", np.uint8)
    edge = np.diff(_SPACE[a].view(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers_to(len(a))
    sums = np.cumsum(_BYTE_NAMES[a] * up[: len(a)], dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return mix((sums[ends - 1] - before) * down[starts] + (ends - starts).astype(np.uint64))


def trim() -> None:
    """Gives freed memory back to the system, as idle Python workers stay alive beside the next ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(f: Callable) -> Callable:
    """A function of a group of rows that frees memory once it's done."""

    @functools.wraps(f)
    def run(*tables: pa.Table) -> pa.Table:
        out = f(*tables)
        trim()
        return out

    # Spark tells functions with a key from those without by their arguments.
    run.__signature__ = inspect.signature(f)
    return run


def pieces(batches: Iterable[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterable[pa.RecordBatch]:
    """The batches cut into slices of about `most` bytes of text in the given column, which bounds what a step holds."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if z > a:
                yield b.slice(a, z - a)
    trim()
