"""Packed blocks: sorted 64-bit names of one chunk of rows, cut by bucket, so that a shuffle moves a few large rows.

A chunk asks for its names bucket by bucket; the task of a bucket sees each name once a chunk at most (a hot name is
summed up where it arises) and answers every block in the order of its names. Buckets may be up to 2**31; once there are
as many as names in a chunk, a block holds a name or so and the shuffle is that of plain rows.
"""

from __future__ import annotations

import numpy as np
import zstandard


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each name, floor(name * buckets / 2**64): buckets hold equal ranges of names."""
    n, low = np.uint64(buckets), np.uint64(0xFFFFFFFF)
    high = names >> np.uint64(32)
    return ((high * n + ((names & low) * n >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)


def cut(names: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the sorted names, without empty buckets; linear in the names, whatever the buckets."""
    if not len(names):
        return []
    bucket = bucket_of(names, buckets)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    return list(zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(names)], strict=True))


def pack(names: np.ndarray) -> bytes:
    """Differences of sorted names, byte planes apart: the upper planes are zeros that compress away."""
    return np.diff(names, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, len(raw) // 8)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def squeeze(raw: bytes) -> bytes:
    """Entropy-coded bytes: small numbers and bits take a fraction of what the shuffle's own codec leaves of them."""
    return zstandard.ZstdCompressor(level=1).compress(raw)


def loosen(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def find(names: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Place of each sought name in sorted names, -1 where it's absent."""
    if not len(names):
        return np.full(len(sought), -1)
    at = np.minimum(np.searchsorted(names, sought), len(names) - 1)
    return np.where(names[at] == sought, at, -1)
