"""Very long texts in suffix dedup: named in pieces, as if whole, in memory that a bound on bytes tells."""

import random
import tracemalloc

import numpy as np
import pytest

from lumenquad.llm.suffix_dedup import PIECE, Anchors, spans_of, suffix_dedup

FIELDS = ("lo", "hi", "q", "core", "whole")


def texts():
    r = np.random.default_rng(3)
    yield r.integers(0, 256, 9_000, dtype=np.uint8).tobytes()
    yield r.integers(0, 2, 6_000, dtype=np.uint8).tobytes()
    yield b"x" * 3_000 + b"ab" * 1_000 + b"\0" * 700
    yield r.integers(0, 256, 200, dtype=np.uint8).tobytes()
    yield r.integers(0, 256, 1_001, dtype=np.uint8).tobytes() * 4


@pytest.mark.parametrize("piece", [200, 201, 333, 1_024])
def test_pieces_make_no_difference(piece):
    for raw in texts():
        a, b = Anchors(raw, 200, 104), Anchors(raw, 200, 104, piece)
        assert all((getattr(a, f) == getattr(b, f)).all() for f in FIELDS)
        # The longer names count only where a window on their side of the turn holds them.
        early, late = a.lo <= a.q - a.half, a.hi > a.q - a.half
        assert (a.early[early] == b.early[early]).all() and (a.late[late] == b.late[late]).all()


def test_memory_of_a_long_text():
    raw = np.random.default_rng(5).integers(0, 256, 24 << 20, dtype=np.uint8).tobytes()
    tracemalloc.start()
    try:
        a = Anchors(raw, 200, 104)
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(a.q) < len(raw) / 40 and held < 3 * len(raw) and peak < 3 * len(raw) + 128 * PIECE


def test_spans_of_equals_plain_python():
    r = random.Random(8)
    for _ in range(300):
        width = r.randrange(1, 6)
        starts = np.array([r.random() < 0.3 for _ in range(r.randrange(0, 30))], bool)
        gone = np.zeros(len(starts) + width, bool)
        for i in np.flatnonzero(starts):
            gone[i : i + width] = True
        edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
        assert spans_of(starts, len(gone), width) == list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


@pytest.mark.parametrize("split", [4096, 1])
def test_passages_over_the_cuts_of_a_long_text(spark, split):
    """Passages that lie over the cuts of one long text, or far apart in it, go; nothing else does."""
    r = np.random.default_rng(7)
    letters = lambda n: bytes(r.integers(97, 123, n, dtype=np.uint8))
    long, inside = bytearray(letters(3 * PIECE + 5_000)), letters(700)
    over = [bytes(long[k * PIECE - 300 : k * PIECE + 260]) for k in (1, 2)]
    for at in (40_000, 2 * PIECE + 90_000):
        long[at : at + 700] = inside
    rows = [(0, long.decode()), *((k, f"<{p.decode()}>") for k, p in enumerate(over, 1)), (3, over[0][:199].decode())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_dedup(df, split=split, chunk_bytes=PIECE // 2).collect()}
    assert got == {0: (2 * 560 + 2 * 700, 4), 1: (560, 1), 2: (560, 1), 3: (0, 0)}
