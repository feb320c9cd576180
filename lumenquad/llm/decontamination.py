"""Benchmark decontamination by SimHash windows.

Every item is a fingerprint of BITS bits over its word shingles; every window of a document that is as long as an item
gets one, too. Fingerprints are cut into blocks of BLOCK bits, and the index holds the blocks of all items of a length.
Two fingerprints within the radius differ in at most `radius` blocks, so they agree on all others: items that agree with
a window on fewer blocks than that are ruled out, all within the radius are found. Candidates within the radius are
then compared by exact weighted similarity of shingles (sum of the least counts over sum of the greatest). The radius is
four standard deviations above the distance expected at the threshold. One agreeing block, as in a plain multi-index,
would rule out next to nothing: at 0.8 the radius is a fifth of the bits. Unlike texts agree on a sixteenth of the
blocks, and the count asks for over an eighth.

Windows without any shingle of an item of their length can't be similar at all and are not fingerprinted. The items
go to the tasks as broadcasts of bounded size, one pass over the documents each; a larger benchmark takes more passes.

Words are compared without case and ASCII punctuation.

Defined cases: null, empty and wordless texts match nothing, nor do such items; an item of fewer words than a shingle
is one shingle; a document shorter than an item is one window; very long texts are read in stretches of SEGMENT words
that overlap by the longest item, and windows in stretches of RUN, so memory doesn't grow with the windows; of windows
of equal similarity the first counts; repeated documents are matched each; of an id's several texts the best match
counts, so an item is found once a document; empty tables give no rows,
or keep all documents; clashing column names of the benchmark never meet those of the documents.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import find
from .common import mix, pieces, shingle_hashes, stretches_of, text_bytes, word_hashes

BITS = 512
BLOCK = 4
SHINGLE = 5
SLICE_BYTES = 16 << 20
SEGMENT = 1 << 18  # words
RUN = 1 << 11  # windows
U = np.uint64
PLAIN = bytes(i if chr(i).isalnum() or i >= 128 else 32 for i in range(256))


def words_of(raw: bytes) -> np.ndarray:
    """Hashes of the words without case (Unicode) and ASCII punctuation."""
    return word_hashes(raw.decode("utf-8", "replace").lower().encode().translate(PLAIN))


def words_in_parts(raw: bytes) -> Iterator[np.ndarray]:
    """words_of a text, a stretch of a megabyte or so at a time, cut at white space."""
    for part in stretches_of(raw):
        yield words_of(part)


def bits_of(shingles: np.ndarray) -> np.ndarray:
    """BITS columns of +1 or -1 for each shingle."""
    seeds = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * U(0xC2B2AE3D27D4EB4F))
    wide = mix(shingles[:, None] + seeds)
    return np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def blocks_of(prints: np.ndarray) -> np.ndarray:
    """Values of the blocks of each fingerprint (rows of bits)."""
    weights = (1 << np.arange(BLOCK)).astype(np.uint8)
    return (prints.reshape(len(prints), -1, BLOCK) * weights).sum(2, dtype=np.uint8)


def radius_for(threshold: float) -> int:
    """Bits by which texts of this weighted similarity differ at most, but for four standard deviations."""
    p = math.acos(min(1.0, 2 * threshold / (1 + threshold))) / math.pi
    return math.ceil(BITS * p + 4 * math.sqrt(BITS * p * (1 - p)))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    at = find(b[0], a[0])
    least = np.minimum(a[1][at >= 0], b[1][at[at >= 0]]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


class Items:
    """Fingerprints of benchmark items by length, with the index of their blocks."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float):
        self.threshold, self.radius = threshold, radius_for(threshold)
        self.agreeing = max(1, BITS // BLOCK - self.radius)
        groups = defaultdict(list)
        for item, raw in items:
            h = words_of(raw)
            if len(h):
                groups[len(h)].append((item, shingle_hashes(h, SHINGLE)))
        self.by_length = {}
        for n, group in groups.items():
            prints = np.stack([self.total(s) > 0 for _, s in group])
            counts = [np.unique(s, return_counts=True) for _, s in group]
            known = np.unique(np.concatenate([s for _, s in group]))
            self.by_length[n] = ([i for i, _ in group], prints, counts, blocks_of(prints), known)
        self.longest = max(self.by_length, default=1)
        self.widths = {n: min(n, SHINGLE) for n in self.by_length}
        every = [g[4] for n, g in self.by_length.items() if self.widths[n] == SHINGLE]
        self.known = np.unique(np.concatenate(every)) if every else np.empty(0, U)
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.known & U((1 << 22) - 1)).astype(np.int64)] = True
        self.lengths_of = {}  # lengths of the items that hold a known shingle
        for n, g in self.by_length.items():
            for s in g[4] if self.widths[n] == SHINGLE else ():
                self.lengths_of.setdefault(int(s), []).append(n)

    @staticmethod
    def total(shingles: np.ndarray) -> np.ndarray:
        """Sum of the bits of many shingles, some at a time."""
        parts = (bits_of(shingles[a : a + RUN]).sum(0, dtype=np.int64) for a in range(0, len(shingles), RUN))
        return sum(parts, np.zeros(BITS, np.int64))

    def windows(self, h: np.ndarray, last_of: Callable[[int], int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, shingles and window starts worth a fingerprint, for each length of item; last_of: the last start."""
        s = shingle_hashes(h, SHINGLE)
        hits = np.flatnonzero(self.sieve[(s & U((1 << 22) - 1)).astype(np.int64)])
        hits = hits[find(self.known, s[hits]) >= 0]
        by_length = defaultdict(list)
        for i in hits:
            for n in self.lengths_of[int(s[i])]:
                by_length[n].append(i)
        for n, k in self.widths.items():
            last = last_of(n)
            if k < SHINGLE:
                t = shingle_hashes(h, k)
                at = np.flatnonzero(find(self.by_length[n][4], t) >= 0)
                if len(at := at[at <= last]):
                    yield n, t, at
            elif n in by_length:
                at = np.array(by_length[n])
                at = at[at <= last + n - k]
                mark = np.zeros(last + 2, np.int32)
                np.add.at(mark, np.clip(at - (n - k), 0, last), 1)
                np.add.at(mark, np.minimum(at, last) + 1, -1)
                if len(starts := np.flatnonzero(np.cumsum(mark[:-1]) > 0)):
                    yield n, s, starts

    def candidates(self, n: int, own: np.ndarray) -> list[np.ndarray]:
        """For each fingerprint (row of bits): places of the items of this length that agree on enough blocks."""
        index, blocks = self.by_length[n][3], blocks_of(own)
        step = max(1, (32 << 20) // index.size)
        out = []
        for a in range(0, len(blocks), step):
            agree = (blocks[a : a + step, None, :] == index).sum(2)
            out += [np.flatnonzero(x >= self.agreeing) for x in agree]
        return out

    def prints_of(self, shingles: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and fingerprints of windows of `size` shingles, for runs of starts at most RUN apart."""
        cuts = [0]
        for i in range(1, len(starts)):
            if starts[i] - starts[cuts[-1]] >= RUN:
                cuts.append(i)
        for a, b in zip(cuts, [*cuts[1:], len(starts)], strict=True):
            first, reach = int(starts[a]), int(starts[b - 1] - starts[a])
            sums = np.empty((reach + 1, BITS), np.int64)
            sums[0] = self.total(shingles[first : first + size])
            if reach:  # a window follows from the one before by what leaves and what enters
                leaves, enters = bits_of(shingles[first : first + reach]), bits_of(shingles[first + size : first + size + reach])
                np.cumsum(enters.astype(np.int64) - leaves, axis=0, out=sums[1:])
                sums[1:] += sums[0]
            yield starts[a:b], sums[starts[a:b] - first] > 0

    def of(self, raw: bytes) -> list[tuple[int, int, int, float]]:
        """Items found in a text: item, first word, words, similarity of the best window."""
        if not self.by_length:
            return []
        best: dict[int, tuple[int, int, int, float]] = {}
        held, before = np.empty(0, U), 0
        for h in words_in_parts(raw):
            held = np.append(held, h) if len(held) else h
            while len(held) >= SEGMENT + self.longest:
                self.search(held[: SEGMENT + self.longest - 1], before, lambda n: SEGMENT - 1, best)
                held, before = held[SEGMENT:], before + SEGMENT
        if len(held):
            n_words = len(held)
            if before:  # a part of a text: what is shorter than an item here is no window of its own
                self.search(held, before, lambda n: n_words - n, best)
            else:  # a document shorter than an item is one window
                self.search(held, 0, lambda n: max(0, n_words - n), best)
        return sorted(best.values())

    def search(self, h: np.ndarray, before: int, last_of: Callable[[int], int], best: dict) -> None:
        for n, shingles, starts in self.windows(h, lambda n: max(-1, last_of(n))):
            ids, prints, counts, _, _ = self.by_length[n]
            size = min(n - self.widths[n] + 1, len(shingles))
            for at, own in self.prints_of(shingles, starts, size):
                for w, c in enumerate(self.candidates(n, own)):
                    for i in c[(prints[c] != own[w]).sum(1) <= self.radius] if len(c) else ():
                        start = int(at[w])
                        sim = similarity(np.unique(shingles[start : start + size], return_counts=True), counts[i])
                        if sim >= self.threshold and (ids[i] not in best or sim > best[ids[i]][3]):
                            best[ids[i]] = (ids[i], before + start, min(n, len(h)), sim)


#: The index that this worker built last, by the number of its broadcast.
_built: dict[tuple[str, float], Items] = {}


def index_of(items: Broadcast, threshold: float) -> Items:
    key = (str(items._jbroadcast) if items._jbroadcast is not None else items._path, threshold)
    if key not in _built:
        _built.clear()
        _built[key] = Items(items.value, threshold)
    return _built[key]


def slices(benchmark: DataFrame) -> Iterator[Broadcast]:
    """The items in parts of about SLICE_BYTES each, one on the driver at a time; executors fetch what they need.

    They are dealt by id, so that texts of one id are judged together, in one slice as in several.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / SLICE_BYTES))
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        yield benchmark.sparkSession.sparkContext.broadcast([(r.item_id, r.text.encode()) for r in part.collect()])


FOUND = "doc_id long, item_id long, start_word long, n_words long, similarity double"


def search(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window of each document for each item found in it."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    names = [x.split()[0] for x in FOUND.split(", ")]
    found = None
    for items in slices(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = index_of(items, threshold)
            for b in pieces(batches, 1):
                texts = zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True)
                rows = [(d, *m) for d, raw in texts for m in index.of(raw)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        part = docs.mapInArrow(run, FOUND)
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents, all columns, in which no item is found."""
    place = [f.name for f in docs.schema.fields].index("text")
    for items in slices(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = index_of(items, threshold)
            for b in pieces(batches, place):
                yield b.filter(pa.array([not index.of(raw) for raw in text_bytes(b.column(place))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
