"""Exact removal of repeated byte strings by distributed prefix doubling on anchors.

Names of strings are doubled inside each text: the name of 2h bytes at a place comes from the names of h bytes there
and h further on, as far as the threshold. A place is compared over the corpus only while its name isn't unique:

1. Each window of `width` bytes has an anchor, the least 32-byte name among its first `span` places, so equal windows
   have anchors at equal offsets. Spark compares the anchors' names of width - span bytes, and beside them the names of
   all windows of an anchor together. Anchors with a unique name drop out, and with them their windows; anchors whose
   windows are all found elsewhere together are settled. One row a chunk and bucket of names is shuffled, not one a byte.
2. What is left lies at the edges of repeats. Its bytes, and one witness of each settled group, go by the names of the
   next longer strings, one before and one after the anchor, and there the single windows of `width` bytes are
   compared by theirs. Where more than `split` anchors share a name, the chunks ask for the windows' names instead, each
   once a chunk, dealt to tasks by name: no passage is one task, however many texts share it.
3. Documents with windows found in step 2 get their final spans.

Names are 64-bit fingerprints, and two of them must agree for a window to be settled: results are exact but for a
clash of both. A chunk is a run of rows of at most CHUNK_ROWS and, but for a single longer text, `chunk_bytes`.

Defined cases: null text counts as empty; texts shorter than the window keep all; very long texts are named a
piece at a time, and some numbers an anchor are held of them; of tied anchor names the leftmost counts; repeated rows are
repeats of one another; an empty table gives no rows; other columns come along, and those called like a result column are
replaced. A cut inside a character drops its remaining bytes from `kept_text`, not from the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .common import mix, pieces, remove_unused, shuffle_width, staged, text_bytes, trimmed

GRAM = 32
CHUNK_ROWS = 4096
PIECE = 1 << 20  # window starts whose bytes are named at a time
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
U = np.uint64


def step(x: np.ndarray, offset: int) -> np.ndarray:
    """Names of the strings made of the string named at each place and that named `offset` further on."""
    y = x[:-offset] * U(0x9E3779B97F4A7C15) + x[offset:] * U(0xC2B2AE3D27D4EB4F) + U(offset)
    y ^= y >> U(29)
    y *= U(0xBF58476D1CE4E5B9)
    y ^= y >> U(32)
    return y


def names_of(raw: bytes, lengths: list[int]) -> dict[int, np.ndarray]:
    """Names of all substrings of each length (ascending) by doubling."""
    x, h, out = (np.frombuffer(raw, np.uint8).astype(np.uint64) + U(1)) * U(0x9FB21C651E98DF25), 1, {}
    for n in lengths:
        while 2 * h <= n:
            x, h = step(x, h), 2 * h
        out[n] = x if h == n else step(x, n - h)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    h = 1
    while 2 * h <= width:
        x, h = np.minimum(x[:-h], x[h:]), 2 * h
    return x if h == width else np.minimum(x[: len(x) - (width - h)], x[width - h :])


class Anchors:
    """Anchors q of one text with the first and last window start lo, hi of each, and their names.

    Bytes are named `piece` window starts at a time, so what is held of a long text is some numbers an anchor, not a byte.
    """

    def __init__(self, raw: bytes, width: int, span: int, piece: int = PIECE):
        assert width <= piece < (1 << 24) - span
        self.half = span // 2
        starts = len(raw) - width + 1
        parts = [list(self.part(raw, a, min(a + piece, starts), width, span)) for a in range(0, starts, piece)]

        def column() -> np.ndarray:
            """The parts' next array; theirs are let go, so that two columns are never held twice."""
            return np.concatenate([p.pop(0) for p in parts])

        # An anchor on both sides of a cut is one: it starts with the first side and ends with the second.
        q = column()
        again = np.append(False, q[1:] == q[:-1])
        first, last = ~again, np.append(~again[1:], True)
        self.q = q[first]
        del q, again
        self.lo, self.hi, self.core = column()[first], column()[last], column()[first]
        self.early, self.late = column()[first], column()[last]
        left, right = column()[first], column()[last]
        places = ((self.q - self.lo) * 1024 + self.hi - self.lo).astype(np.uint64)
        self.whole = mix(mix(left + U(7)) + right * U(0x9E3779B97F4A7C15) + places)

    def part(self, raw: bytes, a: int, b: int, width: int, span: int) -> tuple[np.ndarray, ...]:
        """Anchors of the windows that start in a .. b - 1, and the names of the first and last window of each."""
        core, half = width - span, self.half
        names = names_of(raw[a : b + width - 1], sorted({GRAM, core, core + half, width}))
        n = b - a
        # 40 bits of the 32-byte name and the place: the least is the leftmost of the least names.
        packed = (names[GRAM][: n + span - 1] & ~U(0xFFFFFF)) | np.arange(n + span - 1, dtype=np.uint64)
        low = (sliding_min(packed, span) & U(0xFFFFFF)).astype(np.int64)
        lo = np.flatnonzero(np.diff(low, prepend=-1))
        hi, q = np.append(lo[1:], n) - 1, low[lo]
        # Windows that start at least `half` before the anchor share the longer string that starts `half` before it;
        # the others share the longer string that starts at it. A string beyond the part belongs to no window in it.
        whole, longer = names[width], names[core + half]
        early, late = longer[np.maximum(q - half, 0)], longer[np.minimum(q, len(longer) - 1)]
        return q + a, lo + a, hi + a, names[core][q], early, late, whole[lo], whole[hi]


def prepared(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """docs as a table with a number for each row and its chunk, called by the number of its first row."""
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "_sd_rid", "_sd_chunk")
    docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    at = docs.columns.index("text")
    kind = T.StructType([*docs.schema.fields, *T._parse_datatype_string("_sd_rid long, _sd_chunk long").fields])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = chunk = TaskContext.get().partitionId() << 33
        held = 0
        for batch in pieces(batches, at):
            chunks = []
            for size in pc.binary_length(batch.column(at)).to_pylist():
                if row > chunk and (row - chunk == CHUNK_ROWS or held + size > chunk_bytes):
                    chunk, held = row, 0
                chunks.append(chunk)
                row, held = row + 1, held + size
            rows = pa.array(np.arange(row - batch.num_rows, row))
            yield pa.RecordBatch.from_arrays([*batch.columns, rows, pa.array(chunks, pa.int64())], names=kind.fieldNames())

    return staged(docs.mapInArrow(number, kind), "suffix-input")


def chunk_names(anchors: list[Anchors]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct names of a chunk, and how often each arises in it, as a power of two that is no less."""
    every = np.concatenate([x for a in anchors for x in (a.core, a.whole)]) if anchors else np.empty(0, np.uint64)
    names, counts = np.unique(every, return_counts=True)
    return names, doublings(counts)


def doublings(counts: np.ndarray) -> np.ndarray:
    """The least power of two, as its exponent, that is no less than each count; 0 below 1."""
    return np.ceil(np.log2(np.maximum(counts, 1))).astype(np.uint8)


def compare_names(table: DataFrame, width: int, span: int, buckets: int, split: int) -> DataFrame:
    """For each block of names of a chunk: bits that tell which arise elsewhere, and which are first here.

    `dealt` tells which names arise more than `split` times; there is none where the block has no such name.

    Where a file of the table is split, several tasks may read rows of one chunk. Each run of rows that follow one another
    in a task asks for itself, and `part`, its first row, tells the answers of a chunk apart.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, part, last, found = None, None, None, []

        def done():
            names, times = chunk_names(found)
            parts = blocks.cut(names, buckets)
            columns = {
                "bucket": pa.array([p[0] for p in parts], pa.int32()),
                "chunk": pa.array([chunk] * len(parts), pa.int64()),
                "part": pa.array([part] * len(parts), pa.int64()),
                "names": pa.array([blocks.pack(names[a:b]) for _, a, b in parts], pa.binary()),
                "times": pa.array([blocks.squeeze(times[a:b].tobytes()) for _, a, b in parts], pa.binary()),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for batch in pieces(batches, 2):
            for k, rid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                if k != chunk or rid != last + 1:
                    if found:
                        yield done()
                    chunk, part, found = k, rid, []
                last = rid
                if len(raw) >= width:
                    found.append(Anchors(raw, width, span))
        if found:
            yield done()

    @trimmed
    def answer(group: pa.Table) -> pa.Table:
        group = group.sort_by([("chunk", "ascending"), ("part", "ascending")])
        parts = [blocks.unpack(x) for x in group.column("names").to_pylist()]
        times = np.concatenate([np.frombuffer(blocks.loosen(t), np.uint8) for t in group.column("times").to_pylist()])
        names = np.concatenate(parts)
        assert len(times) == len(names)
        order = np.argsort(names, kind="stable")
        new = np.append(True, names[order[1:]] != names[order[:-1]])
        total = np.add.reduceat(U(1) << times[order].astype(np.uint64), np.flatnonzero(new))[np.cumsum(new) - 1]
        again, first, deal = (np.empty(len(names), bool) for _ in range(3))
        again[order], first[order], deal[order] = total > 1, new, total > split
        at = np.cumsum([0, *map(len, parts)])
        cuts = list(zip(at, at[1:], strict=False))
        bits = [np.packbits(np.concatenate([again[a:b], first[a:b]])).tobytes() for a, b in cuts]
        dealt = [np.packbits(deal[a:b]).tobytes() if deal[a:b].any() else None for a, b in cuts]
        return pa.table({k: group.column(k) for k in ("chunk", "part", "bucket")} | {"bits": pa.array(bits, pa.binary()), "dealt": pa.array(dealt, pa.binary())})

    asked = table.select("_sd_chunk", "_sd_rid", "text").mapInArrow(ask, "bucket int, chunk long, part long, names binary, times binary")
    return asked.groupBy("bucket").applyInArrow(answer, "chunk long, part long, bucket int, bits binary, dealt binary")


def spans_of(starts: np.ndarray, n: int, width: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows at the given starts (a mask)."""
    change = np.flatnonzero(np.diff(np.asarray(starts, bool), prepend=False, append=False))
    first, last = change[::2], change[1::2] - 1
    if not len(first):
        return []
    new = np.append(True, first[1:] - last[:-1] > width)
    return [(int(a), int(b) + width) for a, b in zip(first[new], last[np.append(new[1:], True)], strict=True)]


def outcome(raw: bytes, starts: np.ndarray, width: int) -> tuple[int, int, int, str, bytes]:
    kept, at, removed, spans = [], 0, 0, spans_of(starts, len(raw), width)
    for a, b in spans:
        kept.append(raw[at:a])
        at, removed = b, removed + b - a
    left = b"".join([*kept, raw[at:]])
    return len(raw), removed, len(spans), hashlib.sha256(left).hexdigest(), left


def window_names(edges: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start in the row's bytes and name of each window of the edges. The name tells its place beside the anchor too."""
    raw = edges.column("bytes").to_pylist()
    key = edges.column("key").to_numpy().view(np.uint64)
    n = np.array([len(r) - width + 1 for r in raw], np.int64)
    each = np.array([len(r) for r in raw], np.int64)
    at = np.cumsum(each) - each
    window = names_of(b"".join(raw), [width])[width]
    row = np.repeat(np.arange(len(raw)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    q = edges.column("q").to_numpy()
    return row, place, mix(window[at[row] + place] ^ mix(key[row] + (q[row] - place).astype(np.uint64)))


def ranges(edges: pa.Table, row: np.ndarray, place: np.ndarray) -> pa.Table:
    """Runs of window starts in texts, from rows of the edges and starts in their bytes, in order."""
    place = place + edges.column("at").to_numpy()[row]
    cut = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(place, prepend=-9) != 1))
    last = np.append(cut[1:], len(row)) - 1 if len(cut) else cut
    rid = edges.column("rid").take(pa.array(row[cut])).combine_chunks()
    return pa.table({"rid": rid, "lo": pa.array(place[cut], pa.int32()), "hi": pa.array(place[last], pa.int32())})


def distinct(name: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs of name and check, as their first places, with the pair of each place and how often it arises."""
    order = np.lexsort((check, name))
    new = np.append(True, (np.diff(name[order]) != 0) | (np.diff(check[order]) != 0))[: len(order)]
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    return order[new], pair, np.bincount(pair, minlength=int(new.sum()))


def compare_dealt(edges: DataFrame, width: int, buckets: int) -> DataFrame:
    """Windows that arise more than once among edges (rid, chunk, key, at, q, witness, bytes) beside frequent names.

    A chunk asks for each window's name once, with 32 more bits of the longer name as a check. The task of a bucket of
    names answers with those that arise elsewhere, or twice in the chunk. `times`: 0 for witnesses alone, 2 for twice.
    """

    def named(edges: pa.Table) -> tuple[np.ndarray, ...]:
        row, place, name = window_names(edges, width)
        key, q = edges.column("key").to_numpy().view(np.uint64), edges.column("q").to_numpy()
        check = (mix(key[row] * U(0x9E3779B97F4A7C15) + (q[row] - place).astype(np.uint64)) >> U(32)).astype(np.uint32)
        return row, place, name, check, edges.column("witness").to_numpy(zero_copy_only=False)[row]

    @trimmed
    def ask(group: pa.Table) -> pa.Table:
        _, _, name, check, witness = named(group)
        at, pair, counts = distinct(name, check)
        own = np.bincount(pair[~witness], minlength=len(at)) > 0
        times = np.where(own, np.minimum(counts, 2), 0).astype(np.uint8)
        name, check = name[at], check[at]
        parts = blocks.cut(name, buckets)
        columns = {
            "bucket": pa.array([p for p, _, _ in parts], pa.int32()),
            "chunk": pa.array([group.column("chunk")[0].as_py()] * len(parts), pa.int64()),
            "names": pa.array([blocks.pack(name[a:b]) for _, a, b in parts], pa.binary()),
            "checks": pa.array([check[a:b].tobytes() for _, a, b in parts], pa.binary()),
            "times": pa.array([times[a:b].tobytes() for _, a, b in parts], pa.binary()),
        }
        return pa.table(columns)

    @trimmed
    def answer(group: pa.Table) -> pa.Table:
        names = [blocks.unpack(x) for x in group.column("names").to_pylist()]
        name = np.concatenate(names)
        check, times = (np.frombuffer(b"".join(group.column(k).to_pylist()), t) for k, t in (("checks", np.uint32), ("times", np.uint8)))
        # A pair is in a chunk's list once: it arises more than once if it is in two lists or twice in one.
        _, pair, lists = distinct(name, check)
        again = ((lists[pair] > 1) | (times > 1)) & (times > 0)
        at = np.cumsum([0, *map(len, names)])
        found = [a + np.flatnonzero(again[a:b]) for a, b in zip(at, at[1:], strict=False)]
        said = {"names": [blocks.pack(name[i]) for i in found], "checks": [check[i].tobytes() for i in found]}
        said = pa.table({"chunk": group.column("chunk")} | {k: pa.array(v, pa.binary()) for k, v in said.items()})
        return said.filter(pa.array([len(i) > 0 for i in found], pa.bool_()))

    @trimmed
    def settle(group: pa.Table, said: pa.Table) -> pa.Table:
        row, place, name, check, witness = named(group)
        if not said.num_rows:
            return ranges(group, row[:0], place[:0])
        again = np.concatenate([blocks.unpack(x) for x in said.column("names").to_pylist()])
        checks = np.frombuffer(b"".join(said.column("checks").to_pylist()), np.uint32)
        order = np.argsort(again, kind="stable")
        at = blocks.find(again[order], name)
        hit = (at >= 0) & (checks[order][at] == check) & ~witness
        return ranges(group, row[hit], place[hit])

    asked = edges.groupBy("chunk").applyInArrow(ask, "bucket int, chunk long, names binary, checks binary, times binary")
    said = asked.groupBy("bucket").applyInArrow(answer, "chunk long, names binary, checks binary")
    return edges.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(settle, "rid long, lo int, hi int")


def suffix_dedup(docs: DataFrame, width: int = 200, span: int = 104, keep_text: bool = False, split: int = 4096, chunk_bytes: int = 16 << 20) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept_sha256 instead of text; with keep_text also kept_text.

    Windows beside names that arise more than `split` times are compared by name, those of others by key; `chunk_bytes`
    bounds the text of a chunk. They change no result.
    """
    assert GRAM <= width - span <= width
    spark = docs.sparkSession
    table = prepared(docs, chunk_bytes)
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_width(spark), size // (span * 1_000_000))  # about four million names a bucket
    other = [f for f in table.schema.fields if f.name not in ("text", "_sd_rid", "_sd_chunk")]
    names = [f.name for f in other]
    answers = compare_names(table, width, span, buckets, split)
    edges_type = "array<struct<key:long,at:int,q:int,witness:boolean,bytes:binary>>"
    first = T.StructType([*other, *T._parse_datatype_string(f"_sd_rid long, _sd_chunk long, {RESULT}, text binary, _sd_starts binary, _sd_edges {edges_type}, _sd_dealt {edges_type}").fields])

    @trimmed
    def settle(rows: pa.Table, bits: pa.Table) -> pa.Table:
        rows = rows.sort_by("_sd_rid")
        raws = text_bytes(rows.column("text"))
        anchors = [Anchors(r, width, span) if len(r) >= width else None for r in raws]
        # Rows before the first part, or after a part that asked for nothing, are shorter than the window.
        firsts = np.unique(bits.column("part").to_numpy())
        part_of = np.searchsorted(firsts, rows.column("_sd_rid").to_numpy(), "right") - 1
        part, bucket, said, deals = (bits.column(k).to_pylist() for k in ("part", "bucket", "bits", "dealt"))
        answer = dict(zip(zip(part, bucket, strict=True), zip(said, deals, strict=True), strict=True))
        assert len(answer) == len(bits), "two answers for one part of a chunk"
        parts = []
        for i, first_row in enumerate(firsts.tolist()):
            known, _ = chunk_names([a for a, p in zip(anchors, part_of, strict=True) if a is not None and p == i])
            flags, deal = np.zeros((2, len(known)), bool), np.zeros(len(known), bool)
            for bucket, a, b in blocks.cut(known, buckets):
                said, deals = answer.pop((first_row, bucket))
                assert len(said) == (2 * (b - a) + 7) // 8, "an answer for other names"
                flags[:, a:b] = np.unpackbits(np.frombuffer(said, np.uint8), count=2 * (b - a)).reshape(2, -1)
                if deals is not None:
                    deal[a:b] = np.unpackbits(np.frombuffer(deals, np.uint8), count=b - a)
            parts.append((known, *flags, deal))
        assert not answer, "an answer for names that nobody has"
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "starts", "edges", "dealt")}
        for raw, a, part in zip(raws, anchors, part_of, strict=True):
            mask, edges, dealt = np.zeros(max(0, len(raw) - width + 1), bool), [], []
            pending = False
            if a is not None:
                known, again, unseen, deal = parts[part]
                whole = blocks.find(known, a.whole)
                core = blocks.find(known, a.core)
                live = again[core]
                settled = again[whole] & live  # two names must arise elsewhere: a clash of one settles nothing
                for j in np.flatnonzero(live):
                    lo, hi = int(a.lo[j]), int(a.hi[j])
                    witness = bool(settled[j])
                    if witness:
                        mask[lo : hi + 1] = True
                        if not unseen[whole[j]]:
                            continue
                        unseen[whole[j]] = False  # one witness is enough
                    pending = pending or not witness
                    q = int(a.q[j])
                    turn = min(max(q - a.half + 1, lo), hi + 1)  # first start that is less than `half` before the anchor
                    into = dealt if deal[core[j]] else edges
                    for key, x, y in ((a.early[j], lo, turn), (a.late[j], turn, hi + 1)):
                        if x < y:
                            piece = raw[x : y - 1 + width]
                            into.append({"key": int(key.view(np.int64)), "at": x, "q": q - x, "witness": witness, "bytes": piece})
            n_bytes, removed, spans, digest, left = outcome(raw, mask, width)
            for k, v in zip(out, (n_bytes, removed, spans, digest, raw if pending else left if keep_text else None, np.packbits(mask).tobytes() if pending else None, edges, dealt), strict=True):
                out[k].append(v)
        columns = {n: rows.column(n) for n in (*names, "_sd_rid", "_sd_chunk")} | {k: pa.array(v, pa.int64()) for k, v in list(out.items())[:3]}
        kind = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32()), ("q", pa.int32()), ("witness", pa.bool_()), ("bytes", pa.binary())]))
        return pa.table(columns | {"kept_sha256": pa.array(out["kept_sha256"], pa.string()), "text": pa.array(out["text"], pa.binary()), "_sd_starts": pa.array(out["starts"], pa.binary()), "_sd_edges": pa.array(out["edges"], kind), "_sd_dealt": pa.array(out["dealt"], kind)})

    settled = staged(table.groupBy("_sd_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(settle, first), "suffix-settled")
    remove_unused(spark, table)

    @trimmed
    def compare_windows(batches: pa.Table) -> pa.Table:
        """All windows of edges and witnesses in one bucket of longer names: which arise more than once."""
        row, place, name = window_names(batches, width)
        witness = batches.column("witness").to_numpy(zero_copy_only=False)[row]
        order = np.argsort(name, kind="stable")
        longer = batches.column("key").to_numpy()[row][order]
        same = (name[order[1:]] == name[order[:-1]]) & (longer[1:] == longer[:-1])
        hit = np.zeros(len(name), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        hit &= ~witness
        return ranges(batches, row[hit], place[hit])

    edges = settled.select(F.col("_sd_rid").alias("rid"), F.explode("_sd_edges").alias("e")).select("rid", "e.*")
    # A text longer than a chunk asks by stretches of that length; which rows ask together changes no answer.
    stretch = F.xxhash64("chunk", F.floor(F.col("e.at") / chunk_bytes))
    dealt = settled.select(F.col("_sd_rid").alias("rid"), F.col("_sd_chunk").alias("chunk"), F.explode("_sd_dealt").alias("e")).withColumn("chunk", stretch)
    edges = edges.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    found = edges.groupBy("bucket").applyInArrow(compare_windows, "rid long, lo int, hi int")
    found = found.unionByName(compare_dealt(dealt.select("rid", "chunk", "e.*"), width, buckets))
    found = found.groupBy(F.col("rid").alias("_sd_rid")).agg(F.collect_list(F.struct("lo", "hi")).alias("_sd_found"))
    pending = settled.where(F.col("_sd_starts").isNotNull()).drop("_sd_edges", "_sd_dealt", "_sd_chunk", "n_bytes", "n_removed", "n_spans", "kept_sha256").join(found, "_sd_rid", "left")
    last = T.StructType([*other, *T._parse_datatype_string(RESULT + ", text binary").fields])

    text_at = pending.columns.index("text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text_at):
            out = []
            for raw, bits, ranges in zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in ("text", "_sd_starts", "_sd_found")), strict=True):
                mask = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(raw) - width + 1).astype(bool)
                for r in ranges or ():
                    mask[r["lo"] : r["hi"] + 1] = True
                out.append(outcome(raw, mask, width))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4] if keep_text else [None] * len(out), pa.binary())], names=last.fieldNames())

    done = settled.where(F.col("_sd_starts").isNull()).select(*last.fieldNames()).unionByName(pending.mapInArrow(finish, last))
    if not keep_text:
        return done.drop("text")
    # Bytes of characters that a cut went through are no text.
    return done.withColumn("kept_text", whole_characters(F.col("text"))).drop("text")


def whole_characters(column):
    @F.pandas_udf("string")
    def decode(b):
        return b.map(lambda x: bytes(x).decode("utf-8", "ignore"))

    return decode(column)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
