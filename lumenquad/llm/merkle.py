"""Merkle manifest of a dataset: a leaf a row, a tree a language, a tree of those trees' roots, and each row's proof.

Leaves are numbered within their language over ranges of (language, doc_id), so no task sees all rows of one. Aligned
blocks of 2**bits nodes are packed as one row each; their roots are the nodes of the next level, packed alike, until a
language is one block. A second pass goes down again: each block is walked by fractal traversal and emits the
authentication path of each node in turn, to which the proof of the block itself, joined from the level above, is
appended. A walk keeps two stacks of small subtrees: those that the current leaf's path lies in (existing), and their
next neighbours (desired), which each step feeds one leaf, so that a neighbour is whole when the walk gets there. The
driver sees one digest, the root.

A digest is a lower-case hexadecimal SHA-256 over digests in that form; in tables it is kept as 32 bytes. A step of a
proof is 33 bytes: 0 and nothing where a node has no sibling and is hashed alone, 1 or 2 and a sibling to the left or
right.

Defined cases: a null field is `-` in the leaf, an empty text is `0:`; very long texts are hashed where they lie and
never move; a null doc_id comes first and is never tampered with; equal doc_ids of a language go by leaf, and equal rows
are leaves of their own that differ in their proofs only; a null language is a tree of its own, before all others; one
leaf is its own subroot, one language's subroot is the root; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_of_id, staged, trimmed

DIGEST, STEP = 32, 33
LONE, LEFT, RIGHT = b"\0", b"\1", b"\2"
NO_SIBLING = LONE + bytes(DIGEST)
#: Lists of at most so many small rows (some 1 kB) may go to all tasks.
BROADCAST_ROWS = 20_000


def parent(children: bytes) -> bytes:
    """Digest of one or two digests that follow one another."""
    return hashlib.sha256(hexlify(children)).digest()


class Subtree:
    """The nodes of heights base to top below one node of height `top`, built leaf by leaf with a stack of lower nodes."""

    __slots__ = ("base", "top", "total", "next", "end", "stack", "nodes")

    def __init__(self, base: int, top: int, index: int, total: int):
        self.base, self.top, self.total = base, top, total
        self.next, self.end = index << top, min(total, (index + 1) << top)
        self.stack: list[bytes] = []
        self.nodes: dict[tuple[int, int], bytes] = {}

    def feed(self, leaves: bytes) -> None:
        """Takes the next leaf, if one is left, and closes all nodes that end with it."""
        if self.next >= self.end:
            return
        i, height = self.next, 0
        self.next += 1
        node = leaves[DIGEST * i : DIGEST * (i + 1)]
        while True:
            at = i >> height
            if height >= self.base:
                self.nodes[height, at] = node
            if height == self.top:
                return
            if at & 1:
                node = parent(self.stack.pop() + node)
            elif (at + 1) << height >= self.total:
                node = parent(node)
            else:
                self.stack.append(node)
                return
            height += 1

    def steps(self, i: int) -> bytes:
        """Siblings on the way of leaf i from height base to top."""
        out = []
        for height in range(self.base, self.top):
            at = (i >> height) ^ 1
            node = self.nodes.get((height, at))
            out.append(NO_SIBLING if node is None else (RIGHT if at & 1 else LEFT) + node)
        return b"".join(out)


def height_of(total: int, bits: int) -> int:
    """Height of a block in a tree of so many nodes: full if there are several blocks."""
    return min(bits, (total - 1).bit_length())


def root_of(leaves: bytes, height: int) -> bytes:
    tree = Subtree(height, height, 0, len(leaves) // DIGEST)
    for _ in range(tree.end):
        tree.feed(leaves)
    return tree.nodes[height, 0]


def paths(leaves: bytes, height: int, span: int = 4) -> Iterator[bytes]:
    """Steps of each leaf up to `height`, one leaf after another, by fractal traversal with subtrees of `span` levels."""
    n = len(leaves) // DIGEST
    levels = [(b, min(b + span, height)) for b in range(0, height, span)]
    existing = [Subtree(b, t, 0, n) for b, t in levels]
    for tree in existing:
        while tree.next < tree.end:
            tree.feed(leaves)
    desired = [Subtree(b, t, 1, n) for b, t in levels]
    parts = [tree.steps(0) for tree in existing]
    for i in range(1, n + 1):
        yield b"".join(parts)
        for tree in desired:
            tree.feed(leaves)
        if i == n:
            return
        for k, (base, top) in enumerate(levels):
            if i & ((1 << base) - 1):
                break
            if not i & ((1 << top) - 1):
                existing[k], desired[k] = desired[k], Subtree(base, top, (i >> top) + 1, n)
            parts[k] = existing[k].steps(i)


def fold(node: bytes, steps: bytes) -> bytes:
    """The root that a node and its proof lead to."""
    for at in range(0, len(steps), STEP):
        side, sibling = steps[at], steps[at + 1 : at + STEP]
        node = parent(node if side == 0 else sibling + node if side == 1 else node + sibling)
    return node


def siblings(steps: bytes) -> bytes:
    """Digests of a proof, without what stands alone."""
    return b"".join(steps[at + 1 : at + STEP] for at in range(0, len(steps), STEP) if steps[at])


def leaf_of(*fields: Column) -> Column:
    """SHA-256 (32 bytes) of fields: `-` for null, else length in UTF-8 bytes, a colon and the value."""
    shown = [c.cast("string") for c in fields]
    text = F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown))
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _small(df: DataFrame, name: str) -> DataFrame:
    """A table that goes to all tasks if it was counted to be short."""
    df = staged(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with i, their place in order within `by` (not null), and total. Ranges are counted, never gathered.

    The ranged rows are written once, as two runs of one shuffle need not see the same ranges. The offsets are one row
    for each part and each key in it.
    """
    ranged = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    table = staged(ranged.select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id() % (1 << 33)).alias("_at")), "merkle-nodes")
    runs = table.groupBy(by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    all_of = Window.partitionBy(by)
    before = F.coalesce(F.sum("_n").over(all_of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = _small(runs.select(by, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(all_of).alias("total")), "merkle-runs")
    return table.join(runs, [by, "_part"]).withColumn("i", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


BLOCK = "key string, block long, total long, digests binary, root binary"
LEAVES = BLOCK + ", doc_id array<long>, checked binary"


def packed(nodes: DataFrame, bits: int, schema: str = BLOCK) -> DataFrame:
    """A row for each aligned block of 2**bits nodes (key, i, total, digest; leaves: doc_id and checked) with its root."""

    @trimmed
    def pack(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t["i"].to_numpy(), kind="stable")))
        digests, total, i = b"".join(t["digest"].to_pylist()), t["total"][0].as_py(), t["i"][0].as_py()
        row = {"key": t["key"][0].as_py(), "block": i >> bits, "total": total, "digests": digests, "root": root_of(digests, height_of(total, bits))}
        if schema == LEAVES:
            row |= {"doc_id": t["doc_id"].to_pylist(), "checked": b"".join(t["checked"].to_pylist())}
        kinds = {"block": pa.int64(), "total": pa.int64(), "digests": pa.binary(), "root": pa.binary(), "doc_id": pa.list_(pa.int64()), "checked": pa.binary()}
        return pa.table({k: pa.array([v], kinds.get(k, pa.string())) for k, v in row.items()})

    return staged(nodes.groupBy("key", F.shiftright("i", bits).alias("block")).applyInArrow(pack, schema), "merkle-blocks")


def above(blocks: DataFrame, bits: int) -> DataFrame:
    """The blocks as nodes of the next level."""
    return blocks.select("key", F.col("block").alias("i"), F.shiftright(F.col("total") + ((1 << bits) - 1), bits).alias("total"), F.col("root").alias("digest"))


def levels_over(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Packed blocks of nodes, of those blocks, and so on until each key is one block."""
    out = [packed(nodes, bits)]
    while not out[-1].where(F.col("total") > (1 << bits)).isEmpty():
        out.append(packed(above(out[-1], bits), bits))
    return out


def below(blocks: DataFrame, upper: DataFrame, bits: int) -> DataFrame:
    """Proofs (key, block, subroot, steps) of the nodes in blocks, from those of the blocks."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, block, total, digests, subroot, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [p + steps for p in paths(digests, height_of(total, bits))]
                first, n = block << bits, len(found)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array([subroot] * n, pa.binary()), pa.array(found, pa.binary())], names=["key", "block", "subroot", "steps"])

    return blocks.join(upper, ["key", "block"]).select("key", "block", "total", "digests", "subroot", "steps").mapInArrow(walk, "key string, block long, subroot binary, steps binary")


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(blocks: DataFrame, upper: DataFrame, root: bytes, bits: int, keep_steps: bool) -> DataFrame:
    """A row a leaf: its proof against the root, checked with the digest that stands in `checked`."""
    shown = root.hex()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                steps, leaves, checked = r["steps"], r["digests"], r["checked"]
                upper_siblings, ends = hexlify(siblings(steps)), {}
                out: dict[str, list] = {k: [] for k in ("leaf", "proof_sha256", "folded_root", "verified", "steps")}
                for at, path in enumerate(paths(leaves, height_of(r["total"], bits))):
                    block_root = fold(checked[DIGEST * at : DIGEST * (at + 1)], path)
                    if block_root not in ends:
                        # Most leaves lead to the block's own root; what lies above is then the same walk.
                        if len(ends) > 1:
                            ends.popitem()
                        ends[block_root] = fold(block_root, steps)
                    end = ends[block_root].hex()
                    out["leaf"].append(leaves[DIGEST * at : DIGEST * (at + 1)].hex())
                    out["proof_sha256"].append(hashlib.sha256(hexlify(siblings(path)) + upper_siblings).hexdigest())
                    out["folded_root"].append(end)
                    out["verified"].append(end == shown)
                    if keep_steps:
                        out["steps"].append(path + steps)
                n = len(out["leaf"])
                columns = {"doc_id": pa.array(r["doc_id"], pa.int64()), "leaf": pa.array(out["leaf"]), "subroot": pa.array([r["subroot"].hex()] * n), "root": pa.array([shown] * n)}
                columns |= {k: pa.array(out[k]) for k in ("proof_sha256", "folded_root", "verified")}
                if keep_steps:
                    columns["steps"] = pa.array(out["steps"], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    joined = blocks.join(upper, ["key", "block"]).select("total", "digests", "checked", "doc_id", "subroot", "steps")
    return joined.mapInArrow(walk, PROOFS + (", steps binary" if keep_steps else ""))


def manifest(leaves: DataFrame, bits: int = 10, keep_steps: bool = False) -> DataFrame:
    """Proofs of leaves (lang, doc_id, leaf, checked) against the root of all.

    leaf and checked are 32 bytes: the manifest is built of the leaves, and what is checked against it is the other
    digest, which differs where a row was tampered with. keep_steps: with the proof itself.
    """
    spark = leaves.sparkSession
    # A prefix keeps the bytewise order and leaves room for null in front.
    key = F.coalesce(F.concat(F.lit(":"), F.col("lang").cast("string")), F.lit(""))
    rows = staged(leaves.select(key.alias("key"), F.col("doc_id").cast("long"), F.col("leaf").alias("digest"), "checked"), "merkle-leaves")
    base = packed(numbered(rows, "key", ["doc_id", "digest"]), bits, LEAVES)
    trees = levels_over(above(base, bits), bits)
    subroots = numbered(trees[-1].select(F.lit("").alias("all"), "key", F.col("root").alias("digest")), "all", ["key"])
    top = levels_over(subroots.select(F.col("all").alias("key"), "i", "total", "digest"), bits)
    whole = top[-1].select("root").first()
    upper = top[-1].select("key", "block", F.col("root").alias("subroot"), F.lit(b"").alias("steps"))
    for blocks in reversed(top):
        upper = below(blocks, upper, bits)
    upper = upper.select(F.col("block").alias("i"), "steps").join(subroots, "i").select("key", F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), "steps")
    for blocks in reversed(trees):
        upper = below(blocks, upper, bits)
    if whole is None:
        return spark.createDataFrame([], PROOFS + (", steps binary" if keep_steps else ""))
    return proofs(base, _small(upper, "merkle-upper"), bytes(whole.root), bits, keep_steps)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_chars = F.col("n_chars").cast("decimal(20,0)")
    fields = [F.col(c) for c in ("doc_id", "source", "lang")]
    tampered = F.pmod(crc_of_id(F.col("doc_id")), F.lit(7)) == 0
    leaf, other = leaf_of(*fields, n_chars, F.col("text")), leaf_of(*fields, n_chars + 1, F.col("text"))
    return manifest(docs.select("lang", "doc_id", leaf.alias("leaf"), F.when(tampered, other).otherwise(leaf).alias("checked")))
