"""Sharding by minimax contiguous partition, with DataFrame functions only.

Groups (equal texts) are atomic and lie in the order of their MD5. The smallest capacity C for which `shards` runs of
groups, each of at most C bytes, cover them all is found by binary search with a greedy check, and the cuts of that
greedy pass are used. Groups are never gathered: the driver holds totals by key prefix, at most `most` of them, and
splits further only those prefixes in which a cut of any capacity still possible can fall, until those are single
groups. A group larger than a shard's share gets a shard of its own size at least; it isn't split, as it is atomic.

Defined cases: null text counts as empty, of size 16; very long texts are hashed where they lie and never move; equal rows
are distinct rows of one group, and ties (equal texts) go by doc_id, then in any order; an empty table gives no rows; fewer groups than shards leave shards empty; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

KEY = 32  # hex digits of the group key


def greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Prefix sums at which greedy runs of at most `capacity` end, or None if `shards` runs don't suffice."""
    at, cuts = 0, []
    for _ in range(shards):
        i = np.searchsorted(ends, at + capacity, side="right") - 1
        at = int(ends[i]) if i >= 0 else 0
        cuts.append(at)
        if at == ends[-1]:
            return cuts
    return None


def smallest(ends: np.ndarray, low: int, high: int, shards: int) -> int:
    """Smallest feasible capacity of atoms that end at the prefix sums `ends`, from low to high (feasible)."""
    while low < high:
        mid = (low + high) // 2
        if greedy(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return high


def cut_keys(groups: DataFrame, shards: int, most: int = 1 << 16) -> tuple[list[str], int]:
    """Last group key of each shard but the last, and the capacity. groups: key, bytes."""
    total = groups.agg(F.sum("bytes"), F.max("bytes"), F.count("*")).first()
    if not total[2]:
        return [], 0
    largest = total[1]
    digits = max(1, int(np.log(most) / np.log(16)))

    def totals(of: DataFrame, n: int) -> list[tuple[str, int, int]]:
        rows = of.groupBy(F.substring("key", 1, n).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("key").alias("last"))
        return sorted((r.p, r.b, r.n, r.last) for r in rows.collect())

    atoms = totals(groups, digits)
    while True:
        sizes = np.array([a[1] for a in atoms], np.int64)
        ends = np.cumsum(sizes)
        single = np.array([a[2] == 1 for a in atoms])
        # Bounds of the capacity: prefixes taken as atoms make it too large, taken as divisible at will too small.
        high = smallest(ends, int(max(sizes.max(), -(-ends[-1] // shards))), int(ends[-1]), shards)
        low = int(max(largest, -(-ends[-1] // shards)))
        if low > high:
            low = high
        open_ = np.zeros(len(atoms), bool)
        reach_low = reach_high = 0
        for _ in range(shards):
            # Any greedy pass with a capacity in low..high ends its k-th run between these two prefix sums.
            i = np.searchsorted(ends, reach_low + low, side="right") - 1
            reach_low = int(ends[i]) if i >= 0 else 0
            reach_high = min(reach_high + high, int(ends[-1]))
            a, b = np.searchsorted(ends, [reach_low, reach_high], side="left")
            open_[max(0, a) : b + 1] = True
        open_ &= ~single
        if not open_.any():
            break
        split = [atoms[i] for i in np.flatnonzero(open_)]
        kept = [atoms[i] for i in np.flatnonzero(~open_)]
        by_length: dict[int, list[str]] = {}
        for a in split:
            by_length.setdefault(len(a[0]), []).append(a[0])
        for n, prefixes in by_length.items():
            finer = min(KEY, n + max(1, int(np.log(max(16, 4 * most / len(prefixes))) / np.log(16))))
            kept += totals(groups.where(F.substring("key", 1, n).isin(prefixes)), finer)
        atoms = sorted(kept)
    capacity = smallest(ends, low, high, shards)
    cuts = greedy(ends, capacity, shards)
    return [atoms[int(np.searchsorted(ends, c, side="left"))][3] for c in cuts[:-1]], capacity


def shard(docs: DataFrame, shards: int = 40, most: int = 1 << 16) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key"))
    # One ordered pass: rows by key and doc_id over ranges; a group of any size spreads over several ranges.
    ordered = rows.repartitionByRange(F.col("key"), F.col("doc_id")).sortWithinPartitions("key", "doc_id")
    table = staged(ordered.select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("at")), "shard")
    groups = table.groupBy("key").agg(F.sum("size").alias("bytes"))
    cuts, _ = cut_keys(groups, shards, most)
    # Cuts are at most shards - 1 keys; a row's shard is the number of cuts below its key.
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<string>")
    placed = table.withColumn("shard", F.size(F.filter(bounds, lambda c: c < F.col("key"))))
    # Rows of a shard in a part are neighbours: a row for each shard and part gives the offsets of all slots.
    runs = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("shard", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(runs, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
