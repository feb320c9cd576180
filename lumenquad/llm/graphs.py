"""Connected components over tables, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import staged, trim

AT_ONCE = 1 << 20  # links


def least_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links a, b and the least node of the component of each."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():  # every node goes by the least root around, and that by its own
        least = np.minimum(root[x], root[y])
        for end in (root[x], root[y], x, y):
            np.minimum.at(root, end, least)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def contracted(links: DataFrame, most: int = AT_ONCE) -> DataFrame:
    """Stars u, v (v the least) that join what the links a, b join, for parts of up to `most` links of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            node, least = least_of(t.column(0).to_numpy(), t.column(1).to_numpy())
            ok = node != least
            return pa.RecordBatch.from_arrays([pa.array(node[ok]), pa.array(least[ok])], names=["u", "v"])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= most:
                yield stars()
                held, n = [], 0
        if n:
            yield stars()
        trim()

    return links.select("a", "b").mapInArrow(run, "u long, v long")


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """pairs: u, v in both directions. Links neighbours of u (all larger, or all smaller and u) to the least of them."""
    side = F.col("v") < F.col("u") if small else F.lit(True)
    least = pairs.where(side).groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    chosen = pairs.where(F.col("v") < F.col("u") if small else F.col("v") > F.col("u")).join(least.hint("merge"), "u")
    out = chosen.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v"))


def components(links: DataFrame, rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """node, component (its least node) for every node of the links (a, b).

    Up to `at_once` links, by count, are joined by one task (16 bytes each); of more, no group of links is gathered.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        """The table and its fingerprint, taken as it is written."""
        seen = Observation()
        got = staged(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "links")
        return got, tuple(seen.get.values())

    links = staged(links.select("a", "b"), "links")
    whole = links.count() <= at_once
    edges, state = kept(contracted(links.coalesce(1), at_once) if whole else contracted(links).distinct())
    for _ in range(rounds):
        if whole or not state[0]:
            break
        large = _star(both(edges), False).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges, now = kept(_star(both(large), True).distinct())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    # Settled edges are stars: each u has one v, and a v is least in its own component.
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
