"""MinHash near-dedup by an LSH forest.

1. Each text becomes a set of word shingles, its 128-bit key and a signature of `SIGNATURE` minhashes. Texts with equal
   sets are one class, shown by its least doc_id.
2. Each tree of the forest takes the minhashes in an order of its own. Classes whose first `depth` values are alone in
   a tree drop out there (packed blocks of names tell). What shares them is a region. Spark sorts the rest by tree and
   signature; in that order the classes of a region stand by longest common prefix. A region of up to `RUN` classes is
   compared as a whole; a larger one by the shallowest deeper prefix that so few share, and each class with the
   `NEXT` ones that follow it. Each class proposes its best neighbour and its best one of lower id.
3. Proposals are confirmed on full sets, and linked classes get components.
4. Classes are contested that share a region with another component: one that signatures don't rule out, or any in a
   region of over `RUN` classes, whose pairs weren't all compared. For these an exact prefix filter finds the rest:
   two sets at the threshold share one of the rarest of their shingles, as many as the threshold lets a set lack, and
   one more. Pairs that do so, in different components and possible by size and place, are confirmed on full sets: at
   first two members a shingle and component, whose links join most of what belongs together, then all that is apart.

So what a tree's order or a run holds apart is compared in step 4, however large the region. The number of trees makes
a pair at the threshold share a region but for one in a million; the depth grows with the logarithm of the number of
classes. Signatures rule a pair out below 4.5 standard deviations under the threshold.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing; fewer words than a
shingle: the whole sequence is the shingle; very long texts are read whole, one at a time beyond 4 MB, and their sets
held in one task, 8 bytes a shingle; rows with equal doc_id count as one document, with the links of each text; a null
doc_id has no component and is kept; ties among neighbours go to the lower doc_id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import mix, pieces, shingle_hashes, shuffle_width, staged, text_bytes, trim, trimmed, word_hashes
from .graphs import components

SIGNATURE = 96
RUN = 128  # classes that are compared pair by pair, by default
NEXT = 4
LIST = 1024  # members of a component that hold a shingle, a row
STRETCH = 8  # runs of an order that a task holds, at least
BROADCAST_ROWS = 250_000  # of 8 bytes
NAMES = 4_000_000  # a bucket
U = np.uint64
ENTRY = "name long, size long, node long, n long, key binary"


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(raw.lower()), k))


def set_key(x: np.ndarray) -> tuple[int, int]:
    if not len(x):
        return 0, 0
    d = xxhash.xxh3_128_intdigest(x.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of 16-bit minhashes of sets that aren't empty."""
    r = np.random.default_rng(20240229)
    odd, flip = r.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * U(2) + U(1), r.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)
    out = np.empty((len(sets), SIGNATURE), np.uint16)
    at = 0
    while at < len(sets):  # about a million shingles at a time
        end, n = at, 0
        while end < len(sets) and (n < 1_000_000 or end == at):
            n += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        lengths = np.fromiter(map(len, sets[at:end]), np.int64)
        starts = np.cumsum(lengths) - lengths
        for i in range(SIGNATURE):
            least = np.minimum.reduceat((x ^ flip[i]) * odd[i], starts)
            out[at:end, i] = mix(least) >> U(48)
        at = end
    return out


def orders(trees: int) -> np.ndarray:
    """The order in which each tree takes the minhashes."""
    r = np.random.default_rng(7)
    return np.stack([r.permutation(SIGNATURE) for _ in range(trees)])


def names_in_trees(sig: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Name of the first `depth` values of each row (first axis) in each tree (second axis)."""
    out = np.empty((len(sig), len(order)), U)
    for t, taken in enumerate(order):
        x = np.full(len(sig), t + 1, U)
        for j in taken[:depth]:
            x = mix(x * U(0x9E3779B97F4A7C15) + sig[:, j])
        out[:, t] = x
    return out


def signed(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            sets = [shingle_set(t, k) for t in text_bytes(b.column(1))]
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list = [None] * len(sets)
            for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                sig[i] = row.tobytes()
            keys = [set_key(s) for s in sets]
            numbers = ([len(s) for s in sets], [x for x, _ in keys], [y for _, y in keys])
            columns = [b.column(0), *(pa.array(x, pa.int64()) for x in numbers), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "k1", "k2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sig binary")


def _signatures(table: pa.Table, column: str = "sig") -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), np.uint16).reshape(-1, SIGNATURE)


def with_counts(
    rows: DataFrame,
    names_of: Callable[[pa.Table], np.ndarray],
    choose: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table],
    schema: str,
    buckets: int,
) -> DataFrame:
    """Per chunk of rows: names of its rows, how many rows bear each over all chunks, and what `choose` makes of it."""

    @trimmed
    def ask(chunk: pa.Table) -> pa.Table:
        names, counts = np.unique(names_of(chunk), return_counts=True)
        parts = blocks.cut(names, buckets)
        k = chunk.column("chunk")[0].as_py()
        return pa.table({
            "bucket": pa.array([p[0] for p in parts], pa.int32()),
            "chunk": pa.array([k] * len(parts), pa.int64()),
            "names": pa.array([blocks.pack(names[a:b]) for _, a, b in parts], pa.binary()),
            "counts": pa.array([counts[a:b].astype("<u4").tobytes() for _, a, b in parts], pa.binary()),
        })

    @trimmed
    def answer(group: pa.Table) -> pa.Table:
        parts = [blocks.unpack(x) for x in group.column("names").to_pylist()]
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), "<u4").astype(np.int64)
        names = np.concatenate(parts)
        order = np.argsort(names, kind="stable")
        head = np.flatnonzero(np.diff(names[order], prepend=names[order[0]] + U(1)))
        total = np.empty(len(names), np.int64)
        total[order] = np.repeat(np.add.reduceat(counts[order], head), np.diff(np.append(head, len(order))))
        total = np.minimum(total, (1 << 32) - 1).astype("<u4")
        at = np.cumsum([0, *map(len, parts)])
        replies = [total[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "counts": pa.array(replies, pa.binary())})

    @trimmed
    def apply(chunk: pa.Table, said: pa.Table) -> pa.Table:
        every = names_of(chunk)
        names = np.unique(every)
        counts = dict(zip(said.column("bucket").to_pylist(), said.column("counts").to_pylist(), strict=True))
        total = np.frombuffer(b"".join(counts[k] for k, _, _ in blocks.cut(names, buckets)), "<u4")
        return choose(chunk, every, total[np.searchsorted(names, every)].astype(np.int64))

    asked = rows.groupBy("chunk").applyInArrow(ask, "bucket int, chunk long, names binary, counts binary")
    said = asked.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, counts binary")
    return rows.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(apply, schema)


def forest(classes: DataFrame, depth: int, trees: int, buckets: int) -> DataFrame:
    """name, size, node, n, key: classes that share their first values with others in a tree, by region.

    key: the signature in the order of the tree; within a region all rows are of one tree.
    """
    order = orders(trees)

    def shared(chunk: pa.Table, names: np.ndarray, counts: np.ndarray) -> pa.Table:
        row, tree = np.nonzero(counts > 1)
        sig = _signatures(chunk)
        keys = np.ascontiguousarray(sig[row[:, None], order[tree]]).view(f"V{2 * SIGNATURE}").ravel()
        picked = {c: chunk.column(c).take(pa.array(row)).combine_chunks() for c in ("node", "n")}
        name, size = pa.array(names[row, tree].view(np.int64)), pa.array(counts[row, tree])
        return pa.table({"name": name, "size": size} | picked | {"key": pa.array([x.tobytes() for x in keys], pa.binary())})

    return with_counts(classes, lambda t: names_in_trees(_signatures(t), order, depth), shared, ENTRY, buckets)


def in_order(entries: DataFrame, most: int) -> DataFrame:
    """Entries sorted by region and key. Regions of up to `most` classes lie whole in a partition; others are cut anywhere."""
    large = F.col("size") > most
    spread = entries.repartitionByRange("name", F.when(large, F.col("key")), F.when(large, F.col("node")))
    return spread.sortWithinPartitions("name", "key", "node")


def stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of a partition in parts that hold regions whole; of one that goes on and on, parts that overlap."""
    held = None
    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if held.num_rows < STRETCH * most:
            continue
        name = held.column("name").to_numpy()
        new = np.flatnonzero(name[1:] != name[:-1])
        if len(new):
            yield held.slice(0, int(new[-1]) + 1)
            held = held.slice(int(new[-1]) + 1)
        else:
            yield held
            held = held.slice(held.num_rows - most)
    if held is not None and held.num_rows:
        yield held
    trim()


def runs_of(name: np.ndarray, sig: np.ndarray, most: int) -> np.ndarray:
    """Number of the run of each row: its region or, beyond `most` rows, the shallowest deeper prefix that so few share."""
    equal = sig[1:] == sig[:-1]
    common = np.where(equal.all(1), SIGNATURE, equal.argmin(1))  # values shared with the row before
    common[name[1:] != name[:-1]] = -1
    run, open_, depth = np.zeros(len(name), np.int64), np.ones(len(name), bool), -1
    while open_.any():
        start = np.append(True, (common <= depth) | ~open_[1:] | ~open_[:-1])
        here = np.cumsum(start) - 1
        sizes = np.bincount(here)[here]
        done = open_ & ((sizes <= most) | (depth >= SIGNATURE - 1))
        run[done] = here[done] + (depth + 2) * (len(name) + 1)
        open_ &= ~done
        depth += 1
    return run


def pairs_in(t: pa.Table, share: float, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (i, j, agreement) that signatures and sizes allow: of each run, and of neighbours in a region."""
    name, n = t.column("name").to_numpy(), t.column("n").to_numpy()
    sig = _signatures(t, "key")
    run = runs_of(name, sig, most)
    out = []

    def check(i: np.ndarray, j: np.ndarray) -> None:
        ok = np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j]) - 1e-9
        i, j = i[ok], j[ok]
        for a in range(0, len(i), 100_000):
            x, y = i[a : a + 100_000], j[a : a + 100_000]
            agree = (sig[x] == sig[y]).sum(1)
            good = agree >= least
            out.append((x[good], y[good], agree[good]))

    at = np.arange(len(name))
    for k in range(1, max(most, NEXT + 1)):
        at = at[at < len(name) - k]
        mine = at[run[at] == run[at + k]]
        near = at[(run[at] != run[at + k]) & (name[at] == name[at + k])] if k <= NEXT else at[:0]
        if not len(mine) and not len(near) and k >= NEXT:
            break
        check(np.append(mine, near), np.append(mine, near) + k)
        at = mine if k >= NEXT else at
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def proposals(entries: DataFrame, share: float, least: int, most: int) -> DataFrame:
    """For each class its best neighbour, and its best one of lower id, in each part of an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in stretches(batches, most):
            i, j, agree = pairs_in(t, share, least, most)
            node = t.column("node").to_numpy()
            a, b, s = np.concatenate([node[i], node[j]]), np.concatenate([node[j], node[i]]), np.concatenate([agree, agree])
            kind = np.concatenate([np.zeros(len(a), bool), np.ones((b < a).sum(), bool)])
            a, b, s = np.append(a, a[b < a]), np.append(b, b[b < a]), np.append(s, s[b < a])
            o = np.lexsort((b, -s, kind, a))
            if len(o):
                o = o[np.append(True, (np.diff(a[o]) != 0) | (np.diff(kind[o].astype(np.int8)) != 0))]
            columns = [pa.array(a[o], pa.int64()), pa.array(b[o], pa.int64()), pa.array(s[o], pa.int32()), pa.array(kind[o])]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "other", "agree", "lower"])

    found = in_order(entries, most).mapInArrow(run, "node long, other long, agree int, lower boolean")
    return found.groupBy("node", "lower").agg(F.max_by("other", F.struct("agree", -F.col("other"))).alias("other"))


def contested(entries: DataFrame, found: DataFrame, share: float, least: int, most: int) -> DataFrame:
    """node, component of the classes that may have links to other components: see step 4."""
    known = found.select("node", F.col("component").alias("joined"))
    inside = entries.join(known, "node", "left").withColumn("component", F.coalesce("joined", "node")).drop("joined")
    inside = staged(inside, "near-inside")
    mixed = inside.groupBy("name").agg(F.min("component").alias("m"), F.max("component").alias("x")).where("m <> x").select("name")
    across = inside.join(mixed, "name", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in stretches(batches, most):
            component = t.column("component").to_numpy()
            i, j, _ = pairs_in(t, share, least, most)
            apart = component[i] != component[j]
            hit = t.column("size").to_numpy() > most
            hit[i[apart]] = True
            hit[j[apart]] = True
            at = pa.array(np.flatnonzero(hit))
            columns = [t.column(c).take(at).combine_chunks() for c in ("node", "component")]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "component"])

    return in_order(across, most).mapInArrow(run, "node long, component long").distinct()


def sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, set (sorted shingle hashes) of the given classes, from one text of each."""
    # A list of known length goes to all tasks only below a bound; beyond it both sides are shuffled.
    few = nodes if nodes.count() > BROADCAST_ROWS else F.broadcast(nodes)
    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string")).join(few, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            sets = [shingle_set(t, k) for t in text_bytes(b.column(1))]
            keys = [set_key(s) for s in sets]
            columns = [b.column(0), *(pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1)), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "k1", "k2", "set"])

    sets = rows.mapInArrow(run, "node long, k1 long, k2 long, set binary")
    # Of rows with the same doc_id, the one whose text is the class's.
    wanted = classes.select("node", F.col("k1").alias("c1"), F.col("k2").alias("c2"))
    sets = sets.join(wanted.hint("merge"), "node").where("k1 = c1 and k2 = c2")
    return sets.select("node", "set").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                both = int((blocks.find(y, x) >= 0).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    ok.append(i)
            at = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])
        trim()

    of = lambda node, name: sets.select(F.col("node").alias(node), F.col("set").alias(name)).hint("merge")
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def rare_shingles(members: DataFrame, sets: DataFrame, percent: int, width: int) -> DataFrame:
    """shingle, node, component, n, at: of each member (node, component) the rarest shingles, with its size and their places.

    Two members at the threshold share one of them. Shingles are ordered by how many members hold them, then by hash.
    """
    rows = sets.join(members.hint("merge"), "node").withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), 9))
    rows = staged(rows, "near-contested")
    total = rows.agg(F.sum(F.octet_length("set"))).first()[0] or 0

    def shingles(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t.column("set").to_pylist()), U)

    def rare(t: pa.Table, names: np.ndarray, counts: np.ndarray) -> pa.Table:
        n = np.array([len(x) // 8 for x in t.column("set").to_pylist()])
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((names, counts, row))
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        first = n - -(-percent * n // 100) + 1
        pick = (place < first[row]) & (counts[order] > 1)  # a shingle that one member alone holds is shared with nobody
        at, row = order[pick], row[pick]
        picked = {c: t.column(c).take(pa.array(row)).combine_chunks() for c in ("node", "component")}
        return pa.table({"shingle": pa.array(names[at].view(np.int64))} | picked | {"n": pa.array(n[row]), "at": pa.array(place[pick])})

    found = with_counts(rows, shingles, rare, "shingle long, node long, component long, n long, at long", max(width, total // (8 * NAMES)))
    return staged(found, "near-rare")


def possible(p: Column, q: Column, percent: int) -> Column:
    """Whether sizes n of two members, and places of a shingle that they share, leave them at the threshold."""
    least, most = F.least(p["n"], q["n"]), F.greatest(p["n"], q["n"])
    left = F.least(p["n"] - p["at"], q["n"] - q["at"])  # shared from here on, at most
    return (100 * least >= percent * most) & ((100 + percent) * left >= percent * (p["n"] + q["n"]))


def first_met(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of different components that may be at the threshold, of two members a shingle and component.

    The members differ from shingle to shingle, so a class that has links into a crowd meets many of it.
    """
    member, by = F.struct("n", "at", "node"), F.xxhash64("shingle", "node")
    two = rare.groupBy("shingle", "component").agg(F.min_by(member, by).alias("p"), F.max_by(member, by).alias("q"))
    two = staged(two.select("shingle", "component", F.explode(F.array_distinct(F.array("p", "q"))).alias("m")), "near-two")
    x, y = (two.select("shingle", F.col("component").alias(f"{k}_in"), F.col("m").alias(k)) for k in ("x", "y"))
    apart = (x["shingle"] == y["shingle"]) & (F.col("x_in") < F.col("y_in")) & possible(x["x"], y["y"], percent)
    return x.join(y.hint("merge"), apart).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def lists_of(found: DataFrame) -> DataFrame:
    """shingle, component, members: the members of a component that hold a shingle, in lists of about LIST.

    A shingle that only one component holds has none: nothing is to be found by it.
    """
    mixed = found.groupBy("shingle").agg(F.min("component").alias("m"), F.max("component").alias("x")).where("m <> x").select("shingle")
    rows = staged(found.join(mixed.hint("merge"), "shingle", "left_semi"), "near-mixed")
    large = rows.groupBy("shingle", "component").agg(F.ceil(F.count("*") / LIST).cast("long").alias("parts")).where("parts > 1")
    rows = rows.join(large.hint("merge"), ["shingle", "component"], "left")
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    bounds = [F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("at")).alias("left")]
    lists = rows.groupBy("shingle", "component", part.alias("part")).agg(F.collect_list(F.struct("n", "at", "node")).alias("members"), *bounds)
    return lists.drop("part")


def across(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b from lists of different components: what is joined are lists, so a component meets itself nowhere.

    Lists meet if their least and greatest sizes and places leave a pair possible.
    """
    side = lambda k: lists.select("shingle", *(F.col(c).alias(f"{k}_{c}") for c in ("component", "members", "lo", "hi", "left")))
    x, y = side("x"), side("y")
    alike = (100 * F.col("x_hi") >= percent * F.col("y_lo")) & (100 * F.col("y_hi") >= percent * F.col("x_lo"))
    alike &= (100 + percent) * F.least("x_left", "y_left") >= percent * (F.col("x_lo") + F.col("y_lo"))
    lists_met = x.join(y.hint("merge"), (x["shingle"] == y["shingle"]) & (F.col("x_component") < F.col("y_component")) & alike)
    # Members that no member of the other list can match don't become rows.
    fit = lambda m: (100 * m["n"] >= percent * F.col("y_lo")) & (100 * F.col("y_hi") >= percent * m["n"])
    meets = lambda m: fit(m) & ((100 + percent) * F.least(m["n"] - m["at"], "y_left") >= percent * (m["n"] + F.col("y_lo")))
    lists_met = lists_met.select(F.explode(F.filter("x_members", meets)).alias("x"), F.col("y_members").alias("ys"))
    pairs = lists_met.select("x", F.explode(F.filter("ys", lambda q: possible(F.col("x"), q, percent))).alias("y"))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """node, component of `found` after links a, b between components, or from them to classes without one."""
    label = lambda node: found.select(F.col("node").alias(node), F.col("component").alias(f"{node}_in"))
    ends = links.join(label("a").hint("merge"), "a", "left").join(label("b").hint("merge"), "b", "left")
    upper = components(ends.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")))
    upper = upper.select(F.col("node").alias("component"), F.col("component").alias("top"))
    lower = found.join(upper.hint("merge"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    lone = upper.join(found.select(F.col("node").alias("component")).hint("merge"), "component", "left_anti")
    return staged(lower.unionByName(lone.select(F.col("component").alias("node"), F.col("top").alias("component"))), "near-found")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, run: int = RUN) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row. run: classes of a region that are compared pair by pair."""
    share, width = percent / 100, shuffle_width(docs.sparkSession)
    rows = staged(signed(docs, k), "near-signed")
    full = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    classes = staged(classes.withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), 14)), "near-classes")
    count = classes.count()
    depth = max(4, round(math.log2(max(2, count)) / 4.5))
    trees = math.ceil(math.log(1e-6) / math.log(1 - share**depth)) if share < 1 else 1
    least = max(1, math.floor(SIGNATURE * share - 4.5 * math.sqrt(SIGNATURE * share * (1 - share))))
    entries = staged(forest(classes, depth, trees, max(width, count * trees // NAMES)), "near-forest")
    nodes = staged(entries.select("node").distinct(), "near-nodes")
    sets = staged(sets_of(docs, classes, nodes, k), "near-sets")
    best = proposals(entries, share, least, run)
    pairs = best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    found = components(confirmed(pairs, sets, percent))
    members = contested(entries, found, share, least, run)
    rare = rare_shingles(members, sets, percent, width)
    met = staged(first_met(rare, percent), "near-met")
    links = staged(confirmed(met, sets, percent), "near-first")
    if not links.isEmpty():
        found = joined(found, links)
        rare = rare.withColumnRenamed("component", "before").join(found.hint("merge"), "node", "left")
        rare = rare.withColumn("component", F.coalesce("component", "before")).drop("before")
    rest = across(lists_of(rare), percent).join(met.hint("merge"), ["a", "b"], "left_anti")
    links = staged(confirmed(rest, sets, percent), "near-links")
    if not links.isEmpty():
        found = joined(found, links)
    labels = classes.select("k1", "k2", "node").join(found.hint("merge"), "node", "left")
    labels = labels.select("k1", "k2", F.coalesce("component", "node").alias("component"))
    out = rows.drop("sig").join(labels.hint("merge"), ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2, percent=80)
