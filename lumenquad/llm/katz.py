"""Language-model scoring by Katz backoff over word n-grams, trigrams unless the parameter `order` says otherwise.

Counts are discounted by Good-Turing (up to 5; above, a tenth of a count is taken, so every context keeps mass for
backoff), and the backoff weight of each context makes its probabilities over the vocabulary and one unknown word sum
to one. Evaluation is recursive: a seen n-gram by its discounted count, else the context's backoff weight times the
probability after the context without its first word, down to the word's own, whose unseen mass belongs to the unknown
word. One begin stands before each text, so the first word has a context of one, the second of two.

Chunks are parts of the file blocks of the table, of bounded size. Each asks for its distinct words, pairs and longer
n-grams in packed blocks; bucket by bucket the corpus counts are summed and stored as a table (one row a length, bucket
and chunk), and go back to the chunks that asked. A second round sums, for the contexts that held-out texts use, the
seen mass and the shorter contexts' mass of the same words to backoff weights. Hot words are one entry a chunk.

Defined cases: null and empty texts are the end token alone; a null doc_id counts as training; repeated rows count
each; very long texts are hashed a stretch at a time and their tokens held in one task; ties don't arise, as sums have
no order; without training rows every word is unknown, with probability 1; an empty table gives no rows; other columns
are ignored. Words and n-grams are told apart by 64-bit hashes. The query rounds its two sums to six places, as the
order of a sum of doubles is free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import crc_of_id, mix, pieces, remove_unused, shuffle_width, staged, text_bytes, trim, trimmed, word_hashes

U = np.uint64
END, BEGIN = U(1), U(2)
TOP = 5  # counts up to this are discounted by Good-Turing
TAIL = 0.1
CHUNK_BYTES = 4 << 20  # of a file block
BUCKET_BYTES = 16 << 20  # of the texts whose names of one length fall into one bucket


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_of_id(doc_id) % 10 == 0, F.lit(False))


def discounts(n: np.ndarray) -> np.ndarray:
    """Discount of counts 1 to TOP; n[r]: how many entries have count r (r up to TOP + 1)."""
    out = np.empty(TOP + 1)
    rest = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r  # few or odd counts of counts: half a count
    return out


@dataclass
class Level:
    """Counts of counts of the n-grams of one length."""

    n: np.ndarray
    distinct: int
    total: int

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        d = discounts(self.n)
        small = np.minimum(counts, TOP)
        return np.where(counts > TOP, counts - TAIL, d[np.maximum(small, 1)] * counts)

    def unseen(self) -> float:
        """Share of the mass that the discounts free."""
        if not self.total:
            return 1.0
        r = np.arange(1, TOP + 1)
        few = self.n[1 : TOP + 1]
        kept = (self.kept(r) * few).sum() + (self.total - (r * few).sum()) - TAIL * (self.distinct - few.sum())
        return float(1 - kept / self.total)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the place of one row of each, and each row's place among them."""
    order = np.argsort(x).astype(np.int32)
    ranked = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    at = np.empty(len(x), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return ranked[new], order[new], at


class Chunk:
    """Tokens of the texts of a chunk and its distinct n-grams of each length up to `order`, in order of their names.

    For length k + 1: names[k]; of[k], the place of each token's n-gram among them, -1 where the text has too few words
    before; lower[k] and context[k], the places of an n-gram without its first and without its last word among those of
    length k. The begin is the context after the last word.
    """

    def __init__(self, raws: list[bytes], held: np.ndarray, order: int):
        hashes = [word_hashes(r.lower()) for r in raws]
        self.lengths = np.array([len(h) + 1 for h in hashes])
        tokens = np.concatenate([x for h in hashes for x in (h, [END])]).astype(np.uint64) if raws else np.empty(0, U)
        del hashes
        starts = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(raws), dtype=np.int32), self.lengths)
        self.train = ~held[self.doc]
        words, _, at = distinct(tokens)
        self.names, self.of, self.lower, self.context = [words], [at], [at[:0]], [at[:0]]
        last = mix(tokens + U(0x5851F42D4C957F2D))
        gram, has = tokens, np.ones(len(tokens), bool)
        for k in range(1, order):
            before = np.roll(gram, 1)
            place = np.roll(self.of[-1], 1)
            if k == 1:
                before[starts], place[starts] = BEGIN, len(words)
            else:
                has = np.roll(has, 1)
                has[starts] = False
            gram = mix(before * U(0x9E3779B97F4A7C15) + last)
            here = np.flatnonzero(has)
            names, first, at = distinct(gram[here])
            of = np.full(len(tokens), -1, np.int32)
            of[here] = at
            first = here[first]
            self.lower.append(self.of[-1][first])
            self.context.append(place[first])
            self.names.append(names)
            self.of.append(of)

    def counts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Length less one, names, counts in training texts, and whether held-out texts have them, for each length."""
        for k, (names, of) in enumerate(zip(self.names, self.of, strict=True)):
            used = np.zeros(len(names), bool)
            if k < len(self.names) - 1:  # the longest are no contexts
                used[of[~self.train & (of >= 0)]] = True
            yield k, names, np.bincount(of[self.train & (of >= 0)], minlength=len(names)), used


def planes(x: np.ndarray) -> bytes:
    return blocks.squeeze(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def bits(x: np.ndarray) -> bytes:
    return blocks.squeeze(np.packbits(x).tobytes())


def from_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blocks.loosen(raw), np.uint8), count=n)


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blocks.loosen(raw), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


BLOCK = "kind int, bucket int, chunk long, names binary, counts binary, used binary"
SUMMED = "kind int, bucket int, chunk long, counts binary, bits binary, stats array<long>"


def ask_counts(docs: DataFrame, buckets: int, order: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_ = None, {}

        def done():
            for (_, chunk), (raws, held) in list(open_.items()):
                yield from packed(chunk, Chunk(raws, np.array(held), order))
            open_.clear()
            trim()

        def packed(chunk, content):
            for kind, names, counts, used in content.counts():
                parts = blocks.cut(names, buckets)
                n = len(parts)
                columns = {
                    "kind": pa.array([kind] * n, pa.int32()),
                    "bucket": pa.array([p[0] for p in parts], pa.int32()),
                    "chunk": pa.array([chunk] * n, pa.int64()),
                    "names": pa.array([blocks.squeeze(blocks.pack(names[a:b])) for _, a, b in parts], pa.binary()),
                    "counts": pa.array([planes(counts[a:b]) for _, a, b in parts], pa.binary()),
                    "used": pa.array([bits(used[a:b]) for _, a, b in parts], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)

        for b in pieces(batches, 3):
            for block, chunk, h, raw in zip(*(b.column(i).to_pylist() for i in range(3)), text_bytes(b.column(3)), strict=True):
                if block != at:
                    yield from done()
                at = block
                raws, held = open_.setdefault((block, chunk), ([], []))
                raws.append(raw)
                held.append(h)
        yield from done()

    return docs.select("block", "chunk", "held_out", "text").mapInArrow(run, BLOCK)


@trimmed
def sum_counts(group: pa.Table) -> pa.Table:
    """Corpus counts of a bucket's names for each block, with bits: first here of all blocks; used in held-out texts."""
    group = group.sort_by("chunk")
    parts = [blocks.unpack(blocks.loosen(x)) for x in group.column("names").to_pylist()]
    names = np.concatenate(parts)
    counts = np.concatenate([from_planes(x) for x in group.column("counts").to_pylist()])
    used = np.concatenate([from_bits(x, len(p)) for p, x in zip(parts, group.column("used").to_pylist(), strict=True)])
    order = np.argsort(names, kind="stable")
    head = np.flatnonzero(np.diff(names[order], prepend=names[order[0]] + U(1)))
    sizes = np.diff(np.append(head, len(order)))
    total = np.add.reduceat(counts[order], head)
    any_used = np.maximum.reduceat(used[order], head)
    first = np.zeros(len(names), np.uint8)
    first[order[head]] = 1
    counts[order], used[order] = np.repeat(total, sizes), np.repeat(any_used, sizes)
    at = np.cumsum([0, *map(len, parts)])
    stats = np.array([*np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)[: TOP + 2], (total > 0).sum(), total.sum()], np.int64)
    cuts = list(zip(at, at[1:], strict=False))
    return pa.table({
        "kind": group.column("kind"), "bucket": group.column("bucket"), "chunk": group.column("chunk"),
        "counts": pa.array([planes(counts[a:b]) for a, b in cuts], pa.binary()),
        "bits": pa.array([bits(np.concatenate([first[a:b], used[a:b]])) for a, b in cuts], pa.binary()),
        "stats": pa.array([stats.tolist()] + [None] * (len(parts) - 1), pa.list_(pa.int64())),
    })


@trimmed
def weigh(group: pa.Table) -> pa.Table:
    """Backoff weight of each context of a bucket, for each block that asked."""
    group = group.sort_by("chunk")
    parts = [blocks.unpack(blocks.loosen(x)) for x in group.column("names").to_pylist()]
    names = np.concatenate(parts)
    order = np.argsort(names, kind="stable")
    head = np.flatnonzero(np.diff(names[order], prepend=names[order[0]] + U(1)))
    sums = (np.concatenate([from_planes(x).view(np.float64) for x in group.column(c).to_pylist()]) for c in ("seen", "own"))
    seen, own = (np.add.reduceat(s[order], head) for s in sums)
    weight = np.empty(len(names))
    weight[order] = np.repeat((1 - seen) / (1 - own), np.diff(np.append(head, len(order))))
    at = np.cumsum([0, *map(len, parts)])
    return pa.table({"bucket": group.column("bucket"), "chunk": group.column("chunk"), "weights": pa.array([weight[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())})


def score(docs: DataFrame, held: Column, stage: bool = True, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; rows not held out train.

    order: words of the longest n-grams, from 2. stage=False: docs is a plain read of files, which is read twice as it
    is instead of being copied first.
    """
    assert order >= 2
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = staged(docs, "katz-input") if stage else docs
    block = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    part = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(F.input_file_block_length() / CHUNK_BYTES)))
    docs = docs.withColumn("held_out", held).withColumn("block", block).withColumn("chunk", F.xxhash64("block", part))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_width(spark), size // BUCKET_BYTES)
    summed = ask_counts(docs, buckets, order).groupBy("kind", "bucket").applyInArrow(sum_counts, SUMMED)
    model = staged(summed, "katz-counts")
    del summed
    remove_unused(spark)
    sums_of = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(TOP + 4)]
    got = {r.kind: r for r in model.where("stats is not null").groupBy("kind").agg(*sums_of).collect()}
    levels = []
    for k in range(order):
        s = np.array([got[k][f"s{i}"] if k in got else 0 for i in range(TOP + 4)], np.int64)
        levels.append(Level(s[: TOP + 2], int(s[-2]), int(s[-1])))
    words = levels[0]
    unknown = words.unseen()
    total, base_of = words.total, words.total + 0.1 * (words.distinct + 1)

    def evaluate(rows: pa.Table, replies: pa.Table) -> pa.Table:
        c = Chunk(text_bytes(rows.column("text")), rows.column("held_out").to_numpy(zero_copy_only=False), order)
        rows = rows.drop_columns(["text"])
        columns = [replies.column(n).to_pylist() for n in ("kind", "bucket", "counts", "bits")]
        said = {(k, b): (x, y) for k, b, x, y in zip(*columns, strict=True)}
        del columns
        n, first, used = [], [], []
        for k, names in enumerate(c.names):
            counts, flags = np.empty(len(names), np.int64), np.empty((2, len(names)), bool)
            for bucket, a, b in blocks.cut(names, buckets):
                x, y = said.pop((k, bucket))
                counts[a:b] = from_planes(x)
                flags[:, a:b] = from_bits(y, 2 * (b - a)).reshape(2, -1)
            n.append(counts)
            first.append(flags[0])
            used.append(flags[1])
        assert not said, "an answer for names that nobody has"
        n_docs = rows.num_rows
        by_doc = lambda x: np.bincount(c.doc, weights=x, minlength=n_docs)
        base = by_doc(np.log10((n[0] + 0.1) / base_of)[c.of[0]])
        known = by_doc((n[0] > 0)[c.of[0]].astype(float)).astype(np.int64)
        chance = np.where(n[0] > 0, words.kept(n[0]) / max(1, total), unknown)
        log = np.log10(chance)[c.of[0]]
        end = blocks.find(c.names[0], np.array([END], U))[0]
        asked, backs = [], []  # contexts by level; for backed-off tokens: level, place and text
        for k in range(1, order):
            as_context = np.append(n[0], n[0][end]) if k == 1 else n[k - 1]  # the begin stands before every end
            seen = n[k] > 0
            direct = np.where(seen, levels[k].kept(n[k]) / np.maximum(1, as_context[c.context[k]]), 0.0)
            # Weights: sums over n-grams that are counted here and nowhere else; the shorter n-gram of a seen one is seen.
            here = seen & first[k]
            sums = [np.bincount(c.context[k][here], x[here], len(as_context)) for x in (direct, chance[c.lower[k]])]
            has = np.flatnonzero(c.of[k] >= 0)
            gram = c.of[k][has]
            hit = seen[gram]
            log[has[hit]] = np.log10(direct[gram[hit]])
            missed, context = has[~hit], c.context[k][gram[~hit]]
            missed, context = missed[as_context[context] > 0], context[as_context[context] > 0]
            wanted = (np.append(used[0], True) if k == 1 else used[k - 1]) & (sums[0] > 0)
            wanted[context] = True
            names = (np.append(c.names[0], BEGIN) if k == 1 else c.names[k - 1])[wanted]
            place = np.full(len(as_context), -1, np.int64)
            place[wanted] = np.arange(len(names)) + sum(len(x[0]) for x in asked)
            asked.append((names, sums[0][wanted], sums[1][wanted]))
            backs.append((place[context], c.doc[missed]))
            chance = direct
        names, *sums = (np.concatenate(x) for x in zip(*asked, strict=True))
        by_name = np.argsort(names, kind="stable")
        names, sums = names[by_name], [s[by_name].view(np.uint64) for s in sums]
        parts = blocks.cut(names, buckets)
        asks = [
            {"bucket": k, "names": blocks.squeeze(blocks.pack(names[a:b])), "seen": planes(sums[0][a:b]), "own": planes(sums[1][a:b])}
            for k, a, b in parts
        ]
        # Backed-off tokens of each text: places in the asked names.
        rank = np.empty(len(names), np.int32)
        rank[by_name] = np.arange(len(names), dtype=np.int32)
        place, doc = (np.concatenate(x) for x in zip(*backs, strict=True))
        by_text = np.argsort(doc, kind="stable")
        place = rank[place[by_text]]
        cut = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))])
        out = pa.table({
            "chunk": pa.array([rows.column("chunk")[0].as_py()] * n_docs, pa.int64()),
            "doc_id": rows.column("doc_id").combine_chunks(), "held_out": rows.column("held_out").combine_chunks(),
            "n_tokens": pa.array(c.lengths, pa.int64()), "n_known": pa.array(known),
            "base_score": pa.array(base), "score": pa.array(by_doc(log)),
            "backs": pa.array([place[a:b].tobytes() if b > a else None for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
            "asks": pa.array([asks] + [None] * (n_docs - 1), pa.list_(pa.struct([("bucket", pa.int32()), ("names", pa.binary()), ("seen", pa.binary()), ("own", pa.binary())]))),
        })
        del c, asks
        trim()
        return out

    result = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    half = f"chunk long, {result}, backs binary, asks array<struct<bucket:int,names:binary,seen:binary,own:binary>>"
    rows = docs.drop("block").groupBy("chunk")
    halves = staged(rows.cogroup(model.drop("stats").groupBy("chunk")).applyInArrow(evaluate, half), "katz-halves")
    del rows
    remove_unused(spark, model)
    asks = halves.where("asks is not null").select("chunk", F.explode("asks").alias("a")).select("chunk", "a.*")
    weights = asks.groupBy("bucket").applyInArrow(weigh, "bucket int, chunk long, weights binary")

    @trimmed
    def finish(rows: pa.Table, replies: pa.Table) -> pa.Table:
        replies = replies.sort_by("bucket")
        raw = b"".join(replies.column("weights").to_pylist())
        log = np.log10(np.frombuffer(raw, np.float64))
        more = [log[np.frombuffer(x, np.int32)].sum() if x else 0.0 for x in rows.column("backs").to_pylist()]
        rows = rows.set_column(rows.column_names.index("score"), "score", pa.array(rows.column("score").to_numpy() + np.array(more)))
        return rows.select(["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = halves.drop("asks").groupBy("chunk").cogroup(weights.groupBy("chunk")).applyInArrow(finish, result)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out(F.col("doc_id")), stage=False)
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})
