"""Packing by concatenate and cut.

Each partition tokenizes its documents and notes, for each, the tokens before it in that partition (first pass).
The driver sums the partition totals, one number a partition, to global offsets; each document then cuts itself at
the multiples of the window (second pass). No shuffle, and no step needs more than one document at a time.

Defined cases: null and empty texts are one end token; repeated rows are packed once for each row; an empty table
gives no rows; other columns are ignored. Rows with a null doc_id are packed, too, with a null doc_id.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32, pieces, staged, tokenizer_path

TOKENIZED = "doc_id long, part int, first_token long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Ids:
    """Token ids of texts as bytes, by the tokenizer of a file.

    Where a table of the same byte-level BPE lies beside it as ranks (`.tiktoken`), texts of Latin-1 characters without
    the strings of added tokens take the faster library: same ranks, same pre-tokens (a test holds both together). All
    other texts take the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.fast = None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def slow(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        plain = self.fast is not None and not any(t in text for t in self.added)
        if plain and not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                plain = False
        return np.asarray(self.fast.encode_ordinary(text) if plain else self.slow(text), self.dtype).tobytes()


@functools.cache
def ids_of(path: str) -> Ids:
    """One a worker: tasks that follow in the same worker use it again."""
    return Ids(path)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Ids of each row with the end id, the partition it lies in and the tokens before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, ids = TaskContext.get().partitionId(), 0, ids_of(tokenizer)
        end = np.asarray([end_id], ids.dtype).tobytes()
        for batch in pieces(batches, 1):
            rows = [ids.of(t or "") + end for t in batch.column(1).to_pylist()]
            lengths = np.fromiter(map(len, rows), np.int64, len(rows)) // ids.dtype.itemsize
            before = at + np.cumsum(lengths) - lengths
            at += int(lengths.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(rows), part, np.int32)), pa.array(before), pa.array(rows, pa.binary())], names=["doc_id", "part", "first_token", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TOKENIZED)


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, wide: bool | None = None) -> DataFrame:
    """Pieces of documents in sequences of `length` tokens, each sequence but the last full. Also the ids (binary)."""
    size = ids_of(tokenizer).dtype.itemsize if wide is None else 4 if wide else 2
    table = staged(tokenize(docs, tokenizer, end_id), "pack")
    # One row a partition comes to the driver: its total.
    totals = table.groupBy("part").agg(F.max(F.col("first_token") + F.length("ids") / size).cast("long").alias("n")).collect()
    offsets, at = {}, 0
    for r in sorted(totals, key=lambda r: r.part):
        offsets[r.part], at = at, at + r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3):
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for doc, part, first, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, f"<u{size}").astype("<u4")
                begin, n = offsets[part] + first, len(ids)
                cuts = [0, *range(length - begin % length, n, length), n]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    piece = ids[a:b].tobytes()
                    for k, v in zip(out, (doc, a, b - a, crc32(piece), n, (begin + a) // length, (begin + a) % length, piece), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for k, v in out.items() if k != "ids"), pa.array(out["ids"], pa.binary())], names=list(out))

    return table.mapInArrow(run, PIECES + ", ids binary")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer_path("byte_bpe_50k.json")).drop("ids")
