"""Corpus pipeline: from raw documents to packed training sequences.

The stages follow one another; each works on all its predecessor kept, whose result is written and read again between
them. All but the last return the columns of their documents.

1. quality classifier: documents that it rejects go;
2. MinHash near-dedup (five words, 0.8): one document of each group stays;
3. suffix-array dedup: bytes in 200-byte strings that repeat are cut from the texts (a document may become empty);
4. benchmark decontamination (five words, 0.8): documents that hold an item go;
5. packing into sequences of 2048 tokens.

A stage may read tables that it staged in the shared folder until its result is written; the next stage removes them.

Defined cases, beside those of the operators: null, empty and wordless texts are scored by stage 1 like others, and
those that it keeps go through unlinked, unmatched and as one piece of one token; very long texts are read whole by
each stage; empty tables of documents, labels or benchmark give no rows, scores of 0.5 (so no document is kept) or no
leaks; rows with equal doc_id are one document for stage 2, of which each distinct text stays once if the document
stays; rows without doc_id stay there; further columns come along as they are up to stage 5, whatever their names,
unless called like a result of a stage, which then stands in their place until the stage ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenquad.llm import common, decontamination, near_dedup, packing, quality_classifier, suffix_dedup

#: SQL can't express a learned classifier; tests/llm holds the other stages against brute force.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def _staging(stage: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.remove(spark, _left)
        with common.scope(_left):
            return stage(spark, docs, sf_dir)

    return run


@_staging
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.classify(docs, model, 0.7).where("quality_kept").select(*docs.columns)


@_staging
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdicts = common.staged(near_dedup.near_dedup(docs, k=5, percent=80).select("doc_id", "kept"), "near-verdicts")
    gone = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    # A list of known length goes to all tasks only below a bound.
    gone = gone if gone.count() > near_dedup.BROADCAST_ROWS else F.broadcast(gone)
    kept = docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    if not verdicts.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id is null"))
    return kept.select(*docs.columns)


@_staging
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.suffix_dedup(docs, keep_text=True).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


@_staging
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_staging
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, common.tokenizer_path("byte_bpe_50k.json")).drop("ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        out, written = stage(spark, docs, sf_dir), []
        with common.scope(written):
            docs = common.staged(out, f"pipeline-{name}")
        common.remove(spark, read)
        read = written
    packed_rows = STAGES[-1][1](spark, docs, sf_dir)
    common.remove(spark, read)  # the last stage has tokenized its documents into a table of its own
    return packed_rows
