"""Quality rules with host verdicts.

Every document is measured once (words, symbols, repeated lines and 3-word windows) and tested by simple rules; the
measures are staged as narrow rows. Failures of each rule are counted by domain (the `source` column). For each rule a
beta prior is fitted to the domains' rates by moments; a domain's posterior under it gives its shrunk rate and, two
deviations below, the rate that it has at least. Verdicts are joined back to the documents:

- a domain that fails any rule at a rate of over `max_rate`, at least, goes as a whole;
- a domain that fails the rule of symbols or of repeated lines at a rate of `habit` or more, at least, has it as a habit:
  its documents that fail it go. Where such failures are accidents, they stay: a page of formulas on a clean domain.

A small domain borrows the others' evidence, so what is a habit of all is taken for one of its own.

Defined cases: null text counts as empty (no words: the base rule fails); a null source has no domain, so only the
base rule speaks; very long texts are measured whole, one at a time beyond 4 MB; ties don't arise; repeated rows each
count; an empty table gives no rows; other columns are ignored. Windows are told
apart by 64-bit hashes within one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, SYMBOLS, pieces, shingle_hashes, staged, text_bytes, word_hashes

MEASURES = "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"


def repeated_words(h: np.ndarray) -> int:
    """Words (by their hashes) that lie in a 3-word window found at least twice."""
    n = len(h)
    if n < 4:
        return 0
    key = shingle_hashes(h, 3)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : i + n - 2] |= again
    return int(covered.sum())


def lines_of(text: bytes) -> list[bytes]:
    """Lines that hold a word."""
    return [x for x in text.split(b"\n") if x.strip()]


def measure(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            rows = []
            for text in text_bytes(batch.column(2)):
                h, lines = word_hashes(text), lines_of(text)
                rows.append((len(h), len(text.decode("utf-8", "replace")) - len(text) + len(text.translate(None, SPACES)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), len(lines), repeated_words(h)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6))], names=[x.split()[0] for x in MEASURES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, MEASURES)


#: Rules whose failures are counted by domain, by their columns.
COUNTED = ["rules_failed", "symbols_failed", "lines_failed"]


def host_verdicts(measured: DataFrame, max_rate: float = 0.5, habit: float = 0.01) -> DataFrame:
    """One row a domain: documents, failures by rule, the shrunk rate of any failure, and the verdicts."""
    counts = [F.count_if(c).alias(f"{c}_n") for c in COUNTED]
    hosts = measured.where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("host_docs"), *counts)
    rate = lambda c: F.col(f"{c}_n") / F.col("host_docs")
    # One row comes to the driver. Beta by moments: a + b = m (1 - m) / v - 1, held to 1 .. 1000, so that few or equal
    # domains still give a prior.
    moments = hosts.agg(*(f(rate(c)).alias(f"{n}_{c}") for c in COUNTED for n, f in (("m", F.avg), ("v", F.var_pop)))).first()
    means, least = {}, {}
    for c in COUNTED:
        m, v = moments[f"m_{c}"] or 0.0, moments[f"v_{c}"] or 0.0
        strength = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v else 1000.0
        a, n = F.col(f"{c}_n") + m * strength, F.col("host_docs") + strength
        means[c] = a / n
        least[c] = means[c] - 2 * F.sqrt(means[c] * (1 - means[c]) / (n + 1))
    return hosts.withColumns({
        "host_rate": means["rules_failed"], "host_kept": least["rules_failed"] <= max_rate,
        "symbols_habit": least["symbols_failed"] >= habit, "lines_habit": least["lines_failed"] >= habit,
    })


def quality_rules(docs: DataFrame, max_rate: float = 0.5, habit: float = 0.01, min_words: int = 50, max_repeat_percent: int = 50, max_symbols_per_word: float = 0.5, max_dup_line_percent: int = 60) -> DataFrame:
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    symbols, lines = F.col("n_symbols") > max_symbols_per_word * F.col("n_words"), 100 * F.col("n_dup_lines") > max_dup_line_percent * F.col("n_lines")
    measured = measure(docs).withColumns({"base_failed": failed, "symbols_failed": symbols, "lines_failed": lines})
    measured = staged(measured.withColumn("rules_failed", F.col("base_failed") | F.col("symbols_failed") | F.col("lines_failed")), "rules")
    hosts = host_verdicts(measured, max_rate, habit).select("source", "host_rate", "host_kept", "symbols_habit", "lines_habit")
    gone = ~F.col("host_kept") | (F.col("symbols_failed") & F.col("symbols_habit")) | (F.col("lines_failed") & F.col("lines_habit"))
    judged = measured.join(hosts, "source", "left").withColumn("host_gone", F.coalesce(gone, F.lit(False)))
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("host_gone"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "source", F.round("host_rate", 6).alias("host_rate"), "host_gone")
