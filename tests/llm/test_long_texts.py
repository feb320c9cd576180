"""Very long texts, clashing column names and nulls in every column, through each operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquad.llm import decontamination, html_extraction, katz, near_dedup, packing, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts
from lumenquad.llm.common import tokenizer_path, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, chunk string, part string, kept string, shard string, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    words = [f"w{r.randrange(5000)}é" for _ in range(150_000)]
    texts = [" ".join(words), "x" * 300_000, "ab " * 100_000, "\n" * 50_000, None, "", "plain words here and there"]
    rows = [(i, t, *[None] * 9) for i, t in enumerate(texts)] + [(None,) * 11, (6, texts[6], *["clash"] * 2, 1, *["clash"] * 6)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_all_operators(spark, docs):
    n = docs.count()
    path = tokenizer_path("byte_bpe_50k.json")
    labels = spark.createDataFrame([(None, None, None), (0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, None), (1, "plain words here and there"), (2, "")], "item_id long, text string")
    pieces = packing.pack(docs, path)
    assert pieces.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).where("n % doc_tokens <> 0").isEmpty()
    assert quality_classifier.classify(docs, quality_classifier.train(docs, labels)).count() == n
    assert near_dedup.near_dedup(docs, 2).count() == n
    assert katz.score(docs, katz.held_out(F.col("doc_id"))).count() == n
    assert sharding.shard(docs, 3).count() == n
    assert token_counts.token_counts(docs, token_counts.vocabulary(tokenizer_path("piece_bpe_32k.model"))).count() == n
    assert {(r.doc_id, r.item_id) for r in decontamination.search(docs, bench).collect()} == {(6, 1)}
    assert decontamination.decontaminate(docs, bench).count() == n - 2
    cut = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert cut[1].n_removed == cut[1].n_bytes == 300_000 and cut[0].n_removed == 0 and cut[3].n_removed == 50_000
    assert quality_rules.quality_rules(docs).count() == n
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), "part", "size")
    assert html_extraction.extract(pages).count() == n


def test_anchors_beyond_the_packed_range():
    r = np.random.default_rng(0)
    raw = r.integers(0, 256, (1 << 24) + 5_000, dtype=np.uint8).tobytes()
    a = suffix_dedup.Anchors(raw, 200, 104)
    assert (a.lo <= a.q).all() and (a.q <= a.lo + 103).all() and (a.q >= a.hi).all() and a.hi[-1] == len(raw) - 200 and (a.lo[1:] == a.hi[:-1] + 1).all()
    b = suffix_dedup.Anchors(raw[-9_000:], 200, 104)
    shift = len(raw) - 9_000
    assert set(b.q[3:] + shift) <= set(a.q)


def test_word_hashes_follow_words():
    r = random.Random(2)
    for _ in range(200):
        t = "".join(r.choice(["a", "bc", "é", " ", "\n", "\x0b", "漢"]) for _ in range(r.randrange(40))).encode()
        h, w = word_hashes(t), t.split()
        assert len(h) == len(w) and all((h[i] == h[j]) == (w[i] == w[j]) for i in range(len(w)) for j in range(i))
