import random
import re

import pytest

import corpus_pipeline
from lumenquad.llm import quality_classifier as qc
from lumenquad.llm.common import tokenizer_path
from lumenquad.llm.packing import Ids

from .test_decontamination import brute as leaks
from .test_near_dedup import brute as near
from .test_quality import corpus


def removed(texts, width=200):
    from collections import Counter

    raws = [t.encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append(bytes(c for c, g in zip(r, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows, labels = corpus(200, 3)
    r = random.Random(9)
    passage = " ".join(f"passage{r.randrange(99)}" for _ in range(60))
    item = " ".join(f"item{r.randrange(99)}" for _ in range(30))
    n = len(rows)
    rows += [(n, rows[0][1], "s"), (n + 1, rows[0][1] + " End.", "s"), (n + 2, rows[1][1] + " " + passage, "s"), (n + 3, passage + ". " + rows[2][1], "s"), (n + 4, rows[3][1] + " " + item + ".", "s"), (n + 5, None, None), (n + 6, "", "s")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item), (1, "other thing of this benchmark that nobody holds at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_equal_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    model = qc.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = {r.doc_id: r.text for r in qc.classify(docs, model).where("quality_kept").collect()}
    ids = sorted(want)
    want = {d: want[d] or "" for d, (_, _, kept) in zip(ids, near([want[d] for d in ids], 5, 80), strict=True) if kept}
    want = dict(zip(want, removed(list(want.values())), strict=True))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = {d for d, _ in leaks(list(want.items()), items)}
    assert found
    want = {d: t for d, t in want.items() if d not in found}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k == 3:
            got = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
            assert got == {d: (t, len(t)) for d, t in want.items()}
    tokens = Ids(tokenizer_path("byte_bpe_50k.json"))
    total = {r.doc_id: r.doc_tokens for r in docs.collect()}
    assert total == {d: len(tokens.slow(t)) + 1 for d, t in want.items()}
    ran = {(r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()}
    assert {(d, s) for d, s, _ in ran} >= {(d, 0) for d in total}
    assert len(corpus_pipeline.STAGES) == 5 and not re.search("_$", corpus_pipeline.STAGES[0][0])


def test_near_duplicates_of_repeated_rows(spark, folder):
    df = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11)] * 2 + [(2, "a b c d e f", "en", "s", 11), (None, "z", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, df, folder).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1]


def test_empty_tables_and_further_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_text string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
