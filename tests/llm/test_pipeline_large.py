import corpus_pipeline
from .test_near_large import variants


def test_one_of_over_large_variants_survives(spark):
    texts = variants(900) + ["a text that stands alone"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted(r.doc_id for r in got) == [0, len(texts) - 1]
