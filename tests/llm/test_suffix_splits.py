import random

from lumenquad.llm.suffix_dedup import suffix_dedup

from .test_suffix_dedup import brute


def test_staged_file_of_many_row_groups(spark):
    """Row groups that end inside a chunk are read by several tasks."""
    r = random.Random(11)
    prose = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passages = [prose(r.randrange(220, 400)) for _ in range(8)]
    texts = [prose(r.randrange(100, 500)) + (r.choice(passages) + prose(40) if r.random() < 0.3 else "") for _ in range(1500)]
    hadoop = spark._jsc.hadoopConfiguration()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    hadoop.setInt("parquet.block.size", 64 << 10)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        got = {x.doc_id: tuple(x)[1:] for x in suffix_dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    finally:
        hadoop.unset("parquet.block.size")
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [got[i] for i in range(len(texts))] == brute(texts)
