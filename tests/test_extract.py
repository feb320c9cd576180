"""Replies and the codes they stand for."""

import pytest
from pyspark.sql import functions as F

from lumenquad.functions import extract
from lumenquad.functions.pythonic import nfkc

YES_NO = [
    ("", -1), ("   ", -1), (None, -1), ("Yes.", 1), ("no", 0), ("know", -1), ("yes ok", 1), ("Answer：No", 0), ("No; x", -1), ("Answer: yes ... no", 1), ("no. Final answer: YES", 1),
    ("éno way", -1), ("I say no, really", 0), ("prediction : no", 0), ("yesterday", -1), ("(yes)", 1),
]
TWO_WAY = [
    ("A", 1), ("A.", 1), ("A.x", 1), ("(B)", 0), ("option B", 0), ("Option: b", 0), ("B is my answer, not A", 0), ("final answer: A", 1), ("the answer could be B", 0), ("neither", -1), ("[ b ]", 0), ("A/B", -1), ("choice A or B", 1),
]
FOUR_WAY = [("answer: (C", 2), ("Option D", 3), ("{b}", 1), ("c", -1), ("etc.", -1), ("It is C.", 2), ("a dog", -1), ("B/C", -1), ("so D it is", 3)]
OPTIONS = ["A. a red car", "B. two dogs", "C. xyz", "D. nothing at all."]
CHOICE = [
    ("A person walks. B", 1), ("The best answer is clearly B", 2), ("best answer is about", 0), ("Answer: d", 3), ("C) since", 2), ("D", 3), ("[A]", 0), ("etc.", -1), ("c", -1), ("it shows two dogs running", 1), ("two dogs and a red car", -1), ("xyz", -1),
    ("Nothing at all happens", 3), ("A person walks", -1), ("I pick B over C", 2), (None, -1),
]


def codes(spark, rows, function):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").withColumn("n", nfkc("t"))
    got = {r.i: r.c for r in df.select("i", F.when(F.col("n") == "", -1).otherwise(function(F.col("n"))).alias("c")).collect()}
    return [got[i] for i in range(len(rows))]


@pytest.mark.parametrize(
    "rows,function",
    [(YES_NO, extract.yes_no), (TWO_WAY, extract.two_way), (FOUR_WAY, extract.four_way), (CHOICE, lambda c: extract.choice(c, F.array(*map(F.lit, OPTIONS))))],
    ids=["yes_no", "two_way", "four_way", "choice"],
)
def test_codes(spark, rows, function):
    assert codes(spark, rows, function) == [c for _, c in rows]


def test_dispatch_labels_and_gold(spark):
    df = spark.createDataFrame([("yes", "yes_no"), ("B", "multiple_choice"), ("answer: C", "multiple_choice_4"), ("D", "mcq4"), ("", "unheard of")], "n string, k string")
    got = df.select(extract.answer(F.col("n"), F.col("k")).alias("c"), F.col("k")).withColumn("l", extract.label(F.col("c"), F.col("k"))).collect()
    assert [(r.c, r.l) for r in got] == [(1, "yes"), (0, "b"), (2, "c"), (3, "d"), (-1, "")]
    with pytest.raises(Exception, match="unknown item type"):
        spark.createDataFrame([("x", "unheard of")], "n string, k string").select(extract.answer(F.col("n"), F.col("k"))).collect()
    gold = spark.createDataFrame([("b",), ("(C)",), ("?",), (None,)], "a string").select(extract.gold_letter(F.col("a")).alias("g")).collect()
    assert [r.g for r in gold] == [1, 2, -1, -1]
