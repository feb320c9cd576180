import random

import pytest
from pyspark.sql import functions as F

from lumenquad.llm import near_dedup as nd

from .test_near_dedup import brute


def variants(n, words=3000, seed=5):
    """n copies of one long text that differ in one word."""
    r = random.Random(seed)
    base = [f"w{r.randrange(100_000)}" for _ in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        copy[r.randrange(words)] = f"other{i}"
        out.append(" ".join(copy))
    return out


def test_over_a_thousand_variants_of_one_text_are_one_group(spark):
    texts = variants(1200) + ["another text of a few words", "one more that stands alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in nd.near_dedup(df, 2, 80).collect()}
    n = len(texts)
    assert got == {i: 0 if i < n - 2 else i for i in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_capped_regions_equal_brute_force(spark, seed):
    """Copies at about the threshold, in regions far over the run."""
    r = random.Random(seed)
    texts = []
    for _ in range(4):
        base = [f"w{r.randrange(300)}" for _ in range(r.randrange(60, 150))]
        for _ in range(40):
            copy = list(base)
            for _ in range(r.randrange(0, len(copy) // 10)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(300)}"
            texts.append(" ".join(copy[r.randrange(12) :]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in nd.near_dedup(df, 2, 80, 2).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 2, 80)


def templated(n, share, seed=3):
    """Pages of 40 shared sentences, each there at the given share."""
    r = random.Random(seed)
    sentences = [" ".join(f"s{k}w{r.randrange(10**6)}" for _ in range(9)) for k in range(40)]
    return [" ".join(s for s in sentences if r.random() < share) for _ in range(n)]


def test_a_linked_crowd_meets_few_pairs(spark, monkeypatch):
    """Pages of one component aren't met with one another by the exact filter, however many share a rare shingle."""
    across, lists_of, met = nd.across, nd.lists_of, []

    def listing(found):
        each = found.groupBy("shingle").count()
        met.append([each.agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0])
        return lists_of(found)

    def counting(lists, percent):
        sizes = lists.select("shingle", "component", F.size("members").alias("n"))
        whole = sizes.groupBy("shingle").agg(F.sum("n").alias("all")).join(sizes.groupBy("shingle", "component").agg(F.sum("n").alias("n")), "shingle")
        met[-1].append(whole.agg(F.sum(F.col("n") * (F.col("all") - F.col("n")))).first()[0] or 0)
        return across(lists, percent)

    monkeypatch.setattr(nd, "lists_of", listing)
    monkeypatch.setattr(nd, "across", counting)
    for n in (400, 1200):
        df = spark.createDataFrame(list(enumerate(templated(n, 0.9))), "doc_id long, text string").repartition(4)
        found = nd.near_dedup(df, 2, 80).groupBy("component_id").count().orderBy(F.desc("count")).collect()
        assert sum(r["count"] for r in found) == n and found[0]["count"] > 0.9 * n
    assert all(across_ * 30 < plain for plain, across_ in met), met


def test_lists_meet_as_members_would(spark, monkeypatch):
    monkeypatch.setattr(nd, "LIST", 3)
    r = random.Random(8)
    members = {n: (r.choice([1, 1, 1, 1, 2, 3, n + 100]), r.randrange(5, 12)) for n in range(60)}
    rows = [(s, n, c, size, at) for n, (c, size) in members.items() for at, s in enumerate(r.sample(range(9), 3))]
    rows += [(77, n, 1, members[n][1], 0) for n, (c, _) in members.items() if c == 1]
    found = spark.createDataFrame(rows, "shingle long, node long, component long, n long, at long")
    lists = nd.lists_of(found)
    assert 77 not in {x.shingle for x in lists.collect()} and max(len(x.members) for x in lists.collect()) < 15
    want = set()
    for s, a, ca, na, pa_ in rows:
        for t, b, cb, nb, pb in rows:
            if s == t and a < b and ca != cb and 100 * min(na, nb) >= 80 * max(na, nb) and 180 * min(na - pa_, nb - pb) >= 80 * (na + nb):
                want.add((a, b))
    got = nd.across(lists, 80).collect()
    assert len(got) == len(want) and {(x.a, x.b) for x in got} == want and want
