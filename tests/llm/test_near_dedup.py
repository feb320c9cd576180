import random

import numpy as np
import pytest

from lumenquad.llm import near_dedup as nd


def brute(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return [(len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n\t", "one", "ONE", "two words", "Two  Words", "é É", "é é"]
    for _ in range(60):
        base = [r.choice(words) for _ in range(r.randrange(5, 150))]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 2, 12])):
            copy = list(base)
            for _ in range(r.randrange(0, max(1, len(base) // 12) + 1)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy).upper() if r.random() < 0.5 else "  ".join(copy))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,k,run", [(1, 2, 1024), (2, 5, 128), (3, 2, 8), (4, 2, 2)])
def test_equals_brute_force(spark, seed, k, run):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n int, node string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_dedup(df, k, 80, run).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, k, 80)


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (5, "a b c")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in nd.near_dedup(df, 2).collect()), key=str)
    assert got == [(3, 3, True), (3, 3, True), (5, 3, False), (None, None, True)]
    assert nd.near_dedup(df.limit(0), 2).count() == 0


def test_runs_by_common_prefix():
    """Runs are regions, or deeper prefixes that few enough share; equal signatures can't be told apart."""
    name = np.array([1] * 6 + [2] * 2)
    sig = np.zeros((8, nd.SIGNATURE), np.uint16)
    sig[2:6, 3], sig[3:6, 9] = 1, 1
    r = nd.runs_of(name, sig, 3)
    assert len({*r[:2]}) == 1 and len({*r[3:6]}) == 1 and len({*r[6:]}) == 1 and len(set(r.tolist())) == 4
    assert len(set(nd.runs_of(name, sig, 8).tolist())) == 2
