import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquad.llm import katz


def level(counts):
    n = np.zeros(katz.TOP + 2, np.int64)
    for c in counts.values():
        if c <= katz.TOP + 1:
            n[c] += 1
    return katz.Level(n, len(counts), sum(counts.values()))


def brute(texts, held, order):
    """A context is a tuple of words, 0 the begin, None the end."""
    words = [(t or "").lower().split() + [None] for t in texts]
    grams, followers = [Counter() for _ in range(order)], defaultdict(set)
    history = lambda w, i, k: tuple([0, *w][max(0, i + 1 - k) : i + 1])
    for w, h in zip(words, held, strict=True):
        if not h:
            for i, x in enumerate(w):
                for k in range(min(order, i + 2)):
                    grams[k][*history(w, i, k), x] += 1
                    followers[history(w, i, k)].add(x)
    levels = [level(g) for g in grams]
    kept = lambda k, c: float(levels[k].kept(np.array([c]))[0])
    n = sum(grams[0].values())
    size = Counter()
    for g in grams[1:]:
        for (*h, _), c in g.items():
            size[tuple(h)] += c
    alphas = {}

    def alpha(h):
        if h not in alphas:
            alphas[h] = (1 - sum(p(h, w) for w in followers[h])) / (1 - sum(p(h[1:], w) for w in followers[h])) if h in followers else 1.0
        return alphas[h]

    def p(h, w):
        c = grams[len(h)][*h, w]
        if not h:
            return kept(0, c) / n if c else levels[0].unseen()
        return kept(len(h), c) / size[h] if c else alpha(h) * p(h[1:], w)

    vocabulary = [x for (x,) in grams[0]]
    seen = sorted((h for h in followers if len(h) == order - 1), key=str)
    for h in [(), (0,), ("never",), *seen[:10], *seen[-10:], ("never",) * (order - 1)]:
        # exactly normalised over the vocabulary and the unknown word
        assert math.isclose(sum(p(h, w) for w in [*vocabulary, "unknown"]), 1, rel_tol=1e-9)
    out = []
    for w in words:
        base = sum(math.log10((grams[0][x,] + 0.1) / (n + 0.1 * (len(grams[0]) + 1))) for x in w)
        score = sum(math.log10(p(history(w, i, order - 1), x)) for i, x in enumerate(w))
        out.append((len(w), sum(grams[0][x,] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize(("parts", "order"), [(1, 2), (5, 2), (1, 3), (5, 3), (3, 4)])
def test_equals_brute_force(spark, parts, order):
    r = random.Random(parts)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(3000)]
    texts = [None, "", " \t\n", "A a A", "only-once"] + [" ".join(r.choice(vocabulary) for _ in range(r.randrange(60))) for _ in range(200)]
    texts += [texts[9]] * 3
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, chunk string").repartition(parts)
    got = {x.doc_id: x for x in katz.score(df, katz.held_out(F.col("doc_id")), order=order).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts, held, order)):
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[i], *want[:3])
        assert math.isclose(g.base_score, want[3], rel_tol=1e-9) and math.isclose(g.score, want[4], rel_tol=1e-9)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score(df, katz.held_out(F.col("doc_id"))).count() == 0
