"""The distributed segmentation against the same steps on one series in plain Python."""

import itertools
import random

import numpy as np
import pytest

from lumenquad.operators import segments

SERIES = "key string, pos int, score double, video_index int, embedding array<float>"


def window(center, size, n):
    half = (size - 1) // 2
    lo, hi = max(0, center - half), min(n - 1, center + size - 1 - half)
    lo = max(0, min(lo, hi - size + 1))
    return lo, min(n - 1, max(hi, lo + size - 1))


def brute_peaks(s):
    n = len(s)
    if n == 1:
        return [0]
    edges = sorted({0, n - 1, *(i for i in range(1, n - 1) if s[i] <= s[i - 1] and s[i] <= s[i + 1])})
    return sorted({a + int(np.argmax(s[a : b + 1])) for a, b in itertools.pairwise(edges)})


def brute_length(center, scores, vectors, most):
    values = []
    for size in range(1, most + 1):
        lo, hi = window(center, size, len(scores))
        pairs = [float(a @ b) for a, b in itertools.combinations(vectors[lo : hi + 1], 2)]
        values.append(np.mean(scores[lo : hi + 1]) - 0.5 * (np.mean(pairs) if pairs else 0.0) + 0.05 * size / most)
    return 1 + int(np.argmax(values))


def brute_plan(rows, budget):
    scores, index, vectors = [r[2] for r in rows], [r[3] for r in rows], np.array([r[4] for r in rows], np.float32).astype(float)
    peaks, k = brute_peaks(scores), min(budget, len(rows))
    if len(peaks) > k:
        peaks = [peaks[i] for i in segments.clustered(np.array(scores)[peaks], np.array(index)[peaks], k)]
    most, frames, clips = max(1, round(4 * budget / len(peaks))), {}, {}
    for c in peaks:
        size = brute_length(c, scores, vectors, most)
        s = min(2.0, max(1.0, (len(peaks) * size / budget) ** 0.5))
        lo, hi = window(c, size, len(rows))
        clips.setdefault(round(s, 3), []).append((set(range(lo, hi + 1)), s))
    for group in clips.values():
        islands = []
        for members, s in sorted(group, key=lambda g: min(g[0])):
            if islands and members & islands[-1][0]:
                islands[-1] = (islands[-1][0] | members, min(s, islands[-1][1]))
            else:
                islands.append((members, s))
        for members, s in islands:
            for i in members:
                frames[index[i]] = min(s, frames.get(index[i], s))
    return frames


@pytest.mark.parametrize("budget", [1, 6, 40])
def test_segments_equal_one_series_at_a_time(spark, budget):
    r = random.Random(budget)
    series = {f"s{k}": [(f"s{k}", i, r.random(), 7 * i + 3, [r.gauss(0, 1) for _ in range(3)]) for i in range(n)] for k, n in enumerate((1, 2, 3, 17, 30, 61))}
    df = spark.createDataFrame([x for rows in series.values() for x in rows], SERIES).repartition(3)
    got = {}
    for x in segments.segment(df, budget).collect():
        assert x.frame not in got.setdefault(x.key, {})
        got[x.key][x.frame] = x.scale
    for key, rows in series.items():
        want = brute_plan(rows, budget)
        assert got[key].keys() == want.keys() and all(abs(got[key][f] - s) < 1e-9 for f, s in want.items())
    assert segments.segment(df.limit(0), budget).count() == 0


def test_lengths_leave_null_scores_and_vectors_out(spark):
    rows = [("k", 0, 1.0, 0, [1.0, 0.0]), ("k", 1, None, 1, None), ("k", 2, 3.0, 2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, SERIES)
    anchors = spark.createDataFrame([("k", 1, 3, 3), ("k", 2, 3, 1)], "key string, pos int, n int, most int")
    assert {(x.pos, x.length) for x in segments.clip_lengths(anchors, df).collect()} == {(1, 2), (2, 1)}


def test_clusters_keep_the_best_of_each(spark):
    assert segments.clustered(np.array([1.0, 5.0, 2.0, 9.0]), np.array([0, 1, 100, 101]), 2) == [1, 3]
    assert segments.clustered(np.array([1.0, 1.0, 1.0]), np.array([0, 1, 2]), 1) == [0]


def test_lobes_equal_one_key_at_a_time(spark):
    r = np.random.default_rng(1)
    blob = lambda x, y, n: r.normal((x, y), 0.03, (n, 2))
    sets = {"apart": np.concatenate([blob(0.1, 0.5, 30), blob(0.8, 0.5, 30)]), "uneven": np.concatenate([blob(0.1, 0.5, 95), blob(0.8, 0.5, 5)]), "close": blob(0.4, 0.5, 60), "few": blob(0.4, 0.5, 19), "wide": r.random((200, 2)), "same": np.full((25, 2), 0.3)}
    rows = [(k, i, float(x), float(y)) for k, p in sets.items() for i, (x, y) in enumerate(p)]
    df = spark.createDataFrame([*rows, ("apart", 900, None, 0.5), (None, 901, 0.1, 0.1)], "key string, i int, x double, y double").repartition(3)
    got = {(x.key, x.i): x.lobe for x in segments.lobes(df, "key").collect()}
    assert len(got) == df.count() and got["apart", 900] is None and got[None, 901] is None
    for key, p in sets.items():
        want = segments.two_lobes(p)
        assert [got[key, i] for i in range(len(p))] == ([None] * len(p) if want is None else want.tolist())
    assert {k for k, p in sets.items() if segments.two_lobes(p) is not None} >= {"apart", "wide"}
    assert segments.lobes(df.limit(0), "key").count() == 0
