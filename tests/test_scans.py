"""Running values over range parts: one long key cut into many parts gives what one pass over it gives."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lumenquad.operators import ranking, segments, work
from lumenquad.operators.scans import Scan

PARTS = [None, 7, 60]


def rows_of(n, seed=1):
    r = random.Random(seed)
    return [(k, i, r.choice([None, r.randrange(100) / 4]), r.randrange(50)) for i in range(n) for k in [r.choice(["hot"] * 8 + ["b", None])]]


def table(spark, rows):
    r = random.Random(3)
    return spark.createDataFrame(r.sample(rows, len(rows)), "k string, i long, x double, y int").repartition(3)


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: r[1]):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("parts", PARTS)
def test_running_mean(spark, parts):
    rows = rows_of(300)
    want = []
    for group in by_key(rows).values():
        seen = []
        for k, i, x, _ in group:
            seen += [] if x is None else [x]
            want.append((k, i, sum(seen) / len(seen) if seen else None))
    got = ranking.running_mean(table(spark, rows), ["k"], "i", "x", "m", parts).select("k", "i", F.round("m", 9)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(((k, i, m if m is None else round(m, 9)) for k, i, m in want), key=lambda r: r[1])


@pytest.mark.parametrize("parts", PARTS)
def test_gates(spark, parts):
    rows, want = rows_of(300, 2), {}
    for group in by_key(rows).values():
        free = float("-inf")
        for _, i, _, y in group:
            start = max(y, free)
            want[i], free = start, start + 0.5
    got = {r.i: round(r.start, 9) for r in work.gated(table(spark, rows), ["k"], "y", "i", 0.5, parts).collect()}
    assert got == want


@pytest.mark.parametrize("parts,ahead", [*itertools.product(PARTS, [2]), (60, 40), (7, 1)])
def test_next_keys_over_several_parts(spark, parts, ahead):
    rows, want = rows_of(400, 4), {}
    for k, group in by_key(rows).items():
        first = list(dict.fromkeys(y for *_, y in group))
        want |= {(k, y): first[n + 1 : n + 1 + ahead] for n, y in enumerate(first)}
    got = {(r.k, r.y): r.next_keys for r in ranking.next_distinct(table(spark, rows), "k", "y", "i", ahead, parts).collect()}
    assert got == want


@pytest.mark.parametrize("parts", PARTS)
def test_valleys_and_peaks(spark, parts):
    r = random.Random(5)
    series = {"hot": [r.randrange(6) for _ in range(260)], "one": [1], "two": [2, 1], "flat": [3] * 40, None: [r.randrange(3) for _ in range(30)]}
    df = spark.createDataFrame([(k, i, float(x)) for k, s in series.items() for i, x in enumerate(s)], "key string, pos long, score double").repartition(3)
    low, high = set(), set()
    for k, s in series.items():
        n = len(s)
        at = [i for i in range(n) if i in (0, n - 1) or (s[i] <= s[i - 1] and s[i] <= s[i + 1])]
        low |= {(k, i) for i in at}
        high |= {(k, max(range(a, b + 1), key=lambda i: (s[i], -i))) for a, b in itertools.pairwise(at)} if n > 1 else {(k, 0)}
    got = segments.valleys(df, parts=parts)
    assert got.columns == ["key", "pos", "score"] and {(x.key, x.pos) for x in got.collect()} == low
    found = segments.basin_peaks(df, parts=parts).collect()
    assert {(x.key, x.pos) for x in found} == high and len(found) == len(high)


@pytest.mark.parametrize("parts", PARTS)
def test_intervals(spark, parts):
    r = random.Random(6)
    clips = [(k, lo, lo + r.randrange(40 if r.random() < 0.05 else 5)) for _ in range(250) for k, lo in [(r.choice(["hot"] * 6 + ["b", None]), r.randrange(900))]] + [("hot", 100, 700)]
    want = []
    for k in {c[0] for c in clips}:
        islands = []
        for _, lo, hi in sorted(c for c in clips if c[0] == k):
            if islands and lo <= islands[-1][1]:
                islands[-1] = (islands[-1][0], max(islands[-1][1], hi), islands[-1][2] + 1)
            else:
                islands.append((lo, hi, 1))
        want += [(k, *x) for x in islands]
    got = segments.merged(spark.createDataFrame(clips, "k string, lo int, hi int").repartition(3), ["k"], parts=parts)
    assert sorted(map(tuple, got.select("k", "lo", "hi", "n_merged").collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("parts", PARTS)
def test_intervals_without_bounds(spark, parts):
    """Null bounds come last, as in the query's SQL: (5, 7) and (5, null) are one interval, and so is a null one behind."""
    r = random.Random(7)
    clips = [(k, None if r.random() < 0.1 else lo, None if r.random() < 0.2 else lo + r.randrange(4)) for _ in range(150) for k, lo in [(r.choice(["hot"] * 4 + ["b"]), r.randrange(300))]]
    clips += [("one", 5, None), ("one", 5, 7), ("one", None, 9), ("one", None, None), ("open", 1, None), ("open", 2, None), ("open", 2, 3), ("none", None, None), ("none", None, None)]
    want = []
    for k in {c[0] for c in clips}:
        islands, reach = [], None
        for _, lo, hi in sorted((c for c in clips if c[0] == k), key=lambda c: [(x is None, x or 0) for x in c[1:]]):
            if reach is None or (lo is not None and lo > reach):
                islands.append([lo, hi, 0])
            own = islands[-1]
            own[1] = hi if own[1] is None else own[1] if hi is None else max(own[1], hi)
            own[2] += 1
            reach = hi if reach is None else reach if hi is None else max(reach, hi)
        want += [(k, *x) for x in islands]
    assert {x for x in want if x[0] in ("one", "none")} == {("one", 5, 9, 4), ("none", None, None, 1)}
    got = segments.merged(spark.createDataFrame(clips, "k string, lo int, hi int").repartition(3), ["k"], parts=parts)
    assert sorted(map(tuple, got.select("k", "lo", "hi", "n_merged").collect()), key=str) == sorted(want, key=str)


def test_equal_intervals_are_one(spark):
    """Many rows of equal bounds, as in repeated tables: however they are dealt, no interval overlaps or touches another."""
    df = spark.range(6000).select((F.col("id") % 3).alias("k"), (F.col("id") % 5 * 10).alias("lo"), (F.col("id") % 5 * 10 + 1 + F.col("id") % 7).alias("hi"), (F.col("id") % 50).alias("s"))
    want = {(k, lo, lo + 7, 400) for k in range(3) for lo in range(0, 50, 10)}
    for parts in PARTS:
        got = segments.merged(df.repartition(5, "s"), ["k"], value="s", parts=parts).collect()
        assert len(got) == len(want) and {(x.k, x.lo, x.hi, x.n_merged) for x in got} == want


def test_states_are_few(spark):
    """Only keys that go over a border have states, however many keys there are."""
    df = spark.range(5000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("i"))
    scan = Scan(df, ["k"], ["i"], 9)
    assert scan.rows.select("_part").distinct().count() == 9 and scan.states(scan.rows, n=F.count("*")).count() <= 18
    plan = scan.running_sum(scan.rows, F.lit(1), "n")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert [r.n for r in scan.running_sum(scan.rows, F.lit(1), "n").where("k = -1").orderBy("i").collect()] == list(range(1, 2501))


@pytest.mark.parametrize("parts", PARTS)
def test_empty(spark, parts):
    df = table(spark, rows_of(5)).limit(0)
    assert ranking.running_mean(df, ["k"], "i", "x", "m", parts).count() == 0 and work.gated(df, ["k"], "y", "i", 0.5, parts).count() == 0 and ranking.next_distinct(df, "k", "y", "i", 2, parts).count() == 0
