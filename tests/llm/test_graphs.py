import random

from lumenquad.llm.graphs import AT_ONCE, components


def test_equals_union_find(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    r.shuffle(edges)
    for at_once in (AT_ONCE, 0):  # by one task, by stars
        links = spark.createDataFrame(edges, "a long, b long").repartition(5)
        got = {x.node: x.component for x in components(links, at_once=at_once).collect()}
        assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
        assert components(spark.createDataFrame([], "a long, b long"), at_once=at_once).count() == 0
