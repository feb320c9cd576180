import random
from collections import Counter

import tracemalloc

import numpy as np

from lumenquad.llm import decontamination as dc
from lumenquad.llm.decontamination import decontaminate, search


def weighted(a, b):
    ca, cb = Counter(a), Counter(b)
    least = sum((ca & cb).values())
    return least / (sum(ca.values()) + sum(cb.values()) - least)


def shingles(words):
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))]


def words(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()


def brute(docs, items):
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if not w or not v:
                continue
            n = len(v)
            if n < 5:
                sims = [float(w[s : s + n] == v) for s in range(len(w) - n + 1)] or [0.0]
            else:
                sims = [weighted(shingles(w[s : s + n]), shingles(v)) for s in range(max(1, len(w) - n + 1))]
            if max(sims) >= 0.8:
                out[d, i] = (sims.index(max(sims)), max(sims))
    return out


def tables():
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(prose(r.randrange(14, 60)))) for i in range(20)] + [(20, "tiny item here"), (21, None), (22, " "), (23, "Same Item"), (24, "same item")]
    docs = [(0, None), (1, ""), (2, "short"), (3, "a TINY item here b"), (4, "same item")]
    for d in range(5, 100):
        w = prose(r.randrange(0, 200))
        if d % 2:
            item = items[r.randrange(20)][1].split()
            for _ in range(r.randrange(2)):
                item[r.randrange(len(item))] = "EDIT"
            at = r.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in item]
        docs.append((d, r.choice([" ", ", ", "!! \n"]).join(w)))
    docs.append((100, " ".join(items[5][1].split()[:-1])))
    docs.append((101, items[5][1]))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = tables()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in search(d, b).collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 and got[k][0] == want[k][0] for k in want)
    kept = {r.doc_id for r in decontaminate(d, b).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_empty_tables(spark):
    docs, items = tables()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert search(d.limit(0), b).count() == 0 and search(d, b.limit(0)).count() == 0
    assert decontaminate(d, b.limit(0)).count() == len(docs)


def test_index_prunes_and_loses_nothing_within_the_radius():
    r = random.Random(6)
    text = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n)).encode()
    items = dc.Items([(i, text(40)) for i in range(500)], 0.8)
    prints = items.by_length[40][1]
    windows = np.stack([items.total(dc.shingle_hashes(dc.words_of(text(40)), dc.SHINGLE)) > 0 for _ in range(100)])
    assert sum(map(len, items.candidates(40, windows))) < 0.05 * 500 * 100
    g = np.random.default_rng(1)
    for i in range(200):
        near = prints[i].copy()
        flip = g.choice(dc.BITS, items.radius, replace=False)
        near[flip] = ~near[flip]
        assert i in items.candidates(40, near[None])[0]


def test_long_text_with_items_at_both_ends_takes_bounded_memory():
    r = random.Random(7)
    item = " ".join(f"item{r.randrange(99)}" for _ in range(30))
    words = [f"w{r.randrange(9999)}" for _ in range(100_000)]
    raw = (item + " " + " ".join(words * 20) + " " + item).encode()
    assert len(raw) > 10_000_000
    items = dc.Items([(0, item.encode()), (1, b"nothing of this is anywhere in there at all")], 0.8)
    tracemalloc.start()
    assert items.of(raw) == [(0, 0, 30, 1.0)]
    assert items.of(raw[200:]) == [(0, len(raw[200:].split()) - 30, 30, 1.0)]
    assert tracemalloc.get_traced_memory()[1] < 150_000_000
    tracemalloc.stop()


def test_segments_equal_one_piece(monkeypatch):
    docs, items = tables()
    index = dc.Items([(i, (t or "").encode()) for i, t in items], 0.8)
    texts = [" ".join((t or "") for _, t in docs[k : k + 30]).encode() for k in range(0, 90, 10)]
    whole = [index.of(t) for t in texts]
    monkeypatch.setattr(dc, "SEGMENT", 50)
    monkeypatch.setattr(dc, "RUN", 16)
    assert [index.of(t) for t in texts] == whole and sum(map(len, whole)) > 20


def test_an_item_of_several_texts_is_found_once_whatever_the_slices(spark, monkeypatch):
    r = random.Random(12)
    prose = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    items = [(i, prose(20)) for i in range(30)] + [(i, prose(25)) for i in range(10)]
    docs = [(d, f"{prose(30)} {items[d % 30][1]} {prose(5)} {items[30 + d % 10][1]} {prose(9)}") for d in range(20)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, search(df, bench).collect()))
    monkeypatch.setattr(dc, "SLICE_BYTES", 700)
    cut = search(df, bench)
    assert sorted(map(tuple, cut.collect())) == whole and len({x[:2] for x in whole}) == len(whole) and decontaminate(df, bench).count() == 0
