import hashlib
import random
import zlib

import pytest

from lumenquad.llm.sharding import shard


def best(sizes, shards):
    """Least capacity of contiguous runs, by trying every feasible one."""

    def fits(c):
        runs, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                runs, at = runs + 1, 0
            at += s
        return runs <= shards

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("shards,most,seed", [(4, 16, 1), (7, 64, 2), (40, 256, 3), (3, 16, 4)])
def test_least_capacity_and_whole_groups(spark, shards, most, seed):
    r = random.Random(seed)
    texts = [None, "", "é" * 5] + ["".join(r.choice("ab") for _ in range(r.randrange(4))) if r.random() < 0.3 else str(r.random()) * r.randrange(1, 9) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(5)
    rows = shard(df, shards, most).collect()
    assert sorted(x.doc_id for x in rows) == list(range(len(texts)))
    groups, owner = {}, {}
    for x in rows:
        raw = (texts[x.doc_id] or "").encode()
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        groups.setdefault(hashlib.md5(raw).hexdigest(), []).append(x.size)
        assert owner.setdefault(raw, x.shard) == x.shard and 0 <= x.shard < shards
    sizes = [sum(groups[k]) for k in sorted(groups)]
    loads = [sum(x.size for x in rows if x.shard == s) for s in range(shards)]
    assert max(loads) == best(sizes, shards)
    for s in range(shards):
        assert sorted(x.slot for x in rows if x.shard == s) == list(range(sum(x.shard == s for x in rows)))


def test_empty_and_one_group(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shard(empty, 4).count() == 0
    one = spark.createDataFrame([(i, "same") for i in range(50)], "doc_id long, text string")
    assert {x.shard for x in shard(one, 4).collect()} == {0}
