import hashlib
import random
import zlib

import pytest

from lumenquad.llm import merkle
from lumenquad.llm.merkle import op11_merkle_manifest

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(*fields):
    return H(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes):
    """Root and, for each node, its siblings from below, by levels of the whole list."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(proofs, at, strict=True):
            p.append((i & 1, nodes[i ^ 1] if i ^ 1 < len(nodes) else None))
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], proofs


def expected(docs):
    langs, out = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode())), []
    parts = []
    for lang in langs:
        own = sorted((d for d in docs if d[2] == lang), key=lambda d: (d[0] is not None, d[0] or 0, leaf(*d)))
        parts.append((own, *tree([leaf(*d) for d in own])))
    root, upper = tree([p[1] for p in parts])
    for (own, subroot, proofs), above in zip(parts, upper, strict=True):
        for d, proof in zip(own, proofs, strict=True):
            bad = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[3] is not None
            node = leaf(*d[:3], d[3] + 1, d[4]) if bad else leaf(*d)
            for right, s in proof + above:
                node = H(node) if s is None else H(s, node) if right else H(node, s)
            out.append((d[0], leaf(*d), subroot, root, H(*(s for _, s in proof + above if s)), node, node == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, block string, root string"


def run(spark, tmp_path, docs):
    spark.createDataFrame([(*d, "x", "y", "z") for d in docs], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return op11_merkle_manifest(spark, str(tmp_path))


def corpus(n):
    r = random.Random(n)
    langs = ["en"] * 5 + ["de", "é", "", None]
    return [(r.randrange(10 * n), r.choice(["a", None]), r.choice(langs), r.choice([3, 10**12, None]), r.choice(["", None, "漢" * 5, "x" * r.randrange(50)])) for _ in range(n)]


def test_equals_levels_of_whole_lists(spark, tmp_path, monkeypatch):
    docs = corpus(300) + [(None, None, None, None, None), (7, "s", "xx", 2**63 - 1, "only one"), (7, "s", "xx", 2**63 - 1, "only one"), (-5, "s", "en", 0, "x" * 200_000)]
    # Blocks of four nodes: several levels of blocks, broken ones among them.
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda leaves: whole(leaves, bits=2))
    rows = run(spark, tmp_path, docs).collect()
    assert sorted(map(tuple, rows), key=str) == expected(docs)
    assert {r.verified for r in rows} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 1100])
def test_production_blocks(spark, tmp_path, n):
    docs = [(i, "s", "en" if n < 3 else ["en", "en", "fr"][i % 3] if n < 9 else "en", 5, f"t{i}") for i in range(n)]
    assert sorted(map(tuple, run(spark, tmp_path, docs).collect()), key=str) == expected(docs)


def test_empty_table(spark, tmp_path):
    df = run(spark, tmp_path, [])
    assert df.count() == 0 and df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_steps_lead_to_the_root(spark):
    leaves = spark.createDataFrame([("en", i, hashlib.sha256(b"%d" % i).digest()) for i in range(37)], "lang string, doc_id long, leaf binary")
    rows = merkle.manifest(leaves.withColumn("checked", leaves.leaf), bits=3, keep_steps=True).collect()
    assert all(merkle.fold(bytes.fromhex(r.leaf), bytes(r.steps)).hex() == r.root and r.verified for r in rows) and len(rows) == 37


@pytest.mark.parametrize("n,height", [(1, 0), (1, 3), (5, 3), (16, 4), (23, 5), (100, 10), (600, 10)])
def test_traversal_in_bounded_memory(n, height):
    leaves = b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(n))
    root = merkle.root_of(leaves, height)
    seen = []
    feed = merkle.Subtree.feed

    def counting(self, x):
        feed(self, x)
        seen.append((len(self.nodes) <= 2 << (self.top - self.base), len(self.stack) <= self.top))

    merkle.Subtree.feed = counting
    try:
        for span in (1, 3, 4):
            found = list(merkle.paths(leaves, height, span))
            assert len(found) == n and all(len(p) == 33 * height and merkle.fold(leaves[32 * i : 32 * i + 32], p) == root for i, p in enumerate(found))
    finally:
        merkle.Subtree.feed = feed
    assert all(a and b for a, b in seen)
