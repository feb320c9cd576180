import hashlib
import random
from collections import Counter

import pytest

from lumenquad.llm.suffix_dedup import suffix_dedup


def brute(texts, width=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        left = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé漢 ") for _ in range(r.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(r.randrange(30, 90)) for _ in range(6)]
    texts = [None, "", "short", "x" * 900, "ab" * 150, prose(400)]
    for _ in range(60):
        t = prose(r.randrange(0, 120))
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            cut = r.randrange(len(p))
            t += r.choice([p, p[cut:], p[:cut]]) + prose(r.randrange(40))
        texts.append(t)
    texts += [texts[7], texts[7], texts[9][3:] + "!", "y" + texts[5][:300] + texts[5][301:]]
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "z", 7, "s") for i, t in enumerate(texts)], "doc_id long, text string, chunk string, rid int, starts string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


@pytest.mark.parametrize("split, chunk_bytes", [(1, 1 << 24), (8, 3000), (40, 1)])
def test_frequent_names_dealt_to_parts(spark, split, chunk_bytes):
    """Splits that deal all names, some and few, over chunks of all rows, some and one."""
    r = random.Random(split)
    texts = corpus(5)
    shared = "".join(r.choice("abcdefgh ") for _ in range(330))
    texts += ["".join(r.choice("stuvw ") for _ in range(r.randrange(150))) + shared[: r.randrange(190, 331)] + str(i) * 60 for i in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = suffix_dedup(df, split=split, chunk_bytes=chunk_bytes).collect()
    assert [tuple(x)[1:] for x in sorted(rows)] == brute(texts)


def test_kept_text_and_empty_table(spark):
    texts = corpus(4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in suffix_dedup(df, keep_text=True).collect():
        if r.n_removed == 0:
            assert r.kept_text == (texts[r.doc_id] or "")
        elif (texts[r.doc_id] or "").isascii():
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert suffix_dedup(df.limit(0)).count() == 0
