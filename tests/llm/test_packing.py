import random
import zlib

import numpy as np
import pytest

from lumenquad.llm.common import tokenizer_path
from lumenquad.llm.packing import Ids, pack

TOKENIZER = tokenizer_path("byte_bpe_50k.json")


def corpus():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghéß漢😀 \n\t.,!?0123456789'") for _ in range(r.randrange(1, 12)))
    texts = [None, "", " ", "a", "<|endoftext|> is text here", "x" * 5000, "  two  spaces \n\n", "long " * 4000, "it's we'll I'd"]
    return texts + [" ".join(word() for _ in range(r.randrange(200))) for _ in range(80)] + ["same", "same"]


def test_fast_and_slow_ids_agree():
    ids = Ids(TOKENIZER)
    r = random.Random(2)
    for t in [x for x in corpus() if x] + ["".join(chr(r.randrange(1, 256)) for _ in range(30)) for _ in range(300)]:
        assert np.frombuffer(ids.of(t), ids.dtype).tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("parts,length", [(1, 64), (7, 64), (3, 2048)])
def test_round_trip(spark, parts, length):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, part int").repartition(parts)
    rows = pack(df, TOKENIZER, length).collect()
    ids = Ids(TOKENIZER)
    docs, sequences = {}, {}
    for r in rows:
        piece = np.frombuffer(r.ids, "<u4")
        assert len(piece) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        docs.setdefault(r.doc_id, []).append((r.start, piece, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(docs) == list(range(len(texts)))
    for d, pieces in docs.items():
        whole = np.concatenate([p for _, p, _ in sorted(pieces, key=lambda x: x[0])]).tolist()
        assert whole == [*(ids.tokenizer.encode(texts[d] or "", add_special_tokens=False).ids), 1]
        assert {n for *_, n in pieces} == {len(whole)} and sum(len(p) for _, p, _ in pieces) == len(whole)
    assert sorted(sequences) == list(range(len(sequences)))
    for s, pieces in sequences.items():
        ends = [0]
        for offset, n in sorted(pieces):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] == length or s == len(sequences) - 1


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0
