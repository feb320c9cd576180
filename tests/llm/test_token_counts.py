import random

from tokenizers import Tokenizer, normalizers
from tokenizers.models import Unigram

from lumenquad.llm.common import tokenizer_path
from lumenquad.llm.token_counts import Counts, token_counts, vocabulary

MARK = "▁"


def library(pieces):
    t = Tokenizer(Unigram([("￿", 0.0), *pieces], 0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(MARK), normalizers.Replace(" ", MARK)])
    return t


def texts():
    r = random.Random(4)
    alphabet = "aabbcdee  étz漢😀.\n\t" + MARK
    return ["", "  a  b ", " ", "x\n\ny  ", "<0x41>", "日本 😀😀", "a" * 300] + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 60))) for _ in range(400)]


def test_counts_equal_the_library(spark):
    pieces = vocabulary(tokenizer_path("piece_bpe_32k.model"))
    t, c = library(pieces), Counts(pieces)
    assert c.parts
    for x in texts():
        assert c.of(x)[0] == len(t.encode(x).ids), x
    df = spark.createDataFrame([(i, x, "s") for i, x in enumerate([None, *texts()])], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, pieces).collect()}
    assert got == {i: len(t.encode(x or "").ids) for i, x in enumerate([None, *texts()])}
    assert token_counts(df.limit(0), pieces).count() == 0


def test_ties_and_whole_texts():
    bytes_ = [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    ties = [(MARK, -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), (MARK + "a", -2.0)]
    for pieces in (bytes_ + ties, bytes_ + [*ties, ("a" + MARK, -1.5)]):
        t, c = library(pieces), Counts(pieces)
        for x in ("ab", "aba", "abab", "ab ab", "bab a", "aé b", "ba ba ba"):
            assert c.of(x)[0] == len(t.encode(x).ids), (x, c.parts)
