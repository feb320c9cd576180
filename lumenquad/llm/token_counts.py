"""Token counts of a unigram tokenizer by count-only Viterbi.

Aho-Corasick lists the vocabulary's matches that end at each character; dynamic programming keeps the best score and
its number of pieces for each end, never the pieces. Rules of the tokenizer library, to the letter: of several best
pieces that end at one place the one that starts first wins (a later one must score strictly more); a character that
is no piece itself may be taken as unknown at the lowest score less 10; unknown characters become their UTF-8 bytes.

White space: a text gets one leading space, and spaces become the mark U+2581. No piece of the vocabulary crosses from
another character to the mark (checked), and all scores are whole numbers (checked), so a text's count is the sum over
its stretches of marks and what follows them; these are looked up per worker. Where either check fails, texts are
taken whole.

Defined cases: null and empty texts have 0 tokens; a null doc_id is kept; repeated rows are counted each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces as slices
from .common import tokenizer_path

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, without control pieces and the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]


class Counts(dict):
    """Pieces and score of each stretch; emptied when it holds `most`."""

    def __init__(self, pieces: list[tuple[str, float]], most: int = 400_000):
        import ahocorasick

        super().__init__()
        self.most = most
        self.matcher = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matcher.add_word(piece, (len(piece), float(score)))
        self.matcher.make_automaton()
        self.unknown = min([0.0, *(s for _, s in pieces)]) - UNKNOWN_PENALTY
        self.parts = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in pieces) and all(float(s).is_integer() for _, s in pieces)
        self.odd = re.compile(r"^ |  | $")
        self.stretch = re.compile(r" *[^ ]+| +$")

    def viterbi(self, text: str) -> tuple[int, float]:
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.matcher.iter(text):  # of the matches with one end the longest comes first
            ends[end].append(match)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for i, matches in enumerate(ends, 1):
            if not matches:
                best[i], count[i] = best[i - 1] + self.unknown, count[i - 1] + len(text[i - 1].encode("utf-8", "replace"))
                continue
            length, score = matches[0]
            top, pieces = best[i - length] + score, count[i - length]
            for length, score in matches[1:]:
                s = best[i - length] + score
                if s > top:
                    top, pieces = s, count[i - length]
            pieces += 1
            if length > 1 and best[i - 1] + self.unknown > top:  # the shortest match is no single character
                top, pieces = best[i - 1] + self.unknown, count[i - 1] + len(text[i - 1].encode("utf-8", "replace"))
            best[i], count[i] = top, pieces
        return count[n], best[n]

    def __missing__(self, stretch: str) -> tuple[int, float]:
        if len(self) >= self.most:
            self.clear()
        found = self.viterbi(stretch.replace(" ", MARK))
        if len(stretch) < 64:
            self[stretch] = found
        return found

    def of(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(MARK, " ")
        if not self.parts:
            return self.viterbi((" " + text).replace(" ", MARK))
        if self.odd.search(text):
            found = [self[x] for x in self.stretch.findall(" " + text)]
        else:
            found = [self[" " + x] for x in text.split(" ")]
        return sum(n for n, _ in found), sum(s for _, s in found)


_kept: dict[str, Counts] = {}


def counts_of(key: str, pieces: list[tuple[str, float]]) -> Counts:
    """The counts of one vocabulary, kept for the tasks that follow in the same worker."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = Counts(pieces)
    return _kept[key]


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """doc_id, n_tokens and the score of the best segmentation. The vocabulary goes along with the tasks."""

    key = hashlib.md5(repr(pieces).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of(key, pieces)
        for b in slices(batches, 1):
            rows = [counts.of(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.float64())], names=["doc_id", "n_tokens", "best_score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, best_score double")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(tokenizer_path("piece_bpe_32k.model")))
