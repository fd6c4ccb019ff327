"""Token counts under a unigram vocabulary, without building the tokens.

Texts are cut into words the way such tokenizers do it: every space begins a word and is written as the mark U+2581, and one stands before
the text. An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic programming over its ends carries the best score
and how many pieces it takes. Ties follow the tokenizer: of candidates with equal score the one that starts first stays, a character that is
no piece costs the lowest score less 10, unknown neighbours are one piece, and with byte fallback an unknown character has as many pieces as
UTF-8 bytes. Words are independent, so each distinct word is solved once in a worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import in_slices, small_batches, table

MARK = "▁"
UNKNOWN_COST = 10.0
#: Pieces and scores of the queries.
VOCABULARY = "piece_bpe_32k.model"
#: Entries of a worker's memory of words.
MEMORY = 300_000
#: Longer words aren't remembered.
LONGEST = 64


class Counter(dict):
    """(pieces, score) of words that follow a mark."""

    def __init__(self, pieces: tuple[tuple[str, float], ...]) -> None:
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_COST
        have = {piece for piece, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in have for b in range(256))

    def __missing__(self, word: str) -> tuple[int, float]:
        found = self.solve(MARK + word)
        if len(word) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = found
        return found

    def solve(self, word: str) -> tuple[int, float]:
        n = len(word)
        score, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(word)
        last, value = next(matches, (n, None))
        for end in range(1, n + 1):
            best, start, single = None, 0, False
            while last == end - 1:
                length, own = value
                single |= length == 1
                if best is None or score[end - length] + own > best:
                    best, start = score[end - length] + own, end - length
                last, value = next(matches, (n, None))
            if not single and (best is None or score[end - 1] + self.unknown > best):
                score[end], unknown[end] = score[end - 1] + self.unknown, True
                if self.bytes:
                    pieces[end] = pieces[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
                else:
                    pieces[end] = pieces[end - 1] + (not unknown[end - 1])
            else:
                score[end], pieces[end] = best, pieces[start] + 1
        return pieces[n], score[n]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        words = text.replace(MARK, " ").split(" ")
        found = list(map(self.__getitem__, words if words[0] else words[1:]))
        return sum(n for n, _ in found), sum(s for _, s in found)


@lru_cache(maxsize=2)
def counter(pieces: tuple[tuple[str, float], ...]) -> Counter:
    return Counter(pieces)


def piece_scores(model: str) -> tuple[tuple[str, float], ...]:
    """All pieces of a vocabulary file in order of their ids, with their scores."""
    own = sentencepiece.SentencePieceProcessor(model_file=model)
    return tuple((own.id_to_piece(i), own.get_score(i)) for i in range(own.get_piece_size()))


def token_counts(docs: DataFrame, pieces: tuple[tuple[str, float], ...]) -> DataFrame:
    """(doc_id, tokens long, score double) of every row of docs(doc_id, text).

    Null and empty texts have 0 tokens and score 0. Ids may be null and rows may repeat; an empty table gives none; other columns aren't
    read. The score is the sum of the words' best scores.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(shipped.value)
        for batch in in_slices(batches):
            found = [own.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tokens long, score double")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_counts of all documents: a row for each."""
    return token_counts(table(spark, sf_dir, "documents"), piece_scores(public_tokenizers.path(VOCABULARY)))
