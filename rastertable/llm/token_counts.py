"""Operator 6: token counts of a unigram tokenizer by count-only Viterbi.

A text is cut as the library's metaspace pre-tokenizer does: each space is the word mark, a mark is put before the text, and
words start at marks. For each word, Aho-Corasick enumerates all vocabulary pieces; dynamic programming over their ends carries the
best score and the number of pieces on the best path, with the library's rules: scores add up from the left in double precision, a
candidate replaces another only if it is strictly better, candidates come in order of their start, and a character that is no
piece costs the least score less 10. Neighbouring unknown characters are one token, or with ``byte_fallback`` one token for
each byte. No path is kept or traced back: scores and counts stay in a ring as long as the longest piece and matches are taken as
they come, so a word of any length needs no more memory than its characters.

Null and empty texts have 0 tokens. Rows that repeat are counted each. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertable.llm.shared import slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers; when full it starts anew. Longer words are not remembered.
MEMORY_ENTRIES, MEMORY_CHARS = 1_000_000, 40


class UnigramCounter(dict):
    """Counts pieces; as a dict it maps words, without their mark, to their counts."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = False) -> None:
        super().__init__()
        self.byte_fallback = byte_fallback
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.pieces = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        #: One less than a power of two that is above the longest piece: scores are kept in a ring.
        self.ring = (1 << max(len(p) for p, _ in vocabulary).bit_length()) - 1

    def count(self, word: str) -> int:
        """Tokens of one word with its mark."""
        found = self.pieces.iter(word)  # in the order of their ends, so none is kept
        ahead = next(found, None)
        mask = self.ring
        best, tokens, unknown_before = [0.0] * (mask + 1), [0] * (mask + 1), False
        for end in range(1, len(word) + 1):
            top, count, unknown, single = None, 0, False, False
            while ahead is not None and ahead[0] == end - 1:  # of equal ends the longest piece, which starts first, comes first
                length, score = ahead[1]
                s = score + best[end - length & mask]
                single = length == 1
                if top is None or s > top:
                    top, count = s, tokens[end - length & mask] + 1
                ahead = next(found, None)
            if not single:
                s = self.unknown + best[end - 1 & mask]
                if top is None or s > top:
                    top, unknown = s, True
                    more = len(word[end - 1].encode()) if self.byte_fallback else 0 if unknown_before else 1
                    count = tokens[end - 1 & mask] + more
            best[end & mask], tokens[end & mask], unknown_before = top, count, unknown
        return tokens[len(word) & mask]

    def __missing__(self, word: str) -> int:
        n = self.count(MARK + word)
        if len(word) <= MEMORY_CHARS:
            if len(self) >= MEMORY_ENTRIES:
                self.clear()
            self[word] = n
        return n

    def tokens(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:  # the text starts with a mark of its own
            del words[0]
        return sum(map(self.__getitem__, words))


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """The unknown piece and all plain pieces of a sentencepiece model with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return [("<unk>", 0.0), *((model.id_to_piece(i), model.get_score(i)) for i in plain)]


_COUNTERS: dict[tuple[str, bool], UnigramCounter] = {}


def counter(path: str, byte_fallback: bool) -> UnigramCounter:
    """One counter for each worker process and vocabulary file."""
    if (path, byte_fallback) not in _COUNTERS:
        _COUNTERS[path, byte_fallback] = UnigramCounter(sentencepiece_vocabulary(path), byte_fallback)
    return _COUNTERS[path, byte_fallback]


def token_counts(docs: DataFrame, vocabulary_path: str, byte_fallback: bool = False) -> DataFrame:
    """(doc_id, n_tokens) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary_path, byte_fallback)
        for batch in slices(batches, "text"):
            found = [own.tokens(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")
