"""Token counts under a unigram vocabulary without building tokens: count-only Viterbi.

An Aho-Corasick automaton lists the vocabulary's matches in a piece of text; dynamic programming over
their ends carries only the best score and the number of tokens. Ties go the way of the tokenizer:
a segmentation replaces another only if its score is higher, and of equal ones the longer last piece
wins. Pieces are cut where no vocabulary entry can match across; counts of pieces add up, and equal
scores stay exact as scores are whole numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a space inside the vocabulary.
META = "▁"
#: What an unknown character's score lies below the least score of the vocabulary.
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model and their scores, in the order of their ids."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in plain]


class Counter:
    """(tokens, score) of whole texts; remembers at most ``most`` short pieces."""

    def __init__(self, vocab: list[tuple[str, float]], most: int = 200_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.singles = {p for p, _ in vocab if len(p) == 1}
        inside = any(META in p.lstrip(META) for p, _ in vocab)
        apart = {c for c in "\n\t\r" if not any(c in p for p, _ in vocab)}
        if inside:
            raise ValueError("a piece holds a space after another character; words can't be counted apart")
        # A cut before each run of spaces, and around characters that no piece holds.
        self.pieces = re.compile(f"{META}*[^{META}{''.join(apart)}]+|{META}+" + (f"|[{''.join(apart)}]" if apart else "")).findall
        self.known: dict[str, tuple[int, float]] = {}
        self.most = most

    def piece(self, s: str) -> tuple[int, float]:
        n = len(s)
        best, count = [float("-inf")] * (n + 1), [0] * (n + 1)
        best[0], done = 0.0, 0
        whole = self.singles.issuperset(s)
        # Matches come by their end, and of one end the longest first, which is the one that began first.
        for last, (size, score) in self.automaton.iter(s):
            if not whole and done <= last:
                self._unknown(s, done, last, best, count)
                done = last + 1
            value = best[last + 1 - size] + score
            if value > best[last + 1]:
                best[last + 1], count[last + 1] = value, count[last + 1 - size] + 1
        if not whole:
            self._unknown(s, done, n, best, count)
        return count[n], best[n]

    def _unknown(self, s: str, first: int, last: int, best: list[float], count: list[int]) -> None:
        """Ends from first to last that no single character's piece reaches: step on by an unknown one."""
        for end in range(max(first, 1), last + 1):
            if s[end - 1] not in self.singles and best[end - 1] + self.unknown > best[end]:
                best[end], count[end] = best[end - 1] + self.unknown, count[end - 1] + len(s[end - 1].encode())

    def count(self, text: str) -> tuple[int, float]:
        known, tokens, score = self.known, 0, 0.0
        for s in self.pieces(META + text.replace(" ", META)) if text else ():
            got = known.get(s)
            if got is None:
                got = self.piece(s)
                if len(s) <= 32:
                    if len(known) >= self.most:
                        known.clear()
                    known[s] = got
            tokens += got[0]
            score += got[1]
        return tokens, score


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count(text: Column, path: str) -> Column:
    """struct<n_tokens: bigint, score: double> of the best segmentation of the whole text.

    A character that no piece matches counts its UTF-8 bytes, as with byte fallback. Null and empty
    texts have no tokens and score 0; equal texts have equal results.
    """

    @F.arrow_udf("struct<n_tokens:bigint,score:double>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(path)
        for batch in batches:
            got = [c.count(t.as_py() or "") for t in batch]
            yield pa.StructArray.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.float64())], ["n_tokens", "score"])

    return counted(text)
