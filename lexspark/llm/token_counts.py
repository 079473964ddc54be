"""Token counts of a unigram tokenizer without its tokens: Aho-Corasick matches and a counting Viterbi."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The vocabulary file, read on the driver; a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: An unknown character scores this much less than the least piece.
UNKNOWN_PENALTY = 10.0
#: Distinct words whose counts a task remembers, and the longest word that is remembered.
CACHE_WORDS, CACHE_LENGTH = 500_000, 64
#: White space by the Unicode property, as the tokenizer splits; str.split() also takes U+001C to U+001F.
_SPACE = regex.compile(r"[\x09-\x0D\x20\x85\xA0  -     　]+")
_ODD = regex.compile(r"[\x1C-\x1F]")


def vocabulary(model: str = MODEL) -> list[tuple[str, float]]:
    """The model's ordinary pieces with their scores; control, unknown, unused and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=model)
    skip = lambda i: p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size()) if not skip(i)]


class Counter:
    """Piece counts of single words by the best-scoring segmentation.

    Positions are settled from left to right. Of segmentations of one score, the first found wins: the one whose last
    piece begins first, that is, is longest; an unknown character comes after all pieces. A character that no
    one-character piece matches may be unknown, and a run of unknown characters counts once.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of a word behind the word mark; a mark within the word begins another word."""
        if MARK in word:
            head, *rest = word.split(MARK)
            return (self.run(MARK + head) if head else 0) + sum(self.run(MARK + part) for part in rest)
        return self.run(MARK + word)

    def run(self, text: str) -> int:
        """Pieces of the best segmentation of the whole text."""
        n = len(text)
        best: list = [None] * (n + 1)
        count, fused = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        matches = self.automaton.iter(text) if len(self.automaton) else iter(())
        end, ahead = 0, next(matches, None)
        for end in range(1, n + 1):
            found = []
            while ahead is not None and ahead[0] == end - 1:
                found.append(ahead[1])
                ahead = next(matches, None)
            found.sort(reverse=True)
            for length, score in found:
                start = end - length
                total = score + best[start]
                if best[end] is None or total > best[end]:
                    best[end], count[end], fused[end] = total, count[start] + 1, False
            if text[end - 1] not in self.single:
                total = self.unknown + best[end - 1]
                if best[end] is None or total > best[end]:
                    best[end], count[end], fused[end] = total, count[end - 1] + (not fused[end - 1]), True
        return count[n]

    def text(self, text: str | None) -> int:
        """Pieces of a text's words; null has none."""
        if not text:
            return 0
        words = [w for w in _SPACE.split(text) if w] if _ODD.search(text) else text.split()
        cache, total = self.cache, 0
        for w in words:
            n = cache.get(w)
            if n is None:
                n = self.word(w)
                if len(w) <= CACHE_LENGTH:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = n
            total += n
        return total


def token_count(text: Column, pieces: list[tuple[str, float]]) -> Column:
    """Number of pieces (long) of each text."""
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(pieces)

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(shared.value)
        for batch in batches:
            yield batch.map(counter.text).astype("int64")

    return run(text)


def count_tokens(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """docs with n_tokens (long): pieces of the text under the model's vocabulary taken as a unigram tokenizer.

    Words are what white space separates, each behind the word mark. Null, empty and blank texts: 0. Repeated rows:
    equal counts. Empty table: empty result. A column named n_tokens is replaced. The vocabulary has a fixed size and
    is sent to the executors; each task remembers the counts of up to CACHE_WORDS words.
    """
    keep = [c for c in docs.columns if c.lower() != "n_tokens"]
    return docs.select(*keep, token_count(F.col(text), vocabulary(model)).alias("n_tokens"))
