"""Operator 9, token counts: a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic programming carries, for each place, the
best score and its number of pieces, never the pieces. Pieces may hold any blanks: a text is parted only before a blank, or a run of blanks,
that no piece of the vocabulary reaches over, and the counts of the parts add up; each worker keeps the counts of parts that it has met, up to a bound.

Rules, as unigram tokenizers have them: blanks are written as U+2581, and a text starts with one more; matches of a place are taken from the earliest
start on and replace the best one only with a higher score, so of equal scores the longest last piece stays; a character that no
one-character piece covers counts as unknown, with the lowest score less ten, and gives one token for each
of its UTF-8 bytes if the vocabulary has all bytes, else neighbouring unknowns are one token. With ``split`` every blank starts a word of its own
and no piece reaches over one, as after a Metaspace splitter.

Defined results: null and empty texts count 0; repeated rows count alike; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.common import chunks

BLANK = "▁"
#: A run of blanks with what follows it.
PART = re.compile(r" +[^ ]*")
PENALTY = 10.0
#: Words of a generation of which a worker remembers the count.
REMEMBERED = 300_000
#: Longer words are split in the table's keys no more than others, but are not remembered.
LONGEST_REMEMBERED = 64


def load_vocabulary(path: str) -> tuple[dict[str, float], bool]:
    """(piece to score, byte pieces) of a sentencepiece model; control, unknown and byte pieces are not matched."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    pieces = {sp.id_to_piece(i): float(sp.get_score(i)) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    return pieces, sum(sp.is_byte(i) for i in ids) == 256


class Counter(dict):
    """Word (without its first blank) to its number of pieces; what is missing is counted and remembered.

    Two generations of ``remembered`` words at most: a full one becomes the older, from which words come back when they are met.
    """

    def __init__(self, vocabulary: dict[str, float], bytes_known: bool, remembered: int = REMEMBERED, split: bool = True):
        super().__init__()
        self.split = split
        self.older: dict[str, int] = {}
        self.remembered, self.bytes_known = remembered, bytes_known
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = frozenset(p for p in vocabulary if len(p) == 1)
        # Pieces that reach from a letter to a blank, or unknown blanks that join unknown letters, leave no place to part a text at.
        self.whole = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in vocabulary) or not (bytes_known or BLANK in vocabulary)
        self.unknown = min(vocabulary.values(), default=0.0) - PENALTY

    def __missing__(self, word: str) -> int:
        got = self.older.get(word)
        if got is None:
            w = BLANK + word
            got = self.viterbi(w) if self.single.issuperset(w) else self.viterbi_with_unknowns(w)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= self.remembered:
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got

    def viterbi(self, w: str) -> int:
        """For a word all of whose characters are pieces. Matches come by their end, the longest of an end first."""
        best, count = [0.0] + [-inf] * len(w), [0] * (len(w) + 1)
        for last, (size, score) in self.automaton.iter(w):
            start = last + 1 - size
            v = best[start] + score
            if v > best[last + 1]:
                best[last + 1], count[last + 1] = v, count[start] + 1
        return count[-1]

    def viterbi_with_unknowns(self, w: str) -> int:
        n = len(w)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(w):
            ends[last + 1].append(match)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        # Whether the best way to a place ends in an unknown: neighbours fuse if there are no byte pieces.
        open_unknown = [False] * (n + 1)
        for e in range(1, n + 1):
            top, c, u = -inf, 0, False
            for size, score in ends[e]:
                v = best[e - size] + score
                if v > top:
                    top, c, u = v, count[e - size] + 1, False
            if w[e - 1] not in self.single:
                v = best[e - 1] + self.unknown
                if v > top:
                    top, u = v, True
                    if self.bytes_known:
                        c = count[e - 1] + len(w[e - 1].encode("utf-8", "surrogatepass"))
                    else:
                        c = count[e - 1] + (not open_unknown[e - 1])
            best[e], count[e], open_unknown[e] = top, c, u
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(BLANK, " ")
        if self.split or not (self.whole or "  " in text or text[0] == " "):
            return sum(map(self.__getitem__, text.split(" ")))
        parts = [text] if self.whole else PART.findall(" " + text)
        return sum(self[p[not self.whole :].replace(" ", BLANK)] for p in parts)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(*load_vocabulary(path), split=False)


def token_counts(documents: DataFrame, vocabulary: str, id_column: str = "doc_id") -> DataFrame:
    """(id, n_tokens): one row for each document; ``vocabulary`` is the path of a sentencepiece model."""
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in chunks(batches):
            n = np.fromiter((c.text(t) for t in b.column("text").to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(id_column), pa.array(n)], [id_column, "n_tokens"])

    return documents.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, n_tokens long")
