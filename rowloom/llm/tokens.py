"""Token counts by a count-only Viterbi.

An Aho-Corasick automaton lists where the pieces of a unigram vocabulary occur
in a text; dynamic programming over their ends carries the best score and the
number of pieces on the best path, and no path is kept. Rules follow unigram
tokenizers: spaces become U+2581 and one is put in front; among equal scores the
piece that begins first (the longest) wins; a code point that is no piece itself
may stand as unknown at ten below the least score, and counts as its UTF-8 bytes
if the vocabulary has byte pieces, else as one for each run of unknowns. Scores
add up in double precision, within each stretch between spaces.

A best path decomposes where no piece can reach across: before a U+2581 that
follows another character, if no piece holds one inside, and around characters
that no piece holds. So whole texts are counted by stretches, and the counts of
short stretches are remembered by each task, at most MEMO of them.

Defined results: a null text has 0 tokens, like an empty one; rows
are independent, so repeated rows and null ids keep a row each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Stretches, of at most LONG code points, that a task remembers.
MEMO, LONG = 500_000, 64


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; bytes: whether unknown code points fall back to byte pieces."""

    pieces: tuple[tuple[str, float], ...]
    bytes: bool = True
    prefix: bool = True


def load(path: str) -> Vocabulary:
    """The pieces and scores of a sentencepiece model with identity normalization."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " a  b\tAﬁ "
    said = model.normalize(probe)
    plain = probe.replace(" ", SPACE)
    if said not in (plain, SPACE + plain):
        raise ValueError("the model normalizes texts")
    ids = range(model.get_piece_size())
    special = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)
    return Vocabulary(tuple((model.id_to_piece(i), model.get_score(i)) for i in ids if not special(i)), any(model.is_byte(i) for i in ids), said != plain)


class Counter(dict):
    """Counts of stretches, remembered; ``count`` counts texts."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        pieces = [piece for piece, _ in vocabulary.pieces]
        self.singles = {piece for piece in pieces if len(piece) == 1}
        # A run of unknowns counts once if there are no bytes, and it may reach across a U+2581 that is no piece.
        self.cuts = not any(SPACE in piece.lstrip(SPACE) for piece in pieces) and (vocabulary.bytes or SPACE in self.singles)
        self.breaks = vocabulary.bytes and not any("\n" in piece for piece in pieces)

    def viterbi(self, stretch: str) -> int:
        n = len(stretch)
        if not n:
            return 0
        best, count, run = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        singles, unknown, with_bytes = self.singles, self.unknown, self.vocabulary.bytes

        def fall_back(end: int) -> None:
            c = stretch[end - 1]
            if c in singles:
                return
            score = best[end - 1] + unknown
            if best[end] is None or score > best[end]:
                best[end], run[end] = score, True
                count[end] = count[end - 1] + (len(c.encode("utf-8", "surrogatepass")) if with_bytes else 0 if run[end - 1] else 1)

        done = 0
        for last, (length, gain) in self.automaton.iter(stretch) if self.vocabulary.pieces else ():
            end = last + 1
            while done < end - 1:
                done += 1
                fall_back(done)
            score = best[end - length] + gain
            if best[end] is None or score > best[end]:
                best[end], count[end], run[end] = score, count[end - length] + 1, False
        while done < n:
            done += 1
            fall_back(done)
        return count[n]

    def __missing__(self, stretch: str) -> int:
        found = self.viterbi(stretch)
        if len(stretch) <= LONG:
            if len(self) >= MEMO:
                self.clear()
            self[stretch] = found
        return found

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = (SPACE if self.vocabulary.prefix else "") + text.replace(" ", SPACE)
        if not self.cuts:
            return self.viterbi(text)
        lines = text.split("\n") if self.breaks else [text]
        total = len(lines) - 1  # a byte piece each
        for line in lines:
            if SPACE + SPACE in line:
                total += sum(map(self.__getitem__, re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", line)))
            else:
                first, *words = line.split(SPACE)
                total += sum(map(self.__getitem__, [SPACE + w for w in words]))
                if first:
                    total += self[first]
        return total


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long")
