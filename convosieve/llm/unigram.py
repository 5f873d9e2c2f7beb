"""Count-only Viterbi over a unigram vocabulary.

A text's spaces are written as U+2581, and one more is put in front.  It is cut where a run of them starts, so the run and the word
behind it stay together: pieces may hold several spaces, but none in this position goes over the cut (a vocabulary with such pieces is
not cut at all).  Inside a part, an Aho-Corasick automaton lists the pieces that end at each character, longest first, and dynamic
programming keeps the best score and its number of pieces there.
The tie rules are those of the unigram tokenizer: scores add from the left, only a strictly better score replaces a path, so the
longest piece wins a tie; a character that no one-character piece covers may stand alone at the lowest score less 10.
Neighbouring such characters count as one piece, or, with byte fallback, each as the byte pieces of its UTF-8 form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convosieve.llm.common import WORD_BYTES, Memo, arrow_schema, batch, pairs, per_process, sliced

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without its control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)]


def has_byte_pieces(path: str) -> bool:
    """Whether a sentencepiece file has a piece for every byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return sum(map(model.is_byte, range(model.get_piece_size()))) == 256


class PieceCounter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = False):
        import ahocorasick

        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.lowest = min(score for _, score in pieces) - UNKNOWN_PENALTY
        across = any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece, _ in pieces)
        self.parts = re.compile(".+" if across else f"{SPACE}+[^{SPACE}]*", re.DOTALL).findall
        self.by_part = Memo(self.best, WORD_BYTES)

    def best(self, word: str) -> tuple[float, int]:
        """Score and number of pieces of the best path through one part."""
        n = len(word)
        score, count, unknown, at = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1), 0

        def stand_alone(end: int, reached: bool, single: bool) -> None:
            if not single and (not reached or score[end - 1] + self.lowest > score[end]):
                score[end] = score[end - 1] + self.lowest
                count[end] = count[end - 1] + (len(word[end - 1].encode()) if self.byte_fallback else not unknown[end - 1])
                unknown[end] = True

        reached = single = False
        for last, (length, own) in self.automaton.iter(word):
            while at < last:
                stand_alone(at + 1, reached, single)
                at, reached, single = at + 1, False, False
            start = last + 1 - length
            if not reached or score[start] + own > score[last + 1]:
                score[last + 1], count[last + 1], unknown[last + 1] = score[start] + own, count[start] + 1, False
                reached = True
            single |= length == 1
        while at < n:
            stand_alone(at + 1, reached, single)
            at, reached, single = at + 1, False, False
        return score[n], count[n]

    def count(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        self.by_part.trim()
        found = list(map(self.by_part.__getitem__, self.parts(SPACE + text.replace(" ", SPACE))))
        return sum(f[0] for f in found), sum(f[1] for f in found)


COUNTS = "doc_id long, score double, n_pieces long"


def token_counts(docs: DataFrame, path: str, byte_fallback: bool = False) -> DataFrame:
    """doc_id, best score and n_pieces of every whole text; a null or empty text has none and score 0.  Very long texts are taken whole,
    a null id stays null, repeated rows each have a row, an empty table gives none.  Other columns are not read and may have any name.

    With `byte_fallback` and a file that has the byte pieces, a character that no piece covers counts as its UTF-8 bytes, as in the
    file's tokenizer; otherwise a run of such characters is one unknown piece."""

    schema = arrow_schema(COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_process(("piece counter", path, byte_fallback), lambda: PieceCounter(vocabulary(path), byte_fallback and has_byte_pieces(path)))
        for own in sliced(batches):
            yield batch([(doc_id, *counter.count(text)) for doc_id, text in pairs(own, "doc_id", "text")], schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, COUNTS)
