"""Counts of one text that the quality rules and the quality ranking share."""

from __future__ import annotations

import numpy as np

from convosieve.llm.common import words
from convosieve.llm.hashing import Runs, hashed

#: Character classes by the first UTF-8 byte; following bytes count nothing.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other_ascii", "latin", "beyond")
_SPACES = " \t\n\v\f\r"


def _class(byte: int) -> int:
    c = chr(byte)
    if 0x80 <= byte < 0xC0:
        return -1
    if byte >= 0x80:
        return 7 if byte < 0xCA else 8
    kinds = (c.islower(), c.isupper(), c.isdigit(), c in _SPACES, c in ".,;:!?'\"()-", c in "#*$%&|<>")
    return kinds.index(True) if True in kinds else 6


_OF_BYTE = np.array([[_class(b) == k for k in range(len(CLASSES))] for b in range(256)], np.int64)


def class_counts(body: bytes) -> np.ndarray:
    """Characters of each class."""
    return np.bincount(np.frombuffer(body, np.uint8), minlength=256) @ _OF_BYTE


def repeated_words(found: list[bytes], memo) -> int:
    """Words in 3-word windows that the text has twice or more, first occurrences included."""
    if len(found) < 4:
        return 0
    runs = Runs(hashed(found, memo)).of(3)
    ordered = np.sort(runs)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(runs, twice)
    covered = np.zeros(len(found), bool)
    for k in range(3):
        covered[k : k + len(runs)] |= hit
    return int(covered.sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    r"""\n-split lines with a word, and those of them equal to an earlier one."""
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return len(lines), len(lines) - len(set(lines))


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, _SPACES))


class Profile:
    """The counts of one text; null counts as empty."""

    def __init__(self, text: str | None, memo):
        text = text or ""
        self.body = text.encode()
        self.words = words(text)
        self.n_words, self.word_chars = len(self.words), word_chars(text)
        self.classes = class_counts(self.body)
        self.n_symbols = int(self.classes[CLASSES.index("symbol")])
        self.n_lines, self.n_dup_lines = duplicate_lines(text)
        self.n_repeat_words = repeated_words(self.words, memo)

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words
