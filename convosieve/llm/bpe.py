"""Byte-pair encoding and decoding of whole texts by a contiguous array of ranks.

A word is a list of part ids and, beside it, the rank of each pair of neighbours.  The least rank is looked for again and again, the
boundary inside that pair goes, and the ranks on both sides are looked up anew.  Scanning costs the square of the length, so only words
of up to SHORT parts are scanned; longer ones keep the same array and take the least pair from a heap.

Normalisation and pre-tokens are those of the tokenizer file.  A word of Latin-1 is cut here; others go through the file's own
normaliser and pre-tokenizer, so that every rule of Unicode is theirs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convosieve.llm.common import WORD_BYTES, Memo, arrow_schema, batch, pairs, per_process, sliced
from convosieve.llm.subwords import BYTE_CHARS, SEPARATORS, WORD_PATTERN, is_latin

SHORT = 64
#: Rank of neighbours that no merge joins.
NONE = 1 << 60


class Merges:
    """Part ids of one pre-token.  `ranks` has the rank of (left id << 32 | right id), `joined` the id that each rank makes."""

    def __init__(self, vocabulary: dict[str, int], merges: list, word_end: str = ""):
        at = lambda pair: tuple(pair.split(" ") if isinstance(pair, str) else pair)
        found = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in map(at, merges)]
        self.ranks = {}
        for rank, (a, b, _) in enumerate(found):
            self.ranks.setdefault(a << 32 | b, rank)
        self.joined = [new for _, _, new in found]
        self.vocabulary, self.word_end = vocabulary, word_end

    def ids(self, word: str) -> list[int]:
        """Ids of a word in the vocabulary's characters; characters that it lacks have none."""
        if not word:
            return []
        parts = [*word[:-1], word[-1] + self.word_end]
        parts = [p for p in map(self.vocabulary.get, parts) if p is not None]
        ranks = [self.ranks.get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        return self.scan(parts, ranks) if len(parts) <= SHORT else self.heap(parts, ranks)

    def scan(self, parts: list[int], ranks: list[int]) -> list[int]:
        rank_of = self.ranks.get
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = self.joined[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 32 | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << 32 | parts[i + 1], NONE)
        return parts

    def heap(self, parts: list[int], ranks: list[int]) -> list[int]:
        """The same merges in the same order: least rank, then leftmost.  Parts are linked, an entry whose rank has changed is stale."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks.append(NONE)
        todo = [(rank, i) for i, rank in enumerate(ranks) if rank != NONE]
        heapify(todo)

        def refresh(i: int) -> None:
            ranks[i] = self.ranks.get(parts[i] << 32 | parts[after[i]], NONE) if after[i] < n else NONE
            if ranks[i] != NONE:
                heappush(todo, (ranks[i], i))

        while todo:
            rank, i = heappop(todo)
            if ranks[i] != rank:
                continue
            j = after[i]
            parts[i], parts[j], ranks[j], after[i] = self.joined[rank], -1, NONE, after[j]
            if after[j] < n:
                before[after[j]] = i
            refresh(i)
            if before[i] >= 0:
                refresh(before[i])
        return [p for p in parts if p >= 0]


class Codec:
    """encode and decode of a tokenizer file with BPE, NFC, white space and lower case, word ends and byte characters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, tokenizer = spec["model"], Tokenizer.from_file(path)
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.find_special = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True)) or "(?!)")
        tokens = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.tokens = [tokens.get(i) for i in range(max(tokens) + 1)]
        self.normal, self.pre = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.cut = regex.compile(WORD_PATTERN).findall
        self.pre_tokens = Memo(lambda p: np.array(self.merges.ids(p), "<u4").tobytes(), WORD_BYTES)
        self.words = Memo(self.word, WORD_BYTES)

    def word(self, word: str) -> bytes:
        """Packed ids of a run of characters without white space."""
        if is_latin(word):
            found = (p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(BYTE_CHARS) for p in self.cut(word.lower()))
        else:
            found = (p for p, _ in self.pre(self.normal(word)))
        return b"".join(map(self.pre_tokens.__getitem__, found))

    def encode(self, text: str | None) -> bytes:
        """Packed little-endian 32-bit ids.  The strings of special tokens in the text are these tokens, as the library has it."""
        if not text:
            return b""
        self.words.trim()
        self.pre_tokens.trim()
        if "<" in text and self.find_special.search(text):
            parts = [p for p in self.find_special.split(text) if p]
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.plain(p) for p in parts)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if SEPARATORS.search(text):  # which str.split cuts at and the file does not
            return self.by_file(text)
        return b"".join(map(self.words.__getitem__, text.split()))

    def by_file(self, text: str) -> bytes:
        return b"".join([self.pre_tokens[p] for p, _ in self.pre(self.normal(text))])

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, joined by spaces, since the file names no decoder; ids that it lacks give nothing."""
        tokens, n = self.tokens, len(self.tokens)
        return " ".join([t for t in (tokens[i] for i in ids if 0 <= i < n) if t is not None])


CODES = "doc_id long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _codec(path: str) -> Codec:
    return per_process(("bpe codec", path), lambda: Codec(path))


def coded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (packed little-endian 32-bit integers) and the text decoded from them, of every whole text.

    A null or empty text has no ids and decodes to the empty text.  Very long texts and words are encoded whole; repeated rows each
    have a row, in no order.  Other columns are not read and may have any name.  An empty table gives no rows.
    """
    return _mapped(docs, path, CODES, lambda ids, decoded: (ids, decoded))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of `coded`'s ids and of its decoded text in UTF-8, without moving either out of the task."""
    from hashlib import sha256

    return _mapped(docs, path, DIGESTS, lambda ids, decoded: (len(ids) // 4, sha256(ids).hexdigest(), sha256(decoded.encode()).hexdigest()))


def _mapped(docs: DataFrame, path: str, ddl: str, of) -> DataFrame:
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for own in sliced(batches):
            rows = []
            for doc_id, text in pairs(own, "doc_id", "text"):
                ids = codec.encode(text)
                rows.append((doc_id, *of(ids, codec.decode(np.frombuffer(ids, "<u4").tolist()))))
            yield batch(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)
