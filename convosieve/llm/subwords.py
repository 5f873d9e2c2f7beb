"""Token ids of whole texts as packed little-endian 32-bit integers, with bounded memos of repeated words.

A tokenizer cuts a text into pre-tokens and encodes each by itself, so ids of a text are the joined ids of pieces cut where a
pre-token must end.  Pieces met before come from a memo; the tokenizers library encodes the rest.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import regex

from convosieve.llm.common import WORD_BYTES, Memo

# The pre-token patterns of the two tokenizer files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: str.split and `\s` of `re` count these as white space, the tokenizers do not.
SEPARATORS = re.compile("[\x1c-\x1f]")


def is_latin(text: str) -> bool:
    """Whether all characters are in Latin-1: each is in NFC, also next to others, and lower-cases by itself."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


#: Byte-level files write each byte of UTF-8 as one character: printable Latin-1 as itself, the others numbered from U+0100 up.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARS = {b: chr(0x100 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def pre_token_ids(tokenizer):
    """Packed ids of one pre-token, from the library's model."""
    model = tokenizer.model

    def ids(s: str) -> bytes:
        plain = s.isascii() and s.isprintable()
        found = model.tokenize(s.replace(" ", BYTE_CHARS[0x20]) if plain else s.encode().decode("latin-1").translate(BYTE_CHARS))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    return ids


class ByteEncoder:
    """For byte-level BPE, pre-token by pre-token."""

    def __init__(self, path: str):
        self.pre_tokens = Memo(pre_token_ids(load(path)), WORD_BYTES)
        self.cut = regex.compile(BYTE_PATTERN).findall

    def packed(self, text: str | None) -> bytes:
        self.pre_tokens.trim()
        return b"".join(map(self.pre_tokens.__getitem__, self.cut(text))) if text else b""


class WordEncoder:
    """For BPE with word ends behind NFC and lower-casing: white space always ends a pre-token and has no ids."""

    def __init__(self, path: str):
        tokenizer, cut = load(path), regex.compile(WORD_PATTERN).findall
        plain = lambda s: np.array(tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        self.plain, self.cut, self.pre_tokens = plain, cut, Memo(pre_token_ids(tokenizer), WORD_BYTES)
        join = lambda s: b"".join(map(self.pre_tokens.__getitem__, cut(s.lower())))
        self.by_word = Memo(lambda s: join(s) if is_latin(s) else plain(s))

    def packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        self.pre_tokens.trim()
        self.by_word.trim()
        if SEPARATORS.search(text):
            return self.plain(text)
        if is_latin(text):
            return b"".join(map(self.pre_tokens.__getitem__, self.cut(text.lower())))
        return b"".join(map(self.by_word.__getitem__, text.split()))
