import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from convosieve.llm import bpe, queries
from conftest import LONG, TEXTS, texts_of

PATH = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [
    *TEXTS, "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext", "é ẛ̣ ΟΔΟΣ ΣΑΣ İstanbul ǅ", "x" * 200, "ab" * 3000, "éa" * 90, "½²³ª ٣ 𝟙 Ⅷ",
    " wide　space line\u0085next", "​zero﻿width", "it'S DON'T 'LLama", "한글 各 กำ ไ", "\x00\x01\x7f", "à́", "́first", "\x1c'S <|endoftext|>",
]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def plain(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def both(codec, text):
    ids = np.frombuffer(codec.encode(text), "<u4").tolist()
    return ids, codec.decode(ids)


@pytest.mark.parametrize("text", AWKWARD, ids=range(len(AWKWARD)))
def test_awkward_texts_as_the_library(codec, library, text):
    assert both(codec, text) == plain(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAbcé 'sStT<|>\n\t0ßΣİ́")), max_size=60))
def test_random_texts_as_the_library(codec, library, text):
    assert both(codec, text) == plain(library, text)


def test_scan_and_heap_agree_with_one_merge_at_a_time(codec):
    merges, draw = codec.merges, random.Random(3)

    def slowly(parts):
        while True:
            ranked = [(merges.ranks.get(a << 32 | b, bpe.NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not ranked or min(ranked)[0] == bpe.NONE:
                return parts
            rank, i = min(ranked)
            parts = [*parts[:i], merges.joined[rank], *parts[i + 2 :]]

    for n in range(1, 150):
        word = "".join(draw.choices("aaabeeinrst", k=n))
        parts = [merges.vocabulary[c] for c in word]
        ranks = [merges.ranks.get(a << 32 | b, bpe.NONE) for a, b in zip(parts, parts[1:])]
        assert merges.scan(parts[:], ranks[:]) == merges.heap(parts[:], ranks[:]) == slowly(parts)


def test_a_word_of_a_million_characters_ends(codec):
    ids, text = both(codec, "banana" * 170_000)
    assert len(ids) > 100_000 and text.replace(" ", "").replace("</w>", "") == "banana" * 170_000


def test_ids_that_no_token_has(codec, library):
    ids = [0, 49406, 49407, 60000, 512]
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) and codec.decode([]) == ""


def expected(library, doc_id, text):
    ids, decoded = plain(library, text)
    packed = struct.pack(f"<{len(ids)}I", *ids)
    return doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_query_on_whole_tables(spark, data, library, documents):
    got = [tuple(r) for r in queries.op12(spark, data).collect()]
    assert sorted(got, key=str) == sorted((expected(library, *r) for r in texts_of(documents)), key=str)


def test_rows(spark, awkward, empty, library):
    got = bpe.coded(awkward, PATH).collect()
    assert sorted(map(repr, ((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got))) == sorted(
        repr((d, np.array(plain(library, t)[0], "<u4").tobytes(), plain(library, t)[1])) for d, t in texts_of(awkward)
    )
    assert any(r["decoded"] and len(r["decoded"]) > len(LONG) for r in got)
    assert bpe.coded(empty, PATH).collect() == [] and bpe.digests(empty, PATH).collect() == []
    assert sorted(map(tuple, bpe.digests(awkward, PATH).collect()), key=str) == sorted((expected(library, *r) for r in texts_of(awkward)), key=str)
