"""Encoding, wavelet shards, packing and unigram counts against the tokenizers library."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from conftest import texts_of

from convosieve.llm import packing, unigram, wavelet
from convosieve.llm.subwords import ByteEncoder, WordEncoder, load

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def ids_of(path, texts, end):
    return [[*e.ids, end] for e in load(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("path", "kind"), [(BYTE, ByteEncoder), (WORD, WordEncoder)])
def test_encoders(path, kind, awkward, documents):
    texts = [t for df in (awkward, documents) for _, t in texts_of(df)]
    encoder = kind(path)
    for text, ids in zip(texts, ids_of(path, texts, 0)):
        assert np.frombuffer(encoder.packed(text), "<u4").tolist() == ids[:-1], repr(text)[:200]


@pytest.mark.parametrize("name", ["awkward", "documents", "empty"])
def test_wavelet_round_trip(request, spark, name):
    docs = request.getfixturevalue(name)
    rows = texts_of(docs)
    folder = wavelet.write_shards(docs, WORD, shard_ids=3000, part_bytes=100_000)
    got = wavelet.read_digests(spark, folder).collect()
    assert wavelet.shards(spark, folder).count() >= (2 if rows else 0)
    expected = Counter((d, len(ids), crc(ids)) for (d, _), ids in zip(rows, ids_of(WORD, [t for _, t in rows], 2)))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    got.sort(key=lambda r: r["start"])
    at, ids = 0, []
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        ids.append(-1 if r["doc_id"] is None else r["doc_id"])
    assert ids == sorted(ids)


def test_wavelet_queries():
    ids = np.random.default_rng(1).integers(0, 300, 5000).astype("<u4")
    m = wavelet.WaveletMatrix.build(ids)
    assert m.decode().tolist() == ids.tolist()
    for at in (0, 1, 511, 512, 513, 4095, 4999):
        assert m.access(at) == ids[at]
    for value in (0, 7, 299, 511, 70000):
        where = np.flatnonzero(ids == value)
        assert m.count(value) == len(where)
        assert m.count(value, 100, 3000) == ((where >= 100) & (where < 3000)).sum()
        assert [m.find(value, k) for k in range(len(where))] == where.tolist()
    with pytest.raises(IndexError):
        m.find(511, 0)
    assert wavelet.WaveletMatrix.build(np.array([], "<u4")).decode().tolist() == []


@pytest.mark.parametrize("name", ["awkward", "documents", "empty"])
def test_packing(request, name):
    docs = request.getfixturevalue(name)
    rows = texts_of(docs)
    got = packing.pack(docs.repartition(5, "doc_id"), BYTE, open_windows=8, keep_ids=True).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["length"] * 4 == len(r["ids"]) and zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    expected = Counter()
    for (d, _), ids in zip(rows, ids_of(BYTE, [t for _, t in rows], 0)):
        for start in range(0, len(ids), 1024):
            expected[d, start, crc(ids[start : start + 1024]), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in got) == expected
    if name == "documents":
        total = sum(r["length"] for r in got)
        assert len(windows) * 1024 < 1.1 * total


def test_unigram_counts(awkward, documents, empty):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers  # noqa: F401

    pieces = unigram.vocabulary(PIECE)
    model = Tokenizer(models.Unigram([("<unk>", -1e9), *pieces], unk_id=0, byte_fallback=False))
    pre = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    assert unigram.token_counts(empty, PIECE).count() == 0
    counter = unigram.PieceCounter(pieces)
    scores = dict(pieces)
    for df in (awkward, documents):
        got = {(r["doc_id"], r["n_pieces"]) for r in unigram.token_counts(df, PIECE).collect()}
        for doc_id, text in texts_of(df):
            found = model.encode(uncut(text), add_special_tokens=False).tokens if text else []
            score, count = counter.count(text)
            assert count == len(found) and (doc_id, len(found)) in got, (text or "")[:50]
            if all(t in scores for t in found):
                assert score == pytest.approx(sum(scores[t] for t in found))
    assert pre.pre_tokenize_str("a  b")


def uncut(text):
    return "▁" + text.replace(" ", "▁")


RUNS = ["x = 1;" + " " * 16 + "y", "a    b", "    ", " " * 500 + "z", "if x:\n        return  1\n", "a " * 40 + "  b   c", "▁▁ ▁a", "tab \t  end  "]


@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_runs_of_spaces(fallback):
    """Against the best path through the uncut text, whose pieces may hold several spaces."""
    pieces = unigram.vocabulary(PIECE)
    assert max(len(p) for p, _ in pieces if not p.strip("▁")) == 16
    counter, whole = (unigram.PieceCounter(pieces, fallback) for _ in range(2))
    whole.parts = lambda text: [text]
    for text in RUNS:
        score, count = counter.count(text)
        assert (pytest.approx(score), count) == whole.count(text) and whole.count(text) == whole.best(uncut(text))
    assert counter.count(RUNS[0])[1] == 7 and counter.count(RUNS[1])[1] == 3


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab  ▁\nxé"), max_size=40))
def test_unigram_cuts_lose_nothing(text):
    toy = [("▁", -1.0), ("▁▁", -1.5), ("▁▁▁", -1.7), ("a", -1.0), ("b", -2.0), ("ab", -2.5), ("▁▁a", -2.0), ("x", -3.0), ("\n", -2.0)]
    counter, whole = unigram.PieceCounter(toy), unigram.PieceCounter([*toy, ("b▁a", -99.0)])
    assert whole.parts("▁a▁b") == ["▁a▁b"]  # a piece goes over a cut, so nothing is cut
    got = counter.count(text)
    assert (pytest.approx(got[0]), got[1]) == ((0.0, 0) if not text else counter.best(uncut(text)))


def test_unigram_byte_fallback(spark, awkward, tmp_path):
    """The query against the tokenizers library with the file's byte pieces."""
    from tokenizers import Tokenizer, models

    from convosieve.llm.queries import QUERIES

    pieces = unigram.vocabulary(PIECE)
    model = Tokenizer(models.Unigram([("<unk>", -1e9), *pieces, *((f"<0x{b:02X}>", -1e9) for b in range(256))], unk_id=0, byte_fallback=True))
    rows = texts_of(awkward) + [(10**6 + i, t) for i, t in enumerate(["龘", "龘龘 龘", "a\n\nb", "\t\t", "🫠🫠x🫠", "ꦲꦏ ꦱꦫ", "<0x0A>", *RUNS])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["n_pieces"]) for r in QUERIES["op9_unigram_token_counts"](spark, str(tmp_path)).collect())
    of = lambda text: len(model.encode(uncut(text), add_special_tokens=False).tokens) if text else 0
    literal = unigram.PieceCounter(pieces).count("<0x0A>")[1]  # text that looks like a byte piece is not one
    assert got == Counter((d, literal if t == "<0x0A>" else of(t)) for d, t in rows)
    assert got[10**6, 4] == got[10**6 + 2, 4] == 1 and unigram.has_byte_pieces(PIECE)


def test_unigram_ties():
    toy = unigram.PieceCounter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("▁ab", -3.0)])
    assert toy.best("▁ab") == (-3.0, 1)
    assert toy.best("▁zzb") == (-1.0 - 13.0 - 13.0 - 1.0, 3)


def test_a_hundred_thousand_words_are_scored_once():
    counter, asked = unigram.PieceCounter([("▁", -1.0), *((c, -2.0) for c in "0123456789")]), []
    best, counter.by_part.fn = counter.best, lambda part: (asked.append(part), best(part))[1]
    texts = [" ".join(map(str, range(first, first + 1000))) for first in range(0, 100_000, 1000)]
    assert [counter.count(t) for t in texts] == [counter.count(t) for t in texts]
    assert len(asked) == 100_000
