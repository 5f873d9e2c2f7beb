"""Hashed n-grams are those of the string functions, and no string is made of a gram."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from convosieve.functions import hashing as H
from convosieve.functions import tokens as K
from convosieve.operators import similarity as D

TEXTS = ["", "a", "ab", "abc a", "Hello  world\n hello\tworld!", "Éa éa x yy zz", "one two one two one", "日本語 テキスト 日本", "\U0001f600\U0001f600 a\U0001f600b", None]


@pytest.mark.parametrize("string, hashes, grams", [(H.word_string, H.word_hashes, K.word_ngrams), (H.char_string, H.char_hashes, lambda c: K.char_wb_ngrams(c, 3, 5))])
def test_hashes_stand_for_the_grams(spark, monkeypatch, string, hashes, grams):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string").select("id", F.coalesce("t", F.lit("")).alias("t")).select("id", string("t").alias("s"), grams("t").alias("g")).orderBy("id").collect()
    wanted = [Counter(r["g"]) for r in rows]
    for part in (1, 1 << 19):
        monkeypatch.setattr(H, "PART", part)
        found = [dict(zip(*(c.tolist() for c in x))) for x in H.term_counts(([r["s"] for r in rows], hashes))]
        assert [sorted(f.values()) for f in found] == [sorted(w.values()) for w in wanted]
        assert len({t for f in found for t in f}) == len({g for w in wanted for g in w})
        # Rows share hashes as they share grams.
        assert all(sum((Counter(a) & Counter(b)).values()) == sum((c & d).values()) for a, c in zip(found, wanted) for b, d in zip(found, wanted))


def test_no_word_gram_crosses_two_texts():
    (terms, counts), = H.term_counts((["ab cd\nef"], H.word_hashes))
    assert len(terms) == 4 and counts.sum() == 4


@pytest.mark.parametrize("method", list(D.GRAMS))
def test_neighbors_make_no_gram_strings(spark, monkeypatch, method):
    for name in ("word_ngrams", "char_wb_ngrams"):
        monkeypatch.setattr(K, name, lambda *_: pytest.fail("a string for every gram"))
    train = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta river fox"), (3, "alpha beta delta")], "doc_id long, text_norm string")
    test = spark.createDataFrame([(1, "ALPHA béta gamma"), (2, "nothing")], "doc_id long, text_norm string")
    got = {(r["test_id"], r["neighbor_rank"]): (r["train_id"], r["similarity"]) for r in D.tfidf_neighbors(train, test, method, 2, min_df=1).collect()}
    assert got[1, 1] == (1, 1.0) and got[1, 2][0] == 3 and 0 < got[1, 2][1] < 1
    assert got[2, 1][0] == 1 or method != "word_tfidf_1_2"
