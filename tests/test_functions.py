"""Functions on tiny hand-made rows."""

import math
import zlib

import pytest
from pyspark.sql import functions as F

from convosieve.functions import features as X
from convosieve.functions import scalar as N
from convosieve.functions import text as T
from convosieve.functions import tokens as K


def one(spark, values, column, name="text"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def feats(spark, family, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.asDict() for r in X.add_features(df, family).orderBy("i").collect()]


def test_normalize_text(spark):
    got = one(spark, [None, "", " \t a\r\nb\rc　\x1c", "é "], T.normalize_text("text"))
    assert got == ["", "", "a\nb\nc", "é"]


def test_label_variants(spark):
    raw = ["true", " T", "1", "Yes", "0", "None", None]
    assert one(spark, raw, T.normalize_label("text")) == ["TRUE", "TRUE", "TRUE", None, "FALSE", None, None]
    assert one(spark, raw, T.normalize_label("text", unknown="keep")) == ["TRUE", "TRUE", "TRUE", "YES", "FALSE", "NONE", None]
    assert one(spark, raw, T.normalize_label_yes_no("text")) == ["TRUE", None, "TRUE", "TRUE", "FALSE", None, None]
    assert one(spark, raw, T.normalize_label_words_only("text")) == ["TRUE", None, None, None, None, None, None]
    with pytest.raises(Exception, match="Unexpected label"):
        one(spark, ["maybe"], T.normalize_label("text", unknown="error"))


def test_match_keys(spark):
    t = ["See  https://a.b/c?d=1 mail x@y.zz, pay 1,000.50!! **Now**"]
    assert one(spark, t, T.exact_key("text")) == ["see https://a.b/c?d=1 mail x@y.zz, pay 1,000.50!! **now**"]
    # The punctuation step also removes the mask brackets.
    assert one(spark, t, T.loose_key("text")) == ["see url mail email pay num now"]
    assert one(spark, t, T.template_key("text")) == ["see <URL> mail <EMAIL> , pay <NUM> !! <MARKUP> now <MARKUP>"]
    assert one(spark, ["Héllo 42\n\nw—x 7"], T.shape_key("text")) == ["A 0 AXA 0"]


def test_previews(spark):
    assert one(spark, ["a\nb", "x" * 10], T.preview("text", 8)) == ["a\\nb", "xxxxx..."]
    assert one(spark, ["a\n\nb", "aaaa bbbb cccc"], T.snippet("text", 8)) == ["a / / b", "aaaa..."]
    assert one(spark, ["abcdefgh", "abc"], T.head_tail("text", 5, "|")) == ["ab|fgh", "abc"]


def test_nested_text(spark):
    rows = [
        '{"role": "user", "content": {"text": "hi \\"you\\""}}',
        '[{"text": "a"}, {"other": "b", "n": 3}, "c", null]',
        '"plain"', '{"text": "", "x": "fallback"}', "true",
    ]
    assert one(spark, rows, T.flatten_json_text("text")) == ['hi "you"', "a\nb\n3\nc", "plain", "fallback", "True"]


def test_turn_count(spark):
    got = one(spark, ["", "User: a\nassistant: b\nx", "one\n\n two", "\n"], T.turn_count("text"))
    assert got == [0, 2, 2, 1]


def test_hard_weight_features(spark):
    a, empty = feats(spark, "hard_weight", "The cat sat, the CAT.\nbcdfghjkl aaa x9 http://a.b {[(!", "")
    assert a["word_count"] == 11 and a["repeated_token_count"] == 2 and a["newline_count"] == 1 and a["url_count"] == 1
    # vowel-less, repeated run, letter and digit, symbol-heavy url, symbol-heavy brackets
    assert a["weird_token_ratio"] == pytest.approx(5 / 10)
    assert a["stopword_ratio"] == pytest.approx(3 / 11)
    assert all(empty[n] == 0 for n in X.feature_names("hard_weight"))


def test_runs_do_not_cross_tokens(spark):
    assert feats(spark, "hard_weight", "aa a")[0]["weird_token_ratio"] == 0
    assert feats(spark, "noise", "aa a")[0]["max_repeated_char_run"] == 2


def test_noise_features(spark):
    text = "a b a b a b. Ünï ✨!! a b a"
    f = feats(spark, "noise", text)[0]
    words = "a b a b a b n a b a".split()
    counts = {w: words.count(w) for w in words}
    assert f["word_count"] == len(words) and f["repeated_token_count"] == len(words) - 3 and f["repeated_token_types"] == 2
    assert f["token_entropy"] == pytest.approx(-sum(c / 10 * math.log2(c / 10) for c in counts.values()))
    chars = {c: text.count(c) for c in set(text)}
    assert f["char_entropy"] == pytest.approx(-sum(c / len(text) * math.log2(c / len(text)) for c in chars.values()))
    assert f["byte_length"] == len(text.encode()) and f["char_length"] == len(text)
    assert f["sentence_count"] == 3 and f["non_ascii_ratio"] == pytest.approx(3 / len(text))


def test_repeated_phrases_depend_on_family(spark):
    text = "x y z x y"
    assert feats(spark, "noise", text)[0]["duplicate_bigram_count"] == 1
    assert feats(spark, "error", "a b c a b")[0]["repeated_phrase_count"] == 0
    assert feats(spark, "error", "a b c a b c")[0]["repeated_phrase_count"] == 1


def test_adjacent_repeats_versus_surplus(spark):
    assert feats(spark, "style", "go Go stop go")[0]["repeated_token_count"] == 1
    assert feats(spark, "hard_weight", "go Go stop go")[0]["repeated_token_count"] == 2


def test_compression_ratio(spark):
    text = "abc " * 50
    assert one(spark, [text, ""], X.compression_ratio("text")) == pytest.approx([len(zlib.compress(text.encode())) / len(text), 0.0])


def test_rare_tokens(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b d d"), (3, "a e"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (round(r.rare_token_ratio, 6), round(r.hapax_token_ratio, 6)) for r in X.rare_token_ratios(df).collect()}
    assert got == {1: (round(2 / 3, 6), round(1 / 3, 6)), 2: (0.75, 0.0), 3: (0.5, 0.5), 4: (0.0, 0.0)}


def test_ngrams(spark):
    assert one(spark, ["Ab cd e FG"], K.word_ngrams("text", 1, 2)) == [["ab", "cd", "fg", "ab cd", "cd fg"]]
    assert one(spark, ["a bcd"], K.char_wb_ngrams("text", 3, 5)) == [[" a ", " bc", "bcd", "cd ", " bcd", "bcd ", " bcd "]]
    assert one(spark, ["Ça naïve Łódź"], K.strip_accents("text"))[0].startswith("Ca naive")


def test_scalars(spark):
    z = [0.0, 0.5, 1.96, 3.5, 8.0]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    assert [r[0] for r in df.select(N.two_sided_p("z")).collect()] == pytest.approx([math.erfc(v / math.sqrt(2)) for v in z], abs=1e-12)
    assert one(spark, ["0.4", "x", "7", "-1", "NaN"], N.safe_prob("text")) == [0.4, 0.0, 1.0, 0.0, 0.0]
    assert spark.range(1).select(N.safe_ratio(F.lit(1), F.lit(0)), N.probability_entropy(F.lit(0.5))).first()[:] == pytest.approx((0.0, math.log(2)))
