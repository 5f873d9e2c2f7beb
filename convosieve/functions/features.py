"""Per-document feature families.

Each family is ``prepare`` (token arrays shared by its features, computed once in
their own projection) plus ``columns`` (name to expression).  Same-named features
differ between families by definition and are not shared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from convosieve.functions import lexicons as lex
from convosieve.functions import text as T
from convosieve.functions import tokens as K
from convosieve.functions.scalar import safe_ratio

TXT = "_txt"


@dataclass(frozen=True)
class Family:
    prepare: Callable[[], dict[str, Column]]
    columns: Callable[[], dict[str, Column]]
    normalize: bool = True


def _t() -> Column:
    return F.col(TXT)


def _chars() -> Column:
    return F.length(_t())


def _newlines() -> Column:
    return T.count_char(_t(), "\n")


def _symbols() -> Column:
    return T.count_re(_t(), rf"[^{T.ALNUM}{T.WS}]")


def _punct() -> Column:
    return T.count_re(_t(), f"[{T.PUNCT}]")


def _digits() -> Column:
    return T.count_re(_t(), f"[{T.DIGIT}]")


def _letters() -> Column:
    return T.count_dense(_t(), r"\p{L}")


def _uppers() -> Column:
    return T.count_re(_t(), r"\p{Lu}")


def _spaces() -> Column:
    return T.count_re(_t(), f"[{T.WS}]")


def _non_ascii() -> Column:
    return T.count_re(_t(), r"[^\x00-\x7F]")


def _raw_count() -> Column:
    return T.count_re(_t(), T.RAW_TOKEN)


def _urls() -> Column:
    return T.count_re(_t(), f"(?i){lex.URL_PREFIX}")


def _runs(n: int) -> Column:
    return T.count_re(_t(), rf"([^\n])\1{{{n - 1},}}")


def _sentences() -> Column:
    return T.count_re(_t(), rf"[^.!?\n{T.WS}][^.!?\n]*+")


def _sentence_lengths(pattern: str) -> Column:
    parts = F.filter(F.split(_t(), T.SENTENCE_BREAK), lambda s: s.rlike(rf"[^{T.WS}]"))
    return F.transform(parts, lambda s: F.regexp_count(s, F.lit(pattern)))


def _flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def _ascii_words() -> dict[str, Column]:
    return {"_w": K.tokens(_t(), T.WORD_ASCII, lower=True)}


def _words() -> Column:
    return F.col("_w")


def _uwords() -> Column:
    return F.col("_u")


def _nwords() -> Column:
    return F.size(F.col("_w"))


# --- families ---------------------------------------------------------------------


def _basic() -> dict[str, Column]:
    t = _t()
    code = (
        T.count_re(t, lex.CODE_FENCED)
        + T.count_re(t, lex.CODE_INLINE)
        + T.count_re(t, T.uni(lex.CODE_KEYWORDS, "i"))
        + T.count_re(t, lex.HTML_TAG)
    )
    return {
        "char_length": _chars(),
        "word_count": T.count_re(t, T.WORD_UNICODE),
        "approx_turn_count": T.turn_count(t),
        "newline_count": _newlines(),
        "url_count": T.count_re(t, T.uni(lex.URL_FULL, "i")),
        "code_like_count": code,
    }


def _weirdness() -> dict[str, Column]:
    n = F.size(_uwords())
    unique = safe_ratio(F.size(F.array_distinct(_uwords())), n)
    long_ratio = safe_ratio(K.count_if(_uwords(), lambda w: F.length(w) >= 12), n)
    chars = F.greatest(_chars(), F.lit(1))
    non_alnum = _symbols() / chars
    digit_symbol = (_symbols() + _digits()) / chars
    repeated = F.greatest(F.lit(0.0), 1.0 - unique)
    # An empty token list counts as fully repeated, as its unique ratio is defined as 0.
    return {
        "token_count": n,
        "unique_word_ratio": unique,
        "avg_word_length": safe_ratio(K.total_length(_uwords()), n),
        "long_token_ratio": long_ratio,
        "repeated_token_ratio": repeated,
        "non_alnum_ratio": non_alnum,
        "digit_symbol_ratio": digit_symbol,
        "weirdness_proxy": 0.35 * repeated + 0.25 * non_alnum + 0.20 * digit_symbol + 0.20 * long_ratio,
    }


def _style() -> dict[str, Column]:
    t, n, chars, low = _t(), F.size(_uwords()), _chars(), F.col("_ul")
    return {
        "char_length": chars,
        "word_count": n,
        "avg_word_length": safe_ratio(K.total_length(_uwords()), n),
        "max_word_length": K.max_length(_uwords()),
        "unique_word_ratio": safe_ratio(F.size(F.array_distinct(low)), n),
        "stopword_ratio": safe_ratio(K.in_list(low, lex.STOPWORDS_STYLE), n),
        "digit_ratio": safe_ratio(_digits(), chars),
        "uppercase_ratio": safe_ratio(_uppers(), _letters()),
        "punctuation_ratio": safe_ratio(_punct(), chars),
        "whitespace_ratio": safe_ratio(_spaces(), chars),
        "non_ascii_ratio": safe_ratio(_non_ascii(), chars),
        "non_alnum_ratio": safe_ratio(_symbols() + _spaces(), chars),
        "newline_count": _newlines(),
        "url_domain_count": T.count_re(t, T.uni(lex.URL_DOMAIN, "i")),
        "code_symbol_count": T.count_re(t, T.uni(lex.STYLE_CODE, "i")),
        "decode_error_flag": _flag(t.contains("[DECODE ERROR]")),
        "prompt_template_flag": _flag(t.rlike(T.uni(lex.STYLE_PROMPT, "i"))),
        "spam_keyword_count": K.in_list(low, lex.SPAM_TERMS),
        "risk_keyword_count": K.in_list(low, lex.RISK_TERMS),
        "repeated_token_count": K.adjacent_equal(low),
        "very_long_token_count": K.count_if(_uwords(), lambda w: F.length(w) >= 20),
        "weird_token_ratio": safe_ratio(K.count_if(_uwords(), lambda w: w.rlike(K.WEIRD_STYLE)), n),
        "sentence_count": _sentences(),
        "avg_sentence_word_count": safe_ratio(n, _sentences()),
    }


def _hard_weight() -> dict[str, Column]:
    return {
        "char_length": _chars(),
        "word_count": _nwords(),
        "max_word_length": K.max_length(_words()),
        "stopword_ratio": safe_ratio(K.in_list(_words(), lex.STOPWORDS_FULL), _nwords()),
        "punctuation_ratio": safe_ratio(_punct(), _chars()),
        "special_char_ratio": safe_ratio(_symbols(), _chars()),
        "newline_count": _newlines(),
        "url_count": _urls(),
        "repeated_token_count": K.surplus(_words()),
        "weird_token_ratio": safe_ratio(K.weird_full(_t()), _raw_count()),
    }


def _domain_cues() -> dict[str, Column]:
    cues = {
        "insurance_term_count": lex.CUE_INSURANCE,
        "coordination_term_count": lex.CUE_COORDINATION,
        "manipulation_term_count": lex.CUE_MANIPULATION,
        "cryptic_term_count": lex.CUE_CRYPTIC,
        "agent_marker_count": lex.CUE_AGENT,
    }
    return _hard_weight() | {name: T.count_re(_t(), T.uni(p, "i")) for name, p in cues.items()}


def _noise() -> dict[str, Column]:
    t, chars, low, sl, runs = _t(), _chars(), F.lower(_t()), F.col("_sl"), F.col("_runs")
    template = low.contains(lex.TEMPLATE_PHRASES[0]) | low.contains(lex.TEMPLATE_PHRASES[1])
    char_run = F.coalesce(
        F.array_max(F.transform(K.tokens(t, r"(?s)(.)\1+"), F.length)), F.when(chars > 0, 1).otherwise(0)
    )
    repeated = _nwords() - F.size(runs)
    return {
        "char_length": chars,
        "byte_length": F.octet_length(t),
        "word_count": _nwords(),
        "raw_token_count": _raw_count(),
        "sentence_count": F.size(sl),
        "avg_sentence_word_count": safe_ratio(F.aggregate(sl, F.lit(0), lambda a, x: a + x), F.size(sl)),
        "max_sentence_word_count": F.coalesce(F.array_max(sl), F.lit(0)),
        "short_sentence_count": K.count_if(sl, lambda x: x <= 4),
        "long_sentence_count": K.count_if(sl, lambda x: x >= 30),
        "avg_word_length": safe_ratio(K.total_length(_words()), _nwords()),
        "max_word_length": K.max_length(_words()),
        "unique_word_ratio": safe_ratio(F.size(runs), _nwords()),
        "stopword_ratio": safe_ratio(K.in_list(_words(), lex.STOPWORDS_FULL), _nwords()),
        "punctuation_ratio": safe_ratio(_punct(), chars),
        "symbol_ratio": safe_ratio(_symbols(), chars),
        "digit_ratio": safe_ratio(_digits(), chars),
        "alpha_ratio": safe_ratio(_letters(), chars),
        "uppercase_ratio": safe_ratio(_uppers(), _letters()),
        "whitespace_ratio": safe_ratio(_spaces(), chars),
        "non_ascii_ratio": safe_ratio(_non_ascii(), chars),
        "newline_count": _newlines(),
        "comma_count": T.count_char(t, ","),
        "quote_count": T.count_re(t, f"[{lex.QUOTES}]"),
        "bracket_count": T.count_re(t, r"[()\[\]{}<>]"),
        "url_count": _urls(),
        "email_count": T.count_re(t, T.uni(lex.EMAIL)),
        "repeated_char_count": _runs(3),
        "max_repeated_char_run": char_run,
        "repeated_token_count": repeated,
        "repeated_token_ratio": safe_ratio(repeated, _nwords()),
        "repeated_token_types": K.count_if(runs, lambda x: x > 1),
        "duplicate_bigram_count": K.surplus(K.ngrams(_words(), 2)),
        "repeated_phrase_count": K.surplus(K.ngrams(_words(), 3)),
        "weird_token_count": F.col("_weird"),
        "weird_token_ratio": safe_ratio("_weird", _raw_count()),
        "long_token_count": K.long_raw(t),
        "mixed_alnum_token_count": K.mixed_raw(t),
        "symbol_heavy_token_count": K.symbol_heavy_raw(t),
        "no_vowel_long_token_count": K.no_vowel_raw(t),
        "camel_glue_count": K.containing_raw(t, lex.CAMEL_GLUE),
        "char_entropy": K.entropy_bits(F.col("_cc")),
        "token_entropy": K.entropy_bits(runs),
        "prompt_role_flag": _flag(t.rlike(T.uni(lex.ROLE_MARKER, "i"))),
        "code_like_flag": _flag(t.rlike(T.uni(lex.NOISE_CODE))),
        "markdown_like_flag": _flag(t.rlike(T.uni(lex.NOISE_MARKDOWN, "m"))),
        "template_marker_flag": _flag(template),
        "decode_error_flag": _flag(low.contains("[decode error]")),
        "list_or_bullet_flag": _flag(t.rlike(T.uni(lex.NOISE_LIST, "m"))),
        "has_url_flag": _flag(_urls() > 0),
        "has_non_ascii_flag": _flag(_non_ascii() > 0),
        "has_newline_flag": _flag(t.contains("\n")),
    }


def _review() -> dict[str, Column]:
    t, chars = _t(), _chars()
    return {
        "char_length": chars,
        "word_count": _nwords(),
        "sentence_count": _sentences(),
        "avg_word_length": safe_ratio(K.total_length(_words()), _nwords()),
        "max_word_length": K.max_length(_words()),
        "unique_word_ratio": safe_ratio(F.size(F.array_distinct(_words())), _nwords()),
        "stopword_ratio": safe_ratio(K.in_list(_words(), lex.STOPWORDS_FULL), _nwords()),
        "punctuation_ratio": safe_ratio(_punct(), chars),
        "digit_ratio": safe_ratio(_digits(), chars),
        "uppercase_ratio": safe_ratio(_uppers(), _letters()),
        "special_char_ratio": safe_ratio(_symbols(), chars),
        "non_ascii_ratio": safe_ratio(_non_ascii(), chars),
        "newline_count": _newlines(),
        "comma_count": T.count_char(t, ","),
        "quote_count": T.count_re(t, f"[{lex.QUOTES}]"),
        "bracket_count": T.count_re(t, r"[()\[\]{}<>]"),
        "url_count": _urls(),
        "repeated_token_count": K.surplus(_words()),
        "long_token_count": K.long_raw(t),
        "weird_token_ratio": safe_ratio(K.weird_full(t), _raw_count()),
        "repeated_char_count": _runs(3),
    }


def _error() -> dict[str, Column]:
    t, chars, raw, low = _t(), _chars(), _raw_count(), F.lower(_t())
    hits = sum((F.when(low.rlike(T.uni(p, "m")), 1).otherwise(0) for p in lex.ERROR_PROMPT_CODE), F.lit(0))
    return {
        "char_length": chars,
        "word_count": _nwords(),
        "token_count": raw,
        "unique_word_ratio": safe_ratio(F.size(F.array_distinct(_words())), _nwords()),
        "repeated_token_count": K.surplus(_words()),
        "repeated_token_ratio": safe_ratio(K.surplus(_words()), _nwords()),
        "repeated_phrase_count": F.when(_nwords() >= 6, K.surplus(K.ngrams(_words(), 3))).otherwise(0),
        "weird_token_count": K.weird_no_vowel_rule(t),
        "weird_token_ratio": safe_ratio(K.weird_no_vowel_rule(t), raw),
        "long_token_count": K.long_raw(t),
        "mixed_alnum_token_count": K.mixed_raw(t),
        "symbol_heavy_token_count": K.symbol_heavy_raw(t),
        "non_ascii_ratio": safe_ratio(_non_ascii(), chars),
        "punctuation_ratio": safe_ratio(_punct(), chars),
        "digit_ratio": safe_ratio(_digits(), chars),
        "newline_count": _newlines(),
        "repeated_char_count": _runs(3),
        "prompt_code_hits": hits,
    }


def _artifact() -> dict[str, Column]:
    t, chars, n = _t(), _chars(), F.size(_uwords())
    unique = safe_ratio(F.size(F.array_distinct(F.col("_ul"))), n)
    non_ascii = safe_ratio(_non_ascii(), chars)
    prompt = t.rlike(T.uni(lex.ARTIFACT_PROMPT, "i")) | t.rlike(T.uni(lex.ARTIFACT_CODE, "i"))
    multilingual = t.rlike(lex.ARTIFACT_MOJIBAKE) | (non_ascii >= 0.10) | t.rlike(r"[^\x{00}-\x{FF}]")
    return {
        "char_length": chars,
        "word_count": n,
        "unique_word_ratio": unique,
        "repeated_token_ratio": F.when(n == 0, 0.0).otherwise(1.0 - unique),
        "weird_token_ratio": safe_ratio(K.count_if(_uwords(), lambda w: w.rlike(K.WEIRD_ARTIFACT)), n),
        "max_word_length": K.max_length(_uwords()),
        "avg_word_length": safe_ratio(K.total_length(_uwords()), n),
        "sentence_count": _sentences(),
        "newline_count": _newlines(),
        "punctuation_ratio": safe_ratio(_punct(), chars),
        "digit_ratio": safe_ratio(_digits(), chars),
        "non_ascii_ratio": non_ascii,
        "special_char_ratio": safe_ratio(_symbols(), chars),
        "uppercase_ratio": safe_ratio(_uppers(), _letters()),
        "decode_error_flag": _flag(t.rlike(T.uni(lex.ARTIFACT_DECODE, "i"))),
        "prompt_or_code_flag": _flag(prompt),
        "multilingual_or_encoding_flag": _flag(multilingual),
        "url_flag": _flag(t.rlike(T.uni(lex.URL_DOMAIN, "i"))),
    }


def _engineered() -> dict[str, Column]:
    t, n, low = _t(), F.size(_uwords()), F.col("_ul")
    chars, sl = F.greatest(_chars(), F.lit(1)), F.col("_sl")
    return {
        "char_length": _chars(),
        "word_count": n,
        "unique_word_ratio": safe_ratio(F.size(F.array_distinct(low)), n),
        "avg_word_length": safe_ratio(K.total_length(low), n),
        "digit_ratio": _digits() / chars,
        "uppercase_ratio": safe_ratio(_uppers(), _letters()),
        "punctuation_ratio": _punct() / chars,
        "non_alphanumeric_ratio": _symbols() / chars,
        "newline_count": _newlines(),
        "url_count": T.count_re(t, T.uni(lex.URL_FULL, "i")),
        "repeated_token_count": K.surplus(low),
        "very_long_token_count": K.count_if(low, lambda w: F.length(w) >= 15),
        "short_sentence_count": K.count_if(sl, lambda x: (x > 0) & (x <= 5)),
        "long_sentence_count": K.count_if(sl, lambda x: x >= 25),
        "approx_sentence_count": F.size(sl),
    }


def _engineered_prepare() -> dict[str, Column]:
    lengths = _sentence_lengths(T.WORD_UNICODE)
    whole = F.array(T.count_re(_t(), T.WORD_UNICODE))
    return {
        "_u": K.tokens(_t(), T.WORD_UNICODE),
        "_ul": K.tokens(_t(), T.WORD_UNICODE, lower=True),
        "_sl": F.when((F.size(lengths) == 0) & (_chars() > 0), whole).otherwise(lengths),
    }


def _style_vector() -> dict[str, Column]:
    return {
        "char_length": _chars(),
        "word_count": _nwords(),
        "sentence_count": _sentences(),
        "max_word_length": K.max_length(_words()),
        "avg_word_length": safe_ratio(K.total_length(_words()), _nwords()),
        "stopword_ratio": safe_ratio(K.in_list(_words(), lex.STOPWORDS_FULL), _nwords()),
        "unique_word_ratio": safe_ratio(F.size(F.array_distinct(_words())), _nwords()),
        "repeated_token_count": K.surplus(_words()),
        "newline_count": _newlines(),
    }


def _rule_stats() -> dict[str, Column]:
    chars = _chars()
    return {
        "char_length": chars,
        "word_count": _nwords(),
        "unique_ratio": safe_ratio(F.size(F.array_distinct(_words())), _nwords()),
        "stopword_ratio": safe_ratio(K.in_list(_words(), lex.STOPWORDS_RULES), _nwords()),
        "non_ascii_ratio": safe_ratio(_non_ascii(), chars),
        "punct_ratio": safe_ratio(_symbols(), chars),
        "digit_ratio": safe_ratio(_digits(), chars),
        "uppercase_ratio": safe_ratio(_uppers(), _letters()),
        "newline_count": _newlines(),
        "repeated_tokens": K.adjacent_equal(_words()),
        "long_token_count": K.count_if(_words(), lambda w: F.length(w) >= 18),
        "repeated_char_count": T.count_re(F.lower(_t()), r"([^\n])\1{3,}"),
    }


def _tag_stats() -> dict[str, Column]:
    chars = _chars()
    return {
        "word_count": _nwords(),
        "char_length": chars,
        "unique_ratio": safe_ratio(F.size(F.array_distinct(_words())), _nwords()),
        "stopword_ratio": safe_ratio(K.in_list(_words(), lex.STOPWORDS_TAGS), _nwords()),
        "non_ascii_ratio": safe_ratio(_non_ascii(), chars),
        "punct_ratio": safe_ratio(_symbols(), chars),
        "digit_ratio": safe_ratio(_digits(), chars),
        "newline_count": _newlines(),
        "repeated_token_count": K.adjacent_equal(_words()),
        "long_token_count": K.count_if(_words(), lambda w: F.length(w) >= 18),
        "repeated_char_count": _runs(4),
    }


def _lengths() -> dict[str, Column]:
    return {"char_length": _chars(), "word_count": _raw_count(), "newline_count": _newlines()}


def _unicode_words(pattern: str, lower_first: bool = False) -> Callable[[], dict[str, Column]]:
    def prepare() -> dict[str, Column]:
        if lower_first:
            return {"_u": K.tokens(F.lower(_t()), pattern)}
        return {"_u": K.tokens(_t(), pattern), "_ul": K.tokens(_t(), pattern, lower=True)}

    return prepare


FAMILIES: dict[str, Family] = {
    "basic": Family(dict, _basic, normalize=False),
    "weirdness": Family(_unicode_words(T.WORD_UNICODE, lower_first=True), _weirdness, normalize=False),
    "style": Family(_unicode_words(T.WORD_UNICODE_APOS), _style),
    "hard_weight": Family(_ascii_words, _hard_weight),
    "domain_cues": Family(_ascii_words, _domain_cues),
    "noise": Family(
        lambda: _ascii_words()
        | {
            "_runs": K.run_lengths(K.tokens(_t(), T.WORD_ASCII, lower=True)),
            "_sl": _sentence_lengths(T.WORD_ASCII),
            "_cc": K.char_counts(_t()),
            "_weird": K.weird_full(_t()),
        },
        _noise,
    ),
    "review": Family(_ascii_words, _review),
    "error": Family(_ascii_words, _error),
    "artifact": Family(_unicode_words(T.WORD_UNICODE_APOS), _artifact),
    "engineered": Family(_engineered_prepare, _engineered),
    "style_vector": Family(_ascii_words, _style_vector),
    "rule_stats": Family(lambda: {"_w": K.tokens(F.lower(_t()), T.WORD_ASCII)}, _rule_stats),
    "tag_stats": Family(lambda: {"_w": K.tokens(_t(), T.WORD_TAG, lower=True)}, _tag_stats),
    "lengths": Family(dict, _lengths),
}


def feature_names(family: str) -> list[str]:
    return list(FAMILIES[family].columns())


def add_features(df: DataFrame, family: str, text: str = "text", only: list[str] | None = None) -> DataFrame:
    """Append the DOUBLE columns of a family, replacing same-named input columns."""
    spec = FAMILIES[family]
    base = T.normalize_text(text) if spec.normalize else F.coalesce(F.col(text), F.lit(""))
    staged = df.withColumn(TXT, base)
    prepared = spec.prepare()
    if prepared:
        staged = staged.withColumns(prepared)
    cols = {n: c for n, c in spec.columns().items() if only is None or n in only}
    keep = [F.col(c) for c in df.columns if c not in cols]
    return staged.select(*keep, *[c.cast("double").alias(n) for n, c in cols.items()])


@F.pandas_udf(DoubleType())
def compression_ratio(texts: pd.Series) -> pd.Series:
    """zlib-compressed size over byte size; the one feature without a built-in expression."""
    import zlib

    def ratio(value) -> float:
        raw = (value or "").encode("utf-8", "ignore")
        return len(zlib.compress(raw)) / len(raw) if raw else 0.0

    return texts.map(ratio).astype("float64")


def rare_token_ratios(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Share of a document's tokens seen at most twice / once in the whole corpus.

    A token with a corpus total of two or less touches at most two documents, so its
    owners are its smallest and largest id: one combinable aggregate per token, no join
    of the corpus counts back to the token table, no collected groups.
    """
    words = K.explode_rows(df, [id_col], K.tokens(T.normalize_text(text), T.WORD_ASCII, lower=True), "token")
    per_token = words.groupBy("token").agg(
        F.count(F.lit(1)).alias("total"), F.min(id_col).alias("lo"), F.max(id_col).alias("hi")
    )
    rare = per_token.filter("total <= 2")
    owners = rare.select(
        F.explode(
            F.when((F.col("total") == 1), F.array("lo")).otherwise(F.array("lo", "hi"))
        ).alias(id_col),
        F.when(F.col("total") == 1, 1).otherwise(0).alias("hapax"),
    )
    counts = owners.groupBy(id_col).agg(F.count(F.lit(1)).alias("rare_n"), F.sum("hapax").alias("hapax_n"))
    sizes = df.select(id_col, T.count_re(T.normalize_text(text), T.WORD_ASCII).alias("word_n"))
    return sizes.join(counts, id_col, "left").select(
        id_col,
        safe_ratio(F.coalesce("rare_n", F.lit(0)), "word_n").alias("rare_token_ratio"),
        safe_ratio(F.coalesce("hapax_n", F.lit(0)), "word_n").alias("hapax_token_ratio"),
    )
