"""Token arrays, run lengths, n-grams and weird-token counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convosieve.functions.scalar import let
from convosieve.functions.text import ALNUM, DIGIT, WORD_MIN2, WORD_UNICODE, WS, _col, count_re

_S = rf"[^{WS}]"
_START = rf"(?<!{_S})"
_SYM = rf"[^{WS}{ALNUM}]"
# Lookaheads placed at the first character of a whitespace-delimited token.
_LONG = rf"(?={_S}{{18}})"
_MIXED = rf"(?=[^{WS}{DIGIT}]*+[{DIGIT}])(?={_S}*?\p{{L}})"
_SYMBOLS = rf"(?=(?:[{ALNUM}]*+{_SYM}){{3}})"
_NO_VOWEL = rf"(?![^{WS}aeiouAEIOU]*+[aeiouAEIOU])(?=(?:{_SYM}*+[{ALNUM}]){{8}})"
_RUN3 = rf"(?={_S}*?({_S})\1\1)"


def tokens(c, pattern: str, lower: bool = False) -> Column:
    found = F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(0))
    return F.transform(found, F.lower) if lower else found


def count_raw(c, *conditions: str) -> Column:
    """Whitespace-delimited tokens that meet any of the lookahead conditions, in one regex pass."""
    return count_re(c, f"{_START}(?:{'|'.join(conditions)}){_S}+")


def weird_full(c) -> Column:
    """Long, mixed letters and digits, vowel-less, repeated characters, or symbol-heavy."""
    return count_raw(c, _LONG, _MIXED, _NO_VOWEL, _RUN3, _SYMBOLS)


def weird_no_vowel_rule(c) -> Column:
    return count_raw(c, _LONG, _MIXED, _RUN3, _SYMBOLS)


def long_raw(c) -> Column:
    return count_raw(c, _LONG)


def mixed_raw(c) -> Column:
    return count_raw(c, _MIXED)


def symbol_heavy_raw(c) -> Column:
    return count_raw(c, _SYMBOLS)


def no_vowel_raw(c) -> Column:
    return count_raw(c, _NO_VOWEL)


def containing_raw(c, pattern: str) -> Column:
    return count_raw(c, rf"(?={_S}*?{pattern})")


_MIXED_WORD = rf"(?=.*\p{{L}})(?=.*[{DIGIT}])"
WEIRD_STYLE = rf"^(?:{_MIXED_WORD}|(?=.*[^\x00-\x7F])|(?=.*(.)\1\1\1)|(?=.*[_/\\-]))"
WEIRD_ARTIFACT = rf"^(?:(?=.{{16}})|(?=.*(.)\1\1\1)|{_MIXED_WORD}|(?=.*[^\x00-\x7F]))"


def count_if(arr: Column, pred) -> Column:
    return F.size(F.filter(arr, pred))


def in_list(arr: Column, words) -> Column:
    words = list(words)
    return count_if(arr, lambda w: w.isin(words))


def total_length(arr: Column) -> Column:
    return F.length(F.array_join(arr, ""))


def max_length(arr: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(arr, F.length)), F.lit(0))


def surplus(arr: Column) -> Column:
    """Occurrences beyond the first of each value."""
    return let(arr, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def adjacent_equal(arr: Column) -> Column:
    n = F.size(arr)
    pairs = F.zip_with(F.slice(arr, F.lit(1), n - 1), F.slice(arr, F.lit(2), n - 1), lambda a, b: a == b)
    return F.when(n < 2, 0).otherwise(F.size(F.filter(pairs, lambda x: x)))


def run_lengths(arr: Column) -> Column:
    """Sizes of the groups of equal values (sort once, then one linear pass)."""
    srt = F.sort_array(arr)

    def body(s: Column) -> Column:
        n = F.size(s)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(s, i - 1) != F.get(s, i)))
        starts = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0))))
        return F.zip_with(ends, starts, lambda e, b: e - b)

    empty = F.array().cast("array<int>")
    return F.when(F.size(arr) == 0, empty).otherwise(F.get(F.transform(F.array(srt), body), F.lit(0)))


def entropy_bits(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts."""
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    clogc = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * F.log(x.cast("double")))
    return F.when(F.size(counts) == 0, 0.0).otherwise(
        (F.log(total.cast("double")) - clogc / total) / F.lit(math.log(2.0))
    )


def char_counts(c) -> Column:
    """How often each distinct character occurs, by their first places (one native scan each over what the ones before have left)."""
    c = _col(c)

    def take(a: Column, ch: Column) -> Column:
        return let(
            F.replace(a["rest"], ch, F.lit("")),
            lambda rest: F.struct(rest.alias("rest"), F.length(rest).alias("n"), F.concat(a["counts"], F.array(a["n"] - F.length(rest))).alias("counts")),
        )

    start = F.struct(c.alias("rest"), F.length(c).alias("n"), F.array().cast("array<int>").alias("counts"))
    return F.aggregate(F.array_distinct(F.split(c, "")), start, take, lambda a: a["counts"])


# --- n-grams ----------------------------------------------------------------------


def ngrams(arr: Column, n: int, sep: str = " ") -> Column:
    """All runs of n consecutive tokens."""
    if n == 1:
        return arr
    size = F.size(arr)
    grams = F.transform(
        F.sequence(F.lit(0), size - n),
        lambda i: F.concat_ws(sep, *[F.get(arr, i + F.lit(k)) for k in range(n)]),
    )
    return F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))


def word_ngrams(c, lo: int = 1, hi: int = 2, pattern: str = WORD_MIN2) -> Column:
    """Lower-cased word n-grams of sizes lo..hi (words of two characters or more by default)."""
    words = tokens(F.lower(_col(c)), pattern)
    return F.get(
        F.transform(F.array(words), lambda w: F.concat(*[ngrams(w, n) for n in range(lo, hi + 1)])), F.lit(0)
    )


def char_wb_ngrams(c, lo: int = 3, hi: int = 5) -> Column:
    """Character n-grams inside space-padded words; a word shorter than n yields its padded form once."""
    padded = F.transform(tokens(F.lower(_col(c)), rf"[^{WS}]+"), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def sized(w: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substr(w, i, F.lit(n)))

    def of_word(w: Column) -> Column:
        # Once a word is no longer than n, its whole padded form is emitted and larger n are skipped.
        empty = F.array().cast("array<string>")
        return F.concat(
            sized(w, lo), *[F.when(F.length(w) > n - 1, sized(w, n)).otherwise(empty) for n in range(lo + 1, hi + 1)]
        )

    return F.flatten(F.transform(padded, of_word))


def explode_rows(df: DataFrame, keep: list, arr, name: str) -> DataFrame:
    """One row per array element.

    A plain explode lets the optimizer infer a size filter and push the whole array expression
    below it a second time; the outer form with a null filter evaluates it once.
    """
    return df.select(*keep, F.explode_outer(arr).alias(name)).filter(F.col(name).isNotNull())


def strip_accents(c) -> Column:
    """Fold Latin letters with marks to their base letter (precomposed Latin-1 and Latin Extended-A)."""
    import unicodedata

    src, dst = [], []
    for code in [*range(0xC0, 0x180), *range(0x1CD, 0x1DD), *range(0x1E00, 0x1F00)]:
        decomposed = unicodedata.normalize("NFKD", chr(code))
        base = "".join(ch for ch in decomposed if not unicodedata.combining(ch))
        if len(base) == 1 and base != chr(code):
            src.append(chr(code))
            dst.append(base)
    folded = F.translate(_col(c), "".join(src), "".join(dst))
    return F.regexp_replace(folded, r"\p{Mn}+", "")
