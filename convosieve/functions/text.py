"""Text and label normalisation, match keys, previews and counting primitives.

Everything here maps Column to Column and stays inside Catalyst.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from convosieve.functions import lexicons as lex
from convosieve.functions.scalar import let

# Character classes (inside [...]) that follow Unicode general categories.
WS = r"\s\x1c-\x1f\x{85}\p{Z}"
ALNUM = r"\p{L}\p{N}"
DIGIT = r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
PUNCT = "".join("\\" + ch for ch in lex.PUNCTUATION)

# Token patterns.
WORD_ASCII = r"[A-Za-z0-9_']+"
WORD_TAG = r"[A-Za-z0-9_'-]+"
WORD_UNICODE = rf"[{ALNUM}_]+"
WORD_UNICODE_APOS = rf"[{ALNUM}_](?:[{ALNUM}_']*[{ALNUM}_])?"
WORD_MIN2 = rf"[{ALNUM}_]{{2,}}"
RAW_TOKEN = rf"[^{WS}]+"
SENTENCE_BREAK = r"[.!?]+|\n+"

# Unicode whitespace that a full strip removes.
STRIP_CHARS = "".join(
    chr(code)
    for code in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uni(pattern: str, flags: str = "") -> str:
    """Regex with Unicode-aware \\w \\d \\s \\b, plus optional inline flags (i, m, s)."""
    return f"(?U{flags}){pattern}"


def strip(c) -> Column:
    return F.btrim(_col(c), F.lit(STRIP_CHARS))


def count_re(c, pattern: str) -> Column:
    return F.regexp_count(_col(c), F.lit(pattern))


def has_re(c, pattern: str) -> Column:
    return _col(c).rlike(pattern)


def count_dense(c, char_class: str) -> Column:
    """Count characters of a class that makes up most of the text (removes the rest in runs)."""
    return F.length(F.regexp_replace(_col(c), f"[^{char_class}]+", ""))


def count_char(c, ch: str) -> Column:
    """Occurrences of one character, without a regex."""
    c = _col(c)
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


# --- normalisation ----------------------------------------------------------------


def normalize_newlines(c) -> Column:
    c = F.coalesce(_col(c).cast("string"), F.lit(""))
    c = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    return F.replace(c, F.lit("\r"), F.lit("\n"))


def normalize_text(c) -> Column:
    """Null to empty, CRLF/CR to LF, strip Unicode whitespace."""
    return strip(normalize_newlines(c))


def normalize_label(c, true_words=("TRUE", "T", "1"), false_words=("FALSE", "F", "0"), unknown="null") -> Column:
    """Label spellings to TRUE/FALSE.

    unknown: ``null`` (count them with the label-domain check), ``error``
    (fails the job when evaluated) or ``keep`` (upper-cased spelling, null stays null).
    """
    raw = F.upper(strip(_col(c).cast("string")))
    hit = F.when(raw.isin(*true_words), F.lit("TRUE")).when(raw.isin(*false_words), F.lit("FALSE"))
    if unknown == "null":
        return hit
    if unknown == "keep":
        return hit.otherwise(raw)
    if unknown == "error":
        bad = F.raise_error(F.concat(F.lit("Unexpected label in the data, got "), F.coalesce(raw, F.lit("<missing>"))))
        return hit.otherwise(bad.cast("string"))
    raise ValueError(f"unknown must be null, keep or error: {unknown!r}")


def normalize_label_yes_no(c, unknown="null") -> Column:
    return normalize_label(c, ("TRUE", "1", "YES", "Y"), ("FALSE", "0", "NO", "N"), unknown)


def normalize_label_words_only(c, unknown="null") -> Column:
    return normalize_label(c, ("TRUE",), ("FALSE",), unknown)


def encode_label(c) -> Column:
    return F.when(_col(c) == "TRUE", F.lit(1)).when(_col(c) == "FALSE", F.lit(0))


def decode_label(c) -> Column:
    return F.when(_col(c) == 1, F.lit("TRUE")).otherwise(F.lit("FALSE"))


# --- match keys -------------------------------------------------------------------


def _squash(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"[{WS}]+", " "))


def _mask(c: Column, url: str, email: str, number: str) -> Column:
    c = F.regexp_replace(c, uni(lex.URL_FULL, "i"), url)
    c = F.regexp_replace(c, uni(lex.EMAIL), email)
    return F.regexp_replace(c, uni(lex.NUMBER), number)


def exact_key(c) -> Column:
    return _squash(F.lower(_col(c)))


def loose_key(c) -> Column:
    """Masks volatile values, drops ASCII punctuation (the mask brackets included)."""
    masked = _mask(F.lower(_col(c)), " <url> ", " <email> ", " <num> ")
    return _squash(F.regexp_replace(masked, f"[{PUNCT}]+", ""))


def template_key(c) -> Column:
    masked = _mask(F.lower(_col(c)), " <URL> ", " <EMAIL> ", " <NUM> ")
    return _squash(F.regexp_replace(masked, lex.MARKUP_RUN, " <MARKUP> "))


def shape_key(c) -> Column:
    """Structural signature of the whole text: letter runs to A, digit runs to 0, other symbols to X."""
    c = F.regexp_replace(_col(c), rf"[^\p{{L}}{DIGIT}{WS}{PUNCT}]", "\u0001")
    c = F.regexp_replace(c, r"\p{L}+", "A")
    c = F.regexp_replace(c, f"[{DIGIT}]+", "0")
    c = F.regexp_replace(F.replace(c, F.lit("\u0001"), F.lit("X")), f"[{WS}]+", " ")
    return strip(c)


KEYS = {"exact_key": exact_key, "loose_key": loose_key, "template_key": template_key, "shape_key": shape_key}


# --- previews ---------------------------------------------------------------------


def preview(c, limit: int = 300) -> Column:
    """One-line preview: newlines shown as \\n, ellipsis when cut."""
    c = F.replace(_col(c), F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 3), F.lit("...")))


def snippet(c, limit: int = 220) -> Column:
    """One-line snippet: newlines shown as /, whitespace squashed, ellipsis when cut."""
    c = _squash(F.replace(normalize_text(c), F.lit("\n"), F.lit(" / ")))
    cut = F.rtrim(F.substring(c, 1, limit - 3))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("...")))


def head_tail(c, max_chars: int, marker: str = "\n...[TRUNCATED]...\n") -> Column:
    c = _col(c)
    tail = max_chars - max_chars // 2
    cut = F.concat(F.substring(c, 1, max_chars // 2), F.lit(marker), F.substring(c, -tail, tail))
    return F.when(F.length(c) <= max_chars, c).otherwise(cut)


# --- nested payloads --------------------------------------------------------------


def join_turns(turns, text_field: str = "text") -> Column:
    """Flatten ARRAY<STRUCT<..., text>> to one text, skipping empty parts."""
    parts = F.filter(F.transform(_col(turns), lambda t: t[text_field]), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(parts, "\n")


def flatten_json_text(c, depth: int = 3) -> Column:
    """Readable text of a nested JSON string: preferred keys first, lists and other objects joined by newline.

    JSON has no bound on nesting, a column expression does; parts nested deeper than
    ``depth`` come back as their raw JSON.
    """

    def scalar(raw: Column) -> Column:
        unquoted = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
        words = F.when(raw == "null", "").when(raw == "true", "True").when(raw == "false", "False").otherwise(raw)
        return F.when(raw.startswith('"'), unquoted).otherwise(words)

    def kind(values: Column, k: int) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(k).alias("k"), _requote(x).alias("v")))

    def joined(parts: Column, k: int) -> Column:
        return F.array_join(F.transform(F.filter(parts, lambda p: (p["k"] == k) & (p["t"] != "")), lambda p: p["t"]), "\n")

    def walk(raw: Column, level: int) -> Column:
        if level == 0:
            return scalar(raw)

        def body(r: Column) -> Column:
            m = F.from_json(r, "map<string,string>", {"mode": "PERMISSIVE"})
            preferred = F.array_compact(F.array(*[m[k] for k in lex.PREFERRED_TEXT_KEYS]))
            of_map = F.concat(kind(preferred, 1), kind(F.array_compact(F.map_values(m)), 2))
            of_list = kind(F.array_compact(F.from_json(r, "array<string>", {"mode": "PERMISSIVE"})), 2)
            children = F.when(r.startswith("["), of_list).when(r.startswith("{"), of_map)
            texts = F.transform(children, lambda c: F.struct(c["k"].alias("k"), walk(c["v"], level - 1).alias("t")))
            # Preferred keys win when any of them holds text, otherwise every value counts.
            parts = let(texts, lambda p: F.when(joined(p, 1) != "", joined(p, 1)).otherwise(joined(p, 2)))
            return F.when(children.isNull(), scalar(r)).otherwise(parts)

        return let(raw, body)

    return F.coalesce(walk(F.btrim(_col(c)), depth), F.lit(""))


def _requote(part: Column) -> Column:
    # Array/map extraction already unquotes strings; re-mark plain strings so that they stay strings.
    is_nested = part.startswith("{") | part.startswith("[")
    return F.when(is_nested, part).otherwise(F.concat(F.lit('"'), _json_escape(part), F.lit('"')))


def _json_escape(c: Column) -> Column:
    for ch, esc in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        c = F.replace(c, F.lit(ch), F.lit(esc))
    return c


def turn_count(text, turns=None) -> Column:
    """List size when a turn list is given, else role-marker lines, else non-empty lines."""
    text = _col(text)
    roles = count_re(text, uni(lex.ROLE_LINE, "im"))
    lines = count_re(text, rf"[^\n{WS}][^\n]*")
    by_text = F.when(F.length(text) == 0, 0).when(roles > 0, roles).otherwise(F.greatest(F.lit(1), lines))
    if turns is None:
        return by_text
    return F.coalesce(F.size(_col(turns)), by_text)


def escape_words(words) -> str:
    return "|".join(re.escape(w) for w in words)
