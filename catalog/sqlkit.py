"""SQL fragments the oracles share: the derived views and text primitives, written for DuckDB."""

from __future__ import annotations

from convosieve.functions import lexicons as lex
from convosieve.functions.text import STRIP_CHARS

WS = r"\s\x0b\x1c-\x1f\x{85}\pZ"
DIG = r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
AN = r"\pL\pN"
PUNCT = r"!-/:-@\[-`{-~"

LAB = "lab AS (SELECT doc_id, CASE WHEN toxic = 1 OR quality = 0 THEN 'TRUE' ELSE 'FALSE' END AS label FROM labels)"
TRAIN = f"{LAB}, train AS (SELECT d.doc_id, d.text, d.lang, d.source, l.label, CASE WHEN l.label = 'TRUE' THEN 1 ELSE 0 END AS y FROM documents d JOIN lab l USING (doc_id))"
TEST = "test AS (SELECT d.doc_id, d.text, d.lang, d.source FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels))"
_H = {1: (7919, 17), 2: (104729, 31), 3: (1299709, 57), 4: (15485863, 101)}
_noise = {k: f"((doc_id * {a} + {b}) % 10007) / 10007.0::DOUBLE" for k, (a, b) in _H.items()}
SCORED = (
    f"{LAB}, scored AS (SELECT doc_id, label, CASE WHEN label = 'TRUE' THEN 1 ELSE 0 END AS y, "
    + ", ".join(f"0.30::DOUBLE * (CASE WHEN label = 'TRUE' THEN 1 ELSE 0 END) + 0.70::DOUBLE * ({e}) AS p{k}" for k, e in _noise.items())
    + " FROM lab)"
)
UNSCORED = (
    "unscored AS (SELECT doc_id, " + ", ".join(f"{e} AS p{k}" for k, e in _noise.items())
    + " FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {q(STRIP_CHARS)})"


def norm(x: str) -> str:
    return strip(f"replace(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))")


def cnt(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, {q(p)}))"


def has(x: str, p: str) -> str:
    return f"regexp_matches({x}, {q(p)})"


def words(x: str, p: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {q(p)}), lambda z: lower(z))"


def nchar(x: str, ch: str) -> str:
    return f"(length({x}) - length(replace({x}, {q(ch)}, '')))"


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0.0)"


def inlist(lst: str, items) -> str:
    arr = "[" + ", ".join(q(i) for i in items) + "]"
    return f"len(list_filter({lst}, lambda z: list_contains({arr}, z)))"


def surplus(lst: str) -> str:
    return f"(len({lst}) - len(list_distinct({lst})))"


def adjacent(lst: str) -> str:
    return f"len(list_filter(range(2, len({lst}) + 1), lambda i: {lst}[i] = {lst}[i - 1]))"


def grams(lst: str, n: int) -> str:
    parts = " || ' ' || ".join(f"{lst}[i + {k}]" for k in range(n))
    return f"list_transform(range(1, len({lst}) - {n - 2}), lambda i: {parts})"


def run_in(tok: str, n: int) -> str:
    eq = " AND ".join(f"{tok}[i] = {tok}[i + {k}]" for k in range(1, n))
    return f"len(list_filter(range(1, length({tok}) - {n - 2}), lambda i: {eq})) > 0"


def runs(chars: str, n: int) -> str:
    """Maximal runs of n or more equal characters (newline excluded) in a list of characters."""
    eq = " AND ".join(f"{chars}[i] = {chars}[i + {k}]" for k in range(1, n))
    return (
        f"len(list_filter(range(1, len({chars}) - {n - 2}), lambda i: {chars}[i] <> chr(10) AND {eq} "
        f"AND (i = 1 OR {chars}[i - 1] <> {chars}[i])))"
    )


def maxlen(lst: str) -> str:
    return f"coalesce(list_max(list_transform({lst}, lambda z: length(z))), 0)"


def sumlen(lst: str) -> str:
    return f"coalesce(list_sum(list_transform({lst}, lambda z: length(z))), 0)"


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END"


_mixed = f"({has('z', r'\pL')} AND {has('z', f'[{DIG}]')})"
_symbols = f"{cnt('z', f'[^{AN}]')} >= 3"
_novowel = f"({cnt('z', f'[{AN}]')} >= 8 AND NOT {has('z', '[aeiouAEIOU]')})"
WEIRD_FULL = f"length(z) >= 18 OR {_mixed} OR {_novowel} OR {run_in('z', 3)} OR {_symbols}"
WEIRD_NV = f"length(z) >= 18 OR {_mixed} OR {run_in('z', 3)} OR {_symbols}"
WEIRD_STYLE = f"{_mixed} OR {has('z', r'[^\x00-\x7F]')} OR {run_in('z', 4)} OR {has('z', r'[_/\\-]')}"
WEIRD_ARTIFACT = f"length(z) >= 16 OR {run_in('z', 4)} OR {_mixed} OR {has('z', r'[^\x00-\x7F]')}"


def toks(lst: str, cond: str) -> str:
    return f"len(list_filter({lst}, lambda z: {cond}))"


def sentence_parts(x: str = "t") -> str:
    split = r"[.!?]+|\n+"
    nonblank = f"[^{WS}]"
    return f"list_filter(string_split_regex({x}, {q(split)}), lambda s: {has('s', nonblank)})"


UNI = rf"[{AN}_]+"
UNI_APOS = rf"[{AN}_](?:[{AN}_']*[{AN}_])?"
ASCII = r"[A-Za-z0-9_']+"
TAGW = r"[A-Za-z0-9_'-]+"

_c = {
    "chars": "length(t)",
    "nl": nchar("t", "\n"),
    "sym": cnt("t", f"[^{AN}{WS}]"),
    "punct": cnt("t", f"[{PUNCT}]"),
    "dig": cnt("t", f"[{DIG}]"),
    "alpha": cnt("t", r"\pL"),
    "upper": cnt("t", r"\p{Lu}"),
    "space": cnt("t", f"[{WS}]"),
    "nonascii": cnt("t", r"[^\x00-\x7F]"),
    "url": cnt("t", f"(?i){lex.URL_PREFIX}"),
}


def _avg(lst: str) -> str:
    return ratio(sumlen(lst), f"len({lst})")


def entropy(counts: str) -> str:
    total = f"list_sum({counts})"
    return (
        f"CASE WHEN len({counts}) = 0 THEN 0.0 ELSE -list_sum(list_transform({counts}, lambda c: (c::DOUBLE / {total}) "
        f"* log2(c::DOUBLE / {total}))) END"
    )


# family: (CTE columns computed from t, then name -> expression)
def families() -> dict[str, tuple[dict[str, str], dict[str, str]]]:
    c = _c
    raw = f"regexp_extract_all(t, {q(f'[^{WS}]+')})"
    ascii_words = words("t", ASCII)
    roles = cnt("t", f"(?im){lex.ROLE_LINE}")
    lines = f"len(list_filter(string_split(t, chr(10)), lambda s: {has('s', f'[^{WS}]')}))"
    out: dict[str, tuple[dict[str, str], dict[str, str]]] = {}
    out["basic"] = ({}, {
        "char_length": c["chars"], "word_count": cnt("t", UNI),
        "approx_turn_count": f"CASE WHEN length(t) = 0 THEN 0 WHEN {roles} > 0 THEN {roles} ELSE greatest(1, {lines}) END",
        "newline_count": c["nl"], "url_count": cnt("t", f"(?i){lex.URL_FULL}"),
        "code_like_count": f"{cnt('t', lex.CODE_FENCED)} + {cnt('t', lex.CODE_INLINE)} + {cnt('t', '(?i)' + lex.CODE_KEYWORDS)} + {cnt('t', lex.HTML_TAG)}",
    })
    uniq = ratio("len(list_distinct(u))", "len(u)")
    long12 = ratio(toks("u", "length(z) >= 12"), "len(u)")
    na = f"({c['sym']})::DOUBLE / greatest(length(t), 1)"
    ds = f"({c['sym']} + {c['dig']})::DOUBLE / greatest(length(t), 1)"
    rep = f"greatest(0.0, 1.0 - {uniq})"
    out["weirdness"] = ({"u": f"regexp_extract_all(lower(t), {q(UNI)})"}, {
        "token_count": "len(u)", "unique_word_ratio": uniq, "avg_word_length": _avg("u"), "long_token_ratio": long12,
        "repeated_token_ratio": rep, "non_alnum_ratio": na, "digit_symbol_ratio": ds,
        "weirdness_proxy": f"0.35::DOUBLE * {rep} + 0.25::DOUBLE * {na} + 0.20::DOUBLE * {ds} + 0.20::DOUBLE * {long12}",
    })
    apos = {"u": f"regexp_extract_all(t, {q(UNI_APOS)})", "ul": words("t", UNI_APOS), "sp": sentence_parts()}
    out["style"] = (apos, {
        "char_length": c["chars"], "word_count": "len(u)", "avg_word_length": _avg("u"), "max_word_length": maxlen("u"),
        "unique_word_ratio": ratio("len(list_distinct(ul))", "len(u)"), "stopword_ratio": ratio(inlist("ul", lex.STOPWORDS_STYLE), "len(u)"),
        "digit_ratio": ratio(c["dig"], "length(t)"), "uppercase_ratio": ratio(c["upper"], c["alpha"]),
        "punctuation_ratio": ratio(c["punct"], "length(t)"), "whitespace_ratio": ratio(c["space"], "length(t)"),
        "non_ascii_ratio": ratio(c["nonascii"], "length(t)"), "non_alnum_ratio": ratio(f"{c['sym']} + {c['space']}", "length(t)"),
        "newline_count": c["nl"], "url_domain_count": cnt("t", f"(?i){lex.URL_DOMAIN}"), "code_symbol_count": cnt("t", f"(?i){lex.STYLE_CODE}"),
        "decode_error_flag": flag("contains(t, '[DECODE ERROR]')"), "prompt_template_flag": flag(has("t", f"(?i){lex.STYLE_PROMPT}")),
        "spam_keyword_count": inlist("ul", lex.SPAM_TERMS), "risk_keyword_count": inlist("ul", lex.RISK_TERMS),
        "repeated_token_count": adjacent("ul"), "very_long_token_count": toks("u", "length(z) >= 20"),
        "weird_token_ratio": ratio(toks("u", WEIRD_STYLE), "len(u)"), "sentence_count": "len(sp)", "avg_sentence_word_count": ratio("len(u)", "len(sp)"),
    })
    aw = {"w": ascii_words, "raw": raw}
    hard = {
        "char_length": c["chars"], "word_count": "len(w)", "max_word_length": maxlen("w"), "stopword_ratio": ratio(inlist("w", lex.STOPWORDS_FULL), "len(w)"),
        "punctuation_ratio": ratio(c["punct"], "length(t)"), "special_char_ratio": ratio(c["sym"], "length(t)"), "newline_count": c["nl"],
        "url_count": c["url"], "repeated_token_count": surplus("w"), "weird_token_ratio": ratio(toks("raw", WEIRD_FULL), "len(raw)"),
    }
    out["hard_weight"] = (aw, hard)
    out["domain_cues"] = (aw, hard | {
        f"{n}_count": cnt("t", f"(?i){p}") for n, p in (
            ("insurance_term", lex.CUE_INSURANCE), ("coordination_term", lex.CUE_COORDINATION), ("manipulation_term", lex.CUE_MANIPULATION),
            ("cryptic_term", lex.CUE_CRYPTIC), ("agent_marker", lex.CUE_AGENT),
        )
    })
    slen = f"list_transform({sentence_parts()}, lambda s: {cnt('s', ASCII)})"
    ends = "list_filter(range(1, len(ch) + 1), lambda i: i = len(ch) OR ch[i] <> ch[i + 1])"
    # Token counts by sorting: positions where the sorted list changes.
    cuts = "list_filter(range(1, len(ws) + 1), lambda i: i = len(ws) OR ws[i] <> ws[i + 1])"
    out["noise"] = ({
        "w": ascii_words, "raw": raw, "sl": slen, "ch": "CASE WHEN t = '' THEN [] ELSE string_split(t, '') END", "ws": f"list_sort({ascii_words})",
    }, {
        "char_length": c["chars"], "byte_length": "strlen(t)", "word_count": "len(w)", "raw_token_count": "len(raw)", "sentence_count": "len(sl)",
        "avg_sentence_word_count": ratio("coalesce(list_sum(sl), 0)", "len(sl)"), "max_sentence_word_count": "coalesce(list_max(sl), 0)",
        "short_sentence_count": "len(list_filter(sl, lambda z: z <= 4))", "long_sentence_count": "len(list_filter(sl, lambda z: z >= 30))",
        "avg_word_length": _avg("w"), "max_word_length": maxlen("w"), "unique_word_ratio": ratio("len(list_distinct(w))", "len(w)"),
        "stopword_ratio": ratio(inlist("w", lex.STOPWORDS_FULL), "len(w)"), "punctuation_ratio": ratio(c["punct"], "length(t)"),
        "symbol_ratio": ratio(c["sym"], "length(t)"), "digit_ratio": ratio(c["dig"], "length(t)"), "alpha_ratio": ratio(c["alpha"], "length(t)"),
        "uppercase_ratio": ratio(c["upper"], c["alpha"]), "whitespace_ratio": ratio(c["space"], "length(t)"), "non_ascii_ratio": ratio(c["nonascii"], "length(t)"),
        "newline_count": c["nl"], "comma_count": nchar("t", ","), "quote_count": cnt("t", f"[{lex.QUOTES}]"), "bracket_count": cnt("t", r"[()\[\]{}<>]"),
        "url_count": c["url"], "email_count": cnt("t", lex.EMAIL), "repeated_char_count": runs("ch", 3),
        "max_repeated_char_run": f"coalesce(list_max(list_transform(range(1, len({ends}) + 1), lambda j: {ends}[j] - coalesce({ends}[j - 1], 0))), 0)",
        "repeated_token_count": surplus("w"), "repeated_token_ratio": ratio(surplus("w"), "len(w)"),
        "repeated_token_types": f"len(list_filter(range(1, len({cuts}) + 1), lambda j: {cuts}[j] - coalesce({cuts}[j - 1], 0) > 1))",
        "duplicate_bigram_count": surplus(grams("w", 2)), "repeated_phrase_count": surplus(grams("w", 3)),
        "weird_token_count": toks("raw", WEIRD_FULL), "weird_token_ratio": ratio(toks("raw", WEIRD_FULL), "len(raw)"),
        "long_token_count": toks("raw", "length(z) >= 18"), "mixed_alnum_token_count": toks("raw", _mixed), "symbol_heavy_token_count": toks("raw", _symbols),
        "no_vowel_long_token_count": toks("raw", _novowel), "camel_glue_count": toks("raw", has("z", lex.CAMEL_GLUE)),
        "char_entropy": "@CHAR_ENTROPY@", "token_entropy": "@TOKEN_ENTROPY@",
        "prompt_role_flag": flag(has("t", f"(?i){lex.ROLE_MARKER}")), "code_like_flag": flag(has("t", lex.NOISE_CODE)),
        "markdown_like_flag": flag(has("t", f"(?m){lex.NOISE_MARKDOWN}")), "template_marker_flag": flag("contains(lower(t), 'the passage above')"),
        "decode_error_flag": flag("contains(lower(t), '[decode error]')"), "list_or_bullet_flag": flag(has("t", f"(?m){lex.NOISE_LIST}")),
        "has_url_flag": flag(has("t", f"(?i){lex.URL_PREFIX}")), "has_non_ascii_flag": flag(has("t", r"[^\x00-\x7F]")), "has_newline_flag": flag("contains(t, chr(10))"),
    })
    out["review"] = ({"w": ascii_words, "raw": raw, "sp": sentence_parts(), "ch": "string_split(t, '')"}, {
        "char_length": c["chars"], "word_count": "len(w)", "sentence_count": "len(sp)", "avg_word_length": _avg("w"), "max_word_length": maxlen("w"),
        "unique_word_ratio": ratio("len(list_distinct(w))", "len(w)"), "stopword_ratio": ratio(inlist("w", lex.STOPWORDS_FULL), "len(w)"),
        "punctuation_ratio": ratio(c["punct"], "length(t)"), "digit_ratio": ratio(c["dig"], "length(t)"), "uppercase_ratio": ratio(c["upper"], c["alpha"]),
        "special_char_ratio": ratio(c["sym"], "length(t)"), "non_ascii_ratio": ratio(c["nonascii"], "length(t)"), "newline_count": c["nl"],
        "comma_count": nchar("t", ","), "quote_count": cnt("t", f"[{lex.QUOTES}]"), "bracket_count": cnt("t", r"[()\[\]{}<>]"), "url_count": c["url"],
        "repeated_token_count": surplus("w"), "long_token_count": toks("raw", "length(z) >= 18"), "weird_token_ratio": ratio(toks("raw", WEIRD_FULL), "len(raw)"),
        "repeated_char_count": runs("ch", 3),
    })
    hits = " + ".join(f"CASE WHEN {has('lower(t)', '(?m)' + p)} THEN 1 ELSE 0 END" for p in lex.ERROR_PROMPT_CODE)
    out["error"] = ({"w": ascii_words, "raw": raw, "ch": "string_split(t, '')"}, {
        "char_length": c["chars"], "word_count": "len(w)", "token_count": "len(raw)", "unique_word_ratio": ratio("len(list_distinct(w))", "len(w)"),
        "repeated_token_count": surplus("w"), "repeated_token_ratio": ratio(surplus("w"), "len(w)"),
        "repeated_phrase_count": f"CASE WHEN len(w) >= 6 THEN {surplus(grams('w', 3))} ELSE 0 END",
        "weird_token_count": toks("raw", WEIRD_NV), "weird_token_ratio": ratio(toks("raw", WEIRD_NV), "len(raw)"), "long_token_count": toks("raw", "length(z) >= 18"),
        "mixed_alnum_token_count": toks("raw", _mixed), "symbol_heavy_token_count": toks("raw", _symbols), "non_ascii_ratio": ratio(c["nonascii"], "length(t)"),
        "punctuation_ratio": ratio(c["punct"], "length(t)"), "digit_ratio": ratio(c["dig"], "length(t)"), "newline_count": c["nl"],
        "repeated_char_count": runs("ch", 3), "prompt_code_hits": hits,
    })
    nar = ratio(c["nonascii"], "length(t)")
    ur = ratio("len(list_distinct(ul))", "len(u)")
    out["artifact"] = (apos, {
        "char_length": c["chars"], "word_count": "len(u)", "unique_word_ratio": ur, "repeated_token_ratio": f"CASE WHEN len(u) = 0 THEN 0.0 ELSE 1.0 - {ur} END",
        "weird_token_ratio": ratio(toks("u", WEIRD_ARTIFACT), "len(u)"), "max_word_length": maxlen("u"), "avg_word_length": _avg("u"), "sentence_count": "len(sp)",
        "newline_count": c["nl"], "punctuation_ratio": ratio(c["punct"], "length(t)"), "digit_ratio": ratio(c["dig"], "length(t)"), "non_ascii_ratio": nar,
        "special_char_ratio": ratio(c["sym"], "length(t)"), "uppercase_ratio": ratio(c["upper"], c["alpha"]),
        "decode_error_flag": flag(has("t", f"(?i){lex.ARTIFACT_DECODE}")),
        "prompt_or_code_flag": flag(f"{has('t', '(?i)' + lex.ARTIFACT_PROMPT)} OR {has('t', '(?i)' + lex.ARTIFACT_CODE)}"),
        "multilingual_or_encoding_flag": flag(f"{has('t', lex.ARTIFACT_MOJIBAKE)} OR {nar} >= 0.10 OR {has('t', r'[^\x00-\x{FF}]')}"),
        "url_flag": flag(has("t", f"(?i){lex.URL_DOMAIN}")),
    })
    sl2 = f"list_transform({sentence_parts()}, lambda s: {cnt('s', UNI)})"
    out["engineered"] = ({
        "u": f"regexp_extract_all(t, {q(UNI)})", "ul": words("t", UNI), "sl": f"CASE WHEN len({sl2}) = 0 AND length(t) > 0 THEN [{cnt('t', UNI)}] ELSE {sl2} END",
    }, {
        "char_length": c["chars"], "word_count": "len(u)", "unique_word_ratio": ratio("len(list_distinct(ul))", "len(u)"), "avg_word_length": _avg("ul"),
        "digit_ratio": ratio(c["dig"], "length(t)"), "uppercase_ratio": ratio(c["upper"], c["alpha"]), "punctuation_ratio": ratio(c["punct"], "length(t)"),
        "non_alphanumeric_ratio": ratio(c["sym"], "length(t)"), "newline_count": c["nl"], "url_count": cnt("t", f"(?i){lex.URL_FULL}"),
        "repeated_token_count": surplus("ul"), "very_long_token_count": toks("ul", "length(z) >= 15"),
        "short_sentence_count": "len(list_filter(sl, lambda z: z > 0 AND z <= 5))", "long_sentence_count": "len(list_filter(sl, lambda z: z >= 25))",
        "approx_sentence_count": "len(sl)",
    })
    out["style_vector"] = ({"w": ascii_words, "sp": sentence_parts()}, {
        "char_length": c["chars"], "word_count": "len(w)", "sentence_count": "len(sp)", "max_word_length": maxlen("w"), "avg_word_length": _avg("w"),
        "stopword_ratio": ratio(inlist("w", lex.STOPWORDS_FULL), "len(w)"), "unique_word_ratio": ratio("len(list_distinct(w))", "len(w)"),
        "repeated_token_count": surplus("w"), "newline_count": c["nl"],
    })
    lowch = "string_split(lower(t), '')"
    out["rule_stats"] = ({"w": f"regexp_extract_all(lower(t), {q(ASCII)})", "ch": lowch}, {
        "char_length": c["chars"], "word_count": "len(w)", "unique_ratio": ratio("len(list_distinct(w))", "len(w)"),
        "stopword_ratio": ratio(inlist("w", lex.STOPWORDS_RULES), "len(w)"), "non_ascii_ratio": nar, "punct_ratio": ratio(c["sym"], "length(t)"),
        "digit_ratio": ratio(c["dig"], "length(t)"), "uppercase_ratio": ratio(c["upper"], c["alpha"]), "newline_count": c["nl"], "repeated_tokens": adjacent("w"),
        "long_token_count": toks("w", "length(z) >= 18"), "repeated_char_count": runs("ch", 4),
    })
    out["tag_stats"] = ({"w": words("t", TAGW), "ch": "string_split(t, '')"}, {
        "word_count": "len(w)", "char_length": c["chars"], "unique_ratio": ratio("len(list_distinct(w))", "len(w)"),
        "stopword_ratio": ratio(inlist("w", lex.STOPWORDS_TAGS), "len(w)"), "non_ascii_ratio": nar, "punct_ratio": ratio(c["sym"], "length(t)"),
        "digit_ratio": ratio(c["dig"], "length(t)"), "newline_count": c["nl"], "repeated_token_count": adjacent("w"),
        "long_token_count": toks("w", "length(z) >= 18"), "repeated_char_count": runs("ch", 4),
    })
    out["lengths"] = ({}, {"char_length": c["chars"], "word_count": "len(" + raw + ")", "newline_count": c["nl"]})
    cc = "list_transform(list_distinct(ch), lambda z: length(t) - length(replace(t, z, '')))"
    lens = f"list_transform(range(1, len({cuts}) + 1), lambda j: {cuts}[j] - coalesce({cuts}[j - 1], 0))"
    noise_cols = out["noise"][1]
    noise_cols["char_entropy"] = entropy("cc")
    noise_cols["token_entropy"] = entropy("tl")
    # Lists that other lists are built from get their own step.
    noise_cols["max_repeated_char_run"] = "coalesce(list_max(list_transform(range(1, len(ce) + 1), lambda j: ce[j] - coalesce(ce[j - 1], 0))), 0)"
    noise_cols["repeated_token_types"] = "len(list_filter(tl, lambda z: z > 1))"
    out["noise"] = (out["noise"][0] | {"@2": {"cc": cc, "ce": ends, "wcut": cuts}, "@3": {"tl": lens.replace(cuts, "wcut")}}, noise_cols)
    return out


FAMILIES = families()
NOT_NORMALIZED = {"basic", "weirdness"}


def feature_ctes(family: str, src: str, out: str, keep: str = "doc_id", text: str = "text", digits: int | None = None, only=None) -> str:
    """CTEs that compute a family over ``src`` into ``out`` (keep columns plus features as DOUBLE)."""
    prep, cols = FAMILIES[family]
    base = f"coalesce({text}, '')" if family in NOT_NORMALIZED else norm(text)
    ctes = [f"{out}_n AS (SELECT {keep}, {base} AS t FROM {src})"]
    last = f"{out}_n"
    steps = [{k: v for k, v in prep.items() if not k.startswith("@")}] + [v for k, v in sorted(prep.items()) if k.startswith("@")]
    for i, step in enumerate(steps):
        if not step:
            continue
        ctes.append(f"{out}_p{i} AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in step.items()) + f" FROM {last})")
        last = f"{out}_p{i}"
    wrap = (lambda e: f"round(({e})::DOUBLE, {digits})") if digits is not None else (lambda e: f"({e})::DOUBLE")
    keep_cols = ", ".join(k.strip() for k in keep.split(","))
    exprs = ", ".join(f"{wrap(v)} AS {k}" for k, v in cols.items() if only is None or k in only)
    ctes.append(f"{out} AS (SELECT {keep_cols}, {exprs} FROM {last})")
    return ", ".join(ctes)


def feature_names(family: str) -> list[str]:
    return list(FAMILIES[family][1])


def md5rank(seed: int, part: str | None, id_col: str = "doc_id") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({p}ORDER BY md5('{seed}:' || {id_col}), {id_col})"


def r(expr: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE, {digits})"


def erfc(x: str) -> str:
    """Complementary error function by the same expansions written for SQL (z is the bound argument)."""
    from convosieve.functions.scalar import ERF_SERIES

    poly = repr(ERF_SERIES[-1]) + "::DOUBLE"
    for coef in reversed(ERF_SERIES[:-1]):
        poly = f"({poly}) * (z * z) + {coef!r}::DOUBLE"
    frac = "z"
    for k in range(40, 0, -1):
        frac = f"(z + {k / 2.0}::DOUBLE / {frac})"
    return (
        f"list_transform([({x})::DOUBLE], lambda z: CASE WHEN z < 2.5 THEN 1.0 - z * ({poly}) "
        f"ELSE exp(-z * z) / ({frac} * sqrt(pi())) END)[1]"
    )


def two_sided_p(z: str) -> str:
    return erfc(f"abs({z}) / sqrt(2.0::DOUBLE)")
