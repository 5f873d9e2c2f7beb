"""Normalisation, keys, labels, previews, scalar functions, n-grams, nested payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import sqlkit as S
from convosieve.functions import lexicons as lex
from convosieve.functions import scalar as N
from convosieve.functions import text as T
from convosieve.functions import tokens as K
from convosieve.operators import stats as G
from convosieve.sources import tables as V


@query("text_normalized", f"""
SELECT doc_id, md5({S.norm('text')}) AS text_md5, length({S.norm('text')})::BIGINT AS chars FROM documents""")
def normalized(spark, folder):
    t = T.normalize_text("text")
    return V.documents(spark, folder).select("doc_id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("chars"))


def _squash(x):
    return S.strip(f"regexp_replace({x}, {S.q(f'[{S.WS}]+')}, ' ', 'g')")


def _mask(url, email, num):
    x = f"regexp_replace(lower(t), {S.q(lex.URL_FULL)}, {S.q(url)}, 'gi')"
    x = f"regexp_replace({x}, {S.q(lex.EMAIL)}, {S.q(email)}, 'g')"
    return f"regexp_replace({x}, {S.q(lex.NUMBER)}, {S.q(num)}, 'g')"


_loose = _squash(f"regexp_replace({_mask(' <url> ', ' <email> ', ' <num> ')}, {S.q(f'[{S.PUNCT}]')}, '', 'g')")
_template = _squash(f"regexp_replace({_mask(' <URL> ', ' <EMAIL> ', ' <NUM> ')}, {S.q(lex.MARKUP_RUN)}, ' <MARKUP> ', 'g')")
_shape_other = f"regexp_replace(t, {S.q(rf'[^\pL{S.DIG}{S.WS}{S.PUNCT}]')}, chr(1), 'g')"
_shape = (
    f"{_squash(f'replace(regexp_replace(regexp_replace({_shape_other}, {S.q(chr(92) + "pL+")}, {S.q("A")}, {S.q("g")}), {S.q(f"[{S.DIG}]+")}, {S.q("0")}, {S.q("g")}), chr(1), {S.q("X")})')}"
)
KEY_SQL = {"exact_key": _squash("lower(t)"), "loose_key": _loose, "template_key": _template, "shape_key": _shape}


@query("text_match_keys", f"""
WITH n AS (SELECT doc_id, {S.norm('text')} AS t FROM documents)
SELECT doc_id, {', '.join(f'md5({e}) AS {k}' for k, e in KEY_SQL.items())} FROM n""")
def match_keys(spark, folder):
    docs = V.documents(spark, folder).select("doc_id", T.normalize_text("text").alias("t"))
    return docs.select("doc_id", *[F.md5(fn("t")).alias(k) for k, fn in T.KEYS.items()])


# Label spellings derived from the label table, so that every branch of the variants is met.
_SPELL = ["TRUE", " true", "T", "1", "yes", "Y", "False", "f ", "0", "NO", "n", "maybe", None]
_spark_spell = "CASE CAST(doc_id % 13 AS INT) " + " ".join(
    f"WHEN {i} THEN {'NULL' if s is None else S.q(s)}" for i, s in enumerate(_SPELL)) + " END"


def _lab(true, false, other):
    v = "upper(trim(raw))"
    return f"CASE WHEN {v} IN ({', '.join(map(S.q, true))}) THEN 'TRUE' WHEN {v} IN ({', '.join(map(S.q, false))}) THEN 'FALSE' ELSE {other} END"


_variants = {
    "strict": _lab(["TRUE", "T", "1"], ["FALSE", "F", "0"], "NULL"),
    "passthrough": _lab(["TRUE", "T", "1"], ["FALSE", "F", "0"], "upper(trim(raw))"),
    "yes_no": _lab(["TRUE", "1", "YES", "Y"], ["FALSE", "0", "NO", "N"], "NULL"),
    "words_only": _lab(["TRUE"], ["FALSE"], "NULL"),
}


@query("label_spellings", f"""
WITH s AS (SELECT doc_id, {_spark_spell} AS raw FROM documents),
v AS (SELECT doc_id, {', '.join(f'{e} AS {k}' for k, e in _variants.items())} FROM s)
SELECT *, CASE strict WHEN 'TRUE' THEN 1 WHEN 'FALSE' THEN 0 END AS encoded FROM v""")
def label_spellings(spark, folder):
    s = V.table(spark, folder, "documents").select("doc_id", F.expr(_spark_spell).alias("raw"))
    return s.select(
        "doc_id", T.normalize_label("raw").alias("strict"), T.normalize_label("raw", unknown="keep").alias("passthrough"),
        T.normalize_label_yes_no("raw").alias("yes_no"), T.normalize_label_words_only("raw").alias("words_only"),
    ).withColumn("encoded", T.encode_label("strict"))


_snip = _squash(f"replace({S.norm('text')}, chr(10), ' / ')")
_n = S.norm("text")


@query("text_previews", f"""
WITH n AS (SELECT doc_id, {_n} AS t, {_snip} AS s FROM documents),
p AS (SELECT *, replace(t, chr(10), '\\n') AS o FROM n)
SELECT doc_id, CASE WHEN length(o) <= 300 THEN o ELSE left(o, 297) || '...' END AS preview,
  CASE WHEN length(s) <= 220 THEN s ELSE rtrim(left(s, 217)) || '...' END AS snippet,
  CASE WHEN length(t) <= 400 THEN t ELSE left(t, 200) || chr(10) || '...[TRUNCATED]...' || chr(10) || right(t, 200) END AS head_tail
FROM p""")
def previews(spark, folder):
    docs = V.documents(spark, folder).select("doc_id", "text", T.normalize_text("text").alias("t"))
    return docs.select("doc_id", T.preview("t").alias("preview"), T.snippet("text").alias("snippet"), T.head_tail("t", 400).alias("head_tail"))


@query("score_scalars", f"""
WITH {S.UNSCORED}, x AS (SELECT doc_id, p1, p1 * 3 - 1 AS wild, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id END AS den FROM unscored),
c AS (SELECT *, greatest(least(p1, 1 - 1e-5), 1e-5) AS l, greatest(least(p1, 1 - 1e-6), 1e-6) AS e FROM x)
SELECT doc_id, {S.r('greatest(least(wild, 1.0), 0.0)')} AS safe_prob, {S.r('ln(l / (1 - l))')} AS logit,
  {S.r('-(e * ln(e) + (1 - e) * ln(1 - e))')} AS entropy, {S.r('CASE WHEN den = 0 THEN 0 ELSE p1 / den END')} AS ratio, {S.r(S.two_sided_p('wild * 3'))} AS p_value
FROM c""")
def scalars(spark, folder):
    df = V.unlabelled_scores(spark, folder)
    den = F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("doc_id"))
    wild = F.col("p1") * 3 - 1
    return df.select(
        "doc_id", N.r6(N.safe_prob(wild)).alias("safe_prob"), N.r6(N.safe_logit("p1")).alias("logit"), N.r6(N.probability_entropy("p1")).alias("entropy"),
        N.r6(N.safe_ratio("p1", den)).alias("ratio"), N.r6(N.two_sided_p(wild * 3)).alias("p_value"),
    )


@query("corpus_signature", """
SELECT count(*) AS row_count, count(DISTINCT md5(doc_id || ':' || text)) AS distinct_rows FROM documents""")
def signature(spark, folder):
    docs = V.table(spark, folder, "documents")
    keyed = docs.select(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text")).alias("k"))
    return keyed.groupBy("k").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("row_count"), F.count(F.lit(1)).alias("distinct_rows"))


_ROW_MD5 = f"md5(concat(CAST(doc_id AS VARCHAR), ':', {S.norm('text')}))"


@query(
    "corpus_fingerprint",
    f"SELECT count(*) AS row_count, CAST(sum(CAST(CAST(concat('0x', substr({_ROW_MD5}, 1, 15)) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM documents",
)
def fingerprint(spark, folder):
    """Order-insensitive signature: equal corpora give equal values on any partitioning, and a repeated row counts each time."""
    digest = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), T.normalize_text("text")))
    h = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)")
    return V.table(spark, folder, "documents").agg(F.count(F.lit(1)).alias("row_count"), F.sum(h).cast("string").alias("fingerprint"))


_tok = {"ascii": S.ASCII, "raw": f"[^{S.WS}]+", "unicode": S.UNI, "apostrophe": S.UNI_APOS, "tag": S.TAGW, "min2": rf"[{S.AN}_]{{2,}}"}
_tokens_sql = ", ".join(f"{S.cnt('t', p)} AS {k}_tokens, md5(array_to_string(regexp_extract_all(t, {S.q(p)}), ' ')) AS {k}_md5" for k, p in _tok.items())


@query("tokenizers", f"WITH n AS (SELECT doc_id, {S.norm('text')} AS t FROM documents) SELECT doc_id, {_tokens_sql} FROM n")
def tokenizers(spark, folder):
    pats = {"ascii": T.WORD_ASCII, "raw": T.RAW_TOKEN, "unicode": T.WORD_UNICODE, "apostrophe": T.WORD_UNICODE_APOS, "tag": T.WORD_TAG, "min2": T.WORD_MIN2}
    docs = V.documents(spark, folder).select("doc_id", T.normalize_text("text").alias("t"))
    arrays = docs.select("doc_id", *[K.tokens("t", p).alias(k) for k, p in pats.items()])
    cols = []
    for k in pats:
        cols += [F.size(k).cast("long").alias(f"{k}_tokens"), F.md5(F.array_join(k, " ")).alias(f"{k}_md5")]
    return arrays.select("doc_id", *cols)


_w2 = f"regexp_extract_all(lower(t), {S.q(rf'[{S.AN}_]{{2,}}')})"


@query("word_ngram_counts", f"""
WITH n AS (SELECT {S.norm('text')} AS t FROM documents), w AS (SELECT {_w2} AS w FROM n),
g AS (SELECT unnest(list_concat(w, {S.grams('w', 2)})) AS ngram FROM w)
SELECT ngram, count(*) AS row_count FROM g GROUP BY ngram""")
def word_ngrams(spark, folder):
    docs = V.documents(spark, folder).select(T.normalize_text("text").alias("t"))
    return K.explode_rows(docs, [], K.word_ngrams("t", 1, 2), "ngram").groupBy("ngram").agg(F.count(F.lit(1)).alias("row_count"))


def char_wb_sql(x: str, lo: int, hi: int) -> str:
    """List of padded-word character n-grams of text column x."""
    padded = f"list_transform(regexp_extract_all(lower({x}), {S.q(f'[^{S.WS}]+')}), lambda z: ' ' || z || ' ')"
    per = []
    for n in range(lo, hi + 1):
        guard = "TRUE" if n == lo else f"length(p) > {n - 1}"
        per.append(f"CASE WHEN {guard} THEN list_transform(range(1, greatest(length(p) - {n - 1}, 1) + 1), lambda i: substr(p, i, {n})) ELSE [] END")
    return f"flatten(list_transform({padded}, lambda p: list_concat({', '.join(per)})))"


@query("char_ngram_counts", f"""
WITH n AS (SELECT {S.norm('text')} AS t FROM documents), g AS (SELECT unnest({char_wb_sql('t', 3, 5)}) AS ngram FROM n)
SELECT ngram, count(*) AS row_count FROM g GROUP BY ngram""")
def char_ngrams(spark, folder):
    docs = V.documents(spark, folder).select(T.normalize_text("text").alias("t"))
    return K.explode_rows(docs, [], K.char_wb_ngrams("t", 3, 5), "ngram").groupBy("ngram").agg(F.count(F.lit(1)).alias("row_count"))


@query("corpus_token_counts", f"""
WITH n AS (SELECT {S.norm('text')} AS t FROM documents), x AS (SELECT unnest({S.words('t', S.ASCII)}) AS token FROM n)
SELECT token, count(*) AS count FROM x GROUP BY token""")
def corpus_tokens(spark, folder):
    docs = V.documents(spark, folder)
    return G.token_counts(docs, K.tokens(T.normalize_text("text"), T.WORD_ASCII, lower=True))


@query("conversation_flattened", """
SELECT conv_id, string_agg(CASE WHEN text <> '' THEN text END, chr(10) ORDER BY turn) AS flat, count(*) AS turn_count FROM conversations GROUP BY conv_id""")
def flattened(spark, folder):
    conv = V.conversation_documents(spark, folder)
    return conv.select("conv_id", T.join_turns("turns").alias("flat"), T.turn_count("text", "turns").cast("long").alias("turn_count"))


@query("nested_payload_text", """
WITH t AS (SELECT conv_id, turn, text FROM conversations)
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS flat FROM t WHERE text <> '' GROUP BY conv_id""")
def nested_payload(spark, folder):
    """Conversations serialised as nested JSON objects and flattened back to text."""
    conv = V.conversation_documents(spark, folder)
    body = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.struct(t["text"].alias("text")).alias("content")))
    return conv.select("conv_id", T.flatten_json_text(F.to_json(body), depth=3).alias("flat"))


@query("event_property_types", """
SELECT 'OBJECT' AS value_type, count(*) AS row_count FROM events WHERE json_valid(props) AND json_type(props) = 'OBJECT'""")
def property_types(spark, folder):
    from convosieve.operators.checks import value_types

    return value_types(V.table(spark, folder, "events"), "props")
