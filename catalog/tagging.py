"""Heuristic tags, tag reports, validation of stored tag strings, tag joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import sqlkit as S
from catalog.evaluation import ERR, predicted, rounded
from convosieve.functions import lexicons as lex
from convosieve.operators import labeling as L
from convosieve.operators import sampling as P
from convosieve.operators import stats as G
from convosieve.operators import tags as X
from convosieve.sources import tables as V


def _any(k):
    return "(" + " OR ".join(f"contains(low, {S.q(t)})" for t in lex.TAG_KEYWORDS[k]) + ")"


# The same overrides written as successive steps, the way they are defined.
_steps = [
    ("noise", ("noise_or_corrupt", "none", "low", None, "noisy or corrupted wording")),
    ("code", ("code_or_structured", "instruct", "low", None, "structured or prompt-like text")),
    (_any("tool_or_workflow"), None),
    (_any("coordination"), ("coordination", "coordinate", "low", None, "coordination language present")),
    (_any("covert_instruction"), ("covert_instruction", "hide_or_obfuscate", "med", "TRUE", "hidden signaling language")),
    (_any("deception"), ("deception", "hide_or_obfuscate", "med", "TRUE", "deception cue present")),
    (_any("manipulation"), ("manipulation", "manipulate", "med", "hidden OR contains(low, 'quiet') OR contains(low, 'secret')", "manipulation cue present")),
    (_any("policy_evasion"), ("policy_evasion", "evade", "high", "TRUE", "evasion cue present")),
    (_any("extract_or_leak"), ("policy_evasion", "extract_or_leak", "high", "TRUE", "sensitive data cue")),
    ("word_count < 5", ("generic_filler", "none", "none", "FALSE", "too little content")),
    ("link AND family = 'clean_benign'", ("tool_or_workflow", "benign_info", "low", None, "contains link or contact")),
    ("blank", ("unclear", "unclear", "none", "FALSE", "empty text")),
]


def _tag_ctes(src, out):
    ctes = [
        S.feature_ctes("tag_stats", src, out + "_s", keep="doc_id, label, text"),
        f"""{out}_0 AS (SELECT doc_id, label, word_count, lower(text) AS low, non_ascii_ratio > 0.03 OR (unique_ratio < 0.38 AND word_count >= 20) OR repeated_token_count >= 2 OR long_token_count >= 2 OR repeated_char_count >= 1
 OR punct_ratio > 0.18 AS noise, {S.has('text', '(?im)' + lex.TAG_CODE_OR_STRUCTURED)} AS code, {S.has('text', lex.TAG_URL_OR_EMAIL)} AS link, {S.strip('text')} = '' AS blank,
 'clean_benign' AS family, 'benign_info' AS intent, 'none' AS risk, FALSE AS hidden, 'ordinary informational text' AS why FROM {out}_s)""",
    ]
    for i, (cond, values) in enumerate(_steps):
        if values is None:
            new = {
                "family": "CASE WHEN family = 'clean_benign' THEN 'tool_or_workflow' ELSE family END", "intent": "CASE WHEN intent = 'benign_info' THEN 'benign_plan' ELSE intent END",
                "risk": "risk", "hidden": "hidden", "why": "'workflow or tool language'",
            }
        else:
            f, n, rk, h, w = values
            new = {"family": f"'{f}'", "intent": f"'{n}'", "risk": f"'{rk}'", "hidden": h or "hidden", "why": f"'{w}'"}
        cols = ", ".join(f"CASE WHEN {cond} THEN {e} ELSE {c} END AS {c}" for c, e in new.items())
        ctes.append(f"{out}_{i + 1} AS MATERIALIZED (SELECT doc_id, label, word_count, low, noise, code, link, blank, {cols} FROM {out}_{i})")
    ctes.append(f"{out} AS (SELECT doc_id, label, family, intent, risk, hidden, why FROM {out}_{len(_steps)})")
    return ", ".join(ctes)


TAGGED = f"{S.TRAIN}, src AS (SELECT doc_id, text, label FROM train), {_tag_ctes('src', 'tg')}"


def _tagged(spark, folder):
    return X.heuristic_tags(V.train(spark, folder), keep=["doc_id", "label"])


@query("heuristic_tags", f"WITH src AS (SELECT doc_id, text, '' AS label FROM documents), {_tag_ctes('src', 'tg')} SELECT doc_id, family, intent, risk, hidden, why FROM tg")
def heuristic(spark, folder):
    return X.heuristic_tags(V.documents(spark, folder).select("doc_id", "text"), keep=["doc_id"])


@query("tag_counts", f"WITH {TAGGED} SELECT family, intent, risk, hidden, count(*) AS row_count FROM tg GROUP BY ALL")
def counts(spark, folder):
    return G.value_counts(_tagged(spark, folder), "family", "intent", "risk", "hidden")


@query("tag_family_by_label", f"""WITH {TAGGED} SELECT family, count(*) FILTER (label = 'TRUE') AS "TRUE", count(*) FILTER (label = 'FALSE') AS "FALSE" FROM tg GROUP BY family""")
def crosstab(spark, folder):
    return G.crosstab(_tagged(spark, folder), "family", "label", ["TRUE", "FALSE"])


@query("tag_enrichment", f"""
WITH {TAGGED}, c AS (SELECT family, count(*) FILTER (label = 'TRUE') AS label_count, count(*) FILTER (label <> 'TRUE') AS other_count FROM tg GROUP BY family),
s AS (SELECT *, label_count::DOUBLE / greatest(sum(label_count) OVER (), 1) AS ls, other_count::DOUBLE / greatest(sum(other_count) OVER (), 1) AS os FROM c)
SELECT family, label_count, other_count, {S.r('ls')} AS label_share, {S.r('os')} AS other_share, {S.r('ls / greatest(os, 1e-9)')} AS enrichment FROM s""")
def enrichment(spark, folder):
    return rounded(G.enrichment(_tagged(spark, folder), "family", "label", "TRUE"), ["label_share", "other_share", "enrichment"])


@query("tag_examples", f"WITH {TAGGED} SELECT doc_id, family FROM tg QUALIFY row_number() OVER (PARTITION BY family ORDER BY doc_id) <= 5")
def examples(spark, folder):
    return P.top_per_group(_tagged(spark, folder), ["family"], [F.col("doc_id")], 5).select("doc_id", "family")


# --- stored tag strings: every document gets a raw generated string ------------------

_fam = "CASE doc_id % 5 WHEN 0 THEN 'coordination' WHEN 1 THEN 'deception' WHEN 2 THEN 'made_up' WHEN 3 THEN 'clean_benign' ELSE 'manipulation' END"
_raw = f"""'```json' || chr(10) || 'note {{"family": "' || {_fam} || '", "intent": " evade ", "risk": "' || CASE WHEN doc_id % 4 = 0 THEN 'HIGH' ELSE 'unknown' END || '", "hidden": ' || CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE '"no"' END
 || ', "why": "' || regexp_replace(text, '[^a-z ]', '') || '"' || CASE WHEN doc_id % 13 = 7 THEN '' ELSE '}}' END || chr(10) || '```'"""
_raw_sql = _raw.replace("'[^a-z ]', ''", "'[^a-z ]', '', 'g'").replace("{{", "{").replace("}}", "}")
_raw_spark = _raw.replace("{{", "{").replace("}}", "}")
_wsplit = "list_filter(string_split_regex(trim(w0), ' +'), lambda z: z <> '')"


@query("validated_tag_strings", f"""
WITH b AS (SELECT doc_id, doc_id % 13 <> 7 AS valid, {_fam} AS f, regexp_replace(text, '[^a-z ]', '', 'g') AS w0 FROM documents), w AS (SELECT *, {_wsplit} AS ws FROM b)
SELECT doc_id, valid, CASE WHEN valid AND f <> 'made_up' THEN f ELSE 'unclear' END AS family, CASE WHEN valid THEN 'evade' ELSE 'unclear' END AS intent, CASE WHEN valid AND doc_id % 4 = 0 THEN 'high' ELSE 'none' END AS risk,
 valid AND doc_id % 3 = 0 AS hidden, CASE WHEN NOT valid OR len(ws) = 0 THEN 'unclear' WHEN len(ws) > 8 THEN array_to_string(ws[1:8], ' ') ELSE trim(w0) END AS why FROM w""")
def validated(spark, folder):
    rows = V.documents(spark, folder).select("doc_id", F.expr(_raw_spark).alias("raw"))
    return X.normalize_tags(rows, "raw", ["doc_id"])


_coh = "CASE doc_id % 4 WHEN 0 THEN 'normal' WHEN 1 THEN ' Broken' WHEN 2 THEN 'odd' ELSE 'awkward' END"
_teach = f"""'{{"idx": ' || doc_id || ', "coherence": "' || {_coh} || '", "semantic_drift": "high", "task_clarity": "clear", "corruption": "' || lang || '", "ordinary_purpose": ' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END
 || ', "suspicious_intent": "none", "family": "list_poem"' || CASE WHEN doc_id % 6 = 1 THEN '' ELSE ', "why": "a b c d e f g h i j"' END || '}}'"""
_teach_one = _teach.replace("{{", "{").replace("}}", "}")


@query("validated_teacher_tags", """
WITH b AS (SELECT doc_id, doc_id % 6 <> 1 AS valid FROM documents)
SELECT doc_id, valid, CASE WHEN valid THEN CASE doc_id % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'broken' ELSE 'awkward' END END AS coherence, CASE WHEN valid THEN 'high' END AS semantic_drift, CASE WHEN valid THEN 'clear' END AS task_clarity,
 CASE WHEN valid THEN 'some' END AS corruption, CASE WHEN valid THEN 'none' END AS suspicious_intent, CASE WHEN valid THEN 'list_poem' END AS family, CASE WHEN valid THEN doc_id % 2 = 0 END AS ordinary_purpose,
 CASE WHEN valid THEN 'a b c d e f g h' END AS why FROM b""")
def teacher_tags(spark, folder):
    return X.validate_teacher_tags(_teacher_raw(spark, folder), "raw", ["doc_id"])


def _teacher_raw(spark, folder):
    return V.documents(spark, folder).select("doc_id", F.expr(_teach_one).alias("raw"))


@query("tag_task_coverage", """
WITH b AS (SELECT doc_id % 6 <> 1 AS valid FROM documents), t AS (SELECT unnest(['coherence', 'semantic_drift', 'task_clarity', 'corruption', 'suspicious_intent', 'family', 'ordinary_purpose']) AS task)
SELECT task, count(*) FILTER (valid) AS tagged_rows, count(*) AS total_rows FROM b, t GROUP BY task""")
def coverage(spark, folder):
    tags = X.validate_teacher_tags(_teacher_raw(spark, folder), "raw", ["doc_id"]).filter("valid").withColumn("tagged_at", F.lit(1))
    rows = V.documents(spark, folder).select("doc_id")
    tasks = [*lex.TEACHER_TAG_DOMAINS, "ordinary_purpose"]
    return X.tag_coverage(X.attach_tags(rows, tags), tasks)


@query("document_context", f"""
WITH {ERR}, sx AS (SELECT d.text, min_by({S.r('p.prob')}, d.doc_id) AS bp, min_by(p.pred_label, d.doc_id) AS bl FROM pred p JOIN documents d USING (doc_id) GROUP BY d.text),
ex AS (SELECT d.text, min_by(e.error_type, d.doc_id) AS et FROM err e JOIN documents d USING (doc_id) GROUP BY d.text)
SELECT doc_id, bp AS base_prob, coalesce(bl, 'NA') AS base_pred_label, coalesce(et, 'NA') AS base_error_type FROM documents LEFT JOIN sx USING (text) LEFT JOIN ex USING (text)""")
def context(spark, folder):
    docs = V.documents(spark, folder).select("doc_id", "text")
    scored = docs.join(predicted(spark, folder), "doc_id").persist()
    out = X.attach_context(docs, scored, L.errors(scored))
    return out.select("doc_id", F.round(F.col("base_prob_TRUE").try_cast("double"), 6).alias("base_prob"), "base_pred_label", "base_error_type")


@query("hard_rows_by_text", f"""
WITH {ERR} SELECT d.doc_id FROM documents d WHERE d.text IN (SELECT text FROM err JOIN documents USING (doc_id))""")
def hard_rows(spark, folder):
    """Semi-join by text: every document whose text occurs among the wrong predictions."""
    docs = V.documents(spark, folder).select("doc_id", F.sha2("text", 256).alias("k"))
    wrong = docs.join(L.errors(predicted(spark, folder)).select("doc_id"), "doc_id", "left_semi")
    return docs.join(wrong.select("k"), "k", "left_semi").select("doc_id")
