"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import sqlkit as S
from convosieve.operators import checks as C
from convosieve.operators.labeling import apply_threshold
from convosieve.sources import sinks
from convosieve.sources import tables as V


@query("check_row_parity", """
SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows,
  (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AS equal""")
def parity(spark, folder):
    return C.row_count_parity(V.table(spark, folder, "documents"), V.table(spark, folder, "labels"))


_wild = "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE p1 * 1.5::DOUBLE - 0.2::DOUBLE END"


@query("check_probability_range", f"""
WITH {S.UNSCORED}, x AS (SELECT {_wild} AS p FROM unscored)
SELECT count(*) AS row_count, count(*) FILTER (p IS NULL) AS missing_rows, count(*) FILTER (p < 0 OR p > 1) AS out_of_range_rows FROM x""")
def prob_range(spark, folder):
    x = V.unlabelled_scores(spark, folder).select(F.when(F.col("doc_id") % 11 != 0, F.col("p1") * 1.5 - 0.2).alias("p"))
    return C.prob_range_check(x, "p")


@query("check_text_alignment", """
WITH b AS (SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN text || ' x' ELSE text END AS text FROM documents),
j AS (SELECT a.doc_id, a.text = b.text AS same FROM documents a JOIN b USING (doc_id))
SELECT count(*) AS row_count, count(*) FILTER (same) AS matched, min(doc_id) FILTER (NOT same) AS first_mismatch,
  round(count(*) FILTER (same)::DOUBLE / count(*), 6) AS match_rate, count(*) FILTER (same)::DOUBLE / count(*) >= 0.995 AS aligned FROM j""")
def alignment(spark, folder):
    a = V.documents(spark, folder).select("doc_id", "text")
    b = a.withColumn("text", F.when(F.col("doc_id") % 97 == 5, F.concat("text", F.lit(" x"))).otherwise(F.col("text")))
    return C.text_alignment(a, b).withColumn("match_rate", F.round("match_rate", 6))


@query("check_label_domain", f"""
WITH {S.LAB} SELECT count(*) AS row_count, count(*) FILTER (label = 'TRUE') AS true_rows, count(*) FILTER (label = 'FALSE') AS false_rows, 0::BIGINT AS invalid_rows FROM lab""")
def label_domain(spark, folder):
    return C.label_domain_check(V.labels(spark, folder))


_cols = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


@query("profile_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) FILTER ({c} IS NULL) AS null_count FROM documents" for c, t in _cols.items()))
def columns(spark, folder):
    return C.profile_columns(V.table(spark, folder, "documents"))


@query("profile_duplicates", """
SELECT 'duplicate_rows' AS metric, count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM conversations)) AS duplicates FROM conversations
UNION ALL SELECT 'duplicate_ids:conv_id', count(*), count(*) - count(DISTINCT conv_id) FROM conversations""")
def duplicates(spark, folder):
    return C.duplicate_profile(V.table(spark, folder, "conversations"))


_TEXT_COLUMNS = {"documents": ("text", "text"), "conversations": ("text", "text"), "benchmark": ("text", "text"), "pages": ("url", ""), "events": ("event_type", "")}


@query("text_column_inference", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS text_column, '{like}' AS text_like, count(*) AS row_count, count(*) FILTER ({c} <> '') AS filled_rows FROM {t}"
    for t, (c, like) in _TEXT_COLUMNS.items()))
def text_columns(spark, folder):
    parts = []
    for name in _TEXT_COLUMNS:
        df = V.table(spark, folder, name)
        c = C.infer_text_column(df)
        counts = df.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col(c) != "").alias("filled_rows"))
        parts.append(counts.select(F.lit(name).alias("table_name"), F.lit(c).alias("text_column"), F.lit(",".join(C.text_like_columns(df))).alias("text_like"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("label_distribution", f"""
WITH {S.LAB} SELECT label, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS percentage FROM lab GROUP BY label""")
def distribution(spark, folder):
    return C.label_distribution(V.labels(spark, folder))


@query("coverage_report", f"""
WITH {S.LAB}, {S.TEST}
SELECT (SELECT count(*) FROM lab) AS train_rows, (SELECT count(*) FROM test) AS test_rows, (SELECT count(*) FROM test) AS template_rows,
  TRUE AS train_has_label, FALSE AS test_has_label, TRUE AS template_matches_test, 'doc_id,label' AS template_columns""")
def coverage(spark, folder):
    test = V.unlabelled_scores(spark, folder).select("doc_id")
    template = test.withColumn("label", F.lit(None).cast("string"))
    return C.coverage_report(V.labels(spark, folder), test, template)


_pred = {k: f"CASE WHEN p{k} >= 0.5 THEN 'TRUE' ELSE 'FALSE' END" for k in (1, 2)}


@query("label_diff_summary", f"""
WITH {S.UNSCORED}, x AS (SELECT doc_id, {_pred[1]} AS a, {_pred[2]} AS b FROM unscored)
SELECT count(*) AS row_count, count(*) FILTER (a <> b) AS differing_rows, count(*) FILTER (a <> b) = 0 AS exact_match,
  count(*) FILTER (a = 'TRUE') AS "original_TRUE", count(*) FILTER (a = 'FALSE') AS "original_FALSE",
  count(*) FILTER (b = 'TRUE') AS "regenerated_TRUE", count(*) FILTER (b = 'FALSE') AS "regenerated_FALSE" FROM x""")
def diff_summary(spark, folder):
    return _diff(spark, folder)["summary"]


@query("label_diff_first", f"""
WITH {S.UNSCORED}, x AS (SELECT doc_id, {_pred[1]} AS original_label, {_pred[2]} AS regenerated_label FROM unscored)
SELECT * FROM x WHERE original_label <> regenerated_label ORDER BY doc_id LIMIT 20""")
def diff_first(spark, folder):
    return _diff(spark, folder)["first"]


def _diff(spark, folder):
    df = V.unlabelled_scores(spark, folder)
    one = df.select("doc_id", apply_threshold("p1", 0.5).alias("label"))
    two = df.select("doc_id", apply_threshold("p2", 0.5).alias("label"))
    return C.label_diff(one, two)


@query("submission_table", f"WITH {S.UNSCORED} SELECT doc_id, {_pred[1]} AS label FROM unscored")
def submission(spark, folder):
    df = V.unlabelled_scores(spark, folder)
    template = df.select("doc_id", F.lit(None).cast("string").alias("label"))
    return sinks.make_submission(template, df.select("doc_id", apply_threshold("p1", 0.5).alias("label")))
