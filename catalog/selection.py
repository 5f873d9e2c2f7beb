"""Top-k selection, samples, splits, folds, deduplication, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import sqlkit as S
from catalog.evaluation import rounded
from catalog.flagship import ARTIFACT, artifact_rows
from convosieve.functions import lexicons as lex
from convosieve.functions import text as T
from convosieve.functions.features import add_features
from convosieve.operators import models as O
from convosieve.operators import ranking as K
from convosieve.operators import sampling as P
from convosieve.operators.targets import keep_first
from convosieve.sources import tables as V


@query("top_k_candidates", f"""
WITH {S.UNSCORED}, o AS (SELECT p1, row_number() OVER (ORDER BY p1 DESC, doc_id) AS n FROM unscored)
SELECT k AS count, count(*) FILTER (n <= k) AS selected, {S.r('min(p1) FILTER (n <= k)')} AS threshold_floor FROM o, (SELECT unnest({lex.SELECTION_COUNTS}) AS k) GROUP BY k""")
def candidates(spark, folder):
    return rounded(P.select_counts(V.unlabelled_scores(spark, folder), "p1", lex.SELECTION_COUNTS), ["threshold_floor"])


@query("top_k_labels", f"""
WITH {S.UNSCORED} SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY p1 DESC, doc_id) <= 150 THEN 'TRUE' ELSE 'FALSE' END AS label FROM unscored""")
def top_labels(spark, folder):
    return P.labels_from_top_k(V.unlabelled_scores(spark, folder).select("doc_id", "p1"), "p1", 150).select("doc_id", "label")


@query("ordinal_ranks", f"""
WITH {S.UNSCORED} SELECT doc_id, {S.r('(row_number() OVER (ORDER BY p1, doc_id) - 1)::DOUBLE / (count(*) OVER () - 1)', 9)} AS rank01 FROM unscored""")
def rank01(spark, folder):
    return rounded(K.rank01(V.unlabelled_scores(spark, folder), "p1"), ["rank01"], 9).select("doc_id", "rank01")


@query("longest_and_shortest", """
(SELECT doc_id, length(text) AS chars, 'longest' AS kind FROM documents ORDER BY length(text) DESC, doc_id LIMIT 10)
UNION ALL (SELECT doc_id, length(text), 'shortest' FROM documents ORDER BY length(text), doc_id LIMIT 10)""")
def extremes(spark, folder):
    d = V.table(spark, folder, "documents").select("doc_id", F.length("text").cast("long").alias("chars"))
    hi = P.top_n(d, 10, F.desc("chars"), F.col("doc_id")).withColumn("kind", F.lit("longest"))
    return hi.unionByName(P.top_n(d, 10, F.asc("chars"), F.col("doc_id")).withColumn("kind", F.lit("shortest")))


@query("seeded_sample", f"WITH {S.LAB}, o AS (SELECT doc_id, label, {S.md5rank(42, 'label')} AS n FROM lab) SELECT doc_id, label FROM o WHERE n <= 100")
def sample(spark, folder):
    return P.seeded_sample(V.labels(spark, folder), "label", 100)


@query("stratified_split", f"""
WITH {S.LAB}, o AS (SELECT doc_id, label, {S.md5rank(42, 'label')} AS n, count(*) OVER (PARTITION BY label) AS c FROM lab)
SELECT doc_id, label, CASE WHEN n <= ceil(round(c * 0.2::DOUBLE, 6)) THEN 'val' ELSE 'train' END AS split FROM o""")
def split(spark, folder):
    return P.split(V.labels(spark, folder), "label")


@query("stratified_folds", f"""
WITH {S.LAB} """ + " UNION ALL ".join(f"SELECT doc_id, label, (({S.md5rank(s, 'label')} - 1) % 5)::INTEGER AS fold, {s} AS seed FROM lab" for s in (42, 43, 44)))
def folds(spark, folder):
    return P.multi_seed_folds(V.labels(spark, folder), "label", [42, 43, 44])


@query("stratification_keys", f"""
WITH {S.TRAIN}, {ARTIFACT}, c1 AS (SELECT *, label || '__' || bucket AS k0, count(*) OVER (PARTITION BY label, bucket) AS n FROM ab),
c2 AS (SELECT *, CASE WHEN n >= 12 THEN k0 ELSE label || '__other' END AS k1 FROM c1), c3 AS (SELECT *, count(*) OVER (PARTITION BY k1) AS m FROM c2)
SELECT doc_id, CASE WHEN m >= 12 THEN k1 ELSE label END AS stratum FROM c3""")
def strata(spark, folder):
    return P.stratify_key(artifact_rows(spark, folder), "label", "bucket", 12).select("doc_id", "stratum")


@query("stratification_keys_strict", f"""
WITH {S.TRAIN}, {ARTIFACT}, c AS (SELECT *, count(*) OVER (PARTITION BY label, bucket) AS n FROM ab), m AS (SELECT min(n) AS m FROM c)
SELECT doc_id, CASE WHEN m < 5 THEN label ELSE label || '_' || bucket END AS stratum FROM c, m""")
def strata_strict(spark, folder):
    return P.stratify_key_strict(artifact_rows(spark, folder), "label", "bucket", 5).select("doc_id", "stratum")


@query("balanced_oversample", f"""
WITH {S.LAB}, o AS (SELECT doc_id, label, {S.md5rank(42, 'label')} AS n, count(*) OVER (PARTITION BY label) AS c FROM lab),
need AS (SELECT (ceil(max(c)::DOUBLE / 8) * 8)::BIGINT AS need FROM o), x AS (SELECT doc_id, label, n, c, unnest(range(0, ((need - n) // c + 1)::BIGINT)) AS cp FROM o, need)
SELECT doc_id, label, cp::INTEGER AS copy, n + cp * c - 1 AS slot, (n + cp * c - 1) // 8 AS batch FROM x""")
def oversample(spark, folder):
    return P.oversample(V.labels(spark, folder), "label", batch=16)


@query("manual_review_picks", f"""
WITH {S.TRAIN}, {S.feature_ctes('weirdness', 'train', 'f', keep='doc_id, label', digits=9)},
a AS (SELECT doc_id, label, weirdness_proxy AS w, row_number() OVER (PARTITION BY label ORDER BY weirdness_proxy DESC, doc_id) AS hi,
  row_number() OVER (PARTITION BY label ORDER BY weirdness_proxy, doc_id) AS lo, {S.md5rank(42, 'label')} AS h FROM f)
SELECT doc_id, label, {S.r('w')} AS weirdness_proxy, 'TRUE_high_weirdness' AS selection_reason FROM a WHERE label = 'TRUE' AND hi <= 4
UNION ALL SELECT doc_id, label, {S.r('w')}, 'FALSE_low_weirdness' FROM a WHERE label = 'FALSE' AND lo <= 4
UNION ALL SELECT doc_id, label, {S.r('w')}, label || '_random_sample' FROM a WHERE h <= 2""")
def review(spark, folder):
    feats = add_features(V.train(spark, folder), "weirdness", "text", ["weirdness_proxy"]).drop("text")
    picks = P.review_picks(feats.withColumn("weirdness_proxy", F.round("weirdness_proxy", 9)).persist())
    return rounded(picks, ["weirdness_proxy"]).select("doc_id", "label", "weirdness_proxy", "selection_reason")


_style8 = ["char_length", "non_ascii_ratio", "code_symbol_count", "weird_token_ratio", "repeated_token_count", "spam_keyword_count", "prompt_template_flag", "decode_error_flag"]


@query("extreme_examples", f"""
WITH {S.TRAIN}, {S.feature_ctes('style', 'train', 'f', keep='doc_id, label', only=set(_style8))},
u AS (UNPIVOT f ON {', '.join(_style8)} INTO NAME feature VALUE v), o AS (SELECT *, row_number() OVER (PARTITION BY label, feature ORDER BY v DESC, doc_id) AS rank FROM u)
SELECT doc_id, label, feature, {S.r('v')} AS feature_value, rank FROM o WHERE rank <= 20""")
def extreme_examples(spark, folder):
    from convosieve.operators.stats import melt

    feats = add_features(V.train(spark, folder), "style", "text", _style8).drop("text")
    top = P.top_per_group(melt(feats, _style8, ["doc_id", "label"]), ["label", "feature"], [F.desc("value"), F.col("doc_id")], 20)
    return top.select("doc_id", "label", "feature", F.round("value", 6).alias("feature_value"), F.col("rank").cast("long").alias("rank"))


@query("first_per_text", """
SELECT md5(text) AS text_md5, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY text""")
def first_per_text(spark, folder):
    d = V.table(spark, folder, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    first = keep_first(d, ["text_md5"], "doc_id").withColumnRenamed("doc_id", "first_id")
    last = keep_first(d, ["text_md5"], "doc_id", last=True).withColumnRenamed("doc_id", "last_id")
    return first.join(last, "text_md5")


@query("text_occurrences", "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) - 1 AS occurrence FROM documents")
def occurrences(spark, folder):
    d = V.table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    return K.occurrence_number(d, ["k"]).select("doc_id", "occurrence")


@query("corpus_union", """
SELECT origin, count(*) AS row_count, sum(length(text))::BIGINT AS chars FROM (SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark
  UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY origin""")
def union(spark, folder):
    parts = [V.table(spark, folder, n).select(F.lit(n).alias("origin"), "text") for n in ("documents", "benchmark", "conversations")]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.length("text")).alias("chars"))


@query("distinct_texts", "SELECT count(DISTINCT text) AS texts, count(DISTINCT lang) AS langs FROM documents")
def distinct(spark, folder):
    d = V.table(spark, folder, "documents")
    texts = d.select(F.sha2("text", 256).alias("k")).distinct().agg(F.count(F.lit(1)).alias("texts"))
    return texts.withColumn("langs", F.lit(d.select("lang").distinct().count()).cast("long"))


@query("unlabelled_texts_unseen", """
SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels) AND d.text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id))""")
def unseen(spark, folder):
    """Anti-join by text: unlabelled documents whose text no labelled document has."""
    key = F.sha2(T.normalize_text("text"), 256).alias("k")
    known = V.train(spark, folder).select(key)
    return V.test(spark, folder).select("doc_id", key).join(known, "k", "left_anti").select("doc_id")


@query("flagged_ids", f"""
WITH {S.SCORED} SELECT doc_id FROM scored WHERE p1 >= 0.7 UNION SELECT doc_id FROM scored WHERE p2 <= 0.1 UNION SELECT doc_id FROM scored WHERE label = 'TRUE' AND p3 < 0.5""")
def flagged(spark, folder):
    s = V.labelled_scores(spark, folder)
    a, b = s.filter("p1 >= 0.7").select("doc_id"), s.filter("p2 <= 0.1").select("doc_id")
    return a.union(b).union(s.filter("label = 'TRUE' AND p3 < 0.5").select("doc_id")).distinct()



@query("fold_seed_averages", f"""
WITH {S.UNSCORED}, l AS ({' UNION ALL '.join(f'SELECT doc_id, p{k} AS prob FROM unscored' for k in range(1, 5))})
SELECT doc_id, {S.r('avg(prob)')} AS prob_mean, {S.r('stddev_pop(prob)')} AS prob_std, count(*) AS models FROM l GROUP BY doc_id""")
def fold_average(spark, folder):
    return rounded(O.fold_average(V.long_scores(V.unlabelled_scores(spark, folder))), ["prob_mean", "prob_std"])


