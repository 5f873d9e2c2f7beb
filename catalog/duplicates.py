"""Duplicates, cross-corpus matches, nearest neighbours, leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import sqlkit as S
from catalog.evaluation import rounded
from catalog.texts import KEY_SQL, char_wb_sql
from convosieve.functions import lexicons as lex
from convosieve.operators import similarity as D
from convosieve.sources import tables as V

_PREV = "CASE WHEN length(replace({0}, chr(10), '\\n')) <= 300 THEN replace({0}, chr(10), '\\n') ELSE left(replace({0}, chr(10), '\\n'), 297) || '...' END"


def _keyed(src, extra=""):
    return f"(SELECT doc_id, {extra} t, {', '.join(f'{e} AS {k}' for k, e in KEY_SQL.items())} FROM (SELECT *, {S.norm('text')} AS t FROM {src}))"


def _train(spark, folder):
    return D.add_keys(V.train(spark, folder)).drop("text")


def _test(spark, folder):
    return D.add_keys(V.test(spark, folder)).drop("text")


@query("duplicate_groups", f"""
WITH {S.TRAIN}, k AS {_keyed('train', 'label,')}, g AS (SELECT sha256(exact_key) AS key_digest, count(*) AS row_count, {_PREV.format('min_by(t, doc_id)')} AS example_text,
  count(*) FILTER (label = 'TRUE') AS "TRUE_count", count(*) FILTER (label = 'FALSE') AS "FALSE_count" FROM k GROUP BY exact_key HAVING count(*) > 1)
SELECT key_digest, row_count, example_text, "TRUE_count", "FALSE_count",
  {S.r('"TRUE_count"::DOUBLE / row_count')} AS "TRUE_rate", "TRUE_count" > 0 AND "FALSE_count" > 0 AS has_label_conflict FROM g""")
def groups(spark, folder):
    return rounded(D.duplicate_groups(_train(spark, folder), "exact_key", label="label"), ["TRUE_rate"])


@query("duplicate_groups_all_documents", f"""
WITH k AS {_keyed('documents')} SELECT sha256(exact_key) AS key_digest, count(*) AS row_count, {_PREV.format('min_by(t, doc_id)')} AS example_text
  FROM k GROUP BY exact_key HAVING count(*) > 1""")
def all_groups(spark, folder):
    return D.duplicate_groups(D.add_keys(V.documents(spark, folder).select("doc_id", "text")), "exact_key")


@query("duplicate_group_members", f"""
WITH {S.TRAIN}, k AS {_keyed('train', 'label,')} SELECT sha256(exact_key) AS key_digest, doc_id AS id, label FROM k QUALIFY count(*) OVER (PARTITION BY exact_key) > 1""")
def group_members(spark, folder):
    return D.group_members(_train(spark, folder), "exact_key", label="label")


@query("duplicate_group_members_all_documents", f"""
WITH k AS {_keyed('documents')} SELECT sha256(exact_key) AS key_digest, doc_id AS id FROM k QUALIFY count(*) OVER (PARTITION BY exact_key) > 1""")
def all_group_members(spark, folder):
    return D.group_members(D.add_keys(V.documents(spark, folder).select("doc_id", "text")), "exact_key")


def _cross_members_sql(key, min_train):
    return f"""
WITH {S.TRAIN}, {S.TEST}, a AS {_keyed('train', 'label,')}, b AS {_keyed('test')},
m AS (SELECT {key} AS k, 'train' AS side, doc_id AS id, label FROM a UNION ALL SELECT {key}, 'test', doc_id, NULL FROM b)
SELECT sha256(k) AS key_digest, side, id, label FROM m
QUALIFY count(*) FILTER (side = 'train') OVER (PARTITION BY k) >= {min_train} AND count(*) FILTER (side = 'test') OVER (PARTITION BY k) > 0"""


def _cross_sql(key, min_train):
    return f"""
WITH {S.TRAIN}, {S.TEST}, a AS {_keyed('train', 'label,')}, b AS {_keyed('test')},
ag AS (SELECT {key} AS k, count(*) AS train_match_count, count(*) FILTER (label = 'TRUE') AS nt, count(*) FILTER (label = 'FALSE') AS nf, {_PREV.format('min_by(t, doc_id)')} AS train_example_text FROM a GROUP BY 1 HAVING count(*) >= {min_train}),
bg AS (SELECT {key} AS k, count(*) AS test_match_count, {_PREV.format('min_by(t, doc_id)')} AS test_example_text FROM b GROUP BY 1)
SELECT sha256(k) AS key_digest, test_match_count, test_example_text, train_match_count, nt AS "train_TRUE_count", nf AS "train_FALSE_count", train_example_text,
  {S.r('nt::DOUBLE / train_match_count')} AS "train_TRUE_rate", {S.r('nf::DOUBLE / train_match_count')} AS "train_FALSE_rate", train_match_count * test_match_count AS cross_pair_count FROM ag JOIN bg USING (k)"""


def _register_cross(key, min_train):
    @query(f"cross_matches_{key}", _cross_sql(key, min_train))
    def run(spark, folder):
        out = D.cross_matches(_train(spark, folder), _test(spark, folder), key, min_train=min_train)
        return rounded(out, ["train_TRUE_rate", "train_FALSE_rate"])

    @query(f"cross_match_members_{key}", _cross_members_sql(key, min_train))
    def members(spark, folder):
        return D.cross_members(_train(spark, folder), _test(spark, folder), key, min_train=min_train)


for _key, _min in (("exact_key", 1), ("loose_key", 1), ("template_key", 1), ("shape_key", 2)):
    _register_cross(_key, _min)


# --- nearest neighbours: documents against benchmark passages ----------------------

_w2 = rf"[{S.AN}_]{{2,}}"


def _fold(x):
    # Accents of the fixture alphabets, folded by name; strip_accents covers the same letters.
    return f"strip_accents(lower({x}))"


WORD_GRAMS = f"list_concat(w, {S.grams('w', 2)})"


def _knn_sql(k, grams_cte):
    return f"""
{S.LAB}, src AS (SELECT doc_id AS id, TRUE AS tr, {_fold(S.norm('text'))} AS t FROM documents UNION ALL SELECT item_id, FALSE, {_fold(S.norm('text'))} FROM benchmark),
{grams_cte}
tf AS (SELECT id, tr, g, count(*) AS tf FROM gr GROUP BY ALL), dn AS (SELECT count(*) AS n FROM src),
vo AS (SELECT g, count(*) AS df, sum(tf) AS total FROM tf GROUP BY g HAVING count(*) >= 2),
wt AS (SELECT id, tr, g, (1 + ln(tf)) * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN vo USING (g), dn),
nm AS (SELECT id, tr, g, w / sqrt(sum(w * w) OVER (PARTITION BY id, tr)) AS w FROM wt),
dp AS (SELECT b.id AS test_id, a.id AS train_id, sum(a.w * b.w) AS s FROM nm a JOIN nm b ON a.g = b.g AND a.tr AND NOT b.tr GROUP BY ALL),
al AS (SELECT b.id AS test_id, a.id AS train_id, round(coalesce(s, 0), 6) AS similarity FROM (SELECT id FROM src WHERE tr) a CROSS JOIN (SELECT id FROM src WHERE NOT tr) b LEFT JOIN dp ON dp.test_id = b.id AND dp.train_id = a.id),
nn AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY similarity DESC, train_id) AS neighbor_rank FROM al QUALIFY neighbor_rank <= {k})"""


_WORD_CTE = f"wd AS (SELECT id, tr, regexp_extract_all(t, {S.q(_w2)}) AS w FROM src), gr AS (SELECT id, tr, unnest({WORD_GRAMS}) AS g FROM wd),"


def _corpora(spark, folder):
    bench = V.table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    docs = V.documents(spark, folder).select("doc_id", "text").join(V.labels(spark, folder), "doc_id", "left")
    return D.add_keys(docs).drop("text"), D.add_keys(bench).drop("text")


def _word_neighbors(spark, folder, k=5):
    a, b = _corpora(spark, folder)
    return D.tfidf_neighbors(a, b, "word_tfidf_1_2", k)


@query("word_tfidf_neighbors", f"WITH {_knn_sql(5, _WORD_CTE)} SELECT test_id, train_id, similarity, neighbor_rank::INTEGER AS neighbor_rank FROM nn")
def word_neighbors(spark, folder):
    return _word_neighbors(spark, folder).select("test_id", "train_id", "similarity", "neighbor_rank")


_BEST = f"{_knn_sql(1, _WORD_CTE)}, best AS (SELECT nn.*, label AS train_label FROM nn LEFT JOIN lab ON lab.doc_id = train_id)"


def _best(spark, folder, method="word_tfidf_1_2"):
    a, b = _corpora(spark, folder)
    nn = D.tfidf_neighbors(a, b, method, 1)
    return nn.join(V.labels(spark, folder).select(F.col("doc_id").alias("train_id"), F.col("label").alias("train_label")), "train_id", "left")


@query("similarity_thresholds", f"""
WITH {_BEST}, c AS (SELECT unnest({lex.SIMILARITY_CUTOFFS})::DOUBLE AS t)
SELECT t AS threshold, count(*) FILTER (similarity >= t) AS test_rows, {S.r('count(*) FILTER (similarity >= t)::DOUBLE / count(*)')} AS test_pct,
  count(*) FILTER (similarity >= t AND train_label = 'TRUE') AS "nearest_TRUE_count", count(*) FILTER (similarity >= t AND train_label = 'FALSE') AS "nearest_FALSE_count",
  {S.r("count(*) FILTER (similarity >= t AND train_label = 'TRUE')::DOUBLE / nullif(count(*) FILTER (similarity >= t), 0)")} AS "nearest_TRUE_rate" FROM best, c GROUP BY t""")
def thresholds(spark, folder):
    return rounded(D.threshold_summary(_best(spark, folder)), ["test_pct", "nearest_TRUE_rate"])


_quant = " UNION ALL ".join(f"SELECT {p}::DOUBLE AS quantile, {S.r(f'quantile_cont(similarity, {p})')} AS similarity FROM best" for p in lex.SIMILARITY_QUANTILES)


@query("similarity_quantiles", f"WITH {_BEST} {_quant}")
def quantiles(spark, folder):
    return rounded(D.similarity_quantiles(_best(spark, folder)), ["similarity"])


_CHAR_CTE = f"gr AS (SELECT id, tr, unnest({char_wb_sql('t', 3, 5)}) AS g FROM src),"


@query("char_tfidf_neighbors", f"""
WITH {_knn_sql(5, _CHAR_CTE)}, nb AS (SELECT doc_id AS train_id, label AS train_label, length({S.norm('text')}) AS train_char_length, {S.cnt(S.norm('text'), S.ASCII)} AS train_word_count FROM documents LEFT JOIN lab USING (doc_id)),
nt AS (SELECT item_id AS test_id, length({S.norm('text')}) AS test_char_length, {S.cnt(S.norm('text'), S.ASCII)} AS test_word_count FROM benchmark)
SELECT nn.test_id, nn.train_id, similarity, neighbor_rank::INTEGER AS neighbor_rank, train_label, train_char_length, test_char_length, train_word_count, test_word_count
FROM nn JOIN nb ON nb.train_id = nn.train_id JOIN nt ON nt.test_id = nn.test_id""")
def char_neighbors(spark, folder):
    a, b = _corpora(spark, folder)
    out = D.tfidf_neighbors(a, b, "char_tfidf_3_5", 5)
    return D.describe_neighbors(out, a, b).select(
        "test_id", "train_id", "similarity", "neighbor_rank", "train_label",
        *[F.col(c).cast("long").alias(c) for c in ("train_char_length", "test_char_length", "train_word_count", "test_word_count")])


def _nearest_sql(grams_cte):
    return f"(WITH {_knn_sql(1, grams_cte)} SELECT test_id, train_id, similarity, label FROM nn LEFT JOIN lab ON lab.doc_id = train_id)"


def _leakage_sql(char_min, word_min):
    return f"""
WITH c AS {_nearest_sql(_CHAR_CTE)}, w AS {_nearest_sql(_WORD_CTE)}, dk AS {_keyed('documents')}, bk AS {_keyed('(SELECT item_id AS doc_id, text FROM benchmark)')},
f AS (SELECT doc_id AS test_id, {', '.join(f'{k} IN (SELECT {k} FROM dk) AS has_{k[:-4]}_match' for k in ('exact_key', 'loose_key', 'template_key'))} FROM bk)
SELECT test_id, c.similarity AS char_similarity, c.train_id AS char_nearest_id, c.label AS char_nearest_label, w.similarity AS word_similarity, w.train_id AS word_nearest_id,
  w.label AS word_nearest_label, has_exact_match, has_loose_match, has_template_match, CASE WHEN c.similarity >= w.similarity THEN c.label ELSE w.label END AS nearest_train_label
FROM c JOIN w USING (test_id) JOIN f USING (test_id) WHERE has_exact_match OR has_loose_match OR has_template_match OR c.similarity >= {char_min} OR w.similarity >= {word_min}"""


def _leakage(spark, folder, **at_least):
    from convosieve.plans.leakage import inspect

    a, b = _corpora(spark, folder)
    return inspect(a, b, **at_least)["leakage_cases"]


@query("leakage_cases", _leakage_sql(0.85, 0.80))
def leakage(spark, folder):
    return _leakage(spark, folder)


# Passages are short beside documents, so lower bars find those that documents hold in part.
@query("leakage_cases_in_part", _leakage_sql(0.24, 0.05))
def leakage_in_part(spark, folder):
    return _leakage(spark, folder, char_min=0.24, word_min=0.05)


# --- embeddings --------------------------------------------------------------------

# Fixed value: hex digits of the id hash that mark the query side of the vector split.
_SIDE = "substr(md5('42:' || vec_id), 1, 1) IN ('0', '1', '2', '3', '4')"
_UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"


def _vectors(spark, folder):
    v = V.table(spark, folder, "embeddings")
    is_query = F.substring(F.md5(F.concat(F.lit("42:"), F.col("vec_id").cast("string"))), 1, 1).isin("0", "1", "2", "3", "4")
    return v.filter(~is_query), v.filter(is_query)


_EMB = f"""e AS (SELECT vec_id, label, {_SIDE} AS qs, {_UNIT} AS v FROM embeddings), u AS (SELECT vec_id, label, qs, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM e),
pr AS (SELECT b.vec_id AS test_id, a.vec_id AS train_id, round(list_inner_product(a.v, b.v), 6) AS similarity, a.label AS train_class FROM u a JOIN u b ON NOT a.qs AND b.qs),
nn AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY similarity DESC, train_id) AS neighbor_rank FROM pr QUALIFY neighbor_rank <= 3)"""


@query("embedding_neighbors", f"WITH {_EMB} SELECT test_id, train_id, similarity, neighbor_rank::INTEGER AS neighbor_rank FROM nn")
def embedding(spark, folder):
    train, test = _vectors(spark, folder)
    return D.embedding_neighbors(train, test, 3)


@query("embedding_neighbor_report", f"""
WITH {_EMB}, best AS (SELECT similarity, CASE WHEN train_class >= 7 THEN 'TRUE' ELSE 'FALSE' END AS train_label FROM nn WHERE neighbor_rank = 1), c AS (SELECT unnest({lex.SIMILARITY_CUTOFFS})::DOUBLE AS t)
SELECT t AS threshold, count(*) FILTER (similarity >= t) AS test_rows, {S.r('count(*) FILTER (similarity >= t)::DOUBLE / count(*)')} AS test_pct,
  count(*) FILTER (similarity >= t AND train_label = 'TRUE') AS "nearest_TRUE_count", count(*) FILTER (similarity >= t AND train_label = 'FALSE') AS "nearest_FALSE_count",
  {S.r("count(*) FILTER (similarity >= t AND train_label = 'TRUE')::DOUBLE / nullif(count(*) FILTER (similarity >= t), 0)")} AS "nearest_TRUE_rate" FROM best, c GROUP BY t""")
def embedding_report(spark, folder):
    train, test = _vectors(spark, folder)
    label = F.when(F.col("label") >= 7, "TRUE").otherwise("FALSE")
    best = D.embedding_neighbors(train, test, 1).join(train.select(F.col("vec_id").alias("train_id"), label.alias("train_label")), "train_id")
    return rounded(D.threshold_summary(best), ["test_pct", "nearest_TRUE_rate"])


_GRAMS = f"CASE WHEN len(w) < 2 THEN w ELSE list_concat({S.grams('w', 2)}, {S.grams('w', 3)}) END"


@query("near_duplicate_pairs", f"""
WITH k AS {_keyed('documents')}, wd AS (SELECT doc_id, regexp_extract_all(lower(exact_key), {S.q(_w2)}) AS w FROM k),
g AS (SELECT doc_id, list_sort(list_distinct({_GRAMS})) AS g FROM wd WHERE len(w) > 0),
c AS (SELECT *, min(doc_id) OVER (PARTITION BY g) AS first FROM g), r AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM c WHERE doc_id = first),
p AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS c, a.n + b.n - count(*) AS u FROM r a JOIN r b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n)
SELECT l AS left_id, r AS right_id, {S.r('1 - c::DOUBLE / u')} AS distance FROM p WHERE c >= 0.7::DOUBLE * u - 1e-9
UNION ALL SELECT first, doc_id, 0.0 FROM c WHERE doc_id > first""")
def near_duplicates(spark, folder):
    return rounded(D.near_duplicates(V.documents(spark, folder).select("doc_id", "text"), max_distance=0.3), ["distance"])
