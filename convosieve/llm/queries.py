"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convosieve.llm import bpe, contamination, crf, dialogue, jaccard, merkle, packing, pairwise, quality_rules, repeats, sharding, unigram, wavelet
from convosieve.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def tokenizer_file(name: str) -> str:
    """The default for the `path` of the tokenizing operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_bounded_load_ring")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return sharding.assign(docs, shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op4_wavelet_matrix")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    shards = wavelet.write_shards(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)
    return wavelet.read_digests(spark, shards)


@query("op5_bounded_space_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"), size=1024, end_id=0)


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

@query("op2_distribution_divergence")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.report(table(spark, folder, "documents"))


REPEATS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
t AS (SELECT min(doc_id) AS doc_id, count(*) AS copies, any_value(w) AS w FROM d GROUP BY text),
x AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 50], ' ') AS run FROM (SELECT *, unnest(range(0, len(w) - 49)) AS i FROM t WHERE len(w) >= 50)),
o AS (SELECT doc_id, i, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM x),
c AS (SELECT doc_id, p, bool_or(k = 1) AS first_copy FROM (SELECT *, unnest(range(i, i + 50)) AS p FROM o WHERE n > 1) GROUP BY doc_id, p),
a AS (
  SELECT t.doc_id, t.p, coalesce(c.first_copy, true) AS first_copy
  FROM (SELECT doc_id, copies, unnest(range(0, len(w))) AS p FROM t WHERE len(w) >= 50) t LEFT JOIN c USING (doc_id, p)
  WHERE c.p IS NOT NULL OR t.copies > 1
  UNION ALL
  SELECT doc_id, unnest(range(0, len(w))), false FROM d WHERE len(w) >= 50 AND doc_id NOT IN (SELECT doc_id FROM t)),
g AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, first_copy ORDER BY p) AS island FROM a)
SELECT doc_id, CAST(min(p) AS BIGINT) AS start_word, CAST(max(p) + 1 AS BIGINT) AS end_word, first_copy FROM g GROUP BY doc_id, first_copy, island
"""


@query("op3_sparse_suffix_repeats", REPEATS_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.spans(table(spark, folder, "documents"), length=50)


JACCARD_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("text", LOWER)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS run
  FROM (SELECT *, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


@query("op6_token_group_jaccard", JACCARD_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar(table(spark, folder, "documents"), size=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query("op7_bradley_terry_quality")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return pairwise.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, w, least(13, len(w)) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
r AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS run
  FROM (SELECT d.doc_id, d.w, n.k, unnest(range(1, len(d.w) - n.k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) n)),
m AS (SELECT r.doc_id, r.k, r.i, p.item_id FROM r JOIN p ON r.k = p.k AND r.run = p.run),
h AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS spot FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit > 0 AND 20 * h.n_hit >= len(d.w), false) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op8_wu_manber_contamination", CONTAMINATION_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_unigram_token_counts")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return unigram.token_counts(table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"), byte_fallback=True)


@query("op10_crf_language")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return crf.languages(table(spark, folder, "documents"))


@query("op12_rank_array_bpe")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: crc32 of an ASCII string `s` by the polynomial's bits: DuckDB has no such function.
CRC32_SQL = (
    "xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(strlen({s})), lambda i: ascii({s}[i + 1])::UBIGINT)), "
    "lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, z: xor(x >> 1, (x & 1::UBIGINT) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"
)


def _repair_sql() -> str:
    crc = CRC32_SQL.format(s="name")
    order = "turn NULLS FIRST, role, md5(text)"
    asked = "CASE q WHEN 2 THEN 3 ELSE 2 END"
    kept = "CASE WHEN q = 0 AND initial = 's' THEN 1 WHEN q <> 2 AND initial = 'u' THEN 2 WHEN q = 2 AND initial = 'a' THEN 3 END"
    return rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'null') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
k AS (SELECT *, {crc} % 20 AS kind FROM c),
d AS (
  SELECT key, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM k, (VALUES (1), (2)) v(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {order}) AS i FROM d),
p AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY key, role, text ORDER BY i) AS seen FROM o),
f AS (
  SELECT *, lag(initial) OVER (PARTITION BY key ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE '' END AS fault
  FROM p),
-- Up to two inserts and one edit for each row; states: nothing yet, after system, after user, after assistant.
ins AS (
  SELECT q, n, CASE n WHEN 0 THEN q WHEN 1 THEN one ELSE 5 - one END AS q2,
    CASE WHEN n = 0 THEN [] WHEN n = 1 THEN [names[one - 1]] ELSE [names[one - 1], names[4 - one]] END AS more
  FROM (SELECT q, {asked} AS one, ['user:', 'assistant:'] AS names FROM range(4) r(q)), range(3) t(n)),
s AS (
  SELECT DISTINCT key, 0::BIGINT AS i, 0::BIGINT AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM c
  UNION ALL
  SELECT key, i, q, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY key, q ORDER BY cost, audit) AS best FROM (
      SELECT s.key, f.i, e.to_q AS q, s.cost + 3 * ins.n + e.more AS cost, s.audit || repeat('I', ins.n) || e.edit AS audit, s.lines || ins.more || e.line AS lines
      FROM s JOIN f ON f.key = s.key AND f.i = s.i + 1 JOIN ins ON ins.q = s.q JOIN LATERAL (
        SELECT ins.q2 AS to_q, 4 AS more, 'D' AS edit, []::VARCHAR[] AS line
        UNION ALL
        SELECT {kept.replace("q ", "ins.q2 ").replace("initial", "f.initial")}, CASE f.fault WHEN 't' THEN 3 ELSE 0 END, 'K', [f.role || ':' || f.text] WHERE f.fault IN ('', 't')
        UNION ALL
        SELECT CASE ins.q2 WHEN 2 THEN 3 ELSE 2 END, CASE f.fault WHEN 't' THEN 6 ELSE 3 END, 'R', [CASE ins.q2 WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text] WHERE f.fault IN ('', 't')
      ) e ON e.to_q IS NOT NULL)) WHERE best = 1),
n AS (
  SELECT key, count(*) AS n, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated,
    count_if(before || initial NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM f GROUP BY key),
e AS (
  SELECT s.key, s.cost + CASE q WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END AS cost, s.audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
    s.lines || CASE q WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END AS lines
  FROM s LEFT JOIN n ON n.key = s.key WHERE s.i = coalesce(n.n, 0)),
z AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY cost, audit) = 1)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, z.cost::BIGINT AS cost, z.audit, sha256(array_to_string(z.lines, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT key, conv_id FROM c) a JOIN z ON z.key = a.key LEFT JOIN n ON n.key = a.key
"""


@query("op11_persistent_audit_repair", _repair_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.report(dialogue.damaged(table(spark, folder, "conversations")))


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _climb_sql(name: str, leaves: str) -> str:
    """A recursive table (grp, lvl, pos, h) over rows (grp, pos, h): every level up to the single node."""
    return f"""{name} AS (
  SELECT grp, 0 AS lvl, pos, h FROM {leaves}
  UNION ALL
  SELECT grp, any_value(lvl) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}) WHERE n > 1 GROUP BY grp, pos // 8)"""


MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT coalesce('=' || lang, '') AS grp, doc_id, {_leaf_sql("text")} AS h,
    CASE WHEN {CRC32_SQL.format(s="CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf_sql(LOWER)} END AS changed
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM d),
{_climb_sql("t", "l")},
s AS (SELECT grp AS lang_grp, h, '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos FROM (SELECT grp, arg_max(h, lvl) AS h FROM t GROUP BY grp)),
{_climb_sql("u", "s")},
-- One row per step: where the group's own tree ends, the siblings are the other groups' roots.
step AS (
  SELECT l.grp, l.pos AS leaf, i.lvl, l.pos // CAST(8 ** i.lvl AS BIGINT) AS own
  FROM l JOIN (SELECT grp, lvl FROM t GROUP BY grp, lvl HAVING count(*) > 1) i ON i.grp = l.grp),
low AS (
  SELECT step.grp, step.leaf, step.lvl, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < own), '') AS a, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > own), '') AS b
  FROM step JOIN t ON t.grp = step.grp AND t.lvl = step.lvl AND t.pos // 8 = own // 8 GROUP BY ALL),
up AS (
  SELECT s.lang_grp AS grp, i.lvl, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < s.pos // CAST(8 ** i.lvl AS BIGINT)), '') AS a,
    coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > s.pos // CAST(8 ** i.lvl AS BIGINT)), '') AS b
  FROM s, (SELECT lvl FROM u GROUP BY lvl HAVING count(*) > 1) i, u
  WHERE u.lvl = i.lvl AND u.pos // 8 = (s.pos // CAST(8 ** i.lvl AS BIGINT)) // 8 GROUP BY ALL),
path AS (
  SELECT l.grp, l.pos, coalesce((SELECT list({{'a': a, 'b': b}} ORDER BY lvl) FROM low WHERE low.grp = l.grp AND low.leaf = l.pos), [])
    || coalesce((SELECT list({{'a': a, 'b': b}} ORDER BY lvl) FROM up WHERE up.grp = l.grp), []) AS p
  FROM l),
f AS (
  SELECT l.grp, l.pos, 1 AS k, coalesce(changed, h) AS h, p FROM l JOIN path USING (grp, pos)
  UNION ALL
  SELECT grp, pos, k + 1, sha256(p[k].a || h || p[k].b), p FROM f WHERE k <= len(p)),
r AS (SELECT arg_max(h, lvl) AS root FROM u)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.root, sha256(array_to_string(list_transform(path.p, lambda x: x.a || x.b), '')) AS proof_sha256,
  f.h AS folded_root, f.h = r.root AS verified
FROM l JOIN path USING (grp, pos) JOIN f ON f.grp = l.grp AND f.pos = l.pos AND f.k = len(path.p) + 1 JOIN s ON s.lang_grp = l.grp, r
"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = merkle.manifest(table(spark, folder, "documents"), changed={"text": F.translate("text", UPPER, UPPER.lower())}, where=third)
    root = merkle.folded(F.coalesce("changed_leaf", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.siblings_hash(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
