"""Duplicates, cross-corpus matches, nearest neighbours and leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convosieve.functions import lexicons as lex
from convosieve.functions import text as T
from convosieve.functions import tokens as K
from convosieve.functions.hashing import char_hashes, char_string, word_hashes, word_string
from convosieve.functions.scalar import let
from convosieve.operators.neighbors import document_counts, embedding_neighbors, nearest_by_terms, ranked
from convosieve.operators.ranking import most_frequent
from convosieve.operators.stats import stack
from convosieve.session import checkpoint


def add_keys(df: DataFrame, text: str = "text") -> DataFrame:
    base = df.withColumn("text_norm", T.normalize_text(text))
    cols = {name: fn("text_norm") for name, fn in T.KEYS.items()}
    cols |= {"char_length": F.length("text_norm"), "word_count": T.count_re("text_norm", T.WORD_ASCII)}
    return base.withColumns(cols)


def _digest(key: str) -> Column:
    # Keys are never null; a digest that cannot be null is not filtered, and so evaluated, a second time below a join.
    return F.coalesce(F.sha2(F.col(key), 256), F.lit(""))


def duplicate_groups(df: DataFrame, key: str, id_col: str = "doc_id", label: str | None = None, text: str = "text_norm") -> DataFrame:
    """Keys held by more than one row: counts, example, and label conflicts; `group_members` lists the rows."""
    narrow = df.select(id_col, *([label] if label else []), T.preview(text).alias("_p"), _digest(key).alias("_k"))
    aggs = [F.count(F.lit(1)).alias("row_count"), F.min_by("_p", F.col(id_col)).alias("example_text")]
    if label:
        aggs += [F.count_if(F.col(label) == v).alias(f"{v}_count") for v in ("TRUE", "FALSE")]
    out = narrow.groupBy("_k").agg(*aggs).filter("row_count > 1")
    if label:
        out = out.withColumn("TRUE_rate", F.col("TRUE_count") / F.col("row_count")).withColumn(
            "has_label_conflict", (F.col("TRUE_count") > 0) & (F.col("FALSE_count") > 0)
        )
    return out.withColumnRenamed("_k", "key_digest")


def _sized(rows: DataFrame, kept: DataFrame) -> DataFrame:
    # A kept key may hold a large share of the rows: these meet its one row id range by id range.
    parts = 64
    spread_keys = kept.select("key_digest", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_s"))
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    return salted.join(spread_keys, ["key_digest", "_s"], "left_semi").drop("_s")


def group_members(df: DataFrame, key: str, id_col: str = "doc_id", label: str | None = None) -> DataFrame:
    """Every row of every key that more than one row holds: key_digest, id and, with labels, label."""
    rows = df.select(_digest(key).alias("key_digest"), F.col(id_col).alias("id"), *([F.col(label).alias("label")] if label else []))
    return _sized(rows, rows.groupBy("key_digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))


def cross_members(train: DataFrame, test: DataFrame, key: str, id_col: str = "doc_id", label: str = "label", test_id: str = "doc_id", min_train: int = 1) -> DataFrame:
    """Every row of the keys that both corpora hold: key_digest, side, id, label (null for test rows)."""
    a = train.select(_digest(key).alias("key_digest"), F.lit("train").alias("side"), F.col(id_col).alias("id"), F.col(label).alias("label"))
    b = test.select(_digest(key).alias("key_digest"), F.lit("test").alias("side"), F.col(test_id).alias("id"), F.lit(None).cast("string").alias("label"))
    rows = a.unionByName(b)
    held = rows.groupBy("key_digest").agg(F.count_if(F.col("side") == "train").alias("a"), F.count_if(F.col("side") == "test").alias("b"))
    return _sized(rows, held.filter((F.col("a") >= min_train) & (F.col("b") > 0)))


def cross_matches(train: DataFrame, test: DataFrame, key: str, id_col: str = "doc_id", label: str = "label", test_id: str = "doc_id", min_train: int = 1) -> DataFrame:
    """Keys present in both corpora.  Each side is aggregated before the join, so no pair is ever formed; `cross_members` lists the rows."""
    a = train.select(id_col, label, T.preview("text_norm").alias("_p"), _digest(key).alias("_k"))
    b = test.select(F.col(test_id).alias("_tid"), T.preview("text_norm").alias("_p"), _digest(key).alias("_k"))
    ag = a.groupBy("_k").agg(
        F.count(F.lit(1)).alias("train_match_count"),
        *[F.count_if(F.col(label) == v).alias(f"train_{v}_count") for v in ("TRUE", "FALSE")],
        F.min_by("_p", F.col(id_col)).alias("train_example_text"),
    ).filter(F.col("train_match_count") >= min_train)
    bg = b.groupBy("_k").agg(F.count(F.lit(1)).alias("test_match_count"), F.min_by("_p", F.col("_tid")).alias("test_example_text"))
    n = F.col("train_match_count")
    return (
        bg.join(ag, "_k")
        .withColumn("train_TRUE_rate", F.col("train_TRUE_count") / n)
        .withColumn("train_FALSE_rate", F.col("train_FALSE_count") / n)
        .withColumn("cross_pair_count", n * F.col("test_match_count"))
        .withColumnRenamed("_k", "key_digest")
    )


def matched_rows(train: DataFrame, test: DataFrame, key: str, test_id: str = "doc_id") -> DataFrame:
    """Test ids whose key occurs in train."""
    left = test.select(test_id, _digest(key).alias("_k"))
    return left.join(train.select(_digest(key).alias("_k")).distinct(), "_k", "left_semi").select(test_id)


# --- exact nearest neighbours -----------------------------------------------------


#: A term's occurrences meet the vocabulary in so many parts.
SALT = 8


def tfidf_vectors(docs: DataFrame, grams: Column, id_col: str, min_df: int = 2, max_features: int | None = None) -> DataFrame:
    """(id, terms, weights): sublinear tf, smoothed idf, unit length, over all terms (or the ``max_features`` most frequent).

    Terms are 64-bit hashes; two grams of one hash stay apart in the vocabulary.  Occurrence counts per document come from one
    map-side-combined aggregate, and the vocabulary, which grows with the corpus, is joined rather than broadcast.  A term of many
    documents is dealt out by id: the vocabulary is repeated SALT times.
    """
    occ = K.explode_rows(docs, [id_col], grams, "g").groupBy(id_col, F.xxhash64("g").alias("term"), "g").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.count()
    vocab = occ.groupBy("term", "g").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    vocab = vocab if max_features is None else most_frequent(vocab, "total", "g", max_features)
    vocab = vocab.select("term", "g", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_s"), (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    salted = occ.withColumn("_s", F.pmod(F.xxhash64(id_col), F.lit(SALT)).cast("int"))
    weighted = salted.join(vocab, ["term", "g", "_s"]).select(id_col, "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    rows = weighted.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("tw"))
    norm = F.sqrt(F.aggregate("tw", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    # The norm is bound once per row; as a plain column it would be inlined into the lambda.
    weights = let(norm, lambda n: F.transform("tw", lambda x: x["w"] / n))
    return rows.select(id_col, F.transform("tw", lambda x: x["term"]).alias("terms"), weights.alias("weights"))


GRAMS = {
    "word_tfidf_1_2": lambda t: K.word_ngrams(K.strip_accents(F.lower(t)), 1, 2),
    "char_tfidf_3_5": lambda t: K.char_wb_ngrams(K.strip_accents(F.lower(t)), 3, 5),
}
#: The same grams as hashes: the string that a task gets, and what makes its hashes.
HASHES = {
    "word_tfidf_1_2": (lambda t: word_string(K.strip_accents(F.lower(t))), word_hashes),
    "char_tfidf_3_5": (lambda t: char_string(K.strip_accents(F.lower(t))), char_hashes),
}


def tfidf_neighbors(
    train: DataFrame, test: DataFrame, method: str = "word_tfidf_1_2", k: int = 5, train_id: str = "doc_id", test_id: str = "doc_id",
    text: str = "text_norm", min_df: int = 2, max_features: int | None = None,
) -> DataFrame:
    """Exact top-k cosine neighbours of each test row; the weights are fitted on both sides together.

    Terms are 64-bit hashes.  Texts of one id count as one document, and repeated rows of an id each have their neighbours.
    """
    both = train.select(F.col(train_id).alias("_id"), F.lit(0).alias("_odd"), F.col(text).alias("_text")).unionByName(
        test.select(F.col(test_id).alias("_id"), F.lit(1).alias("_odd"), F.col(text).alias("_text"))
    )
    # One id space for both sides: even for train, odd for test.
    keyed = both.select((F.col("_id").cast("long") * 2 + F.col("_odd")).alias("key"), "_text")
    spark = both.sparkSession
    parts = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = keyed.repartition(parts, "key").groupBy("key").agg(F.collect_list("_text").alias("_texts"))
    if max_features is None:
        # Texts of one id have no gram across them.
        string, hashes = HASHES[method]
        hashed = checkpoint(texts.select("key", F.array_join(F.transform("_texts", string), "\n" if hashes is word_hashes else " ").alias("grams")))
        vocab = document_counts(hashed, hashes).filter(F.col("df") >= min_df)
    else:
        grams_of, hashes = checkpoint(texts).select("key", F.flatten(F.transform("_texts", GRAMS[method])).alias("grams")), None
        hashed = grams_of.select("key", F.transform("grams", lambda g: F.xxhash64(g)).alias("grams"))
        occ = K.explode_rows(grams_of, ["key"], "grams", "g").groupBy("key", "g").agg(F.count(F.lit(1)).alias("tf"))
        vocab = occ.groupBy("g").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
        vocab = most_frequent(vocab, "total", "g", max_features).select(F.xxhash64("g").alias("term"), "df")
    best = ranked(nearest_by_terms(hashed, hashes, checkpoint(vocab), both.count(), k), k).drop("neighbor_rank")
    for df, id_col, name in ((train, train_id, "train_id"), (test, test_id, "test_id")):
        best = best.join(df.select(F.col(id_col).cast("long").alias(name)), name)
    return ranked(best.select("test_id", "train_id", "similarity"), k).withColumn("method", F.lit(method))


def describe_neighbors(neighbors: DataFrame, train: DataFrame, test: DataFrame, train_id: str = "doc_id", test_id: str = "doc_id", label: str = "label") -> DataFrame:
    """Add labels, lengths and previews of both sides."""
    a = train.select(
        F.col(train_id).alias("train_id"), F.col(label).alias("train_label"), F.col("char_length").alias("train_char_length"),
        F.col("word_count").alias("train_word_count"), T.preview("text_norm").alias("train_text"),
    )
    b = test.select(
        F.col(test_id).alias("test_id"), F.col("char_length").alias("test_char_length"), F.col("word_count").alias("test_word_count"),
        T.preview("text_norm").alias("test_text"),
    )
    return neighbors.join(a, "train_id").join(b, "test_id")


# --- similarity reports -----------------------------------------------------------


def threshold_summary(best: DataFrame, sim: str = "similarity", label: str = "train_label", cutoffs=None) -> DataFrame:
    """Rank-1 rows at or above each cut-off, with the labels of their neighbours."""
    cutoffs = cutoffs or lex.SIMILARITY_CUTOFFS
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cutoffs):
        hit = F.col(sim) >= c
        aggs += [F.count_if(hit).alias(f"c{i}")] + [F.count_if(hit & (F.col(label) == v)).alias(f"{v}{i}") for v in ("TRUE", "FALSE")]
    return stack(best.agg(*aggs), [
        {
            "threshold": F.lit(c), "test_rows": F.col(f"c{i}"), "test_pct": F.col(f"c{i}") / F.greatest(F.col("n"), F.lit(1)),
            "nearest_TRUE_count": F.col(f"TRUE{i}"), "nearest_FALSE_count": F.col(f"FALSE{i}"),
            "nearest_TRUE_rate": F.try_divide(F.col(f"TRUE{i}").cast("double"), F.col(f"c{i}")),
        }
        for i, c in enumerate(cutoffs)
    ])


def similarity_quantiles(best: DataFrame, sim: str = "similarity", probs=None) -> DataFrame:
    from convosieve.operators.ranking import exact_quantiles

    got = exact_quantiles(best, [sim], probs or lex.SIMILARITY_QUANTILES)
    return got.select(F.col("prob").alias("quantile"), F.col("value").alias("similarity"))


def leakage_cases(char_best: DataFrame, word_best: DataFrame, flags: dict[str, DataFrame], char_min: float = 0.85, word_min: float = 0.80) -> DataFrame:
    """Rows that match by key or are close by either similarity.

    ``*_best`` are rank-1 tables (test_id, train_id, similarity, train_label); ``flags`` maps
    a flag name to the test ids it holds for.
    """
    a = char_best.select("test_id", F.col("similarity").alias("char_similarity"), F.col("train_id").alias("char_nearest_id"), F.col("train_label").alias("char_nearest_label"))
    b = word_best.select("test_id", F.col("similarity").alias("word_similarity"), F.col("train_id").alias("word_nearest_id"), F.col("train_label").alias("word_nearest_label"))
    out = a.join(b, "test_id")
    for name, ids in flags.items():
        marked = ids.select(F.col(ids.columns[0]).alias("test_id")).distinct().withColumn(name, F.lit(True))
        out = out.join(marked, "test_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    any_flag = F.lit(False)
    for name in flags:
        any_flag = any_flag | F.col(name)
    nearest = F.when(F.col("char_similarity") >= F.col("word_similarity"), F.col("char_nearest_label")).otherwise(F.col("word_nearest_label"))
    return out.withColumn("nearest_train_label", nearest).filter(
        any_flag | (F.col("char_similarity") >= char_min) | (F.col("word_similarity") >= word_min)
    )


#: Rows of one gram that a task joins with the gram's other rows; grams with more are dealt out in parts.
GRAM_ROWS = 5000


def _word_grams(text: str) -> Column:
    """The distinct word 2- and 3-grams of a text; a single word is a gram."""
    words = K.tokens(F.lower(T.exact_key(T.normalize_text(text))), K.WORD_MIN2)
    return F.array_distinct(let(words, lambda w: F.when(F.size(w) < 2, w).otherwise(F.concat(K.ngrams(w, 2), K.ngrams(w, 3)))))


def gram_sets(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, n, text): digest and size of the set of word 2- and 3-grams of each text.  Texts without words are left out."""
    rows = K.explode_rows(df, [F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")], F.array(F.sort_array(_word_grams(text))), "grams")
    return rows.filter(F.size("grams") > 0).select("id", F.sha2(F.array_join("grams", "|"), 256).alias("digest"), F.size("grams").alias("n"), "text")


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(id, n, gram, place): a set's rarest grams, as many as must have one in common with those of any set that is similar enough.

    Grams are 64-bit hashes, one for each gram also where two are alike, so that no pair is lost by a hash.  Those that only one set
    has come first in the order and meet nothing, so they are counted and left out.
    """
    each = K.explode_rows(sets, ["id"], F.transform(_word_grams("text"), lambda g: F.xxhash64(g)), "gram")
    often = each.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("gram"))).filter("df > 1")
    whole = Window.partitionBy("id")
    rows = often.join(sets.select("id", "n"), "id").withColumn("met", F.count(F.lit(1)).over(whole))
    place = F.row_number().over(whole.orderBy("df", "gram")) + F.col("n") - F.col("met")
    return rows.select("id", "n", "gram", place.alias("place")).filter(F.col("place") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1)


def _in_parts(rows: DataFrame, gram_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows twice, with a `part` to join on: a gram of many rows has parts by their number; one side is dealt out, the other is in all."""
    hot = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > gram_rows)
    hot = hot.select("gram", F.ceil(F.col("rows") / gram_rows).cast("int").alias("parts"))
    sized = rows.join(hot, "gram", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return dealt.drop("parts"), sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", max_distance: float = 0.3, gram_rows: int = GRAM_ROWS) -> DataFrame:
    """(left_id, right_id, distance): all pairs of different gram sets within a Jaccard distance, by their smallest ids, and the
    smallest id of each set with every other row of the set, at distance 0.

    The pairs are complete.  Sets are ordered by the number of sets that have a gram; two sets that are similar enough share one of
    their first grams, and from there on must have enough left to share.  What remains is compared whole.
    """
    least = 1 - max_distance
    sets = checkpoint(gram_sets(df, id_col, text))
    groups = sets.groupBy("digest").agg(F.min("id").alias("left_id"), F.count(F.lit(1)).alias("rows"))
    members = sets.select("id", "digest").join(groups.filter("rows > 1").drop("rows"), "digest").filter("id > left_id")
    first = checkpoint(sets.join(groups.select("digest", F.col("left_id").alias("id")), ["digest", "id"], "left_semi").dropDuplicates(["id"]).select("id", "n", "text"))
    a, b = _in_parts(checkpoint(_prefixes(first, least)), gram_rows)
    a = a.select("gram", "part", F.col("id").alias("left_id"), F.col("n").alias("n"), (F.col("n") - F.col("place") + 1).alias("left"))
    b = b.select("gram", "part", F.col("id").alias("right_id"), F.col("n").alias("m"), (F.col("n") - F.col("place") + 1).alias("right"))
    n, m = F.col("n"), F.col("m")
    fits = (F.least(n, m) >= least * F.greatest(n, m) - 1e-9) & (F.least("left", "right") * (1 + least) >= least * (n + m) - 1e-9)
    pairs = checkpoint(a.join(b, ["gram", "part"]).filter((F.col("left_id") < F.col("right_id")) & fits).select("left_id", "right_id").distinct())
    side = lambda name, size: first.select(F.col("id").alias(f"{name}_id"), F.col("n").alias(size), F.col("text").alias(name))
    # Texts go to the pairs, as they are smaller than their grams.
    whole = pairs.join(side("left", "n"), "left_id").join(side("right", "m"), "right_id")
    met = K.explode_rows(whole, ["left_id", "right_id", "n", "m"], F.array(F.size(F.array_intersect(_word_grams("left"), _word_grams("right")))), "both")
    near = met.filter(F.col("both") >= least * (n + m - F.col("both")) - 1e-9).select("left_id", "right_id", (1 - F.col("both") / (n + m - F.col("both"))).alias("distance"))
    return near.unionByName(members.select("left_id", F.col("id").alias("right_id"), F.lit(0.0).alias("distance")))
