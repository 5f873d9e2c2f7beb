"""Top-k selection, seeded samples, splits, folds, oversampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convosieve.operators.ranking import add_hash_rank, add_rank, hash_order
from convosieve.operators.stats import stack


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """First n rows per key.  Spark cuts each map partition to n rows per key before the shuffle."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(out) <= n)


def select_counts(df: DataFrame, score: str, counts: list[int], id_col: str = "doc_id") -> DataFrame:
    """For each count k: rows labelled TRUE and the k-th best score (the floor)."""
    ranked = add_rank(df, score, id_col, descending=True, out="_pos", total="_n")
    one = ranked.agg(
        *[F.count_if(F.col("_pos") <= k).alias(f"c{k}") for k in counts],
        *[F.min(F.when(F.col("_pos") <= k, F.col(score))).alias(f"f{k}") for k in counts],
    )
    return stack(one, [
        {"count": F.lit(k), "selected": F.col(f"c{k}"), "threshold_floor": F.coalesce(F.col(f"f{k}"), F.lit(1.0))} for k in counts
    ])


def labels_from_top_k(df: DataFrame, score: str, k: int, id_col: str = "doc_id", out: str = "label") -> DataFrame:
    """Exactly k rows TRUE: the best scores, ties by id."""
    ranked = add_rank(df, score, id_col, descending=True, out="_pos")
    return ranked.withColumn(out, F.when(F.col("_pos") <= k, "TRUE").otherwise("FALSE")).drop("_pos")


def seeded_sample(df: DataFrame, group: str, n: int, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """n rows per group in hash order."""
    order = [hash_order(id_col, seed).asc(), F.col(id_col).asc()]
    return top_per_group(df, [group], order, n, "_rn").drop("_rn")


def split(df: DataFrame, strata: str, fraction: float = 0.2, id_col: str = "doc_id", seed: int = 42, out: str = "split") -> DataFrame:
    """Stratified hold-out: the first ceil(fraction * n) rows of each stratum in hash order are ``val``."""
    ranked = add_hash_rank(df, id_col, strata, seed, "_pos", "_n")
    is_val = F.col("_pos") <= F.ceil(F.round(F.col("_n") * fraction, 6))
    return ranked.withColumn(out, F.when(is_val, "val").otherwise("train")).drop("_pos", "_n")


def folds(df: DataFrame, strata: str, k: int = 5, id_col: str = "doc_id", seed: int = 42, out: str = "fold") -> DataFrame:
    """Stratified k folds: positions in hash order dealt round-robin."""
    ranked = add_hash_rank(df, id_col, strata, seed, "_pos")
    return ranked.withColumn(out, ((F.col("_pos") - 1) % k).cast("int")).drop("_pos")


def multi_seed_folds(df: DataFrame, strata: str, seeds: list[int], k: int = 5, id_col: str = "doc_id") -> DataFrame:
    """(row, seed, fold) for several seeds."""
    parts = [folds(df, strata, k, id_col, s).withColumn("seed", F.lit(s)) for s in seeds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stratify_key(df: DataFrame, label: str, bucket: str, min_count: int, out: str = "stratum") -> DataFrame:
    """label__bucket, or label__other when rare, or just the label when that is rare too.

    Counts come from a small (label, bucket) table joined back, not from windows over the rows.
    """
    combo = F.concat_ws("__", label, bucket)
    counts = df.groupBy(label, bucket).agg(F.count(F.lit(1)).alias("_c"))
    first = counts.withColumn("_k", F.when(F.col("_c") >= min_count, combo).otherwise(F.concat(F.col(label), F.lit("__other"))))
    per_key = Window.partitionBy("_k")  # one row per label and bucket
    second = first.withColumn("_kc", F.sum("_c").over(per_key))
    key = F.when(F.col("_kc") >= min_count, F.col("_k")).otherwise(F.col(label))
    return df.join(second.select(label, bucket, key.alias(out)), [label, bucket])


def stratify_key_strict(df: DataFrame, label: str, bucket: str, n_splits: int, out: str = "stratum") -> DataFrame:
    """label_bucket for all rows, or only the label for all rows if any combination is too small."""
    smallest = df.groupBy(label, bucket).agg(F.count(F.lit(1)).alias("c")).agg(F.min("c")).first()[0]
    if smallest is not None and smallest < n_splits:
        return df.withColumn(out, F.col(label))
    return df.withColumn(out, F.concat_ws("_", label, bucket))


def oversample(df: DataFrame, label: str, id_col: str = "doc_id", batch: int = 16, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Balanced classes: rows of the smaller class repeat until both fill the same number of half batches.

    Adds ``copy`` (0 for the first use) and a shuffled ``slot``.  The needed copies per row
    are arithmetic on its rank, so replication is a local explode.
    """
    if batch % 2:
        raise ValueError("batch must be even")
    half = batch // 2
    sizes = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect()}
    if len(sizes) < 2:
        raise ValueError("both classes must be present")
    need = -(-max(sizes.values()) // half) * half
    ranked = add_hash_rank(df, id_col, label, seed + epoch, "_pos", "_n")
    copies = F.floor((F.lit(need) - F.col("_pos")) / F.col("_n")) + 1
    repeated = ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1)))
    slot = F.col("_pos") + F.col("copy") * F.col("_n") - 1
    return repeated.withColumn("slot", slot).withColumn("batch", F.floor(slot / half)).drop("_pos", "_n")


def review_picks(df: DataFrame, weirdness: str = "weirdness_proxy", label: str = "label", id_col: str = "doc_id", seed: int = 42, extremes: int = 4, randoms: int = 2) -> DataFrame:
    """Rows for manual reading: the weirdest TRUE, the plainest FALSE, and a few random of each; first reason wins."""
    def tag(part: DataFrame, reason: str, rank: int) -> DataFrame:
        return part.withColumn("selection_reason", F.lit(reason)).withColumn("_o", F.lit(rank))

    t, f = df.filter(F.col(label) == "TRUE"), df.filter(F.col(label) == "FALSE")
    h = [hash_order(id_col, seed).asc(), F.col(id_col).asc()]
    parts = [
        tag(top_n(t, extremes, F.desc(weirdness), F.asc(id_col)), "TRUE_high_weirdness", 0),
        tag(top_n(f, extremes, F.asc(weirdness), F.asc(id_col)), "FALSE_low_weirdness", 1),
        tag(top_n(t, randoms, *h), "TRUE_random_sample", 2),
        tag(top_n(f, randoms, *h), "FALSE_random_sample", 3),
    ]
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.unionByName(p)
    return picked.dropDuplicates([id_col, "selection_reason"]).drop("_o")
