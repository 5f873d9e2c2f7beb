"""Group summaries, effect sizes, correlations, length tables, n-gram log-odds, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convosieve.functions.scalar import safe_ratio, two_sided_p
from convosieve.functions.tokens import explode_rows
from convosieve.operators.ranking import exact_quantiles, most_frequent, quantiles_wide


def stack(one_row: DataFrame, rows: list[dict[str, Column]], keep: list[str] | None = None) -> DataFrame:
    """Turn wide aggregate rows into one row per entry of ``rows`` (no second pass over the data)."""
    structs = [F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows]
    return one_row.select(*(keep or []), F.explode(F.array(*structs)).alias("_r")).select(*(keep or []), "_r.*")


def melt(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Wide features to (keep..., feature, value)."""
    return df.unpivot([F.col(k) for k in keep], [F.col(f) for f in features], "feature", "value")


def summarize(
    df: DataFrame, group: str, features: list[str], stats=("mean", "median", "std", "min", "max"), digits: int = 6
) -> DataFrame:
    """One row per group with ``<feature>_<stat>`` columns; std is the sample deviation."""
    simple = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    aggs = [simple[s](f).alias(f"{f}_{s}") for f in features for s in stats if s != "median"]
    out = df.groupBy(group).agg(*aggs)
    if "median" in stats:
        med = quantiles_wide(df, {f"{f}_median": (f, 0.5) for f in features}, [group])
        out = out.join(med, group)
    ordered = [F.col(f"{f}_{s}") if s == "count" else F.round(f"{f}_{s}", digits).alias(f"{f}_{s}") for f in features for s in stats]
    return out.select(group, *ordered)


def summarize_long(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """(group, feature, mean, median, p90, max)."""
    one = df.groupBy(group).agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.max(f).alias(f"x{i}") for i, f in enumerate(features)])
    base = stack(one, [{"feature": F.lit(f), "mean": F.col(f"m{i}"), "max": F.col(f"x{i}")} for i, f in enumerate(features)], [group])
    q = exact_quantiles(df, features, [0.5, 0.9], [group])
    q = q.groupBy(group, "feature").agg(
        F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("prob") == 0.9, F.col("value"))).alias("p90"),
    )
    return base.join(q, [group, "feature"])


DESCRIBE_PROBS = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def describe_lengths(df: DataFrame, columns: dict[str, str], group: str, with_all: bool = True, all_label: str = "ALL") -> DataFrame:
    """count, mean, population std, min, p50..p99, max per group value, plus one row over everything."""
    rows = df
    if with_all:
        rows = df.withColumn(group, F.explode(F.array(F.col(group), F.lit(all_label))))
    aggs = []
    for prefix, c in columns.items():
        aggs += [
            F.count(c).alias(f"{prefix}_count"), F.avg(c).alias(f"{prefix}_mean"), F.stddev_pop(c).alias(f"{prefix}_std"),
            F.min(c).alias(f"{prefix}_min"), F.max(c).alias(f"{prefix}_max"),
        ]
    specs = {f"{prefix}_{n}": (c, p) for prefix, c in columns.items() for n, p in DESCRIBE_PROBS.items()}
    return rows.groupBy(group).agg(*aggs).join(quantiles_wide(rows, specs, [group]), group)


def length_coverage(df: DataFrame, length: str, group: str, candidates: list[int], reserved: int = 2) -> DataFrame:
    """Per group and candidate maximum: truncated rows and how much of the text is kept."""
    n = F.col(length)
    wide = df.select(group, n, *[(F.least(n, F.lit(m - reserved)) / F.greatest(n, F.lit(1))).alias(f"k{m}") for m in candidates])
    one = wide.groupBy(group).agg(
        F.count(F.lit(1)).alias("total_count"),
        *[F.count_if(n > m - reserved).alias(f"t{m}") for m in candidates],
        *[F.avg(f"k{m}").alias(f"a{m}") for m in candidates],
    )
    base = stack(
        one,
        [
            {
                "max_length": F.lit(m), "content_capacity": F.lit(m - reserved), "truncated_count": F.col(f"t{m}"),
                "truncated_pct": 100.0 * F.col(f"t{m}") / F.col("total_count"), "mean_retained_pct": 100.0 * F.col(f"a{m}"),
                "feature": F.lit(f"k{m}"),
            }
            for m in candidates
        ],
        [group, "total_count"],
    )
    q = exact_quantiles(wide, [f"k{m}" for m in candidates], [0.05], [group])
    q = q.select(group, "feature", (100.0 * F.col("value")).alias("p05_retained_pct"))
    return base.join(q, [group, "feature"]).drop("feature")


# --- effect sizes and correlations ------------------------------------------------


def _two_class(df: DataFrame, features: list[str], label: str, std) -> DataFrame:
    aggs = []
    for i, f in enumerate(features):
        for v, tag in (("TRUE", "t"), ("FALSE", "f")):
            x = F.when(F.col(label) == v, F.col(f))
            aggs += [F.avg(x).alias(f"m{tag}{i}"), std(x).alias(f"s{tag}{i}")]
    return df.agg(*aggs)


def effect_sizes(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Mean difference, ratio and standardised difference (sample deviations)."""
    one = _two_class(df, features, label, F.stddev_samp)
    rows = []
    for i, f in enumerate(features):
        mt, mf, st, sf = (F.col(f"{k}{i}") for k in ("mt", "mf", "st", "sf"))
        pooled = F.coalesce(F.sqrt((st * st + sf * sf) / 2), F.lit(0.0))
        rows.append({
            "feature": F.lit(f), "true_mean": mt, "false_mean": mf, "diff_true_minus_false": mt - mf,
            "ratio_true_over_false": safe_ratio(mt, mf), "standardized_diff": safe_ratio(mt - mf, pooled),
        })
    return stack(one, rows).orderBy(F.abs("standardized_diff").desc(), "feature")


def effect_sizes_population(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Standardised difference with population variances, and its direction."""
    one = _two_class(df, features, label, F.stddev_pop)
    rows = []
    for i, f in enumerate(features):
        mt, mf, st, sf = (F.col(f"{k}{i}") for k in ("mt", "mf", "st", "sf"))
        pooled = F.sqrt((st * st + sf * sf) / 2)
        effect = F.when(pooled > 1e-12, (mt - mf) / pooled).otherwise(0.0)
        rows.append({
            "feature": F.lit(f), "false_mean": mf, "true_mean": mt, "difference_true_minus_false": mt - mf,
            "effect_size": effect, "direction": F.when(effect > 0, "higher_TRUE").otherwise("higher_FALSE"),
        })
    return stack(one, rows).orderBy(F.abs("effect_size").desc(), "feature")


def correlations(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Pearson correlation with the label, its approximate p-value, class means, medians, deviations, Cohen d."""
    y = F.when(F.col(label) == "TRUE", 1.0).otherwise(0.0)
    aggs = [F.count(F.lit(1)).alias("n"), F.stddev_pop(y).alias("sy"), F.avg(y).alias("my")]
    for i, f in enumerate(features):
        aggs += [F.stddev_pop(f).alias(f"sx{i}"), F.covar_pop(F.col(f), y).alias(f"cv{i}")]
        for v, tag in (("TRUE", "t"), ("FALSE", "f")):
            x = F.when(F.col(label) == v, F.col(f))
            aggs += [F.avg(x).alias(f"m{tag}{i}"), F.stddev_pop(x).alias(f"s{tag}{i}")]
    one = df.agg(*aggs)
    rows = []
    for i, f in enumerate(features):
        mt, mf, st, sf, sx, cv = (F.col(f"{k}{i}") for k in ("mt", "mf", "st", "sf", "sx", "cv"))
        r = F.when((sx < 1e-12) | (F.col("sy") < 1e-12), 0.0).otherwise(cv / (sx * F.col("sy")))
        pooled = F.sqrt((st * st + sf * sf) / 2)
        rows.append({
            "feature": F.lit(f), "mean_FALSE": mf, "mean_TRUE": mt, "std_FALSE": sf, "std_TRUE": st, "r": r, "n": F.col("n"),
            "cohen_d_TRUE_minus_FALSE": F.when(pooled > 1e-12, (mt - mf) / pooled).otherwise(0.0),
        })
    base = stack(one, rows)
    r = F.col("r")
    t = F.when(F.abs(r) < 1, r * F.sqrt(F.greatest(F.col("n") - 2, F.lit(1)) / F.greatest(1.0 - r * r, F.lit(1e-12)))).otherwise(F.signum(r) * 1e9)
    med = exact_quantiles(df, features, [0.5], [label]).groupBy("feature").agg(
        *[F.max(F.when(F.col(label) == v, F.col("value"))).alias(f"median_{v}") for v in ("FALSE", "TRUE")]
    )
    out = base.withColumn("t", t).join(med, "feature")
    return out.select(
        "feature", "mean_FALSE", "mean_TRUE", "median_FALSE", "median_TRUE", "std_FALSE", "std_TRUE",
        r.alias("pearson_corr_with_TRUE"), F.abs(r).alias("abs_corr"), "cohen_d_TRUE_minus_FALSE",
        two_sided_p("t").alias("approx_p_value"), F.when(r > 0, "higher_TRUE").otherwise("higher_FALSE").alias("direction"),
    ).orderBy(F.desc("abs_corr"), "feature")


# --- n-gram log-odds --------------------------------------------------------------


def ngram_log_odds(
    df: DataFrame, grams: Column, label: str = "label", min_df: int = 3, max_features: int | None = None, alpha: float = 1.0,
) -> DataFrame:
    """Smoothed log-odds of each n-gram in TRUE against FALSE documents.

    Occurrences and first occurrences go through one aggregate by gram, combined map-side,
    so frequent grams never travel row by row.  The vocabulary keeps grams in at least
    ``min_df`` documents, all of them unless ``max_features`` asks for the most frequent only.
    """
    once = F.get(F.transform(F.array(grams), lambda g: F.concat(
        F.transform(g, lambda x: F.struct(x.alias("ngram"), F.lit(1).alias("tf"), F.lit(0).alias("first"))),
        F.transform(F.array_distinct(g), lambda x: F.struct(x.alias("ngram"), F.lit(0).alias("tf"), F.lit(1).alias("first"))),
    )), F.lit(0))
    tokens = explode_rows(df, [label], once, "g").select(label, "g.*")
    vocab = tokens.groupBy("ngram").agg(
        F.sum("first").alias("df"),
        F.sum(F.when(F.col(label) == "TRUE", F.col("tf")).otherwise(0)).alias("true_count"),
        F.sum(F.when(F.col(label) == "FALSE", F.col("tf")).otherwise(0)).alias("false_count"),
    )
    vocab = vocab.filter(F.col("df") >= min_df)
    if max_features is not None:
        vocab = most_frequent(vocab.withColumn("total", F.col("true_count") + F.col("false_count")), "total", "ngram", max_features)
    kept = vocab
    sums = kept.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("true_count").alias("t"), F.sum("false_count").alias("f")).alias("sums")).scalar()
    tt, ft = sums["t"] + alpha * sums["n"], sums["f"] + alpha * sums["n"]
    odds = F.log((F.col("true_count") + alpha) / tt) - F.log((F.col("false_count") + alpha) / ft)
    return kept.select("ngram", "true_count", "false_count", odds.alias("log_odds_true_minus_false"))


def top_each_direction(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """The n highest and the n lowest rows, with a direction column."""
    hi = df.orderBy(F.desc(value), tie).limit(n).withColumn("direction", F.lit("TRUE"))
    lo = df.orderBy(F.asc(value), tie).limit(n).withColumn("direction", F.lit("FALSE"))
    return hi.unionByName(lo)


# --- counts -----------------------------------------------------------------------


def token_counts(df: DataFrame, tokens: Column) -> DataFrame:
    return explode_rows(df, [], tokens, "token").groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count"))


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(str(v)) for v in values])


def enrichment(df: DataFrame, family: str, label: str, value: str) -> DataFrame:
    """Share of a family among rows of one label against its share among the rest."""
    counts = df.groupBy(family).agg(
        F.count_if(F.col(label) == value).alias("label_count"), F.count_if(F.col(label) != value).alias("other_count")
    )
    everything = Window.partitionBy(F.lit(0))  # one row per family
    share = F.col("label_count") / F.greatest(F.sum("label_count").over(everything), F.lit(1))
    other = F.col("other_count") / F.greatest(F.sum("other_count").over(everything), F.lit(1))
    out = counts.withColumn("label_share", share).withColumn("other_share", other)
    return out.withColumn("enrichment", F.col("label_share") / F.greatest(F.col("other_share"), F.lit(1e-9)))


def reason_counts(df: DataFrame, reason: str) -> DataFrame:
    """Counts of single reasons (split on +) and of exact reason strings."""
    kinds = F.concat(
        F.transform(F.split(reason, r"\+"), lambda r: F.struct(F.lit("token").alias("kind"), r.alias("reason"))),
        F.array(F.struct(F.lit("exact").alias("kind"), F.col(reason).alias("reason"))),
    )
    return df.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.reason").agg(F.count(F.lit(1)).alias("row_count"))


def label_share(df: DataFrame, label: str, prob: str) -> DataFrame:
    """Rows, percentage, mean probability per label, and the majority percentage."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("row_count"), F.avg(prob).alias("mean_prob"))
    everything = Window.partitionBy(F.lit(0))  # one row per label
    pct = 100.0 * F.col("row_count") / F.sum("row_count").over(everything)
    return counts.withColumn("pct", pct).withColumn("majority_pct", F.max("pct").over(everything))


def zscore(df: DataFrame, features: list[str]) -> DataFrame:
    """Standardise with the population deviation; near-constant features keep their scale, all-null ones stay null."""
    stats = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    scaled = {f: (F.col(f) - F.lit(stats[f"m_{f}"])) / (stats[f"s_{f}"] if (stats[f"s_{f}"] or 0.0) >= 1e-6 else 1.0) for f in features}
    return df.withColumns(scaled)
