"""Single-feature patterns and two-feature rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convosieve.functions.scalar import two_sided_p
from convosieve.operators.ranking import exact_quantiles
from convosieve.operators.stats import melt

# Percentile patterns and the quantile-bin edges.
EDGE_PATTERNS = {"lte_p05": 0.05, "lte_p10": 0.10, "gte_p90": 0.90, "gte_p95": 0.95}
BIN_EDGES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def primitive_patterns(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, pattern_id, lo, lo_open, hi): membership is lo < v <= hi, or lo <= v <= hi when not lo_open.

    Built on the driver from one small table of exact quantiles (a dozen numbers per feature).
    """
    probs = sorted({*EDGE_PATTERNS.values(), *BIN_EDGES})
    q: dict[str, dict[float, float]] = {}
    for r in exact_quantiles(df, features, probs).collect():
        q.setdefault(r["feature"], {})[r["prob"]] = r["value"]
    inf = float("inf")
    rows = []
    for f in features:
        at = q.get(f)
        # A (nearly) constant feature has no patterns.
        if not at or at[1.0] - at[0.0] < 1e-12:
            continue
        for name, p in EDGE_PATTERNS.items():
            rows.append((f, f"{f}__{name}", *((-inf, False, at[p]) if name.startswith("lte") else (at[p], False, inf))))
        if at[0.0] <= 0 <= at[1.0]:
            rows.append((f, f"{f}__gt_0", 0.0, True, inf))
            rows.append((f, f"{f}__eq_0", 0.0, False, 0.0))
        edges = sorted({at[p] for p in BIN_EDGES})
        # Right-closed bins; the first one also holds the minimum.
        for i in range(len(edges) - 1):
            rows.append((f, f"{f}__bin_{i + 1}", edges[i], i > 0, edges[i + 1]))
    schema = "feature string, pattern_id string, lo double, lo_open boolean, hi double"
    return df.sparkSession.createDataFrame(rows, schema)


def membership(df: DataFrame, features: list[str], patterns: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., pattern_id): the patterns each row meets (a broadcast join on the feature name)."""
    long = melt(df, features, keep)
    hit = long.join(F.broadcast(patterns), "feature")  # a dozen rows per feature
    inside = ((F.col("value") > F.col("lo")) | (~F.col("lo_open") & (F.col("value") == F.col("lo")))) & (F.col("value") <= F.col("hi"))
    return hit.filter(inside).select(*keep, "pattern_id")


def pattern_stats(counts: DataFrame, total: int, total_true: int) -> DataFrame:
    """Support, rates, lifts, purity, z, p and log-odds ratio from (support_count, true_count)."""
    base = total_true / total
    s, t = F.col("support_count"), F.col("true_count")
    f = s - t
    out = counts.withColumns({
        "false_count": f, "support_pct": s / total, "true_rate": t / s, "false_rate": f / s, "base_true_rate": F.lit(base),
    })
    tr, fr = F.col("true_rate"), F.col("false_rate")
    se = F.sqrt(F.greatest(F.lit(base * (1 - base)) / s, F.lit(1e-12)))
    t_out = F.lit(total_true) - t
    f_out = F.lit(total - total_true) - F.col("false_count")
    odds = F.log(((t + 0.5) * (f_out + 0.5)) / ((F.col("false_count") + 0.5) * (t_out + 0.5)))
    out = out.withColumns({
        "lift_TRUE": tr / base if base > 0 else F.lit(0.0),
        "lift_FALSE": fr / (1 - base) if base < 1 else F.lit(0.0),
        "purity": F.greatest(tr, fr),
        "direction": F.when(tr >= base, "TRUE").otherwise("FALSE"),
        "z_score": (tr - base) / se,
        "log_odds_ratio_vs_rest": odds,
        "abs_log_odds_ratio": F.abs(odds),
    })
    out = out.withColumn("approx_p_value", two_sided_p("z_score"))
    return out.withColumn("confidence", 1.0 - F.least(F.greatest(F.col("approx_p_value"), F.lit(0.0)), F.lit(1.0)))


def score_patterns(df: DataFrame, features: list[str], patterns: DataFrame, y: str = "y", min_support: int = 80, min_class: int = 10) -> DataFrame:
    n, nt = df.agg(F.count(F.lit(1)), F.sum(y)).first()
    counts = membership(df, features, patterns, [y]).groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("support_count"), F.sum(y).alias("true_count")
    )
    counts = counts.filter(
        (F.col("support_count") >= min_support)
        & ((F.col("true_count") >= min_class) | (F.col("support_count") - F.col("true_count") >= min_class))
    )
    scored = pattern_stats(counts, n, nt or 0)
    return scored.join(F.broadcast(patterns.select("pattern_id", "feature")), "pattern_id")


def strong_patterns(scored: DataFrame, min_true: int = 40, min_false: int = 80, min_false_rate: float = 0.85, p_max: float = 0.01) -> DataFrame:
    """Significant patterns with a practical lift in their direction."""
    base = F.col("base_true_rate")
    strong_true = (F.col("direction") == "TRUE") & (F.col("true_rate") >= F.greatest(base + 0.08, base * 1.30)) & (F.col("true_count") >= min_true)
    strong_false = (F.col("direction") == "FALSE") & (F.col("false_rate") >= min_false_rate) & (F.col("false_count") >= min_false)
    return scored.filter((F.col("approx_p_value") <= p_max) & (strong_true | strong_false)).orderBy(
        "direction", F.desc("abs_log_odds_ratio"), F.desc("support_count"), "pattern_id"
    )


def combined_rules(
    df: DataFrame, features: list[str], patterns: DataFrame, strong: DataFrame, y: str = "y", id_col: str = "doc_id", top: int = 80,
    min_support: int = 80, min_true: int = 40, min_false: int = 80, true_purity: float = 0.50, false_purity: float = 0.90, p_max: float = 0.01,
) -> DataFrame:
    """Conjunctions of two strong patterns on different features.

    Rows are first reduced to their membership signature over the (at most ``top``)
    candidates, and pairs are formed once per distinct signature rather than per row.
    """
    # Log-odds are rounded so that equal counts tie exactly and the id decides.
    chosen = strong.orderBy(F.round("abs_log_odds_ratio", 9).desc(), "pattern_id").limit(top).select("pattern_id").collect()
    order = {r["pattern_id"]: i for i, r in enumerate(chosen)}
    n, nt = df.agg(F.count(F.lit(1)), F.sum(y)).first()
    spark = df.sparkSession
    cand = patterns.join(
        F.broadcast(spark.createDataFrame(list(order.items()), "pattern_id string, ord int")), "pattern_id"
    ).persist()
    hits = membership(df, features, cand.drop("ord"), [id_col, y]).join(F.broadcast(cand.select("pattern_id", "ord", "feature")), "pattern_id")
    signature = hits.groupBy(id_col, y).agg(F.sort_array(F.collect_list(F.struct("ord", "pattern_id", "feature"))).alias("sig"))
    per_sig = signature.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.sum(y).alias("ct"))
    # a signature holds at most ``top`` entries
    pairs = per_sig.select("c", "ct", "sig", F.explode("sig").alias("a")).select("c", "ct", "a", F.explode("sig").alias("b"))
    pairs = pairs.filter((F.col("a.ord") < F.col("b.ord")) & (F.col("a.feature") != F.col("b.feature")))
    counts = pairs.groupBy(F.col("a.pattern_id").alias("first_pattern"), F.col("b.pattern_id").alias("second_pattern")).agg(
        F.sum("c").alias("support_count"), F.sum("ct").alias("true_count")
    ).filter(F.col("support_count") >= min_support)
    scored = pattern_stats(counts, n, nt or 0)
    good_true = (F.col("direction") == "TRUE") & (F.col("true_rate") >= true_purity) & (F.col("true_count") >= min_true)
    good_false = (F.col("direction") == "FALSE") & (F.col("false_rate") >= false_purity) & (F.col("false_count") >= min_false)
    return scored.filter((F.col("approx_p_value") <= p_max) & (good_true | good_false)).orderBy(
        "direction", F.desc("abs_log_odds_ratio"), F.desc("support_count"), "first_pattern", "second_pattern"
    )
