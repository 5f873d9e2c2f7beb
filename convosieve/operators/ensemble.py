"""Blends, hard-label votes, rank ensembles, swaps, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convosieve.functions import lexicons as lex
from convosieve.functions.scalar import r6
from convosieve.operators.labeling import apply_threshold
from convosieve.operators.ranking import add_rank, percentile_rank, rank_columns
from convosieve.operators.stats import stack


def blend(a, b, weight: float) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.lit(weight) * a + F.lit(1.0 - weight) * b


def blend_grid(df: DataFrame, a: str, b: str, weights=None, thresholds=None) -> DataFrame:
    """Manifest of every weight and threshold: predicted counts, in one aggregate."""
    grid = [(w, t) for w in (weights or lex.BLEND_WEIGHTS) for t in (thresholds or lex.BLEND_THRESHOLDS)]
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(blend(a, b, w) >= t).alias(f"c{i}") for i, (w, t) in enumerate(grid)])
    return stack(one, [
        {
            "first_weight": F.lit(w), "second_weight": F.round(F.lit(1.0 - w), 6), "threshold": F.lit(t),
            "pred_TRUE": F.col(f"c{i}"), "pred_FALSE": F.col("n") - F.col(f"c{i}"),
        }
        for i, (w, t) in enumerate(grid)
    ])


def named_blends(df: DataFrame, a: str, b: str, candidates=None, base_threshold: float = 0.32) -> DataFrame:
    """Named weight/threshold candidates with rows changed against each source alone."""
    cands = candidates or lex.NAMED_BLENDS
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (_, w, t) in enumerate(cands):
        hit = blend(a, b, w) >= t
        aggs += [
            F.count_if(hit).alias(f"c{i}"),
            F.count_if(hit != (F.col(a) >= base_threshold)).alias(f"a{i}"),
            F.count_if(hit != (F.col(b) >= base_threshold)).alias(f"b{i}"),
        ]
    return stack(df.agg(*aggs), [
        {
            "candidate": F.lit(name), "first_weight": F.lit(w), "threshold": F.lit(t), "pred_TRUE": F.col(f"c{i}"),
            "pred_FALSE": F.col("n") - F.col(f"c{i}"), "changed_vs_first": F.col(f"a{i}"), "changed_vs_second": F.col(f"b{i}"),
        }
        for i, (name, w, t) in enumerate(cands)
    ])


def two_run_blend(df: DataFrame, main: str, other: str, weights=None, threshold: float = 0.32) -> DataFrame:
    """Blend of two runs: distribution, rows changed against each run, mean and largest score gap."""
    ws = weights or lex.TWO_RUN_WEIGHTS
    gap = F.abs(F.col(main) - F.col(other))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(gap).alias("avg_gap"), F.max(gap).alias("max_gap")]
    for i, w in enumerate(ws):
        hit = blend(main, other, w) >= threshold
        aggs += [
            F.count_if(hit).alias(f"c{i}"),
            F.count_if(hit != (F.col(main) >= threshold)).alias(f"m{i}"),
            F.count_if(hit != (F.col(other) >= threshold)).alias(f"o{i}"),
        ]
    return stack(df.agg(*aggs), [
        {
            "main_weight": F.lit(w), "other_weight": F.round(F.lit(1.0 - w), 6), "pred_TRUE": F.col(f"c{i}"),
            "pred_FALSE": F.col("n") - F.col(f"c{i}"), "changed_vs_main": F.col(f"m{i}"), "changed_vs_other": F.col(f"o{i}"),
            "avg_abs_delta": F.col("avg_gap"), "max_abs_delta": F.col("max_gap"),
        }
        for i, w in enumerate(ws)
    ])


def vote(df: DataFrame, anchor: str, other: str) -> DataFrame:
    """Hard-label OR, AND and anchor-on-tie votes."""
    a, b = F.col(anchor), F.col(other)
    return df.withColumns({
        "vote_or": F.when((a == "TRUE") | (b == "TRUE"), "TRUE").otherwise("FALSE"),
        "vote_and": F.when((a == "TRUE") & (b == "TRUE"), "TRUE").otherwise("FALSE"),
        "vote_anchor": a,
        "agree": a == b,
    })


def vote_report(voted: DataFrame) -> DataFrame:
    one = voted.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("agree").alias("agree"),
        *[F.count_if(F.col(c) == "TRUE").alias(c) for c in ("vote_or", "vote_and", "vote_anchor")],
    )
    return stack(one, [
        {
            "rule": F.lit(c), "pred_TRUE": F.col(c), "pred_FALSE": F.col("n") - F.col(c), "agree_count": F.col("agree"),
            "disagree_count": F.col("n") - F.col("agree"), "agree_ratio": F.try_divide(F.col("agree").cast("double"), F.col("n")),
        }
        for c in ("vote_or", "vote_and", "vote_anchor")
    ])


# --- rank ensembles ---------------------------------------------------------------


def normalize_weights(weights: dict[str, float], available) -> dict[str, float]:
    """Positive weights of the available sources, scaled to sum to 1."""
    kept = {k: float(v) for k, v in weights.items() if k in set(available) and v > 0}
    total = sum(kept.values())
    if total <= 0:
        raise ValueError("no positive weight left over the available sources")
    return {k: v / total for k, v in kept.items()}


def rank_ensemble(long: DataFrame, recipes: dict[str, dict[str, float]], id_col: str = "doc_id") -> DataFrame:
    """(id, recipe, score): weighted percentile ranks of the sources of each recipe.

    ``long`` is (id, source, prob).  Ranks are taken per source, then one aggregate by id
    produces every recipe at once.
    """
    ranked = percentile_rank(long, "prob", id_col, "source", "pct_rank")
    aggs = []
    for name, weights in recipes.items():
        part = F.lit(0.0)
        for source, w in weights.items():
            part = F.when(F.col("source") == source, F.col("pct_rank") * w).otherwise(part)
        aggs.append(F.round(F.sum(part), 12).alias(name))
    wide = ranked.groupBy(id_col).agg(*aggs)
    return wide.unpivot([F.col(id_col)], [F.col(r) for r in recipes], "recipe", "score")


def ensemble_manifest(scores: DataFrame, anchor: DataFrame, counts: list[int], id_col: str = "doc_id") -> DataFrame:
    """Per recipe and count: changed rows against the anchor labels and anchor scores of the selected rows.

    ``anchor`` is (id, anchor_prob, anchor_rank, anchor_label).
    """
    ranked = add_rank(scores, "score", id_col, "recipe", descending=True, out="_pos").join(anchor, id_col)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("anchor_label") == "TRUE").alias("anchor_true_count")]
    for k in counts:
        sel = F.col("_pos") <= k
        aggs += [
            F.count_if(sel).alias(f"c{k}"),
            F.count_if(sel != (F.col("anchor_label") == "TRUE")).alias(f"d{k}"),
            F.avg(F.when(sel, F.col("anchor_prob"))).alias(f"mp{k}"),
            F.min(F.when(sel, F.col("anchor_prob"))).alias(f"np{k}"),
            F.avg(F.when(sel, F.col("anchor_rank"))).alias(f"mr{k}"),
        ]
    one = ranked.groupBy("recipe").agg(*aggs)
    return stack(one, [
        {
            "true_count": F.col(f"c{k}"), "false_count": F.col("n") - F.col(f"c{k}"), "requested": F.lit(k),
            "anchor_true_count": F.col("anchor_true_count"), "changed_vs_anchor": F.col(f"d{k}"),
            "mean_anchor_prob": F.col(f"mp{k}"), "min_anchor_prob": F.col(f"np{k}"), "mean_anchor_rank": F.col(f"mr{k}"),
        }
        for k in counts
    ], ["recipe"])


def source_summary(long: DataFrame) -> DataFrame:
    """(source, rows, min, mean, p95, max)."""
    from convosieve.operators.ranking import quantiles_wide

    base = long.groupBy("source").agg(
        F.count("prob").alias("row_count"), F.min("prob").alias("min"), F.avg("prob").alias("mean"), F.max("prob").alias("max")
    )
    return base.join(quantiles_wide(long, {"p95": ("prob", 0.95)}, ["source"]), "source")


def rank_blends(df: DataFrame, a: str, b: str, weights=None, id_col: str = "doc_id") -> DataFrame:
    """Percentile ranks of two scores and their weighted blends (one column per weight)."""
    ranked = rank_columns(df, [a, b], "percentile", id_col)
    cols = {
        f"rank_blend_{int(round(w * 100)):03d}": F.round(w * F.col(f"{a}_rank") + (1.0 - w) * F.col(f"{b}_rank"), 12)
        for w in (weights or lex.RANK_BLEND_WEIGHTS)
    }
    return ranked.withColumns(cols)


# --- swaps and routing ------------------------------------------------------------


def swap_scores(df: DataFrame, anchor: str, signals: dict[str, float], id_col: str = "doc_id") -> DataFrame:
    """Consensus rank of the secondary signals and the two directional swap scores."""
    ranked = rank_columns(df, [anchor, *signals], "rank01", id_col)
    total = sum(signals.values())
    consensus = sum((F.col(f"{s}_rank") * w for s, w in signals.items()), F.lit(0.0)) / max(total, 1e-9)
    cols = [F.col(s) for s in signals]
    mean = sum(cols[1:], cols[0]) / len(cols)
    hi = F.greatest(*cols) if len(cols) > 1 else cols[0]
    lo = F.least(*cols) if len(cols) > 1 else cols[0]
    out = ranked.withColumns({"consensus_true_rank": consensus, "anchor_rank": F.col(f"{anchor}_rank"), "mean_secondary": mean, "max_secondary": hi, "min_secondary": lo})
    out = out.withColumns({
        "false_to_true_score": F.round(
            0.45 * F.col("consensus_true_rank") + 0.25 * F.col("anchor_rank") + 0.20 * F.col("mean_secondary") + 0.10 * F.col("max_secondary"), 12
        ),
        "true_to_false_score": F.round(
            0.45 * (1.0 - F.col("consensus_true_rank")) + 0.30 * (1.0 - F.col("anchor_rank"))
            + 0.15 * (1.0 - F.col("mean_secondary")) + 0.10 * (1.0 - F.col("min_secondary")), 12
        ),
    })
    return out.drop(*[f"{s}_rank" for s in [anchor, *signals]])


def balanced_swaps(scored: DataFrame, base_label: str, counts: list[int], id_col: str = "doc_id") -> dict[str, DataFrame]:
    """Swap the n best candidates in each direction, so the TRUE count never changes."""
    score = F.when(F.col(base_label) == "FALSE", F.col("false_to_true_score")).otherwise(F.col("true_to_false_score"))
    ranked = add_rank(scored.withColumn("swap_score", score), "swap_score", id_col, base_label, True, "swap_rank", "side_rows")
    smaller = scored.groupBy(base_label).agg(F.count(F.lit(1)).alias("c")).agg(F.min("c")).first()[0]
    usable = [n for n in counts if n <= smaller]
    actions = {
        f"swap_{n:02d}_action": F.when(F.col("swap_rank") > n, "keep")
        .when(F.col(base_label) == "FALSE", "FALSE_to_TRUE")
        .otherwise("TRUE_to_FALSE")
        for n in usable
    }
    diagnostics = ranked.withColumns(actions)
    is_false = F.col(base_label) == "FALSE"
    aggs = [F.count_if(~is_false).alias("base_true"), F.count(F.lit(1)).alias("n")]
    for n in usable:
        hit = F.col("swap_rank") <= n
        aggs += [
            F.count_if(hit & is_false).alias(f"u{n}"), F.count_if(hit & ~is_false).alias(f"d{n}"),
            F.avg(F.when(hit & is_false, F.col("swap_score"))).alias(f"mu{n}"),
            F.avg(F.when(hit & ~is_false, F.col("swap_score"))).alias(f"md{n}"),
        ]
    manifest = stack(ranked.agg(*aggs), [
        {
            "swap_count": F.lit(n), "total_changed": F.col(f"u{n}") + F.col(f"d{n}"),
            "pred_TRUE": F.col("base_true") + F.col(f"u{n}") - F.col(f"d{n}"),
            "pred_FALSE": F.col("n") - F.col("base_true") - F.col(f"u{n}") + F.col(f"d{n}"),
            "mean_false_to_true_score": r6(F.col(f"mu{n}")), "mean_true_to_false_score": r6(F.col(f"md{n}")),
        }
        for n in usable
    ])
    return {"diagnostics": diagnostics, "manifest": manifest}


def route(df: DataFrame, base: str, specialist: str, base_threshold: float, specialist_threshold: float, bands=None) -> DataFrame:
    """One row per input row and band: which model decided, and the final label."""
    bands = bands or lex.ROUTER_BANDS
    for lo, hi in bands:
        if lo >= hi:
            raise ValueError(f"invalid band: {lo}, {hi}")
    name = lambda lo, hi: f"low_{lo:.2f}_high_{hi:.2f}".replace(".", "p")
    items = F.array(*[F.struct(F.lit(name(lo, hi)).alias("route_band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in bands])
    rows = df.withColumn("_b", F.explode(items)).select(*df.columns, "_b.*")
    used = (
        F.when(F.col(base) < F.col("lo"), "base_low_confident_FALSE")
        .when(F.col(base) > F.col("hi"), "base_high_confident_TRUE")
        .otherwise("specialist_uncertain_band")
    )
    final = F.when(F.col("route_used") == "specialist_uncertain_band", apply_threshold(specialist, specialist_threshold)).otherwise(
        apply_threshold(base, base_threshold)
    )
    return rows.withColumn("route_used", used).withColumn("final_label", final)


def route_summary(routed: DataFrame, base: str, base_threshold: float) -> DataFrame:
    u = F.col("route_used")
    return routed.groupBy("route_band", "lo", "hi").agg(
        F.count_if(u == "base_low_confident_FALSE").alias("base_low_rows"),
        F.count_if(u == "base_high_confident_TRUE").alias("base_high_rows"),
        F.count_if(u == "specialist_uncertain_band").alias("specialist_rows"),
        F.count_if(F.col("final_label") == "TRUE").alias("pred_TRUE"),
        F.count_if(F.col("final_label") == "FALSE").alias("pred_FALSE"),
        F.count_if(F.col("final_label") != apply_threshold(base, base_threshold)).alias("changed_vs_base"),
    )
