"""Global ranks and exact quantiles without a single-partition sort.

A global order is cut into buckets that are a pure function of the value, so a
recomputed task always agrees with the first run:

1. bucket bounds come from a bounded quantile sketch, collected to the driver
   (at most a few thousand doubles) and embedded as a literal;
2. a value equal to a bound gets a bucket of its own, and inside that bucket rows
   are spread further by id range, so one value holding a third of all rows is
   still many tasks;
3. rank = rows in earlier buckets (a table with one row per bucket) + row number
   inside the bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convosieve.functions.scalar import let

_ACC = 10000


def bucket_count(df: DataFrame) -> int:
    want = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    size = 16
    while size < min(want, 4096):
        size *= 2
    return size


def _bounds(df: DataFrame, group: str | None, value: Column, n: int, id_value: Column | None = None) -> tuple[dict, list]:
    """Quantile bounds of the value per group and, in the same pass, 63 bounds of the id."""
    probs = [i / n for i in range(1, n)]
    keyed = df.select(
        (F.col(group) if group else F.lit("all")).cast("string").alias("g"), value.alias("v"),
        (id_value if id_value is not None else F.lit(0.0)).alias("i"),
    )
    rows = keyed.groupBy("g").agg(
        F.percentile_approx("v", probs, max(_ACC, 10 * n)).alias("b"), F.percentile_approx("i", [k / 64 for k in range(1, 64)], 1000).alias("ib")
    ).collect()
    ids = sorted({float(x) for r in rows for x in (r["ib"] or [])})
    step = max(1, -(-len(ids) // 63))
    return {r["g"]: list(r["b"] or []) for r in rows}, ids[::step] or [0.0]


def _search(bounds: Column, size: int, v: Column) -> Column:
    """Number of sorted bounds strictly below v, by binary lifting over a literal array."""
    steps = []
    s = size
    while s >= 1:
        steps.append(s)
        s //= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda acc, step: F.when(F.get(bounds, acc + step - 1) < v, acc + step).otherwise(acc),
    )


def _bucket(df: DataFrame, group: str | None, value: Column, n: int, id_value: Column | None = None) -> tuple[Column, dict, list]:
    """Bucket number (even: between bounds, odd: equal to a bound), the repeated bounds per group, the id bounds."""
    found, ids = _bounds(df, group, value, n, id_value)
    distinct = {g: sorted({float(x) for x in b}) for g, b in found.items()}
    hot = {g: sorted({float(x) for x in b if b.count(x) > 1}) for g, b in found.items()}
    if not distinct:
        return F.lit(0), hot, ids
    key = (F.col(group) if group else F.lit("all")).cast("string")
    arr = F.element_at(F.create_map(*[F.lit(x) for g, b in distinct.items() for x in (g, b or [0.0])]), key)
    pos = _search(arr, n, value)
    return let(F.struct(arr.alias("a"), pos.alias("p")), lambda s: 2 * s["p"] + F.when(F.get(s["a"], s["p"]) == value, 1).otherwise(0)), hot, ids


def add_rank(
    df: DataFrame,
    value: Column | str,
    id_col: str = "doc_id",
    group: str | None = None,
    descending: bool = False,
    out: str = "position",
    total: str | None = None,
) -> DataFrame:
    """Ordinal rank 1..n by (value, id), over the table or inside each value of a low-cardinality column."""
    v = F.col(value) if isinstance(value, str) else value
    v = (-v if descending else v).cast("double")
    n = bucket_count(df)
    src = df.withColumn("_v", v)
    bucket, _, id_bounds = _bucket(src, group, F.col("_v"), n, F.col(id_col).cast("double"))
    id_part = _search(F.lit(id_bounds), 64, F.col(id_col).cast("double"))
    src = src.withColumn("_b", bucket).withColumn("_s", F.when(F.col("_b") % 2 == 1, id_part).otherwise(0))
    return _finish(src, [F.col("_v").asc(), F.col(id_col).asc()], group, ["_b", "_s"], out, total).drop("_v")


def occurrence_number(df: DataFrame, keys: list[str], id_col: str = "doc_id", out: str = "occurrence") -> DataFrame:
    """0-based occurrence of each row within its key, in id order.

    Rows of one key are spread over id ranges, so a group of copies that holds a third
    of the table is still many tasks.  Pass short keys (hash long texts first).
    """
    _, bounds = _bounds(df, None, F.lit(0.0), 2, F.col(id_col).cast("double"))
    src = df.withColumn("_s", _search(F.lit(bounds), 64, F.col(id_col).cast("double")))
    ranked = _finish(src, [F.col(id_col).asc()], keys, ["_s"], out, None)
    return ranked.withColumn(out, F.col(out) - 1)


def hash_order(id_col: str = "doc_id", seed: int = 42) -> Column:
    """Deterministic pseudo-random order key: the same row gets the same key on every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def add_hash_rank(
    df: DataFrame, id_col: str = "doc_id", group: str | None = None, seed: int = 42, out: str = "position",
    total: str | None = None,
) -> DataFrame:
    """Ordinal rank in hash order; the leading hex digits are evenly spread, so they are the buckets."""
    width = 2 if bucket_count(df) <= 256 else 3
    src = df.withColumn("_h", hash_order(id_col, seed)).withColumn("_b", F.substring("_h", 1, width))
    return _finish(src, [F.col("_h").asc(), F.col(id_col).asc()], group, ["_b"], out, total).drop("_h")


def _finish(src: DataFrame, order: list, group, keys: list[str], out: str, total: str | None) -> DataFrame:
    group = [group] if isinstance(group, str) else list(group or [])
    part = group + keys
    counts = src.groupBy(*part).agg(F.count(F.lit(1)).alias("_c"))
    # One row per bucket: this window never sees corpus-sized data.
    over_group = Window.partitionBy(*(group or [F.lit(0)]))
    before = over_group.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *part,
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(over_group).alias("_total"),
    )
    local = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    joined = _null_safe_join(src, counts, part)
    ranked = joined.withColumn(out, (local + F.col("_before")).cast("long"))
    if total:
        ranked = ranked.withColumn(total, F.col("_total").cast("long"))
    return ranked.drop("_before", "_total", *keys)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, cond).drop(*[f"_r_{k}" for k in keys])


def average_rank_table(
    df: DataFrame, value: str, group: str | None = None, aggs: list[Column] | None = None
) -> tuple[DataFrame, dict]:
    """One row per distinct value: (group, _v, avg_rank, rank_n, extra aggregates), and the hot values.

    Ties collapse before ranking, so a value that holds a third of the rows is one row here.
    """
    n = bucket_count(df)
    src = df.withColumn("_v", F.col(value).cast("double"))
    bucket, hot, _ = _bucket(src, group, F.col("_v"), n)
    gcols = [group] if group else []
    distinct = src.groupBy(*gcols, "_v").agg(F.count(F.lit(1)).alias("_c"), *(aggs or [])).withColumn("_b", bucket)
    counts = distinct.groupBy(*gcols, "_b").agg(F.sum("_c").alias("_bc"))
    over_group = Window.partitionBy(*(gcols or [F.lit(0)]))
    before = over_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *gcols,
        "_b",
        F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_before"),
        F.sum("_bc").over(over_group).alias("_total"),
    )
    local = F.sum("_c").over(Window.partitionBy(*gcols, "_b").orderBy("_v"))
    ranks = _null_safe_join(distinct, counts, [*gcols, "_b"])
    table = ranks.withColumn("avg_rank", F.col("_before") + local - (F.col("_c") - 1) / 2.0)
    return table.withColumn("rank_n", F.col("_total").cast("long")).drop("_before", "_total", "_b"), hot


def add_average_rank(
    df: DataFrame,
    value: str,
    id_col: str = "doc_id",
    group: str | None = None,
    out: str = "avg_rank",
    total: str = "rank_n",
    salt: int = 16,
) -> DataFrame:
    """Tie-averaged rank 1..n (ascending) on every row."""
    ranks, hot = average_rank_table(df, value, group)
    gcols = [group] if group else []
    ranks = ranks.select(*gcols, "_v", F.col("avg_rank").alias(out), F.col("rank_n").alias(total))
    src = df.withColumn("_v", F.col(value).cast("double"))
    # Values that hold many rows are salted on the way back.
    hot_values = sorted({x for values in hot.values() for x in values})
    is_hot = F.col("_v").isin(hot_values) if hot_values else F.lit(False)
    left = src.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(id_col), F.lit(salt))).otherwise(F.lit(0)).cast("int"))
    fan_out = F.when(is_hot, F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0)))
    right = ranks.withColumn("_salt", F.explode(fan_out))
    return _null_safe_join(left, right, [*gcols, "_v", "_salt"]).drop("_v", "_salt")


def percentile_rank(df: DataFrame, value: str, id_col: str = "doc_id", group: str | None = None, out: str = "pct_rank") -> DataFrame:
    """Average rank divided by n."""
    ranked = add_average_rank(df, value, id_col, group, "_ar", "_rn")
    return ranked.withColumn(out, F.col("_ar") / F.col("_rn")).drop("_ar", "_rn")


def rank01(
    df: DataFrame, value: str, id_col: str = "doc_id", group: str | None = None, out: str = "rank01",
    higher_is_more_true: bool = True,
) -> DataFrame:
    """Ordinal rank scaled to [0, 1]; ties are ordered by id."""
    ranked = add_rank(df, value, id_col, group, not higher_is_more_true, "_pos", "_n")
    scaled = (F.col("_pos") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    return ranked.withColumn(out, scaled).drop("_pos", "_n")


def rank_columns(df: DataFrame, columns: list[str], how: str = "percentile", id_col: str = "doc_id", suffix: str = "_rank") -> DataFrame:
    """Rank several score columns at once: ``percentile`` (tie-averaged) or ``rank01`` (ordinal).

    The columns are ranked together in long form, so the input is read once however many there are.
    """
    items = F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(id_col, F.explode(items).alias("_p")).select(id_col, "_p.source", "_p.v")
    rank = percentile_rank if how == "percentile" else rank01
    ranked = rank(long, "v", id_col, "source", out="_rk")
    wide = ranked.groupBy(id_col).agg(*[F.max(F.when(F.col("source") == c, F.col("_rk"))).alias(f"{c}{suffix}") for c in columns])
    return df.join(wide, id_col)


def most_frequent(df: DataFrame, count: str, key: str, n: int) -> DataFrame:
    """The n rows with the highest count, ties by the MD5 of the key.

    A vocabulary that fits is returned as it is; otherwise rows are ranked in buckets, so no
    task sees the whole vocabulary.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if df.count() <= n:
        return df
    tie = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")
    ranked = add_rank(df.withColumn("_tie", tie), count, "_tie", descending=True, out="_pos")
    return ranked.filter(F.col("_pos") <= n).drop("_pos", "_tie")


# --- exact quantiles --------------------------------------------------------------


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], group: list[str] | None = None, margin: float = 0.002
) -> DataFrame:
    """Exact linearly interpolated quantiles of many columns: (group..., feature, prob, value, n).

    A sketch brackets each wanted quantile (bounded, collected); the second pass counts
    what lies below the bracket and counts per value only inside it, so no task ever
    holds a whole column.
    """
    group = group or []
    probs = list(probs)
    narrow = df.select(*group, *[F.col(c).cast("double").alias(c) for c in columns]).persist(StorageLevel.MEMORY_AND_DISK)
    edges = [x for p in probs for x in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = narrow.groupBy(*group).agg(
        *[F.percentile_approx(c, edges, _ACC).alias(f"e{i}") for i, c in enumerate(columns)],
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(columns)],
    )
    rows = []
    for r in sketch.collect():
        for i, c in enumerate(columns):
            if not r[f"n{i}"]:
                continue
            for j, p in enumerate(probs):
                lo, hi = r[f"e{i}"][2 * j], r[f"e{i}"][2 * j + 1]
                # A small group is its own bracket: the margin must span a few ranks.
                small = r[f"n{i}"] * margin < 20
                lo = r[f"lo{i}"] if small or p - margin <= 0 else lo
                hi = r[f"hi{i}"] if small or p + margin >= 1 else hi
                rows.append((*[r[g] for g in group], i, j, float(lo), float(hi), int(r[f"n{i}"])))
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name in group]
        + ["f int", "q int", "lo double", "hi double", "n long"]
    )
    brackets = narrow.sparkSession.createDataFrame(rows, schema)
    long = narrow.select(*group, F.posexplode(F.array(*[F.col(c) for c in columns])).alias("f", "v")).filter("v is not null")
    per_feature = brackets.groupBy(*group, "f").agg(F.sort_array(F.collect_list(F.struct("q", "lo", "hi", "n"))).alias("br"))
    # At most groups x columns rows, each with one small array.
    hit = _null_safe_join(long, F.broadcast(per_feature), [*group, "f"])
    hit = hit.select(*group, "f", "v", F.explode("br").alias("b")).filter("v <= b.hi")
    counted = hit.groupBy(
        *group, "f", F.col("b.q").alias("q"), F.col("b.n").alias("n"),
        F.when(F.col("v") >= F.col("b.lo"), F.col("v")).alias("vk"),
    ).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*group, "f", "q").orderBy(F.col("vk").asc_nulls_first())
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("q") + 1)
    pos = prob * (F.col("n") - 1)
    cum = counted.withColumn("cum", F.sum("c").over(w)).withColumn("pos", pos)
    cum = cum.withColumn("before", F.col("cum") - F.col("c"))

    def at(idx: Column) -> Column:
        return F.max(F.when((F.col("before") <= idx) & (idx < F.col("cum")), F.col("vk")))

    got = cum.groupBy(*group, "f", "q", "n", "pos").agg(
        at(F.floor(F.col("pos"))).alias("a"), at(F.ceil(F.col("pos"))).alias("b")
    )
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("f") + 1)
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor(F.col("pos")))
    return got.select(
        *group, name.alias("feature"), F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("q") + 1).alias("prob"),
        value.alias("value"), F.col("n").cast("long").alias("n"),
    )


def quantiles_wide(df: DataFrame, specs: dict[str, tuple[str, float]], group: list[str] | None = None) -> DataFrame:
    """One row per group with a named column per (column, probability)."""
    group = group or []
    columns = sorted({c for c, _ in specs.values()})
    probs = sorted({p for _, p in specs.values()})
    long = exact_quantiles(df, columns, probs, group)
    picks = [
        F.max(F.when((F.col("feature") == c) & (F.col("prob") == float(p)), F.col("value"))).alias(name)
        for name, (c, p) in specs.items()
    ]
    return long.groupBy(*group).agg(*picks)
