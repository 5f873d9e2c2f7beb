"""Data-quality checks and profiling.  Every check is one aggregate pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from convosieve.functions import lexicons as lex
from convosieve.functions import text as T


def missing_columns(df: DataFrame, required) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required, name: str = "table") -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{name} is missing required columns: {missing}")
    return df


def row_count_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_rows, right_rows, equal) of two tables."""
    tagged = left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(F.lit(0), F.lit(1)))
    sums = tagged.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"))
    return sums.withColumn("equal", F.col("left_rows") == F.col("right_rows"))


def bad_prob(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | F.isnan(c) | (c < 0) | (c > 1)


def prob_range_check(df: DataFrame, prob: str) -> DataFrame:
    c = F.col(prob)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(c.isNull() | F.isnan(c)).alias("missing_rows"),
        F.count_if((c < 0) | ((c > 1) & ~F.isnan(c))).alias("out_of_range_rows"),
    )


def text_alignment(left: DataFrame, right: DataFrame, id_col: str = "doc_id", text: str = "text", min_rate: float = 0.995) -> DataFrame:
    """Match rate of normalised texts by key, the first mismatching key, and whether the rate suffices.

    Texts are compared by hash, so only (key, hash) is shuffled.
    """
    digest = F.sha2(T.normalize_text(text), 256)
    a = left.select(id_col, digest.alias("_a"))
    b = right.select(id_col, digest.alias("_b"))
    same = F.col("_a").eqNullSafe(F.col("_b"))
    got = a.join(b, id_col, "full_outer").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(same).alias("matched"),
        F.min(F.when(~same, F.col(id_col))).alias("first_mismatch"),
    )
    rate = F.col("matched") / F.greatest(F.col("row_count"), F.lit(1))
    return got.withColumn("match_rate", rate).withColumn("aligned", rate >= min_rate)


def label_domain_check(df: DataFrame, label: str = "label") -> DataFrame:
    norm = T.normalize_label(label)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(norm == "TRUE").alias("true_rows"),
        F.count_if(norm == "FALSE").alias("false_rows"),
        F.count_if(norm.isNull()).alias("invalid_rows"),
    )


def id_like_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.lower() == "id" or c.lower().endswith("_id")]


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: name, type, null count (a single aggregate)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col(f"n{i}").alias("null_count"))
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def duplicate_profile(df: DataFrame) -> DataFrame:
    """Row count, surplus exact copies, and surplus occurrences per id-like column.

    Rows and ids are counted through grouped hashes, so hot duplicates combine map-side.
    """
    row_hash = df.select(F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256).alias("v"), F.lit("duplicate_rows").alias("metric"))
    parts = [row_hash]
    for c in id_like_columns(df):
        parts.append(df.select(F.sha2(F.col(c).cast("string"), 256).alias("v"), F.lit(f"duplicate_ids:{c}").alias("metric")))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    per_value = stacked.groupBy("metric", "v").agg(F.count(F.lit(1)).alias("c"))
    return per_value.groupBy("metric").agg(
        F.sum("c").alias("row_count"), (F.sum("c") - F.count(F.lit(1))).alias("duplicates")
    )


def text_like_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(h in c.lower() for h in lex.TEXT_NAME_HINTS)]


def infer_text_column(df: DataFrame, label: str | None = None) -> str:
    """By priority name, else the only other column, else the first string column."""
    for c in lex.TEXT_COLUMN_PRIORITY:
        if c in df.columns and c != label:
            return c
    rest = [f for f in df.schema.fields if f.name != label]
    if len(rest) == 1:
        return rest[0].name
    for f in rest:
        if isinstance(f.dataType, StringType):
            return f.name
    raise ValueError(f"cannot infer a text column from {df.columns}")


def value_types(df: DataFrame, column: str) -> DataFrame:
    """How many values parse as which JSON type."""
    v = F.try_parse_json(F.col(column))
    kind = F.coalesce(F.schema_of_variant(v), F.lit("unparsed"))
    kind = F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").otherwise(kind)
    return df.groupBy(kind.alias("value_type")).agg(F.count(F.lit(1)).alias("row_count"))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and percentage (4 digits) per normalised label; unknown spellings and nulls are kept."""
    counts = df.groupBy(T.normalize_label(label, unknown="keep").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    # A handful of labels: the total is a window over the counts.
    from pyspark.sql import Window

    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percentage", F.round(F.col("count") / total * 100, 4))


def coverage_report(train: DataFrame, test: DataFrame, template: DataFrame, label: str = "label") -> DataFrame:
    """Cross-check of the three inputs: row counts, label presence, row parity."""
    tagged = (
        train.select(F.lit("train").alias("t")).unionAll(test.select(F.lit("test"))).unionAll(template.select(F.lit("template")))
    )
    counts = tagged.agg(*[F.count_if(F.col("t") == n).alias(f"{n}_rows") for n in ("train", "test", "template")])
    return counts.select(
        "*",
        F.lit(label in train.columns).alias("train_has_label"),
        F.lit(label in test.columns).alias("test_has_label"),
        (F.col("template_rows") == F.col("test_rows")).alias("template_matches_test"),
        F.lit(",".join(template.columns)).alias("template_columns"),
    )


def label_diff(original: DataFrame, regenerated: DataFrame, id_col: str = "doc_id", label: str = "label", show: int = 20) -> dict[str, DataFrame]:
    """Reproducibility check of two label tables: summary row and the first differing keys."""
    a = original.select(id_col, T.normalize_label(label).alias("original_label"))
    b = regenerated.select(id_col, T.normalize_label(label).alias("regenerated_label"))
    both = a.join(b, id_col, "full_outer")
    differs = ~F.col("original_label").eqNullSafe(F.col("regenerated_label"))
    summary = both.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(differs).alias("differing_rows"),
        (F.count_if(differs) == 0).alias("exact_match"),
        *[
            F.count_if(F.col(f"{side}_label") == v).alias(f"{side}_{v}")
            for side in ("original", "regenerated")
            for v in ("TRUE", "FALSE")
        ],
    )
    return {"summary": summary, "first": both.filter(differs).orderBy(id_col).limit(show)}
