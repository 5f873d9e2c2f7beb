"""Readers with explicit schemas: JSON lines, CSV tables, score sources, metrics documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convosieve.functions import lexicons as lex
from convosieve.functions import text as T
from convosieve.operators.checks import bad_prob, require_columns
from convosieve.operators.ranking import rank01
from convosieve.session import checkpoint

CORPUS_SCHEMA = "doc_id long, text string, label string"
SCORE_SCHEMA = "doc_id long, text string, pred_prob_TRUE string"


def read_jsonl(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA, corrupt: str | None = None) -> DataFrame:
    """One JSON object per non-blank line.  Values keep their text form, so TRUE and true both survive.

    With ``corrupt`` unparsable lines are kept in that column, otherwise they fail the job.
    """
    reader = spark.read.option("mode", "PERMISSIVE" if corrupt else "FAILFAST")
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
        schema = f"{schema}, {corrupt} string"
    return reader.schema(schema).json(path)


def number_rows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows read from files with `id_col`: 0, 1, 2, ... in the order of the files' paths and of the rows in each.

    The rows are written once with the split that they come from; one row per split is counted and summed up, so no row leaves its
    place and nothing depends on how splits were dealt out to tasks.
    """
    marks = {"_path": "_metadata.file_path", "_start": "_metadata.file_block_start"}
    rows = checkpoint(df.select("*", *[F.col(c).alias(m) for m, c in marks.items()], F.monotonically_increasing_id().alias("_at")))
    splits = rows.groupBy(*marks).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.orderBy(*marks).rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(*marks, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(starts, list(marks)).withColumn(id_col, F.col("_at") + F.col("_shift")).drop(*marks, "_at", "_shift")


def read_corpus(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA, id_col: str = "doc_id") -> DataFrame:
    """(id, text, norm_text, label, y).  Files without an id get the row number."""
    df = read_jsonl(spark, path, schema)
    if id_col not in df.columns:
        df = number_rows(df, id_col)
    label = T.normalize_label("label") if "label" in df.columns else F.lit(None).cast("string")
    return df.select(id_col, "text", T.normalize_text("text").alias("norm_text"), label.alias("label"), T.encode_label(label).alias("y"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; quoted texts may hold newlines and doubled quotes."""
    return (
        spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        .option("enforceSchema", False).schema(schema).csv(path)
    )


def infer_column(df: DataFrame, priority: Iterable[str]) -> str:
    for c in priority:
        if c in df.columns:
            return c
    raise ValueError(f"none of {list(priority)} in {df.columns}")


def probability_column(df: DataFrame, pseudo: bool = False) -> str:
    return infer_column(df, lex.PROB_COLUMNS_PSEUDO if pseudo else lex.PROB_COLUMNS_TEACHER)


def score_source(df: DataFrame, column: str, name: str, expected_rows: int | None = None, id_col: str = "doc_id", strict: bool = False) -> DataFrame | None:
    """Validated (id, name): numeric, complete, of the expected size; scores outside [0, 1] become ranks.

    An invalid source gives None, or an error with ``strict`` (which also rejects out-of-range scores).
    """
    if column not in df.columns:
        if strict:
            raise ValueError(f"{name}: missing column {column}")
        return None
    c = F.col(column).try_cast("double")
    got = df.select(id_col, c.alias(name))
    n, missing, outside = got.agg(
        F.count(F.lit(1)), F.count_if(F.col(name).isNull() | F.isnan(name)), F.count_if((F.col(name) < 0) | (F.col(name) > 1))
    ).first()
    problem = None
    if expected_rows is not None and n != expected_rows:
        problem = f"row count {n} != {expected_rows}"
    elif missing:
        problem = f"{missing} missing or non-numeric scores"
    elif outside and strict:
        problem = f"{outside} scores outside [0, 1]"
    if problem:
        if strict:
            raise ValueError(f"{name}: {problem}")
        return None
    if not outside:
        return got
    return rank01(got, name, id_col, out="_r").select(id_col, F.col("_r").alias(name))


def load_sources(spark: SparkSession, specs: list[dict], id_col: str = "doc_id") -> DataFrame:
    """Union of the present sources as (id, source, prob); a missing optional one is skipped.

    A spec has name, path, column, and optionally required and format (csv or parquet).
    """
    parts = []
    for s in specs:
        if not path_exists(spark, s["path"]):
            if s.get("required"):
                raise FileNotFoundError(f"nothing to read at {s['path']} for the source {s['name']}, which must be there")
            continue
        if s.get("format", "csv") == "csv":
            df = read_csv(spark, s["path"], s.get("schema", SCORE_SCHEMA))
        else:
            df = spark.read.parquet(s["path"])
        require_columns(df, [id_col, s["column"]], s["name"])
        parts.append(df.select(id_col, F.lit(s["name"]).alias("source"), F.coalesce(F.col(s["column"]).try_cast("double"), F.lit(0.0)).alias("prob")))
    if not parts:
        raise ValueError("no source could be loaded")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob is there, in whatever file system Spark itself would read it from."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(p)
    return found is not None and len(found) > 0


def join_sources(long: DataFrame, names: list[str], id_col: str = "doc_id") -> DataFrame:
    """Wide table of the rows that every source scores: one shuffle instead of a join per source."""
    wide = long.groupBy(id_col).pivot("source", names).agg(F.first("prob"))
    return wide.dropna(subset=names)


# --- metrics documents ------------------------------------------------------------


def metrics_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc): whole metrics JSON files as strings."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))


def threshold_of(doc: str | Column) -> Column:
    """Decision threshold of a metrics document: fixed paths first, then the best epoch, then the best table row."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    direct = F.coalesce(*[F.get_json_object(doc, p).try_cast("double") for p in lex.THRESHOLD_PATHS])
    epochs = F.from_json(F.get_json_object(doc, "$.epoch_metrics"), "array<struct<epoch:int,best_tuned_threshold:double>>")
    best = F.get_json_object(doc, "$.best_epoch.epoch").cast("int")
    by_epoch = F.get(F.transform(F.filter(epochs, lambda e: (e["epoch"] == best) & e["best_tuned_threshold"].isNotNull()), lambda e: e["best_tuned_threshold"]), F.lit(0))
    table = F.from_json(F.get_json_object(doc, "$.threshold_tuning.table"), "array<struct<threshold:double,f1:double>>")
    # Highest F1 wins, the earlier row on a tie.
    indexed = F.transform(table, lambda r, i: F.struct(F.coalesce(r["f1"], F.lit(-1.0)).alias("f1"), (-i).alias("i"), r["threshold"].alias("t")))
    by_table = F.array_max(indexed)["t"]
    value = F.coalesce(direct, by_epoch, by_table)
    return F.when(value.between(0.0, 1.0), value)


def metric_bundle(doc: str | Column) -> Column:
    """struct(f1, roc_auc, precision, recall, threshold) of the first bundle present."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    raw = F.coalesce(*[F.get_json_object(doc, f"$.{k}") for k in lex.METRIC_BUNDLE_KEYS])
    return F.from_json(raw, "struct<f1:double,roc_auc:double,precision:double,recall:double,threshold:double>")


def invalid_probabilities(df: DataFrame, column: str) -> DataFrame:
    return df.filter(bad_prob(column))
