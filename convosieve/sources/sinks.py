"""Writers: result tables, label files, resumable append with a dead-letter table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convosieve.operators.targets import keep_first
from convosieve.sources.readers import path_exists


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """parquet, json or csv (header, quoted, doubled quotes)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def write_corpus_jsonl(df: DataFrame, path: str) -> None:
    df.select("text", "label").write.mode("overwrite").json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A report of one row as one JSON object; more rows are an error."""
    if len(df.limit(2).collect()) > 1:
        raise ValueError("a metrics document has one row")
    df.coalesce(1).write.mode("overwrite").json(path)


def make_submission(template: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "label") -> DataFrame:
    """Labels in the template's rows and column order; anything but TRUE/FALSE fails the job."""
    value = F.when(F.col("_l").isin("TRUE", "FALSE"), F.col("_l")).otherwise(
        F.raise_error(F.concat(F.lit("invalid or missing label for row "), F.col(id_col).cast("string"))).cast("string")
    )
    joined = template.join(labels.select(id_col, F.col(label).alias("_l")), id_col, "left")
    return joined.withColumn(label, value).select(*template.columns)


#: Folders that the ids of an appended table are dealt out to, by hash.
ID_PARTS = 256


def _with_part(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.withColumn("id_part", F.pmod(F.xxhash64(id_col), F.lit(ID_PARTS)).cast("int"))


def pending(rows: DataFrame, done: list[DataFrame], id_col: str = "doc_id") -> DataFrame:
    """Rows whose id is in none of the tables yet, one per id; a null id is an id.  Of equal ids the least row by the other columns,
    in their order and nulls last, stays."""
    others = [c for c in rows.columns if c != id_col]
    order = F.min(F.struct(*[x for c in others for x in (F.col(c).isNull().alias(f"_{c}"), F.col(c))])) if others else F.lit(None)
    once = rows.groupBy(id_col).agg(order.alias("_row"))
    once = once.select(*[F.col(c) if c == id_col else F.col(f"_row.{c}").alias(c) for c in rows.columns])
    for table in done:
        ids = table.select(F.col(id_col).alias("_done"))
        once = once.join(ids, F.col(id_col).eqNullSafe(F.col("_done")), "left_anti")
    return once


def append_new(rows: DataFrame, tag, out_path: str, failed_path: str | None = None, id_col: str = "doc_id", valid: str = "valid") -> None:
    """Tag the rows in neither table yet, append the good ones to ``out_path``, the rest to ``failed_path``.

    ``tag`` maps a DataFrame to one with a boolean ``valid`` column.  Running it again after a stop only does what is left; a failed id
    is not tried again while it is in ``failed_path``.  Both tables are dealt out by ``id_part``, the hash of the id, and only the
    folders that hash values of the new rows fall into are read.
    """
    spark = rows.sparkSession
    rows = _with_part(rows, id_col)
    touched = [r[0] for r in rows.select("id_part").distinct().collect()]  # ID_PARTS at most
    tables = [spark.read.parquet(path).filter(F.col("id_part").isin(touched)) for path in (out_path, failed_path) if path and path_exists(spark, path)]
    tagged = tag(pending(rows, tables, id_col)).withColumn("tagged_at", F.current_timestamp()).persist()
    try:
        tagged.filter(F.col(valid)).drop(valid).write.mode("append").partitionBy("id_part").parquet(out_path)
        if failed_path:
            tagged.filter(~F.col(valid)).drop(valid).write.mode("append").partitionBy("id_part").parquet(failed_path)
    finally:
        tagged.unpersist()


def latest(df: DataFrame, id_col: str = "doc_id", order: str = "tagged_at") -> DataFrame:
    """The last record per id."""
    return keep_first(df, [id_col], order, last=True)
