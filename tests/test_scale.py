"""Work is dealt evenly, and rules make no more rows than they need."""

from pyspark.sql import functions as F

from convosieve.operators import rules as R
from convosieve.sources.tables import spread


def test_scan_tasks_beyond_the_cores_are_dealt_evenly(spark):
    slots = spark.sparkContext.defaultParallelism
    one_more = spark.range(1000).coalesce(1).repartition(slots + 1)
    assert spread(one_more, "id").rdd.getNumPartitions() == 3 * (slots + 1)
    assert spread(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() == slots
    lopsided = spark.range(0, 1000, 1, slots).withColumn("part", F.spark_partition_id()).filter("part = 0")
    sizes = spread(lopsided, "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > slots


def test_a_row_is_made_of_selected_rules_alone(spark):
    schema = "rule string, target_label string, train_precision double, val_precision double, rule_set string"
    selected = spark.createDataFrame([("a", "TRUE", 0.9, 0.9, "safe"), ("a", "TRUE", 0.9, 0.9, "balanced"), ("b", "FALSE", 0.8, 0.8, "safe")], schema)
    ruled = spark.createDataFrame([(1, 0, ["a", "x", "y"]), (2, 1, ["b", "a", "z"]), (3, 1, ["x"]), (4, 1, [])], "doc_id long, base_pred int, rules array<string>")
    applied = R.apply_rule_sets(ruled, selected)
    got = {(r["doc_id"], r["rule_set"]): (r["new_pred"], r["matched_rules"], r["changed"]) for r in applied.collect()}
    assert got == {(1, "safe"): ("TRUE", "a", True), (1, "balanced"): ("TRUE", "a", True), (2, "safe"): ("TRUE", "a || b", False), (2, "balanced"): ("TRUE", "a", False)}
    assert "array_intersect" in applied._jdf.queryExecution().optimizedPlan().toString()
    assert R.apply_rule_sets(ruled, selected.filter("false")).count() == 0


def test_plans_of_rules_run_no_job(spark):
    mined = spark.createDataFrame([("a", "TRUE", 0.9, 10, 9, 1)], "rule string, target_label string, train_precision double, train_support long, train_true long, train_false long")
    broken = spark.createDataFrame([(1, 1, 0, ["a"])], "doc_id long, y int, base_pred int, rules array<string>").withColumn("y", F.raise_error(F.lit("a job ran")).cast("int"))
    assert "delta_val_f1" in R.validate_rules(mined, broken).columns
