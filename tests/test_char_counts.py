"""Characters are counted over what earlier ones have left of a text."""

from collections import Counter

from pyspark.sql import functions as F

from convosieve.functions import tokens as K
from convosieve.functions.features import add_features

TEXTS = ["", "a", "abracadabra", "Ünï ünï  \n\t", "\U0001f600a\U0001f600 b"]


def test_counts_are_those_of_the_characters_in_order(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string").select("id", K.char_counts("t").alias("c")).orderBy("id").collect()
    assert [r["c"] for r in rows] == [[0]] + [list(Counter(t).values()) for t in TEXTS[1:]]


def test_noise_features_look_for_weird_tokens_and_characters_once(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = add_features(docs, "noise")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS _weird") == 1 and plan.count("aggregate(array_distinct(split(") == 1


def test_surplus_makes_its_array_once(spark):
    rows = spark.createDataFrame([(["a", "b", "a", "a"],), ([],)], "w array<string>")
    assert [r[0] for r in rows.select(K.surplus(F.col("w"))).collect()] == [2, 0]
