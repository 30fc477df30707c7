"""Cleaning expressions on hand-made edge cases."""

from pyspark.sql import functions as F

from outcomelens.functions import scalars as X


def test_text_edge_cases(spark):
    df = spark.createDataFrame(
        [("", "x", "yes", "3.9"), (None, "nan", "TRUE", "-2.7"), ("None", "12.5", "1", "junk"),
         ("NA", "1e3", "no", None)], "item string, num string, flag string, cnt string")
    r = df.select(X.blank_to_sentinel("item").alias("item"), X.lenient_numeric("num").alias("num"),
                  X.normalize_flag("flag").alias("flag"), X.flag_default("flag").alias("fd"),
                  X.lenient_int("cnt").alias("cnt")).collect()
    assert [x.item for x in r] == ["None", "None", "None", "NA"]
    assert [x.num for x in r] == [None, None, 12.5, 1000.0]
    assert [x.flag for x in r] == ["Yes", "Yes", "Yes", "No"]
    assert [x.fd for x in r] == [0, 0, 0, 0]          # only the exact text 'Yes' counts
    assert [x.cnt for x in r] == [3, -2, 0, 0]        # truncation toward zero


def test_code_map_and_buckets(spark):
    df = spark.createDataFrame([("Dead", 3), ("Escape", 7), ("Draw", 13)], "r string, s int")
    r = df.select(X.code_map("r", {"Dead": 0, "Escape": 1}).alias("c"), X.range_bucket("s").alias("b"),
                  X.outcome_label(F.lit(1)).alias("o"), X.cap_value(F.col("s")).alias("cap")).collect()
    assert [x.c for x in r] == [0, 1, None]
    assert [x.b for x in r] == ["0-3", "7-9", "10-12"]   # sums above 12 land in the last range
    assert r[0].o == "3k" and [x.cap for x in r] == [3, 4, 4]


def test_round_display_half_even(spark):
    r = spark.createDataFrame([(3.125,)], "x double").select(
        X.round_display("x", 2).alias("a"), X.round_display("x", 2, half_even=True).alias("b")).first()
    assert (r.a, r.b) == (3.13, 3.12)
