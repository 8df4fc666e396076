"""Literal unit cases carried over from the reference's test suite (FIXTURES 2)."""

import math

from pyspark.sql import functions as F

from trendspark.functions import text as T
from trendspark.functions import timefn as D
from trendspark.operators import events as E


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr(F.col("x")).alias("r")).first()["r"]


def test_clean_alnum_keeps_digits(spark):
    assert "19" in one(spark, T.clean_alnum, "COVID-19 pandemic")
    assert "2020" in one(spark, T.clean_alnum, "Year 2020!")


def test_clean_alpha_drops_digits(spark):
    r = one(spark, T.clean_alpha, "COVID-19 pandemic 2020")
    assert "19" not in r and "2020" not in r and "covid" in r


def test_lower_specials_whitespace_empty(spark):
    assert one(spark, T.clean_alnum, "HELLO World") == "hello world"
    r = one(spark, T.clean_alnum, "it's a test! @#$%")
    assert "@" not in r and "#" not in r and "'" not in r
    assert one(spark, T.clean_alnum, "  hello   world  ") == "hello world"
    assert one(spark, T.clean_alnum, "") == ""


def test_non_string_and_null(spark):
    assert one(spark, T.clean_alnum, 12345, "int") == "12345"
    assert one(spark, T.clean_alnum, None) == "none"


def test_nbsp_is_whitespace(spark):
    assert one(spark, T.clean_alnum, "hello world") == "hello world"


def test_richness(spark):
    hi = one(spark, lambda c: T.richness(T.tokens(T.clean_alnum(c))), "alpha beta gamma delta epsilon")
    lo = one(spark, lambda c: T.richness(T.tokens(T.clean_alnum(c))), "word word word word word")
    assert hi > 0.8 and lo < 0.3


def test_temporal_weight(spark):
    df = spark.createDataFrame([(d,) for d in (0, 100, 500, 3650)], "d int")
    w = [r["w"] for r in df.select(D.temporal_weight(F.col("d"), F.lit(3650)).alias("w")).orderBy("w").collect()]
    assert all(0 <= x <= 1 for x in w) and w == sorted(w) and w[0] == 0 and abs(w[-1] - 1) < 1e-12


def test_time_encoding(spark):
    df = spark.createDataFrame([(0.5,), (3.14,), (0.0,), (5.0,)], "t double")
    rows = [r["e"] for r in df.select(D.time_encoding(F.col("t"), 32).alias("e")).collect()]
    assert all(len(e) == 32 and all(-1 <= x <= 1 for x in e) for e in rows)
    assert rows[2] != rows[3]
    assert len([0.0] * 384 + rows[0]) == 416


def test_bigrams_and_vocab(spark):
    r = spark.createDataFrame([("a b c",)], "x string").select(
        T.bigrams(T.tokens(F.col("x"))).alias("b"), T.query_vocab(T.tokens(F.col("x"))).alias("v")).first()
    assert r["b"] == ["a b", "b c"] and set(r["v"]) == {"a", "b", "c", "a b", "b c"}


def test_verdict_map(spark):
    df = spark.createDataFrame([(p,) for p in (0.80, 0.62, 0.45, 0.30, 0.10)], "p double")
    got = [r["v"] for r in df.select(E.verdict(F.col("p")).alias("v")).collect()]
    assert got == ["VERIFIED_REAL", "LIKELY_REAL", "UNCERTAIN", "LIKELY_NOISE", "VERIFIED_NOISE"]


def test_spike_window_edges(spark):
    df = spark.createDataFrame([("2016-07-01", 2017), ("2018-06-30", 2017), ("2018-07-01", 2017),
                                ("2016-06-30", 2017)], "d string, y int")
    got = [r["w"] for r in df.select(D.spike_window(F.to_date("d"), F.col("y")).alias("w")).collect()]
    assert got == [True, True, False, False]


def test_percent_text(spark):
    assert one(spark, T.percent_text, 0.4567, "double") == "45.7%"
    assert one(spark, T.percent_text, 3.0, "double") == "100.0%"
