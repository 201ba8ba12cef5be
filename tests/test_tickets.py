"""Tiny frames for ticket rules and place strengths."""

import datetime

from pyspark.sql import functions as F

from contestlab.operators import tickets


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_exact_places_never_negative(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0.7, 0.9), (1, 2, 0.4, 0.3, 0.6), (2, 1, 1.0, 1.0, 1.0)], "c int, s int, a double, b double, t double")
    got = rows(tickets.exact_places(df, "c", "a", "b", "t").select("c", "s", F.round("second", 6), F.round("third", 6)), "c", "s")
    assert got == [(1, 1, 1.0, 0.4), (1, 2, 0.0, 0.6), (2, 1, 0.0, 0.0)]


def test_condition_is_bounded_and_missing_keys_stay(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "c", 0.2)], "c int, k string, p double")
    rates = spark.createDataFrame([("a", 0.9, 0.1), ("b", 0.0, 0.0)], "k string, rate double, base double")
    got = rows(tickets.apply_condition(df, rates, ["k"], "c", "p").select("k", F.round("adjusted", 6)), "k")
    assert got == [("a", round(1.6 / 2.6, 6)), ("b", round(1 / 2.6, 6)), ("c", 1.0)]


def test_expected_value_guards(spark):
    df = spark.createDataFrame([(0.5, 3.0), (0.01, 300.0), (0.5, None), (0.5, 0.0)], "p double, o double")
    assert [r.ev for r in tickets.expected_value(df, "p", "o", 0.05).collect()] == [1.5, None, None, None]


def test_formation_without_rule_has_no_ticket(spark):
    df = spark.createDataFrame([(1, "1-234"), (2, "432"), (3, None)], "c int, formation string")
    assert rows(tickets.formation_ticket(df, {"1-234": ["x", "y"]}, "c"), "place") == [(1, "1-234", 0, "x"), (1, "1-234", 1, "y")]


def test_tier_quota(spark):
    df = spark.createDataFrame([(1, 1, "1-2-3", 0.5), (1, 1, "1-3-2", 0.2), (1, 2, "2-1-3", 0.2), (1, 3, "3-1-2", 0.1)], "c int, s1 int, ticket string, prob double")
    got = rows(tickets.tier_ticket(df, "c", 1, [(0.6, 1, 1), (0.0, 2, 2)]).select("ticket"), "ticket")
    assert got == [("1-2-3",), ("2-1-3",)]


def test_trailing_mean_leaves_the_end_out(spark):
    day = datetime.date
    df = spark.createDataFrame([("a", day(2024, 1, 1), 5), ("a", day(2024, 1, 9), 1), ("a", day(2024, 1, 10), 9)], "k string, d date, v int")
    assert rows(tickets.trailing_mean(df, ["k"], "d", "2024-01-10", 5, F.col("v"))) == [("a", 1, 1.0)]


def test_fill_and_enrich_keep_rows(spark):
    df = spark.createDataFrame([(1, None), (2, 7), (3, None)], "k int, v int")
    other = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    assert rows(tickets.fill_from(df, other, ["k"], "v"), "k") == [(1, 5), (2, 7), (3, None)]
    assert tickets.enrich(df, [(other.withColumnRenamed("v", "w"), ["k"])]).count() == 3
