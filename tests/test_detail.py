"""Side figures by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from contestlab.operators import detail, tuples


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_mixed_seconds_keep_every_first(spark):
    p = [(1, k, x) for k, x in enumerate((0.4, 0.3, 0.2, 0.1), 1)] + [(2, k, 1 / 3) for k in (1, 2, 3)]
    tri = tuples.ordered_triples(spark.createDataFrame(p, "c int, slot int, p double"), "c", "slot", "p")
    shares = spark.createDataFrame([(1, 2, 0.0), (1, 3, 0.5), (1, 4, 0.5), (2, 2, 0.9)], "c int, s2 int, share double")
    before = {(r.c, r.s1, r.s2, r.s3): r.prob for r in tri.collect()}
    after = {(r.c, r.s1, r.s2, r.s3): r.prob for r in detail.mix_second(tri, shares, "c", 1, 0.5).collect()}
    assert before.keys() == after.keys()
    for c, n in ((1, 4), (2, 3)):
        for s in range(1, n + 1):
            assert sum(v for k, v in after.items() if k[:2] == (c, s)) == pytest.approx(sum(v for k, v in before.items() if k[:2] == (c, s)))
    assert all(after[k] == pytest.approx(v) for k, v in before.items() if k[0] == 2 or k[1] != 1)  # contest 2 lacks a share
    cond = {s: sum(v for k, v in before.items() if k[:3] == (1, 1, s)) / 0.4 for s in (2, 3, 4)}
    raw = {s: (cond[s] * t / 1.001) ** 0.5 for s, t in ((2, 0.001), (3, 0.5), (4, 0.5))}
    for s in (2, 3, 4):
        assert sum(v for k, v in after.items() if k[:3] == (1, 1, s)) == pytest.approx(0.4 * raw[s] / sum(raw.values()))


def test_pattern_detail_counts_unknown_places_in_the_total_alone(spark):
    df = spark.createDataFrame([("x", "g", "p", 1, 2, 3), ("x", "g", "p", 1, 2, None), ("y", "g", "p", 3, None, None), ("y", "g", "p", None, 1, 2)], "s string, g string, k string, a int, b int, c int")
    got = rows(detail.pattern_detail(df, "s", "g", "k", ("a", "b", "c")).where("all_scopes = 1").select("kind", "value", "n", F.round("share", 4)), "kind", "value")
    assert got == [("head", "3", 1, 0.3333), ("second", "2", 2, 0.6667), ("triple", "1-2-3", 1, 0.3333)]
    assert detail.pattern_detail(df.limit(0), "s", "g", "k", ("a", "b", "c")).isEmpty()


def test_second_shares_give_a_share_to_seconds_that_never_came(spark):
    df = spark.createDataFrame([("k", "calm", 2), ("k", "calm", 2), ("k", "wind", 3), ("k", "wind", 3), ("k", "rare", 2), ("k", None, 2)], "key string, cond string, b int")
    got = rows(detail.second_shares(df, ["key"], "cond", "b", 5.0, 2).select("cond", "b", "n", "base", "share"), "cond", "b")
    assert got == [("calm", 2, 2, 0.6, 5 / 7), ("calm", 3, 0, 0.4, 2 / 7), ("wind", 2, 0, 0.6, 3 / 7), ("wind", 3, 2, 0.4, 4 / 7)]


def test_runs_and_bands_by_outcome(spark):
    bets = lambda data: spark.createDataFrame([(c, t, h, 1.0, 3.0 if h else 0.0) for c, t, h in data], "c int, t string, hit boolean, stake double, returned double")
    test = bets([(1, "a", True), (1, "b", False), (2, "a", False), (3, "a", True), (4, "a", False)])
    live = bets([(1, "b", False), (1, "a", True), (2, "c", True), (9, "a", True)])
    skipped = spark.createDataFrame([(3,), (3,), (2,)], "c int")
    assert rows(detail.runs_by_outcome(live, test, skipped, "c", "t"), "kind") == [("none", 1, 0, 0, 0.0, None), ("other", 1, 0, 1, 0.0, 3.0), ("same", 1, 1, 1, 1.5, 1.5), ("skipped", 1, 1, 0, 3.0, None)]
    results = spark.createDataFrame([(1, "a", 10.0), (2, "c", 99.0), (3, "z", 5.0)], "c int, result string, payout double")
    got = detail.common_bands({"test": test, "live": live}, ["test"], results, "c", "t", F.when(F.col("payout") < 50, "low").otherwise("high"))
    assert rows(got, "band", "method") == [("live", "high", "live", 1, 1), ("live", "high", "test", 1, 0), ("live", "low", "live", 1, 1), ("live", "low", "test", 1, 1)]


def test_limits_hold_their_ratio_and_need_units(spark):
    df = spark.createDataFrame([("many", f"d{k}", float(k % 3), 1.0) for k in range(90)] + [("few", "d1", 2.0, 1.0)], "g string, u string, num double, den double")
    few, many = rows(detail.limits_by(df, ["g"], "u", "num", "den", 100), "g")
    assert few == ("few", 1, 2.0, None, None) and many[:3] == ("many", 90, 1.0) and 0.7 < many[3] < 1 < many[4] < 1.3


def test_attribution_takes_ability_before_the_session(spark):
    d = lambda k: datetime.date(2024, 1, k)
    runs = spark.createDataFrame([("x", d(9), d(8), 1, 7, 1, 5.0, True), ("y", d(9), d(8), 1, 7, 1, 9.0, False)], "actor string, day date, start date, site int, motor int, pos int, points double, top boolean")
    ability = spark.createDataFrame([("x", d(7), 10, 20.0), ("x", d(9), 11, 99.0), ("y", d(8), 2, 4.0)], "actor string, day date, n long, points double")
    assert rows(detail.attribution(runs, ability, "actor", "day", "start", "site", "motor", "pos", "points", F.col("top"), 10)) == [(1, 7, 2, 1, 3.0, 0.0)]


def test_contest_conditions_are_judged_at_position_one(spark):
    df = spark.createDataFrame([(c, k, "t", 0.5, k == 1) for c in range(4) for k in (1, 2)], "c int, pos int, title string, p double, hit boolean")
    got = rows(detail.calibration_gains(df, "c", "pos", {"pos": F.col("pos")}, {"title": F.col("title")}, "p", "hit", 1), "condition", "value")
    assert [r[:3] for r in got] == [("pos", "1", 4), ("pos", "2", 4), ("title", "t", 4)] and got[2] == ("title", "t", 4, 0.5, 1.0, 2.0, 0.5)
