"""Composite studies by hand and against plain loops."""

from collections import defaultdict
from math import exp, log

import pytest
from pyspark.sql import functions as F

from contestlab.operators import composite


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def frame(spark, n=60):
    data, seed = [], 7
    for c in range(n):
        raw = []
        for _ in range(4):
            seed = (seed * 1103515245 + 12345) % 2 ** 31
            raw.append(1 + seed % 97)
        p = [x / sum(raw) for x in raw]
        data += [(c, k, p[k], 0.75 / (p[k] * (0.6 + (c * 7 + k * 3) % 9 / 10)), 0.75 / p[k], k == c % 4, c < n // 2) for k in range(4)]
    return data, spark.createDataFrame(data, "c int, slot int, p double, odds double, final double, hit boolean, first boolean")


def test_ticket_grid_against_loops(spark):
    data, df = frame(spark)
    got = {(r[0], r[1]): r[2:] for r in rows(composite.ticket_grid(df, "c", "slot", "p", "odds", "hit", [0.7, 1.0], [1, 3]))}
    for level in (0.7, 1.0):
        for most in (1, 3):
            taken = []
            for c in range(60):
                taken += sorted([x for x in data if x[0] == c and round(x[2] * x[3], 9) >= level], key=lambda x: (-round(x[2], 9), x[1]))[:most]
            paid = [x[3] for x in taken if x[5]]
            assert got[(level, most)] == pytest.approx((len(taken), len(paid), sum(paid) / len(taken), (sum(paid) - max(paid)) / len(taken)))


def test_dutch_prefix_stops_at_the_line_and_counts_hits_that_lose(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 2.0, 1.0, True), (1, 2, 0.3, 4.0, 4.0, False), (1, 3, 0.2, 4.0, 4.0, False), (2, 1, 0.9, 1.1, 1.1, True), (2, 2, 0.1, None, 9.0, False)],
                               "c int, slot int, p double, odds double, final double, hit boolean")
    got = rows(composite.dutch_cases(df, "c", "slot", "p", "odds", "final", "hit", [(1.2, None), (1.05, None), (1.05, 1.0), (9.0, None)]))
    assert got[0] == pytest.approx((1.2, None, 1, 0.5, 2.0, 4 / 3, 1.0, 2 / 3, 1))  # the third ticket takes the composite odds to 1
    assert got[1][2:8] == pytest.approx((2, 1.0, 1.5, (4 / 3 + 1.1) / 2, 1.0, (2 / 3 + 1.1) / 2))
    assert got[2][2] == 1 and got[3][2:] == (0, 0.0, None, None, None, None, 0)


def test_band_is_chosen_on_the_first_part_alone(spark):
    data, df = frame(spark)
    pick = lambda d: {(r.lo, r.hi): r for r in composite.band_check(d, "first", "odds", "hit", "final", [(1.0, 3.0), (3.0, 9.0), (2.0, 50.0)], 5, 0.05).collect()}
    got = pick(df)
    for (lo, hi), r in got.items():
        one = [x for x in data if x[6] and lo <= x[3] < hi]
        assert (r.first_bets, r.first_hits) == (len(one), sum(x[5] for x in one)) and r.first_roi == pytest.approx(sum(x[4] for x in one if x[5]) / len(one))
    changed = pick(df.withColumn("hit", F.when(F.col("first"), F.col("hit")).otherwise(~F.col("hit"))))
    assert {k: (r["rank"], r.first_roi) for k, r in got.items()} == {k: (r["rank"], r.first_roi) for k, r in changed.items()}
    assert sorted(r["rank"] for r in got.values()) == [0, 1, 2, 3] and composite.band_check(df.limit(0), "first", "odds", "hit", "final", [(1.0, 3.0)], 5, 0.05).count() == 0


def test_trend_knows_nothing_of_its_own_contest(spark):
    data, df = frame(spark)
    own = df.withColumn("meeting", F.col("c") % 5)
    trended = composite.with_trend(own, ["meeting"], "c", "slot", "p", "hit", 4)
    total, seen, loss = defaultdict(float), defaultdict(int), defaultdict(list)
    for c in range(60):
        mine = [x for x in data if x[0] == c]
        for beta in (0.0, 2.0):
            w = [x[2] * exp(beta * total[c % 5, x[1]] / (seen[c % 5] + 3.0)) for x in mine]
            loss[beta, c < 30].append(-log(next(v for v, x in zip(w, mine) if x[5]) / sum(w)))
        for x in mine:
            total[c % 5, x[1]] += x[5] - x[2]
        seen[c % 5] += 1
    got = {r[0]: r[1:] for r in rows(composite.trend_fit(trended, "c", "first", "p", "hit", [0.0, 2.0], 3.0))}
    for beta in (0.0, 2.0):
        assert got[beta][:2] == pytest.approx(tuple(sum(loss[beta, h]) / 30 for h in (True, False)))
    assert sum(v[2] for v in got.values()) == 1
    assert composite.with_trend(own, ["meeting"], "c", "slot", "p", "hit", 5).count() == 0  # no contest has five entrants


def test_decision_times_and_flow_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 2.0, 1.0, 1.5, True), (1, 2, 0.5, 1.0, 3.0, 2.0, False), (2, 1, 0.6, None, 9.0, 9.0, True), (2, 2, 0.4, 1.0, 1.0, 1.0, False)],
                               "c int, slot int, p double, early double, late double, final double, hit boolean")
    got = rows(composite.decision_times(df, "c", "slot", "p", {"early": "early", "late": "late"}, "final", "hit", 1.0, 1), "time")
    assert got == [("early", 1, 1, 1.5, 0.75), ("late", 1, 0, 0.0, None)]  # contest 2 lacks a quote
    flow = rows(composite.flow_table(df, "c", "early", "late", "hit", 1.1, 0.9, [0.5]), "band", "move")
    assert flow == [(0, "down", 1, pytest.approx(0.25), 0.0), (1, "up", 1, pytest.approx(0.75), 1.0)]


def test_stacked_filters_treat_null_as_not_met(spark):
    df = spark.createDataFrame([(1, 5, None), (2, None, 1), (3, 7, 1)], "id int, a int, b int")
    got = composite.cases(df, composite.stacked({"a": F.col("a") > 4, "b": F.col("b") == 1}))
    assert rows(got.groupBy("case").agg(F.sort_array(F.collect_list("id"))), "case") == [("+a", [1, 3]), ("+b", [3]), ("all", [1, 2, 3])]
