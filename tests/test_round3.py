"""Findings of round 3: what a job makes is bounded by its question, not by the rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from contestlab.operators import boost, discover, rules, study, trends


def test_rule_search_counts_tickets_before_they_meet_the_grid(spark):
    rng = random.Random(13)
    tickets = [(c, s, c % 7, rng.choice([0.1, 0.2, 0.25, 0.5]), rng.choice([1.0, 2.0, 3.5, 4.0, 8.0, None]), rng.random() < 0.3) for c in range(300) for s in range(1, 5)]
    grid = [(t, k, lo, hi, side) for t in (0.5, 0.8, 1.0) for k in (1, 2) for lo, hi in ((0.0, 100.0), (2.0, 4.0), (3.5, 8.0)) for side in ("all", "outer")]
    df = spark.createDataFrame(tickets, "part int, slot int, day int, p double, odds double, hit boolean")
    found = study.rule_search(df, spark.createDataFrame(grid, "theta double, k int, lo double, hi double, side string"), "part", "day", "p", "odds", "hit", "slot", F.col("day") > 3, {"all": F.lit(True), "outer": F.col("slot") > 2})
    want = {}
    for c in range(300):
        own = sorted((t for t in tickets if t[0] == c and t[4] is not None), key=lambda t: (-round(t[3] * t[4], 9), t[1]))
        for theta, k, lo, hi, side in grid:
            for rank, t in enumerate(own, 1):
                if round(t[3] * t[4], 9) >= theta and rank <= k and lo <= t[4] < hi and (side == "all" or t[1] > 2):
                    held = want.setdefault((theta, k, lo, hi, side), [0, 0.0, 0, 0.0])
                    held[2 * (t[2] > 3)] += 1
                    held[2 * (t[2] > 3) + 1] += t[4] if t[5] else 0.0
    got = {tuple(r[c] for c in ("theta", "k", "lo", "hi", "side")): (r.first_bets, r.first_roi, r.second_bets, r.second_roi) for r in found.collect()}
    assert got.keys() == want.keys()
    for key, (n1, b1, n2, b2) in want.items():
        assert got[key][0] == n1 and got[key][2] == n2 and all(g is None if not n else abs(g - b / n) < 1e-9 for g, b, n in ((got[key][1], b1, n1), (got[key][3], b2, n2)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join"):]  # the join's rows are counted ones


def test_histograms_count_two_features_at_once_as_one_by_one():
    rng = np.random.default_rng(16)
    for features, n_bins, width in ((5, 9, 4), (2, 33, 1), (3, 251, 2)):
        bins, node = rng.integers(0, n_bins, (500, features)).astype(np.uint8), rng.integers(0, width + 1, 500)
        steps = rng.integers(-boost.GRAIN, boost.GRAIN, (2, 500)).astype(float)
        got, want = boost._sums(node, boost._places(bins, n_bins, width), steps, width, features, n_bins), np.zeros((3, width, features, n_bins), np.int64)
        for r in np.flatnonzero(node < width):
            for f in range(features):
                want[:, node[r], f, bins[r, f]] += (*steps[:, r].astype(np.int64), 1)
        assert (got == want).all()


def test_backoff_deals_rows_once_into_the_parts_asked_for(spark):
    df = spark.createDataFrame([("a", 1, "x", 1)] * 3 + [("a", 1, "y", 0)] * 2 + [("b", 2, None, 1)] * 3 + [(None, 1, "x", 1)] * 4, "actor string, p int, t string, h int")
    wanted = spark.createDataFrame([("a", 1, "z"), ("a", 3, "x"), ("b", 2, None), ("c", 1, "x"), (None, 1, "x")], "actor string, p int, t string")
    found = discover.backoff_history(df, wanted, "actor", ["p", "t"], F.col("h") == 1, 3, 9)
    assert {r[:3]: r[3:] for r in found.collect()} == {("a", 1, "z"): (1, 5, 0.6), ("a", 3, "x"): (2, 3, 1.0), ("b", 2, None): (0, 3, 1.0)}
    plan = discover.backoff_history(df, df, "actor", ["p", "t"], F.col("h") == 1, 3, 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(actor" in plan and ", 9)" in plan


def test_prior_means_cost_no_frame_a_row(spark):
    rng = random.Random(12)
    rows = [(k, rng.randrange(5), rng.choice("xy"), rng.randrange(0, 1100), rng.choice([1, 2, 3, None])) for k in range(600)]
    # both ends of the year, and two rows of one day
    rows += [(600, 9, "x", 0, 2), (601, 9, "x", 365, 3), (602, 9, "x", 366, 1), (603, 9, "x", 366, 4), (604, 9, "y", 731, 1), (605, 9, "y", 732, 1)]
    df = spark.createDataFrame(rows, "id int, actor int, title string, day long, v int")
    values = {"a": ("v", 1, []), "b": ("(v = 1)::int", 3, ["title"])}
    found = rules.prior_means(df, "day", "actor", values, 365)
    # running sums only: a frame that ends behind the row and starts at a day is added up anew for every row
    assert "-365, -1" not in found._jdf.queryExecution().optimizedPlan().toString().replace("$()", "")
    got = {r.id: (r.a, r.b) for r in found.collect()}
    for k, actor, title, day, _ in rows:
        before = [r for r in rows if r[1] == actor and day - 365 <= r[3] < day and r[4] is not None]
        a, b = [r[4] for r in before], [int(r[4] == 1) for r in before if r[2] == title]
        assert got[k] == (round(sum(a) / len(a), 9) if a else None, round(sum(b) / len(b), 9) if len(b) >= 3 else None)


def test_rule_study_gathers_a_position_once_and_writes_no_table(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1, 5, "A", "g"), (1, 2, None, "N", "g"), (1, 2, 3, "B", "g"), (2, 6, 1, None, "h"), (2, 7, 9, "A", "h")], "contest int, slot int, x int, c string, g string")
    wide = rules.wide(df, "contest", "slot", ["x", "c"], ["g"])
    # of two rows of a position the greatest value counts, measure by measure
    got = {r.contest: r for r in wide.collect()}
    assert (got[1].g, got[1].x1, got[1].x2, got[1].c2, got[1].x3) == ("g", 5, 3, "N", None) and (got[2].g, got[2].x6, got[2].c6, got[2].x1) == ("h", 1, None, None)
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") <= 6
    monkeypatch.setattr("contestlab.storage.written", lambda *a: 1 / 0)
    monkeypatch.setattr(rules, "written", lambda *a: 1 / 0, raising=False)
    rule = rules.Rule(1, "r", {"all": "x1 > 1"}, {"y": "x2 = 3"})
    assert [(r.n, r.rate) for r in rules.rule_tables(wide, [rule], ["g"]).collect()] == [(1, 1.0)]


def test_sessions_are_dealt_once_and_summed_on_the_actors_own_days(spark):
    rng = random.Random(23)
    rows = [(rng.choice("st"), rng.choice([1, 2, 3, 4, None]), rng.choice([1, 3, 4, 8, 9, None]), rng.choice([5.0, 7.0, 9.0, None]), rng.choice([1, 2, None])) for _ in range(60)]
    rows += [("u", 1, None, 5.0, 1), ("v", 1, None, 5.0, 1), ("v", 2, 4, 6.0, 2), ("v", 2, 6, 5.0, 2), (None, 1, 2, 1.0, 1)]
    df = spark.createDataFrame(rows, "session string, actor int, day int, score double, pts long")
    found = trends.session_running(df, ["session"], "actor", "day", "score", "pts", 3)
    # no grid is joined, and the rows move once
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    want = set()
    for s in "stuv":
        own = [r for r in rows if r[0] == s]
        for d in {r[2] for r in own} - {None}:
            state = {}
            for a in {r[1] for r in own}:
                before = [r for r in own if a is not None and r[1] == a and r[2] is not None and r[2] < d]
                state[a] = (min((r[3] for r in before if r[3] is not None), default=None), sum(r[4] or 0 for r in before), len(before))
            for a, (best, points, starts) in state.items():
                want.add((s, a, d, best, points, starts, None if best is None else 1 + sum(x[0] is not None and x[0] < best for x in state.values())))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
