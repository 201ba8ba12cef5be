"""Templates, back-tests without look-ahead, sectioned logs in splits, ranks by range."""

import datetime

import pytest
from pyspark.sql import functions as F

from contestlab.operators import evaluate, patterns, ranks, rules, study
from contestlab.sources import text


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_templates():
    assert patterns.compile_tickets("2-1-*") == ["2-1-3", "2-1-4", "2-1-5", "2-1-6"]
    assert len(patterns.compile_tickets("2-3-* 2-*-3")) == 8 and len(patterns.compile_tickets("2-3-* 2-*-3 2-1-*")) == 11
    assert len(patterns.compile_tickets("123-123-123")) == 6 and len(patterns.compile_tickets("*-*-*")) == 120 and patterns.compile_tickets("1-1-2") == []


def test_patterns_settle_by_hand(spark):
    df = spark.createDataFrame([(1, "2-1-3", 900.0, True), (2, "1-2-3", 500.0, True), (3, "2-3-1", 700.0, None), (4, None, None, True)], "contest int, result string, payout double, go boolean")
    got = patterns.pattern_study(df, {"under": ("2-1-*", F.col("go")), "switch/a": ("2-3-*", F.col("contest") == 3), "switch/b": ("1-2-*", F.col("contest") == 2), "never": ("1-2-3", F.lit(False))}, [], "result", "payout")
    assert rows(got, "shape") == [("switch", 2, 8, 2, 1.0, 1.5), ("under", 2, 8, 1, 0.5, 900 / 800)]


def test_backtest_knows_nothing_of_later_days(spark):
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(k)
    data = [(a, day(k), 1 if (a == "good" or k % 2) and a != "poor" else 0, 0.5) for a in ("good", "poor", "even") for k in range(60)]
    late = [(a, d, 1 - y, e) if d >= day(40) else (a, d, y, e) for a, d, y, e in data]
    cuts = [str(day(20)), str(day(40))]
    run = lambda x: patterns.ability_backtest(spark.createDataFrame(x, "actor string, day date, y int, e double"), ["actor"], "day", cuts, F.col("y") == 1, "e", F.col("y") * 200.0, 10, 0.1, 2.0)
    got = rows(run(data), "cut", "kind")
    assert got[:3] == [(cuts[0], "good", 1, 20, 1.0, 0.5, 2.0), (cuts[0], "none", 1, 20, 0.5, 0.5, 1.0), (cuts[0], "poor", 1, 20, 0.0, 0.5, 0.0)]
    changed = rows(run(late), "cut", "kind")
    assert changed[:3] == got[:3] and [r[:4] for r in changed] == [r[:4] for r in got]  # who is an owner doesn't change, what came of it does
    assert changed[3][4] == 0.0 and got[3][4] == 1.0


def test_sections_across_splits_equal_one_split(spark, tmp_path):
    lines = []
    for k in range(400):
        if k % 90 == 0:
            lines.append(f"#site {k // 90}")
        if k % 37 == 0:
            lines.append(f"== race {k}\r")
        lines.append(f"{k % 6 + 1} name{k}")
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("1 early\n" + "\n".join(reversed(lines)) + "\n")
    headers, row, fields = {"site": r"^#site (\d+)", "race": r"^== (.*)"}, r"^(\d) (\w+)$", ["slot", "name"]
    want = rows(text.read_sections(spark, str(tmp_path), headers, row, fields).withColumn("file", F.substring_index("file", "/", -1)), "file", "line_no")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        split = text.read_split_sections(spark, str(tmp_path), headers, row, fields)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = rows(split.withColumn("file", F.substring_index("file", "/", -1)), "file", "line_no")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want and len(got) == 801


def test_ranks_cross_partitions(spark):
    df = spark.createDataFrame([(k * 7919 % 1000, float(k % 13)) for k in range(1000)], "k long, v double").repartition(9)
    found, n = ranks.positions(df, "k")
    assert n == 1000 and rows(found.select("k", "position"), "k") == [(k, k) for k in range(1000)]
    placed = ranks.place(df, "k", parts=5)
    assert placed.select(ranks.PART).distinct().count() > 1
    by = {r.k: r.v for r in df.collect()}
    before, total = ranks.before_sum(placed, "v", "s")
    top = {r.k: r.m for r in ranks.upto_max(placed, "v", "m").collect()}
    run, high = 0.0, 0.0
    sums = {r.k: r.s for r in before.collect()}
    for k in range(1000):
        assert sums[k] == pytest.approx(run)
        run, high = run + by[k], max(high, by[k])
        assert top[k] == high
    assert total == pytest.approx(run)
    assert ranks.positions(df.limit(0), "k")[1] == 0 and rows(evaluate.time_split(spark.createDataFrame([], "day date"), "day")) == []


def test_no_window_over_one_partition(spark):
    df = spark.createDataFrame([(f"n{k}", k % 50 / 50, k % 3 == 0) for k in range(200)], "name string, p double, hit boolean")
    for out in (evaluate.holm(df, "p", "name"), evaluate.auc_rank(df, "p", "hit"), study.quantile_table(df, "p", "hit")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        windows = [x for x in plan.splitlines() if "Window " in x or "Window [" in x]
        assert windows and all("__part" in x for x in windows)


def test_rules_by_hand(spark):
    df = spark.createDataFrame([(1, k, float(x), f, "a") for k, (x, f) in enumerate(zip((3, 1, 2, 2, 9, 9), (1, 2, 3, 4, 5, 6)), 1)] + [(2, k, None if k > 3 else float(k), k, "b") for k in range(1, 7)], "contest int, slot int, x double, f int, g string")
    wide = rules.wide(df, "contest", "slot", ["x", "f"], ["g"])
    wide = wide.selectExpr("*", *[f"{rules.rank_of('x', k)} as x_r{k}" for k in range(1, 7)], f"{rules.rank_of('x', 3, ties='max')} as x_x3", f"{rules.margin_of('x')} as x_margin")
    assert [rows(wide.select(*[f"x_r{k}" for k in range(1, 7)], "x_x3", "x_margin"), "x_margin", "x_x3")[k] for k in (0, 1)] in (
        [(None,) * 7 + (1.0,), (4, 1, 2, 2, 5, 5, 3, 1.0)], [(4, 1, 2, 2, 5, 5, 3, 1.0), (None,) * 7 + (1.0,)])
    rule = rules.Rule(1, "r", {"ahead": "x{k} < x{o}", "all": "true"}, {"inner": "f{k} < f{o}", "wins": "f{k} = 1"}, each=(1, 2, 3, 4, 5))
    got = {(r.g, r.band, r.outcome): (r.n, r.rate) for r in rules.rule_tables(wide, [rule], ["g"]).collect()}
    assert got["a", "ahead", "inner"] == (2, 1.0) and got["a", "ahead", "wins"] == (2, 0.0) and got["b", "ahead", "wins"] == (2, 0.5) and got["b", "all", "wins"] == (5, 0.2)
