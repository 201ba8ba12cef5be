"""Tiny frames for the contest operators, and every registered query against its SQL on the smallest tables."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from contestlab import registry
from contestlab.functions import text as T
from contestlab.operators import asof, evaluate, ingest, tuples, within

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
D = datetime.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_window_of_90_days_counts_earlier_days_only(spark):
    daily = spark.createDataFrame([("a", D(2024, 1, 1), 1), ("a", D(2024, 3, 1), 1), ("a", D(2024, 5, 1), 1)], "k string, day date, n long")
    out = asof.asof_stats(daily, ["k"], "day", ["n"], 90, next_day="2024-05-02").orderBy("day").collect()
    assert [r.w_n for r in out] == [0, 1, 1, 2]


def test_no_look_ahead(spark):
    data = [("a", D(2024, 1, k), k) for k in range(1, 20)]
    make = lambda x: asof.prior_cumulative(asof.asof_stats(spark.createDataFrame(x, "k string, day date, n long"), ["k"], "day", ["n"], 7), ["k"], "day", ["n"])
    assert make(data).where("day <= '2024-01-10'").exceptAll(make(data[:10])).isEmpty()


def test_asof_strict_and_tolerance(spark):
    left = spark.createDataFrame([("a", D(2024, 1, 10), 1), ("b", D(2024, 1, 10), 2)], "k string, day date, x int")
    right = spark.createDataFrame([("a", D(2024, 1, 10), 5.0), ("a", D(2023, 12, 1), 4.0)], "k string, day date, v double")
    assert [r.v for r in asof.asof_join(left, right, ["k"], "day", ["v"]).orderBy("k").collect()] == [5.0, None]
    assert [r.v for r in asof.asof_join(left, right, ["k"], "day", ["v"], strict=True).orderBy("k").collect()] == [4.0, None]
    assert [r.v for r in asof.asof_join(left, right, ["k"], "day", ["v"], strict=True, tolerance=30).orderBy("k").collect()] == [None, None]


def test_relations_of_six_entrants(spark):
    df = spark.createDataFrame([(1, k, float(s)) for k, s in enumerate((5, 3, 1, 2, 4, 6), 1)], "c int, slot int, score double")
    out = within.inner_relations(df, "c", "slot", "score").orderBy("slot").collect()
    assert [r.inner_slower for r in out] == [0, 1, 2, 2, 1, 0]
    assert rows(within.max_gap(df, "c", "slot", "score"), "c") == [(1, 2.0, 4)]


def test_nulls_have_no_rank_and_ties_average(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 3.0), (1, None)], "c int, x double")
    assert sorted((r.x or 0, r.rank or 0) for r in within.rank_in(df, ["c"], "x", "average").collect()) == [(0, 0), (1.0, 1.5), (1.0, 1.5), (3.0, 3.0)]


def test_text_functions(spark):
    df = spark.createDataFrame([("F.02", "1'49\"8", "1-2-3:12.5 1-2-3:9 x:bad"), ("L", "9", ""), (".15", None, None)], "t string, c string, o string")
    out = df.select(T.parse_signed_time(F.col("t")).alias("t"), T.parse_clock(F.col("c")).alias("c"), T.parse_odds(F.col("o")).alias("o")).collect()
    assert [r.t for r in out] == [-0.02, None, 0.15]
    assert [r.c for r in out] == [109800, None, None]
    assert out[0].o == {"1-2-3": 9.0} and out[1].o == {} and out[2].o is None


def test_triples_sum_to_one_and_empty_input(spark):
    df = spark.createDataFrame([(1, k, 1 / 6) for k in range(1, 7)], "c int, slot int, p double")
    t = tuples.ordered_triples(df, "c", "slot", "p")
    assert t.count() == 120 and abs(t.agg(F.sum("prob")).first()[0] - 1) < 1e-9
    assert tuples.ordered_triples(df.limit(0), "c", "slot", "p").isEmpty()


def test_holm_and_latest(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "n string, p double")
    assert [round(r[2], 4) for r in rows(evaluate.holm(df, "p", "n").select("n", "p", "p_holm"), "n")] == [0.03, 0.06, 0.06]
    old = spark.createDataFrame([("k", 1, "x"), ("k", 2, None)], "k string, v int, c string")
    assert rows(ingest.latest_nonnull(old, ["k"], ["c"], ["v"]), "k") == [("k", "x")]


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(registry.ORACLE[name])
    cols = [c[0] for c in cur.description]
    want = sorted(map(str, [tuple(dict(zip(cols, r))[c] for c in sorted(cols)) for r in cur.fetchall()]))
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(str, [tuple(r[c] for c in sorted(cols)) for r in df.collect()])) == want


def test_bootstrap_limits_against_brute_force(spark):
    import hashlib

    import numpy as np
    data = [(k, 0.4 + 0.05137 * (k % 29) + 0.000271 * k * k, 1.0) for k in range(40)]  # no replicate is 1 exactly
    draw = np.array([[int(hashlib.md5(f"{k}:{rep}".encode()).hexdigest()[:8], 16) / 2 ** 32 for k, _, _ in data] for rep in range(1, 1001)])
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    w = sum((draw >= c).astype(int) for c in cuts)
    num = np.array([x for _, x, _ in data])
    ratio = w @ num / w.sum(axis=1)
    want = [num.mean(), *np.percentile(ratio, [5, 95, 2.5, 97.5]), (ratio > 1).mean()]
    got = evaluate.bootstrap_limits(spark.createDataFrame(data, "unit long, num double, den double"), "unit", "num", "den").first()
    assert list(got) == pytest.approx(want, abs=1e-9) and 0 < got.p_over_1 < 1
    assert registry.QUERIES["e7_bootstrap_limits"](spark, SF).count() == 1


def test_pool_is_fitted_on_the_first_half_and_applied_to_the_second(spark):
    import random
    from math import exp, log
    rnd = random.Random(2)
    data = []
    for c in range(24):
        raw, odd = [rnd.random() for _ in range(4)], [rnd.random() for _ in range(4)]
        data += [(c, raw[k] / sum(raw), odd[k] / sum(odd), k == c % 4, c >= 12) for k in range(4)]
    def loss(a, b, half):
        total = 0.0
        for c in range(12 * half, 12 * half + 12):
            raw = [(exp(a * log(p) + b * log(m)), y) for i, p, m, y, _ in data if i == c]
            total -= log(next(x for x, y in raw if y) / sum(x for x, _ in raw))
        return total / 12
    cells = [(a / 10, b / 10) for a in range(5, 31) for b in range(16)]
    best = min((round(loss(a, b, 0), 12), a, b) for a, b in cells)
    df = spark.createDataFrame(data, "contest long, p double, market double, hit boolean, second boolean")
    got = evaluate.fit_and_apply_pool(df, spark.createDataFrame(cells, "a double, b double"), "contest", "p", "market", "hit", "second").first()
    assert (got.a, got.b) == best[1:] and [got.first_loss, got.second_loss] == pytest.approx([best[0], loss(got.a, got.b, 1)], abs=1e-9)
    assert registry.QUERIES["e2_fit_pool_halves"](spark, SF).count() == 1


def test_bootstrap_draws_equal_md5_and_deal_their_work_over_all_cores(spark):
    import hashlib

    import numpy as np
    from contestlab.operators import draws
    for size in (0, 1, 6, 50, 51, 52, 60):  # from one block to two
        heads = [f"{k:0{size}d}"[:size].encode() for k in range(9)]
        for tails in ([b"1", b"7"], [b"10", b"99"], [b"1000"]):
            want = [[int(hashlib.md5(h + t).hexdigest()[:8], 16) for t in tails] for h in heads]
            assert draws.md5_numbers(heads, tails).tolist() == want
    data = [("a", 1.5, 1.0), (None, 2.5, 2.0), ("x" * 70, None, 1.0), ("b", 4.0, 3.0)] + [(str(k), k / 7, 1.0) for k in range(95, 105)]
    df = spark.createDataFrame(data, "unit string, num double, den double").coalesce(1)
    u = evaluate.unit_random(F.col("unit"), F.col("rep"))
    weight = sum(((u >= c).cast("int") for c in draws.POISSON_CUTS), F.lit(0))
    old = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("w", weight).groupBy("rep").agg((F.sum(F.col("w") * F.col("num")) / F.sum(F.col("w") * F.col("den"))).alias("ratio"))
    found = evaluate.bootstrap_ratio(df, "unit", "num", "den", 12)
    assert {r.rep: r.ratio for r in found.collect()} == pytest.approx({r.rep: r.ratio for r in old.collect()}, abs=1e-12)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # no row a unit and replicate
    assert evaluate.bootstrap_ratio(df.limit(0), "unit", "num", "den", 12).isEmpty()


def test_pool_makes_no_row_an_entrant_and_cell(spark):
    import random
    from math import exp, log
    rnd = random.Random(4)
    data = [(c, rnd.random(), rnd.random() if k else None, k == c % 7) for c in range(40) for k in range(2 + c % 5)]  # some contests without a winner
    cells = [(a / 10, b / 10) for a in range(5, 31) for b in range(16)]
    got = evaluate.fit_pool(spark.createDataFrame(data, "contest long, p double, market double, hit boolean"), spark.createDataFrame(cells, "a double, b double"), "contest", "p", "market", "hit")
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for a, b in cells:
        each = []
        for c in range(40):
            raw = [(exp(a * log(max(p, 1e-9)) + b * log(max(m or 0, 1e-9))), y) for i, p, m, y in data if i == c]
            if any(y for _, y in raw):
                each.append(log(sum(x for x, _ in raw)) - sum(log(x) for x, y in raw if y))
        want[a, b] = sum(each) / len(each)
    assert {(r.a, r.b): r.log_loss for r in got.collect()} == pytest.approx(want, abs=1e-9)


def test_large_tables_are_dealt_into_parts_by_their_size(spark):
    from contestlab.plans import standins
    small = standins.spread(spark, SF, "lineitem", "l_orderkey")
    parts = standins.spread(spark, SF, "lineitem", "l_orderkey", 1 << 13)
    assert "Exchange" not in small._jdf.queryExecution().executedPlan().toString() and parts.rdd.getNumPartitions() > 4
    assert sorted(parts.collect()) == sorted(small.collect())


def test_null_worlds_make_no_row_a_contest_and_sim(spark):
    from contestlab.operators import study
    data = [(c, s, 1 / (2 + c % 3), 1.5 + s + c / 100, s == c % (2 + c % 3)) for c in range(95, 125) for s in range(2 + c % 3)]
    got = study.null_max_test(spark.createDataFrame(data, "contest long, slot int, market double, odds double, hit boolean"), "contest", "slot", "market", "odds", "hit", 60)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    import hashlib
    n, back, tops = {}, {}, []
    for _, s, _, o, y in data:
        n[s], back[s] = n.get(s, 0) + 1, back.get(s, 0) + o * y
    best = min((-round(back[s] / n[s], 9), s) for s in n)
    for sim in range(1, 61):
        won = {}
        for c in range(95, 125):
            u, size = int(hashlib.md5(f"{c}:{sim}".encode()).hexdigest()[:8], 16) / 2 ** 32, 2 + c % 3
            s = min(sum((k + 1) / size < u for k in range(size)), size - 1)
            won[s] = won.get(s, 0) + 1.5 + s + c / 100
        tops.append(round(max(won[s] / n[s] for s in won), 9))
    assert tuple(got.first()) == pytest.approx((best[1], -best[0], (1 + sum(t >= -best[0] for t in tops)) / 61))
