"""Audits, studies, discovery and late decisions: queries against their SQL, the rest against plain loops."""

import datetime as dt
import glob
import itertools
import math
import os

import duckdb
import numpy as np
import pytest

from contestlab import registry
from contestlab.operators import audit, study
from contestlab.plans.standins import entrants
from contestlab.streaming import live

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in registry.QUERIES.items() if (f.__module__ == "contestlab.plans.studies" or n[0] == "r" or n in ("a10_adaptive_bins", "e1_log_loss", "j7_current_version", "t2_pick_value")) and n in registry.ORACLE)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    return round(float(v), 4) + 0.0 if not isinstance(v, (bool, int, str, type(None))) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cur = duck.execute(registry.ORACLE[name])
    cols = [c[0] for c in cur.description]
    want = sorted(str([plain(dict(zip(cols, r))[c]) for c in sorted(cols)]) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert sorted(str([plain(r[c]) for c in sorted(cols)]) for r in df.collect()) == want


def contests(spark):
    found = {}
    for r in entrants(spark, SF).collect():
        found.setdefault(r.contest, []).append(r)
    return found


def test_coordinate_fit_against_a_loop(spark):
    values, free = [0.6, 0.7, 0.8, 0.9, 0.95, 1.0, 1.05, 1.1, 1.2, 1.3, 1.4, 1.6], ["A", "N", "R"]
    data = list(contests(spark).values())

    def loss(m):
        total = 0.0
        for rows in data:
            raw = {r.slot: max(float(r.score), 1e-9) * m[r["class"]] for r in rows}
            total += math.log(sum(raw.values())) - math.log(raw[next(r.slot for r in rows if r.finish == 1)])
        return total / len(data)

    now = dict.fromkeys(free, 1.0)
    for _ in range(3):
        before = dict(now)
        for k in free:
            now[k] = min(values, key=lambda v: (round(loss(now | {k: v}), 9), v))  # noqa: B023
        if now == before:
            break
    got = {r["class"]: r.multiplier for r in registry.QUERIES["e5_coordinate_fit"](spark, SF).collect()}
    assert got == now


def test_conditional_logit_against_plain_gradient(spark):
    e = entrants(spark, SF)
    w = study.conditional_logit(e.selectExpr("contest", "finish = 1 as hit", "score / 50 as x1", "discount * 10 as x2"), "contest", "hit", ["x1", "x2"])
    grad = -1e-3 * np.array(w)
    for rows in contests(spark).values():
        x = np.array([[float(r.score) / 50, float(r.discount) * 10] for r in rows])
        p = np.exp(x @ w - (x @ w).max())
        grad += x[[r.finish == 1 for r in rows]].sum(axis=0) - p / p.sum() @ x
    assert np.abs(grad).max() < 1e-5


def test_alerts_against_a_loop(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(key, start + dt.timedelta(hours=h), (h * key * 7 + h // 3) % 5 > 1 or 20 < h < 50) for key, h in itertools.product((1, 2, 3), range(0, 90, 2))]
    want = set()
    for key, own in itertools.groupby(rows, lambda r: r[0]):
        n, sent = 0, None
        for _, at, bad in own:
            if bad:
                n += 1
                if n >= 2 and (sent is None or at - sent >= dt.timedelta(hours=6)):
                    want.add((key, at, "alert"))
                    sent = at
            else:
                if sent:
                    want.add((key, at, "recovered"))
                n, sent = 0, None
    got = live.alert_state(spark.createDataFrame(rows, "key int, ts timestamp, bad boolean"), "key", "ts", "bad").collect()
    assert {(r.key, r.ts, r.kind) for r in got} == want and len(got) == len(want) > 10


def test_validate_counts_each_repeated_value_once(spark):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "x"), ("b", None, "y"), ("b", 2, "z")]
    df = spark.createDataFrame(rows, "part string, slot int, name string")
    got = {r.part: (r.errors, r.warnings, r.ready) for r in audit.validate(df, "part", 3, [("warning", "no slot", df.slot.isNull())], {"name twice": "name"}).collect()}
    assert got == {"a": (1, 0, False), "b": (0, 1, True)}
    assert audit.validate(df.limit(0), "part", 3, [], {}).isEmpty()


def test_expected_best_and_detection(spark):
    from pyspark.sql import functions as F
    r = spark.range(1).select(study.expected_best_of(F.lit(1)).alias("one"), study.expected_best_of(F.lit(100)).alias("many"), study.bets_to_detect(F.lit(200.0), 25.0, 5).alias("n")).first()
    assert r.one == 0 and 2.3 < r.many < 2.6 and r.n == math.ceil(((2.3263478740408408 + 0.8416212335729143) * 8) ** 2)
