"""Tiny frames for selection, discovery, text sources and streams."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from contestlab.operators import discover, select, trends
from contestlab.sources import text
from contestlab.streaming import live, stateful


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_quota_replaces_the_last_others(spark):
    df = spark.createDataFrame([(1, k, k >= 4) for k in range(1, 7)], "c int, k int, f boolean")
    assert rows(select.top_with_quota(df, ["c"], [F.col("k")], 3, F.col("f"), 2).select("k"), "k") == [(1,), (4,), (5,)]
    assert rows(select.top_with_quota(df.where("not f"), ["c"], [F.col("k")], 2, F.col("f"), 2).select("k"), "k") == [(1,), (2,)]


def test_upsert_and_roster(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, v int"), spark.createDataFrame([("b", None), ("c", 4), ("d", 5)], "k string, v int")
    assert rows(select.upsert(old, new, ["k"], ["v"]), "k") == [("a", 1, "kept"), ("b", None, "same"), ("c", 4, "updated"), ("d", 5, "inserted")]
    members = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "k string, missed int")
    seen = spark.createDataFrame([("b",), ("d",)], "k string")
    assert rows(select.roster_merge(members, seen, "k", "missed", 2), "k") == [("a", 1, "missing"), ("b", 0, "restored"), ("c", 2, "inactive"), ("d", 0, "added")]


def test_resets_keep_their_distance(spark):
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(k)
    df = spark.createDataFrame([("s", day(k), 9, float(k % 2)) for k in range(12)], "site string, day date, n int, share double")
    assert [r.day for r in trends.detect_resets(df, "site", "day", "n", "share", 0.6, 0.3, 6, 4).orderBy("day").collect()] == [day(1), day(5), day(9)]


def test_backoff_takes_the_most_specific_conditions(spark):
    df = spark.createDataFrame([("a", 1, "x", 1)] * 3 + [("a", 1, "y", 0)] * 2 + [("b", 2, None, 1)], "actor string, p int, t string, h int")
    got = {r[:3]: r[3:] for r in rows(discover.backoff_history(df, df, "actor", ["p", "t"], F.col("h") == 1, 3), "actor")}
    assert got == {("a", 1, "x"): (0, 3, 1.0), ("a", 1, "y"): (1, 5, 0.6)}


def test_sections_fixed_width_and_json_lines(spark, tmp_path):
    (tmp_path / "log.txt").write_text("#site 01\n== first\n1 ann\n2 bob\n== second\n1 cy\n#site 02\n1 di\n")
    got = text.read_sections(spark, str(tmp_path / "log.txt"), {"site": r"^#site (\d+)", "race": "^== (.*)"}, r"^(\d) (\w+)$", ["slot", "name"])
    assert rows(got.drop("file", "line_no"), "site", "race", "slot") == [("01", "first", "1", "ann"), ("01", "first", "2", "bob"), ("01", "second", "1", "cy"), ("02", "second", "1", "di")]
    cut = text.cut_fixed_width(spark.createDataFrame([("ab 125",), ("    xx",), (None,)], "line string"), "line", {"name": (1, 3, None), "v": (4, 3, 100.0)}).drop("line")
    assert [tuple(r) for r in cut.collect()] == [("ab", 1.25), (None, None), (None, None)]
    (tmp_path / "x.jsonl").write_text('{"k": "a", "v": 1}\n{"k": "b", "v\n')
    good, bad = text.read_jsonl(spark, str(tmp_path / "x.jsonl"), StructType().add("k", StringType()).add("v", IntegerType()))
    assert rows(good) == [("a", 1)] and rows(bad) == [('{"k": "b", "v',)]


def test_days_are_replaced_one_by_one(spark, tmp_path):
    out = str(tmp_path / "days")
    text.write_days(spark.createDataFrame([("1", "old"), ("2", "old")], "day string, v string"), out, "day")
    text.write_days(spark.createDataFrame([("2", "new")], "day string, v string"), out, "day")
    assert rows(spark.read.json(out).select(F.col("day").cast("int"), "v"), "day") == [(1, "old"), (2, "new")]


def test_streams_run_over_several_batches(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 10, m)
    for k, data in enumerate([[("a", at(56), 1), ("a", at(58), 2)], [("a", at(57), 3), ("b", at(59), 4), ("b", at(10), 5)]]):
        spark.createDataFrame(data, "k string, ts timestamp, id int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    make = lambda: spark.readStream.schema("k string, ts timestamp, id int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    first = live.run_available(live.first_tick(make(), ["k"], "ts", 60 - F.minute("ts"), 5.5, "id", []), "update", ["k"])
    assert rows(first.select("k", "id"), "k") == [("a", 1), ("b", 4)]
    total = live.run_available(live.window_totals(make(), ["k"], "ts", "1 hour", {"s": F.col("id")}), "update", ["k"])
    with pytest.raises(ValueError):
        live.run_available(make(), "complete")
    assert rows(total.select("k", "n", "s"), "k") == [("a", 3, 6), ("b", 2, 9)]
    assert rows(live.run_available(live.notify_once(make(), ["k"], "ts"), "append").select("k"), "k") == [("a",), ("b",)]


def test_decisions_and_alerts_equal_their_batch_twins(spark, tmp_path):
    base, draw = datetime.datetime(2024, 1, 1, 10), random.Random(1)
    at = lambda m: base + datetime.timedelta(minutes=m)
    every, n = [], 0
    for b in range(4):
        data = []
        for _ in range(40):
            n, key = n + 1, draw.choice("abcdef")
            data.append((key, at(b * 25 + draw.random() * 24 - (5 if draw.random() < 0.3 else 0)), at(20 + 15 * "abcdef".index(key)), n))
        every += data + data[:3]
        spark.createDataFrame(data + data[:3], "k string, ts timestamp, due timestamp, id int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    make = lambda: spark.readStream.schema("k string, ts timestamp, due timestamp, id int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    df = spark.createDataFrame(every, "k string, ts timestamp, due timestamp, id int")
    passed = max(r[1] for r in every) - datetime.timedelta(minutes=10)
    got = live.run_available(stateful.decide(make(), ["k"], "ts", "due", "id", ["id"], late="10 minutes"), "append")
    want = stateful.decide_batch(df.where(F.col("due") < F.lit(passed)), ["k"], "ts", "due", "id", ["id"])
    assert rows(got.where("kind = 'fixed'").select("k", "at", "id"), "k") == rows(want, "k") and len(rows(want)) > 2
    assert got.where("kind = 'provisional'").count() > len(rows(want))
    checks = make().withColumn("bad", F.when(F.col("id") % 7 != 0, F.col("id") % 3 != 0))
    told = live.run_available(stateful.alerts(checks, ["k"], "ts", "bad", resend_hours=0.3, late="10 minutes"), "append")
    twin = df.select("k", F.timestamp_millis(F.unix_millis("ts")).alias("ts"), F.coalesce(F.when(F.col("id") % 7 != 0, F.col("id") % 3 != 0), F.lit(False)).alias("bad")).distinct()
    want = live.alert_state(twin, "k", "ts", "bad", 2, "18 minutes").where(F.col("ts") < F.lit(passed))
    assert rows(told, "k", "at") == rows(want.select("k", "ts", "kind"), "k", "ts") and {r.kind for r in told.collect()} == {"alert", "recovered"}


def test_giving_up_comes_out_when_the_watermark_has_passed(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h, minutes=m)
    for data in ([("a", at(1), 1, "bet"), ("b", at(1), 2, "bet")], [("a", at(2), 3, "result")], [("z", at(20), 4, "bet"), ("z", at(20, 1), 5, "result")]):
        spark.createDataFrame(data, "k string, ts timestamp, id int, what string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    make = lambda: spark.readStream.schema("k string, ts timestamp, id int, what string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    bets = make().where("what = 'bet'").select("k", F.col("ts").alias("bet_ts"), F.col("id").alias("bet"))
    found = make().where("what = 'result'").select(F.col("k").alias("result_key"), F.col("ts").alias("result_ts"), F.col("id").alias("result"))
    out = live.run_available(live.settle_late(bets, found, "k", "bet_ts", "result_ts", how="leftOuter"), "append")
    assert rows(out.select("bet", "result"), "bet") == [(1, 3), (2, None)]


def test_a_replayed_batch_changes_no_swap(spark, tmp_path):
    day = datetime.date(2024, 1, 1)
    first = spark.createDataFrame([("s", day, 0.0)] * 7 + [("t", day, 1.0)] * 13 + [(None, day, 0.0)], "site string, day date, v double")
    second = spark.createDataFrame([("s", day, None)] * 2 + [("s", day, 3.0)] * 4, "site string, day date, v double")
    take = stateful.swap_recorder(str(tmp_path), "site", "day", "v")
    take(first, 0)
    assert rows(stateful.read_swaps(spark, str(tmp_path))) == []
    take(second, 1)
    want = [("s", day, 13, 9)]
    assert rows(stateful.read_swaps(spark, str(tmp_path))) == want
    take(second, 1)
    take(first, 0)
    assert rows(stateful.read_swaps(spark, str(tmp_path))) == want


def test_a_buckets_keys_share_their_calls_to_the_state_store():
    import pandas as pd

    class Store:
        def __init__(self):
            self.held, self.calls, self.timers = None, 0, []

        def getValueState(self, *_):
            return self

        def exists(self):
            self.calls += 1
            return self.held is not None

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls, self.held = self.calls + 1, value

        def clear(self):
            self.calls, self.held = self.calls + 1, None

        def registerTimer(self, at):
            self.calls += 1
            self.timers.append(at)

    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    for processor, columns in ((stateful.Decide(1000), {"due_ms": 1500, "tie_text": "", "what_json": "{}"}), (stateful.Alert(2, 10), {"is_bad": True})):
        store = Store()
        processor.init(store)
        for at in (1000, 1100):
            list(processor.handleInputRows((0,), iter([pd.DataFrame({"who": [str(k) for k in range(500)], "at_ms": at, **columns})]), At(0)))
        told = pd.concat(processor.handleExpiredTimer((0,), At(2000), At(2000)))
        assert len(told) == 500 and set(told["at"]) == ({1000} if isinstance(processor, stateful.Decide) else {1100})
        assert store.calls < 20 and len(store.timers) == 1  # not some for each of 500 keys
