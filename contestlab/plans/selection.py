"""Queries for selection, discovery and streaming, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlab.operators import discover, select, tuples
from contestlab.plans.queries import RESULT, TRIPLES, R, query, results, triples
from contestlab.plans.standins import entrants, parts_of, table
from contestlab.sources.text import cut_fixed_width
from contestlab.streaming import live

WIN = lambda: F.col("finish") == 1


@query(", x as (select *, row_number() over (partition by site, class = 'R' order by price desc, contest, slot) as r from ent), y as (select *, class = 'R' and r <= 3 as sure from x), z as (select *, row_number() over (partition by site, sure order by price desc, contest, slot) as rest, sum(sure::int) over (partition by site) as n from y) select site, contest, slot, class from z where sure or rest <= 8 - n", ent=True)
def t4_top_with_quota(spark: SparkSession, d: str) -> DataFrame:
    found = select.top_with_quota(entrants(spark, d), ["site"], [F.desc("price"), F.asc("contest"), F.asc("slot")], 8, F.col("class") == "R", 3)
    return found.select("site", "contest", "slot", "class")


LISTS = ", a as (select contest, slot, row_number() over (partition by contest order by p desc, slot) as r from ent), b as (select contest, slot, row_number() over (partition by contest order by score, slot) as r from ent), u as (select contest, slot, 1 as list, r from a where r <= 2 union all select contest, slot, 2, r from b where r <= 2)"


def _lists(spark: SparkSession, d: str) -> list[DataFrame]:
    e = entrants(spark, d)
    return [tuples.top_k(e, ["contest"], order, 2) for order in ([F.desc("p"), F.asc("slot")], [F.asc("score"), F.asc("slot")])]


@query(LISTS + ", f as (select contest, slot, min((list, r)) as t from u group by all) select contest, slot, t[1] as list, row_number() over (partition by contest order by t, slot) as place from f", ent=True)
def t5_union_ordered(spark: SparkSession, d: str) -> DataFrame:
    return select.union_ordered(_lists(spark, d), "contest", "slot", "rank")


@query(LISTS + " select 'both' as kind, count(*) as n from (select contest, slot from u where list = 1 intersect select contest, slot from u where list = 2) union all select 'first', count(*) from (select contest, slot from u where list = 1 except select contest, slot from u where list = 2) union all select 'either', count(*) from (select contest, slot from u where list = 1 union select contest, slot from u where list = 2)", ent=True)
def t6_set_ops(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.select("contest", "slot") for x in _lists(spark, d))
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in (("both", a.intersect(b)), ("first", a.subtract(b)), ("either", a.union(b).distinct()))]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("with o as (select c_custkey, c_custkey % 3 as missed from customer where c_mktsegment <> 'BUILDING'), s as (select distinct o_custkey as c_custkey from orders where o_orderstatus = 'F') select c_custkey, case when s.c_custkey is not null then 0 else missed + 1 end as missed, case when o.c_custkey is null then 'added' when s.c_custkey is not null and missed > 0 then 'restored' when s.c_custkey is not null then 'updated' when missed + 1 >= 2 then 'inactive' else 'missing' end as status from o full join s using (c_custkey)")
def t7_roster_merge(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey", (F.col("c_custkey") % 3).alias("missed"))
    seen = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return select.roster_merge(old, seen, "c_custkey", "missed", 2)


UPSERT_SQL = "with a as (select o_custkey, max(o_orderkey) as v from orders where o_orderdate < timestamp '1998-01-01' group by 1), b as (select o_custkey, max(o_orderkey) as v from orders where o_orderdate >= timestamp '1997-01-01' group by 1)"


@query(UPSERT_SQL + " select o_custkey, coalesce(b.v, a.v) as v, case when a.v is null then 'inserted' when b.v is null then 'kept' when a.v = b.v then 'same' else 'updated' end as status from a full join b using (o_custkey)")
def t8_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a, b = (o.where(w).groupBy("o_custkey").agg(F.max("o_orderkey").alias("v")) for w in ("o_orderdate < timestamp '1998-01-01'", "o_orderdate >= timestamp '1997-01-01'"))
    return select.upsert(a, b, ["o_custkey"], ["v"])


@query("select event_id, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1 as current, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as older from events")
def t9_supersede(spark: SparkSession, d: str) -> DataFrame:
    return select.supersede(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "current", "older")


@query(LISTS + " select case when list = 1 then 'favourite' else 'fast' end as strategy, count(*) as bets, sum((finish = 1)::int)::bigint as hits from u join ent using (contest, slot) group by 1", ent=True)
def l1_strategies(spark: SparkSession, d: str) -> DataFrame:
    a, b = _lists(spark, d)
    long = select.strategies({"favourite": a, "fast": b}, "contest", "slot")
    return long.join(entrants(spark, d).select("contest", "slot", "finish"), ["contest", "slot"]).groupBy("strategy").agg(F.count("*").alias("bets"), F.sum(WIN().cast("long")).alias("hits"))


@query(", s as (select contest, max(case when slot = 1 then score end) - max(case when slot = 2 then score end) as lead from ent group by contest) select contest, lead >= 5 as skip, lead from s where lead is not null", ent=True)
def l3_skip_rule(spark: SparkSession, d: str) -> DataFrame:
    return select.skip_rule(entrants(spark, d), "contest", "slot", "score", 5.0)


@query(" select contest, slot, round(p, 8) as p from (select *, row_number() over (partition by contest order by score desc, slot) as k from ent) where k = 1 and slot <> 1 and p >= 0.35", ent=True)
def l5_agreement_ticket(spark: SparkSession, d: str) -> DataFrame:
    return select.agreement_ticket(entrants(spark, d), "contest", "slot", "p", "score", 0.35).withColumn("p", R("p", 8))


LEDGER = ", " + TRIPLES + ", " + RESULT + """, m as (select *, row_number() over (partition by contest order by round(prob, 9) desc, ticket) as k from tri),
led as (select contest, result, (select max(k) from m where m.contest = res.contest and m.ticket = res.result) as model_rank, (select count(*) from m where m.contest = res.contest and k <= 6 and prob >= 0.05) as bought from res),
led2 as (select *, case when model_rank <= 6 and (select max(prob) from m where m.contest = led.contest and m.ticket = led.result) >= 0.05 then model_rank end as hit_place from led)"""


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    tri = triples(spark, d).withColumn("q", F.round("prob", 9))
    picks = tuples.top_k(tri, ["contest"], [F.desc("q"), F.asc("ticket")], 6, "place").where("prob >= 0.05")
    return select.ledger(picks, tri, results(entrants(spark, d)), "contest", "ticket", "q")


@query(LEDGER + " select contest, result, model_rank, bought, hit_place from led2", ent=True)
def l12_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).select("contest", "result", "model_rank", "bought", "hit_place")


@query(LEDGER + " select case when bought = 0 then 'not bought' when hit_place is not null then 'hit' when model_rank <= 12 then 'near' else 'far' end as reason, count(*) as n from led2 group by 1", ent=True)
def l15_day_review(spark: SparkSession, d: str) -> DataFrame:
    return select.day_review(_ledger(spark, d), 12).groupBy("reason").agg(F.count("*").alias("n"))


@query(", " + TRIPLES + " select contest, concat_ws('=', least(s1, s2, s3), s1 + s2 + s3 - least(s1, s2, s3) - greatest(s1, s2, s3), greatest(s1, s2, s3)) as kind, round(sum(prob), 7) as prob from tri group by 1, 2", ent=True)
def l14_unordered(spark: SparkSession, d: str) -> DataFrame:
    tri = triples(spark, d).withColumn("parts", F.split("ticket", "-")).withColumns({f"x{k}": F.get("parts", F.lit(k)) for k in range(3)})
    return select.unordered(tri, "contest", ["x0", "x1", "x2"], "prob").withColumn("prob", R("prob", 7))


BAND = lambda: F.when(F.col("odds") < 2, "short").when(F.col("odds") < 6, "mid").otherwise("long")
BAND_SQL = "case when odds < 2 then 'short' when odds < 6 then 'mid' else 'long' end"


@query(f", e as (select *, {BAND_SQL} as band from ent), s as (select unnest([('band', band), ('class', class), ('slot', slot::varchar)]) as e, finish, odds from e) select e[1] as dimension, e[2] as value, count(*) as n, sum((finish = 1)::int)::bigint as hits, round(sum(case when finish = 1 then odds else 0 end), 4) as returned from s group by all", ent=True)
def e26_split_report(spark: SparkSession, d: str) -> DataFrame:
    found = discover.split_report(entrants(spark, d), {"band": BAND(), "class": F.col("class"), "slot": F.col("slot")}, {"hits": WIN().cast("long"), "returned": F.when(WIN(), F.col("odds")).otherwise(0.0)})
    return found.withColumn("returned", R("returned", 4))


@query(f", g as (select {BAND_SQL} as band, count(*) as n, sum(0.75 / p / odds) as s from ent where finish = 1 group by 1) select band, n, round(case when n >= 1000 then s / n else sum(s) over () / sum(n) over () end, 6) as factor from g", ent=True)
def e27_drift_factors(spark: SparkSession, d: str) -> DataFrame:
    won = entrants(spark, d).where("finish = 1").withColumn("final", F.lit(0.75) / F.col("p"))
    return discover.drift_factors(won, BAND(), "odds", "final", 1000).withColumn("factor", R("factor"))


@query(f" select {BAND_SQL} as band, case when score_rank = 1 then 'first' else 'other' end as other, count(*) as n, round(avg(p), 6) as expected, round(avg((finish = 1)::int), 6) as actual from ent group by 1, 2", ent=True)
def e31_cross_table(spark: SparkSession, d: str) -> DataFrame:
    found = discover.cross_table(entrants(spark, d), BAND(), F.when(F.col("score_rank") == 1, "first").otherwise("other"), "p", WIN())
    return found.withColumns({"expected": R("expected"), "actual": R("actual")})


@query(", s as (select unnest([('site', site::varchar), ('slot', slot::varchar), ('title', title)]) as e, finish from ent), g as (select e[1] as dimension, e[2] as value, count(*) as n, sum((finish = 1)::int)::bigint as hits from s group by all) select dimension, value, n, hits, round(hits / n, 6) as rate, case when hits / n < 0.3 then 'weak' when hits / n >= 0.36 then 'strong' else 'observe' end as verdict from g where n >= 100", ent=True)
def e32_context_audit(spark: SparkSession, d: str) -> DataFrame:
    return discover.context_audit(entrants(spark, d), ["site", "slot", "title"], WIN(), 100, 0.3, 0.36).withColumn("rate", R("rate"))


@query(""", h as (select actor, slot, class, title, grouping(slot, class, title) as mask, count(*) as n, sum((finish = 1)::int) as hits from ent group by actor, cube (slot, class, title) having count(*) >= 12),
w as (select distinct actor, slot, class, title from ent), c as (select w.*, h.mask, h.n, h.hits, row_number() over (partition by w.actor, w.slot, w.class, w.title order by bit_count(h.mask::int), h.n desc, h.mask) as k
from w join h on h.actor = w.actor and (h.mask & 4 <> 0 or h.slot = w.slot) and (h.mask & 2 <> 0 or h.class = w.class) and (h.mask & 1 <> 0 or h.title = w.title))
select actor, slot, class, title, mask, n, round(hits / n, 6) as rate from c where k = 1""", ent=True)
def e34_backoff_history(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    return discover.backoff_history(e, e, "actor", ["slot", "class", "title"], WIN(), 12, parts_of(spark, d, "lineitem")).withColumn("rate", R("rate"))


EXPECTED = """, x as (select *, case when title like '5%' then null else class end as cls from ent), y as (select *, case when cls is null then avg((finish = 1)::int) over (partition by slot) else avg((finish = 1)::int) over (partition by cls, slot) end as expected from x),
g as (select actor, count(*) as n, avg((finish = 1)::int) as observed, avg(expected) as e, sum((finish = 1)::int - expected) / sqrt(sum(expected * (1 - expected))) as z, sum(case when day < date '1998-06-01' then (finish = 1)::int - expected else 0 end) * sum(case when day >= date '1998-06-01' then (finish = 1)::int - expected else 0 end) > 0 as agree from y group by actor)"""


def _expected(spark: SparkSession, d: str) -> DataFrame:
    return discover.expected_rate(entrants(spark, d).withColumn("cls", F.when(~F.col("title").like("5%"), F.col("class"))), ["cls", "slot"], ["slot"], WIN())


def _compared(spark: SparkSession, d: str) -> DataFrame:
    return discover.compare_expected(_expected(spark, d), ["actor"], WIN(), "expected", F.col("day") < F.lit("1998-06-01").cast("date"))


@query(EXPECTED + " select contest, slot, round(expected, 6) as expected from y", ent=True)
def d1_expected_rate(spark: SparkSession, d: str) -> DataFrame:
    return _expected(spark, d).select("contest", "slot", R("expected").alias("expected"))


@query(EXPECTED + " select actor, n, round(observed, 6) as observed, round(e, 6) as expected, round(z, 5) as z, agree from g", ent=True)
def d2_compare_expected(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).select("actor", "n", R("observed").alias("observed"), R("expected").alias("expected"), R("z", 5).alias("z"), "agree")


@query(EXPECTED + " select actor, n, round(z, 5) as z, case when abs(z) >= 2 then 'S' when abs(z) >= 1.2 then 'A' when abs(z) >= 0.5 then 'B' end as grade from g where n >= 20 and abs(observed - e) >= 0.01 and abs(z) >= 0.5 and agree", ent=True)
def d3_rate_findings(spark: SparkSession, d: str) -> DataFrame:
    return discover.rate_findings(_compared(spark, d), 20, 0.01, 0.5, [(2, "S"), (1.2, "A"), (0.5, "B")]).select("actor", "n", R("z", 5).alias("z"), "grade")


@query("select c_custkey, c_name as name, c_custkey / 10.0 as scaled, null::double as bad from customer")
def s15_cut_fixed_width(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "customer").select("c_custkey", F.concat(F.lpad(F.col("c_custkey").cast("string"), 9, " "), F.lit(" xx "), F.rpad("c_name", 30, " ")).alias("line"))
    return cut_fixed_width(lines, "line", {"name": (14, 30, None), "scaled": (1, 9, 10.0), "bad": (11, 2, 1.0)}).drop("line")


# ---- streaming


def stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream; event times need a time zone, here the session's. As a pattern the path may be one file or a folder."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


LEFT = lambda: F.lit(60) - (F.minute("ts") + F.second("ts") / 60)


@query("select user_id, hour, event_id, event_type from (select *, strftime(ts, '%Y-%m-%d %H') as hour, row_number() over (partition by user_id, strftime(ts, '%Y-%m-%d %H') order by ts, event_id) as k from events where 60 - (minute(ts) + second(ts) / 60) <= 5.5) where k = 1")
def r1_first_tick(spark: SparkSession, d: str) -> DataFrame:
    ticks = stream(spark, d).withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    return live.run_available(live.first_tick(ticks, ["user_id", "hour"], "ts", LEFT(), 5.5, "event_id", ["event_type"]), "update", ["user_id", "hour"]).drop("ts")


@query("select strftime(ts, '%Y-%m-%d %H') as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def r6_window_totals(spark: SparkSession, d: str) -> DataFrame:
    found = live.run_available(live.window_totals(stream(spark, d), ["event_type"], "ts", "1 hour", {"total": F.col("value")}), "update", ["start", "event_type"])
    return found.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", R("total", 4).alias("total"))


@query("select distinct user_id, event_type, strftime(ts, '%Y-%m-%d %H') as hour from events")
def r8_notify_once(spark: SparkSession, d: str) -> DataFrame:
    ticks = stream(spark, d).withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    return live.run_available(live.notify_once(ticks, ["user_id", "event_type", "hour"], "ts"), "append").select("user_id", "event_type", "hour")


@query("select distinct user_id, hour, stretch from (select user_id, strftime(ts, '%Y-%m-%d %H') as hour, 60 - (minute(ts) + second(ts) / 60) as m, case when m <= 3 and m > 2 then 1 when m <= 2 and m > 1 then 2 when m <= 1 and m > 0 then 3 end as stretch from events) where stretch is not null")
def r2_late_decisions(spark: SparkSession, d: str) -> DataFrame:
    ticks = stream(spark, d).withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    return live.run_available(live.late_decisions(ticks, ["user_id", "hour"], "ts", LEFT(), [(3, 2), (2, 1), (1, 0)]), "append").select("user_id", "hour", "stretch")


@query("select event_id, round((epoch(date_trunc('second', w.last)) - epoch(date_trunc('second', ts))) / 60, 4) as minutes_left from events join (select user_id, max(ts) as last from events group by user_id) w using (user_id)")
def r3_quote_stream(spark: SparkSession, d: str) -> DataFrame:
    deadlines = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("deadline"))
    return live.run_available(live.quote_stream(stream(spark, d), deadlines, "user_id", "ts", "deadline"), "append").select("event_id", R("minutes_left", 4).alias("minutes_left"))


@query("select a.event_id as bet, b.event_id as result from events a join events b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'purchase' and b.ts >= a.ts + interval 6 minutes and b.ts <= a.ts + interval 12 hours")
def r4_settle_late(spark: SparkSession, d: str) -> DataFrame:
    bets = stream(spark, d).where("event_type = 'click'").select("user_id", F.col("ts").alias("bet_ts"), F.col("event_id").alias("bet"))
    found = stream(spark, d).where("event_type = 'purchase'").select(F.col("user_id").alias("result_key"), F.col("ts").alias("result_ts"), F.col("event_id").alias("result"))
    return live.run_available(live.settle_late(bets, found, "user_id", "bet_ts", "result_ts"), "append").select("bet", "result")


@query("select user_id, event_id, age from (select user_id, q.event_id as event_id, row_number() over (partition by user_id order by q.ts desc, q.event_id desc) as age from (select user_id, min({'ts': ts, 'event_id': event_id}) as q from events group by user_id, floor(epoch(ts) / 240))) where age <= 12")
def r5_bounded_history(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.bounded_history(events, "user_id", "ts", "event_id", 4, 12).select("user_id", "event_id", "age")


@query("select strftime(s, '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 4) as total from (select *, unnest([time_bucket(interval 30 minutes, ts), time_bucket(interval 30 minutes, ts) - interval 30 minutes]) as s from events) group by 1, 2")
def r6_sliding_totals(spark: SparkSession, d: str) -> DataFrame:
    found = live.run_available(live.window_totals(stream(spark, d), ["event_type"], "ts", "1 hour", {"total": F.col("value")}, slide="30 minutes"), "update", ["start", "event_type"])
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", R("total", 4).alias("total"))


@query("""select user_id, count(*) as n, round(sum(value), 4) as total from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from (select *, (lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 3 hours)::int as new from events)) group by user_id, s""")
def r6_session_totals(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.session_totals(events, ["user_id"], "ts", "3 hours", {"total": F.col("value")}).select("user_id", "n", R("total", 4).alias("total"))


@query("select user_id, mode, event_id from (select user_id, event_type as mode, event_id, row_number() over (partition by user_id order by case event_type when 'purchase' then 0 when 'click' then 1 else 2 end, ts desc, event_id desc) as k from events where ts <= timestamp '2024-01-15 00:00:00' and timestamp '2024-01-15 00:00:00' - ts <= interval 10 days) where k = 1")
def r7_current_prediction(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return live.current_prediction(events, "user_id", "ts", "event_id", now, "event_type", ["purchase", "click"], [], 14400).select("user_id", F.col("event_type").alias("mode"), "event_id")


@query()
def r9_alert_state(spark: SparkSession, d: str) -> DataFrame:
    """Failures are low values of a user's events; no SQL (each alert depends on the last), tested by a plain loop."""
    checks = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("timestamp").alias("ts")).agg(F.min("value").alias("value")).withColumn("bad", F.col("value") < 40)
    return live.alert_state(checks, "user_id", "ts", "bad").withColumn("ts", F.col("ts").cast("string"))
