"""Queries of audits, studies, discovery and late decisions, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestlab.functions import text as T
from contestlab.operators import asof, audit, discover, evaluate, ingest, select, study, tickets, tuples
from contestlab.plans.queries import MARKET, RESULT, TRIPLES, R, daily, query, results, triples
from contestlab.plans.standins import entrants, table

HIT = lambda e: e.withColumn("hit", F.col("finish") == 1)

# ---- audits

#: A ledger of contests with errors at known places, from the entrants.
LEDGER = RESULT + """, led as (select e.contest, case when e.contest % 19 <> 3 then res.result end as result, case when e.contest % 17 = 1 then '9-9' else max(slot) filter (finish = 1) || '-' || max(slot) filter (finish = 2) end as result_pair,
  10.0 * round(max(res.payout) / 10) + e.contest % 2 as payout, 10.0 * round(max(res.payout) / 20) as payout_pair, min(slot) filter (score_rank = 1) as favourite, coalesce(max((finish = 1 and score_rank = 1)::int), 0) = 1 as favourite_won,
  e.contest % 23 = 0 as cancelled, (e.contest % 200)::double as minutes_since, e.contest % 4 <> 0 as bought, [res.result] as picks, case when e.contest % 5 = 0 then 150.0 else 100.0 end as stake,
  case when e.contest % 7 <> 0 then 10.0 * round(max(res.payout) / 10) + (e.contest % 13 = 0)::int end as returned, e.contest % 11 <> 0 as hit, max(day) as day
  from ent e join res using (contest) group by e.contest, res.result)"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    slot = lambda c: F.max(F.when(c, F.col("slot")))
    first = e.groupBy("contest").agg(slot(F.col("finish") == 1).alias("a"), slot(F.col("finish") == 2).alias("b"), F.min(F.when(F.col("score_rank") == 1, F.col("slot"))).alias("favourite"),
                                     (F.coalesce(F.max(((F.col("finish") == 1) & (F.col("score_rank") == 1)).cast("int")), F.lit(0)) == 1).alias("favourite_won"), F.max("day").alias("day"))
    rows, c = first.join(results(e), "contest"), F.col("contest")
    tens = F.lit(10.0) * F.round(F.col("payout") / 10)
    return rows.select(
        "contest", F.when(c % 19 != 3, F.col("result")).alias("result"), F.when(c % 17 == 1, "9-9").otherwise(F.concat_ws("-", "a", "b")).alias("result_pair"), (tens + c % 2).alias("payout"),
        (F.lit(10.0) * F.round(F.col("payout") / 20)).alias("payout_pair"), "favourite", "favourite_won", (c % 23 == 0).alias("cancelled"), (c % 200).cast("double").alias("minutes_since"), (c % 4 != 0).alias("bought"),
        F.array("result").alias("picks"), F.when(c % 5 == 0, 150.0).otherwise(100.0).alias("stake"), F.when(c % 7 != 0, tens + (c % 13 == 0).cast("int")).alias("returned"), (c % 11 != 0).alias("hit"), "day")


@query(", " + LEDGER + """, bad as (select contest, unnest([
  case when cancelled and coalesce(stake, 0) > 0 then 'cancelled_but_staked' end, case when settled and split_part(result, '-', 1) || '-' || split_part(result, '-', 2) <> result_pair then 'pair_differs' end,
  case when settled and (payout < 100 or payout % 10 <> 0) then 'payout_odd' end, case when settled and (payout_pair < 100 or payout_pair % 10 <> 0) then 'pair_payout_odd' end,
  case when settled and favourite_won <> (favourite::varchar = split_part(result, '-', 1)) then 'favourite_flag' end, case when result is null and not cancelled and minutes_since > 90 then 'result_missing' end,
  case when not cancelled and not bought and stake > 0 then 'staked_not_bought' end, case when not cancelled and bought and stake <> 100 then 'stake_differs' end,
  case when settled and bought and hit <> list_contains(picks, result) then 'hit_flag' end,
  case when settled and bought and returned is not null and returned <> case when list_contains(picks, result) then payout else 0 end then 'return_differs' end,
  case when settled and bought and returned is null and list_contains(picks, result) then 'return_missing' end]) as "check" from (select *, result is not null and not cancelled as settled from led))
select "check", count(*) as n, array_to_string(list_sort(list(contest))[1:3], ',') as examples from bad where "check" is not null group by 1""", ent=True)
def q1_ledger_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit(ledger(spark, d), audit.ledger_checks(), "contest")


@query(", " + LEDGER + """, t as (select day, sum(stake) as stake, sum(coalesce(returned, 0)) + (day(day) % 5 = 0)::int as returned from led group by day), m as (select day, sum(stake) as stake, sum(coalesce(returned, 0)) as returned from led group by day)
select cast(day as varchar) as day, m.stake::double as rows_stake, t.stake::double as total_stake, m.returned::double as rows_returned, t.returned::double as total_returned from m join t using (day) where m.stake <> t.stake or m.returned <> t.returned""", ent=True)
def q2_audit_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger(spark, d).withColumn("returned", F.coalesce("returned", F.lit(0.0)))
    totals = rows.groupBy("day").agg(F.sum("stake").alias("stake"), (F.sum("returned") + (F.dayofmonth("day") % 5 == 0).cast("int")).alias("returned"))
    return audit.audit_rollup(rows, totals, ["day"], ["stake", "returned"]).withColumn("day", F.col("day").cast("string"))


@query(""", x as (select *, (score < 5)::int as e1, (discount is null or discount > 0.08)::int as w1, (price < 2000)::int as i1,
  (class is not null and count(*) over (partition by contest, class) > 1 and row_number() over (partition by contest, class order by slot) = 1)::int as d1 from ent)
select contest, count(*) as rows, (sum(e1) + sum(d1))::bigint as errors, (sum(w1) + (count(*) < 6)::int)::bigint as warnings, sum(i1)::bigint as infos, sum(e1) + sum(d1) = 0 and count(*) = 6 as ready from x group by contest""", ent=True)
def q3_validate(spark: SparkSession, d: str) -> DataFrame:
    rules = [("error", "low score", F.col("score") < 5), ("warning", "discount", F.col("discount").isNull() | (F.col("discount") > 0.08)), ("info", "cheap", F.col("price") < 2000)]
    return audit.validate(entrants(spark, d), "contest", 6, rules, {"class twice": "class"})


@query(""", b as (select class, day, count(*) as bets, sum((finish = 1)::int) as hits, 100.0 * count(*) as stake, sum(case when finish = 1 then 100 * odds else 0 end) as returned from ent where slot = 1 group by class, day)
select class, cast(date_trunc('week', day) as date)::varchar as week, count(*) as days, sum(bets)::bigint as bets, sum(hits)::bigint as hits, round(sum(stake)::double, 4) as stake, round(sum(returned), 4) as returned,
  sum((returned > stake)::int)::bigint as days_up, round(min(returned - stake), 4) as worst_day, round(sum(returned) / sum(stake), 6) as roi from b group by 1, 2""", ent=True)
def q4_weekly(spark: SparkSession, d: str) -> DataFrame:
    bets = HIT(entrants(spark, d).where("slot = 1")).withColumns({"stake": F.lit(100.0), "returned": F.when(F.col("finish") == 1, 100 * F.col("odds")).otherwise(0.0)})
    found = audit.weekly(bets, "day", ["class"]).withColumn("week", F.col("week").cast("string"))
    return found.withColumns({c: R(c, 4) for c in ("stake", "returned", "worst_day")}).withColumn("roi", R("roi"))


# ---- studies

MODELS = "m as (select actor, round(avg(score), 6) as loss from ent where slot <= 3 group by actor), o as (select actor, round(avg(score), 6) as loss from ent where slot >= 3 group by actor)"


@query(", " + MODELS + " select coalesce(m.actor, o.actor) as actor, case when o.actor is null or (m.actor is not null and m.loss < o.loss - 0.5) then m.loss else o.loss end as loss, coalesce(o.actor is null or m.loss < o.loss - 0.5, false) as adopted from m full join o on m.actor = o.actor", ent=True)
def e3_adopt_if(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda c: entrants(spark, d).where(c).groupBy("actor").agg(R(F.avg("score")).alias("loss"))
    return study.adopt_if(mean("slot <= 3"), mean("slot >= 3"), "actor", "loss", 0.5)


@query(""", v as (select unnest([0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0])::double as value), c as (select contest, value, ln(sum(p ** value)) - sum(case when finish = 1 then value * ln(p) end) as loss from ent, v group by 1, 2),
t as (select value, avg(loss) as l from c group by value) select value, round(l, 6) as log_loss, value = arg_min(value, (round(l, 9), value)) over () as best from t""", ent=True)
def e4_tune_1d(spark: SparkSession, d: str) -> DataFrame:
    found = study.tune_1d(HIT(entrants(spark, d)), "contest", "hit", [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0], lambda v: F.pow(F.col("p"), v))
    return found.withColumn("log_loss", R("log_loss"))


@query()
def e5_coordinate_fit(spark: SparkSession, d: str) -> DataFrame:
    """Multipliers of the score by class; no SQL (the passes depend on one another), tested by brute force."""
    e = HIT(entrants(spark, d))
    fitted = study.coordinate_fit(e, "contest", "score", "hit", "class", ["A", "N", "R"], [0.6, 0.7, 0.8, 0.9, 0.95, 1.0, 1.05, 1.1, 1.2, 1.3, 1.4, 1.6])
    fitted = F.create_map(*[F.lit(x) for k, v in sorted(fitted.items()) for x in (k, v)])
    return e.groupBy("class").agg(F.count("*").alias("n")).withColumn("multiplier", fitted[F.col("class")])


DAYS = "dp as (select day, sum(case when finish = 1 then 100 * odds else 0 end) - 100.0 * count(*) as profit from ent where slot = 1 group by day)"


@query(", " + DAYS + """, r as (select day, profit, unnest(range(1, 201)) as rep from dp), b as (select rep, profit, 20000 + sum(profit) over (partition by rep order by md5(rep::varchar || ':' || day::varchar), day rows between unbounded preceding and current row) as bank from r),
s as (select rep, least(min(bank), 20000) as low, 20000 + sum(profit) as fin from b group by rep) select round(avg((low < 2000)::int), 6) as bust, round(avg((low < 10000)::int), 6) as half, round(avg((round(fin, 6) > 20000)::int), 6) as up from s""", ent=True)
def e8_permutation_risk(spark: SparkSession, d: str) -> DataFrame:
    days = entrants(spark, d).where("slot = 1").groupBy("day").agg((F.sum(F.when(F.col("finish") == 1, 100 * F.col("odds")).otherwise(0.0)) - 100.0 * F.count("*")).alias("profit"))
    found = study.permutation_risk(days, "day", "profit", 20000.0)
    return found.select(*[R(c).alias(c) for c in found.columns])


@query(""", b as (select slot, 100.0 as s, case when finish = 1 then 100 * odds else 0 end as r from ent), a as (select slot, count(*) as bets, sum(s) as s, sum(r) as r, sum(r * r) as rr, sum(r * s) as rs, sum(s * s) as ss from b group by slot),
c as (select slot, bets, r / s as roi, sqrt(greatest(rr - 2 * (r / s) * rs + (r / s) ** 2 * ss, 0)) / s as se from a)
select slot, bets, round(roi, 6) as roi, round(se, 6) as se, case when roi > 1 then ceil(round(bets * ((1.6448536269514715 + 0.8416212335729143) * se / (roi - 1)) ** 2, 6))::bigint end as need from c""", ent=True)
def e9_required_n(spark: SparkSession, d: str) -> DataFrame:
    b = entrants(spark, d).withColumns({"s": F.lit(100.0), "r": F.when(F.col("finish") == 1, 100 * F.col("odds")).otherwise(0.0)})
    return study.required_n(b, ["slot"], "s", "r", 0.05).withColumns({"roi": R("roi"), "se": R("se")})


@query(""", n as (select class, count(distinct actor) as n from ent group by class) select class, n, case when n > 1 then round(sqrt(2 * ln(n)) - (ln(ln(n)) + ln(4 * pi())) / (2 * sqrt(2 * ln(n))), 6) else 0 end as luck from n""", ent=True)
def e10_best_of(spark: SparkSession, d: str) -> DataFrame:
    return entrants(spark, d).groupBy("class").agg(F.count_distinct("actor").alias("n")).withColumn("luck", R(study.expected_best_of(F.col("n"))))


@query(", " + LEDGER + """, t as (select day, sum(stake) as stake, sum(stake) + (day(day) % 3 = 0)::int as total from led group by day) select contest, cast(day as varchar) as day from led join t using (day) where round(t.stake, 6) = round(t.total, 6)""", ent=True)
def e11_reconciled(spark: SparkSession, d: str) -> DataFrame:
    led = ledger(spark, d)
    totals = led.groupBy("day").agg((F.sum("stake") + (F.dayofmonth("day") % 3 == 0).cast("int")).alias("stake"))
    return study.reconciled(led, totals, "day", ["stake"]).select("contest", F.col("day").cast("string").alias("day"))


@query(", " + MARKET + """, cum as (select contest, slot, odds, sum(market) over (partition by contest order by slot) as hi, lag(market, 1, 0.0) over (partition by contest order by slot) as _, row_number() over (partition by contest order by slot desc) = 1 as last from mk),
lo as (select *, coalesce(lag(hi) over (partition by contest order by slot), 0) as low from cum), r as (select contest, unnest(range(1, 201)) as sim from (select distinct contest from ent)),
u as (select *, ('0x' || substr(md5(contest::varchar || ':' || sim::varchar), 1, 8))::bigint / 4294967296.0 as u from r),
w as (select sim, slot, odds from u join lo using (contest) where u > low and (u <= hi or last) or u <= 0 and low = 0), n as (select slot, count(*) as n, sum(case when finish = 1 then odds else 0 end) as back from ent group by slot),
top as (select sim, max(b / n) as top from (select sim, slot, sum(odds) as b from w group by sim, slot) join n using (slot) group by sim),
best as (select slot as best, round(back / n, 9) as roi from n order by round(back / n, 9) desc, slot limit 1)
select best, round(roi, 6) as roi, round((1 + sum((round(top, 9) >= roi)::int)) / 201.0, 6) as p from top, best group by best, roi""", ent=True)
def e12_null_max_test(spark: SparkSession, d: str) -> DataFrame:
    e = HIT(tuples.implied(entrants(spark, d), "contest", "odds"))
    found = study.null_max_test(e, "contest", "slot", "market", "odds", "hit")
    return found.select("best", R("roi").alias("roi"), R("p").alias("p"))


GRID = """cell as (select theta::double as theta, k, lo::double as lo, hi::double as hi, side from (select unnest([0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2]) as theta), (select unnest([1, 2, 3]) as k),
 (select unnest([0, 3, 4, 5, 7]) as lo, unnest([100, 4, 5, 7, 12]) as hi), (select unnest(['all', 'outer', 'class_r', 'slow']) as side)),
sp as (select max(day) filter (b <= 6) as cut from (select day, ntile(10) over (order by day) as b from (select distinct day from ent))),
rk as (select p * odds as ev, odds, finish = 1 as hit, day > cut as later, slot, class, score_rank, row_number() over (partition by contest order by round(p * odds, 9) desc, slot) as rank from ent, sp),
found as (select theta, k, lo, hi, side, count(*) filter (not later) as first_bets, sum(case when hit then odds else 0 end) filter (not later) / nullif(count(*) filter (not later), 0) as first_roi,
 count(*) filter (later) as second_bets, sum(case when hit then odds else 0 end) filter (later) / nullif(count(*) filter (later), 0) as second_roi
 from rk join cell on round(ev, 9) >= theta and rank <= k and odds >= lo and odds < hi and (side = 'all' or side = 'outer' and slot > 1 or side = 'class_r' and class = 'R' or side = 'slow' and score_rank > 2) group by all)"""


def rule_cells(spark: SparkSession, d: str) -> DataFrame:
    """420 rules over value, number, odds band and condition, on the first six tenths of the days and on the rest."""
    e = entrants(spark, d)
    cut = evaluate.date_blocks(e.select("day").distinct(), "day", 10).where("block <= 6").agg(F.max("day").alias("cut"))
    arrays = {"theta": [0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2], "k": [1, 2, 3], "side": ["all", "outer", "class_r", "slow"]}
    cells = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in ((0, 100), (3, 4), (4, 5), (5, 7), (7, 12))])).alias("b")).select("b.*")
    for c, values in arrays.items():
        cells = cells.withColumn(c, F.explode(F.array(*[F.lit(v) for v in values])))
    conditions = {"all": F.lit(True), "outer": F.col("slot") > 1, "class_r": F.col("class") == "R", "slow": F.col("score_rank") > 2}
    return study.rule_search(HIT(e).join(F.broadcast(cut)), cells, "contest", "day", "p", "odds", "hit", "slot", F.col("day") > F.col("cut"), conditions)


@query(", " + GRID + " select theta, k, lo, hi, side, first_bets, round(first_roi, 6) as first_roi, second_bets, round(second_roi, 6) as second_roi from found", ent=True)
def e13_rule_search(spark: SparkSession, d: str) -> DataFrame:
    return rule_cells(spark, d).withColumns({"first_roi": R("first_roi"), "second_roi": R("second_roi")})


@query(", " + GRID + " select theta, k, lo, hi, side, first_bets, round(first_roi, 6) as first_roi, second_bets, round(second_roi, 6) as second_roi from found where first_bets >= 50 order by round(first_roi, 9) desc, theta, k, lo, hi, side limit 1", ent=True)
def e14_band_search(spark: SparkSession, d: str) -> DataFrame:
    return study.best_rule(rule_cells(spark, d), 50).withColumns({"first_roi": R("first_roi"), "second_roi": R("second_roi")})


@query(""", d as (select score, count(*) as n, sum((finish = 1)::int) as h from ent group by score), q as (select *, floor(5 * coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) / sum(n) over ())::bigint + 1 as part from d)
select part, sum(n)::bigint as n, round(sum(h) / sum(n), 6) as rate, min(score) as lo, max(score) as hi from q group by part""", ent=True)
def e16_quantile_table(spark: SparkSession, d: str) -> DataFrame:
    return study.quantile_table(HIT(entrants(spark, d)), "score", "hit").withColumn("rate", R("rate"))


@query(", " + MARKET + """, l as (select contest, max(day) as day, sum(case when finish = 1 then ln(greatest(p, 1e-9)) - ln(greatest(market, 1e-9)) end) as d from mk group by contest), la as (select max(day) as last from ent),
f as (select d, floor(date_diff('day', day, last) / 200.0)::int as fold from l, la), g as (select * from f where fold between 0 and 3 and d is not null), e as (select fold, sum(d) as s from g group by fold),
a as (select count(*) as n, avg(d) as mean, stddev_samp(d) / sqrt(count(*)) as se from g), b as (select count(*) as folds, sum((s > 0)::int)::bigint as helped from e)
select n, folds, helped, round(mean, 6) as mean, round(mean / se, 4) as z, case when mean / se >= 2 and helped >= ceil(folds * 0.75) then 'better' when mean / se <= -2 and folds - helped >= ceil(folds * 0.75) then 'worse' else 'unclear' end as verdict from a, b""", ent=True)
def e17_paired_verdict(spark: SparkSession, d: str) -> DataFrame:
    e = tuples.implied(entrants(spark, d), "contest", "odds")
    gain = F.sum(F.when(F.col("finish") == 1, F.log(F.greatest("p", F.lit(1e-9))) - F.log(F.greatest("market", F.lit(1e-9)))))
    each = e.groupBy("contest").agg(F.max("day").alias("day"), gain.alias("d")).join(F.broadcast(e.agg(F.max("day").alias("last"))))
    found = study.paired_verdict(each.withColumn("fold", study.fold_of(F.col("day"), F.col("last"), 200, 4)), "fold", "d")
    return found.withColumns({"mean": R("mean"), "z": R("z", 4)})


@query(", " + MARKET + """, r as (select *, max((finish = 1 and slot = 1)::int) over (partition by contest) as gone from mk), s as (select contest, slot, finish = 1 as hit, p / sum(p) over w as a, market / sum(market) over w as b from r where gone = 0 and slot <> 1 window w as (partition by contest)),
t as (select *, (a + b) / 2 as c from s), e as (select contest, sum(case when hit then -ln(greatest(a, 1e-9)) end) as la, sum(case when hit then -ln(greatest(b, 1e-9)) end) as lb, sum(case when hit then -ln(greatest(c, 1e-9)) end) as lc,
 arg_max(hit::int, (round(a, 9), -slot)) as ta, arg_max(hit::int, (round(b, 9), -slot)) as tb, arg_max(hit::int, (round(c, 9), -slot)) as tc from t group by contest)
select count(*) as n, round(avg(ta), 6) as model_hit, round(avg(la), 6) as model_loss, round(avg(tb), 6) as market_hit, round(avg(lb), 6) as market_loss, round(avg(tc), 6) as average_hit, round(avg(lc), 6) as average_loss,
 round(avg(lb - la) / (stddev_samp(lb - la) / sqrt(count(*))), 4) as z from e where la is not null""", ent=True)
def e24_conditional_eval(spark: SparkSession, d: str) -> DataFrame:
    found = study.conditional_eval(HIT(tuples.implied(entrants(spark, d), "contest", "odds")), "contest", "slot", "p", "market", "hit")
    return found.select("n", *[R(c).alias(c) for c in found.columns if c not in ("n", "z")], R("z", 4).alias("z"))


@query(""", x as (select day, class = 'R' as rough, slot, case when finish = 1 then 100 * odds else 0 end as back from ent where slot <= 2),
y as (select day, 'as before' as plan, case when slot = 1 then 100.0 else 0 end as s, back from x union all select day, 'switch', case when slot = case when rough then 2 else 1 end then 100.0 else 0 end, back from x union all select day, 'skip', case when slot = 1 and not rough then 100.0 else 0 end, back from x),
z as (select plan, day, sum(s) as stake, sum(back) as back, count(*) as bets, sum((back > 0)::int) as hits from y where s > 0 group by plan, day)
select plan, round(sum(back) / sum(stake), 6) as roi, round(sum(hits) / sum(bets), 6) as hit_rate, round(stddev_pop(back / stake), 6) as spread, count(*) as days, round(min(back - stake), 4) as worst_day from z group by plan""", ent=True)
def e25_regime_switch(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d).where("slot <= 2").withColumn("back", F.when(F.col("finish") == 1, 100 * F.col("odds")).otherwise(0.0))
    rough, stake = F.col("class") == "R", lambda c: F.when(c, 100.0).otherwise(0.0)
    plans = {"as before": stake(F.col("slot") == 1), "switch": stake(F.col("slot") == F.when(rough, 2).otherwise(1)), "skip": stake((F.col("slot") == 1) & ~rough)}
    found = study.regime_switch(e, "day", {k: (s, F.col("back")) for k, s in plans.items()})
    return found.select("plan", R("roi").alias("roi"), R("hit_rate").alias("hit_rate"), R("spread").alias("spread"), "days", R("worst_day", 4).alias("worst_day"))


@query(""", b as (select round(p * odds, 9) as ev, slot > 3 as second, 100.0 as stake, case when finish = 1 then 100 * odds else 0 end as returned, unnest([0.6, 0.75, 0.9])::double as threshold from ent)
select threshold, ev >= threshold as kept, second, count(*) as bets, round(sum(returned) / sum(stake), 6) as roi from b group by 1, 2, 3""", ent=True)
def e28_ev_filter_study(spark: SparkSession, d: str) -> DataFrame:
    b = entrants(spark, d).withColumns({"stake": F.lit(100.0), "returned": F.when(F.col("finish") == 1, 100 * F.col("odds")).otherwise(0.0)})
    return study.ev_filter_study(b, F.round(F.col("p") * F.col("odds"), 9), [0.6, 0.75, 0.9], F.col("slot") > 3, "stake", "returned").withColumn("roi", R("roi"))


@query(", v as (select contest, arg_max(slot, (round(p, 9), -slot)) as choice, max(p) as p, max(slot) filter (finish = 1 and odds < 8) as winner from ent group by contest) select contest, choice, winner, case when p < 0.25 or winner is null then 'not applicable' when choice = winner then 'match' else 'mismatch' end as verdict from v", ent=True)
def e33_verify(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d).withColumn("hit", (F.col("finish") == 1) & (F.col("odds") < 8))
    return study.verify(e, "contest", "slot", "p", "hit", 0.25)


@query(", m as (select class, left(cast(day as varchar), 7) as month, round(avg(case when finish = 1 then -ln(p) end), 6) as loss from ent group by 1, 2) select class, month, loss, round(loss - lag(loss) over w, 6) as change, round(loss - first(loss) over w, 6) as from_first from m window w as (partition by class order by month)", ent=True)
def e37_history_table(spark: SparkSession, d: str) -> DataFrame:
    runs = entrants(spark, d).groupBy("class", F.date_format("day", "yyyy-MM").alias("month")).agg(R(F.avg(F.when(F.col("finish") == 1, -F.log("p")))).alias("loss"))
    return study.history_table(runs, ["class"], "month", "loss").withColumns({"change": R("change"), "from_first": R("from_first")})


@query(""", r as (select class, rank() over (partition by contest order by score) + (count(*) over (partition by contest, score) - 1) / 2.0 as a, rank() over (partition by contest order by price) + (count(*) over (partition by contest, price) - 1) / 2.0 as b from ent)
select class, count(*) as n, round(corr(a, b), 6) as spearman from r group by class""", ent=True)
def a23_spearman(spark: SparkSession, d: str) -> DataFrame:
    return study.spearman(entrants(spark, d), ["class"], "contest", "score", "price").withColumn("spearman", R("spearman"))


@query("select cast(day as varchar) as day, count(*) as n, case when count(*) > 2 and stddev_pop(score) > 0 and stddev_pop(price) > 0 then round(corr(score, price), 6) end as pearson from ent group by day", ent=True)
def a23_pearson_by_day(spark: SparkSession, d: str) -> DataFrame:
    found = study.pearson(entrants(spark, d), ["day"], "score", "price")
    return found.select(F.col("day").cast("string").alias("day"), "n", F.when(F.col("n") > 2, R("pearson")).alias("pearson"))


@query()
def e23_conditional_logit(spark: SparkSession, d: str) -> DataFrame:
    """Weights of score and discount in the winner's softmax; no SQL (Newton steps), tested against a plain solver."""
    e = HIT(entrants(spark, d)).withColumns({"x1": F.col("score") / 50, "x2": F.col("discount") * 10})
    w = study.conditional_logit(e, "contest", "hit", ["x1", "x2"])
    return e.groupBy("class").agg(F.count("*").alias("n"), *[F.lit(round(x, 6)).alias(f"w_{n}") for n, x in zip(("score", "discount"), w)])


# ---- discovery

EXPECT = "ex as (select e.*, (finish <= 3)::int as y, avg((finish <= 3)::int) over (partition by class, slot) as x, day >= date '1995-06-01' as second from ent e)"


def expected(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d).withColumn("y", (F.col("finish") <= 3).cast("int"))
    return e.withColumn("x", F.avg("y").over(Window.partitionBy("class", "slot"))).withColumn("second", F.col("day") >= F.lit("1995-06-01").cast("date"))


INFLUENCE = """h as (select contest, actor as head from ex where slot = 1), g as (select head as actor, slot, count(*) as n, avg(y) as rate, avg(x) as base, sum(y - x) as dd, sum(x * (1 - x)) as v, sum(case when not second then y - x end) as early, sum(case when second then y - x end) as late
 from ex join h using (contest) where slot <> 1 group by 1, 2), inf as (select actor, slot, n, rate, base, dd / sqrt(v) as z from g where v > 0 and n >= 5 and rate >= base + 0.02 and dd / sqrt(v) >= 0.5 and early > 0 and late > 0)"""
SHIFT = """b as (select avg((score_rank < slot)::int) as base from ex where slot >= 2), sg as (select actor, count(*) as n, avg((score_rank < slot)::int) as rate, avg((score_rank < slot)::int) filter (not second) as early, avg((score_rank < slot)::int) filter (second) as late from ex where slot >= 2 group by actor),
sh as (select actor, n, rate, base, (rate - base) / sqrt(base * (1 - base) / n) as z from sg, b where n >= 10 and rate >= 0.25 and (rate - base) / sqrt(base * (1 - base) / n) >= 0.5 and early > base and late > base)"""
FLAGS = """u as (select avg(score) filter (discount > 0.05) - avg(score) filter (discount <= 0.05) as usual from ex), fg as (select actor, count(*) filter (discount > 0.05) as n_with, count(*) filter (discount <= 0.05) as n_without, avg(score) filter (discount > 0.05) - avg(score) filter (discount <= 0.05) as gap,
 stddev_samp(score) filter (discount > 0.05) as s1, stddev_samp(score) filter (discount <= 0.05) as s0 from ex group by actor),
fl as (select actor, n_with, n_without, gap, usual, (gap - usual) / ((s1 + s0) / 2 * sqrt(1.0 / n_with + 1.0 / n_without)) as z from fg, u where n_with >= 5 and n_without >= 5 and gap - usual >= 0.5 and (gap - usual) / ((s1 + s0) / 2 * sqrt(1.0 / n_with + 1.0 / n_without)) >= 0.5)"""


def influence(ex: DataFrame) -> DataFrame:
    return discover.influence_findings(ex, "contest", "slot", "actor", "y", "x", "second", 1, 5, 0.02, 0.5)


def shifted(ex: DataFrame) -> DataFrame:
    return discover.shift_findings(ex.where("slot >= 2"), "actor", F.col("score_rank") < F.col("slot"), "second", 10, 0.25, 0.5)


def flagged(ex: DataFrame) -> DataFrame:
    return discover.flag_effect_findings(ex, "actor", F.col("discount") > 0.05, "score", 5, 5, 0.5, 0.5)


@query(", " + EXPECT + ", " + INFLUENCE + " select actor, slot, n, round(rate, 6) as rate, round(base, 6) as base, round(z, 4) as z from inf", ent=True)
def d4_influence(spark: SparkSession, d: str) -> DataFrame:
    return influence(expected(spark, d)).select("actor", "slot", "n", R("rate").alias("rate"), R("base").alias("base"), R("z", 4).alias("z"))


@query(", " + EXPECT + ", " + SHIFT + " select actor, n, round(rate, 6) as rate, round(base, 6) as base, round(z, 4) as z from sh", ent=True)
def d5_shift(spark: SparkSession, d: str) -> DataFrame:
    return shifted(expected(spark, d)).select("actor", "n", R("rate").alias("rate"), R("base").alias("base"), R("z", 4).alias("z"))


@query(", " + EXPECT + ", " + FLAGS + " select actor, n_with, n_without, round(gap, 6) as gap, round(usual, 6) as usual, round(z, 4) as z from fl", ent=True)
def d6_flag_effect(spark: SparkSession, d: str) -> DataFrame:
    return flagged(expected(spark, d)).select("actor", "n_with", "n_without", R("gap").alias("gap"), R("usual").alias("usual"), R("z", 4).alias("z"))


@query(", " + EXPECT + ", " + INFLUENCE + ", " + SHIFT + ", " + FLAGS + """, every as (select actor, 'influence' as finding, max(z) as z from inf group by actor union all select actor, 'shift', z from sh union all select actor, 'flag', z from fl)
select actor, finding, round(z, 4) as z from (select *, row_number() over (partition by actor order by round(abs(z), 9) desc, finding) as k from every) where k <= 2""", ent=True)
def d7_discover(spark: SparkSession, d: str) -> DataFrame:
    ex = expected(spark, d)
    found = {"influence": influence(ex).groupBy("actor").agg(F.max("z").alias("z")), "shift": shifted(ex), "flag": flagged(ex)}
    return discover.discover(found, "actor", 2).withColumn("z", R("z", 4))


PROFILE = "pr as (select actor, slot, count(*) as n, avg((finish = 1)::int) as win, avg(score_rank) as start, avg((finish >= 5)::int) as wall from ent group by actor, slot)"


def profiles(spark: SparkSession, d: str) -> DataFrame:
    return entrants(spark, d).groupBy("actor", "slot").agg(F.count("*").alias("n"), F.avg((F.col("finish") == 1).cast("int")).alias("win"), F.avg("score_rank").alias("start"), F.avg((F.col("finish") >= 5).cast("int")).alias("wall"))


@query(", " + PROFILE + """ select actor, slot, n, concat_ws(',', case when n >= 3 and slot = 1 and win >= 0.85 then 'iron_front' end, case when n >= 3 and round(win, 9) >= round(ln + 0.1, 9) then 'winner_s' when n >= 3 and win >= ln then 'winner_a' end,
 case when n >= 3 and slot >= 2 and wall <= 0.3 then 'breaks_front' end, case when n >= 3 and start <= 1.5 then 'starter_s' when n >= 3 and start <= 2 then 'starter_a' end) as flags
from (select *, case slot when 2 then 0.2 when 3 then 0.25 when 4 then 0.3 when 5 then 0.2 end as ln from pr)""", ent=True)
def d8_ability_flags(spark: SparkSession, d: str) -> DataFrame:
    found = discover.ability_flags(profiles(spark, d), "slot", "n", "win", "start", "wall", {2: 0.2, 3: 0.25, 4: 0.3, 5: 0.2}, 3)
    return found.select("actor", "slot", "n", F.array_join("flags", ",").alias("flags"))


# ---- ingestion, text and joins that were missing


@query(r"select event_id, case when event_id % 3 = 0 then '' else event_type || ',' || user_id::varchar end as picks from events")
def s5_json_collect(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    bet = lambda c: F.struct(F.col(c).cast("string").alias("combination"))
    deep = F.to_json(F.struct(F.struct(F.struct(F.when(F.col("event_id") % 3 != 0, F.array(bet("event_type"), bet("user_id"))).alias("x")).alias("cover"), F.lit("no").alias("other")).alias("bets")))
    return e.select("event_id", T.json_collect(deep, ["bets", "cover"], "combination").alias("picks"))


@query("select day::varchar as day, kind as key, n as value from (select cast(ts as date) as day, event_type as kind, count(*) as n from events group by 1, 2) where day < date '2024-01-20' and day(day) % 4 <> 0")
def s19_harvest_state(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    states = counts.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("state"))
    done = states.where(F.dayofmonth("day") % 4 == 0).select("day")
    return ingest.harvest_state(states, "day", "state", "2024-01-20", done).select(F.col("day").cast("string").alias("day"), "key", "value")


@query("select nullif(trim(c_name), '') as name, c_nationkey::varchar as site, case when c_nationkey % 5 = 0 then null else c_mktsegment end as grade, case when c_nationkey % 5 = 0 then 'missing key' when count(*) over (partition by c_nationkey, case when c_nationkey % 5 = 0 then null else c_mktsegment end) > 1 then 'given twice' end as rejected from customer")
def s20_submissions(spark: SparkSession, d: str) -> DataFrame:
    given = table(spark, d, "customer").select(F.col("c_name").alias("Full Name"), F.col("c_nationkey").alias("venue"), F.when(F.col("c_nationkey") % 5 == 0, " ").otherwise(F.col("c_mktsegment")).alias("Class"))
    return ingest.normalise_submissions(given, {"name": ["name", "full name"], "site": ["site", "venue"], "grade": ["grade", "class"]}, ["site", "grade"])


@query(""", s as (select *, avg((class = 'R')::int) over (partition by site, title) as share from ent) select contest, slot, case when title in ('1-URGENT', '2-HIGH') and share >= 0.8 then 'special' else title end as category, share >= 0.25 or contains(title, 'LOW') as double from s""", ent=True)
def f7_refine_category(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d).withColumn("share", F.avg((F.col("class") == "R").cast("int")).over(Window.partitionBy("site", "title")))
    category, double = T.refine_category(F.col("title"), F.col("share"), F.col("title"), ["LOW"], ["1-URGENT", "2-HIGH"], "special")
    return e.select("contest", "slot", category.alias("category"), double.alias("double"))


@query("select event_id, case when user_id % 7 = 0 then null else contains(event_type, 'view') end as first, case when user_id % 7 = 0 then null else contains(event_type, 'cart') or contains(event_type, 'purchase') end as last from events")
def f11_day_flags(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("user_id") % 7 == 0, F.lit(" ")).otherwise(F.col("event_type"))
    first, last = T.day_flags(label, ["view"], ["cart", "purchase"])
    return table(spark, d, "events").select("event_id", first.alias("first"), last.alias("last"))


@query(", g as (select avg((finish = 1)::int) as p0 from ent), a as (select actor, count(*) as n, sum((finish = 1)::int) as k from ent group by actor) select actor, n, round((k + 10 * p0) / (n + 10), 6) as rate from a, g", ent=True)
def f13_shrink(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d).withColumn("y", (F.col("finish") == 1).cast("int"))
    by = e.groupBy("actor").agg(F.count("*").alias("n"), F.sum("y").alias("k")).join(F.broadcast(e.agg(F.avg("y").alias("p0"))))
    return by.select("actor", "n", R(asof.shrink(F.col("k"), F.col("n"), F.col("p0"), 10)).alias("rate"))


TOPICS = {"speed": (["the", "of"], ["in", "a"]), "start": (["de", "la"], ["und", "que"])}


def _hits(words: list[str]) -> str:
    return " + ".join(f"contains(text, '{w}')::int" for w in words)


@query("select doc_id, a as speed, b as start, round(greatest(least((a + b) * 0.1, 0.3), -0.3), 6)::double as delta, mixed, case when a + b > 0 then 'good' when a + b < 0 then 'bad' else 'plain' end as label from (select doc_id, sign("
       + ") as a, sign(".join(f"({_hits(g)}) - ({_hits(b)})" for g, b in TOPICS.values()) + ") as b, " + " or ".join(f"({_hits(g)} > 0 and {_hits(b)} > 0)" for g, b in TOPICS.values()) + " as mixed from documents where text is not null)")
def f15_comment_score(spark: SparkSession, d: str) -> DataFrame:
    ways, delta, mixed, label = T.comment_score(F.col("text"), TOPICS)
    return table(spark, d, "documents").where("text is not null").select("doc_id", ways.alias("w"), R(delta).alias("delta"), mixed.alias("mixed"), label.alias("label")).select(
        "doc_id", "w.speed", "w.start", "delta", "mixed", "label")


@query("""select doc_id, array_to_string(case when len(h) > 0 then h else list_filter(list_transform(regexp_split_to_array(text, '[.,\\n]'), lambda x: trim(x, ' ')), lambda x: length(x) > 0 and length(x) <= 40)[1:3] end, '|') as phrases
from (select doc_id, text, list_filter(['zweite', 'thstor', 'leeux'], lambda w: contains(text, w)) as h from documents where text is not null)""")
def f16_key_phrases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(T.key_phrases(F.col("text"), ["zweite", "thstor", "leeux"]), "|").alias("phrases"))


@query(", c as (select contest, count(*) as n, max(p) as top, -sum(case when p > 0 then p * ln(p) end) as h from ent group by contest), v as (select contest, greatest(least(round(100 * round(0.62 * top + 0.38 * (1 - case when n > 1 then h / ln(n) else 0 end), 9) / 0.8), 98), 5)::bigint as confidence from c) select contest, confidence, case when confidence >= 72 then 'firm' when confidence >= 55 then 'main' when confidence >= 40 then 'mixed' else 'wild' end as tier from v", ent=True)
def f19_confidence(spark: SparkSession, d: str) -> DataFrame:
    return tickets.confidence(entrants(spark, d), "contest", "p")


CONDITIONS = {"front": "slot = 1", "outer": "slot >= 5", "class_r": "class = 'R'", "fast": "score_rank = 1", "slow": "score_rank >= 5", "cheap": "price < 10000", "dear": "price > 50000", "cut": "discount > 0.05",
              "first_site": "site < 5", "urgent": "title = '1-URGENT'", "longshot": "odds > 10", "sure": "p > 0.4"}


@query(" select contest, slot, concat_ws(',', " + ", ".join(f"case when {c} then '{n}' end" for n, c in CONDITIONS.items()) + ") as active from ent", ent=True)
def f21_match_conditions(spark: SparkSession, d: str) -> DataFrame:
    return entrants(spark, d).select("contest", "slot", F.array_join(T.match_conditions({n: F.expr(c) for n, c in CONDITIONS.items()}), ",").alias("active"))


@query(" select contest, slot, cast(day as varchar) as day from ent where class = 'R' and contains(lower(title), 'low') and day between date '1994-01-01' and date '1996-12-31'", ent=True)
def f22_filter_history(spark: SparkSession, d: str) -> DataFrame:
    found = ingest.filter_history(entrants(spark, d), {"class": "R", "slot": "all"}, {"title": "Low"}, "day", "1994-01-01", "1996-12-31")
    return found.select("contest", "slot", F.col("day").cast("string").alias("day"))


@query(", " + RESULT + ", n as (select contest, max(title) as note from ent where contest % 3 = 0 group by contest), f as (select contest, arg_max(slot, (round(p, 9), -slot)) as choice from ent group by contest) select contest, choice, result, coalesce(note, 'none') as note from f join res using (contest) left join n using (contest)", ent=True)
def a18_verified_rows(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    choice = e.groupBy("contest").agg(F.max_by("slot", F.struct(F.round("p", 9), -F.col("slot"))).alias("choice"))
    notes = e.where("contest % 3 = 0").groupBy("contest").agg(F.max("title").alias("note"))
    return ingest.verified_rows(choice, results(e).select("contest", "result"), notes, "contest", "note", "none").select("contest", "choice", "result", "note")


# ---- tickets and probabilities that were missing


@query(", " + TRIPLES + " select contest, ticket, k as rank from (select *, row_number() over (partition by contest order by round(prob, 10) desc, ticket) as k from tri) where k <= 4", ent=True)
def t1_top_k(spark: SparkSession, d: str) -> DataFrame:
    return tuples.top_k(triples(spark, d), ["contest"], [F.desc(F.round("prob", 10)), F.asc("ticket")], 4).select("contest", "ticket", "rank")


@query(", z as (select actor, slot, count(*) as n, round((avg((finish = 1)::int) - 0.3) / sqrt(0.21 / count(*)), 6) as z from ent group by actor, slot) select actor, slot, z from (select *, row_number() over (partition by actor order by abs(z) desc, slot) as k from z) where k <= 2", ent=True)
def t3_top_findings(spark: SparkSession, d: str) -> DataFrame:
    z = entrants(spark, d).groupBy("actor", "slot").agg(R((F.avg((F.col("finish") == 1).cast("int")) - 0.3) / F.sqrt(0.21 / F.count("*"))).alias("z"))
    return select.top_findings(z, "actor", "z", "slot", 2).select("actor", "slot", "z")


METHODS = [(k, m, (k * j % 5 + 1) / 20) for k in range(1, 7) for j, m in enumerate(("lead", "pass", "late"), 1)]


@query(", t(slot, method, share) as (values " + ", ".join(f"({k}, '{m}', {s})" for k, m, s in METHODS) + ") select contest, method, round(sum(p * share::double), 6) as prob from ent join t using (slot) group by contest, method", ent=True)
def p13_scenario(spark: SparkSession, d: str) -> DataFrame:
    shares = spark.createDataFrame(METHODS, "slot int, method string, share double")
    return tickets.scenario(entrants(spark, d), "contest", "slot", "p", shares).withColumn("prob", R("prob"))


@query(", s as (select contest, slot, ln(greatest(p, 1e-6)) + 0.02 * (score - avg(score) over w) + 3 * (discount - avg(discount) over w) as s from ent window w as (partition by contest)), e as (select contest, slot, exp(s - max(s) over (partition by contest)) as e from s) select contest, slot, round(e / sum(e) over (partition by contest), 6) as q from e", ent=True)
def p14_heuristic_score(spark: SparkSession, d: str) -> DataFrame:
    return tickets.heuristic_score(entrants(spark, d), "contest", F.col("p"), {"score": 0.02, "discount": 3.0}).select("contest", "slot", R("q").alias("q"))


@query(", r as (select contest, slot, p * exp(0.8 * (discount * 100) / (slot + 10)) as r from ent) select contest, slot, round(r / sum(r) over (partition by contest), 6) as q from r", ent=True)
def p15_trend_adjust(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d).withColumn("trend", F.col("discount") * 100)
    return tickets.trend_adjust(e, "contest", "p", "trend", "slot", 0.8).select("contest", "slot", R("q").alias("q"))


@query(", " + RESULT + """, b as (select contest, case when slot % 2 = 0 then 'even' else 'odd' end as kind, slot::varchar as ticket, case when slot <> 4 then odds end as odds, row_number() over (partition by contest, slot % 2 order by round(p, 9) desc, slot) as rank from ent),
s as (select *, coalesce(greatest(floor(round(2000 * (1 / odds) / sum(1 / odds) over (partition by contest, kind) / 100, 9)), 1) * 100, 100)::double as stake from b), r as (select contest, unnest(['even', 'odd']) as kind, left(result, 1) as result, payout from res where contest % 5 <> 0)
select contest, kind, count(*) as points, sum(stake) as stake, min(rank) filter (ticket = result) as hit_rank, max(ticket = result) as hit, case when max(result) is not null then round(coalesce(sum(payout * stake / 100) filter (ticket = result), 0), 4) end as returned
from s left join r using (contest, kind) group by contest, kind""", ent=True)
def j12_settle_kinds(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    kind = F.when(F.col("slot") % 2 == 0, "even").otherwise("odd")
    bought = e.select("contest", kind.alias("kind"), F.col("slot").cast("string").alias("ticket"), F.when(F.col("slot") != 4, F.col("odds")).alias("odds"),
                      F.row_number().over(Window.partitionBy("contest", kind).orderBy(F.desc(F.round("p", 9)), "slot")).alias("rank"))
    known = results(e).where("contest % 5 <> 0").select("contest", F.explode(F.array(F.lit("even"), F.lit("odd"))).alias("kind"), F.substring("result", 1, 1).alias("result"), "payout")
    return tickets.settle_kinds(bought, known, "contest", 2000.0).withColumn("returned", R("returned", 4))


PAIRS = """sc as (select contest, slot, 0.5 * (7 - score_rank) + 20 * discount + (class = 'R')::int as s from ent), hd as (select *, row_number() over (partition by contest order by round(s, 9) desc, slot) as h from sc),
pr as (select a.contest, a.slot as head, a.slot || '-' || b.slot as ticket, a.s + b.s / 2 as score from hd a join hd b on a.contest = b.contest and a.slot <> b.slot where a.h <= 2),
rp as (select *, row_number() over (partition by contest order by round(score, 9) desc, ticket) as rank from pr)"""


def pairs(spark: SparkSession, d: str, k: int) -> DataFrame:
    terms = {"rank": (7 - F.col("score_rank"), 0.5), "cut": (F.col("discount"), 20.0), "class": (F.col("class") == "R", 1.0)}
    return tickets.scored_tickets(entrants(spark, d), "contest", "slot", terms, 2, k)


@query(", " + PAIRS + " select contest, ticket, round(score, 6) as score, rank from rp where rank <= 4", ent=True)
def l9_scored_tickets(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d, 4).withColumn("score", R("score"))


@query(", " + PAIRS + ", " + PROFILE.replace("pr as", "pf as", 1) + ", k as (select e.contest, e.slot from ent e join pf using (actor, slot) where n >= 1 and start <= 2), g as (select rp.*, row_number() over (partition by rp.contest order by rp.rank) as r2 from rp join k on rp.contest = k.contest and rp.head = k.slot) select contest, ticket, r2 as rank from g where r2 <= 3", ent=True)
def l10_ability_tickets(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    able = discover.ability_flags(profiles(spark, d), "slot", "n", "win", "start", "wall", {}, 1).withColumn("flags", F.transform("flags", lambda f: F.regexp_replace(f, "_[sa]$", "")))
    own = e.select("contest", "slot", "actor").join(able.select("actor", "slot", "flags"), ["actor", "slot"]).select("contest", "slot", "flags")
    every = pairs(spark, d, 10).withColumn("head", F.substring_index("ticket", "-", 1).cast("int"))
    return tickets.ability_tickets(every, "contest", "head", ["rank"], own, "starter", 3).select("contest", "ticket", "rank")
