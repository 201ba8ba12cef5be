"""Strategies by name, and figures beside those of the older queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlab.operators import evaluate, tuples, within
from contestlab.operators.strategy import apply_strategies
from contestlab.plans.queries import MARKET, TRIPLES, R, query, triples
from contestlab.plans.standins import entrants


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return entrants(spark, d).withColumn("hit", F.col("finish") == 1)


@query(""", t as (select contest, slot, finish, p, odds, round(p * odds, 9) as ev, round(p, 9) as q from ent),
a as (select *, row_number() over (partition by contest order by q desc, slot) as kp, row_number() over (partition by contest, coalesce(ev >= 0.8, false) order by ev desc, slot) as ke, row_number() over (partition by contest order by ev desc, slot) as kt from t),
b as (select 'top' as strategy, * from a where kp <= 3 union all select 'ev', * from a where ev >= 0.8 and ke <= 6 union all select 'ev_band', * from a where ev >= 0.8 and ke <= 2 and odds >= 4 and odds < 20
 union all select 'ev_top', * from a where kt <= 1 union all select 'mix', * from a where kp <= 2 or (ev >= 0.8 and ke <= 1))
select strategy, count(*) as bets, count_if(finish = 1) as hits, round(sum(case when finish = 1 then odds else 0 end) / count(*), 6) as roi from b group by strategy""", ent=True)
def l1_named_strategies(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    picked = apply_strategies(e, "contest", "slot", "p", "odds").join(e.select("contest", "slot", "finish"), ["contest", "slot"])
    won = F.col("finish") == 1
    return picked.groupBy("strategy").agg(F.count("*").alias("bets"), F.count_if(won).alias("hits"), R(F.sum(F.when(won, F.col("odds")).otherwise(0.0)) / F.count("*")).alias("roi"))


@query(", " + TRIPLES + """, r as (select contest, string_agg(slot::varchar, '-' order by finish) as result from ent where finish <= 3 group by contest having count(*) = 3),
k as (select *, row_number() over (partition by contest order by round(prob, 9) desc, ticket) as k from tri)
select count(*) as contests, round(avg(-ln(greatest(prob, 1e-9))), 6) as triple_log_loss, round(avg((k <= 1)::int), 6) as top_1, round(avg((k <= 5)::int), 6) as top_5, round(avg((k <= 10)::int), 6) as top_10 from k join r on r.contest = k.contest and result = ticket""", ent=True)
def e1_triple_scores(spark: SparkSession, d: str) -> DataFrame:
    place = lambda k: F.max(F.when(F.col("finish") == k, F.col("slot").cast("string")))
    results = entrants(spark, d).groupBy("contest").agg(F.concat(place(1), F.lit("-"), place(2), F.lit("-"), place(3)).alias("result"))
    found = tuples.triple_scores(triples(spark, d), results, "contest")
    return found.select("contests", *[R(c).alias(c) for c in found.columns if c != "contests"])


@query(", " + MARKET + """ select contest, slot, round(r / sum(r) over (partition by contest), 8) as pooled from (select *, exp(0.6 * ln(greatest(p, 1e-9)) + 0.5 * ln(greatest(market, 1e-9)) + coalesce(0.3 * ln(greatest(case when slot <> 3 then 1 + discount end, 1e-9)), 0)) as r from mk)""", ent=True)
def p9_pool_with_movement(spark: SparkSession, d: str) -> DataFrame:
    e = tuples.implied(entrants(spark, d), "contest", "odds").withColumn("move", F.when(F.col("slot") != 3, 1 + F.col("discount")))
    return tuples.pool(e, "contest", "p", "market", 0.6, 0.5, move="move", c=0.3).select("contest", "slot", R("pooled", 8).alias("pooled"))


@query(""", h as (select actor, day, contest, slot, finish = 1 as hit from ent), i as (select *, sum(hit::int) over (partition by actor order by day, contest, slot) as island from h),
r as (select actor, island, min(day) as start, count(*) as n from i where not hit group by actor, island), m as (select actor, max(island) as last from i group by actor)
select actor, cast(start as varchar) as start, n as length, island = last as current from r join m using (actor)""", ent=True)
def w18_losing_runs(spark: SparkSession, d: str) -> DataFrame:
    return within.losing_runs(_hits(spark, d), ["actor"], ["day", "contest", "slot"], "hit").withColumn("start", F.col("start").cast("string"))


@query(""", h as (select actor, day, contest, slot, odds, finish = 1 as hit from ent), i as (select *, coalesce(sum(hit::int) over (partition by actor order by day, contest, slot rows between unbounded preceding and 1 preceding), 0) as island from h),
s as (select *, (row_number() over (partition by actor, island order by day, contest, slot) - 1) % 4 as step from i), k as (select *, 100.0::double * 2.0 ** step as stake from s),
t as (select *, sum(case when hit then stake * odds else 0 end - stake) over (partition by actor order by day, contest, slot rows unbounded preceding) as total from k),
g as (select *, greatest(max(total) over (partition by actor order by day, contest, slot rows unbounded preceding), 0) as high from t)
select actor, count(*) as bets, count_if(not hit and step = 3) as busts, round(sum(stake), 4) as staked, round(sum(case when hit then stake * odds else 0 end), 4) as returned, round(least(min(total), 0), 4) as shortfall, round(max(high - total), 4) as drawdown from g group by actor""", ent=True)
def w24_martingale_summary(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.martingale_summary(_hits(spark, d), ["actor"], ["day", "contest", "slot"], "hit", "odds", 100.0, 2.0, 4)
    return found.withColumns({c: R(c, 4) for c in ("staked", "returned", "shortfall", "drawdown")})


@query(""", s as (select actor, day, contest, slot, odds, finish = 1 as hit, 100.0::double * greatest(0, least(3, round(round(p * odds, 9) + 0.4 - 1, 1))) as s from ent),
f as (select *, 3000 + sum(case when hit then s * (odds - 1) else -s end) over (partition by actor order by day, contest, slot rows unbounded preceding) as f from s where s > 0),
g as (select *, coalesce(max((f <= 0)::int) over (partition by actor order by day, contest, slot rows between unbounded preceding and 1 preceding), 0) as gone from f)
select actor, count(*) as bets, round(sum(s), 4) as staked, round(arg_max(f, (day, contest, slot)), 4) as fund, round(min(f), 4) as lowest, min(f) <= 0 as bust from g where gone = 0 group by actor""", ent=True)
def w23_scaled_stakes(spark: SparkSession, d: str) -> DataFrame:
    ev = F.round(F.col("p") * F.col("odds"), 9) + 0.4
    found = evaluate.scaled_equity(_hits(spark, d), ["actor"], ["day", "contest", "slot"], "hit", "odds", ev, 100.0, 3, 3000.0)
    return found.withColumns({c: R(c, 4) for c in ("staked", "fund", "lowest")})
