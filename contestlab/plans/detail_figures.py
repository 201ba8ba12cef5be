"""Figures beside the plain tables (A6, A8, A11, P10, E15, J14, J15, Q4) on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestlab.operators import asof, detail, tuples
from contestlab.plans.queries import DAILY, TRIPLES, R, daily, query, triples
from contestlab.plans.standins import entrants

#: One row a contest: its first three, and the classes of its first two slots as pattern.
CONTESTS_SQL = """, ct as (select contest, title, year(day) as year, max(case when finish = 1 then slot end) as a, max(case when finish = 2 then slot end) as b, max(case when finish = 3 then slot end) as c,
 concat(max(case when slot = 1 then class end), max(case when slot = 2 then class end)) as pattern from ent group by contest, title, day)"""


def contests(spark: SparkSession, d: str) -> DataFrame:
    at = lambda col, k, what: F.max(F.when(F.col(col) == k, F.col(what)))
    return entrants(spark, d).groupBy("contest", "title", F.year("day").alias("year")).agg(*[at("finish", k, "slot").alias(n) for k, n in enumerate("abc", 1)], F.concat_ws("", at("slot", 1, "class"), at("slot", 2, "class")).alias("pattern"))


@query(CONTESTS_SQL + """, o as (select *, unnest([{'kind': case when a = 1 then 'second' else 'head' end, 'value': case when a = 1 then b::varchar else a::varchar end},
  {'kind': case when a = 1 then 'triple' else 'pair' end, 'value': case when a = 1 then a || '-' || b || '-' || c else a || '-' || b end}]) as e from ct),
g as (select year, title, pattern, e.kind as kind, e.value as value, grouping(year)::int as all_scopes, count(*) as n from o where e.value is not null group by grouping sets ((title, pattern, kind, value), (year, title, pattern, kind, value))),
t as (select year, title, pattern, grouping(year)::int as all_scopes, count(*) as total from ct group by grouping sets ((title, pattern), (year, title, pattern)))
select g.year, g.title, g.pattern, kind, value, g.all_scopes, n, round(n / total, 6) as share from g join t on g.title = t.title and g.pattern = t.pattern and g.all_scopes = t.all_scopes and g.year is not distinct from t.year""", ent=True)
def a8_pattern_detail(spark: SparkSession, d: str) -> DataFrame:
    found = detail.pattern_detail(contests(spark, d), "year", "title", "pattern", ("a", "b", "c"))
    return found.withColumns({"share": R("share"), "all_scopes": F.col("all_scopes").cast("int")})


@query(CONTESTS_SQL + """, k as (select title, year, b, count(*) as n from ct where a = 1 and b is not null group by all), s as (select title, b, sum(n) / sum(sum(n)) over (partition by title) as base from k group by title, b),
m as (select title, year, sum(n)::bigint as cases from k group by all having sum(n) >= 30)
select title, year, b, cases, coalesce(n, 0)::bigint as n, round(base, 6) as base, round((coalesce(n, 0) + 30 * base) / (cases + 30), 6) as share from m join s using (title) left join k using (title, year, b)""", ent=True)
def a11_second_shares(spark: SparkSession, d: str) -> DataFrame:
    found = detail.second_shares(contests(spark, d).where("a = 1"), ["title"], "year", "b", 30.0, 30)
    return found.select("title", "year", "b", "cases", "n", R("base").alias("base"), R("share").alias("share"))


@query(CONTESTS_SQL + ", " + TRIPLES + """, g as (select title, b, count(*) / sum(count(*)) over (partition by title) as share from ct where a = 1 and b is not null group by title, b),
sh as (select contest, g.b as s2, greatest(share, 0.001) as t from ct join g using (title)),
h as (select tri.contest, s2, sum(prob) as p from tri where s1 = 1 group by all), x as (select h.*, t, p / sum(p) over (partition by h.contest) as c, t / sum(t) over (partition by h.contest) as u, bool_and(t is not null) over (partition by h.contest) as known from h left join sh using (contest, s2)),
y as (select *, sqrt(c) * sqrt(u) as m from x), z as (select *, m / sum(m) over (partition by contest) / c as f from y)
select tri.contest, ticket, round(case when s1 = 1 and known then prob * f else prob end, 7) as prob from tri left join z on tri.contest = z.contest and tri.s2 = z.s2""", ent=True)
def p10_mix_second(spark: SparkSession, d: str) -> DataFrame:
    c = contests(spark, d)
    seconds = c.where("a = 1 and b is not null").groupBy("title", F.col("b").alias("s2")).agg(F.count("*").alias("n"))
    shares = seconds.select("title", "s2", (F.col("n") / F.sum("n").over(Window.partitionBy("title"))).alias("share"))
    mixed = detail.mix_second(triples(spark, d), c.select("contest", "title").join(shares, "title"), "contest", 1, 0.5)
    return mixed.select("contest", "ticket", R("prob", 7).alias("prob"))


@query(""", c as (select 'class' as condition, class as value, p, (finish = 1)::int as y from ent union all select 'slot', slot::varchar, p, (finish = 1)::int from ent union all select 'title', title, p, (finish = 1)::int from ent where slot = 1)
select condition, value, count(*) as n, round(avg(p), 6) as expected, round(avg(y), 6) as actual, round(sum(y - p) / sqrt(sum(p * (1 - p))), 4) as z, round(sum(y - p) ** 2 / (2 * sum(p * (1 - p))) / (select count(distinct contest) from ent), 8) as gain
from c group by 1, 2 having count(*) >= 20 and sum(p * (1 - p)) > 0""", ent=True)
def e15_calibration_gains(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d).withColumn("hit", F.col("finish") == 1)
    found = detail.calibration_gains(e, "contest", "slot", {"class": F.col("class"), "slot": F.col("slot")}, {"title": F.col("title")}, "p", "hit", 20)
    return found.withColumns({"expected": R("expected"), "actual": R("actual"), "z": R("z", 4), "gain": R("gain", 8)})


@query(""", b as (select contest, slot, finish = 1 as hit, 1.0::double as stake, case when finish = 1 then odds else 0 end as back, discount from ent where p >= 0.3),
t as (select contest, string_agg(slot::varchar, ',' order by slot) as s, count_if(hit) as h, sum(stake) as st, sum(back) as r from b group by 1), l as (select contest, string_agg(slot::varchar, ',' order by slot) as s, count_if(hit) as h, sum(stake) as st, sum(back) as r from b where discount >= 0.03 and contest % 5 <> 0 group by 1)
select case when l.s = t.s then 'same' when l.s is not null then 'other' when t.contest % 10 = 0 then 'skipped' else 'none' end as kind, count(*) as contests, sum(t.h)::bigint as test_hits, coalesce(sum(l.h), 0)::bigint as live_hits,
 round(sum(t.r) / sum(t.st), 6) as test_roi, round(sum(l.r) / nullif(sum(l.st), 0), 6) as live_roi from t left join l using (contest) group by 1""", ent=True)
def j14_runs_by_outcome(spark: SparkSession, d: str) -> DataFrame:
    bets = entrants(spark, d).where("p >= 0.3").withColumns({"hit": F.col("finish") == 1, "stake": F.lit(1.0)}).withColumn("returned", F.when(F.col("hit"), F.col("odds")).otherwise(0.0))
    found = detail.runs_by_outcome(bets.where("discount >= 0.03 and contest % 5 <> 0"), bets, bets.where("contest % 10 = 0"), "contest", "slot")
    return found.withColumns({"test_roi": R("test_roi"), "live_roi": R("live_roi")})


BANDS_SQL = """, m as (select contest, slot, 'top' as m from (select *, row_number() over (partition by contest order by round(p, 9) desc, slot) as k from ent) where k = 1 union all select contest, slot, 'value' from ent where round(p * odds, 9) >= 0.8
 union all select contest, slot, 'quick' from ent where score_rank = 1 union all select contest, slot, 'calm' from ent where discount >= 0.05),
r as (select contest, slot as w, case when 0.75 / p < 1 then 'low' when 0.75 / p < 1.5 then 'mid' else 'high' end as band from ent where finish = 1), c as (select contest, m, max((slot = w)::int) as hit, any_value(band) as band from m join r using (contest) group by contest, m),"""


@query(BANDS_SQL + """ o as (select unnest(['quick', 'calm']) as against), f as (select against, contest from o join c on c.m in (against, 'top', 'value') group by all having count(*) = 3)
select against, band, m as method, count(*) as contests, sum(hit)::bigint as hits from f join c using (contest) where m in (against, 'top', 'value') group by 1, 2, 3""", ent=True)
def j15_common_bands(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    top = tuples.top_k(e.withColumn("q", F.round("p", 9)), ["contest"], [F.desc("q"), F.asc("slot")], 1, "kp")
    methods = {"top": top, "value": e.where(F.round(F.col("p") * F.col("odds"), 9) >= 0.8), "quick": e.where("score_rank = 1"), "calm": e.where("discount >= 0.05")}
    results = e.where("finish = 1").select("contest", F.col("slot").alias("result"), (F.lit(0.75) / F.col("p")).alias("payout"))
    band = F.when(F.col("payout") < 1, "low").when(F.col("payout") < 1.5, "mid").otherwise("high")
    return detail.common_bands(methods, ["top", "value"], results, "contest", "slot", band)


@query(""", u as (select class, day::varchar as unit, sum(case when finish = 1 then odds else 0 end) as num, count(*)::double as den from ent where slot = 1 group by all),
w as (select class, rep, num, den, ('0x' || substr(md5(unit || ':' || rep), 1, 8))::bigint / 4294967296.0 as x from u, (select unnest(range(1, 41)) as rep)),
v as (select class, rep, num, den, (x >= 0.36787944117144233)::int + (x >= 0.7357588823428847)::int + (x >= 0.9196986029286058)::int + (x >= 0.9810118431238462)::int + (x >= 0.9963401531726563)::int + (x >= 0.9994058151824183)::int as k from w),
s as (select class, rep, count(*) as units, sum(num) / sum(den) as ratio, sum(k * num) / sum(k * den) as drawn from v group by class, rep)
select class, max(units) as units, round(max(ratio), 6) as ratio, round(case when max(units) >= 30 then quantile_cont(drawn, 0.025) end, 6) as low, round(case when max(units) >= 30 then quantile_cont(drawn, 0.975) end, 6) as high from s group by class""", ent=True)
def q4_limits(spark: SparkSession, d: str) -> DataFrame:
    bets = entrants(spark, d).where("slot = 1").select("class", F.col("day").cast("string").alias("day"), F.when(F.col("finish") == 1, F.col("odds")).otherwise(0.0).alias("returned"), F.lit(1.0).alias("stake"))
    return detail.limits_by(bets, ["class"], "day", "returned", "stake", 40).withColumns({c: R(c) for c in ("ratio", "low", "high")})


@query(", " + DAILY + """, pr as (select actor, day, coalesce(sum(n) over w, 0) as n, coalesce(sum(points) over w, 0) as points from daily window w as (partition by actor order by day rows between unbounded preceding and 1 preceding)),
l as (select slot, avg((finish <= 2)::int) as level from ent group by slot), x as (select e.*, pr.n as n, pr.points as points from (select *, date_trunc('year', day)::date as start from ent) e asof left join pr on e.actor = pr.actor and e.start >= pr.day)
select site, equipment, count(*) as n, count(case when x.n >= 10 then 1 end) as judged, round(sum(case when x.n >= 10 then score - points / x.n end), 4) as gain, round(avg((finish <= 2)::int - level), 6) as residual from x join l using (slot) group by site, equipment""", ent=True)
def a6_attribution(spark: SparkSession, d: str) -> DataFrame:
    prior = asof.prior_cumulative(daily(spark, d), ["actor"], "day", ["n", "points"]).select("actor", "day", F.col("prior_n").alias("n"), F.col("prior_points").alias("points"))
    e = entrants(spark, d).withColumn("start", F.trunc("day", "year"))
    found = detail.attribution(e, prior, "actor", "day", "start", "site", "equipment", "slot", "score", F.col("finish") <= 2, 10)
    return found.withColumns({"gain": R("gain", 4), "residual": R("residual")})
