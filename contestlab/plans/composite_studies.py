"""Composite studies (E38) on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlab.operators import composite, evaluate, tuples
from contestlab.plans.queries import MARKET, R, query, triples
from contestlab.plans.standins import entrants
from contestlab.storage import written

#: Quotes by the time before the deadline: the quoted odds stand at 5 minutes, the final quote follows the probability.
QUOTES_SQL = "qt as (select *, odds * (1 + discount) as q15, odds * (1 + discount / 2) as q10, 0.75::double / p as final, finish = 1 as hit from ent)"
#: Halves of the distinct days.
HALF_SQL = "hf as (select day, k < floor(0.5 * n) as first from (select day, row_number() over (order by day) - 1 as k, count(*) over () as n from (select distinct day from ent)))"
TIMES = {"15": "q15", "10": "q10", "5": "odds", "final": "final"}
LEVELS, MOSTS = [0.5, 0.6, 0.75, 0.9, 1.1], [1, 2, 3, 6]
LINES = [(1.1, None), (1.3, None), (2.0, None), (3.0, None), (1.1, 0.6), (2.0, 0.8)]
BANDS = [(lo, hi) for lo in (1.0, 2.0, 4.0, 8.0) for hi in (6.0, 10.0, 20.0) if hi > 2 * lo]
TREND_BETAS = [0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0]
INDEX_EDGES = [0, 10, 20, 30]


def quoted(spark: SparkSession, d: str) -> DataFrame:
    odds = F.col("odds")
    return entrants(spark, d).withColumns({"q15": odds * (1 + F.col("discount")), "q10": odds * (1 + F.col("discount") / 2), "final": F.lit(0.75) / F.col("p"), "hit": F.col("finish") == 1})


def halved(df: DataFrame) -> DataFrame:
    return evaluate.time_split(written(df), "day", 0.5, 0.0).withColumn("first", F.col("role") == 1).drop("role")


def rounded(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: R(c, n) for c in cols})


def _each(select: str, values, sep: str = " union all ") -> str:
    return sep.join(select.format(*(v if isinstance(v, tuple) else (v,))) for v in values)


@query(f", {QUOTES_SQL}, " + _each("t{0} as (select '{0}' as time, *, {1} as q, row_number() over (partition by contest, round(p * {1}, 9) >= 0.7 order by round(p, 9) desc, slot) as k from qt)", TIMES.items(), ", ")
       + " select time, count(*) as bets, count_if(hit) as hits, round(coalesce(sum(case when hit then final end), 0) / count(*), 6) as roi, round(avg(case when hit then final / q end), 6) as drift from ("
       + _each("select * from t{0}", list(TIMES)) + ") where round(p * q, 9) >= 0.7 and k <= 2 group by time", ent=True)
def e38_decision_times(spark: SparkSession, d: str) -> DataFrame:
    return rounded(composite.decision_times(quoted(spark, d), "contest", "slot", "p", TIMES, "final", "hit", 0.7, 2), "roi", "drift")


@query(", l as (" + _each("select {0}::double as least_ev", LEVELS) + "), m as (" + _each("select {0} as most", MOSTS) + """), v as (select least_ev, p, odds, finish = 1 as hit,
 row_number() over (partition by least_ev, contest order by round(p, 9) desc, slot) as k from ent, l where round(p * odds, 9) >= least_ev),
g as (select least_ev, most, odds, hit from v, m where k <= most)
select l.least_ev, m.most, count(g.odds) as bets, count_if(coalesce(g.hit, false)) as hits, round(coalesce(sum(case when g.hit then g.odds end), 0) / nullif(count(g.odds), 0), 6) as roi,
 round((coalesce(sum(case when g.hit then g.odds end), 0) - coalesce(max(case when g.hit then g.odds end), 0)) / nullif(count(g.odds), 0), 6) as roi_without_best
from l cross join m left join g using (least_ev, most) group by 1, 2""", ent=True)
def e38_ticket_grid(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d).withColumn("hit", F.col("finish") == 1)
    return rounded(composite.ticket_grid(e, "contest", "slot", "p", "odds", "hit", LEVELS, MOSTS), "roi", "roi_without_best")


@query(f", {QUOTES_SQL}, l as (" + _each("select {0}::double as line, {1}::double as least_ev", [(a, "null" if b is None else b) for a, b in LINES]) + """),
c as (select *, round(1 / sum(1 / odds) over (partition by contest order by round(p, 9) desc, slot rows unbounded preceding), 9) as c from qt),
a as (select line, least_ev, contest, count(*) as n, sum(1 / odds) as i, sum(p) as s, coalesce(max(case when hit then final / odds end), 0) as b from c, l where c >= line group by all),
m as (select *, b / i as back from a where least_ev is null or round(s / i, 9) >= least_ev)
select line, least_ev, count(*) as contests, round(count(*) / (select count(distinct contest) from ent), 6) as share, round(avg(n), 6) as tickets, round(avg(1 / i), 6) as composite, round(avg((b > 0)::int), 6) as hit_rate,
 round(avg(back), 6) as roi, count_if(back > 0 and round(back, 9) < 1) as losing_hits from m group by line, least_ev""", ent=True)
def e38_dutch_cases(spark: SparkSession, d: str) -> DataFrame:
    return rounded(composite.dutch_cases(quoted(spark, d), "contest", "slot", "p", "odds", "final", "hit", LINES), "share", "tickets", "composite", "hit_rate", "roi")


@query(f", {QUOTES_SQL}, {HALF_SQL}, b as (" + _each("select {0}::double as lo, {1}::double as hi", [*BANDS, (0.0, "'infinity'")]) + """),
x as (select odds, hit, final, first from qt join hf using (day) where round(p * odds, 9) >= 0.5),
g as (select lo, hi, count_if(first) as first_bets, count_if(first and hit) as first_hits, coalesce(sum(case when first and hit then final end), 0) / nullif(count_if(first), 0) as first_roi,
 (coalesce(sum(case when first and hit then final end), 0) - coalesce(max(case when first and hit then final end), 0)) / nullif(count_if(first), 0) as first_roi_without_best,
 count_if(not first) as second_bets, count_if(not first and hit) as second_hits, coalesce(sum(case when not first and hit then final end), 0) / nullif(count_if(not first), 0) as second_roi,
 (coalesce(sum(case when not first and hit then final end), 0) - coalesce(max(case when not first and hit then final end), 0)) / nullif(count_if(not first), 0) as second_roi_without_best
 from x join b on odds >= lo and odds < hi group by lo, hi),
w as (select *, lo = 0 as every, max(case when lo = 0 then first_bets end) over () as total from g)
select lo, hi, first_bets, first_hits, round(first_roi, 6) as first_roi, round(first_roi_without_best, 6) as first_roi_without_best, second_bets, second_hits, round(second_roi, 6) as second_roi,
 round(second_roi_without_best, 6) as second_roi_without_best, case when every then 0 else row_number() over (partition by every order by round(first_roi, 9) desc, lo, hi) end::int as rank
 from w where every or (first_bets >= 100 and first_bets >= 0.1 * total)""", ent=True)
def e38_band_check(spark: SparkSession, d: str) -> DataFrame:
    picked = halved(quoted(spark, d)).where(F.round(F.col("p") * F.col("odds"), 9) >= 0.5)
    found = composite.band_check(picked, "first", "odds", "hit", "final", BANDS, 100, 0.1)
    return rounded(found, "first_roi", "first_roi_without_best", "second_roi", "second_roi_without_best").withColumn("rank", F.col("rank").cast("int"))


@query(f", {QUOTES_SQL}, s as (select hit, (1 / q15) / sum(1 / q15) over w as a, (1 / odds) / sum(1 / odds) over w as b from qt window w as (partition by contest)), r as (select *, round(b / a, 9) as r, round(b, 9) as q from s) "
       "select ((q >= 0.05)::int + (q >= 0.1)::int + (q >= 0.2)::int + (q >= 0.35)::int + (q >= 0.5)::int)::int as band, case when r >= 1.02 then 'up' when r <= 0.98 then 'down' else 'flat' end as move, "
       "count(*) as n, round(avg(b), 6) as implied, round(avg(hit::int), 6) as actual from r group by 1, 2", ent=True)
def e38_flow_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(composite.flow_table(quoted(spark, d), "contest", "q15", "odds", "hit", 1.02, 0.98, [0.05, 0.1, 0.2, 0.35, 0.5]), "implied", "actual")


@query(", " + MARKET + """, t as (select contest, sum(p) as ta, sum(p ** 0.8) as tb from ent group by contest),
tri as (select x.contest, x.slot as s1, y.slot as s2, z.slot as s3, x.p / ta * (y.p ** 0.8) / (tb - x.p ** 0.8) * (z.p ** 0.8) / (tb - x.p ** 0.8 - y.p ** 0.8) as prob
 from ent x join ent y on x.contest = y.contest and x.slot <> y.slot join ent z on z.contest = x.contest and z.slot <> x.slot and z.slot <> y.slot join t on t.contest = x.contest),
pl as (select contest, slot, sum(case when slot = s1 then prob else 0 end) as w, sum(prob) as top3 from (select *, unnest([s1, s2, s3]) as slot from tri) group by contest, slot)
select slot, count(*) as n, round(avg(w), 6) as predicted, round(avg(market), 6) as quoted, round(avg((finish = 1)::int), 6) as actual, round(avg(top3), 6) as predicted_top3, round(avg((finish <= 3)::int), 6) as actual_top3
from mk join pl using (contest, slot) group by slot""", ent=True)
def e38_slot_review(spark: SparkSession, d: str) -> DataFrame:
    market = tuples.implied(entrants(spark, d), "contest", "odds")
    found = composite.slot_review(tuples.marginal_places(triples(spark, d), "contest"), market, "contest", "slot", "market", "finish", "slot")
    return rounded(found, "predicted", "quoted", "actual", "predicted_top3", "actual_top3")


@query(f", {QUOTES_SQL}, {HALF_SQL}, k as (select *, row_number() over (partition by contest order by round(p, 9) desc, slot) as kp, round(p * odds, 9) >= 0.8 as good from qt), " + """
c as (select contest, first, greatest(0, least(100, round(100 * max(case when slot = 1 then p end) / 0.85)))::int as idx, max(case when slot = 1 then hit::int end) as won, count_if(kp <= 2) as b1, count_if(kp <= 2 and hit) as h1, coalesce(sum(case when kp <= 2 and hit then final end), 0) as r1,
 count_if(good) as b2, count_if(good and hit) as h2, coalesce(sum(case when good and hit then final end), 0) as r2 from k join hf using (day) group by contest, first having max(case when slot = 1 then p end) is not null),
u as (select 'band' as part, case when idx >= 30 then 30 when idx >= 20 then 20 when idx >= 10 then 10 else 0 end as "at", null::boolean as half, c.* from c union all select 'rest', e, first, c.* from c, (select unnest([0, 10, 20, 30]) as e) where idx >= e),
w as (select part, "at", half, won, 'top' as kind, b1 as b, h1 as h, r1 as r from u union all select part, "at", half, won, 'value', b2, h2, r2 from u)
select part, "at"::int as "at", half as first, count(*) as contests, round(sum(won) / count(*), 6) as won_rate, kind, sum(b)::bigint as bets, sum(h)::bigint as hits, round(sum(r) / nullif(sum(b), 0), 6) as roi from w group by part, "at", half, kind""", ent=True)
def e38_skip_by_index(spark: SparkSession, d: str) -> DataFrame:
    q = halved(tuples.top_k(quoted(spark, d).withColumn("q", F.round("p", 9)), ["contest"], [F.desc("q"), F.asc("slot")], 6, "kp"))
    ways = {"top": F.col("kp") <= 2, "value": F.round(F.col("p") * F.col("odds"), 9) >= 0.8}
    sums = [c for k, taken in ways.items() for c in (F.count_if(taken).alias(f"{k}_bets"), F.count_if(taken & F.col("hit")).alias(f"{k}_hits"), F.coalesce(F.sum(F.when(taken & F.col("hit"), F.col("final"))), F.lit(0.0)).alias(f"{k}_back"))]
    one = F.max(F.when(F.col("slot") == 1, F.col("p")))
    contests = q.groupBy("contest", "first").agg(F.greatest(F.lit(0), F.least(F.lit(100), F.round(100 * one / 0.85))).alias("idx"), F.max(F.when(F.col("slot") == 1, F.col("hit"))).alias("won"), *sums).where("idx is not null and won is not null")
    return rounded(composite.index_review(contests, "idx", "first", "won", list(ways), INDEX_EDGES), "won_rate", "roi")


#: Meetings: contests of one title in one year, those with three entrants.
TREND_SQL = f", {HALF_SQL}, f as (select *, finish = 1 as hit, date_trunc('year', day) as year, count(*) over (partition by contest) as size from ent), " + """
tr as (select *, count(*) over w as before, coalesce(sum(hit::int - p) over w, 0) as surprise from f join hf using (day) where size = 3 window w as (partition by title, year, slot order by contest rows between unbounded preceding and 1 preceding))"""


def _trended(spark: SparkSession, d: str) -> DataFrame:
    e = halved(entrants(spark, d).withColumns({"hit": F.col("finish") == 1, "year": F.trunc("day", "year")}))
    return composite.with_trend(e, ["title", "year"], "contest", "slot", "p", "hit", 3)


@query(TREND_SQL + ", m as (select *, round(surprise / before, 9) as s from tr where before >= 2) select ((s >= -0.15)::int + (s >= -0.05)::int + (s >= 0.05)::int + (s >= 0.15)::int)::int as band, first, count(*) as n, round(avg(p), 6) as expected, round(avg(hit::int), 6) as actual from m group by 1, 2", ent=True)
def e38_trend_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(composite.trend_table(_trended(spark, d), "first", "p", "hit", 2, [-0.15, -0.05, 0.05, 0.15]), "expected", "actual")


@query(TREND_SQL + ", b as (select unnest([0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0])::double as beta), x as (select beta, contest, first, hit, p * exp(beta * surprise / (before + 3.0)) as w from tr, b), "
       "l as (select beta, contest, first, -ln(greatest(max(case when hit then w end) / sum(w), 1e-9)) as loss from x group by all), g as (select beta, avg(case when first then loss end) as a, avg(case when not first then loss end) as c from l group by beta) "
       "select beta, round(a, 6) as first_loss, round(c, 6) as second_loss, row_number() over (order by round(a, 9), beta) = 1 as best from g", ent=True)
def e38_trend_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(composite.trend_fit(_trended(spark, d), "contest", "first", "p", "hit", TREND_BETAS, 3.0), "first_loss", "second_loss")


#: The likeliest ticket of each contest under filters laid on top of each other, with a martingale by title.
FILTERS = {"calm": "discount >= 0.02", "quick": "score_rank <= 3", "value": "round(p * odds, 9) >= 0.5"}


@query(f", {HALF_SQL}, a as (select * from (select *, finish = 1 as hit, row_number() over (partition by contest order by round(p, 9) desc, slot) as kp from ent) join hf using (day) where kp = 1), " + """
c as (select 'all' as "case", * from a union all select '+calm', * from a where discount >= 0.02 union all select '+quick', * from a where discount >= 0.02 and score_rank <= 3 union all select '+value', * from a where discount >= 0.02 and score_rank <= 3 and round(p * odds, 9) >= 0.5)
select "case", count(*) as bets, count_if(hit) as hits, round(sum(case when hit then odds else 0 end) / count(*), 6) as roi, round(sum(case when hit and first then odds else 0 end) / nullif(count_if(first), 0), 6) as first_roi,
 round(sum(case when hit and not first then odds else 0 end) / nullif(count_if(not first), 0), 6) as second_roi from c group by 1""", ent=True)
def e38_stacked_filters(spark: SparkSession, d: str) -> DataFrame:
    back = lambda at: F.try_divide(F.sum(F.when(at & F.col("hit"), F.col("odds")).otherwise(0.0)), F.count_if(at))
    return rounded(_filtered(spark, d).groupBy("case").agg(F.count("*").alias("bets"), F.count_if("hit").alias("hits"), back(F.lit(True)).alias("roi"), back(F.col("first")).alias("first_roi"), back(~F.col("first")).alias("second_roi")), "roi", "first_roi", "second_roi")


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    top = tuples.top_k(entrants(spark, d).withColumns({"hit": F.col("finish") == 1, "q": F.round("p", 9)}), ["contest"], [F.desc("q"), F.asc("slot")], 1, "kp")
    return composite.cases(halved(top), composite.stacked({k: F.expr(c) for k, c in FILTERS.items()}))


@query(""", a as (select * from (select *, finish = 1 as hit, row_number() over (partition by contest order by round(p, 9) desc, slot) as kp from ent) where kp = 1),
c as (select 'all' as "case", * from a union all select '+calm', * from a where discount >= 0.02 union all select '+quick', * from a where discount >= 0.02 and score_rank <= 3 union all select '+value', * from a where discount >= 0.02 and score_rank <= 3 and round(p * odds, 9) >= 0.5),
i as (select *, coalesce(sum(hit::int) over (partition by "case", title order by day, contest rows between unbounded preceding and 1 preceding), 0) as island from c),
s as (select *, (row_number() over (partition by "case", title, island order by day, contest) - 1) % 5 as step from i), k as (select *, 100.0::double * 2.0 ** step as stake from s),
t as (select *, sum(case when hit then stake * odds else 0 end - stake) over (partition by "case", title order by day, contest rows unbounded preceding) as total from k),
g as (select *, greatest(max(total) over (partition by "case", title order by day, contest rows unbounded preceding), 0) as high from t)
select "case", title, count(*) as bets, count_if(not hit and step = 4) as busts, round(sum(stake), 4) as staked, round(sum(case when hit then stake * odds else 0 end), 4) as returned, round(least(min(total), 0), 4) as shortfall, round(max(high - total), 4) as drawdown from g group by 1, 2""", ent=True)
def e38_filtered_martingale(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.martingale_summary(_filtered(spark, d), ["case", "title"], ["day", "contest"], "hit", "odds", 100.0, 2.0, 5)
    return rounded(found, "staked", "returned", "shortfall", "drawdown", n=4)
