"""Queries for joins, grouped statistics and trends, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlab.operators import aggregate, asof, joins, trends
from contestlab.plans.queries import DAILY, R, daily, query
from contestlab.plans.standins import entrants, parts_of, table

WIN = lambda: F.col("finish") == 1
TEXT = lambda c: F.col(c).cast("string").alias(c)

# ---- joins


@query(", c as (select site, day from (select site, date_trunc('year', day)::date as day from ent where title like '1%') group by all) select contest, slot, (select count(*) from c where c.site = ent.site and c.day <= ent.day) as era from ent", ent=True)
def j8_era(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    changes = e.where("title like '1%'").groupBy("site").agg(F.collect_set(F.trunc("day", "year")).alias("dates"))
    return asof.era(e, "site", "day", changes).select("contest", "slot", F.col("era").cast("long").alias("era"))


@query(" select a.actor, count(*) as n, sum((b.finish = 1)::int)::bigint as hits from ent a join ent b using (contest) where a.slot = 1 and b.slot = 2 group by a.actor", ent=True)
def j10_attribute_outcome(spark: SparkSession, d: str) -> DataFrame:
    return joins.attribute_outcome(entrants(spark, d), "contest", "slot", "actor", WIN().cast("long"), 1, 2).groupBy("actor").agg(F.count("*").alias("n"), F.sum("outcome").alias("hits"))


@query(""", a as (select site, class, slot, count(*) as n, avg((finish = 1)::int) as rate from ent group by all), b as (select class, slot, count(*) as n, avg((finish = 1)::int) as rate from ent group by all),
c as (select slot, count(*) as n, avg((finish = 1)::int) as rate from ent group by all)
select contest, slot, case when a.n >= 20 then 1 when b.n >= 20 then 2 when c.n >= 20 then 3 end as level, round(case when a.n >= 20 then a.rate when b.n >= 20 then b.rate when c.n >= 20 then c.rate end, 6) as rate
from ent left join a using (site, class, slot) left join b using (class, slot) left join c using (slot)""", ent=True)
def j11_fallback_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    levels = [(keys, e.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(WIN().cast("int")).alias("rate"))) for keys in (["site", "class", "slot"], ["class", "slot"], ["slot"])]
    return joins.fallback_lookup(e, levels, "n", "rate", 20).select("contest", "slot", F.col("level").cast("int").alias("level"), R("found").alias("rate"))


@query(" select a.contest, count(*) as matched, round(avg(b.odds / a.odds), 6) as mean_ratio, round(max(abs(b.odds / a.odds - 1)), 6) as worst from ent a join (select contest, slot, 0.75 / p as odds from ent where class <> 'N') b using (contest, slot) group by 1", ent=True)
def j13_compare_quotes(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    other = e.where("class <> 'N'").select("contest", "slot", (F.lit(0.75) / F.col("p")).alias("odds"))
    return joins.compare_quotes(e, other, "contest", "slot", "odds").select("contest", "matched", R("mean_ratio").alias("mean_ratio"), R("worst").alias("worst"))


@query(", a as (select contest, slot from ent where p >= 0.2), b as (select contest, slot from ent where round(p * odds, 9) >= 0.8) select contest, slot, case when b.contest is null then 'first' when a.contest is null then 'second' else 'both' end as kind from a full join b using (contest, slot) where contest in (select contest from a) and contest in (select contest from b)", ent=True)
def j14_compare_runs(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    return joins.compare_runs(e.where("p >= 0.2"), e.where(F.round(F.col("p") * F.col("odds"), 9) >= 0.8), "contest", "slot")


@query(", m as (select contest, slot, finish, 'high' as method from ent where p >= 0.3 union all select contest, slot, finish, 'quick' from ent where score_rank = 1 and score < 10) select method, count(*) as n, sum((finish = 1)::int)::bigint as hits from m where contest in (select contest from m group by contest having count(distinct method) = 2) group by method", ent=True)
def j15_common_contests(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d).select("contest", "slot", "finish", "p", "score", "score_rank")
    return joins.common_contests({"high": e.where("p >= 0.3"), "quick": e.where("score_rank = 1 and score < 10")}, "contest").groupBy("method").agg(F.count("*").alias("n"), F.sum(WIN().cast("long")).alias("hits"))


@query("select c_custkey, o_orderkey, o_orderstatus from customer left join orders on c_custkey = o_custkey")
def j16_left_outcomes(spark: SparkSession, d: str) -> DataFrame:
    outcomes = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return joins.left_outcomes(table(spark, d, "customer").select("c_custkey"), outcomes, ["c_custkey"])


@query(", k as (select distinct actor from ent where title like '1%' and finish = 1) select contest, bool_and(k.actor is not null) as all_in, count(k.actor) as n_in from ent left join k using (actor) group by contest", ent=True)
def j17_all_in_set(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    return joins.all_in_set(e, "contest", "actor", e.where("title like '1%' and finish = 1"))


@query(""", q as (select contest, slot, odds from ent where discount > 0), r as (select contest, max(case when finish = 1 then slot end) as winner from ent group by contest)
select contest, count(*) as n, round(sum(p), 8) as total_p, round(sum(q.odds), 8) as total_odds, max(winner) as winner from ent left join q using (contest, slot) join r using (contest) group by contest having count(*) >= 4 and count(q.odds) = count(*)""", ent=True)
def j18_contest_spine(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    won = e.groupBy("contest").agg(F.max(F.when(WIN(), F.col("slot"))).alias("winner"))
    add = lambda c: F.aggregate(F.map_values(c), F.lit(0.0), lambda a, x: a + x)
    return joins.contest_spine(e, e.where("discount > 0"), won, "contest", "slot", 4).select("contest", "n", F.round(add("probs"), 8).alias("total_p"), F.round(add("quotes"), 8).alias("total_odds"), "winner")


# ---- grouped statistics


@query(" select actor, cast(max(day) + 1 as varchar) as day, count(*) as n, sum((finish = 1)::int)::bigint as win from ent group by actor", ent=True)
def a2_serving_totals(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.serving_totals(entrants(spark, d), ["actor"], "day", {"n": F.lit(1).cast("long"), "win": WIN().cast("long")}).withColumn("day", F.col("day").cast("string"))


@query(" select site, slot, grouping(site)::int as all_sites, count(*) as n, round(avg((finish = 1)::int), 6) as win, round(avg(case when score < 40 then score end), 6) as quick from ent group by grouping sets ((slot), (site, slot))", ent=True)
def a3_priors(spark: SparkSession, d: str) -> DataFrame:
    found = aggregate.priors(entrants(spark, d), "site", "slot", {"win": WIN().cast("int"), "quick": F.when(F.col("score") < 40, F.col("score"))})
    return found.select("site", "slot", F.col("all_sites").cast("int").alias("all_sites"), "n", R("win").alias("win"), R("quick").alias("quick"))


@query(" select actor, slot, count(*) as all_n, sum((finish = 1)::int)::bigint as all_win, sum((day >= date '2000-01-01')::int)::bigint as late_n, sum((day >= date '2000-01-01' and finish = 1)::int)::bigint as late_win from ent group by actor, slot", ent=True)
def a4_profile(spark: SparkSession, d: str) -> DataFrame:
    scopes = {"all": F.lit(True), "late": F.col("day") >= F.lit("2000-01-01").cast("date")}
    return aggregate.profile(entrants(spark, d), ["actor", "slot"], scopes, {"n": F.lit(1).cast("long"), "win": WIN().cast("long")})


@query(", m as (select slot, avg(score) as m from ent group by slot) select actor, sum((class = 'R')::int)::bigint as n_flag, round(avg(case when class = 'R' then score - m end), 6) as flag_mean, round(avg(case when class <> 'R' then score - m end), 6) as normal_mean from ent join m using (slot) group by actor", ent=True)
def a5_residual_stats(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.residual_stats(entrants(spark, d), ["actor"], "slot", "score", F.col("class") == "R").select("actor", "n_flag", R("flag_mean").alias("flag_mean"), R("normal_mean").alias("normal_mean"))


@query(", " + DAILY + """, pr as (select actor, day, coalesce(sum(n) over w, 0) as n, coalesce(sum(points) over w, 0) as points from daily window w as (partition by actor order by day rows between unbounded preceding and 1 preceding))
select equipment, count(*) as n, round(sum(score - (points + 5 * 25.0) / (pr.n + 5)), 4) as gain from ent join pr using (actor, day) group by equipment""", ent=True)
def a6_contribution(spark: SparkSession, d: str) -> DataFrame:
    prior = asof.prior_cumulative(daily(spark, d), ["actor"], "day", ["n", "points"]).select("actor", "day", F.col("prior_n").alias("n"), F.col("prior_points").alias("points"))
    return aggregate.contribution(entrants(spark, d), prior, "actor", "day", "equipment", "score", 25.0, 5.0).withColumn("gain", R("gain", 4))


@query(" select site, slot, sum((class = 'A')::int)::bigint as n_a, sum((class = 'N')::int)::bigint as n_n, sum((class not in ('A', 'N'))::int)::bigint as n_other from ent where finish = 1 group by site, slot", ent=True)
def a7_method_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.method_counts(entrants(spark, d).where("finish = 1"), ["site", "slot"], "class", ["A", "N"])


@query(", g as (select site, title, grouping(site)::int as all_scopes, count(*) as n, sum((slot = 1)::int)::bigint as hits from ent where finish = 1 group by grouping sets ((title), (site, title))) select site, title, all_scopes, n, hits, row_number() over (partition by all_scopes, site order by round(hits / n, 9) desc, title)::int as rank from g", ent=True)
def a8_pattern_table(spark: SparkSession, d: str) -> DataFrame:
    found = aggregate.pattern_table(entrants(spark, d).where("finish = 1"), "site", "title", F.col("slot") == 1)
    return found.withColumn("all_scopes", F.col("all_scopes").cast("int"))


@query(" select site, slot, count(*) as n, round(avg((finish = 1)::int), 6) as win from ent where day >= date '2001-01-01' - 365 and day < date '2001-01-01' group by site, slot", ent=True)
def a9_site_position_rates(spark: SparkSession, d: str) -> DataFrame:
    end = F.lit("2001-01-01").cast("date")
    return aggregate.recent_rates(entrants(spark, d), ["site", "slot"], "day", end, 365, {"win": WIN().cast("int")}).withColumn("win", R("win"))


@query(", g as (select site, count(*) as n, avg((slot = 1)::int) as base, sum((score < 20)::int)::bigint as quick_n, sum((score < 20 and slot = 1)::int)::bigint as quick_hits from ent where finish = 1 group by site) select site, n, round(base, 6) as base, quick_n, quick_hits, round((quick_hits + 30 * base) / (quick_n + 30), 6) as quick_rate from g", ent=True)
def a11_condition_table(spark: SparkSession, d: str) -> DataFrame:
    found = aggregate.condition_table(entrants(spark, d).where("finish = 1"), ["site"], {"quick": F.col("score") < 20}, F.col("slot") == 1, 30.0)
    return found.withColumns({"base": R("base"), "quick_rate": R("quick_rate")})


@query(" select case when odds < 2 then 'short' when odds < 6 then 'mid' else 'long' end as band, count(*) as n, round(avg(p), 6) as implied, round(avg((finish = 1)::int), 6) as actual, round(avg(case when finish = 1 then odds else 0 end), 6) as returned from ent group by 1", ent=True)
def a12_band_table(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("odds") < 2, "short").when(F.col("odds") < 6, "mid").otherwise("long")
    found = aggregate.band_table(entrants(spark, d), band, "p", WIN(), F.when(WIN(), F.col("odds")).otherwise(0.0))
    return found.select("band", "n", *[R(c).alias(c) for c in ("implied", "actual", "returned")])


@query(" select case when class = 'N' then 'unknown' else class end as label, count(*) as n, count(case when slot < 5 then 1 end) as judged, round(avg(case when slot < 5 then (finish = 1)::int end), 6) as match_rate from ent group by 1", ent=True)
def a13_match_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = entrants(spark, d).withColumn("group", F.when(F.col("class") != "N", F.col("class")).otherwise(" ")).withColumn("matched", F.when(F.col("slot") < 5, WIN()))
    return aggregate.match_summary(rows, "group", "matched").withColumn("match_rate", R("match_rate"))


@query(" select actor, count(*) as n, round(avg((finish = 1)::int), 9) as rate from ent group by actor having count(*) >= 20 order by rate desc, n desc, actor limit 10", ent=True)
def a14_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.leaderboard(entrants(spark, d), "actor", WIN(), 20, 10)


@query(" select actor, count(*) as n, round(avg((finish = 1)::int), 6) as win, round(avg((finish <= 3)::int), 6) as top3, case when count(*) >= 600 then 'high' when count(*) >= 300 then 'middle' else 'none' end as grade from ent group by actor", ent=True)
def a15_tendency(spark: SparkSession, d: str) -> DataFrame:
    found = aggregate.tendency(entrants(spark, d), "actor", {"win": WIN(), "top3": F.col("finish") <= 3}, [(600, "high"), (300, "middle")])
    return found.withColumns({"win": R("win"), "top3": R("top3")})


@query(", w as (select distinct contest, slot, finish, unnest(string_split(p_type, ' ')) as phrase from ent join part on equipment = p_partkey) select phrase, count(*) as used, count(case when slot < 5 then 1 end) as judged, round(avg(case when slot < 5 then finish end), 6) as mean_finish, round(avg(case when slot < 5 then (finish = 1)::int end), 6) as win_rate, round(avg(case when slot < 5 then (finish <= 2)::int end), 6) as top2_rate from w group by phrase", ent=True)
def a16_phrase_stats(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select(F.col("p_partkey").alias("equipment"), F.split("p_type", " ").alias("words"))
    found = aggregate.phrase_stats(entrants(spark, d).join(words, "equipment").withColumn("f", F.when(F.col("slot") < 5, F.col("finish"))), "words", "f")
    return found.select("phrase", "used", "judged", *[R(c).alias(c) for c in ("mean_finish", "win_rate", "top2_rate")])


@query("select o_custkey, count(*) as n, sum((o_orderstatus = 'F')::int)::bigint as n_done, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as names from orders group by o_custkey")
def a17_batch_index(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.batch_index(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F", "o_orderpriority")


@query(", m as (select slot, avg((finish = 1)::int) as m from ent group by slot) select score_rank, class, grouping(score_rank, class)::bigint as level, count(*) as n, round(avg((finish = 1)::int - m), 6) + 0.0 as uplift from (select *, cast(score_rank as int) as score_rank_i from ent) join m using (slot) group by cube (score_rank, class) having count(*) >= 50", ent=True)
def a19_uplift_grid(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.uplift_grid(entrants(spark, d), "score_rank", "class", "slot", WIN(), 50).select(F.col("score_rank").cast("long").alias("score_rank"), "class", F.col("level").cast("long").alias("level"), "n", (R("uplift") + F.lit(0.0)).alias("uplift"))


@query(" select left(cast(ent.day as varchar), 7) as period, cast(ent.day as varchar) as day, grouping(left(cast(ent.day as varchar), 7), ent.day)::bigint as level, count(*) as bets, sum((finish = 1)::int)::bigint as hits from ent where slot = 1 group by rollup (left(cast(ent.day as varchar), 7), ent.day)", ent=True)
def a20_day_totals(spark: SparkSession, d: str) -> DataFrame:
    found = aggregate.day_totals(entrants(spark, d).where("slot = 1"), F.date_format("day", "yyyy-MM"), "day", {"bets": F.lit(1).cast("long"), "hits": WIN().cast("long")})
    return found.select("period", TEXT("day"), F.col("level").cast("long").alias("level"), "bets", "hits")


@query("""with v as (select o_orderkey, o_custkey, case when o_totalprice > 100000 then o_totalprice end as price from orders), c as (select count(*) as n, count(o_custkey) as a, count(price) as b from v)
select name, filled, round(filled / n, 6) as share, case when filled / n >= 0.9 then 'ok' else 'collect' end as action from (select 'o_custkey' as name, a as filled, n from c union all select 'price', b, n from c)""")
def a21_readiness(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("price", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")))
    return aggregate.readiness(rows, ["o_custkey", "price"], 0.9).withColumn("share", R("share"))


@query("select event_type, count(distinct user_id) as users, round(median(value), 6) as median_value from events group by event_type")
def a22_distincts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.round(F.median("value"), 6).alias("median_value"))


MINUTES = lambda: F.lit(55) - (F.minute("ts") + F.second("ts") / 60)
MINUTES_SQL = "55 - (minute(ts) + second(ts) / 60)"


@query(f"select user_id, strftime(ts, '%Y-%m-%d %H') as hour, count(*) as versions, round(max({MINUTES_SQL}), 4) as first_min, round(min({MINUTES_SQL}), 4) as last_min, round(avg(({MINUTES_SQL} < 0)::int), 6) as late_share from events group by 1, 2")
def a24_version_timing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    return aggregate.version_timing(rows, ["user_id", "hour"], MINUTES()).select("user_id", "hour", "versions", R("first_min", 4).alias("first_min"), R("last_min", 4).alias("last_min"), R("late_share").alias("late_share"))


# ---- trends


@query(", f as (select actor, day, sum((class = 'R')::int)::bigint as f from ent group by actor, day) select actor, cast(day as varchar) as day, coalesce(sum(f) over (partition by actor order by day range between interval 179 days preceding and interval 1 day preceding), 0)::bigint as recent_f from f", ent=True)
def w3_recent_count(spark: SparkSession, d: str) -> DataFrame:
    flagged = asof.daily_sums(entrants(spark, d), ["actor"], "day", {"f": (F.col("class") == "R").cast("long")})
    return asof.asof_stats(flagged, ["actor"], "day", ["f"], 180, prefix="recent_").select("actor", TEXT("day"), "recent_f")


PRIOR = "pm as (select actor, day, case when coalesce(sum(n) over w, 0) >= 3 then (coalesce(sum(points) over w, 0) + 5 * 25.0) / (coalesce(sum(n) over w, 0) + 5) end as prior from daily window w as (partition by actor order by day rows between unbounded preceding and 1 preceding))"


def _prior(spark: SparkSession, d: str) -> DataFrame:
    return trends.prior_mean(daily(spark, d), ["actor"], "day", "points", "n", 25.0, 5.0, 3)


@query(", " + DAILY + ", " + PRIOR + " select actor, cast(day as varchar) as day, round(prior, 6) as prior from pm", ent=True)
def w6_prior_mean(spark: SparkSession, d: str) -> DataFrame:
    return _prior(spark, d).select("actor", TEXT("day"), R("prior").alias("prior"))


@query(", " + DAILY + ", " + PRIOR + " select contest, slot, round(score - prior, 6) as deviation, round(score - prior - avg(score - prior) over (partition by contest), 6) as relative from ent left join pm using (actor, day)", ent=True)
def w7_habit_deviation(spark: SparkSession, d: str) -> DataFrame:
    found = trends.habit_deviation(entrants(spark, d), _prior(spark, d), ["actor"], "day", "contest", "score")
    return found.select("contest", "slot", R("deviation").alias("deviation"), R("relative").alias("relative"))


SESSION = """, s as (select *, date_trunc('month', day)::date as month from ent), dd as (select site, month, actor, day, min(score) as b, sum(7 - finish) as p, count(*) as n from s group by all),
g as (select * from (select distinct site, month, actor from s) join (select distinct site, month, day from s) using (site, month)),
run as (select site, month, actor, day, min(b) over w as best, coalesce(sum(p) over w, 0)::bigint as points, coalesce(sum(n) over w, 0)::bigint as starts from g left join dd using (site, month, actor, day) window w as (partition by site, month, actor order by day rows between unbounded preceding and 1 preceding))
"""


def _session(spark: SparkSession, d: str) -> DataFrame:
    rows = entrants(spark, d).withColumn("month", F.trunc("day", "month")).withColumn("pts", (7 - F.col("finish")).cast("long"))
    return trends.session_running(rows, ["site", "month"], "actor", "day", "score", "pts", parts_of(spark, d, "lineitem"))


@query(SESSION + " select site, actor, cast(day as varchar) as day, best, case when best is not null then rank() over (partition by site, month, day order by best asc nulls last) end as best_rank from run", ent=True)
def w9_session_best(spark: SparkSession, d: str) -> DataFrame:
    return _session(spark, d).select("site", "actor", TEXT("day"), "best", F.col("best_rank").cast("long").alias("best_rank"))


@query(SESSION + " select site, actor, cast(day as varchar) as day, points, starts from run", ent=True)
def w10_session_points(spark: SparkSession, d: str) -> DataFrame:
    return _session(spark, d).select("site", "actor", TEXT("day"), "points", "starts")


@query(" select contest, slot, count(*) over w as n_before, round(coalesce(sum((finish = 1)::int - p) over w, 0), 6) as trend from ent window w as (partition by site, day, slot order by contest rows between unbounded preceding and 1 preceding)", ent=True)
def w19_day_trend(spark: SparkSession, d: str) -> DataFrame:
    return trends.day_trend(entrants(spark, d), ["site", "day", "slot"], ["contest"], WIN().cast("int"), "p").select("contest", "slot", "n_before", R("trend").alias("trend"))


@query(", q as (select site, slot, day, min(case when class = 'A' then odds end) as early, min(case when class = 'N' then odds end) as late from ent group by site, slot, day) select site, slot, cast(day as varchar) as day, round(early, 6) as early, round(late, 6) as late, round(late / early, 6) as ratio from q where early > 0 and late > 0", ent=True)
def w20_quote_moves(spark: SparkSession, d: str) -> DataFrame:
    quotes = entrants(spark, d).groupBy("site", "slot", "day", "class").agg(F.min("odds").alias("odds"))
    return trends.quote_moves(quotes, ["site", "slot", "day"], "class", "odds", "A", "N").select("site", "slot", TEXT("day"), *[R(c).alias(c) for c in ("early", "late", "ratio")])


#: The rule on the distance to the last day found is sequential: the SQL follows it by recursion.
@query("""with recursive x as (select user_id, cast(ts as date) as day, count(*) as n, avg((event_type = 'purchase')::int) as share from events group by 1, 2),
l as (select *, lag(share) over (partition by user_id order by day) as b from x), c as (select user_id, day from l where share >= 0.25 and b < 0.25 and n >= 2),
f as (select user_id, min(day) as day from c group by user_id union all select f.user_id, (select min(c.day) from c where c.user_id = f.user_id and c.day >= f.day + 7) as day from f where f.day is not null)
select user_id, cast(day as varchar) as day from f where day is not null""")
def w21_detect_resets(spark: SparkSession, d: str) -> DataFrame:
    daily_share = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.avg((F.col("event_type") == "purchase").cast("int")).alias("share"))
    return trends.detect_resets(daily_share, "user_id", "day", "n", "share", 0.25, 0.25, 2, 7).select("user_id", TEXT("day"))


@query(f"select user_id, hour, round(minutes, 4) as minutes, value from (select user_id, strftime(ts, '%Y-%m-%d %H') as hour, {MINUTES_SQL} as minutes, value, row_number() over (partition by user_id, strftime(ts, '%Y-%m-%d %H') order by {MINUTES_SQL}, event_id desc) as k from events where {MINUTES_SQL} >= 5) where k = 1")
def w22_snap_at(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH")).withColumn("minutes", MINUTES())
    return trends.snap_at(rows, ["user_id", "hour"], "minutes", 5, ["value"], "event_id").withColumn("minutes", R("minutes", 4))


@query(", t as (select site, day, sum(1.0) as stake, sum(case when finish = 1 then odds else 0 end) as returned from ent where slot = 1 group by site, day) select site, cast(day as varchar) as day, round(returned / stake, 6) as day_roi, round(sum(returned) over w / sum(stake) over w, 6) as roi from t window w as (partition by site order by day rows between unbounded preceding and current row)", ent=True)
def w25_daily_cumulative(spark: SparkSession, d: str) -> DataFrame:
    rows = entrants(spark, d).where("slot = 1").withColumn("stake", F.lit(1.0)).withColumn("returned", F.when(WIN(), F.col("odds")).otherwise(0.0))
    return trends.daily_cumulative(rows, ["site"], "day", "stake", "returned").select("site", TEXT("day"), R("day_roi").alias("day_roi"), R("roi").alias("roi"))
