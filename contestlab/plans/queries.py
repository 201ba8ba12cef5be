"""One query for each operator on the stand-in tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestlab.functions import text as T
from contestlab.operators import asof, evaluate, ingest, tuples, within
from contestlab.plans.standins import ENTRANTS_SQL, VERSION, entrants, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, ent: bool = False):
    """Register a query under its name, with SQL to check it (`ent`: on the entrants table)."""
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = ENTRANTS_SQL + sql if ent else sql
        return f

    return keep


R = lambda c, n=6: F.round(c, n)

# ---- ingestion


@query("select event_id, json_extract_string(props, '$.k') as k, coalesce(json_extract_string(props, '$.missing'), event_type) as kind from events")
def s1_project_json(spark: SparkSession, d: str) -> DataFrame:
    return ingest.project_json(table(spark, d, "events"), "props", {"k": "$.k", "kind": "$.missing"}, {"kind": "event_type"}).select("event_id", "k", "kind")


@query("select event_id, case when starts_with(props, '{') then cast(json_extract(props, '$.k') as bigint) end as k from events")
def s2_safe_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", ingest.safe_json("props", "k bigint")["k"].alias("k"))


@query("""select event_id, pos, item from (select event_id, unnest([event_type, user_id::varchar]) as item, generate_subscripts([1, 2], 1) as pos from events)""")
def s3_explode_json_array(spark: SparkSession, d: str) -> DataFrame:
    arr = F.to_json(F.array(F.col("event_type"), F.col("user_id").cast("string")))
    return ingest.explode_json_array(table(spark, d, "events").withColumn("a", arr), "a", "string").select("event_id", F.col("pos").cast("long").alias("pos"), "item")


@query("select contest, string_agg(slot::varchar || ':' || score::int::varchar, ' ' order by slot::varchar) as packed from ent group by contest", ent=True)
def s4_pack_map(spark: SparkSession, d: str) -> DataFrame:
    return ingest.pack_map(entrants(spark, d).withColumn("q", F.col("score").cast("int")), ["contest"], "slot", "q")


@query(r"select event_id, nullif(regexp_extract(props, '\"k\": ?(\d+)', 1), '') as k from events")
def s6_extract_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", ingest.extract_first("props", r'"k": ?(\d+)').alias("k"))


@query("select event_type, count(*) as n_rows, cast(min(cast(ts as date)) as varchar) as first_day, cast(max(cast(ts as date)) as varchar) as last_day from events group by event_type")
def s7_profile_source(spark: SparkSession, d: str) -> DataFrame:
    found = ingest.profile_source(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["event_type"], "day")
    return found.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("select key, count(*) as n from (select unnest(json_keys(props)) as key from events) group by key")
def s7_json_key_counts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.json_key_counts(table(spark, d, "events"), "props")


@query("select origin, count(*) as n, count(phone) as with_phone, count(seg) as with_seg from (select 'customer' as origin, null as phone, c_mktsegment as seg from customer union all select 'supplier', s_name, null from supplier) group by origin")
def s8_union_sources(spark: SparkSession, d: str) -> DataFrame:
    both = ingest.union_sources({"customer": table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg")), "supplier": table(spark, d, "supplier").select(F.col("s_name").alias("phone"))})
    return both.groupBy("origin").agg(F.count("*").alias("n"), F.count("phone").alias("with_phone"), F.count("seg").alias("with_seg"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as double) as number, lpad(user_id::varchar, 4, '0') as site, strftime(ts, '%Y%m%d') as day, lower(event_type) in ('click', 'view') as flag from events")
def s9_clean_types(spark: SparkSession, d: str) -> DataFrame:
    e = ingest.project_json(table(spark, d, "events"), "props", {"k": "$.k"}).withColumn("d", F.to_date("ts").cast("string"))
    return e.select("event_id", ingest.clean_number("k").alias("number"), ingest.clean_site("user_id", 4).alias("site"), ingest.clean_day("d").alias("day"), ingest.clean_flag("event_type", ("click", "view")).alias("flag"))


@query("select l_orderkey, count(*) as n, count(case when l_quantity between 10 and 40 then 1 end) as kept from lineitem group by l_orderkey")
def s10_null_outside(spark: SparkSession, d: str) -> DataFrame:
    return ingest.null_outside(table(spark, d, "lineitem"), {"l_quantity": (10, 40)}).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count("l_quantity").alias("kept"))


@query("""with s as (select event_type, avg((value between 0 and 50)::int) as share from events where value is not null group by event_type)
select event_id, round(case when share > 0.3 then value * 100 else value end, 4) as value from events left join s using (event_type)""")
def s11_harmonise_units(spark: SparkSession, d: str) -> DataFrame:
    return ingest.harmonise_units(table(spark, d, "events"), ["event_type"], "value", 0, 50, 0.3, 100).select("event_id", R("value", 4).alias("value"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_quantity from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc,
 l_suppkey desc, l_quantity desc, l_extendedprice desc, l_discount desc, l_tax desc, l_returnflag desc, l_linestatus desc) as k from lineitem) where k = 1""")
def s12_latest_by(spark: SparkSession, d: str) -> DataFrame:
    return ingest.latest_by(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc(c) for c in VERSION]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("""select user_id, arg_max(v, (ts, event_id)) filter (v is not null) as v, arg_max(event_type, (ts, event_id)) as event_type
from (select *, case when event_id % 3 = 0 then round(value, 4) end as v from events) group by user_id""")
def s13_latest_nonnull(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, R("value", 4)))
    return ingest.latest_nonnull(e, ["user_id"], ["v", "event_type"], ["ts", "event_id"])


@query("select distinct o_custkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def s16_pending(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return ingest.pending(table(spark, d, "orders"), done, ["o_custkey"])


# ---- scalar functions


@query("""select contest, slot, case when slot = 1 then round(-(score / 100), 4) when slot = 2 then null else round(score / 100, 4) end as t from ent""", ent=True)
def f1_parse_signed_time(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.when(F.col("slot") == 1, "F").when(F.col("slot") == 2, "L").otherwise(""), F.lit("."), F.lpad(F.col("score").cast("int").cast("string"), 2, "0"))
    return entrants(spark, d).select("contest", "slot", R(T.parse_signed_time(text), 4).alias("t"))


@query("select contest, slot, case when 60000 + score::int * 1000 + slot * 100 between 90000 and 150000 then (60000 + score::int * 1000 + slot * 100)::bigint end as ms from ent", ent=True)
def f2_parse_clock(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("1'"), F.lpad(F.col("score").cast("int").cast("string"), 2, "0"), F.lit('"'), F.col("slot").cast("string"))
    return entrants(spark, d).select("contest", "slot", T.parse_clock(text).cast("long").alias("ms"))


@query("select distinct contest, strftime(day, '%Y%m%d') || '-' || lpad(site::varchar, 2, '0') || '-' || lpad(slot::varchar, 2, '0') as id from ent", ent=True)
def f3_contest_id(spark: SparkSession, d: str) -> DataFrame:
    return entrants(spark, d).select("contest", T.contest_id(F.col("day"), F.col("site"), F.col("slot")).alias("id")).distinct()


@query("select contest, count(*) as n, round(sum(score), 4) as total from ent where score > 0 group by contest", ent=True)
def f4_parse_odds(spark: SparkSession, d: str) -> DataFrame:
    packed = ingest.pack_map(entrants(spark, d), ["contest"], "slot", "score")
    return packed.select("contest", F.map_values(T.parse_odds(F.col("packed"))).alias("v")).select(
        "contest", F.size("v").cast("long").alias("n"), R(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("select o_orderkey, case when o_orderpriority like '1%' then 'top' when o_orderpriority like '%HIGH%' then 'high' else 'normal' end as category from orders")
def f6_classify_by_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.classify_by_rules(F.col("o_orderpriority"), [("^1", "top"), ("HIGH", "high")], "normal").alias("category"))


@query("select p_partkey, case when lower(p_type) like '%brass%' then 'brass' when lower(p_type) like '%steel%' then 'steel' else lower(trim(p_type)) end as label from part")
def f8_normalise_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.normalise_label(F.col("p_type"), [("brass", "brass"), ("steel", "steel")]).alias("label"))


@query("""select event_id, round(-(value * cos(radians((user_id % 16) * 22.5 - 90))), 4) + 0.0 as tail, round(value * sin(radians((user_id % 16) * 22.5 - 90)), 4) + 0.0 as cross_part,
case when value < 1 then 'calm' when a < 90 then 'head' when a < 180 then 'right' when a < 270 then 'tail' else 'left' end as category
from (select *, ((((user_id % 16) * 22.5 - 90 + 45)::double % 360) + 360) % 360 as a from events)""")
def f9_wind(spark: SparkSession, d: str) -> DataFrame:
    direction, speed, heading = F.col("user_id") % 16, F.col("value"), F.lit(90.0)
    tail, cross = T.wind_components(direction, speed, heading)
    return table(spark, d, "events").select("event_id", (R(tail, 4) + 0.0).alias("tail"), (R(cross, 4) + 0.0).alias("cross_part"), T.wind_category(direction, speed, heading).alias("category"))


@query("select case when l_quantity < 10 then 'low' when l_quantity < 30 then 'mid' else 'high' end as band, count(*) as n from lineitem group by 1")
def f12_band(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(T.band(F.col("l_quantity"), [10, 30], ["low", "mid", "high"]).alias("band")).agg(F.count("*").alias("n"))


@query("select p_partkey, case when p_partkey::varchar = '12' then 100 when n = 'part12' then 90 when starts_with(n, '12') then 75 when contains(n, '12') then 60 else 0 end as score from (select *, lower(regexp_replace(p_name, '\\s+', '', 'g')) as n from part)")
def f14_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.search_score(F.col("p_name"), F.col("p_partkey"), "12").alias("score"))


@query("""select contest, slot, greatest(least(50 + case when score_rank = 1 then 20.0 else 0.0 end + case when slot = 1 then 15.0 else 0.0 end - case when discount > 0.05 then 10.0 else 0.0 end, 80.0), 45.0)::double as points,
(score_rank = 1)::int + (slot = 1)::int + (discount > 0.05)::int as notes from ent""", ent=True)
def f17_apply_rules(spark: SparkSession, d: str) -> DataFrame:
    points, notes = T.add_rules(F.lit(50.0), [(F.col("score_rank") == 1, 20.0, "fastest"), (F.col("slot") == 1, 15.0, "inside"), (F.col("discount") > 0.05, -10.0, "discount")], 45.0, 80.0)
    return entrants(spark, d).select("contest", "slot", points.alias("points"), F.size(notes).alias("notes"))


@query("select o_orderkey, case when month(o_orderdate) in (3,4,5) then 'spring' when month(o_orderdate) in (6,7,8) then 'summer' when month(o_orderdate) in (9,10,11) then 'autumn' else 'winter' end as season from orders")
def f20_season(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.season(F.col("o_orderdate")).alias("season"))


@query("select p_partkey, sha256(trim(p_brand) || '|' || trim(p_type) || '|' || p_size::varchar) as id from part")
def f23_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.fingerprint(F.col("p_brand"), F.col("p_type"), F.col("p_size")).alias("id"))


# ---- joins and point-in-time statistics


@query("select contest, n from (select contest, count(*) as n, sum((finish = 1)::int) as winners from ent group by contest) where n >= 4 and winners = 1", ent=True)
def j2_valid_contests(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    good = e.groupBy("contest").agg(F.count("*").alias("n"), F.sum((F.col("finish") == 1).cast("int")).alias("winners")).where("n >= 4 and winners = 1")
    return e.join(good, "contest", "left_semi").groupBy("contest").agg(F.count("*").alias("n"))


DAILY = "daily as (select actor, day, count(*)::bigint as n, sum((finish = 1)::int)::bigint as win, sum(score) as points from ent group by actor, day)"


def daily(spark: SparkSession, d: str) -> DataFrame:
    return asof.daily_sums(entrants(spark, d), ["actor"], "day", {"n": F.lit(1).cast("long"), "win": (F.col("finish") == 1).cast("long"), "points": F.col("score")})


@query(", " + DAILY + " select actor, cast(day as varchar) as day, n, win, points from daily", ent=True)
def a1_daily_sums(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d).withColumn("day", F.col("day").cast("string"))


@query(", " + DAILY + " select actor, cast(day as varchar) as day, coalesce(sum(n) over w, 0)::bigint as prior_n, coalesce(sum(win) over w, 0)::bigint as prior_win from daily window w as (partition by actor order by day rows between unbounded preceding and 1 preceding)", ent=True)
def w1_prior_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return asof.prior_cumulative(daily(spark, d), ["actor"], "day", ["n", "win"]).select("actor", F.col("day").cast("string").alias("day"), "prior_n", "prior_win")


@query(", " + DAILY + " select actor, cast(day as varchar) as day, coalesce(sum(n) over w, 0)::bigint as w_n, coalesce(sum(win) over w, 0)::bigint as w_win from daily window w as (partition by actor order by day range between interval 89 days preceding and interval 1 day preceding)", ent=True)
def w2_asof_stats(spark: SparkSession, d: str) -> DataFrame:
    return asof.asof_stats(daily(spark, d), ["actor"], "day", ["n", "win"], 90).select("actor", F.col("day").cast("string").alias("day"), "w_n", "w_win")


@query(", " + DAILY + " select actor, cast(day as varchar) as day, round(sum(win) over w / sum(n) over w, 6) as rate from daily window w as (partition by actor order by day range between interval 365 days preceding and interval 1 day preceding)", ent=True)
def w4_rolling_rate(spark: SparkSession, d: str) -> DataFrame:
    return asof.rolling_rate(daily(spark, d), ["actor"], "day", "win", "n").select("actor", F.col("day").cast("string").alias("day"), R("rate").alias("rate"))


@query(""", days as (select distinct site, day, title from ent), f as (select *, case when lag(day) over w is null or day - lag(day) over w > 1 or lag(title) over w <> title then 1 else 0 end as new from days window w as (partition by site order by day, title)),
s as (select *, sum(new) over (partition by site order by day, title) as session from f)
select site, cast(day as varchar) as day, title, session::bigint as session, row_number() over (partition by site, session order by day) as day_no from s""", ent=True)
def w8_sessions(spark: SparkSession, d: str) -> DataFrame:
    return asof.sessions(entrants(spark, d), "site", "day", "title").withColumn("day", F.col("day").cast("string")).select("site", "day", "title", "session", F.col("day_no").cast("long").alias("day_no"))


ASOF_SQL = """, r as (select actor, day, sum(score) as v from ent where slot = 1 group by actor, day), l as (select distinct actor, day from ent)
select l.actor, cast(l.day as varchar) as day, round({v}, 4) as v from l asof left join r on l.actor = r.actor and l.day {op} r.day"""


def _asof(spark: SparkSession, d: str, **how) -> DataFrame:
    e = entrants(spark, d)
    right = e.where("slot = 1").groupBy("actor", "day").agg(F.sum("score").alias("v"))
    found = asof.asof_join(e.select("actor", "day").distinct(), right, ["actor"], "day", ["v"], **how)
    return found.select("actor", F.col("day").cast("string").alias("day"), R("v", 4).alias("v"))


@query(ASOF_SQL.format(v="r.v", op=">="), ent=True)
def j4_asof_join(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d)


@query(ASOF_SQL.format(v="r.v", op=">"), ent=True)
def j5_asof_strict(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, strict=True)


@query(ASOF_SQL.format(v="case when l.day - r.day <= 40 then r.v end", op=">="), ent=True)
def j6_asof_tolerance(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, tolerance=40)


@query("select o_custkey, cast(max(o_orderdate) as date)::varchar as eff, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as v from orders where o_orderdate <= timestamp '1998-06-30' group by o_custkey")
def j7_current_version(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey").withColumn("v", F.col("o_orderkey"))
    at = F.lit("1998-06-30").cast(o.schema["o_orderdate"].dataType)
    return asof.current_version(o, ["o_custkey"], "o_orderdate", at, ["v"], "o_orderkey").select("o_custkey", F.to_date("o_orderdate").cast("string").alias("eff"), "v")


@query("""select contest, slot, a.score as score, (select score from ent b where b.contest = a.contest and b.slot = a.slot - 1) as "inner",
(select score from ent b where b.contest = a.contest and b.slot = a.slot + 1) as "outer", (select score from ent b where b.contest = a.contest and b.slot = 1) as "first" from ent a""", ent=True)
def j9_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return within.neighbour_join(entrants(spark, d), "contest", "slot", "score").select("contest", "slot", "score", "inner", "outer", "first")


@query("""select contest, slot, rank() over w + (count(*) over (partition by contest, score) - 1) / 2.0 as average, rank() over w + count(*) over (partition by contest, score) - 1 as max_rank, dense_rank() over w as dense_rank
from ent window w as (partition by contest order by score)""", ent=True)
def w11_rank_in(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    for m in ("average", "max", "dense"):
        e = within.rank_in(e, ["contest"], "score", m, f"r_{m}")
    return e.select("contest", "slot", F.col("r_average").cast("double").alias("average"), F.col("r_max").cast("long").alias("max_rank"), F.col("r_dense").cast("long").alias("dense_rank"))


@query("select contest, slot, round(case when n >= 4 then score - m end, 6) as centred, case when n >= 4 then score - lo end as gap from (select *, count(score) over (partition by contest) as n, avg(score) over (partition by contest) as m, min(score) over (partition by contest) as lo from ent)", ent=True)
def w12_center_in(spark: SparkSession, d: str) -> DataFrame:
    return within.center_in(entrants(spark, d), ["contest"], "score", 4).select("contest", "slot", R("centred").alias("centred"), F.col("centred_gap").alias("gap"))


@query("select contest, slot, max(score) over (partition by contest order by slot rows between unbounded preceding and 1 preceding) as inner_max, (select count(*) from ent b where b.contest = a.contest and b.slot < a.slot and b.score > a.score) as inner_slower from ent a", ent=True)
def w13_inner_relations(spark: SparkSession, d: str) -> DataFrame:
    return within.inner_relations(entrants(spark, d), "contest", "slot", "score").select("contest", "slot", "inner_max", F.col("inner_slower").cast("long").alias("inner_slower"))


@query(", f as (select contest, slot, score, row_number() over (partition by contest order by score, slot) as k from ent where slot <= 4), g as (select contest from f group by contest having count(*) = 4) select contest, (case when min(slot) filter (k = 1) = 1 then '1-' else '' end) || string_agg(slot::varchar, '' order by k) filter (slot > 1) as formation, max(score) filter (k = 2) - max(score) filter (k = 1) as gap_to_best from f join g using (contest) group by contest", ent=True)
def w14_formation(spark: SparkSession, d: str) -> DataFrame:
    return within.formation(entrants(spark, d), "contest", "slot", "score")


@query(", g as (select contest, slot, lead(score) over (partition by contest order by slot) - score as gap from ent) select contest, max(gap) as gap, arg_min(slot, (-gap, slot)) as gap_at from g where gap is not null group by contest", ent=True)
def w15_max_gap(spark: SparkSession, d: str) -> DataFrame:
    return within.max_gap(entrants(spark, d), "contest", "slot", "score")


@query("select contest, slot, max(case when slot = 2 then score end) over (partition by contest) as second from ent", ent=True)
def w16_spread(spark: SparkSession, d: str) -> DataFrame:
    return within.spread(entrants(spark, d), "contest", "slot", "score", 2, "second").select("contest", "slot", "second")


@query(", c as (select *, count(*) over (partition by contest, score_rank) as n from ent) select contest, slot, case when max(n) over (partition by contest) > 1 then slot else score_rank end as position from c", ent=True)
def w17_resolve_positions(spark: SparkSession, d: str) -> DataFrame:
    return within.resolve_positions(entrants(spark, d), "contest", "score_rank", "slot").select("contest", "slot", F.col("position").cast("long").alias("position"))


@query(""", h as (select actor, day, contest, slot, finish = 1 as hit from ent), i as (select *, sum(hit::int) over (partition by actor order by day, contest, slot) as island from h),
r as (select actor, island, count(*) as n from i where not hit group by actor, island), m as (select actor, max(island) as last, count(*) as n_rows, sum(hit::int)::bigint as hits from i group by actor)
select actor, n_rows, hits, coalesce((select max(n) from r where r.actor = m.actor), 0) as longest, coalesce((select n from r where r.actor = m.actor and r.island = m.last), 0) as current from m""", ent=True)
def w18_streaks(spark: SparkSession, d: str) -> DataFrame:
    return within.streaks(entrants(spark, d).withColumn("hit", F.col("finish") == 1), ["actor"], ["day", "contest", "slot"], "hit")


# ---- probability algebra, selection, settlement


@query("select contest, slot, round(exp(s - m) / sum(exp(s - m)) over (partition by contest), 8) as q from (select *, discount * 10 as s, max(discount * 10) over (partition by contest) as m from ent)", ent=True)
def p2_softmax(spark: SparkSession, d: str) -> DataFrame:
    return tuples.softmax_in(entrants(spark, d).withColumn("s", F.col("discount") * 10), "contest", "s").select("contest", "slot", R("q", 8).alias("q"))


TRIPLES = """t as (select contest, sum(p) as ta, sum(p ** 0.8) as tb from ent group by contest),
tri as (select x.contest, x.slot as s1, y.slot as s2, z.slot as s3, concat_ws('-', x.slot, y.slot, z.slot) as ticket,
 x.p / ta * (y.p ** 0.8) / (tb - x.p ** 0.8) * (z.p ** 0.8) / (tb - x.p ** 0.8 - y.p ** 0.8) as prob
 from ent x join ent y on x.contest = y.contest and x.slot <> y.slot join ent z on z.contest = x.contest and z.slot <> x.slot and z.slot <> y.slot join t on t.contest = x.contest)"""


def triples(spark: SparkSession, d: str) -> DataFrame:
    return tuples.ordered_triples(entrants(spark, d), "contest", "slot", "p", 0.8)


@query(", " + TRIPLES + " select contest, ticket, round(prob, 7) as prob from tri", ent=True)
def p3_ordered_triples(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).select("contest", "ticket", R("prob", 7).alias("prob"))


@query(", " + TRIPLES + " select contest, concat_ws('-', least(s1, s2), greatest(s1, s2)) as ticket, round(sum(prob), 7) as prob from tri group by 1, 2", ent=True)
def p7_marginal_pairs(spark: SparkSession, d: str) -> DataFrame:
    return tuples.marginal_pairs(triples(spark, d), "contest", ordered=False).withColumn("prob", R("prob", 7))


@query(", " + TRIPLES + " select contest, slot, round(sum(case when slot = s1 then prob else 0 end), 7) as win, round(sum(case when slot in (s1, s2) then prob else 0 end), 7) as top2, round(sum(prob), 7) as top3 from tri, lateral (select unnest([s1, s2, s3]) as slot) group by 1, 2", ent=True)
def p7_marginal_places(spark: SparkSession, d: str) -> DataFrame:
    return tuples.marginal_places(triples(spark, d), "contest").select("contest", "slot", *[R(c, 7).alias(c) for c in ("win", "top2", "top3")])


MARKET = "mk as (select *, (1 / odds) / sum(1 / odds) over (partition by contest) as market from ent)"


@query(", " + MARKET + " select contest, slot, round(market, 8) as market from mk", ent=True)
def p8_implied(spark: SparkSession, d: str) -> DataFrame:
    return tuples.implied(entrants(spark, d), "contest", "odds").select("contest", "slot", R("market", 8).alias("market"))


@query(", " + MARKET + " select contest, slot, round(r / sum(r) over (partition by contest), 8) as pooled from (select *, exp(0.6 * ln(greatest(p, 1e-9)) + 0.5 * ln(greatest(market, 1e-9))) as r from mk)", ent=True)
def p9_pool(spark: SparkSession, d: str) -> DataFrame:
    return tuples.pool(tuples.implied(entrants(spark, d), "contest", "odds"), "contest", "p", "market", 0.6, 0.5).select("contest", "slot", R("pooled", 8).alias("pooled"))


@query(", r as (select *, row_number() over (partition by contest order by p desc, slot) as k from ent where odds > 0), c as (select *, 1 / sum(1 / odds) over (partition by contest order by k) as composite from r), b as (select *, max((composite < 1.2)::int) over (partition by contest order by k) as bad from c) select contest, slot, round(composite, 6) as composite, round((1 / odds) / sum(1 / odds) over (partition by contest), 6) as weight from b where bad = 0", ent=True)
def p12_composite(spark: SparkSession, d: str) -> DataFrame:
    ranked = entrants(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("contest").orderBy(F.desc("p"), "slot")))
    return tuples.composite(ranked, "contest", "k", "odds", 1.2).select("contest", "slot", R("composite").alias("composite"), R("weight").alias("weight"))


@query(", r as (select *, row_number() over (partition by contest order by round(p * odds, 9) desc, slot) as k from ent where p * odds >= 0.8 and p >= 0.05) select contest, slot, round(p * odds, 6) as ev from r where k <= 3 and odds >= 2 and odds < 10", ent=True)
def t2_pick_value(spark: SparkSession, d: str) -> DataFrame:
    found = tuples.pick_value(entrants(spark, d), "contest", "p", "odds", "slot", 0.8, 0.05, 3, 2.0, 10.0)
    return found.select("contest", "slot", R("ev").alias("ev"))


RESULT = "res as (select contest, concat_ws('-', max(slot) filter (finish = 1), max(slot) filter (finish = 2), max(slot) filter (finish = 3)) as result, round(100 * max(odds) filter (finish = 1)) as payout from ent group by contest having max(finish) >= 3)"


def results(e: DataFrame, *more) -> DataFrame:
    """Result and payout of the contests that have three places, and what else is asked of their entrants."""
    place = lambda k: F.max(F.when(F.col("finish") == k, F.col("slot")))
    return e.groupBy("contest").agg(F.concat_ws("-", place(1), place(2), place(3)).alias("result"), F.round(100 * F.max(F.when(F.col("finish") == 1, F.col("odds")))).alias("payout"), F.max("finish").alias("n"), *more).where("n >= 3").drop("n")


@query(", " + TRIPLES + ", " + RESULT + """, pick as (select *, row_number() over (partition by contest order by round(prob, 10) desc, ticket) as k from tri)
select left(cast(d.day as varchar), 7) as month, count(*) as bets, sum((ticket = result)::int)::bigint as hits, round(sum(case when ticket = result then payout else 0 end) / sum(100.0), 6) as roi
from pick join res using (contest) join (select contest, max(day) as day from ent group by contest) d using (contest) where k <= 6 group by 1""", ent=True)
def l11_settle_roi(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    picked = tuples.top_k(triples(spark, d), ["contest"], [F.desc(F.round("prob", 10)), F.asc("ticket")], 6)
    settled = tuples.settle(picked, results(e, F.max("day").alias("day")), "contest").where("hit is not null")
    return tuples.roi(settled.withColumn("month", F.date_format("day", "yyyy-MM")), ["month"]).select("month", "bets", "hits", R("roi").alias("roi"))


@query(", " + DAILY + ", " + RESULT + """, g as (select sum(win) / sum(n) as p0 from daily), w as (select *, coalesce(sum(n) over v, 0) as wn, coalesce(sum(win) over v, 0) as ww from daily window v as (partition by actor order by day range between interval 89 days preceding and interval 1 day preceding)),
f as (select e.contest, e.slot, e.day, (ww + 10 * p0) / (wn + 10) as s from ent e join w on e.actor = w.actor and e.day = w.day, g), ent2 as (select contest, slot, day, s / sum(s) over (partition by contest) as p from f),
t as (select contest, sum(p) as t from ent2 group by contest), tri as (select x.contest, x.day, concat_ws('-', x.slot, y.slot, z.slot) as ticket, x.p / t * y.p / (t - x.p) * z.p / (t - x.p - y.p) as prob
 from ent2 x join ent2 y on x.contest = y.contest and x.slot <> y.slot join ent2 z on z.contest = x.contest and z.slot <> x.slot and z.slot <> y.slot join t on t.contest = x.contest),
pick as (select *, row_number() over (partition by contest order by round(prob, 9) desc, ticket) as k from tri)
select left(cast(day as varchar), 7) as month, count(*) as bets, sum((ticket = result)::int)::bigint as hits, round(sum(case when ticket = result then payout else 0 end) / sum(100.0), 6) as roi from pick join res using (contest) where k <= 6 group by 1""", ent=True)
def flagship_monthly_return(spark: SparkSession, d: str) -> DataFrame:
    """Actors' smoothed prior-90-day win rate, normalised in the contest, expanded to ordered triples; return of the top six by month."""
    e = entrants(spark, d)
    by_day = daily(spark, d)
    base = by_day.agg((F.sum("win") / F.sum("n")).alias("p0"))
    prior = asof.asof_stats(by_day, ["actor"], "day", ["n", "win"], 90).select("actor", "day", "w_n", "w_win").join(F.broadcast(base))
    scored = e.join(prior, ["actor", "day"]).withColumn("s", asof.shrink(F.col("w_win"), F.col("w_n"), F.col("p0"), 10))
    win = tuples.normalise(scored, "contest", "s", 0.0).select("contest", "slot", "q")
    picked = tuples.top_k(tuples.ordered_triples(win, "contest", "slot", "q"), ["contest"], [F.desc(F.round("prob", 9)), F.asc("ticket")], 6)
    settled = tuples.settle(picked, results(e, F.max("day").alias("day")), "contest").where("hit is not null")
    return tuples.roi(settled.withColumn("month", F.date_format("day", "yyyy-MM")), ["month"]).select("month", "bets", "hits", R("roi").alias("roi"))


# ---- evaluation


@query("select count(*) as contests, round(avg(loss), 6) as log_loss, round(avg(fav), 6) as favourite_hit from (select contest, sum(case when finish = 1 then -ln(greatest(1 / odds, 1e-9)) end) as loss, arg_max((finish = 1)::int, (round(1 / odds, 12), -slot)) as fav from ent group by contest)", ent=True)
def e1_log_loss(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d).withColumns({"hit": F.col("finish") == 1, "q": F.round(1 / F.col("odds"), 12)})
    return evaluate.log_loss(e, [], "q", "hit").select("contests", R("log_loss").alias("log_loss"), R("favourite_hit").alias("favourite_hit"))


@query(", " + MARKET + """, g as (select a / 10.0::double as a, b / 10.0::double as b from range(0, 11, 2) t(a), range(0, 11, 2) u(b)),
c as (select contest, a, b, ln(sum(exp(a * ln(greatest(p, 1e-9)) + b * ln(greatest(market, 1e-9))))) - sum(case when finish = 1 then a * ln(greatest(p, 1e-9)) + b * ln(greatest(market, 1e-9)) end) as loss from mk, g group by 1, 2, 3)
select a, b, round(avg(loss), 6) as log_loss from c group by a, b""", ent=True)
def e2_fit_pool(spark: SparkSession, d: str) -> DataFrame:
    e = tuples.implied(entrants(spark, d), "contest", "odds").withColumn("hit", F.col("finish") == 1)
    grid = spark.range(0, 11, 2).select((F.col("id") / 10).alias("a"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(10), F.lit(2)), lambda x: x / 10)).alias("b"))
    return evaluate.fit_pool(e, grid, "contest", "p", "market", "hit").withColumn("log_loss", R("log_loss"))


@query(""", u as (select contest, max(case when finish = 1 then odds end) as num, 1.0 as den from ent group by contest), r as (select *, unnest(range(1, 21)) as rep from u),
w as (select *, ('0x' || substr(md5(contest::varchar || ':' || rep::varchar), 1, 8))::bigint / 4294967296.0 as x from r),
k as (select rep, num, den, (x >= 0.36787944117144233)::int + (x >= 0.7357588823428847)::int + (x >= 0.9196986029286058)::int + (x >= 0.9810118431238462)::int + (x >= 0.9963401531726563)::int + (x >= 0.9994058151824183)::int as w from w)
select rep::int as rep, round(sum(w * num) / sum(w * den), 6) as ratio from k group by rep""", ent=True)
def e7_bootstrap_ratio(spark: SparkSession, d: str) -> DataFrame:
    u = entrants(spark, d).groupBy("contest").agg(F.max(F.when(F.col("finish") == 1, F.col("odds"))).alias("num"), F.lit(1.0).alias("den"))
    return evaluate.bootstrap_ratio(u, "contest", "num", "den", 20).withColumn("ratio", R("ratio"))


@query()
def e2_fit_pool_halves(spark: SparkSession, d: str) -> DataFrame:
    """The reference's whole grid (a 0.5 to 3.0, b 0 to 1.5 by 0.1) on the first half of the days, its best cell on the second."""
    e = evaluate.date_blocks(tuples.implied(entrants(spark, d), "contest", "odds"), "day", 2).withColumns({"hit": F.col("finish") == 1, "second": F.col("block") == 2})
    grid = spark.range(5, 31).select((F.col("id") / 10).alias("a"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda x: x / 10)).alias("b"))
    return evaluate.fit_and_apply_pool(e, grid, "contest", "p", "market", "hit", "second").select("a", "b", R("first_loss").alias("first_loss"), R("second_loss").alias("second_loss"))


@query()
def e7_bootstrap_limits(spark: SparkSession, d: str) -> DataFrame:
    u = entrants(spark, d).groupBy("contest").agg(F.max(F.when(F.col("finish") == 1, F.col("odds"))).alias("num"), F.lit(1.0).alias("den"))
    found = evaluate.bootstrap_limits(u, "contest", "num", "den", 1000)
    return found.select(*[R(c).alias(c) for c in found.columns])


@query(""", t as (select actor, count(*) as n, round(exp(-sum((finish = 1)::int)), 9) as pv from ent group by actor), k as (select *, least((count(*) over () - row_number() over (order by pv, actor) + 1) * pv, 1.0) as raw, row_number() over (order by pv, actor) as i from t)
select actor, pv, round(max(raw) over (order by i), 9) as p_holm from k""", ent=True)
def e10_holm(spark: SparkSession, d: str) -> DataFrame:
    t = entrants(spark, d).groupBy("actor").agg(F.round(F.exp(-F.sum((F.col("finish") == 1).cast("int"))), 9).alias("pv"))
    return evaluate.holm(t, "pv", "actor").select("actor", "pv", F.round("p_holm", 9).alias("p_holm"))


@query(""", c as (select 'class' as condition, class as value, p, (finish = 1)::int as y from ent union all select 'slot', slot::varchar, p, (finish = 1)::int from ent)
select condition, value, count(*) as n, round(avg(p), 6) as expected, round(avg(y), 6) as actual, round(sum(y - p) / sqrt(sum(p * (1 - p))), 4) as z from c group by 1, 2 having count(*) >= 20""", ent=True)
def e15_calibration_cells(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d).withColumn("hit", F.col("finish") == 1)
    found = evaluate.calibration_cells(e, {"class": F.col("class"), "slot": F.col("slot")}, "p", "hit", 20)
    return found.select("condition", "value", "n", R("expected").alias("expected"), R("actual").alias("actual"), R("z", 4).alias("z"))


@query(""", r as (select (finish = 1)::int as y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from ent)
select sum(y)::bigint as positives, (count(*) - sum(y))::bigint as negatives, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 8) as auc from r""", ent=True)
def a23_auc_rank(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.auc_rank(entrants(spark, d).withColumn("y", F.col("finish") == 1), "score", "y").withColumn("auc", R("auc", 8))


@query(""", c as (select site, score::int as v, count(*) as n from ent group by 1, 2), o as (select *, row_number() over (partition by site order by v) as k, lead(v) over (partition by site order by v) is null as last from c),
x as (with recursive x as (select site, k, 0 as bin, v as lo, n, n >= 150 as done, last from o where k = 1
 union all select o.site, o.k, case when x.done then x.bin + 1 else x.bin end, case when x.done then o.v else x.lo end, case when x.done then o.n else x.n + o.n end, case when x.done then o.n else x.n + o.n end >= 150, o.last from x join o on o.site = x.site and o.k = x.k + 1) select * from x)
select site, bin, lo::bigint as lo, n::bigint as n from x where done or last""", ent=True)
def a10_adaptive_bins(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.adaptive_bins(entrants(spark, d).withColumn("v", F.col("score").cast("int")), "site", "v", 150)


EQUITY = "dd as (select class, day, 100.0 * count(*) as stake, sum(case when finish = 1 then 100 * odds else 0 end) as returned from ent where slot = 1 group by class, day)"


@query(", " + EQUITY + """, t as (select class, day, sum(returned - stake) over (partition by class order by day) as total from dd)
select class, cast(day as varchar) as day, round(total, 4) as total, round(greatest(max(total) over w, 0) - total, 4) as drawdown, round(least(min(total) over w, 0), 4) as low from t window w as (partition by class order by day)""", ent=True)
def w23_equity_curve(spark: SparkSession, d: str) -> DataFrame:
    days = entrants(spark, d).where("slot = 1").groupBy("class", "day").agg((100.0 * F.count("*")).alias("stake"), F.sum(F.when(F.col("finish") == 1, 100 * F.col("odds")).otherwise(0.0)).alias("returned"))
    return evaluate.equity_curve(days, ["class"], "day", "stake", "returned").select("class", F.col("day").cast("string").alias("day"), *[R(c, 4).alias(c) for c in ("total", "drawdown", "low")])


@query(""", h as (select actor, day, contest, slot, finish = 1 as hit from ent), i as (select *, coalesce(sum(hit::int) over (partition by actor order by day, contest, slot rows between unbounded preceding and 1 preceding), 0) as island from h)
select actor, contest, slot, 100.0 * 2.0 ** ((row_number() over (partition by actor, island order by day, contest, slot) - 1) % 4) as stake from i""", ent=True)
def w24_martingale(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d).withColumn("hit", F.col("finish") == 1)
    return evaluate.martingale(e, ["actor"], ["day", "contest", "slot"], "hit", 100.0, 2.0, 4).select("actor", "contest", "slot", "stake")


@query(", b as (select day, ntile(3) over (order by day) as block from (select distinct day from ent)) select block, count(*) as n, cast(min(day) as varchar) as first_day from ent join b using (day) group by block", ent=True)
def e18_date_blocks(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.date_blocks(entrants(spark, d).select("day", "slot"), "day", 3).groupBy("block").agg(F.count("*").alias("n"), F.min("day").cast("string").alias("first_day"))
