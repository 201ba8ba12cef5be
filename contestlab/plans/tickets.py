"""Queries for ticket rules, place strengths and scalar functions, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlab.functions import text as T
from contestlab.operators import tickets, tuples, within
from contestlab.plans.queries import RESULT, TRIPLES, R, query, results, triples
from contestlab.plans.standins import entrants, table

WON = lambda: (F.col("finish") == 1).cast("int")

# ---- scalar functions


@query("with x as (select o_orderkey, (o_orderkey % 900 + 100)::varchar as a, (o_orderkey % 700 + 100)::varchar as b from orders) select o_orderkey, a[1] || '-' || a[2] || '-' || a[3] || case when a = b then '' else ' ' || b[1] || '-' || b[2] || '-' || b[3] end as tickets from x")
def f5_parse_tickets(spark: SparkSession, d: str) -> DataFrame:
    n = lambda k: ((F.col("o_orderkey") % k) + 100).cast("string")
    listed = F.concat(n(900), F.lit(", "), n(700), F.lit(" 12 "), n(900))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.parse_tickets(listed), " ").alias("tickets"))


@query("select event_id, (user_id % 4)::int as n from events")
def f10_parts_count(spark: SparkSession, d: str) -> DataFrame:
    listed = F.concat(F.col("event_type"), F.lit(", ring x"), (F.col("user_id") % 4).cast("string"))
    return table(spark, d, "events").select("event_id", T.parts_count(listed, "ring").alias("n"))


@query(", x as (select contest, slot, least(greatest(round_even(100 * p / 0.85, 0), 0), 100)::int as index from ent) select contest, slot, index, case when index >= 60 then 'high' when index >= 30 then 'mid' when index >= 0 then 'low' end as tier from x", ent=True)
def f18_tiered_index(spark: SparkSession, d: str) -> DataFrame:
    index, tier = T.tiered_index(F.col("p"), 0.85, [(0, "low"), (30, "mid"), (60, "high")])
    return entrants(spark, d).select("contest", "slot", index.alias("index"), tier.alias("tier"))


# ---- joins and snapshots


@query("select o_orderkey, c_name, n_name, r_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def j1_enrich(spark: SparkSession, d: str) -> DataFrame:
    spine = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return tickets.enrich(spine, [(customer, ["c_custkey"]), (nation, ["n_nationkey"]), (table(spark, d, "region"), ["r_regionkey"])]).select("o_orderkey", "c_name", "n_name", "r_name")


@query("select c_custkey, coalesce(case when c_custkey % 3 > 0 then c_acctbal end, v) as c_acctbal from customer left join (select o_custkey, max(o_totalprice) as v from orders group by 1) on c_custkey = o_custkey")
def j3_fill_from(spark: SparkSession, d: str) -> DataFrame:
    holed = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("c_acctbal"))
    other = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return tickets.fill_from(holed, other, ["c_custkey"], "c_acctbal")


@query(" select site, slot, count(*) as n, round(avg((finish = 1)::int), 6) as mean from ent where day < date '1998-06-01' and day >= date '1998-06-01' - 365 group by 1, 2", ent=True)
def w5_trailing_mean(spark: SparkSession, d: str) -> DataFrame:
    return tickets.trailing_mean(entrants(spark, d), ["site", "slot"], "day", "1998-06-01", 365, WON()).withColumn("mean", R("mean"))


# ---- place strengths


@query(" select contest, slot, round(greatest(p, 0.05) / sum(greatest(p, 0.05)) over (partition by contest), 8) as q from ent", ent=True)
def p1_normalise(spark: SparkSession, d: str) -> DataFrame:
    return tuples.normalise(entrants(spark, d), "contest", "p", 0.05).select("contest", "slot", R("q", 8).alias("q"))


MIXED = """, s as (select contest, slot, p, price * 0.4 / sum(price) over (partition by contest) + 0.6 * score / sum(score) over (partition by contest) as b from ent),
tot as (select contest, sum(p) as ta, sum(b) as tb from s group by contest)
select x.contest, concat_ws('-', x.slot, y.slot, z.slot) as ticket, round(x.p / ta * y.b / (tb - x.b) * z.b / (tb - x.b - y.b), 7) as prob
from s x join s y on x.contest = y.contest and x.slot <> y.slot join s z on z.contest = x.contest and z.slot <> x.slot and z.slot <> y.slot join tot on tot.contest = x.contest"""


@query(MIXED, ent=True)
def p4_mixed_triples(spark: SparkSession, d: str) -> DataFrame:
    e = tuples.normalise(entrants(spark, d), "contest", "score", 0.0, "share")
    return tuples.ordered_triples(e, "contest", "slot", "p", second="share", third="share", mix=0.4).select("contest", "ticket", R("prob", 7).alias("prob"))


PLACES = ", " + TRIPLES + ", m as (select contest, slot, sum(case when slot = s1 then prob else 0 end) as win, sum(case when slot in (s1, s2) then prob else 0 end) as top2, sum(prob) as top3 from tri, lateral (select unnest([s1, s2, s3]) as slot) group by 1, 2)"


@query(PLACES + ", g as (select contest, slot, greatest(top2 - win, 0) as second, greatest(top3 - top2, 0) as third from m) select contest, slot, round(second / sum(second) over (partition by contest), 6) as second, round(third / sum(third) over (partition by contest), 6) as third from g", ent=True)
def p5_exact_places(spark: SparkSession, d: str) -> DataFrame:
    found = tickets.exact_places(tuples.marginal_places(triples(spark, d), "contest"), "contest", "win", "top2", "top3")
    return found.select("contest", "slot", R("second").alias("second"), R("third").alias("third"))


@query(" select contest, slot, round(p * case slot when 1 then 0.8 when 2 then 1.2 else 1 end, 8) as second, round(p * case slot when 1 then 0.7 when 2 then 1.1 else 1 end, 8) as third from ent", ent=True)
def p6_place_multiplier(spark: SparkSession, d: str) -> DataFrame:
    found = tickets.place_multiplier(entrants(spark, d), "slot", "p", {1: (0.8, 0.7), 2: (1.2, 1.1)})
    return found.select("contest", "slot", R("second", 8).alias("second"), R("third", 8).alias("third"))


@query(""", r as (select title, slot, avg((finish = 1)::int) as rate from ent group by 1, 2), b as (select slot, avg((finish = 1)::int) as base from ent group by 1),
x as (select contest, ent.slot, p * greatest(least(rate / base, 1.6), 0.6) as a from ent join r using (title, slot) join b on b.slot = ent.slot)
select contest, slot, round(a / sum(a) over (partition by contest), 7) as adjusted from x""", ent=True)
def p10_apply_condition(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    rates = e.groupBy("title", "slot").agg(F.avg(WON()).alias("rate")).join(e.groupBy("slot").agg(F.avg(WON()).alias("base")), "slot")
    return tickets.apply_condition(e, rates, ["title", "slot"], "contest", "p").select("contest", "slot", R("adjusted", 7).alias("adjusted"))


@query(" select contest, slot, round(case when p >= 0.1 then p * odds end, 6) as ev from ent", ent=True)
def p11_expected_value(spark: SparkSession, d: str) -> DataFrame:
    return tickets.expected_value(entrants(spark, d), "p", "odds", 0.1).select("contest", "slot", R("ev").alias("ev"))


# ---- tickets

PAIR_QUOTES = "pq as (select x.contest, concat_ws('-', x.slot, y.slot) as ticket, x.odds * y.odds as odds from ent x join ent y on x.contest = y.contest and x.slot <> y.slot)"


def _quotes(spark: SparkSession, d: str, n: int) -> DataFrame:
    """Quotes of ordered pairs or triples: the product of their slots' odds."""
    packed = entrants(spark, d).groupBy("contest").agg(F.collect_list(F.struct("slot", "odds")).alias("e"))
    rows = packed
    for k in range(n):
        rows = rows.withColumn(f"x{k}", F.explode("e"))
        for j in range(k):
            rows = rows.where(F.col(f"x{j}.slot") != F.col(f"x{k}.slot"))
    odds = F.col("x0.odds")
    for k in range(1, n):
        odds = odds * F.col(f"x{k}.odds")
    return rows.select("contest", F.concat_ws("-", *[f"x{k}.slot" for k in range(n)]).alias("ticket"), odds.alias("odds"))


@query(f", {TRIPLES}, {PAIR_QUOTES}, g as (select t.contest, t.ticket, prob * odds as ev from (select contest, concat_ws('-', s1, s2) as ticket, sum(prob) as prob from tri where s1 in (1, 2, 3) group by 1, 2) t join pq using (contest, ticket) where prob >= 0.05 and prob * odds >= 0.6), k as (select *, row_number() over (partition by contest order by round(ev, 9) desc, ticket) as place from g) select contest, ticket, place, round(ev, 5) as ev from k where place <= 3", ent=True)
def l2_pair_picks(spark: SparkSession, d: str) -> DataFrame:
    return tickets.pair_picks(triples(spark, d), _quotes(spark, d, 2), "contest", 0.6, 0.05, 3, [1, 2, 3]).select("contest", "ticket", "place", R("ev", 5).alias("ev"))


@query(""", f as (select contest, string_agg(slot::varchar, '' order by score, slot) filter (slot > 1) as s, arg_min(slot, (score, slot)) = 1 as one from ent where slot <= 4 group by contest having count(*) = 4),
g as (select contest, case when one then '1-' else '' end || s as formation from f), r as (select * from (values ('1-234', 0, '1-2-3'), ('1-234', 1, '1-2-4'), ('432', 0, '4-3-2'), ('324', 0, '3-2-4'), ('324', 1, '3-4-2')) as v(formation, place, ticket))
select contest, formation, place, ticket from g join r using (formation)""", ent=True)
def l4_formation_ticket(spark: SparkSession, d: str) -> DataFrame:
    return tickets.formation_ticket(within.formation(entrants(spark, d), "contest", "slot", "score"), {"1-234": ["1-2-3", "1-2-4"], "432": ["4-3-2"], "324": ["3-2-4", "3-4-2"]}, "contest")


TRIPLE_QUOTES = "tq as (select tri.contest, ticket, s1, s2, s3, prob, a.odds * b.odds * c.odds as odds from tri join ent a on a.contest = tri.contest and a.slot = s1 join ent b on b.contest = tri.contest and b.slot = s2 join ent c on c.contest = tri.contest and c.slot = s3)"


@query(f", {TRIPLES}, {TRIPLE_QUOTES}, n as (select *, row_number() over (partition by contest order by round(prob, 9) desc, ticket) <= 6 as normal, prob * odds as ev from tq), x as (select *, case when normal and ev >= 0.9 then 'normal' when not normal and ev >= 1.25 and prob >= 0.012 then 'extra' end as kind from n), k as (select *, row_number() over (partition by contest, kind order by round(ev, 9) desc, ticket) as place from x where kind is not null) select contest, ticket, kind, place, round(ev, 5) as ev from k where kind = 'normal' or place <= 3", ent=True)
def l6_value_filter(spark: SparkSession, d: str) -> DataFrame:
    tri = triples(spark, d).join(_quotes(spark, d, 3), ["contest", "ticket"]).withColumn("q", F.round("prob", 9))
    normal = tuples.top_k(tri, ["contest"], [F.desc("q"), F.asc("ticket")], 120).withColumn("normal", F.col("rank") <= 6)
    return tickets.value_filter(normal, "contest", "prob", "odds", 0.9, 1.25, 0.012, 3).select("contest", "ticket", "kind", "place", R("ev", 5).alias("ev"))


@query(f", {TRIPLES}, gp as (select contest, slot, lead(score) over (partition by contest order by slot) - score as g from ent), w as (select contest, max(g) as gap, arg_min(slot, (-g, slot)) as gap_at from gp where g is not null group by contest), h as (select tri.*, row_number() over (partition by tri.contest order by round(prob, 9) desc, ticket) as place from tri join w on w.contest = tri.contest and gap >= 10 and s1 = gap_at + 1) select contest, ticket, place from h where place <= 4", ent=True)
def l7_gap_ticket(spark: SparkSession, d: str) -> DataFrame:
    return tickets.gap_ticket(triples(spark, d), within.max_gap(entrants(spark, d), "contest", "slot", "score"), "contest", 10.0, 4).select("contest", "ticket", "place")


@query(f", {TRIPLES}, x as (select *, s1 = 1 as own, round(sum(case when s1 = 1 then prob else 0 end) over (partition by contest), 9) as escape, row_number() over (partition by contest, s1 = 1 order by round(prob, 9) desc, ticket) as place from tri) select contest, ticket, own, place from x where place <= case when own then case when escape >= 0.4 then 6 when escape >= 0.2 then 4 else 2 end else case when escape >= 0.4 then 1 when escape >= 0.2 then 3 else 5 end end", ent=True)
def l8_tier_ticket(spark: SparkSession, d: str) -> DataFrame:
    return tickets.tier_ticket(triples(spark, d), "contest", 1, [(0.4, 6, 1), (0.2, 4, 3), (0.0, 2, 5)]).select("contest", "ticket", "own", "place")


@query(", v as (select contest, slot::varchar as ticket, p, odds, unnest([('T5', 1.0), ('T1', 0.9), ('FINAL', 0.8)]) as l from ent), g as (select contest, ticket, l[1] as label, p * odds * l[2]::double as ev from v), k as (select *, row_number() over (partition by contest, label order by round(ev, 9) desc, ticket) as place from g where ev >= 0.7) select contest, label, ticket, place, round(ev, 5) as ev from k where place <= 2", ent=True)
def l13_timing_variants(spark: SparkSession, d: str) -> DataFrame:
    labels = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(f).alias("f")) for n, f in (("T5", 1.0), ("T1", 0.9), ("FINAL", 0.8))])).alias("l")
    quotes = entrants(spark, d).select("contest", F.col("slot").cast("string").alias("ticket"), "p", "odds", labels).select("contest", "ticket", "p", (F.col("odds") * F.col("l.f")).alias("odds"), F.col("l.label").alias("label"))
    return tickets.timing_variants(quotes, "contest", "label", "p", "odds", 0.7, 2).select("contest", "label", "ticket", "place", R("ev", 5).alias("ev"))


@query(f", {TRIPLES}, x as (select *, round(sum(prob) over (partition by contest, s1), 9) as h, round(sum(prob) over (partition by contest, s1, s2), 9) as q from tri), y as (select *, dense_rank() over (partition by contest order by h desc, s1) as hr from x), z as (select *, dense_rank() over (partition by contest order by q desc, s2) as partner from y where hr = 1), u as (select *, row_number() over (partition by contest, s1, s2 order by round(prob, 9) desc, s3) as third from z where partner <= 2) select contest, ticket, partner, third from u where third <= 2", ent=True)
def l16_partner_tickets(spark: SparkSession, d: str) -> DataFrame:
    return tickets.partner_tickets(triples(spark, d), "contest", 2, 2).select("contest", "ticket", "partner", "third")


@query(f", {TRIPLES}, {RESULT}, k as (select *, row_number() over (partition by contest order by round(prob, 9) desc, ticket) as k from tri), s as (select site, ticket = result as hit, case when ticket = result then payout else 0 end as returned from k join res using (contest) join (select distinct contest, site from ent where slot = 1) using (contest) where k <= 6) select site, count(*) as bets, sum(hit::int)::bigint as hits, round(sum(returned) / sum(100.0), 6) as roi, round((sum(returned) - max(returned)) / sum(100.0), 6) as roi_without_best from s group by 1", ent=True)
def e6_roi(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d)
    picks = tuples.top_k(triples(spark, d).withColumn("q", F.round("prob", 9)), ["contest"], [F.desc("q"), F.asc("ticket")], 6).select("contest", "ticket")
    settled = tuples.settle(picks, results(e), "contest").where("hit is not null").join(e.where("slot = 1").select("contest", "site"), "contest")
    return tuples.roi(settled, ["site"]).withColumns({"roi": R("roi"), "roi_without_best": R("roi_without_best")})
