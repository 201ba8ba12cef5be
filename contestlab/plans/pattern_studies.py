"""Queries of ticket templates, ability back-tests, upsets and sectioned logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlab.operators import patterns
from contestlab.operators.rules import rank_of, wide
from contestlab.plans.queries import R, query
from contestlab.plans.standins import entrants, spread, table
from contestlab.sources import text
from contestlab.storage import shared_dir

#: Name (what follows / parts alternatives), template, condition: two heads (over, under, both, switched by rank), and fixed shapes with the first ahead or not.
SHAPES = {
    "over": ("2-3-* 2-*-3", "x2 > x1"), "under": ("2-1-*", "x2 > x1"), "both": ("2-3-* 2-*-3 2-1-*", "x2 > x1"),
    "switched/over": ("2-3-* 2-*-3", "x2 > x1 and x2_rank <= 2"), "switched/under": ("2-1-*", "x2 > x1 and x2_rank > 2"),
    "first holds": ("1-23-234", "x1 >= x2"), "first and outer": ("1-456-*", "x1 >= x2 and x4 > x3"), "box of three": ("123-123-123", "x1 is not null"), "outer heads": ("456-*-*", "x4 > x3 and x4 > x2"),
}


def _contests(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d).select("contest", "slot", F.col("finish").alias("f"), F.col("score").alias("x"), "odds", F.lit(1).alias("one"), F.year("day").alias("year"))
    w = wide(e, "contest", "slot", ["f", "x", "odds"], ["year"])
    at = lambda place: F.expr("case " + " ".join(f"when f{k} = {place} then '{k}'" for k in range(1, 7)) + " end")
    won = F.expr("case " + " ".join(f"when f{k} = 1 then odds{k}" for k in range(1, 7)) + " end")
    return w.withColumns({"result": F.concat(at(1), F.lit("-"), at(2), F.lit("-"), at(3)), "payout": 1000 * won, "x2_rank": F.expr(rank_of("x", 2, least=1))})


def _shapes_sql() -> str:
    cells = " union all ".join(
        f"select year, '{name.split('/')[0]}' as shape, count(*) as contests, {len(patterns.compile_tickets(t))} * count(*) as tickets, count_if(result in ({', '.join(repr(x) for x in patterns.compile_tickets(t))})) as hits, "
        f"coalesce(sum(case when result in ({', '.join(repr(x) for x in patterns.compile_tickets(t))}) then payout end), 0) as returned from r where result is not null and ({c}) group by year" for name, (t, c) in SHAPES.items())
    at = lambda place: "max(case when finish = " + str(place) + " then slot::varchar end)"
    return f""", w as (select contest, any_value(year(day)) as year, {', '.join(f'max(case when slot = {k} then score end) as x{k}' for k in range(1, 7))}, {at(1)} || '-' || {at(2)} || '-' || {at(3)} as result, 1000 * max(case when finish = 1 then odds end) as payout from ent group by contest),
r as (select *, {rank_of('x', 2, least=1)} as x2_rank from w), c as ({cells})
select year, shape, sum(contests)::bigint as contests, sum(tickets)::bigint as tickets, sum(hits)::bigint as hits, round(sum(hits) / sum(contests), 6) as hit_rate, round(sum(returned) / (100 * sum(tickets)), 6) as roi from c group by year, shape"""


@query(_shapes_sql(), ent=True)
def e29_pattern_cells(spark: SparkSession, d: str) -> DataFrame:
    found = patterns.pattern_study(_contests(spark, d), {k: (t, F.expr(c)) for k, (t, c) in SHAPES.items()}, ["year"], "result", "payout")
    return found.withColumns({"hit_rate": R("hit_rate"), "roi": R("roi")})


@query("""select class, slot, count(*) as n, round(avg((finish = 1)::int), 6) as place1, round(avg((finish = 2)::int), 6) as place2, round(avg((finish = 3)::int), 6) as place3, round(avg((finish > 3)::int), 6) as later from ent group by class, slot""", ent=True)
def e29_outcome_by_position(spark: SparkSession, d: str) -> DataFrame:
    found = patterns.outcome_by_position(entrants(spark, d), ["class"], "slot", "finish")
    return found.withColumns({c: R(c) for c in ("place1", "place2", "place3", "later")})


CUTS = ["1995-07-01", "1996-01-01", "1996-07-01", "1997-01-01", "1997-07-01"]


@query(", " + "b as (select slot, round(avg((finish = 1)::int), 6) as base from ent where day < date '1995-07-01' group by slot), " + f"""x as (select actor, (day >= date '{CUTS[0]}')::int + (day >= date '{CUTS[1]}')::int + (day >= date '{CUTS[2]}')::int + (day >= date '{CUTS[3]}')::int + (day >= date '{CUTS[4]}')::int as s,
  (finish = 1)::int as y, base as e, case when finish = 1 then 100 * odds else 0 end as r from ent join b using (slot)),
k as (select actor, s, count(*) as n, sum(y) as y, sum(e) as e, sum(e * (1 - e)) as v, sum(r) as r from x group by actor, s),
w as (select *, sum(n) over p as bn, sum(y) over p as by_, sum(e) over p as be, sum(v) over p as bv from k window p as (partition by actor order by s rows between unbounded preceding and 1 preceding)),
g as (select *, case when bn >= 10 and bv > 0 and (by_ - be) / bn >= 0.02 and (by_ - be) / sqrt(bv) >= 0.5 then 'good' when bn >= 10 and bv > 0 and (by_ - be) / bn <= -0.02 and (by_ - be) / sqrt(bv) <= -0.5 then 'poor' else 'none' end as kind from w where s > 0)
select [{', '.join(repr(c) for c in CUTS)}][s] as cut, kind, count(*) as owners, sum(n)::bigint as n, round(sum(y) / sum(n), 6) as rate, round(sum(e) / sum(n), 6) as expected, round(sum(r) / (100 * sum(n)), 6) as roi from g group by s, kind""", ent=True)
def e36_ability_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Actors found strong or weak for their positions before each year, tried on that year alone."""
    e = entrants(spark, d)
    base = e.where(F.col("day") < F.lit(CUTS[0]).cast("date")).groupBy("slot").agg(F.round(F.avg((F.col("finish") == 1).cast("int")), 6).alias("base"))
    won = F.col("finish") == 1
    found = patterns.ability_backtest(e.join(F.broadcast(base), "slot"), ["actor"], "day", CUTS, won, "base", F.when(won, 100 * F.col("odds")).otherwise(0.0), 10, 0.02, 0.5)
    return found.withColumns({c: R(c) for c in ("rate", "expected", "roi")})


@query(""", s as (select *, date_trunc('quarter', day) as session from ent), m as (select title, session, actor, day, max(score) as m from s group by all),
b as (select title, session, actor, day, max(m) over (partition by title, session, actor order by day rows between unbounded preceding and 1 preceding) as best from m),
r as (select s.*, case when best is not null then rank() over (partition by contest order by best desc nulls last) end as rank from s join b using (title, session, actor, day))
select rank::int as rank, count(*) as n, count_if(finish = 1) as hits, round(count_if(finish = 1) / count(*), 6) as rate, round(sum(case when finish = 1 then 100 * odds else 0 end) / (100 * count(*)), 6) as roi from r group by rank""", ent=True)
def e39_rank_tickets(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d).withColumn("session", F.date_trunc("quarter", "day"))
    ranked = patterns.session_best_rank(e, ["title", "session"], "actor", "day", "score", "contest", "slot")
    won = F.col("finish") == 1
    return patterns.rank_ticket_study(ranked, "rank", won, F.when(won, 100 * F.col("odds")).otherwise(0.0)).withColumns({"rate": R("rate"), "roi": R("roi")})


@query(""", c as (select contest, day, title, count(*) as size, max(p) as top, min(odds) as short, max(case when finish = 1 then odds end) as won from ent group by all),
x as (select (won >= 6)::int as u, unnest([{'section': 'favourite', 'band': floor(top * 10)::bigint::varchar}, {'section': 'shortest', 'band': floor(short)::bigint::varchar}, {'section': 'title', 'band': title}, {'section': 'size', 'band': size::varchar}, {'section': 'month', 'band': month(day)::varchar}, {'section': 'weekday', 'band': dayofweek(day)::varchar}]) as e from c where won is not null),
f as (select e.section as section, e.band as band, count(*) as n, sum(u) as upsets from x group by all)
select section, band, n, upsets::bigint as upsets, round(upsets / n, 6) as rate, round(upsets / n / (sum(upsets) over (partition by section) / sum(n) over (partition by section)), 6) as lift from f qualify n >= 5""", ent=True)
def e39_upset_study(spark: SparkSession, d: str) -> DataFrame:
    """A win at odds of six or more, by six bands of what was known before."""
    c = entrants(spark, d).groupBy("contest", "day", "title").agg(F.count("*").alias("size"), F.max("p").alias("top"), F.min("odds").alias("short"), F.max(F.when(F.col("finish") == 1, F.col("odds"))).alias("won"))
    sections = {"favourite": F.floor(F.col("top") * 10).cast("long"), "shortest": F.floor("short").cast("long"), "title": F.col("title"), "size": F.col("size"), "month": F.month("day"), "weekday": F.dayofweek("day") - 1}
    return patterns.upset_study(c, F.col("won") >= 6, sections, 5).withColumns({"rate": R("rate"), "lift": R("lift")})


@query("select o_orderkey::varchar as contest, o_orderdate::date::varchar as day, l_linenumber::varchar as slot, l_quantity::bigint::varchar as score, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by all")
def s14_sections(spark: SparkSession, d: str) -> DataFrame:
    """Order lines written as a log under headings of the order and its day, and read back in splits."""
    lines = spread(spark, d, "lineitem", "l_orderkey").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    head = F.concat(F.lit("== "), F.col("l_orderkey").cast("string"), F.lit("\n#day "), F.to_date("o_orderdate").cast("string"), F.lit("\n"))
    rows = lines.groupBy("l_orderkey", "o_orderdate").agg(F.array_sort(F.collect_list(F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("bigint").cast("string")))).alias("r"))
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    rows.select(F.concat(head, F.array_join("r", "\n")).alias("value")).write.text(path)
    found = text.read_split_sections(spark, path, {"contest": r"^== (\d+)$", "day": r"^#day (\S+)$"}, r"^(\d+) (\d+)$", ["slot", "score"])
    return found.groupBy("contest", "day", "slot", "score").agg(F.count("*").alias("n"))
