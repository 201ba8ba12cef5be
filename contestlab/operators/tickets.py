"""Ticket rules and place strengths (P4 to P6, P10, P11, L2, L4, L6 to L8, L13, L16), each on one shuffle by contest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.operators.tuples import normalise, top_k


def exact_places(df: DataFrame, part: str, top1: str, top2: str, top3: str) -> DataFrame:
    """P5: chances of exactly the second and third place from cumulative ones, never below 0, each divided by the contest's sum."""
    w = Window.partitionBy(part)
    gaps = {"second": F.greatest(F.col(top2) - F.col(top1), F.lit(0.0)), "third": F.greatest(F.col(top3) - F.col(top2), F.lit(0.0))}
    out = df.withColumns(gaps)
    return out.withColumns({k: F.when(F.sum(k).over(w) > 0, F.col(k) / F.sum(k).over(w)).otherwise(F.lit(0.0)) for k in gaps})


def place_multiplier(df: DataFrame, slot: str, p: str, factors: dict[int, tuple[float, float]]) -> DataFrame:
    """Strengths for the second and third place, the probability times its slot's factors; slots without any keep it."""
    at = F.create_map(*[x for k, (b, c) in factors.items() for x in (F.lit(k), F.struct(F.lit(b).alias("b"), F.lit(c).alias("c")))])
    found = F.try_element_at(at, F.col(slot))
    return df.withColumns({"second": F.col(p) * F.coalesce(found["b"], F.lit(1.0)), "third": F.col(p) * F.coalesce(found["c"], F.lit(1.0))})


def apply_condition(df: DataFrame, rates: DataFrame, keys: list[str], part: str, p: str, lo: float = 0.6, hi: float = 1.6) -> DataFrame:
    """P10: probabilities times the ratio of the condition's rate to the base rate, bounded, then normalised.

    rates: one row a key of `keys`, with `rate` and `base`; keys without a row leave the probability as it is.
    """
    joined = df.join(rates.select(*keys, "rate", "base"), keys, "left")
    ratio = F.when(F.col("base") > 0, F.greatest(F.least(F.col("rate") / F.col("base"), F.lit(hi)), F.lit(lo)))
    return normalise(joined.withColumn("__p", F.col(p) * F.coalesce(ratio, F.lit(1.0))), part, "__p", 0.0, "adjusted").drop("__p", "rate", "base")


def expected_value(df: DataFrame, p: str, odds: str, least_p: float, into: str = "ev") -> DataFrame:
    """Probability times odds; null below the least probability or without odds."""
    return df.withColumn(into, F.when((F.col(p) >= least_p) & (F.col(odds) > 0), F.col(p) * F.col(odds)))


def pair_picks(triples: DataFrame, quotes: DataFrame, part: str, least_ev: float, least_p: float, k: int, heads: list[int]) -> DataFrame:
    """L2: the k ordered pairs of most expected value whose head is one of `heads`, from triples' probabilities and quotes of pairs."""
    pairs = triples.where(F.col("s1").isin(heads)).groupBy(part, F.concat_ws("-", "s1", "s2").alias("ticket")).agg(F.sum("prob").alias("prob"))
    good = expected_value(pairs.join(quotes, [part, "ticket"]), "prob", "odds", least_p).where(F.col("ev") >= least_ev)
    return top_k(good.withColumn("__ev", F.round("ev", 9)), [part], [F.desc("__ev"), F.asc("ticket")], k, "place").drop("__ev")


def formation_ticket(shapes: DataFrame, rules: dict[str, list[str]], part: str) -> DataFrame:
    """L4: the tickets that each contest's formation calls for; formations without a rule call for none."""
    at = F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    return shapes.select(part, "formation", F.posexplode(F.try_element_at(at, F.col("formation"))).alias("place", "ticket"))


def value_filter(tickets: DataFrame, part: str, p: str, odds: str, least_ev: float, extra_ev: float, extra_p: float, k: int) -> DataFrame:
    """Normal picks (`normal`) of enough expected value, and the k best others of high value as extras; `kind` tells which."""
    rows = tickets.withColumn("ev", F.col(p) * F.col(odds))
    rows = rows.withColumn("kind", F.when(F.col("normal") & (F.col("ev") >= least_ev), "normal").when(~F.col("normal") & (F.col("ev") >= extra_ev) & (F.col(p) >= extra_p), "extra")).where("kind is not null")
    place = F.row_number().over(Window.partitionBy(part, "kind").orderBy(F.desc(F.round("ev", 9)), "ticket"))
    return rows.withColumn("place", place).where((F.col("kind") == "normal") | (F.col("place") <= k))


def gap_ticket(triples: DataFrame, gaps: DataFrame, part: str, least_gap: float, k: int) -> DataFrame:
    """Where the largest gap (W15) reaches `least_gap`, the k likeliest triples headed by the slot just outside it."""
    wide = gaps.where(F.col("gap") >= least_gap).select(part, "gap_at")
    headed = triples.join(wide, part).where(F.col("s1") == F.col("gap_at") + 1).withColumn("__p", F.round("prob", 9))
    return top_k(headed, [part], [F.desc("__p"), F.asc("ticket")], k, "place").drop("__p", "gap_at")


def tier_ticket(triples: DataFrame, part: str, favourite: int, tiers: list[tuple[float, int, int]]) -> DataFrame:
    """By the favourite's chance a quota of tickets that it heads and one of others: (least chance, heads, others), the highest tier first."""
    w = Window.partitionBy(part)
    rows = triples.withColumn("own", F.col("s1") == favourite).withColumn("escape", F.round(F.sum(F.when(F.col("s1") == favourite, F.col("prob")).otherwise(0.0)).over(w), 9))
    quota = F.coalesce(*[F.when(F.col("escape") >= least, F.struct(F.lit(a).alias("own"), F.lit(b).alias("other"))) for least, a, b in tiers])
    place = F.row_number().over(Window.partitionBy(part, "own").orderBy(F.desc(F.round("prob", 9)), "ticket"))
    ranked = rows.withColumn("quota", quota).withColumn("place", place)
    return ranked.where(F.col("place") <= F.when(F.col("own"), F.col("quota.own")).otherwise(F.col("quota.other"))).drop("quota")


def timing_variants(quotes: DataFrame, part: str, label: str, p: str, odds: str, least_ev: float, k: int) -> DataFrame:
    """The same rule at every decision time: the k tickets of most expected value for each label."""
    good = quotes.withColumn("ev", F.col(p) * F.col(odds)).where(F.col("ev") >= least_ev).withColumn("__ev", F.round("ev", 9))
    return top_k(good, [part, label], [F.desc("__ev"), F.asc("ticket")], k, "place").drop("__ev")


def partner_tickets(triples: DataFrame, part: str, n_partners: int, n_thirds: int) -> DataFrame:
    """The likeliest head, its likeliest partners in second place, and for each the likeliest thirds."""
    rows = triples.withColumn("__p", F.round("prob", 9))
    head = Window.partitionBy(part, "s1")
    pair = Window.partitionBy(part, "s1", "s2")
    rows = rows.withColumns({"__h": F.round(F.sum("prob").over(head), 9), "__q": F.round(F.sum("prob").over(pair), 9)})
    rows = rows.withColumn("__head", F.dense_rank().over(Window.partitionBy(part).orderBy(F.desc("__h"), "s1"))).where("__head = 1")
    rows = rows.withColumn("partner", F.dense_rank().over(Window.partitionBy(part).orderBy(F.desc("__q"), "s2"))).where(F.col("partner") <= n_partners)
    return rows.withColumn("third", F.row_number().over(pair.orderBy(F.desc("__p"), "s3"))).where(F.col("third") <= n_thirds).drop("__p", "__h", "__q", "__head")


def enrich(spine: DataFrame, tables: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """The spine with every table's columns by its keys; tables are unique in their keys, and spine rows without a match stay."""
    for df, keys in tables:
        spine = spine.join(df, keys, "left")
    return spine


def fill_from(df: DataFrame, other: DataFrame, keys: list[str], col: str) -> DataFrame:
    """`col`, filled where it is null from the other table, which is unique in `keys`."""
    return df.join(other.select(*keys, F.col(col).alias("__o")), keys, "left").withColumn(col, F.coalesce(col, "__o")).drop("__o")


def trailing_mean(df: DataFrame, keys: list[str], day: str, end: str, days: int, value: Column, into: str = "mean") -> DataFrame:
    """Mean of the `days` days before the date `end`, that day itself left out."""
    last = F.lit(end).cast("date")
    return df.where((F.col(day) < last) & (F.col(day) >= F.date_sub(last, days))).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias(into))


def confidence(df: DataFrame, part: str, p: str) -> DataFrame:
    """(part, confidence, tier): 0.62 of the largest probability and 0.38 of what the normalised entropy leaves, over 0.8, in percent from 5 to 98."""
    each = df.groupBy(part).agg(F.count("*").alias("n"), F.max(p).alias("top"), (-F.sum(F.when(F.col(p) > 0, F.col(p) * F.log(p)))).alias("h"))
    even = F.when(F.col("n") > 1, F.col("h") / F.log(F.col("n"))).otherwise(0.0)
    value = F.greatest(F.least(F.round(100 * F.round(0.62 * F.col("top") + 0.38 * (1 - even), 9) / 0.8), F.lit(98.0)), F.lit(5.0)).cast("long")
    out = each.withColumn("confidence", value)
    return out.select(part, "confidence", F.when(value >= 72, "firm").when(value >= 55, "main").when(value >= 40, "mixed").otherwise("wild").alias("tier"))


def scenario(df: DataFrame, part: str, slot: str, p: str, table: DataFrame) -> DataFrame:
    """(part, method, prob): how the contest is won, from each slot's chance and the table (slot, method, share); few rows, a slot and method each."""
    return df.join(F.broadcast(table), slot).groupBy(part, "method").agg(F.sum(F.col(p) * F.col("share")).alias("prob"))


def heuristic_score(df: DataFrame, part: str, base: Column, weights: dict[str, float], into: str = "q") -> DataFrame:
    """Log of the base rate plus weighted gaps to the contest's means, as a softmax over the contest; missing values have no gap."""
    w = Window.partitionBy(part)
    score = F.log(F.greatest(base, F.lit(1e-6)))
    for c, x in weights.items():
        score = score + x * F.coalesce(F.col(c) - F.avg(c).over(w), F.lit(0.0))
    out = df.withColumn("__s", score).withColumn("__e", F.exp(F.col("__s") - F.max("__s").over(w)))
    return out.withColumn(into, F.col("__e") / F.sum("__e").over(w)).drop("__s", "__e")


def trend_adjust(df: DataFrame, part: str, p: str, trend: str, n: str, beta: float, k: float = 10.0, into: str = "q") -> DataFrame:
    """P times exp(beta * trend / (n + k)), divided by the contest's sum."""
    raw = F.col(p) * F.exp(beta * F.col(trend) / (F.col(n) + k))
    return df.withColumn("__r", raw).withColumn(into, F.col("__r") / F.sum("__r").over(Window.partitionBy(part))).drop("__r")


def settle_kinds(tickets: DataFrame, results: DataFrame, part: str, budget: float) -> DataFrame:
    """Settled contests by (part, kind): points, stake, rank of the hit among the tickets, whether there is one, and what returns.

    tickets: (part, kind, ticket, rank, odds); results: (part, kind, result, payout for 100). Each kind's tickets share `budget` by inverse
    odds (dutch stakes, in hundreds, at least one); without odds each has 100. A contest without a result of the kind has null hits.
    """
    w = Window.partitionBy(part, "kind")
    inverse = F.when(F.col("odds") > 0, 1 / F.col("odds"))
    stake = F.coalesce(F.greatest(F.floor(F.round(budget * inverse / F.sum(inverse).over(w) / 100, 9)), F.lit(1)) * 100, F.lit(100))
    rows = tickets.withColumn("stake", stake.cast("double")).join(results, [part, "kind"], "left")
    hit = F.col("ticket") == F.col("result")
    return rows.groupBy(part, "kind").agg(
        F.count("*").alias("points"), F.sum("stake").alias("stake"), F.min(F.when(hit, F.col("rank"))).alias("hit_rank"), F.max(hit).alias("hit"),
        F.when(F.max("result").isNotNull(), F.coalesce(F.sum(F.when(hit, F.col("payout") * F.col("stake") / 100)), F.lit(0.0))).alias("returned"))


def scored_tickets(df: DataFrame, part: str, slot: str, terms: dict[str, tuple[Column, float]], heads: int, k: int) -> DataFrame:
    """The best k ordered pairs of a contest whose first member is among the `heads` of the highest score: (part, ticket, score, rank).

    A slot's score is the weighted sum of `terms`; a ticket's is that of its head and half of its partner's.
    """
    score = F.lit(0.0)
    for c, x in terms.values():
        score = score + x * F.coalesce(c.cast("double"), F.lit(0.0))
    entries = df.select(part, slot, score.alias("s"))
    entries = entries.withColumn("h", F.row_number().over(Window.partitionBy(part).orderBy(F.desc(F.round("s", 9)), slot)))
    packed = entries.groupBy(part).agg(F.collect_list(F.struct(F.col(slot).alias("slot"), "s", "h")).alias("e"))
    pairs = packed.select(part, "e", F.explode(F.filter("e", lambda x: x["h"] <= heads)).alias("a")).select(
        part, "a", F.explode(F.filter("e", lambda y: y["slot"] != F.col("a.slot"))).alias("b"))
    out = pairs.select(part, F.concat_ws("-", "a.slot", "b.slot").alias("ticket"), (F.col("a.s") + F.col("b.s") / 2).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(part).orderBy(F.desc(F.round("score", 9)), "ticket"))).where(F.col("rank") <= k)


def ability_tickets(tickets: DataFrame, part: str, head: str, order: list, flags: DataFrame, keep: str, most: int) -> DataFrame:
    """The first `most` tickets of each contest, of those whose head has the flag `keep`; flags: (part, slot, flags)."""
    good = flags.where(F.array_contains("flags", keep)).select(part, F.col("slot").alias(head))
    w = Window.partitionBy(part).orderBy(*order)
    return tickets.join(good, [part, head], "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
