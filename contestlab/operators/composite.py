"""Composite studies of a back-test (E38): each compares many cases of a rule on the same tickets in one or two shuffles.

Cases (times, thresholds, lengths) are parameters, so their number is small; every case is a conditional sum over the same rows, and only the summed
row is turned into one row a case. Ranks by probability are taken once, whatever the number of cases.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEAR = 9  # digits at which probabilities and values count as equal


def _unfold(one: DataFrame, cases: list[dict[str, Column]]) -> DataFrame:
    """One row a case from columns of a summed row."""
    return one.select(F.inline(F.array(*[F.struct(*[c.alias(name) for name, c in case.items()]) for case in cases])))


def _sums(df: DataFrame, cases: list[dict[str, Column]]) -> DataFrame:
    return df.agg(*[c.alias(f"{name}_{k}") for k, case in enumerate(cases) for name, c in case.items()])


def _from_best(part: str, p: str, ticket: str):
    return Window.partitionBy(part).orderBy(F.desc(F.round(p, NEAR)), ticket).rowsBetween(Window.unboundedPreceding, 0)


def _all_quoted(df: DataFrame, part: str, quotes: list[str]) -> DataFrame:
    """The rows of contests in which every entrant has all the quotes."""
    quoted = reduce(lambda a, b: a & b, [F.coalesce(F.col(q) > 0, F.lit(False)) for q in quotes])
    return df.withColumn("__every", F.bool_and(quoted).over(Window.partitionBy(part))).where("__every").drop("__every")


def decision_times(df: DataFrame, part: str, ticket: str, p: str, quotes: dict[str, str], final: str, hit: str, least_ev: float, most: int) -> DataFrame:
    """Decide by the quotes of different times: of the tickets of enough value at that time the `most` likeliest, paid at the final quote.

    Contests count in which every ticket is quoted at every time. `drift` is final over deciding quote of the hits.
    """
    rows = _all_quoted(df, part, list(quotes.values()))
    w = _from_best(part, p, ticket)
    good = {k: F.round(F.col(p) * F.col(q), NEAR) >= least_ev for k, q in enumerate(quotes.values())}
    rows = rows.withColumns({f"__t{k}": c & (F.count_if(c).over(w) <= most) for k, c in good.items()})
    won = lambda k: F.col(f"__t{k}") & F.col(hit)
    sums = [{"bets": F.count_if(f"__t{k}"), "hits": F.count_if(won(k)), "back": F.sum(F.when(won(k), F.col(final))), "drift": F.avg(F.when(won(k), F.col(final) / F.col(q)))} for k, q in enumerate(quotes.values())]
    return _unfold(_sums(rows, sums), [{"time": F.lit(name), "bets": F.col(f"bets_{k}"), "hits": F.col(f"hits_{k}"),
                                        "roi": F.try_divide(F.coalesce(F.col(f"back_{k}"), F.lit(0.0)), F.col(f"bets_{k}")), "drift": F.col(f"drift_{k}")} for k, name in enumerate(quotes)])


def ticket_grid(df: DataFrame, part: str, ticket: str, p: str, odds: str, hit: str, levels: list[float], mosts: list[int]) -> DataFrame:
    """Bets, hits, return, and return without the best payout for every pair of least value and most tickets a contest (the likeliest ones)."""
    w = _from_best(part, p, ticket)
    value = F.round(F.col(p) * F.col(odds), NEAR)
    rows = df.withColumns({f"__n{k}": F.when(value >= level, F.count_if(value >= level).over(w)) for k, level in enumerate(levels)})
    cells = [(k, level, most) for k, level in enumerate(levels) for most in mosts]
    taken = lambda k, most: F.col(f"__n{k}") <= most
    paid = lambda k, most: F.when(taken(k, most) & F.col(hit), F.col(odds))
    sums = [{"bets": F.count_if(taken(k, most)), "hits": F.count(paid(k, most)), "back": F.coalesce(F.sum(paid(k, most)), F.lit(0.0)), "best": F.coalesce(F.max(paid(k, most)), F.lit(0.0))} for k, _, most in cells]
    return _unfold(_sums(rows, sums), [{"least_ev": F.lit(float(level)), "most": F.lit(most), "bets": F.col(f"bets_{i}"), "hits": F.col(f"hits_{i}"), "roi": F.try_divide(F.col(f"back_{i}"), F.col(f"bets_{i}")),
                                        "roi_without_best": F.try_divide(F.col(f"back_{i}") - F.col(f"best_{i}"), F.col(f"bets_{i}"))} for i, (_, level, most) in enumerate(cells)])


def dutch_cases(df: DataFrame, part: str, ticket: str, p: str, odds: str, final: str, hit: str, lines: list[tuple[float, float | None]]) -> DataFrame:
    """Likeliest tickets while their composite odds stay at a line or above, staked so that each returns the same at the deciding quote.

    lines: (least composite, least value of the whole prefix or None). A stake of 1 a contest is paid at the final quote; `losing_hits` return less
    than it. Tickets without a quote are left out.
    """
    inverse = 1 / F.col(odds)
    run = df.where(F.col(odds) > 0).withColumn("__c", F.round(1 / F.sum(inverse).over(_from_best(part, p, ticket)), NEAR))
    cuts = sorted({line for line, _ in lines})
    own = {line: F.col("__c") >= line for line in cuts}
    per = run.groupBy(part).agg(*[c for k, line in enumerate(cuts) for c in (
        F.count_if(own[line]).alias(f"n_{k}"), F.sum(F.when(own[line], inverse)).alias(f"i_{k}"), F.sum(F.when(own[line], F.col(p))).alias(f"p_{k}"),
        F.coalesce(F.max(F.when(own[line] & F.col(hit), F.col(final) * inverse)), F.lit(0.0)).alias(f"b_{k}"))])
    sums = []
    for line, least in lines:
        k = cuts.index(line)
        made = F.col(f"n_{k}") > 0
        if least is not None:
            made = made & (F.round(F.col(f"p_{k}") / F.col(f"i_{k}"), NEAR) >= least)
        back = F.when(made, F.col(f"b_{k}") / F.col(f"i_{k}"))
        sums.append({"contests": F.count(back), "share": F.count(back) / F.count("*"), "tickets": F.avg(F.when(made, F.col(f"n_{k}"))), "composite": F.avg(F.when(made, 1 / F.col(f"i_{k}"))),
                     "hit_rate": F.avg(F.when(made, (F.col(f"b_{k}") > 0).cast("int"))), "roi": F.avg(back), "losing_hits": F.count_if((back > 0) & (F.round(back, NEAR) < 1))})
    return _unfold(_sums(per, sums), [{"line": F.lit(float(line)), "least_ev": F.lit(least).cast("double"), **{c: F.col(f"{c}_{k}") for c in sums[k]}} for k, (line, least) in enumerate(lines)])


def band_check(df: DataFrame, first: str, odds: str, hit: str, final: str, bands: list[tuple[float, float]], least: int, share: float) -> DataFrame:
    """Odds bands ranked by their return in the first part, with what they return in the second; rank 0 is all bets.

    A band needs `least` bets, and `share` of all, in the first part. Bets are summed once by the cells between the bands' edges.
    """
    edges = sorted({e for band in bands for e in band})
    cell = reduce(lambda a, b: a + b, [(F.col(odds) >= e).cast("int") for e in edges])
    cells = df.where(F.col(odds) > 0).groupBy(F.col(first).alias("__first"), cell.alias("__cell")).agg(
        F.count("*").alias("__n"), F.count_if(hit).alias("__h"), F.coalesce(F.sum(F.when(F.col(hit), F.col(final))), F.lit(0.0)).alias("__b"), F.coalesce(F.max(F.when(F.col(hit), F.col(final))), F.lit(0.0)).alias("__m"))
    span = [F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.lit(edges.index(lo) + 1).alias("a"), F.lit(edges.index(hi) + 1).alias("b")) for lo, hi in bands]
    span.append(F.struct(F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).alias("a"), F.lit(len(edges) + 1).alias("b")))
    rows = cells.select("*", F.inline(F.array(*span))).where("__cell >= a and __cell < b")
    at = lambda c, one, f=F.sum: F.coalesce(f(F.when(F.col("__first") == one, F.col(c))), F.lit(0))
    found = rows.groupBy("lo", "hi").agg(*[e for side, one in (("first", True), ("second", False)) for e in (
        at("__n", one).alias(f"{side}_bets"), at("__h", one).alias(f"{side}_hits"), F.try_divide(at("__b", one), at("__n", one)).alias(f"{side}_roi"),
        F.try_divide(at("__b", one) - at("__m", one, F.max), at("__n", one)).alias(f"{side}_roi_without_best"))])
    every = (F.col("lo") == 0) & (F.col("hi") == float("inf"))
    total = F.max(F.when(every, F.col("first_bets"))).over(Window.partitionBy(F.lit(0)))  # the bands are parameters: few rows
    enough = found.withColumn("__all", total).where(every | ((F.col("first_bets") >= least) & (F.col("first_bets") >= share * F.col("__all"))))
    place = F.row_number().over(Window.partitionBy(every).orderBy(F.desc(F.round("first_roi", NEAR)), "lo", "hi"))
    return enough.withColumn("rank", F.when(every, 0).otherwise(place)).drop("__all")


def flow_table(df: DataFrame, part: str, early: str, late: str, hit: str, up: float, down: float, edges: list[float]) -> DataFrame:
    """Entrants by their late implied share (`band`: the number of edges reached) and by how that share moved since the early quote: cases, implied and actual win rate.

    Contests count in which every entrant is quoted at both times.
    """
    w = Window.partitionBy(part)
    share = lambda q: (1 / F.col(q)) / F.sum(1 / F.col(q)).over(w)
    rows = _all_quoted(df, part, [early, late]).withColumns({"__a": share(early), "__b": share(late)})
    ratio = F.round(F.col("__b") / F.col("__a"), NEAR)
    move = F.when(ratio >= up, "up").when(ratio <= down, "down").otherwise("flat")
    band = reduce(lambda a, b: a + b, [(F.round("__b", NEAR) >= e).cast("int") for e in edges])
    return rows.groupBy(band.alias("band"), move.alias("move")).agg(F.count("*").alias("n"), F.avg("__b").alias("implied"), F.avg(F.col(hit).cast("int")).alias("actual"))


def slot_review(places: DataFrame, quoted: DataFrame, part: str, slot: str, market: str, finish: str, key: str) -> DataFrame:
    """Predicted, quoted and actual win rate and predicted and actual rate of the first three for each `key` (slot or position). places: as of `marginal_places`."""
    both = quoted.join(places.select(part, slot, F.col("win").alias("__w"), F.col("top3").alias("__t")), [part, slot])
    return both.groupBy(key).agg(F.count("*").alias("n"), F.avg("__w").alias("predicted"), F.avg(market).alias("quoted"), F.avg((F.col(finish) == 1).cast("int")).alias("actual"),
                                 F.avg("__t").alias("predicted_top3"), F.avg((F.col(finish) <= 3).cast("int")).alias("actual_top3"))


def index_review(contests: DataFrame, index: str, first: str, won: str, kinds: list[str], edges: list[int]) -> DataFrame:
    """Contests by bands of an index (`at`: the band's least), and what is left where lower ones are skipped, that by half (`first`).

    contests: one row each with `<kind>_bets`, `<kind>_hits` and `<kind>_back` for every way of betting. Bands are summed once; what is left is summed from them.
    """
    at = F.coalesce(*[F.when(F.col(index) >= e, e) for e in sorted(edges, reverse=True)])
    sums = [f"{k}_{c}" for k in kinds for c in ("bets", "hits", "back")]
    cells = contests.withColumn("at", at).where("at is not null").groupBy("at", F.col(first).alias("first")).agg(F.count("*").alias("contests"), F.sum(F.col(won).cast("int")).alias("won"), *[F.sum(c).alias(c) for c in sums])
    total = [F.sum(c).alias(c) for c in ("contests", "won", *sums)]
    bands = cells.groupBy("at").agg(*total).select(F.lit("band").alias("part"), "at", F.lit(None).cast("boolean").alias("first"), "contests", "won", *sums)
    left = cells.withColumnRenamed("at", "__at").select("*", F.explode(F.array(*[F.lit(e) for e in edges])).alias("at")).where("__at >= at").groupBy("at", "first").agg(*total)
    rows = bands.unionByName(left.select(F.lit("rest").alias("part"), "at", "first", "contests", "won", *sums))
    ways = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), *[F.col(f"{k}_{c}").alias(c) for c in ("bets", "hits", "back")]) for k in kinds]))
    return rows.select("part", "at", "first", "contests", (F.col("won") / F.col("contests")).alias("won_rate"), ways).withColumn("roi", F.try_divide("back", "bets")).drop("back")


def with_trend(df: DataFrame, keys: list[str], part: str, slot: str, p: str, won: str, size: int) -> DataFrame:
    """What each slot of the same meeting (`keys`) won above its probabilities in the contests before this one (`surprise`), and their number (`before`).

    Only contests with `size` entrants count. Contests of a meeting follow each other by `part`; a meeting is short by meaning.
    """
    full = df.withColumn("__n", F.count("*").over(Window.partitionBy(part))).where(F.col("__n") == size).drop("__n")
    w = Window.partitionBy(*keys, slot).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return full.withColumns({"before": F.count("*").over(w), "surprise": F.coalesce(F.sum(F.col(won).cast("int") - F.col(p)).over(w), F.lit(0.0))})


def trend_table(trended: DataFrame, first: str, p: str, won: str, least: int, edges: list[float]) -> DataFrame:
    """Expected and actual win rate by bands of the mean surprise before, by half, from contests with `least` before them."""
    mean = F.round(F.col("surprise") / F.col("before"), NEAR)
    band = reduce(lambda a, b: a + b, [(mean >= e).cast("int") for e in edges])
    return trended.where(F.col("before") >= least).groupBy(band.alias("band"), F.col(first).alias("first")).agg(F.count("*").alias("n"), F.avg(p).alias("expected"), F.avg(F.col(won).cast("int")).alias("actual"))


def trend_fit(trended: DataFrame, part: str, first: str, p: str, won: str, betas: list[float], strength: float) -> DataFrame:
    """Mean log-loss of the winner by half where probabilities are multiplied by exp(beta * surprise / (before + strength)); `best` has the least in the first half."""
    lift = lambda b: F.col(p) * F.exp(b * F.col("surprise") / (F.col("before") + strength))
    per = trended.groupBy(part, first).agg(*[c for k, b in enumerate(betas) for c in (F.sum(lift(b)).alias(f"s_{k}"), F.max(F.when(F.col(won), lift(b))).alias(f"w_{k}"))])
    loss = lambda k: -F.log(F.greatest(F.col(f"w_{k}") / F.col(f"s_{k}"), F.lit(1e-9)))
    won_only = per.where("w_0 is not null")
    found = _unfold(_sums(won_only, [{"first": F.avg(F.when(F.col(first), loss(k))), "second": F.avg(F.when(~F.col(first), loss(k)))} for k in range(len(betas))]),
                    [{"beta": F.lit(float(b)), "first_loss": F.col(f"first_{k}"), "second_loss": F.col(f"second_{k}")} for k, b in enumerate(betas)])
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("first_loss", NEAR), "beta"))  # one row a beta
    return found.withColumn("best", place == 1)


def cases(df: DataFrame, named: dict[str, Column], into: str = "case") -> DataFrame:
    """Every row once for each case whose condition it meets; a null condition is not met."""
    return df.withColumn(into, F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]), lambda x: x.isNotNull())))


def stacked(filters: dict[str, Column]) -> dict[str, Column]:
    """`all`, then each filter on top of the ones before it, named by the last."""
    out, so_far = {"all": F.lit(True)}, F.lit(True)
    for name, c in filters.items():
        so_far = so_far & F.coalesce(c, F.lit(False))
        out["+" + name] = so_far
    return out
