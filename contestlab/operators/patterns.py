"""Ticket templates, and studies of patterns, abilities and upsets."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compile_tickets(terms: str, size: int = 6) -> list[str]:
    """The ordered triples that a template stands for, in its order and once each: terms like `2-3-*` or `12-34-*`, parted by blanks.

    A place lists the positions that may take it; `*` is any position that the other places don't hold.
    """
    out: dict[str, None] = {}
    for term in terms.split():
        places = [set(range(1, size + 1)) if p == "*" else {int(c) for c in p} for p in term.split("-")]
        for triple in permutations(range(1, size + 1), len(places)):
            if all(x in p for x, p in zip(triple, places)):
                out["-".join(map(str, triple))] = None
    return list(out)


def pattern_study(contests: DataFrame, shapes: dict[str, tuple[str, Column]], by: list[str], result: str, payout: str, stake: float = 100.0) -> DataFrame:
    """For each shape (template, condition) and group: contests, tickets, hits, hit rate and return.

    A shape's tickets are the same in all its contests, so a hit is a look-up of the result in a constant set, and the shapes are sums of one aggregation,
    unpivoted afterwards. A contest without a result is left out. Shapes of one name are alternatives: their conditions should exclude each other.
    """
    known = contests.where(F.col(result).isNotNull())
    sums, rows = [], []
    for k, (name, (terms, condition)) in enumerate(shapes.items()):
        tickets = compile_tickets(terms)
        met = F.coalesce(condition, F.lit(False))
        hit = met & F.col(result).isin(tickets)
        sums += [F.count_if(met).alias(f"n{k}"), F.count_if(hit).alias(f"h{k}"), F.coalesce(F.sum(F.when(hit, F.col(payout))), F.lit(0.0)).alias(f"r{k}")]
        rows.append(F.struct(F.lit(name.split("/")[0]).alias("shape"), F.col(f"n{k}").alias("contests"), (F.col(f"n{k}") * len(tickets)).alias("tickets"), F.col(f"h{k}").alias("hits"), F.col(f"r{k}").alias("returned")))
    found = known.groupBy(*by).agg(*sums).select(*by, F.explode(F.array(*rows)).alias("e")).select(*by, "e.*")
    total = found.groupBy(*by, "shape").agg(*[F.sum(c).alias(c) for c in ("contests", "tickets", "hits", "returned")]).where(F.col("contests") > 0)
    return total.select(*by, "shape", "contests", "tickets", "hits", (F.col("hits") / F.col("contests")).alias("hit_rate"), (F.col("returned") / (stake * F.col("tickets"))).alias("roi"))


def outcome_by_position(df: DataFrame, by: list[str], slot: str, finish: str) -> DataFrame:
    """How often each position comes first, second, third or later in each group."""
    place = lambda c: F.count_if(c)
    out = df.where(F.col(finish).isNotNull()).groupBy(*by, slot).agg(F.count("*").alias("n"), *[place(F.col(finish) == k).alias(f"place{k}") for k in (1, 2, 3)], place(F.col(finish) > 3).alias("later"))
    return out.select(*by, slot, "n", *[(F.col(c) / F.col("n")).alias(c) for c in ("place1", "place2", "place3", "later")])


def ability_backtest(df: DataFrame, keys: list[str], day: str, cuts: list[str], hit: Column, expected: str, returned: Column, least: int, effect: float, z: float, stake: float = 100.0) -> DataFrame:
    """Abilities found before each of `cuts` (rising dates), tried on the days from that cut to the next: owners against the others.

    One row a cut and kind (`good`: over the expected rate by `effect` with `z`, `poor`: under it, `none`): rows, owners, rate, expected rate, return.
    All cuts share one aggregation: a key's sums by stretch, whose running totals over earlier stretches are what was known at each cut; no later day
    enters them.
    """
    stretch = F.lit(0)
    for c in cuts:
        stretch = stretch + (F.col(day) >= F.lit(c).cast("date")).cast("int")
    rows = df.select(*keys, stretch.alias("__s"), hit.cast("double").alias("__y"), F.col(expected).cast("double").alias("__e"), returned.cast("double").alias("__r"))
    sums = rows.groupBy(*keys, "__s").agg(F.count("*").alias("n"), F.sum("__y").alias("y"), F.sum("__e").alias("e"), F.sum(F.col("__e") * (1 - F.col("__e"))).alias("v"), F.sum("__r").alias("r"))
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    known = sums.select("*", *[F.sum(c).over(before).alias(f"__{c}") for c in "nyev"])
    gap = (F.col("__y") - F.col("__e")) / F.col("__n")
    sure = (F.col("__n") >= least) & (F.col("__v") > 0)
    score = (F.col("__y") - F.col("__e")) / F.sqrt("__v")
    kind = F.when(sure & (gap >= effect) & (score >= z), "good").when(sure & (gap <= -effect) & (score <= -z), "poor").otherwise("none")
    out = known.where("__s > 0").groupBy("__s", kind.alias("kind")).agg(F.count("*").alias("owners"), *[F.sum(c).alias(c) for c in "nyer"])
    return out.select(F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("__s")).alias("cut"), "kind", "owners", "n", (F.col("y") / F.col("n")).alias("rate"), (F.col("e") / F.col("n")).alias("expected"),
                      (F.col("r") / (stake * F.col("n"))).alias("roi"))


def session_best_rank(df: DataFrame, session: list[str], actor: str, day: str, value: str, contest: str, slot: str, out: str = "rank") -> DataFrame:
    """Each entrant's place in its contest by the actor's best (greatest) value on earlier days of the session; null without one. Ties share the better place."""
    daily = df.groupBy(*session, actor, day).agg(F.max(value).alias("__m"))
    w = Window.partitionBy(*session, actor).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    best = daily.select(*session, actor, day, F.max("__m").over(w).alias("__best"))
    found = df.join(best, [*session, actor, day])
    place = F.rank().over(Window.partitionBy(contest).orderBy(F.col("__best").desc_nulls_last()))
    return found.withColumn(out, F.when(F.col("__best").isNotNull(), place)).drop("__best")


def rank_ticket_study(df: DataFrame, rank: str, hit: Column, returned: Column, stake: float = 100.0) -> DataFrame:
    """One ticket on each rank: rows, hits, rate and return, the unknown rank by itself."""
    out = df.groupBy(F.col(rank).alias("rank")).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.sum(returned).alias("__r"))
    return out.select("rank", "n", "hits", (F.col("hits") / F.col("n")).alias("rate"), (F.col("__r") / (stake * F.col("n"))).alias("roi"))


def upset_study(contests: DataFrame, upset: Column, sections: dict[str, Column], least: int = 1) -> DataFrame:
    """For each section (a banded column of the contest) and band: contests, upsets, their rate, and how it stands to that of all."""
    rows = contests.select(upset.cast("int").alias("__u"), F.explode(F.array(*[F.struct(F.lit(k).alias("section"), c.cast("string").alias("band")) for k, c in sections.items()])).alias("e")).where("__u is not null")
    found = rows.groupBy("e.section", "e.band").agg(F.count("*").alias("n"), F.sum("__u").alias("upsets"))
    whole = found.groupBy("section").agg((F.sum("upsets") / F.sum("n")).alias("__all"))
    return found.join(F.broadcast(whole), "section").where(F.col("n") >= least).select("section", "band", "n", "upsets", (F.col("upsets") / F.col("n")).alias("rate"), (F.col("upsets") / F.col("n") / F.col("__all")).alias("lift"))
