"""Probability and quote algebra on ordered tuples (P1 to P15), top-k selection (T1, T2) and settlement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalise(df: DataFrame, part: str, p: str, least: float = 1e-6, into: str = "q") -> DataFrame:
    """Clip and divide by the contest's sum."""
    clipped = F.greatest(F.col(p), F.lit(least))
    return df.withColumn(into, clipped / F.sum(clipped).over(Window.partitionBy(part)))


def softmax_in(df: DataFrame, part: str, score: str, into: str = "q") -> DataFrame:
    """Softmax over the contest, the largest score taken off first."""
    w = Window.partitionBy(part)
    return df.withColumn("__e", F.exp(F.col(score) - F.max(score).over(w))).withColumn(into, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def ordered_triples(df: DataFrame, part: str, slot: str, p: str, decay: float = 1.0, second: str | None = None, third: str | None = None, mix: float = 1.0) -> DataFrame:
    """Plackett-Luce probabilities of all ordered triples, at most 120 for six entrants.

    One row a contest holds its entrants, which nested transforms expand, so there is no self-join. Strengths for the second and
    third place are p to the power of `decay`, or `second` and `third` mixed with it by `mix`.
    """
    cols = [F.col(slot).alias("s"), F.col(p).alias("a"), (F.col(second) * (1 - mix) + F.col(p) * mix if second else F.pow(p, F.lit(decay))).alias("b"),
            (F.col(third) * (1 - mix) + F.col(p) * mix if third else F.pow(p, F.lit(decay))).alias("c")]
    packed = df.groupBy(part).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("e"))
    tot = packed.select(part, "e", *[F.aggregate(F.col("e")[k], F.lit(0.0), lambda acc, x: acc + x).alias(f"t{k}") for k in "abc"])
    one = tot.select("*", F.explode("e").alias("x"))
    two = one.select("*", F.explode(F.filter("e", lambda y: y["s"] != F.col("x.s"))).alias("y"))
    three = two.select("*", F.explode(F.filter("e", lambda z: (z["s"] != F.col("x.s")) & (z["s"] != F.col("y.s")))).alias("z"))
    prob = F.col("x.a") / F.col("ta") * F.col("y.b") / (F.col("tb") - F.col("x.b")) * F.col("z.c") / (F.col("tc") - F.col("x.c") - F.col("y.c"))
    return three.select(part, F.col("x.s").alias("s1"), F.col("y.s").alias("s2"), F.col("z.s").alias("s3"), F.concat_ws("-", "x.s", "y.s", "z.s").alias("ticket"), prob.alias("prob"))


def marginal_pairs(triples: DataFrame, part: str, ordered: bool = True) -> DataFrame:
    """Probabilities of the first two, in order or not."""
    a, b = (F.col("s1"), F.col("s2")) if ordered else (F.least("s1", "s2"), F.greatest("s1", "s2"))
    return triples.groupBy(part, F.concat_ws("-", a, b).alias("ticket")).agg(F.sum("prob").alias("prob"))


def marginal_places(triples: DataFrame, part: str) -> DataFrame:
    """Each slot's chance to win, to be in the first two and in the first three."""
    places = F.explode(F.array(*[F.struct(F.col(f"s{k}").alias("slot"), F.lit(k).alias("place")) for k in (1, 2, 3)])).alias("e")
    return triples.select(part, "prob", places).groupBy(part, F.col("e.slot").alias("slot")).agg(
        *[F.sum(F.when(F.col("e.place") <= k, F.col("prob")).otherwise(0.0)).alias(n) for k, n in ((1, "win"), (2, "top2"), (3, "top3"))])


def implied(df: DataFrame, part: str, odds: str, into: str = "market") -> DataFrame:
    """Inverse odds divided by their sum; a missing quote takes the contest's smallest inverse."""
    w = Window.partitionBy(part)
    inverse = F.when(F.col(odds) > 0, 1 / F.col(odds))
    return df.withColumn("__i", inverse).withColumn("__i", F.coalesce("__i", F.min("__i").over(w))).withColumn(into, F.col("__i") / F.sum("__i").over(w)).drop("__i")


def pool(df: DataFrame, part: str, p: str, market: str, a: float, b: float, into: str = "pooled", move: str | None = None, c: float = 0.0) -> DataFrame:
    """Log-linear pool p^a * market^b (* move^c, where no movement is known that factor is 1), divided by its sum."""
    log = lambda x: F.log(F.greatest(F.col(x), F.lit(1e-9)))
    power = a * log(p) + b * log(market)
    if move:
        power = power + F.coalesce(c * log(move), F.lit(0.0))
    return df.withColumn("__r", F.exp(power)).withColumn(into, F.col("__r") / F.sum("__r").over(Window.partitionBy(part))).drop("__r")


def triple_scores(triples: DataFrame, results: DataFrame, part: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Contests, mean log-loss of the triple that came, and how often it was among the first k by probability (ties by ticket). results: (part, result)."""
    place = F.row_number().over(Window.partitionBy(part).orderBy(F.desc(F.round("prob", 9)), "ticket"))
    came = triples.withColumn("__k", place).join(results.select(part, "result"), part).where("ticket = result")
    return came.agg(F.count("*").alias("contests"), F.avg(-F.log(F.greatest("prob", F.lit(1e-9)))).alias("triple_log_loss"), *[F.avg((F.col("__k") <= k).cast("int")).alias(f"top_{k}") for k in ks])


def composite(df: DataFrame, part: str, rank: str, odds: str, least: float) -> DataFrame:
    """The prefix of ranked tickets whose composite odds 1 / sum(1 / odds) stay at `least` or above, with dutch weights.

    Tickets without odds are skipped; the cut is at the first breach.
    """
    w = Window.partitionBy(part).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    run = df.where(F.col(odds) > 0).withColumn("composite", 1 / F.sum(1 / F.col(odds)).over(w))
    run = run.withColumn("__bad", F.max((F.col("composite") < least).cast("int")).over(w)).where("__bad = 0").drop("__bad")
    return run.withColumn("weight", (1 / F.col(odds)) / F.sum(1 / F.col(odds)).over(Window.partitionBy(part)))


def top_k(df: DataFrame, part: list[str], order: list, k: int, into: str = "rank") -> DataFrame:
    """The first k rows of each part."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col(into) <= k)


def pick_value(df: DataFrame, part: str, p: str, odds: str, ticket: str, least_ev: float, least_p: float, k: int, lo: float, hi: float) -> DataFrame:
    """Tickets of enough expected value, the best k of them, and of those the ones in the odds band (after the cut)."""
    good = df.withColumn("ev", F.col(p) * F.col(odds)).where((F.col("ev") >= least_ev) & (F.col(p) >= least_p))
    return top_k(good, [part], [F.desc(F.round("ev", 9)), F.asc(ticket)], k).where((F.col(odds) >= lo) & (F.col(odds) < hi))


def settle(tickets: DataFrame, results: DataFrame, part: str, ticket: str = "ticket", stake: float = 100.0) -> DataFrame:
    """Hit, stake and return of each ticket; contests without a result have null hits. results: (part, result, payout)."""
    joined = tickets.join(results, part, "left")
    hit = F.when(F.col("result").isNotNull(), F.col(ticket) == F.col("result"))
    return joined.withColumns({"hit": hit, "stake": F.lit(stake), "returned": F.when(hit, F.col("payout") * stake / 100).when(hit.isNotNull(), 0.0)})


def roi(df: DataFrame, by: list[str]) -> DataFrame:
    """Bets, hits, return on stake, and the same without the largest payout."""
    return df.groupBy(*by).agg(F.count("*").alias("bets"), F.sum(F.col("hit").cast("int")).alias("hits"), (F.sum("returned") / F.sum("stake")).alias("roi"),
                               ((F.sum("returned") - F.max("returned")) / F.sum("stake")).alias("roi_without_best"))
