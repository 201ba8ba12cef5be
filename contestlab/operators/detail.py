"""Figures beside the plain tables: what followed a pattern, conditional second places, gains of calibration, runs compared by outcome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.operators.asof import asof_join, shrink
from contestlab.operators.evaluate import unit_random


def pattern_detail(df: DataFrame, scope: str, category: str, pattern: str, places: tuple[str, str, str], head: int = 1) -> DataFrame:
    """How often each outcome followed a pattern, for every scope and over all of them (`all_scopes`), with its share of the pattern's cases.

    Where `head` won: `second` and `triple`; where another won: `head` and `pair`. Outcomes with an unknown place don't count. Each contest gives at
    most two outcomes, which combine before the shuffle.
    """
    a, b, c = (F.col(x).cast("string") for x in places)
    own = F.col(places[0]) == head
    kinds = [("second", own, b), ("triple", own, F.concat(a, F.lit("-"), b, F.lit("-"), c)), ("head", ~own, a), ("pair", ~own, F.concat(a, F.lit("-"), b))]
    found = F.array(*[F.when(at & v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("value"))) for k, at, v in kinds], F.struct(F.lit("all").alias("kind"), F.lit("").alias("value")))
    rows = df.where(F.col(places[0]).isNotNull()).select(scope, category, pattern, F.explode(F.array_compact(found)).alias("e")).select(scope, category, pattern, "e.*")
    counts = rows.groupingSets([[category, pattern, "kind", "value"], [scope, category, pattern, "kind", "value"]], scope, category, pattern, "kind", "value").agg(
        F.grouping(scope).alias("all_scopes"), F.count("*").alias("n"))
    total = F.max(F.when(F.col("kind") == "all", F.col("n"))).over(Window.partitionBy("all_scopes", scope, category, pattern))
    return counts.withColumn("share", F.col("n") / total).where("kind <> 'all'")


def second_shares(df: DataFrame, keys: list[str], condition: str, second: str, strength: float, least: int) -> DataFrame:
    """Who comes second, by condition, each share drawn towards that of all conditions; conditions with `least` cases of the key.

    df: the contests that the first position won. Seconds that never came under a condition have a row too, as their share isn't zero.
    """
    cells = df.where(F.col(second).isNotNull() & F.col(condition).isNotNull()).groupBy(*keys, condition, second).agg(F.count("*").alias("n"))
    base = cells.groupBy(*keys, second).agg(F.sum("n").alias("__b"))
    base = base.withColumn("base", F.col("__b") / F.sum("__b").over(Window.partitionBy(*keys))).drop("__b")
    cases = cells.groupBy(*keys, condition).agg(F.sum("n").alias("cases")).where(F.col("cases") >= least)
    full = cases.join(base, keys).join(cells, [*keys, condition, second], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return full.withColumn("share", shrink(F.col("n"), F.col("cases"), F.col("base"), strength))


def mix_second(triples: DataFrame, shares: DataFrame, part: str, head: str, weight: float, least: float = 0.001) -> DataFrame:
    """P10: triples whose first is `head` with the second place drawn towards given shares, by a geometric mean; the chance of each first stays the same.

    shares: one row a (part, s2) with `share`, at least `least`. Contests without shares, and other firsts, stay as they are.
    """
    own = F.col("s1") == F.lit(head)
    w, pair = Window.partitionBy(part, "__own"), Window.partitionBy(part, "__own", "s2")
    rows = triples.withColumn("__own", own).join(shares.select(part, "s2", F.greatest("share", F.lit(least)).alias("__t")), [part, "s2"], "left")
    rows = rows.withColumns({"__c": F.sum("prob").over(pair) / F.sum("prob").over(w), "__k": F.row_number().over(pair.orderBy("s3"))})
    # a second place is summed once, at its first triple
    once = F.col("__k") == 1
    target = F.col("__t") / F.sum(F.when(once, F.col("__t"))).over(w)
    rows = rows.withColumn("__m", F.pow(F.col("__c"), 1 - weight) * F.pow(target, F.lit(weight)))
    scaled = F.col("prob") * (F.col("__m") / F.sum(F.when(once, F.col("__m"))).over(w)) / F.col("__c")
    known = F.bool_and(F.col("__t").isNotNull()).over(w)
    return rows.withColumn("prob", F.when(F.col("__own") & known & (F.col("__c") > 0), scaled).otherwise(F.col("prob"))).drop("__own", "__t", "__c", "__k", "__m")


def calibration_gains(df: DataFrame, part: str, pos: str, entrant: dict[str, Column], contest: dict[str, Column], p: str, hit: str, least: int) -> DataFrame:
    """Expected and actual rate, z, and about how much log-loss a contest would gain from mending each cell: (actual - expected)^2 / (2 variance) by contests.

    Conditions that all entrants of a contest share (`contest`) are judged at position 1 alone, since a contest's probabilities sum to one.
    """
    one = lambda c: F.when(F.col(pos) == 1, c.cast("string"))
    named = [*[(k, c.cast("string")) for k, c in entrant.items()], *[(k, one(c)) for k, c in contest.items()]]
    cells = F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("condition"), c.alias("value"))) for k, c in named])
    rows = df.select(F.col(p).alias("__p"), F.col(hit).cast("double").alias("__y"), F.explode(F.array_compact(cells)).alias("c"))
    out = rows.groupBy("c.condition", "c.value").agg(F.count("*").alias("n"), F.avg("__p").alias("expected"), F.avg("__y").alias("actual"), F.sum(F.col("__p") * (1 - F.col("__p"))).alias("__v"), F.sum(F.col("__y") - F.col("__p")).alias("__d"))
    contests = df.agg(F.count_distinct(part).alias("__n"))  # one row
    out = out.where((F.col("n") >= least) & (F.col("__v") > 0)).join(contests)
    return out.withColumns({"z": F.col("__d") / F.sqrt("__v"), "gain": F.col("__d") ** 2 / (2 * F.col("__v")) / F.greatest("__n", F.lit(1))}).drop("__v", "__d", "__n")


def runs_by_outcome(live: DataFrame, test: DataFrame, skipped: DataFrame, part: str, ticket: str) -> DataFrame:
    """Contests in which the back-test bets, by what the live run did: `same` tickets, `other` ones, `skipped` (listed there), or `none` (never seen). live, test: hit, stake, returned.

    Counts, hits and both returns on stake; null where nothing was staked.
    """
    side = lambda df, n: df.groupBy(part).agg(F.sort_array(F.collect_set(F.col(ticket).cast("string"))).alias(f"__{n}"), F.count_if("hit").alias(f"{n}_hits"), F.sum("stake").alias(f"{n}_stake"), F.sum("returned").alias(f"{n}_back"))
    both = side(test, "test").join(side(live, "live"), part, "left").join(skipped.select(part).distinct().withColumn("__s", F.lit(True)), part, "left")
    kind = F.when(F.col("__live") == F.col("__test"), "same").when(F.col("__live").isNotNull(), "other").when(F.col("__s"), "skipped").otherwise("none")
    rate = lambda n: F.try_divide(F.sum(f"{n}_back"), F.sum(f"{n}_stake")).alias(f"{n}_roi")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("contests"), F.sum("test_hits").alias("test_hits"), F.coalesce(F.sum("live_hits"), F.lit(0)).alias("live_hits"), rate("test"), rate("live"))


def common_bands(methods: dict[str, DataFrame], own: list[str], results: DataFrame, part: str, ticket: str, band: Column) -> DataFrame:
    """Each other method against all own ones on the contests that it and they cover: contests and each method's hits by band of the payout.

    results: (part, result, payout), one row a contest.
    """
    marks = reduce(DataFrame.unionByName, [df.select(part, F.col(ticket).cast("string").alias("__t"), F.lit(name).alias("__m")) for name, df in methods.items()])
    got = marks.join(results.select(part, F.col("result").cast("string").alias("__r"), band.alias("band")), part).groupBy(part, "band").agg(
        *[F.count_if(F.col("__m") == m).alias(f"__n{k}") for k, m in enumerate(methods)], *[F.count_if((F.col("__m") == m) & (F.col("__t") == F.col("__r"))).alias(f"__h{k}") for k, m in enumerate(methods)])
    at = {m: k for k, m in enumerate(methods)}
    covers = lambda m: F.col(f"__n{at[m]}") > 0
    pairs = []
    for other in [m for m in methods if m not in own]:
        every = reduce(lambda a, b: a & b, [covers(m) for m in (other, *own)])
        pairs += [F.when(every, F.struct(F.lit(other).alias("against"), F.lit(m).alias("method"), (F.col(f"__h{at[m]}") > 0).cast("long").alias("hit"))) for m in (other, *own)]
    return got.select("band", F.explode(F.array_compact(F.array(*pairs))).alias("e")).groupBy("e.against", "band", "e.method").agg(F.count("*").alias("contests"), F.sum("e.hit").alias("hits"))


def limits_by(df: DataFrame, by: list[str], unit: str, num: str, den: str, reps: int = 200, least: int = 30) -> DataFrame:
    """Q4: for each group the ratio of sums and its 95 percent limits over `reps` resamples of its units; no limits (null) under `least` units.

    Poisson weights drawn from md5(unit:rep), as in E7: the units of a group are added up where they are, and a group sends `reps` sums.
    """
    units = df.groupBy(*by, unit).agg(F.sum(num).alias("__num"), F.sum(den).alias("__den"))
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    drawn = units.withColumn("__rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("__u", unit_random(F.col(unit), F.col("__rep")))
    weight = reduce(lambda a, b: a + b, [(F.col("__u") >= c).cast("int") for c in cuts])
    sums = drawn.groupBy(*by, "__rep").agg(F.count("*").alias("__n"), F.sum("__num").alias("__a"), F.sum("__den").alias("__b"), F.sum(weight * F.col("__num")).alias("__x"), F.sum(weight * F.col("__den")).alias("__y"))
    out = sums.groupBy(*by).agg(F.max("__n").alias("units"), F.max_by(F.try_divide("__a", "__b"), "__rep").alias("ratio"), F.percentile(F.try_divide("__x", "__y"), F.array(F.lit(0.025), F.lit(0.975))).alias("__q"))
    enough = F.col("units") >= least
    return out.select(*by, "units", "ratio", *[F.when(enough, F.get("__q", F.lit(k))).alias(c) for k, c in enumerate(("low", "high"))])


def attribution(df: DataFrame, ability: DataFrame, actor: str, day: str, start: str, site: str, equipment: str, pos: str, points: str, top: Column, least: int) -> DataFrame:
    """By equipment the points above the actor's own mean before the session began (`gain` of `judged` runs) and the mean of `top` less its position's mean (`residual`).

    ability: (actor, day, n, points) before each day on which the actor ran, unique in both; the newest day up to the session's start counts. Runs of
    actors with fewer than `least` earlier ones aren't judged.
    """
    before = ability.select(actor, F.col(day).alias("__at"), F.struct("n", "points").alias("__s"))
    rows = asof_join(df.withColumn("__at", F.col(start)), before, [actor], "__at", ["__s"])
    mean = F.when(F.col("__s.n") >= least, F.col("__s.points") / F.col("__s.n"))
    level = df.groupBy(pos).agg(F.avg(top.cast("double")).alias("__level"))  # one row a position
    rows = rows.withColumns({"__gain": F.col(points) - mean, "__top": top.cast("double")}).join(level, pos)
    return rows.groupBy(site, equipment).agg(F.count("*").alias("n"), F.count("__gain").alias("judged"), F.sum("__gain").alias("gain"), F.avg(F.col("__top") - F.col("__level")).alias("residual"))
