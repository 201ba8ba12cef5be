"""Habits, sessions, trends and quote movement over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.operators.asof import shrink


def prior_mean(daily: DataFrame, keys: list[str], day: str, total: str, n: str, p0: float, strength: float, least: int, into: str = "prior") -> DataFrame:
    """Smoothed mean of all earlier days; null below `least` earlier cases. `daily` has one row a key and day."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    k, cases = F.coalesce(F.sum(total).over(w), F.lit(0)), F.coalesce(F.sum(n).over(w), F.lit(0))
    return daily.withColumn(into, F.when(cases >= least, shrink(k, cases, p0, strength)))


def habit_deviation(df: DataFrame, prior: DataFrame, keys: list[str], day: str, part: str, value: str) -> DataFrame:
    """today's value minus the actor's own habit, then minus the contest's mean of that. `prior` has (keys, day, prior)."""
    own = df.join(prior.select(*keys, day, "prior"), [*keys, day], "left").withColumn("deviation", F.col(value) - F.col("prior"))
    return own.withColumn("relative", F.col("deviation") - F.avg("deviation").over(Window.partitionBy(part)))


def session_running(df: DataFrame, session: list[str], actor: str, day: str, best: str, points: str, parts: int | None = None) -> DataFrame:
    """Each actor's best value, points and starts earlier in the session, and the rank of the best among the day's actors.

    The result has a row for every actor of a session on every day of it; the day itself is left out. A session is a few days: it
    is dealt to one of `parts` as a whole, once. What is known changes on an actor's own days only, so it is summed over these, and each
    is then repeated for the session's days up to the actor's next one.
    """
    rows = df.where(" and ".join(f"`{c}` is not null" for c in session)).select(*session, actor, day, F.col(best).alias("__b"), F.col(points).alias("__p"))
    rows = rows.repartition(parts, *session) if parts else rows.repartition(*session)
    known = F.col(actor).isNotNull() & F.col(day).isNotNull()
    daily = rows.groupBy(*session, actor, day).agg(F.min(F.when(known, F.col("__b"))).alias("__b"), F.sum(F.when(known, F.col("__p"))).alias("__p"), F.count(F.when(known, 1)).alias("__n"))
    own = Window.partitionBy(*session, actor).orderBy(day)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    run = daily.select(*session, actor, F.col(day).alias("__own"), F.min("__b").over(upto).alias("__b"), F.sum("__p").over(upto).alias("__p"), F.sum("__n").over(upto).alias("__n"),
                       F.lead(day).over(own).alias("__next"), F.row_number().over(own).alias("__k"))
    run = run.withColumn("__days", F.sort_array(F.collect_set("__own").over(Window.partitionBy(*session))))
    at = lambda c: F.array_position("__days", F.col(c)).cast("int")
    run = run.withColumn("__from", F.when(F.col("__k") == 1, 0).otherwise(at("__own"))).withColumn("__to", F.coalesce(at("__next"), F.size("__days")))
    run = run.select(*session, actor, "__own", "__b", "__p", "__n", F.explode(F.slice("__days", F.col("__from") + 1, F.col("__to") - F.col("__from"))).alias(day))
    # an actor's first row stands for the days up to it, too
    later = F.col(day) > F.col("__own")
    run = run.select(*session, actor, day, F.when(later, F.col("__b")).alias("best"), F.coalesce(F.when(later, F.col("__p")), F.lit(0)).alias("points"), F.coalesce(F.when(later, F.col("__n")), F.lit(0)).alias("starts"))
    rank = F.rank().over(Window.partitionBy(*session, day).orderBy(F.asc_nulls_last("best")))
    return run.withColumn("best_rank", F.when(F.col("best").isNotNull(), rank))


def day_trend(df: DataFrame, keys: list[str], order: list[str], actual: Column, expected: str) -> DataFrame:
    """Sum of actual minus expected over the earlier contests of the same day, and how many they are."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__d", actual - F.col(expected))
    return rows.withColumn("n_before", F.count("*").over(w)).withColumn("trend", F.coalesce(F.sum("__d").over(w), F.lit(0.0))).drop("__d")


def quote_moves(quotes: DataFrame, keys: list[str], label: str, odds: str, early: str, late: str) -> DataFrame:
    """Quote under the late label over that under the early one, where both are positive."""
    at = lambda x: F.max(F.when((F.col(label) == x) & (F.col(odds) > 0), F.col(odds)))
    return quotes.where(F.col(label).isin(early, late)).groupBy(*keys).agg(at(early).alias("early"), at(late).alias("late")).where("early is not null and late is not null").withColumn("ratio", F.col("late") / F.col("early"))


def detect_resets(daily: DataFrame, site: str, day: str, n: str, share: str, high: float, low: float, least: int, apart: int) -> DataFrame:
    """Days on which the share jumps from below `low` to at least `high`, with `least` cases, `apart` days after the last such day.

    Only the candidate days of a site are gathered; the rule on their distance runs over that short array.
    """
    before = F.lag(share).over(Window.partitionBy(site).orderBy(day))
    found = daily.withColumn("__b", before).where((F.col(share) >= high) & (F.col("__b") < low) & (F.col(n) >= least))
    empty = F.lit(None).cast("array<date>")
    keep = F.aggregate(F.sort_array(F.collect_set(day)), F.coalesce(empty, F.array().cast("array<date>")),
                       lambda kept, x: F.when((F.size(kept) == 0) | (F.datediff(x, F.try_element_at(kept, F.lit(-1))) >= apart), F.array_append(kept, x)).otherwise(kept))
    return found.groupBy(site).agg(keep.alias("__days")).select(site, F.explode("__days").alias(day))


def snap_at(quotes: DataFrame, keys: list[str], minutes: str, least: float, cols: list[str], tie: str) -> DataFrame:
    """The last quote at least `least` minutes before the deadline; of equal minutes the greatest `tie`."""
    return quotes.where(F.col(minutes) >= least).groupBy(*keys).agg(F.max_by(F.struct(minutes, *cols), F.struct(-F.col(minutes), F.col(tie))).alias("__q")).select(*keys, "__q.*")


def daily_cumulative(df: DataFrame, by: list[str], day: str, stake: str, returned: str) -> DataFrame:
    """Return of each day and up to it."""
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    daily = df.groupBy(*by, day).agg(F.sum(stake).alias("stake"), F.sum(returned).alias("returned"))
    return daily.withColumn("day_roi", F.col("returned") / F.col("stake")).withColumn("roi", F.sum("returned").over(w) / F.sum("stake").over(w))
