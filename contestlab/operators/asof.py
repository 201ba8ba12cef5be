"""Point-in-time statistics that never look ahead: windows and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def epoch_day(day: str):
    return F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("long")


def daily_sums(df: DataFrame, keys: list[str], day: str, sums: dict) -> DataFrame:
    """A1: one row for each key and day; `sums` names Columns to add up. Windows over days stay small after this."""
    return df.groupBy(*keys, day).agg(*[F.sum(c).alias(name) for name, c in sums.items()])


def prior_cumulative(daily: DataFrame, keys: list[str], day: str, cols: list[str], prefix: str = "prior_") -> DataFrame:
    """Sums over all earlier days of the key, the day itself left out; 0 if there are none."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return daily.withColumns({prefix + c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in cols})


def asof_stats(daily: DataFrame, keys: list[str], day: str, cols: list[str], days: int, prefix: str = "w_", next_day=None) -> DataFrame:
    """Sums over the days in (day - days, day), the day itself left out; `next_day` adds a row for that date to every key."""
    if next_day is not None:
        daily = daily.unionByName(daily.select(*keys).distinct().withColumn(day, F.lit(next_day).cast("date")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__day").rangeBetween(-(days - 1), -1)
    out = daily.withColumn("__day", epoch_day(day))
    return out.withColumns({prefix + c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in cols}).drop("__day")


def rolling_rate(daily: DataFrame, keys: list[str], day: str, hits: str, n: str, days: int = 365, into: str = "rate") -> DataFrame:
    """Rate over [day - days, day), one day wider than W2 at the far end."""
    w = Window.partitionBy(*keys).orderBy("__day").rangeBetween(-days, -1)
    return daily.withColumn("__day", epoch_day(day)).withColumn(into, F.sum(hits).over(w) / F.sum(n).over(w)).drop("__day")


def shrink(k, n, p0, strength: float):
    """smoothed rate (k + s * p0) / (n + s)."""
    return (k + strength * p0) / (n + strength)


def sessions(df: DataFrame, site: str, day: str, title: str) -> DataFrame:
    """Session number and day in session of each site's days; a new one starts where a day is skipped or the title changes."""
    w = Window.partitionBy(site).orderBy(day, title)
    new = F.coalesce((F.datediff(day, F.lag(day).over(w)) > 1) | (F.lag(title).over(w) != F.col(title)), F.lit(True))
    out = df.select(site, day, title).distinct().withColumn("__new", new.cast("int")).withColumn("session", F.sum("__new").over(w))
    return out.withColumn("day_no", F.row_number().over(Window.partitionBy(site, "session").orderBy(day))).drop("__new")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, cols: list[str], strict: bool = False, tolerance: int | None = None) -> DataFrame:
    """The newest right row with day <= the left row's (< if strict), not older than `tolerance` days.

    A union of both sides and one window by key: no range join, and one shuffle. Right rows must be unique in key and day.
    """
    tag = F.struct(F.col(on).alias("__at"), *cols)
    r = right.select(*by, on, F.lit(1 if strict else 0).alias("__side"), tag.alias("__r"))
    own = [c for c in left.columns if c not in (*by, on)]
    le = left.select(*by, on, F.lit(0 if strict else 1).alias("__side"), F.struct(*[F.col(c) for c in own], F.lit(True).alias("__left")).alias("__l"))
    both = le.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__l is not null")
    if tolerance is not None:
        found = found.withColumn("__r", F.when(F.datediff(on, F.col("__r.__at")) <= tolerance, F.col("__r")))
    return found.select(*by, on, *[F.col(f"__l.{c}").alias(c) for c in own], *[F.col(f"__r.{c}").alias(c) for c in cols], F.col("__r.__at").alias("matched_on"))


def current_version(df: DataFrame, keys: list[str], eff: str, at, cols: list[str], tie: str | None = None) -> DataFrame:
    """For each key the newest version in force on `at`; of several of one date that with the largest `tie`."""
    order = F.struct(eff, tie) if tie else F.col(eff)
    return df.where(F.col(eff) <= F.lit(at)).groupBy(*keys).agg(F.max(eff).alias(eff), *[F.max_by(c, order).alias(c) for c in cols])


def era(df: DataFrame, site: str, day: str, changes: DataFrame) -> DataFrame:
    """Number of the site's change dates up to the day; changes has one row a site with an array column `dates`."""
    return df.join(changes, site, "left").withColumn("era", F.coalesce(F.size(F.filter("dates", lambda d: d <= F.col(day))), F.lit(0))).drop("dates")
