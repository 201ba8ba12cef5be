"""Grouped statistics (A2 to A24): conditional sums in one pass, so that they combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.operators.asof import shrink


def serving_totals(df: DataFrame, keys: list[str], day: str, sums: dict[str, Column]) -> DataFrame:
    """A2: totals to the last day of each key, dated the day after it."""
    return df.groupBy(*keys).agg(F.date_add(F.max(day), 1).alias(day), *[F.sum(c).alias(k) for k, c in sums.items()])


def priors(df: DataFrame, site: str, pos: str, rates: dict[str, Column]) -> DataFrame:
    """A3: means for each position, and for each site and position (site null: all sites)."""
    sets = df.groupingSets([[pos], [site, pos]], F.col(site), F.col(pos))
    return sets.agg(F.grouping(site).alias("all_sites"), F.count("*").alias("n"), *[F.avg(c).alias(k) for k, c in rates.items()])


def profile(df: DataFrame, keys: list[str], scopes: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """A4: every sum in every scope, as `<scope>_<sum>`; one pass."""
    return df.groupBy(*keys).agg(*[F.sum(F.when(cond, c).otherwise(0)).alias(f"{s}_{k}") for s, cond in scopes.items() for k, c in sums.items()])


def residual_stats(df: DataFrame, keys: list[str], pos: str, value: str, flag: Column) -> DataFrame:
    """A5: mean deviation from the position's mean, under the flag and otherwise. The means are one row a position."""
    means = df.groupBy(pos).agg(F.avg(value).alias("__mean"))
    left = F.col(value) - F.col("__mean")
    return df.withColumn("__flag", flag).join(means, pos).groupBy(*keys).agg(
        F.count_if("__flag").alias("n_flag"), F.avg(F.when(F.col("__flag"), left)).alias("flag_mean"), F.avg(F.when(~F.col("__flag"), left)).alias("normal_mean"))


def contribution(df: DataFrame, prior: DataFrame, actor: str, day: str, equipment: str, points: str, p0: float, strength: float) -> DataFrame:
    """Points above what the actor's own earlier record promised, summed for each equipment. `prior` has (actor, day, n, points)."""
    known = prior.select(actor, day, F.col("n").alias("__n"), F.col("points").alias("__p"))
    promised = shrink(F.coalesce("__p", F.lit(0)), F.coalesce("__n", F.lit(0)), p0, strength)
    return df.join(known, [actor, day], "left").groupBy(equipment).agg(F.count("*").alias("n"), F.sum(F.col(points) - promised).alias("gain"))


def method_counts(df: DataFrame, keys: list[str], label: str, labels: list[str]) -> DataFrame:
    """How often each label occurs, a column a label, and all others."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(label) == x).alias("n_" + x.lower()) for x in labels], F.count_if(F.col(label).isNull() | ~F.col(label).isin(labels)).alias("n_other"))


def pattern_table(df: DataFrame, scope: str, pattern: str, hit: Column) -> DataFrame:
    """Cases and successes of each pattern for every scope and over all (scope null), ranked by rate within the scope."""
    found = df.groupingSets([[pattern], [scope, pattern]], F.col(scope), F.col(pattern)).agg(
        F.grouping(scope).alias("all_scopes"), F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    w = Window.partitionBy("all_scopes", scope).orderBy(F.desc(F.round(F.col("hits") / F.col("n"), 9)), pattern)
    return found.withColumn("rank", F.row_number().over(w))


def recent_rates(df: DataFrame, keys: list[str], day: str, end, days: int, rates: dict[str, Column]) -> DataFrame:
    """Means over the days in [end - days, end)."""
    return df.where(F.col(day).between(F.date_sub(F.lit(end), days), F.date_sub(F.lit(end), 1))).groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(k) for k, c in rates.items()])


def condition_table(df: DataFrame, keys: list[str], conditions: dict[str, Column], hit: Column, strength: float) -> DataFrame:
    """Base rate of each key, and the rate under each condition drawn towards it."""
    cond = [c for name, at in conditions.items() for c in (F.count_if(at).alias(f"{name}_n"), F.count_if(at & hit).alias(f"{name}_hits"))]
    base = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(hit.cast("int")).alias("base"), *cond)
    return base.withColumns({f"{name}_rate": shrink(F.col(f"{name}_hits"), F.col(f"{name}_n"), F.col("base"), strength) for name in conditions})


def band_table(df: DataFrame, band: Column, implied: str, hit: Column, returned: Column) -> DataFrame:
    """For each band cases, implied and actual rate, and return for a stake of 1."""
    return df.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(implied).alias("implied"), F.avg(hit.cast("int")).alias("actual"), F.avg(returned).alias("returned"))


def match_summary(df: DataFrame, group: str, matched: str) -> DataFrame:
    """Judged rows and share that matched for each group; no group is `unknown`, null in `matched` is not judged."""
    return df.groupBy(F.coalesce(F.nullif(F.trim(F.col(group).cast("string")), F.lit("")), F.lit("unknown")).alias("label")).agg(
        F.count("*").alias("n"), F.count(matched).alias("judged"), F.avg(F.col(matched).cast("int")).alias("match_rate"))


def leaderboard(df: DataFrame, key: str, hit: Column, least: int, most: int) -> DataFrame:
    """The `most` best keys by rate among those with at least `least` cases; ties by cases, then key."""
    found = df.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("int")), 9).alias("rate")).where(F.col("n") >= least)
    return found.orderBy(F.desc("rate"), F.desc("n"), key).limit(most)


def tendency(df: DataFrame, actor: str, rates: dict[str, Column], grades: list[tuple[int, str]]) -> DataFrame:
    """Rates of each actor and a grade by the number of cases: the first of `grades` that is reached, else `none`."""
    found = df.groupBy(actor).agg(F.count("*").alias("n"), *[F.avg(c.cast("int")).alias(k) for k, c in rates.items()])
    return found.withColumn("grade", F.coalesce(*[F.when(F.col("n") >= n, F.lit(g)) for n, g in grades], F.lit("none")))


def phrase_stats(df: DataFrame, phrases: str, finish: str) -> DataFrame:
    """Use, judged uses, mean finish and rates of win and top 2 for each phrase of an array column, once a row."""
    rows = df.select(F.explode(F.array_distinct(phrases)).alias("phrase"), F.col(finish).alias("__f"))
    return rows.groupBy("phrase").agg(F.count("*").alias("used"), F.count("__f").alias("judged"), F.avg("__f").alias("mean_finish"),
                                      F.avg((F.col("__f") == 1).cast("int")).alias("win_rate"), F.avg((F.col("__f") <= 2).cast("int")).alias("top2_rate"))


def batch_index(df: DataFrame, keys: list[str], done: Column, name: str) -> DataFrame:
    """Entries and finished entries of each saved batch, and its distinct names in order."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(done).alias("n_done"), F.array_join(F.sort_array(F.collect_set(name)), ",").alias("names"))


def uplift_grid(df: DataFrame, one: str, two: str, pos: str, hit: Column, least: int) -> DataFrame:
    """Mean of hit minus the position's mean in every cell of a cube of two conditions that has `least` cases (null: all)."""
    rows = df.withColumn("__h", hit.cast("double"))
    means = rows.groupBy(pos).agg(F.avg("__h").alias("__m"))
    cells = rows.join(means, pos).cube(one, two).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg(F.col("__h") - F.col("__m")).alias("uplift"))
    return cells.where(F.col("n") >= least)


def day_totals(df: DataFrame, period: Column, day: str, sums: dict[str, Column]) -> DataFrame:
    """Totals of each day, each period and all (nulls), by rollup."""
    rows = df.withColumn("period", period)
    return rows.rollup("period", day).agg(F.grouping_id().alias("level"), *[F.sum(c).alias(k) for k, c in sums.items()])


def readiness(df: DataFrame, cols: list[str], least: float) -> DataFrame:
    """Share of rows that have each column, and whether that is enough; one row a column, from one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in cols])
    long = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("filled")) for c in cols])).alias("e"))
    share = F.when(F.col("n") > 0, F.col("e.filled") / F.col("n")).otherwise(0.0)
    return long.select("e.name", "e.filled", share.alias("share"), F.when(share >= least, "ok").otherwise("collect").alias("action"))


def version_timing(df: DataFrame, keys: list[str], minutes: Column) -> DataFrame:
    """Minutes before the deadline of the first and last version, and the share of versions after it."""
    return df.withColumn("__m", minutes).groupBy(*keys).agg(F.count("*").alias("versions"), F.max("__m").alias("first_min"), F.min("__m").alias("last_min"), F.avg((F.col("__m") < 0).cast("int")).alias("late_share"))
