"""Statistical evaluation at scale (E1 to E19, A10, A23) and money curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import draws, pools, ranks


def unit_random(*key: Column) -> Column:
    """A reproducible uniform number in [0, 1) from the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def log_loss(df: DataFrame, by: list[str], p: str, hit: str) -> DataFrame:
    """Mean negative log of the winner's probability and the favourite's hit rate."""
    fav = df.groupBy(*by, "contest").agg(F.sum(F.when(F.col(hit), -F.log(F.greatest(F.col(p), F.lit(1e-9))))).alias("loss"), F.max_by(F.col(hit).cast("int"), F.struct(F.col(p), -F.col("slot"))).alias("fav"))
    return fav.groupBy(*by).agg(F.count("*").alias("contests"), F.avg("loss").alias("log_loss"), F.avg("fav").alias("favourite_hit"))


def fit_pool(df: DataFrame, grid: DataFrame, part: str, p: str, market: str, hit: str) -> DataFrame:
    """Mean log-loss of p^a * market^b for every grid cell (a, b).

    The grid is a constant list of cells (hundreds), which goes to the tasks with the function. A contest's entrants meet in one row, as
    they are few by meaning; a task takes all cells of its contests at once and gives out one row a cell.
    """
    cells = [(float(r.a), float(r.b)) for r in grid.select("a", "b").collect()]
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-9)))
    contests = df.groupBy(part).agg(F.collect_list(F.struct(log(p).alias("lp"), log(market).alias("lm"), F.col(hit).alias("hit"))).alias("rows")).select("rows")
    sums = contests.mapInArrow(pools.cell_losses(cells), "a double, b double, loss double, n long")
    return sums.groupBy("a", "b").agg((F.sum("loss") / F.nullif(F.sum("n"), F.lit(0))).alias("log_loss"))


def fit_and_apply_pool(df: DataFrame, grid: DataFrame, part: str, p: str, market: str, hit: str, second: str) -> DataFrame:
    """The cell of least mean log-loss over the rows where `second` is false (of equals the smallest a, then b), applied to the others.

    One row: a, b, first_loss, second_loss; no row if the first half has none.
    """
    best = fit_pool(df.where(~F.col(second)), grid, part, p, market, hit).agg(F.min(F.struct("log_loss", "a", "b")).alias("m")).where("m is not null").select("m.a", "m.b", F.col("m.log_loss").alias("first_loss"))
    applied = fit_pool(df.where(F.col(second)), best.select("a", "b"), part, p, market, hit)
    return best.join(applied.select(F.col("log_loss").alias("second_loss")), how="left")


def bootstrap_ratio(df: DataFrame, unit: str, num: str, den: str, reps: int) -> DataFrame:
    """`reps` replicates of sum(num) / sum(den) with Poisson(1) weights per unit, drawn from md5(unit:rep).

    Weights of resampled units are independent, so each replicate is a partial sum; the limits are those of resampling n units.
    A task draws all replicates of its units in Arrow batches and gives out one row a replicate. Rows are dealt over all cores, as
    the draws and not the rows take the time.
    """
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.coalesce(F.concat(F.col(unit).cast("string"), F.lit(":")), F.lit("")).cast("binary").alias("head"), F.col(num).cast("double").alias("num"), F.col(den).cast("double").alias("den"))
    drawn = rows.repartition(parts).mapInArrow(draws.weighted_sums(reps), "rep int, num double, den double, nums long, dens long")
    total = lambda x: F.when(F.sum(f"{x}s") > 0, F.sum(x))
    return drawn.groupBy("rep").agg((total("num") / total("den")).alias("ratio"))


def bootstrap_limits(df: DataFrame, unit: str, num: str, den: str, reps: int = 1000) -> DataFrame:
    """One row: the ratio, its 5, 95, 2.5 and 97.5 percent limits over `reps` replicates, and the share of these over 1."""
    drawn = bootstrap_ratio(df, unit, num, den, reps).agg(
        F.percentile("ratio", F.array(*[F.lit(x) for x in (0.05, 0.95, 0.025, 0.975)])).alias("q"), F.avg((F.col("ratio") > 1).cast("double")).alias("p_over_1"))
    return df.agg((F.sum(num) / F.sum(den)).alias("ratio")).join(drawn).select(
        "ratio", *[F.get("q", F.lit(k)).alias(c) for k, c in enumerate(("low_5", "high_95", "low_2_5", "high_97_5"))], "p_over_1")


def holm(df: DataFrame, p: str, name: str) -> DataFrame:
    """Holm-adjusted p-values; one row a hypothesis, ranked by range."""
    found, n = ranks.before_sum(ranks.place(df.withColumn("__one", F.lit(1)), p, name), "__one", "__k")
    raw = found.withColumn("__raw", F.least((F.lit(n) - F.col("__k")) * F.col(p), F.lit(1.0)))
    return ranks.upto_max(raw, "__raw", "p_holm").select(*df.columns, "p_holm")


def calibration_cells(df: DataFrame, conditions: dict[str, Column], p: str, hit: str, least: int) -> DataFrame:
    """Expected and actual rate and z for each value of each condition."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), c.cast("string").alias("value")) for k, c in conditions.items()])).alias("c")
    out = df.select(F.col(p).alias("p"), F.col(hit).cast("double").alias("y"), cells).groupBy("c.condition", "c.value").agg(
        F.count("*").alias("n"), F.avg("p").alias("expected"), F.avg("y").alias("actual"), F.sum(F.col("p") * (1 - F.col("p"))).alias("__v"), F.sum(F.col("y") - F.col("p")).alias("__d")).where(F.col("n") >= least)
    return out.withColumn("z", F.when(F.col("__v") > 0, F.col("__d") / F.sqrt("__v"))).drop("__v", "__d")


def auc_rank(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve from rank sums; ties count half. One row a distinct score is ranked, by range."""
    by = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(label).cast("int")).alias("pos"), F.count("*").alias("n"))
    found, _ = ranks.before_sum(ranks.place(by, score), "n", "__below")
    r = found.withColumn("rank", F.col("__below") + (F.col("n") + 1) / 2)
    return r.agg(F.sum("pos").alias("positives"), (F.sum("n") - F.sum("pos")).alias("negatives"), F.sum(F.col("rank") * F.col("pos")).alias("s")).select(
        "positives", "negatives", ((F.col("s") - F.col("positives") * (F.col("positives") + 1) / 2) / (F.col("positives") * F.col("negatives"))).alias("auc"))


def adaptive_bins(df: DataFrame, by: str, value: str, least: int) -> DataFrame:
    """A10: cut a small-range integer from below so that each bin has `least` rows; the last bin stays open. From counts by value."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("n")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct(value, "n"))).alias("c"))
    start = F.struct(F.expr("cast(array() as array<struct<lo:bigint,n:bigint>>)").alias("bins"), F.lit(None).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("n"))
    folded = F.aggregate("c", start, lambda acc, x: F.when(
        acc["n"] + x["n"] >= least,
        F.struct(F.concat(acc["bins"], F.array(F.struct(F.coalesce(acc["lo"], x[value].cast("bigint")).alias("lo"), (acc["n"] + x["n"]).alias("n")))).alias("bins"), F.lit(None).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("n")),
    ).otherwise(F.struct(acc["bins"].alias("bins"), F.coalesce(acc["lo"], x[value].cast("bigint")).alias("lo"), (acc["n"] + x["n"]).alias("n"))))
    made = counts.select(by, folded.alias("f")).select(by, F.when(F.col("f.n") > 0, F.concat("f.bins", F.array(F.struct(F.col("f.lo").alias("lo"), F.col("f.n").alias("n"))))).otherwise(F.col("f.bins")).alias("bins"))
    return made.select(by, F.posexplode("bins").alias("bin", "e")).select(by, "bin", F.col("e.lo").alias("lo"), F.col("e.n").alias("n"))


def equity_curve(daily: DataFrame, by: list[str], day: str, stake: str, returned: str) -> DataFrame:
    """Profit, running total, running high, drawdown and low-water mark by day; pre-aggregated days only."""
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("profit", F.col(returned) - F.col(stake)).withColumn("total", F.sum("profit").over(w))
    return out.withColumn("high", F.greatest(F.max("total").over(w), F.lit(0.0))).withColumn("drawdown", F.col("high") - F.col("total")).withColumn("low", F.least(F.min("total").over(w), F.lit(0.0)))


def martingale(df: DataFrame, by: list[str], order: list[str], hit: str, base: float, mult: float, most: int) -> DataFrame:
    """Stake after each loss, from the number of losses since the last hit, starting again after `most`."""
    w = Window.partitionBy(*by).orderBy(*order)
    island = F.coalesce(F.sum(F.col(hit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumn("__i", island).withColumn("step", F.pmod(F.row_number().over(Window.partitionBy(*by, "__i").orderBy(*order)) - 1, F.lit(most)))
    return out.withColumn("stake", base * F.pow(F.lit(mult), F.col("step"))).drop("__i")


def martingale_summary(df: DataFrame, by: list[str], order: list[str], hit: str, odds: str, base: float, mult: float, most: int) -> DataFrame:
    """Per group bets, busts (the largest stake lost), money staked and returned, the lowest running total (shortfall) and the greatest fall from a high."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = martingale(df, by, order, hit, base, mult, most).withColumn("__back", F.when(F.col(hit), F.col("stake") * F.col(odds)).otherwise(0.0))
    rows = rows.withColumn("__total", F.sum(F.col("__back") - F.col("stake")).over(w)).withColumn("__high", F.greatest(F.max("__total").over(w), F.lit(0.0)))
    return rows.groupBy(*by).agg(F.count("*").alias("bets"), F.count_if(~F.col(hit) & (F.col("step") == most - 1)).alias("busts"), F.sum("stake").alias("staked"), F.sum("__back").alias("returned"),
                                 F.least(F.min("__total"), F.lit(0.0)).alias("shortfall"), F.max(F.col("__high") - F.col("__total")).alias("drawdown"))


def scaled_equity(df: DataFrame, by: list[str], order: list[str], hit: str, odds: str, ev: Column, base: float, most: float, fund: float) -> DataFrame:
    """Stakes of base * (ev - 1), from 0 to `most` times the base in tenths, until the fund is gone: per group bets, staked, the end and lowest of the fund, and whether it went bust.

    Bets after the first one that leaves less than nothing are not made.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    stake = base * F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.round(ev - 1, 1)))
    rows = df.withColumn("__s", stake).where("__s > 0").withColumn("__f", fund + F.sum(F.when(F.col(hit), F.col("__s") * (F.col(odds) - 1)).otherwise(-F.col("__s"))).over(w))
    gone = F.coalesce(F.max((F.col("__f") <= 0).cast("int")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    made = rows.withColumn("__gone", gone).where("__gone = 0")
    return made.groupBy(*by).agg(F.count("*").alias("bets"), F.sum("__s").alias("staked"), F.max_by("__f", F.struct(*order)).alias("fund"), F.min("__f").alias("lowest"), (F.min("__f") <= 0).alias("bust"))


def date_blocks(df: DataFrame, day: str, n: int) -> DataFrame:
    """The number of each row's block of distinct dates, 1 to n, the first ones a date longer where they don't come out even."""
    dates, total = ranks.positions(df.select(day).where(F.col(day).isNotNull()).distinct(), day)
    size, longer = divmod(total, n)
    k = F.col("position")
    block = F.when(k < longer * (size + 1), F.floor(k / (size + 1))).otherwise(longer + F.floor((k - longer * (size + 1)) / max(size, 1))) + 1
    return df.join(dates.select(day, block.cast("int").alias("block")), day)


def block_improvement(df: DataFrame, day: str, old: str, new: str, n: int = 3, least: int = 60) -> DataFrame:
    """Per block of dates the rows, the mean change new - old of a loss (null under `least` rows), and whether it fell."""
    found = date_blocks(df, day, n).groupBy("block").agg(F.count("*").alias("n"), F.avg(F.col(new) - F.col(old)).alias("__d"))
    return found.select("block", "n", F.when(F.col("n") >= least, F.col("__d")).alias("change"), F.coalesce(F.when(F.col("n") >= least, F.col("__d") < 0), F.lit(False)).alias("better"))


def time_split(df: DataFrame, day: str, train: float = 0.6, valid: float = 0.15, out: str = "role") -> DataFrame:
    """1 for the first share of distinct dates, 2 for the next, 3 for the rest (60/15/25); null dates are left out."""
    dates, total = ranks.positions(df.select(day).where(F.col(day).isNotNull()).distinct(), day)
    role = F.when(F.col("position") < int(total * train), 1).when(F.col("position") < int(total * (train + valid)), 2).otherwise(3)
    return df.join(dates.select(day, role.alias(out)), day)


def days_split(df: DataFrame, day: str, last: str, test_days: int, valid_days: int, out: str = "role") -> DataFrame:
    """3 for the `test_days` up to the day `last`, 2 for the `valid_days` before these, else 1."""
    age = F.datediff(F.lit(last).cast("date"), day)
    return df.withColumn(out, F.when(age <= test_days, 3).when(age <= test_days + valid_days, 2).otherwise(1))
