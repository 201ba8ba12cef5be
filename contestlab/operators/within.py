"""Relations within a contest (W11 to W20) on one shuffle by contest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_in(df: DataFrame, part: list[str], col: str, method: str = "min", into: str = "rank", descending: bool = False) -> DataFrame:
    """Rank by `col` (min, max, average, first, dense); nulls have no rank."""
    order = F.desc_nulls_last(col) if descending else F.asc_nulls_last(col)
    w, peers = Window.partitionBy(*part).orderBy(order), F.count("*").over(Window.partitionBy(*part, col))
    rank = {"min": F.rank().over(w), "dense": F.dense_rank().over(w), "first": F.row_number().over(w),
            "max": F.rank().over(w) + peers - 1, "average": F.rank().over(w) + (peers - 1) / 2}[method]
    return df.withColumn(into, F.when(F.col(col).isNotNull(), rank))


def center_in(df: DataFrame, part: list[str], col: str, least: int = 1, into: str = "centred") -> DataFrame:
    """Deviation from the contest's mean and gap to its best, if at least `least` values are there."""
    w = Window.partitionBy(*part)
    enough = F.count(col).over(w) >= least
    return df.withColumn(into, F.when(enough, F.col(col) - F.avg(col).over(w))).withColumn(into + "_gap", F.when(enough, F.col(col) - F.min(col).over(w)))


def inner_relations(df: DataFrame, part: str, pos: str, score: str) -> DataFrame:
    """Worst score further inside, and how many inner entrants are slower (larger score)."""
    inner = Window.partitionBy(part).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("inner_max", F.max(score).over(inner)).withColumn("inner_slower", F.size(F.filter(F.collect_list(score).over(inner), lambda x: x > F.col(score))))


def neighbour_join(df: DataFrame, part: str, pos: str, col: str) -> DataFrame:
    """The value at the next position inside and outside (null where that position is missing) and at position 1."""
    at = F.map_from_entries(F.collect_list(F.struct(pos, col)).over(Window.partitionBy(part)))
    return df.withColumn("__at", at).withColumns({"inner": F.try_element_at("__at", F.col(pos) - 1), "outer": F.try_element_at("__at", F.col(pos) + 1), "first": F.try_element_at("__at", F.lit(1))}).drop("__at")


def max_gap(df: DataFrame, part: str, pos: str, col: str) -> DataFrame:
    """A contest's largest rise between adjacent positions and where it is; of equal gaps the first."""
    gaps = df.withColumn("__gap", F.lead(col).over(Window.partitionBy(part).orderBy(pos)) - F.col(col)).where("__gap is not null")
    return gaps.groupBy(part).agg(F.max("__gap").alias("gap"), F.min_by(pos, F.struct(-F.col("__gap"), F.col(pos))).alias("gap_at"))


def spread(df: DataFrame, part: str, pos: str, col: str, at: int, into: str) -> DataFrame:
    """The value at one position, on every row of the contest."""
    return df.withColumn(into, F.max(F.when(F.col(pos) == at, F.col(col))).over(Window.partitionBy(part)))


def resolve_positions(df: DataFrame, part: str, pos: str, slot: str, into: str = "position") -> DataFrame:
    """Predicted positions, or the slots for the whole contest if two of them collide or one is missing."""
    counted = df.withColumn("__n", F.count("*").over(Window.partitionBy(part, pos)))
    bad = F.max(((F.col("__n") > 1) | F.col(pos).isNull()).cast("int")).over(Window.partitionBy(part))
    return counted.withColumn(into, F.when(bad == 1, F.col(slot)).otherwise(F.col(pos))).drop("__n")


def formation(df: DataFrame, part: str, pos: str, score: str) -> DataFrame:
    """The order of positions 2 to 4 by score, with `1` in front if position 1 is fastest; only where all four are there."""
    four = df.where(F.col(pos).between(1, 4)).groupBy(part).agg(F.count(score).alias("n"), F.sort_array(F.collect_list(F.struct(score, pos))).alias("s")).where("n = 4")
    order = F.array_join(F.transform(F.filter("s", lambda e: e[pos] > 1), lambda e: e[pos].cast("string")), "")
    return four.select(part, F.concat(F.when(F.element_at("s", 1)[pos] == 1, "1-").otherwise(""), order).alias("formation"), (F.element_at("s", 2)[score] - F.element_at("s", 1)[score]).alias("gap_to_best"))


def streaks(df: DataFrame, part: list[str], order: list[str], hit: str) -> DataFrame:
    """Longest and current losing streak of each group, by gaps and islands."""
    w = Window.partitionBy(*part).orderBy(*order)
    lost = df.withColumn("__island", F.sum(F.col(hit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = lost.where(~F.col(hit)).groupBy(*part, "__island").agg(F.count("*").alias("n"))
    last = lost.groupBy(*part).agg(F.max("__island").alias("__last"), F.count("*").alias("n_rows"), F.sum(F.col(hit).cast("int")).alias("hits"))
    return last.join(runs.groupBy(*part).agg(F.max("n").alias("longest"), F.max(F.struct("__island", "n")).alias("__end")), part, "left").select(
        *part, "n_rows", "hits", F.coalesce("longest", F.lit(0)).alias("longest"), F.when(F.col("__end.__island") == F.col("__last"), F.col("__end.n")).otherwise(0).alias("current"))


def losing_runs(df: DataFrame, part: list[str], order: list[str], hit: str) -> DataFrame:
    """Each losing run of a group: where it starts (the first of `order`), its length, and whether it still goes on."""
    w = Window.partitionBy(*part).orderBy(*order)
    lost = df.withColumn("__island", F.sum(F.col(hit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = lost.groupBy(*part).agg(F.max("__island").alias("__last"))
    runs = lost.where(~F.col(hit)).groupBy(*part, "__island").agg(F.min(order[0]).alias("start"), F.count("*").alias("length"))
    return runs.join(last, part).select(*part, "start", "length", (F.col("__island") == F.col("__last")).alias("current"))
