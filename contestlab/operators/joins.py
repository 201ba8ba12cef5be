"""Joins between contests, lookups and runs (J10 to J18), each on its key with one shuffle a side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attribute_outcome(df: DataFrame, part: str, pos: str, actor: str, outcome: Column, owner: int, target: int) -> DataFrame:
    """What happened to position `target`, put down to the actor in position `owner`; only contests that have both."""
    at = lambda k, c: F.max(F.when(F.col(pos) == k, c))
    both = df.where(F.col(pos).isin(owner, target)).groupBy(part).agg(at(owner, F.col(actor)).alias(actor), at(target, outcome).alias("outcome"))
    return both.where(F.col(actor).isNotNull() & F.col("outcome").isNotNull())


def fallback_lookup(df: DataFrame, levels: list[tuple[list[str], DataFrame]], n: str, value: str, least: int, into: str = "found") -> DataFrame:
    """The value of the first level that has at least `least` cases; `level` is its number from 1. Each level has one row a key."""
    for k, (keys, rates) in enumerate(levels):
        good = rates.where(F.col(n) >= least).select(*keys, F.struct(F.col(value).alias("v"), F.lit(k + 1).alias("level")).alias(f"__l{k}"))
        df = df.join(good, keys, "left")
    first = F.coalesce(*[F.col(f"__l{k}") for k in range(len(levels))])
    return df.withColumn(into, first["v"]).withColumn("level", first["level"]).drop(*[f"__l{k}" for k in range(len(levels))])


def compare_quotes(a: DataFrame, b: DataFrame, part: str, ticket: str, odds: str) -> DataFrame:
    """For each contest how many tickets both sides quote, and how far the second quote lies from the first."""
    both = a.select(part, ticket, F.col(odds).alias("__a")).join(b.select(part, ticket, F.col(odds).alias("__b")), [part, ticket])
    ratio = F.col("__b") / F.col("__a")
    return both.groupBy(part).agg(F.count("*").alias("matched"), F.avg(ratio).alias("mean_ratio"), F.max(F.abs(ratio - 1)).alias("worst"))


def compare_runs(a: DataFrame, b: DataFrame, part: str, ticket: str) -> DataFrame:
    """Tickets of both runs on the contests that both cover, as `both`, `first` or `second`."""
    shared = a.select(part).distinct().join(b.select(part).distinct(), part, "left_semi")
    sides = [df.select(part, ticket).distinct().withColumn(side, F.lit(1)) for df, side in ((a, "__a"), (b, "__b"))]
    kind = F.when(F.col("__b").isNull(), "first").when(F.col("__a").isNull(), "second").otherwise("both")
    return sides[0].join(sides[1], [part, ticket], "full").join(shared, part, "left_semi").select(part, ticket, kind.alias("kind"))


def common_contests(methods: dict[str, DataFrame], part: str) -> DataFrame:
    """The rows of all methods, with `method`, of contests that every method covers."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("method", F.lit(name)) for name, df in methods.items()])
    covered = rows.groupBy(part).agg(F.count_distinct("method").alias("n")).where(F.col("n") == len(methods)).select(part)
    return rows.join(covered, part, "left_semi")


def left_outcomes(runs: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Every run with each of its outcomes; runs without one stay, with nulls."""
    return runs.join(outcomes, keys, "left")


def all_in_set(df: DataFrame, part: str, member: str, known: DataFrame) -> DataFrame:
    """Whether all members of a contest are in the set; `known` has one column, named like `member`."""
    flagged = df.join(known.select(member).distinct().withColumn("__in", F.lit(True)), member, "left")
    return flagged.groupBy(part).agg(F.bool_and(F.coalesce("__in", F.lit(False))).alias("all_in"), F.count("__in").alias("n_in"))


def contest_spine(preds: DataFrame, quotes: DataFrame, results: DataFrame, part: str, slot: str, least: int) -> DataFrame:
    """One row for each contest that has a result and at least `least` entrants, all of them predicted and quoted."""
    p, o = (F.map_from_entries(F.sort_array(F.collect_list(F.struct(slot, c)))) for c in ("p", "odds"))
    full = preds.select(part, slot, "p").join(quotes.select(part, slot, "odds"), [part, slot], "left").groupBy(part).agg(
        F.count("*").alias("n"), F.count_if(F.col("odds") > 0).alias("quoted"), p.alias("probs"), o.alias("quotes"))
    return full.where((F.col("n") >= least) & (F.col("n") == F.col("quoted"))).drop("quoted").join(results, part)
