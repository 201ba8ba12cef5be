"""Audits and discovery (E26 to E34, D1 to D3): observed against expected, by conditional sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_report(df: DataFrame, dims: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """Sums for every value of every dimension, as (dimension, value); partial sums leave each task before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("value")) for k, c in dims.items()])
    rows = df.select(*[c.alias(f"__{k}") for k, c in sums.items()], F.explode(pairs).alias("e"))
    return rows.groupBy("e.dimension", "e.value").agg(F.count("*").alias("n"), *[F.sum(f"__{k}").alias(k) for k in sums])


def drift_factors(df: DataFrame, band: Column, early: str, final: str, least: int) -> DataFrame:
    """Mean of final over early quotes in each band, or over all bands where the band has fewer than `least`."""
    ratio = F.col(final) / F.col(early)
    found = df.where(F.col(early) > 0).groupBy(band.alias("band")).agg(F.count(ratio).alias("n"), F.sum(ratio).alias("__s"))
    every = found.groupBy(F.lit(1).alias("__one")).agg((F.sum("__s") / F.sum("n")).alias("__all"))
    return found.withColumn("__one", F.lit(1)).join(every, "__one").select("band", "n", F.when(F.col("n") >= least, F.col("__s") / F.col("n")).otherwise(F.col("__all")).alias("factor"))


def cross_table(df: DataFrame, band: Column, other: Column, p: str, hit: Column) -> DataFrame:
    """Within the same band of one model, actual against expected by what the other model says."""
    return df.groupBy(band.alias("band"), other.alias("other")).agg(F.count("*").alias("n"), F.avg(p).alias("expected"), F.avg(hit.cast("int")).alias("actual"))


def context_audit(df: DataFrame, dims: list[str], hit: Column, least: int, weak: float, strong: float) -> DataFrame:
    """Each value of each dimension judged weak, strong or observe by its rate, with at least `least` cases."""
    found = split_report(df, {c: F.col(c) for c in dims}, {"hits": hit.cast("long")}).where(F.col("n") >= least)
    rate = F.col("hits") / F.col("n")
    return found.withColumn("rate", rate).withColumn("verdict", F.when(rate < weak, "weak").when(rate >= strong, "strong").otherwise("observe"))


def backoff_history(df: DataFrame, wanted: DataFrame, actor: str, dims: list[str], hit: Column, least: int, parts: int | None = None) -> DataFrame:
    """Each wanted row's rate over the largest set of matching conditions with `least` earlier rows; equal sets by cases, then mask.

    Rows are dealt by actor once (into `parts`, if given) and counted by all conditions there; each of these cells then sums the 2^n sets
    of conditions that it belongs to, within its actor, so that a task holds the cells of its actors only.
    """
    rows = df.select(actor, *dims, F.lit(1).alias("__n"), hit.cast("long").alias("__h"), F.lit(wanted is df).alias("__asked"))
    if wanted is not df:
        rows = rows.unionByName(wanted.select(actor, *dims, F.lit(0).alias("__n"), F.lit(None).cast("long").alias("__h"), F.lit(True).alias("__asked")))
    rows = rows.where(F.col(actor).isNotNull())
    rows = rows.repartition(parts, actor) if parts else rows.repartition(actor)
    cells = rows.groupBy(actor, *dims).agg(F.sum("__n").alias("__n"), F.sum("__h").alias("__h"), F.max("__asked").alias("__asked"))
    masks = cells.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in range(1 << len(dims))])))
    shared = [F.when(F.col("mask").bitwiseAND(F.lit(1 << (len(dims) - 1 - k))) == 0, F.col(c)) for k, c in enumerate(dims)]
    w = Window.partitionBy(actor, "mask", *shared)
    found = masks.withColumns({"__n": F.sum("__n").over(w), "__h": F.sum("__h").over(w)}).where(F.col("__asked") & (F.col("__n") >= least))
    score = F.struct(len(dims) - F.bit_count("mask"), F.col("__n"), -F.col("mask"))
    best = found.groupBy(actor, *dims).agg(F.max_by(F.struct("mask", "__n", "__h"), score).alias("b"))
    return best.select(actor, *dims, F.col("b.mask").alias("mask"), F.col("b.__n").alias("n"), (F.col("b.__h") / F.col("b.__n")).alias("rate"))


def expected_rate(df: DataFrame, cell: list[str], coarse: list[str], hit: Column, into: str = "expected") -> DataFrame:
    """Mean of the row's cell, or of the coarse cell where a column of the fine one is null. Both tables are small, joined by key."""
    rows = df.withColumn("__h", hit.cast("double"))
    fine, rough = (rows.groupBy(*keys).agg(F.avg("__h").alias(name)) for keys, name in ((cell, "__f"), (coarse, "__r")))
    return rows.join(fine, cell, "left").join(rough, coarse, "left").withColumn(into, F.coalesce("__f", "__r")).drop("__f", "__r", "__h")


def compare_expected(df: DataFrame, keys: list[str], hit: Column, expected: str, first_half: Column) -> DataFrame:
    """Observed and expected mean, z of the difference, and whether both halves differ in the same direction."""
    gap, e = hit.cast("double") - F.col(expected), F.col(expected)
    halves = [F.sum(F.when(side, gap).otherwise(0.0)) for side in (first_half, ~first_half)]
    found = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("observed"), F.avg(e).alias("expected"), F.sum(gap).alias("__g"), F.sum(e * (1 - e)).alias("__v"), halves[0].alias("__1"), halves[1].alias("__2"))
    return found.withColumn("z", F.when(F.col("__v") > 0, F.col("__g") / F.sqrt("__v"))).withColumn("agree", F.col("__1") * F.col("__2") > 0).drop("__g", "__v", "__1", "__2")


def rate_findings(compared: DataFrame, least: int, effect: float, z: float, grades: list[tuple[float, str]]) -> DataFrame:
    """D3: differences large and sure enough that both halves agree on, graded by absolute z."""
    far = F.abs(F.col("observed") - F.col("expected"))
    kept = compared.where((F.col("n") >= least) & (far >= effect) & (F.abs("z") >= z) & F.col("agree"))
    return kept.withColumn("grade", F.coalesce(*[F.when(F.abs("z") >= at, F.lit(g)) for at, g in grades]))


def influence_findings(df: DataFrame, contest: str, slot: str, actor: str, outcome: str, expected: str, second: str, front: int, least: int, effect: float, z: float) -> DataFrame:
    """How entrants at other slots do when an actor stands at slot `front`, against what is expected of them.

    (actor, slot, n, rate, base, z): findings with `least` contests, a rate above the expected one by `effect`, a z of at least `z`, and
    both halves (`second` false and true) above.
    """
    heads = df.where(F.col(slot) == front).select(contest, F.col(actor).alias("head"))
    rows = df.where(F.col(slot) != front).join(heads, contest).withColumn("d", F.col(outcome) - F.col(expected))
    half = lambda later: F.sum(F.when(F.col(second) == later, F.col("d")))
    out = rows.groupBy(F.col("head").alias(actor), slot).agg(
        F.count("*").alias("n"), F.avg(outcome).alias("rate"), F.avg(expected).alias("base"), F.sum("d").alias("d"), F.sum(F.col(expected) * (1 - F.col(expected))).alias("v"),
        half(False).alias("early"), half(True).alias("late"))
    out = out.withColumn("z", F.when(F.col("v") > 0, F.col("d") / F.sqrt("v")))
    good = (F.col("n") >= least) & (F.col("rate") >= F.col("base") + effect) & (F.col("z") >= z) & (F.col("early") > 0) & (F.col("late") > 0)
    return out.where(good).select(actor, slot, "n", "rate", "base", "z")


def shift_findings(df: DataFrame, actor: str, moved: Column, second: str, least: int, rate: float, z: float) -> DataFrame:
    """Actors that gain a position more often than all do: (actor, n, rate, base, z), above the base in both halves."""
    rows = df.withColumn("v", moved.cast("double"))
    base = rows.agg(F.avg("v").alias("base"))
    half = lambda later: F.avg(F.when(F.col(second) == later, F.col("v")))
    out = rows.groupBy(actor).agg(F.count("*").alias("n"), F.avg("v").alias("rate"), half(False).alias("early"), half(True).alias("late")).join(F.broadcast(base))
    out = out.withColumn("z", (F.col("rate") - F.col("base")) / F.sqrt(F.col("base") * (1 - F.col("base")) / F.col("n")))
    good = (F.col("n") >= least) & (F.col("rate") >= rate) & (F.col("z") >= z) & (F.col("early") > F.col("base")) & (F.col("late") > F.col("base"))
    return out.where(good).select(actor, "n", "rate", "base", "z")


def flag_effect_findings(df: DataFrame, actor: str, flag: Column, value: str, least_with: int, least_without: int, effect: float, z: float) -> DataFrame:
    """Actors whose value differs under a flag by more than it does for all: (actor, n_with, n_without, gap, usual, z)."""
    rows = df.select(actor, flag.alias("f"), F.col(value).cast("double").alias("v")).where("f is not null and v is not null")
    of = lambda fn, f: fn(F.when(F.col("f") == f, F.col("v")))
    usual = rows.agg((of(F.avg, True) - of(F.avg, False)).alias("usual"))
    out = rows.groupBy(actor).agg(of(F.count, True).alias("n_with"), of(F.count, False).alias("n_without"), (of(F.avg, True) - of(F.avg, False)).alias("gap"),
                                  of(F.stddev_samp, True).alias("s1"), of(F.stddev_samp, False).alias("s0")).join(F.broadcast(usual))
    out = out.where((F.col("n_with") >= least_with) & (F.col("n_without") >= least_without))
    spread = F.coalesce((F.col("s1") + F.col("s0")) / 2, F.col("s1"), F.col("s0"), F.lit(1.5))
    out = out.withColumn("z", (F.col("gap") - F.col("usual")) / (F.when(spread > 0, spread).otherwise(1.5) * F.sqrt(1 / F.col("n_with") + 1 / F.col("n_without"))))
    return out.where((F.col("gap") - F.col("usual") >= effect) & (F.col("z") >= z)).select(actor, "n_with", "n_without", "gap", "usual", "z")


def discover(findings: dict[str, DataFrame], actor: str, most: int = 4) -> DataFrame:
    """All findings (each with `actor` and z) under their names, the `most` of the largest absolute z for each actor."""
    every = None
    for name, df in findings.items():
        part = df.select(actor, F.lit(name).alias("finding"), F.col("z").cast("double").alias("z"))
        every = part if every is None else every.unionByName(part)
    order = Window.partitionBy(actor).orderBy(F.desc(F.round(F.abs("z"), 9)), "finding")
    return every.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def ability_flags(profiles: DataFrame, slot: str, n: str, win: str, start: str, wall: str, lines: dict[int, float], least: int) -> DataFrame:
    """`profiles` (one row an actor and slot) with `flags`: names of the abilities that it shows with at least `least` runs."""
    line = F.lit(None).cast("double")
    for k, v in lines.items():
        line = F.when(F.col(slot) == k, F.lit(v)).otherwise(line)
    enough = F.col(n) >= least
    found = [F.when(enough & (F.col(slot) == 1) & (F.col(win) >= 0.85), F.lit("iron_front")), F.when(enough & (F.round(win, 9) >= F.round(line + 0.10, 9)), F.lit("winner_s")).when(enough & (F.col(win) >= line), F.lit("winner_a")),
             F.when(enough & (F.col(slot) >= 2) & (F.col(wall) <= 0.30), F.lit("breaks_front")), F.when(enough & (F.col(start) <= 1.5), F.lit("starter_s")).when(enough & (F.col(start) <= 2.0), F.lit("starter_a"))]
    return profiles.withColumn("flags", F.array_compact(F.array(*found)))
