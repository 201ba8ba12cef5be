"""Checks of records and inputs (Q1 to Q4): rule lists over rows, reconciled sums, readiness, weekly reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger_checks(ticket_price: float = 100.0, unsettled_minutes: float = 90.0) -> dict[str, Column]:
    """Q1: the checks of one settled or open contest, by name.

    Columns: result, result_pair, payout, payout_pair, favourite, favourite_won, cancelled, minutes_since, bought, picks (array), stake, returned, hit.
    """
    c = F.col
    settled, open_ = c("result").isNotNull() & ~c("cancelled"), c("result").isNull() & ~c("cancelled")
    bought = settled & c("bought")
    wanted = F.array_contains("picks", c("result"))
    odd = lambda pay: pay.isNull() | (pay < 100) | (F.pmod(pay, F.lit(10)) != 0)
    return {
        "cancelled_but_staked": c("cancelled") & (F.coalesce("stake", F.lit(0)) > 0),
        "pair_differs": settled & (F.substring_index("result", "-", 2) != c("result_pair")),
        "payout_odd": settled & odd(c("payout")),
        "pair_payout_odd": settled & c("result_pair").isNotNull() & odd(c("payout_pair")),
        "favourite_flag": settled & (c("favourite_won") != (c("favourite").cast("string") == F.substring_index("result", "-", 1))),
        "result_missing": open_ & (c("minutes_since") > unsettled_minutes),
        "staked_not_bought": ~c("cancelled") & ~c("bought") & (F.coalesce("stake", F.lit(0)) > 0),
        "stake_differs": ~c("cancelled") & c("bought") & (F.size("picks") > 0) & (c("stake") != ticket_price * F.size("picks")),
        "hit_flag": bought & (c("hit") != wanted),
        "return_differs": bought & c("returned").isNotNull() & (c("returned") != F.when(wanted, c("payout")).otherwise(0)),
        "return_missing": bought & c("returned").isNull() & wanted,
    }


def audit(df: DataFrame, checks: dict[str, Column], where: str, most: int = 3) -> DataFrame:
    """Q1: (check, n, examples): how many rows fail each check, and the first `most` places; checks that none fails are left out.

    Examples are picked in two rounds, so that a check that most rows fail does not meet in one task.
    """
    failed = df.select(F.col(where).alias("at"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))).alias("check"))
    few = failed.distinct().withColumn("part", F.pmod(F.hash("at"), F.lit(64)))
    for part in (["check", "part"], ["check"]):
        few = few.withColumn("k", F.row_number().over(Window.partitionBy(*part).orderBy("at"))).where(F.col("k") <= most)
    examples = few.groupBy("check").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("at")), lambda x: x.cast("string"))).alias("examples"))
    return failed.groupBy("check").agg(F.count("*").alias("n")).join(examples, "check")


def audit_rollup(rows: DataFrame, totals: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Q1, Q2: the keys where the rows' sums differ from the stated totals, or where one side is missing: both sums of each column."""
    made = rows.groupBy(*by).agg(*[F.sum(c).alias(f"rows_{c}") for c in sums])
    both = made.join(totals.select(*by, *[F.col(c).alias(f"total_{c}") for c in sums]), by, "full")
    same = F.lit(True)
    for c in sums:
        same = same & F.col(f"rows_{c}").eqNullSafe(F.col(f"total_{c}"))
    return both.where(~same)


def validate(df: DataFrame, part: str, size: int, rules: list[tuple[str, str, Column]], unique: dict[str, str]) -> DataFrame:
    """Q3: (part, rows, errors, warnings, infos, ready): issues of each group's rows by severity.

    `rules`: (severity, name, condition that is an issue) for each row. `unique`: columns by issue name of which a value that is
    repeated in the group is an error. A group of another size than `size` is a warning, and never ready.
    """
    w = {n: Window.partitionBy(part, c) for n, c in unique.items()}
    found = [F.when(cond, F.lit(level)) for level, _, cond in rules]
    # each repeated value is one error, told at its first row
    first = [F.when(F.col(c).isNotNull() & (F.count("*").over(w[n]) > 1) & (F.row_number().over(w[n].orderBy(c)) == 1), F.lit("error")) for n, c in unique.items()]
    rows = df.select(part, F.array_compact(F.array(*found, *first)).alias("issues"))
    n = lambda level: F.sum(F.size(F.filter("issues", lambda x: x == level)))
    out = rows.groupBy(part).agg(F.count("*").alias("rows"), n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))
    out = out.withColumn("warnings", F.col("warnings") + (F.col("rows") < size).cast("int"))
    return out.withColumn("ready", (F.col("errors") == 0) & (F.col("rows") == size))


def weekly(df: DataFrame, day: str, by: list[str]) -> DataFrame:
    """Q4: by ISO week: days, bets, hits, stake, returned, return on stake, days in profit and the worst day. Columns stake, returned, hit."""
    daily = df.groupBy(*by, day).agg(F.count("*").alias("bets"), F.sum(F.col("hit").cast("int")).alias("hits"), F.sum("stake").alias("stake"), F.sum("returned").alias("returned"))
    daily = daily.withColumn("week", F.to_date(F.date_trunc("week", day))).withColumn("profit", F.col("returned") - F.col("stake"))
    out = daily.groupBy(*by, "week").agg(F.count("*").alias("days"), *[F.sum(c).alias(c) for c in ("bets", "hits", "stake", "returned")],
                                         F.sum((F.col("profit") > 0).cast("int")).alias("days_up"), F.min("profit").alias("worst_day"))
    return out.withColumn("roi", F.col("returned") / F.col("stake"))
