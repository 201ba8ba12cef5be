"""Selection, sets and ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlab.operators.tuples import top_k


def top_with_quota(df: DataFrame, part: list[str], order: list[Column], k: int, favoured: Column, quota: int) -> DataFrame:
    """T4: the first k rows of each part, but at least `quota` favoured ones where there are so many: they replace the last of the others."""
    rows = df.withColumn("__f", favoured)
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*part, "__f").orderBy(*order)))
    rows = rows.withColumn("__sure", F.col("__f") & (F.col("__r") <= quota))
    rest = F.row_number().over(Window.partitionBy(*part, "__sure").orderBy(*order))
    sure = F.count_if("__sure").over(Window.partitionBy(*part))
    return rows.withColumn("__rest", rest).withColumn("__n", sure).where(F.col("__sure") | (F.col("__rest") <= k - F.col("__n"))).drop("__f", "__r", "__sure", "__rest", "__n")


def union_ordered(lists: list[DataFrame], part: str, ticket: str, rank: str) -> DataFrame:
    """T5: the lists one after the other without repeated tickets; `place` counts from 1 in each contest."""
    rows = reduce(DataFrame.unionByName, [df.select(part, ticket, F.lit(k).alias("list"), F.col(rank).alias("__r")) for k, df in enumerate(lists, 1)])
    first = rows.groupBy(part, ticket).agg(F.min(F.struct("list", "__r")).alias("__at"))
    return first.select(part, ticket, F.col("__at.list").alias("list"), F.row_number().over(Window.partitionBy(part).orderBy("__at", ticket)).alias("place"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """The new values over the old ones, with `status`: inserted, updated, same or kept (not in `new`). Both are unique in keys."""
    a, b = (df.select(*keys, F.struct(*cols).alias(name)) for df, name in ((old, "__a"), (new, "__b")))
    status = F.when(F.col("__a").isNull(), "inserted").when(F.col("__b").isNull(), "kept").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("updated")
    return a.join(b, keys, "full").select(*keys, F.coalesce("__b", "__a").alias("__v"), status.alias("status")).select(*keys, "__v.*", "status")


def roster_merge(old: DataFrame, seen: DataFrame, key: str, missed: str, most: int) -> DataFrame:
    """Members after a sync: added, updated (seen again), restored (had been missed), missing, or inactive after `most` misses."""
    both = old.select(key, missed, F.lit(True).alias("__o")).join(seen.select(key, F.lit(True).alias("__s")).distinct(), key, "full")
    count = F.when(F.col("__s"), 0).otherwise(F.col(missed) + 1)
    status = F.when(F.col("__o").isNull(), "added").when(F.col("__s") & (F.col(missed) > 0), "restored").when(F.col("__s"), "updated").when(count >= most, "inactive").otherwise("missing")
    return both.select(key, count.alias(missed), status.alias("status"))


def supersede(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every decision, with `current` on the newest of its key and how many it supersedes."""
    w = Window.partitionBy(*keys)
    return log.withColumn("current", F.row_number().over(w.orderBy(*[F.desc(c) for c in order])) == 1).withColumn("older", F.row_number().over(w.orderBy(*order)) - 1)


def top_findings(df: DataFrame, part: str, z: str, key: str, k: int) -> DataFrame:
    """The k strongest findings of each actor by absolute z."""
    return top_k(df, [part], [F.desc(F.abs(z)), F.asc(key)], k)


def strategies(named: dict[str, DataFrame], part: str, ticket: str) -> DataFrame:
    """L1: tickets of all strategies as one long table."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("strategy"), part, ticket) for name, df in named.items()])


def skip_rule(df: DataFrame, part: str, pos: str, score: str, lead: float) -> DataFrame:
    """L3: contests in which position 2 is faster than position 1 by at least `lead`."""
    at = lambda k: F.max(F.when(F.col(pos) == k, F.col(score)))
    return df.groupBy(part).agg((at(1) - at(2) >= lead).alias("skip"), (at(1) - at(2)).alias("lead")).where("lead is not null")


def agreement_ticket(df: DataFrame, part: str, slot: str, own: str, other: str, least: float) -> DataFrame:
    """The other model's first slot, where that isn't slot 1 and our own probability of it is at least `least`."""
    best = df.groupBy(part).agg(F.max_by(F.struct(slot, own), F.struct(other, -F.col(slot))).alias("__b"))
    return best.select(part, "__b.*").where((F.col(slot) != 1) & (F.col(own) >= least))


def ledger(tickets: DataFrame, probs: DataFrame, results: DataFrame, part: str, ticket: str, p: str) -> DataFrame:
    """A row for each contest: result, its rank by probability (null: not among them), tickets bought and the hit's place among them."""
    w = Window.partitionBy(part).orderBy(F.desc(p), ticket)
    ranked = probs.select(part, ticket, F.row_number().over(w).alias("model_rank")).join(results, part).where(F.col(ticket) == F.col("result")).select(part, "model_rank")
    picked = tickets.join(results.select(part, "result"), part).groupBy(part).agg(F.count("*").alias("bought"), F.max(F.when(F.col(ticket) == F.col("result"), F.col("place"))).alias("hit_place"))
    return results.join(ranked, part, "left").join(picked, part, "left").withColumn("bought", F.coalesce("bought", F.lit(0).cast("long")))


def day_review(book: DataFrame, near: int) -> DataFrame:
    """Why each contest of a ledger was missed: not bought, near (rank up to `near`), far, or hit."""
    return book.withColumn("reason", F.when(F.col("bought") == 0, "not bought").when(F.col("hit_place").isNotNull(), "hit").when(F.col("model_rank") <= near, "near").otherwise("far"))


def unordered(triples: DataFrame, part: str, slots: list[str], p: str) -> DataFrame:
    """Probability of each unordered set of slots."""
    return triples.groupBy(part, F.array_join(F.sort_array(F.array(*[F.col(s).cast("string") for s in slots])), "=").alias("kind")).agg(F.sum(p).alias("prob"))
