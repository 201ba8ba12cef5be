"""Named strategies: a registry of rules that say which tickets of a contest are bought."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that a rule may ask for, by these names.
Columns = dict[str, Column]


@dataclass(frozen=True)
class Strategy:
    """Tickets that `keep` holds for, the first `most` of them by `by` (p or ev, falling), and of those the ones that `then` holds for."""

    keep: Callable[[Columns], Column]
    by: str = "p"
    most: int = 6
    then: Callable[[Columns], Column] | None = None


REGISTRY: dict[str, list[Strategy]] = {}


def register(name: str, *parts: Strategy) -> None:
    """A strategy of several parts buys what any of them buys, once."""
    REGISTRY[name] = list(parts)


register("top", Strategy(lambda c: F.lit(True), "p", 3))
register("ev", Strategy(lambda c: c["ev"] >= 0.8, "ev", 6))
register("ev_band", Strategy(lambda c: c["ev"] >= 0.8, "ev", 2, lambda c: (c["odds"] >= 4) & (c["odds"] < 20)))
register("ev_top", Strategy(lambda c: c["odds"] > 0, "ev", 1))
register("mix", Strategy(lambda c: F.lit(True), "p", 2), Strategy(lambda c: c["ev"] >= 0.8, "ev", 1))


def apply_strategies(tickets: DataFrame, part: str, ticket: str, p: str, odds: str, names: list[str] | None = None) -> DataFrame:
    """L1: (strategy, part, ticket, p, odds, ev): the tickets that each named strategy (all by default) buys. One shuffle by contest for all of them.

    Equal values go by ticket; tickets without odds have no expected value, and rules on it don't hold.
    """
    columns = {"p": F.col(p), "odds": F.col(odds), "ev": F.round(F.col(p) * F.col(odds), 9)}
    bought = []
    for name in names or list(REGISTRY):
        hit = F.lit(False)
        for s in REGISTRY[name]:
            keep = F.coalesce(s.keep(columns), F.lit(False))
            place = F.row_number().over(Window.partitionBy(part, keep).orderBy(F.round(columns[s.by], 9).desc_nulls_last(), ticket))
            own = keep & (place <= s.most)
            hit = hit | (own & F.coalesce(s.then(columns), F.lit(False)) if s.then else own)
        bought.append(F.struct(F.lit(name).alias("strategy"), hit.alias("bought")))
    rows = tickets.select(part, ticket, columns["p"].alias("p"), columns["odds"].alias("odds"), columns["ev"].alias("ev"), F.array(*bought).alias("s"))
    return rows.withColumn("s", F.explode("s")).where("s.bought").select("s.strategy", part, ticket, "p", "odds", "ev")
