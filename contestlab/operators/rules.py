"""Rules of thumb compiled to one wide row a contest and counted there.

A rule names positions, neighbours, ranks, prior rates and bands in SQL over columns `measure<position>`; `{k}` in it stands for each of its
positions, `{i}` and `{o}` for the inner and outer neighbour. All rules' conditions and outcomes are evaluated in one
pass, the pairs are counted by scope inside the tasks, and only the few sums are unpivoted.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSITIONS = range(1, 7)
#: Scopes whose sums a task holds before it gives them on.
SCOPES = 64


@dataclass(frozen=True)
class Rule:
    """Bands (name: condition) against outcomes (name: condition, null where it can't be known); `each` repeats both for its positions and adds them up."""

    number: int
    name: str
    bands: dict[str, str]
    outcomes: dict[str, str]
    each: tuple[int, ...] = ()
    least: int = 1

    def cells(self) -> list[tuple[str, str, str, str]]:
        """(band, outcome, condition, outcome's condition), a row for each position of `each`."""
        out = []
        for band, c in self.bands.items():
            for outcome, y in self.outcomes.items():
                for k in self.each or (0,):
                    at = (lambda s, k=k: s.replace("{k}", str(k)).replace("{i}", str(k - 1)).replace("{o}", str(k + 1))) if k else (lambda s: s)
                    out.append((band, outcome, at(c), at(y)))
        return out


def known(measure: str, positions=POSITIONS) -> str:
    return "(" + " + ".join(f"({measure}{k} is not null)::int" for k in positions) + ")"


def rank_of(measure: str, k: int, least: int = 5, ties: str = "min") -> str:
    """Place of position k, ascending; null if it or too many others are unknown. `ties`: `min` counts those before, `max` also those equal."""
    op = "<" if ties == "min" else "<="
    before = " + ".join(f"coalesce(({measure}{j} {op} {measure}{k})::int, 0)" for j in POSITIONS if ties == "max" or j != k)
    return f"case when {measure}{k} is not null and {known(measure)} >= {least} then {'1 + ' if ties == 'min' else ''}{before} end"


def margin_of(measure: str) -> str:
    """By how much the first leads the second; 0 if two are equal, null under two known."""
    values = ", ".join(f"{measure}{k}" for k in POSITIONS)
    rest = ", ".join(f"case when {measure}{k} = least({values}) and not ({' or '.join(f'coalesce({measure}{j} = {measure}{k}, false)' for j in POSITIONS if j != k)}) then null else {measure}{k} end" for k in POSITIONS)
    return f"case when {known(measure)} >= 2 then least({rest}) - least({values}) end"


def prior_means(df: DataFrame, day: str, actor: str, values: dict[str, tuple[str, int, list[str]]], days: int) -> DataFrame:
    """Mean of whole numbers over the actor's rows of the `days` days before `day` (a number), the day itself left out: name: (value in SQL, least rows, other keys).

    Each is the difference of two running sums, so that a row costs the same however many rows the days before it hold; sums of whole numbers
    are exact. Null under the least number of known values.
    """
    for name, (value, least, keys) in values.items():
        upto = Window.partitionBy(actor, *keys).orderBy(day)
        of = lambda f: f.over(upto.rangeBetween(Window.unboundedPreceding, -1)) - F.coalesce(f.over(upto.rangeBetween(Window.unboundedPreceding, -days - 1)), F.lit(0))
        n, total = of(F.count(F.expr(value))), of(F.sum(F.expr(value).cast("long")))
        df = df.withColumn(name, F.when(n >= least, F.round(total / n, 9)))
    return df


def wide(df: DataFrame, part: str, slot: str, measures: list[str], contest: list[str]) -> DataFrame:
    """One row a contest: `measure<position>` for positions 1 to 6, and the columns `contest` (any row's, as all of a contest have the same).

    A position's rows are gathered whole, as a case for each measure and position costs more on every row; of several rows the greatest value counts.
    """
    at = [F.collect_list(F.when(F.col(slot) == k, F.struct(*measures))).alias(f"__{k}") for k in POSITIONS]
    rows = df.groupBy(part).agg(F.first(F.struct(*contest)).alias("__contest"), *at)
    return rows.select(part, *[F.col(f"__contest.{c}").alias(c) for c in contest], *[F.array_max(F.col(f"__{k}.{m}")).alias(f"{m}{k}") for m in measures for k in POSITIONS])


def rule_tables(contests: DataFrame, rules: list[Rule], by: list[str]) -> DataFrame:
    """(by, rule, name, band, outcome, n, rate, base_n, base): how often each outcome came under each band, and in all contests.

    Rows with an unknown outcome count nowhere; bands with fewer than the rule's `least` are left out. All conditions and outcomes are evaluated once
    a contest as two arrays; a task multiplies them (conditions x contests by contests x outcomes) scope by scope and gives on its sums.
    """
    cells = [(r, *c) for r in rules for c in r.cells()]
    conditions, outcomes = ({x: k for k, x in enumerate(dict.fromkeys(["true", *(c[at] for c in cells)] if at == 3 else [c[at] for c in cells]))} for at in (3, 4))
    pairs = list(dict.fromkeys((conditions[c], outcomes[y]) for _, _, _, c, y in cells)) + [(0, k) for k in outcomes.values()]
    # Spark keeps ranks and margins in a projection of their own, as conditions name them many times
    rows = contests.select(*by, F.expr("array(" + ", ".join(f"coalesce(({c}), false)" for c in conditions) + ")").alias("c"),
                                    F.expr("array(" + ", ".join(f"cast(coalesce(({y})::int, -1) as tinyint)" for y in outcomes) + ")").alias("y"))
    schema = rows.select(*by).schema.add("pair", "integer").add("hits", "long").add("n", "long")
    at, width = np.array(pairs), (len(conditions), len(outcomes))

    def batch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for scope, total in sums.items():
                hits, n = total[0][at[:, 0], at[:, 1]], total[1][at[:, 0], at[:, 1]]
                keys = [pa.array([v] * len(pairs), f.type) for v, f in zip(scope, kinds)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(hits), pa.array(n)], names=schema.names)
            sums.clear()

        kinds: list = []
        for frame in frames:
            kinds = [frame.schema.field(k) for k in range(len(by))]
            met = frame.column("c").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width[0])
            came = frame.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, width[1])
            scopes: dict[tuple, list[int]] = {}
            for k, scope in enumerate(zip(*[frame.column(c).to_pylist() for c in by]) if by else [()] * len(met)):
                scopes.setdefault(scope, []).append(k)
            for scope, own in scopes.items():
                if scope not in sums and len(sums) >= SCOPES:
                    yield from given()
                total = sums.setdefault(scope, np.zeros((2, *width), np.int64))
                total[0] += (met[own].T @ (came[own] == 1).astype(np.float32)).astype(np.int64)
                total[1] += (met[own].T @ (came[own] >= 0).astype(np.float32)).astype(np.int64)
        yield from given()

    counted = rows.mapInArrow(batch, schema).groupBy(*by, "pair").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    number = {p: k for k, p in reversed(list(enumerate(pairs)))}
    plan = [(r.number, r.name, band, outcome, r.least, number[conditions[c], outcomes[y]] if kind == "cell" else number[0, outcomes[y]], kind) for r, band, outcome, c, y in cells for kind in ("cell", "base")]
    plan = contests.sparkSession.createDataFrame(plan, "rule int, name string, band string, outcome string, least int, pair int, kind string")
    own = ["rule", "name", "band", "outcome"]
    total = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)))
    out = counted.join(F.broadcast(plan), "pair").groupBy(*by, *own, "least").agg(
        total("cell", "hits").alias("hits"), total("cell", "n").alias("n"), total("base", "hits").alias("base_hits"), total("base", "n").alias("base_n"))
    return out.where(F.col("n") >= F.col("least")).select(*by, *own, "n", (F.col("hits") / F.col("n")).alias("rate"), "base_n", (F.col("base_hits") / F.col("base_n")).alias("base"))
