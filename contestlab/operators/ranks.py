"""Global order over all rows without one task that sees them all: range partitions, numbers within, and offsets by a prefix over partitions."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestlab.storage import written

AT, PART = "__at", "__part"


def place(df: DataFrame, *order, parts: int | None = None) -> DataFrame:
    """`df` in range partitions by `order`, sorted and written once: `__part` says which, `__at` ascends in the order of all rows.

    Equal keys fall into one partition, so `order` should end in a column that tells rows apart. Without `parts` their number follows the data's size.
    """
    ranged = df.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    return written(ranged.withColumn(AT, F.monotonically_increasing_id()).withColumn(PART, F.shiftright(AT, 33)))


def _offsets(placed: DataFrame, how, column: str, out: str, join) -> tuple[DataFrame, float]:
    """(__part, out): `how` of the column in earlier partitions, and over all; one row a partition comes to the driver."""
    rows = sorted((r[PART], r.t) for r in placed.groupBy(PART).agg(how(column).alias("t")).collect() if r.t is not None)
    ends = list(accumulate((t for _, t in rows), join))
    kind = dict(placed.dtypes)[column]
    kind = "bigint" if how is F.sum and kind in ("int", "bigint", "smallint", "tinyint") else kind
    frame = placed.sparkSession.createDataFrame([(p, e) for (p, _), e in zip(rows[1:], ends)], f"{PART} bigint, {out} {kind}")
    return frame, ends[-1] if ends else 0


def before_sum(placed: DataFrame, column: str, out: str) -> tuple[DataFrame, float]:
    """The placed rows with `out`, the sum of `column` over all earlier rows (0 for the first), and the sum over all."""
    offsets, total = _offsets(placed, F.sum, column, "__o", lambda a, b: a + b)
    w = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    made = placed.join(F.broadcast(offsets), PART, "left").withColumn(out, F.coalesce(F.sum(column).over(w), F.lit(0)) + F.coalesce("__o", F.lit(0)))
    return made.drop("__o"), total


def upto_max(placed: DataFrame, column: str, out: str) -> DataFrame:
    """The placed rows with `out`, the greatest value of `column` up to each row, itself included."""
    offsets, _ = _offsets(placed, F.max, column, "__o", max)
    w = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(F.broadcast(offsets), PART, "left").withColumn(out, F.greatest(F.max(column).over(w), "__o")).drop("__o")


def positions(df: DataFrame, *order, out: str = "position") -> tuple[DataFrame, int]:
    """`df` with each row's place in `order`, from 0, and the number of rows."""
    found, total = before_sum(place(df.withColumn("__one", F.lit(1)), *order), "__one", out)
    return found.drop("__one", AT, PART), int(total)
