"""Mixing sources to target weights by capped water-filling (operator 9), in DataFrame functions only.

Each source's share of the whole is clamped at `most_epochs` times its size, and the excess is dealt again to the others in
proportion to their weights until none is above. Sorted by cap over weight, the clamped sources are a prefix, so the level that
the rounds end at is found with running sums over one row a source. A source then takes whole repetitions of all its documents and
one fractional repetition: documents in seeded order until the rest of the target is reached; the last one gives a part of its
words. Only the place in that order where the rest is reached is looked for, in two steps: over prefixes of the hash, then within
the one where it falls. So no task holds a whole source, and each document is then compared with its source's place, without
moving its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

SEED = "mix-1"
#: Leading hex digits of the seeded hash that part a source for its running total: 4096 parts a source.
DIGITS = 3
#: Sources whose plan, a few hundred bytes each, may be broadcast; more of them are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def water_fill(sources: DataFrame, most_epochs: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size, weight): one row a source, weights positive.

    The targets share the sum of all sizes; a source without words gets 0. Works on one row a source in one task.
    """
    cap = F.col("source_size") * most_epochs
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = sources.withColumn("cap", cap).select(
        "*", F.coalesce(F.sum("cap").over(fill), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("weight").over(fill), F.lit(0)).alias("weight_before"),
        F.sum("source_size").over(whole).alias("total"), F.sum("weight").over(whole).alias("weights"))
    # what this source would get if all sources before it were clamped and no other; the first one that stays below its cap sets the level
    left, over = F.col("total") - F.col("cap_before"), F.col("weights") - F.col("weight_before")
    levels = levels.withColumn("free", F.col("weight") * left <= F.col("cap") * over)
    at = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("rank"), left.alias("left"), over.alias("over")))).over(whole)
    return levels.withColumn("level", at).select(
        "source", "source_size", "weight",
        F.when((F.col("cap") / F.col("weight") < F.col("level.r")) | ((F.col("cap") / F.col("weight") == F.col("level.r")) & (F.col("rank") < F.col("level.rank"))), F.col("cap").cast("double"))
        .otherwise((F.col("weight") * F.col("level.left")).cast("double") / F.col("level.over")).alias("target"))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3),
                most_epochs: int = 3, seed: str = SEED) -> DataFrame:
    """`docs` with size, source_size, target and taken (columns of these names are replaced).

    Sources in code-point order, null last, weigh `weights` in turn. taken: the words that the mix takes of the document,
    repeats counted, at most `most_epochs` times its size; a source's taken words add up to its target, rounded (but for what equal shares of repeated rows leave). Null and empty
    texts have size 0 and give nothing. Repeated rows are documents of their own, and where the rest is reached among them they share it evenly; documents without an id count. An empty
    table gives an empty result. Reruns agree: the order within a source is that of md5(seed:doc_id), then id and size.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    carried = [F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(kept)]
    # a key that is never null and sorts as asked: by code point, null last
    src = F.coalesce(F.concat(F.lit("0"), F.col(f"`{source}`").cast("string")), F.lit("1"))
    mark = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))).cast("string")
    rows = docs.select(*carried, src.alias("src"), F.col(f"`{doc_id}`").alias("id"), n_words(F.col(f"`{text}`")).alias("size"), mark.alias("mark")).withColumn("part", F.substring("mark", 1, DIGITS))
    parts = written(rows.groupBy("src", "part").agg(F.sum("size").alias("part_size")))
    few = parts.select("src").distinct().count() <= BROADCAST_SOURCES
    ranked = parts.groupBy("src").agg(F.sum("part_size").alias("source_size")).withColumn("rank", F.row_number().over(Window.orderBy("src")))
    weigh = F.array(*[F.lit(w).cast("long") for w in weights])[((F.col("rank") - 1) % len(weights)).cast("int")]
    filled = water_fill(ranked.select(F.col("src").alias("source"), "source_size", "rank", weigh.alias("weight")), most_epochs)
    filled = filled.select(F.col("source").alias("src"), "source_size", "target").withColumn(
        "whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_epochs))).otherwise(0).cast("long")).withColumn(
        "rest", F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.withColumn("ahead", F.coalesce(F.sum("part_size").over(before), F.lit(0))).join(filled.select("src", "rest"), "src")
    # the part of each source where the rest is reached, and there the document
    crossing = ahead.where("ahead < rest and ahead + part_size >= rest").select("src", "part", "ahead", "rest")
    there = rows.select("src", "part", "mark", "id", "size").join(F.broadcast(crossing) if few else crossing, ["src", "part"])
    ties = there.groupBy("src", "ahead", "rest", "mark", "id", "size").agg(F.count("*").alias("copies"))
    own = Window.partitionBy("src").orderBy("mark", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("within", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(own), F.lit(0))).withColumn("left", F.col("rest") - F.col("ahead") - F.col("within"))
    cut = ties.where((F.col("left") > 0) & (F.col("left") <= F.col("size") * F.col("copies"))).select(
        F.col("src").alias("c_src"), F.struct("mark", "id", "size").alias("cut"), F.floor(F.col("left") / F.col("copies")).alias("some"))
    plan = written(filled.join(cut, F.col("src") == F.col("c_src"), "left").select("src", "source_size", "target", "whole", "rest", "cut", "some"))
    placed = rows.join(F.broadcast(plan) if few else plan, "src")
    place = F.struct("mark", "id", "size")
    extra = F.when(F.col("rest") <= 0, 0).when(F.col("cut").isNull() | (place < F.col("cut")), F.col("size")).when(place == F.col("cut"), F.col("some")).otherwise(0)
    return placed.select(*[F.col(f"in_{k}").alias(c) for k, c in enumerate(kept)], "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"))
