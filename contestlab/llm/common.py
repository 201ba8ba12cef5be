"""Helpers shared by the corpus operators: the shared folder, written tables, connected components, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir; a temporary one of our own where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[app]


#: Shuffle files go when a written table is complete: nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, dictionary: bool = True, folder: str = "", codec: str = "snappy") -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts the lineage and survives the loss of executors.

    The files go when the driver's JVM ends, or with their `scratch` folder. Hashes are better written without a dictionary.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.enable.dictionary", str(dictionary).lower()).option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if not folder:
        _on_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a `written` table that nothing reads any more."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
    at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _on_exit(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """A `written` whose tables are deleted at the end of the block; what is needed after it must be written outside."""
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    try:
        yield partial(written, folder=folder)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def private_name(what: str) -> str:
    """A column name that no input has."""
    return f"{what}_{uuid.uuid4().hex}"


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns, and nothing else that the input may carry."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def connected_components(edges: DataFrame, keep: Callable[..., DataFrame] = written) -> DataFrame:
    """(node, component) for every node of the undirected `edges` (a, b): component is the smallest node reachable.

    Alternates large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).
    Each is a grouped minimum joined back on its key, so that no node's neighbours ever meet in one task's memory; each
    round is written to the shared folder by `keep`. Null ends and self-loops are ignored. No edges: an empty result.
    """
    now = keep(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and a <> b").distinct()
    )
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u").select(F.explode(F.array(
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            )).alias("e")).select("e.*").where("u <> v").distinct()
        )
        now = keep(small)
        # a star forest: every node has one parent, and no parent has one itself
        tangled = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").limit(1).unionByName(
            now.select("u").join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1))
        if tangled.isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: A gram that more keys hold is split by finer ones, where there are any.
CROWD = 128


def linked_groups(prefixed: DataFrame, sets: DataFrame, sketched: Callable[[DataFrame], DataFrame], may: Callable[[Column, Column], Column],
                  verified: Callable[[DataFrame, DataFrame], DataFrame], keep: Callable[..., DataFrame],
                  finer: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """(key, component): keys that are linked to others, with the smallest key of their group.

    Candidates are pairs of keys that share a `gram` of `prefixed` (gram, key) and whose sketches pass `may`, which is false only for pairs
    that are no links. `sketched` takes the rows of `sets` (one a key) that candidates need and gives (key, sketch); `verified` takes pairs
    (a, b) and the same rows, and gives the pairs that are links. Each key is first tried with the first key and the two
    before it, in the order of keys, under each of its grams (all pairs of up to four keys), then with all others that it isn't connected to; sketches are compared
    where two keys meet, so that only likely pairs are written. Under a gram of more than CROWD keys they don't meet: each of `finer` in turn takes the rows of these keys
    and gives other grams, of which linked keys have one in common as well; the last one's grams are not split. Tables are written by `keep`.
    """
    own = Window.partitionBy("gram")
    under = own.orderBy("key")
    tried = [F.first("key").over(under).alias("lead"), F.lag("key", 1).over(under).alias("last"), F.lag("key", 2).over(under).alias("last_2")]

    def met(grams: DataFrame, last: bool) -> DataFrame:
        split = F.lit(False) if last else F.col("crowd") > CROWD
        rows = grams.select("gram", "key", *tried, F.count("*").over(own).alias("crowd")).where("key <> lead")
        return keep(rows.withColumn("split", split).withColumn("untried", ~split & (F.col("crowd") > 4)).drop("crowd"), dictionary=False, codec="zstd")

    shared = [met(prefixed, not finer)]
    members = keep(sets.join(shared[0].select(F.explode(F.array("lead", "key")).alias("key")).distinct(), "key", "left_semi"), dictionary=False, codec="zstd")
    for k, split in enumerate(finer, 1):
        # the lead of each gram is tried with all others under it
        crowded = shared[-1].where("split").select("key").distinct()
        shared.append(met(split(members.join(crowded, "key", "left_semi")), k == len(finer)))
    sketches = keep(sketched(members), dictionary=False)
    shared = reduce(DataFrame.unionByName, shared)
    led = shared.select(F.explode(F.array("lead", "last", "last_2")).alias("a"), F.col("key").alias("b")).where("a <> b").distinct()
    led = led.join(sketches.toDF("a", "a_sketch"), "a").join(sketches.toDF("b", "b_sketch"), "b").where(may(F.col("a_sketch"), F.col("b_sketch"))).select("a", "b")
    links = keep(verified(led, members))
    joined = connected_components(links, keep).select(F.col("node").alias("key"), "component")
    halves = shared.where("untried").select("gram", "key").join(sketches.join(joined, "key", "left").withColumn("component", F.coalesce("component", "key")), "key")
    halves = keep(halves, dictionary=False, codec="zstd")
    a, b = halves.alias("a"), halves.alias("b")
    across = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.key") < F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & may(F.col("a.sketch"), F.col("b.sketch"))).select(
        F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()
    return connected_components(links.unionByName(verified(across, members)), keep).select(F.col("node").alias("key"), "component")
