"""Contest tables derived from the driver's TPC-H-like tables: entrants with finish, probability and odds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestlab.operators.ingest import latest_by
from contestlab.operators.within import rank_in

VERSION = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files for each part of it: a task sorts and groups one part, whatever the size of the table.
PART_BYTES = 2 << 20


def parts_of(spark: SparkSession, sf_dir: str, name: str, part_bytes: int = PART_BYTES) -> int:
    """Parts of about `part_bytes` of the table's files; at least as many as a shuffle makes anyway."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return max(-(-size // part_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(spark: SparkSession, sf_dir: str, name: str, key: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The table, dealt by `key` into parts of about `part_bytes` of its files, where that makes more parts than a shuffle does anyway.

    Windows, groups and joins on the key keep these parts.
    """
    df = table(spark, sf_dir, name)
    parts = parts_of(spark, sf_dir, name, part_bytes)
    return df.repartition(parts, key) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def entrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contest (order) and slot (line 1 to 6), latest version only."""
    lines = latest_by(spread(spark, sf_dir, "lineitem", "l_orderkey"), ["l_orderkey", "l_linenumber"], [F.desc(c) for c in VERSION]).where("l_linenumber <= 6")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("title"))
    sites = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("site"))
    contest = Window.partitionBy("contest")
    base = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(sites, lines["l_suppkey"] == sites["s_suppkey"]).select(
        F.col("l_orderkey").alias("contest"), F.col("l_linenumber").alias("slot"), F.col("l_suppkey").alias("actor"), F.col("l_partkey").alias("equipment"),
        F.col("l_returnflag").alias("class"), "site", "day", "title", F.col("l_quantity").alias("score"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))
    ranked = base.withColumn("finish", F.row_number().over(contest.orderBy(F.desc("price"), "slot")))
    ranked = rank_in(ranked, ["contest"], "score", "min", "score_rank")
    return ranked.withColumn("p", F.col("price") / F.sum("price").over(contest)).withColumn("odds", 0.75 * F.sum("score").over(contest) / F.col("score"))


#: The same table for the SQL that checks the queries; put before each of them.
ENTRANTS_SQL = """with latest as (select * from (select *, row_number() over (partition by l_orderkey, l_linenumber order by
  l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc, l_discount desc, l_tax desc, l_returnflag desc, l_linestatus desc) as k from lineitem) where k = 1 and l_linenumber <= 6),
base as (select l_orderkey as contest, l_linenumber as slot, l_suppkey as actor, l_partkey as equipment, l_returnflag as class, s_nationkey as site, cast(o_orderdate as date) as day,
  o_orderpriority as title, l_quantity as score, l_extendedprice as price, l_discount as discount
  from latest join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey),
ent as (select *, row_number() over (partition by contest order by price desc, slot) as finish, rank() over (partition by contest order by score) as score_rank,
  price / sum(price) over (partition by contest) as p, 0.75 * sum(score) over (partition by contest) / score as odds from base)
"""
