"""Structured Streaming operators: decisions at and near a deadline, quotes, late results, windows, notices."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from contestlab.storage import shared_dir


def first_tick(stream: DataFrame, keys: list[str], ts: str, minutes_left: Column, within: float, tie: str, cols: list[str], late: str = "1 hour", span: str = "1 hour") -> DataFrame:
    """The first tick of each key at most `within` minutes before its deadline; it fixes the decision, later ticks don't change it.

    A key's ticks must lie in one window of `span`, after which, and the time for late ones, its state is dropped.
    """
    ticks = stream.withWatermark(ts, late).where((minutes_left >= 0) & (minutes_left <= within))
    found = ticks.groupBy(F.window(ts, span), *keys).agg(F.min(F.struct(ts, tie, *[c for c in cols if c not in (ts, tie)])).alias("__t"))
    return found.select(*keys, "__t.*")


def late_decisions(stream: DataFrame, keys: list[str], ts: str, minutes_left: Column, bounds: list[tuple[float, float]], late: str = "1 hour") -> DataFrame:
    """R2: once for each key and each stretch (more than b, at most a, minutes before the deadline) in which a tick comes: keys and `stretch` (1 is the first)."""
    at = F.lit(None).cast("int")
    for k, (a, b) in enumerate(bounds, 1):
        at = F.when((minutes_left <= a) & (minutes_left > b), k).otherwise(at)
    return stream.withColumn("stretch", at).where("stretch is not null").withWatermark(ts, late).dropDuplicatesWithinWatermark([*keys, "stretch"])


def quote_stream(stream: DataFrame, deadlines: DataFrame, key: str, ts: str, deadline: str) -> DataFrame:
    """Quotes with the minutes left to their contest's deadline, a small table; without state."""
    left = (F.unix_timestamp(deadline) - F.unix_timestamp(ts)) / 60
    return stream.join(F.broadcast(deadlines.select(key, deadline)), key).withColumn("minutes_left", left)


def settle_late(bets: DataFrame, found: DataFrame, key: str, bet_ts: str, result_ts: str, first: str = "6 minutes", last: str = "12 hours", late: str = "1 hour", how: str = "inner") -> DataFrame:
    """Bets with the results of their key that come from `first` to `last` after them; `how` leftOuter gives up on the others when the watermark has passed.

    `found` has the key as `result_key`. State is dropped as the interval bounds both sides.
    """
    b, r = bets.withWatermark(bet_ts, late), found.withWatermark(result_ts, late)
    cond = (F.col(key) == F.col("result_key")) & (F.col(result_ts) >= F.col(bet_ts) + F.expr(f"interval {first}")) & (F.col(result_ts) <= F.col(bet_ts) + F.expr(f"interval {last}"))
    return b.join(r, cond, how)


def bounded_history(quotes: DataFrame, key: str, ts: str, tie: str, minutes: int, most: int) -> DataFrame:
    """R5 (batch): the first quote of each stretch of `minutes`, and of these the newest `most` of each key, numbered from the newest."""
    stretch = F.floor(F.unix_timestamp(ts) / (60 * minutes))
    first = quotes.withColumn("__s", stretch).groupBy(key, "__s").agg(F.min(F.struct(ts, tie)).alias("__q")).select(key, "__q.*")
    return first.withColumn("age", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie)))).where(F.col("age") <= most)


def window_totals(stream: DataFrame, keys: list[str], ts: str, length: str, sums: dict[str, Column], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of each key in tumbling windows, or in sliding ones with `slide`; state is dropped behind the watermark."""
    found = stream.withWatermark(ts, late).groupBy(F.window(ts, length, slide), *keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    return found.select(F.col("window.start").alias("start"), *keys, "n", *sums)


def session_totals(stream: DataFrame, keys: list[str], ts: str, gap: str, sums: dict[str, Column], late: str = "1 hour") -> DataFrame:
    """Counts and sums of each key's sessions, which a pause of `gap` ends. A stream gives them in append mode, once they are over."""
    found = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n", *sums)


def current_prediction(df: DataFrame, key: str, created: str, revision: str, now: Column, mode: str, order: list[str], cols: list[str], stale_minutes: float) -> DataFrame:
    """Of the predictions made up to `now` and not older than `stale_minutes`, that of the first mode of `order`, and of it the newest revision."""
    rank = F.lit(-len(order))
    for k, m in enumerate(order):
        rank = F.when(F.col(mode) == m, -k).otherwise(rank)
    fresh = df.where((F.col(created) <= now) & (F.unix_timestamp(now) - F.unix_timestamp(created) <= 60 * stale_minutes))
    return fresh.groupBy(key).agg(F.max_by(F.struct(mode, created, revision, *cols), F.struct(rank, created, revision)).alias("__p")).select(key, "__p.*")


def alert_state(checks: DataFrame, key: str, ts: str, bad: str, confirm: int = 2, resend: str = "6 hours") -> DataFrame:
    """R9 (batch): (key, ts, kind): an alert at the `confirm`th failure in a row, again whenever `resend` has passed since the last one, and
    a recovery at the first success after a failure that was told. A run of failures is folded in the memory of one row."""
    w = Window.partitionBy(key).orderBy(ts)
    runs = checks.withColumn("__run", F.sum((~F.col(bad)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    failed = runs.where(bad).groupBy(key, "__run").agg(F.array_sort(F.collect_list(ts)).alias("at"))
    start = F.expr("named_struct('n', 0, 'last', cast(null as timestamp), 'sent', cast(array() as array<timestamp>))")
    due = lambda acc, t: (acc["n"] + 1 >= confirm) & (acc["last"].isNull() | (t >= acc["last"] + F.expr(f"interval {resend}")))
    told = failed.withColumn("sent", F.aggregate("at", start, lambda acc, t: F.struct(
        (acc["n"] + 1).alias("n"), F.when(due(acc, t), t).otherwise(acc["last"]).alias("last"), F.when(due(acc, t), F.concat(acc["sent"], F.array(t))).otherwise(acc["sent"]).alias("sent")))["sent"]).where(F.size("sent") > 0)
    ends = runs.where(~F.col(bad)).select(key, (F.col("__run") - 1).alias("__run"), ts)
    return told.select(key, F.explode("sent").alias(ts), F.lit("alert").alias("kind")).unionByName(told.join(ends, [key, "__run"]).select(key, ts, F.lit("recovered").alias("kind")))


def notify_once(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """One notice for each key; state is kept until the watermark has passed it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def stream_wrote(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def run_available(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that has arrived and return its table, in the folder that the cluster shares.

    Each micro-batch writes its own folder, so that a batch repeated after a failure replaces itself. `update`: of each of `keys` the
    newest batch's row counts. `complete` is refused: each batch would write the whole table again. Where spark.checkpoint.dir is unset all must
    run in one process.
    """
    if mode not in ("append", "update"):
        raise ValueError("mode must be append or update")
    spark: SparkSession = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not stream_wrote(spark, f"{at}/rows"):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{at}/rows")
    if mode == "update":
        newest = F.max_by(F.struct(*stream.columns), "batch").alias("r")
        rows = rows.groupBy(*(keys or [])).agg(newest).select("r.*")
    return rows.select(*stream.columns)
