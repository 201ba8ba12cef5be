"""Keyed state with event-time timers: decisions that are provisional until a timer fixes them (R1), alerts with hysteresis (R9), swaps merged once.

Both processors wait for the watermark before they settle anything, so that the result is that of the batch twin however rows are dealt into
micro-batches, as long as none comes later than the watermark allows. State of a key goes when it is settled. Keys share their state in buckets, so that
a batch costs a few calls to the state store for each bucket and not for each key or row.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Timers and lists of state need this store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The session's streams keep their state in RocksDB from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _millis(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


#: Keys are dealt into this many buckets, whose keys share one row of state and one timer: a call to the store costs more than a key's work.
BUCKETS = 512
#: How keys and carried columns are packed; times keep their microseconds and offset.
PACKED = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class Bucketed(StatefulProcessor):
    """The keys of a bucket in one packed row of state, with a timer at the earliest time that one of them waits for."""

    #: Columns of the rows given out.
    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", StructType([StructField("next", LongType()), StructField("keys", BinaryType())]))

    def load(self) -> tuple[int | None, dict]:
        held = self.state.get() if self.state.exists() else None
        return (held[0], pickle.loads(held[1])) if held else (None, {})

    def save(self, timer: int | None, earliest: int | None, keys: dict) -> None:
        """`timer` is the one that is set, or None; a later one that is left behind finds nothing to do."""
        if not keys:
            self.state.clear()
            return
        if earliest is not None and (timer is None or earliest < timer):
            self.handle.registerTimer(earliest)
            timer = earliest
        self.state.update((timer, pickle.dumps(keys, pickle.HIGHEST_PROTOCOL)))

    def given(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=list(self.columns))

    def close(self) -> None:
        pass


class Decide(Bucketed):
    """State of a key: the first tick within the last stretch, or before it the newest one (provisional), and its deadline, at which it is settled."""

    columns = ("who", "kind", "at", "tie", "what")

    def __init__(self, within_ms: int):
        self.within = within_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, keys = self.load()
        changed, opened = set(), {}
        for frame in rows:
            for who, at, due, tie, what in zip(*[frame[c].tolist() for c in ("who", "at_ms", "due_ms", "tie_text", "what_json")]):
                held, inside = keys.get(who), due - at <= self.within
                if held is None:
                    opened[who] = due
                elif not ((inside and not held[0]) or (inside == held[0] and ((at, tie) < held[1:3] if inside else (at, tie) > held[1:3]))):
                    continue
                keys[who] = (inside, at, tie, what, held[4] if held else due)
                changed.add(who)
        if changed:
            self.save(timer, min(opened.values(), default=None), keys)
        return self.given([(who, "provisional", *keys[who][1:4]) for who in changed])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        timer, keys = self.load()
        if timer is None or timer > fired:
            return iter(())
        over = [who for who, held in keys.items() if held[4] <= fired or held[4] < passed]
        settled = [(who, keys.pop(who)) for who in over]
        self.save(None, min((held[4] for held in keys.values()), default=None), keys)
        return self.given([(who, "fixed", *held[1:4]) for who, held in settled if held[0]])


def _packed(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), PACKED)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("who"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _untied(rows: DataFrame, packed: str, columns: list[str], kinds: StructType) -> DataFrame:
    """Columns out of their packed form."""
    shape = StructType([StructField(f.name, f.dataType) for f in kinds.fields if f.name in columns])
    return rows.withColumn("__w", F.from_json(packed, shape, PACKED)).select(*[c for c in rows.columns if c != packed], *[F.col(f"__w.{c}").alias(c) for c in columns])


def decide(stream: DataFrame, keys: list[str], ts: str, deadline: str, tie: str, what: list[str], within: float = 5.5, late: str = "1 minute") -> DataFrame:
    """A `provisional` row whenever a batch changes a contest's decision, and once its `fixed` one: the first tick at most `within` minutes before the deadline.

    A timer in event time fires when the watermark has passed the deadline; a contest without a tick in that stretch is never fixed. Ticks after
    their deadline, and rows without a time or deadline, are left out. Ticks at one time are taken by `tie` as text.
    """
    use_rocksdb(stream.sparkSession)
    packed = stream.withWatermark(ts, late).where(F.col(ts) <= F.col(deadline)).select(
        ts, _packed(*keys).alias("who"), _millis(ts).alias("at_ms"), _millis(deadline).alias("due_ms"), F.coalesce(F.col(tie).cast("string"), F.lit("")).alias("tie_text"), _packed(*what).alias("what_json"))
    found = packed.withColumn("bucket", _bucket()).groupBy("bucket").transformWithStateInPandas(Decide(int(within * 60_000)), "who string, kind string, at long, tie string, what string", "Append", "EventTime")
    rows = found.select("who", "kind", F.timestamp_millis("at").alias("__at"), "what")
    return _untied(_untied(rows, "who", keys, stream.schema), "what", what, stream.schema).select(*keys, "kind", F.col("__at").alias("at"), *what)


def decide_batch(ticks: DataFrame, keys: list[str], ts: str, deadline: str, tie: str, what: list[str], within: float = 5.5) -> DataFrame:
    """R1, batch twin: keys, at and `what` of the fixed decisions."""
    left = _millis(deadline) - _millis(ts)
    inside = ticks.where((left >= 0) & (left <= int(within * 60_000)))
    first = inside.groupBy(*keys).agg(F.min_by(F.struct(F.timestamp_millis(_millis(ts)).alias("at"), *what), F.struct(_millis(ts), F.coalesce(F.col(tie).cast("string"), F.lit("")))).alias("__d"))
    return first.select(*keys, "__d.*")


class Alert(Bucketed):
    """State of a key: checks that the watermark has not passed, by their times, and how the run of failures stands. They are taken up in order."""

    columns = ("who", "at", "kind")

    def __init__(self, confirm: int, resend_ms: int):
        self.confirm, self.resend = confirm, resend_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, keys = self.load()
        earliest = None
        for frame in rows:
            for who, at, bad in zip(*[frame[c].tolist() for c in ("who", "at_ms", "is_bad")]):
                waiting = keys.setdefault(who, ({}, 0, -1))[0]
                waiting[at] = waiting.get(at, False) or bad
                earliest = at if earliest is None else min(at, earliest)
        self.save(timer, earliest, keys)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        timer, keys = self.load()
        if timer is None or timer > fired:
            return iter(())
        told, left, earliest = [], {}, None
        for who, (waiting, failures, sent) in keys.items():
            for at in sorted(t for t in waiting if t <= fired or t < passed):
                if waiting.pop(at):
                    failures += 1
                    if failures >= self.confirm and (sent < 0 or at - sent >= self.resend):
                        told.append((who, at, "alert"))
                        sent = at
                else:
                    if sent >= 0:
                        told.append((who, at, "recovered"))
                    failures, sent = 0, -1
            if waiting:
                earliest = min(waiting) if earliest is None else min(earliest, min(waiting))
            if waiting or failures:
                left[who] = (waiting, failures, sent)
        self.save(None, earliest, left)
        return self.given(told)


def alerts(checks: DataFrame, keys: list[str], ts: str, bad: str, confirm: int = 2, resend_hours: float = 6, late: str = "1 minute") -> DataFrame:
    """(keys, at, kind): an `alert` at the `confirm`th failure in a row, again at the first failure `resend_hours` after the last one told, and `recovered`
    at the first success after a told failure. Checks of one key and millisecond are one, bad if any is. Null `bad` is a success."""
    use_rocksdb(checks.sparkSession)
    rows = checks.withWatermark(ts, late).where(F.col(ts).isNotNull()).select(ts, _packed(*keys).alias("who"), _millis(ts).alias("at_ms"), F.coalesce(F.col(bad), F.lit(False)).alias("is_bad"))
    found = rows.withColumn("bucket", _bucket()).groupBy("bucket").transformWithStateInPandas(Alert(confirm, int(resend_hours * 3_600_000)), "who string, at long, kind string", "Append", "EventTime")
    return _untied(found.select("who", F.timestamp_millis("at").alias("__at"), "kind"), "who", keys, checks.schema).select(*keys, F.col("__at").alias("at"), "kind")


def swap_recorder(folder: str, site: str, day: str, value: str, least: int = 12, share: float = 0.6):
    """A foreachBatch function that records the days on which a site's values go to zero or null all at once (a swap of equipment).

    `folder`/counts holds one small partial count for each batch, and `folder`/swaps the merged table after each batch. A batch that is replayed
    overwrites its own part, so it changes nothing; the newest number that was written is the table in force (`read_swaps`).
    """
    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        counts = batch.where(F.col(site).isNotNull() & F.col(day).isNotNull()).groupBy(site, day).agg(
            F.count("*").alias("n"), F.sum((F.coalesce(F.col(value), F.lit(0)) == 0).cast("long")).alias("zeros"))
        counts.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")
        every = spark.read.schema(counts.schema.add("batch", "long")).parquet(f"{folder}/counts").where(F.col("batch") <= number)
        total = every.groupBy(site, day).agg(F.sum("n").alias("n"), F.sum("zeros").alias("zeros"))
        found = total.where((F.col("n") >= least) & (F.col("zeros") / F.col("n") >= share))
        found.write.mode("overwrite").parquet(f"{folder}/swaps/batch={number}")

    return take


def read_swaps(spark: SparkSession, folder: str) -> DataFrame:
    """The swaps in force: those that the newest batch left."""
    every = spark.read.parquet(f"{folder}/swaps")
    newest = every.agg(F.max("batch").alias("batch"))
    return every.join(F.broadcast(newest), "batch").drop("batch")
