"""Stream queries over several files with late rows: decisions, alerts, giving up, swaps, windows and sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlab.plans.queries import R, query
from contestlab.plans.standins import table
from contestlab.storage import shared_dir
from contestlab.streaming import live, stateful

FILES = 4


def feed(spark: SparkSession, d: str, files: int = FILES) -> DataFrame:
    """A stream of `events` in `files` files by time, a micro-batch each; every second event of a file's last hour comes with the next file."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    path = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    if first is None:
        events.coalesce(1).write.parquet(path)
    else:
        span = (last - first) / files
        for k in range(files):
            low, high = (F.lit(first + span * j) for j in (k, k + 1))
            tardy = lambda edge: (F.col("ts") >= edge - F.expr("interval 1 hour")) & (F.col("ts") < edge) & (F.col("event_id") % 2 == 0)
            own = (F.col("ts") >= low) & ((F.col("ts") < high) | F.lit(k == files - 1)) & ~(tardy(high) & F.lit(k < files - 1))
            held = own | (tardy(low) & F.lit(k > 0))
            # one after the other, as a stream takes files by their times
            events.where(held).repartition(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


#: Decisions are due at midnight; a watermark of two hours after the last event bounds what is settled.
DUE = "(date_trunc('day', ts) + interval 1 day)"


@query(f"select user_id, cast(due as varchar)[1:10] as due, arg_min(event_id, (epoch_us(ts) // 1000, event_id::varchar)) as event_id from (select *, {DUE} as due from events) where epoch_us(due) // 1000 - epoch_us(ts) // 1000 between 0 and 21600000 and due < (select max(ts) - interval 2 hours from events) group by user_id, due")
def r1_decide(spark: SparkSession, d: str) -> DataFrame:
    """The first event of a user's last six hours of a day, fixed by a timer at midnight."""
    ticks = feed(spark, d).withColumn("due", F.date_trunc("day", "ts") + F.expr("interval 1 day"))
    found = live.run_available(stateful.decide(ticks, ["user_id", "due"], "ts", "due", "event_id", ["event_id"], 360, "2 hours"), "append")
    return found.where("kind = 'fixed'").select("user_id", F.col("due").cast("date").cast("string").alias("due"), "event_id")


@query("""with b as (select user_id, ts as bet_ts, event_id as bet from events where event_type = 'click'), r as (select user_id, ts as result_ts, event_id as result from events where event_type = 'purchase'),
w as (select least((select max(bet_ts) from b), (select max(result_ts) from r)) - interval 3 hours as w)
select bet, result from b left join r on b.user_id = r.user_id and result_ts >= bet_ts + interval 6 minutes and result_ts <= bet_ts + interval 12 hours where result is not null or bet_ts + interval 12 hours < (select w from w)""")
def r4_give_up(spark: SparkSession, d: str) -> DataFrame:
    """Bets with their late results, and those that were given up when the watermark had passed their last chance."""
    bets = feed(spark, d).where("event_type = 'click'").select("user_id", F.col("ts").alias("bet_ts"), F.col("event_id").alias("bet"))
    found = feed(spark, d).where("event_type = 'purchase'").select(F.col("user_id").alias("result_key"), F.col("ts").alias("result_ts"), F.col("event_id").alias("result"))
    return live.run_available(live.settle_late(bets, found, "user_id", "bet_ts", "result_ts", late="3 hours", how="leftOuter"), "append").select("bet", "result")


@query("""with recursive c as (select user_id, epoch_us(ts) // 1000 as ts, bool_or(value < 40) as bad from events group by 1, 2),
q as (select *, sum((not bad)::int) over (partition by user_id order by ts) as run, sum((not bad)::int) over (partition by user_id order by ts) + (not bad)::int * -1 as before from c),
f as (select user_id, run, ts, row_number() over (partition by user_id, run order by ts) as k from q where bad),
s as (select user_id, run, ts from f where k = 2 union all select s.user_id, s.run, min(f.ts) from s join f on f.user_id = s.user_id and f.run = s.run and f.ts >= s.ts + 21600000 group by s.user_id, s.run, s.ts),
a as (select user_id, ts, 'alert' as kind from s union all select q.user_id, q.ts, 'recovered' from q join (select distinct user_id, run from s) t on q.user_id = t.user_id and q.before = t.run where not q.bad)
select user_id, strftime(make_timestamp(ts * 1000), '%Y-%m-%d %H:%M:%S.%g') as at, kind from a where ts < (select epoch_us(max(ts)) // 1000 - 7200000 from events)""")
def r9_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Two failures of a user in a row (values under 40) raise an alert, told again after six hours, until a success."""
    told = live.run_available(stateful.alerts(feed(spark, d).withColumn("bad", F.col("value") < 40), ["user_id"], "ts", "bad", late="2 hours"), "append")
    return told.select("user_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"), "kind")


@query("select event_type, cast(ts as date)::varchar as day, count(*) as n, sum((value < 30)::int)::bigint as zeros from events group by 1, 2 having count(*) >= 12 and sum((value < 30)::int) / count(*) >= 0.3")
def r10_live_swap(spark: SparkSession, d: str) -> DataFrame:
    """Days on which an event type's values (those under 30 count as zero) go to zero for three tenths of at least 12 events, merged batch by batch."""
    folder = f"{shared_dir(spark)}/swaps-{uuid.uuid4().hex}"
    rows = feed(spark, d).select("event_type", F.to_date("ts").alias("day"), F.when(F.col("value") >= 30, F.col("value")).otherwise(0.0).alias("value"))
    take = stateful.swap_recorder(folder, "event_type", "day", "value", 12, 0.3)
    rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stateful.read_swaps(spark, folder).select("event_type", F.col("day").cast("string").alias("day"), "n", "zeros")


@query("""select user_id, n, total from (select user_id, s, count(*) as n, round(sum(value), 4) as total, max(ts) + interval 3 hours as ended from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from (select *,
  (lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 3 hours)::int as new from events)) group by user_id, s) where ended < (select max(ts) - interval 2 hours from events)""")
def r6_session_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that a pause of three hours has ended, given out when the watermark has passed them."""
    found = live.run_available(live.session_totals(feed(spark, d), ["user_id"], "ts", "3 hours", {"total": F.col("value")}, "2 hours"), "append")
    return found.select("user_id", "n", R("total", 4).alias("total"))


@query("select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2 having time_bucket(interval 1 hour, max(ts)) + interval 1 hour <= (select max(ts) - interval 2 hours from events)")
def r6_closed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hours that the watermark has closed, late rows of the batch before included."""
    found = live.run_available(live.window_totals(feed(spark, d), ["event_type"], "ts", "1 hour", {"total": F.col("value")}, "2 hours"), "append")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", R("total", 4).alias("total"))
