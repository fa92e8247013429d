"""Structured Streaming queries: each runs to the end of its input and gives its sink's table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.plans.catalog import register
from millrace.sources.scratch import scratch
from millrace.sources.tables import SCHEMAS


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; ts with a zone, as watermarks need it. The table may be a file or a folder of files."""
    # a pattern, as a stream's plain path has to be a folder
    stream = spark.readStream.schema(SCHEMAS["events"]).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str, name: str, keys: list[str] | None = None, idle: bool = False) -> DataFrame:
    """Run to the end of the input and give what the sink then holds.

    Each batch is written under its number, so that a repeated batch replaces itself. In update mode
    a key's row of the last batch that has it counts; in complete mode the last batch does. Input
    without rows gives no rows. With idle the query is stopped after batches without input: operators that live in
    processing time always ask for another batch, so they never end by themselves.
    """
    spark, path = stream.sparkSession, scratch(stream.sparkSession, name)
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").foreachBatch(sink)
    if idle:
        stop_when_idle(writer.trigger(processingTime="0 seconds").start())
    else:
        writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(path)
    if mode != "update":
        return rows.drop("batch")
    others = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"last.{c}").alias(c) for c in stream.columns])


def stop_when_idle(query: StreamingQuery, wait: float = 0.2) -> None:
    """Stop a query once two batches in a row have found no new input, and pass on what ended it before.

    The first batch after a restart may be an old one that wasn't finished, so one is not enough.
    """
    while not query.awaitTermination(wait):
        last = query.recentProgress[-2:]
        if len(last) == 2 and last[0]["batchId"] != last[1]["batchId"] and not any(p["numInputRows"] for p in last):
            query.stop()
            return


@register("stream_agg", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode: the watermark lets the state of past windows go, and their last counts stand in the sink."""
    counts = events(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return finished(counts, "update", "stream-agg", ["w", "event_type"]).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@register("stream_complete", "SELECT event_type, count(*) AS n, max(ts) AS last FROM events GROUP BY ALL")
def stream_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete mode, for a result of a few rows: each batch gives it whole."""
    counts = events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return finished(counts, "complete", "stream-complete").withColumn("last", F.col("last").cast("timestamp_ntz"))


@register("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-duplication with state that the watermark bounds: a key may come again when the watermark has passed it by 90 days."""
    once = events(spark, sf_dir).withWatermark("ts", "90 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return finished(once.select("user_id", "event_type"), "append", "stream-dedup")


@register(
    "stream_join",
    """SELECT e.event_id AS error_id, s.event_id AS signup_id FROM events e JOIN events s ON e.user_id = s.user_id AND s.ts <= e.ts AND e.ts < s.ts + INTERVAL 1 DAY
       WHERE e.event_type = 'error' AND s.event_type = 'signup'""",
)
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-stream: errors within a day of the user's signup; the time bound lets state be dropped."""
    errors = events(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").alias("u"), F.col("ts").alias("at"), F.col("event_id").alias("error_id")).withWatermark("at", "1 day")
    signups = events(spark, sf_dir).where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id")).withWatermark("ts", "1 day")
    near = F.expr("u = user_id AND ts <= at AND at < ts + INTERVAL 1 DAY")
    return finished(errors.join(signups, near).select("error_id", "signup_id"), "append", "stream-join")


@register("stream_static_join", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.schema(SCHEMAS["customer"]).parquet(f"{sf_dir}/customer.parquet")
    joined = events(spark, sf_dir).join(customers, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment")
    return finished(joined, "append", "stream-static")


#: A visit ends after so many seconds without an event; events may come this late.
IDLE, LATE = 86_400, 3_600


@register(
    "stream_timers",
    f"""WITH gaps AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL {IDLE} SECOND, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         visits AS (SELECT user_id, ts, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS visit FROM gaps)
       SELECT user_id, epoch_us(max(ts)) AS last_us, count(*) AS n FROM visits GROUP BY user_id, visit
       HAVING epoch_ms(max(ts)) + {IDLE}000 < (SELECT epoch_ms(max(ts)) FROM events) - {LATE}000 ORDER BY ALL""",
)
def stream_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of users, given out by a timer in event time when they have been idle long enough; visits that may go on are not.

    A later event ends a visit, but doesn't give it out: the watermark has to pass the end of its idle time. The user's own newest event less
    LATE is a bound that the watermark reaches, so that the state holds the visits of about a day.
    """
    idle, late = IDLE * 1_000, LATE * 1_000

    def visits(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []  # first and last event of each visit, and its events
        held = sorted(held + [(int(t), int(t), 1) for f in frames for t in f["at"]])
        open_visits: list[tuple[int, int, int]] = []
        for first, last, n in held:
            if open_visits and first - open_visits[-1][1] <= IDLE * 1_000_000:  # events that come late can join two visits
                a, b, m = open_visits[-1]
                open_visits[-1] = (a, max(b, last), m + n)
            else:
                open_visits.append((first, last, n))
        passed = max(state.getCurrentWatermarkMs(), open_visits[-1][1] // 1000 - late)
        ended = lambda v: v[1] // 1000 + idle < passed
        out, kept = [v for v in open_visits if ended(v)], [v for v in open_visits if not ended(v)]
        if kept:
            state.update(tuple([int(x) for x in column] for column in zip(*kept)))
            state.setTimeoutTimestamp(max(kept[0][1] // 1000 + idle, state.getCurrentWatermarkMs()))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "last_us": [v[1] for v in out], "n": [v[2] for v in out]}).astype("int64")

    rows = events(spark, sf_dir).withWatermark("ts", f"{LATE} seconds").withColumn("at", F.unix_micros("ts"))
    held = "firsts array<long>, lasts array<long>, ns array<long>"
    closed = rows.groupBy("user_id").applyInPandasWithState(visits, "user_id long, last_us long, n long", held, "append", GroupStateTimeout.EventTimeTimeout)
    return finished(closed, "append", "stream-timers")


@register("stream_file", "SELECT event_id, event_type FROM events WHERE value > 50")
def stream_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(events(spark, sf_dir).where("value > 50").select("event_id", "event_type"), "append", "stream-file")


@register("stream_sink", "SELECT event_id, user_id FROM events WHERE event_type = 'signup'")
def stream_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file sink, whose log of finished files makes a repeated batch appear once."""
    path = scratch(spark, "stream-sink")
    signups = events(spark, sf_dir).where("event_type = 'signup'").select("event_id", "user_id")
    signups.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(signups.schema).parquet(path)


@register(
    "stream_watermark",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL
       HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR""",
)
def stream_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: a window is given once, when the watermark passes its end, so the last ones are not."""
    counts = events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return finished(counts, "append", "stream-watermark").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@register("stream_rate", "SELECT n_name, count(*) AS n FROM range(100) t(value) JOIN nation ON value % 25 = n_nationkey GROUP BY n_name")
def stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows made by the batch at a fixed rate and joined with the nations; the first 100 of them are looked at."""
    path = scratch(spark, "stream-rate")
    nations = spark.read.schema(SCHEMAS["nation"]).parquet(f"{sf_dir}/nation.parquet")
    rates = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", "50").option("numPartitions", "2").load().select("value")
    named = rates.join(F.broadcast(nations), F.col("value") % 25 == F.col("n_nationkey")).select("value", "n_name")
    query = named.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").start()
    while query.lastProgress is None or query.lastProgress["batchId"] < 2:
        query.awaitTermination(0.2)
    query.stop()
    return spark.read.schema(named.schema).parquet(path).where("value < 100").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


#: Quarters of a month in the order in which their files come, and the days that events may be late.
REPLAY, LATE_DAYS = (0, 2, 3, 1), 9


@register(
    "stream_late",
    f"""WITH e AS (SELECT ts, time_bucket(INTERVAL 1 DAY, ts) AS start, least((day(ts) - 1) // 8, 3) AS quarter FROM events),
         turns AS (SELECT *, list_position({list(REPLAY)}, quarter) AS turn FROM e),
         marks AS (SELECT turn, max(max(ts)) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS before FROM turns GROUP BY turn)
       SELECT start, count(*) FILTER (fine) AS n, count(*) FILTER (NOT fine) AS late FROM
         (SELECT start, before IS NULL OR start + INTERVAL 1 DAY > date_trunc('milliseconds', before) - INTERVAL {LATE_DAYS} DAY AS fine FROM turns JOIN marks USING (turn)) GROUP BY start""",
)
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose files come out of order, one to a batch: rows of windows that the watermark has passed are dropped, and counted as late.

    A batch drops by the watermark that the batch before it began with, so the files that count are those up to two turns ago.
    """
    path = scratch(spark, "stream-late-in")
    rows = spark.read.schema(SCHEMAS["events"]).parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    quarter = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    for turn in REPLAY:  # a stream reads files by their age
        rows.where(quarter == turn).coalesce(1).write.mode("append").parquet(f"{path}/in")
    spark.createDataFrame([], rows.schema).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    window = F.window("ts", "1 day").alias("w")
    counts = stream.withWatermark("ts", f"{LATE_DAYS} days").groupBy(window).agg(F.count(F.lit(1)).alias("n"))
    seen = finished(counts, "update", "stream-late", ["w"]).select(F.col("w.start").alias("s"), "n")
    every = rows.groupBy(window).agg(F.count(F.lit(1)).alias("all")).select(F.col("w.start").alias("start"), "all")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return every.join(seen, F.col("start") == F.col("s"), "left").select(F.col("start").cast("timestamp_ntz").alias("start"), n.alias("n"), (F.col("all") - n).alias("late"))


@register(
    "stream_sessions",
    """WITH gaps AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 4 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
         sessions AS (SELECT user_id, ts, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
       SELECT user_id, min(ts) AS start, count(*) AS n FROM sessions GROUP BY user_id, s HAVING max(ts) + INTERVAL 4 HOUR <= date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows, whose state merges as events join them; each is given once, when the watermark has passed its end."""
    sessions = events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return finished(sessions, "append", "stream-sessions").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@register(
    "stream_outer_join",
    """WITH e AS (SELECT * FROM events WHERE event_type = 'error'), s AS (SELECT * FROM events WHERE event_type = 'signup')
       SELECT e.event_id AS error_id, s.event_id AS signup_id FROM e LEFT JOIN s ON e.user_id = s.user_id AND s.ts <= e.ts AND e.ts < s.ts + INTERVAL 1 DAY
       WHERE s.event_id IS NOT NULL OR e.ts < date_trunc('milliseconds', least((SELECT max(ts) FROM e), (SELECT max(ts) FROM s))) - INTERVAL 2 HOUR""",
)
def stream_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-stream left outer: an error without a signup in the day before it is given with a null once the watermark of both streams has passed it."""
    errors = events(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").alias("u"), F.col("ts").alias("at"), F.col("event_id").alias("error_id")).withWatermark("at", "2 hours")
    signups = events(spark, sf_dir).where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id")).withWatermark("ts", "2 hours")
    near = F.expr("u = user_id AND ts <= at AND at < ts + INTERVAL 1 DAY")
    return finished(errors.join(signups, near, "left_outer").select("error_id", "signup_id"), "append", "stream-outer-join")
