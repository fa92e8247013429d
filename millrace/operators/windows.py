"""Window queries, and event-time windows over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.catalog import register
from millrace.sources.tables import table

BY_PRICE = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"


@register(
    "win_rank",
    f"""SELECT o_orderkey, CAST(row_number() {BY_PRICE} AS INTEGER) AS rn, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS dr, CAST(ntile(4) {BY_PRICE} AS INTEGER) AS nt,
        round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""",
)
def win_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    level = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.row_number().over(price).alias("rn"),
        F.rank().over(level).alias("r"),
        F.dense_rank().over(level).alias("dr"),
        F.ntile(4).over(price).alias("nt"),
        F.round(F.percent_rank().over(level), 9).alias("pr"),
        F.round(F.cume_dist().over(level), 9).alias("cd"),
    )


@register(
    "win_offset",
    """SELECT event_id, lag(event_type) OVER w AS before, lead(event_id, 2) OVER w AS later, first_value(event_type) OVER w AS first, nth_value(event_id, 2) OVER f AS second
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts), f AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def win_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.lag("event_type").over(w).alias("before"),
        F.lead("event_id", 2).over(w).alias("later"),
        F.first("event_type").over(w).alias("first"),
        F.nth_value("event_id", 2).over(whole).alias("second"),
    )


@register("win_ignore_nulls", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS signup FROM events")
def win_ignore_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("signup"))


@register("win_rows", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS most FROM orders")
def win_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.max("o_totalprice").over(w).alias("most"))


@register("win_range", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part")
def win_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 5)
    return table(spark, sf_dir, "part").select("p_partkey", F.count(F.lit(1)).over(w).alias("near"))


@register("win_running_agg", "SELECT o_orderkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS spent FROM orders")
def win_running_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    spent = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w).cast("decimal(38,2)")
    return table(spark, sf_dir, "orders").select("o_orderkey", spent.alias("spent"))


@register("win_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def win_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.window("ts", "1 hour").start.cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy(start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@register("win_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * i FOR i IN range(4)]) AS start FROM events) GROUP BY start")
def win_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@register(
    "win_session",
    """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM
       (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
)
def win_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


ORDERED = "OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)"
WHOLE = ORDERED[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def over_orders(name: str, sql: str, value) -> None:
    """One function over each customer's orders, by priority."""

    @register(name, f"SELECT o_orderkey, {sql} AS x FROM orders")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")
        return table(spark, sf_dir, "orders").select("o_orderkey", value(w).alias("x"))


def whole(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


for name, sql, value in (
    ("win_row_number", f"CAST(row_number() {ORDERED} AS INTEGER)", lambda w: F.row_number().over(w)),
    ("win_dense_rank", f"CAST(dense_rank() {ORDERED} AS INTEGER)", lambda w: F.dense_rank().over(w)),
    ("win_ntile", f"CAST(ntile(3) {ORDERED} AS INTEGER)", lambda w: F.ntile(3).over(w)),
    ("win_percent_rank", f"round(percent_rank() {ORDERED}, 9)", lambda w: F.round(F.percent_rank().over(w), 9)),
    ("win_cume_dist", f"round(cume_dist() {ORDERED}, 9)", lambda w: F.round(F.cume_dist().over(w), 9)),
    ("win_lag", f"lag(o_orderstatus, 1, '-') {ORDERED}", lambda w: F.lag("o_orderstatus", 1, "-").over(w)),
    ("win_lead", f"lead(o_orderkey, 2) {ORDERED}", lambda w: F.lead("o_orderkey", 2).over(w)),
    ("win_first", f"first_value(o_orderkey) {ORDERED}", lambda w: F.first("o_orderkey").over(w)),
    ("win_last", f"last_value(o_orderkey) {WHOLE}", lambda w: F.last("o_orderkey").over(whole(w))),
    ("win_nth", f"nth_value(o_orderkey, 2) {WHOLE}", lambda w: F.nth_value("o_orderkey", 2).over(whole(w))),
):
    over_orders(name, sql, value)
