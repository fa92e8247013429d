"""Sketches that are stored and merged: daily ones are written once, and weeks, months and sets are made of them without the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import register
from millrace.sources.scratch import stored
from millrace.sources.tables import table

#: Stated relative errors: three standard deviations of an HLL of 2 ** 12 registers, and of a theta sketch of 2 ** 12 samples.
HLL_ERROR, THETA_ERROR = 0.05, 0.05
#: Rank error of the KLL sketch, whose default size keeps it under two percent.
KLL_ERROR = 0.02


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day and event type: sketches of users (HLL and theta), of values (KLL) and of frequent users; some kilobytes each, whatever the day held."""
    events = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    made = events.groupBy("day", "event_type").agg(
        F.hll_sketch_agg("user_id").alias("hll"),
        F.expr("theta_sketch_agg(user_id, 12)").alias("theta"),
        F.expr("kll_sketch_agg_double(value)").alias("kll"),
        F.expr("approx_top_k_accumulate(event_type, 100)").alias("top"),
        F.count(F.lit(1)).alias("n"),
    )
    return stored(made, "daily-sketches")


def near(estimate, exact, error: float):
    """Whether an estimate lies within a relative error, or within three of a small number."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(3.0), F.lit(error) * exact)


@register("sketch_rollup", "SELECT date_trunc('week', ts)::DATE AS week, count(*) AS n, count(DISTINCT user_id) AS users, true AS hll, true AS theta FROM events GROUP BY ALL")
def sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of a week by the union of its days' sketches, beside the exact number."""
    week = F.date_trunc("week", "day").cast("date").alias("week")
    merged = daily(spark, sf_dir).groupBy(week).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("h"), F.expr("theta_sketch_estimate(theta_union_agg(theta))").alias("t"))
    exact = table(spark, sf_dir, "events").groupBy(F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.count_distinct("user_id").alias("users"))
    return merged.join(exact, "week").select("week", "n", "users", near(F.col("h"), F.col("users"), HLL_ERROR).alias("hll"), near(F.col("t"), F.col("users"), THETA_ERROR).alias("theta"))


@register(
    "sketch_overlap",
    """WITH p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), e AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
       SELECT (SELECT count(*) FROM p SEMI JOIN e USING (user_id)) AS both, (SELECT count(*) FROM p ANTI JOIN e USING (user_id)) AS bought_only, (SELECT count(*) FROM (FROM p UNION FROM e)) AS either, true AS within""",
)
def sketch_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with purchases and errors, with purchases only, and with either, by set operations on merged theta sketches, beside the exact numbers."""
    one = lambda kind: F.expr(f"theta_union_agg(theta) FILTER (WHERE event_type = '{kind}')")
    sets = daily(spark, sf_dir).agg(one("purchase").alias("p"), one("error").alias("e"))
    found = sets.selectExpr("theta_sketch_estimate(theta_intersection(p, e)) AS b", "theta_sketch_estimate(theta_difference(p, e)) AS o", "theta_sketch_estimate(theta_union(p, e)) AS u")
    users = table(spark, sf_dir, "events").where("event_type in ('purchase', 'error')").groupBy("user_id")
    kinds = users.agg(F.bool_or(F.col("event_type") == "purchase").alias("p"), F.bool_or(F.col("event_type") == "error").alias("e"))
    exact = kinds.agg(F.count_if(F.col("p") & F.col("e")).alias("both"), F.count_if(F.col("p") & ~F.col("e")).alias("bought_only"), F.count(F.lit(1)).alias("either"))
    # the error of set operations is relative to the union
    close = [F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(3.0), F.lit(THETA_ERROR) * F.col("either")) for a, b in (("b", "both"), ("o", "bought_only"), ("u", "either"))]
    return exact.crossJoin(F.broadcast(found)).select("both", "bought_only", "either", (close[0] & close[1] & close[2]).alias("within"))  # one row each


@register("sketch_quantiles", "SELECT event_type, count(*) AS n, true AS median, true AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of each type's values from merged daily KLL sketches, checked by counting the rows below them."""
    at = {"median": 0.5, "p95": 0.95}
    merged = daily(spark, sf_dir).groupBy("event_type").agg(F.expr("kll_merge_agg_double(kll)").alias("kll"))
    guesses = merged.select("event_type", *[F.expr(f"kll_sketch_get_quantile_double(kll, {p})").alias(k) for k, p in at.items()])
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL").join(guesses, "event_type")
    below = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("value") < F.col(k)).alias(k) for k in at])
    upto = [F.abs(F.col(k) - F.lit(p) * F.col("n")) <= F.greatest(F.lit(2.0), F.lit(KLL_ERROR) * F.col("n")) for k, p in at.items()]
    return below.select("event_type", "n", *[c.alias(k) for c, k in zip(upto, at)])


@register("sketch_top_k", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def sketch_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent types of the month from the combined daily sketches, exact while they hold more items than there are."""
    top = daily(spark, sf_dir).agg(F.expr("approx_top_k_estimate(approx_top_k_combine(top, 100), 3)").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("event_type"), F.col("t.count").alias("n"))


@register("sketch_bitmap", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def sketch_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct users by bitmaps: one of 4 KB for each bucket of 32,768 ids, which days merge by OR."""
    events = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    bitmaps = events.groupBy("event_type", "day", F.expr("bitmap_bucket_number(user_id)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(user_id))").alias("bits"))
    months = stored(bitmaps, "daily-bitmaps").groupBy("event_type", "bucket").agg(F.expr("bitmap_count(bitmap_or_agg(bits))").alias("users"))
    return months.groupBy("event_type").agg(F.sum("users").alias("users"))
