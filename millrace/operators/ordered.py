"""Work in one order over a whole table: running totals, row numbers and as-of joins, without a task that sees all rows.

Rows are dealt to ranges of the order. What a range needs of the rows before it is a few values (a sum, the last row of a side);
those of all ranges, one row each, are carried forward in one small scan and handed back to the ranges.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.catalog import register
from millrace.sources.scratch import stored
from millrace.sources.tables import table


def in_ranges(rows: DataFrame, order: list[Column], name: str, ranges: int | None = None) -> DataFrame:
    """rows with range, which rises with the order; stored, so that it stays as it is.

    Rows that are equal in the order may stand in different ranges only if Spark's own range partitioning puts them there, which
    it doesn't, so the order should end with columns that tell rows apart.
    """
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    return stored(dealt.withColumn("range", F.spark_partition_id()), name)


def carried(ranged: DataFrame, facts: list[Column], start: tuple, step: Callable[[tuple, Row], tuple], schema: T.StructType | str) -> DataFrame:
    """range and what the ranges before it leave: a scan of one row of facts for each range, of which there are as many as partitions."""
    found = ranged.groupBy("range").agg(*facts).collect()
    out, held = [], start
    for row in sorted(found, key=lambda r: r["range"]):
        out.append((row["range"], *held))
        held = step(held, row)
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return ranged.sparkSession.createDataFrame(out, T.StructType([T.StructField("range", T.IntegerType()), *fields.fields]))


def running(rows: DataFrame, order: list[Column], value: str, total: str = "total", number: str = "number", ranges: int | None = None) -> DataFrame:
    """rows with the running sum of value (exact numbers; nulls add nothing) and the row's number, from 1, in the order of the whole table.

    The order has to tell rows apart. An empty table gives no rows.
    """
    kind = rows.select(F.sum(F.col(value))).schema[0].dataType
    ranged = in_ranges(rows, order, "running", ranges)
    facts = [F.coalesce(F.sum(value), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("n")]
    none = Decimal(0) if isinstance(kind, T.DecimalType) else 0
    before = carried(ranged, facts, (none, 0), lambda held, row: (held[0] + row["s"], held[1] + row["n"]), T.StructType([T.StructField("sum_before", T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else kind), T.StructField("rows_before", T.LongType())]))
    here = Window.partitionBy("range").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(F.broadcast(before), "range")
    out = joined.withColumn(total, (F.col("sum_before") + F.coalesce(F.sum(value).over(upto), F.lit(0))).cast(kind)).withColumn(number, F.col("rows_before") + F.row_number().over(here))
    return out.drop("range", "sum_before", "rows_before")


def asof(left: DataFrame, right: DataFrame, at: tuple[str, str], tie: str, by: list[tuple[str, str]] = (), ranges: int | None = None) -> DataFrame:
    """left with right's other columns from its last row whose time isn't after the left row's, and with equal keys; null where there is none.

    at names the two time columns, by pairs of key columns (none: by time alone), tie a column of right: of right rows with one
    time the one with the largest tie counts. Rows of left with a null time or key have no match, rows of right with one are none. Names of
    left and right must differ. Both sides are dealt by key and time together, so one key with most of the rows, or no key at
    all, is as many ranges as it needs.
    """
    keys = [f"k{k}" for k in range(len(by))]
    taken = [c for c in right.columns if c not in [r for _, r in by]]
    row = F.struct(*[F.col(f"`{c}`") for c in taken])
    left_keys, right_keys = [F.col(f"`{a}`").alias(k) for (a, _), k in zip(by, keys)], [F.col(f"`{b}`").alias(k) for (_, b), k in zip(by, keys)]
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    first = right.where(F.col(at[1]).isNotNull()).select(*right_keys, F.col(at[1]).alias("t"), F.lit(0).alias("side"), F.col(tie).alias("tie"), F.lit(0).cast("long").alias("own"), row.alias("r"))
    second = left.select(*left_keys, F.col(at[0]).alias("t"), F.lit(1).alias("side"), F.lit(None).alias("tie"), F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]).alias("own"), whole.alias("l"))
    both = first.unionByName(second, allowMissingColumns=True)
    order = [*[F.col(k) for k in keys], F.col("t"), F.col("side"), F.col("tie"), F.col("own")]
    ranged = in_ranges(both, order, "asof", ranges)
    # the last right row of a range, with its key, is all that later ranges need of it
    last = F.max_by(F.struct(*keys, "r"), F.when(F.col("side") == 0, F.struct(*keys, "t", "side", "tie"))).alias("last")
    schema = ranged.groupBy("range").agg(last).schema["last"].dataType
    before = carried(ranged, [last], (None,), lambda held, found: (found["last"],) if found["last"] is not None else held, T.StructType([T.StructField("before", schema)]))
    upto = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = F.last(F.when(F.col("side") == 0, F.struct(*keys, "r")), ignorenulls=True).over(upto)
    met = ranged.join(F.broadcast(before), "range").withColumn("met", F.coalesce(here, F.col("before"))).where("side = 1")
    equal = F.col("t").isNotNull() & F.col("met").isNotNull()
    for k in keys:
        equal = equal & (F.col(k) == F.col(f"met.{k}"))
    found = F.when(F.coalesce(equal, F.lit(False)), F.col("met.r"))
    return met.select("l.*", found.alias("found")).select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"found.`{c}`").alias(c) for c in taken])


@register("win_running_total", "SELECT o_orderkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (ORDER BY o_orderdate, o_orderkey) AS total, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def win_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue up to each order, over all orders in time."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return running(orders, [F.col("o_orderdate"), F.col("o_orderkey")], "price").select("o_orderkey", F.col("total").cast("decimal(38,2)").alias("total"), "number")


def purchases_and_clicks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select(F.col("user_id").alias("click_user"), F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks


@register(
    "join_asof",
    """SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""",
)
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's latest click at or before it; of clicks at one time the one with the largest id."""
    purchases, clicks = purchases_and_clicks(spark, sf_dir)
    return asof(purchases, clicks, ("ts", "click_ts"), "click_id", [("user_id", "click_user")]).select("event_id", "click_id")


#: Days between the events and the orders that are matched with them, which end earlier.
SHIFT = 9_500


@register(
    "join_asof_time",
    f"""SELECT event_id, e.ts, o.day, o.orders, o.last_order FROM (SELECT event_id, ts - INTERVAL {SHIFT} DAY AS ts FROM events) e
        ASOF LEFT JOIN (SELECT o_orderdate AS day, count(*) AS orders, max(o_orderkey) AS last_order FROM orders GROUP BY o_orderdate) o ON e.ts >= o.day""",
)
def join_asof_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last day of orders at or before it, by time alone."""
    events = table(spark, sf_dir, "events").select("event_id", (F.col("ts") - F.expr(f"INTERVAL {SHIFT} DAY")).alias("ts"))
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderkey").alias("last_order"))
    return asof(events, days, ("ts", "day"), "last_order")


@register(
    "join_asof_forward",
    """SELECT e.event_id, s.event_id AS next_signup FROM (SELECT * FROM events WHERE event_type = 'error') e
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.ts <= s.ts""",
)
def join_asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the next signup of any user: an as-of join in the time that runs back."""
    back = lambda kind: table(spark, sf_dir, "events").where(f"event_type = '{kind}'").select("event_id", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("back"))
    signups = back("signup").withColumnsRenamed({"event_id": "next_signup", "back": "signup_back"})
    return asof(back("error"), signups, ("back", "signup_back"), "next_signup").select("event_id", "next_signup")
