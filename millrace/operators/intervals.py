"""Joins of intervals with intervals, of any lengths, as equi-joins on bins; and their totals without the pairs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import carried, in_ranges
from millrace.plans.catalog import register
from millrace.sources.scratch import stored
from millrace.sources.tables import table

#: Bits by which the bins of one level are wider than those of the level below.
STEP = 2


def overlapping(left: DataFrame, right: DataFrame, spans: tuple[tuple[str, str], tuple[str, str]], by: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs of rows whose closed intervals share a point, with equal keys; the columns of left and of right.

    spans names the start and end columns of left and of right (whole numbers), by pairs of key columns. An interval's level
    is the lowest whose bins are as wide as it is long, so that it touches two of them at most; a pair meets on the higher of both levels,
    where the shorter interval is entered too, and only in the bin that has the later start. Rows with a
    null bound or key, or with an end before the start, have no pairs. Names of left and right must differ. How many levels there are
    depends on the lengths (at most 32), how often a row is entered on the other side's levels.
    """
    sides = []
    for df, (start, end), key in zip((left, right), spans, ([a for a, _ in by], [b for _, b in by])):
        length = F.col(end) - F.col(start)
        # the number of bits of the length, by steps; a length of n bits fits a bin of 2 ** n
        bits = F.when(length <= 0, 0).otherwise(F.length(F.bin(length)))
        fine = length >= 0
        for c in key:
            fine = fine & F.col(c).isNotNull()
        sides.append(stored(df.where(fine).withColumn("level", F.ceil(bits / STEP).cast("int")), "intervals"))
    a, b = sides
    levels = [sorted(r[0] for r in s.select("level").distinct().collect()) for s in sides]  # at most 32 each
    parts = []
    # the longer interval is at home on its own level, the shorter one is entered there; equal levels count on the left's side
    for home, other, home_span, other_span, targets, lower in ((a, b, *spans, levels[0], F.col("at") >= F.col("level")), (b, a, *spans[::-1], levels[1], F.col("at") > F.col("level"))):
        own = home.withColumn("at", F.col("level")).withColumn("bin", bins(home_span, F.col("level"))).drop("level")
        entered = other.withColumn("at", F.explode(F.array(*[F.lit(x) for x in targets]))) if targets else other.withColumn("at", F.lit(None).cast("int"))
        entered = entered.where(lower).withColumn("bin", bins(other_span, F.col("at"))).drop("level")
        own, entered = own.withColumn("bin", F.explode("bin")), entered.withColumn("bin", F.explode("bin"))
        x, y = (own, entered) if home is a else (entered, own)
        on = (x["at"] == y["at"]) & (x["bin"] == y["bin"])
        for c, d in by:
            on = on & (x[c] == y[d])
        (s, e), (t, f) = spans
        share = (x[s] <= y[f]) & (y[t] <= x[e]) & (bin_of(F.greatest(x[s], y[t]), x["at"]) == x["bin"])
        parts.append(x.join(y, on & share).select(*[x[c] for c in left.columns], *[y[c] for c in right.columns]))
    return parts[0].unionByName(parts[1])


def bin_of(value: Column, level: Column) -> Column:
    """The bin of a value on a level; shifts, so that it is exact below zero too."""
    return F.call_function("shiftright", value.cast("long"), level * STEP)


def bins(span: tuple[str, str], level: Column) -> Column:
    """The bins that an interval touches on a level that isn't below its own: one or two."""
    first, last = bin_of(F.col(span[0]), level), bin_of(F.col(span[1]), level)
    return F.when(first == last, F.array(first)).otherwise(F.array(first, last))


def overlap_totals(left: DataFrame, right: DataFrame, spans: tuple[tuple[str, str], tuple[str, str]], key: str, ranges: int | None = None) -> DataFrame:
    """key, n and shared: for each key of left the pairs of its closed intervals with those of right that share a point, and the sum of what they share; keys without a pair have no row.

    The pairs, which grow with the square of the rows, are not made. The bounds of both sides stand in one order: an interval of left pairs with the
    intervals of right that start by its end, without those that end before its start; and up to a point x the intervals of right have spent, of all time, x for each one that
    is open, less the open ones' starts, plus the ended ones' lengths. Three running sums give both. Rows with a null bound, or with an end before the start, have no pairs.
    """
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    # at one time: starts of left, starts of right, ends of left, ends of right
    bound = lambda side, own, step: lambda c: F.struct(wide(c).alias("at"), F.lit(step).alias("step"), F.col(own).cast(left.schema[key].dataType).alias("own"), F.lit(side).alias("side"))
    parts = []
    for df, (start, end), own, side in ((left, spans[0], key, 0), (right, spans[1], spans[1][0], 1)):
        both = F.array(bound(side, own, side)(start), bound(side, own, side + 2)(end))
        parts.append(df.where(F.col(end) >= F.col(start)).select(F.explode(both).alias("b")).select("b.at", "b.step", F.col("b.own").alias("own"), "b.side"))
    order = [F.col("at"), F.col("step"), F.col("own")]
    ranged = in_ranges(parts[0].unionByName(parts[1]), order, "bounds", ranges)
    sign = F.when(F.col("side") == 0, 0).when(F.col("step") == 1, 1).otherwise(-1)
    values = {"starts": (sign == 1).cast("long"), "ends": (sign == -1).cast("long"), "moment": (sign * F.col("at")).cast("decimal(20,0)")}
    types = {"starts": "long", "ends": "long", "moment": "decimal(38,0)"}
    facts = [F.coalesce(F.sum(v).cast(types[k]), F.lit(0).cast(types[k])).alias(k) for k, v in values.items()]
    before = carried(ranged, facts, (0, 0, Decimal(0)), lambda held, row: tuple(h + row[k] for h, k in zip(held, values)), ", ".join(f"{k}_before {t}" for k, t in types.items()))
    upto = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.join(F.broadcast(before), "range").withColumns({k: F.col(f"{k}_before") + F.sum(v).over(upto).cast(types[k]) for k, v in values.items()})
    spent = F.col("at") * (F.col("starts") - F.col("ends")) - F.col("moment")
    ended = F.col("step") == 2
    each = summed.where("side = 0").groupBy(F.col("own").alias(key))
    found = each.agg(F.sum(F.when(ended, F.col("starts")).otherwise(-F.col("ends"))).alias("n"), F.sum(F.when(ended, spent).otherwise(-spent)).cast("long").alias("shared"))
    return found.where("n > 0")


#: A user's session of one kind of event ends after so many hours without one.
IDLE_HOURS = 60
SESSIONS = f"""
WITH marked AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS us, coalesce(ts - lag(ts) OVER w >= INTERVAL {IDLE_HOURS} HOUR, true) AS new FROM events WHERE event_type IN ('click', 'error') WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
numbered AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id, event_type ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM marked),
sessions AS (SELECT user_id, event_type, min(event_id) AS session, min(us) AS f, max(us) AS t FROM numbered GROUP BY user_id, event_type, s),
c AS (SELECT * FROM sessions WHERE event_type = 'click'), e AS (SELECT * FROM sessions WHERE event_type = 'error')
"""


def sessions(spark: SparkSession, sf_dir: str, kind: str, prefix: str) -> DataFrame:
    """A user's sessions of one kind of event, from the first to the last of it in microseconds; from no time at all to weeks."""
    events = table(spark, sf_dir, "events").where(F.col("event_type") == kind).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    grouped = events.groupBy("user_id", F.session_window("ts", f"{IDLE_HOURS} hours"))
    found = grouped.agg(F.min("event_id").alias("session"), F.min("us").alias("f"), F.max("us").alias("t")).drop("session_window")
    return found.withColumnsRenamed({c: f"{prefix}_{c}" for c in found.columns})


@register("join_intervals", SESSIONS + "SELECT c.session AS click_session, e.session AS error_session FROM c JOIN e ON c.user_id = e.user_id AND c.f <= e.t AND e.f <= c.t")
def join_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of clicks and of errors of one user that overlap."""
    pairs = overlapping(sessions(spark, sf_dir, "click", "c"), sessions(spark, sf_dir, "error", "e"), (("c_f", "c_t"), ("e_f", "e_t")), [("c_user_id", "e_user_id")])
    return pairs.select(F.col("c_session").alias("click_session"), F.col("e_session").alias("error_session"))


@register("join_intervals_all", SESSIONS + "SELECT c.session AS click_session, count(*) AS n, CAST(sum(least(c.t, e.t) - greatest(c.f, e.f)) AS BIGINT) AS shared FROM c JOIN e ON c.f <= e.t AND e.f <= c.t GROUP BY c.session")
def join_intervals_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each session of clicks the sessions of errors, of any user, that it overlaps with: their number and the time in common."""
    found = overlap_totals(sessions(spark, sf_dir, "click", "c"), sessions(spark, sf_dir, "error", "e"), (("c_f", "c_t"), ("e_f", "e_t")), "c_session")
    return found.withColumnRenamed("c_session", "click_session")
