"""Exact order statistics of groups of any size, by distributed selection.

No task holds a group: each rank that is asked for has an interval of values that contains it. A sketch of the interval's
rows proposes two values around the rank, exact counts of the rows below, at, between and above them tell in which of these cells
it lies, and that cell is the next interval. When no interval has more than a bounded number of rows, they are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.catalog import register
from millrace.sources.scratch import stored
from millrace.sources.tables import table

#: Rows of an interval that are ranked in one task; groups up to this size need no narrowing.
RANKED = 10_000
#: Cuts of a sketch; an interval keeps about three parts of so many.
CUTS = 256
#: Intervals that are broadcast to the rows; beyond that they are joined by group.
BROADCAST_ROWS = 100_000


def exact_quantiles(rows: DataFrame, by: list[str], value: str, fractions: list[float], ranked: int = RANKED) -> DataFrame:
    """One row per group: the columns of by, n (values that count) and q, an array with a quantile for each fraction.

    Quantiles are interpolated between the two values around fraction * (n - 1), as percentile_cont does. Values are
    taken as doubles; nulls don't count, NaN is the largest value. A group without values has n 0 and null quantiles;
    null group keys are a group. Without by, all rows are one group, and an empty table gives one row then, none otherwise.
    """
    keys = [f"g{k}" for k in range(len(by))]
    v = rows.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], F.col(f"`{value}`").cast("double").alias("x"))
    sizes = stored(v.groupBy(*keys).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "quantile-sizes")
    v = v.where(F.col("x").isNotNull())
    place = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for j, p in enumerate(fractions)]))
    places = sizes.where("n > 0").select(*keys, "n", "lo", "hi", place.alias("p")).select(*keys, "n", "lo", "hi", "p.j", "p.at")
    ranks = places.select(*keys, "n", "lo", "hi", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    # rank is the one in the group, k the one among the m rows of the interval from lo to hi
    targets = stored(ranks.select(*keys, "rank", F.col("rank").alias("k"), F.col("n").alias("m"), "lo", "hi"), "quantile-ranks")
    open_now = (F.col("m") > ranked) & (F.col("lo") < F.col("hi"))
    while targets.where(open_now).limit(1).count():
        closed, wide = targets.where(~open_now), targets.where(open_now)
        targets = stored(closed.unionByName(narrowed(v, wide, keys, 2 * len(fractions))), "quantile-ranks")
    known = targets.where("lo = hi").select(*keys, "rank", F.col("lo").alias("x"))
    found = known.unionByName(picked(v, targets.where("lo < hi"), keys))
    return interpolated(sizes, places, found, keys, len(fractions)).select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "n", "q")


def same(left: list[Column], right: list[Column]) -> Column:
    """Equality of keys, nulls included."""
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & a.eqNullSafe(b)
    return out


def inside(v: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """The values of v that lie in an interval (keys, lo, hi and more) of their group, with the interval's columns."""
    names = {k: f"i_{k}" for k in keys}
    intervals = intervals.withColumnsRenamed(names)
    if intervals.count() <= BROADCAST_ROWS:
        intervals = F.broadcast(intervals)
    on = same([F.col(k) for k in keys], [F.col(n) for n in names.values()]) & F.col("x").between(F.col("lo"), F.col("hi"))
    return v.join(intervals, on).drop(*names.values())


def narrowed(v: DataFrame, targets: DataFrame, keys: list[str], most: int) -> DataFrame:
    """targets with smaller intervals: the one of up to 2 * most + 1 cells that has the rank."""
    span = [*keys, "lo", "hi"]
    cuts = F.percentile_approx("x", F.array(*[F.lit(c / CUTS) for c in range(CUTS + 1)]), F.lit(8 * CUTS))
    sketches = inside(v, targets.select(*span).distinct(), keys).groupBy(*span).agg(cuts.alias("cuts"))
    sketches = stored(sketches, "quantile-cuts").withColumnsRenamed({c: f"s_{c}" for c in span})
    both = targets.join(sketches, same([F.col(c) for c in span], [F.col(f"s_{c}") for c in span])).drop(*[f"s_{c}" for c in span])
    at = F.floor(F.col("k") / F.col("m") * CUTS).cast("int")
    around = F.array(F.get("cuts", F.greatest(at - 1, F.lit(0))), F.get("cuts", F.least(at + 2, F.lit(CUTS))))
    points = both.select(*span, F.explode(around).alias("cut")).groupBy(*span).agg(F.array_sort(F.collect_set("cut")).alias("points"))
    rows = inside(v, stored(points, "quantile-points"), keys)
    # even cells lie between points, odd ones are a point
    cell = sum((F.when(F.col("x") > F.get("points", F.lit(j)), 2).when(F.col("x") == F.get("points", F.lit(j)), 1).otherwise(0) for j in range(2 * most)), F.lit(0))
    cells = rows.groupBy(*span, cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))
    upto = F.sum("c").over(Window.partitionBy(*span).orderBy("cell"))  # at most 4 * most + 1 cells
    cells = cells.withColumn("before", upto - F.col("c")).withColumnsRenamed({c: f"s_{c}" for c in span})
    has = (F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("c"))
    met = targets.join(cells, same([F.col(c) for c in span], [F.col(f"s_{c}") for c in span]) & has)
    return met.select(*keys, "rank", (F.col("k") - F.col("before")).alias("k"), F.col("c").alias("m"), F.col("least").alias("lo"), F.col("most").alias("hi"))


def picked(v: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rank, x of targets whose intervals are small enough to be ranked."""
    span = [*keys, "lo", "hi"]
    rows = inside(v, targets.select(*span).distinct(), keys)
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy(*span).orderBy("x")) - 1).withColumnsRenamed({c: f"s_{c}" for c in span})
    on = same([F.col(c) for c in span], [F.col(f"s_{c}") for c in span]) & (F.col("at") == F.col("k"))
    return targets.join(numbered, on).select(*keys, "rank", "x")


def interpolated(sizes: DataFrame, places: DataFrame, found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, n and the quantiles in the order of the fractions."""
    for side, rank in (("below", F.floor("at")), ("above", F.ceil("at"))):
        values = found.withColumnsRenamed({**{k: f"f_{k}" for k in keys}, "x": side, "rank": "f_rank"})
        places = places.join(values, same([F.col(k) for k in keys], [F.col(f"f_{k}") for k in keys]) & (rank == F.col("f_rank"))).drop("f_rank", *[f"f_{k}" for k in keys])
    part = F.col("at") - F.floor("at")
    value = F.when((part == 0) | (F.col("below") == F.col("above")), F.col("below")).otherwise(F.col("below") + (F.col("above") - F.col("below")) * part)
    values = places.groupBy(*keys).agg(F.array(*[F.max(F.when(F.col("j") == j, value)) for j in range(n)]).alias("q"))
    values = values.withColumnsRenamed({k: f"f_{k}" for k in keys})
    return sizes.join(values, same([F.col(k) for k in keys], [F.col(f"f_{k}") for k in keys]), "left").select(*keys, "n", F.coalesce("q", F.array_repeat(F.lit(None).cast("double"), n)).alias("q"))


@register("agg_percentile", "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(median(c_acctbal), 6) AS q2, round(quantile_cont(c_acctbal, 0.9), 6) AS q9 FROM customer GROUP BY c_mktsegment")
def agg_percentile(spark, sf_dir: str) -> DataFrame:
    found = exact_quantiles(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", [0.25, 0.5, 0.9])
    return found.select("c_mktsegment", *[F.round(F.get("q", F.lit(j)), 6).alias(name) for j, name in enumerate(("q1", "q2", "q9"))])


@register("agg_percentile_lines", "SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.01), 6) AS q01, round(median(l_extendedprice), 6) AS q50, round(quantile_cont(l_extendedprice, 0.999), 6) AS q999 FROM lineitem GROUP BY l_returnflag")
def agg_percentile_lines(spark, sf_dir: str) -> DataFrame:
    """Three groups that hold all line items: their intervals are narrowed before anything is ranked."""
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.01, 0.5, 0.999], ranked=1_000)
    return found.select("l_returnflag", "n", *[F.round(F.get("q", F.lit(j)), 6).alias(name) for j, name in enumerate(("q01", "q50", "q999"))])


@register("agg_median", "SELECT l_returnflag, median(l_quantity) AS mid FROM lineitem GROUP BY l_returnflag")
def agg_median(spark, sf_dir: str) -> DataFrame:
    """Many ties: a cell of one value needs no ranking."""
    return exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", [0.5]).select("l_returnflag", F.get("q", F.lit(0)).alias("mid"))


@register("agg_percentile_all", "SELECT count(*) AS n, round(quantile_cont(o_totalprice, 0.1), 6) AS low, round(quantile_cont(o_totalprice, 0.75), 6) AS high FROM orders")
def agg_percentile_all(spark, sf_dir: str) -> DataFrame:
    """The whole table as one group."""
    found = exact_quantiles(table(spark, sf_dir, "orders"), [], "o_totalprice", [0.1, 0.75])
    return found.select("n", F.round(F.get("q", F.lit(0)), 6).alias("low"), F.round(F.get("q", F.lit(1)), 6).alias("high"))
