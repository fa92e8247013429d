"""Grouped aggregation queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.quantiles import exact_quantiles
from millrace.plans.catalog import register
from millrace.sources.tables import table


@register(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty,
              CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DECIMAL(28, 4)) AS revenue
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    revenue = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sum_qty"), F.sum(revenue).cast("decimal(28,4)").alias("revenue")
    )


@register(
    "agg_basic",
    "SELECT l_returnflag, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag HAVING count(*) > 10",
)
def agg_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.round(F.avg("l_quantity"), 6).alias("mean")).where("n > 10")


@register("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL")
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@register(
    "agg_filter",
    "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY o_orderpriority",
)
def agg_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))


@register("agg_stats", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var, round(corr(l_quantity, l_discount), 6) AS r, round(covar_pop(l_quantity, l_tax), 6) AS cov FROM lineitem GROUP BY l_returnflag")
def agg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = {"sd": F.stddev_samp("l_quantity"), "var": F.var_pop("l_quantity"), "r": F.corr("l_quantity", "l_discount"), "cov": F.covar_pop("l_quantity", "l_tax")}
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.round(v, 6).alias(k) for k, v in rounded.items()])


@register(
    "agg_regression",
    """SELECT l_returnflag, regr_count(l_extendedprice, l_quantity) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
       round(regr_avgx(l_extendedprice, l_quantity), 6) AS mean_x, round(regr_avgy(l_extendedprice, l_quantity), 4) AS mean_y FROM lineitem GROUP BY l_returnflag""",
)
def agg_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = {"slope": 4, "intercept": 3, "r2": 6, "mean_x": 6, "mean_y": 4}
    functions = {"slope": F.regr_slope, "intercept": F.regr_intercept, "r2": F.regr_r2, "mean_x": F.regr_avgx, "mean_y": F.regr_avgy}
    price = ("l_extendedprice", "l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.regr_count(*price).alias("n"), *[F.round(f(*price), digits[k]).alias(k) for k, f in functions.items()])


@register("agg_collect_list", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def agg_collect_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders in time, sorted after they are collected, as a shuffle leaves no order."""
    dated = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(dated, lambda o: o["o_orderkey"]).alias("orders"))


@register("agg_argminmax", "SELECT user_id, arg_max(event_type, ts) AS last_type, arg_min(event_type, ts) AS first_type FROM events GROUP BY user_id")
def agg_argminmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("last_type"), F.min_by("event_type", "ts").alias("first_type"))


@register("agg_collect", "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def agg_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@register("agg_bool_bit", "SELECT o_orderstatus, bool_and(o_totalprice > 0) AS all_paid, bool_or(o_totalprice > 400000) AS any_large, bit_xor(o_custkey) AS keys_xor, bit_and(o_custkey | 64) AS keys_and, bit_or(o_custkey) AS keys_or FROM orders GROUP BY o_orderstatus")
def agg_bool_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "orders").groupBy("o_orderstatus")
    return grouped.agg(F.bool_and(F.col("o_totalprice") > 0).alias("all_paid"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_large"), F.bit_xor("o_custkey").alias("keys_xor"), F.bit_and(F.col("o_custkey").bitwiseOR(F.lit(64))).alias("keys_and"), F.bit_or("o_custkey").alias("keys_or"))


@register("agg_rollup", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INTEGER) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("int").alias("g"), F.count(F.lit(1)).alias("n"))


@register("agg_cube", "SELECT p_brand, p_type, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY CUBE (p_brand, p_type)")
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").cube("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"))


@register("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").groupingSets([(status,), (priority,), ()], status, priority).agg(F.count(F.lit(1)).alias("n"))


@register("agg_approx_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS hllpp, true AS hll, true AS theta FROM lineitem GROUP BY l_returnflag")
def agg_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact number, and whether each sketch's estimate lies within 5 % of it.

    The exact numbers are a grouping of their own: count_distinct beside the sketches would have Spark keep a buffer of each sketch for every
    pair of a flag and a part before it merges them.
    """
    sketches = {"hllpp": F.approx_count_distinct("l_partkey", 0.01), "hll": F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")), "theta": F.expr("theta_sketch_estimate(theta_sketch_agg(l_partkey))")}
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey")
    exact = lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    guesses = lines.groupBy(F.col("l_returnflag").alias("flag")).agg(*[v.alias(k) for k, v in sketches.items()])
    found = exact.join(guesses, F.col("l_returnflag").eqNullSafe(F.col("flag")))
    return found.select("l_returnflag", "exact", *[(F.abs(F.col(k) - F.col("exact")) <= 0.05 * F.col("exact")).alias(k) for k in sketches])


@register("agg_approx_quantile", "SELECT l_returnflag, count(*) AS n, round(median(l_extendedprice), 6) AS exact, true AS gk, true AS kll FROM lineitem GROUP BY l_returnflag")
def agg_approx_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact median, and whether each sketch's median has between 47 and 53 % of the rows below it, by counting them in a second pass."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x"))
    sketches = lines.groupBy(F.col("l_returnflag").alias("flag")).agg(F.percentile_approx("x", 0.5, 1000).alias("gk"), F.expr("kll_sketch_get_quantile_double(kll_sketch_agg_double(x), 0.5)").alias("kll"))
    medians = exact_quantiles(lines, ["l_returnflag"], "x", [0.5]).select(F.col("l_returnflag").alias("flag"), F.round(F.get("q", F.lit(0)), 6).alias("exact"))
    below = {k: F.count_if(F.col("x") < F.col(k)) for k in ("gk", "kll")}
    of_flag = F.col("l_returnflag").eqNullSafe(F.col("flag"))
    # one row for each of the model's return flags
    counted = lines.join(F.broadcast(sketches), of_flag).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in below.items()])
    return counted.join(F.broadcast(medians), of_flag).select("l_returnflag", "n", "exact", *[F.col(k).between(0.47 * F.col("n"), 0.53 * F.col("n")).alias(k) for k in below])


@register(
    "market_share",
    """SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DECIMAL(28, 4)) AS revenue
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name""",
)
def market_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").where("o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1998-01-01'")
    lines = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    local = lines.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    revenue = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    # aggregated by key before the names are joined
    by_key = local.groupBy("s_nationkey").agg(F.sum(revenue).alias("r"))
    return by_key.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("r").cast("decimal(28,4)").alias("revenue"))


@register("agg_mode", "SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def agg_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties go to the smallest value."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.mode("event_type", True).alias("event_type"))


@register("agg_listagg", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
def agg_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT n_regionkey, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM {nation} GROUP BY n_regionkey", nation=table(spark, sf_dir, "nation"))


@register(
    "agg_moments",
    """SELECT o_orderstatus, round((avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * avg(x) ** 3) / (avg(x * x) - avg(x) ** 2) ** 1.5, 6) AS skew, round(kurtosis_pop(x), 6) AS kurt
       FROM (SELECT o_orderstatus, o_totalprice / 100000 AS x FROM orders) GROUP BY o_orderstatus""",
)
def agg_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of the population."""
    rows = table(spark, sf_dir, "orders").withColumn("x", F.col("o_totalprice") / 100000)
    return rows.groupBy("o_orderstatus").agg(F.round(F.skewness("x"), 6).alias("skew"), F.round(F.kurtosis("x"), 6).alias("kurt"))


@register("agg_topk_sketch", "SELECT event_type AS item, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, item LIMIT 3")
def agg_topk_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent items by a sketch of bounded size; it is exact while it holds more items than there are."""
    top = table(spark, sf_dir, "events").agg(F.expr("approx_top_k(event_type, 3, 100)").alias("top"))
    return top.select(F.explode("top").alias("t")).select("t.item", F.col("t.count").alias("n"))


@register("agg_cms", "SELECT event_type, count(*) AS n, true AS within FROM events GROUP BY event_type")
def agg_cms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cms_within(table(spark, sf_dir, "events"), "event_type").drop("not_below")


@register("agg_cms_users", "SELECT user_id, count(*) AS n, true AS not_below FROM events GROUP BY user_id")
def agg_cms_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key for each user, however many: no estimate is below the number. That it isn't far above holds for most keys only, as a test checks."""
    return cms_within(table(spark, sf_dir, "events"), "user_id").drop("within")


#: Multipliers of the rows of the count-min sketch.
CMS_SEEDS = (11, 13, 17, 19, 23, 29, 31)


def cms_within(rows: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """Each key's number n, whether its estimate from a count-min sketch is not below it (it never is), and whether it is within e / width of all rows above it.

    The latter fails for a key with probability e ** -len(CMS_SEEDS).

    The sketch is a table of len(CMS_SEEDS) x width counters at most, added up per task before it is shuffled; every key reads its
    counters from it by a join with that table, whose size the parameters fix. Null keys are a key.
    """
    cells = F.array(*[F.struct(F.lit(s).alias("seed"), F.pmod(F.xxhash64(F.lit(s), F.col(key).cast("string")), F.lit(width)).cast("int").alias("cell")) for s in CMS_SEEDS])
    each = lambda df, *columns: df.select(*columns, F.explode(cells).alias("at")).select(*columns, "at.*")
    exact = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sketch = each(rows, F.lit(1).alias("one")).groupBy("seed", "cell").agg(F.count(F.lit(1)).alias("held"))
    estimates = each(exact, key, "n").join(F.broadcast(sketch), ["seed", "cell"]).groupBy(key, "n").agg(F.min("held").alias("estimate"))
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))  # one row
    return estimates.crossJoin(total).select(key, "n", (F.col("estimate") >= F.col("n")).alias("not_below"), F.col("estimate").between(F.col("n"), F.col("n") + F.lit(math.e / width) * F.col("total")).alias("within"))


@register("agg_histogram", "SELECT l_returnflag, count(*) AS n, true AS rising FROM lineitem GROUP BY l_returnflag")
def agg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five bins of a numeric histogram: their heights sum to the rows, and their centres rise within the range."""
    bins = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.histogram_numeric("l_quantity", F.lit(5)).alias("bins"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))
    centres = F.transform("bins", lambda b: b["x"])
    rising = (F.array_sort(centres) == centres) & (F.element_at(centres, 1) >= F.col("least")) & (F.element_at(centres, -1) <= F.col("most")) & (F.size("bins") <= 5)
    return bins.select("l_returnflag", F.aggregate("bins", F.lit(0.0), lambda s, b: s + b["y"]).cast("long").alias("n"), rising.alias("rising"))
