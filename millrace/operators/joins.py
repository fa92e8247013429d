"""Join and subquery queries.

Sides are broadcast where their size is fixed by the data model (nations, regions);
all other choices are left to the optimiser and to AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import register
from millrace.sources.tables import table


@register("join_inner", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_orderkey", "l_partkey")
    return orders, lines


SIDES = "(SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 300000) o {} JOIN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 40) l ON o_orderkey = l_orderkey"


def outer(kind: str):
    @register(f"join_{kind}", f"SELECT o_orderkey, o_orderstatus, l_orderkey, l_partkey FROM {SIDES.format(kind.upper())}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders, lines = sides(spark, sf_dir)
        return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), kind)

    return query


for kind in ("left", "right", "full"):
    outer(kind)


@register("join_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 48")
    return table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@register("join_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@register("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("a"), F.col("n_regionkey").alias("ra"), F.col("n_nationkey").alias("ka"))
    b = table(spark, sf_dir, "nation").select(F.col("n_name").alias("b"), F.col("n_regionkey").alias("rb"), F.col("n_nationkey").alias("kb"))
    return a.join(b, (F.col("ra") == F.col("rb")) & (F.col("ka") < F.col("kb"))).select("a", "b")


@register("join_sortmerge", "SELECT o_orderstatus, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus")
def join_sortmerge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").hint("merge")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


HOUR, BIN = 3600, 600


@register(
    "join_range",
    """SELECT e.event_id AS error_id, s.event_id AS signup_id FROM events e JOIN events s ON s.ts <= e.ts AND e.ts < s.ts + INTERVAL 1 HOUR
       WHERE e.event_type = 'error' AND s.event_type = 'signup'""",
)
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups up to an hour before an error: an equi-join on bins of ten minutes, each signup in all bins that its hour reaches, then the range itself.

    Errors are the right side, whose rows of one bin a merge join keeps at hand: they stand in one bin each, so these are few.
    """
    events = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    bin_of = lambda at: F.floor(at / (BIN * 1_000_000))
    until = F.col("s") + HOUR * 1_000_000
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("s").alias("at"), bin_of(F.col("s")).alias("bin"))
    signups = events.where("event_type = 'signup'").select(F.col("event_id").alias("signup_id"), F.col("s").alias("from"), F.explode(F.sequence(bin_of(F.col("s")), bin_of(until))).alias("bin"))
    inside = (F.col("from") <= F.col("at")) & (F.col("at") < F.col("from") + HOUR * 1_000_000)
    return signups.join(errors.hint("merge"), "bin").where(inside).select("error_id", "signup_id")


@register("join_lateral", "SELECT n_name, c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2)")
def join_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "SELECT n_name, c_custkey FROM {nation}, LATERAL (SELECT c_custkey FROM {customer} WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2)",
        nation=table(spark, sf_dir, "nation"),
        customer=table(spark, sf_dir, "customer"),
    )


@register("subquery_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def subquery_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.where(F.col("o_totalprice") > orders.select(F.avg("o_totalprice") * 1.5).scalar()).select("o_orderkey")


def not_in(rows: DataFrame, key: str, values: DataFrame, value: str) -> DataFrame:
    """SQL's NOT IN, nulls included, as a join by key instead of one that broadcasts all values.

    A null among the values lets no row through; a null key passes only if there are no values.
    """
    facts = values.agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col(value).isNull()).alias("__nulls"))  # one row
    left = rows.join(values.where(F.col(value).isNotNull()), F.col(key) == F.col(value), "left_anti").crossJoin(F.broadcast(facts))
    return left.where((F.col("__nulls") == 0) & (F.col(key).isNotNull() | (F.col("__n") == 0))).select(*rows.columns)


@register(
    "subquery_notin",
    """SELECT 'plain' AS kind, k FROM (SELECT nullif(c_custkey, 7) AS k FROM customer) WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)
       UNION ALL SELECT 'null', k FROM (SELECT nullif(c_custkey, 7) AS k FROM customer) WHERE k NOT IN (SELECT CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_custkey END FROM orders WHERE o_totalprice > 250000)
       UNION ALL SELECT 'none', k FROM (SELECT nullif(c_custkey, 7) AS k FROM customer) WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 0)""",
)
def subquery_notin(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.nullif(F.col("c_custkey"), F.lit(7)).alias("k"))
    orders = table(spark, sf_dir, "orders")
    dear = orders.where("o_totalprice > 250000")
    cases = {"plain": dear.select("o_custkey"), "null": dear.select(F.when(F.col("o_totalprice") <= 400000, F.col("o_custkey")).alias("o_custkey")), "none": orders.where("o_totalprice < 0").select("o_custkey")}
    parts = [not_in(customers, "k", values, "o_custkey").select(F.lit(kind).alias("kind"), "k") for kind, values in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides have a size that the data model fixes."""
    return table(spark, sf_dir, "region").select("r_name").crossJoin(F.broadcast(table(spark, sf_dir, "nation").select("n_name")))


def hinted(name: str, hint: str) -> None:
    """Line items of each nation's suppliers, with the join strategy asked for."""

    @register(name, "SELECT s_nationkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").hint(hint)
        joined = table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        return joined.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


hinted("join_broadcast", "broadcast")
hinted("join_shufflehash", "shuffle_hash")


@register("subquery_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def subquery_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("customer", "orders")}
    return spark.sql("SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)", **t)
