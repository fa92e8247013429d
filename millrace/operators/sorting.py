"""Sort, limit and top-k queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.catalog import register
from millrace.sources.tables import table


@register("sort_nulls", "SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders ORDER BY p DESC NULLS LAST, o_orderkey")
def sort_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT"))
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")).orderBy(F.desc_nulls_last("p"), "o_orderkey")


@register("limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
def limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").offset(10).limit(20)


@register("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@register("topk_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    # the filter on row_number becomes a limit for each group before the shuffle
    return table(spark, sf_dir, "customer").withColumn("rn", best).where("rn <= 3").select("c_nationkey", "c_custkey", "c_acctbal")


@register("sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@register("limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").limit(25)


@register("offset", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 7")
def offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").offset(7)
