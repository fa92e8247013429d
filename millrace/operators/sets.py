"""Set and bag operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import register
from millrace.sources.tables import table

A, B = "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49", "SELECT l_suppkey AS k FROM lineitem WHERE l_discount < 0.01 AND l_suppkey % 3 > 0"


def keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines, k = table(spark, sf_dir, "lineitem"), F.col("l_suppkey").alias("k")
    return lines.where("l_quantity > 49").select(k), lines.where("l_discount < 0.01 and l_suppkey % 3 > 0").select(k)


def both(name: str, sql: str, how) -> None:
    register(name, f"({A}) {sql} ({B})")(lambda spark, sf_dir: how(*keys(spark, sf_dir)))


both("union_all", "UNION ALL", DataFrame.unionAll)
both("union", "UNION", lambda a, b: a.union(b).distinct())
both("intersect", "INTERSECT", DataFrame.intersect)
both("intersect_all", "INTERSECT ALL", DataFrame.intersectAll)
both("except", "EXCEPT", DataFrame.subtract)
both("except_all", "EXCEPT ALL", DataFrame.exceptAll)


@register("union_by_name", "SELECT s_suppkey AS k, s_name AS name, NULL::DOUBLE AS balance FROM supplier UNION ALL BY NAME SELECT c_acctbal AS balance, c_custkey AS k FROM customer")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("k"))
    return suppliers.unionByName(customers, allowMissingColumns=True)
