"""Projection, filter and reshape queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import register
from millrace.sources.tables import table


@register("project", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, lower(l_returnflag) AS flag FROM lineitem")
def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("twice"), F.lower("l_returnflag").alias("flag"))


@register("with_columns", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, split_part(o_orderpriority, '-', 1) AS level FROM orders")
def with_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"y": F.year("o_orderdate"), "m": F.month("o_orderdate"), "level": F.split_part("o_orderpriority", F.lit("-"), F.lit(1))}
    return table(spark, sf_dir, "orders").withColumns(made).select("o_orderkey", *made)


@register("filter_cmp", "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02 AND l_returnflag <> 'R'")
def filter_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = (F.col("l_quantity") > 45) & (F.col("l_discount") < 0.02) & (F.col("l_returnflag") != "R")
    return table(spark, sf_dir, "lineitem").where(kept).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


@register("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_size").between(10, 20)).select("p_partkey", "p_size")


@register("filter_in", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (1, 3, 5, 7)")
def filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.col("c_nationkey").isin(1, 3, 5, 7)).select("c_custkey", "c_nationkey")


@register("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e%' AND regexp_matches(p_type, '^[A-M]')")
def filter_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_name").like("%e%") & F.col("p_type").rlike("^[A-M]")).select("p_partkey", "p_name")


@register("filter_null", "SELECT o_orderkey, x FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS x FROM orders) WHERE x IS NULL OR x IS NOT DISTINCT FROM 'P'")
def filter_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.nullif(F.col("o_orderstatus"), F.lit("F"))
    return table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x")).where(F.col("x").isNull() | F.col("x").eqNullSafe("P"))


@register("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class FROM part")
def case_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(size < 10, "small").when(size < 30, "medium").otherwise("large").alias("class"))


@register("coalesce", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), o_orderpriority) AS x FROM orders")
def coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("O")), F.col("o_orderpriority")).alias("x"))


@register("distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@register("drop_duplicates", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").dropDuplicates(["l_partkey", "l_suppkey"])


@register("pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the values are named, so no job runs to find them
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@register("unpivot", "SELECT l_orderkey, 'l_discount' AS name, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, 'l_tax', l_tax FROM lineitem")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").unpivot("l_orderkey", ["l_discount", "l_tax"], "name", "value")


@register("explode", "SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark")
def explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("word"))


@register("posexplode", "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
def posexplode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


@register("pipe_sql", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def pipe_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("FROM {orders} |> WHERE o_orderstatus = 'F' |> AGGREGATE count(*) AS n GROUP BY o_orderpriority", orders=table(spark, sf_dir, "orders"))


@register("sample")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample is the feature here: a tenth of the orders, by a fixed seed."""
    return table(spark, sf_dir, "orders").sample(0.1, seed=42)


@register("inline", "SELECT n_nationkey, unnest(['key', 'region']) AS name, unnest([n_nationkey, n_regionkey]) AS value FROM nation")
def inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda name, c: F.struct(F.lit(name).alias("name"), F.col(c).alias("value"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.inline(F.array(pair("key", "n_nationkey"), pair("region", "n_regionkey"))))


@register("stack", "SELECT r_regionkey, unnest(['name', 'upper']) AS kind, unnest([r_name, upper(r_name)]) AS text FROM region")
def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", F.stack(F.lit(2), F.lit("name"), F.col("r_name"), F.lit("upper"), F.upper("r_name")).alias("kind", "text"))


@register("transpose", "SELECT 'n' AS key, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an aggregate with a row for each status: the whole table becomes one row."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).transpose("o_orderstatus")
