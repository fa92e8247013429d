"""File sources and sinks: each query writes a table in a format and reads it back by its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import register
from millrace.sources.scratch import scratch
from millrace.sources.tables import SCHEMAS, table


def round_trip(kind: str, name: str, options: dict[str, str]):
    @register(f"scan_{kind}", f"SELECT * FROM {name}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark, f"{name}-{kind}")
        table(spark, sf_dir, name).write.options(**options).format(kind).save(path)
        return spark.read.schema(SCHEMAS[name]).options(**options).format(kind).load(path)

    return query


for kind, name, options in (("csv", "customer", {"header": "true"}), ("json", "part", {}), ("orc", "supplier", {}), ("parquet", "nation", {}), ("xml", "region", {"rowTag": "row"})):
    round_trip(kind, name, options)


@register("scan_text", "SELECT n_name AS value FROM nation")
def scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "nation-text")
    table(spark, sf_dir, "nation").select("n_name").write.text(path)
    return spark.read.text(path)


@register("scan_binary", "SELECT c_nationkey, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS size FROM customer GROUP BY c_nationkey")
def scan_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as bytes: a folder of names for each nation, and what its files hold."""
    path = scratch(spark, "customer-binary")
    table(spark, sf_dir, "customer").select("c_name", "c_nationkey").repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    nation = F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("int")
    return files.groupBy(nation.alias("c_nationkey")).agg(F.sum(F.octet_length("content")).alias("size"))


@register("sink_partitioned", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderstatus")
def sink_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned write, and a read that lists one partition only."""
    path = scratch(spark, "orders-by-status")
    table(spark, sf_dir, "orders").repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.schema(SCHEMAS["orders"]).parquet(path).where("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@register("sink_files", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def sink_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write that replaces what stands there, then one that adds to it."""
    path, orders = scratch(spark, "orders-files"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    for part, mode in ((0, "overwrite"), (1, "append")):
        orders.where(F.col("o_orderkey") % 2 == part).write.mode(mode).option("compression", "zstd").parquet(path)
    return spark.read.schema("o_orderkey long, o_orderpriority string").parquet(path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@register("sink_table", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
def sink_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucketed, sorted table in the catalog; a grouping by its bucket key needs no shuffle."""
    path = scratch(spark, "customer-buckets")
    name = "millrace_" + path[-32:]
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    customers.write.bucketBy(8, "c_nationkey").sortBy("c_nationkey").option("path", path).saveAsTable(name)
    return spark.table(name).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
