"""Upserts on partitioned Parquet by copy-on-write: only partitions that change are written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import register
from millrace.sources.scratch import scratch, stored
from millrace.sources.tables import table


def merge(target: DataFrame, path: str, partition: str, key: str, upserts: DataFrame, deletes: DataFrame) -> list:
    """Bring the table at path (target is its rows, by a fixed schema) up to date; gives the partitions that were written again, in order.

    upserts are whole rows, which replace the row with their key, in whatever partition it is, or are added; deletes are keys, which lose to
    upserts of the same key. A key should be there once in each; of upserts with one key any one stays. Rows of null key are
    never matched: those of target stay, those of upserts are added. Changed partitions are found by a semi join on keys; they are
    staged beside the table, and then replace the old ones by one dynamic overwrite, or are removed where no row is left. Readers of the same moment
    may see some partitions before and some after it, as plain files have no snapshots.
    """
    spark = target.sparkSession
    upserts = stored(upserts.select(*target.columns), "merge-upserts")
    unique = upserts.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(upserts.where(F.col(key).isNull()))
    touched = stored(upserts.select(key).unionByName(deletes.select(key)).where(F.col(key).isNotNull()).distinct(), "merge-keys")
    hit = target.join(touched, key, "left_semi").select(partition).union(upserts.select(partition)).distinct()
    # the names of partitions are as few as the folders of the table
    values = sorted((r[0] for r in hit.collect()), key=lambda v: (v is None, v))
    if not values:
        return []
    changed = F.col(partition).isin([v for v in values if v is not None])
    if None in values:
        changed = changed | F.col(partition).isNull()
    kept = target.where(changed).join(touched, key, "left_anti")
    staged = stored(kept.select(*target.columns).unionByName(unique), "merge-staged")
    left = {r[0] for r in staged.select(partition).distinct().collect()}
    staged.repartition(F.col(partition)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for value in values:
        if value not in left:
            remove(spark, f"{path}/{folder(spark, partition, value)}")
    return values


def folder(spark: SparkSession, partition: str, value) -> str:
    """The name of a partition's folder, as Spark writes it."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return f"{escaped(partition)}={'__HIVE_DEFAULT_PARTITION__' if value is None else escaped(str(value))}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark writes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


BY_YEAR = "o_orderkey bigint, o_totalprice double, o_orderpriority string, year int"


@register(
    "sink_upsert",
    """WITH o AS (SELECT o_orderkey, o_totalprice, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)
       SELECT o_orderkey, CASE WHEN year = 1996 AND o_orderkey % 10 = 1 THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice, o_orderpriority,
         CASE WHEN year = 1996 AND o_orderkey % 10 = 1 AND o_orderkey % 3 = 0 THEN 1997 ELSE year END AS year FROM o WHERE NOT (year = 1998 AND o_orderkey % 10 = 2)
       UNION ALL SELECT o_orderkey + 1000000000000, o_totalprice, 'new', 2002 FROM o WHERE year = 1998 AND o_orderkey % 10 = 3""",
)
def sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by year: some of 1996 change (a third of them move to 1997), some of 1998 go, and new ones come for a year that wasn't there."""
    path = scratch(spark, "orders-upsert")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", F.year("o_orderdate").alias("year"))
    orders.repartition("year").write.partitionBy("year").parquet(path)
    target = spark.read.schema(BY_YEAR).parquet(path)
    tenth = F.col("o_orderkey") % 10
    moved = F.when(F.col("o_orderkey") % 3 == 0, F.lit(1997)).otherwise(F.col("year"))
    updates = orders.where((F.col("year") == 1996) & (tenth == 1)).withColumns({"o_totalprice": F.col("o_totalprice") + 100, "year": moved})
    inserts = orders.where((F.col("year") == 1998) & (tenth == 3)).withColumns({"o_orderkey": F.col("o_orderkey") + 1_000_000_000_000, "o_orderpriority": F.lit("new"), "year": F.lit(2002)})
    merge(target, path, "year", "o_orderkey", updates.unionByName(inserts), orders.where((F.col("year") == 1998) & (tenth == 2)).select("o_orderkey"))
    return spark.read.schema(BY_YEAR).parquet(path)
