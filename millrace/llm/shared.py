"""What several operators share: the shared folder and joins that stand hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of all rows, so at most HOT_PARTS keys are hot.
HOT_PARTS = 500


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, a local session, as in tests, has a folder beside the
    warehouse, which it shares with itself; on a cluster that could be one machine's own disk, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/millrace-shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Arrow batches of texts are kept to so many bytes, where the session has Spark's own, far larger, bound.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session: what a batch holds, the JVM's buffers and Python's objects hold several times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB", "64m", "2147483647b"):
        spark.conf.set(name, BATCH_BYTES)


def settle(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_folder(spark, name)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that no later job reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def attach(rows: DataFrame, key: Column, table: DataFrame, table_key: str, weight: str, total: int, spread: Column, how: str = "left") -> DataFrame:
    """rows joined (left, or inner) with table, which has one row for each key, without gathering a hot key.

    weight is the number of rows that have the key. Keys with more than
    total / HOT_PARTS rows, so at most HOT_PARTS of them, are broadcast; rows with such a
    key keep out of the shuffle join by a key of their own, made from spread.
    The columns of table other than its key and weight are added to rows.
    """
    values = [c for c in table.columns if c not in (table_key, weight)]
    least = max(1000, total // HOT_PARTS)
    pack = lambda prefix: table.select(F.col(table_key).alias(f"{prefix}key"), F.struct(*values).alias(f"{prefix}value"), F.col(weight).alias("__w"))
    hot = pack("__h").where(F.col("__w") > least).drop("__w")
    cold = pack("__c").where(F.col("__w") <= least).drop("__w")
    rows = rows.withColumn("__key", key)
    joined = rows.join(F.broadcast(hot), F.col("__key") == F.col("__hkey"), "left")
    away = F.concat_ws("~", F.lit("hot"), spread.cast("string"), F.xxhash64(spread).cast("string"))
    # the key is text here; no text key of a cold row starts like this
    joined = joined.withColumn("__ckey0", F.when(F.col("__hkey").isNull(), F.concat(F.lit("k"), F.col("__key").cast("string"))).otherwise(away))
    joined = joined.withColumn("__ckey0", F.coalesce("__ckey0", away))
    joined = joined.join(cold.withColumn("__ckey", F.concat(F.lit("k"), F.col("__ckey").cast("string"))), F.col("__ckey0") == F.col("__ckey"), "left")
    if how == "inner":
        joined = joined.where(F.col("__hkey").isNotNull() | F.col("__ckey").isNotNull())
    found = F.coalesce("__hvalue", "__cvalue")
    return joined.select(*[F.col(c) for c in rows.columns if c != "__key"], *[found[v].alias(v) for v in values])


#: A table of keys is broadcast only up to this many rows.
BROADCAST_ROWS = 300_000


def text_keys(text: str = "text") -> dict[str, Column]:
    """Two 64-bit hashes of a text, from different seeds, which name it in joins."""
    return {"t1": F.xxhash64(F.lit(1), text), "t2": F.xxhash64(F.octet_length(text), F.lit(7), text)}


def text_key() -> Column:
    """t1 and t2 as one key."""
    return F.concat_ws(":", "t1", "t2")


def distinct_texts(keyed: DataFrame, texts: DataFrame) -> DataFrame:
    """t1, t2, id, text of each different text of keyed (doc_id, text, t1, t2).

    texts has t1, t2, copies, first_id, and first_id becomes id. Only texts with copies are shuffled, and of those
    only one row each, the one with the first id (ties: any of the equal texts), goes on with its text.
    """
    multiple = texts.where("copies > 1").select(text_key().alias("k"), "first_id", F.lit(True).alias("many"), F.col("copies").alias("weight"))
    size = multiple.agg(F.count(F.lit(1)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rows = keyed.select("t1", "t2", "doc_id", "text")
    if size[0] <= BROADCAST_ROWS:
        marked = rows.withColumn("k", text_key()).join(F.broadcast(multiple.drop("weight")), "k", "left").drop("k")
    else:
        marked = attach(rows, text_key(), multiple, "k", "weight", size[1], F.struct("doc_id", "t1"))
    once = marked.where(F.col("many").isNull()).select("t1", "t2", F.col("doc_id").alias("id"), "text")
    first = marked.where(F.col("many") & F.col("doc_id").eqNullSafe(F.col("first_id")))
    return once.unionByName(first.select("t1", "t2", F.col("first_id").alias("id"), "text").dropDuplicates(["t1", "t2"]))


def join_texts(rows: DataFrame, table: DataFrame, n: int, on: Sequence[str] = ("t1", "t2")) -> DataFrame:
    """rows (text and what names it, on; one for each text) with the columns of table, for those it names; n is the number of its rows."""
    if n <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(table.select(*on)), list(on), "left_semi")
    return rows.join(table, list(on))


def rows_of(df: DataFrame) -> int:
    """Number of rows of a settled table."""
    return df.sparkSession.read.schema(df.schema).parquet(df.settled_at).count()
