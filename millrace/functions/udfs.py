"""The UDF surface: Arrow batches, grouped maps, table functions. Used only where this is the feature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from millrace.plans.catalog import register
from millrace.sources.tables import table


@register("udf_scalar", "SELECT p_partkey, p_size * 2 + 1 AS y FROM part")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("int")
    def odd(size: pd.Series) -> pd.Series:
        return size * 2 + 1

    return table(spark, sf_dir, "part").select("p_partkey", odd("p_size").alias("y"))


@register("udaf", "SELECT c_mktsegment, CAST(max(c_nationkey) - min(c_nationkey) AS BIGINT) AS spread FROM customer GROUP BY c_mktsegment")
def udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("long")
    def spread(x: pd.Series) -> int:
        return int(x.max() - x.min())

    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(spread("c_nationkey").alias("spread"))


@register("udtf", "SELECT n_nationkey, unnest(range(n_regionkey)) AS i FROM nation")
def udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="i long")
    class UpTo:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    spark.udtf.register("millrace_up_to", UpTo)
    return spark.sql("SELECT n_nationkey, i FROM {nation}, LATERAL millrace_up_to(n_regionkey)", nation=table(spark, sf_dir, "nation"))


@register("map_batches", "SELECT s_suppkey, upper(s_name) AS name FROM supplier")
def map_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def upper(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(name=pdf["s_name"].str.upper())[["s_suppkey", "name"]]

    return table(spark, sf_dir, "supplier").mapInPandas(upper, "s_suppkey long, name string")


@register("cogroup", "SELECT n.n_regionkey AS k, count(*) AS nations, (SELECT count(*) FROM region WHERE r_regionkey = n.n_regionkey) AS regions FROM nation n GROUP BY n.n_regionkey")
def cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def sizes(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "nations": [len(a)], "regions": [len(b)]})

    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nations.groupBy("n_regionkey").cogroup(regions.groupBy("r_regionkey")).applyInPandas(sizes, "k int, nations long, regions long")


@register("udf_row", "SELECT p_partkey, p_size + strlen(p_name) AS y FROM part")
def udf_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of one row at a time, with types from its hints' Spark names."""

    @F.udf("int")
    def size(p_size: int, p_name: str) -> int:
        return p_size + len(p_name.encode())

    return table(spark, sf_dir, "part").select("p_partkey", size("p_size", "p_name").alias("y"))


@register("udf_arrow", "SELECT o_orderkey, upper(o_orderpriority) AS priority, o_totalprice > 100000 AS large FROM orders")
def udf_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of Arrow columns, without a detour by pandas."""

    @F.arrow_udf("string")
    def upper(x: pa.Array) -> pa.Array:
        return pc.utf8_upper(x)

    @F.arrow_udf("boolean")
    def large(x: pa.Array) -> pa.Array:
        return pc.greater(x, 100_000)

    return table(spark, sf_dir, "orders").select("o_orderkey", upper("o_orderpriority").alias("priority"), large("o_totalprice").alias("large"))


@register("map_arrow", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def map_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches in, fewer rows out, in Arrow throughout."""

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.greater(batch.column("o_totalprice"), 200_000))

    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").mapInArrow(large, "o_orderkey long, o_totalprice double")


class Streaks:
    """A table function with a table argument: the key of each partition, and its longest run of rows with the same value of a named column."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, field: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {key.value, field.value} <= set(rows.dataType.names):
            raise ValueError("a table, and the names of two of its columns")
        kinds = [rows.dataType[c.value].dataType for c in (key, field)]
        return AnalyzeResult(StructType().add(key.value, kinds[0]).add("value", kinds[1]).add("length", LongType()).add("rows", LongType()))

    def __init__(self) -> None:
        self.key, self.best, self.run, self.value, self.seen = None, (None, 0), 0, None, 0

    def eval(self, rows: Row, key: str, field: str) -> None:
        value = rows[field]
        self.run = self.run + 1 if self.seen and value == self.value else 1
        self.key, self.value, self.seen = rows[key], value, self.seen + 1
        if self.run > self.best[1]:
            self.best = (value, self.run)

    def terminate(self) -> Iterator[tuple]:
        if self.seen:
            yield (self.key, *self.best, self.seen)


@register(
    "udtf_table",
    """WITH e AS (SELECT user_id, event_type, ts, coalesce(event_type <> lag(event_type) OVER w, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
         runs AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e),
         sizes AS (SELECT user_id, event_type, count(*) AS length, min(ts) AS first FROM runs GROUP BY user_id, event_type, run)
       SELECT user_id, event_type AS value, length, (SELECT count(*) FROM events x WHERE x.user_id = sizes.user_id) AS rows FROM sizes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, first) = 1""",
)
def udtf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's longest run of events of one type: rows come to the function by user and in time, and its schema follows from its arguments."""
    spark.udtf.register("millrace_streaks", F.udtf(Streaks))
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    return spark.sql("SELECT * FROM millrace_streaks(key => 'user_id', field => 'event_type', rows => TABLE({events}) PARTITION BY user_id ORDER BY ts)", events=events)


@register("udtf_arrow", "SELECT event_id, unnest(range(CAST(user_id % 4 AS INTEGER))) AS i FROM events")
def udtf_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function of Arrow batches: each batch of a partition's rows becomes one of more rows."""

    @arrow_udtf(returnType="event_id long, i long")
    class Repeat:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            times = pc.subtract(rows.column("user_id"), pc.multiply(pc.floor(pc.divide(rows.column("user_id").cast(pa.float64()), 4.0)).cast(pa.int64()), 4)).to_numpy()
            at = np.repeat(np.arange(len(times)), times)
            place = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.table({"event_id": rows.column("event_id").take(pa.array(at)), "i": pa.array(place)})

    spark.udtf.register("millrace_repeat", Repeat)
    return spark.sql("SELECT event_id, i FROM millrace_repeat(TABLE({events}))", events=table(spark, sf_dir, "events").select("event_id", "user_id"))
