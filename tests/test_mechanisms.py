"""Interval joins, recursion, upserts, JDBC, the connector, stateful streams and table functions beyond what their queries show."""

import os
import random
import time

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.operators import intervals, recursion
from millrace.plans import catalog
from millrace.sources import connector, jdbc
from millrace.sources.merge import merge
from millrace.streaming import stateful, streams
from tests.compare import oracle_rows, plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("seed", range(3))
def test_overlapping(spark, seed, keyed):
    """Points, long and short intervals, below zero too, nulls and turned bounds: each pair once."""
    r = random.Random(seed)

    def made(n):
        out = []
        for k in range(n):
            start = r.randrange(-3000, 3000)
            out.append((k, r.choice(["a", "a", "b", None]), r.choice([start, start, start, None]), start + r.choice([0, 0, 1, 3, 17, 400, 5000, -1])))
        return out

    left, right = made(120), made(90)
    a, b = spark.createDataFrame(left, "i int, k string, f long, t long"), spark.createDataFrame(right, "j int, l string, g long, u long")
    got = intervals.overlapping(a, b, (("f", "t"), ("g", "u")), [("k", "l")] if keyed else [])
    fine = lambda rows: [x for x in rows if x[2] is not None and x[3] >= x[2]]
    want = [(*x, *y) for x in fine(left) for y in fine(right) if x[2] <= y[3] and y[2] <= x[3] and (not keyed or x[1] is not None and x[1] == y[1])]
    assert sorted(map(tuple, got.collect()), key=plain) == sorted(want, key=plain)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlapping_of_empty_sides(spark):
    a, b = spark.createDataFrame([(1, 2, 3)], "i int, f long, t long"), spark.createDataFrame([], "j int, g long, u long")
    assert intervals.overlapping(a, b, (("f", "t"), ("g", "u"))).count() == 0
    assert intervals.overlapping(b.toDF("i", "f", "t"), a.toDF("j", "g", "u"), (("f", "t"), ("g", "u"))).count() == 0


def test_roots(spark):
    """A chain of 300 rows, a star, a lone row, a parent that isn't there; a cycle is refused."""
    rows = [(k, k - 1 if k else None) for k in range(300)] + [(1000 + k, 1000 if k else None) for k in range(50)] + [(5000, None), (6000, 7777)]
    got = {r[0]: (r[1], r[2]) for r in recursion.roots(spark.createDataFrame(rows, "id long, up long"), "id", "up").collect()}
    want = {k: (0, k) for k in range(300)} | {1000 + k: (1000, int(k > 0)) for k in range(50)} | {5000: (5000, 0), 6000: (7777, 1)}
    assert got == want
    with pytest.raises(ValueError):
        recursion.roots(spark.createDataFrame([(1, 2), (2, 1)], "id long, up long"), "id", "up", rounds=5)


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_merge_rewrites_changed_partitions_only(spark, tmp_path):
    """Updates, moves, inserts, deletes, a partition that empties, names that need escaping, null partitions and keys."""
    path, schema = f"{tmp_path}/t", "id long, v string, p string"
    rows = [(k, f"v{k}", ("a/b", "keep", "gone", None, "x=y")[k % 5]) for k in range(40)] + [(None, "n", "keep")]
    spark.createDataFrame(rows, schema).repartition("p").write.partitionBy("p").parquet(path)
    read = lambda: spark.read.schema(schema).parquet(path)
    before = files_of(path)
    upserts = spark.createDataFrame([(0, "new", "a/b"), (5, "moved", "x=y"), (100, "added", "fresh")], schema)
    deletes = spark.createDataFrame([(k,) for k in range(2, 40, 5)] + [(3,), (0,), (999,)], "id long")
    assert merge(read(), path, "p", "id", upserts, deletes) == ["a/b", "fresh", "gone", "x=y", None]
    want = {k: v for k, *v in rows if k is None or k % 5 != 2 and k != 3} | {0: ["new", "a/b"], 5: ["moved", "x=y"], 100: ["added", "fresh"]}
    assert {r[0]: [r[1], r[2]] for r in read().collect()} == want and read().count() == len(want)
    kept = {f for f in before if "p=keep" in f}
    assert kept and kept <= files_of(path) and not any("p=gone" in f for f in files_of(path))
    after = files_of(path)
    assert merge(read(), path, "p", "id", upserts.limit(0), deletes.limit(0)) == [] and files_of(path) == after


def test_jdbc_pushes_down(spark):
    plan = catalog.QUERIES["scan_jdbc"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "numPartitions=8" in plan and "*GreaterThan(o_totalprice,250000.0), *Str" in plan
    assert "o_orderpriority" not in plan.split("ReadSchema")[1]
    plan = catalog.QUERIES["scan_jdbc_aggregate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregates: [COUNT(*), MAX" in plan and "PushedGroupByExpressions: [nation]" in plan and "HashAggregate" not in plan


def test_jdbc_of_an_empty_table(spark):
    url = jdbc.memory_database()
    jdbc.put(spark.createDataFrame([], "k long, v string"), url, "nothing")
    assert jdbc.get(spark, url, "nothing", "k").count() == jdbc.get(spark, url, "nothing").count() == 0


def test_connector_skips_row_groups(spark, tmp_path):
    """Filters reach the reader, which leaves out row groups by their statistics; the rest of the filter stays with Spark."""
    connector.connected(spark)
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "CAST(id AS string) AS s", "IF(id % 2 = 0, id, NULL) AS h").repartitionByRange(5, "id").write.format("millrace_parquet").mode("append").save(path)
    rows = spark.read.format("millrace_parquet").load(path)
    assert rows.schema.simpleString() == "struct<id:bigint,s:string,h:bigint>"
    got = rows.where("id >= 850 AND h IS NOT NULL AND id % 3 = 0 AND s <> '852'")
    assert sorted(r[0] for r in got.collect()) == [k for k in range(850, 1000) if k % 6 == 0 and k != 852]
    folder = connector.Folder(path)
    files = folder.files()
    assert len(files) == 5 and len([f for f in files if connector.groups(folder, f, [("GreaterThanOrEqual", "id", 850)])]) == 1
    assert rows.where("h IS NULL").count() == 500 and rows.where("id = 7").count() == 1 and rows.where("id > 5000").count() == 0


def test_connector_commits_whole_writes(spark, tmp_path):
    """An aborted write leaves nothing visible; overwriting replaces, appending adds; a repeated batch of a stream counts once."""
    connector.connected(spark)
    path = str(tmp_path / "t")
    spark.range(10).write.format("millrace_parquet").mode("append").save(path)
    broken = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(PySparkException):
        broken.write.format("millrace_parquet").mode("append").save(path)
    read = lambda: sorted(r[0] for r in spark.read.format("millrace_parquet").load(path).collect())
    assert read() == list(range(10))
    spark.range(10, 12).write.format("millrace_parquet").mode("append").save(path)
    assert read() == list(range(12))
    spark.range(3).write.format("millrace_parquet").mode("overwrite").save(path)
    assert read() == [0, 1, 2]
    folder = connector.Folder(path)
    sink = connector.StreamWriter(path, spark.range(1).schema, False)
    message = sink.write(iter([pa.RecordBatch.from_arrays([pa.array([50])], ["id"])]))
    sink.commit([message, None], 7)
    sink.commit([message, None], 7)
    assert read() == [0, 1, 2, 50] and len(folder.commits()) == 4
    lost = sink.write(iter([pa.RecordBatch.from_arrays([pa.array([60])], ["id"])]))
    sink.abort([lost, None], 8)
    assert not any(lost.files[0] in i.path for i in folder.listed()) and sink.write(iter([])).files == []


def quarters(spark, path, which):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for k in which:
        events.where(f"event_id % 1000 between {250 * k} and {250 * k + 249}").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)


def test_stateful_stream_restarts(spark, tmp_path):
    """Stopped after two of four files and started again from its checkpoint, the stream's last rows are those of the whole table."""
    stateful.with_rocksdb(spark)
    last = {}

    def sink(batch, number):
        last.update({r["user_id"]: tuple(r) for r in batch.collect()})

    for which in ((0, 1), (2, 3)):
        quarters(spark, f"{tmp_path}/events.parquet", which)
        stream = stateful.profiles(streams.events(spark, str(tmp_path)), stateful.segments(spark, SF))
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    names, want = oracle_rows(catalog.ORACLES["stream_stateful"], SF)
    order = [names.index(c) for c in ("user_id", "segment", "n", "recent", "types")]
    assert sorted(last.values()) == sorted(tuple(r[i] for i in order) for r in want)


def test_time_to_live(spark, tmp_path):
    """Counts that aren't renewed within their time are gone in the next batch; values and lists stay."""
    stateful.with_rocksdb(spark)
    rows = {}

    def sink(batch, number):
        rows.update({r["user_id"]: r for r in batch.collect()})

    customers = spark.createDataFrame([(1, "s")], "user_id long, segment string")
    for part in ([(1, 1, "a"), (1, 2, "b")], [(1, 3, "a")]):
        spark.createDataFrame(part, "user_id long, event_id long, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("user_id long, event_id long, event_type string").parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_millis("event_id"))
        query = stateful.profiles(stream, customers, ttl_ms=500).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(sink).start()
        streams.stop_when_idle(query)
        time.sleep(1)
    assert (rows[1]["segment"], rows[1]["n"], rows[1]["recent"], rows[1]["types"]) == ("s", 3, "1,2,3", "a:1")


def test_table_function_asks_for_columns(spark):
    spark.range(3).createOrReplaceTempView("three_rows")
    from millrace.functions.udfs import Streaks

    spark.udtf.register("streaks_here", F.udtf(Streaks))
    with pytest.raises(PySparkException):
        spark.sql("SELECT * FROM streaks_here(key => 'id', field => 'nothing', rows => TABLE(three_rows))").collect()


def test_range_join_keeps_few_rows_at_hand(spark):
    """The merge join's right side, of which it holds the rows of a key, is the one whose rows stand in one bin each."""
    plan = catalog.QUERIES["join_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [bin" in plan and plan.index("Generate explode") < plan.index("EqualTo(event_type,error)")
