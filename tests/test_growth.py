"""Queries whose work grew faster than their input, or whose results were not whole."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import intervals
from millrace.plans import catalog
from millrace.sources.tables import SCHEMAS
from millrace.streaming import stateful
from tests.compare import same

SF = "/root/testdata/sf0.001"


def test_sketches_are_not_kept_by_part(spark):
    """Only the exact count groups by part; a buffer of each sketch for each part would grow with the parts."""
    plan = catalog.QUERIES["agg_approx_distinct"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    groupings = [line for line in plan.splitlines() if "Aggregate(keys=[" in line]
    by_part = [line for line in groupings if "l_partkey" in line.split("functions=")[0]]
    assert by_part and not any("sketch" in line or "approx" in line for line in by_part)


def test_approximate_quantiles_stand_beside_the_exact_median(spark, tmp_path):
    """Also for line items without a return flag."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.replace("R", None, "l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["agg_approx_quantile"](spark, str(tmp_path))
    assert "exact" in got.columns
    same(got, catalog.ORACLES["agg_approx_quantile"], str(tmp_path))


@pytest.mark.parametrize("files", [1, 4])
def test_visits_wait_for_the_watermark(spark, tmp_path, files, monkeypatch):
    """A visit that the user's next event ended within the last day and hour isn't given out; in one batch and in four."""
    at = lambda hours: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)
    hours = {1: [0, 10, 60, 85], 2: [0, 50, 75.5, 99.9], 3: [71, 95.5], 4: [100], 5: [1, 26, 74], 6: [2, 75.2, 99.95]}
    rows = sorted((at(h), user) for user, found in hours.items() for h in found)
    step = -(-len(rows) // files)
    for k in range(files):  # one after the other, as a stream reads files by their age
        part = [(i, *rows[i], "view", 1.0, "") for i in range(k * step, min((k + 1) * step, len(rows)))]
        spark.createDataFrame(part, SCHEMAS["events"]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        time.sleep(0.01)
    if files > 1:
        read = type(spark).readStream.fget
        monkeypatch.setattr(type(spark), "readStream", property(lambda s: read(s).option("maxFilesPerTrigger", 1)))
    same(catalog.QUERIES["stream_timers"](spark, str(tmp_path)), catalog.ORACLES["stream_timers"], str(tmp_path))


@pytest.mark.parametrize("ranges", [1, 7])
def test_overlap_totals(spark, ranges):
    """Points, equal bounds, below zero too, nulls and turned bounds: as the pairs say."""
    r = random.Random(ranges)

    def made(n):
        starts = [r.choice([None, *range(-40, 40)]) for _ in range(n)]
        return [(f"k{k}", f, r.choice([None, *[(f or 0) + d for d in (-1, 0, 0, 1, 3, 20, 90)]])) for k, f in enumerate(starts)]

    left, right = made(150), made(100)
    a, b = spark.createDataFrame(left, "i string, f long, t long"), spark.createDataFrame(right, "j string, g long, u long")
    got = {row[0]: tuple(row)[1:] for row in intervals.overlap_totals(a, b, (("f", "t"), ("g", "u")), "i", ranges).collect()}
    fine = lambda rows: [x for x in rows if None not in x and x[2] >= x[1]]
    want = {}
    for i, f, t in fine(left):
        shared = [min(t, u) - max(f, g) for _, g, u in fine(right) if f <= u and g <= t]
        if shared:
            want[i] = (len(shared), sum(shared))
    assert got == want


def test_overlaps_of_all_users_are_counted_without_pairs(spark):
    """No join has more rows than the sessions: the one join is with a row for each range."""
    plan = catalog.QUERIES["join_intervals_all"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == plan.count("BroadcastHashJoin") == 1


def test_customers_without_events_take_no_state(spark, tmp_path):
    """State grows with the users that have events, not with all customers."""
    stateful.with_rocksdb(spark)
    customers = spark.range(500).select(F.col("id").alias("user_id"), F.lit("s").alias("segment"))
    schema = "user_id long, event_id long, event_type string"
    spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (999, 3, "a")], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_millis("event_id"))
    found = []
    writer = stateful.profiles(stream, customers).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c")
    query = writer.trigger(availableNow=True).foreachBatch(lambda batch, number: found.extend(map(tuple, batch.collect()))).start()
    query.awaitTermination()
    assert sorted(found) == [(1, "s", 1, "1", "a:1"), (2, "s", 1, "2", "b:1"), (999, None, 1, "3", "a:1")]
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) < 50
