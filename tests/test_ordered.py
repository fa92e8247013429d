"""Exact quantiles and work in one order against brute force, with the plans that make them scale."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered, quantiles
from millrace.plans import catalog
from tests.compare import plain

SF = "/root/testdata/sf0.001"


def interpolated(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low, part = int(at), at - int(at)
    return values[low] if not part or values[low] == values[low + 1] else values[low] + (values[low + 1] - values[low]) * part


@pytest.mark.parametrize("ranked", [3, 40, 10_000])
def test_exact_quantiles(spark, ranked):
    """Ties, one hot group, nulls in keys and values, infinities, groups of one row and of none."""
    r = random.Random(7)
    rows = [("hot", 1, r.choice([r.random(), float(r.randrange(5)), -1e300, float("inf")])) for _ in range(4000)]
    rows += [(None, k % 3 or None, float(r.randrange(50))) for k in range(300)] + [("one", 1, 2.5), ("none", 1, None), ("hot", 1, None), ("same", 2, 7.0)] + [("same", 2, 7.0)] * 500
    fractions = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "x string, n int, lo double")  # names that are used inside
    got = {(a, b): (n, q) for a, b, n, q in quantiles.exact_quantiles(df, ["x", "n"], "lo", fractions, ranked).toDF("a", "b", "c", "q").collect()}
    groups = {}
    for a, b, v in rows:
        groups.setdefault((a, b), []).extend([v] if v is not None else [])
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key] == (len(values), [interpolated(values, p) if values else None for p in fractions])


def test_exact_quantiles_of_a_whole_table(spark):
    df = spark.range(1, 2002).select(F.col("id").alias("v"))
    assert quantiles.exact_quantiles(df, [], "v", [0.5, 0.0], 10).collect() == [(2001, [1001.0, 1.0])]
    assert quantiles.exact_quantiles(df.limit(0), [], "v", [0.5], 10).collect() == [(0, [None])]
    assert quantiles.exact_quantiles(df.limit(0), ["v"], "v", [0.5], 10).collect() == []


def test_nothing_ranks_a_large_interval(spark, monkeypatch):
    """What comes to be ranked is bounded, whatever the groups hold."""
    seen = []
    whole = quantiles.picked

    def watched(v, targets, keys):
        seen.append(max([r["n"] for r in quantiles.inside(v, targets.select(*keys, "lo", "hi").distinct(), keys).groupBy(*keys, "lo", "hi").agg(F.count(F.lit(1)).alias("n")).collect()], default=0))
        return whole(v, targets, keys)

    monkeypatch.setattr(quantiles, "picked", watched)
    df = spark.range(50_000).select((F.col("id") % 2).alias("g"), F.rand(3).alias("v"))
    quantiles.exact_quantiles(df, ["g"], "v", [0.1, 0.5], 100).collect()
    assert len(seen) == 1 and seen[0] <= 100


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_running(spark, ranges):
    r = random.Random(1)
    rows = [(k, r.randrange(5), r.choice([None, r.randrange(-9, 9)])) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, o int, v long")
    got = ordered.running(df, [F.col("o"), F.desc("k")], "v", ranges=ranges).collect()
    want, total = {}, 0
    for n, (k, _, v) in enumerate(sorted(rows, key=lambda x: (x[1], -x[0])), 1):
        total += v or 0
        want[k] = (total, n)
    assert {x["k"]: (x["total"], x["number"]) for x in got} == want
    assert ordered.running(df.limit(0), [F.col("k")], "v").count() == 0


def test_running_has_no_single_partition(spark):
    plan = catalog.QUERIES["win_running_total"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(range" in plan


@pytest.mark.parametrize("ranges", [1, 5, 60])
@pytest.mark.parametrize("keyed", [True, False])
def test_asof(spark, ranges, keyed):
    """Ties in time within and between the sides, a hot key, nulls in times and keys, repeated rows."""
    r = random.Random(ranges)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    left = [(k, key(), r.choice([None, *range(30)])) for k in range(400)] + [(1, "hot", 5)] * 3
    right = [(key(), r.choice([None, *range(0, 30, 3)]), k, f"v{k}") for k in range(200)]
    a = spark.createDataFrame(left, "id int, who string, t1 int")
    b = spark.createDataFrame(right, "who2 string, t2 int, tie2 int, value string")
    got = ordered.asof(a, b, ("t1", "t2"), "tie2", [("who", "who2")] if keyed else [], ranges)
    want = []
    for i, who, t in left:
        fit = [(t2, tie, v, w) for w, t2, tie, v in right if t is not None and t2 is not None and t2 <= t and (not keyed or who is not None and w == who)]
        best = max(fit, default=(None, None, None, None))
        want.append((i, who, t, *(() if keyed else (best[3],)), *best[:3]))
    assert sorted(map(tuple, got.collect()), key=plain) == sorted(want, key=plain)


def test_asof_of_empty_sides(spark):
    a, b = spark.createDataFrame([(1, 2)], "id int, t int"), spark.createDataFrame([(1, 3)], "v int, u int")
    assert ordered.asof(a, b.limit(0), ("t", "u"), "v").collect() == [(1, 2, None, None)]
    assert ordered.asof(a.limit(0), b, ("t", "u"), "v").count() == 0


def test_purchases_match_clicks_at_the_same_time(spark):
    """200 purchases, each with a click at its very time."""
    a = spark.createDataFrame([(k, k % 7, k) for k in range(200)], "event_id int, user_id int, ts int")
    b = spark.createDataFrame([(k % 7, k, 1000 + k) for k in range(200)], "click_user int, click_ts int, click_id int")
    got = ordered.asof(a, b, ("ts", "click_ts"), "click_id", [("user_id", "click_user")])
    assert got.where("click_id = 1000 + event_id").count() == 200


def test_cms_reads_every_key(spark):
    from millrace.operators.aggregates import cms_within

    rows = spark.range(3000).select((F.col("id") % 1500).cast("string").alias("k"))
    got = cms_within(rows, "k")
    assert got.where("n = 2 and not_below").count() == got.count() == 1500 and got.where("within").count() >= 1495
