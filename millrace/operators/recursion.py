"""Recursion over rows: chains and trees followed to their fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.catalog import register
from millrace.sources.scratch import stored
from millrace.sources.tables import table


def roots(links: DataFrame, key: str, parent: str, rounds: int = 40) -> DataFrame:
    """key, root and depth of each row of a forest, where parent is another row's key, or null for a root.

    Pointers double: after n rounds a row points 2 ** n steps up or to its root, so a chain of a million rows takes twenty joins by
    key. A parent that no row has is a root itself, at depth 1 from its children. Keys are unique and not null. A cycle
    never ends in a root; the guard of rounds (2 ** 40 steps) raises ValueError then.
    """
    found = stored(links.select(F.col(key).alias("k"), F.coalesce(parent, key).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col(parent).isNull().alias("done")), "roots")
    for _ in range(rounds):
        # a row that has reached its root drops out of the joins
        open_rows = found.where(~F.col("done"))
        if not open_rows.limit(1).count():
            return found.select(F.col("k").alias(key), F.col("up").alias("root"), F.col("steps").alias("depth"))
        above = found.select(F.col("k").alias("ak"), F.col("up").alias("a_up"), F.col("steps").alias("a_steps"), F.col("done").alias("a_done"))
        moved = open_rows.join(above, F.col("up") == F.col("ak"), "left")
        moved = moved.select("k", F.coalesce("a_up", "up").alias("up"), (F.col("steps") + F.coalesce("a_steps", F.lit(0))).alias("steps"), F.coalesce("a_done", F.lit(True)).alias("done"))
        found = stored(found.where("done").unionByName(moved), "roots")
    raise ValueError("the links hold a cycle, or chains beyond the guard")


#: Events of a user up to so many hours apart are one chain.
HOURS = 8
LINKS = f"links AS (SELECT event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {HOURS} HOUR THEN lag(event_id) OVER w END AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@register(
    "cte_recursive",
    f"""WITH RECURSIVE {LINKS}, chain(event_id, root, depth) AS (SELECT event_id, event_id, 0 FROM links WHERE before IS NULL
         UNION ALL SELECT l.event_id, c.root, c.depth + 1 FROM links l JOIN chain c ON l.before = c.event_id)
       SELECT event_id, root, CAST(depth AS BIGINT) AS depth FROM chain""",
)
def cte_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's place in its chain: the first event, and the steps back to it."""
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    near = F.col("at") - F.lag("at").over(w) <= HOURS * 3_600_000_000
    return roots(events.select("event_id", F.when(near, F.lag("event_id").over(w)).alias("before")), "event_id", "before")


@register(
    "cte_recursive_paths",
    """WITH RECURSIVE n AS (SELECT n_regionkey, n_nationkey, n_name, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS next FROM nation),
         walk(region, place, path, steps) AS (SELECT n_regionkey, min(n_nationkey), min_by(n_name, n_nationkey), 1 FROM n GROUP BY n_regionkey
         UNION ALL SELECT region, b.n_nationkey, path || '>' || b.n_name, steps + 1 FROM walk JOIN n a ON walk.place = a.n_nationkey JOIN n b ON a.next = b.n_nationkey)
       SELECT region, path, CAST(steps AS INTEGER) AS steps FROM walk""",
)
def cte_recursive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own WITH RECURSIVE, over the nations of a region, whose number the data model fixes."""
    nations = table(spark, sf_dir, "nation")
    return spark.sql(
        """WITH RECURSIVE n AS (SELECT n_regionkey, n_nationkey, n_name, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS next FROM {nations}),
             walk(region, place, path, steps) AS (SELECT n_regionkey, min(n_nationkey), CAST(min_by(n_name, n_nationkey) AS STRING), 1 FROM n GROUP BY n_regionkey
             UNION ALL SELECT region, b.n_nationkey, path || '>' || b.n_name, steps + 1 FROM walk JOIN n a ON walk.place = a.n_nationkey JOIN n b ON a.next = b.n_nationkey)
           SELECT region, path, steps FROM walk""",
        nations=nations,
    )
