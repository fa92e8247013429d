"""Mixing sources to target weights with exact quotas.

Sizes are words. Each source's target is its weight's share of all words, at
most MOST_PASSES times its own size; what that cuts off is shared again by
weight. A source is dealt into small blocks in an order permuted by hashes;
a target is so many whole passes over the blocks, then blocks in the permuted order
until it is reached. The draws of all sources are the quotas of a splitting
tree: each node deals its quotas to two halves of the output shards by a multivariate
hypergeometric draw (what cutting one random permutation of all draws would
give), down to single shards. A shard's quota of a source takes the next, disjoint
stretch of its permuted blocks, and documents are shuffled within a shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import BROADCAST_ROWS, attach, rows_of, settle

MOST_PASSES = 3
WEIGHTS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Documents for each number of blocks, block draws for each output shard, levels of the tree for each step.
BLOCK, SHARD, LEVELS = 1024, 32, 6
#: Rows for each range of a running sum.
RANGE = 4096


def targets(sizes: DataFrame) -> DataFrame:
    """skey, source_size, weight, target of each source. Sources may be many: no step puts all of them in one task."""
    by_source = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    # places in code point order: within ranges, after the ranges before
    ranged = settle(by_source.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "sources")
    held = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = held.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row for each range
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    weighed = ranged.join(F.broadcast(before), "part").withColumn("weight", (place % WEIGHTS + 1).cast("int"))
    weighed = settle(weighed.select("skey", "source_size", "weight", (MOST_PASSES * F.col("source_size")).cast("double").alias("cap")), "weights")
    # what sources above their caps leave is shared again by weight, until none is above
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") <= F.lit(level) * F.col("weight")
        total = weighed.agg(F.sum("source_size"), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if total[3] == capped or not total[2]:
            break
        capped, level = total[3], (float(total[0]) - (total[1] or 0.0)) / total[2]
    return weighed.select("skey", "source_size", "weight", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def split(pdf: pd.DataFrame) -> pd.DataFrame:
    """A node's quotas, dealt to the nodes LEVELS below it."""
    seed = int(pdf["seed"].iloc[0])
    pdf = pdf.sort_values("skey")
    keys = pdf["skey"].to_numpy()
    nodes, out = [(int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0]), pdf["quota"].to_numpy(np.int64), 0)], []
    while nodes:
        lo, hi, quota, depth = nodes.pop()
        if hi - lo == 1 or depth == LEVELS:
            some = quota > 0
            out.append(pd.DataFrame({"lo": lo, "hi": hi, "seed": seed, "skey": keys[some], "quota": quota[some]}))
            continue
        middle = (lo + hi) // 2
        left = int(quota.sum()) * (middle - lo) // (hi - lo)
        draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(quota, left, method="marginals")
        nodes += [(middle, hi, quota - draw, depth + 1), (lo, middle, draw, depth + 1)]
    return pd.concat(out) if out else pdf[["lo", "hi", "seed", "skey", "quota"]]


def shards_of(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """skey, shard, start, quota: the stretches of each source's draws that the leaves of the tree take. quotas has skey, quota."""
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.lit(seed).alias("seed"), "skey", "quota")
    for _ in range(0, max(1, (shards - 1).bit_length()), LEVELS):
        nodes = nodes.groupBy("lo", "hi").applyInPandas(split, "lo int, hi int, seed int, skey string, quota long")
    return running(nodes.select("skey", F.col("lo").cast("long").alias("at"), F.col("lo").alias("shard"), "quota"), "quota", "start", max(1, shards // RANGE))


def running(rows: DataFrame, value: str, name: str, parts: int, *counted: str) -> DataFrame:
    """rows (skey, at, ...) with the sum of value over the rows of the same source that come before by at, and likewise their number.

    A source is cut into `parts` ranges of at, summed first, so that no task holds all rows of a source.
    """
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    low, width = (0, 1) if low is None else (low, max(1, -(-(high - low + 1) // parts)))
    cut = rows.withColumn("part", F.expr(f"cast((cast(at AS decimal(38, 0)) - ({low})) div {width} AS int)"))
    cut = settle(cut, name)
    sums = cut.groupBy("skey", "part").agg(F.sum(value).alias("v"), F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("skey").orderBy("part")
    sums = settle(sums.select("skey", "part", (F.sum("v").over(over) - F.col("v")).alias("v0"), (F.sum("n").over(over) - F.col("n")).alias("n0")), f"{name}-sums")
    inner = Window.partitionBy("skey", "part").orderBy("at", *counted)
    sums = F.broadcast(sums) if rows_of(sums) <= BROADCAST_ROWS else sums
    out = cut.withColumn("v1", F.sum(value).over(inner) - F.col(value)).withColumn("n1", F.row_number().over(inner) - 1).join(sums, ["skey", "part"])
    return out.withColumn(name, F.col("v0") + F.col("v1")).withColumn("place", F.col("n0") + F.col("n1")).drop("part", "v0", "v1", "n0", "n1")


def block_of(h, blocks: int):
    return F.pmod(F.xxhash64(F.lit(11), h), F.lit(blocks)).cast("long")


def plan(sizes: DataFrame, seed: int) -> tuple[DataFrame, int, DataFrame]:
    """For each block of each source the draws that the tree's leaves make of it, and where its last pass ends; the number of blocks; the sources' targets.

    sizes has skey, source, size, h for each document. Blocks that no leaf draws have no row.
    """
    n = sizes.count()
    blocks = max(1, -(-n // BLOCK))
    dealt = sizes.withColumn("block", block_of(F.col("h"), blocks))
    goal = targets(sizes).drop("weight")
    goal = settle(goal, "goals")
    sums = dealt.groupBy("skey", "block").agg(F.sum("size").alias("block_size"), F.count(F.lit(1)).alias("weight"))
    placed = running(sums.withColumn("at", F.xxhash64(F.lit(seed), "skey", "block")), "block_size", "begun", max(1, blocks // RANGE), "block")
    goal_words = F.least(F.round("target").cast("long"), MOST_PASSES * F.col("source_size"))
    few = rows_of(goal) <= BROADCAST_ROWS
    placed = placed.join(F.broadcast(goal) if few else goal, "skey").withColumn("goal", goal_words).withColumn("passes", F.coalesce(F.expr("cast(goal div nullif(source_size, 0) as int)"), F.lit(0)))
    placed = placed.withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size"))
    # the unfinished last pass takes the blocks that begin before the rest ends, and `last` words of each
    placed = placed.withColumn("in_last", F.col("begun") < F.col("rest")).withColumn("last", F.greatest(F.lit(0), F.least(F.col("block_size"), F.col("rest") - F.col("begun"))))
    placed = settle(placed.drop("at"), "blocks")
    # the quota of a source: so many draws of blocks, in the permuted order, pass after pass
    quotas = placed.groupBy("skey").agg(F.sum(F.col("passes") + F.col("in_last").cast("int")).cast("long").alias("quota"), F.count(F.lit(1)).alias("n_blocks"))
    quotas = settle(quotas, "quotas")
    total = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    leaves = shards_of(quotas.where("quota > 0").select("skey", "quota"), max(1, -(-total // SHARD)), seed)
    draws = leaves.select("skey", "shard", F.explode(F.expr("sequence(start, start + quota - 1)")).alias("pos")).join(F.broadcast(quotas.select("skey", "n_blocks")) if few else quotas.select("skey", "n_blocks"), "skey")
    draws = draws.select("skey", F.expr("pos % n_blocks").alias("place"), F.struct(F.expr("cast(pos div n_blocks as int)").alias("pass"), "shard").alias("draw"))
    draws = draws.groupBy("skey", "place").agg(F.array_sort(F.collect_list("draw")).alias("draws"))
    # the block in which the last pass ends: the hash at which it stops and the words left for documents with that hash
    ends = F.broadcast(placed.where("last > 0 and last < block_size").select("skey", "block", "last")) if few else placed.where("last > 0 and last < block_size").select("skey", "block", "last")
    inside = dealt.join(ends, ["skey", "block"]).groupBy("skey", "block", "h").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("alike"), F.first("last").alias("last"))
    inside = inside.withColumn("upto", F.sum("s").over(Window.partitionBy("skey", "block").orderBy("h")))
    cuts = inside.where("upto > last").groupBy("skey", "block").agg(F.min(F.struct(F.col("h").alias("cut"), ((F.col("last") - (F.col("upto") - F.col("s"))) / F.col("alike")).cast("long").alias("cut_words"))).alias("c"))
    out = placed.join(draws, ["skey", "place"]).join(cuts, ["skey", "block"], "left")
    out = out.select(block_key(), "weight", "passes", "last", "draws", F.col("c.cut").alias("cut"), F.col("c.cut_words").alias("cut_words"))
    return settle(out, "mix"), blocks, goal


def block_key() -> Column:
    """Names a block of a source."""
    return F.concat_ws(":", F.col("block"), F.col("skey")).alias("key")


def with_draws(rows: DataFrame, drawn: DataFrame, blocks: int) -> DataFrame:
    """rows (skey, size, h, id) with the passes, last, draws, cut and cut_words of their blocks, null if no leaf draws them."""
    rows = rows.withColumn("block", block_of(F.col("h"), blocks)).withColumn("key", block_key()).drop("block")
    if rows_of(drawn) <= BROADCAST_ROWS:  # a row for each block, so about a thousandth of the documents
        return rows.join(F.broadcast(drawn.drop("weight")), "key", "left").drop("key")
    total = drawn.agg(F.sum("weight")).first()[0]
    return attach(rows, F.col("key"), drawn, "key", "weight", total, F.struct("id", "h")).drop("key")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    """id, skey, source, size and h of a document."""
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    source, number = F.col(source_col).cast("string"), F.col(id_col).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), source), F.lit("none"))
    return [number.alias("id"), key.alias("skey"), source.alias("source"), words.alias("size"), F.xxhash64(F.lit(seed), number, F.col(text_col).cast("string")).alias("h")]


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, shards (of its copies).

    taken counts the words of the draws that the tree's leaves make of the document's block, repeats included; a source's
    sum to its rounded target, but for fewer
    words than there are rows alike where the last pass ends between repeated rows. A null text has size 0
    and is taken 0 times over; null sources are one source, the last; ids may be null or repeated. All
    draws are hashes of ids and texts, so reruns agree. An empty table gives no rows.
    """
    rows = settle(docs.select(*sized(docs, id_col, text_col, source_col, seed)), "sizes")
    drawn, n, goal = plan(rows, seed)
    joined = with_draws(rows, drawn, n)
    if rows_of(goal) <= BROADCAST_ROWS:
        joined = joined.join(F.broadcast(goal), "skey")
    else:
        counted = goal.join(rows.groupBy("skey").agg(F.count(F.lit(1)).alias("rows")), "skey").withColumnRenamed("skey", "k")
        joined = attach(joined, F.col("skey"), settle(counted, "counted"), "k", "rows", rows_of(rows), F.struct("id", "h"))
    last = F.when(F.col("cut").isNull() | (F.col("h") < F.col("cut")), F.col("size")).when(F.col("h") == F.col("cut"), F.col("cut_words")).otherwise(F.lit(0))
    words = F.transform("draws", lambda d: F.when(d["pass"] < F.col("passes"), F.col("size")).when(F.col("last") > 0, last).otherwise(F.lit(0)))
    total = F.coalesce(F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    shards = F.coalesce(F.transform("draws", lambda d: d["shard"]), F.array().cast("array<int>"))
    return joined.select(F.col("id").alias("doc_id"), "size", "source_size", "target", total.alias("taken"), shards.alias("shards"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The mixture itself: rows of docs, each as often as it is drawn, dealt to shards and shuffled within them.

    Documents stay whole, so a source can differ from its target by half a document. Documents
    without words are drawn with their block. Columns are those of docs, whatever their names.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, inner))
    columns = sized(docs, own[id_col], own[text_col], own[source_col], seed)
    rows = docs.toDF(*inner)
    drawn, n, _ = plan(settle(rows.select(*columns), "sizes"), seed)
    joined = with_draws(rows.select(*inner, *columns).drop("source"), drawn, n)
    in_last = F.col("cut").isNull() | (F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & (2 * F.col("cut_words") >= F.col("size")))
    copies = joined.withColumn("draw", F.explode(F.filter("draws", lambda d: (d["pass"] < F.col("passes")) | in_last)))
    copies = copies.withColumn("local", F.xxhash64(F.lit(seed), "draw", "h"))
    return copies.repartition("draw.shard").sortWithinPartitions("draw.shard", "local").select(*[F.col(c).alias(name) for c, name in zip(inner, docs.columns)])
