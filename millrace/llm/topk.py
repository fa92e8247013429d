"""Exact top-k search by inner product, in tiles.

Queries come in blocks of bounded size, one broadcast at a time, to candidates that stay where they are; a tile is a part of
the block against a batch of candidates, one matrix product, after which each query keeps its k best. A task gives one list for each query; the
lists are merged as a tree: first within groups of tasks, then over the groups. Products are of whole numbers, so they are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import settle

#: Queries and candidates of a tile.
QUERIES, CANDIDATES = 1_024, 2_048
#: Bytes of a block of queries: what one broadcast holds.
BLOCK_BYTES = 32 << 20
#: Tasks whose lists meet in the first merge.
FAN = 16


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other rows.

    queries is a condition on the columns of vectors. Components become floor(scale * x) and
    the score is their inner product; ties go to the smaller id. Rows are known by
    their id: a query's candidates are the rows with another id, each as often as it is
    there, and an id that repeats asks once, with its smallest vector. Rows with a null id or vector, or with a null or non-finite component,
    take no part; a query meets only vectors of its own length. A query with fewer than k
    candidates gets all of them; an empty table gives no rows; other columns may have any names.
    """
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), whole.alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = settle(rows.withColumn("d", F.size("x")), "vectors")
    once = rows.where("asks").groupBy("id").agg(F.min(F.struct("d", "x")).alias("v")).select("id", "v.d", "v.x")
    once = settle(once, "queries")
    # what a block holds is what its vectors take, so blocks are of one size whatever the data
    size = once.agg(F.coalesce(F.sum(8 * F.col("d") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    once = once.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int"))
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    lists = []
    for block in range(blocks):
        asked = rows.sparkSession.sparkContext.broadcast(by_length(once.where(F.col("block") == block).select("d", "id", "x").toArrow()))
        found = rows.select("d", "id", "x").mapInArrow(lambda batches, asked=asked: multiply(batches, asked.value, k), "query_id long, vec_id long, score long, part int")
        lists.append(settle(best(found, "query_id", "part").drop("rank"), "lists"))
        asked.unpersist()
    merged = lists[0].sparkSession.read.schema(lists[0].schema).parquet(*[df.settled_at for df in lists])
    return best(merged, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def by_length(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The ids and the vectors of queries of each length."""
    out, d, t = {}, t.column("d").to_numpy(), t.combine_chunks()
    for n in np.unique(d).tolist():
        part = t.filter(pa.array(d == n)).combine_chunks()
        x = part.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out[n] = (part.column("id").to_numpy(), np.asarray(x, np.int64).reshape(part.num_rows, n))
    return out


def multiply(batches: Iterator[pa.RecordBatch], asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a task's candidates for each query; candidates are taken batch by batch."""
    context = TaskContext.get()
    part = context.partitionId() // FAN if context else 0
    held: dict[tuple[int, int], list[tuple[np.ndarray, ...]]] = {}
    for batch in batches:
        lengths = batch.column("d").to_numpy()
        for d in np.unique(lengths).tolist():
            if d not in asked:
                continue
            some = batch.filter(pa.array(lengths == d)) if len(lengths) and (lengths != d).any() else batch
            x = np.asarray(some.column("x").flatten().to_numpy(zero_copy_only=False), np.int64).reshape(some.num_rows, d)
            own, (ids, matrix) = some.column("id").to_numpy(), asked[d]
            for lo in range(0, len(ids), QUERIES):
                lists = held.setdefault((d, lo), [])
                for at in range(0, len(own), CANDIDATES):
                    q, v, s = select(ids[lo : lo + QUERIES], matrix[lo : lo + QUERIES], own[at : at + CANDIDATES], x[at : at + CANDIDATES], k)
                    lists.append((q, v, s))
                if len(lists) > 8:
                    held[d, lo] = [shortest(*[np.concatenate(c) for c in zip(*lists)], k)]
    for (d, lo), lists in held.items():
        q, v, s = shortest(*[np.concatenate(c) for c in zip(*lists)], k)
        yield pa.RecordBatch.from_arrays([pa.array(asked[d][0][lo + q]), pa.array(v), pa.array(s), pa.array(np.full(len(v), part, np.int32))], ["query_id", "vec_id", "score", "part"])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact product: in floats while every sum is below 2 ** 53, else in whole numbers."""
    largest = lambda m: int(np.abs(m).max()) if m.size else 0
    if largest(a) * largest(b) * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def select(ids: np.ndarray, matrix: np.ndarray, own: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of these candidates: (query's row, id, score)."""
    order = np.argsort(own, kind="stable")
    own, x = own[order], x[order]
    score = product(matrix, x)
    other = ids[:, None] != own[None, :]
    lowest = np.iinfo(np.int64).min
    masked = np.where(other, score, lowest)
    if len(own) > k:
        least = np.partition(masked, len(own) - k, axis=1)[:, len(own) - k]
        level = other & (score == least[:, None])  # candidates stand by id, so the first k of those level are enough
        other = other & (score > least[:, None]) | level & (np.cumsum(level, axis=1, dtype=np.int32) <= k)
    q, c = np.nonzero(other)
    return shortest(q, own[c], score[q, c], k)


def shortest(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first entries of each query by falling score, then id."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    begin = np.concatenate(([0], np.flatnonzero(q[1:] != q[:-1]) + 1)) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    keep = place < k
    return q[keep], v[keep], s[keep]
