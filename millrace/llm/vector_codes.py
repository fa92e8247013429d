"""Compression of vectors to product codes, by Lloyd rounds that shuffle only what changed.

A vector is cut into parts, and each part position has a codebook of a few entries. A round is one pass over a table that
holds each vector beside its previous codes: a part's nearest entry is found, and if it isn't the previous one, the part is
taken from the sums of its old entry and added to those of the new one. A task adds these changes up and gives them as at most
parts x entries x (width + 1) rows, so the shuffle of a round is bounded by the tasks, and what it carries shrinks as
assignments settle. The running sums are whole numbers, so they are the same in any order of rows, and after any retry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import shared
from millrace.llm.shared import attach, discard, settle

#: Scaled components are kept within plus and minus this, so that distances of up to 64 components fit 64 bits.
LARGEST = 1 << 27
#: Float products are exact while all components are below this in size.
EXACT = 1 << 23
#: Vectors that are looked at together.
CHUNK = 8_192


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors, and the codebooks: for each part an array of entries by components.

    The rows are id, label, code (binary, one byte for each part: the entry's index) and error (squared distances to the entries,
    summed over parts), one for each vector that takes part; repeated ids and vectors are as many rows. Components become
    floor(scale * x), at most LARGEST in size. Null vectors, and those with a null or non-finite component, take no part, nor do
    those whose length isn't the table's (the most frequent length that parts divide; ties: the shorter).
    Codebooks start as the parts of the vectors with the smallest ids (ties: the smaller vector, null ids last); with fewer
    vectors than entries there are fewer entries. Each round assigns (ties to the lower index), then moves each entry to the
    floor of its parts' mean; an entry without parts stays. Ids and labels may be null, and other columns have any names.
    An empty table gives no rows and no codebooks. The table of vectors is rewritten in each round, the older one deleted.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index is one byte")
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    # a null component makes the condition null, which is not true
    usable = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    length = F.size(vector_col)
    kept = vectors.where(usable & (length > 0) & (length % parts == 0))
    rows = kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole.alias("v"), F.lit(None).cast("binary").alias("code"))
    rows = settle(rows, "vectors")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return rows.select("id", "label", "code", F.lit(0).cast("long").alias("error")), []
    rows_of_length = lambda df: df.where(F.size("v") == common["d"])
    first = rows_of_length(rows).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = list(np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2))
    sums = [np.zeros((b.shape[0], b.shape[1] + 1), np.int64) for b in books]
    for step in range(rounds + 1):
        last = step == rounds
        coded = settle(assigned(rows_of_length(rows), books, last), "codes")
        discard(rows)
        if last:
            return coded.select("id", "label", "code", "error"), books
        # at most parts x entries x (width + 1) rows, whatever the number of vectors
        for r in coded.where("part IS NOT NULL").groupBy("part", "entry", "at").agg(F.sum("value").alias("value")).collect():
            sums[r["part"]][r["entry"], r["at"]] += r["value"]
        books = [moved(b, s) for b, s in zip(books, sums)]
        rows = coded
        rows_of_length = lambda df: df.where("part IS NULL")
    raise AssertionError("the last step returns")


def moved(book: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries at the floor of their parts' mean; sums holds each entry's sums and, last, the number of its parts."""
    n = sums[:, -1:]
    return np.where(n > 0, sums[:, :-1] // np.maximum(n, 1), book)


def assigned(rows: DataFrame, books: list[np.ndarray], last: bool) -> DataFrame:
    """rows with new codes, and after them the changes of sums: part, entry, at (component, or width for the count) and value.

    The last pass gives errors, and no vectors or changes.
    """
    fields = [rows.schema["id"], rows.schema["label"], T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]
    fields += [T.StructField(c, T.IntegerType()) for c in ("part", "entry", "at")] + [T.StructField("value", T.LongType())]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    book = rows.sparkSession.sparkContext.broadcast(books)
    return rows.select("id", "label", "v", "code").mapInArrow(lambda batches: assign(batches, book.value, last), schema)


def assign(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
    """A task's rows with their codes, then its changes of sums."""
    parts, width = len(books), books[0].shape[1]
    changes = [np.zeros((b.shape[0], width + 1), np.int64) for b in books]
    names, ids = ["id", "label", "v", "code", "error", "part", "entry", "at", "value"], None
    numbers = lambda a: pa.array(a, pa.int32())
    for whole in batches:
        for at in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(at, CHUNK)
            n, ids = batch.num_rows, (batch.column("id").type, batch.column("label").type)
            vectors = np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), np.int64).reshape(n, parts, width)
            old = batch.column("code")
            before = None if old.null_count else np.frombuffer(b"".join(old.to_pylist()), np.uint8).reshape(n, parts)
            codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
            for p, book in enumerate(books):
                part = np.ascontiguousarray(vectors[:, p])
                codes[:, p], nearest = closest(part, book)
                error += nearest
                if not last:
                    change(changes[p], part, codes[:, p], None if before is None else before[:, p])
            code = pa.array([c.tobytes() for c in codes], pa.binary())
            nulls = [pa.nulls(n, pa.int32()) for _ in range(3)]
            kept = pa.nulls(n, pa.list_(pa.int32())) if last else batch.column("v")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), kept, code, pa.array(error), *nulls, pa.nulls(n, pa.int64())], names)
    if last or ids is None:
        return
    found = [(p, e, c, int(x[e, c])) for p, x in enumerate(changes) for e, c in zip(*map(np.ndarray.tolist, np.nonzero(x)))]
    n, columns = len(found), list(zip(*found)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.nulls(n, ids[0]), pa.nulls(n, ids[1]), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), *map(numbers, columns[:3]), pa.array(columns[3], pa.int64())], names)


def closest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower index, and the squared distance; exact."""
    small = max(int(np.abs(part).max(initial=0)), int(np.abs(book).max(initial=0))) < EXACT
    kind = np.float64 if small else np.int64
    distance = (book * book).sum(1)[None, :] - 2 * (part.astype(kind) @ book.T.astype(kind)).astype(np.int64)
    entry = distance.argmin(1)
    return entry.astype(np.uint8), distance[np.arange(len(part)), entry] + (part * part).sum(1)


def change(sums: np.ndarray, part: np.ndarray, new: np.ndarray, old: np.ndarray | None) -> None:
    """Add the parts whose entry changed to the sums of the new one, and take them from those of the old one."""
    moved = np.arange(len(new)) if old is None else np.flatnonzero(new != old)
    for entries, sign in ((new, 1), (old, -1)):
        if entries is None or not len(moved):
            continue
        order = moved[np.argsort(entries[moved], kind="stable")]
        own, begin = np.unique(entries[order], return_index=True)
        sums[own, :-1] += sign * np.add.reduceat(part[order], begin, axis=0)
        sums[own, -1] += sign * np.diff(np.append(begin, len(order)))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes (id, label, code, error; settled) with label_error, the errors of all rows with an equal label, nulls together.

    A sum beyond 64 bits is null. Errors are added up before they are shuffled; up to BROADCAST_ROWS labels are broadcast, beyond
    that labels meet their rows in a join by key, frequent ones apart.
    """
    key = F.when(F.col("label").isNull(), "null").otherwise(F.concat(F.lit("is"), F.col("label").cast("string")))
    sums = codes.groupBy(key.alias("of")).agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    sums = settle(sums, "labels")
    if shared.rows_of(sums) <= shared.BROADCAST_ROWS:
        return codes.join(F.broadcast(sums.drop("n")), key == F.col("of")).drop("of")
    return attach(codes, key, sums, "of", "n", codes.count(), F.struct("id", "code"))
