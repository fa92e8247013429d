"""Best-fit packing of documents into token sequences by bin completion.

Only the histogram of piece lengths matters to the packing, and it has at most
`capacity` entries whatever the data, so the search runs on it: bin completion
takes the largest length left, branches over the undominated fillings around
it, applies each filling to as many bins as the counts allow, and prunes
branches by the waste that a better packing could still afford. Best-fit
decreasing gives the incumbents. The pieces themselves stay distributed: each
gets a rank among the pieces of its length, and a rank names a place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import transducer
from millrace.llm.shared import settle

#: Search steps of the branch-and-bound; the best incumbent stands when they are used up.
STEPS = 400
#: Pieces for each group in which ranks are dealt.
RANKED = 20_000

Bins = list[tuple[tuple[tuple[int, int], ...], int]]


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by total size, and by pieces that can't share a bin (Martello and Toth's L2)."""
    length, half = np.arange(len(count)), capacity // 2
    number, size = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(length * count)))
    a = np.arange(half + 1)
    over = capacity - a + 1  # pieces of this length or more stand alone beside pieces of length a
    alone, paired = number[capacity + 1] - number[over], number[over] - number[half + 1]
    room = paired * capacity - (size[over] - size[half + 1])
    small = size[half + 1] - size[a]
    return int(max(-(-size[-1] // capacity), (alone + paired + np.maximum(0, -(-(small - room) // capacity))).max()))


def best_fit(count: np.ndarray, capacity: int) -> Bins:
    """Best-fit decreasing on the histogram; bins alike are one entry with their number."""
    room: dict[int, list[list]] = {}
    spaces: list[int] = []

    def put(r: int, filled: tuple, n: int) -> None:
        if r not in room:
            room[r] = []
            spaces.insert(bisect_right(spaces, r), r)
        room[r].append([filled, n])

    for length in range(capacity, 0, -1):
        left = int(count[length])
        while left:
            at = bisect_right(spaces, length - 1)
            if at < len(spaces):
                r = spaces[at]
                filled, n = room[r].pop()
                if not room[r]:
                    del room[r]
                    spaces.pop(at)
            else:
                r, filled, n = capacity, (), left
            fit = r // length
            full = min(n, left // fit)
            if full:
                put(r - fit * length, (*filled, (length, fit)), full)
                left, n = left - full * fit, n - full
            if n and left:  # fewer pieces than one bin takes
                put(r - left * length, (*filled, (length, left)), 1)
                left, n = 0, n - 1
            if n and filled:
                put(r, filled, n)
    return [(filled, n) for groups in room.values() for filled, n in groups]


def fillings(count: np.ndarray, room: int, spare: int, most: int = 12) -> list[tuple[int, ...]]:
    """Undominated ways to fill room with up to three pieces and at most spare waste, least waste first.

    A set of pieces that fits into one piece of another set is dominated by
    it, so a pair must be larger than the best single piece, and a triple than that pair.
    """
    there = [int(x) for x in np.flatnonzero(count[: room + 1]) if x]
    if not there:
        return [()] if room <= spare else []
    single = there[-1]
    out = {(single,): room - single} if room - single <= spare else {}
    if single < room:
        for a in reversed(there):
            b = bisect_right(there, min(a, room - a)) - 1
            if b < 0:
                continue
            if there[b] == a and count[a] < 2:
                b -= 1
                if b < 0:
                    continue
            b = there[b]
            if a + b > single and room - a - b <= spare:
                out[(a, b)] = room - a - b
            if a + b < room:
                c = bisect_right(there, min(b, room - a - b)) - 1
                while c >= 0 and count[there[c]] < (a, b).count(there[c]) + 1:
                    c -= 1
                if c >= 0 and a + b + there[c] > single and room - a - b - there[c] <= spare:
                    out[(a, b, there[c])] = room - a - b - there[c]
            if 3 * a < single:
                break
    return sorted(out, key=lambda f: (out[f], tuple(-x for x in f)))[:most]


def applied(left: np.ndarray, largest: int, filling: tuple[int, ...], n: int | None) -> tuple[np.ndarray, int, tuple]:
    """left without n bins of the largest piece and the filling; without n, as many as there are pieces for."""
    need = {x: (largest, *filling).count(x) for x in (largest, *filling)}
    n = n or min(int(left[x]) // k for x, k in need.items())
    left = left.copy()
    for x, k in need.items():
        left[x] -= n * k
    return left, n, tuple(sorted(need.items(), reverse=True))


def complete(count: np.ndarray, capacity: int, steps: int = STEPS) -> Bins:
    """The fewest bins found: best-fit decreasing, bettered by bin completion until the bound or the steps are reached."""
    number = lambda bins: sum(n for _, n in bins)
    total = int((np.arange(len(count)) * count).sum())
    bound, best = lower_bound(count, capacity), best_fit(count, capacity)
    fewest, used = number(best), 0
    later = [(count.copy(), None, 0, 0)]
    while later and fewest > bound and used < steps:
        left, done, bins, waste = later.pop()
        if callable(left):
            left, n, filled = left()
            done = (done, (filled, n))
        while fewest > bound and used < steps:
            there = np.flatnonzero(left)
            rest = best_fit(left, capacity) if used % 8 == 0 or not len(there) else None
            used += 1
            if rest is not None and bins + number(rest) < fewest:
                best, at = list(rest), done
                while at is not None:
                    best.append(at[1])
                    at = at[0]
                fewest = number(best)
            spare = (fewest - 1) * capacity - total - waste
            if not len(there) or spare < 0 or bins + lower_bound(left, capacity) >= fewest:
                break
            largest = int(there[-1])
            without = left.copy()
            without[largest] -= 1
            choices = fillings(without, capacity - largest, spare)
            if not choices:
                break
            for f in reversed(choices[1:]):  # looked at after the branch of least waste
                later.append((lambda left=left, largest=largest, f=f: applied(left, largest, f, 1), done, bins + 1, waste + capacity - largest - sum(f)))
            left, n, filled = applied(left, largest, choices[0], None)
            done, bins, waste = (done, (filled, n)), bins + n, waste + n * (capacity - largest - sum(choices[0]))
    return best


def places(bins: Bins) -> dict[str, np.ndarray]:
    """Runs of places, sorted by length and first rank."""
    rows, rank, first = [], {}, 0
    for filled, n in bins:
        offset = 0
        for length, k in filled:
            start = rank.get(length, 0)
            rows.append((length, start, k, first, offset))
            rank[length] = start + n * k
            offset += length * k
        first += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "start": table[:, 1], "each": table[:, 2], "bin": table[:, 3], "offset": table[:, 4]}


def pieces(docs: DataFrame, vocabulary: str, capacity: int, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """Pieces of at most capacity ids; only longer documents are cut."""
    source = docs.sparkSession.sparkContext.broadcast(transducer.read(vocabulary))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer.compiled(*source.value)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(machine.ids(batch.column("text"))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            own = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id, so a null or empty text is one piece of one id.
    Pieces of a sequence fill it from offset 0 without gaps and never beyond capacity.
    Ids may be null or repeated; other columns are not read; an empty table gives no rows.
    """
    cut = settle(pieces(docs, vocabulary, capacity, id_col, text_col, end_id), "pieces")
    # at most `capacity` rows reach the driver, whatever the input
    count = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():
        count[length] = n
    runs = cut.sparkSession.sparkContext.broadcast(places(complete(count, capacity)))
    groups = max(1, -(-int(count.sum()) // RANKED))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    before = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = settle(before.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n"), "ranks")
    # both sides are dealt by length and part for the windows already; a table of lengths and parts grows with the pieces, so it is not broadcast
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(order) - 1).join(before.hint("merge"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("own"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = runs.value
        stride = np.int64(1 << 40)
        keys = t["length"] * stride + t["start"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * stride + rank, "right") - 1
            inside = rank - t["start"][at]
            bin_, offset = t["bin"][at] + inside // t["each"][at], t["offset"][at] + inside % t["each"][at] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(bin_), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
