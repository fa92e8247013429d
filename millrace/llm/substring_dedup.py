"""Removing long repeated byte strings from a corpus by suffix arrays and longest previous factors.

Semantics: a string of `length` bytes that starts at two places is repeated;
suffixes are sorted as far as `length` bytes, and the previous and next smaller
positions in that order give each one's longest earlier match. One suffix array over the
corpus would have to sit in one place, so suffixes are dealt to many arrays by
keys that suffixes with equal beginnings share, and what keyed counts decide already never enters one:

1. Each window of `length` bytes has an anchor, its smallest GRAM-byte hash (the leftmost, if
   level). Equal windows have equal anchors at equal places, so only windows
   with an anchor that occurs again can be repeated. About one position in 170 is an anchor.
2. The windows of such an anchor are taken STEP at a time. The string that they
   cover together (`full`) settles all of them at once if it occurs again. Of each
   distinct `full`, one row goes on, if the bytes that its windows share (`core`) occur again.
3. Rows with equal cores meet in a bucket, which sorts the suffixes that start at their
   windows and reads their longest previous factors off the array. Cores with more than HOT rows don't enter:
   their windows are counted by fingerprints, so that no bucket gathers a hot core.

Every count is a partial aggregation and a join that keeps hot keys out
of the shuffle, so a passage that a third of all documents share is never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel
from millrace.llm.shared import BROADCAST_ROWS, attach, distinct_texts, join_texts, rows_of, settle, text_keys

GRAM, STEP = 50, 32
#: Bits of a position in a segment; longer texts are read as segments that overlap.
BITS = 21
#: Rows for each bucket of suffixes, and rows above which a core's windows are counted instead.
BUCKET, HOT = 512, 2048
U = np.uint64


def segments(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row of each stretch, its place in the row); stretches of one row overlap by length - 1."""
    for row, data, offsets in kernel.slices(column):
        if len(data) < 1 << BITS:
            yield data, offsets, np.arange(row, row + len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
            continue
        size = (1 << BITS) - 1
        for at in range(0, len(data) - length + 1, size - length + 1):
            part = data[at : at + size]
            yield part, np.array([0, len(part)]), np.array([row]), np.array([at])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive entries, from running minima within blocks."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rows = -(-len(x) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(x)] = x
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One row for each anchor of a text: g, its hash; p, its place; i0 and i1, the first and last window that it stands for."""
    for batch in batches:
        for data, offsets, rows, base in segments(batch.column("text"), length):
            if len(data) < length:
                continue
            grams = len(data) - GRAM + 1
            at = np.arange(grams)
            g = kernel.gram_hashes(data, GRAM)
            low = U((1 << BITS) - 1)
            least = sliding_least((g & ~low) | at.astype(np.uint64), length - GRAM + 1)
            p = (least & low).astype(np.int64)
            row = np.repeat(np.arange(len(rows)), np.diff(offsets))[: len(p)]
            good = np.flatnonzero(at[: len(p)] + length <= offsets[row + 1])
            if not len(good):
                continue
            new = np.ones(len(good), bool)
            new[1:] = (p[good[1:]] != p[good[:-1]]) | (good[1:] != good[:-1] + 1)
            i0 = good[new]
            i1 = good[np.append(np.flatnonzero(new)[1:] - 1, len(good) - 1)]
            own = row[i0]
            shift = base[own] - offsets[own]
            take = pa.array(rows[own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[p[i0]].view(np.int64)), batch.column("t1").take(take), batch.column("t2").take(take), *[pa.array((x + shift).astype(np.int64)) for x in (p[i0], i0, i1)]],
                ["g", "t1", "t2", "p", "i0", "i1"],
            )


RANGES = "t1 long, t2 long, first_id long, place long, full long, core long, lo int, hi int"


def ranges(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The windows of the given anchors, STEP at a time by their distance to the anchor.

    place is the last window of the range, lo and hi the distances back from it of the windows that count.
    """
    for batch in batches:
        lists = batch.column("runs")
        for k in range(batch.num_rows):
            text = batch.column("text")[k].as_py()
            data = np.frombuffer(text.encode(), np.uint8)
            runs = lists[k].values
            p, i0, i1 = (runs.field(c).to_numpy() for c in ("p", "i0", "i1"))
            if len(np.unique(p)) < len(p):  # a run that two segments hold parts of
                p, at = np.unique(p, return_inverse=True)
                low, high = np.full(len(p), np.iinfo(np.int64).max), np.zeros(len(p), np.int64)
                np.minimum.at(low, at, i0)
                np.maximum.at(high, at, i1)
                i0, i1 = low, high
            j0, j1 = (p - i1) // STEP, (p - i0) // STEP
            n = j1 - j0 + 1
            run = np.repeat(np.arange(len(p)), n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + j0[run]
            last = p[run] - STEP * j
            first = last - STEP + 1
            spans = kernel.hasher(data)
            # with j, so that ranges of two anchors in one text are never taken for each other
            level = kernel.mix(j.astype(np.uint64) + U(1))
            core = spans(last, first + length) ^ level
            whole = (first >= 0) & (last + length <= len(data))
            full = np.where(whole, spans(np.maximum(first, 0), np.minimum(last + length, len(data))) ^ level, U(0))
            lo, hi = np.maximum(last - i1[run], 0), np.minimum(last - i0[run], STEP - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(np.full(len(last), batch.column(c)[k].as_py(), np.int64)) for c in ("t1", "t2")],
                    pa.array([batch.column("first_id")[k].as_py()] * len(last), pa.int64()),
                    pa.array(last),
                    pa.array(full.view(np.int64), mask=~whole),
                    pa.array(core.view(np.int64)),
                    pa.array(lo.astype(np.int32)),
                    pa.array(hi.astype(np.int32)),
                ],
                [x.split()[0] for x in RANGES.split(", ")],
            )


EXTRACTS = "core long, many boolean, t1 long, t2 long, first_id long, start long, body binary"


def extracts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes that the open windows of each asked range cover, from the first one's start on."""
    for batch in batches:
        asked = batch.column("asked")
        for k in range(batch.num_rows):
            raw = batch.column("text")[k].as_py().encode()
            place, lo, hi = (asked[k].values.field(c).to_numpy().astype(np.int64) for c in ("place", "lo", "hi"))
            own = [pa.array([batch.column(c)[k].as_py()] * len(place), pa.int64()) for c in ("t1", "t2", "first_id")]
            body = [raw[a:b] for a, b in zip((place - hi).tolist(), (place - lo + length).tolist())]
            yield pa.RecordBatch.from_arrays([asked[k].values.field("core"), asked[k].values.field("many"), *own, pa.array(place - hi), pa.array(body, pa.binary())], [x.split()[0] for x in EXTRACTS.split(", ")])


def bodies(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and of each window its row, its first byte, and its distance from the row's first."""
    column = column.cast(pa.large_binary())
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data, at = np.frombuffer(raw, np.uint8)[at[0] : at[-1]], at - at[0]
    n = np.diff(at) - length + 1
    row = np.repeat(np.arange(len(n)), n)
    ahead = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return data, row, at[row] + ahead, ahead


def previous_factors(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each position the length of its longest previous factor, and where that starts (-1: nowhere).

    order has the positions in suffix order, lcp what each shares with the one before it. A stack
    holds positions that rise; the entry below a position is its previous smaller one, and what
    removes it from the stack is its next smaller one (Crochemore and Ilie).
    """
    factor, source = [0] * len(order), [-1] * len(order)
    stack: list[tuple[int, int]] = []
    for at, common in zip([*order.tolist(), -1], [*lcp.tolist(), 0]):
        while stack and at < stack[-1][0]:
            top, below = stack.pop()
            factor[top] = max(below, common)
            source[top] = (stack[-1][0] if below >= common else at) if factor[top] else -1
            common = min(below, common)
        stack.append((at, common))
    return np.array(factor, np.int64), np.array(source, np.int64)


def sorted_bucket(bucket: pa.Table, length: int, keep_first: bool) -> pa.Table:
    """t1, t2, start, end of the repeated windows of a bucket, as runs, from the suffix array of its windows."""
    late = pc.is_null(bucket.column("first_id"))
    bucket = bucket.append_column("late", late).sort_by([(c, "ascending") for c in ("late", "first_id", "t1", "t2", "start")])
    data, row, first, ahead = bodies(bucket.column("body").combine_chunks(), length)
    # a suffix's number is its place in the order of documents and positions
    suffix = np.lib.stride_tricks.sliding_window_view(data, length)[first]
    order = np.argsort(suffix.view(f"S{length}").ravel(), kind="stable")
    differ = suffix[order[1:]] != suffix[order[:-1]]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    factor, source = previous_factors(order, np.append(0, shared))
    goes = factor >= length
    if not keep_first:  # an earlier match goes too
        goes[source[goes]] = True
    at = np.flatnonzero(goes)
    new = np.append(True, (np.diff(at) > 1) | (np.diff(row[at]) > 0))[: len(at)]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)[: new.sum()]
    take = pa.array(row[at[new]])
    start = bucket.column("start").combine_chunks().to_numpy()[row[at[new]]]
    spans = [pa.array(start + ahead[at[new]]), pa.array(start + ahead[at[last]] + length)]
    return pa.table([bucket.column("t1").take(take), bucket.column("t2").take(take), *spans], ["t1", "t2", "start", "end"])


def windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A fingerprint of each window."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, row, first, ahead = bodies(batch.column("body"), length)
        w = kernel.hasher(data)(first, first + length)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), *[batch.column(c).take(take) for c in ("t1", "t2", "first_id")], pa.array(batch.column("start").to_numpy()[row] + ahead)], ["w", "t1", "t2", "first_id", "place"])


def repeated_spans(docs: DataFrame, texts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """t1, t2, spans: for each distinct text the byte spans [start, end) that are to go, overlapping ones not yet merged.

    docs has doc_id, text, t1, t2; texts has t1, t2, copies, first_id. Copies of whole texts are left to the caller.
    """
    single = distinct_texts(docs.where(F.octet_length("text") >= length), texts)
    place = F.struct(F.col("first_id").isNull(), "first_id", "t1", "t2", "place")

    runs = settle(single.mapInArrow(lambda b: anchors(b, length), "g long, t1 long, t2 long, p long, i0 long, i1 long"), "anchors")
    total = rows_of(runs)
    often = settle(runs.groupBy("g").agg(F.count(F.lit(1)).alias("weight")).where("weight > 1").withColumn("again", F.lit(True)), "often")
    picked = attach(runs, F.col("g"), often, "g", "weight", total, F.struct("t1", "t2", "p"), "inner")
    picked = settle(picked.groupBy("t1", "t2").agg(F.collect_list(F.struct("p", "i0", "i1")).alias("runs")).join(texts.select("t1", "t2", "first_id"), ["t1", "t2"]), "picked")
    parts = settle(join_texts(single, picked, rows_of(picked)).select("t1", "t2", "first_id", "text", "runs").mapInArrow(lambda b: ranges(b, length), RANGES), "ranges")

    def classes(rows: DataFrame, key: str, name: str) -> DataFrame:
        return settle(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("weight"), F.min(place).alias("earliest")).where("weight > 1").withColumn("again", F.lit(True)), name)

    goes = F.coalesce(F.col("again") & (~F.col("earliest").eqNullSafe(place) if keep_first else F.lit(True)), F.lit(False))
    leads = F.coalesce(F.col("earliest").eqNullSafe(place), F.lit(True))
    total = rows_of(parts)
    named = F.coalesce(F.col("full"), F.xxhash64("t1", "t2", "place", "lo"))  # a range that has no full string has a key of its own
    seen = attach(parts, named, classes(parts, "full", "full"), "full", "weight", total, F.struct("t1", "t2", "place"))
    seen = settle(seen.select("t1", "t2", "first_id", "place", "core", "lo", "hi", goes.alias("goes"), F.when(F.col("again").isNull(), F.lit(True)).otherwise(leads).alias("leads")), "seen")
    settled = seen.where("goes").select("t1", "t2", (F.col("place") - STEP + 1).alias("start"), (F.col("place") + length).alias("end"))
    open_ = seen.where("leads").select("t1", "t2", "first_id", "place", "core", "lo", "hi")
    cores = settle(open_.groupBy("core").agg(F.count(F.lit(1)).alias("weight")).where("weight > 1").withColumn("many", F.col("weight") > HOT), "cores")
    closer = attach(open_, F.col("core"), cores, "core", "weight", total, F.struct("t1", "t2", "place"), "inner")
    asked = settle(closer.groupBy("t1", "t2").agg(F.first("first_id").alias("first_id"), F.collect_list(F.struct("place", "lo", "hi", "core", "many")).alias("asked")), "asked")
    bytes_ = settle(join_texts(single, asked, rows_of(asked)).select("t1", "t2", "first_id", "text", "asked").mapInArrow(lambda b: extracts(b, length), EXTRACTS), "extracts")
    few = bytes_.where("not many")
    buckets = max(1, -(-few.count() // BUCKET))
    bucketed = few.select(F.pmod(F.xxhash64("core"), F.lit(buckets)).alias("bucket"), "t1", "t2", "first_id", "start", "body").groupBy("bucket")
    by_array = bucketed.applyInArrow(lambda t: sorted_bucket(t, length, keep_first), "t1 long, t2 long, start long, end long")
    each = settle(bytes_.where("many").select("t1", "t2", "first_id", "start", "body").mapInArrow(lambda b: windows(b, length), "w long, t1 long, t2 long, first_id long, place long"), "windows")
    found = attach(each, F.col("w"), classes(each, "w", "alike"), "w", "weight", rows_of(each), F.struct("t1", "t2", "place"), "inner")
    by_count = found.where(goes).select("t1", "t2", F.col("place").alias("start"), (F.col("place") + length).alias("end"))
    return settled.unionByName(by_array).unionByName(by_count).groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def cut(batches: Iterator[pa.RecordBatch], length: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for text, spans, whole in zip(*[batch.column(c) for c in ("text", "spans", "whole")]):
            raw = (text.as_py() or "").encode()
            merged: list[list[int]] = []
            if whole.as_py() and len(raw) >= length:
                merged = [[0, len(raw)]]
            elif spans.is_valid:
                for a, b in sorted(zip(spans.values.field("start").to_pylist(), spans.values.field("end").to_pylist())):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
            at, rest = 0, []
            for a, b in merged:
                rest.append(raw[at:a])
                at = b
            left = b"".join([*rest, raw[at:]])
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(left))
            out["n_spans"].append(len(merged))
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            out["kept"].append(left.decode(errors="ignore") if with_text else None)
        others = [c for c in batch.schema.names if c not in ("text", "spans", "whole")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *[pa.array(v, t) for v, t in zip(out.values(), kinds)]], [*others, *out])


def substring_dedup(docs: DataFrame, length: int = 400, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining text).

    Each byte that a repeated string of `length` bytes covers goes; with keep_first the
    earliest occurrence, by smallest id and then position, stays. Matches never
    cross documents and are judged on the input. Null texts are empty; texts shorter than
    `length` never lose bytes; null ids come last; rows with equal id and text are
    alike; other columns are not read; an empty table gives no rows. `kept` leaves out
    bytes of a character that is cut in two, kept_sha256 does not.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = named.withColumns(text_keys())
    texts = settle(keyed.where(F.octet_length("text") >= length).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")), "texts")
    spans = repeated_spans(keyed, texts, length, keep_first)
    verdict = settle(texts.join(spans, ["t1", "t2"], "left").where("copies > 1 or spans is not null").select(F.concat_ws(":", "t1", "t2").alias("k"), F.col("copies").alias("weight"), (F.col("copies") > 1).alias("many"), F.col("first_id").alias("first"), "spans"), "verdict")
    size = docs.sparkSession.read.schema(verdict.schema).parquet(verdict.settled_at).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("m"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    key = F.concat_ws(":", "t1", "t2")
    if max(size.n, size.m) <= BROADCAST_ROWS:
        judged = keyed.withColumn("k", key).join(F.broadcast(verdict.drop("weight")), "k", "left")
    else:
        judged = attach(keyed, key, verdict, "k", "weight", size.w, F.struct("doc_id", "t1"))
    later = ~F.col("doc_id").eqNullSafe(F.col("first")) if keep_first else F.lit(True)
    whole = F.coalesce(F.col("many") & later, F.lit(False)).alias("whole")
    return judged.select("doc_id", "text", "spans", whole).mapInArrow(lambda b: cut(b, length, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
