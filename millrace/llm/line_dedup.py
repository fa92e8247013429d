"""Dropping recurring lines with a log-template tree.

The tree has a fixed depth: a line goes to the leaf of its token count and its
DEPTH leading tokens. Tokens with a digit are variable fields from the start.
In a leaf, a token that doesn't recur in its column is a variable field too,
and what is left is the line's template. Templates that recur in enough
different texts, and are constant enough to be one line and not many, are dropped from
all documents but the first that has them.

A log parser grows its templates line by line, so they depend on the order.
Here each level is a count that merges in any order: lines of a leaf, tokens of a column, texts
of a template. Only lines of recurring leaves are looked at closer, and no leaf is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel
from millrace.llm.shared import BROADCAST_ROWS, attach, distinct_texts, join_texts, rows_of, settle, text_keys

#: Leading tokens of a leaf; texts in which a template recurs; share of tokens that must be constant; fewest tokens.
DEPTH, TEXTS, CONSTANT_PERCENT, TOKENS = 3, 10, 60, 3
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
U = np.uint64


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Token hashes (0 for those with a digit), each line's first token, each row's first line, and each line's leaf."""
    start, end, _ = kernel.words(data, offsets)
    h = kernel.spans_hash(data, start, end)
    digits = np.concatenate(([0], np.cumsum(DIGIT[data])))
    h[digits[end] > digits[start]] = 0
    line_start, _, first_line = kernel.lines(data, offsets)
    first = np.append(np.searchsorted(start, line_start), len(start))
    n = np.diff(first)
    padded = np.concatenate((h, np.zeros(DEPTH, np.uint64)))
    leaf = n.astype(np.uint64) * kernel.PLACE[20]
    for k in range(DEPTH):
        leaf += np.where(n > k, padded[first[:-1] + k] * kernel.PLACE[21 + k] + U(k + 1), U(0))
    return h, first, first_line, kernel.mix(leaf)


def leaves(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One row for each leaf of each text, with the numbers of its lines."""
    for batch in batches:
        for row, data, offsets in kernel.slices(batch.column("text")):
            _, first, first_line, leaf = tokens(data, offsets)
            rows = len(offsets) - 1
            own = np.repeat(np.arange(rows), np.diff(first_line))
            line = np.arange(len(leaf)) - first_line[own]
            some = np.diff(first) >= least
            own, line, leaf = own[some], line[some], leaf[some]
            order = np.lexsort((line, leaf, own))
            own, line, leaf = own[order], line[order], leaf[order]
            new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (leaf[1:] != leaf[:-1]))) if len(own) else np.zeros(0, np.int64)
            take = pa.array(own[new] + row)
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(own)).astype(np.int32)), pa.array(line.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("t1").take(take), batch.column("t2").take(take), pa.array(leaf[new].view(np.int64)), lists], ["t1", "t2", "leaf", "lines"])


def chosen(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Of the given lines of the rows, in slices: their rows, numbers and leaves, and each token's line (as an index), token, and key of leaf, column and token."""
    lists = batch.column("lines")
    for row, data, offsets in kernel.slices(batch.column("text")):
        h, first, first_line, leaf = tokens(data, offsets)
        given = [np.sort(lists[row + k].values.to_numpy()) for k in range(len(offsets) - 1)]
        own = np.repeat(np.arange(len(given)), [len(x) for x in given])
        number = np.concatenate(given).astype(np.int64)
        line = first_line[own] + number
        n = np.diff(first)[line]
        which = np.repeat(np.arange(len(line)), n)
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        token = h[first[line][which] + pos]
        yield own + row, number, leaf[line], which, token, kernel.mix(leaf[line][which] + pos.astype(np.uint64) * kernel.PLACE[30] + token * kernel.PLACE[31])


def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each different leaf, column and token of a text; tokens with a digit are never constant and have none."""
    for batch in batches:
        for row, _, _, which, token, key in chosen(batch):
            own, key = row[which][token != 0], key[token != 0]
            order = np.lexsort((key, own))
            own, key = own[order], key[order]
            new = np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1]))[: len(own)]
            take = pa.array(own[new])
            yield pa.RecordBatch.from_arrays([batch.column("t1").take(take), batch.column("t2").take(take), pa.array(key[new].view(np.int64))], ["t1", "t2", "key"])


def templates(batches: Iterator[pa.RecordBatch], percent: int, constants: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The templates of the given lines that are constant enough; constants has all constant tokens, sorted, or else a row's keys its own."""
    for batch in batches:
        salt = np.zeros(batch.num_rows, np.uint64)
        known = constants
        if known is None:  # a key counts in its own row only
            salt = kernel.mix(np.arange(1, batch.num_rows + 1, dtype=np.uint64) * kernel.PLACE[34])
            lists = batch.column("keys")
            sizes = np.array([len(x) for x in lists], np.int64)
            known = np.sort(lists.flatten().to_numpy().view(np.uint64) ^ np.repeat(salt, sizes))
        for row, number, leaf, which, token, key in chosen(batch):
            sought = key ^ salt[row][which]
            at = np.minimum(np.searchsorted(known, sought), max(len(known) - 1, 0))
            constant = (token != 0) & (known[at] == sought) if len(known) else np.zeros(len(key), bool)
            n, fixed = (np.bincount(which, w, len(number)) for w in (None, constant))
            # a key names leaf, column and token, so a sum of keys names the constant tokens with their columns
            total = np.zeros(len(number), np.uint64)
            np.add.at(total, which[constant], kernel.mix(key[constant] ^ kernel.PLACE[32]))
            keep = 100 * fixed >= percent * n
            take = pa.array(row[keep])
            name = kernel.mix(total + leaf * kernel.PLACE[33])[keep]
            yield pa.RecordBatch.from_arrays([batch.column("t1").take(take), batch.column("t2").take(take), pa.array(number[keep].astype(np.int32)), pa.array(name.view(np.int64))], ["t1", "t2", "line", "template"])


def recurring(keyed: DataFrame, texts: DataFrame, least_texts: int, percent: int, least_tokens: int) -> DataFrame:
    """t1, t2, lines: the numbers of the lines that each text is to lose."""
    single = distinct_texts(keyed, texts)
    held = settle(single.mapInArrow(lambda b: leaves(b, least_tokens), "t1 long, t2 long, leaf long, lines array<int>"), "leaves")
    often = settle(held.groupBy("leaf").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least_texts).withColumn("again", F.lit(True)), "often")
    picked = attach(held, F.col("leaf"), often, "leaf", "weight", rows_of(held), F.struct("t1", "t2"), "inner")
    picked = settle(picked.groupBy("t1", "t2").agg(F.flatten(F.collect_list("lines")).alias("lines")), "picked")
    rows = settle(join_texts(single, picked, rows_of(picked)).select("t1", "t2", "text", "lines"), "picked-texts")
    # a row of keys is a text's only one for its key, so counting rows counts texts
    keys = rows.mapInArrow(columns, "t1 long, t2 long, key long")
    columns_ = settle(keys.groupBy("key").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least_texts).withColumn("again", F.lit(True)), "columns")
    kinds = "t1 long, t2 long, line int, template long"
    if rows_of(columns_) <= BROADCAST_ROWS:  # eight bytes each
        found = columns_.select("key").toArrow().column("key").to_numpy()
        known = keyed.sparkSession.sparkContext.broadcast(np.sort(found.astype(np.int64).view(np.uint64)))
        fixed = rows.mapInArrow(lambda b: templates(b, percent, known.value), kinds)
    else:
        total = columns_.agg(F.sum("weight")).first()[0]
        constant = attach(keys, F.col("key"), columns_, "key", "weight", total, F.struct("t1", "t2", "key"), "inner")
        marks = rows.join(constant.groupBy("t1", "t2").agg(F.collect_list("key").alias("keys")), ["t1", "t2"], "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<bigint>")))
        fixed = marks.select("t1", "t2", "text", "lines", "keys").mapInArrow(lambda b: templates(b, percent), kinds)
    fixed = settle(fixed, "templates")
    first = F.struct(F.col("first_id").isNull().alias("late"), "first_id", "t1", "t2")
    by_text = fixed.groupBy("template", "t1", "t2").agg(F.count(F.lit(1)).alias("lines")).join(texts.select("t1", "t2", "first_id"), ["t1", "t2"])
    dropped = by_text.groupBy("template").agg(F.count(F.lit(1)).alias("texts"), F.sum("lines").alias("weight"), F.min(first).alias("first")).where(F.col("texts") >= least_texts)
    dropped = settle(dropped.select("template", "weight", F.col("first.t1").alias("f1"), F.col("first.t2").alias("f2")), "dropped")
    gone = attach(fixed, F.col("template"), dropped, "template", "weight", rows_of(fixed), F.struct("t1", "t2", "line"), "inner").where("t1 <> f1 or t2 <> f2")
    return gone.groupBy("t1", "t2").agg(F.collect_set("line").alias("lines"))


def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, lost, total, digest = [], [], [], []
        for text, lines in zip(batch.column("text"), batch.column("lines")):
            text = text.as_py()
            parts = (text or "").split("\n")
            gone = set(lines.as_py()) if lines.is_valid else ()
            left = "\n".join([x for k, x in enumerate(parts) if k not in gone]) if gone else text
            kept.append(left)
            total.append(len(parts))
            lost.append(len(gone))
            digest.append(hashlib.sha256((left or "").encode()).hexdigest())
        others = [c for c in batch.schema.names if c not in ("text", "lines")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], [*others, "n_lines", "n_dropped", "kept_sha256", "kept"])


def judged(docs: DataFrame, id_col: str, text_col: str, least_texts: int, percent: int, least_tokens: int, carry: list[str]) -> DataFrame:
    """doc_id, __c_0, __c_1, ... (the carried columns), n_lines, n_dropped, kept_sha256, kept."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"__c_{i}") for i, c in enumerate(carry)])
    keyed = named.withColumns(text_keys())
    texts = settle(keyed.where("text is not null").groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")), "texts")
    gone = recurring(keyed.where("text is not null"), texts, least_texts, percent, least_tokens)
    gone = settle(gone.join(texts, ["t1", "t2"]).select(F.concat_ws(":", "t1", "t2").alias("k"), "lines", F.col("copies").alias("weight")), "gone")
    key = F.concat_ws(":", "t1", "t2")
    size = gone.sparkSession.read.schema(gone.schema).parquet(gone.settled_at).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("m"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    if max(size.n, size.m) <= BROADCAST_ROWS:  # a row holds as many numbers as its text loses lines
        marked = keyed.withColumn("k", key).join(F.broadcast(gone.drop("weight")), "k", "left").drop("k")
    else:
        marked = attach(keyed, key, gone, "k", "weight", size.w, F.struct("doc_id", "t1"))
    kinds = "".join(f"__c_{i} {named.schema[f'__c_{i}'].dataType.simpleString()}, " for i in range(len(carry)))
    rows = marked.select("doc_id", *[f"__c_{i}" for i in range(len(carry))], "text", "lines")
    return rows.mapInArrow(without, f"doc_id long, {kinds}n_lines long, n_dropped long, kept_sha256 string, kept string")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_texts: int = TEXTS, percent: int = CONSTANT_PERCENT, least_tokens: int = TOKENS) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_sha256, kept (the text without its dropped lines).

    A line goes if its template has at least least_tokens tokens, percent of them constant, and
    recurs in least_texts different texts, except in the text with the smallest id. Copies of a text count once, so
    that copying a document doesn't make its lines recurring. A text with no dropped
    line stays as it is; null texts stay null and count one empty line; ids may be null (last) or
    repeated; rows with equal texts lose the same lines; other columns are not read; an empty table gives no rows.
    """
    return judged(docs, id_col, text_col, least_texts, percent, least_tokens, [])


def line_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the lines that line_dedup drops taken from their texts; every row stays, with all its columns.

    length_col, if given, becomes the number of characters of texts that lost lines.
    """
    out = judged(docs, id_col, text_col, TEXTS, CONSTANT_PERCENT, TOKENS, docs.columns)
    shorter = F.length("kept").cast("long")
    made = {text_col: F.col("kept")} | ({length_col: F.when(F.col("n_dropped") > 0, shorter)} if length_col else {})
    return out.select(*[F.coalesce(made[c], F.col(f"__c_{i}")).alias(c) if c in made else F.col(f"__c_{i}").alias(c) for i, c in enumerate(docs.columns)])
