"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Fixed base rules come first. The other rules have no fixed cutoffs: for each
language and source the values of each measure that base-passing documents
have are counted in buckets of fixed relative width (about 6 %). Such counts are a quantile
sketch that merges by addition, so partial sketches merge in any order to the
same result and reruns agree. Fences of each sketch are joined back to the
documents. Groups with few documents take the fences of their language, or of
the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import kernel
from millrace.llm.shared import BROADCAST_ROWS, attach, rows_of, settle

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8
LEAST_WORDS, REPEATED_PERCENT = 20, 30
#: Documents that a group needs for fences of its own.
LEAST_GROUP = 100
#: A fence lies this many interquartile ranges, and this much absolutely (in thousandths), beyond the quartile.
REACH, SLACK = 4, {"word_length": 1200, "symbols": 150, "dup_lines": 500, "repeats": 300}
MEASURES = list(SLACK)


def base_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of each text, beside the other columns."""
    for batch in batches:
        parts = [counts(data, offsets) for _, data, offsets in kernel.slices(batch.column("text"))]
        whole = np.concatenate(parts, axis=1) if parts else np.zeros((6, 0), np.int64)
        others = [(c, batch.column(c)) for c in batch.schema.names if c != "text"]
        made = list(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"), map(pa.array, whole)))
        yield pa.RecordBatch.from_arrays([x for _, x in others + made], [c for c, _ in others + made])


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    start, end, first = kernel.words(data, offsets)
    spans = kernel.hasher(data)
    salt = kernel.mix(np.arange(1, rows + 1, dtype=np.uint64) * kernel.PLACE[40])
    n_words = np.diff(first)
    word_chars = kernel.per_row(~kernel.SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    n_symbols = kernel.per_row(SYMBOLS[data], offsets)
    # lines with a word that equal an earlier line of the same text
    line_start, line_end, first_line = kernel.lines(data, offsets)
    filled = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    row_of = np.repeat(np.arange(rows), np.diff(first_line))
    key = (spans(line_start, line_end) ^ salt[row_of])[filled]
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order[1:]] == key[order[:-1]]]
    n_dup_lines = np.bincount(row_of[filled][again], minlength=rows)
    n_lines = np.bincount(row_of[filled], minlength=rows)
    # words in windows that occur twice or more in the same text
    window, begin = kernel.windows(spans(start, end), first, WINDOW)
    n_repeat = np.zeros(rows, np.int64)
    if len(window):
        n_windows = np.diff(begin)
        window = window ^ np.repeat(salt, n_windows)
        order = np.argsort(window)
        same = window[order[1:]] == window[order[:-1]]
        twice = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
        at = twice + np.repeat(first[:-1] - begin[:-1], n_windows)[twice]  # their first words
        change = np.zeros(len(start) + WINDOW + 1, np.int64)
        change[at] += 1
        np.subtract.at(change, at + WINDOW, 1)
        n_repeat = kernel.per_row(np.cumsum(change)[: len(start)] > 0, first)
    return np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_lines]).astype(np.int64)


def bucket(x: Column) -> Column:
    """Integer buckets of relative width 1/16 for whole numbers from 0 on."""
    e = F.greatest(F.length(F.bin(x)) - 5, F.lit(0)).cast("int")
    return F.when(x < 32, x).otherwise(16 * e.cast("long") + F.call_function("shiftright", x, e))


def bucket_value(b: Column) -> Column:
    """The smallest number in a bucket."""
    e = F.floor((b - 16) / 16).cast("int")
    return F.when(b < 32, b).otherwise(F.call_function("shiftleft", (b - 16 * e.cast("long")), e))


def measures() -> dict[str, Column]:
    """Per mille of each measure, in whole numbers."""
    per = lambda a, b: F.when(F.col(b) > 0, F.expr(f"{a} * 1000 div {b}")).otherwise(F.lit(0)).cast("long")
    return {"word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words")}


def fences(measured: DataFrame, keys: list[str]) -> DataFrame:
    """For each group of keys its number of documents and an array of (low, high), one for each measure."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), bucket(F.col(m)).alias("b")) for i, m in enumerate(MEASURES)]))
    sketch = measured.select(*keys, values.alias("x")).groupBy(*keys, "x.m", "x.b").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*keys, "m")
    sketch = sketch.withColumn("upto", F.sum("n").over(group.orderBy("b"))).withColumn("all", F.sum("n").over(group))
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("b")))
    quartiles = sketch.groupBy(*keys, "m").agg(bucket_value(quartile(1)).alias("q1"), bucket_value(quartile(3)).alias("q3"), F.max("all").alias("docs"))
    slack = F.element_at(F.array(*[F.lit(SLACK[m]) for m in MEASURES]), F.col("m") + 1)
    spread = REACH * (F.col("q3") - F.col("q1")) + slack
    low = F.when(F.col("m") == 0, F.col("q1") - spread).otherwise(F.lit(-1))
    return quartiles.groupBy(*keys).agg(F.max("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("m", low.alias("low"), (F.col("q3") + spread).alias("high")))).alias("fences"))


FAILED = f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED_PERCENT} * n_words"
COUNTED = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"))


def named(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")]
    rows = docs.select(*columns, F.col(source_col).cast("string").alias("source"))
    return rows.withColumn("grp", group_of("lang", "source"))


def group_of(lang: str, source: str) -> Column:
    """A text that names the language and source, nulls too."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    return F.concat(part(lang), part(source))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, grp, counts, measures and base_failed of each row, settled."""
    counted = docs.select("doc_id", "text", "lang", "grp").mapInArrow(base_counts, f"doc_id long, lang string, grp string, {COUNTED}")
    return settle(counted.withColumn("base_failed", F.expr(FAILED)).withColumns(measures()), "measures")


def thresholds(counted: DataFrame) -> DataFrame:
    """grp, fences, weight (documents) of each group, settled."""
    passing = counted.where(~F.col("base_failed"))
    whole = fences(passing, []).select(F.col("fences").alias("whole"))
    # one row for each language at most, and one in all; groups that are large enough keep their own
    by_lang = fences(passing, ["lang"]).select(F.col("lang").alias("l"), F.when(F.col("docs") >= LEAST_GROUP, F.col("fences")).alias("by_lang"))
    own = fences(passing, ["lang", "grp"]).join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(whole), F.lit(True), "left")
    return settle(own.select("grp", F.when(F.col("docs") >= LEAST_GROUP, F.col("fences")).otherwise(F.coalesce("by_lang", "whole")).alias("fences"), F.col("docs").alias("weight")), "thresholds")


def verdict() -> Column:
    """Not failed by the base rules, and within the fences in all measures."""
    inside = F.lit(True)
    for i, m in enumerate(MEASURES):
        inside = inside & F.col(m).between(F.col("fences")[i]["low"], F.col("fences")[i]["high"])
    return ~F.expr(FAILED) & F.coalesce(inside, F.lit(True))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    base_failed: fewer than 20 words, or more than 30 % of the words in 8-word windows that
    occur twice or more in the text. kept: not base_failed, and each measure
    (mean word length, symbols a word, repeated lines, repeated words) within the fences
    of the document's language and source. Null texts are without words; null languages or
    sources are groups of their own; ids may be null or repeated; other columns are not read; an
    empty table gives no rows.
    """
    counted = measured(named(docs, id_col, text_col, lang_col, source_col))
    judged = attach(counted, F.col("grp"), thresholds(counted), "grp", "weight", rows_of(counted), F.struct("doc_id", "n_words", "word_chars"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict().alias("kept"))


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that quality() keeps, with the columns of docs.

    Counts are made again beside the texts, which costs less than joining verdicts to them.
    """
    counted = measured(named(docs, id_col, text_col, lang_col, source_col))
    table = thresholds(counted)
    inner = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*inner).withColumn("text", F.col(inner[docs.columns.index(text_col)]).cast("string"))
    lang, source = (inner[docs.columns.index(c)] for c in (lang_col, source_col))
    rows = rows.withColumns({"lang": F.col(lang).cast("string"), "source": F.col(source).cast("string")}).withColumn("grp", group_of("lang", "source")).drop("lang", "source")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    again = rows.mapInArrow(base_counts, f"{kinds}, {COUNTED}").withColumns(measures())
    if rows_of(table) <= BROADCAST_ROWS // 10:
        judged = again.join(F.broadcast(table), "grp", "left")
    else:
        judged = attach(again, F.col("grp"), table, "grp", "weight", rows_of(counted), F.struct(*inner[:1], "n_words", "word_chars"))
    return judged.where(verdict()).select(*[F.col(c).alias(name) for c, name in zip(inner, docs.columns)])
