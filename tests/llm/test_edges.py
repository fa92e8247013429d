"""Null and repeated ids, clashing columns, repeated rows and texts of several MB, end to end."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import chain_dedup, packing
from millrace.llm.line_dedup import line_dedup
from millrace.llm.mixing import taken
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.quality import quality
from millrace.llm.queries import VOCABULARY
from millrace.llm.substring_dedup import substring_dedup
from millrace.llm.token_count import token_counts
from millrace.llm.topk import top_k
from millrace.llm.warc import archive
from tests.llm.test_operators import edited, prose

IDS = [None, 5, 5, None, 7, 7, 9, 2]
TEXTS = [prose(1, 120), prose(2, 90) + "\nline of its own\n" + prose(3, 30), "", None, prose(4, 50), prose(4, 50), edited(prose(1, 120), 3, 2), "ein – Strich, “zitiert” " * 20]
#: Names that operators use inside; source and lang are read by some.
CLASH = "doc_id long, text string, source string, lang string, n long, size long, node string, row int, weight int, k string, v string"


def table(spark, ids):
    return spark.createDataFrame([(i, t, ("a", None)[k % 2], "en", 1, 2, "x", 3, 4, "y", "z") for k, (i, t) in enumerate(zip(ids, TEXTS))], CLASH)


@pytest.mark.parametrize("name", ["token_counts", "quality", "substring_dedup", "pack"])
def test_ids_are_only_carried(spark, name):
    """What the operator says of a text doesn't hang on ids: with null and repeated ones the rows are those of plain ids."""
    run = {
        "token_counts": lambda d: token_counts(d, VOCABULARY),
        "quality": quality,
        "substring_dedup": lambda d: substring_dedup(d, 100, keep_first=False),
        "pack": lambda d: packing.pack(d, VOCABULARY, 64).drop("sequence_id", "offset"),
    }[name]
    plain = [tuple(r) for r in run(table(spark, range(len(TEXTS)))).collect()]
    odd = [tuple(r) for r in run(table(spark, IDS)).collect()]
    assert collections.Counter(odd) == collections.Counter((IDS[i], *rest) for i, *rest in plain)


def test_lines_and_mixing_with_odd_ids(spark):
    found = line_dedup(table(spark, IDS)).collect()
    assert collections.Counter((r["doc_id"], r["n_lines"]) for r in found) == collections.Counter((i, (t or "").count("\n") + 1) for i, t in zip(IDS, TEXTS))
    mixed = taken(table(spark, IDS)).collect()
    words = lambda t: len((t or "").split())
    assert collections.Counter((r["doc_id"], r["size"]) for r in mixed) == collections.Counter((i, words(t)) for i, t in zip(IDS, TEXTS))
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in mixed)


def test_top_k_of_repeated_ids(spark):
    """An id that repeats asks once, with its smallest vector, and is a candidate as often as it is there; other columns may have any names."""
    rows = [(1, [0.5, 0.5], 1, "x"), (1, [0.25, 0.0], 1, "x"), (2, [1.0, 0.0], 1, "x"), (2, [1.0, 0.0], 1, "x"), (None, [9.0, 9.0], 1, "x")]
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, part string"), F.col("vec_id") == 1, 5)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 2, 64 * 256), (1, 2, 2, 64 * 256)]


def test_pages_with_clashing_names(spark):
    rows = [(1, "u", "<p>a</p>", "x", 2, "y"), (None, None, None, None, None, None)]
    records, _, _ = archive(spark.createDataFrame(rows, "page_id long, url string, html string, sha string, first long, bundle string"))
    assert sorted((r["page_id"], r["payload_bytes"]) for r in records.collect() if r["page_id"] is not None) == [(1, 8)] and records.count() == 2


def test_texts_of_several_megabytes(spark):
    """A text of 4 MB, a near copy of it and one without a space, beside short ones."""
    long = " ".join(f"w{k % 90_001}x{k * 7 % 1_009}" for k in range(400_000))
    values = [long, edited(long, 1, 50), "z" * 3_000_000, "short text of a few words", None]
    docs = spark.createDataFrame([(k, t, "a", "en") for k, t in enumerate(values)], "doc_id long, text string, source string, lang string").repartition(2)
    assert len(long) > 4_000_000
    groups = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert groups == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    library = Tokenizer.from_file(VOCABULARY)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, VOCABULARY).collect()}
    assert counts == {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(values)}
    pieces = packing.pack(docs, VOCABULARY, 2048).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in pieces} == {k: n + 1 for k, n in counts.items()}
    assert {r["doc_id"]: r["n_words"] for r in quality(docs).collect()} == {k: len((t or "").split()) for k, t in enumerate(values)}
    assert line_dedup(docs).where("n_dropped = 0").count() == 5
    covered = np.zeros(400_000, bool)
    for r in chain_dedup.passages(docs).where("doc_id = 1 and other_id = 0").collect():
        covered[r["start"] : r["end"]] = True
    assert covered.mean() > 0.95


def test_bin_completion_betters_best_fit():
    """Where best-fit decreasing misses the lower bound, the search often finds fewer bins, and never more."""
    missed = bettered = 0
    number = lambda bins: sum(n for _, n in bins)
    for seed in range(120):
        r = np.random.default_rng(seed)
        capacity = int(r.choice([30, 60, 100]))
        count = np.bincount(r.integers(capacity // 6, capacity // 2 + 5, int(r.integers(10, 60))), minlength=capacity + 1)
        plain, found = number(packing.best_fit(count, capacity)), number(packing.complete(count, capacity))
        assert packing.lower_bound(count, capacity) <= found <= plain
        missed += plain > packing.lower_bound(count, capacity)
        bettered += found < plain
    assert missed > 10 and bettered >= missed // 4
