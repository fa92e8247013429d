"""Product codes against Lloyd rounds written out, and what a round shuffles."""

from __future__ import annotations

import collections

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import shared
from millrace.llm.vector_codes import assign, closest, compress, with_label_errors

DATA = "vec_id long, embedding array<float>, label int, id int, part string, v long, n int, of string"


def made(seed: int, n: int, width: int, ids=None, spread: float = 1.0) -> list[tuple]:
    r = np.random.default_rng(seed)
    x = (r.normal(size=(n, width)) * spread).astype(np.float32)
    x[n // 3 : n // 2] = x[0]  # copies, and so ties
    labels = [None if k % 7 == 0 else 1 if k % 3 else k for k in range(n)]
    return [(i, v.tolist(), label, 3, "x", 1, 2, "y") for i, v, label in zip(range(n) if ids is None else ids, x, labels)]


def brute(rows: list[tuple], parts: int, entries: int, rounds: int, scale: int) -> tuple[list[tuple], list]:
    """All distances in each round, in whole numbers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and len(v) and len(v) % parts == 0]
    if not kept:
        return [], []
    length = min(collections.Counter(len(v) for _, v, _ in kept).items(), key=lambda c: (-c[1], c[0]))[0]
    kept = [k for k in kept if len(k[1]) == length]
    w = length // parts
    first = sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, k[1]))[:entries]
    books = [[v[p * w : (p + 1) * w] for _, v, _ in first] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, v: min((distance(v[p * w : (p + 1) * w], c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for _, v, _ in kept:
                own[nearest(p, v)[1]].append(v[p * w : (p + 1) * w])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if own[e] else old for e, old in enumerate(books[p])]
    out, by_label = [], collections.Counter()
    for i, v, label in kept:
        found = [nearest(p, v) for p in range(parts)]
        out.append((i, bytes(e for _, e in found).hex(), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    return [(i, code, error, by_label[label]) for i, code, error, label in out], books


def collected(spark, rows, *args):
    codes, books = compress(spark.createDataFrame(rows, DATA), *args)
    found = with_label_errors(codes).selectExpr("id", "lower(hex(code)) AS code", "error", "label_error").collect()
    return sorted(map(tuple, found), key=str), [b.tolist() for b in books]


@pytest.mark.parametrize("bound", [shared.BROADCAST_ROWS, 0])
def test_against_brute_force(spark, monkeypatch, bound):
    """Nulls and non-finite components, odd lengths, repeated and null ids, ties, few rows; labels broadcast and joined."""
    monkeypatch.setattr(shared, "BROADCAST_ROWS", bound)
    nan, inf = float("nan"), float("inf")
    bad = [(900, None, 1), (901, [], None), (902, [None] * 16, 1), (903, [1.0] * 15 + [nan], 1), (904, [1.0] * 15 + [inf], 2), (905, [1.0] * 15 + [-inf], 2), (906, [0.5] * 8, 1), (907, [0.5] * 12, 1), (None, [0.25] * 16, None), (3, [0.125] * 16, None), (3, [-0.125] * 16, None)]
    rows = made(1, 150, 16) + [(*b, 3, "x", 1, 2, "y") for b in bad]
    want, books = brute(rows, 8, 16, 6, 4096)
    got, found = collected(spark, rows, 8, 16, 6, 4096.0)
    assert got == sorted(want, key=str) and found == books


def test_few_rows_and_rounds(spark):
    for rows, parts, entries, rounds in ((made(2, 5, 8), 4, 16, 3), (made(3, 60, 6, [k // 2 for k in range(60)]), 3, 4, 0), (made(4, 40, 4, spread=3000.0), 2, 5, 4)):
        want, books = brute(rows, parts, entries, rounds, 4096)
        got, found = collected(spark, rows, parts, entries, rounds, 4096.0)
        assert got == sorted(want, key=str) and found == books


def test_empty_tables(spark):
    assert collected(spark, []) == ([], [])
    assert collected(spark, [(1, None, 1, 3, "x", 1, 2, "y")]) == ([], [])


def test_huge_components(spark):
    """Components beyond the bound count as the bound; distances still fit."""
    got, _ = collected(spark, [(1, [3e38] * 64, 1, 3, "x", 1, 2, "y"), (2, [-3e38] * 64, 1, 3, "x", 1, 2, "y"), (3, [0.0] * 64, 1, 3, "x", 1, 2, "y")])
    assert [r[2] for r in got] == [0, 0, 0] and len({r[1] for r in got}) == 3


def test_rounds_shuffle_changes_only():
    """A part that stays with its entry gives no change; one that moves is taken from one entry and added to another."""
    book = [np.array([[0, 0], [10, 10]]), np.array([[0, 0], [10, 10]])]
    vectors, old = [[1, 1, 9, 9], [9, 8, 0, 1]], [bytes([0, 1]), bytes([0, 0])]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([None, 5]), pa.array(vectors, pa.list_(pa.int32())), pa.array(old, pa.binary())], ["id", "label", "v", "code"])
    rows, changes = [b.to_pylist() for b in assign(iter([batch]), book, False)]
    assert [r["code"] for r in rows] == [bytes([0, 1]), bytes([1, 0])]
    assert {(c["part"], c["entry"], c["at"], c["value"]) for c in changes} == {(0, 1, 0, 9), (0, 1, 1, 8), (0, 1, 2, 1), (0, 0, 0, -9), (0, 0, 1, -8), (0, 0, 2, -1)}
    again = batch.set_column(3, "code", pa.array([bytes([0, 1]), bytes([1, 0])], pa.binary()))
    assert [b.num_rows for b in assign(iter([again]), book, False)] == [2, 0]


def test_closest_is_exact_beyond_floats():
    part, book = np.array([[1 << 27, -(1 << 27) + 1]]), np.array([[1 << 27, -(1 << 27)], [(1 << 27) - 1, -(1 << 27) + 1], [1 << 27, -(1 << 27) + 2]])
    entry, distance = closest(part, book)
    assert entry.tolist() == [0] and distance.tolist() == [1]
