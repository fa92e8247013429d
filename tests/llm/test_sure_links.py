"""Pairs just below the threshold are not sure, so they do not hide true links; a list gives its members once and its links as a forest."""

from __future__ import annotations

import itertools
import time
import tracemalloc

import numpy as np

from millrace.llm import near_dedup


def test_members_keep_true_links():
    """A has two near copies (0.865) that are no link of each other (0.748): all three are looked at exactly."""
    lost = 0
    for seed in range(40):
        new = np.random.default_rng(seed).choice(1 << 32, 222, replace=False).astype(np.uint32)
        a, x, y = new[:194], new[194:208], new[208:222]
        whole = [np.sort(s) for s in (np.concatenate((a[14:], x)), a, np.concatenate((a[:14], a[28:], y)))]
        sets = [s[: near_dedup.RETAINED] for s in whole]
        jaccard = lambda i, j: len(np.intersect1d(whole[i], whole[j])) / len(np.union1d(whole[i], whole[j]))
        assert jaccard(0, 1) > 0.75 and jaccard(1, 2) > 0.75 and jaccard(0, 2) < 0.75
        heads = {np.intersect1d(sets[i], sets[j])[0] for i, j in ((0, 1), (0, 2), (1, 2))}
        seen = [set(near_dedup.in_group(h, True, np.zeros(3, int), np.zeros(3, bool), np.full(3, 194), sets, 0.75).tolist()) for h in heads]
        lost += not all(any({i, j} <= s for s in seen) for i, j in ((0, 1), (1, 2)))
    assert not lost


def test_intersections_and_forest():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 90 + 60 * (k % 5), 70)).astype(np.uint64) for k in range(60)]
    found = near_dedup.intersections(sets)
    for i, j in itertools.combinations(range(60), 2):
        assert found[i, j] == found[j, i] == len(np.intersect1d(sets[i], sets[j]))
    for linked in (np.ones((500, 500), bool), found > 30):
        linked = linked & ~np.eye(len(linked), dtype=bool)
        out, part = near_dedup.forest(linked), list(range(len(linked)))
        root = lambda x: x if part[x] == x else root(part[x])
        for a, b in out:
            assert linked[a, b] and root(a) != root(b)
            part[root(b)] = root(a)
        assert all(root(a) == root(b) for a, b in zip(*np.nonzero(linked)))
    degree = np.bincount(np.array(near_dedup.forest(~np.eye(500, dtype=bool))).ravel())
    assert degree.max() <= near_dedup.FAN + 1


def test_a_list_without_links_is_cheap():
    """1,000 sets of 1,000 values, each two alike to 0.67 and none a link: every member once, and no pair at all."""
    r = np.random.default_rng(5)
    base = r.choice(1 << 62, 1000, replace=False)
    whole = [np.sort(np.concatenate((base[np.sort(r.permutation(1000)[:895])], r.choice(1 << 62, 105))).astype(np.uint64)) for _ in range(1000)]
    sets = [(s[: near_dedup.RETAINED] >> np.uint64(30)).astype(np.uint32) for s in whole]
    began = time.time()
    members = near_dedup.in_group(sets[0][0], True, np.zeros(1000, int), np.zeros(1000, bool), np.full(1000, 1000), [np.sort(np.append(s[1:], sets[0][0])) for s in sets], 0.75)
    common = near_dedup.intersections(whole)
    assert len(members) <= 1000 and time.time() - began < 20
    assert not (100 * common >= 75 * (2000 - common))[~np.eye(1000, dtype=bool)].any()


def test_intersections_of_long_texts_are_held_in_ranges(monkeypatch):
    """Twenty near copies of a million shingles each: beside the sets, what is held stays small; the numbers are exact."""
    r = np.random.default_rng(9)
    base = np.unique(r.integers(0, 1 << 62, 1_000_000))
    sets = [np.sort(np.concatenate((base[k::40] + 1, base[r.permutation(len(base))[: 970_000]]))).astype(np.uint64) for k in range(20)]
    sets = [np.unique(s) for s in sets]
    tracemalloc.start()
    found = near_dedup.intersections(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    for i, j in ((0, 1), (3, 17), (18, 19)):
        assert found[i, j] == found[j, i] == len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    # the same numbers in ranges of any size, also where one value or one set has most of a range
    few = [np.unique(r.integers(0, 300, 200)).astype(np.uint64) for _ in range(20)] + [np.zeros(0, np.uint64), np.array([5], np.uint64)]
    want = near_dedup.in_range(few)
    for size in (1, 7, 100, 1000):
        monkeypatch.setattr(near_dedup, "RANGE", size)
        assert (near_dedup.intersections(few) == want).all()


def test_short_lists_are_cut_by_shingles(spark, monkeypatch):
    """Near copies of long texts in a list that is short by rows: dealt to blocks, with the same components."""
    from tests.llm.test_operators import components, edited, prose, rows

    values = [edited(prose(b, 700), i, 3) for b in (1, 2) for i in range(9)] + [prose(3, 50)]
    monkeypatch.setattr(near_dedup, "WIDE", 100)
    monkeypatch.setattr(near_dedup, "BLOCK", 60)
    members = near_dedup.near_duplicates(rows(spark, values)).collect()
    assert {r.doc_id: r.component_id for r in members} == components(list(enumerate(values)))
