"""Fuzzy passages: chaining against a plain quadratic version, alignment against a plain one, and planted passages."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import chain_dedup
from millrace.llm.shared import settle
from tests.llm.test_operators import edited, prose, rows


def worths(x, y):
    """Best worth of a chain that ends in each match, by trying all predecessors."""
    order, best = sorted(range(len(x)), key=lambda i: (x[i], -y[i])), {}
    for i in order:
        before = [best[j] - chain_dedup.GAP * (x[i] - x[j] + y[i] - y[j]) for j in best if x[j] < x[i] and y[j] < y[i]]
        best[i] = chain_dedup.SEED + max([0.0, *before])
    return best


@pytest.mark.parametrize("seed", range(20))
def test_chains_are_optimal(seed):
    r = random.Random(seed)
    n = r.randint(1, 60)
    x, y = [r.randrange(120) for _ in range(n)], [r.randrange(120) for _ in range(n)]
    found = chain_dedup.chains(np.array(x), np.array(y))
    assert sorted(i for c in found for i in c) == list(range(n))
    for c in found:
        assert all(x[a] < x[b] and y[a] < y[b] and max(x[b] - x[a], y[b] - y[a]) <= chain_dedup.MOST_GAP for a, b in zip(c, c[1:]))
    best = worths(x, y)
    top = max(best.values())
    worth = lambda c: sum(chain_dedup.SEED for _ in c) - sum(chain_dedup.GAP * (x[b] - x[a] + y[b] - y[a]) for a, b in zip(c, c[1:]))
    if top < chain_dedup.SEED * 2 + 1e-9 or len(found) == 1:
        return
    assert max(map(worth, found)) >= top - 2 * chain_dedup.GAP * chain_dedup.MOST_GAP


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for u in a:
        new = [0]
        for j, w in enumerate(b):
            new.append(row[j] + 1 if u == w else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(20))
def test_common_words(seed):
    r = np.random.default_rng(seed)
    a, b = r.integers(0, 6, int(r.integers(0, 90))), r.integers(0, 6, int(r.integers(0, 90)))
    assert chain_dedup.common_words(a, b) == lcs(a.tolist(), b.tolist())


def test_planted_passages(spark):
    passage, other = prose(1, 60), prose(2, 80)
    values = [prose(i, 90) for i in range(10, 30)]
    for i in (3, 5, 8, 13):
        values[i] = prose(100 + i, 30 + i) + " " + passage + " " + prose(200 + i, 20)
    for k, i in enumerate((4, 6)):
        values[i] = prose(100 + i, 17) + " " + edited(other, k, 2) + " " + prose(200 + i, 50)
    values += [None, "", "the the " * 300, "the the " * 250, prose(1, 20), values[10], prose(12, 90).upper()]
    found = chain_dedup.passages(rows(spark, values)).collect()
    pairs = {(r.doc_id, r.other_id) for r in found}
    assert {(5, 3), (8, 3), (13, 3), (6, 4)} <= pairs
    assert (25, 10) in {(r.doc_id, r.other_id) for r in found if r["copy"]}
    assert {i for p in pairs for i in p} <= {3, 4, 5, 6, 8, 13, 10, 25, 2, 26, 22, 23}
    for r in found:
        a, b = (values[i].lower().split()[s:e] for i, s, e in ((r.doc_id, r.start, r.end), (r.other_id, r.other_start, r.other_end)))
        assert min(len(a), len(b)) >= chain_dedup.LEAST_WORDS
        assert r.equal_words <= lcs(a, b) and 100 * r.equal_words >= chain_dedup.LEAST_PERCENT * max(len(a), len(b))
    exact = next(r for r in found if (r.doc_id, r.other_id) == (8, 3))
    assert exact.equal_words >= 60


def every(text: str, n: int, at: int) -> str:
    """text with each n-th word replaced."""
    return " ".join(f"new{at}x{i}" if i % n == n // 2 else w for i, w in enumerate(text.split(" ")))


def test_edited_passages(spark):
    """Passages with each tenth word replaced, or 5-20 % of words at random, against the words that brute force finds equal."""
    values, kinds = [], []
    for n, change in ((60, lambda t, i: every(t, 10, i)), (100, lambda t, i: every(t, 10, i)), (100, lambda t, i: edited(t, i, 5)), (100, lambda t, i: edited(t, i, 10)), (100, lambda t, i: edited(t, i, 20))):
        for i in range(40):
            passage = prose(1000 + len(values), n)
            values += [prose(5000 + len(values) + k, 40) + " " + t + " " + prose(9000 + len(values) + k, 40) for k, t in enumerate((passage, change(passage, i)))]
        kinds.append(len(values))
    found = chain_dedup.passages(rows(spark, values)).collect()
    hits = [len({r.doc_id for r in found if lo <= r.doc_id < hi and r.doc_id == r.other_id + 1}) for lo, hi in zip([0, *kinds], kinds)]
    print("found of 40:", hits)
    assert all(r.doc_id == r.other_id + 1 and r.doc_id % 2 for r in found)
    for r in found:
        a, b = values[r.doc_id].split()[r.start : r.end], values[r.other_id].split()[r.other_start : r.other_end]
        assert r.equal_words <= lcs(a, b) and 100 * r.equal_words >= chain_dedup.LEAST_PERCENT * max(len(a), len(b))
    assert min(hits[:4]) >= 36 and hits[4] >= 20


def test_passage_that_an_earlier_text_holds_in_part(spark):
    """Two texts share a passage exactly, and an earlier one has its halves apart, or a near copy that takes some of its seeds."""
    values = []
    for i in range(120):
        passage = prose(1000 + i, 60)
        words = passage.split(" ")
        part = " ".join((*words[:30], prose(20000 + i, 150), *words[30:])) if i % 2 else edited(passage, i, 2 + i % 24)
        values += [prose(5000 + 3 * i + k, 40) + " " + t + " " + prose(9000 + 3 * i + k, 40) for k, t in enumerate((part, passage, passage))]
    found = chain_dedup.passages(rows(spark, values)).collect()
    missed = [i for i in range(120) if not any(r.doc_id == 3 * i + 2 and r.other_id in (3 * i, 3 * i + 1) for r in found)]
    print("missed of 120:", missed)
    assert all(r.doc_id // 3 == r.other_id // 3 for r in found)
    assert not missed


def test_passages_recur_within_a_text(spark):
    """Ten places of a passage in one text are ten passages if an earlier text has it, and nine if none has."""
    passage, own = prose(1, 60), prose(2, 60)
    first = prose(3, 50) + " " + passage
    many = " ".join(prose(100 + i, 45) + " " + passage for i in range(10))
    alone = " ".join(prose(200 + i, 45) + " " + own for i in range(10))
    half = prose(300, 45) + " " + " ".join(passage.split(" ")[:30]) + " " + prose(301, 45) + " " + passage
    values = [first, many, alone, half, (own + " ") * 3]
    found = chain_dedup.passages(rows(spark, values)).collect()
    places = lambda i: {r.start for r in found if r.doc_id == i}
    whole = lambda i, text: {k for k in range(len(values[i].split())) if values[i].split()[k : k + 60] == text.split()}
    assert whole(1, passage) <= places(1) and len(places(1)) == 10
    assert len(places(2)) == 9 and whole(2, own) - places(2) == {min(whole(2, own))}
    assert whole(3, passage) <= places(3)
    assert {0, 60, 120} <= places(4)
    assert all(r.other_end <= r.start for r in found if r.doc_id == r.other_id)


def test_common_passage_stays_linear(spark):
    """A passage in every document gives one row for each document, not one for each pair."""
    passage = prose(1, 60)
    values = [prose(100 + i, 30) + " " + passage + " " + prose(500 + i, 30) for i in range(60)]
    found = chain_dedup.passages(rows(spark, values)).collect()
    assert {r.doc_id for r in found} == set(range(1, 60)) and len(found) == 59


def test_no_documents(spark):
    assert chain_dedup.passages(rows(spark, [])).count() == 0


def test_passage_whose_pieces_stand_in_earlier_texts(spark):
    """Two texts share 200 words, of which 24 earlier texts hold 20-word pieces: the passage is found whole or nearly so."""
    passage = prose(1, 200)
    words, r = passage.split(" "), random.Random(4)
    pieces = [prose(100 + i, 60) + " " + " ".join(words[a : a + 20]) + " " + prose(200 + i, 60) for i, a in enumerate(r.randrange(180) for _ in range(24))]
    values = [*pieces, prose(300, 80) + " " + passage + " " + prose(301, 80), prose(302, 80) + " " + passage + " " + prose(303, 80)]
    found = [x for x in chain_dedup.passages(rows(spark, values)).collect() if x.doc_id == 25 and x.other_id == 24]
    covered = {k for x in found for k in range(x.start, x.end)} & set(range(80, 280))
    assert len(covered) >= 180
    assert all(x.other_start - x.start == 0 for x in found)


def test_passages_behind_pieces_of_any_length(spark):
    """Two texts share 200 words, behind earlier texts that hold pieces of them, too short to count, at narrow and wide strides."""
    values, cases = [], []
    for piece in (20, 30, 38, 39):
        for stride in (1, 2, 3, 6):
            passage = prose(70_000 + 100 * piece + stride, 200)
            words, at = passage.split(" "), len(values)
            values += [prose(100_000 + at + a, 30) + " " + " ".join(words[a : a + piece]) + " " + prose(200_000 + at + a, 30) for a in range(0, 201 - piece, stride)]
            cases.append((piece, stride, len(values)))
            values += [prose(300_000 + at + k, 80) + " " + passage + " " + prose(400_000 + at + k, 80) for k in (0, 1)]
    found = chain_dedup.passages(rows(spark, values)).collect()
    for piece, stride, first in cases:
        covered = {k for x in found if x.doc_id == first + 1 and x.other_id == first for k in range(x.start, x.end)} & set(range(80, 280))
        assert len(covered) >= 180, (piece, stride, len(covered))


def test_passage_of_which_earlier_texts_hold_any_two_seeds(spark):
    """Two texts share 70 words; each earlier text holds two pieces of 13 of them in their places, with other words between, so that every two seeds stand somewhere before."""
    passage, values = prose(1, 70).split(" "), []
    for a in range(58):
        for b in range(a + 19, 58):
            words = prose(1_000 + 100 * a + b, 70).split(" ")
            words[a : a + 13], words[b : b + 13] = passage[a : a + 13], passage[b : b + 13]
            values.append(" ".join(words))
    values += [prose(300_000 + k, 80) + " " + " ".join(passage) + " " + prose(400_000 + k, 80) for k in (0, 1)]
    n = len(values)
    found = [x for x in chain_dedup.passages(rows(spark, values)).collect() if (x.doc_id, x.other_id) == (n - 1, n - 2)]
    covered = {k for x in found for k in range(x.start, x.end)} & set(range(80, 150))
    assert len(covered) >= 63
    assert all(x.other_start == x.start for x in found) and len(found) == 1


def test_recall_against_all_pairs(spark):
    """Passages shared, exactly or edited, by random sets of texts: of the words that brute force finds repeated, 90 % or more are found."""
    r = random.Random(8)
    shared = [prose(40 + k, r.randint(45, 120)) for k in range(12)]
    values, held = [], []
    for i in range(90):
        parts = [prose(3000 + 10 * i, r.randint(10, 60))]
        for k in r.sample(range(12), r.randint(0, 3)):
            parts += [edited(shared[k], 100 * i + k, r.choice((0, 0, 0, 1, 2))), prose(3001 + 10 * i + k, r.randint(10, 60))]
        values.append(" ".join(parts))
    # all pairs: words of a text in runs of 45 words or more that an earlier text has too
    runs: dict[tuple, int] = {}
    for i, t in enumerate(values):
        w = t.split(" ")
        mine = [tuple(w[k : k + 45]) for k in range(len(w) - 44)]
        held.append({j for k, m in enumerate(mine) if runs.get(m, i) < i for j in range(k, k + 45)})
        for m in mine:
            runs.setdefault(m, i)
    found = chain_dedup.passages(rows(spark, values)).collect()
    got = [{j for x in found if x.doc_id == i for j in range(x.start, x.end)} for i in range(len(values))]
    total, hit = sum(map(len, held)), sum(len(a & b) for a, b in zip(held, got))
    print("recall", hit / total)
    assert total > 3000 and hit >= 0.9 * total


def test_hot_seeds_give_the_same_rows(spark, monkeypatch):
    """Seeds of a passage in every document are kept apart when they count as hot, with the same result."""
    passage = prose(1, 60)
    values = [prose(100 + i, 30) + " " + passage + " " + prose(500 + i, 30) for i in range(40)] + [passage + " " + passage, None, ""]
    found = lambda: sorted(map(tuple, chain_dedup.passages(rows(spark, values)).collect()))
    plain = found()
    monkeypatch.setattr(chain_dedup, "HOT_LEAST", 30)
    hot = found()
    assert len(plain) >= 40 and hot == plain


def test_words_of_texts(spark):
    """sized counts words as the contract's pattern does, nulls as none, also over many slices."""
    values = [None, "", " \t\n", "a", "a\x0bb\x0cc\rd e", "é x  ß", "w " * 300_000, "x" * 600_000, "a b"]
    got = rows(spark, values).selectExpr("doc_id", "1L AS t1", "2L AS t2", "text").mapInArrow(chain_dedup.sized, "doc_id long, t1 long, t2 long, n_words long").collect()
    assert {r.doc_id: r.n_words for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(values)}
    assert {(r.t1, r.t2) for r in got} == {(1, 2)}


def test_null_and_repeated_ids_and_clashing_columns(spark):
    """A text without an id comes last, texts may share an id, and columns named as the operator's own are not read."""
    passage = prose(1, 60)
    held = [(None, 1), (5, 2), (5, 3), (7, 4), (None, 5)]
    data = [(i, prose(100 + k, 30) + " " + passage + " " + prose(200 + k, 30), k, "x", 1, k) for i, k in held] + [(None, None, None, None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, seed long, salt string, hot int, t1 long")
    found = [(r.doc_id, r.other_id) for r in chain_dedup.passages(docs).collect()]
    assert sorted(found, key=str) == sorted([(5, 5), (7, 5), (None, 5), (None, 5)], key=str)
    # a repeated row has its own id as the first one of its text, and so no row
    twice = chain_dedup.passages(docs.where("doc_id = 7").union(docs.where("doc_id = 7"))).collect()
    assert not twice


def plain_extension(u, w):
    """What chain_dedup.extended gives for one end, a cell at a time."""
    grid, part = chain_dedup.GRID, chain_dedup.LEAST_PERCENT
    u, w = u[:grid], w[:grid]
    run = next((i for i, (x, y) in enumerate(zip(u, w)) if x != y), min(len(u), len(w)))
    a, b, best, found = u[run:], w[run:], 0, [run, run, run]
    row = [0] * (grid + 1)
    for i, x in enumerate(a if len(b) else [], 1):
        new = [0]
        for k in range(1, grid + 1):
            new.append(max(row[k], new[-1], row[k - 1] + (k <= len(b) and b[k - 1] == x)))
        row = new
        scores = [100 * n - part * max(k, i) for k, n in enumerate(row)]
        top = max(scores)
        k = scores.index(top)
        if top > best:
            best, found = top, [run + i, run + k, run + row[k]]
        elif top < best - chain_dedup.DROP * part:
            break
    return found


@pytest.mark.parametrize("seed", range(6))
def test_extensions_against_plain_ones(seed):
    """Ends of all lengths that go on far, a little or not at all, also with the words 0 that fill up shorter ones."""
    r, ends = random.Random(seed), []
    for i in range(150):
        u = [r.randrange(r.choice((3, 12, 400))) for _ in range(r.randrange(70))]
        w = [x if r.random() > r.choice((0, 0.1, 0.3, 0.6)) else r.randrange(400) for x in u]
        cut = r.randrange(71)
        w = w[:cut] + [r.randrange(9) for _ in range(r.randrange(6))] + w[cut:]
        ends.append((np.array(u, "<u4"), np.array(w, "<u4")))
    assert chain_dedup.extended(ends).tolist() == [plain_extension(u.tolist(), w.tolist()) for u, w in ends]


def test_plain_pairs_are_chained_as_all_others():
    """Pairs whose matches all add to one chain, and pairs of any other kind, have the chains that each has alone."""
    r, pairs = random.Random(3), {}
    for i in range(300):
        x, y, matches = 0, 0, set()
        for _ in range(r.randint(1, 9)):
            x, y = x + r.choice((1, 5, 30, 63, 64, 65, 90)), max(0, y + r.choice((1, 5, 15, 16, 17, 40, 64, 65, -3)))
            matches.add((x, y))
        pairs[i // 3 + 5, i % 3] = sorted(matches)
    rows_ = [(n << chain_dedup.POSITION | x, q << chain_dedup.POSITION | y, (x + y) % 2 == 0) for (n, q), m in sorted(pairs.items()) for x, y in m]
    columns = [pa.array(c) for c in zip(*rows_)]
    batches = pa.Table.from_arrays(columns, ["place", "qplace", "second"]).to_batches(7)
    got = sorted((x["n"], x["q"], x["second"], x["xs"], x["ys"]) for b in chain_dedup.chained(iter(batches)) for x in b.to_pylist())
    expected = []
    for (n, q), m in pairs.items():
        x, y = (np.array(c) for c in zip(*m))
        for c in chain_dedup.chains(x, y):
            if len(c) > 1:
                expected.append((n, q, any((x[i] + y[i]) % 2 == 0 for i in c), x[c].tolist(), y[c].tolist()))
    assert got == sorted(expected) and len(got) > 100


def test_texts_are_numbered_in_order(spark):
    """By first id with nulls last, then by hash, whatever ids repeat or are below zero."""
    r = random.Random(1)
    texts = [(r.randrange(-9, 9), r.randrange(-9, 9), r.choice((None, -5, 0, 3, 2**62))) for _ in range(200)]
    texts = list({t[:2]: t for t in texts}.values())
    got = chain_dedup.numbered(spark.createDataFrame(texts, "t1 long, t2 long, first_id long").repartition(5)).collect()
    order = sorted(texts, key=lambda t: (t[2] is None, t[2] or 0, t[0], t[1]))
    assert {(x.t1, x.t2): x.n for x in got} == {t[:2]: n for n, t in enumerate(order)}


@pytest.mark.parametrize("least", (1000, 5))
def test_recurring_rows(spark, monkeypatch, least):
    """Keys once, twice, often and in a third of all rows, with and without hot ones among them."""
    monkeypatch.setattr(chain_dedup, "HOT_LEAST", least)
    r = random.Random(least)
    data = [(r.choice((7, r.randrange(100), r.randrange(-(10**6), 10**6))), i * 3, -i) for i in range(3000)]
    r.shuffle(data)
    got, _ = chain_dedup.recurring(settle(spark.createDataFrame(data, "k long, place long, other long").repartition(4), "rows"), "k", "other")
    places = {}
    for k, p, _ in data:
        places.setdefault(k, []).append(p)
    expected = {(k, p, o, min(places[k]), len(places[k]) > 2) for k, p, o in data if len(places[k]) > 1}
    found = {tuple(x) for x in got.select("k", "place", "other", "first", "many").collect()}
    # a hot key is said to have many
    assert {x[:4] for x in found} == {x[:4] for x in expected}
    assert all(x in found or (*x[:4], True) in found for x in expected)


def test_words_and_lines_repeated_over_and_over(spark):
    """Runs of one word, of two or of a line, with others' runs too short to count before them: found against earlier texts as far as these go, and otherwise against the run's own first half."""
    values, expected = [], []
    for k, line in enumerate(["onin ", "ea ha ", "le. von le. reha zum ", prose(7, 12) + " ", prose(8, 33) + " "]):
        n = len(line.split())
        run = lambda words: " ".join((line * -(-words // n)).split()[:words])  # noqa: B023, E731
        for i, words in enumerate((30, 38, 150, 90, 150, 38, 230, 42)):
            at = len(values)
            values.append(prose(1000 + at, 50) + " " + run(words) + " " + prose(2000 + at, 50))
            # the first long run has what is beyond its first 40 words from itself, by whole lines; later ones have all from it, but for what only they have
            expected.append([0, 0, 110 if n < 12 else 50, 90, 150, 0, 230 if n < 12 else 150, 42][i])
    found = chain_dedup.passages(rows(spark, values)).collect()
    for i, least in enumerate(expected):
        covered = {w for x in found if x.doc_id == i for w in range(x.start, x.end)}
        assert len(covered) > least - chain_dedup.K, (i, len(covered))
    for r in found:
        a, b = values[r.doc_id].split()[r.start : r.end], values[r.other_id].split()[r.other_start : r.other_end]
        assert min(len(a), len(b)) >= chain_dedup.LEAST_WORDS
        assert r.equal_words <= lcs(a, b) and 100 * r.equal_words >= chain_dedup.LEAST_PERCENT * max(len(a), len(b))
        assert r.doc_id != r.other_id or r.other_end <= r.start
