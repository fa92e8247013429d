"""Fuzzy repeated passages by collinear chaining of k-mer seeds.

Passages are sought across documents and within them. Seeds are word k-mers picked by winnowing: of each WINDOW consecutive ones the
smallest hash, and every k-mer with a small hash. Any run of K + WINDOW - 1 words that two texts share gives both
a common seed, and of shorter runs a quarter of their k-mers are. Each occurrence of a seed is matched with the seed's
earliest occurrence, and where that is not in the text that first has the seed together with another one APART_BEFORE words or more before it, or APART_AFTER
words or more after it, with these texts too: a text that has only a piece of a passage too short to count cannot stand in for one that has it whole. As texts with
pieces may hold any two seeds of it, an occurrence is matched with the earliest that has the same seeds all along the next LEAST_WORDS words as well. Where a
text repeats a seed (a word or a line over and over), one earliest place gives no chain: the seed's first, second, third occurrence in such a run are
matched each with the earliest first, second, third one, and the run's second half with its first. So a passage that n documents share gives about n matches for each seed and
not n * n, its documents are linked through the earliest, and one that the earliest holds only in part is linked to another that holds the rest. The matches
of a pair of texts are chained in order, with gap costs, through a
Fenwick tree; chains are aligned word by word between their seeds and beyond their ends, cut at
their least similar stretches until what is left is similar enough, and what is long enough then is a passage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel
from millrace.llm.shared import HOT_PARTS, attach, discard, distinct_texts, join_texts, rows_of, settle, text_keys
from millrace.llm.substring_dedup import sliding_least

K, WINDOW = 6, 8
#: k-mers whose hash starts with so many zero bits are seeds too, whatever their neighbours: edits nearby do not unpick them.
ZEROS = 2
#: Worth of a seed in a chain, and cost of each word between two seeds, on either side: single seeds join up to 40 words apart, longer chains further.
SEED, GAP = 5.0, 1 / 16
#: A chain is cut where its seeds lie further apart; a passage has this many words and this share of equal ones.
MOST_GAP, LEAST_WORDS, LEAST_PERCENT = 64, 40, 70
#: Regions of words are fetched in multiples of this.
GRID = 64
#: Words between a seed and the ones that it is matched together with: the nearest such seed so far before it, and the nearest so far after it.
#: A text that holds a seed and one LEAST_WORDS - K before it can hold a passage; the nearer one after it is for passages that are hardly longer than that.
APART_BEFORE, APART_AFTER = LEAST_WORDS - K, 20
#: An end goes on no further once it has fallen back by what so many unequal words cost.
DROP = 16
#: The fewest words beyond a first unequal one that can be similar enough.
LEAST_ON = 3
#: Ends that are aligned together.
TOGETHER = 256
#: Seeds that occur less often than this are never hot.
HOT_LEAST = 1000
U = np.uint64
#: A place is one number: the number of its text, and in so many low bits the word. Texts are numbered by their ids, so that places are in order too.
POSITION = 26
#: Added to the other place of matches of runs, which so are chained by themselves; texts' numbers lie below.
OF_RUNS = 1 << 62
#: Rows that are looked at together where what is done is small.
ROWS = 1 << 17


def picked(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row of each slice of texts; hashes of its k-mers, and the first one of each text; of its seeds the row from there, and which k-mers they are."""
    low = U((1 << POSITION) - 1)
    for row, data, offsets in kernel.slices(column):
        start, end, first = kernel.words(data, offsets)
        h, begin = kernel.windows(kernel.spans_hash(kernel.LOWER[data], start, end), first, K)
        if not len(h):
            continue
        n = np.diff(begin)
        own = np.repeat(np.arange(len(n)), n)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        least = sliding_least(key, WINDOW)
        inside = np.arange(len(least)) + WINDOW <= begin[own[: len(least)] + 1]
        short = np.flatnonzero((n > 0) & (n < WINDOW))  # rows with fewer k-mers have their smallest
        few = np.array([key[begin[i] : begin[i + 1]].min() for i in short], np.uint64)
        small = np.flatnonzero(h >> U(64 - ZEROS) == 0).astype(np.uint64)
        at = np.unique(np.concatenate((least[inside] & low, few & low, small))).astype(np.int64)
        yield row, h, begin, own[at], at


def runs(h: np.ndarray, begin: np.ndarray, own: np.ndarray, at: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Further seeds, all odd, and which of the seeds at `at` have them: those in runs of a seed within a text, no more than MOST_GAP words from one place to the next and LEAST_WORDS words in all.

    One is the seed with its number in the run, so that two runs have them in common as far as the shorter one goes. Others are of this run alone, and common to two places of it:
    its second half is so matched with the first, the half of that with what is before it and so on. Shorter runs have none, so that they can't stand in for long ones.
    """
    order = np.argsort(kernel.mix(h[at] + text[own].astype(U) * kernel.STEP), kind="stable")  # places rise, and so they do among equal ones
    s, t, x = h[at][order], own[order], at[order]
    bounds = np.append(np.append(0, np.flatnonzero((s[1:] != s[:-1]) | (t[1:] != t[:-1]) | (x[1:] - x[:-1] > MOST_GAP)) + 1), len(s))
    lo, hi = bounds[:-1], bounds[1:]
    # windows that reach beyond a run can have picked others than its first and last
    likely = (hi - lo > 1) & (x[hi - 1] + K - x[lo] >= LEAST_WORDS - 2 * WINDOW)
    lo, hi = lo[likely], hi[likely]
    words = x[hi - 1] + K - x[lo]
    for end, step, bound in ((x[lo], -1, begin[t[lo]]), (x[hi - 1], 1, begin[t[lo] + 1] - 1)):
        period = (x[lo + 1] - x[lo]) if step < 0 else (x[hi - 2] - x[hi - 1])
        on = np.ones(len(lo), bool)
        for k in range(1, WINDOW + 1):
            i = end + step * k
            on &= (i >= begin[t[lo]]) if step < 0 else (i <= bound)
            i = np.where(on, i, end)
            on &= h[i] == h[i + period]
            words += on
    long = words >= LEAST_WORDS
    lo, hi, words = lo[long], hi[long], words[long]
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = hi - lo
    head = np.cumsum(size) - size
    number = np.arange(size.sum()) - np.repeat(head, size)
    i = number + np.repeat(lo, size)
    from_start = x[i] - np.repeat(x[lo], size)
    seed, place = s[i].view(np.int64), (text[t[i]] << POSITION) + np.repeat(x[lo] - begin[t[lo]], size)
    found, rows = [key_of(seed, number)], [order[i]]
    upto = np.where(words >= 2 * LEAST_WORDS, words, 0)
    while upto.any():
        last = upto < 2 * LEAST_WORDS
        down = np.where(last, LEAST_WORDS, (upto + 1) // 2)
        upto = np.where(last & (upto > 0), 2 * LEAST_WORDS - K + 1, upto)
        shift = np.add.reduceat((from_start < np.repeat(down, size)).astype(np.int64), head)
        above = np.add.reduceat((from_start < np.repeat(upto, size)).astype(np.int64), head) - shift
        shift, above, level = (np.repeat(v, size) for v in (shift, above, upto))
        for k in (number, number - shift):
            pair = (k >= 0) & (k < above)
            found.append(key_of(seed[pair], place[pair], level[pair], k[pair]))
            rows.append(order[i][pair])
        upto = np.where(last, 0, down)
    return np.concatenate(found) | 1, np.concatenate(rows)


def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """s (the seed) and place of each seed; odd ones are those of runs."""
    for batch in batches:
        n = batch.column("n").to_numpy()
        for row, h, begin, own, at in picked(batch.column("text")):
            place = n[own + row] << POSITION | at - begin[own]
            more, which = runs(h, begin, own, at, n[row : row + len(begin) - 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h[at].view(np.int64) & ~1, more)), pa.array(np.append(place, place[which]))], ["s", "place"])


def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and weight of the keys that are more than one of 4 * HOT_PARTS in some batch; a row without a key tells the number of all.

    Summed by key, the weights lack less than one of 4 * HOT_PARTS of all rows.
    """
    for t in whole(batches, None):
        key, n = np.unique(t.column(0).to_numpy(), return_counts=True)
        often = n * 4 * HOT_PARTS > t.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([None, *key[often].tolist()], pa.int64()), pa.array(np.concatenate(([t.num_rows], n[often])))], ["key", "weight"])


Columns = Callable[[pa.RecordBatch], list[np.ndarray]]


def whole(batches: Iterator[pa.RecordBatch], by: Columns | None) -> Iterator[pa.Table]:
    """Batches put together to ROWS rows or more; rows come sorted by what `by` gives, if anything, and those that are equal in it are not parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS:
            continue
        upto = batch.num_rows
        if by is not None:
            new = np.flatnonzero(np.any([k != k[-1] for k in by(batch)], axis=0)) if upto else []
            upto = int(new[-1]) + 1 if len(new) else 0
        if upto:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, upto)])
            held = [batch.slice(upto)]
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


class Fenwick:
    """Largest (value, place) among the first n keys."""

    def __init__(self, n: int) -> None:
        self.best = [(-1e18, -1)] * (n + 1)

    def raise_to(self, key: int, value: tuple[float, int]) -> None:
        key += 1
        while key < len(self.best):
            if value > self.best[key]:
                self.best[key] = value
            key += key & -key

    def below(self, key: int) -> tuple[float, int]:
        """The largest of all smaller keys."""
        found = (-1e18, -1)
        while key:
            if self.best[key] > found:
                found = self.best[key]
            key -= key & -key
        return found


def chains(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Chains of matches that rise in x and in y, best first, without common members, cut at wide gaps.

    A chain is worth SEED for each match less GAP for each word, in x and in y, from one
    match to the next. As the cost is a difference of sums, the best match
    to come from is the one with the largest worth + GAP * (x + y) below y.
    """
    order = np.lexsort((-y, x))  # equal x: falling y, so that none follows another
    keys = {v: k for k, v in enumerate(np.unique(y).tolist())}
    tree, worth, before = Fenwick(len(keys)), [0.0] * len(x), [-1] * len(x)
    for i in order.tolist():
        a, b = int(x[i]), int(y[i])
        value, j = tree.below(keys[b])
        worth[i] = SEED
        if j >= 0 and value - GAP * (a + b) > 0:
            worth[i], before[i] = SEED + value - GAP * (a + b), j
        tree.raise_to(keys[b], (worth[i] + GAP * (a + b), i))
    used, out = [False] * len(x), []
    for i in sorted(range(len(x)), key=lambda i: -worth[i]):
        chain: list[int] = []
        while i >= 0 and not used[i]:
            used[i] = True
            if chain and max(x[chain[-1]] - x[i], y[chain[-1]] - y[i]) > MOST_GAP:
                out.append(chain[::-1])
                chain = []
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


CHAIN = "n long, q long, second boolean, xs array<int>, ys array<int>"


def texts_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Numbers of both texts of matches, those of runs apart."""
    return [batch.column(c).to_numpy() >> POSITION for c in ("place", "qplace")]


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by pair of texts, place and qplace; a pair has at most a text's seeds."""
    for t in whole(batches, texts_of):
        places = [t.column(c).to_numpy() for c in ("place", "qplace")]
        # a match may come twice; it is one of a second partner if it is nothing else
        at = np.append(0, np.flatnonzero(np.any([k[1:] != k[:-1] for k in places], axis=0)) + 1)
        again = np.logical_and.reduceat(t.column("second").to_numpy(), at)
        n, q = (k[at] >> POSITION for k in places)
        x, y = ((k[at] & (1 << POSITION) - 1).astype(np.int32) for k in places)
        inside = (n[1:] == n[:-1]) & (q[1:] == q[:-1])
        lo = np.append(0, np.flatnonzero(~inside) + 1)
        size = np.diff(np.append(lo, len(x)))
        # where each match adds more than its gap costs, all of a pair are one chain
        dx, dy = np.diff(x), np.diff(y)
        plain = (dx > 0) & (dy > 0) & ((dx + dy) * GAP < SEED) & (np.maximum(dx, dy) <= MOST_GAP)
        easy = (size > 1) & (np.add.reduceat(np.append(inside & ~plain, False).astype(np.int64), lo) == 0)
        links, lengths = [np.flatnonzero(np.repeat(easy, size))], [size[easy]]
        hard = (size > 2) & ~easy  # two matches that are not so are no chain
        for a, b in zip(lo[hard].tolist(), (lo + size)[hard].tolist()):
            found = [c for c in chains(x[a:b], y[a:b]) if len(c) > 1]
            links += [np.array(c) + a for c in found]
            lengths.append(np.array([len(c) for c in found], np.int64))
        link, bounds = np.concatenate(links), np.cumsum(np.concatenate([[0], *lengths])).astype(np.int32)
        if not len(link):
            continue
        first = link[bounds[:-1]]
        lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(v[link])) for v in (x, y)]
        yield pa.RecordBatch.from_arrays([pa.array(n[first]), pa.array(q[first] & (OF_RUNS >> POSITION) - 1), pa.array(np.logical_or.reduceat(again[link], bounds[:-1])), *lists], ["n", "q", "second", "xs", "ys"])


def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of each asked region of a text."""
    for batch in batches:
        for row, data, offsets in kernel.slices(batch.column("text")):
            start, end, first = kernel.words(data, offsets)
            h = (kernel.spans_hash(kernel.LOWER[data], start, end) >> U(32)).astype("<u4")
            asked = batch.column("asked").slice(row, len(offsets) - 1)
            own = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())
            spans = asked.flatten()
            a, b = (spans.field(c).to_numpy() for c in ("a", "b"))
            size = np.diff(first)[own]
            lo, hi = first[own] + np.minimum(a, size), first[own] + np.minimum(b, size)
            take = pa.array(own + row)
            words = pa.array([h[i:j].tobytes() for i, j in zip(lo.tolist(), hi.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("n", "id")], *[spans.field(c) for c in ("a", "b", "weight")], words], ["n", "id", "a", "b", "weight", "words"])


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common subsequence of two short stretches, a bit vector for each word of one."""
    if not len(a) or not len(b):
        return 0
    at: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        m = at.get(w, 0) & v
        v = ((v + m) | (v - m)) & full
    return len(a) - v.bit_count()


def extended(ends: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each two stretches the words of either that an alignment goes on for, and equal ones among them.

    Of all prefixes the ones with the most equal words beyond LEAST_PERCENT of the longer; none lowers a passage below it.
    Many pairs take each step together, for as long as they go on.
    """
    found = np.zeros((len(ends), 3), np.int64)
    across = np.arange(GRID + 1, dtype=np.int16)
    open_ends = []
    for lo in range(0, len(ends), TOGETHER):
        part = ends[lo : lo + TOGETHER]
        # what lies beyond an end is equal to nothing
        n = np.array([[min(len(x), GRID) for x in pair] for pair in part])
        a, b = np.zeros((len(part), GRID + 1), "<u4"), np.zeros((len(part), GRID + 1), "<u4")
        for k, (u, w) in enumerate(part):
            a[k, : n[k, 0]], b[k, : n[k, 1]] = u[:GRID], w[:GRID]
        run = ((a == b) & (across < n.min(1)[:, None])).argmin(1)
        found[lo : lo + len(part)] = run[:, None]
        on = np.flatnonzero(n.min(1) > run)
        after = np.minimum(run[on, None] + np.arange(GRID), GRID)
        # of i words no more can be equal than stand anywhere on the other side: ends where these are too few go on no further
        stand = (np.take_along_axis(a[on], after, 1)[:, :, None] == np.take_along_axis(b[on], after, 1)[:, None, :]).any(2)
        most = (100 * np.cumsum(stand, axis=1) - LEAST_PERCENT * np.arange(1, GRID + 1))[:, LEAST_ON - 1 :].max(1)
        open_ends += (lo + on[most > 0]).tolist()
    for lo in range(0, len(open_ends), TOGETHER):
        own = np.array(open_ends[lo : lo + TOGETHER])
        part = [ends[i] for i in own]
        a, b = (np.full((len(part), 2 * GRID), nothing, np.int64) for nothing in (-1, -2))
        n = np.array([[min(len(x), GRID) for x in pair] for pair in part])
        for k, (u, w) in enumerate(part):
            a[k, : n[k, 0]], b[k, : n[k, 1]] = u[:GRID], w[:GRID]
        run = found[own, 0]
        n = n - run[:, None]
        alive = np.flatnonzero(n.min(1) > 0)
        after = run[alive, None] + np.arange(GRID)
        a, b = np.take_along_axis(a[alive], after, 1), np.take_along_axis(b[alive], after, 1)
        row, best = np.zeros((len(alive), GRID + 1), np.int16), np.zeros(len(part), np.int64)
        for i in range(1, GRID + 1):
            if not len(alive):
                break
            new = row.copy()
            new[:, 1:] = np.maximum(row[:, 1:], row[:, :-1] + (b == a[:, i - 1 : i]))
            row = np.maximum.accumulate(new, axis=1)
            score = 100 * row - LEAST_PERCENT * np.maximum(across, np.int16(i))
            k = score.argmax(1)
            each = np.arange(len(alive))
            top, was = score[each, k].astype(np.int64), best[alive]
            more = top > was
            better = alive[more]
            best[better] = top[more]
            found[own[better]] = run[better, None] + np.stack([np.full(len(better), i), k[more], row[each, k][more]], 1)
            on = (more | (top >= was - DROP * LEAST_PERCENT)) & (n[alive, 0] > i)
            if not on.all():
                alive, row, a, b = alive[on], row[on], a[on], b[on]
    return found


Part = tuple[int, int, int, int, int, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def similar(xs: np.ndarray, ys: np.ndarray, u: np.ndarray, w: np.ndarray, apart: int | None = None) -> list[Part]:
    """x0, x1, y0, y1 and equal words of each similar part of a chain, and the stretches before (backwards) and after it; positions count from the regions' first words u[0], w[0].

    Seeds are equal as they are; stretches between them are aligned. A chain that
    is not similar enough is cut at the stretch that lacks most equal words, and its parts are looked at again.
    Within one text apart is where w begins, counted from u[0]; the two sides do not overlap there.
    """
    xs, ys = xs.tolist(), ys.tolist()
    gain, lack = [0], [0]
    for c, d, a, b in zip(xs, ys, xs[1:], ys[1:]):
        far = max(a - c, b - d)
        if a - c == b - d and (far <= K or u[c + K : a].tobytes() == w[d + K : b].tobytes()):  # seeds on one diagonal that overlap or have equal words between
            gain.append(far)
        else:
            at_x, at_y = c + K, d + K
            step = max(at_x - a, at_y - b, 0)  # what the next seed shares with what is aligned already
            gain.append(common_words(u[at_x : max(at_x, a)], w[at_y : max(at_y, b)]) + K - step)
        lack.append(LEAST_PERCENT * far - 100 * gain[-1])
    upto = list(accumulate(gain))
    out, parts = [], [(0, len(xs) - 1, 0, len(u), 0, len(w))]
    while parts:
        i, j, x_least, x_most, y_least, y_most = parts.pop()
        x0, x1, y0, y1 = xs[i], xs[j] + K, ys[i], ys[j] + K
        equal = K + upto[j] - upto[i]
        if apart is not None:
            if y1 + apart > x0 and i < j:  # cut in the middle, until the sides are apart
                k = (i + j + 1) // 2
                parts.append((i, k - 1, x_least, xs[k], y_least, ys[k]))
                parts.append((k, j, xs[k - 1] + K, x_most, ys[k - 1] + K, y_most))
                continue
            middle = (x0 + y1 + apart) // 2
            x_least, y_most = max(x_least, min(middle, x0)), min(y_most, max(middle - apart, y1))
        if 100 * equal >= LEAST_PERCENT * max(x1 - x0, y1 - y0):
            out.append((x0, x1, y0, y1, equal, (u[x_least:x0][::-1], w[y_least:y0][::-1]), (u[x1:x_most], w[y1:y_most])))
        elif j > i:
            k = max(range(i + 1, j + 1), key=lack.__getitem__)
            parts.append((i, k - 1, x_least, xs[k], y_least, ys[k]))
            parts.append((k, j, xs[k - 1] + K, x_most, ys[k - 1] + K, y_most))
    return out


def grown(parts: list[Part]) -> np.ndarray:
    """x0, x1, y0, y1 and equal words of each part with what its ends add, and whether it is a passage (one row each)."""
    x0, x1, y0, y1, equal = np.array([p[:5] for p in parts], np.int64).reshape(-1, 5).T
    added = extended([p[side] for side in (5, 6) for p in parts])
    before, after = added[: len(parts)].T, added[len(parts) :].T
    x0, y0, x1, y1, equal = x0 - before[0], y0 - before[1], x1 + after[0], y1 + after[1], equal + before[2] + after[2]
    whole = (np.minimum(x1 - x0, y1 - y0) >= LEAST_WORDS) & (100 * equal >= LEAST_PERCENT * np.maximum(x1 - x0, y1 - y0))
    return np.stack([x0, x1, y0, y1, equal, whole], 1)


def align(xs: np.ndarray, ys: np.ndarray, u: np.ndarray, w: np.ndarray, apart: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """x0, x1, y0, y1 and equal words of each passage of a chain."""
    return [tuple(p[:5]) for p in grown(similar(xs, ys, u, w, apart)).tolist() if p[5]]


def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, parts = [], []
        same = batch.column("n").to_numpy() == batch.column("q").to_numpy()
        first = {c: batch.column(c).to_numpy().astype(np.int64) for c in ("xa", "ya")}
        lists = [batch.column(c) for c in ("xs", "ys")]
        values = [c.values.to_numpy() for c in lists]
        bounds = [c.offsets.to_numpy().tolist() for c in lists]
        for k, (u, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("u", "w")))):
            xa, ya = int(first["xa"][k]), int(first["ya"][k])
            xs, ys = (v[at[k] : at[k + 1]] for v, at in zip(values, bounds))
            found = similar(xs - xa, ys - ya, np.frombuffer(u, "<u4"), np.frombuffer(w, "<u4"), ya - xa if same[k] else None)
            row += [k] * len(found)
            parts += found
        made = grown(parts)
        whole = made[:, 5] > 0
        row, made = np.array(row, np.int64)[whole], made[whole]
        made[:, :2] += first["xa"][row, None]
        made[:, 2:4] += first["ya"][row, None]
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("n", "second", "id", "qid")], *[pa.array(made[:, i]) for i in range(5)]], ["n", "second", "doc_id", "other_id", "start", "end", "other_start", "other_end", "equal_words"])


def numbered(texts: DataFrame) -> DataFrame:
    """t1, t2 and n of each text: its number in the order of first_id (nulls last), t1 and t2."""
    ordered = texts.orderBy(F.col("first_id").isNull(), "first_id", "t1", "t2")
    # the number of the task that holds a stretch of the order, and from there on the row
    ordered = settle(ordered.select("t1", "t2", F.monotonically_increasing_id().alias("row")), "ordered")
    part = F.shiftright("row", 33).alias("part")
    sizes = sorted(map(tuple, ordered.groupBy(part).count().collect()))
    before = [(part, start) for (part, _), start in zip(sizes, accumulate((n for _, n in sizes), initial=0))]
    starts = texts.sparkSession.createDataFrame(before, "part long, start long")
    n = (F.col("start") + F.col("row").bitwiseAND((1 << 33) - 1)).alias("n")
    return ordered.withColumn("part", part).join(F.broadcast(starts), "part").select("t1", "t2", n)


def recurring(rows: DataFrame, key: str, *others: str) -> tuple[DataFrame, DataFrame]:
    """key, place and others of the rows, all whole numbers, whose key recurs, with first (the earliest place of the key) and many (whether there are more than two); and the table that they are read from.

    Rows, which are a settled table, are shuffled once. Keys with more than one of HOT_PARTS of them are hot, and none with less than one of 2 * HOT_PARTS, so there are fewer
    than 2 * HOT_PARTS; which ones are hot doesn't change the rows. They are dealt out by their places, and their earliest places are aggregated afterwards and broadcast.
    """
    weights = rows.select(key).mapInArrow(frequent, "key long, weight long").groupBy("key").agg(F.sum("weight").alias("weight"))
    often = settle(weights.where(F.col("key").isNull() | (F.col("weight") >= HOT_LEAST)), "often")
    total = often.where("key is null").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    hot = sorted(r[0] for r in often.where(F.col("key").isNotNull() & (F.col("weight") > total // (2 * HOT_PARTS))).select("key").collect())
    discard(often)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key."""
        for t in whole(batches, lambda batch: [batch.column(key).to_numpy()]):
            keys, place = t.column(key).to_numpy(), t.column("place").to_numpy()
            at = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
            size = np.diff(np.append(at, len(keys)))
            anyway = np.isin(keys[at], hot)
            more = anyway | (size > 1)
            take = pa.array(np.flatnonzero(np.repeat(more, size)))
            n = size[more]
            columns = [t.column(c).take(take).combine_chunks() for c in (key, "place", *others)]
            added = [np.repeat(np.minimum.reduceat(place, at)[more], n), np.repeat((anyway | (size > 2))[more], n)]
            yield from pa.Table.from_arrays([*columns, *map(pa.array, added)], [key, "place", *others, "first", "many"]).to_batches(ROWS)

    is_hot = F.col(key).isin(hot)
    salt = F.when(is_hot, F.xxhash64("place")) if hot else F.lit(0)
    dealt = rows.select(key, "place", *others).repartition(F.col(key), salt).sortWithinPartitions(key)
    kinds = dict(rows.dtypes)
    found = settle(dealt.mapInArrow(firsts, ", ".join([*(f"{c} {kinds[c]}" for c in (key, "place", *others)), "first bigint", "many boolean"])), "found")
    if not hot:
        return found, found
    earliest = found.where(is_hot).groupBy(F.col(key).alias("sought")).agg(F.min("first").alias("earliest"))
    known = found.join(F.broadcast(earliest), F.col(key) == F.col("sought"), "left")
    return known.select(key, "place", *others, F.coalesce("earliest", "first").alias("first"), "many"), found


def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text."""
    for batch in batches:
        for row, data, offsets in kernel.slices(batch.column("text")):
            n = np.diff(kernel.words(data, offsets)[2])
            part = batch.slice(row, len(n))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "t1", "t2")], pa.array(n.astype(np.int64))], ["doc_id", "t1", "t2", "n_words"])


def key_of(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of numbers."""
    h = np.full(len(parts[0]), len(parts), U)
    for p in parts:
        h = kernel.mix(h * kernel.STEP + p.astype(np.int64).view(U))
    return h.view(np.int64)


def is_fixed(s: np.ndarray) -> np.ndarray:
    """The seeds that are picked by their hash alone, such as all copies have."""
    return s.view(U) >> U(64 - ZEROS) == 0


def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by place. For each with many: what it has together with the other seeds (pair), as far as another one that is matched as well, so that a single stretch makes a chain (span), place, and the seed's own earliest (own)."""
    for t in whole(batches, lambda batch: [batch.column("place").to_numpy() >> POSITION]):
        s, place, own, many = (t.column(c).to_numpy() for c in ("s", "place", "first", "many"))
        fixed = is_fixed(s)
        other, at = s[fixed], place[fixed]
        sums = np.append(0, np.bitwise_xor.accumulate(other)) if len(other) else np.zeros(1, np.int64)
        s, place, own, fixed = s[many], place[many], own[many], fixed[many]
        upto = lambda k, side: np.searchsorted(at, k, side)
        out = []
        last = upto(place + (LEAST_WORDS - K), "right")
        for k, kind in ((upto(place - APART_BEFORE, "right") - 1, 2), (upto(place + APART_AFTER, "left"), 2), (last - 1, 3)):
            row = np.flatnonzero((k >= 0) & (k < len(at)))
            row = row[at[k[row]] >> POSITION == place[row] >> POSITION]
            if kind == 3:
                row = row[fixed[row] & (at[k[row]] > place[row])]
            away = at[k[row]] - place[row]
            parts = [s[row], other[k[row]], away]
            if kind == 3:
                parts.append(sums[last[row]] ^ sums[upto(place[row], "left")])
            out.append([key_of(*parts), away if kind == 3 else np.zeros(len(row), np.int64), place[row], own[row]])
        columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
        yield from pa.Table.from_arrays(columns, ["pair", "span", "place", "own"]).to_batches(ROWS)


def second(matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches of seeds with the earliest places of theirs that have the same other seed APART_BEFORE or APART_AFTER words away or more, or the same ones all along the next LEAST_WORDS words, where those are in other texts than the seed's own earliest; and the table that they are read from.

    Only seeds with a third occurrence can have any. At most four for each occurrence, so they stay linear.
    """
    # all others neither have a further partner nor stand beside one that has; the other seeds are matched themselves
    rows = matched.where((F.col("many") | F.expr(f"s >= 0 and shiftright(s, {64 - ZEROS}) = 0")) & (F.col("s").bitwiseAND(1) == 0))
    in_text = rows.repartition(F.shiftright("place", POSITION)).sortWithinPartitions("place")
    pair = settle(in_text.mapInArrow(beside, "pair long, span long, place long, own long"), "pairs")
    found, table = recurring(pair, "pair", "span", "own")
    discard(pair)
    other = found.where((F.col("first") < F.col("place")) & (F.shiftright("first", POSITION) != F.shiftright("own", POSITION)))
    step = F.explode(F.when(F.col("span") > 0, F.array(F.lit(0), "span")).otherwise(F.array(F.lit(0)))).alias("step")
    other = other.select("place", "first", step)
    return other.select((F.col("place") + F.col("step")).alias("place"), (F.col("first") + F.col("step")).alias("qplace"), F.lit(True).alias("second")), table


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fuzzy passages: doc_id, other_id, start, end, other_start, other_end (words, end excluded), equal_words, copy.

    other_id is doc_id for a passage that the text itself holds further up.

    One row for each passage of a text that an earlier text (by smallest id, nulls last) or an earlier place of it holds too, with at least LEAST_WORDS words on both sides and
    LEAST_PERCENT of them equal in order. Words are lower-cased in A-Z. Rows with the text of an
    earlier row have one row instead, with copy true, that spans the text; they are otherwise
    represented by that earlier row. Documents without a passage, null and short texts have
    no rows; a repeated row is a copy of itself; other columns are not read; an empty table gives no rows.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = named.withColumns(text_keys())
    texts = settle(keyed.where("text is not null").groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")), "texts")
    once = distinct_texts(keyed.where("text is not null"), texts)
    single = settle(once.join(numbered(texts).hint("shuffle_hash"), ["t1", "t2"]).select("n", "id", "text"), "single")
    found = settle(single.mapInArrow(seeds, "s long, place long"), "seeds")
    matched, table = recurring(found, "s")
    discard(found)
    further, more = second(matched)
    text_of = lambda c: F.shiftright(c, POSITION)
    of_run = F.col("s").bitwiseAND(1) == 1
    # what the text itself has in a run is news only where no earlier text has it
    inside = of_run & (text_of("place") == text_of("first"))
    earlier = matched.where("place > first").select("place", F.when(of_run, F.col("first") + OF_RUNS).otherwise(F.col("first")).alias("qplace"), inside.alias("second"))
    partners = earlier.unionByName(further)
    # places of one seed come in order too, so that reruns chain alike
    partners = partners.repartition(text_of("place"), text_of("qplace")).sortWithinPartitions(text_of("place"), text_of("qplace"), "place", "qplace")
    linked = settle(partners.mapInArrow(chained, CHAIN), "chains")
    discard(table, more)
    # the regions that alignments may reach into, in steps of GRID so that many chains ask for the same one
    down = lambda c: (F.floor(F.greatest(c - GRID, F.lit(0)) / GRID) * GRID).cast("int")
    up = lambda c: (F.ceil((c + K + GRID) / GRID) * GRID).cast("int")
    sides = {"xa": down(F.col("xs")[0]), "xb": up(F.element_at("xs", -1)), "ya": down(F.col("ys")[0]), "yb": up(F.element_at("ys", -1))}
    chain = settle(linked.withColumns(sides), "asked")
    discard(linked)
    asked = chain.select("n", F.col("xa").alias("a"), F.col("xb").alias("b")).union(chain.select("q", "ya", "yb"))
    asked = asked.groupBy("n", "a", "b").agg(F.count(F.lit(1)).alias("weight"))
    by_text = settle(asked.groupBy("n").agg(F.collect_list(F.struct("a", "b", "weight")).alias("asked")), "by-text")
    fetched = join_texts(single, by_text, rows_of(by_text), ["n"]).select("n", "id", "text", "asked").mapInArrow(regions, "n long, id long, a int, b int, weight long, words binary")
    name = lambda *c: F.concat_ws(":", *c)
    fetched = settle(fetched.select(name("n", "a", "b").alias("k"), "id", "words", "weight"), "words")
    discard(by_text, single)
    n = 2 * rows_of(chain)
    spread = F.struct("n", "q", F.col("xs")[0], F.col("ys")[0])
    both = attach(chain, name("n", "xa", "xb"), fetched.withColumnRenamed("words", "u"), "k", "weight", n, spread)
    both = attach(both, name("q", "ya", "yb"), fetched.withColumnsRenamed({"words": "w", "id": "qid"}), "k", "weight", n, spread)
    kinds = "n long, second boolean, doc_id long, other_id long, start long, end long, other_start long, other_end long, equal_words long"
    fuzzy = both.select("n", "q", "second", "id", "qid", "xs", "ys", "xa", "ya", "u", "w").mapInArrow(aligned, kinds)
    fuzzy = settle(fuzzy, "aligned")
    discard(chain, fetched)
    # what a second partner adds less than a seed's words to is told already
    told = fuzzy.where("not second").select("n", F.col("start").alias("from"), F.col("end").alias("to"))
    most = F.least("end", "to") - F.greatest("start", "from")
    news = fuzzy.where("second").alias("f").join(told.alias("g"), (F.col("f.n") == F.col("g.n")) & (most > F.col("end") - F.col("start") - K), "left_anti")
    # a chain of a run can end in the passage of another chain
    fuzzy = fuzzy.where("not second").unionByName(news).dropDuplicates([c for c in fuzzy.columns if c != "second"])
    fuzzy = fuzzy.drop("n", "second").withColumn("copy", F.lit(False))
    # rows with equal texts: each but the first is a copy of the first
    multiple = settle(texts.where("copies > 1").select(name("t1", "t2").alias("k"), "first_id", F.col("copies").alias("weight"), F.lit(True).alias("many")), "copies")
    n = multiple.sparkSession.read.schema(multiple.schema).parquet(multiple.settled_at).agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    rows = attach(keyed.mapInArrow(sized, "doc_id long, t1 long, t2 long, n_words long"), name("t1", "t2"), multiple, "k", "weight", n, F.struct("doc_id", "t1"), "inner")
    later = rows.where((F.col("n_words") >= LEAST_WORDS) & ~F.col("doc_id").eqNullSafe(F.col("first_id")))
    zero = F.lit(0).cast("long")
    copies = later.select("doc_id", F.col("first_id").alias("other_id"), zero.alias("start"), F.col("n_words").alias("end"), zero.alias("other_start"), F.col("n_words").alias("other_end"), F.col("n_words").alias("equal_words"), F.lit(True).alias("copy"))
    return fuzzy.unionByName(copies)
