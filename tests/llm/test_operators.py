"""The numbered operators against brute force on small tables with nulls, ties, copies, empty and long texts."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import kernel, mixing, near_dedup, packing, quality, shared, topk, transducer, warc
from millrace.llm import line_dedup as line_dedup_module
from millrace.llm.line_dedup import line_dedup, line_filter
from millrace.llm.queries import ORACLES, QUERIES
from millrace.llm.substring_dedup import substring_dedup
from millrace.llm.token_count import token_counts
from tests.compare import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Columns beside id and text, with names that operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, node string, size long, kept boolean, t1 long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(1, 8))) for _ in range(n))


def edited(text: str, seed: int, n: int) -> str:
    r, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = "edit" + str(r.randrange(1000))
    return " ".join(words)


def texts() -> list[str | None]:
    base = [prose(i, 120) for i in range(6)]
    out: list[str | None] = [None, "", "  \n\t ", "one", "one", "One two  three", "one two three", "a b c d e", "a b c d e f"]
    out += base + [base[0], base[0], base[1] + " end", base[2].upper()]
    out += [edited(base[3], i, k) for i, k in enumerate((1, 1, 2, 3, 4, 5))] + [edited(base[4], i, 2) for i in range(25)]
    out += [prose(50, 9000), edited(prose(50, 9000), 1, 40), "é ß ñ " * 60, "# $ % & " * 40, "spam " * 100, "\n".join(["same line here now"] * 5 + [prose(9, 40)])]
    out += ["shared boilerplate line number " + str(i) + " of many\n" + prose(100 + i, 60) for i in range(14)]
    return out


def rows(spark, values=None, ids=None):
    values = texts() if values is None else values
    ids = range(len(values)) if ids is None else ids
    data = [(i, t, ("en", "de", None)[k % 3], (f"src{k % 4}", None)[k % 7 == 0], len(t or ""), 1, "x", 5, True, 9) for k, (i, t) in enumerate(zip(ids, values))]
    return spark.createDataFrame(data, DOCS)


def shingles(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def components(pairs: list[tuple[int, str | None]]) -> dict[int, int]:
    parent = {i: i for i, _ in pairs}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in pairs]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in pairs}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql(spark, name):
    same(QUERIES[name](spark, "/root/testdata/sf0.001"), ORACLES[name], "/root/testdata/sf0.001")


def test_near_duplicates(spark):
    values = texts()
    found = near_dedup.near_duplicates(rows(spark)).collect()
    want = components(list(enumerate(values)))
    assert {r.doc_id: r.component_id for r in found} == want
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(shingles(t)) for i, t in enumerate(values)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_long_lists(spark, monkeypatch):
    """Groups beyond the limits for lists and blocks, and documents that only share a passage."""
    monkeypatch.setattr(near_dedup, "LONG", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base, passage = prose(1, 150), prose(2, 60)
    values = [base] + [edited(base, i, 2 + i % 7) for i in range(40)] + [passage + " " + prose(300 + i, 40 + 5 * (i % 20)) for i in range(30)]
    found = near_dedup.near_duplicates(rows(spark, values)).collect()
    assert {r.doc_id: r.component_id for r in found} == components(list(enumerate(values)))


def test_near_dedup_keeps_one_of_each(spark):
    values = texts() + [texts()[9], texts()[9]]
    ids = [*range(len(values) - 2), 9, 9]  # repeated rows
    out = near_dedup.near_dedup(rows(spark, values, ids))
    assert out.columns == rows(spark, []).columns
    want = components(list(enumerate(texts())))
    kept = collections.Counter(r.doc_id for r in out.collect())
    assert kept == collections.Counter({i for i, c in want.items() if i == c})


def test_near_dedup_null_ids(spark):
    base = prose(5, 100)
    out = near_dedup.near_dedup(rows(spark, [base, base, base + " x", prose(6, 80), None], [None, 4, 7, None, None])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:20]) for r in out) == sorted([(False, 4, base[:20]), (True, 0, prose(6, 80)[:20]), (True, 0, "")])


def test_token_counts(spark):
    lib = Tokenizer.from_file(VOCABULARY)
    values = texts() + ["don't I'll 'tis ''s 'S we've", "<|endoftext|> x", "日本語 ×÷ naïve ́e", "a" * 5000, "9 99 999"]
    want = {i: (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(values)}
    found = token_counts(rows(spark, values), VOCABULARY, 100).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in found} == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in found)


def thue_morse(n: int, a: str = "a", b: str = "b") -> tuple[str, str]:
    """Two different texts that every polynomial hash modulo a power of two takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


def test_hash_of_structured_texts(spark):
    x, y = thue_morse(4096)
    pair = pa.array([f"{x}\n{y}", f"{x} {y}", " ".join(f"w{k} {x}" for k in range(6)), " ".join(f"w{k} {y}" for k in range(6))])
    (_, data, offsets), = kernel.slices(pair)
    assert quality.counts(data, offsets)[3].tolist() == [0, 0, 0, 0]
    sets = kernel.shingle_sets(data, offsets)
    assert not len(np.intersect1d(sets[2], sets[3]))
    with open(VOCABULARY, encoding="utf-8") as f:
        machine, lib = transducer.Transducer(f.read()), Tokenizer.from_file(VOCABULARY)
    assert [list(v) for v in machine.ids(pair)] == [lib.encode(t, add_special_tokens=False).ids for t in pair.to_pylist()]


def test_state_maps_compose():
    """The prefix scan over chunks gives the states of a plain run of the automaton."""
    maps, r = transducer.StateMaps(), np.random.default_rng(1)
    for n in (1, 5, 64, 65, 200, 9000):
        kinds = r.choice([transducer.GAP, transducer.LETTER, transducer.DIGIT, transducer.OTHER, transducer.INNER], n).astype(np.uint8)
        kinds[0] += 7
        state, starts = 0, []
        for k in kinds:
            state, new = transducer.step(0 if k >= 7 else state, int(k) % 7)
            starts.append(new)
        assert maps.token_starts(kinds).tolist() == starts


def test_warc(spark, tmp_path, monkeypatch):
    data = [(3, "http://a/1", "<p>x</p>"), (1, "http://a/2", "<p>x</p>"), (2, None, None), (5, "http://a/3\r\nX: y", ""), (4, "u", "é" * 300), (None, "n", "<p>x</p>"), (7, "big", prose(1, 30000)), (8, "a", "only"), (8, "a", "only")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    records, index, folder = warc.archive(pages, folder=str(tmp_path / "warc"))
    found = records.collect()
    first = {"<p>x</p>": 1, "": 2}
    want = collections.Counter()
    for page, _, html in data:
        body, html = (html or "").encode(), html or ""
        revisit = html in first and page != first[html]
        want[(page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first[html] if revisit else None)] += 1
    assert collections.Counter(tuple(r)[:5] for r in found) == want
    # records by their ids: only their rows of the index are read
    some = {r.page_id: r for r in warc.read(index.where("page_id in (4, 7)"), folder).collect()}
    assert some[4].payload.decode() == "é" * 300 and some[7].payload.decode() == prose(1, 30000)
    # a frame holds many records, and plain zstd reads a bundle from its first byte on
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 4000)
    many = spark.createDataFrame([(i, f"http://p/{i}", prose(i, 40)) for i in range(3000)], "page_id long, url string, html string").coalesce(1)
    records, index, folder = warc.archive(many, folder=str(tmp_path / "many"))
    frames = index.groupBy("bundle", "frame").count().collect()
    assert len({r.bundle for r in frames}) > 1 and max(r["count"] for r in frames) > 100
    assert {r.page_id: r.payload.decode() for r in records.collect()} == {i: prose(i, 40) for i in range(3000)}
    name = frames[0].bundle
    with open(f"{folder}/{name}", "rb") as f:
        whole = warc.zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == sum(r["count"] for r in frames if r.bundle == name)
    assert warc.archive(pages, least_bytes=9)[0].where("record_type = 'revisit'").count() == 0
    assert warc.archive(pages.limit(0))[0].count() == 0


def test_warc_of_repeated_tasks(spark, tmp_path):
    """Bundles of attempts that the index doesn't name are gone once it is published; records have ids of their own, also those of equal or null pages."""
    folder = str(tmp_path / "warc")
    data = [(k // 2 if k % 5 else None, f"u{k}", f"page {k}", None, False) for k in range(40)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, first long, revisit boolean").repartition(3)
    lost = shared.settle(warc.write(pages, folder), "lost")
    index = shared.settle(warc.write(pages, folder), "index")
    assert warc.publish(index, folder) == 3
    names = {p.name for p in (tmp_path / "warc").iterdir()}
    assert names == {r.bundle for r in index.collect()} and not names & {r.bundle for r in lost.collect()}
    whole = b"".join(warc.zstandard.ZstdDecompressor().stream_reader(open(f"{folder}/{n}", "rb"), read_across_frames=True).read() for n in names)
    ids = re.findall(rb"WARC-Record-ID: (\S+)", whole)
    assert len(ids) == len(set(ids)) == 40
    assert warc.publish(index, folder) == 3 and warc.read(index, folder).count() == 40
    with pytest.raises(Exception, match="was not written"):
        warc.publish(lost, folder)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 400)
    r = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in r.normal(size=5)]) for i in range(300)] + [(i, [0.5] * 5) for i in range(300, 360)]
    vectors += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0]), (402, [float("nan")] * 5), (403, [float("inf")] * 5), (None, [1.0] * 5), (450, [1.0, 2.0]), (500, [3.0, -1.0]), (550, [])]
    found = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    good = {i: np.floor(256 * np.array(x)).astype(int) for i, x in vectors if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)}
    want = set()
    for q in (i for i in good if i % 50 == 0):
        scores = sorted((-int(good[q] @ good[i]), i) for i in good if i != q and len(good[i]) == len(good[q]))
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])}
    assert {tuple(x) for x in found} == want and len(found) == len(want)


def test_product_beyond_floats():
    a = np.array([[2**40 + 1, 3]], np.int64)
    b = np.array([[2**20 + 1, 5]], np.int64)
    assert topk.product(a, b)[0, 0] == (2**40 + 1) * (2**20 + 1) + 15


def base_counts(text: str | None) -> tuple[int, ...]:
    w = WORD.findall(text or "")
    windows = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    covered = {i for j in range(len(w) - 7) if windows[tuple(w[j : j + 8])] > 1 for i in range(j, j + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality(spark):
    found = {r.doc_id: r for r in quality.quality(rows(spark)).collect()}
    for i, t in enumerate(texts()):
        assert tuple(found[i])[1:6] == base_counts(t)
        n, *_, repeats = base_counts(t)
        assert found[i].base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (found[i].kept and found[i].base_failed)
    kept = quality.quality_filter(rows(spark))
    assert kept.columns == rows(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in found.items() if r.kept)


def test_quality_adapts(spark):
    """The same measure passes in a source where it is usual and fails where it isn't."""
    plain = [prose(i, 60) for i in range(150)]
    marked = [re.sub(" ", " | ", prose(i, 60)) for i in range(150)]
    data = [(i, t, "en", "a") for i, t in enumerate([*plain, marked[0]])] + [(1000 + i, t, "en", "b") for i, t in enumerate(marked)]
    found = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert not found[150] and all(v for i, v in found.items() if i != 150)


def test_line_dedup_beyond_broadcasts(spark, monkeypatch):
    """Joins by key give the rows that broadcasts give."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(str, line_dedup(docs).collect()))
    for module in (line_dedup_module, shared):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert sorted(map(str, line_dedup(docs).collect())) == want


def test_line_dedup(spark):
    found = {r.doc_id: r for r in line_dedup(rows(spark)).collect()}
    values = texts()
    first = next(i for i, t in enumerate(values) if t and t.startswith("shared boilerplate"))
    for i, t in enumerate(values):
        lost = t is not None and t.startswith("shared boilerplate") and i != first
        assert found[i].n_dropped == lost
        assert found[i].kept == (t.split("\n", 1)[1] if lost else t)
    out = line_filter(rows(spark), length_col="n_chars")
    assert out.columns == rows(spark, []).columns
    assert all(r.n_chars == len(r.text or "") for r in out.collect())


def water_levels(sizes: dict, weights: dict) -> dict:
    out, free, left = {}, set(sizes), sum(sizes.values())
    while free:
        each = left / sum(weights[s] for s in free)
        over = [s for s in free if each * weights[s] > 3 * sizes[s]]
        if not over:
            return out | {s: each * weights[s] for s in free}
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_mixing(spark):
    docs = rows(spark, texts() * 3, range(3 * len(texts())))
    found = mixing.taken(docs).collect()
    assert len(found) == docs.count()
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in found:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 3 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_levels(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) < 60 for s in order)
    assert sorted(map(str, mixing.taken(docs).collect())) == sorted(map(str, found))
    drawn = mixing.mix(docs)
    assert drawn.columns == docs.columns
    by_source = collections.Counter()
    for r in drawn.collect():
        by_source[r.source] += len(WORD.findall(r.text or ""))
    longest = max(len(WORD.findall(t or "")) for t in texts())
    assert all(abs(by_source[s] - target[s]) <= longest / 2 + 1 for s in order)


def test_splitting_tree_is_exact(spark):
    """The leaves' stretches are disjoint, cover each source's quota, and are level over the shards."""
    quota = {f"s{k}": 20 + 410 * k for k in range(4)}
    out = mixing.shards_of(spark.createDataFrame(list(quota.items()), "skey string, quota long"), 100, 7).collect()
    pos = collections.Counter((r.skey, r.start + k) for r in out for k in range(r.quota))
    assert set(pos) == {(s, k) for s, q in quota.items() for k in range(q)} and set(pos.values()) == {1}
    per = collections.Counter()
    for r in out:
        per[r.shard] += r.quota
    assert max(per.values()) - min(per.values()) <= 1


def test_mixing_comes_through_the_tree(spark, monkeypatch):
    """Without the leaves of a shard, what that shard would have drawn isn't taken."""
    monkeypatch.setattr(mixing, "BLOCK", 4)
    monkeypatch.setattr(mixing, "SHARD", 8)
    docs = rows(spark, texts() * 2, range(2 * len(texts())))
    full = {r.doc_id: (r.taken, r.shards) for r in mixing.taken(docs).collect()}
    leaves = mixing.shards_of
    monkeypatch.setattr(mixing, "shards_of", lambda *a: leaves(*a).where("shard <> 0"))
    some = {r.doc_id: r.taken for r in mixing.taken(docs).collect()}
    hit = [i for i, (t, s) in full.items() if 0 in s and t]
    assert hit and all(some[i] < full[i][0] for i in hit if full[i][0] >= 8)
    assert all(some[i] == t for i, (t, s) in full.items() if 0 not in s)


def test_mixing_in_ranges_and_beyond_broadcasts(spark, monkeypatch):
    """Short ranges, small blocks and joins by key give the same mixture."""
    monkeypatch.setattr(mixing, "BLOCK", 2)
    docs = rows(spark, texts() * 2, range(2 * len(texts())))
    want = sorted(mixing.taken(docs).drop("shards").collect(), key=str)
    monkeypatch.setattr(mixing, "RANGE", 3)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(mixing.taken(docs).drop("shards").collect(), key=str) == want
    names = "doc_id long, text string, source string, __size long, h long, c0 long, key string, draws string, skey string"
    data = [(i, prose(i, 20), "a", 5, 7, 9, "k", "d", "s") for i in range(40)]
    out = mixing.mix(spark.createDataFrame(data, names))
    assert {tuple(r) for r in out.collect()} == set(data)


def test_packing(spark):
    lib = Tokenizer.from_file(VOCABULARY)
    want = {}
    for i, t in enumerate(texts()):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 512)):
            want[(i, k)] = (at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes()))
    found = packing.pack(rows(spark), VOCABULARY, 512).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == want
    by = collections.defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    count = np.bincount([r.length for r in found], minlength=513)
    assert packing.lower_bound(count, 512) <= len(by) <= packing.lower_bound(count, 512) + 1


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion(seed):
    """Never more bins than best-fit decreasing, never fewer than the bound, and every piece placed once."""
    r = np.random.default_rng(seed)
    capacity = int(r.choice([10, 30, 100]))
    count = np.bincount(r.integers(1, capacity + 1, int(r.integers(0, 80))), minlength=capacity + 1)
    bins = packing.complete(count, capacity)
    got = np.zeros_like(count)
    for filled, n in bins:
        assert sum(length * k for length, k in filled) <= capacity
        for length, k in filled:
            got[length] += k * n
    assert (got == count).all()
    number = sum(n for _, n in bins)
    assert packing.lower_bound(count, capacity) <= number <= sum(n for _, n in packing.best_fit(count, capacity))


def substrings(values: list[str | None], length: int, keep_first: bool) -> list[tuple]:
    raws, places = [(t or "").encode() for t in values], collections.defaultdict(list)
    for k, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            places[raw[i : i + length]].append((k, i))
    gone = [np.zeros(len(r), bool) for r in raws]
    for same_ in places.values():
        if len(same_) > 1:
            for k, i in same_[1:] if keep_first else same_:
                gone[k][i : i + length] = True
    out = []
    for raw, g in zip(raws, gone):
        left = np.frombuffer(raw, np.uint8)[~g].tobytes()
        out.append((len(raw), int(g.sum()), int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
def test_substring_dedup(spark, keep_first):
    base = prose(1, 700)
    values = [None, "", "a" * 399, "a" * 400, "a" * 401, "a" * 900, "ab" * 450, base[:1200], base[:1200], base[100:900] + "zz" + base[100:900], "é" * 500]
    values += ["q" + base[x : x + n] + "xyz" for x, n in ((500, 399), (500, 400), (700, 460), (501, 430), (1500, 420), (1501, 420))]
    found = sorted(substring_dedup(rows(spark, values), 400, keep_first).collect(), key=lambda r: r.doc_id)
    assert [tuple(r)[1:5] for r in found] == substrings(values, 400, keep_first)


@pytest.mark.parametrize("seed", range(12))
def test_previous_factors(seed):
    """Longest previous factors and their places against all pairs of positions."""
    from millrace.llm.substring_dedup import previous_factors

    r = random.Random(seed)
    text = "".join(r.choice("ab") for _ in range(r.randint(1, 70)))
    common = lambda i, j: next((k for k in range(len(text) - max(i, j)) if text[i + k] != text[j + k]), len(text) - max(i, j))
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0] + [common(a, b) for a, b in zip(order, order[1:])]
    factor, source = previous_factors(np.array(order), np.array(lcp))
    for i in range(len(text)):
        assert factor[i] == max([common(i, j) for j in range(i)], default=0)
        assert source[i] == -1 if not factor[i] else source[i] < i and common(i, source[i]) == factor[i]


@pytest.mark.parametrize("keep_first", [True, False])
def test_substring_hot_cores(spark, monkeypatch, keep_first):
    """Small buckets, and cores that are counted instead, give the same rows."""
    from millrace.llm import substring_dedup as module

    monkeypatch.setattr(module, "HOT", 4)
    monkeypatch.setattr(module, "BUCKET", 3)
    values = texts() + [prose(200 + i, 9 + i) + " " + prose(61, 130) + " " + prose(300 + i, 7) for i in range(12)] + ["ab" * 700, "ab" * 450 + "c"]
    found = sorted(substring_dedup(rows(spark, values), 400, keep_first).collect(), key=lambda r: r.doc_id)
    assert [tuple(r)[1:5] for r in found] == substrings(values, 400, keep_first)


def test_substring_without_broadcast(spark, monkeypatch):
    from millrace.llm import substring_dedup as module

    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    base = prose(1, 400)
    values = [base, prose(2, 30) + base[200:900] + prose(3, 30), base[:300], base[:300], prose(4, 100) + base[1500:1800]]
    found = sorted(substring_dedup(rows(spark, values), 120, False).collect(), key=lambda r: r.doc_id)
    assert [tuple(r)[1:5] for r in found] == substrings(values, 120, False)


def test_segments_hold_each_window_once(monkeypatch):
    """A text longer than a segment has the anchors and windows of the whole."""
    from millrace.llm import substring_dedup as module

    column = pa.array([prose(1, 900), "x" * 500, None])
    batch = pa.RecordBatch.from_arrays([column, pa.array([1, 2, 3]), pa.array([1, 2, 3])], ["text", "t1", "t2"])

    def windows() -> set:
        out = [(r["t1"], i, r["g"], r["p"]) for b in module.anchors([batch], 120) for r in b.to_pylist() for i in range(r["i0"], r["i1"] + 1)]
        assert len(out) == len(set(out))
        return set(out)

    monkeypatch.setattr(module.kernel, "SLICE", 100)
    whole = windows()
    real = module.segments

    def short(column, length):
        for data, offsets, own, base in real(column, length):
            if len(data) < 700:
                yield data, offsets, own, base
                continue
            for at in range(0, len(data) - length + 1, 700 - length + 1):
                part = data[at : at + 700]
                yield part, np.array([0, len(part)]), own, np.array([at])

    monkeypatch.setattr(module, "segments", short)
    assert windows() == whole


def test_attach_with_hot_keys(spark):
    data = spark.range(20000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('k', id % 500) end as k")
    table = data.groupBy("k").agg(F.count("*").alias("w"), F.max("id").alias("most"))
    out = shared.attach(data, F.col("k"), table, "k", "w", 20000, F.col("id"))
    want = data.join(table.drop("w"), "k", "left").select("id", "k", "most")
    assert out.exceptAll(want).count() == 0 and want.exceptAll(out).count() == 0


def test_empty_tables(spark):
    docs = rows(spark, [])
    assert near_dedup.near_duplicates(docs).count() == 0
    assert near_dedup.near_dedup(docs).count() == 0
    assert token_counts(docs, VOCABULARY).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0
    assert quality.quality(docs).count() == 0 and quality.quality_filter(docs).count() == 0
    assert line_dedup(docs).count() == 0 and line_filter(docs).count() == 0
    assert mixing.taken(docs).count() == 0 and mixing.mix(docs).count() == 0
    assert packing.pack(docs, VOCABULARY).count() == 0
    assert substring_dedup(docs).count() == 0
