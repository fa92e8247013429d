"""Token alignment against both libraries on whole texts and against overlaps counted token by token."""

from __future__ import annotations

import collections
import hashlib
import random
from pathlib import Path

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import token_alignment as ta
from millrace.llm.queries import BYTE_LEVEL, PIECES, QUERIES

SF = "/root/testdata/sf0.001"
ODD = ["\t", "\n", " ", "  ", "\x00", "\x1c", "\x85", " ", "​", " ", "▁", "é", "ß", "中", "ไม่", "😀", "é", "'s", "don't", "<s>", "<|endoftext|>", "12", "a", "the", " and", "ABC", "…"]


def made_texts() -> list[str | None]:
    r = random.Random(3)
    out: list[str | None] = [None, "", " ", "  \n ", "a", "the cat", "the cat", "the cat", " lead", "trail ", "▁x", "x ▁ y", "<s> </s> <|endoftext|>"]
    out += ["".join(r.choice(ODD) for _ in range(r.randint(1, 40))) for _ in range(120)]
    out += ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(0xA0, 0x600), r.randrange(0x4E00, 0x4F00)))) for _ in range(60)) for _ in range(20)]
    return [*out, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(3000)), "x" * 5000]


def brute(texts: list[str | None]) -> list[tuple]:
    """What the contract asks, from whole texts: every pair of tokens whose byte ranges end together, cut where both end."""
    a, b = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    symbols = ta.byte_symbols()
    entry = {i: bytes(symbols[c] for c in t) if all(c in symbols for c in t) else t.encode() for t, i in a.get_vocab().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, counts = [], collections.Counter()
    for text in texts:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if b"".join(entry[i] for i in x) != whole or b"".join(map(piece, y)) != whole:
            x, y = [], []
        ends = lambda ids, f: [sum(len(f(i)) for i in ids[: k + 1]) for k in range(len(ids))] if len(ids) < 300 else list(_sums(ids, f))
        at_a, at_b = dict(zip(ends(x, entry.get), range(len(x)))), dict(zip(ends(y, piece), range(len(y))))
        shared = sorted(at_a.keys() & at_b.keys())
        links = [(x[at_a[e]], y[at_b[e]]) for e in shared]
        counts.update(links)
        groups, i, j = [], 0, 0
        for e in shared:
            groups.append((x[i : at_a[e] + 1], y[j : at_b[e] + 1]))
            i, j = at_a[e] + 1, at_b[e] + 1
        rows.append((len(x), len(y), groups, links))
    most = collections.defaultdict(int)
    for (_, v), n in counts.items():
        most[v] = max(most[v], n)
    digest = lambda groups: hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest() if groups else ""
    return [(n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest(groups)) for n_a, n_b, groups, links in rows]


def _sums(ids, f):
    total = 0
    for i in ids:
        total += len(f(i))
        yield total


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("pairs", [ta.PAIRS, 0])
def test_alignment(spark, monkeypatch, pairs):
    """Nulls, empty and odd texts, copies, null and repeated ids, clashing columns; with counts broadcast and joined."""
    monkeypatch.setattr(ta, "PAIRS", pairs)
    texts = made_texts()
    ids = [None, 7, 7, *range(10, 7 + len(texts))]
    docs = spark.createDataFrame([(i, t, 1, "x", 2, k) for k, (i, t) in enumerate(zip(ids, texts))], "doc_id long, text string, row long, pair string, n long, n_a int")
    got = [tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in ta.alignment(docs, BYTE_LEVEL, PIECES).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted([(i, *r) for i, r in zip(ids, brute(texts))], key=key)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_token_alignment"](spark, SF).collect()}
    assert got == dict(zip([d["doc_id"] for d in docs], brute([d["text"] for d in docs])))


def test_units_give_the_libraries_ids():
    """Texts by units have the ids of whole texts, for every code point of the first planes beside letters and spaces."""
    a, b = ta.made(ta.ByteLevel, Path(BYTE_LEVEL).read_bytes()), ta.made(ta.Pieces, Path(PIECES).read_bytes())
    assert a.split and b.split
    r = random.Random(5)
    texts = [x for c in range(1, 0x3100) for x in (f"a{chr(c)}b", f" {chr(c)} x", f"1{chr(c)}{chr(c)} ")]
    texts += ["".join(r.choice(ODD) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    cut = lambda ids, n: [x.tolist() for x in _split(ids, n)]
    ids, n, whole = a.tokens(texts)
    assert whole.all() and cut(ids, n) == [e.ids for e in a.library.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    ids, n, whole = b.tokens(texts)
    # texts with the library's own sign for a space have no tokens here, as that sign reads as a space
    assert [x for x, fine in zip(cut(ids, n), whole) if fine] == [x for x, fine in zip(b.library.encode(texts), whole) if fine]
    assert [t for t, fine in zip(texts, whole) if not fine] == [t for t in texts if "▁" in t]


def _split(ids, n):
    out, at = [], 0
    for k in n.tolist():
        out.append(ids[at : at + k])
        at += k
    return out


def test_units_are_forgotten(monkeypatch):
    """With next to no memory of units the ids are the same."""
    b = ta.Pieces(Path(PIECES).read_bytes())
    monkeypatch.setattr(ta, "UNITS", 3)
    for _ in range(3):
        ids, n, _ = b.tokens(["one two three four", "five six", "one"])
        assert [x.tolist() for x in _split(ids, n)] == b.library.encode(["one two three four", "five six", "one"])


def test_segments_of_long_texts(monkeypatch):
    """Long texts are cut where both tokenizations end, with the same result; one bad part takes the tokens of the whole text."""
    texts = [t for t in made_texts() if t] + ["one two " * 400 + "▁ " + "three four " * 400, "a \n b\n\nc  d " * 500, "y" * 3000]
    source = (Path(BYTE_LEVEL).read_bytes(), Path(PIECES).read_bytes())
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(texts)], ["doc_id", "row", "text"])
    (whole,) = ta.digests(iter([batch]), source)
    monkeypatch.setattr(ta, "SLICE", 64)
    assert max(len(ta.segments(t)) for t in texts) > 50
    (parts,) = ta.digests(iter([batch]), source)
    assert parts.to_pydict() == whole.to_pydict()
    assert whole.column("n_a")[n - 3].as_py() == 0 and whole.column("n_a")[n - 2].as_py() > 0


def test_token_groups(spark):
    """Groups in order, whose joined ids are the tokens of the text; none for texts without tokens."""
    docs = spark.createDataFrame([(1, "the unbelievable cat"), (1, "▁"), (None, "naïve 12345"), (4, None)], "doc_id long, text string")
    rows = ta.token_groups(docs, BYTE_LEVEL, PIECES).orderBy("row", "group").collect()
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for doc, text in ((1, "the unbelievable cat"), (None, "naïve 12345")):
        own = [r for r in rows if r["doc_id"] == doc]
        assert [r["group"] for r in own] == list(range(len(own)))
        assert [i for r in own for i in r["b_ids"]] == b.encode(text)
    assert {r["doc_id"] for r in rows} == {1, None}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ta.alignment(docs, BYTE_LEVEL, PIECES).count() == 0
    assert ta.token_groups(docs, BYTE_LEVEL, PIECES).count() == 0
