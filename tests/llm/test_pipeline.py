"""corpus_pipeline.run against its stages judged one by one: SQL for the first three, brute force for mixing and packing."""

from __future__ import annotations

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm.queries import ORACLES
from tests.compare import oracle_rows
from tests.llm.test_operators import WORD, edited, prose, water_levels

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The folder of documents, and the rows of documents and of each stage."""
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    made = [(10_000 + i, f"this boilerplate line number {i} recurs in many\n{prose(700 + i, 80)}", "en", "web") for i in range(15)]
    made += [(11_000 + i, edited(prose(900, 150), i, 2), "en", "books") for i in range(12)]
    made += [(12_000, None, "en", "web"), (12_001, "", None, None), (12_002, prose(55, 6000), None, None), (12_003, prose(56, 90), "de", None)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, a, b, len(t or "")) for i, t, a, b in made], docs.schema))
    folders = []
    for k, (_, stage) in enumerate([("documents", None), *corpus_pipeline.STAGES]):
        folder = str(root / str(k))
        (stage(spark, docs, folder) if stage else docs).write.parquet(f"{folder}/documents.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        folders.append(folder)
    return folders, [[tuple(r) for r in spark.read.parquet(f"{f}/documents.parquet").collect()] for f in folders]


def by_sql(name: str, folder: str) -> list[dict]:
    names, found = oracle_rows(ORACLES[name], folder)
    return [dict(zip(names, r)) for r in found]


def test_quality(stages):
    folders, rows = stages
    kept = {r["doc_id"] for r in by_sql("op6_quality_rules", folders[0]) if r["kept"]}
    assert 0 < len(kept) < len(rows[0])
    assert sorted(map(str, rows[1])) == sorted(str(r) for r in rows[0] if r[0] in kept)


def test_lines(stages):
    folders, rows = stages
    want = {r["doc_id"]: r for r in by_sql("op7_line_dedup", folders[1])}
    before = {r[0]: r for r in rows[1]}
    assert len(rows[2]) == len(rows[1]) and sum(r["n_dropped"] for r in want.values()) >= 14
    for doc, text, lang, source, n in rows[2]:
        assert hashlib.sha256((text or "").encode()).hexdigest() == want[doc]["kept_sha256"]
        assert (lang, source) == before[doc][2:4]
        assert n == (len(text) if want[doc]["n_dropped"] else before[doc][4])


def test_near_duplicates(stages):
    folders, rows = stages
    kept = {r["doc_id"] for r in by_sql("op1_near_dedup", folders[2]) if r["kept"]}
    assert len(kept) <= len(rows[2]) - 11
    assert sorted(map(str, rows[3])) == sorted(str(r) for r in rows[2] if r[0] in kept)


def test_mixture(stages):
    _, rows = stages
    words = {r[0]: len(WORD.findall(r[1] or "")) for r in rows[3]}
    sizes, got = collections.Counter(), collections.Counter()
    for r in rows[3]:
        sizes[r[3]] += words[r[0]]
    for r in rows[4]:
        got[r[3]] += words[r[0]]
    assert set(map(str, rows[4])) <= set(map(str, rows[3]))
    assert max(collections.Counter(r[0] for r in rows[4]).values()) <= 3
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water_levels(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    assert all(abs(got[s] - target[s]) <= max(words.values()) / 2 + 1 for s in order)


def test_packing_and_run(spark, stages):
    folders, rows = stages
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), collections.Counter()
    for doc, text, *_ in rows[4]:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[doc, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    for found in (rows[5], [tuple(r) for r in corpus_pipeline.run(spark, folders[0]).collect()]):
        assert collections.Counter(r[:5] for r in found) == want
        places = collections.defaultdict(list)
        for r in found:
            places[r[5]].append((r[6], r[3]))
        for held in places.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(places) <= -(-sum(r[3] for r in found) // 2048) + 1
