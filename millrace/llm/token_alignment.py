"""Alignment of the tokens that two tokenizers make of the same text.

The B tokens of a text are disjoint intervals of its bytes, so their sorted bounds are a static index: for each A token, two
bisections give the B tokens that its bytes overlap. A gap between two B tokens that no A token spans is a boundary of groups, as both
tokenizations have an end there. Links are pairs of tokens that end together: an A token and the last one in its list, if their ends agree.

Texts are tokenized by units (a word with the space before it), each met once by a worker, where the file's own rules make
tokens of neighbouring units independent; elsewhere by whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.shared import attach, discard, rows_of, settle, small_batches

#: Characters of text that are aligned together; longer texts are cut where both tokenizations have an end.
SLICE = 1 << 18
#: Units, and their characters, that a worker remembers before it starts anew.
UNITS, UNIT_CHARS = 300_000, 6_000_000
#: New units that are tokenized in one line.
LINE = 1_000
#: Pairs of ids whose counts are broadcast (17 bytes each); beyond that they are joined by key.
PAIRS = 2_000_000

#: Fixed value: the code points of Unicode's White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
BYTE_LEVEL_UNITS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Each unit begins with at least one space, as the text itself does after its prefix.
PIECE_UNITS = re.compile(r" +[^ ]+(?: +\Z)?| +\Z")
#: A place before which both kinds of units end: a lone space between words.
CUT = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")


def byte_symbols() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Units:
    """Token ids of texts, by units that are remembered. Subclasses say how texts are cut and encoded."""

    split: re.Pattern | None

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.lengths = np.array([len(e) for e in entries], np.int64)
        digits = np.array([str(i).encode() for i in range(len(entries))])
        self.digits = digits.view(np.uint8).reshape(len(entries), -1)
        self.n_digits = (self.digits > 0).sum(1)
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.chars, self.ids, self.ends, self.whole = 0, array("i"), array("q", [0]), array("b")

    def encode(self, units: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def learn(self, units: list[str]) -> None:
        """Remember the ids of new units. Words after one space are tokenized in lines of many, which are then cut at the units' ends."""
        words = [u for u in units if self.split and len(u) > 1 and u[0] == " " and u[1] not in WHITE and u[-1] not in WHITE]
        lines = [words[k : k + LINE] for k in range(0, len(words), LINE)]
        odd = [u for u in units if not (self.split and len(u) > 1 and u[0] == " " and u[1] not in WHITE and u[-1] not in WHITE)]
        for line, ids in zip(lines, self.encode(["".join(line) for line in lines])):
            source = [u.encode() for u in line]
            if b"".join([self.entries[i] for i in ids]) != b"".join(source):
                odd += line  # some unit's tokens are not its bytes
                continue
            at = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(x) for x in source])) + 1
            self.codes.update(zip(line, range(len(self.codes), len(self.codes) + len(line))))
            self.chars += sum(map(len, line))
            self.ends.extend((at + len(self.ids)).tolist())
            self.ids.extend(ids)
            self.whole.extend([1] * len(line))
        for unit, ids in zip(odd, self.encode(odd)):
            self.codes[unit] = len(self.codes)
            self.chars += len(unit)
            self.ids.extend(ids)
            self.ends.append(len(self.ids))
            self.whole.append(b"".join([self.entries[i] for i in ids]) == unit.encode())

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another, the number of tokens of each, and whether the tokens' bytes are the text's, with a space before it."""
        if len(self.codes) > UNITS or self.chars > UNIT_CHARS:
            self.forget()
        units = [self.split.findall(" " + t) if self.split else [" " + t] for t in texts]
        flat = list(chain.from_iterable(units))
        code = np.fromiter(map(self.codes.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(code < 0)
        if len(missing):
            met = [flat[k] for k in missing.tolist()]
            self.learn(list(dict.fromkeys(met)))
            code[missing] = np.fromiter(map(self.codes.__getitem__, met), np.int64, len(met))
        ends = np.array(self.ends, np.int64)
        sizes = ends[code + 1] - ends[code]
        at = np.repeat(ends[code] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        ids = np.array(self.ids, np.int32)[at]
        last = np.cumsum([len(u) for u in units])
        total = lambda x: np.diff(np.concatenate(([0], np.concatenate(([0], np.cumsum(x)))[last])))
        counts = total(sizes)
        whole = total(np.array(self.whole, np.int64)[code] == 0) == 0
        for k in np.flatnonzero(~whole):  # units that differ may still make up the text together
            own = ids[counts[:k].sum() : counts[: k + 1].sum()]
            whole[k] = b"".join([self.entries[i] for i in own]) == (" " + texts[k]).encode()
        return ids, counts, whole


class ByteLevel(Units):
    """A byte-level BPE file of the tokenizers library; a space is put before the text."""

    def __init__(self, source: bytes):
        self.library = Tokenizer.from_str(source.decode())
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.library.no_truncation()
        self.library.no_padding()
        spec, symbols = json.loads(source), byte_symbols()
        cutter = spec.get("pre_tokenizer") or {}
        if cutter.get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("the first tokenizer has to be a byte-level BPE without a normalizer")
        self.split = BYTE_LEVEL_UNITS if cutter.get("use_regex", True) and not cutter.get("add_prefix_space") else None
        entries = [b""] * self.library.get_vocab_size(with_added_tokens=True)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            entries[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
        super().__init__(entries)

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(units, add_special_tokens=False)]


class Pieces(Units):
    """A sentencepiece model, which puts a space before the text itself."""

    def __init__(self, source: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=source)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        # where no piece has a space after another character, no token crosses the end of a unit
        self.split = None if any("▁" in x.lstrip("▁") for x in names) else PIECE_UNITS
        super().__init__([bytes([int(x[3:5], 16)]) if self.library.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)])

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.library.encode([u[1:] for u in units], num_threads=1) if units else []


_made: dict[bytes, Units] = {}


def made(kind: type[Units], source: bytes) -> Units:
    """The tokenizer of a file's bytes; a worker keeps it, with the units it has met, from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = kind.__name__.encode() + hashlib.sha256(source).digest()
    if key not in _made:
        _made[key] = kind(source)
    return _made[key]


@dataclass
class Aligned:
    """Texts aligned together: tokens and groups of all of them one after another."""

    a: np.ndarray
    b: np.ndarray
    whole: np.ndarray  # by text: its tokens are its bytes
    a_ends: np.ndarray  # by text: tokens up to its end
    b_ends: np.ndarray
    group_ends: np.ndarray
    last_a: np.ndarray  # by group: its last tokens
    last_b: np.ndarray
    linked_a: np.ndarray  # by link: the tokens that end together
    linked_b: np.ndarray


def align(texts: list[str], a: Units, b: Units) -> Aligned:
    """Overlap lists by bisection, group boundaries from gaps that no A token spans, links from ends that agree."""
    ids_a, n_a, whole_a = a.tokens(texts)
    ids_b, n_b, whole_b = b.tokens(texts)
    whole = whole_a & whole_b
    ids_a, n_a = ids_a[np.repeat(whole, n_a)], n_a * whole
    ids_b, n_b = ids_b[np.repeat(whole, n_b)], n_b * whole
    ends_a, ends_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    first = np.searchsorted(ends_b, ends_a - a.lengths[ids_a], side="right")  # the B tokens that A token i overlaps are
    last = np.searchsorted(ends_b - b.lengths[ids_b], ends_a, side="left") - 1  # first[i] to last[i]
    spans = np.bincount(first, minlength=len(ids_b) + 1) - np.bincount(last, minlength=len(ids_b) + 1)
    last_b = np.flatnonzero(np.cumsum(spans)[: len(ids_b)] == 0)
    last_a = np.searchsorted(ends_a, ends_b[last_b])
    together = np.flatnonzero(ends_b[last] == ends_a) if len(ids_a) else np.zeros(0, np.int64)
    b_ends = np.cumsum(n_b)
    return Aligned(ids_a, ids_b, whole, np.cumsum(n_a), b_ends, np.searchsorted(last_b, b_ends - 1, side="right"), last_a, last_b, together, last[together] if len(ids_a) else together)


def written(x: Aligned, a: Units, b: Units) -> tuple[np.ndarray, np.ndarray]:
    """a1,a2|b1;a3|b2,b3 of all texts one after another as bytes, and where each text ends."""
    n_a, n_b, width = len(x.a), len(x.b), max(a.digits.shape[1], b.digits.shape[1]) + 1
    sizes_a, sizes_b = np.diff(x.last_a, prepend=-1), np.diff(x.last_b, prepend=-1)
    place_a = np.arange(n_a) + np.repeat(x.last_b + 1 - sizes_b, sizes_a)  # after the B tokens of earlier groups
    place_b = np.arange(n_b) + np.repeat(x.last_a + 1, sizes_b)  # after the A tokens up to this group
    rows, size = np.zeros((n_a + n_b, width), np.uint8), np.empty(n_a + n_b, np.int64)
    rows[place_a, : a.digits.shape[1]], size[place_a] = a.digits[x.a], a.n_digits[x.a]
    rows[place_b, : b.digits.shape[1]], size[place_b] = b.digits[x.b], b.n_digits[x.b]
    after = np.full(n_a + n_b, ord(","), np.uint8)
    after[place_a[x.last_a]], after[place_b[x.last_b]] = ord("|"), ord(";")
    rows[np.arange(len(rows)), size] = after
    ends = x.a_ends + x.b_ends
    size += 1
    size[ends[ends > np.concatenate(([0], ends[:-1]))] - 1] -= 1  # nothing after a text's last token
    return rows[np.arange(width) < size[:, None]], np.concatenate(([0], np.cumsum(size)))[ends]


def segments(text: str) -> list[str]:
    """A text, or its parts of about SLICE characters: the space before each further part is the one that tokenizers see before a text."""
    out, at = [], 0
    while len(text) - at > SLICE:
        found = CUT.search(text, at + SLICE)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.end()
    return [*out, text[at:]]


def slices(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Non-empty texts, cut to segments, in slices: the number of its text for each segment, and the segments."""
    owner: list[int] = []
    held: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        for part in segments(text) if text else ():
            if held and size + len(part) > SLICE:
                yield owner, held
                owner, held, size = [], [], 0
            owner.append(k)
            held.append(part)
            size += len(part)
    if held:
        yield owner, held


def sources(a_path: str, b_path: str) -> tuple[bytes, bytes]:
    return Path(a_path).read_bytes(), Path(b_path).read_bytes()


def token_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per group of each text: doc_id, row (the text's own number, as ids may repeat), a_ids and b_ids, in the text's order by group (from 0).

    a_path is a byte-level BPE file of the tokenizers library, b_path a sentencepiece model. Texts without tokens (see alignment) have no rows.
    """
    small_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(sources(a_path, b_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = made(ByteLevel, given.value[0]), made(Pieces, given.value[1])
        for batch in batches:
            texts, groups = batch.column("text").to_pylist(), [[] for _ in range(batch.num_rows)]
            failed = set()
            for owner, held in slices(texts):
                x = align(held, a, b)
                failed.update(k for k, fine in zip(owner, x.whole) if not fine)
                ends = list(zip((x.last_a + 1).tolist(), (x.last_b + 1).tolist()))
                for k, begin, end in zip(owner, [0, *x.group_ends[:-1].tolist()], x.group_ends.tolist()):
                    for g in range(begin, end):
                        (i, j), (from_i, from_j) = ends[g], ends[g - 1] if g else (0, 0)
                        groups[k].append((x.a[from_i:i].tolist(), x.b[from_j:j].tolist()))
            found = [(k, g, *ids) for k, own in enumerate(groups) if k not in failed for g, ids in enumerate(own)]
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("row").take(at), pa.array([f[1] for f in found], pa.int64()), *[pa.array([f[c] for f in found], pa.list_(pa.int32())) for c in (2, 3)]], ["doc_id", "row", "group", "a_ids", "b_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, row long, group long, a_ids array<int>, b_ids array<int>")


def digests(batches: Iterator[pa.RecordBatch], given: tuple[bytes, bytes]) -> Iterator[pa.RecordBatch]:
    """For each text n_a, n_b, n_groups, the hash of its groups, and its links as pairs of ids: a's times B's size, plus b's."""
    a, b = made(ByteLevel, given[0]), made(Pieces, given[1])
    for batch in batches:
        n = batch.num_rows
        counts, hashes, links, failed = np.zeros((n, 3), np.int64), [None] * n, [[] for _ in range(n)], set()
        for owner, held in slices(batch.column("text").to_pylist()):
            x = align(held, a, b)
            text, text_ends = written(x, a, b)
            pairs = x.a[x.linked_a].astype(np.int64) * len(b.entries) + x.b[x.linked_b]
            bounds = np.stack([x.a_ends, x.b_ends, x.group_ends, np.searchsorted(x.linked_a, x.a_ends), text_ends], 1)
            bounds = np.concatenate((np.zeros((1, 5), np.int64), bounds))
            data = memoryview(text.tobytes())
            for s, k in enumerate(owner):
                if not x.whole[s]:
                    failed.add(k)
                    continue
                counts[k] += bounds[s + 1, :3] - bounds[s, :3]
                links[k].append(pairs[bounds[s, 3] : bounds[s + 1, 3]])
                if hashes[k] is None:
                    hashes[k] = hashlib.sha256()
                else:
                    hashes[k].update(b";")
                hashes[k].update(data[bounds[s, 4] : bounds[s + 1, 4]])
        for k in failed:  # one segment that isn't its bytes takes the tokens of the whole text
            counts[k], hashes[k], links[k] = 0, None, []
        flat = [p for own in links for p in own]
        offsets = np.concatenate(([0], np.cumsum([sum(map(len, own)) for own in links])))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
        sha = pa.array([h.hexdigest() if h else "" for h in hashes], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *[pa.array(c) for c in counts.T], sha, lists], ["doc_id", "row", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"])


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pairs with their number, added up before they are shuffled."""
    pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def added(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(np.concatenate((pairs, x)), return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, at, np.concatenate((counts, n)))
        return own, total

    out = lambda: pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])
    for batch in batches:
        pairs, counts = added(*np.unique(batch.column("pairs").flatten().to_numpy(), return_counts=True))
        if len(pairs) > 500_000:
            yield out()
            pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield out()


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """pair, n (its links in the corpus) and best (n is the highest of its B id) from a settled table with pairs.

    A B id has at most as many pairs as A has ids, so the window over one stays small, whatever the corpus.
    """
    counts = links.select("pairs").mapInArrow(tallied, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(F.col("pair") % size_b)
    return settle(counts.withColumn("best", F.col("n") == F.max("n").over(own)), "pairs")


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens are those of a space and the text by a_path (byte-level BPE of the tokenizers library) and of the text by b_path (a
    sentencepiece model that adds the space). A link's count is the number of links in the corpus between its two ids; n_best
    are the links whose count is the highest of their B id, ties included. groups_sha256 is the hash of the ids by groups, a1,a2|b1;a3|b2,b3.
    Null and empty texts, and those whose tokens aren't the bytes of a space and the text, have no tokens: zeros and an empty hash.
    Ids may be null or repeated, copies count as often as they are there, other columns are not read, and an empty table gives no rows.
    Texts are worked on in parts of SLICE characters, so that memory doesn't follow the longest, where words stand between single spaces.
    """
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast(sources(a_path, b_path))
    size_b = len(made(Pieces, given.value[1]).entries)
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    links = settle(rows.mapInArrow(lambda batches: digests(batches, given.value), "doc_id long, row long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>"), "links")
    counts = pair_counts(links, size_b)
    found = looked_up(links, counts) if rows_of(counts) <= PAIRS else joined(links, counts)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = settle(found.select(*columns), "aligned")
    discard(links, counts)
    return found


def looked_up(links: DataFrame, counts: DataFrame) -> DataFrame:
    """links with n_links, n_best and count_sum, from counts that are broadcast."""
    table = counts.orderBy("pair").toArrow()
    given = links.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = given.value
        for batch in batches:
            lists = batch.column("pairs")
            at = np.searchsorted(pair, lists.flatten().to_numpy())
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            sums = [pa.array(np.diff(np.concatenate(([0], np.cumsum(x[at])))[ends])) for x in (best.astype(np.int64), n)]
            others = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*others, pa.array(np.diff(ends)), *sums], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"])

    return links.mapInArrow(work, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long")


def joined(links: DataFrame, counts: DataFrame) -> DataFrame:
    """As looked_up, with the counts joined by pair, frequent pairs apart; a text's different pairs are one row each."""
    each = links.select("row", F.explode("pairs").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("times"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = attach(each, F.col("pair"), counts.select("pair", F.col("n").alias("count"), "best", "n"), "pair", "n", total, F.struct("row", "pair"), "inner")
    sums = found.groupBy("row").agg(F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    out = links.withColumn("n_links", F.size("pairs").cast("long")).drop("pairs").join(sums, "row", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("count_sum", "n_best")})
