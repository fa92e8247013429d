"""Token counts and ids by a compiled finite-state transducer.

The tokenizer file is compiled into two deterministic layers. The first is a
small automaton over byte classes that finds where pre-tokens start; its state
maps (one for each class, as functions from state to state) are closed under
composition into a finite table, so a text is cut into chunks, each
chunk is reduced to one composed map, a prefix scan over the chunks' maps gives
every chunk's entry state, and the transitions that start a pre-token are
read off in parallel. The second layer holds pre-tokens; each
one's last transition is annotated with the tokens that it emits. All words of the vocabulary
are annotated when the file is compiled, once, on the driver; a word that only its merges make is added,
with what the tokenizer library gives for it, when a worker first meets it.

Texts with bytes outside the compiled alphabet (anything but ASCII and the
letters of U+00C0 to U+00FF), with special strings, or tokenizers with another
pre-tokenizer, go to the library itself, so counts and ids always equal its own.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from millrace.llm import kernel

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The pre-tokenizer and normaliser for which the first layer is compiled.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

FRESH, LETTERS, OTHERS, TAIL, TAIL2 = range(5)
GAP, LETTER, DIGIT, OTHER, MARK1, MARK2, INNER, UNSAFE = range(8)
CHUNK = 64
#: Bytes taken at once.
SLICE = 1 << 20
#: Words kept in the second layer of a worker; it is begun anew from the compiled ones when full.
MOST_WORDS = 500_000
SLOT_BITS = 20


def byte_classes() -> np.ndarray:
    c = np.full(256, UNSAFE, np.uint8)
    c[0x21:0x7F] = OTHER
    c[[0x20, 9, 10, 13]] = GAP
    c[ord("0") : ord("9") + 1] = DIGIT
    c[ord("a") : ord("z") + 1] = LETTER
    c[ord("A") : ord("Z") + 1] = LETTER
    c[0xC3] = LETTER
    c[0x80:0xC0] = INNER
    return c


def step(state: int, kind: int) -> tuple[int, bool]:
    """The automaton: next state, and whether a pre-token starts here."""
    if kind == INNER:
        return state, False
    if state == TAIL2:
        return TAIL, False
    if state == TAIL:
        return FRESH, False
    if kind == GAP:
        return FRESH, False
    if kind == DIGIT:
        return FRESH, True
    if kind == LETTER:
        return LETTERS, state != LETTERS
    if state == OTHERS:
        return OTHERS, False
    return {OTHER: OTHERS, MARK1: TAIL, MARK2: TAIL2}[kind], True


class StateMaps:
    """The maps of the classes and all their compositions, numbered; class k is map k, and k + 7 the same from a text's start."""

    def __init__(self) -> None:
        maps = [tuple(step(s, k)[0] for s in range(5)) for k in range(7)]
        maps += [(m[FRESH],) * 5 for m in maps]
        # two generators may be one map; numbers of generators stay as they are
        number = {}
        for k, m in enumerate(maps):
            number.setdefault(m, k)
        generators, at = list(maps), 0
        while at < len(maps):
            for g in generators:
                m = tuple(g[s] for s in maps[at])
                if m not in number:
                    number[m] = len(maps)
                    maps.append(m)
            at += 1
        self.n = len(maps)
        self.apply = np.array(maps, np.uint8)
        self.then = np.array([[number[tuple(b[s] for s in a)] for b in maps] for a in maps], np.uint8)
        self.starts = np.array([[step(FRESH if k >= 7 else s, k % 7)[1] for k in range(14)] for s in range(5)], bool)

    def prefix(self, kinds: np.ndarray) -> np.ndarray:
        """The map of everything up to and with each position."""
        n = len(kinds)
        if n <= CHUNK:
            out = kinds.copy()
            for i in range(1, n):
                out[i] = self.then[out[i - 1], kinds[i]]
            return out
        rows = -(-n // CHUNK)
        padded = np.full(rows * CHUNK, INNER, np.uint8)
        padded[:n] = kinds
        grid = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
        flat = self.then.ravel()
        for j in range(1, CHUNK):
            grid[j] = flat[grid[j - 1].astype(np.intp) * self.n + grid[j]]
        before = np.concatenate(([INNER], self.prefix(grid[-1])[:-1])).astype(np.uint8)
        grid = flat[before.astype(np.intp)[None, :] * self.n + grid]
        return grid.T.ravel()[:n]

    def token_starts(self, kinds: np.ndarray) -> np.ndarray:
        state = np.zeros(len(kinds), np.uint8)
        state[1:] = self.apply[:, FRESH][self.prefix(kinds)[:-1]]
        return self.starts.ravel()[state.astype(np.intp) * 14 + kinds]


class Growing:
    """An array with room to grow, so that appending costs what is appended."""

    def __init__(self, start: np.ndarray) -> None:
        self.room, self.n = start.copy(), len(start)

    def append(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            larger = np.zeros(max(2 * len(self.room), self.n + len(more), 1024), self.room.dtype)
            larger[: self.n] = self.room[: self.n]
            self.room = larger
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


class Sorted:
    """Entries by key: a large sorted part, and a small one that is merged into it when it has grown to a half of it."""

    def __init__(self, keys: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.parts = [(keys[order], order), (keys[:0], order[:0])]

    def add(self, keys: np.ndarray, entry: np.ndarray) -> None:
        (main, at), (new, also) = self.parts
        new, also = np.concatenate((new, keys)), np.concatenate((also, entry))
        if 2 * len(new) > len(main):
            main, at, new, also = np.concatenate((main, new)), np.concatenate((at, also)), new[:0], also[:0]
            order = np.argsort(main, kind="stable")
            main, at = main[order], at[order]
        order = np.argsort(new, kind="stable")
        self.parts = [(main, at), (new[order], also[order])]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        for have, entry in self.parts:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                same = have[at] == keys
                out[same] = entry[at[same]]
        return out


Layer = tuple[np.ndarray, np.ndarray, np.ndarray]


class Transducer:
    """Compiled from the text of a tokenizers .json file; layer has keys, numbers and ids of words annotated before."""

    def __init__(self, source: str, layer: Layer | None = None) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(source)
        splits = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        pattern = splits[0]["pattern"].get("Regex") if splits else None
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.compiled = pattern == PATTERN and kinds == NORMALIZERS and all(t.startswith("<|") for t in special)
        self.maps, self.classes = StateMaps(), byte_classes()
        self.given: Layer = layer or (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32))
        self.clear()
        if layer is None and self.compiled:
            end = (spec.get("model") or {}).get("end_of_word_suffix") or ""
            # words of letters stand for themselves in the vocabulary
            words = sorted({t.removesuffix(end) for t in spec["model"]["vocab"] if t.endswith(end)})
            words = [w.encode() for w in words if w.isascii() and w.isalpha() and w == w.lower()]
            if words:
                size = np.array([len(w) for w in words], np.int64)
                data, last = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size)
                self.learn(words, kernel.spans_hash(data, last - size, last))
            self.given = (self.keys.all[1:].copy(), self.size.all[1:].copy(), self.flat.all.copy())

    def clear(self) -> None:
        """Only the compiled words; entry 0 stands for no word."""
        keys, size, flat = self.given
        self.keys = Growing(np.append(np.zeros(1, np.uint64), keys))
        self.size = Growing(np.append(np.zeros(1, np.int64), size))
        self.begin = Growing(np.append(np.zeros(1, np.int64), np.cumsum(size) - size))
        self.flat = Growing(flat)
        self.places = Sorted(self.keys.all)
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        fast = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [np.array(e.ids, np.uint32) for e in fast(texts, add_special_tokens=False)]

    def learn(self, words: list[bytes], keys: np.ndarray) -> np.ndarray:
        """Annotate new words with what the library emits for them; their entries."""
        ids = self.encode([w.decode() for w in words])
        size, entry = np.array([len(x) for x in ids], np.int64), self.keys.n + np.arange(len(words))
        self.begin.append(self.flat.n + np.cumsum(size) - size)
        self.size.append(size)
        self.flat.append(np.concatenate(ids))
        self.keys.append(keys)
        self.places.add(keys, entry)
        return entry

    def entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The second layer's entry for each pre-token."""
        key = kernel.spans_hash(data, start, end)
        slot = (key >> np.uint64(64 - SLOT_BITS)).astype(np.intp)
        entry = self.slots[slot].astype(np.int64)
        missed = np.flatnonzero(self.keys.all[entry] != key)
        if len(missed):
            new, first, inverse = np.unique(key[missed], return_index=True, return_inverse=True)
            at = self.places.find(new)
            unknown = np.flatnonzero(at < 0)
            if len(unknown):
                where = missed[first[unknown]]
                at[unknown] = self.learn([data[a:b].tobytes() for a, b in zip(start[where], end[where])], new[unknown])
            self.slots[slot[missed[first]]] = at
            entry[missed] = at[inverse]
        return entry

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of all pre-tokens, each row's first one, and which rows are for the library."""
        rows = len(offsets) - 1
        if not self.compiled:
            return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64), np.ones(rows, bool)
        kind = self.classes[data]
        bad = kind == UNSAFE
        after = np.zeros(len(data), np.uint8)
        after[:-1] = data[1:]
        bad |= (data == 0xC3) & ((after == 0x97) | (after == 0xB7))
        bad |= (data == ord("<")) & (after == ord("|"))
        low = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
        capital = np.flatnonzero((data == 0xC3) & (after >= 0x80) & (after <= 0x9E)) + 1
        low[capital] += 32
        total = np.concatenate(([0], np.cumsum(bad)))
        by_library = total[offsets[1:]] > total[offsets[:-1]]
        kind[bad] = OTHER
        for at in np.flatnonzero(data == ord("'")):
            tail = low[at + 1 : at + 3].tobytes().decode("latin-1")
            if tail[:1] and tail[0] in ONE_LETTER:
                kind[at] = MARK1
            elif tail in TWO_LETTERS:
                kind[at] = MARK2
        last = offsets[1:][(offsets[1:] > offsets[:-1])] - 1  # a mark may not reach into the next row
        for back in (0, 1):
            at = last - back
            at = at[at >= 0]
            reach = at[(kind[at] == MARK2) | ((kind[at] == MARK1) & (back == 0))]
            kind[reach] = OTHER
        heads = offsets[:-1][offsets[1:] > offsets[:-1]]
        kind[heads] += 7
        starts = self.maps.token_starts(kind)
        breaks = np.flatnonzero(starts | (kind % 7 == GAP))
        is_start = starts[breaks]
        start, end = breaks[is_start], np.append(breaks[1:], len(data))[is_start]
        first = np.searchsorted(start, offsets)
        if by_library.any():
            keep = np.repeat(~by_library, np.diff(first))
            start, end = start[keep], end[keep]
            first = np.concatenate(([0], np.cumsum(np.where(by_library, 0, np.diff(first)))))
        if self.keys.n > MOST_WORDS + len(self.given[0]):
            self.clear()
        return self.entries(low, start, end), first, by_library

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each row."""
        out = np.zeros(len(column), np.int64)
        for row, data, offsets in kernel.slices(column, SLICE):
            entry, first, by_library = self.slice(data, offsets)
            total = np.concatenate(([0], np.cumsum(self.size.all[entry])))
            n = total[first[1:]] - total[first[:-1]]
            where = np.flatnonzero(by_library)
            if len(where):
                n[where] = [len(x) for x in self.encode([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in where])]
            out[row : row + len(n)] = n
        return out

    def ids(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each row, in order."""
        for _, data, offsets in kernel.slices(column, SLICE):
            entry, first, by_library = self.slice(data, offsets)
            size = self.size.all[entry]
            total = np.concatenate(([0], np.cumsum(size)))
            flat = self.flat.all[np.repeat(self.begin.all[entry] - total[:-1], size) + np.arange(total[-1])]
            for i in range(len(offsets) - 1):
                if by_library[i]:
                    yield self.encode([data[offsets[i] : offsets[i + 1]].tobytes().decode()])[0]
                else:
                    yield flat[total[first[i]] : total[first[i + 1]]]


_compiled: dict[int, Transducer] = {}


def compiled(source: str, layer: Layer) -> Transducer:
    """One transducer for each tokenizer in a worker; the words that it adds outlive the task."""
    key = hash(source)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(source, layer)
    return _compiled[key]


def read(path: str) -> tuple[str, Layer]:
    """A tokenizer file and its compiled words, for a broadcast (a few MB, whatever the data)."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    return source, Transducer(source).given
