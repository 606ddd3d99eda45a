"""Exact BPE of a tokenizer file: splitting into pieces, merging a piece, and a compiled lexicon.

`Lexicon` is a minimal acyclic automaton with shared suffixes whose words are numbered by the count of words
before them; the numbers lead to id outputs. It is built from sorted words, kept in flat arrays, and
memory-mapped by the workers. It holds the pieces that it is given, such as the most frequent ones of a corpus or the
vocabulary's whole words, each with all its ids; any other piece is merged exactly.

Covered: files of the `tokenizers` library with normalizers NFC, whitespace replacement and Lowercase, one
Split pre-tokenizer with a pattern, byte-level pieces, and BPE with or without an end-of-word suffix.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterable

import numpy as np
import regex

MEMO = 300_000
_NONE = 1 << 30
_SPREAD, _MASK = 0x1E3779B97F4A7C15, (1 << 62) - 1
#: Characters whose class is the same for every Unicode version: ASCII and Latin letters with marks.
_PLAIN = re.compile("[^\x00-\x1b\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-ɏ]")


@functools.cache
def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordBpe:
    """The model of a tokenizer file; small enough to be sent to every worker."""

    def __init__(self, raw: str) -> None:
        spec = json.loads(raw)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.rank = {(a, b): k for k, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        self.token = {i: t for t, i in self.vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        steps = spec["normalizer"]["normalizers"] if spec["normalizer"]["type"] == "Sequence" else [spec["normalizer"]]
        kinds = [x["type"] for x in steps]
        if set(kinds) - {"NFC", "Replace", "Lowercase"} or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("this kind of tokenizer file is not covered")
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        pattern = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.pattern = pattern
        self.split_any = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        # for texts of _PLAIN characters only, the same classes spelt out, for a faster engine
        letters, space = "a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-ɏ", "\\x09-\\x0d\\x20"
        plain = pattern.replace(r"[\p{L}]+", f"[{letters}]+").replace(r"[\p{N}]", "[0-9]").replace(r"[^\s\p{L}\p{N}]+", f"[^{space}{letters}0-9]+")
        self.split_plain = None if "\\p" in plain else re.compile(plain)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def parts(self, text: str) -> list[str]:
        """The text cut at special tokens, which come out as they are at the odd places."""
        if self.split_special is None or not any(x in text for x in self.special):
            return [text]
        return self.split_special.split(text)

    def split(self, text: str) -> tuple[list[str], list[int]]:
        """All pieces of a text in order, a special token as its own content, and the places of special tokens."""
        pieces, special = [], []
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                special.append(len(pieces))
                pieces.append(part)
            else:
                pieces += self.pieces(part)
        return pieces, special

    def pieces(self, text: str) -> list[str]:
        """The normalized pieces of a part without special tokens."""
        if self.split_plain is not None and not _PLAIN.search(text):
            return self.split_plain.findall(text.lower() if self.lower else text)
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:  # character by character, so a sigma at a word's end is a sigma like any other
            text = text.replace("Σ", "σ").lower()
        return self.split_any.findall(text)

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: the pair of least rank is joined first, the leftmost of equals, until none is left."""
        letters = byte_letters()
        sym = [letters[b] for b in piece.encode()]
        if self.suffix:
            sym[-1] += self.suffix
        n, rank = len(sym), self.rank
        if n < 12:
            while n > 1:
                best, at = min((rank.get((sym[k], sym[k + 1]), 1 << 30), k) for k in range(n - 1))
                if best == 1 << 30:
                    break
                sym[at : at + 2] = [sym[at] + sym[at + 1]]
                n -= 1
            return [self.vocab[s] for s in sym]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, k, sym[k], sym[k + 1]) for k in range(n - 1) if (r := rank.get((sym[k], sym[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            m = right[k]
            if sym[k] != a or m < 0 or sym[m] != b:
                continue
            sym[k], sym[m] = a + b, ""
            right[k] = right[m]
            if right[m] >= 0:
                left[right[m]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 and y >= 0 and (r := rank.get((sym[x], sym[y]))) is not None:
                    heapq.heappush(heap, (r, x, sym[x], sym[y]))
        return [self.vocab[s] for s in sym if s]

    @functools.cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """An open-addressed table of mergeable pairs: keys, ranks, joined ids, and the table's bits."""
        bits = (4 * len(self.rank)).bit_length()
        keys, ranks, joined = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32), np.zeros(1 << bits, np.int32)
        for (a, b), r in self.rank.items():
            key = self.vocab[a] << 24 | self.vocab[b]
            at = _slot(key, bits)
            while keys[at] >= 0:
                at = (at + 1) & ((1 << bits) - 1)
            keys[at], ranks[at], joined[at] = key, r, self.vocab[a + b]
        return keys, ranks, joined, bits

    @functools.cached_property
    def _letters(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each byte inside a piece, and at its end."""
        letters = byte_letters()
        return np.array([self.vocab[letters[b]] for b in range(256)], np.int64), np.array([self.vocab[letters[b] + self.suffix] for b in range(256)], np.int64)

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, ranks, joined, bits = self._pairs
        key = a << 24 | b
        at = (key * _SPREAD & _MASK) >> (62 - bits)
        todo = np.flatnonzero((keys[at] != key) & (keys[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
            todo = todo[(keys[at[todo]] != key[todo]) & (keys[at[todo]] >= 0)]
        return np.where(keys[at] == key, ranks[at], _NONE), joined[at]

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces: all ids in order of the pieces, and len + 1 offsets. The same merges as merge(), a round for all pieces at once."""
        size = np.array([len(p) for p in pieces], np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of some pieces: their indices, numbers of ids, and ids
        for k in np.flatnonzero(size > 48).tolist():
            ids = np.array(self.merge(pieces[k].decode()), np.int64)
            parts.append((np.array([k]), np.array([len(ids)]), ids))
        order = np.argsort(size, kind="stable")
        order = order[(size[order] > 0) & (size[order] <= 48)]
        inner, last = self._letters
        for lo in range(0, len(order), 8192):
            some = order[lo : lo + 8192]
            width = int(size[some[-1]])
            raw = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in some.tolist()), np.uint8).reshape(-1, width)
            n = size[some]
            sym = inner[raw]
            rows = np.arange(len(some))
            sym[rows, n - 1] = last[raw[rows, n - 1]]
            cols = np.arange(width)
            rank = np.full(raw.shape, _NONE, np.int32)
            if width > 1:
                inside = cols[: width - 1] < n[:, None] - 1
                rank[:, : width - 1][inside] = self._look_up(sym[:, :-1][inside], sym[:, 1:][inside])[0]
            live = rows
            while len(live):
                r, s = rank[live], sym[live]
                at = r.argmin(1)
                go = r[np.arange(len(live)), at] < _NONE
                live, r, s, at = live[go], r[go], s[go], at[go]
                if not len(live):
                    break
                k = np.arange(len(live))
                s[k, at] = self._look_up(s[k, at], s[k, at + 1])[1]
                s = np.take_along_axis(s, np.minimum(cols + (cols > at[:, None]), width - 1), 1)
                r = np.take_along_axis(r, np.minimum(cols + (cols >= at[:, None]), width - 1), 1)
                n[live] -= 1
                m = n[live]
                r[k, m - 1] = _NONE
                ahead = np.flatnonzero(at < m - 1)
                r[ahead, at[ahead]] = self._look_up(s[ahead, at[ahead]], s[ahead, at[ahead] + 1])[0]
                back = np.flatnonzero(at > 0)
                r[back, at[back] - 1] = self._look_up(s[back, at[back] - 1], s[back, at[back]])[0]
                rank[live], sym[live] = r, s
            parts.append((some, n, sym[cols < n[:, None]]))
        lengths = np.zeros(len(pieces), np.int64)
        for some, n, _ in parts:
            lengths[some] = n
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = np.zeros(int(ends[-1]), np.int64)
        for some, n, ids in parts:
            out[np.repeat(ends[some] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return out, ends

    def whole_words(self) -> list[bytes]:
        """The pieces that the vocabulary's whole words stand for, as bytes in order."""
        back = {c: b for b, c in byte_letters().items()}
        found = set()
        for t in self.vocab:
            if t.endswith(self.suffix) and (body := t[: len(t) - len(self.suffix)]) and all(c in back for c in body):
                found.add(bytes(back[c] for c in body))
        return sorted(w for w in found if _is_text(w))


def _slot(key: int, bits: int) -> int:
    return (key * _SPREAD & _MASK) >> (62 - bits)


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
        return True
    except UnicodeDecodeError:
        return False


def compile_lexicon(model: WordBpe, words: list[bytes]) -> dict[str, np.ndarray]:
    """Flat arrays of the minimal acyclic automaton of `words`, with the ids of each word.

    Words come sorted; what lies behind the path shared with the next word can't change any more, so it is
    replaced by an equal state that is already there (Daciuk and others, 2000).
    """
    edges: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    known: dict[tuple, int] = {}
    free: list[int] = []

    def settle(path: list[int], word: bytes, keep: int) -> None:
        for depth in range(len(path) - 1, keep, -1):
            state, parent = path[depth], path[depth - 1]
            key = (final[state], tuple(edges[state].items()))
            if (same := known.setdefault(key, state)) != state:
                edges[parent][word[depth - 1]] = same
                free.append(state)
        del path[keep + 1 :]

    path, last = [0], b""
    for word in words:
        shared = len(os.path.commonprefix([last, word]))
        settle(path, last, shared)
        for byte in word[shared:]:
            if free:
                state = free.pop()
                edges[state], final[state] = {}, False
            else:
                state = len(edges)
                edges.append({})
                final.append(False)
            edges[path[-1]][byte] = state
            path.append(state)
        final[path[-1]] = True
        last = word
    settle(path, last, 0)
    behind: dict[int, int] = {}

    def count(state: int) -> int:
        stack = [state]
        while stack:
            s = stack[-1]
            todo = [t for t in edges[s].values() if t not in behind]
            if todo:
                stack += todo
            else:
                behind[s] = final[s] + sum(behind[t] for t in edges[s].values())
                stack.pop()
        return behind[state]

    count(0)
    order = {0: 0}
    for s in (queue := [0]):
        for t in edges[s].values():
            if t not in order:
                order[t] = len(order)
                queue.append(t)
    first, label, target, skip = [0], [], [], []
    for s in queue:
        before = int(final[s])
        for byte, t in sorted(edges[s].items()):
            label.append(byte)
            target.append(order[t])
            skip.append(before)
            before += behind[t]
        first.append(len(label))
    ids, ends = model.merge_many(words)
    return {
        "first": np.array(first, np.int32), "label": np.array(label, np.uint8), "target": np.array(target, np.int32), "skip": np.array(skip, np.int32),
        "final": np.array([final[s] for s in queue], np.uint8), "out_at": ends.astype(np.int32), "out": ids.astype(np.int32),
    }


class Lexicon:
    """The compiled automaton, memory-mapped from a file of the worker's own that has no name any more."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        with tempfile.TemporaryFile() as f:
            at = {}
            for name, x in arrays.items():
                f.write(b"\0" * (-f.tell() % 8))
                at[name] = f.tell()
                f.write(x.tobytes())
            f.flush()
            for name, x in arrays.items():
                setattr(self, name, np.memmap(f, x.dtype, "r", at[name], x.shape))

        self.key = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) << 8 | self.label

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in the lexicon's order, or -1; all words take a step together."""
        size = np.array([len(w) for w in words], np.int64)
        raw, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        state, out = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        out[size == 0] = -1
        live, k = np.flatnonzero(size > 0), 0
        while len(live):
            key = state[live] << 8 | raw[at[live] + k]
            slot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[slot] == key
            out[live[~hit]] = -1
            live, slot = live[hit], slot[hit]
            out[live] += self.skip[slot]
            state[live] = self.target[slot]
            k += 1
            over = size[live] == k
            done = live[over]
            out[done[self.final[state[done]] == 0]] = -1
            live = live[~over]
        return out

    def ids(self, words: list[bytes]) -> list[list[int] | None]:
        """The id outputs of each word, None for words that the lexicon doesn't hold."""
        return [self.out[self.out_at[n] : self.out_at[n + 1]].tolist() if n >= 0 else None for n in self.numbers(words).tolist()]


def load(path: str) -> str:
    """The text of a tokenizer file, read on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Memo:
    """What pieces came to, of one worker; forgotten as a whole when it holds MEMO pieces."""

    def __init__(self, find) -> None:
        self.known: dict = {}
        self.find = find

    def of(self, lists: Iterable[list[str]]) -> dict:
        """A table that holds all pieces of the lists."""
        all_ = set().union(*lists)
        new = [p for p in all_ if p not in self.known]
        if new:
            if len(self.known) + len(new) > MEMO:
                self.known, new = {}, list(all_)
            self.find(self.known, new)
        return self.known


_LIVE: dict = {}


class Shared:
    """A broadcast value under a name by which workers tell it from others."""

    def __init__(self, spark, value) -> None:
        self.name, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.broadcast.value


def live(kind, shared: Shared):
    """`kind(*shared.value)`, kept by a worker from task to task, as it is a pure function of the broadcast; one of a kind at a time."""
    if _LIVE.get(kind, (None, None))[0] != shared.name:
        _LIVE[kind] = (shared.name, kind(*shared.value))
    return _LIVE[kind][1]
