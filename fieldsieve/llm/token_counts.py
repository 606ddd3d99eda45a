"""Token counts by a compiled finite-state tokenizer, chunk by chunk.

`Transducer` is deterministic and reads bytes. Its states are the beginnings of the corpus's frequent pieces, so a state tells what
is pending; its transitions are annotated with emitted token counts, those that begin the next piece (a letter after a
sign, a digit after a letter, anything after a contraction) included. A text is cut into chunks of CHUNK bytes
anywhere. What a chunk does is a map from entry states to exit states with counts; maps compose associatively, in a tree,
the up sweep of a parallel prefix scan: first those that a task has, then, by an aggregation, those of a text
from wherever they are. Runs between white space that leave the transducer are counted by exact merging.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import Memo, Shared, WordBpe, live, load
from .lineage import cut
from .piece_counts import frequent_pieces
from .words import column_bytes, row_slices, word_spans

CHUNK = 1 << 16
# The pattern that the transducer is built after, and its contractions.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
LETTER, DIGIT, SIGN, CLOSED = 1, 2, 3, 4


def _kinds() -> np.ndarray:
    """What each byte is by itself; bytes of longer characters are nothing."""
    out = np.full(256, SIGN, np.int8)
    out[128:] = 0
    for c in map(chr, range(128)):
        if c.isalpha():
            out[ord(c)] = LETTER
        elif c.isdigit():
            out[ord(c)] = DIGIT
    return out


def compile_transducer(model: WordBpe, pieces: list[bytes]) -> dict[str, np.ndarray]:
    """Transitions, the counts that entering a state emits, whether a piece may end there, and the kind of its last character.

    Sums of counts along a path are those of the pieces it spells where the last one may end. A quote that begins a contraction
    is counted as if it began a word of its own until the contraction is complete, where the difference is emitted.
    """
    if model.pattern != PATTERN or not model.lower:
        raise ValueError("the transducer is built for one pattern of pieces and lower-cased texts")
    kinds = _kinds()
    words = {p for p in pieces if b"<|" not in p and p.decode() not in CONTRACTIONS} | {bytes([b]) for b in range(33, 127) if not 65 <= b <= 90}
    words = sorted(words)
    counts = np.diff(model.merge_many(words)[1]).tolist()
    states: dict[bytes, int] = {b"": 0}
    edges: list[tuple[int, int, int]] = []
    base, ends, kind = [0], [False], [0]
    for w, n in zip(words, counts):
        for k in range(1, len(w) + 1):
            if w[:k] not in states:
                states[w[:k]] = len(base)
                edges.append((states[w[: k - 1]], w[k - 1], len(base)))
                base.append(base[states[w[: k - 1]]])
                ends.append(False)
                kind.append(0)
        last = w.decode()[-1]
        s = states[w]
        base[s], ends[s], kind[s] = n, True, LETTER if last.isalpha() else DIGIT if model.split_any.findall("1" + last) != ["1" + last] and last.isnumeric() else SIGN
    # a state that no piece ends in keeps the kind of the last whole character before it, as only that can go on
    for w, s in states.items():
        if not ends[s] and w and w[-1] < 128:
            kind[s] = int(kinds[w[-1]])
    before = {t: s for s, _, t in edges}
    emit = [0] + [base[t] - base[before[t]] for t in range(1, len(base))]
    quote = states[b"'"]
    children: dict[int, dict[int, int]] = {}
    for s, b, t in edges:
        children.setdefault(s, {})[b] = t

    def new(count: int, closed: bool, like: int = 0) -> int:
        emit.append(count)
        ends.append(closed or ends[like])
        kind.append(CLOSED if closed else LETTER)
        return len(emit) - 1

    for c, n in zip(CONTRACTIONS, np.diff(model.merge_many([c.encode() for c in CONTRACTIONS])[1]).tolist()):
        raw = c.encode()
        if len(raw) == 2:
            edges.append((quote, raw[1], new(n - base[quote], True)))
            continue
        like = states[raw[1:2]]
        half = new(base[like], False, like)
        edges.append((quote, raw[1], half))
        edges.append((half, raw[2], new(n - base[quote] - base[like], True)))
        edges += [(half, b, t) for b, t in children.get(like, {}).items() if b != raw[2]]
    table = np.array(edges, np.int64)
    return {"key": table[:, 0] << 8 | table[:, 1], "to": table[:, 2].astype(np.int32), "emit": np.array(emit, np.int32), "ends": np.array(ends), "kind": np.array(kind, np.int8)}


class Transducer:
    """Runs many words side by side, one byte of all of them a step. State 0 is between pieces, -1 is off the transducer."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.emit, self.ends, kind = arrays["emit"], arrays["ends"], arrays["kind"]
        self.bits = (4 * len(arrays["key"])).bit_length()
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        todo, slot = np.arange(len(arrays["key"])), self._slot(arrays["key"])
        while len(todo):  # open addressing, all keys a round
            free = self.key[slot[todo]] < 0
            first = np.unique(slot[todo[free]], return_index=True)[1]
            put = todo[free][first]
            self.key[slot[put]], self.to[slot[put]] = arrays["key"][put], arrays["to"][put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            taken = todo[self.key[slot[todo]] >= 0]
            slot[taken] = (slot[taken] + 1) & ((1 << self.bits) - 1)
        self.lower = np.arange(256)
        self.lower[65:91] += 32
        kinds = _kinds()
        root = self.child(np.zeros(256, np.int64), np.arange(256))
        #: By the kind of a state and a byte that doesn't go on: the state that begins a piece, or -1.
        self.begin = np.full((5, 256), -1, np.int32)
        for k in (LETTER, DIGIT, SIGN, CLOSED):
            starts = (kinds > 0) & ((kinds != k) | (k == DIGIT) | (k == CLOSED))
            self.begin[k, starts] = root[starts]
        self.kind = np.where(self.ends, kind, 0)
        order = np.argsort(arrays["key"] & 255, kind="stable")
        self._edges, self._from = arrays["key"][order] >> 8, np.searchsorted(arrays["key"][order] & 255, np.arange(257))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def parents(self, byte: int) -> np.ndarray:
        """The states that have a transition of their own on a byte, in order."""
        return np.sort(self._edges[self._from[byte] : self._from[byte + 1]])

    def child(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) << 8 | byte
        slot = self._slot(key)
        found = self.key[slot]
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found[todo] = self.key[slot[todo]]
            todo = todo[(found[todo] != key[todo]) & (found[todo] >= 0)]
        return np.where(found == key, self.to[slot], -1)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one byte of each, -1 where there is none."""
        to = self.child(state, byte)
        off = np.flatnonzero(to < 0)
        to[off] = self.begin[self.kind[state[off]], byte[off]]
        return to

    def run(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of data[s:e] from each state."""
        state, count, at, live = state.astype(np.int64), np.zeros(len(s), np.int64), s.copy(), np.flatnonzero((e > s) & (state >= 0))
        while len(live):
            to = self.step(state[live], self.lower[data[at[live]]])
            state[live] = to
            on = to >= 0
            live, to = live[on], to[on]
            count[live] += self.emit[to]
            at[live] += 1
            live = live[at[live] < e[live]]
        return state, count

    def closed(self, state: np.ndarray) -> np.ndarray:
        """Whether a word may end in each state."""
        return (state >= 0) & (self.ends[state] | (state == 0))


@dataclass
class ChunkMap:
    """What a chunk does: a map from the state it is entered in to the state it is left in, and the tokens emitted between.

    The head is what stands before the chunk's first white space. `entry`, `exit` and `count` are arrays of the entry states, in
    order, that have a transition of their own on its first byte; other states go by their kind, by `kind_exit` and
    `kind_count`. An exit of -1 is off the transducer. A chunk without white space is open, and the exits are its own; a closed one
    maps all entries to one exit state, that of its tail, with the counts of its head, its inner words and its tail so far.
    `head` and `tail` are kept as bytes for words that leave the transducer.
    """

    open: bool
    head: bytes
    entry: np.ndarray
    exit: np.ndarray
    count: np.ndarray
    kind_exit: np.ndarray
    kind_count: np.ndarray
    inner: int = 0
    tail: bytes = b""
    state: int = 0
    pending: int = 0


class Counter:
    """Counts tokens with a model and the transducer's arrays; one for each worker."""

    def __init__(self, raw: str, arrays: dict[str, np.ndarray]) -> None:
        self.model, self.transducer = WordBpe(raw), Transducer(arrays)
        self.memo = Memo(self._find)

    def _find(self, known: dict, new: list[str]) -> None:
        known.update(zip(new, np.diff(self.model.merge_many([w.encode() for w in new])[1]).tolist()))

    def exact(self, words: list[bytes]) -> list[int]:
        """Tokens of runs between white space, by merging."""
        split = [self.model.split(w.decode()) for w in words]
        known = self.memo.of([p for p, _ in split]) if split else {}
        return [sum([known[p] for p in pieces]) - sum([known[pieces[k]] - 1 for k in special]) for pieces, special in split]

    def words(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Tokens of the words data[s:e]."""
        state, count = self.transducer.run(data, s, e, np.zeros(len(s), np.int64))
        off = np.flatnonzero(~self.transducer.closed(state))
        count[off] = self.exact([data[a:b].tobytes() for a, b in zip(s[off].tolist(), e[off].tolist())])
        return count

    def map_of(self, chunk: bytes) -> ChunkMap:
        """The map of one chunk of a text, which may begin and end anywhere."""
        t, data = self.transducer, np.frombuffer(chunk, np.uint8)
        s, e, _ = word_spans(data, np.array([0, len(data)]))
        size = int(e[0]) if len(s) and s[0] == 0 else 0
        open_ = size == len(data)
        head = data[:size]

        def led(first: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Exits and counts after the head's other bytes, of states that its first byte has led to."""
            left, count = t.run(head, np.ones_like(first), np.full_like(first, size), to)
            left[~t.closed(left) if not open_ else left < 0] = -1
            return left, count + np.where(to >= 0, t.emit[to], 0)

        if size:
            byte = int(t.lower[head[0]])
            entry = t.parents(byte)
            exit_, count = led(entry, t.child(entry, np.full(len(entry), byte)))
            by_kind = led(np.zeros(5, np.int64), t.begin[:, byte].astype(np.int64))
        else:
            entry = exit_ = count = np.zeros(0, np.int64)
            by_kind = (np.full(5, -1), np.zeros(5, np.int64))
        arrays = (head.tobytes(), *(x.astype(np.int32) for x in (entry, exit_, count, *by_kind)))
        if open_:
            return ChunkMap(True, *arrays)
        tail = int(s[-1]) if len(e) and e[-1] == len(data) else len(data)
        inner = (s >= size) & (e <= tail) & (s < tail)
        state, pending = t.run(data, np.array([tail]), np.array([len(data)]), np.zeros(1, np.int64))
        return ChunkMap(False, *arrays, int(self.words(data, s[inner], e[inner]).sum()), data[tail:].tobytes(), int(state[0]), int(pending[0]))

    def enter(self, m: ChunkMap, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the map's head leads from each state, -1 off the transducer, and what it emits; from a closed map the exit only tells that its head ends there."""
        state = np.asarray(state, np.int64)
        if not m.head:
            return np.where(self.transducer.closed(state) if not m.open else state >= 0, state, -1), np.zeros(len(state), np.int64)
        known = state >= 0
        kind = np.where(known, self.transducer.kind[state], 0)
        exit_, count = m.kind_exit[kind].astype(np.int64), m.kind_count[kind].astype(np.int64)
        if len(m.entry):
            k = np.minimum(np.searchsorted(m.entry, state), len(m.entry) - 1)
            own = m.entry[k] == state
            exit_, count = np.where(own, m.exit[k], exit_), np.where(own, m.count[k], count)
        return np.where(known, exit_, -1), count

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.open:
            if not a.head:
                return b
            (exit_, count), (by_kind, kind_count) = self.enter(b, a.exit), self.enter(b, a.kind_exit)
            arrays = (a.entry, exit_, a.count + count, by_kind, a.kind_count + kind_count)
            return ChunkMap(b.open, a.head + b.head, *(x.astype(np.int32) for x in arrays), b.inner, b.tail, b.state, b.pending)
        own = (a.head, a.entry, a.exit, a.count, a.kind_exit, a.kind_count)
        exit_, count = (int(x[0]) for x in self.enter(b, np.array([a.state])))
        if b.open:
            return ChunkMap(False, *own, a.inner, a.tail + b.head, exit_, a.pending + count)
        middle = a.pending + count if exit_ >= 0 else self.exact([a.tail + b.head])[0]
        return ChunkMap(False, *own, a.inner + middle + b.inner, b.tail, b.state, b.pending)

    def composed(self, maps: list[ChunkMap]) -> ChunkMap:
        """One map of many, pairwise in a tree."""
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]

    def total(self, m: ChunkMap) -> int:
        """The tokens of a text whose map is `m`: it is entered between pieces, and its end ends a word."""
        closed = lambda state: bool(self.transducer.closed(np.array([state]))[0])
        exit_, count = (int(x[0]) for x in self.enter(m, np.zeros(1, np.int64)))
        n = count if exit_ >= 0 and (not m.open or closed(exit_)) else self.exact([m.head])[0]
        return n if m.open else n + m.inner + (m.pending if closed(m.state) else self.exact([m.tail])[0])


def chunk_maps(chunks: DataFrame, shared: Shared) -> DataFrame:
    """`chunks` (row, k, n, n_bytes, chunk and others) with `map` in place of the chunk, null where that is null."""
    at = chunks.columns.index("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = live(Counter, shared)
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([pickle.dumps(counter.map_of(x)) if x is not None else None for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=["map" if c == "chunk" else c for c in batch.schema.names])

    return chunks.mapInArrow(run, ", ".join(f"{'map' if f.name == 'chunk' else f.name} {f.dataType.simpleString()}" for f in chunks.schema))


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text; a null text counts as empty.

    Texts of one chunk are counted where they are. The chunks of longer ones are dealt out, mapped apart from each other, and
    their maps brought together by text; a map holds some tens of kilobytes. Repeated rows and null ids give their row each.
    Other columns of `docs` are not looked at.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    raw = load(path)
    pieces, _ = frequent_pieces(base, raw)
    shared = Shared(docs.sparkSession, (raw, compile_transducer(WordBpe(raw), pieces)))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = live(Counter, shared)
        for part in row_slices(batches):
            data, offs = column_bytes(part.column(1))
            size = np.diff(offs)
            s, e, at = word_spans(data, offs)
            row = np.repeat(np.arange(len(size)), np.diff(at))
            short = size[row] <= chunk
            n = np.bincount(row[short], counter.words(data, s[short], e[short]), len(size)).astype(np.int64)
            times = np.maximum(1, -(-size // chunk))
            of = np.repeat(np.arange(len(size)), times)
            k = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            lo = offs[of] + k * chunk
            hi = np.minimum(lo + chunk, offs[of + 1])
            chunks = [data[a:b].tobytes() if t > 1 else None for a, b, t in zip(lo.tolist(), hi.tolist(), times[of].tolist())]
            columns = [part.column(2).take(pa.array(of)), part.column(0).take(pa.array(of)), pa.array(k), pa.array(hi - lo), pa.array(n[of]), pa.array(chunks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "k", "n_bytes", "n", "chunk"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = live(Counter, shared)
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False).copy()
            for k, maps in enumerate(batch.column(3).to_pylist()):
                if maps:
                    n[k] += counter.total(counter.composed([pickle.loads(x) for x in maps]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    chunks = base.withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut_up, "row long, doc_id long, k long, n_bytes long, n long, chunk binary")
    maps = chunk_maps(cut(chunks, "chunks").repartition("row", "k"), shared)
    lists = F.sort_array(F.collect_list(F.when(F.col("map").isNotNull(), F.struct("k", "map"))))
    found = maps.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.max("n").alias("n"), F.transform(lists, lambda x: x["map"]).alias("maps"))
    return found.select("doc_id", "n_bytes", "n", "maps").mapInArrow(totals, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
