"""What one task does to look up many patterns in many texts, for `patterns`: windows of texts as integers, found by hash.

The characters of the patterns are numbered, so a window of several is one integer, and a pattern is found exactly, at all its places,
by looking up the windows of its length. Longer patterns go on from what their beginning found. Characters that no pattern has are 0, as
are the borders of texts, and no pattern has a 0. Patterns are in memory, a slice of all; texts stream by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Bits of a window and its group together, characters of texts that are looked up at once, about, and rows of a batch that is given back, about.
BITS, CHARACTERS, ROWS = 63, 1 << 20, 1 << 19
#: Words of 64 texts that searches are compared with at once, at most, words for all terms together, about, and words of queries that are compared at once, about.
WORDS, HELD, AT_ONCE = 16, 1 << 23, 1 << 15
#: Characters by which texts are laid together, and sides of what tells them apart most.
ALIKE, KINDS = 512, 3
_U = np.uint64


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def _sizes(texts: list[str]) -> np.ndarray:
    """The characters of each text, and one behind it."""
    return np.fromiter(map(len, texts), np.int64, len(texts)) + 1


class Finder:
    """Patterns, each of a group and not empty, no two alike."""

    def __init__(self, patterns: list[str], groups: list[str], bits: int | None = None):
        points, size = _points("".join(patterns)), np.fromiter(map(len, patterns), np.int64, len(patterns))
        known, start, bits = np.unique(points), np.cumsum(size) - size, bits or BITS
        self.table = np.zeros(0x110000, _U)
        self.table[known] = np.arange(1, len(known) + 1, dtype=_U)
        self.groups = {g: k for k, g in enumerate(dict.fromkeys(groups), 1)}
        of, flat = np.array([self.groups[g] for g in groups], _U), self.table[points]
        self.bits = _U(len(known).bit_length())
        self.first = max(1, (bits - len(self.groups).bit_length()) // int(self.bits))
        step = max(1, (bits - len(patterns).bit_length()) // int(self.bits))
        self.by_width, self.longer = {}, []

        def keys(state, rows, at, width):
            for j in range(width):
                state = state << self.bits | flat[start[rows] + (at + j)]
            return np.unique(state, return_inverse=True)

        width = np.minimum(size, self.first)
        for k in np.unique(width).tolist():
            rows = np.flatnonzero(width == k)
            found, state = keys(of[rows], rows, 0, k)
            whole, ends = size[rows] == k, np.full(len(found), -1)
            ends[state[whole]] = rows[whole]
            self.by_width[k] = pd.Index(found), ends
            for n in np.unique(size[rows][~whole]).tolist():
                mine = size[rows] == n
                own, at, levels, last = rows[mine], k, [], state[mine]
                while at < n:
                    w = min(step, n - at)
                    found, last = keys(last.astype(_U), own, at, w)
                    levels.append((at, w, pd.Index(found)))
                    at += w
                ends = np.empty(len(found), np.int64)
                ends[last] = own
                self.longer.append((levels, ends))

    def find(self, texts: list[str], groups: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, number of the pattern) of each place where a pattern of the text's group stands."""
        size, found = _sizes(texts), list(self.places(texts, groups))
        return np.repeat(np.arange(len(texts)), size)[np.concatenate([x for x, _ in found])], np.concatenate([x for _, x in found])

    def places(self, texts: list[str], groups: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, number of the pattern) in runs that are in order of the places, which go on from text to text, with one between them."""
        size = _sizes(texts)
        letters = self.table[_points("\0".join([*texts, ""]))]
        letters[np.cumsum(size) - 1] = 0
        n = len(letters)
        window = np.repeat(np.array([self.groups.get(g, 0) for g in groups], _U), size)
        yield np.empty(0, np.int64), np.empty(0, np.int64)
        for k in range(1, max(self.by_width) + 1):
            if k > n:
                break
            window = window[: n - k + 1] << self.bits
            window |= letters[k - 1 :]
            if k not in self.by_width:
                continue
            index, ends = self.by_width[k]
            state = index.get_indexer(window)
            at = np.flatnonzero(state >= 0)
            state = state.take(at)
            end = ends.take(state)
            if k < self.first:  # each is a whole pattern
                yield at, end
                continue
            whole = np.flatnonzero(end >= 0)
            yield at.take(whole), end.take(whole)
            for x in self.longer:
                yield self._rest(letters, at, state, *x)

    def _rest(self, letters, at, state, levels, ends):
        for begin, width, index in levels:
            fits = at + (begin + width) <= len(letters)
            at, key = at[fits], state[fits].astype(_U)
            for j in range(width):
                key = key << self.bits | letters[at + (begin + j)]
            state = index.get_indexer(key)
            at, state = at[state >= 0], state[state >= 0]
        return at, ends[state]


def _numbered(values: Iterable) -> tuple[np.ndarray, list]:
    """The number of each value among the different ones, and those."""
    known: dict = {}
    number = np.array([known.setdefault(x, len(known)) for x in values], np.int64)
    return number, list(known)


def _pieces(texts: list[str], most: int) -> Iterator[slice]:
    """Runs of texts with about CHARACTERS in all, and `most` texts at most."""
    begin = n = 0
    for k, x in enumerate(texts):
        n += len(x) + 1
        if n >= CHARACTERS or k + 1 - begin == most:
            yield slice(begin, k + 1)
            begin, n = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _alike(texts: list[str]) -> np.ndarray:
    """An order of the texts where those in one language, or of one kind, are near each other: by how often letters stand in their beginnings.

    What is found doesn't depend on it, only how many texts of a word answer the same queries.
    """
    size = np.fromiter((min(len(x), ALIKE) for x in texts), np.int64, len(texts))
    letter = _points("".join([x[:ALIKE] for x in texts])) % 128
    shares = np.bincount(np.repeat(np.arange(len(texts)) * 128, size) + letter, minlength=128 * len(texts)).reshape(-1, 128) / np.maximum(size, 1)[:, None]
    shares -= shares.mean(axis=0)
    sides = shares @ np.linalg.eigh(shares.T @ shares)[1][:, -KINDS:] > 0
    return np.argsort(sides @ (1 << np.arange(KINDS)), kind="stable")


class Asked:
    """What is asked in a cell: `ask` takes its rows, `begin` comes once before the first texts, `feed` takes those, `finish` ends."""

    def __init__(self):
        self.rows = []

    def ask(self, rows: pa.RecordBatch) -> None:
        self.rows.append(rows)

    def asked(self) -> pa.Table:
        rows, self.rows = self.rows, []
        return pa.Table.from_batches(rows)

    def finish(self) -> Iterator[pa.RecordBatch]:
        return iter(())


class Pairs(Asked):
    """(id, pattern_id) of texts (id, grp, text) that hold patterns (pattern_id, grp, text)."""

    def begin(self) -> None:
        asked = self.asked()
        number, once = _numbered(zip(asked["grp"].to_pylist(), asked["text"].to_pylist()))
        self.finder = Finder([p for _, p in once], [g for g, _ in once])
        self.ids, self.order = asked["pattern_id"].combine_chunks(), np.argsort(number, kind="stable")
        self.count = np.bincount(number, minlength=len(once))
        self.start = np.cumsum(self.count) - self.count

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, groups, ids = batch["text"].to_pylist(), batch["grp"].to_pylist(), batch["id"]
        for piece in _pieces(texts, 1 << 16):
            text, pattern = self.finder.find(texts[piece], groups[piece])
            both = np.unique(text * len(self.count) + pattern)
            text, pattern = both // len(self.count) + piece.start, both % len(self.count)
            many = self.count[pattern]
            behind = np.cumsum(many)
            while len(text):  # a pattern that several ids have gives a row each
                n = max(1, int(np.searchsorted(behind, (behind[0] - many[0]) + ROWS, "right")))
                copies = many[:n]
                place = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies) + np.repeat(self.start[pattern[:n]], copies)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(text[:n], copies))), self.ids.take(pa.array(self.order[place]))], ["id", "pattern_id"])
                text, pattern, many, behind = text[n:], pattern[n:], many[n:], behind[n:]


class Bits(Asked):
    """(id, bits) of texts (id, grp, text) that hold patterns (bits, grp, text): the bits of all that a text holds, in one row."""

    def begin(self) -> None:
        asked = self.asked()
        number, once = _numbered(zip(asked["grp"].to_pylist(), asked["text"].to_pylist()))
        self.finder, self.bits = Finder([p for _, p in once], [g for g, _ in once]), np.zeros(len(once), np.int64)
        np.bitwise_or.at(self.bits, number, asked["bits"].to_numpy())

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, groups, ids = batch["text"].to_pylist(), batch["grp"].to_pylist(), batch["id"]
        for piece in _pieces(texts, 1 << 16):
            text, pattern = self.finder.find(texts[piece], groups[piece])
            held = np.zeros(piece.stop - piece.start, np.int64)
            np.bitwise_or.at(held, text, self.bits[pattern])
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some + piece.start)), pa.array(held[some])], ["id", "bits"])


class Searches(Asked):
    """(query_id, id) of queries (query_id, terms) all of whose terms stand in a text (id, text), 64 texts in a word and some words at once.

    Texts are looked up once for all terms; queries are kept as numbers of theirs. Texts that are about as long should follow each other:
    short ones answer few queries, and words that are 0 go no further.
    """

    def ask(self, rows: pa.RecordBatch) -> None:
        ids = rows["query_id"].take(pa.array(np.arange(len(rows))))  # a copy, as else the whole batch stays
        self.rows.append((rows["terms"].flatten().dictionary_encode(), rows["terms"].value_lengths().to_numpy().copy(), ids))

    def begin(self) -> None:
        terms, size, ids = (list(x) for x in zip(*self.rows))
        self.rows, terms = [], pa.chunked_array(terms).unify_dictionaries()
        known, number = terms.chunk(0).dictionary.to_pylist(), np.concatenate([x.indices.to_numpy() for x in terms.chunks])
        self.finder, self.n_terms, terms = Finder(known, [""] * len(known)), len(known), None
        size = np.concatenate(size).astype(np.int64)
        start = np.cumsum(size) - size
        order = np.lexsort((number[start], -size))
        self.ids = pa.concat_arrays(ids).take(pa.array(order))
        size, start = size[order], start[order]
        # the k-th terms of the queries that have so many, which come first
        self.columns = [number[start[: np.searchsorted(-size, -k, "left")] + k].astype(np.intp) for k in range(int(size.max()))]
        self.words = 1 << max(0, min(WORDS, HELD // self.n_terms).bit_length() - 1)

    def held(self, texts: list[str], words: int) -> np.ndarray:
        """For each word and each term, a bit for each text that holds it."""
        bits = np.zeros((words, self.n_terms), _U)
        for word in range(words):
            row, some = bits[word], texts[64 * word : 64 * word + 64]
            for piece in _pieces(some, 64):
                own, behind = _U(1) << np.arange(piece.start, piece.stop, dtype=_U), np.cumsum(_sizes(some[piece]))
                for place, term in self.finder.places(some[piece], [""] * len(own)):
                    if len(place) < 16 * len(own):
                        np.bitwise_or.at(row, term, own[np.searchsorted(behind, place, "right")])
                        continue
                    edges = np.searchsorted(place, behind).tolist()
                    for bit, begin, end in zip(own, [0, *edges], edges):
                        row[term[begin:end]] |= bit
        return bits

    def hits(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of texts, queries, words): of some queries that the texts may answer, a bit for each text that does, in a row of words."""
        order = _alike(texts)
        for begin in range(0, len(texts), 64 * self.words):
            own = order[begin : begin + 64 * self.words]
            some = [texts[k] for k in own.tolist()]
            words = 1 << (-(-len(some) // 64) - 1).bit_length()
            bits = self.held(some, words)
            anywhere = np.bitwise_or.reduce(bits, axis=0) != 0
            bits = np.ascontiguousarray(bits.T)
            may = anywhere.take(self.columns[0])
            for column in self.columns[1:]:
                may[: len(column)] &= anywhere.take(column)
            queries = np.flatnonzero(may)
            for k in range(0, len(queries), AT_ONCE // words):
                query = queries[k : k + AT_ONCE // words]
                hit = bits.take(self.columns[0].take(query), axis=0)
                for column in self.columns[1:]:
                    n = int(np.searchsorted(query, len(column)))
                    if not n:
                        break
                    hit[:n] &= bits.take(column.take(query[:n]), axis=0)
                yield own, query, hit

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own, query, hit in self.hits(batch["text"].to_pylist()):
            words = hit.shape[1]
            at = np.flatnonzero(hit != 0)
            word = hit.reshape(-1)[at]
            for k in range(0, len(at), ROWS // 64):
                row, text = np.nonzero(np.unpackbits(word[k : k + ROWS // 64].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                place = at[k + row]
                yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(query[place // words])), batch["id"].take(pa.array(own[place % words * 64 + text]))], ["query_id", "id"])


#: A word is read in runs of so many bits; as many runs as it has.
RUN = 11
RUNS = -(-64 // RUN)


def _sums(ids: np.ndarray, words: int) -> np.ndarray:
    """For each word, each run of its bits and each value of that, the sum of the ids whose bits are set."""
    own = np.zeros((words, RUN * RUNS), np.int64)
    every = np.zeros(64 * words, np.int64)
    every[: len(ids)] = ids
    own[:, :64] = every.reshape(words, 64)
    own, sums = own.reshape(words * RUNS, RUN), np.zeros((words * RUNS, 1), np.int64)
    for k in range(RUN):
        sums = np.concatenate([sums, sums + own[:, k : k + 1]], axis=1)
    return sums.reshape(-1)


class Totals(Searches):
    """(query_id, n, total): how many texts answer each query, and the sum of their ids, which are integers, without a row for each."""

    def begin(self) -> None:
        super().begin()
        self.n, self.total = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, of = batch["id"].to_numpy(), None
        for own, query, hit in self.hits(batch["text"].to_pylist()):
            words = hit.shape[1]
            if own is not of:
                of, sums = own, _sums(ids[own], words)
            at = np.flatnonzero(hit != 0)
            word, place = hit.reshape(-1).take(at), (at & (words - 1)) * (RUNS << RUN)
            total = sums.take((word & _U((1 << RUN) - 1)).view(np.int64) + place)
            for k in range(1, RUNS):
                place += 1 << RUN
                total += sums.take((word >> _U(RUN * k) & _U((1 << RUN) - 1)).view(np.int64) + place)
            ends = np.cumsum(np.bincount(at >> (words.bit_length() - 1), minlength=len(query)))
            for mine, x in ((self.n, np.bitwise_count(word)), (self.total, total)):
                mine[query] += np.diff(np.append(0, np.cumsum(x, dtype=np.int64))[ends], prepend=0)
        return iter(())

    def finish(self) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(self.n)
        yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(some)), pa.array(self.n[some]), pa.array(self.total[some])], ["query_id", "n", "total"])


def by_cell(make: Callable[[], Asked]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Goes through rows in order of (cell, side): what is asked in a cell (side 0), which what `make` makes takes, then its texts (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, work, begun = None, None, False
        for batch in batches:
            place = batch["cell"].to_numpy().astype(np.int64) * 2 + batch["side"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                rows = batch.slice(begin, end - begin)
                if cell != place[begin] // 2:
                    if begun:
                        yield from work.finish()
                    cell, work, begun = place[begin] // 2, None, False
                if place[begin] % 2 == 0:
                    work = work or make()
                    work.ask(rows)
                elif work:
                    if not begun:
                        work.begin()
                        begun = True
                    yield from work.feed(rows)
        if begun:
            yield from work.finish()

    return run
