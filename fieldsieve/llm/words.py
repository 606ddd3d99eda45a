"""Words of whole Arrow columns at once: spans and 64-bit hashes, by numpy over the column's bytes.

A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D. In UTF-8 these bytes stand for
nothing but themselves, so no text is decoded. All work is done in blocks of bounded size.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
ROWS_BYTES = 2 << 20
#: Longer words, of which there are few, are hashed one by one.
LONG = 256

_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD1342543DE82EF95
_QINV = pow(_Q, -1, 1 << 64)
_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        x = np.full(max(n, BLOCK + 4096), base, np.uint64)
        x[0] = 1
        _powers[base] = np.multiply.accumulate(x)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if not len(col) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hands freed memory back to the system. Workers go from task to task, and a process that sits idle would keep what its largest task took."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def row_slices(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = 1 << 30, size: int = ROWS_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each part has about `size` bytes of text and `rows` rows at most, or one row."""
    for batch in batches:
        _, at = column_bytes(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            to = min(row + rows, max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1))
            yield batch.slice(row, to - row)
            row = to
    give_back()


def new_lengths(old: list[str | None], new: list[str | None], sizes: list) -> list:
    """`sizes` with the new text's length wherever it was the old one's."""
    return [len(y) if x is not None and y is not None and n is not None and n == len(x) else n for x, y, n in zip(old, new, sizes)]


def _next_cut(data: np.ndarray, offs: np.ndarray, hi: int) -> int:
    """The first place at or after hi where no word is cut."""
    k = int(np.searchsorted(offs, hi))
    limit = int(offs[k]) if k < len(offs) else len(data)
    at = hi
    while at < limit:
        gap = np.flatnonzero(~_WORD[data[at : min(limit, at + 4096)]])
        if len(gap):
            return at + int(gap[0])
        at += 4096
    return limit


def _word_hashes(block: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words block[s:e]: eight bytes of all words at a time, mixed into two numbers each.

    Words of up to eight bytes and one length have different hashes. No sum over places is formed, so words that are
    made of the same letters in a regular order don't meet.
    """
    padded = np.zeros(len(block) + 8, np.uint8)
    padded[: len(block)] = block
    eight = np.ndarray(len(block) + 1, "<u8", padded, strides=(1,))
    size = e - s
    x = mix(size.astype(np.uint64) * np.uint64(_P))
    y = np.zeros(len(s), np.uint64)
    live, at, left = np.arange(len(s)), s, np.minimum(size, LONG + 1)
    long_ = np.flatnonzero(size > LONG)
    if len(long_):
        live = np.flatnonzero(size <= LONG)
        at, left = s[live], size[live]
    first = True
    while len(live):
        lane = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) * 8).astype(np.uint64))
        x[live] = mix(x[live] ^ lane)
        if not first:
            y[live] = mix(y[live] + lane * np.uint64(_Q)) ^ x[live]
        first = False
        go = left > 8
        live, at, left = live[go], at[go] + 8, left[go] - 8
    for k in long_.tolist():
        x[k] = int.from_bytes(hashlib.blake2b(block[s[k] : e[k]].tobytes(), digest_size=8).digest(), "little")
    return mix(x + mix(y))


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of all words in order, and for each row the place of its first word among them (rows + 1 places)."""
    n, lo, starts, ends = len(data), 0, [], []
    while lo < n:
        hi = _next_cut(data, offs, lo + BLOCK) if lo + BLOCK < n else n
        word = _WORD[data[lo:hi]]
        first = word.copy()
        first[1:] &= ~word[:-1]
        rows = offs[np.searchsorted(offs, lo) : np.searchsorted(offs, hi)] - lo
        first[rows] = word[rows]
        last = word.copy()
        last[:-1] &= ~word[1:] | first[1:]
        starts.append(np.flatnonzero(first) + lo)
        ends.append(np.flatnonzero(last) + lo + 1)
        lo = hi
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    s = np.concatenate(starts)
    return s, np.concatenate(ends), np.searchsorted(s, offs)


def hashed_words(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row the place of its first word among them (rows + 1 places)."""
    s, e, at = word_spans(data, offs)
    hashes = np.zeros(len(s), np.uint64)
    lo = 0
    while lo < len(s):  # blocks of words that keep the arrays small
        hi = max(lo + 1, int(np.searchsorted(e, s[lo] + BLOCK, "right")))
        block = data[s[lo] : e[hi - 1]]
        hashes[lo:hi] = _word_hashes(_LOWER[block] if lower else block, s[lo:hi] - s[lo], e[lo:hi] - s[lo])
        lo = hi
    return hashes, at


def gram_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of the k words from each place on; the last k - 1 places have none."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, np.uint64((0xA0761D6478BD642F + 0x9E3779B97F4A7C15 * (k + 64 * salt)) % 2**64), np.uint64)
    for j in range(k):
        out += h[j : j + n] * np.uint64(((2 * j + 3) * 0xE7037ED1A0B428DB) % 2**64 | 1)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return mix(out)


class Ranges:
    """Hashes of word sequences h[a:b] of a few dozen words, all from one pass over h."""

    def __init__(self, h: np.ndarray) -> None:
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(_Q, len(h)), out=self.sums[1:])
        self.back = powers(_QINV, len(h) + 1)

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a] ^ ((b - a).astype(np.uint64) * np.uint64(_P)))


def shingle_sets(h: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row its sorted distinct k-word shingles; of fewer words, the whole sequence as one."""
    grams, sets, empty = gram_hashes(h, k), [], np.zeros(0, np.uint64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            sets.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            sets.append(gram_hashes(h[a:b], b - a))
        else:
            sets.append(empty)
    return sets
