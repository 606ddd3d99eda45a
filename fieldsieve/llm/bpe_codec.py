"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

The pieces of the corpus are counted, and the most frequent compiled with all their ids into the automaton; each worker maps
it into memory and takes the ids of pieces from it. Pieces that it doesn't hold are merged exactly.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import Lexicon, Memo, Shared, WordBpe, compile_lexicon, live, load
from .piece_counts import frequent_pieces
from .words import row_slices


#: Bytes of text whose pieces are looked up together; the more, the fewer look-ups of one piece.
TEXTS = 4 << 20


class Codec:
    """Encodes and decodes with a model and the lexicon's arrays; one for each worker task."""

    def __init__(self, raw: str, arrays: dict[str, np.ndarray]) -> None:
        self.model, self.lexicon = WordBpe(raw), Lexicon(arrays)
        self.memo = Memo(self._find)

    def _bytes(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, four bytes each: from the lexicon, and the unseen ones merged together."""
        raw = [p.encode() for p in pieces]
        number = self.lexicon.numbers(raw)
        unseen = np.flatnonzero(number < 0)
        ids, ends = self.model.merge_many([raw[k] for k in unseen.tolist()])
        blob = self.lexicon.out.astype("<u4").tobytes() + ids.astype("<u4").tobytes()
        # where each piece's ids are in the lexicon's outputs with the merged ones behind them
        at = np.asarray(self.lexicon.out_at, np.int64) * 4
        lo, hi = at[number], at[number + 1]
        lo[unseen], hi[unseen] = (len(self.lexicon.out) + ends[:-1]) * 4, (len(self.lexicon.out) + ends[1:]) * 4
        return [blob[a:b] for a, b in zip(lo.tolist(), hi.tolist())]

    def _find(self, known: dict, new: list[str]) -> None:
        token = self.model.token
        for piece, ids in zip(new, self._bytes(new)):
            known[piece] = self.form(struct.unpack(f"<{len(ids) // 4}I", ids), token)

    def form(self, ids: list[int], token: dict[int, str]):
        """What is kept of a piece."""
        return len(ids), " ".join(map(str, ids)), " ".join([token[i] for i in ids])

    def found(self, texts: list[str]) -> Iterator[list]:
        """For each text what is kept of its pieces, in order."""
        split = [self.model.split(t) for t in texts]
        known = self.memo.of([p for p, _ in split])
        for pieces, special in split:
            rows = [known[p] for p in pieces]
            for k in special:
                rows[k] = self.form([self.model.special[pieces[k]]], self.model.token)
            yield rows

    def spelled(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text the number of ids, the ids in decimal joined by spaces, and the decoded text."""
        return [(sum([r[0] for r in rows]), " ".join([r[1] for r in rows]), " ".join([r[2] for r in rows])) for rows in self.found(texts)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for i in ids.split()] for _, ids, _ in self.spelled(texts)]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, as the library does for files without a decoder; unknown ids give nothing."""
        return " ".join(t for i in ids if (t := self.model.token.get(i)) is not None)


class IdMemo(Codec):
    """A codec that keeps ids as bytes."""

    def form(self, ids: list[int], token: dict[int, str]):
        return struct.pack(f"<{len(ids)}I", *ids)

    def _find(self, known: dict, new: list[str]) -> None:
        known.update(zip(new, self._bytes(new)))

    def id_arrays(self, texts: list[str]) -> Iterator[np.ndarray]:
        for rows in self.found(texts):
            yield np.frombuffer(b"".join(rows), "<u4")


def vocabulary_model(docs: DataFrame, path: str) -> Shared:
    """The tokenizer file and a lexicon of the vocabulary's whole words, broadcast: a few megabytes that depend on the vocabulary alone."""
    raw = load(path)
    model = WordBpe(raw)
    return Shared(docs.sparkSession, (raw, compile_lexicon(model, model.whole_words())))


def corpus_model(docs: DataFrame, path: str) -> tuple[Shared, float]:
    """The tokenizer file and a lexicon of the most frequent pieces of `docs` (text), broadcast, and their share of all occurrences; at most MOST pieces of LONGEST bytes."""
    raw = load(path)
    pieces, share = frequent_pieces(docs, raw)
    return Shared(docs.sparkSession, (raw, compile_lexicon(WordBpe(raw), pieces))), share


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; a null text counts as empty.

    Empty texts have no tokens and the digest of nothing. Repeated rows and null ids give their row each. Other
    columns of `docs` are not looked at.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared, _ = corpus_model(base, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = live(Codec, shared)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for part in row_slices(batches, size=TEXTS):
            rows = codec.spelled([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([sha(r[1]) for r in rows], pa.string()), pa.array([sha(r[2]) for r in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return base.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_pieces(docs: DataFrame, path: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, nth: the token ids of each text and `end_id`, in pieces of at most `size`.

    `part` is the task that made the row and `nth` counts the task's pieces of that length before it.
    """
    shared = vocabulary_model(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, part_id, seen = live(IdMemo, shared), TaskContext.get().partitionId(), [0] * (size + 1)
        for part in row_slices(batches, size=TEXTS):
            rows = []
            for doc, ids in zip(part.column(0).to_pylist(), codec.id_arrays([t or "" for t in part.column(1).to_pylist()])):
                ids = np.append(ids, np.array(end_id, "<u4"))
                for k, start in enumerate(range(0, len(ids), size)):
                    piece = ids[start : start + size]
                    rows.append((doc, k, start, len(piece), zlib.crc32(piece.tobytes()), part_id, seen[len(piece)]))
                    seen[len(piece)] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")
