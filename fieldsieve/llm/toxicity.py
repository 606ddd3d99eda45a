"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, with exception phrases.

Folding maps upper case, look-alike letters of other scripts and digits or signs that stand for letters to one
letter, and everything else that is no letter to a space. The lexicon holds whole words and word beginnings with
their log odds, learnt from labelled rows; an exception phrase is a hit with the word before or after
it that labelled rows show to be harmless. The sum of weights, bare and by length, gives the score by logistic
regression. Only the sample of labelled rows is bounded (SAMPLE); scoring reads every whole text.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .lineage import cut
from .words import row_slices

SAMPLE = 6000
STEMS = (4, 5, 6, 7, 8)
LEAST_DOCS = 4
LEAST_ODDS = 3.0
LEAST_SPARED = 3

# Letters that look like a Latin one, and signs written for letters.
LOOK_ALIKES = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r",
    "α": "a", "ο": "o", "ρ": "p", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "υ": "u", "τ": "t", "χ": "x", "η": "n", "γ": "y", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ⅼ": "l",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}

# Letters of U+00A0 to U+02AF that folding leaves as they are; all others beyond ASCII call for it. (A no-break space is split at as any space.)
_KEPT = "".join(c for c in map(chr, range(0xA0, 0x2B0)) if c == "\xa0" or c not in LOOK_ALIKES and unicodedata.normalize("NFKC", c).lower() == c)
_UNUSUAL = re.compile(f"[^\x00-\x7f{_KEPT}]")
_SIGN = re.compile(r"[@$](?=[^\W\d_])")
_SPACES = bytes(ord(SIGNS[chr(b)]) if chr(b) in SIGNS else b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_LOOK = str.maketrans(LOOK_ALIKES)


def folded(text: str) -> str:
    """Words of the text with one space before and after each, folded."""
    text = text.lower()
    if _UNUSUAL.search(text):
        text = unicodedata.normalize("NFKC", text).lower().translate(_LOOK)
    if "@" in text or "$" in text:
        text = _SIGN.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return " " + " ".join(text.encode("utf-8", "replace").translate(_SPACES).decode("utf-8", "replace").split()) + " "


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    model: tuple[float, ...] = (-4.0, 1.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for p, w in self.weights.items():
            a.add_word(p, (w, len(p)))
        for p in self.exceptions:
            a.add_word(p, (0.0, len(p)))
        if len(a):
            a.make_automaton()
        return a


def hits(automaton, text: str) -> list[tuple[int, int, float]]:
    """(begin, end, weight) of the lexicon's matches that no exception phrase covers. One sweep over both by where they begin, so the time follows the text and its matches."""
    if not len(automaton):
        return []
    found, spared = [], []
    for end, (w, n) in automaton.iter(text):
        (found if w else spared).append((end - n + 1, end + 1, w))
    if not spared:
        return found
    spared.sort()
    out, at, reach = [], 0, 0
    for x in sorted(found):
        while at < len(spared) and spared[at][0] <= x[0]:
            reach = max(reach, spared[at][1])
            at += 1
        if reach < x[1]:
            out.append(x)
    return out


def _features(automaton, text: str) -> tuple[float, float]:
    total = sum(w for _, _, w in hits(automaton, text))
    return np.log1p(total), np.log1p(100 * total / max(1, text.count(" ") - 1))


def patterns_of(text: str) -> set[str]:
    """Words and beginnings of words of a folded text, each once."""
    words = set(text.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) >= k}


def phrases_of(automaton, text: str) -> set[str]:
    """Each hit with the word before it, and with the word after it."""
    out = set()
    for a, b, _ in hits(automaton, text):
        word_end = text.find(" ", a + 1)
        before, after = text.rfind(" ", 0, a), text.find(" ", word_end + 1)
        if before >= 0:
            out.add(text[before : word_end + 1])
        if after >= 0:
            out.add(text[a : after + 1])
    return out


def _odds(c1: float, c0: float, n1: int, n0: int) -> float:
    return float(np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1)))


def chosen_weights(odds: dict[str, float]) -> dict[str, float]:
    """Of patterns with their log odds, the shortest that are strong already; they stand for the longer ones."""
    weights: dict[str, float] = {}
    for p in sorted(odds, key=lambda p: (len(p.rstrip()), p)):
        if odds[p] >= LEAST_ODDS and not any(p[:k] in weights for k in range(3, len(p))):
            weights[p] = odds[p]
    return weights


def scale(features: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """Bias and weights of a logistic regression on (total, density), classes balanced, by Newton steps with a small ridge."""
    x, n1 = np.hstack([np.ones((len(features), 1)), features]), int(toxic.sum())
    w, balance = np.zeros(3), np.where(toxic == 1, len(toxic) / (2 * n1), len(toxic) / (2 * (len(toxic) - n1)))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (balance * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        w += np.linalg.solve(hessian, x.T @ (balance * (toxic - p)) - 1e-2 * w)
    return tuple(w.tolist())


def _one_class(n1: int) -> Lexicon:
    return Lexicon({}, [], (-4.0 if not n1 else 4.0, 0.0, 0.0))


def learn(texts: list[str], toxic: list[int]) -> Lexicon:
    """A lexicon, its exceptions and its scale from labelled texts; without toxic texts it is empty and scores are low. `fit` does the same for a table."""
    texts, y = [folded(t or "") for t in texts], np.array(toxic)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return _one_class(n1)

    def counted(of) -> tuple[Counter, Counter]:
        seen = (Counter(), Counter())
        for t, c in zip(texts, y.tolist()):
            seen[c].update(of(t))
        return seen

    seen = counted(patterns_of)
    lexicon = Lexicon(chosen_weights({p: _odds(c, seen[0][p], n1, n0) for p, c in seen[1].items() if c >= LEAST_DOCS}))
    automaton = lexicon.automaton()
    around = counted(lambda t: phrases_of(automaton, t))
    lexicon.exceptions = sorted(p for p, c in around[0].items() if c >= LEAST_SPARED and not around[1][p])
    automaton = lexicon.automaton()
    lexicon.model = scale(np.array([_features(automaton, t) for t in texts]), y)
    return lexicon


def score(lexicon: Lexicon, automaton, text: str | None) -> float:
    x = _features(automaton, folded(text or ""))
    b, u, v = lexicon.model
    return float(1 / (1 + np.exp(-np.clip(b + u * x[0] + v * x[1], -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of about `sample` labelled rows of each class at most, none of the held-out fold.

    Rows are chosen by a hash of their id, at a rate that the counts of labels give, so nothing is sorted. Rows
    without an id, a label or a text teach nothing; where an id has both labels each counts, and equal ones count once.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).filter("label_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.filter(F.crc32(F.col("label_id").cast("string")) % folds != held).distinct()
    n = {int(r.toxic): r["count"] for r in known.groupBy("toxic").count().collect()}
    part = F.pmod(F.xxhash64("label_id"), F.lit(1 << 20))
    rate = F.when(F.col("toxic") == 1, min(1.0, sample / max(1, n.get(1, 0)))).otherwise(min(1.0, sample / max(1, n.get(0, 0))))
    known = known.filter(part < rate * (1 << 20))
    # at most about 2 * sample ids whatever the input: the bound of the broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    return texts.join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("text", "toxic")


def _counts(rows: DataFrame, of) -> DataFrame:
    """(pattern, c0, c1): in how many texts of each class `of` a folded text gives the pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = of()
        for part in row_slices(batches):
            seen = (Counter(), Counter())
            for text, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seen[c].update(find(folded(text)))
            names = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([x[p] for p in names], pa.int64()) for x in seen)], names=["pattern", "c0", "c1"])

    return rows.mapInArrow(run, "pattern string, c0 long, c1 long").groupBy("pattern").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE) -> Lexicon:
    """Learns as `learn` does, from a bounded sample of labelled rows, whose texts stay on the executors.

    To the driver come the patterns that at least LEAST_DOCS of the sampled toxic texts hold and that are strong, phrases around their hits that
    LEAST_SPARED harmless ones hold, and two numbers a row: the sample's size bounds them, not the table's.
    """
    rows = cut(training_rows(docs, labels, folds, held, sample), "training")
    n = {int(r.toxic): r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return _one_class(n1)
    strong = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
    found = _counts(rows, lambda: patterns_of).filter(F.col("c1") >= LEAST_DOCS).withColumn("odds", strong).filter(F.col("odds") >= LEAST_ODDS - 1e-6)
    found = found.collect()
    lexicon = Lexicon(chosen_weights({r.pattern: _odds(r.c1, r.c0, n1, n0) for r in found}))
    bare = Lexicon(lexicon.weights)

    def spared():
        automaton = bare.automaton()
        return lambda text: phrases_of(automaton, text)

    calm = _counts(rows, spared).filter((F.col("c0") >= LEAST_SPARED) & (F.col("c1") == 0))
    lexicon.exceptions = sorted(r.pattern for r in calm.collect())
    whole = Lexicon(lexicon.weights, lexicon.exceptions)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = whole.automaton()
        for part in row_slices(batches):
            x = [_features(automaton, folded(t)) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), part.column(1)], names=["total", "density", "toxic"])

    x = rows.mapInArrow(features, "total double, density double, toxic int").toArrow()
    lexicon.model = scale(np.column_stack([x.column(0).to_numpy(), x.column(1).to_numpy()]), x.column(2).to_numpy())
    return lexicon


def toxicity_scores(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text.

    Null and empty texts have no hits and score low. A row with a null id is not held out. Repeated rows give their
    row each, with the same score. Other columns of `docs` are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for part in row_slices(batches):
            s = [score(lexicon, automaton, t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "score", "predicted"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))
    return base.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held_out.alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score below the threshold, with their columns unchanged."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for part in row_slices(batches, text_col):
            yield part.filter(pa.array([score(lexicon, automaton, t) < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)
