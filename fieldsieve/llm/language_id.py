"""Language identification: the family first, then one-versus-one linear support vector machines within it.

Features are square roots of relative frequencies of hashed byte trigrams of the whole text, at unit length. The
family is told by one-versus-one machines over families, the language by those over its family's languages. Only
the training sample is bounded (SAMPLE rows of a language at most); prediction reads every whole text.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import column_bytes, row_slices

SAMPLE = 1200
#: Languages that are learnt at most, the most frequent: 4,950 machines of 16 kB.
MOST = 100
SIZE = 4096
#: Rows whose features are held at once.
ROWS = 1024

# Families of languages by code. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "indic": "hi bn ur pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue wuu",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), lang)


def trigram_features(col: pa.Array) -> np.ndarray:
    """A row of SIZE features for each text; a text of fewer than three bytes has none."""
    data, at = column_bytes(col)
    rows = len(at) - 1
    low = data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    after = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E)) + 1 if len(low) > 1 else []
    low[after] += 32
    low[(low < 65)] = 32
    x = np.zeros((rows, SIZE), np.float32)
    if len(low) >= 3:
        wide = low.astype(np.uint32)
        h = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D))
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20)).astype(np.int64)
        size = np.diff(at)
        for i in range(rows):
            if size[i] >= 3:
                x[i] = np.bincount(h[at[i] : at[i + 1] - 2], minlength=SIZE)
    x = np.sqrt(x)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 120, ridge: float = 1e-3) -> np.ndarray:
    """Weights and a bias of a linear support vector machine with squared hinge loss, by accelerated gradient steps; y is 1 or -1."""
    n, w = len(y), np.zeros(x.shape[1] + 1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step, v, t = 1 / (4 + ridge), w.copy(), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v[:-1].astype(np.float32) + v[-1]))
        g = (-2 * share * slack * y).astype(np.float32)
        grad = np.append(x.T @ g, g.sum()) + ridge * v
        grad[-1] -= ridge * v[-1]
        new, t_new = v - step * grad, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w.astype(np.float32) if n else w


def one_versus_one(x: np.ndarray, names: np.ndarray) -> dict[tuple[str, str], np.ndarray]:
    out = {}
    for a, b in itertools.combinations(sorted(set(names.tolist())), 2):
        some = (names == a) | (names == b)
        out[a, b] = svm(x[some], np.where(names[some] == a, 1.0, -1.0))
    return out


class Discriminator:
    """Machines over families, and for each family with several languages machines over them."""

    def __init__(self, x: np.ndarray, langs: np.ndarray) -> None:
        families = np.array([family_of(c) for c in langs.tolist()])
        self.families = sorted(set(families.tolist()))
        self.langs = {f: sorted(set(langs[families == f].tolist())) for f in self.families}
        self.upper = one_versus_one(x, families)
        self.lower = {f: one_versus_one(x[families == f], langs[families == f]) for f in self.families if len(self.langs[f]) > 1}

    @staticmethod
    def vote(x: np.ndarray, names: list[str], machines: dict) -> tuple[np.ndarray, np.ndarray]:
        """The index of the name with most duels won (then the larger sum of margins), and its mean share of the duels."""
        if len(names) == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        wins, sums, share = (np.zeros((len(x), len(names))) for _ in range(3))
        for (a, b), w in machines.items():
            m = x @ w[:-1] + w[-1]
            i, j = names.index(a), names.index(b)
            p = 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
            wins[:, i] += m > 0
            wins[:, j] += m <= 0
            sums[:, i] += np.tanh(m)
            sums[:, j] -= np.tanh(m)
            share[:, i] += p
            share[:, j] += 1 - p
        best = (wins + sums / (2 * len(names) + 2)).argmax(1)
        return best, share[np.arange(len(x)), best] / (len(names) - 1)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, score = self.vote(x, self.families, self.upper)
        langs = np.empty(len(x), object)
        for k, name in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            if len(rows):
                best, s = self.vote(x[rows], self.langs[name], self.lower.get(name, {}))
                langs[rows] = np.array(self.langs[name], object)[best]
                score[rows] *= s
        return langs.tolist(), score


def fit(docs: DataFrame, folds: int = 5, held: int = 0, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Discriminator | None:
    """Learns from about `sample` texts of each language at most, none of the held-out fold; None without labelled rows.

    Rows are chosen by a hash of the id at a rate that the languages' counts give. What comes to the driver is
    8 kB a row. Rows with a null id, text or language teach nothing, nor do languages beyond the MOST most frequent.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    base = base.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(F.crc32(F.col("doc_id").cast("string")) % folds != held)
    counts = {r["lang"]: r["count"] for r in base.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST).collect()}
    if not counts:
        return None
    most = min(sample, max(50, 4 * sample // len(counts)))
    rate = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, most / n))])
    chosen = base.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.try_element_at(rate, F.col("lang")) * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, rows=ROWS):
            x = trigram_features(part.column(1)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    rows = chosen.select("lang", "text").mapInArrow(run, "lang string, x binary").toArrow()
    if not rows.num_rows:
        return None
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).reshape(-1, SIZE).astype(np.float32)
    return Discriminator(x, np.array(rows.column("lang").to_pylist(), object))


def predicted_languages(docs: DataFrame, model: Discriminator | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every whole text.

    `und` with score 0 where the text is null or has no letter, or where nothing could be learnt. A row with a null
    id is not held out; repeated rows give their row each. Other columns of `docs` are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, rows=ROWS):
            texts = part.column(1).to_pylist()
            langs, score = shared.value.predict(trigram_features(part.column(1))) if shared.value else (["und"] * len(texts), np.zeros(len(texts)))
            known = [t is not None and _LETTER.search(t) is not None for t in texts]
            langs = [v if k else "und" for v, k in zip(langs, known)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))
    return base.mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
