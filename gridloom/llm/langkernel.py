"""Language identification with a blended-spectrum string kernel.

Two texts are as alike as the number of character n-grams, n = 1 to 3, that both hold (presence, not
counts), each text's set being scaled to unit length. Landmarks drawn from the labelled texts give Nyström features: a
text's kernel values to the landmarks, whitened by the landmarks' own kernel matrix. One ridge regression for each language
on these features (kernel ridge regression in the Nyström space) scores it; all of it is two matrix products a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import settle

UNKNOWN = "und"
#: Keys of sampled rows that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 20_000
#: Texts whose kernel values are worked out together.
CHUNK = 256
_LETTER = regex.compile(r"\p{L}")
_STEP, _SPREAD = np.uint64(0x110000 + 1), np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(text: str) -> np.ndarray:
    """A number for each 1-, 2- and 3-gram of code points: its digits in base 0x110001, each code point plus one; 3 * 21 bits."""
    c = code_points(text).astype(np.uint64) + np.uint64(1)
    two = c[:-1] * _STEP + c[1:]
    return np.concatenate([c, two, two[:-1] * _STEP + c[2:]])


class Spectrum:
    """The n-grams that training texts hold, each with a column.

    A table of open slots holds most of them; those that fall on a taken slot are found by binary search.
    """

    def __init__(self, known: np.ndarray) -> None:
        self.width = len(known)
        self.shift = np.uint64(64 - max(10, (16 * self.width).bit_length()))
        slot = self._slot(known)
        first = np.unique(slot, return_index=True)[1]
        size = 1 << (64 - int(self.shift))
        self.key, self.column, self.crowded = np.zeros(size, np.uint64), np.full(size, self.width, np.int32), np.zeros(size, bool)
        self.key[slot[first]], self.column[slot[first]] = known[first], first
        rest = np.setdiff1d(np.arange(self.width), first)
        rest = rest[np.argsort(known[rest])]
        self.more, self.more_column = np.append(known[rest], np.uint64(2**64 - 1)), np.append(rest, self.width)
        self.crowded[slot[rest]] = True

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return ((g ^ (g >> np.uint64(29))) * _SPREAD >> self.shift).astype(np.int64)

    def columns(self, g: np.ndarray) -> np.ndarray:
        """The column of each n-gram; ``width`` for unknown ones."""
        slot = self._slot(g)
        out = np.where(self.key[slot] == g, self.column[slot], self.width)
        check = np.flatnonzero(self.crowded[slot] & (out == self.width))
        if len(check):
            at = np.searchsorted(self.more, g[check])
            out[check] = np.where(self.more[at] == g[check], self.more_column[at], self.width)
        return out

    def presence(self, texts: list[str]) -> np.ndarray:
        """Rows of unit length over the known n-grams."""
        out = np.zeros((len(texts), self.width + 1), dtype=np.float32)
        for i, t in enumerate(texts):
            out[i, self.columns(grams(t))] = 1
        out = out[:, :-1]
        size = np.sqrt(out.sum(axis=1, dtype=np.float32))
        return out / np.maximum(size, 1)[:, None]


@dataclass
class Classifier:
    spectrum: Spectrum
    landmarks: np.ndarray  # presence of the landmark texts, a column each
    weights: np.ndarray  # landmarks x languages, whitening included
    bias: np.ndarray
    languages: list[str]

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values of texts to the landmarks."""
        parts = [self.spectrum.presence(texts[i : i + CHUNK]) @ self.landmarks for i in range(0, len(texts), CHUNK)]
        return np.concatenate(parts) if parts else np.zeros((0, self.landmarks.shape[1]), np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts) @ self.weights + self.bias


def known_grams(texts: list[str]) -> np.ndarray:
    """n-grams that two texts or more hold: those of a single text tell nothing. Merged chunk by chunk."""
    once, twice = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for i in range(0, len(texts), CHUNK):
        g, n = np.unique(np.concatenate([np.unique(grams(t)) for t in texts[i : i + CHUNK]]), return_counts=True)
        again = np.isin(g, once, assume_unique=True)
        twice = np.union1d(twice, g[again | (n > 1)])
        once = np.union1d(once, g)
    return twice


def train(texts: list[str], languages: list[str], *, n_landmarks: int = 192, ridge: float = 1e-2) -> Classifier | None:
    """Fit on a sample; None if it is empty. Rows should come in a fixed random order: the first are the landmarks."""
    names = sorted(set(languages))
    if not names:
        return None
    spectrum = Spectrum(known_grams(texts))
    landmarks = np.ascontiguousarray(spectrum.presence(texts[:n_landmarks]).T)
    fitted = Classifier(spectrum, landmarks, np.zeros(0), np.zeros(0), names)
    k = (landmarks.T @ landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(k)
    keep = values > 1e-6 * max(values.max(), 1e-12)
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    z = fitted.kernel(texts).astype(np.float64) @ whiten
    lang = np.array([names.index(v) for v in languages])
    y = np.where(lang[:, None] == np.arange(len(names)), 1.0, -1.0)
    # languages weigh alike, however many texts each has
    w = (1.0 / np.bincount(lang, minlength=len(names)))[lang]
    w /= w.sum()
    mean_z, mean_y = w @ z, w @ y
    zc, yc = z - mean_z, y - mean_y
    a = np.linalg.solve((zc * w[:, None]).T @ zc + ridge * np.eye(z.shape[1]) / len(z), (zc * w[:, None]).T @ yc)
    fitted.weights, fitted.bias = (whiten @ a).astype(np.float32), (mean_y - mean_z @ a).astype(np.float32)
    return fitted


def training_part(doc_id: Column) -> Column:
    """Rows to learn from: those whose crc32 of doc_id, as text, is not 2 modulo 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2


def sample(labelled: DataFrame, per_language: int, max_chars: int, max_rows: int) -> list:
    """(text, lang) rows in hash order: at most ``per_language`` distinct (doc_id, text) of each language and ``max_rows`` in all, only texts of at most ``max_chars``, whole.

    Where there are more languages than ``max_rows`` / ``per_language``, each gives as many rows as all can. Rows
    that repeat a doc_id and a text are one.
    """
    rows = labelled.where((F.length("text") <= max_chars) & (F.length("text") > 0)).withColumns({"h": F.xxhash64("doc_id"), "t": F.xxhash64("text")})
    line = Window.partitionBy("lang").orderBy("h", "doc_id", "t")
    ranked = rows.select("doc_id", "lang", "h", "t").withColumn("n", F.dense_rank().over(line)).where(F.col("n") <= per_language)
    chosen = settle(ranked.distinct().orderBy("n", "h", "doc_id", "t", "lang").limit(max_rows).drop("n"))
    small = chosen.count() <= BROADCAST_ROWS
    found = rows.join(F.broadcast(chosen) if small else chosen, ["doc_id", "lang", "h", "t"]).select("doc_id", "lang", "h", "t", "text").dropDuplicates(["doc_id", "lang", "h", "t"])
    return sorted(found.collect(), key=lambda r: (r["h"], r["text"], r["lang"]))  # max_rows at most, of max_chars at most


def identify(docs: DataFrame, *, per_language: int = 400, max_chars: int = 20_000, max_rows: int = 20_000, n_landmarks: int = 192) -> DataFrame:
    """docs (doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score: one row for each row of docs.

    held_out: the row is kept from training (:func:`training_part`); rows without doc_id are, too. Training takes at most
    ``per_language`` texts of each language among the others and ``max_rows`` in all, texts of at most ``max_chars``
    characters, by a hash of doc_id; every text is then classified whole, whatever its length and characters. lang_pred is a language of the training rows, or ``und``
    for a text that is null, empty or without a letter, and for all texts if nothing could be learned.
    score (0 to 1) is the language's share in a softmax over the regressions; 0 with ``und``. Repeated rows are
    judged alike; lang, source and doc_id play no part in it. An empty table gives an empty one.
    """
    part = F.coalesce(training_part(F.col("doc_id")), F.lit(False))
    rows = sample(docs.where(part & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"), per_language, max_chars, max_rows)
    model = train([r["text"] for r in rows], [r["lang"] for r in rows], n_landmarks=n_landmarks)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample: its n-grams times the landmarks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                cut = b.slice(i, CHUNK)
                texts = [t or "" for t in cut.column(2).to_pylist()]
                plain = np.array([m is not None and _LETTER.search(t) is not None for t in texts])
                pred, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
                if plain.any():
                    s = 4 * m.scores([t for t, p in zip(texts, plain) if p]).astype(np.float64)
                    s = np.exp(s - s.max(axis=1, keepdims=True))
                    s /= s.sum(axis=1, keepdims=True)
                    pred[plain] = np.array(m.languages, dtype=object)[s.argmax(axis=1)]
                    score[plain] = s.max(axis=1)
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (~part).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
