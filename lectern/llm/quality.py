"""Quality scores by Naive Bayes support vectors.

A text's indicators are its words and pairs of words, its n-grams of four characters, n-grams of its
shape (upper and lower case runs, digits, each mark, with runs told from single ones), and how its
words repeat. Each indicator is scaled by the log of the ratio of its class counts, and a linear
hinge-loss model is fitted to them by dual coordinate descent.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.labelled import held_out, learnable, sample

#: Indicators: n-grams of shapes are hashed to so many, and so are words with pairs, and characters.
PART = 1 << 18
WIDTH = 3 * PART
#: What words and characters weigh beside shapes, of which a text has far fewer.
CONTENT = 0.1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _shapes() -> bytes:
    """By byte: 1 upper, 2 lower, 3 digit, 4 blank, 5 line end, 6 control, 7 up: marks.

    Of UTF-8's later bytes 0x80-0x9F count as capitals (most of them are, in Latin letters with
    accents) and the rest as small letters; first bytes are left out.
    """
    out, marks = [], iter(range(7, 64))
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out.append(1 if b < 0xA0 else 2)
        elif c.isalpha():
            out.append(1 if c.isupper() else 2)
        else:
            out.append(3 if c.isdigit() else 4 if c in " \t" else 5 if c in "\n\r" else 6 if not c.isprintable() else next(marks))
    return bytes(out)


_SHAPE = _shapes()
_LEADS = bytes(range(0xC0, 0x100))


def indicators(text: bytes) -> np.ndarray:
    """The numbers of a text's indicators, each once; an empty text has just the first."""
    shape = np.frombuffer(text.translate(_SHAPE, _LEADS), np.uint8)
    found = [np.zeros(1, np.uint32)]
    if len(shape):
        starts = np.flatnonzero(np.append(True, shape[1:] != shape[:-1]))
        single = np.diff(np.append(starts, len(shape))) == 1
        s = shape[starts].astype(np.uint32)
        s += np.uint32(64) * (~single & (s != 2))
        gram = np.zeros(len(s), np.uint32)
        for n in range(1, 5):
            gram = (gram[: len(gram) - (n > 1)] << np.uint32(7)) + s[n - 1 :]
            if not len(gram):
                break
            found.append(((gram + np.uint32(n << 28)) * np.uint32(2654435761) >> np.uint32(14)) % np.uint32(PART - 64) + np.uint32(64))
    low = text.translate(_LOWER)
    if len(low) >= 4:
        c = np.frombuffer(low, np.uint8).astype(np.uint32)
        four = c[:-3] | c[1:-2] << np.uint32(8) | c[2:-1] << np.uint32(16) | c[3:] << np.uint32(24)
        found.append((four * np.uint32(2654435761) >> np.uint32(13)) % np.uint32(PART) + np.uint32(2 * PART))
    words = low.split()
    if words:
        own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        pairs = (own[:-1] * np.uint32(31) + own[1:]) * np.uint32(2654435761)
        found += [(h >> np.uint32(13)) % np.uint32(PART) + np.uint32(PART) for h in (own * np.uint32(2246822519), pairs)]
        words = text.split()
        again = sum(map(operator.eq, words, words[1:]))
        swapped = sum(map(operator.eq, words, words[2:]))
        # how often a word is followed by itself, at once or after another: once, twice, 4 times ...; in so many of 2, 4, 8 ... words
        for at, n in ((1, again), (17, swapped)):
            found.append(np.arange(at, at + min(n.bit_length(), 8), dtype=np.uint32))
            share = min(7, int(math.log2(len(words) / n))) if n else 8
            found.append(np.arange(at + 8 + share, at + 16, dtype=np.uint32))
    return np.unique(np.concatenate(found))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """The log of each indicator's share of its class's counts over its share of the other's; 0 of one that no text has."""
    p, q = np.full(WIDTH, alpha), np.full(WIDTH, alpha)
    for x, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[x] += 1
    seen = p + q > 2 * alpha
    ratios = np.where(seen, np.log(p / p[seen].sum()) - np.log(q / q[seen].sum()), 0.0)
    ratios[PART:] *= CONTENT
    return ratios


def hinge_dual(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float = 0.05, epochs: int = 20, seed: int = 9) -> np.ndarray:
    """Weights of the indicators (their ratios included) that minimise |w|^2 / 2 + c sum of hinge losses."""
    w, alpha, rng = np.zeros(WIDTH), np.zeros(len(rows)), np.random.default_rng(seed)
    values = [r[x] for x in rows]
    norms = np.array([v @ v for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if norms[i] <= 0:
                continue
            x, v = rows[i], values[i]
            new = min(c, max(0.0, alpha[i] - (y[i] * (w[x] @ v) - 1) / norms[i]))
            if new != alpha[i]:
                w[x] += (new - alpha[i]) * y[i] * v
                moved += abs(new - alpha[i])
                alpha[i] = new
        if moved < 1e-4 * c * len(rows):
            break
    return w * r


def _train(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    return hinge_dual(rows, y, log_count_ratios(rows, y))


class QualityModel:
    def __init__(self, weights: np.ndarray, slope: float, shift: float):
        self.weights, self.slope, self.shift = weights.astype(np.float32), slope, shift

    def score(self, text: bytes) -> float:
        z = self.slope * float(self.weights[indicators(text)].sum()) + self.shift
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of label 1 over margins."""
    x = np.stack([np.ones(len(margin)), margin], axis=1)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.1]), x.T @ (y - p) - np.array([0, 0.1]) * beta), -3, 3)
    return float(beta[1]), float(beta[0])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 4000, seed: int = 9) -> QualityModel:
    """Fits on at most `fit_rows` labelled documents, whole texts of any length, whose indicators come to the driver.

    Margins of each half under the other half's model give the curve from margins to scores.
    With labels of one kind or none, every text scores their smoothed rate. Repeated rows of a doc_id
    are texts of their own; other columns than doc_id and text aren't read. A text's indicators are at
    most WIDTH numbers, however long it is.
    """
    own = learnable(labels, "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [indicators(bytes(t.as_buffer())).astype(np.int32) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "label", "found"])

    got = sample(docs, own, fit_rows, seed).mapInArrow(run, "doc_id long, label int, found array<int>").toArrow().sort_by("doc_id")
    y = np.where(got.column("label").to_numpy() > 0, 1, -1)
    rows = [x.values.to_numpy() for x in got.column("found")]
    if len(set(y.tolist())) < 2:
        rate = ((y > 0).sum() + 0.5) / (len(y) + 1)
        return QualityModel(np.zeros(WIDTH), 0.0, math.log(rate / (1 - rate)))
    fold, margin = got.column("doc_id").to_numpy() // 7 % 2, np.zeros(len(y))
    for k in (0, 1):
        learn, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(y[learn].tolist())) == 2:
            w = _train([rows[i] for i in learn], y[learn])
            margin[held] = [w[rows[i]].sum() for i in held]
    slope, shift = _calibrate(margin, (y > 0).astype(float))
    return QualityModel(_train(rows, y), slope, shift)


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null text is empty, and whole texts of any length count.

    The model is of fixed size. Repeated rows get equal scores, an empty table none; other columns aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [held.value.score(bytes(t.as_buffer()) if t.is_valid else b"") for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
