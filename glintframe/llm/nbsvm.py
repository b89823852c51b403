"""Quality classifier: naive Bayes support vectors on n-gram indicators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from glintframe.llm.common import octets, partitions, remainder, sole_memory

BITS = 18  # features are hashed to so many bits
SAMPLE = 8000  # labelled documents that the hinge-loss model is fitted on; all of them count for the ratios
SMOOTH = 1.0
COST = 1.0
EPOCHS = 12
MIX = 0.9  # share of the fitted weights against their mean size
HELD = 5  # every so many-th sampled document is kept from the fit to calibrate the scores
THRESHOLD = 0.3
BROADCAST_ROWS = 1_000_000
_CHUNK = 1 << 12
_MEMORY = 100_000  # words whose codes a worker remembers

_CLASS = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 0x80 else 48 if 48 <= c <= 57 else c for c in range(256))
_words: dict[bytes, int] = {}


def _shape(word: bytes) -> bytes:
    """Kinds of the word's characters, runs shortened to two."""
    out = bytearray()
    for c in word.translate(_CLASS):
        if len(out) < 2 or not out[-1] == out[-2] == c:
            out.append(c)
    return bytes(out[:12])


def _code(word: bytes) -> int:
    """Hashes of the word's shape (high half) and of the word in lower case (low half)."""
    known = _words.get(word)
    if known is None:
        if len(_words) >= _MEMORY:
            _words.clear()
        known = _words[word] = xxhash.xxh32_intdigest(_shape(word)) << 32 | xxhash.xxh32_intdigest(word.lower())
    return known


def _mixed(x: np.ndarray, y: np.ndarray, salt: int) -> np.ndarray:
    return (x * np.uint64(0x9E3779B97F4A7C15) ^ (y + np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9)


def features(text: bytes) -> np.ndarray:
    """Hashed indicators: words and pairs of words, and runs of one to three word shapes with a mark for a repeated word."""
    words = text.split()
    if not words:
        return np.empty(0, np.int32)
    code = np.fromiter(map(_code, words), np.uint64, len(words))
    word = code & np.uint64(0xFFFFFFFF)
    shape = code >> np.uint64(32)
    shape[1:] += (word[1:] == word[:-1]).astype(np.uint64) * np.uint64(0x5BD1E995)
    two = _mixed(shape[:-1], shape[1:], 3)
    grams = [_mixed(word, word, 1), _mixed(word[:-1], word[1:], 2), _mixed(shape, shape, 4), two, _mixed(two[:-1], shape[2:], 5)]
    return np.unique(np.concatenate([(g >> np.uint64(64 - BITS)).astype(np.int32) for g in grams]))


def _indicators(docs: DataFrame, extra: list[str]) -> DataFrame:
    schema = pa.schema([("grams", pa.binary()), *[(c, pa.int64()) for c in extra]])

    def run(batches):
        for b in batches:
            cols = [pa.array([features(x).tobytes() for x in octets(b.column(0))], pa.binary()), *b.columns[1:]]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    ddl = ", ".join(["grams binary", *[f"{c} long" for c in extra]])
    return docs.select(F.col("text").cast("string").alias("text"), *[F.col(c).cast("long").alias(c) for c in extra]).mapInArrow(run, ddl)


def _count(batches):
    """Documents of either class that hold each feature, summed over the task; a row for each stretch of features."""
    sole_memory("nbsvm", _words.clear)
    held = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for text, label in zip(octets(batch.column(0)), batch.column(1).to_pylist()):
            held[label, features(text)] += 1
    if held.any():
        for i in range(0, 1 << BITS, _CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([held[:, i:i + _CHUNK].tobytes()], pa.binary())], names=["at", "counts"])


def _add(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(x, np.int64).reshape(2, -1)
            total[i] = total[i] + x if i in total else x
    for i, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["at", "counts"])


def ratios(labelled: DataFrame, smooth: float = SMOOTH) -> np.ndarray:
    """Log-count ratio of every feature over all labelled rows ``(text, label)``; of fixed length, so safe to gather."""
    parts = labelled.select(F.col("text").cast("string"), F.col("label").cast("int")).mapInArrow(_count, "at long, counts binary")
    total = np.zeros((2, 1 << BITS))
    for row in parts.repartition(partitions(labelled), "at").mapInArrow(_add, "at long, counts binary").collect():
        total[:, row.at:row.at + _CHUNK] = np.frombuffer(row.counts, np.int64).reshape(2, -1)
    p, q = total[1] + smooth, total[0] + smooth
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    r[total.sum(axis=0) < 2] = 0  # one document says nothing
    return r


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model by dual coordinate descent.

    ``rows`` hold indicator indices, scaled by ``scale`` and brought to unit length, with a constant feature for the
    bias. Each step solves one document's dual variable exactly within [0, cost]; the primal weights follow.
    """
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    norm = np.array([np.sqrt((scale[i] ** 2).sum()) or 1.0 for i in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i = rows[k]
            x = scale[i] / norm[k]
            gradient = y[k] * (w[i] @ x + bias) - 1
            new = min(max(alpha[k] - gradient / (x @ x + 1), 0.0), cost[k])
            step = (new - alpha[k]) * y[k]
            if step:
                w[i] += step * x
                bias += step
                alpha[k] = new
    return w, bias


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of the labels over the margins, by Newton steps with a light prior."""
    t = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y <= 0) + 2))
    theta, x = np.zeros(2), np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta -= np.linalg.solve(h, x.T @ (p - t) + 1e-3 * theta)
    return float(theta[0]), float(theta[1])


@dataclass
class Model:
    """Scaled weights by feature, squared ratios for the length of a document, bias and calibration."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    intercept: float

    def margin(self, grams: np.ndarray) -> float:
        return float(self.weights[grams].sum() / (np.sqrt(self.squares[grams].sum()) or 1.0) + self.bias)

    def score(self, grams: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(grams) + self.intercept, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cost: float = COST, mix: float = MIX) -> Model:
    """Fit on the documents with a row in ``labels (doc_id, label)`` with label 0 or 1.

    The ratios count every such document. The hinge-loss model sees at most ``sample`` of them, those with the
    smallest hash of their id, each of at most 2^18 indices; both classes weigh the same there. Without documents of
    both classes every document gets the share of label 1 (1 without any).
    """
    labels = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    r = ratios(with_labels(docs, labels))
    picked = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = _indicators(with_labels(docs, picked).withColumn("key", F.xxhash64("doc_id")), ["label", "key"]).collect()
    rows.sort(key=lambda x: (x.key, x.grams))
    y = np.array([1 if x.label else -1 for x in rows])
    if not (y > 0).any() or not (y < 0).any():
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, 30.0 if not len(y) or y[0] > 0 else -30.0)
    grams = [np.frombuffer(x.grams, np.int32) for x in rows]
    held = np.zeros(len(y), bool)
    for label in (1, -1):
        own = np.flatnonzero(y == label)
        if len(own) >= HELD:
            held[own[::HELD]] = True
    train = np.flatnonzero(~held)
    weigh = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w, bias = descend([grams[i] for i in train], y[train], r, cost * weigh[train])
    w = mix * w + (1 - mix) * np.abs(w).mean()
    model = Model(w * r, r ** 2, bias, 1.0, 0.0)
    use = np.flatnonzero(held) if (y[held] > 0).any() and (y[held] < 0).any() else train
    model.slope, model.intercept = calibrate(np.array([model.margin(grams[i]) for i in use]), y[use])
    return model


_SCORE = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every document from its text alone; null and empty texts have no features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 2^18 numbers

    def run(batches):
        sole_memory("nbsvm", _words.clear)
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(features(x)) for x in octets(b.column(1))], pa.float64())], schema=_SCORE)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text, label)`` of the documents with a label.

    Labels of up to ``BROADCAST_ROWS`` rows, counted first, go to the texts; more of them are joined by a shuffle.
    """
    side = labels.select("doc_id", "label")
    if side.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(side, "doc_id")


def training_labels(labels: DataFrame, label: str, modulus: int = 5) -> DataFrame:
    """``(doc_id, label)`` outside the held-out fold; rows without the label are left out."""
    named = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    return named.where(F.col("label").isNotNull() & (remainder(F.col("doc_id"), modulus) != 0))


def held_out(doc_id: Column, modulus: int = 5) -> Column:
    return remainder(doc_id, modulus) == 0


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, score)`` of every document, learnt from ``labels.quality`` outside the held-out fold."""
    return score(docs, fit(docs, training_labels(labels, "quality")))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that reach the threshold, unchanged. Columns and repeated rows stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, training_labels(labels, "quality")))

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        sole_memory("nbsvm", _words.clear)
        return texts.map(lambda x: shared.value.score(features((x or "").encode())))

    return docs.where(judge(F.col("text").cast("string")) >= threshold)
