"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glintframe.llm.common import octets
from glintframe.llm.nbsvm import with_labels
from glintframe.session import materialize

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "ѵ": "v", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ø": "o", "đ": "d", "ł": "i", "þ": "p",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i"}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "scum line", "clown fish", "circus clown", "sore loser board")

PREFIX = range(4, 11)  # lengths of word beginnings that may become entries
LEAST_DOCS = 4  # labelled toxic documents that must hold an entry
LEAST_WEIGHT = 2.0  # natural logarithm of the ratio of rates, less one standard error
LEAST_PHRASE = 5  # clean documents that hold a phrase which no toxic one holds, to make it an exception
FLUSH = 300_000  # candidates that a task counts before it sends the counts on
SAMPLE = 20_000  # labelled documents that the calibration is fitted on


class _Fold(dict):
    """Character table of ``str.translate``: lower case, look-alikes and digits to letters, marks off, the rest a space."""

    def __missing__(self, code: int) -> str:
        out = "".join(HOMOGLYPHS.get(c, c) for c in chr(code).casefold())
        out = "".join(HOMOGLYPHS.get(c, c) for c in unicodedata.normalize("NFKD", out))
        kinds = [(c, unicodedata.category(c)[0]) for c in out]
        if any(k == "M" for _, k in kinds) and all(k == "M" for _, k in kinds):
            folded = ""
        else:
            folded = "".join(DIGITS.get(c, c) for c, k in kinds if k in "LN" or c in DIGITS) or " "
        self[code] = folded
        return folded


_fold = _Fold()


def fold(text: str) -> list[str]:
    """Words of the text after folding."""
    return text.translate(_fold).split()


def terms(words: list[str]) -> Counter:
    """Candidates of the lexicon, whole words as ``" word "`` and word beginnings as ``" word"``: how many different
    words each stands for. The empty candidate stands for all of them."""
    different = set(words)
    out = Counter(f" {w[:n]}" for w in different for n in PREFIX if n <= len(w))
    out.update(f" {w} " for w in different)
    out[""] = len(different)
    return out


_TERM = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64()), ("docs", pa.int64())])
_TERM_DDL = "term string, toxic long, clean long, docs long"


def _tallied(labelled: DataFrame, of) -> DataFrame:
    """Counts ``of(words)`` in toxic and in clean documents, and the toxic documents, over all labelled rows ``(text, label)``."""

    def run(batches):
        n, docs = (Counter(), Counter()), Counter()

        def flush():
            both = list(n[0] | n[1])
            out = pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *[pa.array([x[t] for t in both], pa.int64()) for x in (n[1], n[0], docs)]], schema=_TERM)
            for x in (*n, docs):
                x.clear()
            return out

        for b in batches:
            for text, label in zip(octets(b.column(0)), b.column(1).to_pylist()):
                found = of(fold(text.decode()))
                n[label].update(found)
                if label:
                    docs.update(found.keys())
            if len(n[0]) + len(n[1]) >= FLUSH:
                yield flush()
        yield flush()

    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label")).mapInArrow(run, _TERM_DDL)
    return rows.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "docs")])


@dataclass
class Lexicon:
    """Weights of entries (with their word boundaries as spaces), exception phrases, and the curve of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-3.0, 1.0, 1.0)
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_machine": None}

    def machine(self):
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._machine.add_word(entry, (len(entry), weight, entry))
            for phrase in self.exceptions:
                self._machine.add_word(phrase, (len(phrase), 0.0, phrase))
            self._machine.make_automaton()
        return self._machine

    def matches(self, words: list[str]) -> list[tuple[int, int, str, float]]:
        """``(start, end, entry, weight)`` of entries outside exception phrases, the heaviest of those in one place."""
        if not (self.weights or self.exceptions):
            return []
        spared, found = [], {}
        for end, (size, weight, entry) in self.machine().iter(f" {' '.join(words)} "):
            start = end + 1 - size
            if not weight:
                spared.append((start, end))
            elif start not in found or weight > found[start][3]:
                found[start] = (start, end, entry, weight)
        return [m for m in found.values() if not any(a <= m[0] and m[1] <= b + 1 for a, b in spared)]

    def measures(self, text: str) -> tuple[float, float]:
        """Logarithms of the summed weights, as they are and for each hundred words."""
        words = fold(text)
        total = sum(m[3] for m in self.matches(words))
        return math.log1p(total), math.log1p(100 * total / max(1, len(words)))

    def score(self, text: str) -> float:
        a, b, c = self.curve
        x, y = self.measures(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def select_entries(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries from counts ``(term, toxic, clean)``: short ones first, longer ones only if they weigh clearly more.

    A short entry is then drawn out to the longest one that stands for nine tenths of its words.
    """
    weights, longest = {}, {}
    counts = {term: a for term, a, _ in rows}
    for term, a in counts.items():
        word = term.rstrip()
        if word == term or len(word) > PREFIX[-1] + 1:
            for short in (term[:n + 1] for n in PREFIX if n + 1 <= len(word)):
                if a >= 0.9 * counts.get(short, a + 1) and len(term) > len(longest.get(short, short)):
                    longest[short] = term
    for term, a, b in rows:
        weight = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)) - math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if weight >= LEAST_WEIGHT:
            weights[term] = (weight, a)
    out: dict[str, float] = {}
    for term in sorted(weights, key=lambda t: (len(t), t)):
        wider = [out[term[:n + 1]] for n in PREFIX if n + 1 < len(term) and term[:n + 1] in out]
        if weights[term][0] > 1.3 * max(wider, default=0):
            out[term] = round(weights[term][0], 6)
    return {longest.get(t, t): out[t] for t in sorted(out)}


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    theta, prior = np.zeros(x.shape[1]), 0.05 * np.diag([0.01, 1, 1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        theta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior + 1e-9 * np.eye(3), x.T @ (p - y) + prior @ theta)
    return theta


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, sample: int = SAMPLE) -> Lexicon:
    """Lexicon, exception phrases and curve from the documents with a row in ``labels (doc_id, label)`` with label 0 or 1.

    The counts of entries and phrases cover every row, and every entry and phrase with the evidence is kept: the
    driver holds them all, whose number grows with the vocabulary. The curve's three numbers are fitted on at most
    ``sample`` rows, those with the smallest hash of their id. Without toxic rows the lexicon is empty and every
    score near 0.
    """
    labels = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    labelled = with_labels(docs, labels)
    counted = materialize(_tallied(labelled, terms).where(F.col("docs") >= LEAST_DOCS))
    whole = counted.where("term = ''").first()
    toxic, clean = (whole.toxic, whole.clean) if whole else (0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    likely = counted.where((F.col("term") != "") & (odds - error >= LEAST_WEIGHT - 0.25))  # drawn-out entries may weigh a little less
    weights = select_entries([(r.term, r.toxic, r.clean) for r in likely.collect()], toxic, clean)
    spared = tuple(f" {' '.join(fold(x))} " for x in exceptions)
    bare = Lexicon(weights, spared)

    def phrases(words):
        """Two-word phrases around the matched words."""
        line = f" {' '.join(words)} "
        out = Counter()
        for start, *_ in bare.matches(words):
            i = line.count(" ", 0, start + 1) - 1
            out.update(f" {' '.join(words[j:j + 2])} " for j in (i - 1, i) if 0 <= j < len(words) - 1)
        return Counter(dict.fromkeys(out, 1))

    harmless = _tallied(labelled, phrases).where((F.col("clean") >= LEAST_PHRASE) & (F.col("toxic") == 0))
    spared += tuple(r.term for r in harmless.orderBy("term").collect())
    lexicon = Lexicon(weights, spared)
    picked = with_labels(docs, labels.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample))
    x = _measured(picked.select("text", "label"), lexicon).collect()
    x.sort(key=lambda r: (r.label, r.total, r.density))
    if any(r.label for r in x) and not all(r.label for r in x):
        lexicon.curve = tuple(_logistic(np.array([(r.total, r.density) for r in x]), np.array([float(r.label) for r in x])).tolist())
    else:
        lexicon.curve = (30.0 if x and x[0].label else -30.0, 0.0, 0.0)
    return lexicon


def _measured(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    schema = pa.schema([("label", pa.int32()), ("total", pa.float64()), ("density", pa.float64())])

    def run(batches):
        for b in batches:
            m = [lexicon.measures(x.decode()) for x in octets(b.column(0))]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x for x, _ in m], pa.float64()), pa.array([y for _, y in m], pa.float64())], schema=schema)

    return rows.select(F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label")).mapInArrow(run, "label int, total double, density double")


_SCORE = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(doc_id, score)`` of every document, from its text alone; null and empty texts match nothing."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lexicon.score(x.decode()) for x in octets(b.column(1))], pa.float64())], schema=_SCORE)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
