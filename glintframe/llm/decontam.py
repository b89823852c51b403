"""Benchmark decontamination: an FM-index over each shard of the training documents, searched for test phrases."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glintframe.llm.common import numbered, octets, sole_memory
from glintframe.session import materialize

WINDOW = 13
SHARD_SYMBOLS = 1 << 19  # symbols of one index
BLOCK_WORDS = 1 << 18  # benchmark words searched in one pass
SAMPLE = 16  # every so many suffix positions are kept

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of any other code points from U+0080 on, ASCII letters in lower case."""
    return text.translate(_LOWER).split()


def windows(item: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    return [tuple(item[i:i + width]) for i in range(max(1, len(item) - width + 1))] if item else []


class WaveletTree:
    """Ranks over a sequence of symbols, as one bit vector for each bit of a symbol (highest first)."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.ones, self.zeros, self.bits = [], [], bits
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(at), at
        for depth in range(self.bits):
            one = ((symbol >> (self.bits - 1 - depth)) & 1).astype(bool)
            a, b = self.ones[depth][low], self.ones[depth][high]
            low = np.where(one, self.zeros[depth] + a, low - a)
            high = np.where(one, self.zeros[depth] + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for depth in range(self.bits):
            ones = self.ones[depth]
            one = ones[at + 1] - ones[at]
            symbol = symbol * 2 + one
            at = np.where(one == 1, self.zeros[depth] + ones[at], at - ones[at])
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes; every 0 ends its segment and sorts by place. Prefix doubling on what is still tied."""
    n = len(text)
    zero = text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + n)
    order = np.argsort(rank, kind="stable")
    step, tied = 1, None
    while True:
        if tied is None:
            places, key = np.arange(n), rank[order]
        else:
            sub = order[tied]
            second = rank[np.minimum(sub + step, n - 1)]
            inner = np.lexsort((second, rank[sub]))
            order[tied] = sub[inner]
            places, key = tied, rank[sub][inner] * (2 * n + 2) + second[inner]
            step *= 2
        # a place's new rank is the first place of its group
        first = np.r_[True, (key[1:] != key[:-1]) | (places[1:] != places[:-1] + 1)]
        start = places[np.flatnonzero(first)]
        group = np.cumsum(first) - 1
        rank[order[places]] = start[group]
        size = np.bincount(group)
        tied = places[size[group] > 1]
        if not len(tied):
            return order


class FMIndex:
    """Backward search and location over segments of symbols from 1 up; a 0 ends every segment.

    Suffix positions are kept at every ``SAMPLE``-th place and at the segments' first symbols, so that the walk back
    from a match never crosses a segment.
    """

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_array(text)
        self.size = len(text)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols + 1))][:symbols + 1]
        self.tree = WaveletTree(text[order - 1], max(1, int(symbols).bit_length()))
        kept = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.kept, self.position = np.r_[0, np.cumsum(kept)], order[kept]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase; the phrases stand at the right end of their rows of the matrix."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for back in range(phrases.shape[1]):
            alive = alive[(low[alive] < high[alive])]
            at = alive[length[alive] > back]
            symbol = phrases[at, phrases.shape[1] - 1 - back]
            low[at] = self.before[symbol] + self.tree.rank(symbol, low[at])
            high[at] = self.before[symbol] + self.tree.rank(symbol, high[at])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: steps back to the nearest kept position."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.arange(len(rows))
        while len(walking):
            at = rows[walking]
            walking = walking[self.kept[at + 1] == self.kept[at]]
            at = rows[walking]
            symbol = self.tree.access(at)
            rows[walking] = self.before[symbol] + self.tree.rank(symbol, at)
            steps[walking] += 1
        return self.position[self.kept[rows]] + steps


class Phrases:
    """The different windows of some benchmark items, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for w in windows(words(text), width):
                owners.setdefault(w, set()).add(item)
        self.vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(x for p in owners for x in p))}
        self.length = np.array([len(p) for p in owners], np.int64)
        self.widest = int(self.length.max(initial=1))
        self.shortest = int(self.length.min(initial=1))
        self.matrix = np.zeros((len(owners), self.widest), np.int32)
        for i, p in enumerate(owners):
            self.matrix[i, self.widest - len(p):] = [self.vocabulary[x] for x in p]
        self.owners = [sorted(x) for x in owners.values()]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans, sorted and joined where they overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_HITS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
                   ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])
_HITS_DDL = "row long, doc_id long, n_words long, spans array<array<long>>, items array<string>"


def _scan(phrases: Phrases):
    """Index shard after shard of the partition's documents, and search all phrases in each.

    A word of no phrase ends a segment, for no phrase runs across it; a segment shorter than the shortest phrase
    holds none and is left out of the text.
    """

    def close(docs, parts):
        spans: list[list] = [[] for _ in docs]
        items: list[set] = [set() for _ in docs]
        if parts:
            text = np.concatenate([x for p in parts for x in (p[2], np.zeros(1, np.int64))])
            size = np.array([len(p[2]) + 1 for p in parts])
            begin = np.r_[0, np.cumsum(size)[:-1]]
            index = FMIndex(text, len(phrases.vocabulary))
            low, high = index.search(phrases.matrix, phrases.length)
            count = high - low
            phrase = np.repeat(np.arange(len(count)), count)
            rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            place = index.locate(rows)
            part = np.searchsorted(begin, place, side="right") - 1
            for p, w, offset in zip(part.tolist(), phrase.tolist(), (place - begin[part]).tolist()):
                doc, start = parts[p][0], parts[p][1] + offset
                spans[doc].append((start, start + int(phrases.length[w])))
                items[doc].update(phrases.owners[w])
        cols = [[d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs], [merge_spans(s) for s in spans], [sorted(i) for i in items]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _HITS)], schema=_HITS)

    def run(batches):
        sole_memory("decontam")
        docs, parts, symbols, known = [], [], 0, phrases.vocabulary.get
        for batch in batches:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), octets(batch.column(2))):
                found = words(text)
                ids = np.fromiter(map(known, found, repeat(0)), np.int64, len(found))
                stop = np.r_[-1, np.flatnonzero(ids == 0), len(ids)]
                long = np.flatnonzero(np.diff(stop) - 1 >= phrases.shortest)
                for i in long.tolist():
                    parts.append((len(docs), int(stop[i]) + 1, ids[stop[i] + 1:stop[i + 1]].copy()))
                    symbols += len(parts[-1][2]) + 1
                docs.append((row, doc_id, len(found)))
                if symbols >= SHARD_SYMBOLS or len(docs) >= 1 << 16:
                    yield close(docs, parts)
                    docs, parts, symbols = [], [], 0
        if docs:
            yield close(docs, parts)

    return run


def _combine(batches):
    for batch in batches:
        spans = [merge_spans([tuple(s) for s in x]) for x in batch.column(3).to_pylist()]
        items = [sorted(set(x)) for x in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, _HITS.field(3).type), pa.array(items, _HITS.field(4).type)], schema=_HITS)


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Word spans of every document in which a window of a benchmark item occurs, merged, and those items.

    Columns ``doc_id, n_words, spans (half-open word positions), items (ids as strings, sorted)``; one row for each
    row of ``docs``. The benchmark is searched in blocks of about ``BLOCK_WORDS`` words, each its own pass, so what
    a task holds of it is bounded; texts stay where they were read and nothing but the result leaves a task.

    Null and empty texts have no words; a null item id counts as the id ``""``; items without words have no window;
    items that repeat count once for each different id; no benchmark leaves all documents without spans; further columns
    are ignored.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return _occurrences(rows, "row", benchmark, width).drop("row")


def _occurrences(docs: DataFrame, row: str, benchmark: DataFrame, width: int) -> DataFrame:
    """``occurrences`` and the ``row`` they belong to, by the column ``row`` of ``docs``."""
    texts = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + total // (4 * BLOCK_WORDS)
    found = None
    for b in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        phrases = Phrases([(r.item, r.text.encode()) for r in mine.collect()], width)
        one = texts.mapInArrow(_scan(phrases), _HITS_DDL)
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        joined = found.groupBy("row", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        found = joined.mapInArrow(_combine, _HITS_DDL)
    return found


def contamination(found: DataFrame) -> DataFrame:
    """``occurrences`` with ``n_hit``, the words inside spans, and ``contaminated``: at least a twentieth of all words."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows that are not contaminated, unchanged; each is judged by itself, whatever its id."""
    rows = materialize(numbered(docs))
    bad = contamination(_occurrences(rows.select("row", "doc.doc_id", "doc.text"), "row", benchmark, width)).where("contaminated").select("row")
    return rows.join(bad, "row", "left_anti").select("doc.*")
