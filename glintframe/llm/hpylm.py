"""Language-model scores from a hierarchical Pitman-Yor model over word pairs, seated by Gibbs sampling.

A restaurant for every context (the word before) serves words; all context restaurants share one parent, the word
restaurant, whose own base is uniform over the vocabulary and one unknown word. A customer of the parent is a table of
a context. The number of context restaurants is fixed (2^20): contexts are hashed to them, so what has to be known
everywhere, customers and tables of each restaurant, has a fixed size. Everything else is dealt by word: a bucket
holds all pairs that end in its words, with their counts and tables, and where they occur.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from glintframe.llm.common import octets, partitions, remainder
from glintframe.llm.seating import draw_tables
from glintframe.session import materialize

CONTEXT_BITS = 20
BUCKET_TOKENS = 2_000_000  # tokens of a bucket, about
BATCH_BYTES = 8 << 20  # text that a task sorts at once
ROUNDS = 2  # Gibbs sweeps; the predictions of all of them are averaged
STRENGTH = (10.0, 1.0)  # of the word restaurant and of the context restaurants
HOT_SHARE = 4  # a word with more than 1 / (4 * buckets) of the sampled tokens is spread over all buckets
FLUSH = 2_000_000  # document sums that a task holds before it sends them on
_CHUNK = 1 << 14
_END = np.uint64(xxhash.xxh64_intdigest(b""))
_START = np.uint64(xxhash.xxh64_intdigest(b" "))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed octet planes."""
    parts = [len(arrays).to_bytes(2, "little")]
    for x in arrays:
        x = np.ascontiguousarray(x)
        parts += [x.dtype.str.encode().ljust(4), len(x).to_bytes(8, "little"), x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    at, out = 2, []
    for _ in range(int.from_bytes(data[:2], "little")):
        kind, n = np.dtype(data[at:at + 4].decode().strip()), int.from_bytes(data[at + 4:at + 12], "little")
        at += 12
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += size
    return out


def bucket_of(word: np.ndarray, context: np.ndarray | None, buckets: int) -> np.ndarray:
    """A word's bucket, or with contexts that of a pair of a word that is spread."""
    x = word if context is None else (word ^ (context.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((x >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


@dataclass
class Known:
    """What every task knows: per round the tables of the contexts, sums over all words, and the words that are spread."""

    buckets: int
    hot: np.ndarray
    n_tokens: int = 0
    n_words: int = 0
    discounts: tuple[float, float] = (0.5, 0.5)
    customers: np.ndarray | None = None
    hot_count: np.ndarray | None = None
    tables: list = field(default_factory=list)  # of each context
    parents: list = field(default_factory=list)  # tables of the word restaurant, all words
    hot_tables: list = field(default_factory=list)
    hot_parents: list = field(default_factory=list)


_ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_ROW_DDL = "bucket int, kind int, key long, a binary, b binary, c binary"
_DOCS, _STATE, _SUM = 0, 1, 2


def _row(bucket, kind, key, a=None, b=None, c=None):
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((bucket, kind, key, a, b, c), _ROW)], schema=_ROW)


def _deal(known: Known):
    """Documents to rows of a bucket: words in order, with their contexts and the documents they stand in."""

    def one(number, ids, train, texts):
        split = [x.lower().split() for x in texts]
        size = np.array([len(x) + 1 for x in split])
        stop = np.cumsum(size) - 1
        w = np.empty(int(size.sum()), np.uint64)
        inner = np.ones(len(w), bool)
        inner[stop] = False
        w[inner] = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split)), np.uint64, len(w) - len(stop))
        w[stop] = _END
        before = np.r_[_START, w[:-1]]
        before[stop[:-1] + 1] = _START
        k = (before >> np.uint64(64 - CONTEXT_BITS)).astype(np.uint32)
        doc = np.repeat(np.arange(len(size), dtype=np.uint32) * 2 + train.astype(np.uint32), size)
        del split, before, inner
        order = np.argsort(w & ~np.uint64((1 << CONTEXT_BITS) - 1) | k)
        w, k, doc = w[order], k[order], doc[order]
        bucket = bucket_of(w, None, known.buckets)
        if len(known.hot):
            run = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            hot = np.repeat(np.isin(w[run], known.hot), np.diff(np.r_[run, len(w)]))
            bucket[hot] = bucket_of(w[hot], k[hot], known.buckets)
            order = np.argsort(bucket.astype(np.uint16 if known.buckets < 1 << 16 else np.uint32), kind="stable")
            w, k, doc, bucket = w[order], k[order], doc[order], bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(w)]):
            run = np.flatnonzero(np.r_[True, w[i + 1:j] != w[i:j - 1]])
            yield _row(int(bucket[i]), _STATE, number, pack(w[i:j][run], np.diff(np.r_[run, j - i]).astype(np.uint32), k[i:j], doc[i:j]))
        yield _row(-1 - number % known.buckets, _DOCS, number, pack(np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], np.uint8), size.astype(np.int64), train.astype(np.uint8)))

    def run(batches):
        number, ids, train, texts, held = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            for i, t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), octets(batch.column(2))):
                ids.append(i), train.append(t), texts.append(x)
                held += len(x) + 16
                if held >= BATCH_BYTES:
                    yield from one(number, ids, np.array(train), texts)
                    number, ids, train, texts, held = number + 1, [], [], [], 0
        if ids:
            yield from one(number, ids, np.array(train), texts)

    return run


class Sums:
    """Sums that go to every task: by stretches of contexts, and one row for all words and the spread ones."""

    def __init__(self, known: Known):
        self.contexts = np.zeros((2, 1 << CONTEXT_BITS), np.int64)
        self.words = np.zeros(6, np.int64)  # words, parent tables, pairs seen once and twice, words of one and of two contexts
        self.hot = np.zeros((2, len(known.hot)), np.int64)
        self.used = False

    def rows(self):
        if self.used:
            for i in range(0, 1 << CONTEXT_BITS, _CHUNK):
                part = self.contexts[:, i:i + _CHUNK]
                if part.any():
                    yield _row(-1, _SUM, i, pack(part.ravel().astype(np.int64)))
            yield _row(-1, _SUM, -1, pack(np.r_[self.words, self.hot.ravel()]))


def _gather(known: Known):
    """Build the state of each bucket of the partition, and sums for the first seating: a table for each pair."""

    def close(bucket, parts, sums):
        word = np.concatenate([p[0] for p in parts])
        size = np.concatenate([p[1] for p in parts])
        words, place = np.unique(word, return_inverse=True)
        k = np.concatenate([p[2] for p in parts])
        key = np.repeat(place.astype(np.uint64) << np.uint64(CONTEXT_BITS), size) | k
        where = np.concatenate([p[3].astype(np.uint64) | np.uint64(i << 32) for i, p in enumerate(parts)])
        order = np.argsort(key)
        key, where = key[order], where[order]
        run = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.add.reduceat((where & np.uint64(1)).astype(np.int64), run)
        at, context = (key[run] >> np.uint64(CONTEXT_BITS)).astype(np.uint32), (key[run] & np.uint64((1 << CONTEXT_BITS) - 1)).astype(np.uint32)
        total = np.bincount(at, count, len(words)).astype(np.int64)
        kinds = np.bincount(at[count > 0], minlength=len(words))
        sums.used = True
        sums.contexts[0] += np.bincount(context, count, 1 << CONTEXT_BITS).astype(np.int64)
        sums.contexts[1] += np.bincount(context[count > 0], minlength=1 << CONTEXT_BITS)
        hot = np.isin(words, known.hot)
        sums.words += [int((total[~hot] > 0).sum()), int((kinds[~hot] > 0).sum()), int((count == 1).sum()), int((count == 2).sum()), int((kinds[~hot] == 1).sum()), int((kinds[~hot] == 2).sum())]
        i = np.searchsorted(known.hot, words[hot])
        sums.hot[0, i] += total[hot]
        sums.hot[1, i] += kinds[hot]
        batches = np.array([p[4] for p in parts], np.int64)
        return _row(bucket, _STATE, 0, pack(words, total), pack(at, context, count.astype(np.uint32)), pack(batches, np.diff(np.r_[run, len(key)]).astype(np.uint32), where))

    def run(rows):
        sums, bucket, parts = Sums(known), None, []
        for batch in rows:
            for r in batch.to_pylist():
                if r["kind"] == _DOCS:
                    yield _row(r["bucket"], _DOCS, r["key"], r["a"])
                    continue
                if r["bucket"] != bucket:
                    if parts:
                        yield close(bucket, parts, sums)
                    bucket, parts = r["bucket"], []
                parts.append((*unpack(r["a"]), r["key"]))
        if parts:
            yield close(bucket, parts, sums)
        yield from sums.rows()

    return run


def _add(rows):
    total: dict[int, np.ndarray] = {}
    for batch in rows:
        for r in batch.to_pylist():
            x, = unpack(r["a"])
            total[r["key"]] = total[r["key"]] + x if r["key"] in total else x
    for key, x in total.items():
        yield _row(-1, _SUM, key, pack(x))


def _collect_sums(rows: DataFrame, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    contexts, words, hot = np.zeros((2, 1 << CONTEXT_BITS), np.int64), np.zeros(6, np.int64), np.zeros((2, len(known.hot)), np.int64)
    for r in rows.where(F.col("kind") == _SUM).repartition(partitions(rows), "key").mapInArrow(_add, _ROW_DDL).collect():
        x, = unpack(r.a)
        if r.key < 0:
            words, hot = x[:6], x[6:].reshape(2, -1)
        else:
            contexts[:, r.key:r.key + _CHUNK] = x.reshape(2, -1)
    return contexts, words, hot


class Bucket:
    """Seating of one bucket, brought from round to round."""

    def __init__(self, number: int, a: bytes, b: bytes, known: Known):
        self.known, self.round = known, 0
        self.words, self.total = unpack(a)
        self.at, self.context, count = unpack(b)
        self.count = count.astype(np.int64)
        self.rng = np.random.default_rng([7, number])
        self.hot = np.isin(self.words, known.hot)
        self.slot = np.searchsorted(known.hot, self.words[self.hot])
        self.total[self.hot] = known.hot_count[self.slot]
        self.tables = np.minimum(self.count, 1).astype(np.float64)
        self.many = np.flatnonzero(self.count > 1)
        self._sum()
        self.parents = np.minimum(self.own, 1.0)

    def _sum(self):
        self.own = np.bincount(self.at, self.tables, len(self.words))

    def word_probability(self) -> np.ndarray:
        """Of every word in the word restaurant, after the round's sums are known."""
        x, r = self.known, self.round
        own, parents = self.own.copy(), self.parents.copy()
        own[self.hot], parents[self.hot] = x.hot_tables[r][self.slot], x.hot_parents[r][self.slot]
        return (own - x.discounts[0] * parents + (STRENGTH[0] + x.discounts[0] * x.parents[r]) / (x.n_words + 1)) / (STRENGTH[0] + float(x.tables[r].sum()))

    def probability(self) -> np.ndarray:
        """Of every pair, its word after its context."""
        x, r = self.known, self.round
        d, s = x.discounts[1], STRENGTH[1]
        return (self.count - d * self.tables + (s + d * x.tables[r][self.context]) * self.word_probability()[self.at]) / (s + x.customers[self.context])

    def sweep(self):
        """Draw the tables of every dish from their exact conditional, given the other tables of the round before."""
        x, i = self.known, self.many
        others = np.maximum(x.tables[self.round][self.context[i]] - self.tables[i], 0)
        base = self.word_probability()
        self.tables[i] = draw_tables(self.count[i], base[self.at[i]], others, STRENGTH[1], x.discounts[1], self.rng)
        self._sum()
        rest = np.maximum(x.parents[self.round] - self.parents, 0)
        self.parents = draw_tables(self.own.astype(np.int64), np.full(len(self.words), 1 / (x.n_words + 1)), rest, STRENGTH[0], x.discounts[0], self.rng)
        self.round += 1


def _sweeps(shared, rounds: int):
    def run(rows):
        known = shared.value
        sums = Sums(known)
        for batch in rows:
            for r in batch.to_pylist():
                b = Bucket(r["bucket"], r["a"], r["b"], known)
                for _ in range(rounds):
                    b.sweep()
                sums.used = True
                sums.contexts[1] += np.bincount(b.context, b.tables, 1 << CONTEXT_BITS).astype(np.int64)
                sums.words[1] += int(b.parents[~b.hot].sum())
                sums.hot[1, b.slot] += b.own[b.hot].astype(np.int64)
        yield from sums.rows()

    return run


_PART = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("a", pa.binary())])
_PART_DDL = "batch long, kind int, a binary"


def _score(shared, rounds: int):
    """Sums over the tokens of each document, as far as they stand in the buckets of the task."""

    def run(rows):
        known = shared.value
        floor = known.n_tokens + known.n_words + 1
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush():
            for batch, x in held.items():
                doc, place = np.unique(np.concatenate([y[0] for y in x]), return_inverse=True)
                add = [np.bincount(place, np.concatenate([y[i] for y in x]), len(doc)) for i in (1, 2, 3)]
                packed = pack(doc.astype(np.uint32), add[0].astype(np.uint32), add[1], add[2])
                yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([_SUM], pa.int32()), pa.array([packed], pa.binary())], schema=_PART)

        for batch in rows:
            for r in batch.to_pylist():
                b = Bucket(r["bucket"], r["a"], r["b"], known)
                p = np.zeros(len(b.at))
                for _ in range(rounds):
                    b.sweep()
                    p += b.probability() / rounds
                batches, size_of, where = unpack(r["c"])
                log_p, base, seen = np.log10(p), np.log10((b.total + 1) / floor)[b.at], (b.total > 0)[b.at].astype(np.float64)
                pair = np.repeat(np.arange(len(size_of)), size_of)
                part, doc = (where >> np.uint64(32)).astype(np.int64), (where & np.uint64(0xFFFFFFFF)).astype(np.int64) >> 1
                width = int(doc.max()) + 1
                key = part * width + doc
                n = np.bincount(key, minlength=len(batches) * width)
                sums = [np.bincount(key, x[pair], len(n)) for x in (seen, base, log_p)]
                there = np.flatnonzero(n)
                cut = np.searchsorted(there, np.arange(len(batches) + 1) * width)
                for i, number in enumerate(batches.tolist()):
                    mine = there[cut[i]:cut[i + 1]]
                    held.setdefault(number, []).append([mine - i * width, *[s[mine] for s in sums]])
                size += len(there)
                if size >= FLUSH:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _finish(rows):
    """Batch by batch: the documents first, then their sums."""
    number, docs, total = None, None, None

    def close():
        ids, missing, size, train = docs
        cols = [pa.array(ids, mask=missing.astype(bool)), pa.array(train == 0), pa.array(size), pa.array(np.rint(total[0]).astype(np.int64)), pa.array(total[1]), pa.array(total[2])]
        return pa.RecordBatch.from_arrays(cols, schema=_RESULT)

    for batch in rows:
        for r in batch.to_pylist():
            if r["kind"] == _DOCS:
                if docs is not None:
                    yield close()
                number, docs = r["batch"], unpack(r["a"])
                total = np.zeros((3, len(docs[0])))
            elif r["batch"] == number:
                doc, *add = unpack(r["a"])
                for i in range(3):
                    total[i, doc] += add[i]
    if docs is not None:
        yield close()


def _count_words(batches):
    """The most frequent words of sampled documents, and all their tokens (as the end of a text)."""
    for batch in batches:
        n: dict[bytes, int] = {}
        total = 0
        for x in octets(batch.column(0)):
            for w in x.lower().split():
                n[w] = n.get(w, 0) + 1
                total += 1
        top = sorted(n.items(), key=lambda x: -x[1])[:4096]
        yield pa.RecordBatch.from_arrays([pa.array([(xxhash.xxh64_intdigest(w) ^ 1 << 63) - (1 << 63) for w, _ in top] + [0], pa.int64()), pa.array([c for _, c in top] + [0], pa.int64()),
                                          pa.array([0] * len(top) + [total], pa.int64())], names=["word", "n", "total"])


def _plan(docs: DataFrame) -> Known:
    """Number of buckets from the length of all texts, and the words to spread from a sixty-fourth of the documents.

    Both only say where tokens are dealt; the model is the same for any choice.
    """
    octet = F.octet_length(F.col("text").cast("string"))
    buckets = max(partitions(docs), 1 + (docs.agg(F.sum(octet)).first()[0] or 0) // (6 * BUCKET_TOKENS))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(64)) == 0).select(F.col("text").cast("string"))
    counts = some.mapInArrow(_count_words, "word long, n long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    rows = counts.orderBy(F.desc(F.col("n") + F.col("total"))).limit(HOT_SHARE * buckets + 1).collect()
    total = sum(r.total for r in rows)
    hot = [np.uint64(r.word & (1 << 64) - 1) for r in rows if r.n and r.n * HOT_SHARE * buckets > total]
    return Known(int(buckets), np.unique(np.array([*hot, _END], np.uint64)))


def scores(docs: DataFrame, train_fold=None, rounds: int = ROUNDS) -> DataFrame:
    """Log10 probability of every document under a model learnt from those in the training fold.

    ``train_fold`` is a boolean column (default: crc32 of the id modulo 7 is not 2). Columns ``doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score``; ``base_score`` is that of add-one word counts. Tokens are
    lower-cased runs of anything but ASCII white space and one end for each text.

    All tokens are sorted by word and context once and dealt to buckets of words; words that would crowd a bucket are
    spread pair by pair. Each round seats every bucket's customers given the sums of the round before, and only sums
    of fixed size are gathered. Predictions are averaged over the rounds.

    Null and empty texts are the end alone; a null id counts as an empty text in the fold; repeated rows are documents
    of their own; without training documents every token has the uniform probability; further columns are ignored; no
    rows give no rows.
    """
    fold = remainder(F.col("doc_id"), 7) != 2 if train_fold is None else train_fold
    spark = docs.sparkSession
    known = _plan(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("train"), F.col("text").cast("string").alias("text"))
    n = partitions(docs)
    dealt = rows.mapInArrow(_deal(known), _ROW_DDL).repartition(n, "bucket").sortWithinPartitions("bucket", "key")
    state = materialize(dealt.mapInArrow(_gather(known), _ROW_DDL))
    contexts, words, hot = _collect_sums(state, known)
    known.customers, known.hot_count = contexts[0].astype(np.int32), hot[0]
    known.n_tokens = int(contexts[0].sum())
    known.n_words = int(words[0] + (hot[0] > 0).sum())
    share = lambda a, b: float(np.clip(a / max(1, a + 2 * b), 0.05, 0.95))
    known.discounts = share(int(words[4]), int(words[5])), share(int(words[2]), int(words[3]))
    known.tables.append(contexts[1].astype(np.int32))
    known.hot_tables.append(hot[1]), known.hot_parents.append(np.minimum(hot[1], 1))
    known.parents.append(int(words[1] + (hot[1] > 0).sum()))
    buckets = state.where(F.col("kind") == _STATE)
    rng = np.random.default_rng(11)
    for r in range(1, rounds + 1):
        shared = spark.sparkContext.broadcast(known)
        contexts, words, hot = _collect_sums(buckets.select("bucket", "kind", "key", "a", "b").mapInArrow(_sweeps(shared, r), _ROW_DDL), known)
        known.tables.append(contexts[1].astype(np.int32))
        known.hot_tables.append(hot[1])
        known.hot_parents.append(draw_tables(hot[1], np.full(len(known.hot), 1 / (known.n_words + 1)), np.full(len(known.hot), known.parents[-1], np.float64), STRENGTH[0], known.discounts[0], rng))
        known.parents.append(int(words[1] + known.hot_parents[-1].sum()))
    shared = spark.sparkContext.broadcast(known)
    parts = buckets.mapInArrow(_score(shared, rounds), _PART_DDL)
    texts = state.where(F.col("kind") == _DOCS).select(F.col("key").alias("batch"), "kind", "a")
    placed = parts.unionByName(texts).repartition(n, "batch").sortWithinPartitions("batch", "kind")
    found = placed.mapInArrow(_finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("train_tokens", F.lit(known.n_tokens).cast("long"))
