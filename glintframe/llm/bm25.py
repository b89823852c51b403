"""Exact top-k search by BM25: an inverted index for each shard, like queries scored together, and an exact merge."""

from __future__ import annotations

import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from glintframe.llm.common import octets, partitions, sole_memory
from glintframe.llm.decontam import words
from glintframe.llm.hpylm import pack, unpack
from glintframe.session import materialize

K1, B = 1.2, 0.75
TOP = 10
SHARD_DOCS = 1 << 14
SHARD_WORDS = 1 << 23
SCORES = 1 << 21  # scores held at a time
CELLS = 1 << 16  # of them summed from lists at a time
BLOCK = 1 << 11  # documents scored at a time
COMMON = 1 / 300  # terms that more than this share of all pairs of a document and a query have are multiplied, others are listed
TABLE = 1 << 10  # terms multiplied
FEATURES = 512  # the most asked terms, by which documents and queries are grouped
GROUPS, ROUNDS = 8, 8
FEW = 64  # a group has a 64th of the texts at least
PART = 1 << 13  # queries of a group scored at a time, numbered in 16 bits
TASK_TERMS = 8 << 20  # terms of all queries that a task holds
MET = 8  # words of documents that a task meets for each of them, at least
ROW_TERMS = 1 << 20  # terms of queries in a row
WAITING = 1 << 22  # documents that wait for their exact scores
DIGITS = 6  # of a score
HALF = 10.0 ** -DIGITS  # rounding moves a score by less

_INDEX = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_words", pa.int64()), ("docs", pa.binary()), ("terms", pa.binary()), ("postings", pa.binary())])
_INDEX_DDL = "shard long, n_docs long, n_words long, docs binary, terms binary, postings binary"


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the words of each text."""
    split = [words(x) for x in texts]
    size = np.array([len(x) for x in split], np.int64)
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split)), np.uint64, int(size.sum())), size


def _build(batches):
    number, ids, held, sizes, n = TaskContext.get().partitionId() << 32, [], [], [], 0

    def close():
        size = np.concatenate(sizes)
        term = np.concatenate(held)
        doc = np.repeat(np.arange(len(size), dtype=np.uint32), size)
        order = np.argsort(term, kind="stable")
        term, doc = term[order], doc[order]
        run = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]) if len(term) else np.empty(0, np.int64)
        tf = np.diff(np.r_[run, len(term)]).astype(np.uint32)
        term, doc = term[run], doc[run]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else run
        row = (number, len(size), int(size.sum()), pack(np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], np.uint8), size),
               pack(term[first], np.diff(np.r_[first, len(term)]).astype(np.uint32)), pack(doc, tf))
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _INDEX)], schema=_INDEX)

    for batch in batches:
        ids_, texts = batch.column(0).to_pylist(), octets(batch.column(1))
        for i in range(0, len(texts), 512):
            h, size = _hashes(texts[i:i + 512])
            ids += ids_[i:i + 512]
            held.append(h), sizes.append(size)
            n += len(h)
            if len(ids) >= SHARD_DOCS or n >= SHARD_WORDS:
                yield close()
                number, ids, held, sizes, n = number + 1, [], [], [], 0
    if ids:
        yield close()


def build_index(docs: DataFrame) -> DataFrame:
    """The inverted index, a row for each shard: documents with their lengths, terms with their frequencies, postings.

    Shards are cut from the documents where they are read, at ``SHARD_DOCS`` documents or ``SHARD_WORDS`` words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(_build, _INDEX_DDL))


def _frequencies(batches):
    for batch in batches:
        for data in batch.column(0).to_pylist():
            term, df = unpack(data)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(df.astype(np.int64))], names=["term", "df"])


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs, one run after the other."""
    end = np.cumsum(size)
    at = np.repeat(start - end + size, size)
    at += np.arange(len(at))
    return at


def _centres(looks: np.ndarray) -> np.ndarray:
    """Centres of groups of like texts: spherical k-means that starts from the texts least like each other."""
    known = looks.any(axis=1)
    some = looks if known.all() else looks[known]
    if not len(some):
        return np.zeros((1, looks.shape[1]), np.float32)
    near, centres = some @ _unit(some.mean(axis=0, keepdims=True))[0], some[:0]
    while len(centres) < GROUPS:
        centres = np.vstack([centres, some[near.argmin()]])
        near = np.maximum(near, some @ centres[-1]) if len(centres) > 1 else some @ centres[0]
    for _ in range(ROUNDS):
        group = (some @ centres.T).argmax(axis=1)
        large = np.flatnonzero(np.bincount(group) * FEW >= len(some))  # few texts far from all others are no group
        centres = _unit(np.stack([(group == g).astype(np.float32) @ some for g in large]))
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), np.float32(1e-9))[:, None]
    return x


class Asked:
    """The queries of a task in memory, in parts of like queries."""

    def __init__(self, rows: list[bytes], n_docs: int, top: int):
        query, ask, size, code, term, df = zip(*map(unpack, rows))
        self.terms, first = np.unique(np.concatenate(term), return_index=True)
        code = np.concatenate([np.searchsorted(self.terms, t).astype(np.int32)[c] for t, c in zip(term, code)])
        often = np.argsort(-np.bincount(code, minlength=len(self.terms)), kind="stable")
        self.code = np.empty(len(often), np.int32)  # of each term; the most asked have the smallest
        self.code[often] = np.arange(len(often))
        code, df = self.code[code], np.concatenate(df)[first[often]]
        self.idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        query, ask, size = np.concatenate(query), np.concatenate(ask), np.concatenate(size).astype(np.int64)
        looks = self.looks(np.repeat(np.arange(len(size), dtype=np.int32), size), code, len(size))
        self.centres = _centres(looks)
        group, start, self.parts = (looks @ self.centres.T).argmax(axis=1), np.cumsum(size) - size, []
        for g in range(len(self.centres)):
            own = np.flatnonzero(group == g)
            for q in np.array_split(own, -(-len(own) // PART)) if len(own) else ():
                self.parts.append(Part(g, query[q], ask[q], size[q], code[_runs(start[q], size[q])], len(self.terms), top))

    def looks(self, text: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
        """The most asked terms of ``n`` texts, weighed, as vectors of length 1."""
        text, code = text[code < FEATURES], code[code < FEATURES]
        x = np.zeros((n, FEATURES), np.float32)
        x[text, code] = self.idf[code]
        return _unit(x)


class Shard:
    """A shard in memory: documents by group, and what each of their asked terms adds to a score."""

    def __init__(self, asked: Asked, docs: bytes, terms: bytes, postings: bytes, mean_length: float):
        ids, missing, length = unpack(docs)
        term, df = unpack(terms)
        doc, tf = unpack(postings)
        n = len(ids)
        at = np.minimum(np.searchsorted(asked.terms, term), len(asked.terms) - 1)
        known = asked.terms[at] == term
        stay = np.repeat(known, df)
        code, doc, tf = np.repeat(asked.code[at[known]], df[known]), doc[stay], tf[stay]
        group = (asked.looks(doc, code, n) @ asked.centres.T).argmax(axis=1)
        order = np.argsort(group, kind="stable")
        place = np.empty(n, np.uint16 if n <= 1 << 16 else np.uint32)
        place[order] = np.arange(n)
        doc = place[doc]
        by = np.argsort(doc, kind="stable")
        doc, tf, self.code = doc[by], tf[by].astype(np.float64), code[by]
        norm = K1 * (1 - B + B * length[order] / (mean_length or 1.0))
        self.weight = tf * (K1 + 1) / (tf + norm[doc]) * asked.idf[self.code]
        self.start = np.r_[0, np.cumsum(np.bincount(doc, minlength=n))]
        self.ids, self.missing = ids[order], missing[order].astype(bool)
        self.docs = np.r_[0, np.cumsum(np.bincount(group, minlength=len(asked.centres)))]
        self.share = [np.bincount(self.code[self.start[a]:self.start[b]], minlength=len(asked.terms)).astype(np.float32) / max(1, b - a)
                      for a, b in zip(self.docs[:-1], self.docs[1:])]

    def exact(self, docs: np.ndarray, marked: np.ndarray) -> np.ndarray:
        """Scores of documents by the terms that are marked with 1."""
        begin, end = self.start[docs], self.start[docs + 1]
        runs = list(map(slice, begin.tolist(), end.tolist()))
        code, weight = (np.concatenate([x[r] for r in runs]) for x in (self.code, self.weight))
        return np.add.reduceat(weight * marked.take(code, mode="clip"), np.cumsum(end - begin) - end + begin)


class Part:
    """Like queries: their terms, the queries of each term, and the best documents so far."""

    def __init__(self, group: int, query: np.ndarray, ask: np.ndarray, size: np.ndarray, code: np.ndarray, n_terms: int, top: int):
        self.group, self.query, self.ask, self.code, self.top = group, query, ask, code, top
        self.start = np.r_[0, np.cumsum(size)]
        self.asking = np.repeat(np.arange(len(size), dtype=np.uint16), size)[np.argsort(code, kind="stable")]
        self.n_terms = n_terms
        self.rough = (TABLE + max(size.tolist(), default=0) + 8) * 2.0 ** -24  # share that a score summed in single precision may be off
        self.least = np.zeros(len(size))  # the score of the last of the best, or less; 0 if there are fewer
        self.best = tuple(np.empty(0, t) for t in (np.int64, np.float64, bool, np.int64))  # query, score, is the id missing, id

    def meet(self, shard: Shard) -> None:
        """Add what the shard has to the best documents of each query: by score, rounded, then by id, those without an id last.

        The part meets a group of documents at a time. Terms that are common in both are one matrix product in single
        precision; the others are summed from the lists of queries. What is not below the best so far, by more than
        that product may be off, waits for its exact score.
        """
        count = np.bincount(self.code, minlength=self.n_terms)
        first, waiting, fresh = np.cumsum(count) - count, [], 0
        for g in sorted(range(len(shard.docs) - 1), key=lambda g: g != self.group):  # the likely ones first
            for low, score in self._scores(shard, g, count, first):
                new = np.flatnonzero(self.least <= 0) if low == shard.docs[g] and len(score) >= self.top else ()
                if len(new):
                    kth = np.partition(score[:, new].T, -self.top, axis=1)[:, -self.top]
                    self.least[new] = np.maximum(0, kth * (1 - self.rough) - HALF)
                bar = np.maximum((self.least - HALF) * (1 - self.rough), np.finfo(np.float32).tiny).astype(np.float32)
                doc, query = np.divmod(np.flatnonzero(score >= bar), len(bar))
                if not len(doc):
                    continue
                waiting.append((query, doc + low, score[doc, query].astype(np.float64)))
                fresh += len(doc)
                if fresh > 2 * self.top * len(bar):
                    waiting, fresh = [self._raise(waiting)], 0
                    if len(waiting[0][0]) > WAITING:
                        self._settle(shard, *waiting.pop())
        if waiting:
            self._settle(shard, *self._raise(waiting))

    def _scores(self, shard: Shard, g: int, count: np.ndarray, first: np.ndarray):
        """Blocks of scores, a row for each document of the group, each with the place of its first document."""
        begin, end, n = int(shard.docs[g]), int(shard.docs[g + 1]), len(self.query)
        shared = shard.share[g] * count
        common = np.flatnonzero(shared > COMMON * n)
        common = np.sort(common[np.argsort(-shared[common], kind="stable")[:TABLE]])
        column = np.full(len(count), -1, np.int32)
        column[common] = np.arange(len(common))
        table = np.zeros((n, len(common)), np.float32)
        table[self.asking[_runs(first[common], count[common])], np.repeat(np.arange(len(common)), count[common])] = 1
        rows = max(1, min(BLOCK, SCORES // n))
        step = max(1, CELLS // n)
        for low in range(begin, end, rows):
            high = min(low + rows, end)
            here = slice(shard.start[low], shard.start[high])
            code, weight = shard.code[here], shard.weight[here]
            doc, at = np.repeat(np.arange(high - low), np.diff(shard.start[low:high + 1])), column[code]
            listed = (at < 0) & (count[code] > 0)
            left = np.zeros((high - low, len(common)), np.float32)
            left[doc[at >= 0], at[at >= 0]] = weight[at >= 0]
            score = left @ table.T
            code, weight, doc = code[listed], weight[listed].astype(np.float32), doc[listed]
            times, cut = count[code], np.searchsorted(doc, np.arange(0, high - low + step, step)).tolist()
            for a, b in zip(cut[:-1], cut[1:]):
                cell = np.repeat(doc[a:b] * n, times[a:b])
                cell += self.asking[_runs(first[code[a:b]], times[a:b])]
                np.add.at(score.ravel(), cell, np.repeat(weight[a:b], times[a:b]))
            yield low, score

    def _raise(self, waiting):
        """Raise ``least`` by what waits, and let go what can not be among the best any more."""
        query, doc, score = (np.concatenate(x) for x in zip(*waiting))
        known = np.r_[self.best[1], np.maximum(0, score * (1 - self.rough) - HALF)].astype(np.float32)
        # in order of query, then from the highest score
        key = np.sort(np.r_[self.best[0], query].astype(np.uint64) << np.uint64(32) | (~known.view(np.uint32)).astype(np.uint64))
        of = (key >> np.uint64(32)).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        last = begin[np.diff(np.r_[begin, len(of)]) >= self.top] + self.top - 1
        self.least[of[last]] = np.maximum(self.least[of[last]], (~key[last].astype(np.uint32)).view(np.float32))
        stay = score >= (self.least[query] - HALF) * (1 - self.rough)
        return query[stay], doc[stay], score[stay]

    def _settle(self, shard: Shard, query: np.ndarray, doc: np.ndarray, _) -> None:
        order = np.argsort(query, kind="stable")
        query, doc = query[order], doc[order]
        bound, value, marked = np.flatnonzero(np.r_[True, query[1:] != query[:-1], True]), np.empty(len(query)), np.zeros(self.n_terms, np.uint8)
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
            own = self.code[self.start[query[a]]:self.start[query[a] + 1]]
            marked[own] = 1
            for i in range(a, b, BLOCK):
                value[i:min(i + BLOCK, b)] = shard.exact(doc[i:min(i + BLOCK, b)], marked)
            marked[own] = 0
        found = query, np.round(value, DIGITS), shard.missing[doc], shard.ids[doc]
        query, value, missing, ids = (np.concatenate(x) for x in zip(self.best, found))
        order = np.lexsort((ids, missing, -value, query))
        begin = np.flatnonzero(np.r_[True, query[order][1:] != query[order][:-1]])
        rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
        self.best = tuple(x[order[rank < self.top]] for x in (query, value, missing, ids))
        last = order[rank == self.top - 1]
        self.least[query[last]] = value[last]


_FOUND = pa.schema([("query", pa.int64()), ("ask", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])


def _search(n_docs: int, mean_length: float, top: int):
    def found(asked):
        for part in asked.parts if asked else ():
            query, score, missing, ids = part.best
            yield pa.RecordBatch.from_arrays([pa.array(part.query[query]), pa.array(part.ask[query]), pa.array(ids, mask=missing), pa.array(score)], schema=_FOUND)

    def run(batches):
        sole_memory("bm25")
        task, rows, asked = None, [], None
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if r["task"] != task:
                    yield from found(asked)
                    task, rows, asked = r["task"], [], None
                if r["kind"] == 0:
                    rows.append(r["terms"])
                elif rows:
                    asked = asked or Asked(rows, n_docs, top)
                    shard = Shard(asked, r["docs"], r["terms"], r["postings"], mean_length)
                    for part in asked.parts:
                        part.meet(shard)
        yield from found(asked)

    return run


def _query_terms(batches):
    for batch in batches:
        h, size = _hashes(octets(batch.column(2)))
        query, ask = (np.repeat(batch.column(i).to_numpy(), size) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ask), pa.array(h.view(np.int64))], names=["query", "ask", "term"])


_ROW = pa.schema([("block", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.binary())])


def _packed(batches):
    """Queries, whose terms and document frequencies come one after the other, many to a block of octets."""
    number, held, n = TaskContext.get().partitionId() << 32, [], 0

    def close(whole):
        nonlocal number, held, n
        columns = [np.concatenate(x) for x in zip(*held)]
        query, ask = columns[:2]
        first = np.flatnonzero(np.r_[True, (query[1:] != query[:-1]) | (ask[1:] != ask[:-1])])
        end = len(query) if whole else int(first[-1])  # the last query may go on
        held, n = [[x[end:] for x in columns]], len(query) - end
        if end:
            query, ask, term, df = (x[:end] for x in columns)
            first = first[first < end]
            term, at, code = np.unique(term.view(np.uint64), return_index=True, return_inverse=True)
            data = pack(query[first], ask[first], np.diff(np.r_[first, end]).astype(np.uint32), code.astype(np.uint32), term, df[at])
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((number, end, data), _ROW)], schema=_ROW)
            number += 1

    for batch in batches:
        if batch.num_rows:
            held.append([x.to_numpy() for x in batch.columns])
            n += batch.num_rows
            if n >= ROW_TERMS:
                yield from close(False)
    if n:
        yield from close(True)


def _dealt(sizes: dict[int, int], hands: int) -> dict[int, int]:
    """Deal keys to hands, the largest first and each to the hand that has least."""
    held, out = [(0, i) for i in range(hands)], {}
    for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
        least, out[key] = heapq.heappop(held)
        heapq.heappush(held, (least + sizes[key], out[key]))
    return out


def top_k(docs: DataFrame, queries: DataFrame, top: int = TOP, index: DataFrame | None = None) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: the ``top`` documents of each query text by BM25.

    ``queries`` has ``query_id, text``; every different word of a text counts once. Length and document frequencies
    are those of the whole corpus, so scores do not depend on the shards, and the best of each shard merge to the
    exact best of all. A task holds ``TASK_TERMS`` terms of queries and meets its shards one after the other.

    Scores are rounded to six decimals; ties go to the smaller id, null ids come last. Documents without a common
    word with the query are not found, so null and empty texts find nothing and are not found. Rows of ``queries``
    that share id and text ask once, those with another text ask for themselves. Further columns are ignored.
    """
    index = build_index(docs) if index is None else index
    size = index.select("shard", "n_docs", "n_words").collect()
    n_docs, n_words = (sum(r[c] for r in size) for c in ("n_docs", "n_words"))
    asked = queries.select(F.col("query_id").cast("long").alias("query"), F.xxhash64("text").alias("ask"), F.col("text").cast("string").alias("text"))
    wanted = asked.mapInArrow(_query_terms, "query long, ask long, term long").distinct()
    df = index.select("terms").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = wanted.join(df, "term").select("query", "ask", "term", "df")
    n, spark = partitions(docs), docs.sparkSession
    packed = weighed.repartition(n, "query", "ask").sortWithinPartitions("query", "ask", "term").mapInArrow(_packed, "block long, n_terms long, terms binary")
    packed = materialize(packed)
    # a number for each row of the index and of the queries; a task holds some queries and meets some shards one after the other
    blocks, shards = dict(map(tuple, packed.select("block", "n_terms").collect())), {r.shard: r.n_words for r in size}
    lots = max(1, min(len(blocks), -(-sum(blocks.values()) // TASK_TERMS)))
    lot = _dealt(blocks, lots)
    tiles = max(1, min(len(shards), n // lots, n_words * lots // (MET * max(1, sum(blocks.values())))))
    tile = _dealt(shards, tiles)
    own = {r.part: r.id for r in spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("id")).collect()}  # a key for each partition
    task = lambda q, t: (q * tiles + t, own[(q * tiles + t) % n])
    asks = spark.createDataFrame([(b, *task(q, t)) for b, q in lot.items() for t in range(tiles)], "block long, task long, place long")
    meets = spark.createDataFrame([(s, *task(q, t)) for s, t in tile.items() for q in range(lots)], "shard long, task long, place long")
    empty, key = F.lit(None).cast("binary"), ["task", "place"]
    rows = packed.join(F.broadcast(asks), "block").select(*key, F.lit(0).alias("kind"), F.col("block").alias("shard"), empty.alias("docs"), "terms", empty.alias("postings")).unionByName(
        index.join(F.broadcast(meets), "shard").select(*key, F.lit(1).alias("kind"), "shard", "docs", "terms", "postings"))
    placed = rows.repartition(n, "place").sortWithinPartitions("task", "kind", "shard")
    found = placed.mapInArrow(_search(n_docs, n_words / max(1, n_docs), top), "query long, ask long, doc_id long, score double")
    best = Window.partitionBy("query", "ask").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(F.col("query").alias("query_id"), F.col("rank").cast("long").alias("rank"), "doc_id", "score")
