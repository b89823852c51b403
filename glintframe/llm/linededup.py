"""Line dedup: sharded cuckoo filters over exact reference counts, with insertions and deletions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from glintframe.llm.common import octets, partitions
from glintframe.session import materialize

LEAST = 10  # code points of a key that counts
SALTS = 8  # tasks that share the lines of a shard when the filters are probed
SLOTS = 4
NO_ID = (1 << 63) - 1  # documents without an id come after all others


def line_keys(text: bytes) -> list[bytes]:
    """The lines' keys: trimmed of ASCII white space, ASCII letters in lower case."""
    return [x.strip() for x in text.lower().split(b"\n")]


def counted(key: bytes, least: int = LEAST) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def digest(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


_LINE = pa.schema([("doc", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])


def postings(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row ``(doc, hi, lo)`` for each document and different key of enough length: the key's 128-bit hash."""

    def run(batches):
        for batch in batches:
            doc, hi, lo = [], [], []
            for d, text in zip(batch.column(0).to_pylist(), octets(batch.column(1))):
                for key in {x for x in line_keys(text) if counted(x, least)}:
                    a, b = digest(key)
                    doc.append(d), hi.append(a), lo.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, hi, lo)], schema=_LINE)

    return docs.select(_id(), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc long, hi long, lo long").distinct()


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket; when full, a table of twice the size is added."""

    def __init__(self, capacity: int = 64, tables: list[np.ndarray] | None = None):
        self.tables = tables or [self._empty(capacity)]

    @staticmethod
    def _empty(capacity: int) -> np.ndarray:
        return np.zeros((1 << max(2, int(capacity / (SLOTS * 0.7))).bit_length(), SLOTS), np.uint16)

    @staticmethod
    def _where(hi, lo, table):
        """Fingerprint and both buckets of each key."""
        mask = np.uint64(len(table) - 1)
        mark = ((lo.view(np.uint64) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)).astype(np.uint64)
        first = hi.view(np.uint64) & mask
        return mark.astype(np.uint16), first.astype(np.int64), (first ^ ((mark * np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(20) & mask)).astype(np.int64)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hi), bool)
        for table in self.tables:
            mark, a, b = self._where(hi, lo, table)
            found |= (table[a] == mark[:, None]).any(axis=1) | (table[b] == mark[:, None]).any(axis=1)
        return found

    @staticmethod
    def _fill(table, bucket, mark):
        """Put what fits into the free slots of the buckets; return the places in the input that found none."""
        order = np.argsort(bucket, kind="stable")
        at = bucket[order]
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        nth = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
        taken = table[at] != 0
        fits = nth < SLOTS - taken.sum(axis=1)
        slot = np.argsort(taken[fits], axis=1, kind="stable")[np.arange(fits.sum()), nth[fits]]
        table[at[fits], slot] = mark[order[fits]]
        return order[~fits]

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        while len(hi):
            table = self.tables[-1]
            mark, a, b = self._where(hi, lo, table)
            rest = self._fill(table, a, mark) if len(a) else np.empty(0, np.int64)
            rest = rest[self._fill(table, b[rest], mark[rest])] if len(rest) else rest
            lost = [i for i in rest.tolist() if not self._kick(table, int(a[i]), int(mark[i]))]
            hi, lo = hi[lost], lo[lost]
            if len(hi):
                self.tables.append(self._empty(max(len(table) * SLOTS * 2, len(hi))))

    @staticmethod
    def _kick(table, bucket: int, mark: int, most: int = 200) -> bool:
        path, mask = [], len(table) - 1
        for turn in range(most):
            free = np.flatnonzero(table[bucket] == 0)
            if len(free):
                table[bucket, free[0]] = mark
                return True
            slot = turn * 7 % SLOTS
            path.append((bucket, slot, mark))
            mark, table[bucket, slot] = int(table[bucket, slot]), mark
            bucket ^= (mark * 0x5BD1E9955BD1E995 & ((1 << 64) - 1)) >> 20 & mask
        for bucket, slot, put in reversed(path):  # undo, so that no other key is lost
            mark, table[bucket, slot] = int(table[bucket, slot]), mark
        return False

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Take out one fingerprint for each key; the keys must be in."""
        for table in reversed(self.tables):
            mark, a, b = self._where(hi, lo, table)
            left = []
            for i, (m, x, y) in enumerate(zip(mark.tolist(), a.tolist(), b.tolist())):
                for bucket in (x, y):
                    slot = np.flatnonzero(table[bucket] == m)
                    if len(slot):
                        table[bucket, slot[0]] = 0
                        break
                else:
                    left.append(i)
            hi, lo = hi[left], lo[left]

    def dump(self) -> bytes:
        return b"".join(len(t).to_bytes(8, "little") + t.tobytes() for t in self.tables)

    @classmethod
    def load(cls, data: bytes) -> "Cuckoo":
        tables, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at:at + 8], "little")
            tables.append(np.frombuffer(data, np.uint16, n * SLOTS, at + 8).reshape(n, SLOTS).copy())
            at += 8 + n * SLOTS * 2
        return cls(tables=tables)


@dataclass
class LineIndex:
    """The state: who holds which line, how many do and who first, and the filters of the lines held twice or more.

    ``lines (doc, hi, lo)`` and ``counts (hi, lo, n_docs, first)`` are exact; ``filters (shard, filter)`` hold the
    keys with ``n_docs >= 2`` and only save the exact look-up of the others. All three are written tables.
    """

    lines: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def _shard(shards: int) -> Column:
    return F.pmod(F.col("hi"), F.lit(shards)).alias("shard")


_FILTER = pa.schema([("shard", pa.int64()), ("filter", pa.binary())])


def _revise(batches):
    """Shard by shard: the old filter if any, then keys to insert (kind 1) and to delete (kind 2)."""
    shard, held, gone = None, None, None

    def close():
        hi, lo = (np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*gone[1])) if gone[1] else (np.empty(0, np.int64),) * 2
        filt = held or Cuckoo(len(hi))
        filt.insert(hi, lo)
        for x, y in gone[2]:
            filt.delete(x, y)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([filt.dump()], pa.binary())], schema=_FILTER)

    for batch in batches:
        s, kind, hi, lo = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        hi, lo, kind = hi.astype(np.int64), lo.astype(np.int64), kind.astype(np.int64)
        cut = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (kind[1:] != kind[:-1])]) if len(s) else []
        for i, j in zip(cut, [*cut[1:], len(s)]):
            if s[i] != shard:
                if shard is not None:
                    yield close()
                shard, held, gone = int(s[i]), None, {1: [], 2: []}
            if kind[i] == 0:
                held = Cuckoo.load(batch.column(4)[int(i)].as_py())
            else:
                gone[int(kind[i])].append((hi[i:j], lo[i:j]))
    if shard is not None:
        yield close()


def _filters(old: DataFrame | None, keys: DataFrame, shards: int) -> DataFrame:
    """Filters after the changes ``keys (kind, hi, lo)``."""
    rows = keys.select(_shard(shards).cast("long").alias("shard"), "kind", "hi", "lo", F.lit(None).cast("binary").alias("filter"))
    if old is not None:
        rows = rows.unionByName(old.select("shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), "filter"))
    placed = rows.repartition(partitions(keys), "shard").sortWithinPartitions("shard", "kind")
    return materialize(placed.mapInArrow(_revise, "shard long, filter binary"))


def _tally(lines: DataFrame) -> DataFrame:
    return lines.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.min("doc").alias("first"))


def insert(docs: DataFrame, index: LineIndex | None = None, shards: int | None = None) -> LineIndex:
    """The index with the lines of ``docs`` added; documents and lines that it has already are not counted twice."""
    lines = postings(docs)
    if index is None:
        lines = materialize(lines)
        counts = materialize(_tally(lines))
        shards = shards or partitions(docs)
        return LineIndex(lines, counts, _filters(None, counts.where("n_docs > 1").select(F.lit(1).alias("kind"), "hi", "lo"), shards), shards)
    new = materialize(lines.join(index.lines, ["doc", "hi", "lo"], "left_anti"))
    more = _tally(new).select("hi", "lo", F.col("n_docs").alias("more"), F.col("first").alias("other"))
    merged = materialize(index.counts.join(more, ["hi", "lo"], "full").select(
        "hi", "lo", F.coalesce("n_docs", F.lit(0)).alias("was"), (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"),
        F.least("first", "other").alias("first")))
    risen = merged.where("was < 2 and n_docs > 1").select(F.lit(1).alias("kind"), "hi", "lo")
    return LineIndex(materialize(index.lines.union(new)), merged.drop("was"), _filters(index.filters, risen, index.shards), index.shards)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents ``doc_id``; ids that it does not hold change nothing."""
    gone = doc_ids.select(_id()).distinct()
    removed = materialize(index.lines.join(gone, "doc", "left_semi"))
    lines = materialize(index.lines.join(gone, "doc", "left_anti"))
    touched = removed.select("hi", "lo").distinct()
    fresh = _tally(lines.join(touched, ["hi", "lo"], "left_semi"))
    before = index.counts.join(touched, ["hi", "lo"], "left_semi").where("n_docs > 1")
    fallen = before.join(fresh.where("n_docs > 1"), ["hi", "lo"], "left_anti").select(F.lit(2).alias("kind"), "hi", "lo")
    counts = materialize(index.counts.join(touched, ["hi", "lo"], "left_anti").unionByName(fresh))
    return LineIndex(lines, counts, _filters(index.filters, fallen, index.shards), index.shards)


def _probe(batches):
    """Lines behind the filter of their shard: those that it may hold."""
    shard, held = None, None
    for batch in batches:
        s, kind, doc, hi, lo = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
        cut = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (kind[1:] != kind[:-1])]) if len(s) else []
        keep = np.zeros(len(s), bool)
        for i, j in zip(cut, [*cut[1:], len(s)]):
            if kind[i] == 0:
                shard, held = s[i], Cuckoo.load(batch.column(5)[int(i)].as_py())
            elif s[i] == shard:
                keep[i:j] = held.contains(hi[i:j], lo[i:j])
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc, hi, lo)], schema=_LINE)


def repeated_lines(index: LineIndex) -> DataFrame:
    """``(doc, hi)`` of every indexed line that an earlier document holds too.

    The filters pass over the lines of their shard, dealt over ``SALTS`` tasks each, so a line that a third of the
    documents share does not meet in one task; what they let through is joined with the exact counts.
    """
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    rows = index.lines.select(_shard(index.shards).cast("long").alias("shard"), F.lit(1).alias("kind"), "doc", "hi", "lo", F.lit(None).cast("binary").alias("filter"),
                              F.pmod("doc", F.lit(SALTS)).cast("int").alias("salt"))
    zero = F.lit(0).cast("long")
    rows = rows.unionByName(index.filters.select("shard", F.lit(0).alias("kind"), zero.alias("doc"), zero.alias("hi"), zero.alias("lo"), "filter", spread))
    placed = rows.repartition(partitions(rows), "shard", "salt").sortWithinPartitions("shard", "salt", "kind").drop("salt")
    maybe = placed.mapInArrow(_probe, "doc long, hi long, lo long")
    return maybe.join(index.counts.where("n_docs > 1"), ["hi", "lo"]).where(F.col("first") < F.col("doc")).select("doc", "hi")


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])


def _rebuild(least: int):
    def run(batches):
        for batch in batches:
            ids, lines, dropped, kept = batch.column(0), [], [], []
            for text, out in zip(octets(batch.column(1)), batch.column(2).to_pylist()):
                if out:
                    out, whole = set(out), text.split(b"\n")
                    stay = [x for x, key in zip(whole, line_keys(text)) if not (counted(key, least) and digest(key)[0] in out)]
                    lines.append(len(whole)), dropped.append(len(whole) - len(stay)), kept.append(b"\n".join(stay).decode())
                else:
                    lines.append(text.count(b"\n") + 1), dropped.append(0), kept.append(text.decode())
            yield pa.RecordBatch.from_arrays([ids, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], schema=_KEPT)

    return run


def dedup_lines(index: LineIndex, docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Indexed documents without the lines that a document with a smaller id holds: ``doc_id, n_lines, n_dropped, kept``.

    Null and empty texts are one empty line; keys under ``least`` code points stay; within the first document all
    copies of a line stay; rows without an id come after all others as one document; rows that share an id are one
    document; further columns are ignored; no rows give no rows.
    """
    out = repeated_lines(index).groupBy("doc").agg(F.collect_list("hi").alias("out"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _id())
    return texts.join(out, "doc", "left").select("doc_id", "text", "out").mapInArrow(_rebuild(least), "doc_id long, n_lines long, n_dropped long, kept string")
