"""Near-duplicates by SimHash: pigeonhole blocks, verified by Hamming distance."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from glintframe.llm.common import numbered, octets, partitions, per_batch, sole_memory
from glintframe.llm.components import components
from glintframe.session import materialize

SHINGLE = 4
SEED = 42
DISTANCE = 4
TILE = 4096  # members of a bucket that one task compares with each other or with as many others


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64 majority bits over the hashes of all word shingles, repeats included; no words give 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    width = min(width, len(words))
    pieces = [joined[i:j] for i, j in zip((end - size)[:len(words) - width + 1].tolist(), end[width - 1:].tolist())]
    h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """``(doc_id, fp)`` of every document, and the long columns ``carried``; null and empty texts have fingerprint 0."""
    names = ["doc_id", *carried]
    schema = pa.schema([(c, pa.int64()) for c in [*names, "fp"]])

    def run(c):
        sole_memory("simhash")
        return {n: c[n] for n in names} | {"fp": np.array([fingerprint(x) for x in octets(c["text"])], np.uint64).view(np.int64)}

    rows = docs.select(*[F.col(n).cast("long").alias(n) for n in names], F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(per_batch(run, schema), ", ".join(f"{f.name} long" for f in schema))


def _masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of all choices of ``blocks - distance`` of the blocks: a pair within the distance agrees on one."""
    edge = [round(i * 64 / blocks) for i in range(blocks + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:])]
    return [sum(c) for c in combinations(part, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tree(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among ``fp``."""
    rest, a, b = np.arange(len(fp)), [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[at]) <= distance
            found, rest = rest[near], rest[~near]
            a.append(np.full(len(found), at)), b.append(found)
            queue.extend(found.tolist())
    return (np.concatenate(a), np.concatenate(b)) if a else (rest[:0], rest[:0])


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links_of_tiles(distance: int):
    """Links of runs of rows with the same tile: a forest for each run, so never all pairs of a crowded one."""

    def emit(tile, fp):
        cut = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]).any(axis=1)])
        size = np.diff(np.r_[cut, len(fp)])
        run = np.repeat(np.arange(len(cut)), size)
        few = np.repeat(size <= 8, size)
        a, b = [], []
        for step in range(1, 8):
            i = np.flatnonzero(few[step:] & (run[step:] == run[:-step])) if len(fp) > step else np.empty(0, np.int64)
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= distance]
            a.append(i), b.append(i + step)
        for at, n in zip(cut[size > 8].tolist(), size[size > 8].tolist()):
            x, y = _tree(fp[at:at + n], distance)
            a.append(x + at), b.append(y + at)
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], schema=_LINK)

    def run(batches):
        sole_memory("simhash")
        tile, fp = np.empty((0, 4), np.int64), np.empty(0, np.uint64)
        for x in batches:
            tile = np.concatenate([tile, np.stack([x.column(i).to_numpy() for i in range(4)], axis=1).astype(np.int64)])
            fp = np.concatenate([fp, x.column(4).to_numpy().view(np.uint64)])
            if len(fp):
                last = np.flatnonzero((tile != tile[-1]).any(axis=1))
                done = last[-1] + 1 if len(last) else 0
                if done:
                    yield emit(tile[:done], fp[:done])
                    tile, fp = tile[done:], fp[done:]
        if len(fp):
            yield emit(tile, fp)

    return run


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints ``fp`` within ``distance`` bits of each other.

    ``distinct`` holds each fingerprint once. Fingerprints meet on the masked bits of every choice of agreeing
    blocks; their number grows with the rows (6 up to 4 million, then 7 and 8), so that buckets stay short by
    chance, and any number finds every close pair. A bucket above ``TILE`` members is dealt into groups, and
    every two groups meet in a task of their own. Each run returns a spanning forest of its links, which keeps
    every connection without emitting all pairs.
    """
    n = distinct.count()
    masks = _masks(distance + (2 if n <= 1 << 22 else 3 if n <= 1 << 28 else 4), distance)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("mask", "key"))
    size = keyed.groupBy("mask", "key").count().where("count > 1")
    groups = F.ceil(F.col("count") / TILE)
    other = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    tiles = (keyed.join(size, ["mask", "key"]).withColumn("groups", groups).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("groups")))
             .select("mask", "key", "fp", "own", other.alias("other")).select("mask", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))
    placed = tiles.repartition(partitions(distinct), "mask", "key", "i", "j").sortWithinPartitions("mask", "key", "i", "j")
    return placed.mapInArrow(_links_of_tiles(distance), "a long, b long")


def _rooted(least: DataFrame, distance: int) -> DataFrame:
    """``least`` (a row for each fingerprint ``fp``) with the ``root`` that links of close fingerprints reach."""
    tree = components(links(least.select("fp"), distance))
    return least.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Every document with its fingerprint and the smallest ``doc_id`` that links of close fingerprints reach.

    Columns ``doc_id, fp, component_id``. Exact copies share one fingerprint and are never expanded into pairs.
    Null and empty texts have fingerprint 0 and link like any other; repeated ids give repeated rows; a group of
    rows without any id has a null component; further columns are ignored; no rows give no rows.
    """
    marked = materialize(fingerprints(docs))
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    rooted = materialize(_rooted(distinct, distance))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(rooted.select("fp", "root").join(smallest, "root").drop("root"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The documents of which each near-duplicate group keeps one row: that with the smallest id, or any if none has one.

    Rows are judged one by one: rows without an id are compared like all others and come last in their group, and of
    rows that share the smallest id one stays.
    """
    rows = materialize(numbered(docs))
    marked = fingerprints(rows.select("row", "doc.doc_id", "doc.text", F.xxhash64("doc.text").alias("hash")), "row", "hash")
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "hash", "row")
    least = materialize(marked.groupBy("fp").agg(F.min(place).alias("first")))
    kept = _rooted(least, distance).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select("doc.*")
