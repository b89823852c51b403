"""Merkle manifest of a dataset, with a witness for every row that grows as rows are appended.

Each language is a tree over its rows in order of id. A tree is cut into aligned blocks of 1024 nodes. Inside a block
nodes are appended one by one: a subtree without its sibling stays open, with the partial witnesses of its leaves, and
the sibling's completion extends the witnesses on both sides. The roots of all blocks are appended to the next level in
the same way, until each tree has one node; the trees' roots form a last tree of their own.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from glintframe.llm.common import partitions, text_session
from glintframe.operators.pairing import scene_position
from glintframe.session import materialize

LEVELS = 10  # of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: list[Column]) -> Column:
    """A row's digest as text: of each field its octets and its value, or ``-`` for null."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)).cast("binary"), 256)


def joined(*nodes: bytes) -> bytes:
    """Digest of the nodes' digests, which are hashed as text."""
    return hashlib.sha256("".join(x.hex() for x in nodes).encode()).digest()


class Appender:
    """Nodes of one aligned block, appended in order."""

    def __init__(self):
        self.open: list[tuple[int, bytes, int]] = []  # height, root and first node of each subtree without a sibling
        self.paths: list[bytearray] = []  # of each node the siblings so far

    def append(self, digest: bytes) -> None:
        self.paths.append(bytearray())
        self._put(0, digest, len(self.paths) - 1)

    def _put(self, height: int, root: bytes, first: int) -> None:
        while self.open and self.open[-1][0] == height:
            _, left, begin = self.open.pop()
            for path in self.paths[begin:first]:
                path += root
            for path in self.paths[first:]:
                path += left
            height, root, first = height + 1, joined(left, root), begin
        self.open.append((height, root, first))

    def close(self, height: int | None) -> bytes:
        """The block's root. Runs of one are hashed by themselves, up to ``height`` where other blocks follow or precede."""
        while len(self.open) > 1:
            low, root, first = self.open.pop()
            self._put(low + 1, joined(root), first)
        at, root, _ = self.open[0]
        while height is not None and at < height:
            at, root = at + 1, joined(root)
        return root


def fold(digest: bytes, place: int, count: int, path: bytes) -> bytes:
    """Root of a tree of ``count`` leaves from the leaf at ``place`` and its siblings, lowest first."""
    at = 0
    while count > 1:
        if place & 1:
            digest, at = joined(path[at:at + 32], digest), at + 32
        elif place + 1 < count:
            digest, at = joined(digest, path[at:at + 32]), at + 32
        else:
            digest = joined(digest)
        place, count = place >> 1, count + 1 >> 1
    return digest


def _append_blocks(levels: int, out: pa.Schema):
    """Rows sorted by ``tree, place``: each with its witness inside its block, and a row for the root of each block."""
    more = [f for f in out if f.name not in ("is_root", "tree", "place", "digest", "path")]

    def emit(rows: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        tree, place, count, digest = (rows[c].to_pylist() for c in ("tree", "place", "count", "digest"))
        paths, roots = [], []
        for i, j in zip(cuts, cuts[1:]):
            block = Appender()
            for d in digest[i:j]:
                block.append(d)
            roots.append(block.close(None if count[i] <= 1 << levels else levels))
            paths += map(bytes, block.paths)
        n = len(roots)
        columns = {"is_root": pa.array([False] * len(tree) + [True] * n), "tree": pa.array(tree + [tree[i] for i in cuts[:-1]], pa.string()),
                   "place": pa.array(place + [place[i] >> levels for i in cuts[:-1]], pa.int64()), "digest": pa.array(digest + roots, pa.binary()),
                   "path": pa.array(paths + [None] * n, pa.binary())}
        for f in more:
            columns[f.name] = pa.concat_arrays([*(c.cast(f.type) for c in rows[f.name].chunks), pa.nulls(n, f.type)])
        return pa.RecordBatch.from_arrays([columns[f.name] for f in out], schema=out)

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            key = list(zip(held["tree"].to_pylist(), (x >> levels for x in held["place"].to_pylist())))
            cuts = [i for i in range(len(key)) if i == 0 or key[i] != key[i - 1]]
            if len(cuts) > 1:
                yield emit(held.slice(0, cuts[-1]), cuts)
                held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield emit(held, [0, held.num_rows])

    return run


@dataclass
class Level:
    """Nodes ``tree, place, digest, path`` (leaves also carry their own columns). Closed blocks never change again."""

    closed: list[DataFrame]
    open: DataFrame | None

    def nodes(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [*self.closed, self.open])


@dataclass
class Manifest:
    """Levels of nodes, leaves first, and ``tops``: of each tree ``tree, count, last`` (largest id) and the root's ``digest``."""

    levels: list[Level]
    tops: DataFrame
    block: int = LEVELS


def _grow(levels: list[Level], fresh: DataFrame, sizes: DataFrame, most: int, block: int, tops: DataFrame | None = None) -> tuple[list[Level], DataFrame]:
    """Append ``fresh`` nodes (``tree, place, digest`` and more) to the lowest level, and block roots to those above.

    ``sizes``: of each tree the nodes that are ``valid`` before and ``full`` after (no partial block below them), and
    their ``count`` after. Returns the levels and the roots ``tree, digest``.
    """
    done = []
    while True:
        k = len(done)
        old = levels[k] if k < len(levels) else Level([], tops and tops.select("tree", F.lit(0).cast("long").alias("place"), "digest"))
        if old.open is not None:
            still = old.open.join(sizes.select("tree", "valid"), "tree").where("place < valid")
            fresh = fresh.unionByName(still.select(*fresh.columns))
        rows = fresh.join(sizes.select("tree", "count"), "tree").withColumn("block", F.shiftright("place", block))
        rows = rows.repartition(partitions(rows), "tree", "block").sortWithinPartitions("tree", "place").drop("block")
        schema = StructType([StructField("is_root", BooleanType()), StructField("tree", StringType()), StructField("place", LongType()),
                             StructField("digest", BinaryType()), StructField("path", BinaryType()),
                             *[StructField(f.name, f.dataType) for f in fresh.schema if f.name not in ("tree", "place", "digest")]])
        cut = materialize(rows.mapInArrow(_append_blocks(block, to_arrow_schema(schema)), schema))
        nodes = cut.where("not is_root").drop("is_root").join(sizes.select("tree", "full"), "tree")
        shut = F.col("place") < F.shiftleft(F.shiftright("full", block), block)
        done.append(Level([*old.closed, nodes.where(shut).drop("full")], nodes.where(~shut).drop("full")))
        fresh = cut.where("is_root").select("tree", "place", "digest")
        up = lambda c: F.shiftright(c, block).alias(c)
        sizes = sizes.select("tree", up("valid"), up("full"), F.shiftright(F.col("count") + (1 << block) - 1, block).alias("count"))
        most = most + (1 << block) - 1 >> block
        if most <= 1 and k + 1 >= len(levels):
            # a tree whose last block was closed before keeps the root that it had
            return done, fresh if tops is None else fresh.unionByName(tops.select("tree", F.lit(0).cast("long").alias("place"), "digest").join(fresh, "tree", "left_anti")).drop("place")


def append(manifest: Manifest | None, docs: DataFrame, block: int = LEVELS, **carried: Column) -> Manifest:
    """The manifest with the rows of ``docs``, whose ids must come after those of their language that are in it.

    Only open blocks are done again, at most one for each tree and level; closed blocks keep their witnesses. The
    leaves keep ``doc_id`` and what the columns ``carried`` name. Texts are read once and neither written nor
    shuffled; trees of any size are spread over blocks.

    Rows without an id come first in their language; rows that share an id stand in order of their digests; a null
    language is a tree of its own and the first; further columns are ignored; no rows give a manifest without trees.
    """
    text_session(docs.sparkSession)
    block = manifest.block if manifest else block
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree")
    own = [F.unhex(leaf([F.col(c) for c in FIELDS])).alias("digest"), F.col("doc_id").cast("long").alias("doc_id")]
    rows = materialize(docs.select(tree, *own, *[c.alias(n) for n, c in carried.items()]))
    added = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("added"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("doc_id").alias("named"))
    if manifest:
        known = manifest.tops.select("tree", F.col("count").alias("valid"), F.col("last").alias("before"))
        added = added.join(known, "tree", "full")
        late = added.where("valid > 0 and added > 0 and (named < added or coalesce(first <= before, false))")
        if late.take(1):
            raise ValueError("appended ids must come after those of their language")
        last = F.coalesce("last", "before")
    else:
        added, last = added.withColumn("valid", F.lit(0).cast("long")), F.col("last")
    n = F.coalesce("added", F.lit(0)) + F.coalesce("valid", F.lit(0))
    sizes = materialize(added.select("tree", F.coalesce("valid", F.lit(0)).cast("long").alias("valid"), n.cast("long").alias("full"), n.cast("long").alias("count"), last.alias("last")))
    placed = scene_position(rows, ["doc_id", "digest"], ("tree",), "place").drop("place_count")
    if manifest:
        placed = placed.join(sizes.select("tree", "valid"), "tree").withColumn("place", F.col("place") + F.col("valid")).drop("valid")
    most = sizes.agg(F.max("count")).first()[0] or 1
    levels, roots = _grow(manifest.levels if manifest else [], placed, sizes, most, block, manifest and manifest.tops)
    return Manifest(levels, materialize(roots.join(sizes.select("tree", "count", "last"), "tree").select("tree", "count", "last", "digest")), block)


def _whole_paths(levels: list[Level], tops: DataFrame, block: int) -> DataFrame:
    """Leaves with the witness up to their tree's root, and the columns of ``tops`` but their digest."""
    above = tops.withColumnsRenamed({"digest": "top"}).withColumns({"place": F.lit(0).cast("long"), "above": F.lit(b"")})
    more = [c for c in above.columns if c not in ("tree", "place", "above")]
    for level in reversed(levels):
        upper = above.select("tree", F.col("place").alias("block"), "above", *more)
        nodes = level.nodes().withColumn("block", F.shiftright("place", block)).join(upper, ["tree", "block"])
        above = nodes.withColumn("above", F.concat("path", "above")).drop("path", "block")
    return above.withColumnRenamed("above", "path")


def witnesses(manifest: Manifest) -> DataFrame:
    """A row for each leaf: what proves that it belongs to the dataset.

    Columns ``doc_id, lang``, the carried ones, ``leaf``, ``place`` of ``n`` in its tree with ``path`` (siblings of 32
    octets, lowest first) and ``subroot``, then ``tree_place`` of ``trees`` with ``tree_path``, and ``root``.
    """
    tops = manifest.tops.withColumn("forest", F.lit(""))
    ranked = scene_position(tops, ["tree"], ("forest",), "place")
    ranked = ranked.select(F.col("forest").alias("tree"), "place", "digest", F.col("tree").alias("name"), F.col("count").alias("n"))
    trees = manifest.tops.count()
    size = tops.sparkSession.createDataFrame([("", 0, trees, trees)], "tree string, valid long, full long, count long")
    levels, root = _grow([], ranked, size, trees, manifest.block)
    forest = _whole_paths(levels, root.select("tree", "digest"), manifest.block)
    forest = forest.select(F.col("name").alias("tree"), "n", F.col("place").alias("tree_place"), F.lit(trees).cast("long").alias("trees"),
                           F.col("path").alias("tree_path"), F.col("top").alias("root"), "digest")
    leaves = _whole_paths(manifest.levels, materialize(forest), manifest.block)
    lang = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("lang")
    own = ("tree", "n", "tree_place", "trees", "tree_path", "root", "digest", "top", "place", "path", "doc_id")
    return leaves.select("doc_id", lang, *[c for c in leaves.columns if c not in own], F.col("digest").alias("leaf"), "place", "n", "path",
                         F.col("top").alias("subroot"), "tree_place", "trees", "tree_path", "root")


def refold(rows: DataFrame, digest: str, name: str = "folded_root") -> DataFrame:
    """``rows`` of ``witnesses`` with the root that follows from the leaf in the column ``digest`` and their witness."""
    schema = StructType([*rows.schema, StructField(name, BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
            steps = zip(get(digest), get("place"), get("n"), get("path"), get("tree_place"), get("trees"), get("tree_path"))
            found = [fold(fold(d, p, n, s), q, m, t) for d, p, n, s, q, m, t in steps]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), pa.array(found, pa.binary())], schema=arrow)

    return rows.mapInArrow(run, schema)
