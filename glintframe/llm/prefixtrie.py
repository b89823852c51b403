"""Prefix trie of conversations from vertical bitmaps.

A shard is a stretch of conversation ids. Its index maps (position, turn) to the bitset of the shard's conversations
with that turn there; from the root, the intersection of a node's bitset with the postings of the next position gives
its children, their popcounts and the conversations that end. Nodes are named by a hash of their turns, so shards are
merged by name. What is a sum over conversations adds up as it is; what counts a node once is put right by a correction
for every node that several shards found, which is summed up the trie by pointer jumping.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from glintframe.llm.common import join_groups, partitions, text_session
from glintframe.llm.mixing import word_count
from glintframe.session import materialize

SHARD_TURNS = 16_384  # a shard ends with the conversation that reaches this many
_ROOT = bytes(16)

_KINDS = "hi long, lo long, up_hi long, up_lo long, depth long, words long, n long, first long, kids long, childless long, leaves long, member_words long, node_words long, ends string"
_SCHEMA = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in _KINDS.split(", ")])


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, key, words``: a turn's key is a 128-bit hash of role and text, null ones being empty.

    Rows without a ``conv_id`` belong to no conversation and give none; further columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    text_session(conversations.sparkSession)
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("key"),
        word_count(text).alias("words"))


def _pair(name: bytes) -> tuple[int, int]:
    return int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True)


def shard_nodes(ids: list[int], turns: list[list[bytes]], words: list[list[int]]):
    """Nodes of one shard: rows as in ``_KINDS``. ``ids`` ascend; the lists hold each conversation's turns in order."""
    index: dict[tuple[int, bytes], int] = {}
    ended: dict[int, int] = {}
    for i, keys in enumerate(turns):
        for at, key in enumerate(keys):
            index[at, key] = index.get((at, key), 0) | 1 << i
        ended[len(keys)] = ended.get(len(keys), 0) | 1 << i
    out = []
    # name, parent's place in out, depth, words of the last turn, bitset
    stack = [(_ROOT, -1, 0, 0, (1 << len(ids)) - 1)]
    while stack:
        name, parent, depth, size, members = stack.pop()
        here, n = len(out), members.bit_count()
        done = members & ended.get(depth, 0)
        kids, rest = 0, members & ~done
        while rest:
            some = (rest & -rest).bit_length() - 1
            key = turns[some][depth]
            child = rest & index[depth, key]
            rest &= ~child
            kids += 1
            stack.append((xxhash.xxh3_128_digest(name + key), here, depth + 1, words[some][depth], child))
        names = []
        while done:
            names.append(ids[(done & -done).bit_length() - 1])
            done &= done - 1
        first = ids[(members & -members).bit_length() - 1]
        out.append([name, parent, depth, size, n, first, kids, int(not kids), int(not kids), n * size, size, ",".join(map(str, names)) if names else None])
    for row in reversed(out):  # children stand after their parents
        if row[1] >= 0:
            up = out[row[1]]
            up[8], up[9], up[10] = up[8] + row[8], up[9] + row[9], up[10] + row[10]
    for row in out:
        yield (*_pair(row[0]), *(_pair(out[row[1]][0]) if row[1] >= 0 else (None, None)), *row[2:])


def _shards(most: int):
    """Rows sorted by ``conv_id`` and order; shards are cut between conversations."""

    def run(batches):
        ids, turns, words, held = [], [], [], 0

        def close():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*shard_nodes(ids, turns, words)), _SCHEMA)], schema=_SCHEMA)

        for batch in batches:
            for conv, key, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not ids or ids[-1] != conv:
                    if held >= most:
                        yield close()
                        ids, turns, words, held = [], [], [], 0
                    ids.append(conv), turns.append([]), words.append([])
                    held += 1
                if key is not None:
                    turns[-1].append(key), words[-1].append(size)
                    held += 1
        if ids:
            yield close()

    return run


def _hash_ends(batches):
    """Lists of ids, sorted by node and first id, to one digest for each node; no list is held whole."""
    name, digest = None, None
    row = lambda: pa.RecordBatch.from_pydict({"hi": pa.array([x[0] for x in found], pa.int64()), "lo": pa.array([x[1] for x in found], pa.int64()), "ends_sha256": [x[2] for x in found]})
    for batch in batches:
        found = []
        for hi, lo, part in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (hi, lo) != name:
                if name:
                    found.append((*name, digest.hexdigest()))
                name, digest = (hi, lo), hashlib.sha256(part.encode())
            else:
                digest.update(b"," + part.encode())
        if found:
            yield row()
    found = [(*name, digest.hexdigest())] if name else []
    if found:
        yield row()


def _sum_up(nodes: DataFrame, depth: int, *values: str) -> DataFrame:
    """``values`` summed over the subtree of every node, by pointer jumping: each round doubles the reach.

    ``nodes (hi, lo, up_hi, up_lo)`` hold all ancestors of their nodes; a round is two joins on unique names.
    """
    state = nodes.select("hi", "lo", F.col("up_hi").alias("j_hi"), F.col("up_lo").alias("j_lo"), *values)
    reach = 1
    while reach <= depth:
        add = state.where("j_hi is not null").groupBy(F.col("j_hi").alias("hi"), F.col("j_lo").alias("lo")).agg(*[F.sum(v).alias(f"add_{v}") for v in values])
        jump = state.where("j_hi is not null").select(F.col("hi").alias("j_hi"), F.col("lo").alias("j_lo"), F.col("j_hi").alias("k_hi"), F.col("j_lo").alias("k_lo"))
        state = materialize(state.join(add, ["hi", "lo"], "left").join(jump, ["j_hi", "j_lo"], "left").select(
            "hi", "lo", F.col("k_hi").alias("j_hi"), F.col("k_lo").alias("j_lo"), *[(F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values]))
        reach *= 2
    return state.select("hi", "lo", *values)


def prefix_trie(sequences: DataFrame, order: list[str], shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie over ``sequences (conv_id, key, words)`` and more, each conversation's rows in ``order``.

    Columns, one row for each different sequence of first turns, the root with none: ``hi, lo`` (its name) and
    ``up_hi, up_lo`` (its parent's), ``conv_id`` (smallest member), ``parent_conv_id``, ``depth``, ``words`` (of the
    last turn), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    A row without a key says that its conversation exists and adds no turn. Turns alone are shuffled, as hashes; a
    first turn or a conversation that many share costs a row for each shard. Repeated rows are turns of their own; no
    rows give no nodes. A shard holds its turns, so at most ``shard_turns`` and those of one conversation.
    """
    n = partitions(sequences)
    rows = materialize(sequences)
    placed = rows.repartitionByRange(n, "conv_id").sortWithinPartitions("conv_id", *order).select("conv_id", "key", "words")
    found = materialize(placed.mapInArrow(_shards(shard_turns), _KINDS))
    least = [F.min(c).alias(c) for c in ("up_hi", "up_lo", "depth", "words", "first")]
    total = [F.sum(c).alias(c) for c in ("n", "kids", "childless", "leaves", "member_words", "node_words")]
    nodes = materialize(found.groupBy("hi", "lo").agg(*least, *total, F.count(F.lit(1)).alias("shards")))
    several = nodes.where("shards > 1").select(
        "hi", "lo", "up_hi", "up_lo", "depth", (F.col("shards") - 1).alias("again"), ((F.col("shards") - 1) * F.col("words")).alias("words_again"),
        (F.col("childless") - (F.col("kids") == 0).cast("long")).alias("leaves_again"))
    several = materialize(several)
    depth = several.agg(F.max("depth")).first()[0] or 0
    kids = several.where("up_hi is not null").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.sum("again").alias("kids_again"))
    wrong = _sum_up(several, depth, "words_again", "leaves_again").join(kids, ["hi", "lo"], "left")
    ends = found.where("ends is not null").select("hi", "lo", "first", "ends").repartition(n, "hi", "lo").sortWithinPartitions("hi", "lo", "first")
    ends = ends.mapInArrow(_hash_ends, "hi long, lo long, ends_sha256 string")
    less = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = nodes.join(wrong, ["hi", "lo"], "left").join(ends, ["hi", "lo"], "left")
    parents = nodes.where("kids > 0").select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("first").alias("parent_conv_id"), F.col("kids").alias("size"))
    below = join_groups(whole.where("depth > 0"), parents, ["up_hi", "up_lo"], "size").drop("size")
    return below.unionByName(whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))).select(
        "hi", "lo", "up_hi", "up_lo", F.col("first").alias("conv_id"), "parent_conv_id", "depth", "words", F.col("n").alias("n_convs"),
        (F.col("kids") - less("kids_again")).alias("n_children"), (F.col("leaves") - less("leaves_again")).alias("n_leaves"),
        (F.col("member_words") - F.col("node_words") + less("words_again")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
