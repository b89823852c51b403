"""Exact dedup by two Bloom filters: only rows whose hash may occur twice are shuffled. Built-in functions only.

The first pass counts the cells of a filter that lives in the shuffle, spread over all tasks: a row sends one cell
number, which partial aggregation reduces before. The cells hit twice or more become the second filter, blocks of
bitmaps that every task holds. A row with a bit not set there has no copy and passes straight through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glintframe.llm.common import join_groups, text_session
from glintframe.session import materialize

CELL_BITS = 44  # of the first filter, which is spread and sparse; a tenth of a percent of 10^10 rows meet by chance
BLOCK_BITS = 1 << 15  # of the second filter: one Spark bitmap, 4 KiB
MOST_BLOCKS = 1 << 14  # it is sent to all tasks, so 64 MiB at most; a fuller filter lets more rows through to the exact part
HASHES = 4
BITS_A_CELL = 16


def normal_text(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.sha2(normal_text(text).cast("binary"), 256)


def _cell(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - CELL_BITS)


def _place(cell: Column, blocks: int) -> tuple[Column, Column]:
    """Block of a cell, and its bits in that block."""
    block = F.pmod(F.xxhash64(cell), F.lit(blocks))
    return block, F.transform(F.sequence(F.lit(1), F.lit(HASHES)), lambda i: F.pmod(F.xxhash64(cell, i), F.lit(BLOCK_BITS)))


def repeated_cells(rows: DataFrame, key: str) -> DataFrame:
    """First pass: the ``cell`` numbers that at least two rows hit."""
    return rows.groupBy(_cell(F.col(key)).alias("cell")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")


def bloom_filter(cells: DataFrame, blocks: int) -> DataFrame:
    """The second filter as ``(block, bits)``, at most ``blocks`` rows of 4 KiB."""
    block, bits = _place(F.col("cell"), blocks)
    return cells.select(block.alias("block"), F.explode(bits).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _is_set(bits: Column, bit: Column) -> Column:
    octet = F.conv(F.hex(F.substring(bits, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.getbit(octet, (bit % 8).cast("int")) == 1


def with_suspicion(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with the boolean ``suspect``: false only where no other row has the same ``key``.

    The second filter has ``BITS_A_CELL`` bits for each repeated cell, and at most ``MOST_BLOCKS`` blocks, which bounds
    what is sent to every task for any input. Rows are not moved. Column names that begin with ``bloom_`` are taken.
    """
    cells = materialize(repeated_cells(rows, key))
    blocks = min(MOST_BLOCKS, max(1, -(-cells.count() * BITS_A_CELL // BLOCK_BITS)))
    made = F.broadcast(bloom_filter(cells, blocks).withColumnsRenamed({"block": "bloom_block", "bits": "bloom_bits"}))
    block, bits = _place(_cell(F.col(key)), blocks)
    tested = rows.withColumns({"bloom_in": block, "bloom_at": bits}).join(made, F.col("bloom_in") == F.col("bloom_block"), "left")
    found = F.forall("bloom_at", lambda bit: _is_set(F.col("bloom_bits"), bit))
    return tested.select(*rows.columns, (F.col("bloom_bits").isNotNull() & F.coalesce(found, F.lit(False))).alias("suspect"))


def duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are so after every run of ASCII white space has become one space; of equal texts the
    row with the smallest ``doc_id`` is kept. What is written, filtered and shuffled are ids and digests, never texts.

    Null and empty texts are equal; rows without an id come after all others in their group, whose ``keep_id`` is null
    if none has one; of rows that share text and id exactly one is kept; further columns are ignored; no rows give none.
    """
    text_session(docs.sparkSession)
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("text_sha256"))
                       .withColumn("row", F.monotonically_increasing_id()))
    marked = materialize(with_suspicion(rows, "text_sha256"))
    suspects = marked.where("suspect").drop("suspect")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")).alias("first")
    groups = materialize(suspects.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), first))
    judged = join_groups(suspects, groups, ["text_sha256"], "group_size").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
    alone = marked.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(judged)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows that ``duplicates`` keeps, whole, with all their columns, whatever their names.

    Rows that pass the filters are neither shuffled nor written before the result. Of the suspects only those with
    the smallest id of their text go on whole. Rows that share text and id leave any one of them.
    """
    text_session(docs.sparkSession)
    place = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").cast("long").alias("id"))
    rows = docs.select(digest(F.col("text")).alias("digest"), place.alias("place"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = with_suspicion(rows, "digest")
    alone, suspects = marked.where("not suspect"), marked.where("suspect")
    groups = materialize(suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min("place").alias("least")))
    chosen = join_groups(suspects, groups, ["digest"], "group_size").where(F.col("place") == F.col("least")).dropDuplicates(["digest"])
    return alone.select("row.*").unionByName(chosen.select("row.*"))
