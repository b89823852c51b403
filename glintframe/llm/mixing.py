"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glintframe.llm.common import partitions
from glintframe.session import materialize

WEIGHTS = (5, 2, 1)
CAP = 3


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target of every row ``(source, source_size)``: all sizes shared by weight, none above ``cap`` times its own.

    Sources in code point order, null last, take the weights in turn. What the cap cuts off goes to the others by
    weight: with the sources in order of ``cap * size / weight``, the first that stays below its cap when all before
    it are full sets the level of the rest. One row per source, so the windows hold sources, never documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long"))
    order = Window.orderBy(cap * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    left = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(cap * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    level = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    filled = weighed.withColumn("level", level)
    free = F.when(F.col("level") <= cap * F.col("source_size") / F.col("weight"), F.struct(cap * F.col("source_size") / F.col("weight"), "level"))
    common = F.min(free).over(Window.partitionBy())["level"]
    return (filled.withColumn("common", common)
            .select("source", "source_size", F.least(F.col("weight") * F.col("common"), (cap * F.col("source_size")).cast("double")).alias("target")))


def offset(source: Column, seed: str) -> Column:
    """The source's random offset in [0, 1): 24 bits of a hash of seed and name."""
    name = F.concat(F.lit(seed), F.when(source.isNull(), F.lit("|0")).otherwise(F.lit("|1")), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 6), 16, 10).cast("double") / float(1 << 24)


def mix(rows: DataFrame, source: Column, size: Column, key: Column, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """``rows`` with ``mix_size, mix_source_size, mix_target, mix_copies``; columns of these names are replaced.

    Every row of a source expects ``target / source_size`` copies. Rows stand in order of size and key within
    their source, so that the words taken stay within one large document of the target; prefix sums of expected
    copies plus the source's offset are cut at the integers, and each boundary gives one copy. The positions come
    from one range shuffle and a running number inside each partition, so a source of any size is spread; only one
    count for each partition and source is summed up. The sorted rows are written once: both passes see one order.

    Null sources form a source of their own, null sizes count 0, null keys come first; rows that repeat are separate
    rows; a source without words has target 0 and takes nothing; no rows give no rows.
    """
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), source.cast("string").alias("source"),
                         F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("size"), key.alias("key"))
    # a rank of sources keeps null last
    named = packed.select("row", F.col("source").isNull().alias("nameless"), "source", "size", "key")
    order = ["nameless", "source", "size", "key"]
    placed = materialize(named.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
                         .select("row", "source", "size", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    heads = placed.groupBy(part.alias("part"), "source").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = heads.select("part", "source", before.alias("before"), "first")
    goal = targets(heads.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    goal = goal.select(F.col("source").alias("name"), "source_size", "target")
    plan = starts.join(goal, F.col("source").eqNullSafe(F.col("name"))).select(
        "part", F.col("source").alias("name"), "before", "first", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"), offset(F.col("source"), seed).alias("u"))
    joined = placed.withColumn("in", part).join(plan, (F.col("in") == F.col("part")) & F.col("source").eqNullSafe(F.col("name")))
    k = F.col("before") + F.col("at") - F.col("first")
    cut = lambda n: F.floor(n * F.col("rate") + F.col("u"))
    copies = F.least(cut(k + 1) - cut(k), F.ceil("rate")).cast("long")
    own = {"mix_size", "mix_source_size", "mix_target", "mix_copies"}
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in rows.columns if c not in own], F.col("size").alias("mix_size"),
                         F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), copies.alias("mix_copies"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, by words; the columns stay, whatever their names."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    mixed = mix(whole, F.col("doc.source"), word_count(F.col("doc.text")), F.col("doc.doc_id"))
    return mixed.where("mix_copies > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select("doc.*")
