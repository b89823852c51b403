"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glintframe.session import ship_code


def text_session(spark: SparkSession) -> SparkSession:
    """The session, set up for long texts: batches of rows for Python workers are bounded by octets, not by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return ship_code(spark)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return text_session(spark).read.parquet(f"{sf}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def remainder(key: Column, modulus: int) -> Column:
    """``crc32`` of the key as text, modulo ``modulus``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


HEAVY_PARTS = 1024  # a group with more than this fraction of all rows is heavy, so there are fewer heavy groups than this


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` joined with their ``groups``, whose column ``size`` counts the rows of each or more.

    Groups above a 1024th of all counted rows, fewer than 1024, are joined by broadcast, all others by a shuffle:
    no group of any size meets in one task.
    """
    limit = (groups.agg(F.sum(size)).first()[0] or 0) // HEAVY_PARTS
    heavy, light = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    others = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(others)


def numbered(docs: DataFrame) -> DataFrame:
    """``row``, a number, and ``doc``, the whole row, so that no column name clashes; written before it is used twice."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def octets(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def per_batch(fn: Callable[[dict[str, pa.Array]], dict[str, object]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turn a function of columns into one for ``mapInArrow``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(dict(zip(batch.schema.names, batch.columns)))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in schema for x in [out[f.name]]], schema=schema)

    return run


_memories: dict[str, Callable[[], None]] = {}


def sole_memory(name: str, forget: Callable[[], None] | None = None) -> None:
    """Called by a task that begins: what other operators remembered in this worker goes.

    Workers outlive their tasks, and so do memories of words. ``forget`` clears that of the operator ``name``.
    """
    for other in [n for n in _memories if n != name]:
        _memories.pop(other)()
    if forget is not None:
        _memories[name] = forget
    pa.default_memory_pool().release_unused()
