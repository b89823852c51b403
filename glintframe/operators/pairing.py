"""Matching frames, files and pixels of two or more variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from glintframe.functions.scalar import col, stem
from glintframe.session import materialize


def last_by_key(files: DataFrame, keys=("scene", "frame"), order: str = "path") -> DataFrame:
    """One row per key: of several files with one frame number the last path stays."""
    rest = [c for c in files.columns if c not in (*keys, order)]
    top = F.max(F.struct(order, *rest)).alias("_top")
    return files.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_top.{c}").alias(c) for c in (order, *rest)])


def common_frames(*variants: DataFrame, keys=("scene", "frame")) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), [v.select(*keys) for v in variants])


def pair_frames(raw: DataFrame, out: DataFrame, keys=("scene", "frame"), first: int | None = None) -> DataFrame:
    """Frames present in both variants; with ``first``, the lowest frames of each scene."""
    paired = raw.join(out, list(keys))
    return first_frames(paired, first, keys) if first else paired


def triple_frames(raw: DataFrame, candidate: DataFrame, fusion: DataFrame, keys=("scene", "frame")) -> DataFrame:
    return raw.join(candidate, list(keys)).join(fusion, list(keys))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail early when a pairing is empty (reads one row)."""
    if not df.take(1):
        raise ValueError(message)
    return df


def first_frames(df: DataFrame, n: int, keys=("scene", "frame")) -> DataFrame:
    """The ``n`` lowest frame numbers of each scene.

    The candidates are first cut to ``n`` inside salted slices of the scene, so the final
    ranking of a scene sees only ``slices * n`` rows.
    """
    scene, frame = keys
    frames = df.select(*keys).distinct()
    sliced = Window.partitionBy(scene, "_slice").orderBy(frame)
    kept = (frames.withColumn("_slice", F.pmod(F.xxhash64(frame), F.lit(64)))
            .withColumn("_rank", F.row_number().over(sliced)).where(F.col("_rank") <= n)
            .withColumn("_rank", F.row_number().over(Window.partitionBy(scene).orderBy(frame)))
            .where(F.col("_rank") <= n).select(*keys))
    return df.join(kept, list(keys), "left_semi")


def counterparts(raw: DataFrame, other: DataFrame, name: str = "name", scene=()) -> tuple[DataFrame, DataFrame]:
    """Match by stem, preferring png over jpg over jpeg; second result: names without a match."""
    suffix = F.lower(F.regexp_extract(col(name), r"\.([^.]*)$", 1))
    priority = F.when(suffix == "png", 0).when(suffix == "jpg", 1).when(suffix == "jpeg", 2)
    best = (other.withColumn("_stem", stem(name)).withColumn("_p", priority).where("_p is not null")
            .groupBy(*scene, "_stem").agg(F.min_by(col(name), F.struct("_p", name)).alias("match")))
    keyed = raw.withColumn("_stem", stem(name))
    on = [*scene, "_stem"]
    return keyed.join(best, on).drop("_stem"), keyed.join(best, on, "left_anti").drop("_stem")


def pair_pixels(before: DataFrame, after: DataFrame, score: str = "score") -> DataFrame:
    """Pixel-aligned ``raw``/``outp`` scores of two variants (one shuffle on the full pixel key)."""
    on = ["scene", "frame", "y", "x"]
    return (before.withColumnRenamed(score, "raw").join(after.select(*on, F.col(score).alias("outp")), on))


def shape_mismatch(first: DataFrame, second: DataFrame, keys=("scene", "frame")) -> DataFrame:
    """Frames whose dimensions differ, or which exist on one side only."""
    a = first.select(*keys, F.col("h").alias("h1"), F.col("w").alias("w1"))
    b = second.select(*keys, F.col("h").alias("h2"), F.col("w").alias("w2"))
    same = F.col("h1").eqNullSafe(F.col("h2")) & F.col("w1").eqNullSafe(F.col("w2"))
    return a.join(b, list(keys), "full_outer").where(~same)


def frame_size(pixels: DataFrame, keys=("scene", "frame")) -> DataFrame:
    return pixels.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def missing_counterparts(raw: DataFrame, other: DataFrame, keys=("scene", "frame")) -> DataFrame:
    return raw.join(other, list(keys), "left_anti")


def key_difference(first: DataFrame, second: DataFrame, keys) -> DataFrame:
    """Keys on one side only; the key sets are equal when this is empty."""
    a = first.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = second.select(*keys).distinct().withColumn("_b", F.lit(True))
    return (a.join(b, list(keys), "full_outer").where("_a is null or _b is null")
            .select(*keys, F.when(F.col("_a").isNull(), "second").otherwise("first").alias("side")))


# --- picking rows by position -------------------------------------------

def scene_position(df: DataFrame, order: list, scene=("scene",), name: str = "position") -> DataFrame:
    """Zero-based position of each row in its scene, and the rows of the scene as ``<name>_count``.

    Rows are dealt into ranges of equal size by (scene, order), of any type and with any outliers, and sorted inside
    each; a row's position is its place in its range plus the scene's rows in earlier ranges. One count for each
    range and scene is all that is summed up. The sorted rows are written once: both readers see one order.
    """
    keys = [*scene, *order]
    placed = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    whole = Window.partitionBy(*scene)
    before = F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    heads = (placed.groupBy(*scene, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
             .select(*scene, "_range", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(f"{name}_count")))
    return (placed.join(heads, [*scene, "_range"]).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first"))
            .select(*df.columns, name, f"{name}_count"))


def holdout_every(frames: DataFrame, every: int = 8, scene=("scene",), frame="frame") -> DataFrame:
    """Held-out frames: sorted position divisible by ``every``."""
    return scene_position(frames, [frame], scene).where(F.col("position") % every == 0).drop("position", "position_count")


def uniform_pick(candidates: DataFrame, order: str, wanted: int, scene=("scene",)) -> DataFrame:
    """``wanted`` evenly spaced rows per scene (positions rounded half to even).

    A scene with fewer rows than ``wanted`` raises when the result is computed.
    """
    if wanted < 1:
        raise ValueError("the number of picks must be positive")
    placed = scene_position(candidates, [order], scene)
    last = F.col("position_count") - 1
    enough = F.when(F.col("position_count") >= wanted, True).otherwise(
        F.raise_error(F.lit(f"fewer than {wanted} candidates in a scene")).cast("boolean"))
    if wanted == 1:
        return placed.where(enough & (F.col("position") == 0)).withColumn("sequence_index", F.lit(1)).drop("position", "position_count")
    # the slot k that could land on this position is the nearest multiple; test it and its neighbours
    k = F.round(F.col("position") * (wanted - 1) / F.greatest(last, F.lit(1)))
    hit = lambda d: F.when((k + d >= 0) & (k + d <= wanted - 1)
                           & (F.rint((k + d) * last / (wanted - 1)) == F.col("position")), k + d + 1)
    return (placed.where(enough).withColumn("sequence_index", F.coalesce(hit(0), hit(-1), hit(1)).cast("int"))
            .where("sequence_index is not null").drop("position", "position_count"))


def latest_step(files: DataFrame, name: str = "name", scene=("scene",)) -> DataFrame:
    """Render canvases of the highest step of each scene (``val_step<step>_<index>`` names)."""
    named = (files.withColumn("step", F.regexp_extract(col(name), r"val_step([0-9]+)_", 1))
             .where("step <> ''").withColumn("step", F.col("step").cast("long")))
    top = named.groupBy(*scene).agg(F.max("step").alias("step"))
    return named.join(top, [*scene, "step"], "left_semi")


def stride_sample(pixels: DataFrame, max_samples: int = 200_000) -> DataFrame:
    """Every ceil(n / max_samples)-th pixel of a frame in raster order; needs h and w."""
    step = F.greatest(F.lit(1), F.ceil(F.col("h") * F.col("w") / max_samples))
    return pixels.where((F.col("y") * F.col("w") + F.col("x")) % step == 0)


def split_canvas(canvas: DataFrame, values=("r", "g", "b")) -> DataFrame:
    """Left half = reference, right half = render, aligned on the left half's coordinates."""
    half = F.floor(F.col("w") / 2).cast("int")
    on = ["scene", "frame", "y", "x"]
    left = canvas.where(F.col("x") < half).select(*on, *[F.col(v).alias(f"ref_{v}") for v in values])
    right = (canvas.where((F.col("x") >= half) & (F.col("x") < 2 * half))
             .select("scene", "frame", "y", (F.col("x") - half).alias("x"), *[F.col(v).alias(f"out_{v}") for v in values]))
    return left.join(right, on)
