"""Sources and sinks: images, maps, metric tables, summaries, profiles, cells and checksums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from glintframe.functions.scalar import decode_map, encode_map, finite, frame_key

IMAGE_PATTERN = r"(?i)\.(jpe?g|png)$"


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files below a folder as (path, frame, h, w, channels, data); pixels stay encoded rows until asked for."""
    raw = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(path)
    i = F.col("image")
    return (raw.where(i.origin.rlike(IMAGE_PATTERN))
            .select(i.origin.alias("path"), frame_key(i.origin, "zero").alias("frame"), i.height.alias("h"), i.width.alias("w"),
                    i.nChannels.alias("channels"), i.data.alias("data")))


@F.pandas_udf(T.ArrayType(T.ShortType()))
def _bytes_to_values(data: pd.Series) -> pd.Series:
    return data.map(lambda b: np.frombuffer(b, dtype=np.uint8).astype(np.int16))


def explode_pixels(images: DataFrame, keys=("scene", "frame")) -> DataFrame:
    """Image bytes to one row per pixel with ``r g b`` in [0, 1]. Stored order is blue, green, red."""
    c = F.col("channels")
    row_bytes = F.col("w") * c
    # one image row at a time, so that a large image does not become one huge array
    rows = (images.select(*keys, "h", "w", "channels", "data", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
            .select(*keys, "h", "w", "channels", "y", _bytes_to_values(F.substring("data", F.col("y") * row_bytes + 1, row_bytes)).alias("v")))
    at = lambda k: F.element_at("v", (F.col("x") * c + k + 1).cast("int")) / 255.0
    grey = c == 1
    return (rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
            .select(*keys, "y", "x", "h", "w", at(F.when(grey, 0).otherwise(2)).alias("r"), at(F.when(grey, 0).otherwise(1)).alias("g"), at(F.lit(0)).alias("b")))


def hash_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    f = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path))
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("actual"))


def write_map(df: DataFrame, path: str, value: str, bits: int = 16) -> None:
    """Quantised map as Parquet, one folder per scene."""
    df.select("scene", "frame", "y", "x", encode_map(value, bits).alias("q")).write.mode("overwrite").partitionBy("scene").parquet(path)


def read_map(spark: SparkSession, path: str, value: str = "score", bits: int = 16) -> DataFrame:
    return spark.read.parquet(path).select("scene", "frame", "y", "x", decode_map("q", bits).alias(value))


_TEXT = ("view_id",)


def read_view_metrics(spark: SparkSession, path: str, exact_flag: bool = False) -> DataFrame:
    """Per-view metrics CSV: text ids, a support flag, and doubles (NaN becomes NULL).

    ``exact_flag`` accepts the spelling ``True`` only, else case does not matter.
    """
    raw = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    out = []
    for c in raw.columns:
        if c in _TEXT:
            out.append(F.col(c))
        elif c == "within_support":
            out.append(((F.col(c) == "True") if exact_flag else (F.lower(c) == "true")).alias(c))
        else:
            out.append(finite(F.col(c).cast("double")).alias(c))
    return raw.select(*out)


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


STATISTIC = "struct<mean: double, median: double, q25: double, q75: double>"
SUMMARY = f"scenes map<string, struct<frames: bigint, per_image_statistics: map<string, {STATISTIC}>>>"


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Nested summary to (scene, frames, metric, mean, median, q25, q75)."""
    scenes = read_json_document(spark, path, SUMMARY).select(F.explode("scenes").alias("scene", "s"))
    return (scenes.select("scene", F.col("s.frames").alias("frames"), F.explode("s.per_image_statistics").alias("metric", "v"))
            .select("scene", "frames", "metric", "v.*"))


PROFILE = ("struct<release: string, title: string, status: string, runnable: boolean, detector_version: string, blend_mode: string, "
           "threshold: double, data_factor: int, blend_parameters: map<string, double>>")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Registry keyed by release to one row per profile."""
    text = spark.read.option("wholetext", "true").text(path)
    return text.select(F.explode(F.from_json("value", f"map<string, {PROFILE}>")).alias("name", "p")).select("name", "p.*")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Display tables to (table, row, col, value)."""
    text = spark.read.option("wholetext", "true").text(path)
    tables = text.select(F.explode(F.from_json("value", "map<string, string>")).alias("table", "body"))
    body = tables.select("table", F.from_json("body", "array<array<string>>").alias("rows")).where("rows is not null and size(rows) > 0")
    rows = body.select("table", F.posexplode("rows").alias("row", "cells"))
    return rows.select("table", "row", F.posexplode("cells").alias("col", "value"))


# Field names of the trajectory file format.
VIEW = ("struct<view_id: string, height_index: int, direction_index: int, azimuth_degrees: double, raw_camera_to_world: array<array<double>>, "
        "deglared_camera_to_world: array<array<double>>, nearest_training_frame: bigint, distance_in_median_spacings: double, "
        "nearest_orientation_difference_degrees: double, within_support: boolean>")


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Trajectory manifest to one row per view, centres taken out of the pose matrices."""
    views = read_json_document(spark, path, f"schema string, views array<{VIEW}>").select("schema", F.inline("views"))
    at = lambda m, i: F.col(m)[i][3]
    return views.withColumns({**{n: at("raw_camera_to_world", i) for i, n in enumerate(("cx", "cy", "cz"))},
                              **{n: at("deglared_camera_to_world", i) for i, n in enumerate(("ox", "oy", "oz"))}})


def registered_counts(raw: DataFrame, other: DataFrame, keys=("scene",)) -> DataFrame:
    """Registered frames of both branches (rows with a ``frames`` array) and whether they agree."""
    a = raw.select(*keys, F.size("frames").alias("raw_registered_frames"))
    b = other.select(*keys, F.size("frames").alias("other_registered_frames"))
    return a.join(b, list(keys)).withColumn("equal", F.col("raw_registered_frames") == F.col("other_registered_frames"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``hash  path`` lines; blank lines are skipped, hashes lower-cased."""
    part = F.split("value", "  ", 2)
    return (spark.read.text(path).where("trim(value) <> ''")
            .select(F.trim(part[1]).alias("path"), F.lower(F.trim(part[0])).alias("expected")))


def write_rows(df: DataFrame, path: str, form: str = "csv") -> None:
    """Metric rows as CSV or JSON lines; the commit protocol publishes all files or none."""
    writer = df.write.mode("overwrite")
    (writer.option("header", "true").csv(path) if form == "csv" else writer.json(path))
