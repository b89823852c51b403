"""Display tables and run reports built from metric rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from glintframe.functions.scalar import col, experiment_tag, format_display
from glintframe.operators.poses import normalized_rmse_percent
from glintframe.operators.views import aggregate_supported


def display(rows: DataFrame, labels, values: dict[str, int]) -> DataFrame:
    """Label columns as text and value columns with their number of digits."""
    return rows.select(*[F.col(c).cast("string").alias(c) for c in labels], *[format_display(c, d).alias(c) for c, d in values.items()])


def to_cells(table: str, wide: DataFrame, order: Column) -> DataFrame:
    """Wide text rows to (table, row label, col, value)."""
    parts = [F.struct(F.lit(i).alias("col"), F.col(c).alias("value")) for i, c in enumerate(wide.columns)]
    return wide.select(F.lit(table).alias("table"), order.cast("string").alias("row"), F.inline(F.array(*parts)))


# Label -> (parameters, digits); None digits means shortest form.
_PARAMETER_ROWS = [
    ("foreground_score/supported_score", (("foreground_score", 2), ("supported_score", 3)), ""),
    ("background_score/background_evidence", (("background_score", 3), ("background_evidence", 3)), ""),
    ("matte_score_low/matte_score_high", (("matte_score_low", 3), ("matte_score_high", 2)), ""),
    ("matte_evidence_low/matte_evidence_high", (("matte_evidence_low", 2), ("matte_evidence_high", 2)), ""),
    ("structure_barrier_strength", (("structure_barrier_strength", 2),), ""),
    ("matte_smoothness/matte_iterations", (("matte_smoothness", 1), ("matte_iterations", 0)), ""),
    ("matte_edge_sigma/matte_component_floor", (("matte_edge_sigma", 2), ("matte_component_floor", 2)), ""),
    ("weak_mapping_threshold/weak_boost_gain", (("weak_mapping_threshold", 2), ("weak_boost_gain", 2)), ""),
    ("small_width/large_width", (("small_width", 0), ("large_width", 0)), " px"),
    ("small_gain/large_gain", (("small_gain", 2), ("large_gain", 2)), ""),
    ("width_reference_short_side", (("width_reference_short_side", 0),), " px"),
]


def table_parameters(profiles: DataFrame, release: str, steepness: float = 8.0) -> DataFrame:
    """Label and value rows of one profile; the frozen steepness is asserted."""
    if steepness != 8.0:
        raise ValueError("the frozen steepness is 8")
    p = profiles.where(F.col("release") == release)
    head = F.concat_ws("/", format_display("threshold", 2), F.lit("8"), F.col("data_factor").cast("string"))
    rows = [F.struct(F.lit(0).alias("row"), F.lit("threshold/steepness/data_factor").alias("label"), head.alias("value"))]
    for i, (label, parts, unit) in enumerate(_PARAMETER_ROWS, 1):
        text = F.concat(F.concat_ws("/", *[format_display(F.col("blend_parameters")[n], d) for n, d in parts]), F.lit(unit))
        rows.append(F.struct(F.lit(i).alias("row"), F.lit(label).alias("label"), text.alias("value")))
    return p.select(F.inline(F.array(*rows)))


def table_suppression(summary: DataFrame, consensus: DataFrame, frames: DataFrame) -> DataFrame:
    """Seven metrics per scene."""
    robust = consensus.where("level = 'robust_majority'").select("scene", F.col("all_percent").alias("region_consistent"))
    return display(summary.join(robust, "scene").join(frames, "scene"), ["scene", "frames"],
                   {c: 2 for c in ("any_area_reduction", "strong_area_reduction", "source_evidence_attenuation",
                                   "meaningful_improvement_rate", "strong_suppression_rate", "region_consistent")})


# Shown fidelity metrics and their digits.
FIDELITY_DIGITS = {"protected_percent": 2, "direct_cie76_delta_e_mean": 2, "fusion_cie76_delta_e_mean": 2, "direct_highpass_correlation": 3,
                   "fusion_highpass_correlation": 3, "direct_edge_energy_ratio": 3, "fusion_edge_energy_ratio": 3}


def table_fidelity(stats: DataFrame) -> DataFrame:
    """Per-scene medians and the pooled row, from (scene, metric, frames, median) rows."""
    wide = stats.groupBy("scene").agg(F.max("frames").alias("frames"), *[
        F.max(F.when(F.col("metric") == m, F.col("median"))).alias(m) for m in FIDELITY_DIGITS])
    return display(wide, ["scene", "frames"], FIDELITY_DIGITS)


# Held-out metrics, label and digits.
_HELDOUT = {"psnr_orig": ("Raw-target PSNR (dB)", 2), "psnr_suppressed": ("Suppressed-target PSNR (dB)", 2), "render_spec_score": ("Source-core proxy score", 4),
            "render_score_mean": ("Whole-image proxy score", 4), "psnr_hf_textured": ("Texture high-frequency PSNR (dB)", 2),
            "mean_std_render": ("High-variance point luminance variance", 4)}


def table_heldout(raw: DataFrame, processed: DataFrame, keys=()) -> DataFrame:
    """One row per metric with the raw and the processed input side by side; a dash for what was not measured."""
    text = lambda d, m, digits: F.coalesce(format_display(m, digits), F.lit("-")) if m in d.columns else F.lit("-")
    shown = lambda d, name: d.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(label).alias("metric"), text(d, m, digits).alias(name)) for m, (label, digits) in _HELDOUT.items()])))
    return shown(raw, "raw").join(shown(processed, "processed"), [*keys, "metric"])


def table_diagnostics(counts: DataFrame, support: DataFrame, alignment: DataFrame, development: str = "S6") -> DataFrame:
    """Role, registered frames, supported poses and normalised RMSE per scene."""
    d = counts.join(support, "scene").join(alignment, "scene")
    return d.select("scene", F.when(F.col("scene").cast("string") == development, "Development").otherwise("Additional").alias("role"),
                    F.concat_ws("/", "raw_registered_frames", "other_registered_frames").alias("registered"),
                    F.concat_ws("/", "within_support_count", "views").alias("supported"),
                    format_display(normalized_rmse_percent(), 2).alias("normalized_rmse"))


_TRAJECTORY = ("mean_score_reduction_percent", "any_area_reduction_percent", "strong_area_reduction_percent", "source_region_attenuation_percent",
               "broad_improvement_coverage_percent", "strict_significant_coverage_percent", "strong_suppression_percent")


def table_trajectory(pooled: DataFrame) -> DataFrame:
    return display(pooled, ["scene"], {c: 2 for c in _TRAJECTORY})


def compare_experiments(runs: DataFrame, name: str, values: dict[str, int]) -> DataFrame:
    """One sorted row per run, a dash where a value is missing."""
    return runs.select(name, *[F.coalesce(format_display(c, d), F.lit("-")).alias(c) for c, d in values.items()]).orderBy(name)


def cross_scene_summary(fidelity_stats: DataFrame, views: DataFrame, registered: DataFrame) -> DataFrame:
    """2-D medians of every scene beside the 3-D values of its supported views, NULL where it has none.

    ``views`` are single views with ``within_support``; ``registered`` has the frames of each scene in both branches.
    """
    text = lambda d: d.withColumn("scene", F.col("scene").cast("string"))
    metrics = [*FIDELITY_DIGITS, "fusion_to_direct_delta_e_ratio"]
    medians = text(fidelity_stats).groupBy("scene").agg(F.max("frames").alias("frames"), *[
        F.max(F.when(F.col("metric") == m, F.col("median"))).alias(f"{m}_median") for m in metrics])
    counts = views.groupBy("scene").agg(F.count(F.lit(1)).alias("view_count"), F.count_if("within_support").alias("within_support_views"))
    pooled = aggregate_supported(views).select("scene", *[F.col(c).alias(f"supported_{c}") for c in _TRAJECTORY])
    for part in (registered, counts, pooled):
        medians = medians.join(text(part), "scene", "left")
    return medians


def frame_quality_report(frames: DataFrame, done: DataFrame, scored: DataFrame, keys=("scene",)) -> DataFrame:
    """Processed, existing and skipped frames of a run, with the mean score of the processed ones."""
    on = [*keys, "frame"]
    d = (frames.select(*on).join(done.select(*on).distinct().withColumn("_d", F.lit(True)), on, "left")
         .join(scored.select(*on, "mean"), on, "left"))
    status = F.when(F.col("_d"), "existing").when(F.col("mean").isNotNull(), "processed").otherwise("skipped")
    return d.withColumn("status", status).groupBy(*keys).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("processed", "existing", "skipped")],
        F.avg(F.when(F.col("status") == "processed", F.col("mean"))).alias("mean_score"))


def list_artifacts(manifest: DataFrame) -> DataFrame:
    """Figures and tables of a manifest with their levels and limitation."""
    one = lambda kind: manifest.select(F.explode(f"{kind}s").alias("a")).select(
        F.lit(kind).alias("kind"), F.col("a.id").cast("string").alias("id"), F.array_join("a.levels", ", ").alias("levels"), F.col("a.limitation").alias("limitation"))
    return one("figure").unionByName(one("table"))


def profile_of(runs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Named profile of each run by detector, blend mode, threshold and factor, else ``custom``; with its tag."""
    on = ["detector_version", "blend_mode", "threshold", "data_factor"]
    known = profiles.groupBy(*on).agg(F.max("release").alias("_release"))
    return (runs.join(known, on, "left").withColumn("profile", F.coalesce("_release", F.lit("custom"))).drop("_release")
            .withColumn("tag", experiment_tag("blend_mode", "threshold")))
