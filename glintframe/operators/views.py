"""Per-view scores of rendered trajectories, their pooled values and their intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glintframe.functions.scalar import STRONG, WEAK, finite, lum709, percentage, relative_reduction
from glintframe.operators.pairing import scene_position
from glintframe.operators.quantiles import exact_quantiles

# Additive columns of a view row: name -> expression over the view columns.
_WEIGHTED = ("raw_mean", "out_mean", "raw_any", "out_any", "raw_strong", "out_strong")
_COUNTS = ("source_score", "residual_score", "source_px", "improved_px", "strict_px", "strong_px", "strong_suppressed_px")


def score_view(pixels: DataFrame, keys=("scene", "frame"), weak: float = WEAK, strong: float = STRONG) -> DataFrame:
    """One row per view from paired pixels (``raw``, ``outp`` and optionally ``r g b`` / ``sr sg sb``).

    ``any`` counts every pixel at or above the weak threshold, strong ones included.
    """
    raw, out = F.col("raw"), F.col("outp")
    source, hard = raw >= weak, raw >= strong
    drop = raw - out
    n = F.count(F.lit(1))
    before, after = F.sum(F.when(source, raw)), F.sum(F.when(source, out))
    aggs = [n.alias("pixels"), F.avg(raw).alias("raw_mean"), F.avg(out).alias("out_mean"),
            percentage(F.count_if(source), n).alias("raw_any"), percentage(F.count_if(out >= weak), n).alias("out_any"),
            percentage(F.count_if(hard), n).alias("raw_strong"), percentage(F.count_if(out >= strong), n).alias("out_strong"),
            F.count_if(source).alias("source_px"), F.count_if(source & (drop > 0)).alias("improved_px"),
            F.count_if(source & (drop >= 0.03) & (drop >= 0.30 * raw)).alias("strict_px"),
            F.count_if(hard).alias("strong_px"), F.count_if(hard & (out < strong)).alias("strong_suppressed_px"),
            F.coalesce(before, F.lit(0.0)).alias("source_score"), F.coalesce(after, F.lit(0.0)).alias("residual_score"),
            relative_reduction(before, after).alias("source_region_attenuation_percent")]
    if "sr" in pixels.columns:
        aggs += [F.avg(lum709("r", "g", "b")).alias("raw_mean_luminance"), F.avg(lum709("sr", "sg", "sb")).alias("out_mean_luminance")]
    rows = pixels.groupBy(*keys).agg(*aggs)
    for name, value in (("raw_p95", "raw"), ("out_p95", "outp")):
        rows = rows.join(exact_quantiles(pixels, keys, value, {name: 0.95}), list(keys))
    return rows


def _sums(views: DataFrame) -> list[Column]:
    px = F.col("pixels").cast("double")
    lower = lambda a, b: F.sum(F.when(F.col(a) < F.col(b), 1).otherwise(0)).cast("long")
    return [F.count(F.lit(1)).alias("view_count"), F.sum("pixels").alias("pixel_count"),
            *[F.sum(F.col(c) * px).alias(f"w_{c}") for c in _WEIGHTED],
            *[F.sum(finite(F.col(c).cast("double"))).alias(f"s_{c}") for c in _COUNTS],
            lower("out_mean", "raw_mean").alias("l_mean"), lower("out_any", "raw_any").alias("l_any"),
            lower("out_strong", "raw_strong").alias("l_strong")]


def attach_views(scores: DataFrame, manifest: DataFrame, keys=("scene", "view_id")) -> DataFrame:
    """Manifest columns beside each scored view, with the three reductions of the view."""
    rows = scores.join(manifest, list(keys))
    return rows.withColumns({f"{n}_reduction_percent": relative_reduction(f"raw_{c}", f"out_{c}")
                             for n, c in (("mean_score", "mean"), ("any_area", "any"), ("strong_area", "strong"))})


_SUM_NAMES = (["view_count", "pixel_count"] + [f"w_{c}" for c in _WEIGHTED] + [f"s_{c}" for c in _COUNTS]
              + ["l_mean", "l_any", "l_strong"])


def _finish(sums: DataFrame, keys) -> DataFrame:
    px = F.col("pixel_count").cast("double")
    mean = lambda c: F.col(f"w_{c}") / px
    s = lambda c: F.col(f"s_{c}")
    return sums.select(
        *keys, "view_count", "pixel_count", *[mean(c).alias(c) for c in _WEIGHTED],
        relative_reduction(s("source_score"), s("residual_score")).alias("source_region_attenuation_percent"),
        percentage(s("improved_px"), s("source_px")).alias("broad_improvement_coverage_percent"),
        percentage(s("strict_px"), s("source_px")).alias("strict_significant_coverage_percent"),
        percentage(s("strong_suppressed_px"), s("strong_px")).alias("strong_suppression_percent"),
        percentage("l_mean", "view_count").alias("views_with_lower_mean_score_percent"),
        percentage("l_any", "view_count").alias("views_with_lower_any_area_percent"),
        percentage("l_strong", "view_count").alias("views_with_lower_strong_area_percent"),
        relative_reduction(mean("raw_mean"), mean("out_mean")).alias("mean_score_reduction_percent"),
        relative_reduction(mean("raw_any"), mean("out_any")).alias("any_area_reduction_percent"),
        relative_reduction(mean("raw_strong"), mean("out_strong")).alias("strong_area_reduction_percent"))


def aggregate_views(views: DataFrame, keys=("scene",)) -> DataFrame:
    """Pixel-weighted means, coverages, share of improved views, reductions."""
    return _finish(views.groupBy(*keys).agg(*_sums(views)), keys)


def aggregate_supported(views: DataFrame, keys=("scene",)) -> DataFrame:
    return aggregate_views(views.where("within_support"), keys)


def with_path_third(views: DataFrame, order: str = "view_id", scene=("scene",)) -> DataFrame:
    """Thirds of the sorted path; the first ones take the remainder."""
    placed = scene_position(views, [order], scene, "_p")
    size, extra = F.floor(F.col("_p_count") / 3), F.col("_p_count") % 3
    long = extra * (size + 1)
    third = F.when(F.col("_p") < long, F.floor(F.col("_p") / (size + 1))).otherwise(
        extra + F.floor((F.col("_p") - long) / F.greatest(size, F.lit(1))))
    return placed.withColumn("path_third", (third + 1).cast("int")).drop("_p", "_p_count")


def breakdown(views: DataFrame, by=("height", "direction", "path_third")) -> DataFrame:
    """Overall and per-attribute values of each scene.

    Views are first summed to their finest combination, so the grouping sets expand a
    small table and not the views.
    """
    fine = views.groupBy("scene", *by).agg(*_sums(views))
    sets = fine.groupingSets([["scene"], *[["scene", b] for b in by]], "scene", *by).agg(
        *[F.sum(n).alias(n) for n in _SUM_NAMES],
        F.grouping_id().alias("_g"))
    dims = F.coalesce(*[F.when(F.col(b).isNotNull(), F.lit(f"by_{b}")) for b in by], F.lit("overall"))
    level = F.coalesce(*[F.col(b).cast("long") for b in by])
    return _finish(sets.withColumns({"grouping": dims, "level": level}), ["scene", "grouping", "level"])


def scene_mean(rows: DataFrame, values, by=()) -> DataFrame:
    """Unweighted mean over scenes."""
    return rows.groupBy(*by).agg(*[F.avg(finite(v)).alias(v) for v in values])


# --- cluster bootstrap ---------------------------------------------------

_RATIOS = {  # name -> (numerator, denominator, is a reduction)
    "mean_score_reduction_percent": ("w_out_mean", "w_raw_mean", True),
    "any_area_reduction_percent": ("w_out_any", "w_raw_any", True),
    "strong_area_reduction_percent": ("w_out_strong", "w_raw_strong", True),
    "source_region_attenuation_percent": ("s_residual_score", "s_source_score", True),
    "broad_improvement_coverage_percent": ("s_improved_px", "s_source_px", False),
    "strict_significant_coverage_percent": ("s_strict_px", "s_source_px", False),
    "strong_suppression_percent": ("s_strong_suppressed_px", "s_strong_px", False),
}


def draw(seed: int, replicate, slot, n) -> Column:
    """Cluster index of one draw: a portable hash of seed, replicate and slot."""
    text = F.concat_ws("|", F.lit(seed), replicate, slot)
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), n)


def cluster_bootstrap(views: DataFrame, cluster: str = "direction", replicates: int = 10_000,
                      seed: int = 20260808) -> DataFrame:
    """95 % interval of seven ratios, resampling whole clusters of views.

    Views are reduced to additive sums per cluster, then to one row per replicate. The draws
    join the cluster sums on (scene, index); replicates, not scenes, spread the work.
    The pseudo-random stream is our own.
    """
    fine = views.groupBy("scene", cluster).agg(*_sums(views))
    by_scene = Window.partitionBy("scene")
    numbered = fine.withColumn("_i", F.row_number().over(by_scene.orderBy(cluster)) - 1).withColumn("_n", F.count(F.lit(1)).over(by_scene))
    names = sorted({c for num, den, _ in _RATIOS.values() for c in (num, den)})
    sizes = fine.groupBy("scene").agg(F.count(F.lit(1)).alias("_n"))
    draws = (sizes.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 100))))
             .repartition("scene", "_block")
             .withColumn("replicate", F.explode(F.sequence(F.col("_block") * 100, F.least((F.col("_block") + 1) * 100, F.lit(replicates)) - 1)))
             .withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
             .select("scene", "replicate", draw(seed, F.col("replicate"), F.col("slot"), F.col("_n")).alias("_i")))
    totals = (draws.join(numbered.select("scene", "_i", *names), ["scene", "_i"])
              .groupBy("scene", "replicate").agg(*[F.sum(c).alias(c) for c in names]))
    floor = lambda c: F.greatest(F.col(c), F.lit(1e-12))
    ratio = lambda num, den, red: 100.0 * ((F.col(den) - F.col(num)) if red else F.col(num)) / floor(den)
    long = totals.select("scene", F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), ratio(*spec).alias("value")) for name, spec in _RATIOS.items()])))
    bounds = exact_quantiles(long, ["scene", "metric"], "value", {"low": 0.025, "high": 0.975})
    point = (fine.groupBy("scene").agg(*[F.sum(c).alias(c) for c in names])
             .select("scene", F.inline(F.array(*[F.struct(F.lit(name).alias("metric"), ratio(*spec).alias("point"))
                                                 for name, spec in _RATIOS.items()]))))
    return (bounds.join(point, ["scene", "metric"])
            .withColumns({"minus": F.col("point") - F.col("low"), "plus": F.col("high") - F.col("point")}))
