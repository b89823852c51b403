"""Observations of 3-D points across frames: sampling, robust statistics, residual maps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from glintframe.functions.scalar import clip, col
from glintframe.operators.quantiles import exact_quantiles, group_quantiles, hot_groups, with_frame_quantile
from glintframe.session import materialize, place

MAD_TO_SIGMA = 1.4826


def track_points(tracks: DataFrame, points: DataFrame, keys=("point_id",), max_error: float | None = None) -> DataFrame:
    """Tracks of valid points with the point's reprojection error.

    The invalid id (all bits set) reads as -1 once cast to a signed long.
    """
    valid = tracks.where(F.col("point_id").cast("long") >= 0)
    known = points if max_error is None else points.where(F.col("error") <= max_error)
    return valid.join(known, list(keys))


def pixel_of(tracks: DataFrame, camera_w, camera_h) -> DataFrame:
    """Pixel under each track position, scaled from camera to image size, truncated and clipped."""
    at = lambda v, size, cam: clip((col(v) * col(size) / cam).cast("int"), 0, 1e9)
    px = F.least(at("x", "w", col(camera_w)), F.col("w") - 1).cast("int")
    py = F.least(at("y", "h", col(camera_h)), F.col("h") - 1).cast("int")
    return tracks.withColumns({"px": px, "py": py})


def sample_at(tracks: DataFrame, pixels: DataFrame, values, camera_w=None, camera_h=None, keys=("frame",)) -> DataFrame:
    """Nearest-pixel samples at track positions. ``tracks`` needs the image size ``h, w``."""
    placed = pixel_of(tracks, camera_w if camera_w is not None else F.col("w"), camera_h if camera_h is not None else F.col("h"))
    grid = pixels.select(*keys, F.col("y").alias("py"), F.col("x").alias("px"), *values)
    # pixels are made by a generator, whose plan looks small: never broadcast
    return placed.join(grid.hint("merge"), [*keys, "py", "px"]).drop("py", "px")


def point_stats(observations: DataFrame, keys=("point_id",), min_views: int = 4) -> DataFrame:
    """Views, median, MAD and 90th percentile of every point, and whether it is usable."""
    base = group_quantiles(observations, keys, "lum", {"median": 0.5, "p90": 0.9}, count_as="n_views")
    spread = group_quantiles(observations.join(base.select(*keys, "median"), list(keys)), keys,
                             F.abs(F.col("lum") - F.col("median")), {"mad": 0.5})
    return base.join(spread, list(keys)).withColumn("usable", F.col("n_views") >= min_views)


def positive_residual(noise: float = 0.01, mad_scale: float = 1.5) -> Column:
    limit = F.greatest(F.lit(noise), noise + mad_scale * MAD_TO_SIGMA * F.col("mad"))
    return F.greatest(F.col("lum") - F.col("median") - limit, F.lit(0.0))


def stability(min_views: int = 4, noise: float = 0.01) -> Column:
    scale = F.greatest(3.0 * MAD_TO_SIGMA * F.col("mad") + noise, F.lit(0.02))
    seen = clip((F.col("n_views") - min_views + 1) / 4.0)
    steady = clip(F.exp(-F.greatest(F.col("p90") - F.col("median"), F.lit(0.0)) / scale) * seen)
    return F.when(F.col("usable"), steady).otherwise(0.0)


def observation_residuals(observations: DataFrame, keys=("point_id",), min_views: int = 4) -> DataFrame:
    """Every observation with its positive residual and its point's stability (usable points only)."""
    stats = point_stats(observations, keys, min_views).where("usable")
    return (observations.join(stats, list(keys))
            .withColumns({"residual": positive_residual(), "stability": stability(min_views)}))


def residual_scale(residuals: DataFrame, points: DataFrame, scene=(), max_error: float = 2.5) -> DataFrame:
    """p50/p90/p95/p99 of positive residuals of well-reconstructed points; p95 normalises the maps."""
    good = points.where(F.col("error") <= max_error).select(*scene, "point_id")
    kept = residuals.where("residual > 0").join(good, [*scene, "point_id"], "left_semi")
    return exact_quantiles(kept, scene, "residual", {"p50": 0.5, "p90": 0.9, "norm_scale": 0.95, "p99": 0.99}, count_as="positive")


def view_spread(observations: DataFrame, keys=("point_id",), min_views: int = 4, value: str = "lum") -> DataFrame:
    """Population standard deviation over the views of each usable point."""
    return (observations.groupBy(*keys).agg(F.count(value).alias("n_views"), F.stddev_pop(value).alias("std"))
            .where(F.col("n_views") >= min_views))


def view_variance(spread: DataFrame, scene=(), top: float = 0.1) -> DataFrame:
    """Percentiles of the spreads and the cut of the most view-dependent points."""
    return exact_quantiles(spread, scene, "std", {"std_p50": 0.5, "std_p90": 0.9, "std_p99": 0.99, "spec_cut": 1.0 - top},
                           count_as="points_used")


def specular_points(spread: DataFrame, summary: DataFrame, scene=()) -> DataFrame:
    """Points at or above the cut (ties stay in). The cut is one row per scene."""
    joined = spread.join(summary.select(*scene, "spec_cut"), list(scene)) if scene else spread.join(F.broadcast(summary.select("spec_cut")))
    return joined.where(F.col("std") >= F.col("spec_cut")).drop("spec_cut")


def specular_samples(samples: DataFrame, chosen: DataFrame, keys=("point_id",)) -> DataFrame:
    return samples.join(chosen.select(*keys), list(keys), "left_semi")


def view_dependence_ratio(samples: DataFrame, keys=("point_id",), scene=(), reference="ref", render="out") -> DataFrame:
    """Mean spread in the render over mean spread in the reference, points with two views or more."""
    per_point = (samples.groupBy(*scene, *keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(reference).alias("s_ref"),
                                                    F.stddev_pop(render).alias("s_out")).where("n >= 2"))
    m_ref, m_out = F.avg("s_ref"), F.avg("s_out")
    return per_point.groupBy(*scene).agg(F.count(F.lit(1)).alias("points"), m_ref.alias("mean_std_ref"), m_out.alias("mean_std_out"),
                                         (m_out / F.greatest(m_ref, F.lit(1e-8))).alias("r_vd"))


# --- robust affine fits --------------------------------------------------

def _trimmed_line(x: np.ndarray, y: np.ndarray, rounds: int, min_samples: int) -> tuple[float, float]:
    """Gain and offset of one group, before clipping; the rules are those of ``_affine_by_rounds``."""

    def median(v):
        v = np.sort(v[~np.isnan(v)])
        low, high = v[(len(v) - 1) // 2], v[len(v) // 2]
        return low + 0.5 * (high - low)

    gain, offset, keep = 1.0, 0.0, np.ones(len(x), bool)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            u, v = x[keep], y[keep]
            if not len(u) or len(u) < min_samples:
                break
            mx, my = u.mean(), v.mean()
            if u.min() == u.max():
                gain, offset = mx * my / (mx * mx + 1), my / (mx * mx + 1)
            else:
                gain = ((u - mx) * (v - my)).sum() / ((u - mx) ** 2).sum()
                offset = my - gain * mx
            left = v - (gain * u + offset)
            if np.isnan(left).all():
                break
            centre = median(left)
            mad = median(np.abs(left - centre))
            if not mad > 1e-6:
                break
            keep = np.abs(y - (gain * x + offset) - centre) <= 3.0 * MAD_TO_SIGMA * mad
    return float(gain), float(offset)


def robust_affine(df: DataFrame, keys, x: str, y: str, rounds: int = 5, min_samples: int = 100, group_rows: int = 2_000_000) -> DataFrame:
    """Per group: ``y ~ gain * x + offset`` with outliers rejected round by round.

    Groups up to ``group_rows`` rows are placed once and go through all rounds where they lie; the rounds of
    larger groups are aggregates and exact medians over the cluster. A group stops when fewer than
    ``min_samples`` remain or its deviation vanishes. Gain is clipped to [0.5, 2], offset to +-0.25.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where(
        "_x is not null and _y is not null and not isnan(_x) and not isnan(_y)")
    rows = materialize(rows)
    hot = hot_groups(rows, keys, group_rows)
    small = rows if hot is None else rows.join(hot, keys, "left_anti")

    def fit(key, group):
        # a group without a key has no fit
        known = all(k.as_py() is not None for k in key)
        xs, ys = (group.column(c).to_numpy() for c in ("_x", "_y"))
        found = _trimmed_line(xs, ys, rounds, min_samples) if known else (1.0, 0.0)
        return pa.table([pa.array([v.as_py()], v.type) for v in key] + [pa.array([v], pa.float64()) for v in found], names=[*keys, "gain", "offset"])

    schema = StructType([*[rows.schema[k] for k in keys], StructField("gain", DoubleType()), StructField("offset", DoubleType())])
    fits = materialize(place(small, *keys).groupBy(*keys).applyInArrow(fit, schema))
    if hot is not None:
        fits = fits.unionByName(_affine_by_rounds(rows.join(hot, keys, "left_semi"), keys, rounds, min_samples))
    return fits.select(*keys, clip("gain", 0.5, 2.0).alias("gain"), clip("offset", -0.25, 0.25).alias("offset"))


def _affine_by_rounds(rows: DataFrame, keys, rounds: int, min_samples: int) -> DataFrame:
    """Fits of groups of any size: a round is one regression aggregate and two exact medians over all groups at once.

    Only the fits, one row per group, are written between rounds.
    """
    fits = rows.select(*keys).distinct().select(
        *keys, F.lit(1.0).alias("gain"), F.lit(0.0).alias("offset"), F.lit(None).cast("double").alias("centre"),
        F.lit(None).cast("double").alias("mad"), F.lit(True).alias("active"))
    for _ in range(rounds):
        off = F.abs(F.col("_y") - (F.col("gain") * F.col("_x") + F.col("offset")) - F.col("centre"))
        # the first round has no centre yet and keeps every row
        inlier = F.col("centre").isNull() | (off <= 3.0 * MAD_TO_SIGMA * F.col("mad"))
        kept = rows.join(fits.where("active"), keys).where(inlier).select(*keys, "_x", "_y")
        mx, my = F.avg("_x"), F.avg("_y")
        line = (kept.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"),
            # a constant x has no slope: the smallest-norm line through the mean
            F.coalesce(F.regr_slope("_y", "_x"), mx * my / (mx * mx + 1)).alias("_g"),
            F.coalesce(F.regr_intercept("_y", "_x"), my / (mx * mx + 1)).alias("_o")).where(F.col("_n") >= min_samples))
        residual = kept.join(line, keys).select(*keys, "_g", "_o", (F.col("_y") - (F.col("_g") * F.col("_x") + F.col("_o"))).alias("_r"))
        centre = exact_quantiles(residual, keys, "_r", {"_c": 0.5})
        mad = exact_quantiles(residual.join(centre, keys), keys, F.abs(F.col("_r") - F.col("_c")), {"_m": 0.5})
        step = line.join(centre, keys).join(mad, keys)
        fits = materialize(fits.join(step, keys, "left").select(
            *keys, F.coalesce("_g", "gain").alias("gain"), F.coalesce("_o", "offset").alias("offset"),
            F.coalesce("_c", "centre").alias("centre"), F.coalesce("_m", "mad").alias("mad"),
            (F.coalesce("_m", F.lit(0.0)) > 1e-6).alias("active")))
        if not fits.where("active").take(1):
            break
    return fits.select(*keys, "gain", "offset")


def exposure_align(observations: DataFrame, scene=(), min_samples: int = 20) -> tuple[DataFrame, DataFrame]:
    """Fit each frame's luminance to the per-point median and apply the fit.

    Returns the aligned observations and the gains and offsets. The rejection rule is that of
    ``robust_affine``; the original helper is not published, so this definition is ours.
    """
    keys = [*scene, "frame"]
    median = exact_quantiles(observations, [*scene, "point_id"], "lum", {"_med": 0.5})
    paired = observations.join(median, [*scene, "point_id"])
    fits = robust_affine(paired, keys, "lum", "_med", min_samples=min_samples)
    aligned = observations.join(fits, keys).withColumn("lum", F.col("gain") * F.col("lum") + F.col("offset")).drop("gain", "offset")
    return aligned, fits


def exposure_report(observations: DataFrame, fits: DataFrame, scene=(), min_observations: int = 20) -> DataFrame:
    """Gain and offset p5/p50/p95 over frames with enough observations."""
    keys = [*scene, "frame"]
    enough = observations.groupBy(*keys).agg(F.count("lum").alias("_n")).where(F.col("_n") >= min_observations)
    used = fits.join(enough, keys, "left_semi")
    probs = {"p5": 0.05, "p50": 0.5, "p95": 0.95}
    long = used.select(*scene, F.inline(F.array(
        F.struct(F.lit("gain").alias("term"), F.col("gain").alias("value")),
        F.struct(F.lit("offset").alias("term"), F.col("offset").alias("value")))))
    return exact_quantiles(long, [*scene, "term"], "value", probs, count_as="frames")


# --- sparse to dense -----------------------------------------------------

def track_weight(n_views, edge) -> Column:
    """Well-seen points count more; points on strong edges count less."""
    return F.sqrt(F.least(col(n_views).cast("double"), F.lit(10.0))) * (0.1 + 0.9 * (1.0 - col(edge)) ** 2)


def edge_share(pixels: DataFrame, gradient: str = "gradient") -> DataFrame:
    """Gradient over its 95th percentile in the frame, clipped (0 for flat frames)."""
    scaled = with_frame_quantile(pixels, {"_p95": (F.col(gradient), 0.95)})
    share = F.when(F.col("_p95") > 1e-8, clip(F.col(gradient) / F.col("_p95"))).otherwise(0.0)
    return scaled.withColumn("edge", share).drop("_p95")


def splat_maps(samples: DataFrame, value, weight, sigma: float = 6.0, norm_scale=1.0, keys=("frame",), name: str = "value") -> DataFrame:
    """Weighted Gaussian spread of point values to pixels; rows only where a point reaches.

    ``samples`` carries ``px, py, h, w``. The kernel is separable: points spread along their
    row, are summed there, and the row sums spread along the columns, so a point emits a
    line and not a square. The kernel is our own definition.
    """
    reach = max(int(3 * sigma + 0.5), 1)
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    bell = lambda d: F.exp(-(F.col(d) ** 2) / (2.0 * sigma * sigma))
    rows = (samples.select(*keys, "px", "py", "h", "w", col(value).alias("_v"), col(weight).alias("_w"))
            .where("_v is not null and _w is not null")
            .withColumn("_d", F.explode(offsets)).withColumn("x", F.col("px") + F.col("_d")).where("x >= 0 and x < w")
            .groupBy(*keys, "py", "x").agg(F.first("h").alias("h"), F.sum(F.col("_w") * bell("_d")).alias("_w"),
                                           F.sum(F.col("_w") * F.col("_v") * bell("_d")).alias("_v")))
    spread = (rows.withColumn("_d", F.explode(offsets)).withColumn("y", F.col("py") + F.col("_d")).where("y >= 0 and y < h"))
    return spread.groupBy(*keys, "y", "x").agg(
        clip(F.try_divide(F.sum(F.col("_v") * bell("_d")), F.sum(F.col("_w") * bell("_d"))) / col(norm_scale)).alias(name))
