"""Camera poses of two branches: alignment, nearest cameras, support and midpoint paths.

A pose row has ``scene, frame``, a centre and a unit quaternion. The raw branch uses
``cx cy cz, qw qx qy qz``, the other branch ``ox oy oz, pw px py pz``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from glintframe.functions.geometry import (inverse_pose, quat, quat_angle_deg, quat_axis_z, quat_midpoint, quat_product,
                                           transform_pose)
from glintframe.functions.scalar import AUDIT_SUPPORT, PLANNING_SUPPORT, angle_deg, col, percentage, within_support
from glintframe.operators.pairing import scene_position, uniform_pick
from glintframe.operators.quantiles import exact_quantiles
from glintframe.session import materialize

RAW, OTHER = ("cx", "cy", "cz"), ("ox", "oy", "oz")
FIT = ["scale", "tx", "ty", "tz", "gw", "gx", "gy", "gz"]


# --- similarity ----------------------------------------------------------

def _quaternion(m):
    """Quaternions of stacked rotations, from the largest of the four squared components."""
    d = np.einsum("nii->ni", m)
    four = 1 + np.stack([d.sum(1), d[:, 0] - d[:, 1] - d[:, 2], d[:, 1] - d[:, 0] - d[:, 2], d[:, 2] - d[:, 0] - d[:, 1]], 1)
    skew = np.stack([m[:, 2, 1] - m[:, 1, 2], m[:, 0, 2] - m[:, 2, 0], m[:, 1, 0] - m[:, 0, 1]], 1)
    even = m + m.transpose(0, 2, 1)
    rows = np.zeros((len(m), 4, 4))
    rows[:, [0, 1, 2, 3], [0, 1, 2, 3]] = four
    rows[:, 0, 1:] = rows[:, 1:, 0] = skew
    for i, j in ((0, 1), (0, 2), (1, 2)):
        rows[:, i + 1, j + 1] = rows[:, j + 1, i + 1] = even[:, i, j]
    best = rows[np.arange(len(m)), four.argmax(1)]
    best = best / np.linalg.norm(best, axis=1, keepdims=True)
    return best * np.where(best[:, :1] < 0, -1.0, 1.0)


def _solve(batches):
    """Rotation, scale and shift of many scenes at once from their 3x3 cross-covariances."""
    for b in batches:
        cov = b[[f"k{i}{j}" for i in range(3) for j in range(3)]].to_numpy().reshape(-1, 3, 3)
        left, values, right = np.linalg.svd(cov)
        fix = np.ones((len(b), 3))
        fix[:, 2] = np.sign(np.linalg.det(left @ right))
        turn = left @ (fix[:, :, None] * right)
        scale = (values * fix).sum(1) / b["variance"].to_numpy()
        shift = b[["mox", "moy", "moz"]].to_numpy() - scale[:, None] * np.einsum("nij,nj->ni", turn, b[["mcx", "mcy", "mcz"]].to_numpy())
        out = pd.DataFrame({"scene": b["scene"], "cameras": b["cameras"], "scale": scale})
        out[["tx", "ty", "tz"]] = shift
        out[["gw", "gx", "gy", "gz"]] = _quaternion(turn)
        yield out


def similarity_fit(poses: DataFrame, strict: bool = True) -> DataFrame:
    """Least-squares similarity raw -> other per scene.

    A scene with fewer than three cameras raises; with ``strict=False`` it has no row.

    Means and the cross-covariance are ordinary aggregates; only one small row per scene
    reaches Python, for the 3x3 decomposition. The fits are written once, since plans read
    them several times.
    """
    aggs = [F.count(F.lit(1)).alias("cameras")]
    aggs += [F.avg(c).alias(f"m{c}") for c in RAW + OTHER]
    aggs += [F.covar_pop(o, c).alias(f"k{i}{j}") for i, o in enumerate(OTHER) for j, c in enumerate(RAW)]
    aggs += [(F.var_pop("cx") + F.var_pop("cy") + F.var_pop("cz")).alias("variance")]
    enough = F.col("cameras") >= 3
    if strict:
        enough = F.when(enough, True).otherwise(F.raise_error(F.lit("fewer than three cameras in a scene")).cast("boolean"))
    sums = poses.groupBy("scene").agg(*aggs).where(enough)
    kind = poses.schema["scene"].dataType.simpleString()
    schema = f"scene {kind}, cameras bigint, scale double, tx double, ty double, tz double, gw double, gx double, gy double, gz double"
    return materialize(sums.mapInPandas(_solve, schema))


def alignment_residuals(poses: DataFrame, fit: DataFrame) -> DataFrame:
    """Per camera: squared centre error after alignment, and the rotation error in degrees."""
    d = poses.join(fit, "scene")
    centre, turned = transform_pose(RAW, quat("q"), "scale", quat("g"), ("tx", "ty", "tz"))
    square = sum(((c - F.col(o)) ** 2 for c, o in zip(centre, OTHER)), F.lit(0.0))
    return d.select("scene", "frame", square.alias("centre_error2"), quat_angle_deg(turned, quat("p")).alias("rotation_error"))


def alignment_summary(residuals: DataFrame, spacing: DataFrame) -> DataFrame:
    """RMSE, RMSE over the raw camera spacing, median and largest rotation error per scene."""
    rmse = F.sqrt(F.avg("centre_error2"))
    rows = residuals.groupBy("scene").agg(rmse.alias("rmse"), F.max("rotation_error").alias("rotation_error_max"))
    median = exact_quantiles(residuals, ["scene"], "rotation_error", {"rotation_error_median": 0.5})
    return (rows.join(median, "scene").join(spacing.select("scene", "spacing"), "scene")
            .withColumn("rmse_in_spacings", F.try_divide("rmse", "spacing")))


def normalized_rmse_percent(direct="rmse_in_raw_spacings", rmse="rmse", spacing="spacing"):
    """The stored ratio where present, else RMSE over spacing, in percent."""
    return F.coalesce(100.0 * col(direct), percentage(rmse, spacing))


# --- nearest camera ------------------------------------------------------

def nearest(queries: DataFrame, train: DataFrame, *, scene="scene", query="frame", at=RAW, frame="frame",
            train_at=RAW, other_only: bool = False) -> DataFrame:
    """Exact nearest training camera of every query, without comparing all pairs.

    Training positions are collapsed to distinct points and boxed in a tree that halves each axis by
    the number of points; its nodes keep their tight bounds and two of their points. All queries descend one level at a time: a node
    survives only if its bounds are not farther than the best point seen so far, so a query
    keeps a few nodes per level however many cameras share its scene. Ties go to the lowest frame.
    With ``other_only`` a camera does not match itself.
    """
    xyz = ("_x", "_y", "_z")
    pts = (train.select(scene, F.col(frame).alias("_f"), *[col(c).cast("double").alias(n) for c, n in zip(train_at, xyz)])
           .groupBy(scene, *xyz).agg(F.min("_f").alias("_f1"), F.max("_f").alias("_f2")))
    pts = materialize(pts.where(F.col(scene).isNotNull()))
    largest = pts.groupBy(scene).count().agg(F.max("count")).first()[0] or 1
    depth = max(math.ceil(math.log2(max(largest, 2)) / 2), 1)
    for c in xyz:  # halves of equal number along each axis, so no outlier crowds the others into one cell
        pts = scene_position(pts, [c], (scene,), "_p")
        pts = pts.withColumn(f"_i{c}", F.floor(F.col("_p") * (1 << depth) / F.col("_p_count")).cast("long")).drop("_p", "_p_count")
    pts = materialize(pts)
    q = queries.select(scene, F.col(query).alias("_q"), *[col(c).cast("double").alias(f"_q{n}") for c, n in zip(at, xyz)])
    dist2 = lambda a: sum(((F.col(f"_q{c}") - a(c)) ** 2 for c in xyz), F.lit(0.0))
    cell = [f"_c{c}" for c in xyz]
    frontier = q.withColumns({**{c: F.lit(0).cast("long") for c in cell}, "_best": F.lit(float("inf"))})
    by_query = Window.partitionBy(scene, "_q")
    for level in range(1, depth + 1):
        here = [F.shiftright(F.col(f"_i{c}"), depth - level).alias(f"_n{c}") for c in xyz]
        point = F.struct("_f1", "_f2", *xyz)
        nodes = (pts.select(scene, *here, *xyz, "_f1", "_f2").groupBy(scene, *[f"_n{c}" for c in xyz])
                 .agg(F.min(point).alias("_a"), F.max(point).alias("_b"),
                      *[F.min(c).alias(f"_min{c}") for c in xyz], *[F.max(c).alias(f"_max{c}") for c in xyz])
                 .withColumns({c: F.shiftright(F.col(f"_n{x}"), 1) for c, x in zip(cell, xyz)}))
        outside = lambda c: F.greatest(F.col(f"_min{c}") - F.col(f"_q{c}"), F.col(f"_q{c}") - F.col(f"_max{c}"), F.lit(0.0))
        bound = sum((outside(c) ** 2 for c in xyz), F.lit(0.0))
        sees = lambda p: dist2(lambda c: F.col(f"{p}.{c}"))
        if other_only:
            itself = lambda p: (F.col(f"{p}._f1") == F.col("_q")) & (F.col(f"{p}._f2") == F.col("_q"))
            reached = F.least(F.when(~itself("_a"), sees("_a")), F.when(~itself("_b"), sees("_b")))
        else:
            reached = F.least(sees("_a"), sees("_b"))
        frontier = (frontier.join(nodes, [scene, *cell])
                    .withColumn("_lower", bound)
                    .withColumn("_best", F.least(F.col("_best"), F.min(reached).over(by_query)))
                    .where(F.col("_lower") <= F.col("_best"))
                    .select(scene, "_q", *[f"_q{c}" for c in xyz], *[F.col(f"_n{c}").alias(k) for c, k in zip(xyz, cell)], "_best"))
    leaf = frontier.join(pts.select(scene, *[F.col(f"_i{c}").alias(k) for c, k in zip(xyz, cell)], *xyz, "_f1", "_f2"), [scene, *cell])
    found = F.col("_f1")
    if other_only:
        found = F.when(F.col("_f1") != F.col("_q"), F.col("_f1")).when(F.col("_f2") != F.col("_q"), F.col("_f2"))
    best = F.min(F.struct(dist2(F.col).alias("d2"), found.alias("f")))
    return (leaf.where(found.isNotNull()).groupBy(scene, "_q").agg(best.alias("_b"))
            .select(scene, F.col("_q").alias(query), F.col("_b.f").alias("nearest_frame"), F.sqrt("_b.d2").alias("nearest_distance")))


def median_spacing(poses: DataFrame, at=RAW) -> DataFrame:
    """Median distance of each camera to its nearest other camera."""
    pairs = nearest(poses, poses, at=at, train_at=at, other_only=True)
    return exact_quantiles(pairs, ["scene"], "nearest_distance", {"spacing": 0.5})


def support_measurement(queries: DataFrame, train: DataFrame, spacing: DataFrame, at=RAW, turn="q", train_at=RAW,
                        train_turn="q", query="frame") -> DataFrame:
    """Nearest training camera, distance in spacings, angle of the viewing directions, support flags."""
    found = nearest(queries, train, query=query, at=at, train_at=train_at)
    mine = queries.select("scene", query, *[c.alias(f"_a{i}") for i, c in enumerate(quat_axis_z(quat(turn)))])
    theirs = train.select("scene", F.col("frame").alias("nearest_frame"), *[c.alias(f"_b{i}") for i, c in enumerate(quat_axis_z(quat(train_turn)))])
    d = found.join(mine, ["scene", query]).join(theirs, ["scene", "nearest_frame"]).join(spacing.select("scene", "spacing"), "scene")
    angle = angle_deg(sum((F.col(f"_a{i}") * F.col(f"_b{i}") for i in range(3)), F.lit(0.0)))
    return (d.withColumns({"distance_in_spacings": F.try_divide("nearest_distance", "spacing"), "angle": angle})
            .withColumns({"within_planning_support": within_support("distance_in_spacings", "angle", PLANNING_SUPPORT),
                          "within_support": within_support("distance_in_spacings", "angle", AUDIT_SUPPORT)})
            .select("scene", query, "nearest_frame", "nearest_distance", "distance_in_spacings", "angle",
                    "within_planning_support", "within_support"))


def support_summary(measured: DataFrame) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if("within_support")
    return measured.groupBy("scene").agg(
        n.alias("views"), ok.alias("within_support_count"), (ok / n).alias("within_support_fraction"),
        F.max("distance_in_spacings").alias("maximum_distance"), F.max("angle").alias("maximum_angle"),
        F.count_distinct("nearest_frame").alias("unique_nearest_frames"))


# --- midpoint path -------------------------------------------------------

def midpoint_poses(poses: DataFrame, fit: DataFrame) -> DataFrame:
    """Halfway views between consecutive common cameras, symmetric in both branches.

    Each camera's anchor is the midpoint of its raw pose and its other pose mapped back; a view
    lies between the anchors of two neighbours. Neighbours meet by an equi-join on position.
    """
    d = poses.join(fit, "scene")
    back, turned = inverse_pose(OTHER, quat("p"), "scale", quat("g"), ("tx", "ty", "tz"))
    d = d.withColumns({**{f"_b{i}": c for i, c in enumerate(back)}, **{f"_h{n}": c for n, c in zip("wxyz", turned)}})
    mid = quat_midpoint(quat("q"), quat("_h"))
    anchors = d.select("scene", "frame", *[(0.5 * (F.col(c) + F.col(f"_b{i}"))).alias(c) for i, c in enumerate(RAW)],
                       *[c.alias(f"q{n}") for c, n in zip(mid, "wxyz")])
    first = materialize(scene_position(anchors, ["frame"]))
    after = first.select("scene", (F.col("position") - 1).alias("position"), F.col("frame").alias("source_frame_end"),
                         *[F.col(c).alias(f"n{c}") for c in RAW], *[F.col(f"q{n}").alias(f"r{n}") for n in "wxyz"])
    pair = first.join(after, ["scene", "position"]).join(fit.drop("cameras"), "scene")
    centre = [0.5 * (F.col(c) + F.col(f"n{c}")) for c in RAW]
    view = pair.select("scene", (F.col("position") + 1).alias("candidate_index"), F.col("frame").alias("source_frame_start"), "source_frame_end",
                       (F.col("source_frame_end") - F.col("frame")).alias("source_frame_gap"),
                       *[c.alias(n) for c, n in zip(centre, RAW)], *[c.alias(f"q{n}") for c, n in zip(quat_midpoint(quat("q"), quat("r")), "wxyz")], *FIT)
    moved, turn = transform_pose(RAW, quat("q"), "scale", quat("g"), ("tx", "ty", "tz"))
    return view.withColumns({**dict(zip(OTHER, moved)), **{f"p{n}": c for n, c in zip("wxyz", turn)}}).drop(*FIT)


def plan_common_support(poses: DataFrame, wanted: int, fit: DataFrame | None = None, planning=PLANNING_SUPPORT,
                        audit=AUDIT_SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Evenly spaced midpoint views that lie near training cameras in both branches, and a row for every scene.

    A view is eligible if its nearest camera is close and looks the same way, in the raw branch and in the other;
    ``wanted`` of them are picked evenly along the path and checked against the audit limits again. Only scenes with
    enough eligible views whose picks all pass have views; the second table tells what became of each scene
    (``planned``, ``too few views``, ``audit failed``), with the counts and the largest distances and angles.
    """
    fit = similarity_fit(poses) if fit is None else fit
    views = materialize(midpoint_poses(poses, fit))
    key = "candidate_index"
    raw = support_measurement(views, poses, median_spacing(poses), query=key)
    other = support_measurement(views, poses, median_spacing(poses, OTHER), at=OTHER, turn="p", train_at=OTHER, train_turn="p", query=key)
    part = lambda d, name: d.select("scene", key, *[F.col(c).alias(f"{name}_{c}") for c in ("distance_in_spacings", "angle")])
    both = lambda limits: (within_support("raw_distance_in_spacings", "raw_angle", limits) & within_support("other_distance_in_spacings", "other_angle", limits))
    measured = materialize(views.join(part(raw, "raw"), ["scene", key]).join(part(other, "other"), ["scene", key])
                           .withColumns({"eligible": both(planning), "within_support": both(audit)}))
    sizes = measured.groupBy("scene").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("eligible").alias("eligible"))
    enough = measured.where("eligible").join(sizes.where(F.col("eligible") >= wanted).select("scene"), "scene", "left_semi")
    picked = uniform_pick(enough, key, wanted)
    share = F.lit(0.0) if wanted == 1 else (F.col("sequence_index") - 1) / float(wanted - 1)
    picked = materialize(picked.withColumn("path_fraction", share).drop("eligible"))
    worst = [F.max(f"{b}_{c}").alias(f"maximum_{b}_{c}") for b in ("raw", "other") for c in ("distance_in_spacings", "angle")]
    checked = picked.groupBy("scene").agg(F.count(F.lit(1)).alias("picked"), F.count_if("within_support").alias("supported"), *worst)
    report = sizes.join(checked, "scene", "left").fillna(0, ["picked", "supported"])
    report = report.withColumn("status", F.when(F.col("eligible") < wanted, "too few views").when(F.col("supported") < wanted, "audit failed").otherwise("planned"))
    return picked.join(report.where("status = 'planned'").select("scene"), "scene", "left_semi"), report


def azimuth_coverage(poses: DataFrame, at=RAW, slots: int = 3600) -> DataFrame:
    """360 degrees minus the largest empty arc around the mean centre.

    Angles are sorted inside narrow slots; only the slots' first and last angles are compared
    around the circle, so a crowded scene is not sorted in one task.
    """
    centre = poses.groupBy("scene").agg(F.avg(at[0]).alias("_mx"), F.avg(at[1]).alias("_my"))
    angle = F.pmod(F.degrees(F.atan2(F.col(at[1]) - F.col("_my"), F.col(at[0]) - F.col("_mx"))), F.lit(360.0))
    a = poses.join(centre, "scene").select("scene", angle.alias("_a")).withColumn("_s", F.floor(F.col("_a") / 360.0 * slots))
    inner = a.withColumn("_g", F.col("_a") - F.lag("_a").over(Window.partitionBy("scene", "_s").orderBy("_a")))
    slot = inner.groupBy("scene", "_s").agg(F.min("_a").alias("_first"), F.max("_a").alias("_last"), F.max("_g").alias("_g"))
    around = Window.partitionBy("scene").orderBy("_s")
    whole = Window.partitionBy("scene")
    jump = F.coalesce(F.lead("_first").over(around), F.min("_first").over(whole) + 360.0) - F.col("_last")
    gap = slot.withColumn("_j", jump).groupBy("scene").agg(F.greatest(F.max("_j"), F.max("_g")).alias("largest_gap"))
    return gap.withColumn("coverage", 360.0 - F.col("largest_gap"))
