"""Scale-adaptive feathering: the size-aware variant and the weak-region variants.

Both decide on a grid ``factor`` times coarser than the pixels, region by region, and hand
their coarse weights to the same edge-aware finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glintframe.functions.scalar import clip, lum601, smoothstep, view_evidence, weak_boost, zero_floor_sigmoid
from glintframe.operators.matte import coarse_evidence, guided_weights
from glintframe.operators.regions import evidence_override, filled_members, keep_seeded, label_regions, region_gain, region_geometry
from glintframe.operators.stencil import FRAME, along, colocate, dilate, downsample_area, gaussian_blur, morph_close, per_frame_size, sobel
from glintframe.operators.stencil import _images
from glintframe.session import materialize

# The published parameters of both variants.
SIZE_DEFAULTS = {"threshold": 0.3, "steepness": 8.0, "small_width": 6.0, "large_width": 12.0, "small_gain": 0.35, "large_gain": 1.15,
                 "stable_detail": 0.12, "stable_chroma": 0.55}
WEAK_DEFAULTS = {**SIZE_DEFAULTS, "weak_low": 0.10, "weak_mapping_threshold": 0.16, "weak_boost_gain": 0.35, "evidence_seed": 0.18,
                 "small_feather": 0.5, "large_feather": 2.5, "color_feather_gain": 1.0, "boundary_bias": 1.0,
                 "transition_guard_strength": 0.35, "base_edge_lock": 0.2}
OUTER_DEFAULTS = {"outer_low": 0.05, "outer_evidence": 0.10, "small_outer_radius": 0.75, "large_outer_radius": 3.0,
                  "inner_feather_radius": 0.5, "max_profile_shift": 4.0}


def _resolve(defaults: dict, changed: dict) -> dict:
    unknown = set(changed) - set(defaults)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    p = {**defaults, **changed}
    if p["large_width"] <= p["small_width"]:
        raise ValueError("large_width must exceed small_width")
    if "weak_low" in p:
        if not 0 <= p["weak_low"] <= p["weak_mapping_threshold"] < p["threshold"]:
            raise ValueError("need 0 <= weak_low <= weak_mapping_threshold < threshold")
        if not 0 < p["small_feather"] <= p["large_feather"]:
            raise ValueError("need 0 < small_feather <= large_feather")
    if "outer_low" in p and not (0 <= p["outer_low"] < p["weak_low"] and 0 <= p["outer_evidence"] <= 1
                                 and 0 < p["small_outer_radius"] <= p["large_outer_radius"]
                                 and p["inner_feather_radius"] > 0 and p["max_profile_shift"] >= 0):
        raise ValueError("outer feather parameters are out of order")
    return p


# --- size-aware variant --------------------------------------------------

def size_regularize(coarse: DataFrame, p: dict) -> DataFrame:
    """Alpha made consistent inside each region, with the region's scale, gain and evidence override.

    Compact small regions also cover their holes; a pixel of a region keeps its own region's
    value, a hole takes that of the last region around it.
    """
    d = coarse.withColumns({"alpha": zero_floor_sigmoid("score", p["threshold"], p["steepness"]),
                            "_core": (F.col("score") >= p["threshold"]).cast("int")})
    d = materialize(dilate(morph_close(colocate(d), "_core"), "_core"))
    d = materialize(label_regions(d, F.col("_core") == 1))
    members = materialize(filled_members(d))
    g = region_geometry(d, quantiles={"a70": ("alpha", 0.70), "v85": ("view", 0.85)}, members=members).where("area_px >= 2")
    scale = smoothstep(p["small_width"], p["large_width"], "width")
    g = g.select(*FRAME, "region_id", "aspect", "a70", scale.alias("scale"), evidence_override("v85").alias("override"))
    g = g.withColumn("gain", region_gain("scale", "override", p["small_gain"], p["large_gain"]))
    covered = members.join(g, [*FRAME, "region_id"]).where(F.col("own") | ((F.col("scale") < 0.5) & (F.col("aspect") <= 3.0)))
    chosen = covered.groupBy(*FRAME, "y", "x").agg(
        F.max_by(F.struct("scale", "gain", "a70"), F.struct("own", "region_id")).alias("_r"), F.max("override").alias("_o"))
    d = d.join(chosen, [*FRAME, "y", "x"], "left")
    inside, r = F.col("_r").isNotNull(), lambda n: F.col(f"_r.{n}")
    own = evidence_override("view")
    return d.withColumns({
        "regularized": F.when(inside, clip(r("gain") * ((1.0 - r("scale")) * r("a70") + r("scale") * F.col("alpha")))).otherwise(F.col("alpha")),
        "size_scale": F.coalesce(r("scale"), F.lit(0.0)), "size_gain": F.coalesce(r("gain"), F.lit(0.0)),
        "view_override": F.greatest(own, F.coalesce("_o", F.lit(0.0)))}).drop("_r", "_o", "_core")


def feather_weights(df: DataFrame, *, factor: int = 4, short_side: int | None = None, diagnostics: bool = False, **changed) -> DataFrame:
    """Base, detail and chroma weights of the size-aware variant, one row for each pixel."""
    p = _resolve(SIZE_DEFAULTS, changed)
    return per_frame_size(df, lambda d, side: _feather_weights(d, factor, side, diagnostics, p), short_side)


def _feather_weights(df: DataFrame, factor: int, short_side: int, diagnostics: bool, p: dict) -> DataFrame:
    full = df.withColumns({"score": clip("score"), "cross": clip("cross"), "confidence": clip("confidence"), "lum": lum601("r", "g", "b")})
    coarse = downsample_area(full, factor, ["score", "cross", "confidence"]).withColumn("view", view_evidence("cross", "confidence"))
    sized = materialize(size_regularize(coarse, p))
    soft = gaussian_blur(dilate(colocate(sized), "regularized"), {"regularized": "regularized"}, 1.25)
    d = guided_weights(full, soft, factor, short_side, override="view_override", near=("size_scale", "size_gain"),
                       stable_detail=p["stable_detail"], stable_chroma=p["stable_chroma"])
    return d.withColumn("size_gain", clip(F.col("size_gain") / max(p["large_gain"], 1e-6))) if diagnostics else d.drop("size_scale", "size_gain")


# --- weak-region variant -------------------------------------------------

def weak_regions(coarse: DataFrame, p: dict) -> tuple[DataFrame, DataFrame]:
    """Coarse pixels labelled with their retained weak regions, and one row of settings per region."""
    boosted = weak_boost("score", threshold=p["threshold"], steepness=p["steepness"], mapping_threshold=p["weak_mapping_threshold"],
                         mix_from=p["weak_low"], gain=p["weak_boost_gain"])
    shown = (F.col("score") >= max(0.75 * p["weak_low"], 0.01)) & (F.col("evidence") >= p["evidence_seed"])
    d = coarse.withColumns({"alpha": zero_floor_sigmoid("score", p["threshold"], p["steepness"]), "boosted": boosted,
                            "_seed": shown | (F.col("score") >= p["threshold"]), "_cand": (shown | (F.col("score") >= p["weak_low"])).cast("int")})
    d = materialize(morph_close(colocate(d), "_cand"))
    d = keep_seeded(label_regions(d, F.col("_cand") == 1), "_seed")
    d = materialize(d.withColumn("region_id", F.when(F.col("retained"), F.col("region_id")).otherwise(0).cast("long")).drop("_seed", "_cand"))
    g = region_geometry(d, quantiles={"e85": ("evidence", 0.85), "v85": ("view", 0.85), "a70": ("boosted", 0.70), "c85": ("change", 0.85)})
    g = g.select(*FRAME, "region_id", "a70", smoothstep(p["small_width"], p["large_width"], "width").alias("scale"),
                 evidence_override("e85").alias("_eo"), evidence_override("v85").alias("perceptual"), smoothstep(0.03, 0.15, "c85").alias("risk"))
    spread = 1.0 + max(p["color_feather_gain"], 0.0) * F.col("risk")
    g = g.withColumns({"gain": region_gain("scale", "_eo", p["small_gain"], p["large_gain"]),
                       "sigma": (p["small_feather"] + (p["large_feather"] - p["small_feather"]) * F.col("scale")) * spread}).drop("_eo")
    if "small_outer_radius" in p:
        g = g.withColumn("outer_radius", (p["small_outer_radius"] + (p["large_outer_radius"] - p["small_outer_radius"]) * F.col("scale")) * spread)
    return d, materialize(g)


def region_blur(rows: DataFrame, values, max_sigma: float) -> DataFrame:
    """Gaussian blur of each region's own values with the region's own ``sigma``.

    Rows are the region's pixels with ``sigma, h, w``. Each pass spreads a pixel along one axis
    and sums per target; borders repeat the edge value.
    """
    reach = int(max_sigma * 8 + 2) // 2 + 1
    size = F.floor((F.rint(F.col("sigma") * 8 + 1).cast("int").bitwiseOR(F.lit(1))) / 2).cast("int")
    bell = lambda d: F.exp(-(d * d) / (2.0 * F.col("sigma") * F.col("sigma")))
    d = rows.withColumns({"_r": size}).withColumn(
        "_norm", F.aggregate(F.sequence(-F.col("_r"), F.col("_r")), F.lit(0.0), lambda a, k: a + F.exp(-(k * k) / (2.0 * F.col("sigma") * F.col("sigma")))))
    for axis, side in (("x", "w"), ("y", "h")):
        d = d.withColumn("_v", F.explode(_images(F.col(axis).cast("int"), F.col(side).cast("int"), reach, "replicate")))
        low, high = F.greatest(F.col("_v") - F.col("_r"), F.lit(0)), F.least(F.col("_v") + F.col("_r"), F.col(side) - 1)
        d = d.withColumn("_t", F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))))
        weight = bell(F.col("_t") - F.col("_v")) / F.col("_norm")
        other = "y" if axis == "x" else "x"
        d = (d.groupBy(*FRAME, "region_id", other, F.col("_t").alias(axis), "sigma", "_r", "_norm", "h", "w")
             .agg(*[F.sum(weight * F.col(v)).alias(v) for v in values]))
    return d.drop("_r", "_norm")


def region_profiles(d: DataFrame, g: DataFrame, p: dict) -> DataFrame:
    """Per region and reached pixel: feathered membership and inward target."""
    keys = [*FRAME, "region_id"]
    own = d.where("region_id > 0").join(g, keys)
    target = clip(F.col("gain") * ((1.0 - F.col("scale")) * F.col("a70") + F.col("scale") * F.col("boosted")))
    rows = own.select(*keys, "y", "x", "h", "w", "sigma", F.lit(1.0).alias("membership"), target.alias("numerator"))
    blurred = region_blur(rows, ["membership", "numerator"], p["large_feather"] * (1.0 + max(p["color_feather_gain"], 0.0)))
    power = 1.0 + max(p["boundary_bias"], 0.0) * F.col("risk") * F.col("scale")
    m = clip("membership")
    return blurred.join(g.drop("sigma", "a70"), keys).select(
        *keys, "y", "x", "scale", "gain", "perceptual", "risk", *([] if "outer_radius" not in g.columns else ["outer_radius"]),
        F.pow(m, power).alias("feather"), (F.col("numerator") * F.pow(m, F.greatest(power - 1.0, F.lit(0.0)))).alias("inward"))


def merge_profiles(d: DataFrame, profiles: DataFrame) -> DataFrame:
    """Combine the regions reaching each pixel, in raster order of the regions.

    A region clears what earlier ones left on its own pixels and adds to everything else, so a
    pixel gets the clipped sum of its own and all later targets; outside, all targets join the base.
    """
    item = F.struct("region_id", "inward", "feather", "scale", "gain", "perceptual", "risk")
    reached = profiles.groupBy(*FRAME, "y", "x").agg(F.array_sort(F.collect_list(item)).alias("_all"))
    d = d.join(reached, [*FRAME, "y", "x"], "left").withColumn("_all", F.coalesce("_all", F.array().cast(reached.schema["_all"].dataType)))
    later = F.filter("_all", lambda e: e["region_id"] >= F.col("region_id"))
    total = F.aggregate(later, F.lit(0.0), lambda a, e: a + e["inward"])
    over = lambda f: F.aggregate("_all", F.lit(0.0), lambda a, e: (1.0 - e["feather"]) * a + e["feather"] * e[f])
    top = lambda f: F.aggregate("_all", F.lit(0.0), lambda a, e: F.greatest(a, e["feather"] * e[f]))
    return d.withColumns({
        "regularized": clip(F.when(F.col("region_id") > 0, total).otherwise(F.col("alpha") + total)),
        "feather_support": F.aggregate("_all", F.lit(0.0), lambda a, e: F.greatest(a, e["feather"])),
        "size_scale": over("scale"), "size_gain": over("gain"), "transition_risk": top("risk"),
        "source_override": F.greatest(evidence_override("view"), top("perceptual"))}).drop("_all")


# --- outer shell ---------------------------------------------------------

def _chamfer(dy: Column, dx: Column) -> Column:
    """Distance of an offset in steps of 1 (straight), 1.4 (diagonal) and 2.1969 (knight)."""
    long, short = F.greatest(F.abs(dy), F.abs(dx)), F.least(F.abs(dy), F.abs(dx))
    return F.when(2 * short <= long, 2.1969 * short + (long - 2 * short)).otherwise(2.1969 * (long - short) + 1.4 * (2 * short - long))


def chamfer_map(rim: DataFrame, keys: list[str], within: str) -> DataFrame:
    """Distance to the nearest ``rim`` pixel of the same ``keys``, for all pixels at most ``within`` away from it.

    ``within`` has one value for each group. The smallest step along x inside each image row comes first, then
    the minimum over the rows nearby: the distance grows with either step, so each pass needs one line of offsets.
    """
    reach = F.floor(F.col(within) + 1e-6).cast("int")
    steps = F.explode(F.sequence(-reach, reach))
    across = (rim.select(*keys, within, "y", "x", steps.alias("_dx"))
              .groupBy(*keys, within, "y", (F.col("x") + F.col("_dx")).alias("x")).agg(F.min(F.abs("_dx")).alias("_dx")))
    down = (across.select("*", steps.alias("_dy")).withColumn("distance", _chamfer(F.col("_dy"), F.col("_dx")))
            .where(F.col("distance") <= F.col(within) + 1e-6))
    return down.groupBy(*keys, within, (F.col("y") + F.col("_dy")).alias("y"), "x").agg(F.min("distance").alias("distance"))


def outer_shell(d: DataFrame, g: DataFrame, p: dict) -> DataFrame:
    """Pixels each region grows into: supported, not across structure, within its outer radius.

    Rows are (region, pixel) with the distance outside the region. Growth is a bounded number of
    steps; every step joins the new front with the allowed pixels, never all pixel pairs.
    """
    keys = [*FRAME, "region_id"]
    allowed = d.where(((F.col("score") >= p["outer_low"]) | (F.col("evidence") >= p["outer_evidence"]))
                      & ((F.col("structure") <= 0.65) | (F.col("evidence") >= p["evidence_seed"]))).select(*FRAME, "y", "x", F.col("region_id").alias("_home"))
    # region pixels with a side outside the region: only those can be nearest to an outside pixel
    line = lambda a, b: Window.partitionBy(*FRAME, a).orderBy(b)
    same = lambda e: F.coalesce(e, F.lit(-1)) == F.col("region_id")
    rim = d.select(*FRAME, "y", "x", "region_id", (same(F.lag("region_id").over(line("y", "x"))) & same(F.lead("region_id").over(line("y", "x")))
                   & same(F.lag("region_id").over(line("x", "y"))) & same(F.lead("region_id").over(line("x", "y")))).alias("_deep"))
    rim = rim.where("region_id > 0 and not _deep").join(g.select(*keys, "outer_radius"), keys)
    near = chamfer_map(rim, keys, "outer_radius")
    open_ = materialize(near.join(allowed, [*FRAME, "y", "x"]).where("_home <> region_id").drop("_home"))
    around = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))]))
    front = rim.select(*keys, "y", "x", F.greatest(F.ceil("outer_radius"), F.lit(1)).alias("_left"))
    shell = None
    while True:
        beside = (front.where("_left > 0").withColumn("_n", around).select(*keys, (F.col("y") + F.col("_n.dy")).alias("y"), (F.col("x") + F.col("_n.dx")).alias("x"), (F.col("_left") - 1).alias("_left"))
                  .groupBy(*keys, "y", "x").agg(F.max("_left").alias("_left")))
        new = open_.join(beside, [*keys, "y", "x"])
        if shell is not None:
            new = new.join(shell.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti")
        new = materialize(new)
        if not new.take(1):
            break
        shell = new if shell is None else shell.union(new)
        front = new.select(*keys, "y", "x", "_left")
    return (shell if shell is not None else open_.withColumn("_left", F.lit(0)).limit(0)).drop("_left")


def hysteresis_weights(df: DataFrame, *, factor: int = 4, short_side: int | None = None, outer: bool = False, diagnostics: bool = False, **changed) -> DataFrame:
    """Base, detail and chroma weights of the weak-region variant, one row for each pixel.

    With ``outer``, the transition moves into a supported shell around each region. Shells read
    the finished inward profile of all regions at once, so where the shells of two regions meet
    the result does not depend on a processing order.
    """
    p = _resolve({**WEAK_DEFAULTS, **OUTER_DEFAULTS} if outer else WEAK_DEFAULTS, changed)
    return per_frame_size(df, lambda d, side: _hysteresis_weights(d, factor, side, outer, diagnostics, p), short_side)


def _hysteresis_weights(df: DataFrame, factor: int, short_side: int, outer: bool, diagnostics: bool, p: dict) -> DataFrame:
    change = (F.abs(F.col("r") - F.col("sr")) + F.abs(F.col("g") - F.col("sg")) + F.abs(F.col("b") - F.col("sb"))) / 3.0
    full, coarse = coarse_evidence(df.withColumns({"change": change, "lum_after": lum601("sr", "sg", "sb")}), factor, ("change",))
    d, g = weak_regions(coarse, p)
    profiles = materialize(region_profiles(d, g, p))
    merged = merge_profiles(d, profiles)
    merged = merged.withColumn("outer_support", F.lit(0.0))
    if outer:
        merged = shift_outwards(materialize(merged), d, g, profiles, p)
    sigma_guard = p["transition_guard_strength"]

    def guard(x: DataFrame, sigma: float) -> DataFrame:
        if sigma_guard <= 0:
            return x.withColumn("transition_guard", F.lit(0.0))
        x = gaussian_blur(x.withColumn("_delta", F.col("lum_after") - F.col("lum")), {"_delta": "_delta"}, sigma)
        x = sobel(x, "_delta", "_dx", "_dy", "_dm")
        x = gaussian_blur(x, {"transition_guard": smoothstep(0.005, 0.03, F.col("_dm") / 8.0)}, 2.0 * sigma)
        held = F.col("base_weight") * clip(1.0 - sigma_guard * clip("transition_guard"))
        if outer:
            relief = clip("outer_support")
            held = (1.0 - relief) * held + relief * F.col("base_weight")
        return x.withColumn("base_weight", clip(held)).drop("_delta", "_dx", "_dy", "_dm")

    extra = ("size_scale", "size_gain", "feather_support", "transition_risk") if diagnostics else ()
    out = guided_weights(full, merged, factor, short_side, edge_lock=p["base_edge_lock"], stable_detail=p["stable_detail"],
                         stable_chroma=p["stable_chroma"], linear=("outer_support", *extra), before_fractions=guard)
    return out.withColumn("size_gain", clip(F.col("size_gain") / max(p["large_gain"], 1e-6))) if diagnostics else out


def shift_outwards(merged: DataFrame, d: DataFrame, g: DataFrame, profiles: DataFrame, p: dict) -> DataFrame:
    """Move the weight profile of each region into its outer shell."""
    keys = [*FRAME, "region_id"]
    shell = materialize(outer_shell(d, g, p))
    own = d.where("region_id > 0").select(*keys, "y", "x")
    grown = own.withColumn("grown", F.lit(1.0)).unionByName(shell.select(*keys, "y", "x", F.lit(1.0).alias("grown")))
    size = d.select(*FRAME, "h", "w").distinct()
    soft = region_blur(grown.join(size, FRAME).withColumn("sigma", F.lit(0.75)), ["grown"], 0.75).select(*keys, "y", "x", clip("grown").alias("soft"))
    band = (shell.join(soft, [*keys, "y", "x"]).join(g.select(*keys, "scale", "perceptual", "risk", "gain"), keys)
            .withColumn("outer", smoothstep_by(-F.col("outer_radius"), F.lit(p["inner_feather_radius"]), -F.col("distance")) * F.col("soft")))
    # the shifted profile takes values from inside the region: dilated, then smoothed
    lifted = colocate(merged.select(*FRAME, "y", "x", "h", "w", "regularized"))
    most = int(round(p["max_profile_shift"]))
    levels = []
    for k in range(1, most + 1):
        lifted = dilate(lifted, "regularized", "regularized")
        lifted = gaussian_blur(lifted, {f"_k{k}": "regularized"}, 0.75)
        levels.append(F.when(F.col("_steps") == k, F.col(f"_k{k}")))
    band = band.withColumn("_steps", F.rint(p["max_profile_shift"] * F.col("scale")).cast("int"))
    if levels:
        band = band.join(lifted.drop("h", "w", "regularized"), [*FRAME, "y", "x"], "left").withColumn("_lift", F.coalesce(*levels, F.lit(0.0)))
        part = smoothstep_by(-F.col("outer_radius"), F.greatest(F.col("_steps").cast("double"), F.lit(p["inner_feather_radius"])), -F.col("distance"))
        band = band.withColumn("shifted", F.when(F.col("_steps") > 0, F.col("_lift") * part * F.col("soft")).otherwise(0.0))
    else:
        band = band.withColumn("shifted", F.lit(0.0))
    inner = inner_band(d, g, p).join(lifted.drop("h", "w", "regularized"), [*FRAME, "y", "x"], "left") if levels else None
    if inner is not None:
        depth = smoothstep_by(-F.col("outer_radius"), F.greatest(F.col("_steps").cast("double"), F.lit(p["inner_feather_radius"])), F.col("depth"))
        zero = F.lit(0.0)
        inner = inner.select(*FRAME, "y", "x", (F.coalesce(*levels, zero) * depth).alias("shifted"))
        band = band.select(*FRAME, "y", "x", "shifted", "outer", "perceptual", "risk").unionByName(inner, allowMissingColumns=True)
    best = band.groupBy(*FRAME, "y", "x").agg(F.max("shifted").alias("_shift"), F.max(F.col("outer") * F.col("perceptual")).alias("_per"),
                                             F.max(F.col("outer") * F.col("risk")).alias("_risk"), F.max("outer").alias("_out"))
    at = lambda c: F.coalesce(c, F.lit(0.0))
    return merged.join(best, [*FRAME, "y", "x"], "left").withColumns({
        "regularized": clip(F.greatest("regularized", at("_shift"))), "outer_support": F.when(F.col("_out").isNotNull(), 1.0).otherwise(0.0),
        "source_override": F.greatest("source_override", at("_per")), "transition_risk": F.greatest("transition_risk", at("_risk")),
        "feather_support": F.greatest("feather_support", at("_out"))}).drop("_shift", "_per", "_risk", "_out")


def inner_band(d: DataFrame, g: DataFrame, p: dict) -> DataFrame:
    """Region pixels close to their region's border, with the distance to the nearest outside pixel."""
    keys = [*FRAME, "region_id"]
    reach = int(p["max_profile_shift"]) + 2
    near = [F.coalesce(f("region_id").over(Window.partitionBy(*FRAME, a).orderBy(b)), F.col("region_id")) != F.col("region_id")
            for a, b in (("y", "x"), ("x", "y")) for f in (F.lag, F.lead)]
    edge = d.select(*FRAME, "y", "x", F.col("region_id").alias("_home"), F.greatest(*near).alias("_edge")).where("_edge")
    fed = chamfer_map(edge.withColumn("_within", F.lit(float(reach))), [*FRAME, "_home"], "_within").withColumnRenamed("distance", "depth")
    own = d.where("region_id > 0").select(*keys, "y", "x")
    met = fed.join(own, [*FRAME, "y", "x"]).where("_home <> region_id").groupBy(*keys, "y", "x").agg(F.min("depth").alias("depth"))
    steps_of = F.rint(p["max_profile_shift"] * F.col("scale")).cast("int")
    return (met.join(g.select(*keys, "scale", "outer_radius"), keys).withColumn("_steps", steps_of)
            .where((F.col("_steps") > 0) & (F.col("depth") <= F.col("_steps") + 1.0)))


def smoothstep_by(low: Column, high: Column, value: Column) -> Column:
    t = clip((value - low) / (high - low))
    return t * t * (3.0 - 2.0 * t)
