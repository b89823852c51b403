"""Collateral change of colour and detail on protected structure, and held-out view metrics.

Pixels carry the original ``r g b``, a direct variant ``sr sg sb`` and a fused one
``fr fg fb``; frames with too few protected pixels raise, or give a row that says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glintframe.functions.color import delta_e76, rgb_to_lab
from glintframe.functions.scalar import STRONG, WEAK, col, finite, lum601, lum709, percentage, psnr, psnr_from_rmse, rgb_max
from glintframe.operators.quantiles import exact_quantiles, with_frame_quantile
from glintframe.operators.stencil import FRAME, colocate, gaussian_blur, highpass, local_std, sobels
from glintframe.session import materialize


def protected_masks(df: DataFrame, score="score", structure="structure", gradient="gmag", low: float = WEAK,
                    structured: float = 0.65, edge_percentile: float = 0.75) -> DataFrame:
    """``protected``: low score on structure; ``edge``: its pixels in the top quarter of the gradient."""
    keep = (col(score) < low) & (col(structure) >= structured)
    d = df.withColumn("protected", keep)
    d = with_frame_quantile(d, {"edge_cutoff": (F.when(F.col("protected"), col(gradient)), edge_percentile)})
    return d.withColumn("edge", F.col("protected") & (col(gradient) >= F.coalesce("edge_cutoff", F.lit(float("inf")))))


def masked_correlation(first, second, mask: Column) -> Column:
    """Pearson r inside the mask; NULL below ten pixels or without variation."""
    a, b = F.when(mask, col(first)), F.when(mask, col(second))
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b)) * F.count_if(mask)
    return F.when((F.count_if(mask) >= 10) & (spread > 1e-12), F.try_divide(F.covar_pop(a, b) * F.count_if(mask), spread))


def masked_stats(df: DataFrame, value: str, other: str, mask: Column, keys=FRAME) -> DataFrame:
    inside = F.when(mask, col(value))
    rows = df.groupBy(*keys).agg(F.count_if(mask).alias("masked_pixels"), F.avg(inside).alias("mean"),
                                 masked_correlation(value, other, mask).alias("correlation"))
    return rows.join(exact_quantiles(df.where(mask), keys, value, {"median": 0.5}), list(keys), "left")


def fidelity_features(df: DataFrame, variants=("s", "f")) -> DataFrame:
    """High-pass, Sobel and colour difference of the original and of each variant."""
    lab = rgb_to_lab("r", "g", "b")
    d = df.withColumn("lum", lum709("r", "g", "b"))
    for v in variants:
        own = [f"{v}{c}" for c in "rgb"]
        d = d.withColumns({f"{v}_lum": lum709(*own), f"{v}_de": delta_e76(lab, rgb_to_lab(*own))})
    d = highpass(colocate(d), {"hp": "lum", **{f"{v}_hp": f"{v}_lum" for v in variants}})
    return sobels(d, {"lum": ("gx", "gy", "gmag"), **{f"{v}_lum": (f"{v}_gx", f"{v}_gy", f"{v}_gmag") for v in variants}})


def fidelity_rows(features: DataFrame, variants={"s": "direct", "f": "fusion"}, minimum: int = 100, strict: bool = True) -> DataFrame:
    """One row per frame with ten metrics per variant.

    A frame with fewer than ``minimum`` protected or edge pixels raises with ``strict``; else its row has the counts,
    NULL metrics and the ``status`` that says so.
    """
    prot, edge = F.col("protected"), F.col("edge")
    n = F.count(F.lit(1))
    on = lambda m, v: F.when(m, v)
    aggs = [n.alias("pixels"), F.count_if(prot).alias("protected_pixels"), percentage(F.count_if(prot), n).alias("protected_percent"),
            F.count_if(edge).alias("protected_edge_pixels"), percentage(F.count_if(edge), n).alias("protected_edge_percent"),
            F.max("edge_cutoff").alias("edge_percentile_cutoff")]
    for v, name in variants.items():
        de, hp, gm = F.col(f"{v}_de"), F.col(f"{v}_hp"), F.col(f"{v}_gmag")
        rmse = F.sqrt(F.avg(on(prot, (hp - F.col("hp")) ** 2)))
        turn = (F.col("gx") * F.col(f"{v}_gx") + F.col("gy") * F.col(f"{v}_gy")) / (F.col("gmag") * gm + 1e-6)
        aggs += [F.avg(on(prot, de)).alias(f"{name}_cie76_delta_e_mean"),
                 # one frame, whose size the sensor bounds
                 F.percentile(on(prot, de), 0.5).alias(f"{name}_cie76_delta_e_median"),
                 percentage(F.count_if(prot & (de > 2.0)), F.count_if(prot)).alias(f"{name}_cie76_delta_e_gt_2_percent"),
                 percentage(F.count_if(prot & (de > 5.0)), F.count_if(prot)).alias(f"{name}_cie76_delta_e_gt_5_percent"),
                 rmse.alias(f"{name}_highpass_rmse"), psnr_from_rmse(rmse).alias(f"{name}_highpass_psnr_db"),
                 masked_correlation("hp", hp, prot).alias(f"{name}_highpass_correlation"),
                 (F.sum(on(edge, gm)) / F.greatest(F.sum(on(edge, F.col("gmag"))), F.lit(1e-8))).alias(f"{name}_edge_energy_ratio"),
                 F.avg(on(edge, turn)).alias(f"{name}_edge_orientation_agreement"),
                 F.avg(on(edge, F.abs(gm - F.col("gmag")))).alias(f"{name}_edge_magnitude_mae")]
    rows = features.groupBy(*FRAME).agg(*aggs)
    enough = (F.col("protected_pixels") >= minimum) & (F.col("protected_edge_pixels") >= minimum)
    if strict:
        return rows.where(F.when(enough, True).otherwise(F.raise_error(F.lit("too few protected pixels in a frame")).cast("boolean")))
    metrics = [c for c in rows.columns if c.startswith(tuple(f"{name}_" for name in variants.values()))]
    rows = rows.withColumns({c: F.when(enough, F.col(c)) for c in metrics})
    return rows.withColumn("status", F.when(enough, "measured").otherwise("too few protected pixels"))


def fusion_to_direct(rows: DataFrame) -> DataFrame:
    ratio = lambda m: F.col(f"fusion_{m}") / F.greatest(F.col(f"direct_{m}"), F.lit(1e-8))
    return rows.withColumns({"fusion_to_direct_delta_e_ratio": ratio("cie76_delta_e_mean"),
                             "fusion_to_direct_highpass_rmse_ratio": ratio("highpass_rmse")})


def summary_stats(rows: DataFrame, metrics, keys=("scene",), pooled: str | None = "All") -> DataFrame:
    """Mean, median and quartiles of the finite values of every metric, per key and over all frames.

    The pooled values are those of all frames together, not a mean of the scenes' values.
    """
    # metric rows are one per frame; written once, since means, sizes and quantiles all read them
    rows = materialize(rows.select(*keys, *metrics))
    pairs = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), finite(F.col(m).cast("double")).alias("value")) for m in metrics]))
    long = rows.select(*[F.col(k).cast("string").alias(k) for k in keys], pairs)
    if pooled:
        both = F.explode(F.array(F.col(keys[0]), F.lit(pooled)))
        long = long.withColumn(keys[0], both)
    long = long.where("value is not null")
    on = [*keys, "metric"]
    means = long.groupBy(*on).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("frames"))
    return means.join(exact_quantiles(long, on, "value", {"median": 0.5, "q25": 0.25, "q75": 0.75}), on)


# --- held-out views ------------------------------------------------------

def texture_mask(df: DataFrame, diffuse: Column, top: float = 0.3, lum: str = "lum601", name: str = "textured") -> DataFrame:
    """Diffuse pixels with the highest local deviation (ties stay in)."""
    d = local_std(df, lum, 9, "_std").withColumn("_dif", diffuse)
    d = with_frame_quantile(d, {"_cut": (F.when(F.col("_dif"), F.col("_std")), 1.0 - top)})
    return d.withColumn(name, F.col("_dif") & (F.col("_std") >= F.coalesce("_cut", F.lit(float("inf"))))).drop("_std", "_dif", "_cut")


def heldout_metrics(df: DataFrame, threshold: float = 0.5, top: float = 0.3, keys=FRAME) -> DataFrame:
    """Per view: score means, bright shares, PSNR and MAE against the original and the suppressed target.

    ``r g b``: original, ``sr sg sb``: suppressed target, ``tr tg tb``: render; ``score`` and
    ``render_score`` are detector outputs.
    """
    d = colocate(df.withColumns({"lum601": lum601("r", "g", "b"), "spec": F.col("score") >= threshold}))
    d = texture_mask(d, ~F.col("spec"), top)
    channels = {f"_h{p}{c}": f"{p}{c}" for p in ("", "s", "t") for c in "rgb"}
    d = gaussian_blur(d, {h: v for h, v in channels.items()}, 2.0, "replicate")
    d = d.withColumns({h: F.col(v) - F.col(h) for h, v in channels.items()})
    spec, dif, tex = F.col("spec"), ~F.col("spec"), F.col("textured")
    mean3 = lambda f: (f("r") + f("g") + f("b")) / 3.0
    sq = lambda p, q: mean3(lambda c: (F.col(f"{p}{c}") - F.col(f"{q}{c}")) ** 2)
    ab = lambda p, q: mean3(lambda c: F.abs(F.col(f"{p}{c}") - F.col(f"{q}{c}")))
    n = F.count(F.lit(1))
    over = lambda m, v: F.avg(F.when(m, v))
    mae = lambda m, v: F.when(F.count_if(m) >= 10, over(m, v))
    bright = lambda p: F.count_if(rgb_max(f"{p}r", f"{p}g", f"{p}b") > 200.0 / 255.0) / n
    return d.groupBy(*keys).agg(
        F.avg("render_score").alias("render_score_mean"), F.avg("score").alias("gt_score_mean"),
        over(spec, F.col("render_score")).alias("render_spec_score"), bright("t").alias("render_hifrac"), bright("").alias("gt_hifrac"),
        (F.count_if(spec) / n).alias("spec_fraction_gt"), psnr(F.avg(sq("t", ""))).alias("psnr_orig"), psnr(F.avg(sq("t", "s"))).alias("psnr_suppressed"),
        psnr(over(dif, sq("t", "")), F.count_if(dif)).alias("psnr_diffuse_orig"), psnr(over(spec, sq("t", "s")), F.count_if(spec)).alias("psnr_spec_suppressed"),
        mae(spec, ab("t", "")).alias("mae_spec_orig"), mae(spec, ab("t", "s")).alias("mae_spec_suppressed"),
        (F.count_if(tex) / n).alias("tex_fraction"), psnr(over(tex, sq("t", "")), F.count_if(tex)).alias("psnr_textured_orig"),
        psnr(over(tex, sq("_ht", "_h")), F.count_if(tex)).alias("psnr_hf_textured"),
        mae(dif, ab("s", "")).alias("damage_diffuse"), mae(tex, ab("_hs", "_h")).alias("damage_hf_textured"))


def heldout_means(views: DataFrame, keys=("scene",)) -> DataFrame:
    """Mean over the views of each run that have a value."""
    values = [c for c in views.columns if c not in ("scene", "frame")]
    return views.groupBy(*keys).agg(*[F.avg(finite(v)).alias(v) for v in values])
