"""Structure penalty of a frame and the light removed between two variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glintframe.functions.scalar import clip
from glintframe.operators.pairing import stride_sample
from glintframe.operators.quantiles import robust_normalize
from glintframe.operators.stencil import FRAME, box_mean, coherence, colocate, gradient, guided_base, odd
from glintframe.operators.tracks import robust_affine

CUES = ("base", "positive", "negative", "paired", "paired_nb", "coherence", "edge", "edge_nb")


def structure_penalty(df: DataFrame, lum: str = "lum", *, base_kernel: int = 15, pair_kernel: int = 9,
                      tensor_kernel: int = 15, keep_cues: bool = False) -> DataFrame:
    """Confidence that a pixel belongs to a narrow, paired and directional structure.

    The frame is placed once; box filters, gradients and the per-frame percentiles after that
    are sorts inside a task, with no join and no second read of the chain.
    """
    d = guided_base(colocate(df), lum, base_kernel, name="base")
    rest = F.col(lum) - F.col("base")
    d = d.withColumns({"_p": F.greatest(rest, F.lit(0.0)), "_m": F.greatest(-rest, F.lit(0.0))})
    d = robust_normalize(d, {"positive": (F.col("_p"), 0.995), "negative": (F.col("_m"), 0.995)})
    d = gradient(d, lum, "_gx", "_gy")
    d = coherence(d, "_gx", "_gy", tensor_kernel)
    d = d.withColumn("_gm", F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2))
    d = box_mean(d, {"_nb": F.col("negative")}, pair_kernel)
    d = robust_normalize(d, {"_near": (F.col("_nb"), 0.99), "edge": (F.col("_gm"), 0.99)})
    d = d.withColumn("paired", F.sqrt(clip(F.col("positive") * F.col("_near"))))
    d = box_mean(d, {"_pb": F.col("paired"), "_eb": F.col("edge")}, pair_kernel)
    d = robust_normalize(d, {"paired_nb": (F.col("_pb"), 0.99), "edge_nb": (F.col("_eb"), 0.99)})
    d = d.withColumn("structure", F.cbrt(clip(F.greatest("paired", "paired_nb") * F.col("coherence") * F.greatest("edge", "edge_nb"))))
    drop = ["_p", "_m", "_gx", "_gy", "_gm", "_nb", "_near", "_pb", "_eb"]
    return d.drop(*drop, *(() if keep_cues else CUES))


def removed_kernel(h, w, ratio: float = 0.02, least: int = 31):
    """Odd box width for a frame's sides, given as numbers or as columns."""
    if isinstance(h, Column):
        return F.greatest(F.lit(least), F.rint(F.least(h, w) * ratio)).cast("int").bitwiseOR(F.lit(1))
    return odd(max(least, int(round(min(h, w) * ratio))))


def removed_light(df: DataFrame, before: str = "lum", after: str = "lum_after", *, kernel: int | None = None,
                  max_samples: int | None = None, min_samples: int = 100) -> DataFrame:
    """Broad brightness removed by a suppressed variant, in [0, 1].

    The variant is exposure-aligned per frame, on all its pixels or on a strided sample of ``max_samples``; then the
    positive rest is box-averaged and normalised. Without ``kernel`` its width follows the size of each frame.
    """
    sample = (df if max_samples is None else stride_sample(df, max_samples)).select(*FRAME, F.col(after).alias("_x"), F.col(before).alias("_y"))
    fits = robust_affine(sample, FRAME, "_x", "_y", min_samples=min_samples)
    aligned = df.join(fits, FRAME).withColumn("_al", clip(F.col("gain") * F.col(after) + F.col("offset"))).drop("gain", "offset")
    d = aligned.withColumn("_rm", F.greatest(F.col(before) - F.col("_al"), F.lit(0.0)))
    d = box_mean(colocate(d), {"_bm": F.col("_rm")}, kernel or removed_kernel(F.col("h"), F.col("w")))
    d = robust_normalize(d, {"removed": (F.greatest(F.col("_bm") - 0.01, F.lit(0.0)), 0.99)})
    return d.drop("_al", "_rm", "_bm")
