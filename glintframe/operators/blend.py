"""Blending an original with its suppressed variant, and the registry of strategies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from glintframe.functions.color import lab_to_rgb, rgb_to_lab
from glintframe.functions.scalar import clip, col, sigmoid
from glintframe.operators.stencil import colocate, gaussian_blur


def mix(weight, first: str = "", second: str = "s") -> dict:
    """Output channels ``or og ob`` of ``weight * second + (1 - weight) * first``."""
    w = col(weight)
    return {f"o{c}": clip(w * F.col(f"{second}{c}") + (1.0 - w) * F.col(f"{first}{c}")) for c in "rgb"}


def lab_recompose(df: DataFrame, short_side: int | Column, detail_sigma: float = 2.0) -> DataFrame:
    """Mix broad lightness, fine lightness and colour with their own weights, in CIELAB.

    Needs ``base_weight, detail_weight, chroma_weight``; adds ``or og ob``.
    """
    sigma = detail_sigma * short_side / 3072.0
    sigma = F.greatest(sigma, F.lit(0.5)) if isinstance(sigma, Column) else max(sigma, 0.5)
    names = {"a": rgb_to_lab("r", "g", "b"), "b": rgb_to_lab("sr", "sg", "sb")}
    d = df.withColumns({f"_{k}{i}": c for k, lab in names.items() for i, c in enumerate(lab)})
    d = gaussian_blur(colocate(d), {"_abase": "_a0", "_bbase": "_b0"}, sigma)
    base, fine, tint = F.col("base_weight"), F.col("detail_weight"), F.col("chroma_weight")
    light = ((1.0 - base) * F.col("_abase") + base * F.col("_bbase") + (1.0 - fine) * (F.col("_a0") - F.col("_abase"))
             + fine * (F.col("_b0") - F.col("_bbase")))
    d = d.withColumns({"_l": clip(light, 0.0, 100.0), **{f"_c{i}": (1.0 - tint) * F.col(f"_a{i}") + tint * F.col(f"_b{i}") for i in (1, 2)}})
    d = d.withColumns(dict(zip(("or", "og", "ob"), lab_to_rgb("_l", "_c1", "_c2"))))
    return d.drop(*[f"_{k}{i}" for k in "ab" for i in range(3)], "_abase", "_bbase", "_l", "_c1", "_c2")


@dataclass(frozen=True)
class Strategy:
    name: str
    run: Callable[..., DataFrame]
    needs_score: bool = True
    needs_context: bool = False
    needs_cues: bool = False
    diagnostics: bool = False
    version: str | None = None


_STRATEGIES: dict[str, Strategy] = {}
_SCORE, _CONTEXT, _CUES = ("score",), ("cross", "confidence"), ("cross_support", "removed_support", "structure")


def register_strategy(name: str, *, needs_score=True, needs_context=False, needs_cues=False, diagnostics=False, version=None):
    def add(fn):
        _STRATEGIES[name] = Strategy(name, fn, needs_score, needs_context, needs_cues, diagnostics, version)
        return fn

    return add


def get_strategy(name: str) -> Strategy:
    if name not in _STRATEGIES:
        raise ValueError(f"unknown blend strategy {name!r}; available: {', '.join(available_strategies())}")
    return _STRATEGIES[name]


def available_strategies() -> list[str]:
    return sorted(_STRATEGIES)


def check_requirements(strategy: Strategy, detector: str) -> None:
    """Strategies that read observation context work with the structure-aware detector only."""
    if strategy.needs_context and detector != "structure_aware":
        raise ValueError(f"{strategy.name} needs the structure_aware detector, not {detector}")


def blend(df: DataFrame, name: str, *, detector: str = "structure_aware", **params) -> DataFrame:
    """Run a registered strategy; missing optional evidence counts as zero."""
    s = get_strategy(name)
    check_requirements(s, detector)
    if s.needs_score and "score" not in df.columns:
        raise ValueError(f"{name} needs a score column")
    for wanted, names in ((s.needs_context, _CONTEXT), (s.needs_cues, _CUES)):
        if wanted:
            df = df.withColumns({c: F.lit(0.0) for c in names if c not in df.columns})
    return s.run(df, **params)


@register_strategy("removed_only", needs_score=False)
def removed_only(df: DataFrame, **_) -> DataFrame:
    return df.withColumns(mix(F.lit(1.0)))


@register_strategy("soft")
def soft(df: DataFrame, *, threshold: float = 0.3, steepness: float = 8.0, **_) -> DataFrame:
    return df.withColumns(mix(sigmoid("score", threshold, steepness)))


@register_strategy("hard")
def hard(df: DataFrame, *, threshold: float = 0.3, **_) -> DataFrame:
    return df.withColumns(mix((F.col("score") >= threshold).cast("double")))


def _sized(df: DataFrame, short_side: int | None, weights) -> DataFrame:
    """Recomposed frames from ``weights(rows, short_side)``, widths by frame."""
    from glintframe.operators.stencil import per_frame_size
    return per_frame_size(df, lambda d, side: lab_recompose(weights(d, side), side), short_side)


@register_strategy("evidence_matte", needs_context=True, needs_cues=True, diagnostics=True, version="evidence_matte_diffusion_v2")
def evidence_matte(df: DataFrame, *, short_side: int | None = None, factor: int = 4, **params) -> DataFrame:
    from glintframe.operators.matte import matte_weights
    return _sized(df, short_side, lambda d, side: matte_weights(d, factor=factor, short_side=side, **params))


@register_strategy("adaptive_feather", needs_context=True, diagnostics=True, version="size_view_perceptual_v1")
def adaptive_feather(df: DataFrame, *, short_side: int | None = None, factor: int = 4, **params) -> DataFrame:
    from glintframe.operators.feather import feather_weights
    return _sized(df, short_side, lambda d, side: feather_weights(d, factor=factor, short_side=side, **params))


@register_strategy("weak_hysteresis_feather", needs_context=True, needs_cues=True, diagnostics=True, version="weak_hysteresis_continuous_v1")
def weak_hysteresis_feather(df: DataFrame, *, short_side: int | None = None, factor: int = 4, **params) -> DataFrame:
    from glintframe.operators.feather import hysteresis_weights
    return _sized(df, short_side, lambda d, side: hysteresis_weights(d, factor=factor, short_side=side, **params))


@register_strategy("weak_hysteresis_outer_feather", needs_context=True, needs_cues=True, diagnostics=True, version="evidence_outer_feather_v2")
def weak_hysteresis_outer_feather(df: DataFrame, *, short_side: int | None = None, factor: int = 4, **params) -> DataFrame:
    from glintframe.operators.feather import hysteresis_weights
    return _sized(df, short_side, lambda d, side: hysteresis_weights(d, factor=factor, short_side=side, outer=True, **params))
