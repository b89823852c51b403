"""Column expressions: all stay inside code generation, none needs a UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WEAK, STRONG = 0.075, 0.16

# Support limits (distance in median spacings, angle in degrees).
AUDIT_SUPPORT = (2.5, 30.0)
PLANNING_SUPPORT = (2.25, 27.5)


def col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def clip(value, low=0.0, high=1.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col(value)))


def finite(value) -> Column:
    """NaN and infinities become NULL, so that averages and percentiles skip them."""
    v = col(value)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def r6(value) -> Column:
    return F.round(col(value).cast("double"), 6)


# --- names ---------------------------------------------------------------

def stem(name) -> Column:
    return F.regexp_replace(F.regexp_replace(col(name), r"^.*[/\\]", ""), r"\.[^.]*$", "")


def frame_key(name, missing: str = "error") -> Column:
    """Last digit group of the file stem; ``missing`` is ``error`` or ``zero``."""
    digits = F.regexp_extract(stem(name), r"([0-9]+)[^0-9]*$", 1)
    if missing == "zero":
        otherwise = F.lit(0).cast("long")
    elif missing == "error":
        otherwise = F.raise_error(F.concat(F.lit("no frame number in "), col(name))).cast("long")
    else:
        raise ValueError("missing must be 'error' or 'zero'")
    return F.when(digits != "", digits.cast("long")).otherwise(otherwise)


def digit_key(name) -> Column:
    """All digits of the stem joined into one number (NULL when there is none)."""
    digits = F.regexp_replace(stem(name), r"[^0-9]", "")
    return F.when(digits != "", digits.cast("long"))


# --- colour --------------------------------------------------------------

def lum709(r, g, b) -> Column:
    return 0.2126 * col(r) + 0.7152 * col(g) + 0.0722 * col(b)


def lum601(r, g, b) -> Column:
    return 0.299 * col(r) + 0.587 * col(g) + 0.114 * col(b)


def rgb_max(r, g, b) -> Column:
    return F.greatest(col(r), col(g), col(b))


# --- score mappings ------------------------------------------------------

def smoothstep(low: float, high: float, value) -> Column:
    if high <= low:
        raise ValueError("smoothstep needs high > low")
    t = clip((col(value) - low) / (high - low))
    return t * t * (3.0 - 2.0 * t)


def sigmoid(value, threshold=0.5, steepness=8.0) -> Column:
    return 1.0 / (1.0 + F.exp(-steepness * (col(value) - threshold)))


def zero_floor_sigmoid(value, threshold: float, steepness: float = 8.0) -> Column:
    """Sigmoid shifted and rescaled so that a zero score maps to exactly zero."""
    k = max(float(steepness), 1e-3)
    floor = 1.0 / (1.0 + F.exp(F.lit(k * threshold)))
    return clip((sigmoid(value, threshold, k) - floor) / F.greatest(1.0 - floor, F.lit(1e-6)))


def classify(score, weak: float = WEAK, strong: float = STRONG) -> Column:
    """0 none, 1 weak, 2 strong."""
    s = col(score)
    return F.when(s >= strong, 2).when(s >= weak, 1).otherwise(0)


def appearance(luminance_excess, chromaticity) -> Column:
    return F.greatest(col(luminance_excess), col(chromaticity))


def evidence_support(evidence, app) -> Column:
    return col(evidence) * (0.2 + 0.8 * col(app))


def fuse_score(single, structure, app, cross=0.0, stable=0.0, removed=0.0, *,
               cross_weight: float = 1.0, structure_weight: float = 0.72,
               stable_weight: float = 0.35, rescue_weight: float = 0.95,
               removed_weight: float = 0.85) -> Column:
    """Final score of one pixel from its single-view score and the supporting evidence, all taken within [0, 1].

    Structure lowers the score unless independent evidence rescues it; stable
    structure lowers it further; strong support lifts it.
    """
    unit = lambda w: min(max(float(w), 0.0), 1.0)
    s, stable = clip(single), clip(stable)
    cs, rs = evidence_support(clip(cross), app), evidence_support(clip(removed), app)
    vetoed = clip(structure) * (1.0 - unit(rescue_weight) * F.greatest(cs, rs))
    lowered = s * (1.0 - unit(structure_weight) * vetoed) * (1.0 - unit(stable_weight) * col(stable) * vetoed)
    support = F.greatest(max(cross_weight, 0.0) * cs, max(removed_weight, 0.0) * rs)
    top = max(cross_weight, removed_weight, 0.0)
    return clip(lowered + top / (1.0 + top) * F.greatest(support - lowered, F.lit(0.0)))


def view_evidence(cross, confidence) -> Column:
    return col(cross) * (0.25 + 0.75 * col(confidence))


def independent_evidence(cross, confidence, cross_support=0.0, removed_support=0.0) -> Column:
    return F.greatest(view_evidence(cross, confidence), col(cross_support).cast("double"),
                      col(removed_support).cast("double"))


def weak_boost(score, *, threshold: float, steepness: float, mapping_threshold: float,
               mix_from: float, gain: float) -> Column:
    """Strong-threshold alpha, raised towards the weak-threshold alpha for weak scores."""
    base = zero_floor_sigmoid(score, threshold, steepness)
    weak = zero_floor_sigmoid(score, mapping_threshold, steepness)
    mix = 1.0 - smoothstep(mix_from, threshold, score)
    lifted = clip(base + mix * F.greatest(weak - base, F.lit(0.0)))
    return clip(lifted * (1.0 + max(float(gain), 0.0) * mix))


def detail_fraction(override, stable: float = 0.12) -> Column:
    return clip(stable + (1.0 - stable) * col(override))


def chroma_fraction(override, stable: float = 0.55) -> Column:
    return clip(stable + (1.0 - stable) * col(override))


# --- ratios --------------------------------------------------------------

def percentage(part, whole) -> Column:
    """100 * part / whole; NULL when the whole is zero."""
    return 100.0 * F.try_divide(col(part).cast("double"), col(whole).cast("double"))


def relative_reduction(before, after) -> Column:
    b, a = col(before), col(after)
    return F.when(b > 0, 100.0 * (b - a) / b)


def psnr(mse, pixels=None) -> Column:
    """99 for a vanishing error; NULL when fewer than ten pixels were compared."""
    m = col(mse)
    value = F.when(m <= 1e-12, 99.0).otherwise(10.0 * F.log10(1.0 / m))
    return value if pixels is None else F.when(col(pixels) >= 10, value)


def psnr_from_rmse(rmse) -> Column:
    e = col(rmse)
    return F.when(e <= 1e-12, 99.0).otherwise(20.0 * F.log10(1.0 / e))


# --- geometry ------------------------------------------------------------

def angle_deg(dot) -> Column:
    return F.degrees(F.acos(clip(dot, -1.0, 1.0)))


def within_support(distance_ratio, angle, limits=AUDIT_SUPPORT) -> Column:
    return (col(distance_ratio) <= limits[0]) & (col(angle) <= limits[1])


# --- maps and display ----------------------------------------------------

def decode_map(q, bits: int = 16) -> Column:
    return clip(col(q) / float((1 << bits) - 1))


def encode_map(value, bits: int = 16) -> Column:
    """Truncating quantisation."""
    return F.floor(clip(value) * float((1 << bits) - 1)).cast("int")


def _number(value, pattern: str) -> Column:
    # the pattern form rounds the exact binary value half to even, as C's printf does
    return F.call_function("format_number", col(value).cast("double"), F.lit(pattern))


def format_display(value, digits: int = 2) -> Column:
    return _number(value, "0" + ("." + "0" * digits if digits else ""))


def format_spread(median, q25, q75, digits: int = 2) -> Column:
    return F.concat(format_display(median, digits), F.lit(" ["), format_display(q25, digits),
                    F.lit(", "), format_display(q75, digits), F.lit("]"))


# The modes that read the threshold.
THRESHOLDED = ("soft", "hard", "adaptive_feather", "weak_hysteresis_feather", "weak_hysteresis_outer_feather", "evidence_matte")


def experiment_tag(mode, threshold) -> Column:
    """``mode_t0.3`` for the modes that read the threshold, the bare mode otherwise."""
    text = F.regexp_replace(F.regexp_replace(_number(threshold, "0.000000"), "0+$", ""), r"\.$", "")
    return F.when(col(mode).isin(*THRESHOLDED), F.concat(col(mode), F.lit("_t"), text)).otherwise(col(mode))
