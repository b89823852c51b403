"""Before/after suppression metrics over paired score maps.

Input rows hold one pixel with a ``raw`` and an ``outp`` score. Everything here is an
additive sum, so each task sends at most one row per group to the shuffle and a hot
scene costs no more than a cold one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glintframe.functions.scalar import STRONG, WEAK, classify, percentage

# Tier name -> (relative drop, absolute drop); any_positive is a strict drop > 0.
TIERS = {
    "any_positive": None,
    "detectable": (0.0, 0.005),
    "mild": (0.10, 0.01),
    "meaningful": (0.20, 0.02),
    "strong": (0.30, 0.03),
}
# Decreasing share a region must exceed.
CONSENSUS = {"simple_majority": 0.50, "robust_majority": 0.55}


def check_thresholds(weak: float, strong: float, absolute: float = 0.02, relative: float = 0.20) -> None:
    if not 0.0 <= weak < strong <= 1.0:
        raise ValueError("need 0 <= weak < strong <= 1")
    if absolute < 0.0 or not 0.0 <= relative <= 1.0:
        raise ValueError("need absolute >= 0 and relative in [0, 1]")


def with_states(df: DataFrame, weak: float = WEAK, strong: float = STRONG) -> DataFrame:
    check_thresholds(weak, strong)
    return df.withColumns({"before": classify("raw", weak, strong), "after": classify("outp", weak, strong)})


def tier_test(name: str, absolute: float | None = None, relative: float | None = None) -> Column:
    """Does the drop of a pixel reach the tier? Overrides apply to ``meaningful`` only."""
    drop = F.col("raw") - F.col("outp")
    if TIERS[name] is None:
        return drop > 0
    rel, least = TIERS[name]
    if name == "meaningful":
        rel = rel if relative is None else relative
        least = least if absolute is None else absolute
    return (drop >= least) & (drop >= rel * F.col("raw"))


def transition_matrix(df: DataFrame, keys=("scene",), weak=WEAK, strong=STRONG) -> DataFrame:
    return (with_states(df, weak, strong).groupBy(*keys, "before", "after")
            .agg(F.count(F.lit(1)).alias("pixels")))


def transition_wide(matrix: DataFrame, keys=("scene",)) -> DataFrame:
    """The 3x3 matrix as nine columns ``t00`` .. ``t22``."""
    cell = lambda b, a: F.coalesce(F.sum(F.when((F.col("before") == b) & (F.col("after") == a), F.col("pixels"))), F.lit(0))
    return matrix.groupBy(*keys).agg(*[cell(b, a).alias(f"t{b}{a}") for b in range(3) for a in range(3)])


def area_summary(matrix: DataFrame, keys=("scene",)) -> DataFrame:
    m = transition_wide(matrix, keys)
    t = lambda b, a: F.col(f"t{b}{a}")
    before = {s: sum((t(s, a) for a in range(1, 3)), t(s, 0)) for s in range(3)}
    after = {s: sum((t(b, s) for b in range(1, 3)), t(0, s)) for s in range(3)}
    pixels = before[0] + before[1] + before[2]
    any_b, any_a = before[1] + before[2], after[1] + after[2]
    return m.select(
        *keys, pixels.alias("pixels"),
        percentage(before[1], pixels).alias("weak_before"), percentage(after[1], pixels).alias("weak_after"),
        percentage(before[1] - after[1], before[1]).alias("weak_area_reduction"),
        percentage(before[2], pixels).alias("strong_before"), percentage(after[2], pixels).alias("strong_after"),
        percentage(before[2] - after[2], before[2]).alias("strong_area_reduction"),
        percentage(any_b, pixels).alias("any_before"), percentage(any_a, pixels).alias("any_after"),
        percentage(any_b - any_a, any_b).alias("any_area_reduction"),
        percentage(t(2, 0) + t(2, 1), before[2]).alias("strong_suppression_rate"),
        percentage(t(2, 0), before[2]).alias("strong_clearance_rate"),
        percentage(t(1, 0), before[1]).alias("weak_clearance_rate"),
    )


def severity(matrix: DataFrame, keys=("scene",)) -> DataFrame:
    """Severity weighs a pixel 0, 1 or 2: net change, loss in source pixels, new burden."""
    b, a, n = F.col("before"), F.col("after"), F.col("pixels")
    total = F.sum(b * n)
    return matrix.groupBy(*keys).agg(
        percentage(total - F.sum(a * n), total).alias("net_severity_reduction"),
        percentage(F.sum(F.greatest(b - a, F.lit(0)) * n), total).alias("source_region_severity_reduction"),
        percentage(F.sum(F.greatest(a - b, F.lit(0)) * n), total).alias("new_severity_burden"),
    )


def evidence_attenuation(df: DataFrame, keys=("scene",), weak=WEAK) -> DataFrame:
    source = F.col("raw") >= weak
    before = F.sum(F.when(source, F.col("raw")))
    return df.groupBy(*keys).agg(
        F.count_if(source).alias("source_pixels"),
        percentage(before - F.sum(F.when(source, F.col("outp"))), before).alias("source_evidence_attenuation"))


def _by_state(aggregate, test: Column) -> list[Column]:
    return [aggregate(test & (F.col("before") > 0)), aggregate(test & (F.col("before") == 1)),
            aggregate(test & (F.col("before") == 2))]


def tier_coverage(df: DataFrame, keys=("scene",), weak=WEAK, strong=STRONG, absolute=None, relative=None) -> DataFrame:
    """Share of source pixels whose drop reaches each tier: one scan, one row per key and tier."""
    states = with_states(df, weak, strong)
    aggs, parts = [F.count_if(F.col("before") > 0).alias("n_all"), F.count_if(F.col("before") == 1).alias("n_weak"),
                   F.count_if(F.col("before") == 2).alias("n_strong")], []
    for name in TIERS:
        test = tier_test(name, absolute, relative)
        aggs += [c.alias(f"{name}_{s}") for c, s in zip(_by_state(F.count_if, test), ("all", "weak", "strong"))]
        parts.append(F.struct(F.lit(name).alias("tier"), *[
            percentage(f"{name}_{s}", f"n_{s}").alias(f"{s}_percent") for s in ("all", "weak", "strong")]))
    counts = states.groupBy(*keys).agg(*aggs)
    return counts.select(*keys, F.inline(F.array(*parts)))


def per_image_rows(df: DataFrame, keys=("scene", "frame"), weak=WEAK, strong=STRONG) -> DataFrame:
    """One row of per-image metrics; ``regions.with_consensus`` adds those of connected regions."""
    s = with_states(df, weak, strong)
    b, a = F.col("before"), F.col("after")
    n = F.count(F.lit(1))
    source = F.count_if(b > 0)
    before = F.sum(F.when(b > 0, F.col("raw")))
    tier = lambda name: percentage(F.count_if(tier_test(name) & (b > 0)), source)
    return s.groupBy(*keys).agg(
        n.alias("pixels"),
        percentage(F.count_if(b == 1), n).alias("raw_weak_percent"),
        percentage(F.count_if(b == 2), n).alias("raw_strong_percent"),
        percentage(F.count_if(a == 1), n).alias("output_weak_percent"),
        percentage(F.count_if(a == 2), n).alias("output_strong_percent"),
        percentage(F.count_if((b == 2) & (a < 2)), F.count_if(b == 2)).alias("strong_state_suppression_percent"),
        percentage(F.count_if((b == 1) & (a == 0)), F.count_if(b == 1)).alias("weak_clearance_percent"),
        percentage(before - F.sum(F.when(b > 0, F.col("outp"))), before).alias("source_evidence_attenuation_percent"),
        tier("meaningful").alias("meaningful_improvement_percent"),
        tier("any_positive").alias("any_positive_suppression_percent"),
        tier("detectable").alias("detectable_suppression_percent"),
        tier("mild").alias("mild_suppression_percent"),
        tier("strong").alias("strong_tier_coverage_percent"),
    )


def suppression_summary(df: DataFrame, keys=("scene",), weak=WEAK, strong=STRONG) -> DataFrame:
    """Area, severity, attenuation and tier shares of every key in a single pass."""
    s = with_states(df, weak, strong)
    b, a = F.col("before"), F.col("after")
    count = lambda test: F.count_if(test)
    n, wb, sb = F.count(F.lit(1)), count(b == 1), count(b == 2)
    wa, sa = count(a == 1), count(a == 2)
    burden = F.sum(b.cast("long"))
    before = F.sum(F.when(b > 0, F.col("raw")))
    meaningful = tier_test("meaningful")
    return s.groupBy(*keys).agg(
        n.alias("pixels"),
        percentage(wb - wa, wb).alias("weak_area_reduction"),
        percentage(sb - sa, sb).alias("strong_area_reduction"),
        percentage(wb + sb - wa - sa, wb + sb).alias("any_area_reduction"),
        percentage(count((b == 2) & (a < 2)), sb).alias("strong_suppression_rate"),
        percentage(count((b == 1) & (a == 0)), wb).alias("weak_clearance_rate"),
        percentage(burden - F.sum(a.cast("long")), burden).alias("net_severity_reduction"),
        percentage(F.sum(F.greatest(b - a, F.lit(0)).cast("long")), burden).alias("source_region_severity_reduction"),
        percentage(F.sum(F.greatest(a - b, F.lit(0)).cast("long")), burden).alias("new_severity_burden"),
        percentage(before - F.sum(F.when(b > 0, F.col("outp"))), before).alias("source_evidence_attenuation"),
        percentage(count(meaningful & (b > 0)), wb + sb).alias("meaningful_improvement_rate"),
        percentage(count(meaningful & (b == 1)), wb).alias("weak_meaningful_improvement_rate"),
        percentage(count(meaningful & (b == 2)), sb).alias("strong_meaningful_improvement_rate"),
    )
