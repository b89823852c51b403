"""Exact linear-interpolation quantiles, safe for groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one buffer, which fails for a group
that holds a third of a table. Here every group is collapsed to (value, count) pairs and to a histogram whose
cells are an order-preserving code of the value (power of two, then equal steps): the cell of each wanted rank is
found in that small histogram, and only the values of those cells are ordered, each cell on its own. One plan for
all sizes, and no job before the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glintframe.functions.scalar import col, finite
from glintframe.session import materialize

_STEPS = 1 << 14
_SKETCH = 200  # values that a sketch keeps as they are
_SMALL = 64  # values of a group that is read from its sketch


def order_code(value) -> Column:
    """Monotone integer code: ``_STEPS`` equal steps inside each power of two, sign-aware."""
    v = col(value).cast("double")
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    step = F.floor(size / F.pow(F.lit(2.0), exponent) * _STEPS)
    magnitude = (exponent + 1100) * _STEPS + step - _STEPS
    code = F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * magnitude).cast("long")
    return F.coalesce(code, F.lit(0).cast("long"))


def hot_groups(df: DataFrame, keys, limit: int) -> DataFrame | None:
    """Keys of the groups above ``limit`` rows, or None. Runs one count over ``df``."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= limit:
        return None
    return materialize(sizes.where(F.col("_n") > limit).drop("_n"))


def exact_quantiles(df: DataFrame, keys, value, probs: dict[str, float], *, count_as: str | None = None) -> DataFrame:
    """One row per key with a column per named probability (NULL and NaN values and NULL keys ignored).

    A key without any value keeps its row, with NULL quantiles and a count of 0.
    """
    keys = list(keys)
    # one reference to the value: a filter on it would be pushed down and repeat its expression
    rows = df.select(*keys, F.nanvl(col(value).cast("double"), F.lit(None).cast("double")).alias("_v"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return _by_histogram(rows, keys, probs, count_as)


def _by_histogram(rows, keys, probs, count_as):
    pairs = rows.groupBy(*keys, "_v").agg(F.count("_v").alias("_c")).withColumn("_b", F.when(F.col("_v").isNotNull(), order_code("_v")).otherwise(F.lit(-(1 << 62))))
    cells = pairs.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = lambda n: F.array(*[r for p in probs.values() for r in (
        F.floor((n - 1) * p), F.least(F.floor((n - 1) * p) + 1, n - 1))])
    cells = (cells.withColumn("_hi", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(whole))
             .withColumn("_base", F.col("_hi") - F.col("_c")))
    # the cell of missing values has no width; it stands for a group that has nothing else
    wanted = cells.where((F.col("_n") == 0) | F.exists(ranks(F.col("_n")), lambda r: (r >= F.col("_base")) & (r < F.col("_hi"))))
    on = [*keys, "_b"]
    inside = pairs.join(wanted.select(*on, "_base", "_n"), on)
    within = Window.partitionBy(*on).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (inside.withColumn("_to", F.col("_base") + F.sum("_c").over(within))
              .withColumn("_from", F.col("_to") - F.col("_c")))
    at = lambda r: F.max(F.when((r >= F.col("_from")) & (r < F.col("_to")), F.col("_v")))
    aggs = [F.max("_n").alias("_n")]
    for i, p in enumerate(probs.values()):
        low = F.floor((F.col("_n") - 1) * p)
        aggs += [at(low).alias(f"_l{i}"), at(F.least(low + 1, F.col("_n") - 1)).alias(f"_h{i}")]
    found = placed.groupBy(*keys).agg(*aggs)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        share = (F.col("_n") - 1) * p - F.floor((F.col("_n") - 1) * p)
        out.append((F.col(f"_l{i}") + share * (F.col(f"_h{i}") - F.col(f"_l{i}"))).alias(name))
    if count_as:
        out.append(F.col("_n").alias(count_as))
    return found.select(*keys, *out)


def group_quantiles(df: DataFrame, keys, value, probs: dict[str, float], *, count_as: str | None = None) -> DataFrame:
    """``exact_quantiles`` for tables of many groups, most of them small.

    A sketch of each group is built where its rows are read; it keeps ``_SKETCH`` values as they are, so for groups of up
    to ``_SMALL`` every order statistic is exact after one shuffle of sketches. Only the rows of larger groups go on to
    the histogram.
    """
    keys = list(keys)
    rows = df.select(*keys, F.nanvl(col(value).cast("double"), F.lit(None).cast("double")).alias("_v"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    sketched = rows.groupBy(*keys).agg(F.kll_sketch_agg_double("_v", _SKETCH).alias("_k"), F.count("_v").alias("_n"))
    n = F.col("_n")
    # a sketch takes constant ranks only: of twice as many as there are values, each value has one near its middle
    asked = F.array(*[F.lit((i + 0.5) / (2 * _SMALL)) for i in range(2 * _SMALL)])
    at = lambda rank: F.get("_q", F.floor((rank + 0.5) / n * (2 * _SMALL)).cast("int"))
    out = []
    for name, p in probs.items():
        low = F.floor((n - 1) * p)
        out.append((at(low) + ((n - 1) * p - low) * (at(F.least(low + 1, n - 1)) - at(low))).alias(name))
    if count_as:
        out.append(n.alias(count_as))
    large = rows.join(sketched.where(n > _SMALL).select(*keys), keys, "left_semi")
    small = sketched.where(n <= _SMALL).withColumn("_q", F.when(n > 0, F.kll_sketch_get_quantile_double("_k", asked)))
    return small.select(*keys, *out).unionByName(_by_histogram(large, keys, probs, count_as))


def with_frame_quantile(df: DataFrame, wanted: dict[str, tuple[Column, float]],
                        frame=("scene", "frame")) -> DataFrame:
    """Put a per-frame quantile back on every pixel of the frame, without a join.

    Frames are bounded by the sensor. Each value is ordered inside its frame by Spark's
    spilling sort, and the wanted ranks are picked in the same order, so no value map is
    held and the plan is not read twice. NULL values do not count.
    """
    whole = Window.partitionBy(*frame)
    ids = list(enumerate(wanted.items()))
    df = df.withColumns({f"_qv{i}": F.nanvl(col(v).cast("double"), F.lit(None).cast("double")) for i, (_, (v, _)) in ids})
    df = df.withColumns({**{f"_qr{i}": F.row_number().over(whole.orderBy(F.col(f"_qv{i}").asc_nulls_last())) - 1 for i, _ in ids},
                         **{f"_qn{i}": F.count(f"_qv{i}").over(whole) for i, _ in ids}})
    low = lambda i, p: F.floor((F.col(f"_qn{i}") - 1) * p)
    at = lambda i, rank: F.max(F.when(F.col(f"_qr{i}") == rank, F.col(f"_qv{i}"))).over(whole)
    df = df.withColumns({**{f"_ql{i}": at(i, low(i, p)) for i, (_, (_, p)) in ids},
                         **{f"_qh{i}": at(i, F.least(low(i, p) + 1, F.col(f"_qn{i}") - 1)) for i, (_, (_, p)) in ids}})
    share = lambda i, p: (F.col(f"_qn{i}") - 1) * p - low(i, p)
    return df.withColumns({name: F.col(f"_ql{i}") + share(i, p) * (F.col(f"_qh{i}") - F.col(f"_ql{i}")) for i, (name, (_, p)) in ids}).drop(
        *[f"_q{k}{i}" for k in "vrnlh" for i, _ in ids])


def robust_normalize(df: DataFrame, wanted: dict[str, tuple[Column, float]],
                     frame=("scene", "frame")) -> DataFrame:
    """``least(value / percentile, 1)`` per frame; 0 where the percentile is at most 1e-8.

    Our own definition of the normalisation: the original formula is not published.
    """
    scaled = with_frame_quantile(df, {f"_s_{k}": v for k, v in wanted.items()}, frame)
    unit = lambda name, value: F.when(F.col(f"_s_{name}") > 1e-8, F.least(col(value) / F.col(f"_s_{name}"), F.lit(1.0))).otherwise(0.0)
    return scaled.withColumns({name: unit(name, value) for name, (value, _) in wanted.items()}).drop(*[f"_s_{k}" for k in wanted])
