"""Neighbourhood operators on pixel tables.

A frame table has ``scene, frame, y, x`` and the frame size ``h, w``. A 2-D stencil is a
window over one image row and then a window over one image column, so the largest group
is one line of one image. Pixels near a border are repeated at their mirrored positions
first, which makes every border rule a plain window; the copies are dropped again.

Without preparation each pass shuffles on (frame, line). ``colocate`` places whole frames
once, and all later passes of a chain then only sort inside their task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from glintframe.functions.scalar import col
from glintframe.session import place

FRAME = ["scene", "frame"]


def colocate(df: DataFrame, frame=None) -> DataFrame:
    return place(df, *(frame or FRAME))


def per_frame_size(df: DataFrame, build, short_side: int | Column | None) -> DataFrame:
    """``build(rows, side)`` with the given shorter side, or with a column of each frame's own.

    Widths that follow the side are then columns too: one plan for any number of frame sizes, and no job to find them.
    """
    return build(df, F.least("h", "w") if short_side is None else short_side)


def _images(pos: Column, n: Column, pad: int, border: str) -> Column:
    """Positions in [-pad, n-1+pad] that show the pixel at ``pos`` under the border rule; NULL ones do not count."""
    inside = (pos >= pad) & (pos < n - pad)
    if border in ("replicate", "edge"):
        many = F.concat(F.array(pos),
                        F.when(pos == 0, F.sequence(F.lit(-pad), F.lit(-1))).otherwise(F.array().cast("array<int>")),
                        F.when(pos == n - 1, F.sequence(n.cast("int"), (n - 1 + pad).cast("int"))).otherwise(F.array().cast("array<int>")))
        inside = (pos > 0) & (pos < n - 1)
    else:
        # period of the mirrored line: 2n (edge repeated) or 2n-2 (edge not repeated)
        if border == "reflect":
            period, mirror = 2 * n, -1 - pos
        else:
            period, mirror = F.greatest(2 * n - 2, F.lit(1)), -pos
            inside = (pos > pad) & (pos < n - 1 - pad)
        turns = F.sequence(F.lit(-1) - F.floor(F.lit(pad) / period).cast("int"), F.lit(1) + F.floor(F.lit(pad) / period).cast("int"))
        both = F.flatten(F.transform(turns, lambda k: F.array((pos + k * period).cast("int"), (mirror + k * period).cast("int"))))
        many = F.array_distinct(F.filter(both, lambda p: (p >= -pad) & (p <= n - 1 + pad)))
        # a border within one period needs no more than one turn to each side, which is plain arithmetic
        own = (pos == 0) | (pos == n - 1) if border != "reflect" else F.lit(False)
        shown = [F.when(at.between(-pad, n - 1 + pad), at.cast("int")) for at in (pos, pos - period, pos + period)]
        shown += [F.when(~own & at.between(-pad, n - 1 + pad), at.cast("int")) for at in (mirror, mirror - period, mirror + period)]
        many = F.when(pad <= period, F.array(*shown)).otherwise(many)
    return F.when(inside, F.array(pos)).otherwise(many)


def line_window(axis: str, frame=None):
    return Window.partitionBy(*(frame or FRAME), "y" if axis == "x" else "x").orderBy("_t")


def along(df: DataFrame, axis: str, pad: int, border: str, make, frame=None, drop=()) -> DataFrame:
    """One pass: ``make(window)`` gives the columns computed on the padded line (new or replaced)."""
    size = "w" if axis == "x" else "h"
    shown = F.explode(_images(F.col(axis).cast("int"), F.col(size).cast("int"), pad, border)).alias("_t")
    new = make(line_window(axis, frame))
    kept = [c for c in df.columns if c not in new and c not in drop]
    inside = (F.col("_t") >= 0) & (F.col("_t") < F.col(size))
    lines = df.select("*", shown).where("_t is not null")
    return (lines.select(*kept, "_t", *[c.alias(n) for n, c in new.items()]).where(inside).drop("_t"))


def with_outputs(df: DataFrame, outputs: dict[str, Column | str]) -> DataFrame:
    return df.withColumns({n: col(v).cast("double") for n, v in outputs.items()})


def _fold(t: Column, n: Column, border: str) -> Column:
    """Place on a line of ``n`` pixels that the border rule shows at ``t``."""
    if border in ("replicate", "edge"):
        return F.greatest(F.lit(0), F.least(n - 1, t))
    period = 2 * n if border == "reflect" else F.greatest(2 * n - 2, F.lit(1))
    m = F.pmod(t, period)
    return F.when(m < n, m).otherwise((2 * n - 1 if border == "reflect" else 2 * n - 2) - m)


def _on_lines(df: DataFrame, axis: str, width: Column, extra, value, outputs, frame) -> DataFrame:
    """Replace each output by ``value(arrays, i, n, width)``, from whole image lines held as arrays.

    ``width`` has one value for each frame; ``extra(name)`` names the arrays that an output reads, and the columns
    that are gathered and not kept. A line is the largest group.
    """
    keys, line = frame or FRAME, "y" if axis == "x" else "x"
    arrays = {n: extra(n) for n in outputs}
    helpers = {c for cols in arrays.values() for c in cols} - set(outputs)
    rest = [c for c in df.columns if c not in (*keys, line, axis)]
    rows = df.groupBy(*keys, line).agg(F.array_sort(F.collect_list(F.struct(axis, *rest))).alias("_line"), F.max(width).alias("_width"))
    # arrays of single values are made once for each line, below the generator
    rows = rows.withColumns({f"_at_{c}": F.col(f"_line.{c}") for cols in arrays.values() for c in cols} | {"_n": F.size("_line")})
    if value is _weighed:
        rows = rows.withColumn("_width", _bell(F.col("_width")))
    kept = [axis, *[c for c in rest if c not in outputs and c not in helpers]]
    one = lambda e, i: F.struct(*[e[c].alias(c) for c in kept], *[
        value([F.col(f"_at_{c}") for c in cols], i, F.col("_n"), F.col("_width")).alias(n) for n, cols in arrays.items()])
    return rows.select(*keys, line, F.inline(F.transform("_line", one))).select(*[c for c in df.columns if c not in helpers])


def _bell(sigma: Column) -> Column:
    """Normalised Gaussian taps as an array, its length that of ``taps``."""
    r = F.floor(F.rint(sigma * 8 + 1).cast("int").bitwiseOR(F.lit(1)) / 2).cast("int")
    raw = F.transform(F.sequence(-r, r), lambda k: F.exp(-(k * k) / (2.0 * sigma * sigma)))
    total = F.aggregate(raw, F.lit(0.0), lambda a, t: a + t)
    return F.transform(raw, lambda t: t / total)


def _weighed(arrays, i, n, bell, border="replicate"):
    reach = F.floor(F.size(bell) / 2).cast("int")
    shown = lambda k: F.get(arrays[0], _fold(i + k - reach, n, border).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), F.size(bell) - 1), F.lit(0.0), lambda a, k: a + shown(k) * F.get(bell, k))


def _up_to(sums: Column, t: Column, n: Column, border: str) -> Column:
    """Sum of a bordered line from its first pixel up to ``t`` (negative before it), from its running sums."""
    at = lambda k: F.when(k < 0, F.lit(0.0)).otherwise(F.get(sums, k.cast("int")))
    whole = F.get(sums, n - 1)
    if border in ("replicate", "edge"):
        return F.when(t < 0, (t + 1) * F.get(sums, F.lit(0))).when(t >= n, whole + (t - n + 1) * (whole - at(n - 2))).otherwise(at(t))
    turns, m = F.floor((t + 1) / (2 * n)), F.pmod(t + 1, 2 * n)
    return 2 * turns * whole + F.when(m <= n, at(m - 1)).otherwise(2 * whole - at(2 * n - m - 1))


def _box_by_column(df: DataFrame, outputs, k: Column, border: str, frame) -> DataFrame:
    if border not in ("replicate", "edge", "reflect"):
        raise ValueError(f"no running sums for border {border!r}")
    reach = F.floor(k / 2).cast("int")

    def mean(arrays, i, n, p):
        total = lambda a: _up_to(a, i + p, n, border) - _up_to(a, i - p - 1, n, border)
        count = total(arrays[1])
        return F.when(count > 0.5, total(arrays[0]) / count)

    for axis in ("x", "y"):
        w = Window.partitionBy(*(frame or FRAME), "y" if axis == "x" else "x").orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({f"_s_{n}": F.sum(F.coalesce(F.col(n), F.lit(0.0))).over(w) for n in outputs}
                            | {f"_c_{n}": F.sum(F.col(n).isNotNull().cast("double")).over(w) for n in outputs})
        df = _on_lines(df, axis, reach, lambda n: [f"_s_{n}", f"_c_{n}"], mean, outputs, frame)
    return df


def odd(k: int) -> int:
    k = max(int(k), 1)
    return k if k % 2 else k + 1


def box_mean(df: DataFrame, outputs: dict[str, Column | str], k: int | Column, border: str = "reflect", frame=None) -> DataFrame:
    """Separable k x k mean of every named expression; all of them share the two passes.

    ``k`` may be a column with one value for each frame: running sums along image lines then give every width.
    """
    df = with_outputs(df, outputs)
    if isinstance(k, Column):
        return _box_by_column(df, outputs, k, border, frame)
    p = odd(k) // 2
    for axis in ("x", "y"):
        df = along(df, axis, p, border, lambda w: {n: F.avg(n).over(w.rowsBetween(-p, p)) for n in outputs}, frame)
    return df


def taps(sigma: float, radius: int | None = None) -> list[float]:
    """Normalised Gaussian taps; the default radius is that of 8 * sigma + 1 rounded to odd."""
    radius = (int(round(sigma * 8 + 1)) | 1) // 2 if radius is None else radius
    raw = [math.exp(-(d * d) / (2.0 * sigma * sigma)) for d in range(-radius, radius + 1)]
    return [t / sum(raw) for t in raw]


def gaussian_blur(df: DataFrame, outputs: dict[str, Column | str], sigma: float | Column, border: str = "replicate", frame=None) -> DataFrame:
    """Separable Gaussian of every named expression; ``sigma`` may be a column with one value for each frame."""
    df = with_outputs(df, outputs)
    if isinstance(sigma, Column):
        if border != "replicate":
            raise ValueError("a column of sigmas needs the replicate border")
        for axis in ("x", "y"):
            df = _on_lines(df, axis, sigma, lambda n: [n], _weighed, outputs, frame)
        return df
    bell = taps(sigma)
    r = len(bell) // 2

    def weigh(name, w):
        at = lambda d: F.lead(name, d).over(w) if d >= 0 else F.lag(name, -d).over(w)
        # the copies outside the line have no full neighbourhood: they are dropped after the pass
        return sum((at(d) * t for d, t in zip(range(-r, r + 1), bell)), F.lit(0.0))

    for axis in ("x", "y"):
        df = along(df, axis, r, border, lambda w: {n: weigh(n, w) for n in outputs}, frame)
    return df


def highpass(df: DataFrame, outputs: dict[str, str], sigma: float = 2.0, border: str = "reflect101") -> DataFrame:
    """Value minus its blur."""
    df = gaussian_blur(df, {f"_b_{n}": v for n, v in outputs.items()}, sigma, border)
    return df.withColumns({n: col(v) - F.col(f"_b_{n}") for n, v in outputs.items()}).drop(*[f"_b_{n}" for n in outputs])


def gradient(df: DataFrame, value: str, gx: str = "gx", gy: str = "gy", frame=None) -> DataFrame:
    """Central differences, one-sided at the border (zero on lines of one pixel)."""
    new = {}
    for axis, name in (("x", gx), ("y", gy)):
        w = Window.partitionBy(*(frame or FRAME), "y" if axis == "x" else "x").orderBy(axis)
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        new[name] = F.coalesce((after - before) / 2.0, after - here, here - before, F.lit(0.0))
    return df.withColumns(new)


def sobel(df: DataFrame, value: str, gx: str = "gx", gy: str = "gy", magnitude: str | None = "gmag",
          border: str = "reflect101", frame=None) -> DataFrame:
    """3 x 3 Sobel derivatives and their magnitude."""
    return sobels(df, {value: (gx, gy, magnitude)}, border, frame)


def sobels(df: DataFrame, names: dict[str, tuple[str, str, str | None]], border: str = "reflect101", frame=None) -> DataFrame:
    """Sobel derivatives of every named column, as ``(gx, gy, magnitude)``; all of them share the two passes."""
    lag, lead, values = (lambda c, w: F.lag(c, 1).over(w)), (lambda c, w: F.lead(c, 1).over(w)), list(enumerate(names.items()))
    df = along(df, "x", 1, border, lambda w: {f"_d{i}": lead(v, w) - lag(v, w) for i, (v, _) in values}
               | {f"_m{i}": lag(v, w) + 2 * F.col(v) + lead(v, w) for i, (v, _) in values}, frame)
    df = along(df, "y", 1, border, lambda w: {gx: lag(f"_d{i}", w) + 2 * F.col(f"_d{i}") + lead(f"_d{i}", w) for i, (_, (gx, _, _)) in values}
               | {gy: lead(f"_m{i}", w) - lag(f"_m{i}", w) for i, (_, (_, gy, _)) in values},
               frame, drop=[f"_{k}{i}" for k in "dm" for i, _ in values])
    return df.withColumns({m: F.sqrt(F.col(gx) ** 2 + F.col(gy) ** 2) for gx, gy, m in names.values() if m is not None})


def local_std(df: DataFrame, value: str, k: int = 9, name: str = "local_std") -> DataFrame:
    df = box_mean(df, {"_e1": F.col(value), "_e2": F.col(value) * F.col(value)}, k, "edge")
    return df.withColumn(name, F.sqrt(F.greatest(F.col("_e2") - F.col("_e1") * F.col("_e1"), F.lit(0.0)))).drop("_e1", "_e2")


def guided_base(df: DataFrame, value: str, k: int = 15, eps: float = 0.01, name: str = "base") -> DataFrame:
    """Edge-preserving base of a map guided by itself."""
    return guided_filter(df, value, value, odd(k) // 2, eps, name, "reflect")


def guided_filter(df: DataFrame, guide: str, value: str, radius: int | Column, eps: float, name: str = "filtered",
                  border: str = "replicate") -> DataFrame:
    """Smooth ``value`` while keeping the edges of ``guide``."""
    k = 2 * (F.greatest(radius, F.lit(1)) if isinstance(radius, Column) else max(int(radius), 1)) + 1
    g, v = F.col(guide), F.col(value)
    # a map that guides itself has the same two means for both
    mv, cx = ("_mg", "_cg") if guide == value else ("_mv", "_cx")
    df = box_mean(df, {"_mg": g, mv: v, "_cg": g * g, cx: g * v}, k, border)
    var = F.greatest(F.col("_cg") - F.col("_mg") * F.col("_mg"), F.lit(0.0))
    a = (F.col(cx) - F.col("_mg") * F.col(mv))
    if guide == value:
        a = F.greatest(a, F.lit(0.0))
    a = a / (var + max(float(eps), 1e-6))
    df = box_mean(df, {"_ma": a, "_mb": F.col(mv) - a * F.col("_mg")}, k, border)
    return df.withColumn(name, F.col("_ma") * g + F.col("_mb")).drop("_mg", mv, "_cg", cx, "_ma", "_mb")


def coherence(df: DataFrame, gx: str, gy: str, k: int = 15, name: str = "coherence") -> DataFrame:
    """Anisotropy of the smoothed structure tensor, 0 for no direction and near 1 for one direction."""
    x, y = F.col(gx), F.col(gy)
    df = box_mean(df, {"_jxx": x * x, "_jyy": y * y, "_jxy": x * y}, k)
    a, b, c = F.col("_jxx"), F.col("_jyy"), F.col("_jxy")
    return df.withColumn(name, F.sqrt((a - b) ** 2 + 4.0 * c * c) / (a + b + 1e-6)).drop("_jxx", "_jyy", "_jxy")


# --- morphology: 3 x 3 plus-shaped element ------------------------------

def _plus(df: DataFrame, value: str, out: str, pick, frame) -> DataFrame:
    agg, both = (F.max, F.greatest) if pick == "max" else (F.min, F.least)
    near = [agg(value).over(Window.partitionBy(*(frame or FRAME), line).orderBy(axis).rangeBetween(-1, 1))
            for axis, line in (("x", "y"), ("y", "x"))]
    return df.withColumn(out, both(*near))


def dilate(df: DataFrame, value: str, out: str | None = None, frame=None) -> DataFrame:
    """Grey or binary dilation (pixels outside the frame do not count)."""
    return _plus(df, value, out or value, "max", frame)


def erode(df: DataFrame, value: str, out: str | None = None, frame=None) -> DataFrame:
    return _plus(df, value, out or value, "min", frame)


def morph_open(df: DataFrame, value: str, out: str | None = None, frame=None) -> DataFrame:
    return dilate(erode(df, value, out, frame), out or value, out or value, frame)


def morph_close(df: DataFrame, value: str, out: str | None = None, frame=None) -> DataFrame:
    return erode(dilate(df, value, out, frame), out or value, out or value, frame)


# --- resampling by a factor ----------------------------------------------

def coarse_side(side: Column, factor: int) -> Column:
    """Cells along a side of the grid that is ``factor`` times coarser, at least one."""
    return F.greatest(F.floor(side / factor), F.lit(1)).cast("int")


def nearest_cell(pos: Column, side: Column, factor: int) -> Column:
    """Cell that holds the pixel's first corner."""
    return F.floor(pos * coarse_side(side, factor) / side).cast("int")


def _cover(pos: Column, side: Column, factor: int) -> Column:
    """Cells that a pixel lies in, with the shares of it in units of one over the number of cells."""
    cells = coarse_side(side, factor)
    first, last = F.floor(pos * cells / side), F.floor(((pos + 1) * cells - 1) / side)
    share = lambda c: F.least((pos + 1) * cells, (c + 1) * side) - F.greatest(pos * cells, c * side)
    return F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda c: F.struct(c.alias("at"), share(c).alias("share")))


def downsample_area(df: DataFrame, factor: int, values) -> DataFrame:
    """Area means over ``max(side // factor, 1)`` cells a side; a pixel on a cell border counts in both by its share."""
    h, w = F.col("h"), F.col("w")
    d = (df.select(*FRAME, "h", "w", *values, F.explode(_cover(F.col("y"), h, factor)).alias("_y"), "x")
         .select(*FRAME, "h", "w", *values, "_y", F.explode(_cover(F.col("x"), w, factor)).alias("_x"))
         .withColumn("_share", (F.col("_y.share") * F.col("_x.share")).cast("double")))
    mean = lambda v: F.sum(F.col("_share") * F.col(v)) / F.sum(F.when(F.col(v).isNotNull(), F.col("_share")))
    return (d.groupBy(*FRAME, F.col("_y.at").alias("y"), F.col("_x.at").alias("x"))
            .agg(F.max(coarse_side(h, factor)).alias("h"), F.max(coarse_side(w, factor)).alias("w"), *[mean(v).alias(v) for v in values]))


def upsample(full: DataFrame, small: DataFrame, factor: int, linear=(), near=()) -> DataFrame:
    """Bring cell values back to every pixel: bilinear (half-pixel centres, border cells repeated) or nearest.

    Each cell first collects its neighbours' values in two line windows, on the small table;
    one join per pixel then replaces four. Sizes of exploded pixels are not known before they
    are made, so the join is a merge: neither side may be taken for small and broadcast.
    """
    sides = {"y": F.col("h"), "x": F.col("w")}
    own = {p: nearest_cell(F.col(p), n, factor) for p, n in sides.items()}
    if not linear:
        one = small.select(*FRAME, F.col("y").alias("_ty"), F.col("x").alias("_tx"), *near)
        return full.withColumns({f"_t{p}": c for p, c in own.items()}).join(one.hint("merge"), [*FRAME, "_ty", "_tx"]).drop("_ty", "_tx")
    taken = [*linear, *near]
    one = small.select(*FRAME, F.col("y").alias("_ty"), F.col("x").alias("_tx"), *taken)
    across = Window.partitionBy(*FRAME, "_ty").orderBy("_tx")
    down = Window.partitionBy(*FRAME, "_tx").orderBy("_ty")
    around = lambda v, w: F.array(F.coalesce(F.lag(v).over(w), v), v, F.coalesce(F.lead(v).over(w), v))
    one = one.withColumns({f"_{v}": around(F.col(v), across) for v in taken})
    one = one.withColumns({f"_g{v}": around(F.col(f"_{v}"), down) for v in taken}).drop(*taken, *[f"_{v}" for v in taken])
    # the cell under the pixel's centre, and the centre's distance from that cell's, in cells
    centre = {p: (2 * F.col(p) + 1) * coarse_side(n, factor) / (2 * n) for p, n in sides.items()}
    keyed = full.withColumns({f"_t{p}": F.floor(c).cast("int") for p, c in centre.items()})
    out = keyed.join(one.hint("merge"), [*FRAME, "_ty", "_tx"])
    off = {p: c - 0.5 - F.col(f"_t{p}") for p, c in centre.items()}
    other = {p: F.when(c < 0, 0).otherwise(2) for p, c in off.items()}
    cell = {p: 1 + c - F.col(f"_t{p}") for p, c in own.items()}

    def blend(v):
        g, (wy, wx) = F.col(f"_g{v}"), (F.abs(off["y"]), F.abs(off["x"]))
        row = lambda r: r[1] * (1 - wx) + r[other["x"]] * wx
        return row(g[1]) * (1 - wy) + row(g[other["y"]]) * wy

    values = {v: blend(v) for v in linear} | {v: F.col(f"_g{v}")[cell["y"]][cell["x"]] for v in near}
    return out.withColumns(values).drop("_ty", "_tx", *[f"_g{v}" for v in taken])
