"""Connected regions of a mask, their geometry and region-level decisions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from glintframe.functions.scalar import STRONG, WEAK, classify, col, percentage, smoothstep
from glintframe.operators.quantiles import hot_groups
from glintframe.operators.stencil import FRAME
from glintframe.operators.suppression import CONSENSUS
from glintframe.session import materialize, place

_ROW = 1 << 32   # a run's id orders runs as a raster scan meets them
_BLOCK = 128     # runs meet inside blocks of this many columns


def _with_run_start(pixels: DataFrame, mask: Column) -> DataFrame:
    """``_x0``: first column of the run a masked pixel belongs to (NULL outside the mask)."""
    row = Window.partitionBy(*FRAME, "y").orderBy("x")
    d = pixels.withColumn("_on", F.coalesce(mask, F.lit(False)))
    starts = F.col("_on") & ~(F.coalesce(F.lag("_on").over(row), F.lit(False)) & (F.coalesce(F.lag("x").over(row), F.lit(-9)) == F.col("x") - 1))
    d = d.withColumn("_s", F.when(starts, F.col("x")))
    return d.withColumn("_x0", F.when(F.col("_on"), F.last("_s", ignorenulls=True).over(row))).drop("_s")


def _touching(runs: DataFrame, reach: int) -> DataFrame:
    """Pairs of runs in neighbouring rows that touch."""
    span = F.sequence(F.floor((F.col("x0") - reach) / _BLOCK), F.floor((F.col("x1") + reach) / _BLOCK))
    spread = runs.withColumn("_blk", F.explode(span))
    below = spread.select(*FRAME, (F.col("y") - 1).alias("y"), "_blk", F.col("rid").alias("b"), F.col("x0").alias("u0"), F.col("x1").alias("u1"))
    near = (F.col("u0") <= F.col("x1") + reach) & (F.col("u1") >= F.col("x0") - reach)
    return spread.join(below, [*FRAME, "y", "_blk"]).where(near).select(*FRAME, F.col("rid").alias("a"), "b").distinct()


def group_starts(rows: pa.Table, keys=FRAME) -> np.ndarray:
    """Whether each row but the first belongs to another group (frame) than the row before it."""
    other = [pc.fill_null(pc.not_equal(rows[k].slice(1), rows[k].slice(0, rows.num_rows - 1)), True).to_numpy() for k in keys]
    return np.logical_or.reduce(other)


def _smallest(rows: pa.Table) -> pa.Table:
    """Smallest reachable id inside each frame, by repeated minima and pointer jumps over all frames of the table."""
    new = np.concatenate([[True], group_starts(rows)])
    first, number = np.flatnonzero(new), np.cumsum(new) - 1
    ids, codes = np.unique(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]), return_inverse=True)
    # nodes in order of frame and id
    nodes, ends = np.unique(np.tile(number, 2) * len(ids) + codes.ravel(), return_inverse=True)
    ends = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        low = root[ends].min(axis=0)
        nxt = root.copy()
        np.minimum.at(nxt, root[ends].ravel(), np.tile(low, 2))
        nxt = nxt[nxt]
        if np.array_equal(nxt, root):
            break
        root = nxt
    at = first[nodes // len(ids)]
    return pa.table({**{k: rows[k].take(pa.array(at)) for k in FRAME}, "a": ids[nodes % len(ids)], "p": ids[nodes[root] % len(ids)]})


def _solve_frames(batches):
    """Roots of whole frames that follow one another; a frame that goes on in the next batch waits for it."""
    held = []
    for batch in batches:
        rows = pa.table(batch)
        if not rows.num_rows:
            continue
        joint = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), rows]) if held else rows
        starts = np.flatnonzero(group_starts(joint)) + (0 if held else 1)
        if len(starts):
            yield from _smallest(pa.concat_tables([*held, rows.slice(0, starts[-1])]).combine_chunks()).to_batches()
            held, rows = [], rows.slice(starts[-1])
        held.append(rows)
    if held:
        yield from _smallest(pa.concat_tables(held).combine_chunks()).to_batches()


def _roots(runs: DataFrame, edges: DataFrame, limit: int) -> DataFrame | None:
    """Smallest reachable id of every run that touches another.

    Frames up to ``limit`` runs are solved where their contacts meet, all frames in parallel; the
    contacts of a larger frame stay spread over the cluster and are contracted together.
    """
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    solve = lambda e: place(e, *FRAME).sortWithinPartitions(*FRAME).mapInArrow(_solve_frames, f"scene {kinds['scene']}, frame {kinds['frame']}, a bigint, p bigint")
    hot = hot_groups(runs, FRAME, limit)
    if hot is None:
        return solve(edges)
    wide = _contract(edges.join(hot, FRAME, "left_semi").union(
        edges.join(hot, FRAME, "left_semi").select(*FRAME, F.col("b").alias("a"), F.col("a").alias("b"))))
    small = solve(edges.join(hot, FRAME, "left_anti"))
    return small if wide is None else small.union(wide.select(*FRAME, "a", "p"))


def _contract(edges: DataFrame) -> DataFrame | None:
    """Smallest reachable id of every id in ``edges``, by contraction.

    In a round every cluster points at its smallest neighbour, pointers are followed four steps,
    and the edges are rewritten between the clusters reached. Long chains shrink at least fourfold
    per round, and a large region is only ever an aggregation key, never a gathered group.
    """
    maps = []
    edges = materialize(edges)
    on = [*FRAME]
    while edges.take(1):
        up = materialize(edges.groupBy(*on, "a").agg(F.min("b").alias("p")).withColumn("p", F.least("a", "p")))
        for _ in range(2):
            step = up.select(*on, F.col("a").alias("p"), F.col("p").alias("q"))
            up = materialize(up.join(step, [*on, "p"]).select(*on, "a", F.col("q").alias("p")))
        maps.append(up)
        to = lambda name: up.select(*on, F.col("a").alias(name), F.col("p").alias(f"p{name}"))
        moved = edges.join(to("a"), [*on, "a"]).join(to("b"), [*on, "b"]).select(*on, F.col("pa").alias("a"), F.col("pb").alias("b"))
        # a pointer target that itself points on keeps its link
        chain = up.select(*on, F.col("p").alias("a")).distinct().join(up.select(*on, "a", F.col("p").alias("b")), [*on, "a"])
        both = moved.union(chain).union(chain.select(*on, F.col("b").alias("a"), F.col("a").alias("b")))
        edges = materialize(both.where("a <> b").distinct())
    if not maps:
        return None
    whole = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = whole.select(*on, F.col("a").alias("p"), F.col("p").alias("q"))
        whole = earlier.join(later, [*on, "p"], "left").select(*on, "a", F.coalesce("q", "p").alias("p"))
    return whole


def label_regions(pixels: DataFrame, mask, connectivity: int = 8, name: str = "region_id",
                  frame_runs: int = 2_000_000) -> DataFrame:
    """Adds the region of each pixel: 1 + raster index of the region's first pixel, 0 outside.

    Pixels become row runs first; only runs and their contacts take part in the search.
    """
    d = _with_run_start(pixels, col(mask).cast("boolean"))
    rid = F.col("y").cast("long") * _ROW + F.col("_x0")
    runs = materialize(d.where("_on").groupBy(*FRAME, "y", "_x0").agg(F.max("x").alias("x1"))
                       .select(*FRAME, "y", F.col("_x0").alias("x0"), "x1", rid.alias("rid")))
    roots = _roots(runs, _touching(runs, 1 if connectivity == 8 else 0), frame_runs)
    keyed = runs.select(*FRAME, "y", F.col("x0").alias("_x0"), "rid")
    if roots is None:
        labels = keyed.withColumn("_root", F.col("rid"))
    else:
        labels = (keyed.join(roots.select(*FRAME, F.col("a").alias("rid"), "p"), [*FRAME, "rid"], "left")
                  .withColumn("_root", F.coalesce("p", "rid")))
    labels = labels.select(*FRAME, "y", "_x0", "_root")
    first = F.floor(F.col("_root") / _ROW) * F.col("w") + F.col("_root") % _ROW + 1
    return (d.join(labels, [*FRAME, "y", "_x0"], "left")
            .withColumn(name, F.coalesce(first, F.lit(0)).cast("long")).drop("_on", "_x0", "_root"))


def keep_seeded(labelled: DataFrame, seed, region: str = "region_id", name: str = "retained") -> DataFrame:
    """Marks pixels of regions that hold at least one seed."""
    held = (labelled.where((F.col(region) > 0) & col(seed).cast("boolean")).select(*FRAME, region).distinct()
            .withColumn(name, F.lit(True)))
    return labelled.join(held, [*FRAME, region], "left").withColumn(name, F.coalesce(name, F.lit(False)))


# --- region consensus ----------------------------------------------------

def region_votes(labelled: DataFrame, weak=WEAK, strong=STRONG, region: str = "region_id") -> DataFrame:
    """Per region: sizes by state, mean drop, share of decreasing pixels."""
    drop = F.col("raw") - F.col("outp")
    state = classify("raw", weak, strong)
    return labelled.where(F.col(region) > 0).groupBy(*FRAME, region).agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(state == 1).alias("n_weak"), F.count_if(state == 2).alias("n_strong"),
        F.avg(drop).alias("mean_drop"), (F.count_if(drop > 0) / F.count(F.lit(1))).alias("decreasing"))


def region_consensus(pixels: DataFrame, keys=("scene",), weak=WEAK, strong=STRONG) -> DataFrame:
    """Share of source pixels in regions that improve as a whole, per level and state."""
    votes = region_votes(label_regions(pixels, F.col("raw") >= weak), weak, strong)
    parts, aggs = [], [F.sum(f"n_{s}").alias(f"n_{s}") for s in ("all", "weak", "strong")]
    for level, least in CONSENSUS.items():
        accepted = (F.col("mean_drop") > 0) & (F.col("decreasing") > least)
        aggs += [F.sum(F.when(accepted, F.col(f"n_{s}")).otherwise(0)).alias(f"{level}_{s}") for s in ("all", "weak", "strong")]
        parts.append(F.struct(F.lit(level).alias("level"), *[percentage(f"{level}_{s}", f"n_{s}").alias(f"{s}_percent") for s in ("all", "weak", "strong")]))
    return votes.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*parts)))


def with_consensus(rows: DataFrame, pixels: DataFrame, weak=WEAK, strong=STRONG) -> DataFrame:
    """Per-image ``rows`` with the share of each image's source pixels in accepted regions, a column per level.

    NULL for an image without source pixels, as for the other shares of the source.
    """
    levels = region_consensus(pixels, FRAME, weak, strong)
    wide = levels.groupBy(*FRAME).agg(*[F.max(F.when(F.col("level") == level, F.col("all_percent"))).alias(f"{level}_region_consensus_percent") for level in CONSENSUS])
    return rows.join(wide, list(FRAME), "left")


# --- geometry ------------------------------------------------------------

def filled_members(labelled: DataFrame, region: str = "region_id") -> DataFrame:
    """(region, pixel) rows of every region with its holes filled; ``own`` marks the region itself.

    Regions and 4-connected background areas form a tree: the pixel left of a component's first
    pixel belongs to the component around it. Everything below a region fills its holes.
    """
    base = labelled.select(*FRAME, "y", "x", "h", "w", region)
    ground = label_regions(base, F.col(region) == 0, 4, "_bg")
    # one signed component per pixel: regions positive, background negative
    comp = materialize(ground.select(*FRAME, "y", "x", "w", F.when(F.col(region) > 0, F.col(region)).otherwise(-F.col("_bg")).alias("comp")))
    first = comp.select(*FRAME, "comp", "w").distinct().withColumn("_i", F.abs("comp") - 1)
    first = first.select(*FRAME, "comp", F.floor(F.col("_i") / F.col("w")).cast("int").alias("y"), (F.col("_i") % F.col("w") - 1).cast("int").alias("x"))
    parent = (first.join(comp.select(*FRAME, "y", "x", F.col("comp").alias("outer")), [*FRAME, "y", "x"])
              .select(*FRAME, "comp", "outer"))
    # only background not touching the frame border can be a hole; a border area has no parent region
    size = labelled.select(*FRAME, "h", "w").distinct()
    edge = (comp.select(*FRAME, "comp", "y", "x").where("comp < 0").join(size, FRAME)
            .where("y = 0 or x = 0 or y = h - 1 or x = w - 1").select(*FRAME, "comp").distinct())
    parent = materialize(parent.join(edge, [*FRAME, "comp"], "left_anti"))
    level, found = parent.where("outer <> 0"), []
    while level.take(1):
        found.append(level)
        up = parent.select(*FRAME, F.col("comp").alias("outer"), F.col("outer").alias("_next"))
        level = materialize(level.join(up, [*FRAME, "outer"]).select(*FRAME, "comp", F.col("_next").alias("outer")))
    own = comp.where("comp > 0").select(*FRAME, F.col("comp").alias(region), "y", "x", F.lit(True).alias("own"))
    if not found:
        return own
    inside = reduce(DataFrame.union, found).where("outer > 0").select(*FRAME, "comp", F.col("outer").alias(region))
    return own.union(comp.join(inside, [*FRAME, "comp"]).select(*FRAME, region, "y", "x", F.lit(False).alias("own")))


def contour_measures(members: DataFrame, region: str = "region_id") -> DataFrame:
    """Area and length of the outer contour through pixel centres, from 2 x 2 blocks.

    Each member pixel reports to the four blocks it is a corner of. A full block covers one
    unit of area, a three-pixel block half a unit and a diagonal of the contour; every side of a
    4-adjacent pair that no such block covers is one unit of contour, and two diagonal pixels
    alone are linked forth and back.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(1 << (2 * -dy - dx)).alias("bit"))
                                 for dy in (-1, 0) for dx in (-1, 0)])).alias("c")
    # bit 0: top left, 1: top right, 2: bottom left, 3: bottom right
    blocks = (members.select(*FRAME, region, "y", "x", corner)
              .groupBy(*FRAME, region, (F.col("y") + F.col("c.dy")).alias("by"), (F.col("x") + F.col("c.dx")).alias("bx"))
              .agg(F.sum("c.bit").alias("m")))
    m = F.col("m")
    pixels = F.bit_count(m)
    pair = pixels == 2
    diagonal = pair & m.isin(6, 9)
    # an adjacent pair alone in its block leaves this side open
    length = (F.when(pixels == 3, F.sqrt(F.lit(2.0))).when(diagonal, 2 * F.sqrt(F.lit(2.0))).when(pair, 1.0).otherwise(0.0))
    area = F.when(pixels == 4, 1.0).when(pixels == 3, 0.5).otherwise(0.0)
    return blocks.groupBy(*FRAME, region).agg(F.sum(area).alias("contour_area"), F.sum(length).alias("perimeter"))


def effective_width(area, perimeter, occupied: bool) -> Column:
    """4A/P, plus one occupied pixel (never below one) in the support-aware form; 1 for no contour."""
    ratio = 4.0 * col(area) / col(perimeter)
    return F.when(col(perimeter) > 1e-6, F.greatest(ratio + 1.0, F.lit(1.0)) if occupied else ratio).otherwise(1.0)


def region_geometry(labelled: DataFrame, region: str = "region_id", quantiles=None, members: DataFrame | None = None) -> DataFrame:
    """Area, box, aspect, contour measures and named quantiles (``name -> (column, p)``) of each region."""
    own = labelled.where(F.col(region) > 0)
    rows = own.groupBy(*FRAME, region).agg(
        F.count(F.lit(1)).alias("area_px"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"),
        # a region lies inside one frame, whose size the sensor bounds
        *[F.percentile(value, p).alias(name) for name, (value, p) in (quantiles or {}).items()])
    tall, wide = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    rows = rows.withColumn("aspect", F.greatest(tall, wide) / F.least(tall, wide))
    shape = contour_measures(filled_members(labelled, region) if members is None else members, region)
    rows = rows.join(shape, [*FRAME, region]).withColumns({
        "width": effective_width("contour_area", "perimeter", False), "width_occupied": effective_width("contour_area", "perimeter", True)})
    return rows


def region_gain(scale, override, small_gain: float, large_gain: float) -> Column:
    """Gain between the small and the large value by scale, raised to the large one by evidence."""
    gain = small_gain + (large_gain - small_gain) * col(scale)
    return gain + (large_gain - gain) * col(override)


def evidence_override(value) -> Column:
    return smoothstep(0.08, 0.35, value)
