"""Connected regions, their geometry and consensus."""

from pyspark.sql import functions as F

from glintframe.catalog.base import duck, grid, query, r6, rounded
from glintframe.catalog.scores import _per_image_sql
from glintframe.operators import regions as R, suppression as SU

PIX = "scene, frame, y::bigint y, x::bigint x"
KEY = ["scene", "frame", "y", "x"]


def flood(out, src, mask, n=8, steps=44, plus=False):
    """Smallest raster index reachable inside the mask: 3 x 3 (or plus-shaped) minima, repeated."""
    row = "min(lab) over (partition by scene,frame,y order by x rows between 1 preceding and 1 following)"
    column = lambda v: f"min({v}) over (partition by scene,frame,x order by y rows between 1 preceding and 1 following)"
    nb = f"least({row},{column('lab')})" if plus else "cm"
    inner = f"select *, {nb} nb from {out}_l where i<{steps}" if plus else f"select *, {column('rm')} nb from (select *, {row} rm from {out}_l where i<{steps})"
    return [(f"{out}_l", f"select 0 i, scene, frame, y, x, case when {mask} then y*{n}+x+1 end lab, {mask} msk from {src} union all select i+1, scene, frame, y, x, case when msk then nb end, msk from ({inner})"),
            (out, f"select scene, frame, y, x, coalesce(lab,0) region from {out}_l where i={steps}")]


@query("region_labels", "W12 J15", duck("grid", f"select {PIX}, region::bigint region_id from lab", *flood("lab", "grid", "raw>=0.075::double"), recursive=True))
def region_labels(spark, sf):
    return rounded(R.label_regions(grid(spark, sf), F.col("raw") >= 0.075).select(*KEY, "region_id"))


@query("seeded_regions", "W13", duck("grid", f"select {PIX}, region>0 and s retained from (select l.*, bool_or(g.raw>=0.3::double) over (partition by scene, frame, region) s from lab l join grid g using (scene, frame, y, x))",
    *flood("lab", "grid", "raw>=0.1::double"), recursive=True))
def seeded_regions(spark, sf):
    d = R.label_regions(grid(spark, sf), F.col("raw") >= 0.1)
    return rounded(R.keep_seeded(d, F.col("raw") >= 0.3).select(*KEY, "retained"))


_pct = lambda c, cond: r6(f"100*coalesce(sum({c}) filter (where {cond}),0)/nullif(sum({c}),0)")


@query("region_consensus", "A7", duck("grid", " union all ".join(
    f"select scene, '{lv}' as level, {_pct('n', c)} all_percent, {_pct('nw', c)} weak_percent, {_pct('ns', c)} strong_percent from v group by scene"
    for lv, c in (("simple_majority", "md>0 and df>0.5::double"), ("robust_majority", "md>0 and df>0.55::double"))),
    *flood("lab", "grid", "raw>=0.075::double"),
    ("v", "select scene, frame, region, count(*) n, count(*) filter (where raw<0.16::double) nw, count(*) filter (where raw>=0.16::double) ns, avg(raw-outp) md, count(*) filter (where raw-outp>0)/count(*) df from lab join grid using (scene, frame, y, x) where region>0 group by all"), recursive=True))
def region_consensus(spark, sf):
    return rounded(R.region_consensus(grid(spark, sf)))


_CONS = lambda cond: r6(f"100*coalesce(sum(n) filter (where {cond}),0)/nullif(sum(n),0)")
_IMAGE, _IMAGE_STATES = _per_image_sql("grid", "scene, frame")


@query("per_image_consensus_rows", "A4 A7", duck("grid", f"""select i.*, simple_majority_region_consensus_percent, robust_majority_region_consensus_percent from ({_IMAGE}) i left join
    (select scene, frame, {_CONS('md>0 and df>0.5::double')} simple_majority_region_consensus_percent, {_CONS('md>0 and df>0.55::double')} robust_majority_region_consensus_percent from v group by all) c using (scene, frame)""",
    *flood("lab", "grid", "raw>=0.075::double"), _IMAGE_STATES,
    ("v", "select scene, frame, region, count(*) n, avg(raw-outp) md, count(*) filter (where raw-outp>0)/count(*) df from lab join grid using (scene, frame, y, x) where region>0 group by all"), recursive=True))
def per_image_consensus_rows(spark, sf):
    """The whole per-image row, with both levels of region consensus."""
    g = grid(spark, sf)
    return rounded(R.with_consensus(SU.per_image_rows(g), g))


def geometry_steps(lab, out="geo"):
    """Brute force: flood the outside of every region on a padded board, then count 2 x 2 blocks."""
    row = "max(o) over (partition by scene,frame,region,y order by x rows between 1 preceding and 1 following)"
    column = "max(o) over (partition by scene,frame,region,x order by y rows between 1 preceding and 1 following)"
    return [("rg", f"select distinct scene, frame, region from {lab} where region>0"),
            ("board", f"select rg.*, b.y, b.x, coalesce(l.region=rg.region,false) own from rg cross join (select a.range-1 y, b.range-1 x from range(10) a, range(10) b) b left join {lab} l on l.scene=rg.scene and l.frame=rg.frame and l.y=b.y and l.x=b.x"),
            ("ou", f"select 0 i, scene, frame, region, y, x, own, (y=-1 and x=-1)::int o from board union all select i+1, scene, frame, region, y, x, own, case when own then 0 else greatest({row},{column}) end from ou where i<60"),
            ("fil", "select scene, frame, region, y, x, (1-o) f from ou where i=60"),
            ("blk", "select a.scene, a.frame, a.region, a.f tl, b.f tr, c.f bl, d.f br from fil a join fil b on b.scene=a.scene and b.frame=a.frame and b.region=a.region and b.y=a.y and b.x=a.x+1 "
                    "join fil c on c.scene=a.scene and c.frame=a.frame and c.region=a.region and c.y=a.y+1 and c.x=a.x join fil d on d.scene=a.scene and d.frame=a.frame and d.region=a.region and d.y=a.y+1 and d.x=a.x+1"),
            (out, "select scene, frame, region, sum(case n when 4 then 1 when 3 then 0.5 else 0 end)::double ca, sum(case when n=3 then sqrt(2) when n=2 and tl=br then 2*sqrt(2) when n=2 then 1 else 0 end)::double pe from (select *, tl+tr+bl+br n from blk) group by all")]


@query("region_geometry", "A35", duck("grid", f"""select scene, frame, region::bigint region_id, area_px::bigint area_px, y0::bigint y0, y1::bigint y1, x0::bigint x0, x1::bigint x1,
    {r6('greatest(y1-y0+1,x1-x0+1)/least(y1-y0+1,x1-x0+1)')} aspect, {r6('ca')} contour_area, {r6('pe')} perimeter, {r6('case when pe>1e-6::double then 4*ca/pe else 1 end')} width,
    {r6('case when pe>1e-6::double then greatest(4*ca/pe+1,1) else 1 end')} width_occupied, {r6('p70')} p70, {r6('p85')} p85 from
    (select scene, frame, region, count(*) area_px, min(y) y0, max(y) y1, min(x) x0, max(x) x1, quantile_cont(raw,0.7) p70, quantile_cont(outp,0.85) p85 from lab join grid using (scene, frame, y, x) where region>0 group by all) join geo using (scene, frame, region)""",
    *flood("lab", "grid", "raw>=0.1::double"), *geometry_steps("lab"), recursive=True))
def region_geometry(spark, sf):
    d = R.label_regions(grid(spark, sf), F.col("raw") >= 0.1)
    return rounded(R.region_geometry(d, quantiles={"p70": ("raw", 0.70), "p85": ("outp", 0.85)}))
