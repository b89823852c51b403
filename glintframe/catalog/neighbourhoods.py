"""Stencils, structure, resampling and the exposure-aligned removed light."""

from pyspark.sql import functions as F

from glintframe.catalog import duckstencil as D
from glintframe.catalog.base import duck, grid, query, r6, rounded, paired_rgb, table
from glintframe.catalog.trajectories import _TRK, _tracks, affine_sql
from glintframe.functions.scalar import lum601
from glintframe.operators import stencil as W, structure as ST, tracks as T
from glintframe.session import place

PIX = "scene, frame, y::bigint y, x::bigint x"
KEY = ["scene", "frame", "y", "x"]
show = lambda src, *cols: f"select {PIX}, {', '.join(f'{r6(c)} {c}' for c in cols)} from {src}"


@query("box_means", "W1", duck("grid", show("c", "m3", "m15", "e9"), *D.box("a", "grid", {"m3": "raw"}, 3), *D.box("b", "a", {"m15": "outp"}, 15), *D.box("c", "b", {"e9": "raw"}, 9, "edge")))
def box_means(spark, sf):
    d = W.colocate(grid(spark, sf))
    d = W.box_mean(W.box_mean(W.box_mean(d, {"m3": "raw"}, 3), {"m15": "outp"}, 15), {"e9": "raw"}, 9, "edge")
    return rounded(d.select(*KEY, "m3", "m15", "e9"))


@query("guided_bases", "W2 W2b", duck("grid", show("b", "base", "filtered"), *D.guided("a", "grid", "raw", "raw", 7, 0.01, "base", "reflect"), *D.guided("b", "a", "raw", "outp", 3, 0.006, "filtered")))
def guided_bases(spark, sf):
    d = W.guided_base(W.colocate(grid(spark, sf)), "raw")
    return rounded(W.guided_filter(d, "raw", "outp", 3, 0.006).select(*KEY, "base", "filtered"))


@query("gradients", "W3 W4", duck("grid", show("b", "gx", "gy", "sx", "sy", "sm"), *D.gradient("a", "grid", "raw"), *D.sobel("b", "a", "raw", "sx", "sy", "sm")))
def gradients(spark, sf):
    d = W.gradient(W.colocate(grid(spark, sf)), "raw")
    d = W.sobel(d, "raw", "sx", "sy", "sm")
    return rounded(d.select(*KEY, "gx", "gy", "sx", "sy", "sm"))


@query("blurs", "W5", duck("grid", show("(select *, raw-b2 hp from b)", "b1", "hp"), *D.blur("a", "grid", {"b1": "raw"}, 1.25), *D.blur("b", "a", {"b2": "raw"}, 2.0, "reflect101")))
def blurs(spark, sf):
    d = W.gaussian_blur(W.colocate(grid(spark, sf)), {"b1": "raw"}, 1.25)
    return rounded(W.highpass(d, {"hp": "raw"}).select(*KEY, "b1", "hp"))


@query("local_stds", "W6", duck("grid", f"select {PIX}, {r6('sqrt(greatest(e2-e1*e1,0))')} local_std from a", *D.box("a", "grid", {"e1": "raw", "e2": "raw*raw"}, 9, "edge")))
def local_stds(spark, sf):
    return rounded(W.local_std(W.colocate(grid(spark, sf)), "raw").select(*KEY, "local_std"))


@query("structure_penalties", "W7 W8 J9", duck("grid", f"select {PIX}, {r6('base')} base, {r6('pos_')} positive, {r6('coh')} coherence, {r6('edge_')} edge, {r6('structure')} structure from st", *D.structure("st", "grid", "raw")))
def structure_penalties(spark, sf):
    d = ST.structure_penalty(grid(spark, sf), "raw", keep_cues=True)
    return rounded(d.select(*KEY, "base", "positive", "coherence", "edge", "structure"))


@query("morphology", "W9", duck("grid", f"select {PIX}, dil::bigint dil, ero::bigint ero, opened::bigint opened, closed::bigint closed, {r6('gd')} gd from f",
    ("m", "select *, (raw>=0.1::double)::int core from grid"), *D.plus("a", "m", "core", "dil", "max"), *D.plus("b", "a", "core", "ero", "min"),
    *D.plus("c", "b", "ero", "opened", "max"), *D.plus("e", "c", "dil", "closed", "min"), *D.plus("f", "e", "raw", "gd", "max")))
def morphology(spark, sf):
    d = W.colocate(grid(spark, sf)).withColumn("core", (F.col("raw") >= 0.1).cast("int"))
    d = W.erode(W.dilate(d, "core", "dil"), "core", "ero")
    d = W.morph_close(W.morph_open(d, "core", "opened"), "core", "closed")
    return rounded(W.dilate(d, "raw", "gd").select(*KEY, "dil", "ero", "opened", "closed", "gd"))


@query("resampling", "P23", duck("grid", show("u", "lin", "near"), *D.down("s", "(select *, raw lin, outp near from grid)", 2, ["lin", "near"]), *D.up("u", "grid", "s", 2, ["lin"], ["near"])))
def resampling(spark, sf):
    g = grid(spark, sf)
    s = W.downsample_area(g.withColumnsRenamed({"raw": "lin", "outp": "near"}), 2, ["lin", "near"])
    return rounded(W.upsample(g, s, 2, ["lin"], ["near"]).select(*KEY, "lin", "near"))


_ODD = ("select *, sqrt((frame*37+y*101+x*53+bal)%97)/10 v from (select s_nationkey::bigint scene, s_suppkey frame, floor(abs(s_acctbal))::bigint bal, "
        "9+s_suppkey%7 h, 10+s_suppkey%11 w, unnest(range(9+s_suppkey%7)) y from supplier) s, range(21) r(x) where x < w")


def odd_frames(spark, sf):
    """Frames of many sizes, from 9 x 10 to 15 x 20 pixels, with values from the supplier rows."""
    # a few bytes a frame become hundreds of pixels: the rows are spread before that
    s, k = place(table(spark, sf, "supplier"), "s_suppkey"), F.col("s_suppkey")
    d = (s.select(F.col("s_nationkey").cast("long").alias("scene"), k.alias("frame"), F.floor(F.abs("s_acctbal")).alias("_bal"), (9 + k % 7).cast("int").alias("h"), (10 + k % 11).cast("int").alias("w"))
         .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1))))
    return d.withColumn("v", F.sqrt((F.col("frame") * 37 + F.col("y") * 101 + F.col("x") * 53 + F.col("_bal")) % 97) / 10).drop("_bal")


def _mixed_sizes(factor):
    """Overlap of every pixel with every cell, and bilinear and nearest values by their positions."""
    cells = lambda n: f"greatest({n}//{factor},1)"
    over = lambda p, n: f"greatest(0::double, least((f.{p}+1)*{cells(n)}, (c.{p}+1)*{n})-greatest(f.{p}*{cells(n)}, c.{p}*{n}))"
    at = lambda p, n: f"(({p}+0.5::double)*{cells(n)}/{n}-0.5::double)"
    low = lambda p, n: f"greatest(0, floor({at(p, n)}))::int"
    high = lambda p, n: f"least({cells(n)}-1, floor({at(p, n)})+1)::int"
    part = lambda p, n: f"greatest(0, {at(p, n)}-{low(p, n)})"
    grid = f"select distinct scene, frame, h, w, yy::bigint y, xx::bigint x from f, range(8) a(yy), range(8) b(xx) where yy < {cells('h')} and xx < {cells('w')}"
    small = f"select c.scene, c.frame, c.y, c.x, sum(f.v*{over('y', 'c.h')}*{over('x', 'c.w')})/sum({over('y', 'c.h')}*{over('x', 'c.w')}) v from c join f using (scene, frame) group by all"
    join = lambda name, y, x: f"join small {name} on {name}.scene=f.scene and {name}.frame=f.frame and {name}.y={y} and {name}.x={x}"
    qualify = lambda e: e.replace("h//", "f.h//").replace("w//", "f.w//").replace("/h-", "/f.h-").replace("/w-", "/f.w-").replace("(y+", "(f.y+").replace("(x+", "(f.x+")
    ly, hy, lx, hx, py, px = (qualify(e) for e in (low("y", "h"), high("y", "h"), low("x", "w"), high("x", "w"), part("y", "h"), part("x", "w")))
    final = (f"select f.scene, f.frame, f.y::bigint y, f.x::bigint x, {r6(f'(a.v*(1-{px})+b.v*{px})*(1-{py})+(c.v*(1-{px})+d.v*{px})*{py}')} lin, {r6('e.v')} near "
             f"from f {join('a', ly, lx)} {join('b', ly, hx)} {join('c', hy, lx)} {join('d', hy, hx)} "
             f"{join('e', f'(f.y*greatest(f.h//{factor},1))//f.h', f'(f.x*greatest(f.w//{factor},1))//f.w')}")
    return f"with f as materialized ({_ODD}), c as materialized ({grid}), small as materialized ({small}) {final}"


@query("mixed_resampling", "P23", _mixed_sizes(4))
def mixed_resampling(spark, sf):
    """Area means and both ways back on frames whose sides the factor does not divide: every pixel returns."""
    f = odd_frames(spark, sf)
    small = W.downsample_area(f, 4, ["v"])
    back = W.upsample(f, small.select("scene", "frame", "y", "x", F.col("v").alias("lin"), F.col("v").alias("near")), 4, ["lin"], ["near"])
    return rounded(back.select(*KEY, "lin", "near"))


_RL = [("p", "select *, 0.299::double*r+0.587::double*g+0.114::double*b lum, 0.299::double*sr+0.587::double*sg+0.114::double*sb after_, frame fk from paired_rgb"),
       ("xy", "select frame, after_ x, lum y from p"), *affine_sql("xy", "frame", 20),
       ("al", "select p.*, greatest(lum-greatest(0,least(1,gain*after_+off)),0) rm from p join fit using (frame)")]


@query("removed_light", "A29 A30 W23", duck("paired_rgb", show("z", "removed"), *_RL, *D.box("bx", "al", {"bm": "rm"}, 31), *D.normalized("z", "bx", {"removed": ("greatest(bm-0.01::double,0)", 0.99)})))
def removed_light(spark, sf):
    d = paired_rgb(spark, sf).withColumns({"lum": lum601("r", "g", "b"), "lum_after": lum601("sr", "sg", "sb")})
    return rounded(ST.removed_light(d, min_samples=20).select(*KEY, "removed"))


@query("multiscale_samples", "J8", duck("tracks grid", f"select scene, frame, point_id, {r6('0.35::double*fine+0.65::double*broad')} lum from trk t join b g using (frame) where point_id>=0 and g.y=t.py and g.x=t.px", _TRK,
    *D.box("a", "grid", {"fine": "raw"}, 3), *D.box("b", "a", {"broad": "raw"}, 7)))
def multiscale_samples(spark, sf):
    d = W.box_mean(W.box_mean(W.colocate(grid(spark, sf)), {"fine": "raw"}, 3), {"broad": "raw"}, 7)
    s = T.sample_at(_tracks(spark, sf).where("point_id >= 0"), d, ["scene", "fine", "broad"], F.lit(10), F.lit(10))
    return rounded(s.select("scene", "frame", "point_id", (0.35 * F.col("fine") + 0.65 * F.col("broad")).alias("lum")))


@query("edge_shares", "A38 W3", duck("grid", f"select {PIX}, {r6('case when q>1e-8::double then greatest(0,least(1,m/q)) else 0 end')} edge from (select *, quantile_cont(m,0.95) over (partition by scene, frame) q from (select *, sqrt(gx*gx+gy*gy) m from b))",
    *D.box("a", "grid", {"sm": "raw"}, 3), *D.gradient("b", "a", "sm")))
def edge_shares(spark, sf):
    d = W.gradient(W.box_mean(W.colocate(grid(spark, sf)), {"sm": "raw"}, 3), "sm")
    return rounded(T.edge_share(d.withColumn("gradient", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2))).select(*KEY, "edge"))
