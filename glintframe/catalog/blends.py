"""Blending strategies and the steps they are made of."""

from pyspark.sql import functions as F

from glintframe.catalog import duckstencil as D
from glintframe.catalog.areas import flood, geometry_steps
from glintframe.catalog.base import blend_inputs, duck, query, r6, rounded
from glintframe.catalog.scores import BOOST, _COMP, _INV, clip, lab_of, lab_steps, smooth, zfs
from glintframe.operators import blend as B, matte as M

KEY = ["scene", "frame", "y", "x"]
PIX = "scene, frame, y::bigint y, x::bigint x"
SIDE, FACTOR = 8, 2
_OUT = ["or", "og", "ob"]


def _mix_sql(w, name=""):
    return ", ".join(f"{r6(clip(f'({w})*s{c}+(1-({w}))*{c}'))} \"o{c}{name}\"" for c in "rgb")


@query("simple_blends", "P11 F1", duck("blend_inputs", f"select {PIX}, {_mix_sql('1/(1+exp(-8*(score-0.3::double)))', '_soft')}, {_mix_sql('(score>=0.3::double)::int', '_hard')}, {_mix_sql('1', '_only')} from blend_inputs"))
def simple_blends(spark, sf):
    d = blend_inputs(spark, sf)
    for name, mode in (("soft", "soft"), ("hard", "hard"), ("only", "removed_only")):
        d = B.blend(d, mode).withColumnsRenamed({o: f"{o}_{name}" for o in _OUT})
    return rounded(d.select(*KEY, *[f"{o}_{n}" for n in ("soft", "hard", "only") for o in _OUT]))


def compose_sql(src, out="res", n=8):
    """The CIELAB recomposition; ``src`` has base_weight, detail_weight, chroma_weight."""
    keep = "scene,frame,y,x,base_weight,detail_weight,chroma_weight"
    t = [("k1", lab_steps("p", "r", "g", "b", src, keep + ",sr,sg,sb")), ("k2", lab_steps("s", "sr", "sg", "sb", "k1", keep + ",px,py,pz")),
         ("k3", f"select {keep}, {lab_of('p')[0]} al, {lab_of('p')[1]} aa, {lab_of('p')[2]} ab, {lab_of('s')[0]} bl, {lab_of('s')[1]} ba, {lab_of('s')[2]} b2 from k2"),
         *D.blur("k4", "k3", {"abl": "al", "bbl": "bl"}, 0.5, "replicate", n),
         ("k5", f"select {keep}, greatest(0,least(100,(1-base_weight)*abl+base_weight*bbl+(1-detail_weight)*(al-abl)+detail_weight*(bl-bbl)))::double l, "
                "(1-chroma_weight)*aa+chroma_weight*ba a, (1-chroma_weight)*ab+chroma_weight*b2 bb from k4"),
         ("k6", f"""select *, 0.950456::double*{_INV('(fy+a/500)')} X_, 1.088754::double*{_INV('(fy-bb/200)')} Z_ from (select *,
     case when l<=0.008856::double*903.3::double then l/903.3::double else power((l+16)/116,3) end Y_,
     case when l<=0.008856::double*903.3::double then 7.787::double*(l/903.3::double)+16::double/116 else (l+16)/116 end fy from k5)"""),
         (out, f"""select scene, frame, y, x, {_COMP('3.240479::double*X_-1.537150::double*Y_-0.498535::double*Z_')} "or",
     {_COMP('-0.969256::double*X_+1.875991::double*Y_+0.041556::double*Z_')} og, {_COMP('0.055648::double*X_-0.204043::double*Y_+1.057311::double*Z_')} ob from k6""")]
    return t


@query("lab_recomposition", "P14 P13", duck("blend_inputs", f"select {PIX}, {r6(chr(34) + 'or' + chr(34))} \"or\", {r6('og')} og, {r6('ob')} ob from res",
    ("bw", f"select *, score base_weight, score*{clip('0.12::double+0.88::double*confidence')} detail_weight, score*{clip('0.55::double+0.45::double*confidence')} chroma_weight from blend_inputs"), *compose_sql("bw")))
def lab_recomposition(spark, sf):
    from glintframe.functions.scalar import chroma_fraction, detail_fraction
    d = blend_inputs(spark, sf)
    d = d.withColumns({"base_weight": F.col("score"), "detail_weight": F.col("score") * detail_fraction("confidence"),
                       "chroma_weight": F.col("score") * chroma_fraction("confidence")})
    return rounded(B.lab_recompose(d, SIDE).select(*KEY, *_OUT))


# --- evidence matte, step by step ----------------------------------------

_FULL = ("f0", "select scene,frame,y,x,pos,h,w,r,g,b,sr,sg,sb,score,cross_*(0.25::double+0.75::double*confidence) view_,greatest(cross_*(0.25::double+0.75::double*confidence),cross_support,removed_support) evidence,"
         "structure,0.299::double*r+0.587::double*g+0.114::double*b lum from blend_inputs")
_COARSE = [_FULL, *D.down("c0", "f0", 2, ["score", "view_", "evidence", "structure", "lum"])]
_SEEDS = [
    *_COARSE, *D.blur("c1", "c0", {"sctx": "score", "ectx": "evidence"}, 0.8, n=4), *D.blur("c2", "c1", {"tctx": "structure"}, 0.6, n=4),
    ("c3", f"""select *, {smooth(0.08, 0.30, 'ectx')} rescue, (sctx>=0.075::double and (score>=0.3::double or ectx>=0.18::double))::int cand,
      (score>=0.3::double or (score>=0.075::double and evidence>=0.3::double)) and ectx>=0.18::double alone,
      greatest({smooth(0.015, 0.12, 'sctx')},0.9::double*{smooth(0.03, 0.18, 'ectx')})*{clip(f"1-0.85::double*tctx*(1-{smooth(0.08, 0.30, 'ectx')})")} lk0 from c2"""),
    *D.plus("c4", "c3", "cand", "er", "min"), *D.plus("c5", "c4", "er", "op", "max"),
    ("c6", "select *, op=1 or alone fg from c5"),
    ("c7", "select *, (sctx<=0.012::double and ectx<=0.025::double) or (tctx>=0.9::double and ectx<0.18::double and not fg) bg from c6"),
    ("sd", f"select *, case when bg then 0 when fg then 1 else {clip('lk0')} end::double likelihood from c7"),
]


@query("matte_seeds", "W10", duck("blend_inputs", f"select {PIX}, fg, bg, {r6('likelihood')} likelihood, {r6('rescue')} rescue from sd", *_SEEDS))
def matte_seeds(spark, sf):
    _, coarse = M.coarse_evidence(blend_inputs(spark, sf), FACTOR)
    return rounded(M.matte_seeds(coarse, M.parameters()).select(*KEY, "fg", "bg", "likelihood", "rescue"))


_ld = lambda v, o, a, f="lead": f"{f}({v}) over (partition by scene,frame,{o} order by {a})"
_link = lambda o, a: f"coalesce(greatest(0.01::double,least(1,exp(-power(({_ld('gd', o, a)}-gd)/0.08::double,2))*(1-0.85::double*greatest(wall,{_ld('wall', o, a)})))) * ({_ld(a, o, a)} is not null)::int,0)"
_DIFF = [
    *D.blur("d1", "sd", {"gd": "lum"}, 1.0, n=4), ("d2", f"select *, {clip('tctx*(1-rescue)')} wall from d1"),
    ("d3", f"select *, case when {_ld('x', 'y', 'x')} is null then 0 else {_link('y', 'x')} end rgt, case when {_ld('y', 'x', 'y')} is null then 0 else {_link('x', 'y')} end dwn, "
           f"0.35::double+3*greatest({smooth(0.45, 0.95, 'likelihood')},{smooth(0.45, 0.95, '(1-likelihood)')},(fg or bg)::int) trust from d2"),
    ("d4", f"select *, coalesce({_ld('rgt', 'y', 'x', 'lag')},0) lft, coalesce({_ld('dwn', 'x', 'y', 'lag')},0) upp from d3"),
    ("rx", "select 0 i, scene, frame, y, x, likelihood lk, trust, rgt, dwn, lft, upp, fg or bg pin, likelihood m from d4 union all select i+1, scene, frame, y, x, lk, trust, rgt, dwn, lft, upp, pin, case when pin then lk else "
           "(trust*lk+1.5::double*(rgt*coalesce(mr,0)+lft*coalesce(ml,0)+dwn*coalesce(md,0)+upp*coalesce(mu,0)))/greatest(trust+1.5::double*(rgt+lft+dwn+upp),1e-6::double) end from "
           f"(select *, {_ld('m', 'y', 'x')} mr, {_ld('m', 'y', 'x', 'lag')} ml, {_ld('m', 'x', 'y')} md, {_ld('m', 'x', 'y', 'lag')} mu from rx where i<24)"),
    ("so", "select d4.* exclude (rgt,dwn,lft,upp,trust,wall,gd), greatest(0,least(1,rx.m)) matte from d4 join rx using (scene, frame, y, x) where rx.i=24"),
]


@query("matte_diffusion", "W11", duck("blend_inputs", f"select {PIX}, {r6('matte')} matte from so", *_SEEDS, *_DIFF, recursive=True))
def matte_diffusion(spark, sf):
    _, coarse = M.coarse_evidence(blend_inputs(spark, sf), FACTOR)
    p = M.parameters()
    return rounded(M.matte_diffuse(M.matte_seeds(coarse, p), p, band_rows=3).select(*KEY, "matte"))


def pieces_sql(src, mask, owner, out):
    """Contour sums per owner from the pieces of a mask on the 8 x 8 grid."""
    return [*flood("pl", src, mask, 8), *geometry_steps("pl", "pg"),
            ("pw", f"select distinct p.scene, p.frame, p.region, {owner} ow from pl p join {src} s using (scene, frame, y, x) where p.region>0"),
            ("px_", "select distinct f.scene, f.frame, p.region from fil f join pw a on a.scene=f.scene and a.frame=f.frame and a.region=f.region join pl p on p.scene=f.scene and p.frame=f.frame and p.y=f.y and p.x=f.x "
                    "join pw b on b.scene=p.scene and b.frame=p.frame and b.region=p.region where f.f=1 and p.region<>f.region and p.region>0 and a.ow=b.ow"),
            (out, "select scene, frame, ow, sum(ca) ca, sum(pe) pe from pg join pw using (scene, frame, region) anti join px_ using (scene, frame, region) group by all")]


_ELL = [(dy, M._ellipse(FACTOR)[dy]) for dy in range(-FACTOR, FACTOR + 1)]
_OFFS = ", ".join(f"({dy},{dx})" for dy, r in _ELL for dx in range(-r, r + 1))
_GAIN = [
    *flood("rl", "so", "matte>=0.02::double", 4, 20),
    ("g1", "select so.* exclude (matte), rl.region, coalesce(bool_or(so.fg) over (partition by scene, frame, rl.region),false) and rl.region>0 kept, so.matte m0 from so join rl using (scene, frame, y, x)"),
    ("g2", f"select * exclude (m0), case when kept then m0 else 0 end matte, {BOOST('score', 0.12)} boosted from g1"),
    ("g3", "select scene, frame, region, count(*) filter (where matte>=0.5::double) ns, quantile_cont(evidence,0.85) e85, quantile_cont(view_,0.85) v85, quantile_cont(case when matte>=0.5::double then boosted end,0.7) asure, quantile_cont(boosted,0.7) aall from g2 where kept group by 1,2,3"),
    ("g4", "select g2.scene, g2.frame, y, x, region from g2 join g3 using (scene, frame, region) where kept and (matte>=0.5::double or ns<2)"),
    ("n1", f"select f.scene, f.frame, f.y, f.x, f.score, f.evidence, coalesce(g4.region,0) reg, {smooth(0.015, 0.12, 'f.score')}>=0.5::double or {smooth(0.03, 0.18, 'f.evidence')}>=0.5::double sup from f0 f left join g4 on g4.scene=f.scene and g4.frame=f.frame and g4.y=f.y//2 and g4.x=f.x//2"),
    ("n2", f"select n.scene, n.frame, n.y, n.x, count(*)={len(_OFFS.split('), ('))} solid from n1 n cross join (values {_OFFS}) o(dy,dx) join n1 q on q.scene=n.scene and q.frame=n.frame and q.y=n.y+dy and q.x=n.x+dx and q.reg>0 where n.reg>0 group by all"),
    ("n3", "select n1.*, reg>0 and (sup or coalesce(solid,false)) kp from n1 left join n2 using (scene, frame, y, x)"),
    ("n4", "select *, reg>0 and (kp or not bool_or(kp) over (partition by scene, frame, reg)) geo from n3"),
    *pieces_sql("n4", "geo", "s.reg", "wd"),
    ("g5", f"select scene, frame, region, {smooth(2, 10, 'wi')} sc, {smooth(0.08, 0.35, 'e85')} eo, {smooth(0.08, 0.35, 'v85')} vl, case when ns>=2 then asure else aall end alpha from "
           "(select g3.*, case when pe>1e-6::double then greatest(4*ca/pe+1,1) else 1 end*3072/8 wi from g3 join wd on wd.scene=g3.scene and wd.frame=g3.frame and wd.ow=g3.region)"),
    ("g6", "select *, 0.45::double+0.65::double*sc + (1.1::double-(0.45::double+0.65::double*sc))*eo gain from g5"),
    ("gn", f"""select g2.*, case when kept then {clip('matte*gain*((1-sc)*alpha+sc*(0.65::double*alpha+0.35::double*boosted))')} else 0 end regularized, case when kept then sc*matte else 0 end size_scale,
      case when kept then gain*matte else 0 end size_gain, case when kept then greatest({smooth(0.08, 0.35, 'view_')},matte*vl) else {smooth(0.08, 0.35, 'view_')} end source_override from g2 left join g6 using (scene, frame, region)"""),
]


@query("matte_gain", "W14 W13 A35", duck("blend_inputs", f"select {PIX}, {r6('matte')} matte, {r6('regularized')} regularized, {r6('size_scale')} size_scale, {r6('size_gain')} size_gain, {r6('source_override')} source_override from gn", *_SEEDS, *_DIFF, *_GAIN, recursive=True))
def matte_gain(spark, sf):
    full, coarse = M.coarse_evidence(blend_inputs(spark, sf), FACTOR)
    p = M.parameters()
    d = M.matte_gain(M.matte_diffuse(M.matte_seeds(coarse, p), p), full, FACTOR, p)
    return rounded(d.select(*KEY, "matte", "regularized", "size_scale", "size_gain", "source_override"))


_FINAL = [
    ("w0", f"select *, {clip('structure*(1-evidence)')} ep, source_override so_, regularized rg_, matte mt, likelihood lh, size_gain sg_ from gn"),
    *D.up("w1", "f0", "w0", 2, ["rg_", "so_", "ep", "mt", "lh", "sg_"]),
    *D.blur("w2", "w1", {"gu": "lum", "so2": "so_", "ep2": "ep"}, 0.75), *D.guided("w3", "w2", "gu", "rg_", 3, 0.006, "gw"),
    ("w4", f"select *, {clip('0.2::double+0.8::double*ep2')} mx from w3"), ("w5", f"select *, {clip(f'mx*{clip(chr(103) + chr(119))}+(1-mx)*rg_')} base_weight, {clip('so2')} ov from w4"),
    ("w6", f"select *, base_weight*{clip('0.12::double+0.88::double*ov')} detail_weight, base_weight*{clip('0.55::double+0.45::double*ov')} chroma_weight from w5"),
]


@query("evidence_matte_weights", "W18", duck("blend_inputs", f"select {PIX}, {r6('base_weight')} base_weight, {r6('detail_weight')} detail_weight, {r6('chroma_weight')} chroma_weight, {r6(clip('mt'))} matte, {r6(f'4*{clip(chr(109) + chr(116))}*(1-{clip(chr(109) + chr(116))})')} uncertainty, {r6(clip('sg_/1.1::double'))} size_gain from w6",
    *_SEEDS, *_DIFF, *_GAIN, *_FINAL, recursive=True))
def evidence_matte_weights(spark, sf):
    d = M.matte_weights(blend_inputs(spark, sf), factor=FACTOR, short_side=SIDE, diagnostics=True)
    return rounded(d.select(*KEY, "base_weight", "detail_weight", "chroma_weight", "matte", "uncertainty", "size_gain"))


@query("evidence_matte_blend", "W18 P14 F1 F2", duck("blend_inputs", f"select {PIX}, {r6(chr(34) + 'or' + chr(34))} \"or\", {r6('og')} og, {r6('ob')} ob from res", *_SEEDS, *_DIFF, *_GAIN, *_FINAL, *compose_sql("w6"), recursive=True))
def evidence_matte_blend(spark, sf):
    return rounded(B.blend(blend_inputs(spark, sf), "evidence_matte", short_side=SIDE, factor=FACTOR).select(*KEY, *_OUT))


# --- size-aware feathering -----------------------------------------------

_SIZE = [
    ("v0", "select scene,frame,y,x,pos,h,w,r,g,b,sr,sg,sb,score,cross_,confidence,0.299::double*r+0.587::double*g+0.114::double*b lum from blend_inputs"),
    *D.down("v1", "v0", 2, ["score", "cross_", "confidence"]),
    ("v2", f"select *, cross_*(0.25::double+0.75::double*confidence) view_, {zfs('score', 0.3)} alpha, (score>=0.3::double)::int core from v1"),
    *D.plus("v3", "v2", "core", "c1", "max"), *D.plus("v4", "v3", "c1", "c2", "min"), *D.plus("v5", "v4", "c2", "joined", "max"),
    *flood("vl", "v5", "joined=1", 4, 20), *geometry_steps("vl", "vg"),
    ("v6", "select scene, frame, region, count(*) n, greatest(max(y)-min(y)+1,max(x)-min(x)+1)/least(max(y)-min(y)+1,max(x)-min(x)+1) asp, quantile_cont(alpha,0.7) a70, quantile_cont(view_,0.85) v85 from vl join v5 using (scene, frame, y, x) where region>0 group by 1,2,3 having count(*)>=2"),
    ("v7", f"select *, {smooth(6, 12, 'wi')} sc, {smooth(0.08, 0.35, 'v85')} ov from (select v6.*, case when pe>1e-6::double then 4*ca/pe else 1 end wi from v6 join vg using (scene, frame, region))"),
    ("v8", "select *, 0.35::double+0.8::double*sc+(1.15::double-(0.35::double+0.8::double*sc))*ov gain from v7"),
    ("v9", "select f.scene, f.frame, f.y, f.x, max_by({'s':sc,'g':gain,'a':a70},(case when l.region=f.region then 1 else 0 end, f.region)) r, max(ov) o from fil f join vl l on l.scene=f.scene and l.frame=f.frame and l.y=f.y and l.x=f.x "
           "join v8 on v8.scene=f.scene and v8.frame=f.frame and v8.region=f.region where f.f=1 and (l.region=f.region or (sc<0.5::double and asp<=3)) group by all"),
    ("vr", f"select v5.*, case when r is not null then {clip('r.g*((1-r.s)*r.a+r.s*alpha)')} else alpha end reg, coalesce(r.s,0) size_scale, coalesce(r.g,0) size_gain, greatest({smooth(0.08, 0.35, 'view_')},coalesce(o,0)) view_override from v5 left join v9 using (scene, frame, y, x)"),
]


@query("size_regularized", "W14 W15", duck("blend_inputs", f"select {PIX}, {r6('reg')} regularized, {r6('size_scale')} size_scale, {r6('size_gain')} size_gain, {r6('view_override')} view_override from vr", *_SIZE, recursive=True))
def size_regularized(spark, sf):
    from glintframe.functions.scalar import view_evidence
    from glintframe.operators import feather as W
    from glintframe.operators.stencil import downsample_area
    coarse = downsample_area(blend_inputs(spark, sf), FACTOR, ["score", "cross", "confidence"]).withColumn("view", view_evidence("cross", "confidence"))
    return rounded(W.size_regularize(coarse, W.SIZE_DEFAULTS).select(*KEY, "regularized", "size_scale", "size_gain", "view_override"))


_SIZE_END = [
    *D.plus("vd", "vr", "reg", "grown", "max"), *D.blur("ve", "vd", {"rg_": "grown"}, 1.25, n=4), ("vf", "select *, view_override so_ from ve"),
    *D.up("vh", "v0", "vf", 2, ["rg_", "so_"]), *D.blur("vi", "vh", {"gu": "lum", "so2": "so_"}, 0.75), *D.guided("vj", "vi", "gu", "rg_", 3, 0.006, "gw"),
    ("vk", f"select *, {clip('gw')} base_weight, {clip('so2')} ov from vj"),
    ("vm", f"select *, base_weight*{clip('0.12::double+0.88::double*ov')} detail_weight, base_weight*{clip('0.55::double+0.45::double*ov')} chroma_weight from vk"),
]


@query("size_feather_weights", "W15", duck("blend_inputs", f"select {PIX}, {r6('base_weight')} base_weight, {r6('detail_weight')} detail_weight, {r6('chroma_weight')} chroma_weight from vm", *_SIZE, *_SIZE_END, recursive=True))
def size_feather_weights(spark, sf):
    from glintframe.operators.feather import feather_weights
    return rounded(feather_weights(blend_inputs(spark, sf), factor=FACTOR, short_side=SIDE).select(*KEY, "base_weight", "detail_weight", "chroma_weight"))


@query("size_feather_blend", "W15 P14 F1", duck("blend_inputs", f"select {PIX}, {r6(chr(34) + 'or' + chr(34))} \"or\", {r6('og')} og, {r6('ob')} ob from res", *_SIZE, *_SIZE_END, *compose_sql("vm"), recursive=True))
def size_feather_blend(spark, sf):
    return rounded(B.blend(blend_inputs(spark, sf), "adaptive_feather", short_side=SIDE, factor=FACTOR).select(*KEY, *_OUT))


def weak_sql(factor):
    """Weak regions and their settings on the grid ``factor`` times coarser."""
    n = 8 // factor
    return [
        ("e0", "select f0.*, (abs(r-sr)+abs(g-sg)+abs(b-sb))/3 change, 0.299::double*sr+0.587::double*sg+0.114::double*sb lum2 from f0"),
        *D.down("e1", "e0", factor, ["score", "view_", "evidence", "structure", "lum", "change"]),
        ("e2", f"select *, {zfs('score', 0.3)} alpha, {BOOST('score', 0.1)} boosted, (score>=0.075::double and evidence>=0.18::double) or score>=0.3::double seed, ((score>=0.075::double and evidence>=0.18::double) or score>=0.1::double)::int cand from e1"),
        *D.plus("e3", "e2", "cand", "c1", "max"), *D.plus("e4", "e3", "c1", "joined", "min"), *flood("el", "e4", "joined=1", n, 44 if n > 4 else 20),
        ("e5", "select e4.*, case when region>0 and bool_or(seed) over (partition by scene, frame, region) then region else 0 end region from e4 join el using (scene, frame, y, x)"),
        ("el2", "select scene, frame, y, x, region from e5"), *geometry_steps("el2", "eg"),
        ("e6", "select scene, frame, region, quantile_cont(evidence,0.85) e85, quantile_cont(view_,0.85) v85, quantile_cont(boosted,0.7) a70, quantile_cont(change,0.85) c85 from e5 where region>0 group by 1,2,3"),
        ("e7", f"select *, {smooth(6, 12, 'wi')} sc, {smooth(0.08, 0.35, 'e85')} eo, {smooth(0.08, 0.35, 'v85')} per, {smooth(0.03, 0.15, 'c85')} risk from (select e6.*, case when pe>1e-6::double then 4*ca/pe else 1 end wi from e6 join eg using (scene, frame, region))"),
        ("e8", "select *, 0.35::double+0.8::double*sc+(1.15::double-(0.35::double+0.8::double*sc))*eo gain, (0.5::double+2*sc)*(1+risk) sigma from e7"),
    ]


_PROFILE = [
    ("eb", "select e8.*, v, exp(-v*v/(2*sigma*sigma)) k from (select *, (((round_even(sigma*8+1,0)::int)|1)//2)::int rad from e8) e8 join (select range::int v from range(-22,23)) on abs(v)<=rad"),
    ("ew", "select scene, frame, region, d, greatest(0,least(3,d+v)) s, sum(k)/any_value(nk) wt from (select *, sum(k) over (partition by scene, frame, region) nk from eb) join (select range::int d from range(4)) on true group by all"),
    ("ep", f"select e5.scene, e5.frame, e5.region, wy.d y, wx.d x, sum(wy.wt*wx.wt) mem, sum(wy.wt*wx.wt*{clip('gain*((1-sc)*a70+sc*boosted)')}) num from e5 join e8 using (scene, frame, region) "
           "join ew wy on wy.scene=e5.scene and wy.frame=e5.frame and wy.region=e5.region and wy.s=e5.y join ew wx on wx.scene=e5.scene and wx.frame=e5.frame and wx.region=e5.region and wx.s=e5.x group by all"),
    ("eq", f"select ep.*, per, power({clip('mem')},1+risk*sc) fm, num*power({clip('mem')},risk*sc) inw from ep join e8 using (scene, frame, region)"),
    ("er", f"select e5.*, coalesce(t.own,0) own, coalesce(t.al,0) al, greatest({smooth(0.08, 0.35, 'view_')},coalesce(t.pv,0)) source_override from e5 left join (select a.scene, a.frame, a.y, a.x, sum(inw) filter (where q.region>=a.region) own, sum(inw) al, max(fm*per) pv "
           "from e5 a join eq q on q.scene=a.scene and q.frame=a.frame and q.y=a.y and q.x=a.x group by all) t using (scene, frame, y, x)"),
]


def weak_tail(support=None):
    """From coarse weights to the pixels; ``support`` relieves the transition guard."""
    relief = f"(1-{support})*" if support else ""
    return [
        *D.up("et", "e0", "es", 2, ["rg_", "so_", "ep_", *([support] if support else [])]), *D.blur("eu", "(select *, lum2-lum delta from et)", {"gu": "lum", "so2": "so_", "ep2": "ep_", "dl": "delta"}, 0.75),
        *D.guided("ev", "eu", "gu", "rg_", 3, 0.006, "gw"), *D.sobel("ex", "ev", "dl", "dgx", "dgy", "dgm"), *D.blur("ey", "ex", {"tg": smooth(0.005, 0.03, 'dgm/8')}, 1.5),
        ("ez", f"select *, {clip('0.2::double+0.8::double*ep2')} mx, {clip('so2')} ov from ey"),
        ("wk", f"select *, {clip(f'mx*{clip(chr(103) + chr(119))}+(1-mx)*rg_')}*(1-{relief}0.35::double*{clip('tg')}) base_weight from ez"),
        ("wf", f"select *, base_weight*{clip('0.12::double+0.88::double*ov')} detail_weight, base_weight*{clip('0.55::double+0.45::double*ov')} chroma_weight from wk"),
    ]


_WEAK = [
    *weak_sql(FACTOR), *_PROFILE,
    ("es", f"select *, {clip('case when region>0 then own else alpha+al end')} rg_, source_override so_, {clip('structure*(1-evidence)')} ep_ from er"),
    *weak_tail(),
]


@query("weak_feather_weights", "W16 P12", duck("blend_inputs", f"select {PIX}, {r6('base_weight')} base_weight, {r6('detail_weight')} detail_weight, {r6('chroma_weight')} chroma_weight from wf", _FULL, *_WEAK, recursive=True))
def weak_feather_weights(spark, sf):
    from glintframe.operators.feather import hysteresis_weights
    return rounded(hysteresis_weights(blend_inputs(spark, sf), factor=FACTOR, short_side=SIDE).select(*KEY, "base_weight", "detail_weight", "chroma_weight"))


@query("weak_feather_blend", "W16 P14 F1", duck("blend_inputs", f"select {PIX}, {r6(chr(34) + 'or' + chr(34))} \"or\", {r6('og')} og, {r6('ob')} ob from res", _FULL, *_WEAK, *compose_sql("wf"), recursive=True))
def weak_feather_blend(spark, sf):
    return rounded(B.blend(blend_inputs(spark, sf), "weak_hysteresis_feather", short_side=SIDE, factor=FACTOR).select(*KEY, *_OUT))


_cham = lambda dy, dx: f"(case when 2*least(abs({dy}),abs({dx}))<=greatest(abs({dy}),abs({dx})) then 2.1969::double*least(abs({dy}),abs({dx}))+greatest(abs({dy}),abs({dx}))-2*least(abs({dy}),abs({dx})) else 2.1969::double*(greatest(abs({dy}),abs({dx}))-least(abs({dy}),abs({dx})))+1.4::double*(2*least(abs({dy}),abs({dx}))-greatest(abs({dy}),abs({dx}))) end)"


def shell_sql(factor):
    return [
        *weak_sql(factor),
        ("s1", "select scene, frame, region, (1.5::double+1.5::double*sc)*(1+risk) rad from e8"),
        ("s2", f"select s1.*, t.y, t.x, t.region=s1.region own, min({_cham('o.y-t.y', 'o.x-t.x')}) dist, any_value((t.score>=0.05::double or t.evidence>=0.1::double) and (t.structure<=0.65::double or t.evidence>=0.18::double)) ok "
               "from s1 join e5 t using (scene, frame) join e5 o on o.scene=s1.scene and o.frame=s1.frame and o.region=s1.region group by all"),
        ("s3", "select 0 i, scene, frame, region, y, x, rad, own, dist, ok, own grown from s2 union all select i+1, scene, frame, region, y, x, rad, own, dist, ok, grown or (i<greatest(ceil(rad),1) and ok and dist<=rad+1e-6::double and near) from "
               "(select *, coalesce(lag(grown) over (partition by scene,frame,region,y order by x),false) or coalesce(lead(grown) over (partition by scene,frame,region,y order by x),false) or coalesce(lag(grown) over (partition by scene,frame,region,x order by y),false) or coalesce(lead(grown) over (partition by scene,frame,region,x order by y),false) near from s3 where i<8)"),
    ]


def _shells(spark, sf, factor):
    from glintframe.operators import feather as W
    p = W._resolve({**W.WEAK_DEFAULTS, **W.OUTER_DEFAULTS}, {"small_outer_radius": 1.5})
    d = blend_inputs(spark, sf)
    change = sum((F.abs(F.col(c) - F.col(f"s{c}")) for c in "gb"), F.abs(F.col("r") - F.col("sr"))) / 3.0
    _, coarse = M.coarse_evidence(d.withColumn("change", change), factor, ("change",))
    return rounded(W.outer_shell(*W.weak_regions(coarse, p), p).select(*KEY, "region_id", "distance"))


_SHELL_ROWS = f"select {PIX}, region::bigint region_id, {r6('dist')} distance from s3 where i=8 and grown and not own"


@query("outer_shells", "W17", duck("blend_inputs", _SHELL_ROWS, _FULL, *shell_sql(FACTOR), recursive=True))
def outer_shells(spark, sf):
    return _shells(spark, sf, FACTOR)


@query("fine_shells", "W17", duck("blend_inputs", _SHELL_ROWS, _FULL, *shell_sql(1), recursive=True))
def fine_shells(spark, sf):
    """The shells on the pixels themselves."""
    return _shells(spark, sf, 1)


def smooth_by(low, high, value):
    t = clip(f"(({value})-({low}))/(({high})-({low}))")
    return f"({t}*{t}*(3-2*{t}))"


_TAPS = ", ".join(f"({v},{t!r}::double)" for v, t in zip(range(-3, 4), D.taps(0.75)))
_OUTER = [
    *shell_sql(FACTOR), *_PROFILE,
    ("o1", "select scene, frame, region, y, x, rad, own, dist from s3 where i=8 and grown"),
    ("ow", f"select d, greatest(0,least(3,d+v)) s, sum(k) wt from (values {_TAPS}) t(v,k) join (select range::int d from range(4)) on true group by all"),
    ("o2", f"select o.scene, o.frame, o.region, wy.d y, wx.d x, {clip('sum(wy.wt*wx.wt)')} soft from o1 o join ow wy on wy.s=o.y join ow wx on wx.s=o.x group by all"),
    ("o3", f"select o1.*, soft, {smooth_by('-rad', '0.5::double', '-dist')}*soft outside, per, round_even(4*sc,0)::int st from o1 join o2 using (scene, frame, region, y, x) join e8 using (scene, frame, region) where not own"),
    ("o4", f"select *, {clip('case when region>0 then own else alpha+al end')} rg0 from er"),
    *D.plus("o5", "o4", "rg0", "l1", "max"), *D.plus("o6", "o5", "l1", "l2", "max"), *D.plus("o7", "o6", "l2", "l3", "max"), *D.plus("o8", "o7", "l3", "l4", "max"),
    *D.blur("o9", "o8", {f"k{k}": f"l{k}" for k in range(1, 5)}, 0.75, n=4),
    ("oi", f"select t.scene, t.frame, t.y, t.x, min({_cham('o.y-t.y', 'o.x-t.x')}) depth, any_value(round_even(4*sc,0)::int) st, any_value((1.5::double+1.5::double*sc)*(1+risk)) rad from e5 t "
           "join e8 on e8.scene=t.scene and e8.frame=t.frame and e8.region=t.region join e5 o on o.scene=t.scene and o.frame=t.frame and o.region<>t.region group by all"),
    ("oa", f"select b.scene, b.frame, b.y, b.x, case when st>0 then [k1,k2,k3,k4][st]*{smooth_by('-rad', 'greatest(st,0.5::double)', '-dist')}*soft else 0 end shift, outside, outside*per held from o3 b join o9 using (scene, frame, y, x) "
           f"union all select i.scene, i.frame, i.y, i.x, [k1,k2,k3,k4][st]*{smooth_by('-rad', 'greatest(st,0.5::double)', 'depth')}, null, null from oi i join o9 using (scene, frame, y, x) where st>0 and depth<=st+1"),
    ("ob", "select scene, frame, y, x, max(shift) sh, max(held) pv, max(outside) ou from oa group by all"),
    ("es", f"select o4.*, {clip('greatest(rg0,coalesce(sh,0))')} rg_, greatest(source_override,coalesce(pv,0)) so_, {clip('structure*(1-evidence)')} ep_, (ou is not null)::int::double os_ from o4 left join ob using (scene, frame, y, x)"),
    *weak_tail("os_"),
]


@query("outer_feather_weights", "W17 W16", duck("blend_inputs", f"select {PIX}, {r6('base_weight')} base_weight, {r6('detail_weight')} detail_weight, {r6('chroma_weight')} chroma_weight, {r6('os_')} outer_support from wf", _FULL, *_OUTER, recursive=True))
def outer_feather_weights(spark, sf):
    from glintframe.operators.feather import hysteresis_weights
    return rounded(hysteresis_weights(blend_inputs(spark, sf), factor=FACTOR, short_side=SIDE, outer=True, small_outer_radius=1.5).select(*KEY, "base_weight", "detail_weight", "chroma_weight", "outer_support"))
