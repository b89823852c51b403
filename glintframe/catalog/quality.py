"""Structure fidelity and held-out metrics."""

from pyspark.sql import functions as F

from glintframe.catalog import duckstencil as D
from glintframe.catalog.base import duck, grid, paired_rgb, query, r6, rounded
from glintframe.catalog.scores import lab_of, lab_steps
from glintframe.operators import fidelity as Q, structure as ST
from glintframe.operators.pairing import holdout_every

_L = lambda r, g, b: f"0.2126::double*{r}+0.7152::double*{g}+0.0722::double*{b}"


def _features(spark, sf):
    # the structure cue is a stand-in: a fixed share of the pixels counts as structure
    d = paired_rgb(spark, sf).withColumns({"score": F.col("r") / 2, "structure": 0.5 + 0.1 * (F.col("pos") % 6)})
    return Q.protected_masks(Q.fidelity_features(d))


_LAB = "power({a0}-{b0},2)+power({a1}-{b1},2)+power({a2}-{b2},2)"
def _de(p, q):
    a, b = lab_of(p), lab_of(q)
    return "sqrt(" + _LAB.format(a0=a[0], a1=a[1], a2=a[2], b0=b[0], b1=b[1], b2=b[2]) + ")"


_FEAT = [
    ("q1", lab_steps("p", "r", "g", "b", "paired_rgb", f"scene,frame,y,x,pos,sr,sg,sb,fr,fg,fb,r,{_L('r', 'g', 'b')} lum,{_L('sr', 'sg', 'sb')} s_lum,{_L('fr', 'fg', 'fb')} f_lum")),
    ("q2", lab_steps("s", "sr", "sg", "sb", "q1", "scene,frame,y,x,pos,r,lum,s_lum,f_lum,px,py,pz,fr,fg,fb")),
    ("q3", lab_steps("f", "fr", "fg", "fb", "q2", "scene,frame,y,x,pos,r,lum,s_lum,f_lum,px,py,pz,sx,sy,sz")),
    ("q4", f"select scene,frame,y,x,lum,s_lum,f_lum,{_de('p', 's')} s_de,{_de('p', 'f')} f_de, r/2<0.075::double and 0.5::double+0.1::double*(pos%6)>=0.65::double prot from q3"),
    *D.blur("q5", "q4", {"hp": "lum", "s_hp": "s_lum", "f_hp": "f_lum"}, 2.0, "reflect101"),
    *D.sobel("q6", "q5", "lum"), *D.sobel("q7", "q6", "s_lum", "s_gx", "s_gy", "s_gmag"), *D.sobel("q8", "q7", "f_lum", "f_gx", "f_gy", "f_gmag"),
    ("ft", "select * exclude (hp,s_hp,f_hp), lum-hp hp, s_lum-s_hp s_hp, f_lum-f_hp f_hp, prot and gmag>=cut edge from (select *, quantile_cont(case when prot then gmag end,0.75) over (partition by scene,frame) cut from q8)"),
]


def _corr(a, b, m):
    f = f"filter (where {m})"
    den = f"sqrt(var_pop({a}) {f}*var_pop({b}) {f})*count(*) {f}"
    return f"case when count(*) {f}>=10 and {den}>1e-12::double then covar_pop({a},{b}) {f}*count(*) {f}/({den}) end"


def _metrics(v, n):
    fp, fe = "filter (where prot)", "filter (where edge)"
    rm = f"sqrt(avg(power({v}_hp-hp,2)) {fp})"
    return {f"{n}_cie76_delta_e_mean": f"avg({v}_de) {fp}", f"{n}_cie76_delta_e_gt_2_percent": f"100*count(*) filter (where prot and {v}_de>2)/count(*) {fp}",
            f"{n}_cie76_delta_e_gt_5_percent": f"100*count(*) filter (where prot and {v}_de>5)/count(*) {fp}", f"{n}_highpass_rmse": rm,
            f"{n}_highpass_psnr_db": f"case when {rm}<=1e-12::double then 99 else 20*log10(1/{rm}) end", f"{n}_highpass_correlation": _corr("hp", f"{v}_hp", "prot"),
            f"{n}_edge_energy_ratio": f"sum({v}_gmag) {fe}/greatest(sum(gmag) {fe},1e-8::double)",
            f"{n}_edge_orientation_agreement": f"avg((gx*{v}_gx+gy*{v}_gy)/(gmag*{v}_gmag+1e-6::double)) {fe}", f"{n}_edge_magnitude_mae": f"avg(abs({v}_gmag-gmag)) {fe}",
            f"{n}_cie76_delta_e_median": f"quantile_cont({v}_de,0.5) {fp}"}


_M = {**_metrics("s", "direct"), **_metrics("f", "fusion")}
_OK = "count(*) filter (where prot)>=4 and count(*) filter (where edge)>=4"
_FROWS = ("fr", "select scene, frame, count(*) pixels, count(*) filter (where prot) protected_pixels, 100*count(*) filter (where prot)/count(*) protected_percent, count(*) filter (where edge) protected_edge_pixels, "
          "100*count(*) filter (where edge)/count(*) protected_edge_percent, max(cut) edge_percentile_cutoff, " + ", ".join(f"case when {_OK} then {e} end {n}" for n, e in _M.items()) + f", case when {_OK} then 'measured' else 'too few protected pixels' end status from ft group by 1,2")


@query("fidelity_rows", "A9 A10 A11 A12", duck("paired_rgb", f"""select scene, frame, status, pixels::bigint pixels, protected_pixels::bigint protected_pixels, protected_edge_pixels::bigint protected_edge_pixels,
    {r6('protected_percent')} protected_percent, {r6('protected_edge_percent')} protected_edge_percent, {r6('edge_percentile_cutoff')} edge_percentile_cutoff,
    {', '.join(f'{r6(n)} {n}' for n in _M)}, {r6('case when direct_cie76_delta_e_mean is not null then fusion_cie76_delta_e_mean/greatest(direct_cie76_delta_e_mean,1e-8::double) end')} fusion_to_direct_delta_e_ratio,
    {r6('case when direct_highpass_rmse is not null then fusion_highpass_rmse/greatest(direct_highpass_rmse,1e-8::double) end')} fusion_to_direct_highpass_rmse_ratio from fr""", *_FEAT, _FROWS))
def fidelity_rows(spark, sf):
    return rounded(Q.fusion_to_direct(Q.fidelity_rows(_features(spark, sf), minimum=4, strict=False)))


_SHOWN = ["protected_percent", "direct_cie76_delta_e_mean", "fusion_cie76_delta_e_mean", "direct_highpass_correlation", "fusion_highpass_correlation", "direct_edge_energy_ratio", "fusion_edge_energy_ratio"]


@query("fidelity_summary", "A8 U2", duck("paired_rgb", f"select scene, metric, count(v)::bigint frames, {r6('avg(v)')} mean, {r6('quantile_cont(v,0.5)')} median, {r6('quantile_cont(v,0.25)')} q25, {r6('quantile_cont(v,0.75)')} q75 from (" + " union all ".join(
    f"select {s} scene, '{m}' metric, {m}::double v from fr" for m in _SHOWN for s in ("scene::varchar", "'All'")) + ") where v is not null group by 1,2", *_FEAT, _FROWS))
def fidelity_summary(spark, sf):
    return rounded(Q.summary_stats(Q.fidelity_rows(_features(spark, sf), minimum=4, strict=False), _SHOWN))


@query("masked_statistics", "A9", duck("grid", f"select scene, frame, count(*) filter (where raw<0.075::double)::bigint masked_pixels, {r6('avg(raw) filter (where raw<0.075::double)')} mean, {r6('quantile_cont(raw,0.5) filter (where raw<0.075::double)')} median, {r6(_corr('raw', 'outp', 'raw<0.075::double'))} correlation from grid group by 1,2"))
def masked_statistics(spark, sf):
    return rounded(Q.masked_stats(grid(spark, sf), "raw", "outp", F.col("raw") < 0.075))


_HELD = [
    ("held", "select scene, frame from (select scene, frame, row_number() over (partition by scene order by frame)-1 p from (select distinct scene, frame from paired_rgb)) where p%8=0"),
    ("h1", "select *, r/2 score, fr/2 rscore, fr tr, fg tg, fb tb, 0.299::double*r+0.587::double*g+0.114::double*b l6 from paired_rgb semi join held using (scene, frame)"),
    *D.box("h2", "h1", {"e1": "l6", "e2": "l6*l6"}, 9, "edge"),
    ("h3", "select *, score>=0.16::double spec, sqrt(greatest(e2-e1*e1,0)) sd from h2"),
    ("h4", "select *, not spec and sd>=cut tex from (select *, quantile_cont(case when not spec then sd end,0.7) over (partition by scene,frame) cut from h3)"),
    *D.blur("h5", "h4", {f"b{p}{c}": f"{p}{c}" for p in ("", "s", "t") for c in "rgb"}, 2.0, "replicate"),
]
_m3 = lambda f: "((" + "+".join(f(c) for c in "rgb") + ")/3)"
_sq = lambda p, q: _m3(lambda c: f"power({p}{c}-{q}{c},2)")
_ab = lambda p, q: _m3(lambda c: f"abs({p}{c}-{q}{c})")
_hp = lambda p: lambda c: f"({p}{c}-b{p}{c})"
_hsq = _m3(lambda c: f"power({_hp('t')(c)}-{_hp('')(c)},2)")
_hab = _m3(lambda c: f"abs({_hp('s')(c)}-{_hp('')(c)})")
_ps = lambda e, m=None: (f"case when {'count(*) filter (where ' + m + ')>=10' if m else 'true'} then (case when avg({e}){' filter (where ' + m + ')' if m else ''}<=1e-12::double then 99 else 10*log10(1/avg({e}){' filter (where ' + m + ')' if m else ''}) end) end")
_ma = lambda e, m: f"case when count(*) filter (where {m})>=10 then avg({e}) filter (where {m}) end"
_HM = {"render_score_mean": "avg(rscore)", "gt_score_mean": "avg(score)", "render_spec_score": "avg(rscore) filter (where spec)",
       "render_hifrac": "count(*) filter (where greatest(tr,tg,tb)>200/255::double)/count(*)", "gt_hifrac": "count(*) filter (where greatest(r,g,b)>200/255::double)/count(*)",
       "spec_fraction_gt": "count(*) filter (where spec)/count(*)", "psnr_orig": _ps(_sq("t", "")), "psnr_suppressed": _ps(_sq("t", "s")), "psnr_diffuse_orig": _ps(_sq("t", ""), "not spec"),
       "psnr_spec_suppressed": _ps(_sq("t", "s"), "spec"), "mae_spec_orig": _ma(_ab("t", ""), "spec"), "mae_spec_suppressed": _ma(_ab("t", "s"), "spec"), "tex_fraction": "count(*) filter (where tex)/count(*)",
       "psnr_textured_orig": _ps(_sq("t", ""), "tex"), "psnr_hf_textured": _ps(_hsq, "tex"), "damage_diffuse": _ma(_ab("s", ""), "not spec"), "damage_hf_textured": _ma(_hab, "tex")}


def held_out_pixels(pixels):
    """Pixels of every eighth frame of a scene, by position."""
    held = holdout_every(pixels.select("scene", "frame").distinct())
    return pixels.join(held, ["scene", "frame"], "left_semi")


def _held(spark, sf):
    d = held_out_pixels(paired_rgb(spark, sf)).withColumns({"score": F.col("r") / 2, "render_score": F.col("fr") / 2, **{f"t{c}": F.col(f"f{c}") for c in "rgb"}})
    return Q.heldout_metrics(d, threshold=0.16)


@query("heldout_views", "A13 A31", duck("paired_rgb", "select scene, frame, " + ", ".join(f"{r6(e)} {n}" for n, e in _HM.items()) + " from h5 group by 1,2", *_HELD))
def heldout_views(spark, sf):
    return rounded(_held(spark, sf))


@query("heldout_means", "A31 R6", duck("paired_rgb", "select scene, " + ", ".join(f"{r6(f'avg({n})')} {n}" for n in _HM) + " from hv group by 1", *_HELD, ("hv", "select scene, frame, " + ", ".join(f"{e} {n}" for n, e in _HM.items()) + " from h5 group by 1,2")))
def heldout_means(spark, sf):
    return rounded(Q.heldout_means(_held(spark, sf)))
