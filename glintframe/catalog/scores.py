"""Score mappings, suppression metrics, pairing and selection."""

from pyspark.sql import functions as F

from glintframe.catalog.base import duck, expected, files, grid, pair_rows, query, r6, rgb, paired_rgb, rounded, table, poses
from glintframe.functions import color, scalar as S
from glintframe.operators import pairing as P, suppression as A
from glintframe.operators.quantiles import exact_quantiles, with_frame_quantile

GRID_KEY = ["scene", "frame", "y", "x"]
clip = lambda e: f"greatest(0::double,least(1::double,{e}))"


def smooth(lo, hi, e):
    t = clip(f"(({e})-{lo}::double)/({hi}::double-{lo}::double)")
    return f"({t}*{t}*(3-2*{t}))"


def zfs(e, thr, k=8):
    return clip(f"(1/(1+exp(-{k}::double*(({e})-{thr}::double)))-1/(1+exp({k}::double*{thr}::double)))/"
                f"greatest(1-1/(1+exp({k}::double*{thr}::double)),1e-6::double)")


STATE = lambda c: f"(case when {c}>=0.16::double then 2 when {c}>=0.075::double then 1 else 0 end)"
BOOST = lambda e, mixfrom: ("with_boost", None) and (
    clip(f"{clip(f'{zfs(e, 0.3)}+(1-{smooth(mixfrom, 0.3, e)})*greatest({zfs(e, 0.16)}-{zfs(e, 0.3)},0)')}"
         f"*(1+0.35::double*(1-{smooth(mixfrom, 0.3, e)}))"))


@query("score_mappings", "P5 P6 P7 P8 P10 P12 P13 S3 S4", duck("grid", f"""
    select scene, frame, pos::bigint pos, {r6(smooth(0.08, 0.35, 'raw'))} smooth, {r6('1/(1+exp(-8*(raw-0.5::double)))')} prob,
    {r6(zfs('raw', 0.3))} zero_floor, {STATE('raw')}::bigint state, {r6('raw*(0.25::double+0.75::double*outp)')} view_ev,
    {r6('greatest(raw*(0.25::double+0.75::double*outp),0.4::double*raw,0.3::double*outp)')} independent,
    {r6(BOOST('raw', 0.1))} boost_v5, {r6(BOOST('raw', 0.12))} boost_v6,
    {r6(clip('0.12::double+0.88::double*raw'))} detail, {r6(clip('0.55::double+0.45::double*raw'))} chroma,
    floor({clip('raw')}*65535)::bigint q16, {r6('floor(' + clip('raw') + '*65535)/65535')} decoded from grid"""))
def score_mappings(spark, sf):
    q = S.encode_map("raw")
    return rounded(grid(spark, sf).select(
        "scene", "frame", "pos", S.smoothstep(0.08, 0.35, "raw").alias("smooth"), S.sigmoid("raw").alias("prob"),
        S.zero_floor_sigmoid("raw", 0.3).alias("zero_floor"), S.classify("raw").alias("state"),
        S.view_evidence("raw", "outp").alias("view_ev"),
        S.independent_evidence("raw", "outp", F.col("raw") * 0.4, F.col("outp") * 0.3).alias("independent"),
        S.weak_boost("raw", threshold=0.3, steepness=8, mapping_threshold=0.16, mix_from=0.10, gain=0.35).alias("boost_v5"),
        S.weak_boost("raw", threshold=0.3, steepness=8, mapping_threshold=0.16, mix_from=0.12, gain=0.35).alias("boost_v6"),
        S.detail_fraction("raw").alias("detail"), S.chroma_fraction("raw").alias("chroma"),
        q.alias("q16"), S.decode_map(q).alias("decoded")))


_FUSE = """select scene, frame, pos, single, structure, stable, cr*(0.2::double+0.8::double*app) cs, rm*(0.2::double+0.8::double*app) rs from
 (select scene, frame, pos, raw single, outp structure, sqrt(raw) app, raw*outp cr, sqrt(outp)*0.5::double rm, least(1::double,2*outp) stable from grid)"""


@query("fused_scores", "P9", duck("grid", f"""select scene, frame, pos::bigint pos, {r6(clip('low + 0.5::double*greatest(sup-low,0)'))} score
    from (select *, greatest(cs,0.85::double*rs) sup, single*(1-0.72::double*eff)*(1-0.35::double*stable*eff) low
          from (select *, structure*(1-0.95::double*greatest(cs,rs)) eff from f))""", ("f", _FUSE)))
def fused_scores(spark, sf):
    g = grid(spark, sf)
    score = S.fuse_score("raw", "outp", F.sqrt("raw"), F.col("raw") * F.col("outp"), F.least(F.lit(1.0), 2 * F.col("outp")),
                         F.sqrt("outp") * 0.5)
    return rounded(g.select("scene", "frame", "pos", score.alias("score")))


_LIN = lambda c: f"(case when {c}<=0.04045::double then {c}/12.92::double else power(({c}+0.055::double)/1.055::double,2.4::double) end)"
_F = lambda t: f"(case when {t}>0.008856::double then cbrt({t}) else 7.787::double*{t}+16::double/116 end)"
def lab_steps(prefix, r, g, b, src, keep):
    """Two CTE bodies: linear/xyz then lab columns l,a,bb with a prefix."""
    return (f"select {keep}, (0.412453::double*R_+0.357580::double*G_+0.180423::double*B_)/0.950456::double {prefix}x, "
            f"0.212671::double*R_+0.715160::double*G_+0.072169::double*B_ {prefix}y, "
            f"(0.019334::double*R_+0.119193::double*G_+0.950227::double*B_)/1.088754::double {prefix}z "
            f"from (select *, {_LIN(r)} R_, {_LIN(g)} G_, {_LIN(b)} B_ from {src})")
def lab_of(p):
    return (f"(case when {p}y>0.008856::double then 116*cbrt({p}y)-16 else 903.3::double*{p}y end)",
            f"(500*({_F(p + 'x')}-{_F(p + 'y')}))", f"(200*({_F(p + 'y')}-{_F(p + 'z')}))")


@query("color_spaces", "P3 P4", duck("paired_rgb", f"""select scene, frame, pos::bigint pos, {r6('l709')} l709, {r6('l601')} l601, {r6('mx')} mx,
    {r6(lab_of('p')[0])} l, {r6(lab_of('p')[1])} a, {r6(lab_of('p')[2])} bb,
    {r6(f"sqrt(power({lab_of('p')[0]}-{lab_of('s')[0]},2)+power({lab_of('p')[1]}-{lab_of('s')[1]},2)+power({lab_of('p')[2]}-{lab_of('s')[2]},2))")} delta_e
    from t2""",
    ("t1", lab_steps("p", "r", "g", "b", "paired_rgb", "scene,frame,pos,sr,sg,sb,0.2126::double*r+0.7152::double*g+0.0722::double*b l709,0.299::double*r+0.587::double*g+0.114::double*b l601,greatest(r,g,b) mx")),
    ("t2", lab_steps("s", "sr", "sg", "sb", "t1", "scene,frame,pos,l709,l601,mx,px,py,pz"))))
def color_spaces(spark, sf):
    d = paired_rgb(spark, sf)
    lab = color.rgb_to_lab("r", "g", "b")
    return rounded(d.select("scene", "frame", "pos", S.lum709("r", "g", "b").alias("l709"), S.lum601("r", "g", "b").alias("l601"),
                            S.rgb_max("r", "g", "b").alias("mx"), lab[0].alias("l"), lab[1].alias("a"), lab[2].alias("bb"),
                            color.delta_e76(lab, color.rgb_to_lab("sr", "sg", "sb")).alias("delta_e")))


_COMP = lambda e: clip(f"(case when {clip(e)}<=0.0031308::double then 12.92::double*{clip(e)} else 1.055::double*power({clip(e)},1/2.4::double)-0.055::double end)")
_INV = lambda f: f"(case when {f}<=7.787::double*0.008856::double+16::double/116 then ({f}-16::double/116)/7.787::double else power({f},3) end)"


@query("lab_round_trip", "P4b", duck("rgb", f"""select scene, frame, pos::bigint pos,
    {r6(_COMP('3.240479::double*X-1.537150::double*Y-0.498535::double*Z'))} r, {r6(_COMP('-0.969256::double*X+1.875991::double*Y+0.041556::double*Z'))} g,
    {r6(_COMP('0.055648::double*X-0.204043::double*Y+1.057311::double*Z'))} b from t3""",
    ("t1", lab_steps("p", "r", "g", "b", "rgb", "scene,frame,pos")),
    ("t2", f"select scene, frame, pos, {lab_of('p')[0]}*0.9::double l, {lab_of('p')[1]}+3 a, {lab_of('p')[2]}-2 bb from t1"),
    ("t3", f"""select *, 0.950456::double*{_INV('(fy+a/500)')} X, 1.088754::double*{_INV('(fy-bb/200)')} Z from (select *,
     case when l<=0.008856::double*903.3::double then l/903.3::double else power((l+16)/116,3) end Y,
     case when l<=0.008856::double*903.3::double then 7.787::double*(l/903.3::double)+16::double/116 else (l+16)/116 end fy from t2)""")))
def lab_round_trip(spark, sf):
    light, a, b = color.rgb_to_lab("r", "g", "b")
    shifted = rgb(spark, sf).select("scene", "frame", "pos", (light * 0.9).alias("l"), (a + 3).alias("a"), (b - 2).alias("bb"))
    return rounded(shifted.select("scene", "frame", "pos", *[c.alias(n) for c, n in zip(color.lab_to_rgb("l", "a", "bb"), "rgb")]))


@query("ratios_and_psnr", "P15 P16 P18 P17", duck("grid", f"""select scene, frame, n::bigint pixels, {r6('100*(sb-sa)/nullif(sb,0)')} reduction,
    {r6('100*hit::double/nullif(strong,0)')} hit_percent, {r6('case when mse<=1e-12::double then 99 else 10*log10(1/mse) end')} psnr_all,
    {r6('case when strong>=10 then (case when smse<=1e-12::double then 99 else 10*log10(1/smse) end) end')} psnr_strong,
    {r6('case when sqrt(mse)<=1e-12::double then 99 else 20*log10(1/sqrt(mse)) end')} psnr_rmse,
    {r6('degrees(acos(greatest(-1::double,least(1::double,dot))))')} angle,
    (dot*4<=2.5::double and degrees(acos(greatest(-1::double,least(1::double,dot))))<=30) supported from
    (select scene, frame, count(*) n, sum(raw) sb, sum(outp) sa, sum(raw*outp)/sqrt(sum(raw*raw)*sum(outp*outp)) dot,
     count(*) filter (where raw>=0.16::double) strong, count(*) filter (where raw>=0.16::double and outp<0.16::double) hit,
     avg(power(raw-outp,2)) mse, avg(power(raw-outp,2)) filter (where raw>=0.16::double) smse from grid group by 1,2)"""))
def ratios_and_psnr(spark, sf):
    sq = (F.col("raw") - F.col("outp")) ** 2
    strong = F.col("raw") >= S.STRONG
    g = grid(spark, sf).groupBy("scene", "frame").agg(
        F.count(F.lit(1)).alias("n"), F.sum("raw").alias("sb"), F.sum("outp").alias("sa"),
        (F.sum(F.col("raw") * F.col("outp")) / F.sqrt(F.sum(F.col("raw") * F.col("raw")) * F.sum(F.col("outp") * F.col("outp")))).alias("dot"),
        F.count_if(strong).alias("strong"), F.count_if(strong & (F.col("outp") < S.STRONG)).alias("hit"),
        F.avg(sq).alias("mse"), F.avg(F.when(strong, sq)).alias("smse"))
    return rounded(g.select("scene", "frame", F.col("n").alias("pixels"), S.relative_reduction("sb", "sa").alias("reduction"),
                            S.percentage("hit", "strong").alias("hit_percent"), S.psnr("mse").alias("psnr_all"),
                            S.psnr("smse", F.col("strong")).alias("psnr_strong"), S.psnr_from_rmse(F.sqrt("mse")).alias("psnr_rmse"),
                            S.angle_deg("dot").alias("angle"),
                            S.within_support(F.col("dot") * 4, S.angle_deg("dot")).alias("supported")))


@query("display_text", "P22", duck("grid", """select scene, printf('%.2f', q[2]) med, printf('%.3f', q[2]) med3,
    printf('%.2f', q[2])||' ['||printf('%.2f', q[1])||', '||printf('%.2f', q[3])||']' spread
    from (select scene, quantile_cont(raw*10,[0.25,0.5,0.75]) q from grid group by scene)"""))
def display_text(spark, sf):
    q = exact_quantiles(grid(spark, sf), ["scene"], F.col("raw") * 10, {"q25": 0.25, "med": 0.5, "q75": 0.75})
    return q.select("scene", S.format_display("med").alias("med"), S.format_display("med", 3).alias("med3"),
                    S.format_spread("med", "q25", "q75").alias("spread"))


@query("frame_names", "P1 P2", duck("files", r"""select name, frame, regexp_extract(regexp_replace(name,'\.[^.]*$',''),'([0-9]+)[^0-9]*$',1)::bigint as key_last,
    regexp_replace(regexp_replace(alt,'\.[^.]*$',''),'[^0-9]','','g')::bigint as key_digits,
    coalesce(nullif(regexp_extract(regexp_replace(bare,'\.[^.]*$',''),'([0-9]+)[^0-9]*$',1),''),'0')::bigint as key_zero
    from (select *, 'cam'||(frame%3)||'_'||frame||'b.jpeg' alt, case when frame%2=0 then 'left.png' else name end bare from files)"""))
def frame_names(spark, sf):
    f = files(spark, sf).withColumn("alt", F.concat(F.lit("cam"), F.col("frame") % 3, F.lit("_"), F.col("frame"), F.lit("b.jpeg")))
    bare = F.when(F.col("frame") % 2 == 0, F.lit("left.png")).otherwise(F.col("name"))
    return f.select("name", "frame", S.frame_key("name").alias("key_last"), S.digit_key("alt").alias("key_digits"),
                    S.frame_key(bare, "zero").alias("key_zero"))


# --- suppression ---------------------------------------------------------

_TRANS = f"select scene, {STATE('raw')} b, {STATE('outp')} a, count(*) n from {{src}} group by 1,2,3"


@query("transition_matrix", "A1", duck("grid", "select scene, b::bigint as before, a::bigint as after, n::bigint pixels from t", ("t", _TRANS.format(src="grid"))))
def transition_matrix(spark, sf):
    return rounded(A.transition_matrix(grid(spark, sf)))


_WIDE = ", ".join(f"coalesce(sum(n) filter (where b={b} and a={a}),0) t{b}{a}" for b in range(3) for a in range(3))
_AREA = f"""select scene, (b0+b1+b2)::bigint pixels, {r6('100*b1/(b0+b1+b2)')} weak_before, {r6('100*a1/(b0+b1+b2)')} weak_after,
 {r6('100*(b1-a1)/nullif(b1,0)')} weak_area_reduction, {r6('100*b2/(b0+b1+b2)')} strong_before, {r6('100*a2/(b0+b1+b2)')} strong_after,
 {r6('100*(b2-a2)/nullif(b2,0)')} strong_area_reduction, {r6('100*(b1+b2)/(b0+b1+b2)')} any_before, {r6('100*(a1+a2)/(b0+b1+b2)')} any_after,
 {r6('100*(b1+b2-a1-a2)/nullif(b1+b2,0)')} any_area_reduction, {r6('100*(t20+t21)/nullif(b2,0)')} strong_suppression_rate,
 {r6('100*t20/nullif(b2,0)')} strong_clearance_rate, {r6('100*t10/nullif(b1,0)')} weak_clearance_rate
 from (select *, (t00+t01+t02)::double b0, (t10+t11+t12)::double b1, (t20+t21+t22)::double b2, (t01+t11+t21)::double a1, (t02+t12+t22)::double a2
 from (select scene, {_WIDE} from t group by scene))"""


@query("area_summary", "A5 A1", duck("grid", _AREA, ("t", _TRANS.format(src="grid"))))
def area_summary(spark, sf):
    return rounded(A.area_summary(A.transition_matrix(grid(spark, sf))))


@query("area_summary_rows", "A5 J4", duck("pair_rows", _AREA, ("t", _TRANS.format(src="pair_rows"))))
def area_summary_rows(spark, sf):
    return rounded(A.area_summary(A.transition_matrix(pair_rows(spark, sf))))


_SEV = f"""select scene, {r6('100*(sum(b*n)-sum(a*n))/nullif(sum(b*n),0)')} net_severity_reduction,
 {r6('100*sum(greatest(b-a,0)*n)/nullif(sum(b*n),0)')} source_region_severity_reduction,
 {r6('100*sum(greatest(a-b,0)*n)/nullif(sum(b*n),0)')} new_severity_burden from t group by scene"""


@query("severity", "A6", duck("pair_rows", _SEV, ("t", _TRANS.format(src="pair_rows"))))
def severity(spark, sf):
    return rounded(A.severity(A.transition_matrix(pair_rows(spark, sf))))


@query("evidence_attenuation", "A3", duck("pair_rows", f"""select scene, count(*) filter (where raw>=0.075::double)::bigint source_pixels,
 {r6('100*(sum(raw) filter (where raw>=0.075::double)-sum(outp) filter (where raw>=0.075::double))/nullif(sum(raw) filter (where raw>=0.075::double),0)')} source_evidence_attenuation
 from pair_rows group by scene"""))
def evidence_attenuation(spark, sf):
    return rounded(A.evidence_attenuation(pair_rows(spark, sf)))


_TIER = {"any_positive": "raw-outp>0", "detectable": "raw-outp>=0.005::double and raw-outp>=0*raw",
         "mild": "raw-outp>=0.01::double and raw-outp>=0.1::double*raw",
         "meaningful": "raw-outp>=0.02::double and raw-outp>=0.2::double*raw",
         "strong": "raw-outp>=0.03::double and raw-outp>=0.3::double*raw"}


def _tier_sql(src):
    pct = lambda test, s: r6(f"100*count(*) filter (where ({test}) and {s})::double/nullif(count(*) filter (where {s}),0)")
    return " union all ".join(
        f"select scene, '{n}' tier, {pct(t, 'b>0')} all_percent, {pct(t, 'b=1')} weak_percent, {pct(t, 'b=2')} strong_percent from s group by scene"
        for n, t in _TIER.items()), ("s", f"select *, {STATE('raw')} b from {src}")


@query("tier_coverage", "A2", duck("grid", *_tier_sql("grid")))
def tier_coverage(spark, sf):
    return rounded(A.tier_coverage(grid(spark, sf)))


@query("tier_coverage_rows", "A2", duck("pair_rows", *_tier_sql("pair_rows")))
def tier_coverage_rows(spark, sf):
    return rounded(A.tier_coverage(pair_rows(spark, sf)))


def _per_image_sql(src, keys):
    c = lambda t: f"count(*) filter (where {t})::double"
    pct = lambda p, q: r6(f"100*{p}/nullif({q},0)")
    cols = {"raw_weak_percent": pct(c("b=1"), "count(*)"), "raw_strong_percent": pct(c("b=2"), "count(*)"),
            "output_weak_percent": pct(c("a=1"), "count(*)"), "output_strong_percent": pct(c("a=2"), "count(*)"),
            "strong_state_suppression_percent": pct(c("b=2 and a<2"), c("b=2")), "weak_clearance_percent": pct(c("b=1 and a=0"), c("b=1")),
            "source_evidence_attenuation_percent": pct("(sum(raw) filter (where b>0)-sum(outp) filter (where b>0))", "sum(raw) filter (where b>0)")}
    names = {"meaningful": "meaningful_improvement_percent", "any_positive": "any_positive_suppression_percent", "detectable": "detectable_suppression_percent",
             "mild": "mild_suppression_percent", "strong": "strong_tier_coverage_percent"}
    cols.update({names[n]: pct(c(f"({t}) and b>0"), c("b>0")) for n, t in _TIER.items()})
    return (f"select {keys}, count(*)::bigint pixels, {', '.join(f'{v} {k}' for k, v in cols.items())} from s group by {keys}",
            ("s", f"select *, {STATE('raw')} b, {STATE('outp')} a from {src}"))


@query("per_image_rows", "A4", duck("grid", *_per_image_sql("grid", "scene, frame")))
def per_image_rows(spark, sf):
    return rounded(A.per_image_rows(grid(spark, sf)))


def _summary_sql(src):
    c = lambda t: f"count(*) filter (where {t})::double"
    pct = lambda p, q: r6(f"100*({p})/nullif({q},0)")
    m = _TIER["meaningful"]
    cols = {"weak_area_reduction": pct(f"{c('b=1')}-{c('a=1')}", c("b=1")), "strong_area_reduction": pct(f"{c('b=2')}-{c('a=2')}", c("b=2")),
            "any_area_reduction": pct(f"{c('b>0')}-{c('a>0')}", c("b>0")), "strong_suppression_rate": pct(c("b=2 and a<2"), c("b=2")),
            "weak_clearance_rate": pct(c("b=1 and a=0"), c("b=1")), "net_severity_reduction": pct("sum(b)-sum(a)", "sum(b)"),
            "source_region_severity_reduction": pct("sum(greatest(b-a,0))", "sum(b)"), "new_severity_burden": pct("sum(greatest(a-b,0))", "sum(b)"),
            "source_evidence_attenuation": pct("sum(raw) filter (where b>0)-sum(outp) filter (where b>0)", "sum(raw) filter (where b>0)"),
            "meaningful_improvement_rate": pct(c(f"({m}) and b>0"), c("b>0")), "weak_meaningful_improvement_rate": pct(c(f"({m}) and b=1"), c("b=1")),
            "strong_meaningful_improvement_rate": pct(c(f"({m}) and b=2"), c("b=2"))}
    return (f"select scene, count(*)::bigint pixels, {', '.join(f'{v} {k}' for k, v in cols.items())} from s group by scene",
            ("s", f"select *, {STATE('raw')} b, {STATE('outp')} a from {src}"))


@query("suppression_summary", "A1 A3 A5 A6", duck("grid", *_summary_sql("grid")))
def suppression_summary(spark, sf):
    return rounded(A.suppression_summary(grid(spark, sf)))


@query("suppression_summary_rows", "A1 A3 A5 A6", duck("pair_rows", *_summary_sql("pair_rows")))
def suppression_summary_rows(spark, sf):
    return rounded(A.suppression_summary(pair_rows(spark, sf)))


# --- pairing and picking -------------------------------------------------

@query("frame_pairs", "J1 J2 U1 L1", duck("grid", """select scene, frame, n::bigint pixels from (select scene, frame, count(*) n, row_number() over (partition by scene order by frame) rn
    from grid where frame%3<>0 and frame%5<>1 and frame%7<>2 group by 1,2) where rn<=5"""))
def frame_pairs(spark, sf):
    g = grid(spark, sf).groupBy("scene", "frame").agg(F.count(F.lit(1)).alias("pixels"))
    raw, cand, fus = g.where("frame % 3 <> 0"), g.where("frame % 5 <> 1"), g.where("frame % 7 <> 2")
    both = P.triple_frames(raw, cand.select("scene", "frame"), fus.select("scene", "frame"))
    return rounded(P.first_frames(both.join(P.common_frames(raw, cand, fus), ["scene", "frame"], "left_semi"), 5))


@query("pixel_pairs", "J4", duck("grid", f"select scene, {r6('sum(raw-outp)')} dropped, count(*)::bigint pixels from grid group by scene"))
def pixel_pairs(spark, sf):
    g = grid(spark, sf)
    paired = P.pair_pixels(g.select(*GRID_KEY, F.col("raw").alias("score")), g.select(*GRID_KEY, F.col("outp").alias("score")))
    return rounded(paired.groupBy("scene").agg(F.sum(F.col("raw") - F.col("outp")).alias("dropped"), F.count(F.lit(1)).alias("pixels")))


@query("shape_mismatches", "J5", duck("grid", """select scene, frame, h1::bigint h1, w1::bigint w1, h2::bigint h2, w2::bigint w2 from
    (select scene, frame, max(y)+1 h1, max(x)+1 w1 from grid where frame%11<>4 group by 1,2) full join
    (select scene, frame, max(y)+1 h2, max(x)+1 w2 from grid where not (frame%5=0 and x=7) group by 1,2) using (scene, frame)
    where h1 is distinct from h2 or w1 is distinct from w2"""))
def shape_mismatches(spark, sf):
    g = grid(spark, sf)
    return rounded(P.shape_mismatch(P.frame_size(g.where("frame % 11 <> 4")), P.frame_size(g.where("not (frame % 5 = 0 and x = 7)"))))


@query("file_counterparts", "J3 U3", duck("files", """select name, "match" from (select name, min_by(other, pr) "match" from
    (select f.name, replace(f.name,'.png',e.s) other, e.pr from files f join (values ('.jpeg',2),('.jpg',1),('.PNG',0)) e(s,pr) on (f.frame+e.pr)%3<>0 and f.frame%7<>3) group by name)
    union all select name, null from files where frame%7=3"""))
def file_counterparts(spark, sf):
    f = files(spark, sf)
    other = f.where("frame % 7 <> 3").select(
        F.explode(F.filter(F.array(*[F.when((F.col("frame") + p) % 3 != 0, F.regexp_replace("name", r"\.png$", s)) for s, p in
                                     ((".jpeg", 2), (".jpg", 1), (".PNG", 0))]), lambda v: v.isNotNull())).alias("name"))
    matched, missing = P.counterparts(f.select("name"), other)
    return matched.select("name", "match").unionByName(missing.select("name", F.lit(None).cast("string").alias("match")))


@query("frame_quantile_on_pixels", "J9 L2", duck("grid", f"""select scene, frame, pos::bigint pos, {r6('q')} cut, raw>=q top from
    (select *, quantile_cont(raw,0.9) over (partition by scene, frame) q from grid)"""))
def frame_quantile_on_pixels(spark, sf):
    g = with_frame_quantile(grid(spark, sf), {"cut": (F.col("raw"), 0.9)})
    return rounded(g.select("scene", "frame", "pos", "cut", (F.col("raw") >= F.col("cut")).alias("top")))


@query("scene_quantiles", "A8 A28", duck("grid", f"""select scene, count(*)::bigint n, {r6('avg(raw)')} mean, {r6('quantile_cont(raw,0.25)')} q25, {r6('quantile_cont(raw,0.5)')} p50,
    {r6('quantile_cont(raw,0.75)')} q75, {r6('quantile_cont(raw,0.9)')} p90, {r6('quantile_cont(raw,0.99)')} p99 from grid group by scene"""))
def scene_quantiles(spark, sf):
    g = grid(spark, sf)
    q = exact_quantiles(g, ["scene"], "raw", {"q25": 0.25, "p50": 0.5, "q75": 0.75, "p90": 0.9, "p99": 0.99}, count_as="n")
    return rounded(q.join(g.groupBy("scene").agg(F.avg("raw").alias("mean")), "scene"))


@query("score_statistics", "A28", duck("grid", f"""select scene, frame, mean, p50, p90, p99, {r6('avg(mean) over ()')} run_mean from
    (select scene, frame, {r6('round(avg(raw),4)')} mean, {r6('round(quantile_cont(raw,0.5),4)')} p50, {r6('round(quantile_cont(raw,0.9),4)')} p90,
     {r6('round(quantile_cont(raw,0.99),4)')} p99 from grid group by scene, frame)"""))
def score_statistics(spark, sf):
    g = grid(spark, sf)
    q = exact_quantiles(g, ["scene", "frame"], "raw", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    rows = q.join(g.groupBy("scene", "frame").agg(F.avg("raw").alias("mean")), ["scene", "frame"])
    rows = rows.select("scene", "frame", *[F.bround(c, 4).alias(c) for c in ("mean", "p50", "p90", "p99")])
    run = rows.agg(F.avg("mean").alias("run_mean"))
    return rounded(rows.join(F.broadcast(run)))


@query("held_out_frames", "W21", duck("grid", """select scene, frame from (select scene, frame, row_number() over (partition by scene order by frame)-1 p
    from (select distinct scene, frame from grid)) where p%8=0"""))
def held_out_frames(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("scene"), F.col("vec_id").alias("frame"))
    return P.holdout_every(e)


@query("uniform_views", "W20", duck("grid", """select scene, frame, k+1 sequence_index from (select scene, frame, row_number() over (partition by scene order by frame)-1 p, count(*) over (partition by scene) c
    from (select distinct scene, frame from grid)) join (select range::bigint k from range(20)) on round_even(k*(c-1)/19::double,0)=p"""))
def uniform_views(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("scene"), F.col("vec_id").alias("frame"))
    return rounded(P.uniform_pick(e, "frame", 20))


@query("latest_canvases", "W22 L3", duck("files", """select scene, name, step from (select *, max(step) over (partition by scene) m from
    (select frame%10 scene, 'val_step'||(frame%4*1000+frame%10)||'_'||lpad(frame::varchar,7,'0')||'.png' as name, frame%4*1000+frame%10 step from files)) where step=m"""))
def latest_canvases(spark, sf):
    f = files(spark, sf).select((F.col("frame") % 10).alias("scene"), F.concat(
        F.lit("val_step"), F.col("frame") % 4 * 1000 + F.col("frame") % 10, F.lit("_"), F.lpad(F.col("frame").cast("string"), 7, "0"), F.lit(".png")).alias("name"))
    return P.latest_step(f).select("scene", "name", "step").orderBy("scene", "name")


@query("strided_pixels", "W23", duck("grid", f"select scene, frame, count(*)::bigint n, {r6('sum(raw)')} total from grid where pos%3=0 group by 1,2"))
def strided_pixels(spark, sf):
    s = P.stride_sample(grid(spark, sf), 22)
    return rounded(s.groupBy("scene", "frame").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("total")))


@query("canvas_halves", "P20", duck("grid", f"""select a.scene, a.frame, {r6('avg(power(a.raw-b.raw,2))')} mse, count(*)::bigint n from grid a join grid b
    on a.frame=b.frame and a.y=b.y and b.x=a.x+4 where a.x<4 group by 1,2"""))
def canvas_halves(spark, sf):
    c = P.split_canvas(grid(spark, sf), ["raw"])
    return rounded(c.groupBy("scene", "frame").agg(F.avg((F.col("ref_raw") - F.col("out_raw")) ** 2).alias("mse"), F.count(F.lit(1)).alias("n")))
