"""Rendered views, bootstrap intervals, track statistics and photometric alignment."""

from pyspark.sql import functions as F

from glintframe.catalog.base import duck, grid, observations, paired_rgb, points, query, r6, rounded, tracks, views
from glintframe.operators import tracks as T, views as V
from glintframe.operators.pairing import holdout_every
from glintframe.operators.quantiles import exact_quantiles

_SUMS = ", ".join(
    ["count(*)::bigint view_count", "sum(pixels)::bigint pixel_count"]
    + [f"sum({c}*pixels)/sum(pixels) {c}" for c in ("raw_mean", "out_mean", "raw_any", "out_any", "raw_strong", "out_strong")]
    + ["100*(sum(source_score)-sum(residual_score))/sum(source_score) source_region_attenuation_percent",
       "100*sum(improved_px)/sum(source_px) broad_improvement_coverage_percent",
       "100*sum(strict_px)/sum(source_px) strict_significant_coverage_percent",
       "100*sum(strong_suppressed_px)/sum(strong_px) strong_suppression_percent",
       "100*count(*) filter (where out_mean<raw_mean)/count(*) views_with_lower_mean_score_percent",
       "100*count(*) filter (where out_any<raw_any)/count(*) views_with_lower_any_area_percent",
       "100*count(*) filter (where out_strong<raw_strong)/count(*) views_with_lower_strong_area_percent",
       "100*(sum(raw_mean*pixels)-sum(out_mean*pixels))/sum(raw_mean*pixels) mean_score_reduction_percent",
       "100*(sum(raw_any*pixels)-sum(out_any*pixels))/sum(raw_any*pixels) any_area_reduction_percent",
       "100*(sum(raw_strong*pixels)-sum(out_strong*pixels))/sum(raw_strong*pixels) strong_area_reduction_percent"])
_COLS = [s.split()[-1] for s in _SUMS.split(", ")]


def _agg_sql(keys, src, where=""):
    show = ", ".join(c if c in ("view_count", "pixel_count") else f"{r6(c)} {c}" for c in _COLS)
    return f"select {keys}, {show} from (select {keys}, {_SUMS} from {src} {where} group by {keys})"


@query("view_scores", "A20", duck("grid paired_rgb", f"""select scene, frame, count(*)::bigint pixels, {r6('avg(raw)')} raw_mean, {r6('avg(outp)')} out_mean,
    {r6('100*count(*) filter (where raw>=0.075::double)/count(*)')} raw_any, {r6('100*count(*) filter (where outp>=0.075::double)/count(*)')} out_any,
    {r6('100*count(*) filter (where raw>=0.16::double)/count(*)')} raw_strong, {r6('100*count(*) filter (where outp>=0.16::double)/count(*)')} out_strong,
    count(*) filter (where raw>=0.075::double)::bigint source_px, count(*) filter (where raw>=0.075::double and raw-outp>0)::bigint improved_px,
    count(*) filter (where raw>=0.075::double and raw-outp>=0.03::double and raw-outp>=0.3::double*raw)::bigint strict_px,
    count(*) filter (where raw>=0.16::double)::bigint strong_px, count(*) filter (where raw>=0.16::double and outp<0.16::double)::bigint strong_suppressed_px,
    {r6('coalesce(sum(raw) filter (where raw>=0.075::double),0)')} source_score, {r6('coalesce(sum(outp) filter (where raw>=0.075::double),0)')} residual_score,
    {r6('100*(sum(raw) filter (where raw>=0.075::double)-sum(outp) filter (where raw>=0.075::double))/nullif(sum(raw) filter (where raw>=0.075::double),0)')} source_region_attenuation_percent,
    {r6('avg(0.2126::double*r+0.7152::double*g+0.0722::double*b)')} raw_mean_luminance, {r6('avg(0.2126::double*sr+0.7152::double*sg+0.0722::double*sb)')} out_mean_luminance,
    {r6('quantile_cont(raw,0.95)')} raw_p95, {r6('quantile_cont(outp,0.95)')} out_p95 from grid join (select frame, pos, r,g,b,sr,sg,sb from paired_rgb) using (frame, pos) group by 1,2"""))
def view_scores(spark, sf):
    d = paired_rgb(spark, sf)
    raw = F.col("r") / 2  # the grid score is half the red channel
    d = d.join(grid(spark, sf).select("scene", "frame", "pos", "raw", "outp"), ["scene", "frame", "pos"])
    return rounded(V.score_view(d))


@query("pooled_views", "A21", duck("views", _agg_sql("scene", "views")))
def pooled_views(spark, sf):
    return rounded(V.aggregate_views(views(spark, sf)))


@query("supported_views", "A22", duck("views", _agg_sql("scene", "views", "where within_support")))
def supported_views(spark, sf):
    return rounded(V.aggregate_supported(views(spark, sf)))


_THIRD = ("v3", "select *, ntile(3) over (partition by scene order by view_id) path_third from views")


@query("view_breakdown", "A23", duck("views", f"{_agg_sql('scene, grouping, level', 'long')}", _THIRD, (
    "long", "select 'overall' grouping, null::bigint level, * from v3 union all select 'by_height', height, * from v3 union all "
            "select 'by_direction', direction, * from v3 union all select 'by_path_third', path_third, * from v3")))
def view_breakdown(spark, sf):
    return rounded(V.breakdown(V.with_path_third(views(spark, sf))))


@query("scene_means", "A32", duck("views", f"""select {', '.join(f'{r6(f"avg({c})")} {c}' for c in ('mean_score_reduction_percent', 'strong_area_reduction_percent'))}
    from (select scene, {_SUMS} from views group by scene)"""))
def scene_means(spark, sf):
    return rounded(V.scene_mean(V.aggregate_views(views(spark, sf)), ["mean_score_reduction_percent", "strong_area_reduction_percent"]))


_BOOT = {"mean_score_reduction_percent": ("wo", "wr", 1), "any_area_reduction_percent": ("ao", "ar", 1), "strong_area_reduction_percent": ("so", "sr", 1),
         "source_region_attenuation_percent": ("rs", "ss", 1), "broad_improvement_coverage_percent": ("im", "sp", 0),
         "strict_significant_coverage_percent": ("st", "sp", 0), "strong_suppression_percent": ("su", "sg", 0)}
_BCOLS = ["wo", "wr", "ao", "ar", "so", "sr", "rs", "ss", "im", "sp", "st", "su", "sg"]
_ratio = lambda n, d, red: f"100*({d + '-' + n if red else n})/greatest({d},1e-12::double)"
_long = lambda src, val, keys: " union all ".join(f"select {keys}, '{m}' metric, {_ratio(*spec)} {val} from {src}" for m, spec in _BOOT.items())


@query("bootstrap_intervals", "A24", duck("views", f"""select scene, metric, {r6('low')} low, {r6('high')} high, {r6('point')} point, {r6('point-low')} minus, {r6('high-point')} plus
    from b join p using (scene, metric)""",
    ("c", """select scene, direction, row_number() over (partition by scene order by direction)-1 i, count(*) over (partition by scene) n,
      sum(out_mean*pixels) wo, sum(raw_mean*pixels) wr, sum(out_any*pixels) ao, sum(raw_any*pixels) ar, sum(out_strong*pixels) so, sum(raw_strong*pixels) sr,
      sum(residual_score) rs, sum(source_score) ss, sum(improved_px)::double im, sum(source_px)::double sp, sum(strict_px)::double st,
      sum(strong_suppressed_px)::double su, sum(strong_px)::double sg from views group by scene, direction"""),
    ("d", """select scene, r.range rep, ('0x'||substr(md5('20260808|'||r.range||'|'||s.i),1,12))::bigint % n i
      from range(10000) r, (select distinct scene, i, n from c) s"""),
    ("t", f"select scene, rep, {', '.join(f'sum({c}) {c}' for c in _BCOLS)} from d join c using (scene, i) group by scene, rep"),
    ("tot", f"select scene, {', '.join(f'sum({c}) {c}' for c in _BCOLS)} from c group by scene"),
    ("b", f"select scene, metric, quantile_cont(v,0.025) low, quantile_cont(v,0.975) high from ({_long('t', 'v', 'scene')}) group by scene, metric"),
    ("p", _long("tot", "point", "scene"))))
def bootstrap_intervals(spark, sf):
    return rounded(V.cluster_bootstrap(views(spark, sf)))


# --- tracks --------------------------------------------------------------

_OBS_STATS = ("st", """select point_id, n_views, med, p90, median(abs(lum-med)) mad from observations join
    (select point_id, count(*) n_views, median(lum) med, quantile_cont(lum,0.9) p90 from observations group by 1) using (point_id) group by all""")
_RES = ("res", """select *, greatest(lum-med-greatest(0.01::double,0.01::double+1.5::double*1.4826::double*mad),0) residual,
    greatest(0,least(1,exp(-greatest(p90-med,0)/greatest(3*1.4826::double*mad+0.01::double,0.02::double))*greatest(0,least(1,(n_views-3)/4::double)))) stab
    from observations join st using (point_id) where n_views>=4""")


@query("point_statistics", "A14", duck("observations", f"select point_id, n_views::bigint n_views, {r6('med')} median, {r6('p90')} p90, {r6('mad')} mad, n_views>=4 usable from st", _OBS_STATS))
def point_statistics(spark, sf):
    return rounded(T.point_stats(observations(spark, sf)))


@query("observation_residuals", "A15 A16", duck("observations", f"select frame, point_id, {r6('residual')} residual, {r6('stab')} stability from res", _OBS_STATS, _RES))
def observation_residuals(spark, sf):
    return rounded(T.observation_residuals(observations(spark, sf)).select("frame", "point_id", "residual", "stability"))


@query("residual_scale", "A17", duck("observations points", f"""select count(*)::bigint positive, {r6('quantile_cont(residual,0.5)')} p50, {r6('quantile_cont(residual,0.9)')} p90,
    {r6('quantile_cont(residual,0.95)')} norm_scale, {r6('quantile_cont(residual,0.99)')} p99 from res semi join (select * from points where error<=2.5) using (point_id) where residual>0""", _OBS_STATS, _RES))
def residual_scale(spark, sf):
    return rounded(T.residual_scale(T.observation_residuals(observations(spark, sf)), points(spark, sf)))


_SPREAD = ("sp", "select point_id, count(*) n_views, stddev_pop(lum) std from observations group by 1 having count(*)>=4")
_CUT = ("cut", "select count(*) n, quantile_cont(std,0.5) p50, quantile_cont(std,0.9) p90, quantile_cont(std,0.99) p99, quantile_cont(std,0.9) c from sp")


@query("view_variance", "A18", duck("observations", f"select n::bigint points_used, {r6('p50')} std_p50, {r6('p90')} std_p90, {r6('p99')} std_p99, {r6('c')} spec_cut from cut", _SPREAD, _CUT))
def view_variance(spark, sf):
    return rounded(T.view_variance(T.view_spread(observations(spark, sf))))


@query("specular_samples", "J13 L2", duck("observations", f"select frame, point_id, {r6('lum')} lum from observations semi join (select point_id from sp, cut where std>=c) using (point_id)", _SPREAD, _CUT))
def specular_samples(spark, sf):
    o = observations(spark, sf)
    spread = T.view_spread(o)
    return rounded(T.specular_samples(o, T.specular_points(spread, T.view_variance(spread))))


@query("view_dependence_ratio", "A19", duck("observations", f"""select count(*)::bigint points, {r6('avg(a)')} mean_std_ref, {r6('avg(b)')} mean_std_out, {r6('avg(b)/greatest(avg(a),1e-8::double)')} r_vd from
    (select point_id, stddev_pop(lum) a, stddev_pop(lum*(0.6::double+0.01::double*(frame%40))) b from observations semi join (select point_id from sp, cut where std>=c) using (point_id)
     where frame in (select frame from (select frame, row_number() over (order by frame)-1 p from (select distinct frame from observations)) where p%8=0) group by 1 having count(*)>=2)""", _SPREAD, _CUT))
def view_dependence_ratio(spark, sf):
    o = observations(spark, sf)
    spread = T.view_spread(o)
    frames = holdout_every(o.select("frame").distinct(), scene=())
    held = T.specular_samples(o.join(frames, "frame", "left_semi"), T.specular_points(spread, T.view_variance(spread)))
    return rounded(T.view_dependence_ratio(held.select("point_id", F.col("lum").alias("ref"), (F.col("lum") * (0.6 + 0.01 * (F.col("frame") % 40))).alias("out"))))


_TRK = ("trk", "select *, least(greatest(trunc(x*8/10::double)::int,0),7) px, least(greatest(trunc(y*8/10::double)::int,0),7) py from (select frame, case when (frame+point_id)%23=0 then -1 else point_id end point_id, x, y from tracks)")


def _tracks(spark, sf):
    # every 23rd track carries the invalid id marker
    t = tracks(spark, sf)
    bad = (F.col("frame") + F.col("point_id")) % 23 == 0
    return t.withColumn("point_id", F.when(bad, F.lit(-1)).otherwise(F.col("point_id"))).withColumns({"h": F.lit(8), "w": F.lit(8)})


@query("track_points", "J6", duck("tracks points", f"select frame, point_id, {r6('x')} x, {r6('y')} y, {r6('error')} error from trk join points using (point_id) where point_id>=0 and error<=2.5", _TRK))
def track_points(spark, sf):
    return rounded(T.track_points(_tracks(spark, sf), points(spark, sf), max_error=2.5).select("frame", "point_id", "x", "y", "error"))


@query("track_samples", "J7", duck("tracks points grid", f"select scene, frame, point_id, {r6('raw')} raw, {r6('outp')} outp from trk t join grid g using (frame) where point_id>=0 and g.y=t.py and g.x=t.px", _TRK))
def track_samples(spark, sf):
    t = _tracks(spark, sf).where("point_id >= 0")
    return rounded(T.sample_at(t, grid(spark, sf), ["scene", "raw", "outp"], F.lit(10), F.lit(10)).select("scene", "frame", "point_id", "raw", "outp"))


def affine_sql(src, key, min_n, rounds=5):
    steps, keep = [], f"select {key}, x, y from {src}"
    for k in range(rounds):
        steps += [(f"k{k}", keep), (f"l{k}", f"select {key}, regr_slope(y,x) g, regr_intercept(y,x) o from k{k} group by {key} having count(*)>={min_n}"),
                  (f"c{k}", f"select {key}, median(y-(g*x+o)) c from k{k} join l{k} using ({key}) group by {key}"),
                  (f"m{k}", f"select {key}, g, o, c, median(abs(y-(g*x+o)-c)) m from k{k} join l{k} using ({key}) join c{k} using ({key}) group by all")]
        keep = f"select {key}, x, y from {src} join m{k} using ({key}) where m>1e-6::double and abs(y-(g*x+o)-c)<=3*1.4826::double*m"
    names = ", ".join(key.split(", "))
    joins = " ".join(f"left join m{k} using ({names})" for k in range(rounds))
    pick = lambda c, d: "coalesce(" + ", ".join(f"m{k}.{c}" for k in reversed(range(rounds))) + f", {d})"
    fit = (f"select {key}, greatest(0.5::double,least(2::double,{pick('g', '1::double')})) gain, greatest(-0.25::double,least(0.25::double,{pick('o', '0::double')})) off "
           f"from (select distinct {key} from {src}) {joins}")
    return [*steps, ("fit", fit)]


_ALIGN = [("pairs", "select frame, lum x, med y from observations join (select point_id, median(lum) med from observations group by 1) using (point_id)"), *affine_sql("pairs", "frame", 20)]


@query("exposure_alignment", "A36 A29", duck("observations", f"select frame, {r6('gain')} gain, {r6('off')} \"offset\" from fit", *_ALIGN))
def exposure_alignment(spark, sf):
    return rounded(T.exposure_align(observations(spark, sf))[1])


@query("exposure_report", "A36", duck("observations", f"""select term, count(*)::bigint frames, {r6('quantile_cont(v,0.05)')} p5, {r6('quantile_cont(v,0.5)')} p50, {r6('quantile_cont(v,0.95)')} p95 from
    (select 'gain' term, gain v, frame from fit union all select 'offset', off, frame from fit) semi join (select frame from observations group by 1 having count(*)>=20) using (frame) group by term""", *_ALIGN))
def exposure_report(spark, sf):
    o = observations(spark, sf)
    return rounded(T.exposure_report(o, T.exposure_align(o)[1]))


@query("splatted_maps", "A37 A38", duck("tracks points grid", f"""select scene, frame, y::bigint y, x::bigint x, {r6('greatest(0,least(1,(sum(w*k*raw)/sum(w*k))/0.2::double))')} "value" from
    (select s.scene, s.frame, p.y, p.x, s.raw, s.w, exp(-(power(p.y-s.py,2)+power(p.x-s.px,2))/(2*1.2::double*1.2::double)) k
     from s join (select a.range y, b.range x from range(8) a, range(8) b) p on abs(p.y-s.py)<=4 and abs(p.x-s.px)<=4) group by all""", _TRK,
    ("s", "select scene, frame, point_id, px, py, raw, sqrt(least(5+point_id%9,10)::double)*(0.1::double+0.9::double*power(1-least(1,outp),2)) w from trk t join grid g using (frame) where point_id>=0 and g.y=t.py and g.x=t.px")))
def splatted_maps(spark, sf):
    t = _tracks(spark, sf).where("point_id >= 0")
    s = T.pixel_of(T.sample_at(t, grid(spark, sf), ["scene", "raw", "outp"], F.lit(10), F.lit(10)), F.lit(10), F.lit(10))
    w = T.track_weight(5 + F.col("point_id") % 9, F.least(F.lit(1.0), F.col("outp")))
    return rounded(T.splat_maps(s, "raw", w, sigma=1.2, norm_scale=0.2, keys=("scene", "frame")))
