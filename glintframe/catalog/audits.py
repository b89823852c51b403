"""Hash audits, document comparison, report tables and incremental runs."""

import re

from pyspark.sql import Window, functions as F

from glintframe.catalog.areas import flood
from glintframe.catalog.base import duck, expected, files, grid, observations, pair_rows, paired_rgb, poses, query, r6, rounded, table, views
from glintframe.catalog.cameras import _NEAR, _QV, _SPACING, _SUP, _known_fit, _shifted
from glintframe.catalog.quality import _FEAT, _FROWS, _HELD, _HM, _features, held_out_pixels
from glintframe.catalog.scores import STATE, _TIER, _TRANS
from glintframe.catalog.trajectories import _SUMS
from glintframe.functions import scalar as S
from glintframe.operators import audit as A, fidelity as Q, poses as C, regions as R, suppression as SU, tracks as T, views as V
from glintframe.plans import reports as RP
from glintframe.session import materialize, shared_dir
from glintframe.streaming import incremental as I

_VER = ("ver", "select frame, expected, actual, case when actual is null then 'missing' when expected is null then 'unexpected' when lower(expected)=lower(actual) then 'match' else 'mismatch' end status from "
        "(select frame, upper(expected) expected from expected where frame%50<>7) e full join (select frame, actual from files where frame%13<>5) f using (frame)")


def _verified(spark, sf):
    e = expected(spark, sf).where("frame % 50 <> 7").withColumn("expected", F.upper("expected"))
    return A.verify_join(e, files(spark, sf).where("frame % 13 <> 5").select("frame", "actual"), ["frame"])


@query("hash_verification", "J14", duck("files expected", "select frame, expected, actual, status from ver", _VER))
def hash_verification(spark, sf):
    return _verified(spark, sf).select("frame", "expected", "actual", "status")


@query("check_totals", "A34 R8", duck("files expected", "select count(*)::bigint checks, count(*) filter (where status<>'match')::bigint failures, bool_and(status='match') passed from ver where status<>'unexpected'", _VER))
def check_totals(spark, sf):
    return A.check_totals(A.checks(_verified(spark, sf), "frame"))


@query("set_digests", "A33", duck("files", "select \"set\", count(*)::bigint files, upper(sha256(string_agg(name||chr(0)||upper(actual)||chr(10),'' order by name))) digest from (select *, frame%7 \"set\" from files) group by \"set\""))
def set_digests(spark, sf):
    return A.set_digest(files(spark, sf).withColumn("set", F.col("frame") % 7), "set")


@query("key_set_difference", "U5 U3", duck("files expected", "select frame, 'first' side from files where frame not in (select frame from expected) union all select frame, 'second' from expected where frame not in (select frame from files)"))
def key_set_difference(spark, sf):
    from glintframe.operators.pairing import key_difference
    return key_difference(files(spark, sf), expected(spark, sf), ["frame"])


@query("parameter_drift", "R10", duck("", "select parameter, actual, frozen from (select user_id::varchar||'-'||event_type as parameter, max(value) actual from events group by 1) full join (select user_id::varchar||'-'||event_type as parameter, max(value) frozen from events where event_id%40<>0 group by 1) using (parameter) where actual is distinct from frozen"))
def parameter_drift(spark, sf):
    e = table(spark, sf, "events").withColumn("parameter", F.concat(F.col("user_id").cast("string"), F.lit("-"), "event_type"))
    top = lambda d: d.groupBy("parameter").agg(F.max("value").alias("value"))
    return A.profile_guard(top(e), top(e.where("event_id % 40 <> 0")))


def _documents(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    make = lambda v, name, ok, tail: F.to_json(F.struct(k.alias("k"), F.array(F.col("value"), v).alias("v"), F.struct(name.alias("s"), ok.alias("ok")).alias("m"), tail.alias("t")))
    actual = make(F.col("value") * 2, F.col("event_type"), i % 2 == 0, F.array(F.lit(1), F.lit(2)))
    shift = F.when(i % 5 == 0, 1e-6).when(i % 5 == 1, 5e-10).otherwise(0.0)
    reference = make(F.col("value") * 2 + shift, F.when(i % 11 == 0, F.lit("other")).otherwise(F.col("event_type")), i % 2 == F.when(i % 13 == 0, 1).otherwise(0),
                     F.when(i % 17 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))))
    # some references lack a key
    reference = F.when(i % 19 == 0, F.regexp_replace(reference, '"s":', '"z":')).otherwise(reference)
    return e.select("event_id", actual.alias("actual"), reference.alias("reference"))


@query("document_differences", "R9", duck("", """select event_id, '$.v[1]' as location, 'values differ' difference from events where event_id%5=0
    union all select event_id, '$.m.s', 'values differ' from events where event_id%11=0 and event_id%19<>0
    union all select event_id, '$.m.ok', 'values differ' from events where event_id%13=0 and event_id%19<>0
    union all select event_id, '$.t', 'not a list of this length' from events where event_id%17=0
    union all select event_id, '$.m', 'other keys' from events where event_id%19=0"""))
def document_differences(spark, sf):
    return A.compare_documents(_documents(spark, sf), "event_id")


_SUPCOLS = {"any_area_reduction": "100*(b.any_-a.any_)/nullif(b.any_,0)"}


@query("suppression_table", "R2 P22", duck("grid", """select scene::varchar scene, frames::varchar frames, printf('%.2f',any_area) any_area_reduction, printf('%.2f',strong_area) strong_area_reduction, printf('%.2f',att) source_evidence_attenuation,
    printf('%.2f',meaningful) meaningful_improvement_rate, printf('%.2f',sup) strong_suppression_rate, printf('%.2f',rc) region_consistent from
    (select scene, count(distinct frame) frames, 100*(count(*) filter (where b>0)-count(*) filter (where a>0))/count(*) filter (where b>0) any_area, 100*(count(*) filter (where b=2)-count(*) filter (where a=2))/count(*) filter (where b=2) strong_area,
     100*(sum(raw) filter (where b>0)-sum(outp) filter (where b>0))/sum(raw) filter (where b>0) att, 100*count(*) filter (where b>0 and """ + _TIER["meaningful"] + """)/count(*) filter (where b>0) meaningful,
     100*count(*) filter (where b=2 and a<2)/count(*) filter (where b=2) sup from s group by scene)
    join (select scene, 100*sum(n) filter (where md>0 and df>0.55::double)/sum(n) rc from v group by scene) using (scene)""",
    ("s", f"select *, {STATE('raw')} b, {STATE('outp')} a from grid"), *flood("lab", "grid", "raw>=0.075::double"),
    ("v", "select scene, frame, region, count(*) n, avg(raw-outp) md, count(*) filter (where raw-outp>0)/count(*) df from lab join grid using (scene, frame, y, x) where region>0 group by all"), recursive=True))
def suppression_table(spark, sf):
    g = grid(spark, sf)
    frames = g.select("scene", "frame").distinct().groupBy("scene").agg(F.count(F.lit(1)).alias("frames"))
    return RP.table_suppression(SU.suppression_summary(g), R.region_consensus(g), frames)


@query("fidelity_table", "R3", duck("paired_rgb", "select scene, count(*)::varchar frames, " + ", ".join(f"printf('%.{d}f', quantile_cont({m},0.5)) {m}" for m, d in RP.FIDELITY_DIGITS.items()) +
    " from (select scene::varchar scene, * exclude (scene) from fr union all select 'All', * exclude (scene) from fr) group by scene", *_FEAT, _FROWS))
def fidelity_table(spark, sf):
    return RP.table_fidelity(Q.summary_stats(Q.fidelity_rows(_features(spark, sf), minimum=4, strict=False), list(RP.FIDELITY_DIGITS)))


@query("trajectory_table", "R5 A22", duck("views", f"select scene, {', '.join(f'printf(chr(37)||chr(46)||chr(50)||chr(102), {c}) {c}' for c in RP._TRAJECTORY)} from (select scene, {_SUMS} from views where within_support group by scene)"))
def trajectory_table(spark, sf):
    return RP.table_trajectory(V.aggregate_supported(views(spark, sf)))


@query("run_comparison", "R6 L3", duck("views", f"select scene, coalesce(printf('%.2f',a),'-') mean_score_reduction_percent, coalesce(printf('%.3f',b),'-') best from (select scene, 100*(sum(raw_mean*pixels)-sum(out_mean*pixels))/sum(raw_mean*pixels) a, max(value_) b from (select *, case when scene<>'click' then raw_any/7 end value_ from views) group by scene)"))
def run_comparison(spark, sf):
    v = views(spark, sf)
    best = v.groupBy("scene").agg(F.max(F.when(F.col("scene") != "click", F.col("raw_any") / 7)).alias("best"))
    return RP.compare_experiments(V.aggregate_views(v).join(best, "scene"), "scene", {"mean_score_reduction_percent": 2, "best": 3})


@query("frame_quality", "R11", duck("grid", f"select scene, count(*) filter (where st='processed')::bigint processed, count(*) filter (where st='existing')::bigint existing, count(*) filter (where st='skipped')::bigint skipped, {r6('avg(m) filter (where st=' + chr(39) + 'processed' + chr(39) + ')')} mean_score from (select scene, frame, avg(raw) m, case when frame%4=0 then 'existing' when frame%9=1 then 'skipped' else 'processed' end st from grid group by 1,2) group by scene"))
def frame_quality(spark, sf):
    g = grid(spark, sf)
    frames = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("scene"), F.col("vec_id").alias("frame"))
    scored = g.where("frame % 9 <> 1").groupBy("scene", "frame").agg(F.avg("raw").alias("mean"))
    return rounded(RP.frame_quality_report(frames, frames.where("frame % 4 = 0"), scored))


_RATIO = "case when direct_cie76_delta_e_mean is not null then fusion_cie76_delta_e_mean/greatest(direct_cie76_delta_e_mean,1e-8::double) end"


@query("cross_scene_summary", "R12", duck("paired_rgb views poses", "select m.*, raw_registered_frames, other_registered_frames, view_count, within_support_views, " + ", ".join(f"{r6(c)} supported_{c}" for c in RP._TRAJECTORY) +
    " from (select scene, count(*)::bigint frames, " + ", ".join(f"{r6(f'quantile_cont({m},0.5)')} {m}_median" for m in RP.FIDELITY_DIGITS) + f", {r6(f'quantile_cont({_RATIO},0.5)')} fusion_to_direct_delta_e_ratio_median"
    " from (select scene::varchar scene, * exclude (scene) from fr) group by scene) m"
    " left join (select scene::varchar scene, count(*)::bigint raw_registered_frames, count(*) filter (where frame%9<>0)::bigint other_registered_frames from poses group by 1) using (scene)"
    " left join (select scene, count(*)::bigint view_count, count(*) filter (where within_support)::bigint within_support_views from v7 group by 1) c using (scene)"
    f" left join (select scene, {', '.join(RP._TRAJECTORY)} from (select scene, {_SUMS} from v7 where within_support group by scene)) using (scene)",
    *_FEAT, _FROWS, ("v7", "select (view_id%7)::varchar scene, * exclude (scene) from views")))
def cross_scene_summary(spark, sf):
    """Ten scenes with 2-D values, seven of them with views of a 3-D path."""
    rows = Q.fusion_to_direct(Q.fidelity_rows(_features(spark, sf), minimum=4, strict=False))
    stats = Q.summary_stats(rows, [*RP.FIDELITY_DIGITS, "fusion_to_direct_delta_e_ratio"], pooled=None)
    registered = poses(spark, sf).groupBy("scene").agg(F.count(F.lit(1)).alias("raw_registered_frames"), F.count_if(F.col("frame") % 9 != 0).alias("other_registered_frames"))
    return rounded(RP.cross_scene_summary(stats, views(spark, sf).withColumn("scene", (F.col("view_id") % 7).cast("string")), registered))


def _held_rows(name, held, spread):
    """Six rows a scene: five from the held-out views, one from the spread of its points over the views."""
    rows = [f"select scene, '{label}' metric, coalesce(printf('%.{d}f', avg({m})), '-') \"{name}\" from {held} group by scene" for m, (label, d) in RP._HELDOUT.items() if m in _HM]
    label, d = RP._HELDOUT["mean_std_render"]
    rows.append(f"select scene, '{label}', coalesce(printf('%.{d}f', v), '-') from (select distinct scene from {held}) left join "
                f"(select scene, avg(v) v from (select point_id%10 scene, point_id, stddev_pop({spread}) v from observations group by all having count(*)>=2) group by 1) using (scene)")
    return " union all ".join(rows)


_HV = ("hv", "select scene, frame, " + ", ".join(f"{e} {n}" for n, e in _HM.items()) + " from h5 group by 1,2")
_HELD2 = [(f"p{n}" if n[0] == "h" and n != "held" else n, re.sub(r"\bh([1-5])(\w*)\b", r"ph\1\2", t).replace("fr/2 rscore, fr tr, fg tg, fb tb", "sr/2 rscore, sr tr, sg tg, sb tb")) for n, t in _HELD if n != "held"]


@query("heldout_table", "R4", duck("paired_rgb observations", f"select scene, metric, raw, processed from ({_held_rows('raw', 'hv', 'lum*0.9::double')}) join ({_held_rows('processed', 'phv', 'lum*(0.6::double+0.01::double*(frame%40))')}) using (scene, metric)", *_HELD, _HV, *_HELD2, ("phv", _HV[1].replace("h5", "ph5"))))
def heldout_table(spark, sf):
    d = held_out_pixels(paired_rgb(spark, sf)).withColumn("score", F.col("r") / 2)
    run = lambda v: Q.heldout_means(Q.heldout_metrics(d.withColumns({"render_score": F.col(f"{v}r") / 2, **{f"t{c}": F.col(f"{v}{c}") for c in "rgb"}}), 0.16))
    seen = observations(spark, sf).withColumn("scene", F.col("point_id") % 10)
    both = seen.select("scene", "point_id", (F.col("lum") * 0.9).alias("ref"), (F.col("lum") * (0.6 + 0.01 * (F.col("frame") % 40))).alias("out"))
    spread = materialize(T.view_dependence_ratio(both, scene=("scene",)))
    std = lambda c: spread.select("scene", F.col(c).alias("mean_std_render"))
    return RP.table_heldout(run("f").join(std("mean_std_ref"), "scene", "left"), run("s").join(std("mean_std_out"), "scene", "left"), ["scene"])


@query("diagnostics_table", "R5 A26 A39", duck("poses", """select scene, case when scene=6 then 'Development' else 'Additional' end as role, raw_n||'/'||oth_n registered, ok||'/'||n supported, printf('%.2f', 100*rmse/s) normalized_rmse from
    (select scene, count(*) raw_n, count(*) filter (where frame%9<>0) oth_n, sqrt(avg(power(1.7::double*(-cy)+0.5::double-ox,2)+power(1.7::double*cx-0.25::double-oy,2)+power(1.7::double*cz+1-oz,2))) rmse from poses group by 1)
    join (select scene, count(*) n, count(*) filter (where ratio<=2.5::double and ang<=30) ok from sup group by 1) using (scene) join spacing using (scene)""", _NEAR, _SPACING, _QV, _SUP))
def diagnostics_table(spark, sf):
    p = poses(spark, sf)
    spacing = materialize(C.median_spacing(p))
    counts = p.groupBy("scene").agg(F.count(F.lit(1)).alias("raw_registered_frames"), F.count_if(F.col("frame") % 9 != 0).alias("other_registered_frames"))
    aligned = C.alignment_summary(C.alignment_residuals(p, _known_fit(p)), spacing)
    # even scenes store the ratio, the others only its parts
    aligned = aligned.withColumn("rmse_in_raw_spacings", F.when(F.col("scene") % 2 == 0, F.col("rmse_in_spacings")))
    return RP.table_diagnostics(counts, C.support_summary(C.support_measurement(_shifted(p), p, spacing)), aligned, development="6")


@query("attached_views", "J10 P15", duck("views", f"select scene, view_id, height, direction, {r6('case when raw_mean>0 then 100*(raw_mean-out_mean)/raw_mean end')} mean_score_reduction_percent, {r6('100*(raw_any-out_any)/raw_any')} any_area_reduction_percent, {r6('100*(raw_strong-out_strong)/raw_strong')} strong_area_reduction_percent from views where view_id%3<>1"))
def attached_views(spark, sf):
    v = views(spark, sf)
    manifest = v.where("view_id % 3 <> 1").select("scene", "view_id", "height", "direction")
    return rounded(V.attach_views(v.drop("height", "direction"), manifest).select(
        "scene", "view_id", "height", "direction", *[f"{n}_reduction_percent" for n in ("mean_score", "any_area", "strong_area")]))


_RUNS = ("select o_orderkey run, 'v'||(o_custkey%2+2) detector_version, ['soft','hard','evidence_matte','removed_only','blur'][(o_orderkey%5)::int+1] blend_mode, "
         "(o_custkey%3+1)/10::double threshold, (o_orderkey%2+1)*2 data_factor from orders")
_PROFILES = ("select 'v'||(p_size%2+2) detector_version, ['soft','hard','evidence_matte','removed_only','blur'][(p_partkey%5)::int+1] blend_mode, (p_size%2+1)/10::double threshold, "
             "(p_partkey%2+1)*2 data_factor, p_brand release from part")


@query("run_profiles", "P19", f"""with r as ({_RUNS}), k as (select detector_version, blend_mode, threshold, data_factor, max(release) release from ({_PROFILES}) group by all)
    select run, coalesce(release, 'custom') profile, case when blend_mode in ('soft','hard','evidence_matte') then blend_mode||'_t'||threshold else blend_mode end tag
    from r left join k using (detector_version, blend_mode, threshold, data_factor)""")
def run_profiles(spark, sf):
    """Profile and tag of every run, read from the orders, against the profiles of the parts."""
    mode = lambda c: F.element_at(F.array(*map(F.lit, ("soft", "hard", "evidence_matte", "removed_only", "blur"))), (F.col(c) % 5 + 1).cast("int"))
    version = lambda c: F.concat(F.lit("v"), (F.col(c) % 2 + 2).cast("string")).alias("detector_version")
    factor = lambda c: ((F.col(c) % 2 + 1) * 2).alias("data_factor")
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), version("o_custkey"), mode("o_orderkey").alias("blend_mode"),
                                             ((F.col("o_custkey") % 3 + 1) / 10.0).alias("threshold"), factor("o_orderkey"))
    profiles = table(spark, sf, "part").select(version("p_size"), mode("p_partkey").alias("blend_mode"), ((F.col("p_size") % 2 + 1) / 10.0).alias("threshold"),
                                               factor("p_partkey"), F.col("p_brand").alias("release"))
    return rounded(RP.profile_of(runs, profiles).select("run", "profile", "tag"))


@query("cell_verification", "R7", """with c as (select o_orderpriority "table", o_orderstatus row, (o_custkey%50)::varchar col, count(*)::varchar as value from orders group by all)
    select "table", row, col, value actual, case when col='7' then value||'?' else value end expected, col<>'7' passed from c where row<>'P' and col<>'9'
    union all select "table", row, col, value, null, false from c where row='P' and col<>'9'
    union all select "table", row, col, null, case when col='7' then value||'?' else value end, false from c where row<>'P' and col='9'""")
def cell_verification(spark, sf):
    """Cells of generated tables against expected ones, with a wrong, a surplus and a missing group."""
    keys = [F.col("o_orderpriority").alias("table"), F.col("o_orderstatus").alias("row"), (F.col("o_custkey") % 50).cast("string").alias("col")]
    cells = table(spark, sf, "orders").groupBy(*keys).agg(F.count(F.lit(1)).cast("string").alias("value"))
    expected = cells.where("row <> 'P'").withColumn("value", F.when(F.col("col") == "7", F.concat("value", F.lit("?"))).otherwise(F.col("value")))
    return rounded(A.verify_cells(cells.where("col <> '9'"), expected))


# --- incremental ---------------------------------------------------------

def _pair_stream(spark, sf):
    """Pixel rows of the frames over several files: a frame lies in two of them, and a part of each comes twice."""
    import uuid
    root = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    lines = table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("scene"), F.col("l_suppkey").alias("frame"),
        (F.col("l_discount") * 3).alias("raw"), (F.col("l_tax") * 3).alias("outp"))
    frame = Window.partitionBy("scene", "frame")
    rows = lines.select("*", F.row_number().over(frame.orderBy("raw", "outp")).alias("piece"), F.count(F.lit(1)).over(frame).alias("expected"))
    half = F.col("piece") % 2
    for name, part in (("a", rows.where(half == 0)), ("b", rows.where((half == 1) | (F.col("piece") % 6 == 0))), ("c", rows.where(half == 1))):
        part.write.parquet(f"{root}/{name}")
    per_batch = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).parquet(root)


@query("incremental_frames", "ST1 ST2", duck("pair_rows", f"select scene, frame, b::bigint as before, a::bigint as after, count(*)::bigint pixels from (select scene, frame, {STATE('raw')} b, {STATE('outp')} a from pair_rows) group by all"))
def incremental_frames(spark, sf):
    """Per-frame transition rows written by an available-now stream, each whole frame once."""
    import uuid
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = {"weak": S.WEAK, "strong": S.STRONG}
    stream = _pair_stream(spark, sf)
    for _ in range(2):  # the second run finds nothing new
        I.evaluate_new_frames(stream, I.frame_transitions, out, run, pixel=("piece",), expected="expected")
    return rounded(I.results(spark, out).drop("batch"))


@query("running_totals", "ST2", duck("pair_rows", "select scene, b::bigint as before, a::bigint as after, n::bigint pixels from t", ("t", _TRANS.format(src="pair_rows"))))
def running_totals(spark, sf):
    """Totals over per-frame rows: a third comes wrong first, all frames are closed, then all come right and a quarter once more."""
    import uuid
    root = f"{shared_dir(spark)}/totals-{uuid.uuid4().hex}"
    rows = I.frame_transitions(pair_rows(spark, sf)).withColumn("version", F.lit(1).cast("long"))
    wrong = rows.withColumns({"pixels": F.col("pixels") + 1, "before": F.when(F.col("frame") % 2 == 0, F.col("after")).otherwise(F.col("before"))})
    later = lambda part, version: part.withColumn("version", F.lit(version).cast("long"))
    closing = rows.limit(1).select("scene", (-F.col("frame") - 1).cast(rows.schema["frame"].dataType).alias("frame"), "before", "after", F.lit(0).cast("long").alias("pixels"), F.lit(100).cast("long").alias("version"))
    last = later(rows, 101).unionByName(later(rows.where("frame % 4 = 0"), 101)).unionByName(later(wrong.where("frame % 5 = 0"), 7))
    for part in (wrong.where("frame % 3 = 0"), closing, last):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        I.running_totals(stream, f"{root}/out", horizon=50)
    return rounded(I.totals(spark, f"{root}/out"))
