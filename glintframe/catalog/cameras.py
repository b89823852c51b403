"""Camera poses: alignment, nearest cameras, support, midpoint trajectories."""

from pyspark.sql import functions as F

from glintframe.catalog.base import duck, poses, query, r6, rounded
from glintframe.functions import geometry as G
from glintframe.operators import poses as C
from glintframe.session import materialize

# a known similarity, used where SQL cannot solve for one
_KNOWN = {"scale": 1.7, "tx": 0.5, "ty": -0.25, "tz": 1.0, "gw": 0.7071067811865476, "gx": 0.0, "gy": 0.0, "gz": 0.7071067811865476}

_NEAR = ("near", """select scene, frame, min_by(nf, (d2, nf)) nf, sqrt(min(d2)) dist from
    (select a.scene, a.frame, b.frame nf, power(a.cx-b.cx,2)+power(a.cy-b.cy,2)+power(a.cz-b.cz,2) d2 from poses a join poses b on a.scene=b.scene and a.frame<>b.frame) group by 1,2""")
_SPACING = ("spacing", "select scene, median(dist) s from near group by scene")
_AXIS = lambda q: (f"2*({q}x*{q}z+{q}w*{q}y)", f"2*({q}y*{q}z-{q}w*{q}x)", f"1-2*({q}x*{q}x+{q}y*{q}y)")


@query("nearest_cameras", "J11 L4", duck("poses", f"select scene, frame, nf::bigint nearest_frame, {r6('dist')} nearest_distance from near", _NEAR))
def nearest_cameras(spark, sf):
    p = poses(spark, sf)
    return rounded(C.nearest(p, p, other_only=True))


@query("median_spacing", "J12", duck("poses", f"select scene, {r6('s')} spacing from spacing", _NEAR, _SPACING))
def median_spacing(spark, sf):
    return rounded(C.median_spacing(poses(spark, sf)))


def _shifted(p):
    """Query views: every camera moved a little off its place and rolled onto another heading."""
    return p.select("scene", "frame", (F.col("cx") + 0.05).alias("cx"), (F.col("cy") - 0.03 * (F.col("frame") % 5)).alias("cy"), "cz", "qw", "qx", "qy", "qz")


_QV = ("qv", "select scene, frame, cx+0.05::double cx, cy-0.03::double*(frame%5) cy, cz, qw, qx, qy, qz from poses")
_SUP = ("sup", f"""select n.scene, n.frame, n.nf, n.dist, n.dist/s ratio, degrees(acos(greatest(-1,least(1,{'+'.join(f'({a})*({b})' for a, b in zip(_AXIS('q.q'), _AXIS('t.q')))})))) ang from
    (select scene, frame, min_by(nf, (d2, nf)) nf, sqrt(min(d2)) dist from (select a.scene, a.frame, b.frame nf, power(a.cx-b.cx,2)+power(a.cy-b.cy,2)+power(a.cz-b.cz,2) d2 from qv a join poses b using (scene)) group by 1,2) n
    join qv q using (scene, frame) join poses t on t.scene=n.scene and t.frame=n.nf join spacing on spacing.scene=n.scene""")


@query("support_flags", "J11 P17 P18", duck("poses", f"""select scene, frame, nf nearest_frame, {r6('dist')} nearest_distance, {r6('ratio')} distance_in_spacings, {r6('ang')} angle,
    ratio<=2.25::double and ang<=27.5::double within_planning_support, ratio<=2.5::double and ang<=30 within_support from sup""", _NEAR, _SPACING, _QV, _SUP))
def support_flags(spark, sf):
    p = poses(spark, sf)
    return rounded(C.support_measurement(_shifted(p), p, C.median_spacing(p)))


@query("support_summary", "A39 U4", duck("poses", f"""select scene, count(*)::bigint as views, count(*) filter (where ratio<=2.5::double and ang<=30)::bigint within_support_count,
    {r6('count(*) filter (where ratio<=2.5::double and ang<=30)/count(*)')} within_support_fraction, {r6('max(ratio)')} maximum_distance, {r6('max(ang)')} maximum_angle,
    count(distinct nf)::bigint unique_nearest_frames from sup group by scene""", _NEAR, _SPACING, _QV, _SUP))
def support_summary(spark, sf):
    p = poses(spark, sf)
    return rounded(C.support_summary(C.support_measurement(_shifted(p), p, C.median_spacing(p))))


# the same fit in closed form: the leading eigenvector of a symmetric 4 x 4 matrix, by power iteration
_N = {"n00": "sxx+syy+szz", "n01": "syz-szy", "n02": "szx-sxz", "n03": "sxy-syx", "n11": "sxx-syy-szz", "n12": "sxy+syx", "n13": "szx+sxz",
      "n22": "syy-sxx-szz", "n23": "syz+szy", "n33": "szz-sxx-syy"}
_at = lambda i, j: f"n{min(i, j)}{max(i, j)}"
_ROT = (("1-2*(gy*gy+gz*gz)", "2*(gx*gy-gw*gz)", "2*(gx*gz+gw*gy)"), ("2*(gx*gy+gw*gz)", "1-2*(gx*gx+gz*gz)", "2*(gy*gz-gw*gx)"),
        ("2*(gx*gz-gw*gy)", "2*(gy*gz+gw*gx)", "1-2*(gx*gx+gy*gy)"))
_turned = lambda i, v: "(" + "+".join(f"({_ROT[i][j]})*{v[j]}" for j in range(3)) + ")"
_HORN = [
    ("cv", "select scene, count(*) cameras, " + ", ".join(f"covar_pop(o{b}, c{a}) s{a}{b}" for a in "xyz" for b in "xyz") + ", " + ", ".join(f"avg({p}{a}) m{p}{a}" for p in "co" for a in "xyz") + ", var_pop(cx)+var_pop(cy)+var_pop(cz) vr from poses group by scene having count(*)>=3"),
    ("nm", "select *, " + ", ".join(f"{e} {n}" for n, e in _N.items()) + " from cv"),
    ("ns", "select *, sqrt(" + "+".join(f"{n}*{n}*{1 if n[1] == n[2] else 2}" for n in _N) + ") sh from nm"),
    ("pw_", "select 0 i, scene, 1::double q0, 0.5::double q1, 0.25::double q2, 0.125::double q3 from ns union all select i+1, scene, a0/z, a1/z, a2/z, a3/z from (select *, sqrt(a0*a0+a1*a1+a2*a2+a3*a3) z from (select i, scene, "
            + ", ".join("+".join(f"{_at(k, j)}*q{j}" for j in range(4)) + f"+sh*q{k} a{k}" for k in range(4)) + " from pw_ join ns using (scene) where i<150))"),
    ("ev_", "select ns.*, case when q0<0 then -q0 else q0 end gw, case when q0<0 then -q1 else q1 end gx, case when q0<0 then -q2 else q2 end gy, case when q0<0 then -q3 else q3 end gz, ("
            + "+".join(f"{_at(i, j)}*q{i}*q{j}" for i in range(4) for j in range(4)) + ")/vr sc from pw_ join ns using (scene) where i=150"),
    ("ht", "select scene, cameras, sc, gw, gx, gy, gz, " + ", ".join(f"mo{c}-sc*{_turned(i, ('mcx', 'mcy', 'mcz'))} t{c}" for i, c in enumerate("xyz")) + " from ev_"),
]


@query("similarity_fit", "A25", duck("poses", f"select scene, cameras::bigint cameras, {r6('sc')} scale, {', '.join(f'{r6(c)} {c}' for c in ('tx', 'ty', 'tz', 'gw', 'gx', 'gy', 'gz'))} from ht", *_HORN, recursive=True))
def similarity_fit(spark, sf):
    return rounded(C.similarity_fit(poses(spark, sf)))


_PROD = ("gw*qw-gx*qx-gy*qy-gz*qz", "gw*qx+gx*qw+gy*qz-gz*qy", "gw*qy-gx*qz+gy*qw+gz*qx", "gw*qz+gx*qy-gy*qx+gz*qw")


@query("alignment_summary", "A25 A26", duck("poses", f"""select scene, {r6('sqrt(avg(e2))')} rmse, {r6('max(rot)')} rotation_error_max, {r6('median(rot)')} rotation_error_median,
    {r6('any_value(s)')} spacing, {r6('sqrt(avg(e2))/any_value(s)')} rmse_in_spacings from (select scene, {'+'.join(f"power(sc*{_turned(i, ('cx', 'cy', 'cz'))}+t{c}-o{c},2)" for i, c in enumerate('xyz'))} e2,
    2*degrees(acos(greatest(0,least(1,abs({'+'.join(f'({e})*p{n}' for e, n in zip(_PROD, 'wxyz'))}))))) rot from poses join ht using (scene)) join spacing using (scene) group by scene""", _NEAR, _SPACING, *_HORN, recursive=True))
def alignment_summary(spark, sf):
    p = poses(spark, sf)
    fit = C.similarity_fit(p)
    return rounded(C.alignment_summary(C.alignment_residuals(p, fit), C.median_spacing(p)))


def _known_fit(p):
    return p.select("scene").distinct().select("scene", F.lit(0).alias("cameras"), *[F.lit(v).alias(k) for k, v in _KNOWN.items()])


@query("known_alignment_summary", "A26", duck("poses", f"""select scene, {r6('sqrt(avg(e2))')} rmse, {r6('max(rot)')} rotation_error_max, {r6('median(rot)')} rotation_error_median,
    {r6('any_value(s)')} spacing, {r6('sqrt(avg(e2))/any_value(s)')} rmse_in_spacings from
    (select scene, power(1.7::double*(-cy)+0.5::double-ox,2)+power(1.7::double*cx-0.25::double-oy,2)+power(1.7::double*cz+1-oz,2) e2,
     2*degrees(acos(greatest(0,least(1,abs(0.7071067811865476::double*((qw-qz)*pw+(qx-qy)*px+(qy+qx)*py+(qz+qw)*pz)))))) rot from poses) join spacing using (scene) group by scene""", _NEAR, _SPACING))
def known_alignment_summary(spark, sf):
    p = poses(spark, sf)
    return rounded(C.alignment_summary(C.alignment_residuals(p, _known_fit(p)), C.median_spacing(p)))


@query("pose_transforms", "P24", duck("poses", f"""select scene, frame, {r6('1.7::double*(-cy)+0.5::double')} fx, {r6('1.7::double*cx-0.25::double')} fy, {r6('1.7::double*cz+1')} fz,
    {r6('(oy+0.25::double)/1.7::double')} bx, {r6('-(ox-0.5::double)/1.7::double')} "by", {r6('(oz-1)/1.7::double')} bz,
    {r6('abs(0.7071067811865476::double*((qw-qz)*pw+(qx-qy)*px+(qy+qx)*py+(qz+qw)*pz))')} agree from poses"""))
def pose_transforms(spark, sf):
    p = poses(spark, sf)
    d = p.join(_known_fit(p), "scene")
    fwd, q1 = G.transform_pose(C.RAW, G.quat("q"), "scale", G.quat("g"), ("tx", "ty", "tz"))
    back, _ = G.inverse_pose(C.OTHER, G.quat("p"), "scale", G.quat("g"), ("tx", "ty", "tz"))
    return rounded(d.select("scene", "frame", *[c.alias(f"f{n}") for c, n in zip(fwd, "xyz")], *[c.alias(f"b{n}") for c, n in zip(back, "xyz")],
                            F.abs(G.quat_dot(q1, G.quat("p"))).alias("agree")))


_H = ("(pw+pz)", "(px+py)", "(py-px)", "(pz-pw)")
_unit = lambda names: "sqrt(" + "+".join(f"{n}*{n}" for n in names) + ")"
_ANCHOR = [
    ("h", f"select *, {', '.join(f'0.7071067811865476::double*{e} h{n}' for e, n in zip(_H, 'wxyz'))}, 0.5::double*(cx+(oy+0.25::double)/1.7::double) ax, 0.5::double*(cy-(ox-0.5::double)/1.7::double) ay, 0.5::double*(cz+(oz-1)/1.7::double) az from poses"),
    ("s", "select *, case when qw*hw+qx*hx+qy*hy+qz*hz<0 then -1 else 1 end g from h"),
    ("u", "select scene, frame, ax, ay, az, " + ", ".join(f"q{n}+g*h{n} u{n}" for n in "wxyz") + " from s"),
    ("an", "select scene, frame, ax, ay, az, " + ", ".join(f"u{n}/{_unit(['uw', 'ux', 'uy', 'uz'])} a{n}q" for n in "wxyz") + " from u"),
    ("pr", "select *, " + ", ".join(f"lead({c}) over w l_{c}" for c in ("frame", "ax", "ay", "az", "awq", "axq", "ayq", "azq")) + ", row_number() over w i from an window w as (partition by scene order by frame)"),
    ("m", "select *, case when awq*l_awq+axq*l_axq+ayq*l_ayq+azq*l_azq<0 then -1 else 1 end g from pr where l_frame is not null"),
    ("v", "select *, " + ", ".join(f"a{n}q+g*l_a{n}q v{n}" for n in "wxyz") + " from m"),
]


@query("midpoint_views", "W19 P24", duck("poses", f"""select scene, i::bigint candidate_index, frame source_frame_start, l_frame source_frame_end, l_frame-frame source_frame_gap,
    {r6('0.5::double*(ax+l_ax)')} cx, {r6('0.5::double*(ay+l_ay)')} cy, {r6('0.5::double*(az+l_az)')} cz, {r6('1.7::double*(-0.5::double*(ay+l_ay))+0.5::double')} ox,
    {r6('1.7::double*0.5::double*(ax+l_ax)-0.25::double')} oy, {r6('1.7::double*0.5::double*(az+l_az)+1')} oz,
    {', '.join(f"{r6(f'abs(v{n})/' + _unit(['vw', 'vx', 'vy', 'vz']))} q{n}" for n in 'wxyz')} from v""", *_ANCHOR))
def midpoint_views(spark, sf):
    p = poses(spark, sf)
    v = C.midpoint_poses(p, _known_fit(p))
    return rounded(v.select("scene", "candidate_index", "source_frame_start", "source_frame_end", "source_frame_gap", *C.RAW, *C.OTHER,
                            *[F.abs(f"q{n}").alias(f"q{n}") for n in "wxyz"]))


_undone = lambda j: "(" + "+".join(f"({_ROT[i][j]})*(o{c}-t{c})/sc" for i, c in enumerate("xyz")) + ")"
_PLAN = [
    ("pa", f"select scene, frame, {', '.join(f'0.5::double*(c{c}+{_undone(j)}) a{c}' for j, c in enumerate('xyz'))} from poses join ht using (scene)"),
    ("pb", "select scene, row_number() over w candidate_index, " + ", ".join(f"0.5::double*(a{c}+lead(a{c}) over w) c{c}" for c in "xyz") + " from pa window w as (partition by scene order by frame)"),
    ("pc", "select b.scene, candidate_index, any_value(b.cx) cx, any_value(b.cy) cy, any_value(b.cz) cz, sqrt(min(power(b.cx-p.cx,2)+power(b.cy-p.cy,2)+power(b.cz-p.cz,2))) dist from pb b join poses p using (scene) where b.cx is not null group by 1,2"),
    ("pd", "select scene, candidate_index, cx, cy, cz, row_number() over (partition by scene order by candidate_index)-1 i, count(*) over (partition by scene) n from pc join spacing using (scene) where dist/s<=2.25::double"),
]


@query("planned_trajectory", "W19 W20 A25 J11", duck("poses", f"select scene, candidate_index::bigint candidate_index, k+1 sequence_index, {r6('cx')} cx, {r6('cy')} cy, {r6('cz')} cz, 'planned' status from pd join (select range::bigint k from range(30)) on round_even(k*(n-1)/29::double,0)=i where n>=30 "
    "union all select distinct scene, null::bigint, null::bigint, null::double, null::double, null::double, 'too few views' from poses anti join (select scene from pd where n>=30) using (scene)",
    _NEAR, _SPACING, *_HORN, *_PLAN, recursive=True))
def planned_trajectory(spark, sf):
    """Fitted midpoint path of every scene, jointly supported views only, thirty evenly spaced ones; a status row for a scene with fewer."""
    from glintframe.operators.pairing import uniform_pick
    p = poses(spark, sf)
    v = materialize(C.midpoint_poses(p, C.similarity_fit(p)))
    raw = C.support_measurement(v, p, C.median_spacing(p), query="candidate_index")
    kept = v.join(raw.where("distance_in_spacings <= 2.25").select("scene", "candidate_index"), ["scene", "candidate_index"])
    kept = materialize(kept)
    short = p.select("scene").distinct().join(kept.groupBy("scene").agg(F.count(F.lit(1)).alias("n")).where("n >= 30"), "scene", "left_anti")
    picked = uniform_pick(kept.join(short, "scene", "left_anti"), "candidate_index", 30)
    picked = picked.select("scene", "candidate_index", "sequence_index", "cx", "cy", "cz", F.lit("planned").alias("status"))
    return rounded(picked.unionByName(short.withColumn("status", F.lit("too few views")), allowMissingColumns=True))


_dot = lambda a, b: f"degrees(acos(greatest(-1,least(1,{'+'.join(f'({x})*({y})' for x, y in zip(_AXIS(a), _AXIS(b)))}))))"


def _near_view(name, at):
    return (f"n{name}", f"""select scene, candidate_index, min_by(nf, (d2, nf)) nf, sqrt(min(d2)) dist from (select a.scene, candidate_index, b.frame nf,
        {'+'.join(f'power(a.{at}{c}-b.{at}{c},2)' for c in 'xyz')} d2 from cand a join poses b using (scene)) group by 1,2""")


_COMMON = [
    ("cand0", f"select scene, i::bigint candidate_index, {', '.join(f'0.5::double*(a{c}+l_a{c}) c{c}' for c in 'xyz')}, {', '.join(f'v{n}/{_unit(chr(118) + m for m in chr(119) + chr(120) + chr(121) + chr(122))} q{n}' for n in 'wxyz')} from v"),
    ("cand", "select *, 1.7::double*(-cy)+0.5::double ox, 1.7::double*cx-0.25::double oy, 1.7::double*cz+1 oz, 0.7071067811865476::double*(qw-qz) pw, 0.7071067811865476::double*(qx-qy) px, "
             "0.7071067811865476::double*(qy+qx) py, 0.7071067811865476::double*(qz+qw) pz from cand0"),
    ("sother", """select scene, median(d) s from (select a.scene, a.frame, sqrt(min(power(a.ox-b.ox,2)+power(a.oy-b.oy,2)+power(a.oz-b.oz,2))) d
        from poses a join poses b on a.scene=b.scene and a.frame<>b.frame group by 1,2) group by scene"""),
    _near_view("raw", "c"), _near_view("other", "o"),
    ("meas", f"""select c.scene, c.candidate_index, r.dist/s1.s rd, {_dot('c.q', 'tr.q')} ra, o.dist/s2.s od, {_dot('c.p', 'tx.p')} oa from cand c
        join nraw r using (scene, candidate_index) join nother o using (scene, candidate_index) join poses tr on tr.scene=c.scene and tr.frame=r.nf
        join poses tx on tx.scene=c.scene and tx.frame=o.nf join spacing s1 on s1.scene=c.scene join sother s2 on s2.scene=c.scene"""),
    ("elig", "select *, row_number() over (partition by scene order by candidate_index)-1 i, count(*) over (partition by scene) n from meas where rd<=2.25::double and od<=2.25::double and ra<=27.5::double and oa<=27.5::double"),
    ("pick", "select *, k+1 sequence_index, k::double path_fraction from elig join (select range::bigint k from range(2)) on k*(n-1)=i where n>=2"),
]


def _common(p):
    return C.plan_common_support(p, 2, _known_fit(p))


@query("common_support_views", "W19 W20 J11 P17 P18", duck("poses", f"""select scene, candidate_index, sequence_index::bigint sequence_index, path_fraction, {r6('rd')} raw_distance_in_spacings, {r6('ra')} raw_angle,
    {r6('od')} other_distance_in_spacings, {r6('oa')} other_angle from pick""", _NEAR, _SPACING, *_ANCHOR, *_COMMON))
def common_support_views(spark, sf):
    """Two evenly spaced views of every scene that are supported in both branches by distance and by angle."""
    views, _ = _common(poses(spark, sf))
    return rounded(views.select("scene", "candidate_index", "sequence_index", "path_fraction", *[f"{b}_{c}" for b in ("raw", "other") for c in ("distance_in_spacings", "angle")]))


@query("common_support_report", "W19 A39 U4", duck("poses", f"""select m.scene, m.candidates, m.eligible, coalesce(p.n,0)::bigint picked, coalesce(p.n,0)::bigint supported, {r6('p.rd')} maximum_raw_distance_in_spacings,
    {r6('p.ra')} maximum_raw_angle, {r6('p.od')} maximum_other_distance_in_spacings, {r6('p.oa')} maximum_other_angle, case when m.eligible<2 then 'too few views' else 'planned' end status from
    (select scene, count(*)::bigint candidates, count(*) filter (where rd<=2.25::double and od<=2.25::double and ra<=27.5::double and oa<=27.5::double)::bigint eligible from meas group by 1) m
    left join (select scene, count(*) n, max(rd) rd, max(ra) ra, max(od) od, max(oa) oa from pick group by 1) p using (scene)""", _NEAR, _SPACING, *_ANCHOR, *_COMMON))
def common_support_report(spark, sf):
    """What became of every scene: planned, or why not."""
    return rounded(_common(poses(spark, sf))[1])


@query("azimuth_coverage", "A27", duck("poses", f"""select scene, {r6('max(gap)')} largest_gap, {r6('360-max(gap)')} coverage from
    (select scene, coalesce(lead(a) over (partition by scene order by a), min(a) over (partition by scene)+360)-a gap from
     (select scene, d-360*floor(d/360) a from (select scene, degrees(atan2(cy-avg(cy) over (partition by scene), cx-avg(cx) over (partition by scene))) d from poses))) group by scene"""))
def azimuth_coverage(spark, sf):
    return rounded(C.azimuth_coverage(poses(spark, sf)))
