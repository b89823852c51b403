import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.functions import geometry as G, scalar as S
from glintframe.operators import pairing as P, poses as C, suppression as A, tracks as T, views as V
from glintframe.operators.quantiles import exact_quantiles, with_frame_quantile

PROBS = {"a": 0.025, "b": 0.25, "c": 0.5, "d": 0.7, "e": 0.975, "f": 1.0, "g": 0.0}


def test_quantiles_of_all_group_sizes_match_numpy(spark):
    rng = np.random.default_rng(3)
    values = {1: rng.normal(size=4001), 2: np.round(rng.random(999), 1), 3: np.array([5.0]), 4: np.r_[-1e-300, 0.0, 1e300, -7.5]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [(1, None), (2, float("nan"))], "k int, v double")
    df = df.union(spark.createDataFrame([(9, None)], "k int, v double"))
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", PROBS, count_as="n").collect()}
    assert set(got) == {*values, 9} and got[9].n == 0 and got[9].c is None
    for k, vs in values.items():
        assert got[k].n == len(vs)
        np.testing.assert_allclose([got[k][n] for n in PROBS], [np.quantile(vs, p) for p in PROBS.values()], rtol=1e-12)
    whole = exact_quantiles(df, [], "v", PROBS).first()
    every = np.concatenate(list(values.values()))
    np.testing.assert_allclose([whole[n] for n in PROBS], [np.quantile(every, p) for p in PROBS.values()], rtol=1e-12)


def test_frame_quantile_ignores_null(spark):
    df = spark.createDataFrame([(1, 1, float(i) if i else None) for i in range(8)], "scene int, frame int, v double")
    assert {r.q for r in with_frame_quantile(df, {"q": (F.col("v"), 0.5)}).collect()} == {4.0}


def test_tier_edges_are_inclusive_and_tiers_nest(spark):
    rows = [("s", 0.075, 0.075), ("s", 0.16, 0.075), ("s", 0.25, 0.2), ("s", 0.5, 0.4), ("s", 0.01, 0.0), ("s", 0.075, 0.07)]
    df = spark.createDataFrame(rows, "scene string, raw double, outp double")
    assert [r.b for r in df.select(S.classify("raw").alias("b")).collect()] == [1, 2, 2, 2, 0, 1]
    share = {r.tier: r.all_percent for r in A.tier_coverage(df).collect()}
    assert share["any_positive"] >= share["detectable"] >= share["mild"] >= share["meaningful"] >= share["strong"]
    only = {r.tier: r.all_percent for r in A.tier_coverage(df, absolute=0.9).collect()}
    assert only["meaningful"] == 0 and only["strong"] == share["strong"]


def test_summary_invariants(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(int(i % 3), float(a), float(b)) for i, (a, b) in enumerate(rng.random((600, 2)) * 0.3)], "scene int, raw double, outp double")
    m = A.transition_matrix(df)
    assert m.agg(F.sum("pixels")).first()[0] == 600
    for r in A.severity(m).collect():
        assert r.net_severity_reduction == pytest.approx(r.source_region_severity_reduction - r.new_severity_burden)


def test_empty_source_gives_null(spark):
    df = spark.createDataFrame([("s", 1, 0.0, 0.0)], "scene string, frame int, raw double, outp double")
    r = A.suppression_summary(df).first()
    assert r.any_area_reduction is None and r.source_evidence_attenuation is None and r.meaningful_improvement_rate is None
    assert A.evidence_attenuation(df).first().source_evidence_attenuation is None


def test_thresholds_are_checked():
    with pytest.raises(ValueError):
        A.check_thresholds(0.2, 0.1)
    with pytest.raises(ValueError):
        S.smoothstep(1, 1, F.lit(0))


def test_point_statistics_with_outlier(spark):
    rows = [(f, 1, v) for f, v in enumerate([0.2, 0.21, 0.19, 0.2, 0.9])] + [(f, 2, 0.5) for f in range(3)]
    o = spark.createDataFrame(rows, "frame int, point_id int, lum double")
    stats = {r.point_id: r for r in T.point_stats(o).collect()}
    assert stats[1].usable and not stats[2].usable
    assert stats[1].median == pytest.approx(0.2) and stats[1].mad == pytest.approx(0.01)
    res = {r.frame: r.residual for r in T.observation_residuals(o).collect()}
    assert len(res) == 5 and res[4] == pytest.approx(0.9 - 0.2 - (0.01 + 1.5 * 1.4826 * 0.01)) and res[1] == 0


def test_robust_affine_ignores_outliers(spark):
    rng = np.random.default_rng(8)
    x = rng.random(200)
    y = 1.2 * x + 0.05 + rng.normal(size=200) * 1e-3
    y[:20] += 0.6
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)] + [(2, 0.1, 0.9)], "frame int, x double, y double")
    fit = {r.frame: r for r in T.robust_affine(df, ["frame"], "x", "y").collect()}
    assert fit[1].gain == pytest.approx(1.2, abs=5e-3) and fit[1].offset == pytest.approx(0.05, abs=5e-3)
    assert fit[2].gain == 1.0 and fit[2].offset == 0.0


def test_bootstrap_of_equal_clusters_has_no_width(spark):
    row = dict(scene="s", pixels=100, raw_mean=0.2, out_mean=0.1, raw_any=10.0, out_any=5.0, raw_strong=4.0, out_strong=1.0, source_px=10,
               improved_px=5, strict_px=4, strong_px=4, strong_suppressed_px=2, source_score=3.0, residual_score=1.5)
    df = spark.createDataFrame([{**row, "direction": d, "view_id": d} for d in range(6)])
    for r in V.cluster_bootstrap(df, replicates=200).collect():
        assert r.low == pytest.approx(r.high) and r.point == pytest.approx(r.low)


def test_path_thirds_split_like_equal_parts(spark):
    df = spark.createDataFrame([("s", i) for i in range(11)], "scene string, view_id int")
    got = [r.path_third for r in V.with_path_third(df).orderBy("view_id").collect()]
    assert got == [i + 1 for i, part in enumerate(np.array_split(np.arange(11), 3)) for _ in part]


def test_uniform_pick_and_its_errors(spark):
    df = spark.createDataFrame([("s", i * 5000) for i in range(23)], "scene string, k long")
    got = [r.k // 5000 for r in P.uniform_pick(df, "k", 9).orderBy("k").collect()]
    assert got == np.rint(np.linspace(0, 22, 9)).astype(int).tolist()
    with pytest.raises(Exception):
        P.uniform_pick(df, "k", 24).collect()
    with pytest.raises(Exception):
        spark.createDataFrame([("x.png",)], "n string").select(S.frame_key("n")).collect()


def _poses(spark, centres, quats, turn, scale, shift):
    rows = []
    for i, (c, q) in enumerate(zip(centres, quats)):
        o = scale * turn @ c + shift
        rows.append((1, i, *map(float, c), *map(float, o), *map(float, q), *map(float, q)))
    names = "scene int, frame int, " + ", ".join(f"{n} double" for n in ("cx", "cy", "cz", "ox", "oy", "oz", "qw", "qx", "qy", "qz", "pw", "px", "py", "pz"))
    return spark.createDataFrame(rows, names)


def test_similarity_is_recovered(spark):
    rng = np.random.default_rng(2)
    a = math.radians(100)
    turn = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]]) @ np.array([[1, 0, 0], [0, 0, -1], [0, 1, 0]])
    q = rng.normal(size=(20, 4))
    p = _poses(spark, rng.random((20, 3)), q / np.linalg.norm(q, axis=1, keepdims=True), turn, 2.5, np.array([1.0, -2, 3]))
    fit = C.similarity_fit(p)
    r = fit.first()
    assert r.scale == pytest.approx(2.5, abs=1e-9) and [r.tx, r.ty, r.tz] == pytest.approx([1, -2, 3], abs=1e-9)
    m = fit.select(*[c.alias(f"m{i}{j}") for i, row in enumerate(G.quat_matrix(G.quat("g"))) for j, c in enumerate(row)]).first()
    np.testing.assert_allclose(np.array(m).reshape(3, 3), turn, atol=1e-9)
    assert C.alignment_residuals(p, fit).agg(F.max("centre_error2")).first()[0] < 1e-16


def test_matrix_and_quaternion_agree(spark):
    rng = np.random.default_rng(4)
    q = rng.normal(size=(50, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    q *= np.where(q[:, :1] < 0, -1, 1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in q], "qw double, qx double, qy double, qz double")
    m = df.select("*", F.array(*[F.array(*row) for row in G.quat_matrix(G.quat("q"))]).alias("m"))
    back = m.select(*G.quat("q"), *[c.alias(f"b{i}") for i, c in enumerate(G.matrix_quat("m"))]).collect()
    for r in back:
        np.testing.assert_allclose(r[4:], r[:4], atol=1e-9)


def test_nearest_camera_matches_all_pairs(spark):
    rng = np.random.default_rng(6)
    c = np.r_[rng.random((150, 3)), np.repeat(rng.random((1, 3)), 30, 0), 5 + 1e-4 * rng.random((40, 3))]
    df = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(c)], "scene int, frame int, cx double, cy double, cz double")
    d = np.linalg.norm(c[:, None] - c[None], axis=2)
    np.fill_diagonal(d, np.inf)
    for r in C.nearest(df, df, other_only=True).collect():
        assert r.nearest_distance == pytest.approx(d[r.frame].min(), abs=1e-12)
    q = rng.random((60, 3)) * 6
    queries = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(q)], "scene int, frame int, cx double, cy double, cz double")
    far = np.linalg.norm(q[:, None] - c[None], axis=2)
    got = {r.frame: r for r in C.nearest(queries, df).collect()}
    assert len(got) == 60
    for i in range(60):
        assert got[i].nearest_frame == far[i].argmin()


def test_display_rounds_like_printf(spark):
    values = [2.675, 0.125, -1.005, 0.0, 12345.678]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(S.format_display("v", 2)).collect()] == [f"{v:.2f}" for v in values]


def test_nearest_camera_with_an_outlier(spark):
    rng = np.random.default_rng(11)
    at = rng.normal(size=(400, 3))
    at[7] = 1e7, -1e7, 1e7
    rows = [(1, i, *map(float, x)) for i, x in enumerate(at)]
    df = spark.createDataFrame(rows, "scene int, frame int, cx double, cy double, cz double")
    d = np.linalg.norm(at[:, None] - at[None], axis=2)
    np.fill_diagonal(d, np.inf)
    got = {r.frame: r.nearest_distance for r in C.nearest(df, df, other_only=True).collect()}
    assert len(got) == 400 and all(abs(got[i] - d[i].min()) <= 1e-9 * max(1, d[i].min()) for i in range(400))


def test_positions_with_outliers_text_and_ties(spark):
    from glintframe.operators.pairing import scene_position

    values = [1e300, *map(float, range(200)), 5.0, 5.0]
    df = spark.createDataFrame([("s", v) for v in values] + [("t", 1.0)], "scene string, v double").repartition(5)
    got = [(r.v, r.position) for r in scene_position(df, ["v"]).where("scene = 's'").collect()]
    assert [v for v, _ in sorted(got, key=lambda x: x[1])] == sorted(values) and {p for _, p in got} == set(range(len(values)))
    assert {r.position_count for r in scene_position(df, ["v"]).where("scene = 't'").collect()} == {1}


def test_path_thirds_follow_text_ids(spark):
    names = [f"p{i:03d}" for i in range(1, 9)]
    df = spark.createDataFrame([("s", n) for n in reversed(names)], "scene string, view_id string")
    got = {r.view_id: r.path_third for r in V.with_path_third(df).collect()}
    assert [got[n] for n in names] == [1, 1, 1, 2, 2, 2, 3, 3]


def test_statistics_start_no_job_before_the_action(spark):
    tracker = spark.sparkContext.statusTracker()
    df = spark.createDataFrame([(1, i, float(i % 7)) for i in range(50)], "point_id int, frame int, lum double")
    spark.sparkContext.setJobGroup("plan only", "")
    out = T.point_stats(df)
    assert list(tracker.getJobIdsForGroup("plan only")) == []
    assert out.count() == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_group_quantiles_of_small_and_large_groups(spark):
    import numpy as np

    from glintframe.operators.quantiles import group_quantiles

    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 3, 63, 64, 65, 900]
    groups = {k: np.where(rng.random(n) < 0.3, 5.0, rng.normal(size=n) * 10.0 ** rng.integers(-3, 9, n)) for k, n in enumerate(sizes)}
    rows = [(k, float(v)) for k, g in groups.items() for v in g] + [(k, None) for k in groups] + [(3, float("nan")), (None, 1.0)]
    got = group_quantiles(spark.createDataFrame(rows, "k int, v double").repartition(6), ["k"], "v", {"lo": 0.0, "q": 0.9, "mid": 0.5, "hi": 1.0}, count_as="n")
    found = {r.k: r for r in got.collect()}
    assert set(found) == set(groups)
    for k, g in groups.items():
        assert found[k].n == len(g)
        for name, p in (("lo", 0.0), ("q", 0.9), ("mid", 0.5), ("hi", 1.0)):
            assert found[k][name] is None if not len(g) else found[k][name] == pytest.approx(np.quantile(g, p), rel=1e-12)


def test_robust_lines_of_small_and_large_groups_agree(spark):
    from pyspark.sql import functions as F
    from glintframe.operators.tracks import robust_affine
    rows = (spark.range(3000).select((F.col("id") % 5).alias("frame"), (F.hash("id") % 1000 / 1000.0).alias("a"), "id")
            .withColumn("b", F.when(F.col("id") % 10 == 3, 4.0).otherwise(1.2 * F.col("a") - 0.05 + F.hash(F.col("id") + 7) % 100 / 5000.0)))
    odd = spark.createDataFrame([(7, 0.5, 0.1 * i) for i in range(120)] + [(8, 0.1 * i, 0.2) for i in range(20)] + [(None, 0.1 * i, 0.3 * i) for i in range(150)]
                                + [(9, float("nan"), 1.0)], "frame long, a double, b double")
    rows = rows.select("frame", "a", "b").union(odd)
    context = spark.sparkContext
    context.setJobGroup("lines", "lines")
    placed = {r.frame: (r.gain, r.offset) for r in robust_affine(rows, ["frame"], "a", "b").collect()}
    jobs = len(context.statusTracker().getJobIdsForGroup("lines"))
    context.setJobGroup("", "")
    spread = {r.frame: (r.gain, r.offset) for r in robust_affine(rows, ["frame"], "a", "b", group_rows=150).collect()}
    assert placed.keys() == spread.keys() == {None, *range(5), 7, 8}
    assert all(placed[k] == pytest.approx(spread[k], abs=1e-9) for k in placed)
    assert placed[None] == placed[8] == (1.0, 0.0) and placed[0][0] == pytest.approx(1.2, abs=0.02)
    assert jobs < 20  # no jobs for each round
