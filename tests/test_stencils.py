import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.operators import stencil as W
from glintframe.operators.structure import structure_penalty

MODES = {"reflect": "symmetric", "reflect101": "reflect", "replicate": "edge", "edge": "edge"}


def board(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.select("y", "x", name).collect():
        out[r["y"], r["x"]] = r[name]
    return out


def window_mean(a, k, mode):
    p = k // 2
    pad = np.pad(a, p, mode=mode)
    return np.array([[pad[y:y + k, x:x + k].mean() for x in range(a.shape[1])] for y in range(a.shape[0])])


@pytest.mark.parametrize("border", list(MODES))
@pytest.mark.parametrize("shape,k", [((5, 7), 3), ((4, 6), 15), ((3, 5), 31)])
def test_box_mean_matches_padding(frame, border, shape, k):
    a = np.random.default_rng(1).random(shape)
    got = board(W.box_mean(frame(a), {"m": "v"}, k, border), "m", shape)
    np.testing.assert_allclose(got, window_mean(a, k, MODES[border]), atol=1e-12)


@pytest.mark.parametrize("border", ["reflect101", "replicate"])
def test_gaussian_blur(frame, border):
    a = np.random.default_rng(2).random((6, 9))
    bell = np.array(W.taps(0.8))
    r = len(bell) // 2
    pad = np.pad(a, r, mode=MODES[border])
    want = np.array([[(pad[y:y + 2 * r + 1, x:x + 2 * r + 1] * np.outer(bell, bell)).sum() for x in range(9)] for y in range(6)])
    np.testing.assert_allclose(board(W.gaussian_blur(frame(a), {"b": "v"}, 0.8, border), "b", a.shape), want, atol=1e-12)
    assert len(W.taps(2.0)) == 17 and len(W.taps(0.5)) == 5


def test_gradient_is_numpy_gradient(frame):
    a = np.random.default_rng(3).random((5, 6))
    d = W.gradient(frame(a), "v")
    gy, gx = np.gradient(a)
    np.testing.assert_allclose(board(d, "gx", a.shape), gx, atol=1e-12)
    np.testing.assert_allclose(board(d, "gy", a.shape), gy, atol=1e-12)


def test_sobel_of_a_ramp(frame):
    d = W.sobel(frame(np.tile(np.arange(6.0), (5, 1))), "v")
    inner = board(d, "gx", (5, 6))[:, 1:-1]
    assert np.all(inner == 8) and np.all(board(d, "gy", (5, 6)) == 0)
    assert np.all(board(d, "gx", (5, 6))[:, [0, -1]] == 0)  # mirrored without repeating the edge


def test_morphology_uses_the_plus_shape(frame):
    a = np.zeros((5, 5), int)
    a[2, 2] = 1
    grown = board(W.dilate(frame(a), "v"), "v", a.shape)
    assert grown.sum() == 5 and grown[1, 1] == 0
    assert board(W.morph_open(frame(a), "v"), "v", a.shape).sum() == 0


def test_resampling(frame):
    a = np.random.default_rng(4).random((6, 6))
    f = frame(a)
    small = W.downsample_area(f, 3, ["v"])
    np.testing.assert_allclose(board(small, "v", (2, 2)), a.reshape(2, 3, 2, 3).mean((1, 3)), atol=1e-12)
    up = board(W.upsample(f.drop("v"), small, 3, ["v"]), "v", a.shape)
    s = a.reshape(2, 3, 2, 3).mean((1, 3))
    assert up[0, 0] == pytest.approx(s[0, 0]) and up[1, 1] == pytest.approx(s[0, 0])
    assert up[1, 2] == pytest.approx(s[0, 0] * 2 / 3 + s[0, 1] / 3)


def test_flat_frame_has_no_structure(frame):
    d = structure_penalty(frame(np.full((6, 6), 0.4), "lum"))
    assert d.agg(F.max("structure")).first()[0] < 1e-4


def test_stencil_plan_places_frames_once(frame):
    d = structure_penalty(frame(np.random.default_rng(5).random((6, 6)), "lum"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "ENSURE_REQUIREMENTS" not in plan and "Join" not in plan


def odd_frame(spark, sizes):
    """Frames of the given sizes with the columns that the weights need."""
    rows = []
    for number, (h, w) in enumerate(sizes):
        rng = np.random.default_rng(number)
        v = rng.random((h, w, 9))
        rows += [(1, number, y, x, h, w, *v[y, x].tolist(), *(0.6 * v[y, x, :3]).tolist()) for y in range(h) for x in range(w)]
    names = ["r", "g", "b", "score", "cross", "confidence", "cross_support", "removed_support", "structure", "sr", "sg", "sb"]
    return spark.createDataFrame(rows, ["scene", "frame", "y", "x", "h", "w", *names])


def test_no_pixel_is_lost_for_any_size(spark):
    from glintframe.operators.feather import feather_weights, hysteresis_weights
    from glintframe.operators.matte import matte_weights

    sizes = [(10, 10), (9, 13), (3, 18)]
    df = odd_frame(spark, sizes)
    want = {i: h * w for i, (h, w) in enumerate(sizes)}
    for weights in (matte_weights, feather_weights, hysteresis_weights):
        out = weights(df, factor=4)
        got = {r.frame: r.n for r in out.groupBy("frame").agg(F.countDistinct("y", "x").alias("n")).collect()}
        assert got == want, weights.__name__
        assert out.where("base_weight is null or base_weight < 0 or base_weight > 1").count() == 0


def test_area_means_count_shares(spark, frame):
    a = np.arange(35.0).reshape(5, 7)
    small = W.downsample_area(frame(a), 2, ["v"])  # 2 x 3 cells of 2.5 x 7/3 pixels
    fine = np.repeat(np.repeat(a, 2, axis=0), 3, axis=1).reshape(2, 5, 3, 7).mean(axis=(1, 3))
    got = {(r.y, r.x): r.v for r in small.collect()}
    assert len(got) == 6
    for (y, x), v in got.items():
        assert abs(v - fine[y, x]) < 1e-9


def test_relaxation_solves_the_four_neighbour_equation(spark):
    import pandas as pd
    from glintframe.operators.matte import _relax

    rng = np.random.default_rng(5)
    h, w = 6, 7
    right, down = rng.random((h, w)), rng.random((h, w))
    right[:, -1], down[-1] = 0, 0
    want, trust, pinned = rng.random((h, w)), rng.random((h, w)) + 0.3, rng.random((h, w)) < 0.2
    m = want.copy()
    for _ in range(9):
        new = m.copy()
        for y in range(h):
            for x in range(w):
                near = [(y, x + 1, right[y, x]), (y + 1, x, down[y, x])]
                near += [(y, x - 1, right[y, x - 1])] * (x > 0) + [(y - 1, x, down[y - 1, x])] * (y > 0)
                near = [(a, b, 1.5 * k) for a, b, k in near if k]
                if not pinned[y, x]:
                    new[y, x] = (trust[y, x] * want[y, x] + sum(k * m[a, b] for a, b, k in near)) / (trust[y, x] + sum(k for *_, k in near))
        m = new
    yy, xx = np.mgrid[:h, :w]
    pdf = pd.DataFrame({"scene": 1, "frame": 1, "y": yy.ravel(), "x": xx.ravel(), "likelihood": want.ravel(), "trust": trust.ravel(),
                        "right": right.ravel(), "down": down.ravel(), "pinned": pinned.ravel().astype(int), "own": True}).sample(frac=1, random_state=1)
    out = _relax(9, 1.5)(pdf)
    for r in out.itertuples():
        assert abs(r.matte - m[r.y, r.x]) < 1e-12


def test_chamfer_map_equals_brute_force(spark):
    from glintframe.operators.feather import chamfer_map

    def chamfer(dy, dx):
        long, short = max(abs(dy), abs(dx)), min(abs(dy), abs(dx))
        return 2.1969 * short + long - 2 * short if 2 * short <= long else 2.1969 * (long - short) + 1.4 * (2 * short - long)

    rng = np.random.default_rng(8)
    within = {1: 3.0, 2: 6.4, 3: 0.0}
    rim = {(g, int(y), int(x)) for g in within for y, x in rng.integers(0, 40, (25, 2))}
    rows = [(1, 1, g, y, x, within[g]) for g, y, x in rim]
    got = chamfer_map(spark.createDataFrame(rows, "scene long, frame long, region_id long, y int, x int, r double"), ["scene", "frame", "region_id"], "r")
    want = {}
    for g, y, x in rim:
        for dy in range(-7, 8):
            for dx in range(-7, 8):
                if chamfer(dy, dx) <= within[g] + 1e-6:
                    at = (g, y + dy, x + dx)
                    want[at] = min(want.get(at, 99.0), chamfer(dy, dx))
    found = {(r.region_id, r.y, r.x): r.distance for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_widths_by_frame_equal_those_of_one_frame(spark):
    sizes = [(5, 9), (12, 7), (1, 6), (8, 1)]
    df = odd_frame(spark, sizes).withColumn("confidence", F.when(F.col("x") % 4 != 1, F.col("confidence")))
    k, sigma = 3 + 4 * F.col("frame"), 0.5 + 0.4 * F.col("frame")
    for border in ("reflect", "replicate"):
        mixed = {tuple(r)[:3]: r for r in W.box_mean(df, {"a": "score", "b": "confidence"}, k, border).select("frame", "y", "x", "a", "b").collect()}
        assert len(mixed) == sum(h * w for h, w in sizes)
        for n in range(len(sizes)):
            for r in W.box_mean(df.where(F.col("frame") == n), {"a": "score"}, 3 + 4 * n, border).select("frame", "y", "x", "a").collect():
                assert mixed[tuple(r)[:3]].a == pytest.approx(r.a, abs=1e-12)
    mixed = {tuple(r)[:3]: r.a for r in W.gaussian_blur(df, {"a": "score"}, sigma).select("frame", "y", "x", "a").collect()}
    for n in range(len(sizes)):
        for r in W.gaussian_blur(df.where(F.col("frame") == n), {"a": "score"}, 0.5 + 0.4 * n).select("frame", "y", "x", "a").collect():
            assert mixed[tuple(r)[:3]] == pytest.approx(r.a, abs=1e-12)


def test_mixed_sizes_are_one_plan_without_a_job(spark):
    df = odd_frame(spark, [(4, 6), (7, 5)])
    d = W.guided_filter(W.gaussian_blur(df, {"soft": "score"}, F.least("h", "w") / 8.0), "soft", "score", F.least("h", "w"), 0.01)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    for n, side in ((0, 4), (1, 5)):
        one = W.guided_filter(W.gaussian_blur(df.where(F.col("frame") == n), {"soft": "score"}, side / 8.0), "soft", "score", side, 0.01)
        want = {(r.y, r.x): r.filtered for r in one.collect()}
        got = {(r.y, r.x): r.filtered for r in d.where(F.col("frame") == n).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_pixels_of_exploded_frames_are_not_broadcast(spark, tmp_path):
    from glintframe.catalog.neighbourhoods import mixed_resampling
    rows = [(k, k % 5, float(k)) for k in range(40)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    d = mixed_resampling(spark, str(tmp_path))
    assert d.count() == sum((9 + k % 7) * (10 + k % 11) for k in range(40))
    assert "BroadcastExchange" not in d._jdf.queryExecution().executedPlan().toString()


def _windows(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Window [")


def test_sobels_of_several_maps_share_their_passes(frame):
    rng = np.random.default_rng(12)
    df = frame(rng.random((5, 7)), "v", u=rng.random((5, 7)))
    both = W.sobels(W.colocate(df), {"v": ("gx", "gy", "gm"), "u": ("hx", "hy", None)})
    assert _windows(both) == 2
    for got, name in (("gx gy gm", "v"), ("hx hy", "u")):
        names = got.split()
        alone = W.sobel(df, name, names[0], names[1], "m" if len(names) < 3 else names[2])
        for c in names:
            np.testing.assert_array_equal(board(both, c, (5, 7)), board(alone, c, (5, 7)))


@pytest.mark.parametrize("border", ["reflect", "reflect101"])
def test_borders_within_a_period_are_plain_arithmetic(spark, border):
    mode = {"reflect": "symmetric", "reflect101": "reflect"}[border]
    for n in (1, 2, 3, 8):
        for pad in (1, 2, 8, 30):
            shown = spark.range(n).select(F.col("id").cast("int").alias("p"), F.explode(W._images(F.col("id").cast("int"), F.lit(n), pad, border)).alias("t")).where("t is not null")
            got = sorted((r.t, r.p) for r in shown.collect())
            assert got == list(enumerate(np.pad(np.arange(n), pad, mode).tolist(), -pad)), (n, pad)


def test_a_map_that_guides_itself_is_averaged_once(frame):
    d = W.guided_base(W.colocate(frame(np.random.default_rng(3).random((4, 5)))), "v", 3)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "_mv" not in plan and "_cx" not in plan
