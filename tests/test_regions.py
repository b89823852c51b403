import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.operators import regions as R
from glintframe.operators.matte import _ellipse, matte_diffuse, parameters


def flood(mask):
    lab = np.zeros(mask.shape, int)
    for start in zip(*np.nonzero(mask)):
        if lab[start]:
            continue
        todo, name = [start], start[0] * mask.shape[1] + start[1] + 1
        while todo:
            y, x = todo.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not lab[y, x]:
                lab[y, x] = name
                todo += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return lab


def labels(df, shape):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r["y"], r["x"]] = r["region_id"]
    return out


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_labels_match_flood_fill(frame, limit):
    m = np.random.default_rng(7).random((17, 19)) < 0.45
    got = labels(R.label_regions(frame(m.astype(int)), F.col("v") == 1, frame_runs=limit), m.shape)
    np.testing.assert_array_equal(got, flood(m))


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_long_spiral_is_one_region(frame, limit):
    m = np.zeros((23, 23), int)
    y = x = 0
    dy, dx = 0, 1
    m[0, 0] = 1
    for _ in range(500):
        ny, nx = y + dy, x + dx
        ahead = (ny + dy, nx + dx)
        if not (0 <= ny < 23 and 0 <= nx < 23) or (0 <= ahead[0] < 23 and 0 <= ahead[1] < 23 and m[ahead]):
            dy, dx = dx, -dy
            ny, nx = y + dy, x + dx
            if not (0 <= ny < 23 and 0 <= nx < 23) or m[ny, nx]:
                break
        y, x = ny, nx
        m[y, x] = 1
    got = labels(R.label_regions(frame(m), F.col("v") == 1, 4, frame_runs=limit), m.shape)
    assert set(got[m == 1]) == {1}


def geometry(frame, m):
    d = R.label_regions(frame(np.asarray(m)), F.col("v") == 1)
    return {r["region_id"]: r for r in R.region_geometry(d).collect()}


def test_widths_of_known_shapes(frame):
    def width(m):
        (r,) = geometry(frame, m).values()
        return r["width_occupied"]

    square = lambda n: np.pad(np.ones((n, n), int), 1)
    assert width(square(2)) == pytest.approx(2)
    assert width(square(10)) == pytest.approx(10)
    line = np.zeros((3, 8), int)
    line[1, 1:7] = 1
    assert width(line) == pytest.approx(1)
    dot = np.zeros((3, 3), int)
    dot[1, 1] = 1
    assert width(dot) == pytest.approx(1)
    diagonal = np.eye(5, dtype=int)
    (r,) = geometry(frame, diagonal).values()
    assert r["contour_area"] == 0 and r["perimeter"] == pytest.approx(8 * np.sqrt(2))


def test_holes_and_nested_regions(frame):
    m = np.zeros((9, 9), int)
    m[1:8, 1:8] = 1
    m[2:7, 2:7] = 0
    m[4, 4] = 1
    g = geometry(frame, m)
    ring = g[11]
    assert ring["area_px"] == 24 and ring["contour_area"] == 36 and ring["perimeter"] == 24
    assert g[4 * 9 + 5]["area_px"] == 1


def test_diffusion_is_exact_across_bands(frame):
    rng = np.random.default_rng(9)
    shape = (30, 5)
    like, lum = rng.random(shape), rng.random(shape) * 0.1
    fg, bg = like > 0.93, like < 0.05
    df = frame(like, "likelihood", lum=lum, fg=fg, bg=bg, structure_ctx=rng.random(shape), rescue=rng.random(shape))
    p = parameters(matte_iterations=6)
    wide = {(r.y, r.x): r.matte for r in matte_diffuse(df, p).collect()}
    narrow = {(r.y, r.x): r.matte for r in matte_diffuse(df, p, band_rows=4).collect()}
    assert len(wide) == 150 and wide.keys() == narrow.keys()
    assert max(abs(wide[k] - narrow[k]) for k in wide) < 1e-12
    assert all(wide[y, x] == like[y, x] for y, x in zip(*np.nonzero(fg | bg)))


def test_bands_of_many_frames_are_diffused_together(spark):
    import pyarrow as pa
    from glintframe.operators.matte import _relax
    rng = np.random.default_rng(9)
    columns = ["scene", "frame", "band", "y", "x", "likelihood", "trust", "right", "down", "pinned", "own"]
    band = lambda f, top: [(1, f, top, y, x, *rng.random(4), int(rng.random() < 0.2), y > top) for y in range(top, top + 4) for x in range(3)]
    bands = [band(f, top) for f in range(5) for top in (0, 7)]
    solve = lambda rows, size: [tuple(r.values()) for b in _relax(7, 1.5)(pa.table(dict(zip(columns, map(list, zip(*rows))))).to_batches(size)) for r in b.to_pylist()]
    alone = [r for rows in bands for r in solve(rows, 100)]
    assert solve(sum(bands, []), 1000) == alone and solve(sum(bands, []), 7) == alone and len(alone) == 90
    assert len(list(_relax(7, 1.5)(pa.table(dict(zip(columns, map(list, zip(*sum(bands, [])))))).to_batches(1000)))) == 2


def test_ellipse_rows():
    assert _ellipse(1) == {-1: 0, 0: 1, 1: 0}
    assert _ellipse(2) == {-2: 0, -1: 2, 0: 2, 1: 2, 2: 0}
    assert _ellipse(4)[3] == 3


def test_parameter_order_is_checked():
    with pytest.raises(ValueError):
        parameters(matte_score_low=0.2)
    with pytest.raises(ValueError):
        parameters(nonsense=1)


def test_frames_are_solved_together_across_batches():
    import pyarrow as pa
    from glintframe.operators.regions import _solve_frames
    rng = np.random.default_rng(5)
    rows, expected = [], {}
    for scene, frame in ((None, 1), ("a", 1), ("a", 2), ("b", 2), ("b", 3)):
        edges = [(int(a) << 32, int(b) << 32) for a, b in rng.integers(0, 30, (17, 2))]
        parent = {v: v for e in edges for v in e}
        for _ in parent:
            for a, b in edges:
                parent[a] = parent[b] = min(parent[a], parent[b])
        rows += [(scene, frame, a, b) for a, b in edges]
        expected |= {(scene, frame, v): p for v, p in parent.items()}
    rows.sort(key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    known = {k: v for k, v in expected.items() if k[0] is not None}  # joins drop frames without a key
    for size in (1, 7, 17, 100):
        table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(("scene", "frame", "a", "b"))})
        found = [r for b in _solve_frames(table.to_batches(max_chunksize=size)) for r in b.to_pylist() if r["scene"] is not None]
        assert len(found) == len(known) and {(r["scene"], r["frame"], r["a"]): r["p"] for r in found} == known
