"""The estimate in one step against the same measures by rows, and against closed forms, on outlines that are not boxes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesograph.operators import outlines as O
from mesograph.operators import masks as K
from mesograph.operators import particles as P
from mesograph.operators import spans as S
from mesograph.operators import surface as U

SCHEMA = "particle_id string, image_id int, label string, vertices array<struct<x:double,y:double>>, pixel_size_nm double, px_unc_nm double"


def regular(x, y, r, n=32):
    return [(x + r * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)) for i in range(n)]


def rod(x, y, length, width, angle):
    c, s = math.cos(angle), math.sin(angle)
    return [(x + a * c - b * s, y + a * s + b * c) for a, b in ((-length / 2, -width / 2), (length / 2, -width / 2), (length / 2, width / 2), (-length / 2, width / 2))]


SHAPES = {
    "disc": regular(50, 60, 20), "small": regular(5, 5, 1.2), "tiny": [(0, 0), (1, 0), (0, 1)], "box": [(0.5, 0.1), (12.2, 0.1), (12.2, 9.4), (0.5, 9.4)],
    "ell": [(3, 2), (33, 2), (33, 12), (13, 12), (13, 42), (3, 42)], "rod": rod(70, 70, 60, 7, 0.6), "rod2": rod(70, 70, 60, 7, -1.1),
    "ring": [(0, 0), (40, 0), (40, 40), (0, 40), (0, 0), (10, 10), (10, 30), (30, 30), (30, 10), (10, 10)],
    "star": [(40 + (18 if i % 2 else 6) * math.cos(math.pi * i / 9), 40 + (18 if i % 2 else 6) * math.sin(math.pi * i / 9)) for i in range(18)],
    "two": [(1, 1), (2, 5)],
}


def table(spark):
    rows = [(name, 1, "x", [(float(x), float(y)) for x, y in v], 2.0, 0.1) for name, v in SHAPES.items()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("method", ["auto", "fourier_spiky"])
def test_one_step_equals_tables_of_rows(spark, method):
    particles = table(spark)
    once = {r.particle_id: r.asDict() for r in U.estimate_surface_area(particles, method).collect()}
    rows = {r.particle_id: r.asDict() for r in U.estimate_surface_area(particles, method, whole_pixels=0).collect()}
    assert once.keys() == rows.keys() == SHAPES.keys()
    for name in SHAPES:
        for column, value in rows[name].items():
            if isinstance(value, float):
                assert once[name][column] == pytest.approx(value, rel=1e-6, abs=1e-9), (name, column)
            else:
                assert once[name][column] == value, (name, column)


def test_estimate_against_closed_forms(spark):
    got = {r.particle_id: r for r in U.estimate_surface_area(table(spark), "ellipsoid").collect()}
    assert got["disc"].SA_nm2 == pytest.approx(4 * math.pi * 40 ** 2, rel=0.02)
    assert got["ring"].is_hollow and not got["ell"].is_hollow
    assert got["tiny"].flag_reason == "mask_too_small" and got["tiny"].SA_nm2 == 0
    shape = {r.particle_id: r for r in U.contour_metrics(table(spark)).collect()}
    assert shape["ell"].area_px == pytest.approx(600) and shape["ell"].convexity == pytest.approx(600 / (40 * 30 - 0.5 * 30 * 20))
    assert shape["rod"].rect_long == pytest.approx(60) and shape["rod"].rect_short == pytest.approx(7)
    assert shape["disc"].convexity == pytest.approx(1) and shape["disc"].circularity > 0.98
    assert shape["rod"].aggregate_score == 0 and shape["star"].aggregate_score == 1


def test_mask_measures_of_known_masks():
    one = P.measures([[c[0] for c in SHAPES["ell"]]], [[c[1] for c in SHAPES["ell"]]]).iloc[0]
    pixels = np.array([(y, x) for y in range(2, 42) for x in range(3, 33) if x < 13 or y < 12])
    values = np.linalg.eigvalsh(np.cov(pixels.T, bias=True))
    assert one.mask_area == len(pixels) == 600
    assert [one.ea, one.eb] == pytest.approx(list(2 * np.sqrt(values[::-1])))
    ring = P.measures([[c[0] for c in SHAPES["ring"]]], [[c[1] for c in SHAPES["ring"]]]).iloc[0]
    assert ring.is_hollow and ring.shell_px >= 5
    odd = P.measures([None, [], [1.0, float("nan"), 2.0], [1.0, None, 2.0]], [None, [], [1.0, 1.0, 2.0], [0.0, 0.0, 1.0]])
    assert (odd.mask_area == 0).all() and len(odd) == 4


def test_peaks_and_signal_of_a_star(spark):
    particles = table(spark)
    peaks = {r.particle_id: r["count"] for r in U.local_peaks(particles).groupBy("particle_id").count().collect()}
    contour = {r.particle_id: np.array([(p.x, p.y) for p in r.contour]) for r in U.with_contour(particles).collect()}
    for name, points in contour.items():
        if len(points) < 20:
            assert name not in peaks
            continue
        u, v = points - np.roll(points, 2, axis=0), np.roll(points, -2, axis=0) - points
        curve = np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) / np.maximum((np.hypot(*u.T) * np.hypot(*v.T)) ** 1.5, 1e-9)
        level, best, n = np.percentile(curve, 80), [], len(curve)
        tops = []
        i = 1
        while i < n - 1:  # plateaus count once, at their middle
            j = i
            while j + 1 < n and curve[j + 1] == curve[i]:
                j += 1
            if j < n - 1 and curve[i - 1] < curve[i] > curve[j + 1] and curve[i] >= level:
                tops.append((i + j) // 2)
            i = j + 1
        for k in sorted(tops, key=lambda k: (-curve[k], -k)):
            if all(abs(k - b) >= 5 for b in best):
                best.append(k)
        assert peaks.get(name, 0) == len(best), name
    signal = {}
    for r in U.radial_signal(particles, 64).collect():
        signal.setdefault(r.particle_id, {})[r.i] = r.r
    assert list(signal["disc"].values()) == pytest.approx([20.0] * 64, rel=0.01)
    assert max(signal["star"].values()) == pytest.approx(18, rel=0.05) and min(signal["star"].values()) == pytest.approx(6, rel=0.05)


def test_spike_surface_of_a_cone(spark):
    """A flat line with one spike: the cone over it has the radius and height of the spike's base."""
    found = {r.particle_id: r for r in table(spark).select("particle_id", P.spike_column(F.col("vertices"), F.lit(True)).alias("s")).select("particle_id", "s.*").collect()}
    contour = {r.particle_id: np.array([(p.x, p.y) for p in r.contour]) for r in U.with_contour(table(spark)).collect()}
    for name, points in contour.items():
        area, n = U.spike_surface(points)
        assert (found[name].spikes, found[name].n_spikes) == (pytest.approx(area), n)
    assert found["star"].n_spikes >= 9 and found["star"].spikes > 0 and found["tiny"].n_spikes == 0


# ---- outlines of masks

def ring_area(v):
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(v, v[1:] + v[:1])) / 2


def test_rings_have_the_area_of_their_pixels(spark):
    rng = np.random.default_rng(3)
    rows, pixels = [], {}
    for region in range(12):
        field = rng.random((14, 17)) < (0.35 + 0.05 * region)
        pixels[region] = {(int(y) - 3, int(x) - 4) for y, x in np.argwhere(field)}
        rows += [(1, region, y, x) for y, x in pixels[region]]
    rows += [(1, 99, y, x) for y in range(5) for x in range(5) if (y, x) != (2, 2)] + [(1, 98, 0, 0), (1, 98, 1, 1)]
    masks = spark.createDataFrame(rows, "image_id int, region_id int, y int, x int")
    found = {}
    for r in O.mask_rings(masks).collect():
        found.setdefault(r.region_id, []).append(r)
    for region, set_ in pixels.items():
        rings = found[region]
        assert sum(-r.area if r.hole else r.area for r in rings) == len(set_)
        for r in rings:
            v = [p.asDict() for p in r.vertices]
            assert ring_area(v) == (-r.area if r.hole else r.area)
            assert all((a["x"] == b["x"]) != (a["y"] == b["y"]) for a, b in zip(v, v[1:] + v[:1])), "edges go along pixel sides"
        # every side of a pixel next to a free one is walked once
        sides = sum((y + dy, x + dx) not in set_ for y, x in set_ for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        assert sides == sum(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) for r in rings for v in [[p.asDict() for p in r.vertices]] for a, b in zip(v, v[1:] + v[:1]))
    assert sorted((r.hole, r.area) for r in found[99]) == [(False, 25), (True, 1)]
    assert sorted((r.hole, r.area) for r in found[98]) == [(False, 1), (False, 1)], "parts that touch at a corner are apart"
    assert {r.region_id: r.outline_area for r in O.mask_outlines(masks).collect()}[99] == 25


def test_ring_of_a_spiral(spark):
    """A long way around: many rounds of pointer jumping."""
    field = np.zeros((41, 41), bool)
    y = x = 20
    dy, dx, reach = 0, 1, 2
    field[y, x] = True
    while True:
        for _ in range(2):
            for _ in range(reach):
                y, x = y + dy, x + dx
                if not (0 <= y < 41 and 0 <= x < 41):
                    break
                field[y, x] = True
            dy, dx = dx, -dy
        reach += 2
        if not (0 <= y < 41 and 0 <= x < 41):
            break
    masks = spark.createDataFrame([(1, 1, int(a), int(b)) for a, b in np.argwhere(field)], "image_id int, region_id int, y int, x int")
    rings = O.mask_rings(masks).collect()
    assert len(rings) == 1 and rings[0].area == field.sum()
    assert ring_area([p.asDict() for p in rings[0].vertices]) == field.sum()


def test_outlines_of_drawn_masks_draw_the_same_masks(spark):
    shapes = table(spark).select("image_id", F.col("particle_id").alias("region_id"), "vertices")
    runs = K.rasterize_spans(shapes).cache()
    area = {r.region_id: r.area for r in K.mask_area(runs).collect()}
    again = O.mask_outlines(runs).select("image_id", "region_id", F.transform("vertices", lambda p: F.struct((p["x"] - 0.5).alias("x"), (p["y"] - 0.5).alias("y"))).alias("vertices"))
    back = {r.region_id: r.area for r in K.mask_area(K.rasterize_spans(again)).collect()}
    whole = [n for n in area if n != "ring" and n != "star"]
    assert {n: back[n] for n in whole} == {n: area[n] for n in whole} and back["ring"] > area["ring"]


@pytest.mark.parametrize("as_runs", [True, False])
def test_mask_measures_move_one_row_a_mask(spark, as_runs):
    """Runs or pixels, measured whole or by rows: the same, also for a mask drawn twice and one whose box is large."""
    shapes = [*SHAPES.items(), ("disc", SHAPES["disc"]), ("wide", [(0, 0), (3000, 0), (3000, 2), (0, 2)])]
    rois = spark.createDataFrame([(name, [(float(x), float(y)) for x, y in v]) for name, v in shapes], "particle_id string, vertices array<struct<x:double,y:double>>")
    masks = (K.rasterize_spans if as_runs else K.rasterize_roi)(rois, ["particle_id"])
    for measure in (U.mask_lacunarity, U.erosion_depth, U.shell_from_holes):
        once, rows = ({r[0]: r[1:] for r in measure(masks, whole_pixels=limit).collect()} for limit in (1 << 22, 0))
        assert once.keys() == rows.keys() and len(once) > 8
        for name in once:
            assert once[name] == pytest.approx(rows[name], rel=1e-9), (measure, name)
    packed = S.packed_runs(masks, ["particle_id"]).collect()
    assert len(packed) == len(once) and sum(sum(r.runs[2::3]) - sum(r.runs[1::3]) for r in packed) == K.rasterize_roi(rois, ["particle_id"]).count()


def shifted(spark):
    """Outlines left of and above the origin too, a key with two outlines, one with an unknown end, one null and one empty."""
    rows = [(name, [(x - 30.5, y - 20.25) for x, y in v]) for name, v in SHAPES.items()]
    rows += [("disc", regular(9, 9, 6)), ("open", [(0.0, 0.0), (30.0, 0.0), (None, 8.0), (0.0, 8.0)]), ("null", None), ("empty", [])]
    return spark.createDataFrame([(n, v, 2.0) for n, v in rows], "particle_id string, vertices array<struct<x:double,y:double>>, pixel_size_nm double")


def test_packed_contours_measure_like_their_points(spark):
    given = shifted(spark)
    points, packed = U.contour_points(given), U.contour_points(given, packed=True)
    counts = {r.particle_id: r.n for r in points.groupBy("particle_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.particle_id: len(r.contour) / 2 for r in packed.collect()} == counts
    # A key with two sizes is counted in the boxes of both, one without a size has no dimension.
    size = spark.createDataFrame([(n, h, h + 9) for n in SHAPES if n != "rod" for h in (32, 50)] + [("open", 32, 40)], "particle_id string, height int, width int")
    for measure in (U.roughness_index, lambda c: U.box_count_fractal(c, size)):
        want = {r[0]: r[1] for r in measure(points).collect()}
        got = {r[0]: r[1] for r in measure(packed).collect()}
        assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    assert got["rod"] == 1.0 < got["star"]


def test_contour_measures_move_no_points(spark):
    from types import SimpleNamespace

    from mesograph.queries import registry, surface as Q

    given = shifted(spark)
    t = SimpleNamespace(rects=lambda: given.select(F.col("particle_id").alias("ann_id")))
    for name in ("box_count_fractal", "roughness_index", "richardson", "discrete_curvature", "radial_signal"):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(Q, "particles", lambda t: given)
            plan = registry.load()[name].build(t)._jdf.queryExecution().optimizedPlan().toString()
        # Points were made one by one in expressions of the row, and of the first two each was moved.
        assert "ArrowEvalPython" in plan and "sequence(0, (cast(greatest" not in plan, name
        assert name not in ("box_count_fractal", "roughness_index") or "posexplode" not in plan, name


def test_lengths_turning_and_radii_of_contours(spark):
    given = shifted(spark).where("particle_id NOT IN ('disc', 'open')")
    lengths = {r[0]: (r[1], r[2]) for r in U.richardson(given).collect()}
    turning, radii = {}, {}
    for r in U.discrete_curvature(given).collect():
        turning.setdefault(r[0], {})[r.i] = r.curvature
    for r in U.radial_signal(given).collect():
        radii.setdefault(r[0], {})[r.i] = r.r
    assert "null" not in turning and "empty" not in turning and set(radii["null"].values()) == {0.0} and lengths["empty"][1] == 1.0
    for name in set(SHAPES) - {"disc"}:
        v = np.array(SHAPES[name], float) - (30.5, 20.25)
        x, y, _ = P.contours(v[:, 0], v[:, 1], np.array([len(v)]))
        p = np.column_stack([x, y])
        n = len(p)
        steps = [1 << k for k in range(20) if 1 << k <= max(2, n // 4) and math.ceil(n / (1 << k)) >= 3]
        arcs = [sum(math.dist(a, b) for a, b in zip(p[::s], np.roll(p[::s], -1, axis=0))) for s in steps]
        arc = sum(math.dist(a, b) for a, b in zip(v, np.roll(v, -1, axis=0)))
        m, b = np.polyfit(np.log(steps), np.log(arcs), 1) if n >= 20 else (0.0, math.log(arc))
        assert lengths[name] == pytest.approx((2 * math.exp(b), min(2.0, max(1.0, 1 - m))), rel=1e-9), name
        assert [turning[name][i] for i in range(n)] == pytest.approx(U._curvature(p)), name
        rel = p - p.mean(axis=0)
        target = -np.pi + 2 * np.pi * np.arange(256) / 256
        want = np.interp(target, np.arctan2(rel[:, 1], rel[:, 0]), np.hypot(rel[:, 0], rel[:, 1]), period=2 * np.pi) if n >= 3 else np.zeros(256)
        if name != "ring":  # its contour meets some angles twice
            assert [radii[name][i] for i in range(256)] == pytest.approx(want), name


def test_draws_of_many_texts_equal_the_column(spark):
    from mesograph.operators.ordering import hash_uniform, hash_uniforms

    for tail in (["", ""], [":7", ":x"], [":äö-9-12", ":ab-9-3456"], [":" + "k" * n for n in (45, 45)], [":" + "k" * 130]):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(tail)], "i int, t string").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(1111))))
        text = F.concat(F.col("n").cast("string"), F.col("t"))
        want = np.zeros((len(tail), 1112))
        for r in rows.select("i", "n", hash_uniform(42, "offset", text).alias("u")).collect():
            want[r.i, r.n] = r.u
        same = [t.encode() for t in tail if len(t.encode()) == len(tail[0].encode())]
        assert (hash_uniforms("42:offset:", 1112, same) == want[:len(same)]).all()


def test_random_lines_of_runs_and_pixels(spark):
    """Lines are walked in the task that holds the mask, with the same crossings as a plain walk; they were drawn as arrays of rows."""
    from mesograph.operators.ordering import hash_uniforms

    spans = S.outline_spans(table(spark), ["particle_id"])
    pixels = S.span_pixels(spans).select("particle_id", "y", "x")
    kept = {}
    for r in pixels.collect():
        kept.setdefault(r.particle_id, set()).add((r.y, r.x))
    found = U.monte_carlo_perimeter(spans, 300)
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.particle_id: r.perimeter_px for r in found.collect()}
    assert got == {r.particle_id: r.perimeter_px for r in U.monte_carlo_perimeter(pixels, 300).collect()} and got.keys() == kept.keys()
    for name, mask in kept.items():
        y0, x0 = min(y for y, _ in mask) - 2, min(x for _, x in mask) - 2
        h, w = max(y for y, _ in mask) + 3 - y0, max(x for _, x in mask) + 3 - x0
        d = math.hypot(h, w)
        n = math.floor(d) + 2
        s = -d / 2 + d * np.arange(n) / (n - 1)
        angles, offsets = (hash_uniforms(f"42:{tag}:", 300, [f":{name}".encode()])[0] for tag in ("angle", "offset"))
        crossings = 0
        for a, t in zip(angles * math.pi, (offsets - 0.5) * d):
            px, py = np.rint(w / 2 + s * math.cos(a) - t * math.sin(a)), np.rint(h / 2 + s * math.sin(a) + t * math.cos(a))
            inside = (px >= 0) & (px < w) & (py >= 0) & (py < h)
            m = np.array([(y + y0, x + x0) in mask for y, x in zip(py, px)])
            crossings += np.count_nonzero((m[1:] != m[:-1]) & inside[1:] & inside[:-1])
        assert got[name] == pytest.approx(math.pi * d * crossings / 600, rel=1e-3), name
