"""Masks as runs and their set operations against plain sets of pixels."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mesograph.operators import masks as K
from mesograph.operators import spans as S


def shapes(seed, n, size=150):
    """Boxes, triangles, L-shapes and stars, several on top of each other."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = rng.uniform(-20, size), rng.uniform(0, size), rng.uniform(1, 80), rng.uniform(1, 40)
        kind = i % 4
        if kind == 0:
            v = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        elif kind == 1:
            v = [(x, y), (x + w, y + h / 2), (x + w / 3, y + h)]
        elif kind == 2:
            v = [(x, y), (x + w, y), (x + w, y + h / 3), (x + w / 3, y + h / 3), (x + w / 3, y + h), (x, y + h)]
        else:
            v = [(x + rng.uniform(0, w), y + rng.uniform(0, h)) for _ in range(7)]
        out.append((i % 2, "A" if i % 3 else "B", i, v))
    return out


def inside(v, px, py):
    odd = False
    for (x0, y0), (x1, y1) in zip(v, v[1:] + v[:1]):
        if (y0 <= py) != (y1 <= py) and x0 + (py - y0) * (x1 - x0) / (y1 - y0) <= px:
            odd = not odd
    return odd


def plain(v):
    xs, ys = [p[0] for p in v], [p[1] for p in v]
    return {(py, px) for py in range(int(min(ys)) - 1, int(max(ys)) + 2) for px in range(int(min(xs)) - 1, int(max(xs)) + 2) if inside(v, px, py)}


SHAPES = shapes(5, 60)
PIXELS = {r: plain(v) for _, _, r, v in SHAPES}


def table(spark):
    rows = [(g, label, r, [{"x": x, "y": y} for x, y in v]) for g, label, r, v in SHAPES]
    return spark.createDataFrame(rows, "image_id int, label string, region_id int, vertices array<struct<x:double,y:double>>")


@pytest.fixture(scope="module")
def runs(spark):
    return K.rasterize_spans(table(spark), ["image_id", "label", "region_id"]).cache()


def grouped(rows, *keys):
    out = defaultdict(set)
    for r in rows:
        out[tuple(r[k] for k in keys)] |= {(r.y, x) for x in range(r.xa, r.xb)}
    return dict(out)


def test_runs_cover_the_pixels_of_outlines(spark, runs):
    assert grouped(runs.collect(), "region_id") == {(r,): p for r, p in PIXELS.items() if p}
    odd = spark.createDataFrame([(1, 1, None), (1, 2, []), (1, 3, [(0.0, 0.0), (9.0, 9.0)]), (1, 4, [(0.0, 0.0), (float("nan"), 3.0), (3.0, 3.0)]), (1, 5, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]),
                                 (1, 6, [(0.0, 0.0), None, (3.0, 3.0)])], "image_id int, region_id int, vertices array<struct<x:double,y:double>>")
    assert {k: len(p) for k, p in grouped(K.rasterize_spans(odd).collect(), "region_id").items()} == {(5,): 16}
    assert K.rasterize_roi(odd).count() == 16 and K.rasterize_spans(odd.limit(0)).count() == 0


def test_pixels_and_runs_are_the_same_masks(runs):
    pixels = S.span_pixels(runs.select("image_id", "region_id", "y", "xa", "xb"))
    assert grouped(S.pixel_spans(pixels).collect(), "region_id") == {(r,): p for r, p in PIXELS.items() if p}
    vertical = defaultdict(set)
    for r in K.column_runs(runs).collect():
        vertical[r.region_id] |= {(y, r.x) for y in range(r.y0, r.y0 + r.n)}
    assert vertical == {r: p for r, p in PIXELS.items() if p}


def test_overlap_paint_and_union(runs):
    area = {r.region_id: r.area for r in K.mask_area(runs).collect()}
    assert area == {r: len(p) for r, p in PIXELS.items() if p}
    image = {r: g for g, _, r, _ in SHAPES}
    want = {(a, b): len(PIXELS[a] & PIXELS[b]) / len(PIXELS[a] | PIXELS[b]) for a in PIXELS for b in PIXELS if a < b and image[a] == image[b] and PIXELS[a] & PIXELS[b]}
    got = {(r.a, r.b): r.iou for r in K.mask_iou(runs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    painted = grouped(K.label_mask_paint(runs).collect(), "image_id", "region_id")
    want = defaultdict(set)
    for g in (0, 1):
        for p in set().union(*(PIXELS[r] for r in PIXELS if image[r] == g)):
            want[g, max(r for r in PIXELS if image[r] == g and p in PIXELS[r])].add(p)
    assert painted == want
    for name, fold in (("compound_union", lambda parts: set().union(*parts)), ("compound_subtract_inner", lambda parts: parts[0] - set().union(*parts[1:]))):
        want = {k: fold(v) for k, v in ordered_groups().items()}
        assert grouped(getattr(K, name)(runs).collect(), "label", "image_id") == {k: v for k, v in want.items() if v}


def ordered_groups(shapes_=SHAPES, pixels=PIXELS):
    out = defaultdict(list)
    for g, label, r, _ in sorted(shapes_, key=lambda s: (-len(pixels[s[2]]), s[2])):
        if pixels[r]:
            out[label, g].append(pixels[r])
    return out


def folded(parts):
    whole = parts[0]
    for inner in parts[1:]:
        whole = whole - inner if len(inner & whole) / len(inner) > 0.8 else whole | inner
    return whole


def test_compound_auto_equals_the_fold_in_order(spark, runs):
    assert grouped(K.compound_auto(runs).collect(), "label", "image_id") == {k: folded(v) for k, v in ordered_groups().items()}
    pixels = S.span_pixels(runs)
    got = defaultdict(set)
    for r in K.compound_auto(pixels).collect():
        got[r.label, r.image_id].add((r.y, r.x))
    assert got == {k: folded(v) for k, v in ordered_groups().items()}


def test_compound_auto_on_a_long_chain(spark):
    """Nested and shifted boxes: every decision hangs on the one before."""
    rows, pixels, listed = [], {}, []
    for k in range(14):
        box = {(y, x) for y in range(k, 60 - 2 * k) for x in range(k, 60 - 2 * k)} or {(99, k)}
        pixels[k] = box
        listed.append((0, "A", k, None))
        rows += [(0, "A", k, y, x) for y, x in box]
    got = K.compound_auto(spark.createDataFrame(rows, "image_id int, label string, region_id int, y int, x int")).collect()
    assert {(r.y, r.x) for r in got} == folded(ordered_groups(listed, pixels)["A", 0])


def test_suppression_equals_the_greedy_sweep(spark, runs):
    rng = random.Random(2)
    image = {r: g for g, _, r, _ in SHAPES}
    score = {r: rng.choice([1.0, 2.0, 3.0, None]) for r in PIXELS}
    for threshold in (0.01, 0.2):
        kept = []
        for r in sorted(PIXELS, key=lambda r: (-(score[r] if score[r] is not None else -1), r)):
            if all(image[k] != image[r] or len(PIXELS[k] & PIXELS[r]) <= threshold * len(PIXELS[k] | PIXELS[r]) for k in kept):
                kept.append(r)
        scores = spark.createDataFrame([(image[r], r, s) for r, s in score.items()], "image_id int, region_id int, score double")
        assert sorted(r.region_id for r in K.mask_nms(runs, scores, threshold).collect()) == sorted(kept)


def test_run_lengths_join_columns(spark):
    rows = [(1, 1, y, x) for x in (0, 1) for y in range(4)] + [(1, 1, 3, 2), (1, 1, 0, 3), (1, 2, 1, 1)]
    masks = spark.createDataFrame(rows, "image_id int, region_id int, y int, x int")
    shape = spark.createDataFrame([(1, 4, 5)], "image_id int, height int, width int")
    got = {r.region_id: r.counts for r in K.rle_encode(masks, shape).collect()}
    assert got == {1: [0, 8, 3, 2, 7], 2: [5, 1, 14]}


def test_semantic_runs_and_tile_runs_equal_pixels(spark):
    """Classes and tiles of runs are those of their pixels, also without an image and where runs cross the tiles' borders."""
    from mesograph.operators import dataset as D

    rows = [(i % 3 or None, i, 1 + i % 2, 7.0 * i % 90, 5.0 * i % 40, 3.0 + i % 75, 4.0 + i % 5) for i in range(60)]
    boxes = spark.createDataFrame(rows, "image_id int, ann_order int, class_index int, bx double, by_ double, bw double, bh double").withColumn(
        "vertices", F.lit(None).cast("array<struct<x:double,y:double>>"))
    want = {}
    for image, _, kind, x, y, w, h in rows:
        want.update({(image, yy, xx): kind for yy in range(int(y), int(y) + int(h)) for xx in range(int(x), int(x) + int(w))})
    assert {tuple(r)[:3]: r.class_index for r in K.semantic_mask(boxes).collect()} == want
    runs = K.semantic_mask(boxes, as_runs=True)
    assert runs.count() < len(want) / 4
    images = spark.createDataFrame([(1, 50, 200), (2, 30, 170)], "image_id int, height int, width int")
    by_run = D.roi_tile_join(runs, images, 32, 0.25).select("image_id", "tile_idx", "class_index", "y", F.explode(F.sequence("xa", F.col("xb") - 1)).alias("x"))
    by_pixel = D.roi_tile_join(K.semantic_mask(boxes), images, 32, 0.25).select(*by_run.columns)
    got = sorted(map(tuple, by_run.collect()))
    assert got == sorted(map(tuple, by_pixel.collect())) and len(got) > 1000
    grid = {(t.image_id, t.tile_idx): (t.y0, t.x0) for t in D.tile_grid(images, 32, 0.25).collect()}
    assert sorted(got) == sorted((i, tile, kind, y - y0, x - x0) for (i, y, x), kind in want.items() for (j, tile), (y0, x0) in grid.items()
                                 if i == j and 0 <= y - y0 < 32 and 0 <= x - x0 < 32)


def test_masks_move_in_bands_and_meet_there(spark):
    """Outlines, runs and bands of lines give the same answers, those of plain pixels, and what is shuffled are rows of a band, not runs."""
    some = shapes(11, 30)
    rois = spark.createDataFrame([(i, lab, r, [(float(x), float(y)) for x, y in v]) for i, lab, r, v in some],
                                 "image_id int, label string, region_id int, vertices array<struct<x:double,y:double>>")
    keys = ["image_id", "label", "region_id"]
    pixels = {(i, lab, r): {(y, x) for y in range(-2, 230) for x in range(-30, 260) if inside(v, x, y)} for i, lab, r, v in some}

    def covered(df, *names):
        got = defaultdict(set)
        for row in df.collect():
            got[tuple(row[n] for n in names)] |= {(row.y, x) for x in range(row.xa, row.xb)}
        return got

    forms = [K.rasterize_bands(rois, keys), K.rasterize_spans(rois, keys)]
    assert covered(S.band_spans(forms[0], keys), *keys) == {k: v for k, v in pixels.items() if v} == covered(S.band_spans(S.band_rows(forms[1], keys), keys), *keys)
    groups = {k[:2] for k in pixels}
    for masks in forms:
        painted = K.label_mask_paint(masks)
        assert "hashpartitioning(image_id" in (plan := painted._jdf.queryExecution().executedPlan().toString()) and "band#" in plan and "Window" not in plan
        top = {}
        for (i, _, r), where in sorted(pixels.items(), key=lambda p: p[0][2]):
            top.update({(i, *p): r for p in where})
        assert {(row.image_id, row.y, x): row.region_id for row in painted.collect() for x in range(row.xa, row.xb)} == top
        inner, auto = covered(K.compound_subtract_inner(masks), "image_id", "label"), covered(K.compound_auto(masks), "image_id", "label")
        for group in groups:
            order = sorted((k for k in pixels if k[:2] == group and pixels[k]), key=lambda k: (-len(pixels[k]), k[2]))
            assert inner.get(group, set()) == pixels[order[0]] - set().union(*(pixels[k] for k in order[1:]))
            whole = set()
            for k in order:
                whole = whole - pixels[k] if len(pixels[k] & whole) / len(pixels[k]) > 0.8 else whole | pixels[k]
            assert auto.get(group, set()) == whole
        pairs = {(r.image_id, r.a, r.b): r.iou for r in K.mask_iou(masks).collect()}
        assert pairs == {(a[0], a[2], b[2]): len(pixels[a] & pixels[b]) / len(pixels[a] | pixels[b]) for a in pixels for b in pixels if a[0] == b[0] and a[2] < b[2] and pixels[a] & pixels[b]}
    twice = K.compound_auto(forms[0].unionByName(forms[0]))
    assert twice.count() >= 0  # a mask that comes twice does not wait for itself
