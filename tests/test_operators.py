import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesograph.functions import geometry as G
from mesograph.functions import hull as H
from mesograph.functions import special as Q
from mesograph.operators import annotations as A
from mesograph.operators import compare as C
from mesograph.operators import dataset as D
from mesograph.operators import masks as K
from mesograph.operators import ordering as O
from mesograph.operators import pixels as X
from mesograph.operators import spatial as S
from mesograph.operators import surface as U
from mesograph.operators import tracking as T


def squares(spark):
    rows = [(i, float(c - 10), float(c - 10), float(c + 10), float(c + 10)) for i, c in enumerate((100, 200, 300))]
    boxes = spark.createDataFrame(rows, "ann_idx int, x0 double, y0 double, x1 double, y1 double")
    return boxes.withColumns({"image_id": F.lit(1), "type": F.lit("roi"), "pixel_size_nm": F.lit(1.0), "label": F.lit("a"),
                              "vertices": G.box_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))})


def test_golden_squares(spark):
    for row in A.polygon_metrics(squares(spark)).collect():
        assert (row.area_nm2, row.perimeter_nm, row.bbox_w_nm, row.aspect_ratio) == (400.0, 80.0, 20.0, 1.0)
        assert (row.ecd_nm, row.circularity, row.feret_nm) == (22.5676, 0.7854, 28.2843)


def points(spark, xy):
    return spark.createDataFrame([(1, i, "a", float(x), float(y)) for i, (x, y) in enumerate(xy)], "image_id int, point_id long, label string, x_nm double, y_nm double")


def test_golden_pattern(spark):
    p = points(spark, [(100, 100), (200, 200), (300, 300)])
    assert [round(r.nnd_nm, 4) for r in S.nearest_neighbour_join(p).collect()] == [141.4214] * 3
    assert {r.point_id: r.n_neighbors for r in S.local_density(p, 150).collect()} == {0: 1, 1: 2, 2: 1}
    for eps, least, want in ((150, 3, [0, 0, 0]), (150, 2, [0, 0, 0]), (100, 2, [-1, -1, -1])):
        assert [r.cluster_id for r in S.dbscan(p, eps, least).orderBy("point_id").collect()] == want


def test_golden_track(spark):
    d = spark.createDataFrame([("s", i, i, float(c), float(c)) for i, c in enumerate((100, 200, 300))], "sequence_id string, frame int, ann_idx int, x_px double, y_px double")
    tracks = T.track_annotations(d, 150.0)
    assert [round(r.displacement_nm, 4) for r in T.sort_tracks(tracks).collect()] == [0, 141.4214, 141.4214]
    one = T.track_statistics(tracks).first()
    assert (one.n_frames, round(one.total_displacement_nm, 4), round(one.net_displacement_nm, 4)) == (3, 282.8427, 282.8427)
    assert T.track_annotations(d, 100.0).count() == 0


def crowded(seed=3):
    """Half of the points in one tiny spot, some of them copies, the rest spread out."""
    rng = np.random.default_rng(seed)
    spot = np.round(rng.normal(500, 0.5, (60, 2)), 1)
    return np.vstack([spot, spot[:10], rng.uniform(-400, 1000, (50, 2))])


def sequential_dbscan(xy, eps, least):
    near = [np.flatnonzero(((xy - p) ** 2).sum(axis=1) <= eps * eps) for p in xy]
    core = [len(n) >= least for n in near]
    label, current = [-1] * len(xy), 0
    for i in range(len(xy)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = current
                    todo += [k for k in near[j] if core[j]]
            current += 1
    return label


def test_spatial_against_brute_force(spark):
    xy = crowded()
    p = points(spark, xy)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    found = {r.point_id: r.nnd_nm for r in S.nearest_neighbour_join(p).collect()}
    assert np.allclose([found[i] for i in range(len(xy))], d.min(axis=1))
    density = {r.point_id: r.n_neighbors for r in S.local_density(p, 60.0).collect()}
    assert [density[i] for i in range(len(xy))] == (d <= 60.0).sum(axis=1).tolist()
    for eps in (1.0, 80.0, 150.0):
        got = {r.point_id: r.cluster_id for r in S.dbscan(p, eps, 4).collect()}
        assert [got[i] for i in range(len(xy))] == sequential_dbscan(xy, eps, 4)


def test_cross_nearest_far_queries(spark):
    a, b = points(spark, [(0, 0), (5000, 5000), (-3000, 20)]), points(spark, [(10, 0), (11, 0), (4990, 5000)])
    got = {r.point_id: round(r.cross_nnd_nm, 3) for r in S.cross_nearest_join(a, b).collect()}
    assert got == {0: 10.0, 1: 10.0, 2: round(math.hypot(3010, 20), 3)}


def test_hot_cells_are_split_exactly(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_CELL", 5)
    monkeypatch.setattr(S, "CROWD", 6)
    xy = np.random.default_rng(0).uniform(0, 30, (80, 2))
    got = {r.point_id: r.n_neighbors for r in S.local_density(points(spark, xy), 20.0).collect()}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    assert [got[i] for i in range(80)] == ((d <= 20.0).sum(axis=1) - 1).tolist()
    np.fill_diagonal(d, np.inf)
    near = {r.point_id: r.nnd_nm for r in S.nearest_neighbour_join(points(spark, xy)).collect()}
    assert np.allclose([near[i] for i in range(80)], d.min(axis=1))


def test_quantiles_and_ranks_match_numpy(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(0, 10, 400), 0)
    df = spark.createDataFrame([("g" if i % 3 else "h", float(x)) for i, x in enumerate(v)], "k string, v double")
    q = {r.k: r.p for r in O.quantiles(df, ["k"], "v", {"p": 0.37}).collect()}
    for k, keep in (("g", [i % 3 != 0 for i in range(400)]), ("h", [i % 3 == 0 for i in range(400)])):
        assert q[k] == pytest.approx(np.percentile(v[keep], 37))


@pytest.mark.parametrize("seed", range(8))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, m = int(rng.integers(1, 6)), int(rng.integers(1, 6))
    a, b = rng.uniform(0, 10, (n, 2)), rng.uniform(0, 10, (m, 2))
    cost = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    cost = np.where(cost <= 4.0, cost, 40.0)
    small = cost if n <= m else cost.T
    rows, cols = T.assign(small)
    best = min(sum(small[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
    assert small[rows, cols].sum() == pytest.approx(best) and len(set(cols)) == len(small)


def test_tracking_by_groups_equals_whole_sequence(spark):
    rng = np.random.default_rng(5)
    rows = [("s", f, 100 * f + i, float(x), float(y)) for f in range(8) for i, (x, y) in enumerate(rng.uniform(0, 100, (12, 2)))]
    d = spark.createDataFrame(rows, "sequence_id string, frame int, ann_idx int, x_px double, y_px double")
    frames, xy = np.array([r[1] for r in rows]), np.array([r[3:] for r in rows])
    head = T.link_group(frames, xy, 15.0, 1)
    order = {h: i for i, h in enumerate(sorted(set(head)))}
    want = {rows[i][2]: order[h] for i, h in enumerate(head) if (head == h).sum() >= 2}
    assert {r.ann_idx: r.track_id for r in T.track_annotations(d, 15.0).collect()} == want
    by_image = d.withColumn("px", F.lit(2.0))
    assert {r.ann_idx: r.track_id for r in T.track_annotations(by_image, None, pixel_size_nm=F.col("px"), max_nm=30.0).collect()} == want


def test_links_of_neighbouring_frames_are_the_best(spark):
    rng = np.random.default_rng(6)
    rows = [("s", f, 100 * f + i, float(x), float(y)) for f in range(5) for i, (x, y) in enumerate(rng.uniform(0, 60, (9, 2)))]
    d = spark.createDataFrame(rows, "sequence_id string, frame int, ann_idx int, x_px double, y_px double")
    want = set()
    for f in range(4):
        a, b = ([r for r in rows if r[1] == g] for g in (f, f + 1))
        want |= {(a[i][2], b[j][2]) for i, j in T.link_two_frames(np.array([r[3:] for r in a]), np.array([r[3:] for r in b]), 14.0)}
    assert {(r.a, r.b) for r in T.link_frames(d, 14.0).collect()} == want


def test_hull_of_turned_rod_and_star():
    t = math.radians(30)
    rod = np.array([(0, 0), (40, 0), (40, 4), (0, 4)]) @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
    assert np.allclose(H.smallest_rectangle(rod[H.convex_hull(rod)]), (40, 4))
    angles = np.arange(12) * math.pi / 6
    star = np.column_stack([np.cos(angles), np.sin(angles)]) * np.where(np.arange(12) % 2, 20, 60)[:, None]
    assert H.deep_defects(star, H.convex_hull(star)) == 6


def test_tail_probabilities(spark):
    row = spark.range(1).select(*[Q.erfc(F.lit(x)).alias(f"e{i}") for i, x in enumerate((-2.0, 0.0, 0.5, 2.9, 3.1, 6.0))]).first()
    assert np.allclose(list(row), [math.erfc(x) for x in (-2.0, 0.0, 0.5, 2.9, 3.1, 6.0)], rtol=1e-9)
    assert Q.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert Q.chi2_upper(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert Q.f_upper(3.4928, 2, 20) == pytest.approx(0.05, abs=1e-4)
    assert Q.t_quantile(0.975, 9) == pytest.approx(2.262157, abs=1e-5)
    assert Q.studentized_range_upper(3.578, 3, 20) == pytest.approx(0.05, abs=1e-3)


def test_exact_rank_sum_tail():
    a, b = [1.1, 2.2, 3.3], [4.4, 5.5, 0.5, 6.6]
    u = sum(x > y for x in a for y in b)
    pool = range(7)
    ranked = sorted(a + b)
    us = [sum(ranked[i] > ranked[j] for i in c for j in pool if j not in c) for c in itertools.combinations(pool, 3)]
    want = min(1.0, 2 * np.mean([x >= max(u, 12 - u) for x in us]))
    assert C._exact_u_tail(u, 3, 4) == pytest.approx(want)


def test_shapiro_wilk_known_sample():
    w, p = C.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], dtype=float))
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.001)


def mask_rows(spark, regions):
    rows = [(1, "a", r, y, x) for r, cells in regions.items() for y, x in cells]
    return spark.createDataFrame(rows, "image_id int, label string, region_id int, y int, x int")


def block(y0, x0, h, w):
    return {(y, x) for y in range(y0, y0 + h) for x in range(x0, x0 + w)}


def test_run_lengths(spark):
    shape = spark.createDataFrame([(1, 2, 2)], "image_id int, height int, width int")
    rows = mask_rows(spark, {1: {(0, 0), (1, 1)}, 2: {(1, 0), (0, 1)}})
    got = {r.region_id: list(r.counts) for r in K.rle_encode(rows, shape).collect()}
    assert got == {1: [0, 1, 2, 1], 2: [1, 2, 1]}


def test_compound_auto_subtracts_and_unites(spark):
    big, hole, side, far = block(0, 0, 10, 10), block(3, 3, 3, 3), block(8, 8, 5, 5), block(40, 40, 2, 2)
    got = {(r.y, r.x) for r in K.compound_auto(mask_rows(spark, {1: big, 2: hole, 3: side, 4: far})).collect()}
    assert got == ((big | side) - hole) | far


def test_suppression_keeps_best(spark):
    masks = mask_rows(spark, {1: block(0, 0, 10, 10), 2: block(0, 1, 10, 10), 3: block(0, 2, 10, 10), 4: block(50, 0, 3, 3)})
    scores = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7), (1, 4, 0.1)], "image_id int, region_id int, score double")
    assert sorted(r.region_id for r in K.mask_nms(masks, scores, 0.7).collect()) == [1, 3, 4]


def test_regions_by_connectivity(spark):
    cells = spark.createDataFrame([(1, y, x) for y, x in ((0, 0), (1, 1), (1, 2), (5, 0))], "image_id int, y int, x int")
    assert K.connected_regions(cells, 4).select("region_id").distinct().count() == 3
    assert K.connected_regions(cells, 8).select("region_id").distinct().count() == 2


def test_ring_is_hollow(spark):
    ring = block(0, 0, 12, 12) - block(3, 3, 6, 6)
    masks = mask_rows(spark, {1: ring, 2: block(30, 30, 7, 7)}).withColumnRenamed("region_id", "particle_id").select("particle_id", "y", "x")
    got = {r.particle_id: (r.is_hollow, r.shell_px) for r in U.shell_from_holes(masks).collect()}
    assert got == {1: (True, 2.0), 2: (False, 0.0)}


def test_surface_of_a_disc(spark):
    disc = spark.createDataFrame([(1, 1, "a", 100.0, 100.0)], "particle_id int, image_id int, label string, x double, y double").select(
        "particle_id", "image_id", "label", G.regular_polygon(F.col("x"), F.col("y"), F.lit(30.0), 64).alias("vertices"), F.lit(1.0).alias("pixel_size_nm"), F.lit(0.1).alias("px_unc_nm"))
    row = U.estimate_surface_area(disc, "ellipsoid").first()
    assert row.SA_nm2 == pytest.approx(4 * math.pi * 900, rel=0.01) and row.SA_nm2_uncertainty == pytest.approx(0.2 * row.SA_nm2)
    assert row.coverage_score > 0.98 and not row.flagged and not row.is_hollow
    crossings = U.monte_carlo_perimeter(spark.createDataFrame([(1, y, x) for y in range(61) for x in range(61) if (y - 30) ** 2 + (x - 30) ** 2 <= 900], "particle_id int, y int, x int"))
    # Lines that graze the pixel staircase cross it several times, so the estimate lies above the smooth length.
    assert 2 * math.pi * 30 * 0.95 < crossings.first().perimeter_px < 8 * 30


def test_splits_never_divide_a_source(spark):
    images = spark.range(1, 201).select(F.col("id"), (F.col("id") % 10).alias("source_image_id"))
    parts = D.split_images(images, D.split_sources(images))
    assert parts.groupBy("source_image_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert {r.split: r["count"] for r in D.split_sources(images).groupBy("split").count().collect()} == {"test": 1, "val": 1, "train": 8}
    assert D.auto_counts(3, 0.9, 0.9) == (1, 1) and D.split_counts(2, 0.9, 0.9) == (1, 0)


def test_tiles_cover_every_pixel(spark):
    image = spark.createDataFrame([(1, 2200, 500)], "image_id int, height int, width int")
    starts = sorted({r.y0 for r in D.tile_grid(image).collect()})
    assert starts == [0, 768, 1176] and {r.x0 for r in D.tile_grid(image).collect()} == {0}


def test_orientations_match_numpy(spark):
    a = np.arange(12).reshape(3, 4)
    rows = spark.createDataFrame([(int(v), y, x) for (y, x), v in np.ndenumerate(a)], "v int, y int, x int")
    got = D.augment_8(rows, F.lit(3), F.lit(4)).collect()
    for i, name in enumerate(D.ORIENTATIONS):
        want = np.rot90(np.fliplr(a) if i > 3 else a, i % 4)
        assert all(want[r.y, r.x] == r.v for r in got if r.aug == name)


def test_exact_tail_with_a_large_second_group():
    n1, n2 = 4, 30000
    u = n1 * n2 / 2 + 40000
    z = (u - n1 * n2 / 2 - 0.5) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    assert C._exact_u_tail(u, n1, n2) == pytest.approx(math.erfc(z / math.sqrt(2)), abs=0.02)


def test_variance_ratio_with_a_large_common_mean(spark):
    rng = np.random.default_rng(7)
    parts = [rng.normal(1e9 + m, 1.0, 50) for m in (0.0, 0.5, 1.0)]
    df = spark.createDataFrame([(str(g), float(x)) for g, part in enumerate(parts) for x in part], "grp string, v double")
    centred = [p - 1e9 for p in parts]
    grand = np.concatenate(centred).mean()
    between = sum(50 * (p.mean() - grand) ** 2 for p in centred) / 2
    within = sum(((p - p.mean()) ** 2).sum() for p in centred) / 147
    assert C.anova_oneway(df, "grp", "v").first().f_statistic == pytest.approx(between / within, rel=1e-4)


def test_step_up_with_ties_and_keys(spark):
    rng = np.random.default_rng(8)
    rows = [(k, i, float(p)) for k in ("x", "y") for i, p in enumerate(np.round(rng.uniform(0, 1, 40) ** 3, 2))]
    df = spark.createDataFrame(rows, "k string, i int, p double")
    got = {(r.k, r.i): r.p_fdr for r in C.bh_fdr(df, "p", ["k"]).collect()}
    for k in ("x", "y"):
        p = np.array([r[2] for r in rows if r[0] == k])
        want = [min(1.0, min(q * 40 / (p <= q).sum() for q in p if q >= one)) for one in p]
        assert [got[(k, i)] for i in range(40)] == pytest.approx(want)


def test_statistics_follow_the_groups(spark):
    rng = np.random.default_rng(11)
    sets = {"a": rng.normal(0, 1, 40), "b": rng.normal(1.2, 1, 50), "c": rng.exponential(1, 60)}

    def table(*names):
        return spark.createDataFrame([(g, float(v), False) for g in names for v in sets[g]] + [("a", 99.0, True), ("alone", 1.0, False), (None, 2.0, False)], "label string, v double, flagged boolean")

    two, three = C.compare_groups(table("a", "b"), "label", "v"), C.compare_groups(table("a", "b", "c"), "label", "v")
    assert (two["test_used"], three["test_used"]) == ("mann_whitney", "kruskal_wallis+dunn")
    u = sum((x > y) + 0.5 * (x == y) for x in sets["a"] for y in sets["b"])
    row = two["pairwise"].first()
    assert row.statistic == pytest.approx(u) or row.statistic == pytest.approx(40 * 50 - u)
    pooled = math.sqrt((39 * sets["a"].var(ddof=1) + 49 * sets["b"].var(ddof=1)) / 88)
    assert row.effect_size == pytest.approx(abs(sets["a"].mean() - sets["b"].mean()) / pooled) and row.significant
    assert {r.label: r.n for r in two["group_stats"].select("label", "n").collect()} == {"a": 40, "b": 50}
    ranks = {}
    for i, (v, g) in enumerate(sorted((v, g) for g in sets for v in sets[g])):
        ranks.setdefault(g, []).append(i + 1)
    sd = math.sqrt(150 * 151 / 12)
    for r in three["pairwise"].collect():
        a, b = ranks[r.group_a], ranks[r.group_b]
        assert r.statistic == pytest.approx(abs(np.mean(a) - np.mean(b)) / (sd * math.sqrt(1 / len(a) + 1 / len(b))))
    assert C.compare_groups(table("a"), "label", "v")["test_used"] == "none"

    plain = table("a", "b").where("NOT flagged")
    found = C.run_statistics(plain, "label", "v")
    assert (found["test"], found["all_normal"]) == ("Welch t-test", True)
    ea, eb = sets["a"].var(ddof=1) / 40, sets["b"].var(ddof=1) / 50
    assert found["comparison"].first().t_statistic == pytest.approx((sets["a"].mean() - sets["b"].mean()) / math.sqrt(ea + eb))
    assert C.run_statistics(table("a", "c").where("NOT flagged"), "label", "v")["test"] == "Mann-Whitney U"
    many = C.run_statistics(table("a", "b", "c").where("NOT flagged"), "label", "v")
    assert many["test"] == "Kruskal-Wallis" and "posthoc" in many
    p = {(r.group_a, r.group_b): r.p_bonferroni for r in many["posthoc"].collect()}
    raw = {(r.group_a, r.group_b): r.p_value for r in C.mann_whitney(table("a", "b", "c").where("NOT flagged"), "label", "v", 3).collect()}
    assert p.keys() == raw.keys() and all(p[k] == pytest.approx(min(1, 3 * raw[k])) for k in p)


def test_frames_are_aligned_in_two_passes(spark):
    rng = np.random.default_rng(3)
    scene = rng.normal(0, 1, (24, 24))
    scene = sum(np.roll(np.roll(scene, a, 0), b, 1) for a in range(3) for b in range(3))
    shifts = [(0, 0), (1, -1), (2, 1), (-1, 2)]
    rows = [("m", f, y, x, float(scene[6 + y + dy, 6 + x + dx] + rng.normal(0, 0.05))) for f, (dy, dx) in enumerate(shifts) for y in range(12) for x in range(12)]
    frames = spark.createDataFrame(rows, "movie_id string, frame int, y int, x int, v double")
    got = {r.frame: (r.dy, r.dx) for r in X.motion_correct(frames, 3).collect()}
    assert got == dict(enumerate(shifts))


def test_studentized_range_is_fast_and_right():
    # Known 5 % points of the studentised range.
    for q, groups, df in ((3.877, 3, 10), (3.578, 3, 20), (4.232, 5, 20), (3.685, 4, 120)):
        assert Q.studentized_range_upper(q, groups, df) == pytest.approx(0.05, abs=6e-4)
