"""Forms that keep a step's work in proportion to the tables: what is copied, broadcast or shuffled, next to brute force."""

import numpy as np
from pyspark.sql import functions as F

from mesograph.operators import graph
from mesograph.operators import masks as K
from mesograph.operators import spatial as S
from mesograph.operators import surface as U
from mesograph.operators import tracking as T
from mesograph.operators.ordering import join_sorted


def test_pairs_within_a_radius_are_joined_by_shuffles(spark, tmp_path):
    rng = np.random.default_rng(3)
    xy = np.vstack([rng.uniform(-50, 50, (150, 2)), [(0, 0), (5, 0), (3, 4), (-5, 0), (10, 0)]])  # some exactly a radius apart
    left = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "image_id int, i int, x_nm double, y_nm double")
    left.write.parquet(str(tmp_path / "points"))
    left = spark.read.parquet(str(tmp_path / "points"))
    right = left.selectExpr("image_id", "i AS j", "x_nm AS bx", "y_nm AS by")
    pairs = S.near_pairs(left, right, 5.0)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BuildLeft" not in plan
    assert plan.count("BroadcastHashJoin") == plan.count("LeftOuter, BuildRight")  # the list of hot cells alone is broadcast
    got = sorted((r.i, r.j) for r in pairs.collect())
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    assert got == sorted(map(tuple, np.argwhere(d2 <= 25.0).tolist()))


def test_links_of_later_frames(spark):
    rng = np.random.default_rng(4)
    rows = [("s", int(f), i, float(x), float(y)) for i, (f, x, y) in enumerate(zip(rng.integers(0, 6, 120), *rng.uniform(0, 60, (2, 120))))]
    got = {(r.a, r.b) for r in T.candidate_links(spark.createDataFrame(rows, "sequence_id string, frame int, ann_idx int, x_px double, y_px double"), 12.0, 1).collect()}
    want = {(a[2], b[2]) for a in rows for b in rows if 1 <= b[1] - a[1] <= 2 and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= 144.0}
    assert got == want


def test_runs_are_moved_once(spark):
    runs = spark.createDataFrame([(1, r, y, x, x + 4) for r, x in ((1, 0), (2, 2), (3, 62)) for y in range(3)] + [(None, 9, 0, 0, 4)], "image_id int, region_id int, y int, xa int, xb int")
    painted = K.label_mask_paint(runs)
    plan = painted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(image_id") <= 3  # the count of regions takes two of them
    assert "SortMergeJoin" not in plan
    got = {(r.y, x): r.region_id for r in painted.collect() for x in range(r.xa, r.xb)}
    assert got == {(y, x): max(r for r, a in ((1, 0), (2, 2), (3, 62)) if a <= x < a + 4) for y in range(3) for x in (*range(6), *range(62, 66))}


def test_peaks_of_many_rows_are_those_of_each():
    rng = np.random.default_rng(6)
    for n in (20, 31, 64):
        values = rng.integers(0, 7, (200, n)).astype(float)  # plateaus and ties
        height = np.percentile(values, 80, axis=1)
        row, spot = U.peaks_of_rows(values, height, 5)
        assert [spot[row == k].tolist() for k in range(200)] == [U.find_peaks(v, h, 5).tolist() for v, h in zip(values, height)]


def test_rounds_and_crowds_are_not_broadcast(spark):
    """Small inputs whose joins grow (tracks in rounds, points sent to the cells around them) are planned without a broadcast of the growing side."""
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 40, 2)], "src int, dst int")
    nodes = spark.range(41).select(F.col("id").cast("int").alias("node"))
    found = graph.connected_components(nodes, pairs, join=join_sorted)
    assert {r.node: r.component for r in found.collect()} == {i: i - i % 2 for i in range(41)}
    points = spark.createDataFrame([(1, i, float(i % 40), float(i // 40)) for i in range(1200)], "image_id int, point_id int, x_nm double, y_nm double")
    locs = S.locations(points)
    crowd = S._count_in_crowd(locs.select("image_id", "loc", "x_nm", "y_nm"), locs, 8.0, ["image_id"])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert crowd._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 4
    near = {r.loc: r.near for r in crowd.collect()}
    assert near == {i: sum((i % 40 - j % 40) ** 2 + (i // 40 - j // 40) ** 2 <= 64 for j in range(1200)) for i in range(1200)}


def test_annotations_are_not_dealt_by_category(spark):
    """A join with the few categories leaves the annotations where they are."""
    from mesograph.operators import dataset as D

    categories = spark.createDataFrame([(1, "a"), (2, "Background"), (3, "b")], "id int, name string")
    rows = [(i, 1 + i % 3, 900, 900, 10.0 * (i % 50), 20.0, 30.0, 40.0, None) for i in range(200)]
    notes = spark.createDataFrame(rows, "image_id int, category_id int, width int, height int, bx double, by_ double, bw double, bh double, segmentation array<double>").repartition(8)
    lines = D.yolo_lines(notes, categories)
    assert {r.category_id: r.line.split()[0] for r in lines.collect()} == {1: "0", 3: "1"} and lines.count() == 133
    assert lines.rdd.getNumPartitions() == 8
    labelled = D._with_category(notes.drop("category_id").withColumn("label", F.lit(" A")), categories)
    assert labelled.rdd.getNumPartitions() == 8 and {r.category_id for r in labelled.collect()} == {1}


def brute_nearest(a, b, same):
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    if same:
        np.fill_diagonal(d, np.inf)
    return d.min(axis=1)


def test_nearest_neighbours_are_found_in_tiles(spark, monkeypatch):
    """A point with a wide gap around it, points at the border and copies: told by their tile, with text ids, without the pyramid of all points."""
    grid = np.array([(10.0 * i, 10.0 * j) for i in range(40) for j in range(40)])
    gap = np.hypot(*(grid - grid[820]).T)
    xy = np.vstack([grid[(gap == 0) | (gap > 25)], grid[:3]])
    rows = [(1, f"p{i:05d}", "a", x, y) for i, (x, y) in enumerate(xy.tolist())] + [(2, "lone", "a", 1.0, 1.0), (3, "twice", "a", 1.0, 1.0), (3, "twin", "a", 1.0, 1.0), (None, "no", "a", 1.0, 1.0), (1, "null", "a", None, 1.0)]
    points = spark.createDataFrame(rows, "image_id int, point_id string, label string, x_nm double, y_nm double")

    def pyramid(*_):
        raise AssertionError("no point is left for the pyramid")

    want = brute_nearest(xy, xy, True)
    monkeypatch.setattr(S, "nearest_by_pyramid", pyramid)
    for whole in (0, S.WHOLE_KEY):
        monkeypatch.setattr(S, "WHOLE_KEY", whole)
        got = {r.point_id: r.nnd_nm for r in S.nearest_neighbour_join(points).collect()}
        assert got == {**{f"p{i:05d}": d for i, d in enumerate(want.tolist())}, "twice": 0.0, "twin": 0.0}
    far = spark.createDataFrame([(1, 7, "a", -1e6, 4.0), (4, 8, "a", 0.0, 0.0)], "image_id int, point_id int, label string, x_nm double, y_nm double")
    few = spark.createDataFrame([(1, 1, "b", 3.0, 4.0), (1, 2, "b", 8.0, 9.0)], far.schema)
    assert [(r.point_id, r.cross_nnd_nm) for r in S.cross_nearest_join(far, few).collect()] == [(7, 1e6 + 3.0)]
    assert max(want) > 28.0


def test_small_and_crowded_tiles(spark, monkeypatch):
    """Tiles of a few points, of which the crowded ones and the far queries go by the pyramid."""
    monkeypatch.setattr(S, "TILE", 16)
    monkeypatch.setattr(S, "WHOLE_KEY", 0)
    monkeypatch.setattr(S, "TILE_ROWS", 60)
    rng = np.random.default_rng(5)
    b = np.vstack([rng.normal(500, 2, (90, 2)), rng.uniform(0, 1000, (150, 2))])
    a = np.vstack([rng.uniform(-2000, 3000, (40, 2)), rng.uniform(480, 520, (40, 2))])
    as_points = [spark.createDataFrame([(1, i, "a", *p) for i, p in enumerate(xy.tolist())], "image_id int, point_id int, label string, x_nm double, y_nm double") for xy in (a, b)]
    near = {r.point_id: r.nnd_nm for r in S.nearest_neighbour_join(as_points[1]).collect()}
    assert np.allclose([near[i] for i in range(len(b))], brute_nearest(b, b, True))
    cross = {r.point_id: r.cross_nnd_nm for r in S.cross_nearest_join(*as_points).collect()}
    assert np.allclose([cross[i] for i in range(len(a))], brute_nearest(a, b, False))


def test_halves_find_what_all_places_find(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(S, "CROWD", 8)
    for held in (rng.uniform(0, 100, (400, 2)), rng.normal(0, 1, (300, 2)) ** 5, rng.integers(0, 9, (200, 2)).astype(float), np.zeros((30, 2))):
        asked = np.vstack([held[::2], rng.uniform(-50, 150, (50, 2))])
        own = np.r_[np.arange(0, len(held), 2), np.full(50, -1)]
        d2 = ((asked[:, None] - held[None]) ** 2).sum(axis=2)
        d2[np.flatnonzero(own >= 0), own[own >= 0]] = np.inf
        best, least = S._nearest_in(*asked.T, own, *held.T, np.arange(len(held)))
        assert np.array_equal(least, d2.min(axis=1)) and np.array_equal(d2[np.arange(len(best)), best], least)
        assert np.array_equal(best, d2.argmin(axis=1))


def test_density_is_counted_in_tiles(spark, monkeypatch):
    """Points go to a tile and its margin, not to the cells around them, and pairs are never rows; crowded tiles are counted by cells."""
    rng = np.random.default_rng(7)
    xy = np.vstack([rng.uniform(-300, 900, (500, 2)), rng.integers(0, 5, (60, 2)) * 3.0])
    points = spark.createDataFrame([(1, i, "a", *p) for i, p in enumerate(xy.tolist())] + [(None, 999, "a", 0.0, 0.0), (1, 998, "a", None, 0.0)], "image_id int, point_id int, label string, x_nm double, y_nm double")
    want = {i: int(n) - 1 for i, n in enumerate((((xy[:, None] - xy[None]) ** 2).sum(axis=2) <= 900.0).sum(axis=1))}

    def by_pairs(*_):
        raise AssertionError("pairs of points became rows")

    with monkeypatch.context() as held:
        held.setattr(S, "near_pairs", by_pairs)
        assert {r.point_id: r.n_neighbors for r in S.local_density(points, 30.0).collect()} == want
    monkeypatch.setattr(S, "COUNTED_ROWS", 30)
    assert {r.point_id: r.n_neighbors for r in S.local_density(points, 30.0).collect()} == want


def test_masks_are_traced_and_measured_as_one_row_each(spark):
    """Rings and instance measures of packed masks are those by tables of edges and runs, for pixels and for runs, some of them drawn twice."""
    from mesograph.operators import dataset as D
    from mesograph.operators import outlines as O

    rng = np.random.default_rng(8)
    key = ["image_id", "tile_idx", "aug", "region_id"]
    pixels = [(image, 0, aug, 1, int(y), int(x)) for image in range(12) for aug in ("orig", "rot90") for y, x in np.argwhere(rng.random((9, 9)) < 0.08 * image)]
    masks = spark.createDataFrame([*pixels, *pixels[:20], (50, 0, "orig", 1, 4, 4), (51, 0, "orig", 1, 0, 8), (51, 0, "orig", 1, 1, 7), (None, 0, "orig", 1, 1, 7)],
                                  "image_id int, tile_idx int, aug string, region_id int, y int, x int")
    runs = spark.createDataFrame([(7, 0, "orig", 1, 2, 0, 5), (7, 0, "orig", 1, 2, 3, 8), (7, 0, "orig", 1, 3, 0, 2)], "image_id int, tile_idx int, aug string, region_id int, y int, xa int, xb int")
    for given in (masks, runs):
        one, other = ({(*r[:4], r.ring): r for r in O.mask_rings(given, key, n).collect()} for n in (1 << 22, 0))
        assert one == other and one
    one, other = ({r[:4]: r for r in D.instance_stats(masks, 9, n).collect()} for n in (1 << 22, 0))
    assert one == other and len(one) == len({p[:4] for p in pixels}) + 2
    plan = D.instance_stats(masks, 9)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan  # what is moved is the packed masks, before


def test_patterns_are_drawn_and_measured_in_their_task(spark, monkeypatch):
    """Means and pair counts of random patterns, told in a task, are those of the tables that `csr_simulate` draws, and no pattern is shuffled."""
    rng = np.random.default_rng(8)
    rows = [(int(k), f"p{i}", str(i % 3), float(x), float(y)) for i, (k, x, y) in enumerate(zip(rng.integers(0, 2, 90), *rng.uniform(0, 300, (2, 90))))]
    rows += [rows[0], (1, None, "0", 5.0, 5.0), (2, "lone", "0", 1.0, 1.0)]
    points = spark.createDataFrame(rows, "image_id int, point_id string, label string, x_nm double, y_nm double")
    fields = spark.createDataFrame([(k, 300.0, 200.0) for k in range(3)], "image_id int, width_nm double, height_nm double")
    a, b = S.label_pairs(points)
    pair = ["image_id", "from_label", "to_label"]
    pair_fields = a.select(*pair).distinct().withColumns({"width_nm": F.lit(300.0), "height_nm": F.lit(200.0)})

    def answers():
        one = S.nnd_montecarlo_p(points, fields, 19, 7)
        two = S.cross_montecarlo_p(a, b, pair_fields, 19, 7, pair)
        three = S.ripley_envelope(points, fields, [10.0, 40.0, 90.0], 19, 7)
        return [sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]) for df in (one, two, three)]

    with monkeypatch.context() as m:
        m.setattr(S, "csr_simulate", None)  # no table of patterns where keys are small
        inside = answers()
    monkeypatch.setattr(S, "PATTERN_POINTS", 0)
    assert inside == answers() and all(inside)


def test_nearest_gaps_and_pattern_counts_are_exact():
    rng = np.random.default_rng(9)
    steps = np.array([10.0, 50.0, 51.0, 400.0]) ** 2
    for n in (1, 2, 70, 900):
        x, y = rng.integers(0, 400, (2, n)).astype(float)  # ties, copies and distances equal to a radius
        u, v = rng.uniform(-300, 900, (2, 50))
        d2 = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
        assert S.pattern_counts(x, y, steps).tolist() == [(d2 <= s).sum() for s in steps]
        np.fill_diagonal(d2, np.inf)
        assert np.array_equal(S.nearest_gaps(x, y, x, y, True), np.sqrt(d2.min(axis=1)))
        assert np.allclose(S.nearest_gaps(u, v, x, y), np.sqrt(((u[:, None] - x) ** 2 + (v[:, None] - y) ** 2).min(axis=1)))
