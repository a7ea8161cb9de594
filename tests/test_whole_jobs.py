"""Registered queries that run the whole job, against brute force on small tables."""

import hashlib
import math
from types import SimpleNamespace

import numpy as np
import pytest

from mesograph.operators.compare import SPREAD, permutation_test
from mesograph.queries import registry
from mesograph.queries import surface as surface_queries

POINTS = "image_id long, point_id long, label string, x_nm double, y_nm double"


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2 ** 52


def given(spark, seed, n, labels):
    rng = np.random.default_rng(seed)
    return [(1, i, labels[i % len(labels)], float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 2000, (n, 2)))]


def test_production_draws_of_patterns(spark):
    rows = given(spark, 1, 8, "a")
    t = SimpleNamespace(points=lambda: spark.createDataFrame(rows, POINTS))

    def mean(xy):
        return np.mean([min(math.dist(p, q) for j, q in enumerate(xy) if j != i) for i, p in enumerate(xy)])

    seen = mean([r[3:] for r in rows])
    sims = [mean([(2000 * draw(0, "x", s, 1, r[1]), 2000 * draw(0, "y", s, 1, r[1])) for r in rows]) for s in range(199)]
    le, ge = sum(x <= seen for x in sims), sum(x >= seen for x in sims)
    got = registry.load()["nnd_montecarlo_p"].build(t).first()
    assert (got.n_le, got.n_ge) == (le, ge) and got.p_montecarlo_plus == pytest.approx(min(1, 2 * (min(le, ge) + 1) / 200))
    assert registry.load()["csr_simulate"].build(t).count() == 8 * 199


def test_production_draws_of_labels(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"Brand#{1 + i % 2}", float(v)) for i, v in enumerate(rng.normal(0, 1, 10))]
    t = SimpleNamespace(measurements=lambda: spark.createDataFrame(rows, "particle_id long, label string, ecd_nm double"))
    values = dict((r[0], r[2]) for r in rows)

    def gap(first):
        return abs(np.mean([values[i] for i in first]) - np.mean([values[i] for i in values if i not in first]))

    seen = gap({r[0] for r in rows if r[1] == "Brand#1"})
    full = 2 ** 64 - 1

    def place(k, i):
        z = (int(draw(0, i) * 2 ** 52) + (k + 1) * SPREAD[0]) & full
        z = ((z ^ (z >> 30)) * SPREAD[1]) & full
        z = ((z ^ (z >> 27)) * SPREAD[2]) & full
        return z ^ (z >> 31)

    hits = sum(gap(set(sorted(values, key=lambda i: place(k, i))[:5])) >= seen - 1e-9 for k in range(10000))
    got = registry.load()["permutation_test"].build(t).first()
    assert got.n_extreme == hits and got.p_value == pytest.approx((hits + 1) / 10001)


def test_permutations_of_many_rows(spark):
    """Far more rows than buckets: the rows moved are few, and the share agrees with a plain shuffle."""
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0.15, 1, 900), rng.normal(0, 1, 400)])
    rows = [(i, "a" if i < 900 else "b", float(v)) for i, v in enumerate(values)]
    got = permutation_test(spark.createDataFrame(rows, "id long, grp string, v double"), "grp", "v", "id", "a", "b", 400).first()
    full, perms = np.uint64(0), np.arange(400)
    base = np.array([int(draw(0, i) * 2 ** 52) for i in range(1300)], np.uint64)
    hits = 0
    with np.errstate(over="ignore"):
        for k in perms:
            z = base + np.uint64(k + 1) * np.uint64(SPREAD[0]) + full
            z = (z ^ (z >> np.uint64(30))) * np.uint64(SPREAD[1])
            z = (z ^ (z >> np.uint64(27))) * np.uint64(SPREAD[2])
            first = np.argsort(z ^ (z >> np.uint64(31)))[:900]
            total = values[first].sum()
            hits += abs(total / 900 - (values.sum() - total) / 400) >= abs(values[:900].mean() - values[900:].mean()) - 1e-9
    assert got.n_extreme == hits and got.p_value == pytest.approx((hits + 1) / 401)


def test_production_lines_of_perimeters(spark, monkeypatch):
    masks = {1: [(y, x) for y in range(-3, 5) for x in range(7) if (y, x) != (0, 3)], 2: [(5, 5)]}
    table = spark.createDataFrame([(k, y, x) for k, m in masks.items() for y, x in m], "particle_id int, y int, x int")
    monkeypatch.setattr(surface_queries, "masks", lambda t: table)
    got = {r.particle_id: r.perimeter_px for r in registry.load()["monte_carlo_perimeter"].build(None).collect()}
    for key, mask in masks.items():
        y0, x0 = min(y for y, _ in mask) - 2, min(x for _, x in mask) - 2
        h, w = max(y for y, _ in mask) + 3 - y0, max(x for _, x in mask) + 3 - x0
        d = math.hypot(h, w)
        n, crossings = math.floor(d) + 2, 0
        for line in range(2000):
            a, t = draw(42, "angle", line, key) * math.pi, (draw(42, "offset", line, key) - 0.5) * d
            walk = [-d / 2 + d * k / (n - 1) for k in range(n)]
            at = [(round(h / 2 + s * math.sin(a) + t * math.cos(a)), round(w / 2 + s * math.cos(a) - t * math.sin(a))) for s in walk]
            met = [(y + y0, x + x0) in set(mask) for y, x in at if 0 <= y < h and 0 <= x < w]
            crossings += sum(p != q for p, q in zip(met, met[1:]))
        assert got[key] == pytest.approx(math.pi * d * crossings / 4000, rel=2e-3)


def test_manifests_keep_every_region(spark):
    # Keys that are equal modulo 40000, or equal altogether, are different regions.
    keys = ["1-1", "1-2", "40001-1", "80001-1", "7-1"]
    rows = [(image, key, label, 0.0, 0.0, float(i + 1), 2.0) for image in (1, 2) for label in "A" for i, key in enumerate(keys)] + [(3, "5-1", "N", 0.0, 0.0, 1.0, 1.0)]
    t = SimpleNamespace(spark=spark, rects=lambda: spark.createDataFrame(rows, "image_id long, ann_id string, label string, x0 double, y0 double, x1 double, y1 double"))
    written = {r.image_id: r.n for r in registry.load()["write_label_manifest"].build(t).collect()}
    assert written == {1: 5, 2: 5, 3: 1}
    read = {(r.image_id, r.label): (r.n, r.area) for r in registry.load()["read_label_manifest"].build(t).collect()}
    areas = [2.0, 4.0, 10.0, 6.0, 8.0]  # in the order 1-1, 1-2, 7-1, 40001-1, 80001-1
    assert read == {(i, f"region_{k}"): (1, a) for i in (1, 2) for k, a in enumerate(areas)} | {(3, "N"): (1, 1.0)}


def test_all_ordered_pairs_of_labels(spark):
    rows = given(spark, 3, 9, "abc") + [(2, 20, "a", 1.0, 1.0), (2, 21, "b", 4.0, 5.0), (3, 30, "a", 1.0, 1.0)]
    t = SimpleNamespace(points=lambda: spark.createDataFrame(rows, POINTS))
    near = {}
    for image, point, label, x, y in rows:
        for other in {r[2] for r in rows if r[0] == image} - {label}:
            near[image, label, other, point] = min(math.dist((x, y), r[3:]) for r in rows if r[0] == image and r[2] == other)
    got = {tuple(r)[:4]: r.cross_nnd_nm for r in registry.load()["cross_nearest"].build(t).collect()}
    assert got.keys() == near.keys() and all(got[k] == pytest.approx(near[k]) for k in near)
    pairs = {k[:3] for k in near}
    means = {p: np.mean([d for k, d in near.items() if k[:3] == p]) for p in pairs}
    stats = {tuple(r)[:3]: r for r in registry.load()["cross_nn_stats"].build(t).select("image_id", "from_label", "to_label", "mean_cross_nnd_nm", "n_b").collect()}
    assert stats.keys() == pairs and all(stats[p].mean_cross_nnd_nm == pytest.approx(means[p]) for p in pairs)
    drawn = {tuple(r)[:3]: r for r in registry.load()["cross_montecarlo_p"].build(t).collect()}
    assert drawn.keys() == pairs
    for image, a, b in pairs:
        fixed, ids = [r[3:] for r in rows if r[0] == image and r[2] == a], [r[1] for r in rows if r[0] == image and r[2] == b]
        sims = []
        for s in range(199):
            xy = [tuple(2000 * draw(0, axis, s, image, a, b, i) for axis in "xy") for i in ids]
            sims.append(np.mean([min(math.dist(p, q) for q in xy) for p in fixed]))
        assert drawn[image, a, b].n_le == sum(x <= means[image, a, b] for x in sims)
