"""Surface-area estimates of particles from their outlines.

The outline polygon, cut to steps of about one pixel, stands in for the traced contour.  A particle is a bounded
unit, so contour work runs as array expressions or in small numpy helpers per row; pixel work runs on mask rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesograph.functions import geometry as G
from mesograph.functions import hull as H
from mesograph.operators.masks import rasterize_roi
from mesograph.operators.ordering import hash_uniforms, join_on
from mesograph.operators.particles import NAMES, bounded, box_fit, city_block_depth, contours, gliding_lacunarity, hollow_shell, measure_column, rasters, spike_column, stacks
from mesograph.operators.spans import packed_runs, unpacked_pixels

# Fixed value: outline dimension above which a particle counts as spiky.
FRACTAL_LIMIT = 1.15
# Masks whose random lines are drawn together.
LINES_TOGETHER = 256
# Pixels of the raster around a particle, and its contour, up to which all of it is measured in one step.
WHOLE_PIXELS = 1 << 22
KEY = ["particle_id"]
METHODS = ["auto", "ellipsoid", "cauchy", "fourier", "fourier_spiky", "capsule", "perimeter", "monte_carlo", "richardson"]


# ---- closed forms

def sa_spheroid(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Surface of a spheroid with semi-axes a (along the axis) and b: prolate, oblate or a sphere."""
    big, small = F.greatest(a, b), F.least(a, b)
    e = F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.pow(small / F.nullif(big, F.lit(0.0)), F.lit(2))))
    safe = F.greatest(e, F.lit(1e-12))
    prolate = 2.0 * math.pi * b * b * (1.0 + a / F.nullif(b * safe, F.lit(0.0)) * F.asin(F.least(e, F.lit(1.0))))
    oblate = 2.0 * math.pi * b * b * (1.0 + (1.0 - e * e) / safe * F.atanh(F.least(e, F.lit(1.0 - 1e-15))))
    round_one = (F.abs(a - b) < tolerance) | (e < 1e-9)
    return (F.when((a <= 0) | (b <= 0), F.lit(0.0)).when(round_one, 4.0 * math.pi * big * big).when(a > b, prolate).otherwise(oblate))


def sa_inner_spheroid(a: Column, b: Column) -> Column:
    """The same with axes within one percent taken as a sphere of their mean."""
    near = F.abs(a - b) < 0.01 * F.greatest(a, b)
    mean = (a + b) / 2.0
    return F.when((a > 0) & (b > 0) & near, 4.0 * math.pi * mean * mean).otherwise(sa_spheroid(a, b))


def box_aspect(width: Column, height: Column) -> Column:
    return F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1.0))


def sa_cauchy(area_nm2: Column, aspect: Column) -> Column:
    return (4.0 + 0.5 * F.pow(F.greatest(aspect - 1.0, F.lit(0.0)), F.lit(0.7))) * area_nm2


def sa_capsule(long_nm: Column, short_nm: Column) -> Column:
    r = short_nm / 2.0
    return 2.0 * math.pi * r * (2.0 * r + F.greatest(F.lit(0.0), long_nm - 2.0 * r))


def sa_isoperimetric(perimeter_nm: Column, circularity: Column) -> Column:
    return perimeter_nm * perimeter_nm / (math.pi * F.greatest(F.lit(0.05), F.least(F.lit(1.0), circularity)))


def sa_projected(area_nm2: Column) -> Column:
    return 4.0 * area_nm2


def sa_uncertainty(sa: Column, px: Column, px_unc: Column) -> Column:
    return F.when((px_unc > 0) & (px > 0), sa * 2.0 * px_unc / F.nullif(px, F.lit(0.0))).otherwise(F.lit(0.0))


def select_method(fractal: Column, aspect: Column, circularity: Column, convexity: Column) -> Column:
    return (F.when(fractal > FRACTAL_LIMIT, "fourier_spiky").when((aspect > 2.5) & (convexity > 0.85), "capsule")
            .when((circularity > 0.75) & (convexity > 0.85), "ellipsoid").when(convexity > 0.85, "cauchy").otherwise("fourier"))


def coverage_score(mask_area: Column, a_px: Column, b_px: Column) -> Column:
    ellipse = math.pi * a_px * b_px
    return F.when(ellipse > 0, F.least(F.lit(1.0), mask_area / F.nullif(ellipse, F.lit(0.0)))).otherwise(F.lit(1.0))


def aggregate_score(deep_defects: Column) -> Column:
    return F.least(F.lit(1.0), deep_defects / 5.0)


def hollow_correction(sa: Column, a: Column, b: Column, shell_nm: Column, hollow: Column) -> Column:
    """Add the inner surface of a hollow particle when a shell is known and thinner than both axes."""
    fits = hollow & (a > 0) & (shell_nm > 0) & (a - shell_nm > 0) & (b - shell_nm > 0)
    return F.when(fits, sa + sa_inner_spheroid(a - shell_nm, b - shell_nm)).otherwise(sa)


# ---- contour measures

def with_contour(particles: DataFrame) -> DataFrame:
    return particles.withColumn("contour", G.densify(F.col("vertices")))


def contour_metrics(particles: DataFrame) -> DataFrame:
    """Circularity, convexity, box aspect and the number of deep dents of each outline."""
    v = F.col("vertices")
    out = particles.withColumns({"area_px": G.shoelace(v), "perimeter_px": G.perimeter(v), "_h": H.hull_measures(v),
                                 "box_w": G.extent(v, "x"), "box_h": G.extent(v, "y")})
    tiny = (F.col("area_px") < 4) | (F.col("perimeter_px") < 4)
    convex = F.when(F.col("_h.hull_area") > 0, F.least(F.lit(1.0), F.col("area_px") / F.nullif("_h.hull_area", F.lit(0.0)))).otherwise(F.lit(0.0))
    return out.withColumns({
        "circularity": F.when(tiny, F.lit(0.0)).otherwise(G.circularity(F.col("area_px"), F.col("perimeter_px"))),
        "convexity": F.when(tiny, F.lit(0.0)).otherwise(convex),
        "box_aspect": F.when(tiny, F.lit(1.0)).otherwise(box_aspect(F.col("box_w"), F.col("box_h"))),
        "rect_long": F.col("_h.rect_long"), "rect_short": F.col("_h.rect_short"),
        "aggregate_score": aggregate_score(F.col("_h.deep_defects"))}).drop("_h")


def contour_points(particles: DataFrame, keys: Sequence[str] = KEY, packed: bool = False) -> DataFrame:
    """Contour points as rows (keys, i, x, y), or `packed` as one row per key, whose `contour` holds x and y of all its points in turn.

    Outlines of a key are put together before their points are made, so a packed contour moves as its few vertices.
    """
    if not packed:
        return particles.select(*keys, F.posexplode(G.densify(F.col("vertices"))).alias("i", "p")).select(*keys, "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))

    def points(xs: pd.Series, ys: pd.Series, sizes: pd.Series) -> pd.Series:
        size = [np.asarray(s, np.int64) for s in sizes]
        x, y, counts = contours(*(np.concatenate([*(np.asarray(c, float) for c in s), np.zeros(0)]) for s in (xs, ys)), np.cumsum(np.concatenate([*size, np.zeros(0, np.int64)])))
        ends = np.r_[0, np.cumsum(counts)][np.cumsum([len(s) for s in size])]
        return pd.Series(np.split(np.column_stack([x, y]).ravel(), 2 * ends[:-1]) if len(size) else [], dtype=object)

    outlines = particles.where(F.size("vertices") > 0).groupBy(*keys).agg(F.collect_list("vertices").alias("_o"))
    flat = F.flatten("_o")
    return outlines.select(*keys, F.pandas_udf(points, "array<double>")(*_axes(flat), F.transform("_o", lambda v: F.size(v))).alias("contour"))


def _points_of(packed: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates of all points of packed contours, and the number of points of each."""
    parts = [np.asarray(c, float) for c in packed]
    pair = np.concatenate([*parts, np.zeros(0)]).reshape(-1, 2)
    return pair[:, 0], pair[:, 1], np.array([len(c) // 2 for c in parts], np.int64)


def box_count_fractal(points: DataFrame, size: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Box-counting dimension of pixelated contours, given as points or packed; `size` gives the raster height and width per key."""
    keys = list(keys)
    first = F.greatest(F.lit(2), F.floor(F.least("height", "width") / 2).cast("int"))
    halvings = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.floor(first / F.pow(F.lit(2.0), k)).cast("int"))
    sides = F.filter(halvings, lambda s: s >= 2)
    if "contour" in points.columns:
        return _box_count_packed(points, size.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_set(sides))).alias("_s")), keys)
    cells = points.select(*keys, F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y")).distinct()
    sizes = size.select(*keys, F.explode(sides).alias("s"))
    hits = (join_on(cells, sizes, keys).select(*keys, "s", F.floor(F.col("x") / F.col("s")).alias("bx"), F.floor(F.col("y") / F.col("s")).alias("by_")).distinct()
            .groupBy(*keys, "s").agg(F.count(F.lit(1)).alias("n")))
    slope = F.regr_slope(F.log(F.col("n").cast("double")), F.log(1.0 / F.col("s")))
    fit = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), slope.alias("_d"))
    total = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    flat = (F.col("_n") < 10) | (F.coalesce("_k", F.lit(0)) < 3)
    return join_on(total, fit, keys, "left").select(*keys, F.when(flat, F.lit(1.0)).otherwise(
        F.greatest(F.lit(1.0), F.least(F.lit(2.0), F.col("_d")))).alias("fractal_dim"))


def _box_count_packed(contour: DataFrame, sides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same on packed contours: the pixels and boxes of a contour are counted in its task, many contours at a time."""
    def measure(packed: pd.Series, sides: pd.Series) -> pd.Series:
        x, y, counts = _points_of(packed)
        px, py = (np.where(np.isnan(c), -(1 << 40), np.floor(c)).astype(np.int64) for c in (x, y))  # unknown ones share a pixel of their own
        asked = [[] if s is None else s for s in sides]
        table = np.zeros((len(asked), max([1, *map(len, asked)])), np.int64)
        for row, s in zip(table, asked):
            row[:len(s)] = s
        return pd.Series(box_fit(px, py, counts, table))

    return join_on(contour, sides, keys, "left").select(*keys, F.pandas_udf(measure, "double")("contour", "_s").alias("fractal_dim"))


def richardson(particles: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Outline length at steps 1, 2, 4 ... and the fitted dimension and length at one pixel."""
    keys = list(keys)

    def lengths(xs: pd.Series, ys: pd.Series) -> pd.Series:
        x, y, counts = _outlined(xs, ys)
        begin = np.cumsum(counts) - counts
        out = [np.zeros(0)] * len(xs)
        for rows in stacks(counts):
            n = int(counts[rows[0]])
            points = np.stack([c[begin[rows][:, None] + np.arange(n)] for c in (x, y)], axis=2)
            steps = [1 << k for k in range(31) if (1 << k) <= max(2, n // 4) and -(-n // (1 << k)) >= 3]
            each = np.zeros((len(rows), len(steps)))
            for k, s in enumerate(steps):
                gap = np.roll(points[:, ::s], -1, axis=1) - points[:, ::s]
                each[:, k] = np.fmax(np.hypot(gap[..., 0], gap[..., 1]).sum(axis=1), 1e-9)  # an unknown length is none
            for r, found in zip(rows, np.log(each)):
                out[r] = found
        return pd.Series(out, dtype=object)

    base = particles.select(*keys, "pixel_size_nm", G.perimeter(F.col("vertices")).alias("_arc"), _contour_size(F.col("vertices")).alias("_n"),
                            F.pandas_udf(lengths, "array<double>")(*_axes(F.col("vertices"))).alias("_l"))
    points = base.select(*keys, "pixel_size_nm", "_arc", "_n", F.posexplode_outer("_l").alias("_p", "lp")).withColumn("ls", F.log(F.pow(F.lit(2.0), F.col("_p"))))
    fit = points.groupBy(*keys, "pixel_size_nm", "_arc", "_n").agg(
        F.count("ls").alias("_k"), F.regr_slope(F.col("lp"), F.col("ls")).alias("_m"), F.regr_intercept(F.col("lp"), F.col("ls")).alias("_b"))
    plain = (F.col("_n") < 20) | (F.col("_k") < 3)
    px = F.col("pixel_size_nm")
    return fit.select(*keys, F.when(plain, F.col("_arc") * px).otherwise(F.exp("_b") * px).alias("perimeter_nm"),
                      F.when(plain, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(2.0), 1.0 - F.col("_m")))).alias("richardson_fractal_dim"))


def _contour_size(vertices: Column) -> Column:
    """Number of contour points of an outline."""
    return F.aggregate(G.edges(vertices), F.lit(0), lambda s, e: s + F.greatest(F.ceil(F.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"])), F.lit(1)).cast("int"))


def radius_moments(points: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Contour points with their distance from the contour mean."""
    keys = list(keys)
    center = points.groupBy(*keys).agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"), F.count(F.lit(1)).alias("_n"))
    return join_on(points, center, keys).withColumn("r", F.hypot(F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")))


def roughness_index(points: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Spread of the contour radius over its mean, of contours given as points or packed."""
    if "contour" in points.columns:
        return points.select(*keys, F.pandas_udf(_roughness, "double")("contour").alias("roughness"))
    mean = F.avg("r")
    return radius_moments(points, keys).groupBy(*keys).agg(
        F.when((F.count(F.lit(1)) < 20) | (mean < 1e-6), F.lit(0.0)).otherwise(F.stddev_pop("r") / F.nullif(mean, F.lit(0.0))).alias("roughness"))


def _roughness(packed: pd.Series) -> pd.Series:
    """`roughness_index` of packed contours; unknown coordinates count as points, but not in means."""
    x, y, counts = _points_of(packed)
    owner = np.repeat(np.arange(len(counts)), counts)

    def mean(v: np.ndarray) -> np.ndarray:
        known = ~np.isnan(v)
        n = np.bincount(owner, known, minlength=len(counts))
        return np.where(n > 0, np.bincount(owner, np.where(known, v, 0.0), minlength=len(counts)) / np.maximum(n, 1), np.nan)

    r = np.hypot(x - mean(x)[owner], y - mean(y)[owner])
    middle = mean(r)
    spread = np.sqrt(mean((r - middle[owner]) ** 2))
    return pd.Series(np.where((counts < 20) | (middle < 1e-6), 0.0, spread / np.where(middle < 1e-6, 1.0, middle)))


def discrete_curvature(particles: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Turning of the contour at each point from the points two steps before and after it."""
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        x, y, counts = _outlined(xs, ys)
        begin = np.cumsum(counts) - counts
        out = [np.zeros(0)] * len(xs)
        for rows in stacks(counts):
            at = begin[rows][:, None] + np.arange(int(counts[rows[0]]))
            for r, found in zip(rows, _curvatures(np.stack([x[at], y[at]], axis=2))):
                out[r] = found
        return pd.Series(out, dtype=object)

    found = particles.select(*keys, F.posexplode(F.pandas_udf(run, "array<double>")(*_axes(F.col("vertices")))).alias("i", "curvature"))
    return found.withColumn("curvature", F.nanvl("curvature", F.lit(None).cast("double")))


def find_peaks(values: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Positions of local maxima at or above `height`, the higher one kept where two are nearer than `distance`.

    A plateau counts once, at its middle; the ends of the array are never peaks.
    """
    n = len(values)
    edges = np.flatnonzero(np.diff(values)) + 1
    starts, stops = np.r_[0, edges], np.r_[edges, n]
    top = values[starts]
    inner = np.zeros(len(starts), dtype=bool)
    inner[1:-1] = (top[1:-1] > top[:-2]) & (top[1:-1] > top[2:])
    spots = (starts[inner] + stops[inner] - 1) // 2
    spots = spots[values[spots] >= height]
    keep = np.ones(len(spots), dtype=bool)
    for k in np.argsort(values[spots], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(spots - spots[k]) < distance
            near[k] = False
            keep &= ~near
    return spots[keep]


def peaks_of_rows(values: np.ndarray, height: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """`find_peaks` on each row of a matrix, all at once: row and position of every peak, in order."""
    m, n = values.shape
    fresh = np.ones((m, n), bool)
    fresh[:, 1:] = values[:, 1:] != values[:, :-1]
    starts = np.flatnonzero(fresh)
    stops = np.r_[starts[1:], m * n]
    top = values.ravel()[starts]
    inner = (starts % n > 0) & (stops % n > 0)
    inner[1:-1] &= (top[1:-1] > top[:-2]) & (top[1:-1] > top[2:])
    spots = (starts[inner] + stops[inner] - 1) // 2
    spots = spots[values.ravel()[spots] >= height[spots // n]]
    row = spots // n
    highest = np.lexsort((-spots, -values.ravel()[spots], row))  # the later of equal ones first
    slot = np.arange(len(spots)) - np.searchsorted(row, row)
    most = int(slot.max()) + 1 if len(slot) else 0
    place = np.full((m, most), -distance - n)
    place[row, slot] = spots[highest] % n
    keep = place >= 0
    for k in range(most):
        near = keep[:, k, None] & (np.abs(place - place[:, k, None]) < distance)
        near[:, k] = False
        keep &= ~near
    kept = np.sort((np.arange(m)[:, None] * n + place)[keep])
    return kept // n, kept % n


def _curvatures(points: np.ndarray) -> np.ndarray:
    """`_curvature` of contours with the same number of points."""
    u, v = points - np.roll(points, 2, axis=1), np.roll(points, -2, axis=1) - points
    size = (np.hypot(u[..., 0], u[..., 1]) * np.hypot(v[..., 0], v[..., 1])) ** 1.5
    return np.abs(u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]) / np.maximum(size, 1e-9)


def _curvature(points: np.ndarray) -> np.ndarray:
    u, v = points - np.roll(points, 2, axis=0), np.roll(points, -2, axis=0) - points
    size = (np.hypot(u[:, 0], u[:, 1]) * np.hypot(v[:, 0], v[:, 1])) ** 1.5
    return np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) / np.maximum(size, 1e-9)


def _outlined(xs: pd.Series, ys: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contours of a batch of outlines, one after the other: coordinates and the number of points of each; null is empty."""
    parts = [[np.zeros(0) if c is None else np.asarray(c, float) for c in s] for s in (xs, ys)]
    x, y = (np.concatenate([*p, np.zeros(0)]) for p in parts)
    return contours(x, y, np.cumsum(np.array([len(p) for p in parts[0]], np.int64)))


def _axes(c: Column) -> tuple[Column, Column]:
    return F.transform(c, lambda p: p["x"]), F.transform(c, lambda p: p["y"])


def local_peaks(particles: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Positions of the contour curvature maxima above the 80th percentile, at least five points apart."""
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        x, y, counts = _outlined(xs, ys)
        begin = np.cumsum(counts) - counts
        out = [np.zeros(0, np.int32)] * len(xs)
        for rows in stacks(counts):
            n = int(counts[rows[0]])
            if n >= 20:
                at = begin[rows][:, None] + np.arange(n)
                curve = _curvatures(np.stack([x[at], y[at]], axis=2))
                row, spot = peaks_of_rows(curve, np.percentile(curve, 80, axis=1), 5)
                for r, spots in zip(rows, np.split(spot.astype(np.int32), np.searchsorted(row, np.arange(1, len(rows))))):
                    out[r] = spots
        return pd.Series(out, dtype=object)

    return particles.select(*keys, F.explode(F.pandas_udf(run, "array<int>")(*_axes(F.col("vertices")))).alias("i"))


def fourier_axes(p: np.ndarray) -> np.ndarray:
    """Of contours with the same number of points: mean radius plus and minus its first harmonic, roughness, mean radius."""
    if p.shape[1] < 20:
        return np.zeros((len(p), 4))
    rel = p - p.mean(axis=1, keepdims=True)
    amp = np.abs(np.fft.rfft(np.hypot(rel[..., 0], rel[..., 1]), axis=1)) / p.shape[1]
    rough = np.sqrt((amp[:, 2:] ** 2).sum(axis=1)) / np.maximum(amp[:, 0], 1e-6)
    out = np.column_stack([amp[:, 0] + amp[:, 1], np.maximum(amp[:, 0] - amp[:, 1], 1e-6), rough, amp[:, 0]])
    return np.where(amp[:, :1] < 1e-6, 0.0, out)


def spike_surface(points: np.ndarray, curve: np.ndarray | None = None, spots: np.ndarray | None = None) -> tuple[float, int]:
    """Lateral surface of the cones over the curvature peaks, in squared pixels, and the number of peaks."""
    if len(points) < 20:
        return 0.0, 0
    if spots is None:
        curve = _curvature(points)
        spots = find_peaks(curve, np.percentile(curve, 80), 5)
    r = np.hypot(*(points - points.mean(axis=0)).T)
    total = 0.0
    for k in spots:
        low = np.flatnonzero(curve <= curve[k] * 0.3)
        before, after = low[low < k], low[low > k]
        a, b = (before[-1] if len(before) else 0), (after[0] if len(after) else len(points) - 1)
        base, height = np.hypot(*(points[a] - points[b])) / 2.0, max(0.0, r[k] - r.mean())
        if base > 0 and height > 0:
            total += math.pi * base * math.hypot(height, base)
    return float(total), int(len(spots))


def _spike_surfaces(points: np.ndarray) -> np.ndarray:
    """`spike_surface` of contours with the same number of points, whose peaks are found all at once."""
    if points.shape[1] < 20:
        return np.zeros((len(points), 2))
    curves = _curvatures(points)
    row, spot = peaks_of_rows(curves, np.percentile(curves, 80, axis=1), 5)
    parts = np.split(spot, np.searchsorted(row, np.arange(1, len(points))))
    return np.array([spike_surface(*one) for one in zip(points, curves, parts)])


def fourier_measures(particles: DataFrame, spikes: bool = True) -> DataFrame:
    """Add the radial Fourier axes and the spike surface of each contour, in pixels."""
    names = ["a_px", "b_px", "rough", "r_mean", "spikes", "n_spikes"]

    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(xs), 6))
        x, y, counts = _outlined(xs, ys)
        begin = np.cumsum(counts) - counts
        for n in np.unique(counts):
            rows = np.flatnonzero(counts == n)
            at = begin[rows][:, None] + np.arange(n)
            points = np.stack([x[at], y[at]], axis=2)
            out[rows, :4] = fourier_axes(points)
            if spikes:
                out[rows, 4:] = _spike_surfaces(points)
        return pd.DataFrame(out, columns=names).astype({"n_spikes": "int32"})

    measure = F.pandas_udf(run, "a_px double, b_px double, rough double, r_mean double, spikes double, n_spikes int")
    return with_contour(particles).withColumn("_f", measure(*_axes(F.col("vertices"))))


def sa_fourier(a_nm: Column, b_nm: Column, rough: Column) -> Column:
    return F.when((a_nm <= 0) | (b_nm <= 0), F.lit(0.0)).otherwise(sa_spheroid(a_nm, b_nm) * (1.0 + 2.0 * rough))


def sa_fourier_spiky(base: Column, spikes_nm2: Column, n_spikes: Column, r_mean_nm: Column, perimeter_nm: Column) -> Column:
    scale = F.when((perimeter_nm > 0) & (r_mean_nm > 0), 4.0 * math.pi * r_mean_nm * r_mean_nm / F.nullif(perimeter_nm, F.lit(0.0))).otherwise(n_spikes.cast("double"))
    return base + spikes_nm2 * scale


def radial_signal(particles: DataFrame, samples: int = 256, keys: Sequence[str] = KEY) -> DataFrame:
    """Contour radius at evenly spaced angles from -pi, by periodic linear interpolation."""
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        x, y, counts = _outlined(xs, ys)
        begin = np.cumsum(counts) - counts
        out = [np.zeros(samples)] * len(xs)
        for rows in stacks(counts, np.full(len(counts), samples // 8 + 1)):
            if counts[rows[0]] >= 3:
                at = begin[rows][:, None] + np.arange(int(counts[rows[0]]))
                for r, found in zip(rows, radii_at(np.stack([x[at], y[at]], axis=2), samples)):
                    out[r] = found
        return pd.Series(out, dtype=object)

    return particles.select(*keys, F.posexplode(F.pandas_udf(run, "array<double>")(*_axes(F.col("vertices")))).alias("i", "r"))


def radii_at(points: np.ndarray, samples: int) -> np.ndarray:
    """`np.interp` of the radius over the angle, with a period, for contours with the same number of points, all at once."""
    m, n = points.shape[:2]
    rel = points - points.mean(axis=1, keepdims=True)
    turn = 2.0 * np.pi
    angle, r = np.arctan2(rel[..., 1], rel[..., 0]) % turn, np.hypot(rel[..., 0], rel[..., 1])
    order = np.argsort(angle, axis=1)
    angle, r = (np.take_along_axis(v, order, axis=1) for v in (angle, r))
    angle = np.concatenate([angle[:, -1:] - turn, angle, angle[:, :1] + turn], axis=1)
    r = np.concatenate([r[:, -1:], r, r[:, :1]], axis=1)
    target = (-np.pi + turn * np.arange(samples) / samples) % turn
    by_angle = np.argsort(target, kind="stable")
    asked = target[by_angle]
    # The first target not before each contour point, then the number of contour points not after each target.
    place = np.searchsorted(asked, angle, side="left") + np.arange(m)[:, None] * (samples + 1)
    below = np.cumsum(np.bincount(place.ravel(), minlength=m * (samples + 1)).reshape(m, samples + 1), axis=1)[:, :samples]
    left = np.clip(below - 1, 0, n)
    x0, x1, y0, y1 = (np.take_along_axis(v, left + k, axis=1) for v, k in ((angle, 0), (angle, 1), (r, 0), (r, 1)))
    width = x1 - x0
    out = np.empty((m, samples))
    out[:, by_angle] = np.where((x0 == asked) | (width == 0), y0, (y1 - y0) / np.where(width == 0, 1.0, width) * (asked - x0) + y0)
    return out


# ---- mask measures

def ellipse_fit(masks: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Semi-axes of the ellipse with the second moments of the mask: twice the root of the eigenvalues."""
    half = (F.var_pop("x") + F.var_pop("y")) / 2.0
    diff = (F.var_pop("x") - F.var_pop("y")) / 2.0
    root = F.sqrt(diff * diff + F.covar_pop("x", "y") * F.covar_pop("x", "y"))
    return masks.groupBy(*keys).agg(F.count(F.lit(1)).alias("mask_area"), (2.0 * F.sqrt(half + root)).alias("a_px"),
                                    (2.0 * F.sqrt(F.greatest(half - root, F.lit(0.0)))).alias("b_px"))


def particle_raster(masks: DataFrame, pad: int = 2, keys: Sequence[str] = KEY) -> DataFrame:
    """Every pixel of the padded box of each mask, as rows (keys, y, x, v) with v 1 inside and 0 outside."""
    keys = list(keys)
    box = masks.groupBy(*keys).agg((F.min("y") - pad).alias("_y0"), (F.max("y") + pad).alias("_y1"), (F.min("x") - pad).alias("_x0"), (F.max("x") + pad).alias("_x1"))
    grid = (box.withColumn("y", F.explode(F.sequence("_y0", "_y1"))).withColumn("x", F.explode(F.sequence("_x0", "_x1")))
            .select(*keys, "y", "x", F.lit(0.0).alias("v")))
    both = grid.unionByName(masks.select(*keys, "y", "x", F.lit(1.0).alias("v")))
    return both.groupBy(*keys, "y", "x").agg(F.max("v").alias("v"))


def _by_mask(masks: DataFrame, pad: int, keys: Sequence[str], measure, kind: str, by_rows, whole_pixels: int) -> DataFrame:
    """`measure(lists of runs)` of each mask in one vectorised step, as columns `kind`; masks whose padded box has more than `whole_pixels` pixels go
    through `by_rows(pixels)` instead, by the same definitions."""
    keys = list(keys)
    names = [part.split()[0] for part in kind.split(", ")]
    packed = packed_runs(masks, keys)
    fits = (F.col("y1") - F.col("y0") + 1 + 2 * pad) * (F.col("x1") - F.col("x0") + 1 + 2 * pad) <= whole_pixels
    found = packed.where(fits).withColumn("_m", F.pandas_udf(measure, kind)("runs")).select(*keys, *[F.col(f"_m.{n}").alias(n) for n in names])
    return found.unionByName(by_rows(unpacked_pixels(packed.where(~fits), keys)).select(*keys, *names))


def mask_lacunarity(masks: DataFrame, pad: int = 2, keys: Sequence[str] = KEY, whole_pixels: int = WHOLE_PIXELS) -> DataFrame:
    """Gliding-box lacunarity of each padded mask, given as runs or pixels, the box being a third of the raster but 2 to 10 pixels."""
    keys = list(keys)

    def measure(runs: pd.Series) -> pd.DataFrame:
        out = np.zeros(len(runs))
        for at, raster in rasters(runs.tolist(), pad):
            out[at] = gliding_lacunarity(raster)
        return pd.DataFrame({"lacunarity": out})

    named = masks.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    found = _by_mask(named, pad, keys, measure, "lacunarity double", lambda large: _lacunarity_by_rows(large, pad, keys), whole_pixels)
    return found.where(F.col("lacunarity").isNotNull() & ~F.isnan("lacunarity"))


def _lacunarity_by_rows(masks: DataFrame, pad: int, keys: Sequence[str]) -> DataFrame:
    """The same for masks of any size.

    Box sums run along lines held as arrays, rows first and then columns; a line is as long as one particle.
    """
    keys = list(keys)
    span = masks.groupBy(*keys).agg((F.max("y") - F.min("y") + 2 * pad + 1).alias("_h"), (F.max("x") - F.min("x") + 2 * pad + 1).alias("_w"))
    side = F.greatest(F.lit(2), F.least(F.lit(10), F.floor(F.col("_h") / 3), F.floor(F.col("_w") / 3))).cast("int")
    cells = join_on(particle_raster(masks, pad, keys), span.select(*keys, side.alias("_r")), keys)

    def along(df: DataFrame, axis: str) -> DataFrame:
        other = "x" if axis == "y" else "y"
        lines = df.groupBy(*keys, "_r", other).agg(F.array_sort(F.collect_list(F.struct(axis, "v"))).alias("_l"))
        starts = F.sequence(F.lit(1), F.size("_l") - F.col("_r") + 1)
        sums = F.transform(starts, lambda i: G.total(F.slice(F.col("_l.v"), i, F.col("_r"))))
        return lines.where(F.size("_l") >= F.col("_r")).select(*keys, "_r", other, F.posexplode(sums).alias(axis, "v"))

    mean = F.avg("v")
    return along(along(cells, "x"), "y").groupBy(*keys).agg(F.when(mean < 1e-9, F.lit(0.0)).otherwise(
        F.avg(F.col("v") * F.col("v")) / F.nullif(mean * mean, F.lit(0.0)) - 1.0).alias("lacunarity"))


def monte_carlo_perimeter(masks: DataFrame, n_lines: int = 2000, seed: int = 42, pad: int = 2, keys: Sequence[str] = KEY) -> DataFrame:
    """Outline length from the crossings of random lines through the padded box (Cauchy-Crofton).

    A mask, given as runs or pixels, moves as one row; its lines are drawn and walked in one task and are never rows.
    """
    keys = list(keys)

    def crossings(runs: pd.Series, tails: pd.Series) -> pd.Series:
        out = np.zeros(len(runs))
        ends = [t.encode() for t in tails]
        by_length = np.argsort([len(t) for t in ends], kind="stable")
        lengths = np.array([len(t) for t in ends])[by_length]
        for group in np.split(by_length, np.flatnonzero(np.diff(lengths)) + 1):
            for i in range(0, len(group), LINES_TOGETHER):
                part = group[i:i + LINES_TOGETHER]
                angles, offsets = (hash_uniforms(f"{seed}:{name}:", n_lines, [ends[k] for k in part]) for name in ("angle", "offset"))
                for at, rasters_ in rasters([runs.iloc[k] for k in part], pad):
                    for k, raster in zip(at, rasters_):
                        d = math.hypot(*raster.shape)
                        out[part[k]] = math.pi * d * _line_crossings(raster, pad, angles[k] * math.pi, (offsets[k] - 0.5) * d) / (2.0 * n_lines)
        return pd.Series(out)

    tail = F.concat_ws(":", F.lit(""), *[F.col(k).cast("string") for k in keys])
    return packed_runs(masks, keys).select(*keys, F.pandas_udf(crossings, "double")("runs", tail).alias("perimeter_px"))


def _line_crossings(raster: np.ndarray, pad: int, angles: np.ndarray, offsets: np.ndarray) -> int:
    """Changes between mask and background along lines past the middle, walked in steps of about a pixel inside the raster."""
    h, w = raster.shape
    d = math.hypot(h, w)
    n = int(math.floor(d)) + 2
    s = -d / 2.0 + d * np.arange(n) / (n - 1)
    # Farther from the middle than the corners of the mask, and a pixel and a step more, all is background.
    far = math.hypot(h - 2 * pad, w - 2 * pad) / 2.0 + 3.0
    met = np.abs(offsets) <= far
    s, angles, offsets = s[np.abs(s) <= far][:, None], angles[met], offsets[met]
    framed = np.full((h + 2, w + 2), 4, np.uint8)  # 4 is outside
    framed[1:-1, 1:-1] = raster
    framed = framed.ravel()
    cos, sin = np.cos(angles), np.sin(angles)
    step = max(1, (1 << 14) // len(s))
    found = 0
    for i in range(0, len(angles), step):
        c, q, t = cos[i:i + step], sin[i:i + step], offsets[i:i + step]
        px, py = s * c, s * q
        px += w / 2.0
        px -= t * q
        py += h / 2.0
        py += t * c
        for p, side in ((px, w), (py, h)):
            np.rint(p, out=p)
            np.maximum(p, -1.0, out=p)
            np.minimum(p, side, out=p)
        py *= w + 2
        py += px
        at = py.astype(np.int32)
        at += w + 3
        m = framed.take(at)
        found += np.count_nonzero((m[1:] ^ m[:-1]) == 1)
    return found


def shell_from_holes(masks: DataFrame, keys: Sequence[str] = KEY, whole_pixels: int = WHOLE_PIXELS) -> DataFrame:
    """Hollow by shape: over a tenth of the filled outline is hole; the shell is the number of erosions to vanish.  Masks come as runs or pixels."""
    keys = list(keys)

    def measure(runs: pd.Series) -> pd.DataFrame:
        # Only a mask with a gap in some row can have a hole.
        runs = [np.asarray(r, np.int64).reshape(-1, 3) for r in runs]
        found = np.zeros((len(runs), 2))
        owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        y, xa, xb = np.concatenate([*runs, np.zeros((0, 3), np.int64)]).T
        lines, at = np.unique(np.column_stack([owner, y]), axis=0, return_inverse=True)
        low, high = np.full(len(lines), 1 << 62), np.full(len(lines), -(1 << 62))
        np.minimum.at(low, at.ravel(), xa), np.maximum.at(high, at.ravel(), xb)
        gap = np.unique(lines[np.bincount(at.ravel(), xb - xa, minlength=len(lines)) < high - low, 0])
        area = np.bincount(owner, xb - xa, minlength=len(runs))
        if len(gap):
            for k, raster in rasters([runs[g] for g in gap], 1):
                found[gap[k]] = hollow_shell(raster, area[gap[k]])
        return pd.DataFrame({"is_hollow": found[:, 0] == 1, "shell_px": found[:, 1]})

    return _by_mask(masks, 1, keys, measure, "is_hollow boolean, shell_px double", lambda large: _shell_by_rows(large, keys), whole_pixels)


def _shell_by_rows(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for masks of any size.

    Only a mask with a gap in some row can have a hole, and only a hollow one needs its erosion depth, so the raster
    work is done for those alone.  Holes are background regions that do not reach the border of the padded box.
    """
    from mesograph.operators.masks import connected_regions

    keys = list(keys)
    rows = masks.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("_n"), (F.max("x") - F.min("x") + 1).alias("_w"))
    size = rows.groupBy(*keys).agg(F.sum("_n").alias("_area"), F.bool_or(F.col("_n") < F.col("_w")).alias("_gap"))
    open_ended = join_on(masks, size.where("_gap").select(*keys), keys, "left_semi")
    raster = particle_raster(open_ended, 1, keys)
    edge = raster.groupBy(*keys).agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    back = connected_regions(raster.where(F.col("v") == 0), 4, keys)
    rim = (F.col("y") == F.col("_y0")) | (F.col("y") == F.col("_y1")) | (F.col("x") == F.col("_x0")) | (F.col("x") == F.col("_x1"))
    parts = join_on(back, edge, keys).groupBy(*keys, "region_id").agg(F.bool_or(rim).alias("_open"), F.count(F.lit(1)).alias("_c"))
    holes = parts.groupBy(*keys).agg(F.coalesce(F.sum(F.when(~F.col("_open"), F.col("_c"))), F.lit(0)).alias("_hole"))
    hollow = join_on(size, holes, keys).where(F.col("_hole") > 0.1 * (F.col("_hole") + F.col("_area"))).select(*keys)
    depth = _depth_by_rows(join_on(masks, hollow, keys, "left_semi"), keys)
    return join_on(size.select(*keys), depth, keys, "left").select(
        *keys, F.col("depth").isNotNull().alias("is_hollow"), F.coalesce(F.col("depth").cast("double"), F.lit(0.0)).alias("shell_px"))


def erosion_depth(masks: DataFrame, keys: Sequence[str] = KEY, whole_pixels: int = WHOLE_PIXELS) -> DataFrame:
    """Number of cross-shaped erosions until nothing is left: the largest city-block distance to the background.  Masks come as runs or pixels."""
    keys = list(keys)

    def measure(runs: pd.Series) -> pd.DataFrame:
        out = np.zeros(len(runs), np.int64)
        for at, raster in rasters(runs.tolist(), 1):
            out[at] = city_block_depth(raster)
        return pd.DataFrame({"depth": out})

    return _by_mask(masks, 1, keys, measure, "depth long", lambda large: _depth_by_rows(large, keys), whole_pixels)


def _depth_by_rows(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for masks of any size.

    The distance is exact: first along each row, then the minimum of row distance plus offset down each column,
    which is a running minimum in both directions.
    """
    keys = list(keys)
    raster = particle_raster(masks, 1, keys)

    def sweep(df: DataFrame, axis: str, value: Column, out: str) -> DataFrame:
        other = "x" if axis == "y" else "y"
        line = Window.partitionBy(*keys, other).orderBy(axis)
        ahead = F.min(value - F.col(axis)).over(line.rowsBetween(Window.unboundedPreceding, 0)) + F.col(axis)
        behind = F.min(value + F.col(axis)).over(line.rowsBetween(0, Window.unboundedFollowing)) - F.col(axis)
        return df.withColumn(out, F.least(ahead, behind))

    start = F.when(F.col("v") == 0, F.lit(0)).otherwise(F.lit(1 << 29))
    rows = sweep(raster, "x", start, "_dx")
    both = sweep(rows, "y", F.col("_dx"), "_d")
    return both.groupBy(*keys).agg(F.max("_d").alias("depth"))


# ---- the whole estimate

def _measured_at_once(particles: DataFrame, method: str) -> DataFrame:
    """Shape and all measures of each particle in one pass without a shuffle; spikes only where the method asks for them."""
    found = contour_metrics(particles).withColumn("_m", measure_column(F.col("vertices")))
    names = [n for n in NAMES if n not in ("perimeter_px_one", "a_px", "b_px", "rough", "r_mean", "ea", "eb")]
    out = found.withColumns({**{n: F.col(f"_m.{n}") for n in names}, "_ea": F.col("_m.ea"), "_eb": F.col("_m.eb"), "perimeter_nm": F.col("_m.perimeter_px_one") * F.col("pixel_size_nm"),
                             "_n_contour": _contour_size(F.col("vertices"))})
    wanted = F.lit(True) if method == "fourier_spiky" else (F.col("fractal_dim") > FRACTAL_LIMIT) if method == "auto" else F.lit(False)
    out = out.withColumn("_s", spike_column(F.col("vertices"), wanted))
    fields = [F.col(f"_m.{n}").alias(n) for n in ("a_px", "b_px", "rough", "r_mean")]
    return out.withColumn("_f", F.struct(*fields, F.col("_s.spikes").alias("spikes"), F.col("_s.n_spikes").alias("n_spikes"))).drop("_m", "_s")


def _measured_by_rows(particles: DataFrame) -> DataFrame:
    """The same for particles of any size, their pixels and contour points as rows."""
    masks = rasterize_roi(particles, ["image_id", *KEY])
    ellipse = ellipse_fit(masks)
    raster_size = particles.select(*KEY, (F.ceil(G.extent(F.col("vertices"), "y")).cast("int") + 5).alias("height"),
                                   (F.ceil(G.extent(F.col("vertices"), "x")).cast("int") + 5).alias("width"))
    low = particles.select(*KEY, F.array_min(F.transform("vertices", lambda p: p["x"])).alias("_lx"), F.array_min(F.transform("vertices", lambda p: p["y"])).alias("_ly"))
    local = join_on(contour_points(particles), low, KEY).select(*KEY, "i", (F.col("x") - F.col("_lx") + 2).alias("x"), (F.col("y") - F.col("_ly") + 2).alias("y"))
    out = join_on(fourier_measures(contour_metrics(particles)), ellipse.withColumnsRenamed({"a_px": "_ea", "b_px": "_eb"}), KEY, "left")
    for table in (box_count_fractal(local, raster_size), richardson(particles), roughness_index(local), _lacunarity_by_rows(masks, 2, KEY), _shell_by_rows(masks, KEY)):
        out = join_on(out, table, KEY, "left")
    return out.withColumns({"_n_contour": F.size("contour"), "mask_area": F.coalesce("mask_area", F.lit(0).cast("long")), "is_hollow": F.coalesce("is_hollow", F.lit(False)),
                            "shell_px": F.coalesce("shell_px", F.lit(0.0))}).drop("contour")


def estimate_surface_area(particles: DataFrame, method: str = "auto", raw: DataFrame | None = None, whole_pixels: int = WHOLE_PIXELS) -> DataFrame:
    """One result row per particle (particle_id, image_id, label, vertices, pixel_size_nm, px_unc_nm).

    With `raw` pixels (image_id, y, x, v) hollow particles are found by intensity, else by holes in the mask.  Particles are measured where they lie, many at
    a time; those whose raster has more than `whole_pixels` pixels go through tables of pixels and contour points instead, by the same definitions.
    """
    from mesograph.operators.pixels import detect_hollow

    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, choose from {METHODS}")
    px = F.col("pixel_size_nm")
    kept = particles.select(*KEY, "image_id", "label", "vertices", "pixel_size_nm", "px_unc_nm")
    fits = bounded(F.col("vertices"), whole_pixels)
    out = _measured_at_once(kept.where(fits), method)
    large = kept.where(~fits)
    if not large.isEmpty():
        out = out.unionByName(_measured_by_rows(large).select(*out.columns))
    if raw is not None or method == "monte_carlo":
        masks = rasterize_roi(kept, ["image_id", *KEY])
    if raw is not None:
        inside = join_on(masks, raw.select("image_id", "y", "x", "v"), ["image_id", "y", "x"])
        out = join_on(out.drop("is_hollow", "shell_px"), detect_hollow(inside, keys=KEY).withColumnRenamed("shell_thickness_px", "shell_px"), KEY, "left")

    small = F.coalesce("mask_area", F.lit(0)) < 4
    coverage = F.when(F.col("_n_contour") < 5, F.lit(1.0)).otherwise(coverage_score(F.col("mask_area"), F.col("_ea"), F.col("_eb")))
    chosen = (select_method(F.col("fractal_dim"), F.col("box_aspect"), F.col("circularity"), F.col("convexity")) if method == "auto" else F.lit(method))
    out = out.withColumns({"coverage_score": coverage, "method_used": chosen, "is_hollow": F.coalesce("is_hollow", F.lit(False)),
                           "shell_thickness_estimate_nm": F.coalesce("shell_px", F.lit(0.0)) * px})
    if method == "monte_carlo":
        out = join_on(out, monte_carlo_perimeter(masks).withColumnRenamed("perimeter_px", "_mc"), KEY, "left")
    else:
        out = out.withColumn("_mc", F.lit(None).cast("double"))

    arc = F.col("perimeter_px") * px
    fa, fb = F.col("_f.a_px") * px, F.col("_f.b_px") * px
    base = sa_fourier(fa, fb, F.col("_f.rough"))
    spiky = sa_fourier_spiky(base, F.col("_f.spikes") * px * px, F.col("_f.n_spikes"), F.col("_f.r_mean") * px, arc)
    half_box = (F.greatest("box_w", "box_h") / 2.0 * px, F.least("box_w", "box_h") / 2.0 * px)
    circ = F.col("circularity")
    forms = {
        "ellipsoid": (F.col("_ea") * px, F.col("_eb") * px, sa_spheroid(F.col("_ea") * px, F.col("_eb") * px)),
        "cauchy": (*half_box, sa_cauchy(F.col("area_px") * px * px, F.col("box_aspect"))),
        "fourier": (fa, fb, base), "fourier_spiky": (fa, fb, spiky),
        "capsule": (F.col("rect_long") / 2.0 * px, F.col("rect_short") / 2.0 * px, sa_capsule(F.col("rect_long") * px, F.col("rect_short") * px)),
        "perimeter": (*half_box, sa_isoperimetric(arc, circ)), "monte_carlo": (*half_box, sa_isoperimetric(F.col("_mc") * px, circ)),
        "richardson": (*half_box, sa_isoperimetric(F.col("perimeter_nm"), circ)),
    }

    def pick(slot: int) -> Column:
        value = F.lit(None).cast("double")
        for name, columns in forms.items():
            value = F.when(F.col("method_used") == name, columns[slot]).otherwise(value)
        return F.when(small, F.lit(0.0)).otherwise(value)

    out = out.withColumns({"a_nm": pick(0), "b_nm": pick(1), "SA_outer_nm2": pick(2)})
    rough = F.when(F.col("method_used").isin("fourier", "fourier_spiky"), F.col("_f.rough")).otherwise(F.col("roughness"))
    total = hollow_correction(F.col("SA_outer_nm2"), F.col("a_nm"), F.col("b_nm"), F.col("shell_thickness_estimate_nm"), F.col("is_hollow"))
    reasons = F.array_compact(F.array(F.when(F.col("coverage_score") < 0.6, "partially_occluded"), F.when(F.col("aggregate_score") > 0.5, "aggregate")))
    out = out.withColumns({"SA_nm2": total, "flag_reason": F.when(small, "mask_too_small").otherwise(F.array_join(reasons, ";")), "sem_roughness_index": rough})
    return out.select(
        *KEY, "image_id", "label", "a_nm", "b_nm", "SA_nm2", sa_uncertainty(F.col("SA_nm2"), px, F.col("px_unc_nm")).alias("SA_nm2_uncertainty"),
        "coverage_score", F.when(small, F.lit("")).otherwise(F.col("method_used")).alias("method_used"), (F.col("flag_reason") != "").alias("flagged"), "flag_reason",
        "is_hollow", "shell_thickness_estimate_nm", "SA_outer_nm2", (F.col("SA_nm2") - F.col("SA_outer_nm2")).alias("SA_inner_nm2"), "aggregate_score",
        "sem_roughness_index", "perimeter_nm", "lacunarity", "richardson_fractal_dim", "fractal_dim")
