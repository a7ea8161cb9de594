"""Long pixel tables (keys..., y, x, v): movies, volumes, contrast, quality, spectra and profiles.

Neighbour access runs in windows over one pixel row or one pixel column, never over a whole image, and Fourier
transforms run row by row and then column by column, so the largest unit of work is one line of an image.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesograph.functions import geometry as G
from mesograph.operators.ordering import join_on, quantiles
from mesograph.operators.spans import outline_spans, span_pixels

IMAGE = ["image_id"]

# Quality thresholds and the critical-exposure curve (Grant and Grigorieff, 2015).
BLUR_THRESHOLD, CV_THRESHOLD, SATURATION_THRESHOLD, LOW_FREQ_THRESHOLD = 5.0, 0.05, 0.05, 0.70
DOSE_SCALE, DOSE_POWER, DOSE_OFFSET = 0.245, -1.665, 2.81


# ---- movies and volumes

def frame_mean(frames: DataFrame, movie: str = "movie_id") -> DataFrame:
    return frames.groupBy(movie, "y", "x").agg(F.avg("v").alias("v"))


def dose_series(frames: DataFrame, n_bins: int, movie: str = "movie_id") -> DataFrame:
    """Mean image of each of `n_bins` nearly equal runs of frames, with the run as start (inclusive) and stop."""
    lengths = frames.groupBy(movie).agg((F.max("frame") + 1).alias("_n"))
    k = F.greatest(F.lit(1), F.least(F.lit(n_bins), F.col("_n")))

    def edge(i: Column) -> Column:
        return F.bround(i * F.col("_n") / k).cast("int")

    runs = F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda i: F.struct(
        i.alias("bin"), edge(i).alias("start"), F.greatest(edge(i + 1), edge(i) + 1).alias("stop")))
    table = lengths.select(movie, F.explode(runs).alias("r")).select(movie, "r.*").withColumn(
        "frame", F.explode(F.sequence("start", F.col("stop") - 1)))
    return (join_on(frames, table, [movie, "frame"]).groupBy(movie, "bin", "start", "stop", "y", "x").agg(F.avg("v").alias("v")))


def dose_difference(series: DataFrame, dose_per_frame: float = 1.0, movie: str = "movie_id") -> DataFrame:
    """Each later run minus the first one, with its dose range and the symmetric display limit of the movie."""
    first = F.min_by("v", "bin").over(Window.partitionBy(movie, "y", "x"))
    diff = series.withColumn("diff", F.col("v") - first).where(F.col("bin") > 0)
    limit = diff.groupBy(movie).agg(F.max(F.abs("diff")).alias("span"))
    return join_on(diff, limit, [movie]).select(
        movie, "bin", (F.col("start") * dose_per_frame).alias("dose_from"), ((F.col("stop") - 1) * dose_per_frame).alias("dose_to"), "y", "x", "diff", "span")


def z_projection(voxels: DataFrame, how: str, z_from: int = 0, z_to: int | None = None) -> DataFrame:
    """Maximum, minimum or mean over z in [z_from, z_to)."""
    fold = {"max": F.max, "min": F.min, "mean": F.avg}[how]
    part = voxels.where((F.col("z") >= max(0, z_from)) & (F.lit(True) if z_to is None else F.col("z") < z_to))
    return part.groupBy("volume_id", "y", "x").agg(fold("v").alias("v"))


def slice_at(voxels: DataFrame, z: int, depth: int) -> DataFrame:
    return voxels.where(F.col("z") == min(max(z, 0), depth - 1)).select("volume_id", "z", "y", "x", "v")


def estimate_shifts(frames: DataFrame, reference: DataFrame, max_shift: int, movie: str = "movie_id") -> DataFrame:
    """Whole-pixel shift of each frame that best matches the reference image, by normalised correlation.

    Only the reference is copied to the candidate shifts; the frames cross the network once.
    """
    span = range(-max_shift, max_shift + 1)
    moved = (reference.select(movie, F.col("y").alias("ry"), F.col("x").alias("rx"), F.col("v").alias("r"),
                              F.explode(F.lit([[dy, dx] for dy in span for dx in span])).alias("_o"))
             .select(movie, "r", F.get("_o", F.lit(0)).alias("dy"), F.get("_o", F.lit(1)).alias("dx"),
                     (F.col("ry") - F.get("_o", F.lit(0))).alias("y"), (F.col("rx") - F.get("_o", F.lit(1))).alias("x")))
    met = join_on(frames.select(movie, "frame", "y", "x", "v"), moved, [movie, "y", "x"])
    score = met.groupBy(movie, "frame", "dy", "dx").agg(F.corr("v", "r").alias("score"))
    rank = F.struct(F.round(F.coalesce(F.nanvl("score", F.lit(-2.0)), F.lit(-2.0)), 9), -(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")),
                    F.col("dy"), F.col("dx"))
    best = score.groupBy(movie, "frame").agg(F.max_by(F.struct("dy", "dx"), rank).alias("b"))
    return best.select(movie, "frame", F.col("b.dy").alias("dy"), F.col("b.dx").alias("dx"))


def apply_shifts(frames: DataFrame, shifts: DataFrame, movie: str = "movie_id") -> DataFrame:
    """Mean of the shifted frames; a frame counts as zero where it does not reach."""
    shape = frames.groupBy(movie).agg(F.max("y").alias("_h"), F.max("x").alias("_w"), (F.max("frame") + 1).alias("_n"))
    moved = join_on(join_on(frames, shifts, [movie, "frame"]), shape, [movie]).withColumns({"y": F.col("y") + F.col("dy"), "x": F.col("x") + F.col("dx")})
    inside = moved.where(F.col("y").between(F.lit(0), F.col("_h")) & F.col("x").between(F.lit(0), F.col("_w"))).select(movie, "y", "x", "v", "_n")
    base = join_on(frames.where(F.col("frame") == 0), shape, [movie]).select(movie, "y", "x", F.lit(0.0).alias("v"), "_n")
    return inside.unionByName(base).groupBy(movie, "y", "x").agg((F.sum("v") / F.max("_n")).alias("v"))


def motion_correct(frames: DataFrame, max_shift: int, movie: str = "movie_id") -> DataFrame:
    """Two passes: against the first frame, then against the mean of the first pass; returns the total shift."""
    one = estimate_shifts(frames, frames.where(F.col("frame") == 0), max_shift, movie)
    aligned = apply_shifts(frames, one, movie)
    moved = join_on(frames, one, [movie, "frame"]).withColumns({"y": F.col("y") + F.col("dy"), "x": F.col("x") + F.col("dx")})
    two = estimate_shifts(moved, aligned, max_shift, movie).withColumnsRenamed({"dy": "ey", "dx": "ex"})
    return join_on(one, two, [movie, "frame"]).select(movie, "frame", (F.col("dy") + F.col("ey")).alias("dy"), (F.col("dx") + F.col("ex")).alias("dx"))


def drift_summary(shifts: DataFrame, pixel_size_nm: float = 1.0, movie: str = "movie_id", frames_per_bucket: int = 1024) -> DataFrame:
    """Largest and mean shift and the length of the path, in angstrom when calibrated, else in pixels."""
    from mesograph.operators.ordering import previous_row

    scale = pixel_size_nm * 10.0 if pixel_size_nm > 0 and pixel_size_nm != 1.0 else 1.0
    bucketed = shifts.withColumn("_fb", F.floor(F.col("frame") / frames_per_bucket))
    steps = previous_row(bucketed, [movie], "_fb", "frame", {"_py": "dy", "_px": "dx"})
    size = F.hypot(F.col("dy").cast("double"), F.col("dx").cast("double"))
    step = F.hypot((F.col("dy") - F.col("_py")).cast("double"), (F.col("dx") - F.col("_px")).cast("double"))
    return steps.groupBy(movie).agg((F.max(size) * scale).alias("max_shift"), (F.avg(size) * scale).alias("mean_shift"),
                                    (F.coalesce(F.sum(step), F.lit(0.0)) * scale).alias("total_path"))


# ---- neighbours

def _line(keys: Sequence[str], axis: str) -> Window:
    other = "x" if axis == "y" else "y"
    return Window.partitionBy(*keys, other).orderBy(axis)


def laplacian_variance(pixels: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Population variance of the five-point Laplacian with replicated borders."""
    v = F.col("v")
    parts = pixels.withColumn("_h", F.coalesce(F.lag("v").over(_line(keys, "x")), v) + F.coalesce(F.lead("v").over(_line(keys, "x")), v))
    parts = parts.withColumn("_w", F.coalesce(F.lag("v").over(_line(keys, "y")), v) + F.coalesce(F.lead("v").over(_line(keys, "y")), v))
    return parts.groupBy(*keys).agg(F.var_pop(F.col("_h") + F.col("_w") - 4.0 * v).alias("blur_score"))


def surface_gradient(pixels: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """p along x and q along y: central differences inside, one-sided at the borders."""
    def slope(axis: str) -> Column:
        back, ahead, v = F.lag("v").over(_line(keys, axis)), F.lead("v").over(_line(keys, axis)), F.col("v")
        return F.when(back.isNull() & ahead.isNull(), F.lit(0.0)).when(back.isNull(), ahead - v).when(ahead.isNull(), v - back).otherwise((ahead - back) / 2.0)

    return pixels.withColumn("p", slope("x")).withColumn("q", slope("y"))


def height_surface_area(heights: DataFrame, pixel_size_nm: float, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Surface of a height field over the rows with `inside`, its roughness and the projected estimate."""
    lit = F.col("inside")
    tilt = F.sqrt(1.0 + F.col("p") * F.col("p") + F.col("q") * F.col("q"))
    area = pixel_size_nm * pixel_size_nm
    return surface_gradient(heights, keys).groupBy(*keys).agg(
        (F.sum(F.when(lit, tilt)) * area).alias("surface_nm2"), F.stddev_pop(F.when(lit, F.col("v"))).alias("roughness"),
        (4.0 * area * F.count_if(lit)).alias("sa_projected"))


def gliding_box_sum(pixels: DataFrame, r: int, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Mass of the r x r box at every position where it fits."""
    ahead = F.sum("v").over(_line(keys, "x").rowsBetween(0, r - 1))
    fits = F.lead("v", r - 1).over(_line(keys, "x")).isNotNull()
    rows = pixels.withColumns({"_s": ahead, "_fit": fits}).where("_fit").select(*keys, "y", "x", F.col("_s").alias("v"))
    down = F.sum("v").over(_line(keys, "y").rowsBetween(0, r - 1))
    return (rows.withColumns({"mass": down, "_fit": F.lead("v", r - 1).over(_line(keys, "y")).isNotNull()}).where("_fit")
            .select(*keys, "y", "x", "mass"))


def lacunarity(pixels: DataFrame, r: int, keys: Sequence[str] = IMAGE) -> DataFrame:
    boxes = gliding_box_sum(pixels, r, keys)
    mean = F.avg("mass")
    return boxes.groupBy(*keys).agg(F.when(mean < 1e-9, F.lit(0.0)).otherwise(
        F.avg(F.col("mass") * F.col("mass")) / F.nullif(mean * mean, F.lit(0.0)) - 1.0).alias("lacunarity"))


def _gaussian_axis(pixels: DataFrame, sigma: float, axis: str, keys: Sequence[str]) -> DataFrame:
    """Gaussian along one axis, cut at four sigma, mirrored at the borders; one array per line."""
    other = "x" if axis == "y" else "y"
    radius = int(4.0 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel = F.lit([float(w) for w in weights / weights.sum()])
    lines = pixels.groupBy(*keys, other).agg(F.array_sort(F.collect_list(F.struct(F.col(axis), F.col("v")))).alias("_l"))
    values, n = F.col("_l.v"), F.size("_l")

    def mirrored(i: Column) -> Column:
        m = F.pmod(i, 2 * n)
        return F.least(m, 2 * n - 1 - m)

    def blur(item: Column, i: Column) -> Column:
        total = F.aggregate(F.sequence(F.lit(0), F.lit(2 * radius)), F.lit(0.0),
                            lambda s, j: s + F.get(kernel, j) * F.get(values, mirrored(i + j - radius)))
        return F.struct(item[axis].alias(axis), total.alias("v"))

    return lines.select(*keys, other, F.explode(F.transform("_l", blur)).alias("_p")).select(*keys, other, "_p.*").select(*keys, "y", "x", "v")


def gaussian(pixels: DataFrame, sigma: float, keys: Sequence[str] = IMAGE) -> DataFrame:
    return _gaussian_axis(_gaussian_axis(pixels, sigma, "x", keys), sigma, "y", keys)


# ---- contrast

def _stretch(pixels: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    lo, hi = F.col("_lo"), F.col("_hi")
    clipped = F.greatest(F.least(F.col("v"), hi), lo)
    return join_on(pixels, cuts, keys).withColumn("v", (clipped - lo) / (hi - lo + 1e-12)).drop("_lo", "_hi")


def normalize_percentile(pixels: DataFrame, low: float = 0.5, high: float = 99.5, keys: Sequence[str] = IMAGE) -> DataFrame:
    return _stretch(pixels, quantiles(pixels, keys, "v", {"_lo": low / 100.0, "_hi": high / 100.0}), keys)


def normalize_sigma(pixels: DataFrame, n_sigma: float = 3.0, keys: Sequence[str] = IMAGE) -> DataFrame:
    mean, sd = F.avg("v"), F.stddev_pop("v")
    return _stretch(pixels, pixels.groupBy(*keys).agg((mean - n_sigma * sd).alias("_lo"), (mean + n_sigma * sd).alias("_hi")), keys)


def stretch_clipped(pixels: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Stretch between the 0.5 and 99.5 percentiles of all pixels."""
    return _stretch(pixels, quantiles(pixels, keys, "v", {"_lo": 0.005, "_hi": 0.995}), keys)


def bandpass(pixels: DataFrame, low_sigma: float = 20.0, high_sigma: float = 1.0, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Subtract a wide Gaussian background, smooth with a narrow one, stretch."""
    out = pixels.select(*keys, "y", "x", "v")
    if low_sigma > 0:
        back = gaussian(out, low_sigma, keys).withColumnRenamed("v", "_b")
        out = join_on(out, back, [*keys, "y", "x"]).withColumn("v", F.col("v") - F.col("_b")).drop("_b")
    if high_sigma > 0:
        out = gaussian(out, high_sigma, keys)
    return stretch_clipped(out, keys)


def clamp_finite(pixels: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """NaN becomes the median of the finite values, the infinities their extremes; zero where nothing is finite."""
    v = F.col("v")
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = pixels.where(finite)
    span = good.groupBy(*keys).agg(F.min("v").alias("_min"), F.max("v").alias("_max"))
    stats = join_on(span, quantiles(good, keys, "v", {"_med": 0.5}), keys)
    zero = F.lit(0.0)
    fixed = F.when(finite, v).when(F.isnan(v), F.coalesce("_med", zero)).when(v > 0, F.coalesce("_max", zero)).otherwise(F.coalesce("_min", zero))
    return join_on(pixels, stats, keys, "left").withColumn("v", fixed).drop("_min", "_max", "_med")


def apply_gamma(v: Column, gamma: float) -> Column:
    return v if gamma == 1.0 else F.pow(F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)), F.lit(gamma))


def to_uint8(v: Column) -> Column:
    return F.floor(F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)) * 255).cast("int")


# ---- spectra

def _fft_axis(spec: DataFrame, axis: str, keys: Sequence[str], inverse: bool) -> DataFrame:
    """Transform the lines along `axis` of (keys, fy, fx, re, im); each line is one array in one row."""
    other = "fx" if axis == "fy" else "fy"

    def run(re: pd.Series, im: pd.Series) -> pd.DataFrame:
        lines = [(np.fft.ifft if inverse else np.fft.fft)(np.asarray(a) + 1j * np.asarray(b)) for a, b in zip(re, im)]
        return pd.DataFrame({"re": [c.real for c in lines], "im": [c.imag for c in lines]})

    transform = F.pandas_udf(run, "re array<double>, im array<double>")
    lines = spec.groupBy(*keys, other).agg(F.array_sort(F.collect_list(F.struct(axis, "re", "im"))).alias("_l"))
    done = lines.select(*keys, other, transform(F.col("_l.re"), F.col("_l.im")).alias("_c"))
    pairs = F.arrays_zip(F.col("_c.re").alias("re"), F.col("_c.im").alias("im"))
    return done.select(*keys, other, F.posexplode(pairs).alias(axis, "_p")).select(*keys, "fy", "fx", F.col("_p.re").alias("re"), F.col("_p.im").alias("im"))


def spectrum(pixels: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Two-dimensional Fourier transform as rows (keys, fy, fx, re, im), zero frequency first."""
    start = pixels.select(*keys, F.col("y").alias("fy"), F.col("x").alias("fx"), F.col("v").alias("re"), F.lit(0.0).alias("im"))
    return _fft_axis(_fft_axis(start, "fx", keys, False), "fy", keys, False)


def inverse_spectrum(spec: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    back = _fft_axis(_fft_axis(spec.select(*keys, "fy", "fx", "re", "im"), "fx", keys, True), "fy", keys, True)
    return back.select(*keys, F.col("fy").alias("y"), F.col("fx").alias("x"), F.col("re").alias("v"))


def _signed(index: str, size: Column) -> Column:
    """Frequency index in -n/2 .. n/2 - 1."""
    return F.when(F.col(index) < F.ceil(size / 2), F.col(index)).otherwise(F.col(index) - size)


def shapes(spec: DataFrame, keys: Sequence[str]) -> DataFrame:
    return spec.groupBy(*keys).agg((F.max("fy") + 1).alias("_h"), (F.max("fx") + 1).alias("_w"))


def low_freq_fraction(pixels: DataFrame, fraction: float = 0.02, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Share of the power within a small radius of the zero frequency."""
    spec = spectrum(pixels, keys)
    sized = join_on(spec, pixels.groupBy(*keys).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w")), keys)
    radius = F.greatest(F.floor(F.least("_h", "_w") * fraction), F.lit(3))
    fy, fx = _signed("fy", F.col("_h")), _signed("fx", F.col("_w"))
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    total = F.sum(power)
    near = F.sum(F.when(fy * fy + fx * fx <= radius * radius, power).otherwise(F.lit(0.0)))
    return sized.groupBy(*keys).agg(F.when(total == 0, F.lit(0.0)).otherwise(near / F.nullif(total, F.lit(0.0))).alias("low_freq_frac"))


def dose_weighted_spectrum(frames: DataFrame, height: int, width: int, dose_per_frame: float = 1.0, pixel_size_nm: float = 1.0,
                           movie: str = "movie_id") -> DataFrame:
    """Sum of the frame spectra, each damped by its cumulative dose, over the sum of the weights."""
    spec = spectrum(frames, [movie, "frame"])
    step = max(pixel_size_nm * 10.0, 1e-6)
    qy, qx = _signed("fy", F.lit(height)) / (height * step), _signed("fx", F.lit(width)) / (width * step)
    q = F.greatest(F.hypot(qy, qx), F.lit(1e-6))
    critical = DOSE_SCALE * F.pow(q, F.lit(DOSE_POWER)) + DOSE_OFFSET
    w = F.exp(-0.5 * (F.col("frame") + 1) * dose_per_frame / critical)
    total = F.greatest(F.sum(w), F.lit(1e-12))
    return spec.groupBy(movie, "fy", "fx").agg((F.sum(w * F.col("re")) / total).alias("re"), (F.sum(w * F.col("im")) / total).alias("im"))


def dose_weighted_average(frames: DataFrame, height: int, width: int, dose_per_frame: float = 1.0, pixel_size_nm: float = 1.0,
                          movie: str = "movie_id") -> DataFrame:
    return inverse_spectrum(dose_weighted_spectrum(frames, height, width, dose_per_frame, pixel_size_nm, movie), [movie])


def fourier_filter(pixels: DataFrame, highpass_px: float = 100.0, lowpass_px: float = 4.0, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Gaussian high and low pass by their half-transmission wavelengths; 0 turns one off."""
    spec = spectrum(pixels, keys)
    sized = join_on(spec, pixels.groupBy(*keys).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w")), keys)
    fy, fx = _signed("fy", F.col("_h")) / F.col("_h"), _signed("fx", F.col("_w")) / F.col("_w")
    f2 = fy * fy + fx * fx
    factor = F.lit(1.0)
    if highpass_px > 0:
        factor = factor * (1.0 - F.exp(-f2 * (highpass_px * highpass_px * math.log(2.0))))
    if lowpass_px > 0:
        factor = factor * F.exp(-f2 * (lowpass_px * lowpass_px * math.log(2.0)))
    kept = sized.withColumns({"re": F.col("re") * factor, "im": F.col("im") * factor})
    return inverse_spectrum(kept, keys)


def fourier_bandpass(pixels: DataFrame, highpass_px: float = 100.0, lowpass_px: float = 4.0, keys: Sequence[str] = IMAGE) -> DataFrame:
    return stretch_clipped(fourier_filter(pixels, highpass_px, lowpass_px, keys), keys)


# ---- quality

def intensity_quality(pixels: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Coefficient of variation, range and the share of pixels at either extreme."""
    counts = pixels.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    flat = pixels.groupBy(*keys).agg(F.count("v").alias("n_pixels"), F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"), F.min("v").alias("vmin"), F.max("v").alias("vmax"))
    edge = counts.groupBy(*keys).agg(F.max_by("c", "v").alias("_hi"), F.min_by("c", "v").alias("_lo"))
    cv = F.when(F.abs("_m") > 1e-9, F.col("_s") / F.nullif(F.abs("_m"), F.lit(0.0))).otherwise(F.lit(0.0))
    return join_on(flat, edge, keys).select(*keys, "n_pixels", "vmin", "vmax", cv.alias("cv_score"),
                                            ((F.col("_hi") + F.col("_lo")) / F.col("n_pixels")).alias("saturation_frac"))


def assess_quality(pixels: DataFrame, blur: float = BLUR_THRESHOLD, cv: float = CV_THRESHOLD, saturation: float = SATURATION_THRESHOLD,
                   low_freq: float = LOW_FREQ_THRESHOLD, keys: Sequence[str] = IMAGE) -> DataFrame:
    out = join_on(join_on(laplacian_variance(pixels, keys), intensity_quality(pixels, keys), keys), low_freq_fraction(pixels, keys=keys), keys)
    flags = {"motion_blurred": F.col("blur_score") < blur, "near_uniform": (F.col("cv_score") < cv) | (F.col("vmax") - F.col("vmin") < 1e-6),
             "saturated": F.col("saturation_frac") > saturation, "low_freq_heavy": F.col("low_freq_frac") > low_freq}
    out = out.withColumns(flags)
    warnings = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags]))
    return out.withColumns({"ok": F.size(warnings) == 0, "warnings": F.array_join(warnings, ",")}).select(
        *keys, "blur_score", "cv_score", "saturation_frac", "low_freq_frac", *flags, "ok", "warnings")


def rank_quality(reports: DataFrame) -> DataFrame:
    """Images with warnings first, then by rising sharpness."""
    return reports.orderBy("ok", "blur_score")


# ---- regions

def crop_region(pixels: DataFrame, crops: DataFrame, shape: DataFrame) -> DataFrame:
    """Pixels of each image inside its rounded, clamped box, with the offset; an empty box keeps the whole image."""
    def edge(c: str, top: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.bround(c).cast("int"), F.col(top)))

    boxes = join_on(shape, crops, IMAGE, "left").select(
        "image_id", "width", "height", edge("cx0", "width").alias("ax"), edge("cx1", "width").alias("bx"), edge("cy0", "height").alias("ay"), edge("cy1", "height").alias("by_"))
    empty = F.coalesce((F.col("bx") <= F.col("ax")) | (F.col("by_") <= F.col("ay")), F.lit(True))
    boxes = boxes.select("image_id", F.when(empty, 0).otherwise(F.col("ax")).alias("ox"), F.when(empty, 0).otherwise(F.col("ay")).alias("oy"),
                         F.when(empty, F.col("width")).otherwise(F.col("bx")).alias("_x1"), F.when(empty, F.col("height")).otherwise(F.col("by_")).alias("_y1"))
    inside = (F.col("x") >= F.col("ox")) & (F.col("x") < F.col("_x1")) & (F.col("y") >= F.col("oy")) & (F.col("y") < F.col("_y1"))
    return join_on(pixels, boxes, IMAGE).where(inside).drop("_x1", "_y1")


def stride_downsample(pixels: DataFrame, height: int, width: int, cap: int) -> DataFrame:
    k = max(1, math.ceil(max(height, width) / cap))
    return pixels.where((F.col("y") % k == 0) & (F.col("x") % k == 0)).withColumns(
        {"y": F.floor(F.col("y") / k).cast("int"), "x": F.floor(F.col("x") / k).cast("int")})


def roi_pixels(rois: DataFrame, keys: Sequence[str] = ("image_id", "roi_id")) -> DataFrame:
    """Pixels (keys, y, x) inside each outline by the even-odd rule, from scan-line runs."""
    return span_pixels(outline_spans(rois, keys))


def roi_intensity(rois: DataFrame, pixels: DataFrame) -> DataFrame:
    """Mean, population deviation, range and pixel count of each outline; zeros where it covers no pixel."""
    met = join_on(roi_pixels(rois), pixels.select("image_id", "y", "x", "v"), ["image_id", "y", "x"])
    flat = met.groupBy("image_id", "roi_id").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"),
                                                 F.max("v").alias("max"), F.count("v").alias("n_pixels"))
    out = join_on(rois.select("image_id", "roi_id", "vertices", "pixel_size_nm"), flat, ["image_id", "roi_id"], "left")
    area = F.when(F.col("n_pixels") > 0, G.shoelace(F.col("vertices")) * F.col("pixel_size_nm") * F.col("pixel_size_nm"))
    return out.select("image_id", "roi_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "std", "min", "max")],
                      F.coalesce("n_pixels", F.lit(0)).cast("bigint").alias("n_pixels"), F.coalesce(area, F.lit(0.0)).alias("area_nm2"))


def line_profile(lines: DataFrame, pixels: DataFrame, shape: DataFrame, linewidth: int = 1) -> DataFrame:
    """Bilinear samples one pixel apart from (ax, ay) to (bx, by), averaged over `linewidth` parallel lines."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    length = F.hypot(dx, dy)
    n = F.ceil(length + 1).cast("int")
    base = join_on(lines, shape.select("image_id", "width", "height"), IMAGE).withColumns({"_n": n, "_len": length})
    base = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(linewidth - 1))))
    along = F.col("k") / F.greatest(F.col("_n") - 1, F.lit(1))
    aside = F.col("w") - (linewidth - 1) / 2.0
    norm = F.nullif(F.col("_len"), F.lit(0.0))
    base = base.withColumns({"_sx": F.col("ax") + dx * along - F.coalesce(aside * dy / norm, F.lit(0.0)), "_sy": F.col("ay") + dy * along + F.coalesce(aside * dx / norm, F.lit(0.0))})

    def mirrored(i: Column, size: Column) -> Column:
        m = F.pmod(i, 2 * size)
        return F.least(m, 2 * size - 1 - m).cast("int")

    fx, fy = F.col("_sx") - F.floor("_sx"), F.col("_sy") - F.floor("_sy")
    corners = F.array(*[F.struct((F.floor("_sy") + j).alias("y"), (F.floor("_sx") + i).alias("x"),
                                 ((fx if i else 1.0 - fx) * (fy if j else 1.0 - fy)).alias("g")) for j in (0, 1) for i in (0, 1)])
    taps = base.select("image_id", "line_id", "k", "_n", "_len", "pixel_size_nm", "width", "height", F.explode(corners).alias("c")).where(F.col("c.g") > 0)
    taps = taps.select("image_id", "line_id", "k", "_n", "_len", "pixel_size_nm", F.col("c.g").alias("g"),
                       mirrored(F.col("c.y"), F.col("height")).alias("y"), mirrored(F.col("c.x"), F.col("width")).alias("x"))
    met = join_on(taps, pixels.select("image_id", "y", "x", "v"), ["image_id", "y", "x"])
    out = met.groupBy("image_id", "line_id", "k", "_n", "_len", "pixel_size_nm").agg((F.sum(F.col("g") * F.col("v")) / linewidth).alias("intensity"))
    distance = F.col("_len") * F.col("pixel_size_nm") * F.col("k") / F.greatest(F.col("_n") - 1, F.lit(1))
    return out.select("image_id", "line_id", "k", distance.alias("distance_nm"), "intensity")


def radial_profile(masked: DataFrame, rings: int = 20, keys: Sequence[str] = ("image_id", "region_id")) -> DataFrame:
    """Mean value in each of `rings` equal rings about the mask centroid; the outermost pixel belongs to none."""
    keys = list(keys)
    center = masked.groupBy(*keys).agg(F.avg("y").alias("_cy"), F.avg("x").alias("_cx"))
    radius = F.hypot(F.col("y") - F.col("_cy"), F.col("x") - F.col("_cx"))
    placed = join_on(masked, center, keys).withColumn("_r", radius)
    limit = placed.groupBy(*keys).agg(F.max("_r").alias("r_max"))
    ring = F.floor(F.col("_r") * rings / F.nullif("r_max", F.lit(0.0))).cast("int")
    return (join_on(placed, limit, keys).withColumn("ring", ring).where((F.col("r_max") > 0) & (F.col("ring") < rings))
            .groupBy(*keys, "ring", "r_max").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")))


def detect_hollow(masked: DataFrame, rings: int = 20, keys: Sequence[str] = ("image_id", "region_id")) -> DataFrame:
    """Bright-centre test on the ring means: the inner quarter above 1.3 times the outer half."""
    keys = list(keys)
    size = masked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pixels"))
    prof = radial_profile(masked, rings, keys)
    inner, outer = rings // 4, rings // 2
    means = prof.groupBy(*keys, "r_max").agg(
        (F.sum(F.when(F.col("ring") < inner, F.col("mean"))) / inner).alias("center"), (F.sum(F.when(F.col("ring") >= outer, F.col("mean"))) / (rings - outer)).alias("edge"),
        F.map_from_entries(F.collect_list(F.struct("ring", "mean"))).alias("_p"))
    value = F.transform(F.sequence(F.lit(rings - 1), F.lit(1), F.lit(-1)), lambda i: F.struct(i.alias("i"), F.coalesce(F.try_element_at("_p", i), F.lit(0.0)).alias("m")))
    drop = F.get(F.filter(value, lambda s: s["m"] < F.coalesce("edge", F.lit(0.0)) * 0.9), F.lit(0))["i"]
    hollow = (F.col("n_pixels") >= 10) & (F.col("r_max") >= 5) & (F.coalesce("center", F.lit(0.0)) > 1.3 * F.coalesce("edge", F.lit(0.0)))
    out = join_on(size, means, keys, "left").withColumn("is_hollow", F.coalesce(hollow, F.lit(False)))
    shell = F.when(F.col("is_hollow"), F.coalesce(F.col("r_max") * (1.0 - drop / rings), F.lit(0.0))).otherwise(F.lit(0.0))
    return out.select(*keys, "is_hollow", shell.alias("shell_thickness_px"))


def detector_calibration(pixels: DataFrame, flat: str | None = None, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Background and yield: median and three deviations of a flat region if marked, else the 5 and 95 percentiles."""
    part = pixels.where(F.col(flat)) if flat else pixels
    if flat:
        spread = part.groupBy(*keys).agg((F.stddev_pop("v") * 3.0 + 1e-6).alias("eta0"))
        return join_on(quantiles(part, keys, "v", {"i_bg": 0.5}), spread, keys)
    return quantiles(part, keys, "v", {"i_bg": 0.05, "_hi": 0.95}).select(*keys, "i_bg", (F.col("_hi") - F.col("i_bg") + 1e-6).alias("eta0"))


# ---- predictions

def blend_tiles(tiles: DataFrame) -> DataFrame:
    """Plain mean of overlapping tile predictions per image pixel and class."""
    return tiles.groupBy("image_id", "cls", "y", "x").agg(F.avg("p").alias("p"))


def argmax_class(blended: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Most likely class of each pixel (the lowest one on a tie) and whether it passes the threshold."""
    best = blended.groupBy("image_id", "y", "x").agg(F.max_by(F.struct("cls", "p"), F.struct(F.col("p"), -F.col("cls"))).alias("b"))
    return best.select("image_id", "y", "x", F.col("b.cls").alias("cls"), F.col("b.p").alias("p"), (F.col("b.p") > threshold).alias("foreground"))
