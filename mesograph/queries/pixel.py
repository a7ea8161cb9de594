"""Queries over pixel tables."""

from pyspark.sql import functions as F

from mesograph.functions import geometry as G
from mesograph.operators import pixels as X
from mesograph.queries.registry import query

PI = "3.141592653589793"
P = ("fx_pixels",)
FR = ("fx_frames",)
DOSE = """dose AS (SELECT movie_id, b AS bin, s AS start, e AS stop, y, x, avg(v) AS v FROM fx_frames JOIN (
  SELECT movie_id, CAST(i AS INT) AS b, CAST(round_even(i * n / 7.0::DOUBLE, 0) AS INT) AS s, CAST(round_even((i + 1) * n / 7.0::DOUBLE, 0) AS INT) AS e
  FROM (SELECT movie_id, max(frame) + 1 AS n FROM fx_frames GROUP BY 1), range(0, 7) t(i)) k USING (movie_id) WHERE frame >= s AND frame < e GROUP BY ALL)"""


@query("frame_mean", "SELECT movie_id, y, x, avg(v) AS v FROM fx_pixels GROUP BY 1, 2, 3", P, {9: "v"})
def _(t):
    return X.frame_mean(t.pixels())


@query("dose_series", f"WITH {DOSE} SELECT * FROM dose", FR, {9: "v"})
def _(t):
    return X.dose_series(t.frames(), 7)


@query("dose_difference", f"""WITH {DOSE}, d AS (SELECT d.movie_id, d.bin, d.start * 1.5::DOUBLE AS dose_from, (d.stop - 1) * 1.5::DOUBLE AS dose_to, d.y, d.x, d.v - f.v AS diff
FROM dose d JOIN dose f ON f.bin = 0 AND f.movie_id = d.movie_id AND f.y = d.y AND f.x = d.x WHERE d.bin > 0)
SELECT *, max(abs(diff)) OVER (PARTITION BY movie_id) AS span FROM d""", FR, {9: "diff span"})
def _(t):
    return X.dose_difference(X.dose_series(t.frames(), 7), 1.5)


VOX = "(SELECT movie_id AS volume_id, frame AS z, y, x, v FROM fx_frames)"


def voxels(t):
    return t.frames().select(F.col("movie_id").alias("volume_id"), F.col("frame").alias("z"), "y", "x", "v")


@query("z_projection", f"SELECT volume_id, y, x, max(v) AS v FROM {VOX} WHERE z >= 3 AND z < 20 GROUP BY 1, 2, 3", FR)
def _(t):
    return X.z_projection(voxels(t), "max", 3, 20)


@query("slice_at", f"SELECT volume_id, z, y, x, v FROM {VOX} WHERE z = 11", FR)
def _(t):
    return X.slice_at(voxels(t), 11, 40)


SHIFTS = """offs AS (SELECT CAST(a AS INT) AS dy, CAST(b AS INT) AS dx FROM range(-2, 3) s(a), range(-2, 3) u(b)),
score AS (SELECT f.movie_id, f.frame, dy, dx, corr(f.v, r.v) AS score FROM fx_frames f, offs JOIN fx_frames r ON r.frame = 0 AND r.movie_id = f.movie_id AND r.y = f.y + dy AND r.x = f.x + dx GROUP BY ALL),
shifts AS (SELECT movie_id, frame, dy, dx FROM score QUALIFY row_number() OVER (PARTITION BY movie_id, frame ORDER BY round(score, 9) DESC, dy * dy + dx * dx, dy DESC, dx DESC) = 1)"""


@query("estimate_shifts", f"WITH {SHIFTS} SELECT * FROM shifts", FR)
def _(t):
    fr = t.frames()
    return X.estimate_shifts(fr, fr.where("frame = 0"), 2)


@query("apply_shifts", """WITH s AS (SELECT *, frame % 3 - 1 AS dy, frame % 2 AS dx FROM fx_frames), n AS (SELECT movie_id, max(frame) + 1 AS n FROM fx_frames GROUP BY 1),
m AS (SELECT movie_id, y + dy AS y, x + dx AS x, sum(v) AS v FROM s WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7 GROUP BY ALL)
SELECT g.movie_id, g.y, g.x, coalesce(m.v, 0) / n AS v FROM (SELECT DISTINCT movie_id, y, x FROM fx_frames) g JOIN n USING (movie_id) LEFT JOIN m ON m.movie_id = g.movie_id AND m.y = g.y AND m.x = g.x""",
       FR, {9: "v"})
def _(t):
    fr = t.frames()
    shifts = fr.select("movie_id", "frame").distinct().withColumns({"dy": F.col("frame") % 3 - 1, "dx": F.col("frame") % 2})
    return X.apply_shifts(fr, shifts)


@query("motion_correct")
def _(t):
    return X.motion_correct(t.frames(), 2)


@query("drift_summary", """WITH s AS (SELECT DISTINCT movie_id, frame, frame % 5 - 2 AS dy, frame * frame % 7 - 3 AS dx FROM fx_frames),
l AS (SELECT *, lag(dy) OVER w AS py, lag(dx) OVER w AS px FROM s WINDOW w AS (PARTITION BY movie_id ORDER BY frame))
SELECT movie_id, max(sqrt(dy * dy + dx * dx)) * 5 AS max_shift, avg(sqrt(dy * dy + dx * dx)) * 5 AS mean_shift, sum(sqrt((dy - py) ** 2 + (dx - px) ** 2)) * 5 AS total_path FROM l GROUP BY 1""",
       FR, {6: "max_shift mean_shift total_path"})
def _(t):
    f = F.col("frame")
    shifts = t.frames().select("movie_id", "frame").distinct().withColumns({"dy": f % 5 - 2, "dx": f * f % 7 - 3})
    return X.drift_summary(shifts, 0.5, frames_per_bucket=16)


LAP = """n4 AS (SELECT image_id, coalesce(lag(v) OVER r, v) + coalesce(lead(v) OVER r, v) + coalesce(lag(v) OVER c, v) + coalesce(lead(v) OVER c, v) - 4 * v AS l FROM fx_pixels
  WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
lap AS (SELECT image_id, var_pop(l) AS blur_score FROM n4 GROUP BY 1)"""


@query("laplacian_variance", f"WITH {LAP} SELECT * FROM lap", P, {9: "blur_score"})
def _(t):
    return X.laplacian_variance(t.pixels())


GRAD = """grad AS (SELECT image_id, y, x, v, CASE WHEN x = 0 THEN lead(v) OVER r - v WHEN x = 7 THEN v - lag(v) OVER r ELSE (lead(v) OVER r - lag(v) OVER r) / 2 END AS p,
  CASE WHEN y = 0 THEN lead(v) OVER c - v WHEN y = 7 THEN v - lag(v) OVER c ELSE (lead(v) OVER c - lag(v) OVER c) / 2 END AS q FROM fx_pixels
  WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))"""


@query("surface_gradient", f"WITH {GRAD} SELECT image_id, y, x, p, q FROM grad", P, {9: "p q"})
def _(t):
    return X.surface_gradient(t.pixels()).select("image_id", "y", "x", "p", "q")


@query("height_surface_area", f"""WITH {GRAD} SELECT image_id, 0.25 * sum(sqrt(1 + p * p + q * q)) FILTER (v > 0) AS surface_nm2, stddev_pop(v) FILTER (v > 0) AS roughness,
  1.0::DOUBLE * count(*) FILTER (v > 0) AS sa_projected FROM grad GROUP BY 1""", P, {8: "surface_nm2 roughness sa_projected"})
def _(t):
    return X.height_surface_area(t.pixels().withColumn("inside", F.col("v") > 0), 0.5)


BOX = """box AS (SELECT a.image_id, a.y, a.x, sum(b.v) AS mass FROM fx_pixels a JOIN fx_pixels b ON a.image_id = b.image_id AND b.y BETWEEN a.y AND a.y + 2 AND b.x BETWEEN a.x AND a.x + 2
WHERE a.y <= 5 AND a.x <= 5 GROUP BY 1, 2, 3)"""


@query("gliding_box_sum", f"WITH {BOX} SELECT * FROM box", P, {9: "mass"})
def _(t):
    return X.gliding_box_sum(t.pixels(), 3)


@query("normalize_percentile", """SELECT image_id, y, x, (greatest(least(v, hi), lo) - lo) / (hi - lo + 1e-12) AS v FROM fx_pixels JOIN (
  SELECT image_id, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM fx_pixels GROUP BY 1) USING (image_id)""", P, {8: "v"})
def _(t):
    return X.normalize_percentile(t.pixels()).select("image_id", "y", "x", "v")


@query("normalize_sigma", """SELECT image_id, y, x, (greatest(least(v, hi), lo) - lo) / (hi - lo + 1e-12) AS v FROM fx_pixels JOIN (
  SELECT image_id, avg(v) - 2 * stddev_pop(v) AS lo, avg(v) + 2 * stddev_pop(v) AS hi FROM fx_pixels GROUP BY 1) USING (image_id)""", P, {8: "v"})
def _(t):
    return X.normalize_sigma(t.pixels(), 2.0).select("image_id", "y", "x", "v")


GAUSS = """k1 AS (SELECT CAST(o AS INT) AS o, exp(-o * o / (2 * {s} * {s})) / sum(exp(-o * o / (2 * {s} * {s}))) OVER () AS w FROM range(-{r}, {r} + 1) t(o)),
gx AS (SELECT a.image_id, a.y, a.x, sum(w * b.v) AS v FROM {src} a, k1 JOIN {src} b ON b.image_id = a.image_id AND b.y = a.y AND b.x = least((a.x + o + 32) % 16, 15 - (a.x + o + 32) % 16) GROUP BY 1, 2, 3),
gy AS (SELECT a.image_id, a.y, a.x, sum(w * b.v) AS v FROM gx a, k1 JOIN gx b ON b.image_id = a.image_id AND b.x = a.x AND b.y = least((a.y + o + 32) % 16, 15 - (a.y + o + 32) % 16) GROUP BY 1, 2, 3)"""
STRETCH = """cut AS (SELECT image_id, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM flt GROUP BY 1)
SELECT image_id, y, x, (greatest(least(v, hi), lo) - lo) / (hi - lo + 1e-12) AS v FROM flt JOIN cut USING (image_id)"""


@query("bandpass", f"""WITH {GAUSS.format(s='2.0::DOUBLE', r=8, src='fx_pixels')}, sub AS (SELECT p.image_id, p.y, p.x, p.v - g.v AS v FROM fx_pixels p JOIN gy g ON p.image_id = g.image_id AND p.y = g.y AND p.x = g.x),
{GAUSS.format(s='0.75::DOUBLE', r=3, src='sub').replace('k1', 'k2').replace('gx', 'hx').replace('gy', 'hy')}, flt AS (SELECT * FROM hy), {STRETCH}""", P, {7: "v"})
def _(t):
    return X.bandpass(t.pixels(), 2.0, 0.75)


@query("clamp_finite", """WITH b AS (SELECT image_id, y, x, CASE WHEN x = 0 AND y = 0 THEN 'NaN'::DOUBLE WHEN x = 1 AND y = 0 THEN 'Infinity'::DOUBLE WHEN x = 2 AND y = 0 THEN '-Infinity'::DOUBLE ELSE v END AS v FROM fx_pixels),
s AS (SELECT image_id, quantile_cont(v, 0.5) AS med, min(v) AS lo, max(v) AS hi FROM b WHERE isfinite(v) GROUP BY 1)
SELECT image_id, y, x, CASE WHEN isnan(v) THEN med WHEN isinf(v) AND v > 0 THEN hi WHEN isinf(v) THEN lo ELSE v END AS v FROM b JOIN s USING (image_id)""", P, {9: "v"})
def _(t):
    x, top = F.col("x"), F.col("y") == 0
    bad = F.when(top & (x == 0), float("nan")).when(top & (x == 1), float("inf")).when(top & (x == 2), float("-inf")).otherwise(F.col("v"))
    return X.clamp_finite(t.pixels().withColumn("v", bad)).select("image_id", "y", "x", "v")


@query("apply_gamma", "SELECT image_id, y, x, pow(greatest(least(v * 4, 1), 0), 0.7) AS v FROM fx_pixels", P, {9: "v"})
def _(t):
    return t.pixels().select("image_id", "y", "x", X.apply_gamma(F.col("v") * 4, 0.7).alias("v"))


@query("to_uint8", "SELECT image_id, y, x, CAST(floor(greatest(least(v * 4, 1), 0) * 255) AS INT) AS v FROM fx_pixels", P)
def _(t):
    return t.pixels().select("image_id", "y", "x", X.to_uint8(F.col("v") * 4).alias("v"))


SPEC = f"""spec AS (SELECT image_id, CAST(fy AS INT) AS fy, CAST(fx AS INT) AS fx, sum(v * cos(2 * {PI} * (fy * y + fx * x) / 8)) AS re, -sum(v * sin(2 * {PI} * (fy * y + fx * x) / 8)) AS im
FROM fx_pixels, range(0, 8) a(fy), range(0, 8) b(fx) GROUP BY 1, 2, 3)"""
SIGNED = "CASE WHEN fy < 4 THEN fy ELSE fy - 8 END AS sy, CASE WHEN fx < 4 THEN fx ELSE fx - 8 END AS sx"


@query("spectrum", f"WITH {SPEC} SELECT * FROM spec", P, {8: "re im"})
def _(t):
    return X.spectrum(t.pixels())


LOW = f"""low AS (SELECT image_id, sum(re * re + im * im) FILTER (sy * sy + sx * sx <= 9) / sum(re * re + im * im) AS low_freq_frac FROM (SELECT *, {SIGNED} FROM spec) GROUP BY 1)"""


@query("low_freq_fraction", f"WITH {SPEC}, {LOW} SELECT * FROM low", P, {8: "low_freq_frac"})
def _(t):
    return X.low_freq_fraction(t.pixels())


WEIGHT = "exp(-0.5 * (frame + 1) * 0.5 / (0.245 * pow(greatest(sqrt(sy * sy + sx * sx) / 16.0::DOUBLE, 1e-6), -1.665) + 2.81))"
DW = f"""dw AS (SELECT movie_id, fy, fx, sum(w * re) / sum(w) AS re, sum(w * im) / sum(w) AS im FROM (SELECT *, {WEIGHT} AS w FROM (SELECT s.*, movie_id, frame, {SIGNED}
FROM spec s JOIN (SELECT DISTINCT image_id, movie_id, frame FROM fx_frames) USING (image_id))) GROUP BY 1, 2, 3)"""


@query("dose_weighted_spectrum", f"WITH {SPEC}, {DW} SELECT * FROM dw", FR, {8: "re im"})
def _(t):
    return X.dose_weighted_spectrum(t.frames(), 8, 8, 0.5, 0.2)


@query("dose_weighted_average", f"""WITH {SPEC}, {DW} SELECT movie_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, sum(re * cos(2 * {PI} * (fy * y + fx * x) / 8) - im * sin(2 * {PI} * (fy * y + fx * x) / 8)) / 64 AS v
FROM dw, range(0, 8) a(y), range(0, 8) b(x) GROUP BY 1, 2, 3""", FR, {8: "v"})
def _(t):
    return X.dose_weighted_average(t.frames(), 8, 8, 0.5, 0.2)


@query("fourier_bandpass", f"""WITH {SPEC}, f AS (SELECT image_id, fy, fx, re * h AS re, im * h AS im FROM (SELECT *, (1 - exp(-(sy * sy + sx * sx) / 64.0::DOUBLE * 36 * ln(2))) * exp(-(sy * sy + sx * sx) / 64.0::DOUBLE * 4 * ln(2)) AS h FROM (SELECT *, {SIGNED} FROM spec))),
flt AS (SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, sum(re * cos(2 * {PI} * (fy * y + fx * x) / 8) - im * sin(2 * {PI} * (fy * y + fx * x) / 8)) / 64 AS v FROM f, range(0, 8) a(y), range(0, 8) b(x) GROUP BY 1, 2, 3),
{STRETCH}""", P, {7: "v"})
def _(t):
    return X.fourier_bandpass(t.pixels(), 6.0, 2.0)


QUAL = """qual AS (SELECT image_id, count(*) AS n_pixels, min(v) AS vmin, max(v) AS vmax, CASE WHEN abs(avg(v)) > 1e-9 THEN stddev_pop(v) / abs(avg(v)) ELSE 0 END AS cv_score,
  (count(*) FILTER (v = lo) + count(*) FILTER (v = hi)) / count(*) AS saturation_frac FROM fx_pixels JOIN (SELECT image_id, min(v) AS lo, max(v) AS hi FROM fx_pixels GROUP BY 1) USING (image_id) GROUP BY 1)"""


@query("saturation_fraction", f"WITH {QUAL} SELECT image_id, saturation_frac FROM qual", P, {8: "saturation_frac"})
def _(t):
    return X.intensity_quality(t.pixels()).select("image_id", "saturation_frac")


@query("coeff_variation", f"WITH {QUAL} SELECT image_id, cv_score, cv_score < 0.05 OR vmax - vmin < 1e-6 AS near_uniform FROM qual", P, {6: "cv_score"})
def _(t):
    return X.intensity_quality(t.pixels()).select("image_id", "cv_score", ((F.col("cv_score") < 0.05) | (F.col("vmax") - F.col("vmin") < 1e-6)).alias("near_uniform"))


ASSESS = f"""{SPEC}, {LOW}, {LAP}, {QUAL}, rep AS (SELECT image_id, blur_score, cv_score, saturation_frac, low_freq_frac, blur_score < 0.3 AS motion_blurred, cv_score < 0.05 OR vmax - vmin < 1e-6 AS near_uniform,
  saturation_frac > 0.05 AS saturated, low_freq_frac > 0.5 AS low_freq_heavy FROM lap JOIN qual USING (image_id) JOIN low USING (image_id))"""


def assessed(t):
    return X.assess_quality(t.pixels(), blur=0.3, low_freq=0.5)


@query("assess_quality", f"""WITH {ASSESS} SELECT *, NOT (motion_blurred OR near_uniform OR saturated OR low_freq_heavy) AS ok,
  concat_ws(',', CASE WHEN motion_blurred THEN 'motion_blurred' END, CASE WHEN near_uniform THEN 'near_uniform' END, CASE WHEN saturated THEN 'saturated' END, CASE WHEN low_freq_heavy THEN 'low_freq_heavy' END) AS warnings FROM rep""",
       P, {6: "blur_score cv_score saturation_frac low_freq_frac"})
def _(t):
    return assessed(t)


@query("rank_quality", f"""WITH {ASSESS} SELECT image_id, NOT (motion_blurred OR near_uniform OR saturated OR low_freq_heavy) AS ok, blur_score FROM rep""", P, {6: "blur_score"})
def _(t):
    return X.rank_quality(assessed(t)).select("image_id", "ok", "blur_score")


@query("crop_region", """WITH c AS (SELECT image_id, CASE WHEN image_id % 4 = 0 THEN 0 ELSE 2 END AS ox, CASE WHEN image_id % 4 = 0 THEN 0 ELSE 0 END AS oy,
  CASE WHEN image_id % 4 = 0 THEN 8 ELSE 6 END AS x1, CASE WHEN image_id % 4 = 0 THEN 8 ELSE 4 END AS y1 FROM (SELECT DISTINCT image_id FROM fx_pixels))
SELECT image_id, y, x, v, ox, oy FROM fx_pixels JOIN c USING (image_id) WHERE x >= ox AND x < x1 AND y >= oy AND y < y1""", P)
def _(t):
    ids = t.raw("embeddings").select(F.col("vec_id").alias("image_id"))
    crops = ids.where(F.col("image_id") % 4 != 0).select("image_id", F.lit(2.4).alias("cx0"), F.lit(6.5).alias("cx1"), F.lit(-3.0).alias("cy0"), F.lit(3.5).alias("cy1"))
    shape = ids.select("image_id", F.lit(8).alias("width"), F.lit(8).alias("height"))
    return X.crop_region(t.pixels().drop("movie_id"), crops, shape).select("image_id", "y", "x", "v", "ox", "oy")


@query("stride_downsample", "SELECT image_id, CAST(y // 3 AS INT) AS y, CAST(x // 3 AS INT) AS x, v FROM fx_pixels WHERE y % 3 = 0 AND x % 3 = 0", P)
def _(t):
    return X.stride_downsample(t.pixels(), 8, 8, 3).select("image_id", "y", "x", "v")


EDGES = "(VALUES (1.2, 0.7, 6.5, 1.4), (6.5, 1.4, 5.3, 6.2), (5.3, 6.2, 1.7, 5.1), (1.7, 5.1, 1.2, 0.7)) e(ax, ay, bx, by_)"


def rois(t):
    corners = [(1.2, 0.7), (6.5, 1.4), (5.3, 6.2), (1.7, 5.1)]
    shift = (F.col("image_id") % 3) * 0.5
    v = G.polygon(*[(F.lit(x) + shift, F.lit(y)) for x, y in corners])
    return t.raw("embeddings").select(F.col("vec_id").alias("image_id")).select("image_id", F.lit(1).alias("roi_id"), v.alias("vertices"), F.lit(0.5).alias("pixel_size_nm"))


INSIDE = f"""inside AS (SELECT image_id, y, x, v FROM fx_pixels, {EDGES} WHERE (ay <= y) <> (by_ <= y) AND x < ax::DOUBLE + (image_id % 3) * 0.5 + (y - ay::DOUBLE) * (bx::DOUBLE - ax::DOUBLE) / (by_::DOUBLE - ay::DOUBLE)
GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query("roi_pixel_join", f"WITH {INSIDE} SELECT image_id, y, x, v FROM inside", P)
def _(t):
    return X.roi_pixels(rois(t)).join(t.pixels(), ["image_id", "y", "x"]).select("image_id", "y", "x", "v")


@query("roi_intensity", f"""WITH {INSIDE} SELECT image_id, CAST(1 AS INT) AS roi_id, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, count(*) AS n_pixels,
  0.25 * (SELECT abs(sum(ax::DOUBLE * by_::DOUBLE - bx::DOUBLE * ay::DOUBLE)) / 2 FROM {EDGES}) AS area_nm2 FROM inside GROUP BY 1""", P, {8: "mean std min max area_nm2"})
def _(t):
    return X.roi_intensity(rois(t), t.pixels())


@query("line_profile", f"""WITH s AS (SELECT DISTINCT image_id, k, 0.5 + 6.2::DOUBLE * k / 8 AS sx, 1.25 + 4.5::DOUBLE * k / 8 AS sy FROM fx_pixels, range(0, 9) t(k)),
c AS (SELECT image_id, k, floor(sx) + i AS cx, floor(sy) + j AS cy, CASE i WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END * CASE j WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END AS g
FROM s, range(0, 2) a(i), range(0, 2) b(j))
SELECT c.image_id, CAST(7 AS INT) AS line_id, CAST(k AS INT) AS k, sqrt(6.2 * 6.2 + 4.5 * 4.5) * 0.5 * k / 8 AS distance_nm, sum(g * v) AS intensity FROM c JOIN fx_pixels p ON p.image_id = c.image_id AND p.x = cx AND p.y = cy GROUP BY c.image_id, k""",
       P, {8: "distance_nm intensity"})
def _(t):
    ids = t.raw("embeddings").select(F.col("vec_id").alias("image_id"))
    lines = ids.select("image_id", F.lit(7).alias("line_id"), F.lit(0.5).alias("ax"), F.lit(1.25).alias("ay"), F.lit(6.7).alias("bx"), F.lit(5.75).alias("by_"), F.lit(0.5).alias("pixel_size_nm"))
    return X.line_profile(lines, t.pixels(), ids.select("image_id", F.lit(8).alias("width"), F.lit(8).alias("height")))


MASKED = """m AS (SELECT image_id, 0 AS region_id, y, x, v FROM fx_pixels WHERE v > -0.05), c AS (SELECT image_id, avg(y) AS cy, avg(x) AS cx FROM m GROUP BY 1),
r AS (SELECT m.*, sqrt((y - cy) ** 2 + (x - cx) ** 2) AS r FROM m JOIN c USING (image_id)), b AS (SELECT image_id, max(r) AS r_max FROM r GROUP BY 1)"""


@query("radial_profile", f"""WITH {MASKED} SELECT image_id, CAST(0 AS INT) AS region_id, CAST(floor(r * 20 / r_max) AS INT) AS ring, r_max, avg(v) AS mean, count(*) AS n FROM r JOIN b USING (image_id)
WHERE floor(r * 20 / r_max) < 20 GROUP BY 1, 2, 3, 4""", P, {8: "r_max mean"})
def _(t):
    return X.radial_profile(t.pixels().where("v > -0.05").withColumn("region_id", F.lit(0)))


@query("detect_hollow", f"""WITH {MASKED}, p AS (SELECT image_id, r_max, CAST(floor(r * 20 / r_max) AS INT) AS ring, avg(v) AS mean FROM r JOIN b USING (image_id) WHERE floor(r * 20 / r_max) < 20 GROUP BY 1, 2, 3),
g AS (SELECT image_id, r_max, coalesce(sum(mean) FILTER (ring < 5), 0) / 5 AS center, coalesce(sum(mean) FILTER (ring >= 10), 0) / 10 AS edge FROM p GROUP BY 1, 2),
h AS (SELECT g.*, n >= 10 AND r_max >= 5 AND center > 1.3 * edge AS hollow FROM g JOIN (SELECT image_id, count(*) AS n FROM m GROUP BY 1) USING (image_id))
SELECT image_id, CAST(0 AS INT) AS region_id, hollow AS is_hollow, CASE WHEN hollow THEN coalesce(r_max * (1 - (SELECT max(i) FROM range(1, 20) t(i) LEFT JOIN p ON p.image_id = h.image_id AND p.ring = i WHERE coalesce(p.mean, 0) < h.edge * 0.9) / 20), 0) ELSE 0 END AS shell_thickness_px FROM h""",
       P, {8: "shell_thickness_px"})
def _(t):
    return X.detect_hollow(t.pixels().where("v > -0.05").withColumn("region_id", F.lit(0)))


@query("detector_calibration", """SELECT image_id, quantile_cont(v, 0.5) FILTER (x < 3) AS i_bg, stddev_pop(v) FILTER (x < 3) * 3 + 1e-6 AS eta0 FROM fx_pixels GROUP BY 1""", P, {8: "i_bg eta0"})
def _(t):
    return X.detector_calibration(t.pixels().withColumn("flat", F.col("x") < 3), "flat")


TILES = """tl AS (SELECT image_id, CAST(c AS INT) AS cls, y, x, v * (c + 1) / 3.0::DOUBLE + s * 0.01::DOUBLE AS p FROM fx_pixels, range(0, 3) a(c), range(0, 2) b(s) WHERE s = 0 OR x >= 4),
bl AS (SELECT image_id, cls, y, x, avg(p) AS p FROM tl GROUP BY ALL)"""


def tiles(t):
    both = t.pixels().withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return both.where((F.col("s") == 0) | (F.col("x") >= 4)).withColumn("p", F.col("v") * (F.col("cls") + 1) / 3.0 + F.col("s") * 0.01)


@query("blend_tiles", f"WITH {TILES} SELECT * FROM bl", P, {9: "p"})
def _(t):
    return X.blend_tiles(tiles(t))


@query("argmax_class", f"""WITH {TILES} SELECT image_id, y, x, arg_max(cls, p) AS cls, max(p) AS p, max(p) > 0.1 AS foreground FROM bl GROUP BY 1, 2, 3""", P, {9: "p"})
def _(t):
    return X.argmax_class(X.blend_tiles(tiles(t)), 0.1)
