"""Queries for particle surface area, over the annotation boxes as outlines."""

from pyspark.sql import functions as F

from mesograph.functions import geometry as G
from mesograph.operators import pixels as X
from mesograph.operators import surface as S
from mesograph.queries.annotation import RECT, box, sized
from mesograph.queries.pixel import BOX
from mesograph.queries.registry import query

PI = "3.141592653589793"
AB = ("fx_rects", "fx_images")
R = ("fx_rects",)


def particles(t):
    return box(t.spread(sized(t))).withColumnRenamed("ann_id", "particle_id").withColumn("px_unc_nm", 0.02 * F.col("pixel_size_nm"))


def spheroid_sql(a, b):
    return f"""CASE WHEN abs({a} - {b}) < 1e-9 THEN 4 * {PI} * {a} * {a}
  WHEN {a} > {b} THEN 2 * {PI} * {b} * {b} * (1 + {a} / ({b} * sqrt(1 - ({b} / {a}) ** 2)) * asin(sqrt(1 - ({b} / {a}) ** 2)))
  ELSE 2 * {PI} * {b} * {b} * (1 + ({a} / {b}) ** 2 / sqrt(1 - ({a} / {b}) ** 2) * atanh(sqrt(1 - ({a} / {b}) ** 2))) END"""


@query("contour_metrics", f"""SELECT ann_id AS particle_id, least(1.0, 4 * {PI} * a * b / (4 * (a + b) * (a + b))) AS circularity, 1.0::DOUBLE AS convexity, greatest(a, b) / greatest(least(a, b), 1) AS box_aspect,
  0.0::DOUBLE AS aggregate_score FROM (SELECT ann_id, x1 - x0 AS a, y1 - y0 AS b FROM fx_rects)""", R, {6: "circularity convexity box_aspect"})
def _(t):
    return S.contour_metrics(particles(t)).select("particle_id", "circularity", "convexity", "box_aspect", "aggregate_score")


@query("sa_ellipsoid", f"SELECT ann_id AS particle_id, {spheroid_sql('(w / 2)', '(h / 2)')} AS sa FROM ({RECT})", AB, {5: "sa"})
def _(t):
    px = F.col("pixel_size_nm")
    a, b = (F.col("x1") - F.col("x0")) * px / 2.0, (F.col("y1") - F.col("y0")) * px / 2.0
    return sized(t).select(F.col("ann_id").alias("particle_id"), S.sa_spheroid(a, b).alias("sa"))


@query("sa_closed_forms", f"""SELECT ann_id AS particle_id, (4 + 0.5 * pow(greatest(w, h) / greatest(least(w, h), 1) - 1, 0.7)) * w * h AS sa_cauchy,
  {PI} * least(w, h) * (least(w, h) + greatest(0, greatest(w, h) - least(w, h))) AS sa_capsule,
  4 * (w + h) * (w + h) / ({PI} * greatest(0.05, least(1, {PI} * w * h / ((w + h) * (w + h))))) AS sa_isoperimetric, 4 * w * h AS sa_projected, 4 * w * h * 2 * 0.02 AS sa_uncertainty FROM ({RECT})""",
       AB, {4: "sa_cauchy sa_capsule sa_isoperimetric sa_projected sa_uncertainty"})
def _(t):
    px = F.col("pixel_size_nm")
    w, h = (F.col("x1") - F.col("x0")) * px, (F.col("y1") - F.col("y0")) * px
    perim = 2.0 * (w + h)
    return sized(t).select(
        F.col("ann_id").alias("particle_id"), S.sa_cauchy(w * h, S.box_aspect(w, h)).alias("sa_cauchy"), S.sa_capsule(F.greatest(w, h), F.least(w, h)).alias("sa_capsule"),
        S.sa_isoperimetric(perim, G.circularity(w * h, perim)).alias("sa_isoperimetric"), S.sa_projected(w * h).alias("sa_projected"),
        S.sa_uncertainty(S.sa_projected(w * h), px, 0.02 * px).alias("sa_uncertainty"))


@query("select_method", """SELECT ann_id AS particle_id, CASE WHEN f > 1.15 THEN 'fourier_spiky' WHEN a > 2.5 AND v > 0.85 THEN 'capsule' WHEN c > 0.75 AND v > 0.85 THEN 'ellipsoid' WHEN v > 0.85 THEN 'cauchy' ELSE 'fourier' END AS method
FROM (SELECT ann_id, 1 + x0 / 10000 AS f, (x1 - x0) / 4 AS a, (y1 - y0) / 13 AS c, 0.7 + (y1 - y0) / 40 AS v FROM fx_rects)""", R)
def _(t):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return t.rects().select(F.col("ann_id").alias("particle_id"), S.select_method(1 + F.col("x0") / 10000, w / 4, h / 13, 0.7 + h / 40).alias("method"))


@query("hollow_correction", f"""SELECT ann_id AS particle_id, CASE WHEN label = 'R' AND w / 2 > 1.5 AND h / 2 > 1.5 THEN 100 + CASE WHEN abs(w - h) / 2 < 0.01 * (greatest(w, h) / 2 - 1.5) THEN {PI} * ((w + h) / 2 - 3) ** 2
  ELSE {spheroid_sql('(w / 2 - 1.5)', '(h / 2 - 1.5)')} END ELSE 100.0 END AS sa FROM ({RECT})""", AB, {5: "sa"})
def _(t):
    px = F.col("pixel_size_nm")
    a, b = (F.col("x1") - F.col("x0")) * px / 2.0, (F.col("y1") - F.col("y0")) * px / 2.0
    return sized(t).select(F.col("ann_id").alias("particle_id"), S.hollow_correction(F.lit(100.0), a, b, F.lit(1.5), F.col("label") == "R").alias("sa"))


AREA = "area AS (SELECT ann_id, image_id, ceil(x0) AS ax, ceil(x1) - 1 AS bx, ceil(y0) AS ay, ceil(y1) - 1 AS by_ FROM fx_rects), dim AS (SELECT *, bx - ax + 1 AS nx, by_ - ay + 1 AS ny FROM area)"


def masks(t):
    from mesograph.operators.masks import rasterize_roi

    return rasterize_roi(particles(t), ["image_id", "particle_id"])


def runs(t):
    from mesograph.operators.masks import rasterize_spans

    return rasterize_spans(particles(t), ["image_id", "particle_id"])


@query("ellipse_fit", f"""WITH {AREA} SELECT ann_id AS particle_id, CAST(nx * ny AS BIGINT) AS mask_area, 2 * sqrt((greatest(nx, ny) ** 2 - 1) / 12) AS a_px, 2 * sqrt((least(nx, ny) ** 2 - 1) / 12) AS b_px FROM dim""",
       R, {5: "a_px b_px"})
def _(t):
    return S.ellipse_fit(masks(t))


@query("coverage_score", f"""WITH {AREA} SELECT ann_id AS particle_id, least(1, nx * ny / ({PI} * 4 * sqrt((nx * nx - 1) / 12) * sqrt((ny * ny - 1) / 12))) AS coverage FROM dim""", R, {6: "coverage"})
def _(t):
    return S.ellipse_fit(masks(t)).select("particle_id", S.coverage_score(F.col("mask_area"), F.col("a_px"), F.col("b_px")).alias("coverage"))


CONTOUR = """e AS (SELECT ann_id, k, CASE k WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x1 ELSE x0 END AS ax, CASE k WHEN 0 THEN y0 WHEN 1 THEN y0 WHEN 2 THEN y1 ELSE y1 END AS ay,
  CASE k WHEN 0 THEN x1 WHEN 1 THEN x1 WHEN 2 THEN x0 ELSE x0 END AS bx, CASE k WHEN 0 THEN y0 WHEN 1 THEN y1 WHEN 2 THEN y1 ELSE y0 END AS by_ FROM fx_rects, range(0, 4) t(k)),
s AS (SELECT *, greatest(ceil(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2)), 1)::BIGINT AS n FROM e),
c AS (SELECT ann_id, k, j, ax + (bx - ax) * j / n AS x, ay + (by_ - ay) * j / n AS y FROM (SELECT *, unnest(range(0, n)) AS j FROM s)),
ctr AS (SELECT *, row_number() OVER (PARTITION BY ann_id ORDER BY k, j) - 1 AS i, count(*) OVER (PARTITION BY ann_id) AS n, avg(x) OVER (PARTITION BY ann_id) AS cx, avg(y) OVER (PARTITION BY ann_id) AS cy FROM c)"""


@query("roughness_index", f"""WITH {CONTOUR} SELECT ann_id AS particle_id, CASE WHEN count(*) < 20 THEN 0 ELSE stddev_pop(r) / avg(r) END AS roughness FROM (SELECT ann_id, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r FROM ctr) GROUP BY 1""",
       R, {7: "roughness"})
def _(t):
    return S.roughness_index(S.contour_points(particles(t), packed=True))


@query("discrete_curvature", f"""WITH {CONTOUR}, w AS (SELECT a.ann_id, a.i, a.x - b.x AS ux, a.y - b.y AS uy, c.x - a.x AS vx, c.y - a.y AS vy FROM ctr a
  JOIN ctr b ON b.ann_id = a.ann_id AND b.i = (a.i - 2 + a.n) % a.n JOIN ctr c ON c.ann_id = a.ann_id AND c.i = (a.i + 2) % a.n)
SELECT ann_id AS particle_id, sum(abs(ux * vy - uy * vx) / greatest(pow(sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy), 1.5), 1e-9)) AS total, count(*) AS n FROM w GROUP BY 1""", R, {5: "total"})
def _(t):
    return S.discrete_curvature(particles(t)).groupBy("particle_id").agg(F.sum("curvature").alias("total"), F.count(F.lit(1)).alias("n"))


@query("richardson", f"""WITH {CONTOUR}, st AS (SELECT ann_id, n, unnest(range(0, 8)) AS p FROM (SELECT DISTINCT ann_id, n FROM ctr)), k AS (SELECT ann_id, n, CAST(pow(2, p) AS BIGINT) AS s FROM st WHERE pow(2, p) <= greatest(2, floor(n / 4)) AND ceil(n / pow(2, p)) >= 3),
q AS (SELECT k.ann_id, k.s, k.n, ctr.i, ctr.x, ctr.y FROM k JOIN ctr ON ctr.ann_id = k.ann_id AND ctr.i % k.s = 0),
g AS (SELECT ann_id, s, n, x - lag(x, 1, lastx) OVER w AS dx, y - lag(y, 1, lasty) OVER w AS dy FROM (SELECT *, last_value(x) OVER f AS lastx, last_value(y) OVER f AS lasty FROM q WINDOW f AS (PARTITION BY ann_id, s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WINDOW w AS (PARTITION BY ann_id, s ORDER BY i)),
l AS (SELECT ann_id, n, ln(s) AS ls, ln(sum(sqrt(dx * dx + dy * dy))) AS lp FROM g GROUP BY ann_id, n, s),
r AS (SELECT ann_id, n, count(*) AS k, regr_slope(lp, ls) AS m, regr_intercept(lp, ls) AS b FROM l GROUP BY 1, 2)
SELECT ann_id AS particle_id, CASE WHEN n < 20 OR k < 3 THEN 2 * (w + h) ELSE exp(b) * pixel_size_nm END AS perimeter_nm, CASE WHEN n < 20 OR k < 3 THEN 1 ELSE greatest(1, least(2, 1 - m)) END AS richardson_fractal_dim
FROM r JOIN ({RECT}) USING (ann_id)""", AB, {5: "perimeter_nm richardson_fractal_dim"})
def _(t):
    return S.richardson(particles(t))


@query("box_count_fractal", f"""WITH {CONTOUR}, p AS (SELECT DISTINCT ann_id, floor(x)::BIGINT AS x, floor(y)::BIGINT AS y FROM ctr), z AS (SELECT * FROM (VALUES (16), (8), (4), (2)) v(s)),
b AS (SELECT ann_id, s, count(*) AS n FROM (SELECT DISTINCT ann_id, s, x // s AS x, y // s AS y FROM p, z) GROUP BY 1, 2),
f AS (SELECT ann_id, regr_slope(ln(n), ln(1.0::DOUBLE / s)) AS d FROM b GROUP BY 1), t AS (SELECT ann_id, count(*) AS n FROM p GROUP BY 1)
SELECT ann_id AS particle_id, CASE WHEN n < 10 THEN 1 ELSE greatest(1, least(2, d)) END AS fractal_dim FROM f JOIN t USING (ann_id)""", R, {6: "fractal_dim"})
def _(t):
    size = t.rects().select(F.col("ann_id").alias("particle_id"), F.lit(32).alias("height"), F.lit(40).alias("width"))
    return S.box_count_fractal(S.contour_points(particles(t), packed=True), size)


@query("sa_fourier", f"""WITH {CONTOUR}, r AS (SELECT ann_id, i, n, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r FROM ctr),
m AS (SELECT ann_id, n, avg(r) AS r0, sqrt(sum(r * cos(2 * {PI} * i / n)) ** 2 + sum(r * sin(2 * {PI} * i / n)) ** 2) / n AS r1, avg(r * r) AS p2, sum(CASE i % 2 WHEN 0 THEN r ELSE -r END) / n AS alt FROM r GROUP BY 1, 2),
h AS (SELECT ann_id, n, r0, r1, sqrt(greatest((p2 - r0 * r0 + CASE n % 2 WHEN 0 THEN alt * alt ELSE 0 END) / 2 - r1 * r1, 0)) / r0 AS rough FROM m)
SELECT ann_id AS particle_id, CASE WHEN n < 20 THEN 0 ELSE (r0 + r1) * pixel_size_nm END AS a_nm, CASE WHEN n < 20 THEN 0 ELSE rough END AS rough FROM h JOIN ({RECT}) USING (ann_id)""", AB, {5: "a_nm rough"})
def _(t):
    return S.fourier_measures(particles(t), spikes=False).select("particle_id", (F.col("_f.a_px") * F.col("pixel_size_nm")).alias("a_nm"), F.col("_f.rough").alias("rough"))


@query("lacunarity", f"WITH {BOX} SELECT image_id, CASE WHEN avg(mass) < 1e-9 THEN 0 ELSE avg(mass * mass) / (avg(mass) * avg(mass)) - 1 END AS lacunarity FROM box GROUP BY 1", ("fx_pixels",), {6: "lacunarity"})
def _(t):
    return X.lacunarity(t.pixels(), 3)


@query("mask_lacunarity", f"""WITH {AREA}, b AS (SELECT ann_id, nx, ny, greatest(2, least(10, floor((ny + 4) / 3), floor((nx + 4) / 3)))::BIGINT AS r FROM dim),
m AS (SELECT ann_id, (greatest(0, least(i + r - 1, nx + 1) - greatest(i, 2) + 1)) * (greatest(0, least(j + r - 1, ny + 1) - greatest(j, 2) + 1)) AS mass
FROM (SELECT *, unnest(range(0, (nx + 4 - r + 1)::BIGINT)) AS i FROM (SELECT *, unnest(range(0, (ny + 4 - r + 1)::BIGINT)) AS j FROM b)))
SELECT ann_id AS particle_id, avg(mass * mass) / (avg(mass) * avg(mass)) - 1 AS lacunarity FROM m GROUP BY 1""", R, {6: "lacunarity"})
def _(t):
    return S.mask_lacunarity(runs(t))


@query("sa_fourier_spiky")
def _(t):
    px = F.col("pixel_size_nm")
    f = S.fourier_measures(particles(t))
    base = S.sa_fourier(F.col("_f.a_px") * px, F.col("_f.b_px") * px, F.col("_f.rough"))
    return f.select("particle_id", S.sa_fourier_spiky(base, F.col("_f.spikes") * px * px, F.col("_f.n_spikes"), F.col("_f.r_mean") * px,
                                                      G.perimeter(F.col("vertices")) * px).alias("sa"))


@query("local_peaks")
def _(t):
    return S.local_peaks(particles(t)).groupBy("particle_id").agg(F.count(F.lit(1)).alias("n_peaks"))


@query("radial_signal")
def _(t):
    return S.radial_signal(particles(t)).groupBy("particle_id").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_r"))


@query("monte_carlo_perimeter")
def _(t):
    return S.monte_carlo_perimeter(masks(t))


@query("erosion_depth", f"""WITH {AREA} SELECT ann_id AS particle_id, CAST(floor((least(nx, ny) + 1) / 2) AS INT) AS depth FROM dim""", R)
def _(t):
    return S.erosion_depth(runs(t)).withColumn("depth", F.col("depth").cast("int"))


@query("hollow_by_holes", "SELECT ann_id AS particle_id, false AS is_hollow, 0.0::DOUBLE AS shell_px FROM fx_rects", R)
def _(t):
    return S.shell_from_holes(runs(t))


@query("estimate_surface_area")
def _(t):
    return S.estimate_surface_area(particles(t))
