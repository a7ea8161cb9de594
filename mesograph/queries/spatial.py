"""Queries over point patterns."""

from pyspark.sql import functions as F

from mesograph.operators import spatial as S
from mesograph.queries.annotation import sized
from mesograph.queries.registry import query

PI = "3.141592653589793"
P = ("fx_points",)
DRAWS = 199
RADII = [50.0 * k for k in range(1, 21)]
EPS, MIN_SAMPLES = 45.0, 4


def fields(t, points=None):
    ids = (points if points is not None else t.points()).select("image_id").distinct()
    return ids.select("image_id", F.lit(2000.0).alias("width_nm"), F.lit(2000.0).alias("height_nm"))


def rect_points(t):
    """Box centres of all annotations: the large pattern, with text ids."""
    return sized(t).select("image_id", F.col("ann_id").alias("point_id"), "label",
                           ((F.col("x0") + F.col("x1")) / 2.0 * F.col("pixel_size_nm")).alias("x_nm"),
                           ((F.col("y0") + F.col("y1")) / 2.0 * F.col("pixel_size_nm")).alias("y_nm"))


RECT_POINTS = """rp AS (SELECT r.image_id, ann_id AS point_id, (x0 + x1) / 2.0::DOUBLE * pixel_size_nm AS x_nm,
  (y0 + y1) / 2.0::DOUBLE * pixel_size_nm AS y_nm FROM fx_rects r JOIN fx_images i ON r.image_id = i.image_id)"""
D2 = "(a.x_nm-b.x_nm)*(a.x_nm-b.x_nm)+(a.y_nm-b.y_nm)*(a.y_nm-b.y_nm)"
NN = f"""nn AS (SELECT a.image_id, a.point_id, a.x_nm, a.y_nm, min(sqrt({D2})) AS nnd_nm FROM fx_points a JOIN fx_points b
ON a.image_id = b.image_id AND a.point_id <> b.point_id GROUP BY ALL)"""
DRAW = """sims AS (SELECT image_id, CAST(s AS INT) AS sim_id, point_id,
  ('0x' || substr(md5(concat_ws(':', 0, 'x', s, image_id, point_id)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * 2000 AS x_nm,
  ('0x' || substr(md5(concat_ws(':', 0, 'y', s, image_id, point_id)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * 2000 AS y_nm
FROM fx_points, range(0, {n}) t(s))"""


@query("radius_neighbours", f"""SELECT a.image_id, a.point_id, b.point_id AS neighbour_id, sqrt({D2}) AS distance_nm
FROM fx_points a JOIN fx_points b ON a.image_id = b.image_id AND a.point_id <> b.point_id WHERE {D2} <= 6400""", P, {6: "distance_nm"})
def _(t):
    return S.radius_neighbours(t.points(), 80.0)


@query("local_density", f"""SELECT a.image_id, a.point_id, count(*) - 1 AS n_neighbors FROM fx_points a JOIN fx_points b
ON a.image_id = b.image_id AND {D2} <= 10000 GROUP BY 1, 2""", P)
def _(t):
    return S.local_density(t.points(), 100.0).select("image_id", "point_id", "n_neighbors")


@query("local_density_annotations", f"""WITH {RECT_POINTS} SELECT a.image_id, a.point_id, count(*) - 1 AS n_neighbors FROM rp a JOIN rp b
ON a.image_id = b.image_id AND {D2} <= 6400 GROUP BY 1, 2""", ("fx_rects", "fx_images"))
def _(t):
    return S.local_density(rect_points(t), 80.0).select("image_id", "point_id", "n_neighbors")


@query("nearest_neighbour_join", f"WITH {NN} SELECT image_id, point_id, nnd_nm FROM nn", P, {6: "nnd_nm"})
def _(t):
    return S.nearest_neighbour_join(t.points()).select("image_id", "point_id", "nnd_nm")


@query("nearest_neighbour_annotations", f"""WITH {RECT_POINTS} SELECT a.image_id, a.point_id, min(sqrt({D2})) AS nnd_nm FROM rp a JOIN rp b
ON a.image_id = b.image_id AND a.point_id <> b.point_id GROUP BY 1, 2""", ("fx_rects", "fx_images"), {5: "nnd_nm"})
def _(t):
    return S.nearest_neighbour_join(rect_points(t)).select("image_id", "point_id", "nnd_nm")


def all_fields(t):
    """Fields of all images, those without points included."""
    ids = t.points().select("image_id").union(t.images().select("image_id")).distinct()
    return ids.select("image_id", F.lit(2000.0).alias("width_nm"), F.lit(2000.0).alias("height_nm"))


STATS = """, s AS (SELECT image_id, count(*) AS n, avg(nnd_nm) AS mean_nnd_nm, quantile_cont(nnd_nm, 0.5) AS median_nnd_nm,
    0.5 * sqrt(4e6::DOUBLE / count(*)) + (0.0514::DOUBLE + 0.041::DOUBLE / sqrt(count(*))) * 8000 / count(*) AS expected_nnd_nm FROM nn GROUP BY 1)
SELECT image_id, coalesce(n, 0) AS n, mean_nnd_nm, median_nnd_nm, expected_nnd_nm, mean_nnd_nm / expected_nnd_nm AS R,
  (mean_nnd_nm - expected_nnd_nm) / (0.26136::DOUBLE / sqrt(n * n / 4e6::DOUBLE)) AS z_score, CASE WHEN n IS NULL THEN 'fewer than two points' END AS message
FROM (SELECT image_id FROM fx_points UNION SELECT image_id FROM fx_images) LEFT JOIN s USING (image_id)"""


@query("nnd_stats", f"WITH {NN} {STATS}", ("fx_points", "fx_images"), {6: "mean_nnd_nm median_nnd_nm expected_nnd_nm R z_score"})
def _(t):
    return S.nnd_stats(t.points(), all_fields(t)).drop("p_value", "verdict")


@query("csr_simulate", f"WITH {DRAW.format(n=DRAWS)} SELECT * FROM sims", P, {6: "x_nm y_nm"})
def _(t):
    return S.csr_simulate(t.points(), fields(t), DRAWS)


@query("nnd_montecarlo_p", f"""WITH {DRAW.format(n=DRAWS)}, {NN}, simulated AS (
SELECT image_id, sim_id, avg(d) AS simulated FROM (SELECT a.image_id, a.sim_id, a.point_id, min(sqrt({D2})) AS d FROM sims a JOIN sims b
ON a.image_id = b.image_id AND a.sim_id = b.sim_id AND a.point_id <> b.point_id GROUP BY ALL) GROUP BY 1, 2),
c AS (SELECT image_id, observed, count(*) FILTER (simulated <= observed) AS n_le, count(*) FILTER (simulated >= observed) AS n_ge
FROM simulated JOIN (SELECT image_id, avg(nnd_nm) AS observed FROM nn GROUP BY 1) USING (image_id) GROUP BY 1, 2)
SELECT *, least(1.0::DOUBLE, 2.0::DOUBLE * least(n_le, n_ge) / {DRAWS + 1}) AS p_montecarlo,
  least(1.0::DOUBLE, 2.0::DOUBLE * (least(n_le, n_ge) + 1) / {DRAWS + 1}) AS p_montecarlo_plus FROM c""", P, {6: "observed p_montecarlo p_montecarlo_plus"})
def _(t):
    return S.nnd_montecarlo_p(t.points(), fields(t), DRAWS)


PAIR = ("image_id", "from_label", "to_label")
CROSS_PAIRS = f"""cross_nn AS (SELECT a.image_id, a.label AS from_label, b.label AS to_label, a.point_id, min(sqrt({D2})) AS cross_nnd_nm FROM fx_points a JOIN fx_points b
ON a.image_id = b.image_id AND a.label <> b.label GROUP BY 1, 2, 3, 4)"""


def pair_fields(a):
    return a.select(*PAIR).distinct().withColumns({"width_nm": F.lit(2000.0), "height_nm": F.lit(2000.0)})


@query("cross_nearest", f"WITH {CROSS_PAIRS} SELECT * FROM cross_nn", P, {6: "cross_nnd_nm"})
@query("cross_nearest_join", f"WITH {CROSS_PAIRS} SELECT * FROM cross_nn", P, {6: "cross_nnd_nm"})
def _(t):
    return S.cross_nearest_join(*S.label_pairs(t.points()), PAIR).select(*PAIR, "point_id", "cross_nnd_nm")


@query("cross_nn_stats", f"""WITH {CROSS_PAIRS}, a AS (SELECT image_id, from_label, to_label, count(*) AS n_a, avg(cross_nnd_nm) AS mean_cross_nnd_nm FROM cross_nn GROUP BY 1, 2, 3),
b AS (SELECT image_id, label AS to_label, count(*) AS n_b FROM fx_points GROUP BY 1, 2)
SELECT image_id, from_label, to_label, n_a, mean_cross_nnd_nm, n_b, 0.5 / sqrt(n_b / 4e6::DOUBLE) AS expected_nnd_nm,
  mean_cross_nnd_nm / (0.5 / sqrt(n_b / 4e6::DOUBLE)) AS R,
  (mean_cross_nnd_nm - 0.5 / sqrt(n_b / 4e6::DOUBLE)) / (0.26136::DOUBLE / sqrt(n_a * n_b / 4e6::DOUBLE)) AS z_score FROM a JOIN b USING (image_id, to_label)""",
       P, {6: "mean_cross_nnd_nm expected_nnd_nm R z_score"})
def _(t):
    a, b = S.label_pairs(t.points())
    return S.cross_nn_stats(a, b, pair_fields(a), PAIR).drop("p_value", "verdict")


PAIR_DRAW = """sims AS (SELECT b.image_id, l.label AS from_label, b.label AS to_label, CAST(s AS INT) AS sim_id, point_id,
  ('0x' || substr(md5(concat_ws(':', 0, 'x', s, b.image_id, l.label, b.label, point_id)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * 2000 AS x_nm,
  ('0x' || substr(md5(concat_ws(':', 0, 'y', s, b.image_id, l.label, b.label, point_id)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * 2000 AS y_nm
FROM fx_points b JOIN (SELECT DISTINCT image_id, label FROM fx_points) l ON l.image_id = b.image_id AND l.label <> b.label, range(0, {n}) t(s))"""


@query("cross_montecarlo_p", f"""WITH {PAIR_DRAW.format(n=DRAWS)}, {CROSS_PAIRS}, simulated AS (
SELECT image_id, from_label, to_label, sim_id, avg(d) AS simulated FROM (SELECT a.image_id, b.from_label, b.to_label, b.sim_id, a.point_id, min(sqrt({D2})) AS d FROM fx_points a JOIN sims b
ON a.image_id = b.image_id AND a.label = b.from_label GROUP BY ALL) GROUP BY 1, 2, 3, 4),
c AS (SELECT image_id, from_label, to_label, observed, count(*) FILTER (simulated <= observed) AS n_le, count(*) FILTER (simulated >= observed) AS n_ge
FROM simulated JOIN (SELECT image_id, from_label, to_label, avg(cross_nnd_nm) AS observed FROM cross_nn GROUP BY 1, 2, 3) USING (image_id, from_label, to_label) GROUP BY 1, 2, 3, 4)
SELECT *, least(1.0::DOUBLE, 2.0::DOUBLE * least(n_le, n_ge) / {DRAWS + 1}) AS p_montecarlo,
  least(1.0::DOUBLE, 2.0::DOUBLE * (least(n_le, n_ge) + 1) / {DRAWS + 1}) AS p_montecarlo_plus FROM c""", P, {6: "observed p_montecarlo p_montecarlo_plus"})
def _(t):
    a, b = S.label_pairs(t.points())
    return S.cross_montecarlo_p(a, b, pair_fields(a), DRAWS, keys=PAIR)


@query("ripley_l", f"""WITH r AS (SELECT CAST(50.0 * k AS DOUBLE) AS r FROM range(1, 21) t(k)), n AS (SELECT image_id, count(*) AS n FROM fx_points GROUP BY 1),
d AS (SELECT a.image_id, sqrt({D2}) AS d FROM fx_points a JOIN fx_points b ON a.image_id = b.image_id AND a.point_id <> b.point_id)
SELECT n.image_id, r AS radius_nm, sqrt(count(d.d) / (n * (n / 4e6::DOUBLE)) / {PI}) - r AS l_minus_r
FROM n CROSS JOIN r LEFT JOIN d ON d.image_id = n.image_id AND d.d <= r.r GROUP BY n.image_id, n, r""", P, {6: "l_minus_r"})
def _(t):
    return S.ripley_l(t.points(), fields(t), RADII)


@query("ripley_envelope", f"""WITH {DRAW.format(n=DRAWS)}, pts AS (SELECT image_id, -1 AS sim_id, point_id, x_nm, y_nm FROM fx_points UNION ALL SELECT image_id, sim_id, point_id, x_nm, y_nm FROM sims),
c AS (SELECT image_id, sim_id, k, count(*) AS c FROM (SELECT a.image_id, a.sim_id, CAST(ceil(sqrt({D2}) / 50) AS INT) AS k FROM pts a JOIN pts b
  ON a.image_id = b.image_id AND a.sim_id = b.sim_id AND a.point_id <> b.point_id AND {D2} <= 1000000) GROUP BY 1, 2, 3),
n AS (SELECT image_id, count(*) AS n FROM fx_points GROUP BY 1),
l AS (SELECT n.image_id, s AS sim_id, 50.0::DOUBLE * r AS r, sqrt(coalesce(sum(c), 0) / (n * (n / 4e6::DOUBLE)) / {PI}) - 50.0::DOUBLE * r AS l FROM n CROSS JOIN range(1, 21) g(r) CROSS JOIN range(-1, {DRAWS}) t(s)
  LEFT JOIN c ON c.image_id = n.image_id AND c.sim_id = s AND c.k <= r GROUP BY n.image_id, s, n, r)
SELECT image_id, r AS radius_nm, max(CASE WHEN sim_id = -1 THEN l END) AS l_minus_r, quantile_cont(l, 0.025) FILTER (sim_id >= 0) AS lo,
  quantile_cont(l, 0.975) FILTER (sim_id >= 0) AS hi FROM l GROUP BY 1, 2""", P, {6: "l_minus_r lo hi"})
def _(t):
    return S.ripley_envelope(t.points(), fields(t), RADII, DRAWS)


@query("kde_grid", f"""WITH m AS (SELECT image_id, count(*) AS n, var_samp(x_nm) * f AS sxx, var_samp(y_nm) * f AS syy, covar_samp(x_nm, y_nm) * f AS sxy
FROM fx_points JOIN (SELECT image_id, pow(count(*), -1.0 / 3) AS f FROM fx_points GROUP BY 1) USING (image_id) GROUP BY image_id, f),
g AS (SELECT CAST(i AS INT) AS i FROM range(0, 200) t(i)),
w AS (SELECT p.image_id, gy.i AS gy, gx.i AS gx, gx.i * 2000 / 199.0::DOUBLE - x_nm AS dx, gy.i * 2000 / 199.0::DOUBLE - y_nm AS dy, n, sxx, syy, sxy, sxx * syy - sxy * sxy AS det
FROM fx_points p JOIN m USING (image_id) CROSS JOIN g gx CROSS JOIN g gy)
SELECT image_id, gy, gx, 1e6 * sum(exp(-(syy * dx * dx - 2 * sxy * dx * dy + sxx * dy * dy) / (2 * det)) / (2 * {PI} * sqrt(det) * n)) AS density
FROM w GROUP BY 1, 2, 3""", P, {8: "density"})
def _(t):
    return S.kde_grid(t.points(), fields(t), 200).withColumn("density", F.col("density") * 1e6)


DBSCAN = f"""near AS (SELECT a.image_id, a.point_id AS a, b.point_id AS b FROM fx_points a JOIN fx_points b ON a.image_id = b.image_id AND {D2} <= {EPS * EPS}),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
reach(a, b) AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)
  UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a WHERE n.b IN (FROM core)),
root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY 1),
num AS (SELECT id, image_id, dense_rank() OVER (PARTITION BY image_id ORDER BY root) - 1 AS c FROM root JOIN fx_points p ON p.point_id = id),
clusters AS (SELECT p.image_id, p.point_id, coalesce(own.c, (SELECT min(m.c) FROM near n JOIN num m ON m.id = n.b WHERE n.a = p.point_id), -1) AS cluster_id
FROM fx_points p LEFT JOIN num own ON own.id = p.point_id)"""


@query("dbscan", f"WITH RECURSIVE {DBSCAN} SELECT image_id, point_id, cluster_id FROM clusters", P)
def _(t):
    return S.dbscan(t.points(), EPS, MIN_SAMPLES).select("image_id", "point_id", "cluster_id")


@query("count_positive_groups", f"""WITH RECURSIVE {DBSCAN} SELECT image_id, count(*) AS n_features, count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS n_clusters,
count(*) FILTER (cluster_id = -1) AS n_noise FROM clusters GROUP BY 1""", P)
def _(t):
    return S.cluster_summary(S.dbscan(t.points(), EPS, MIN_SAMPLES))


@query("focus_cluster", f"WITH RECURSIVE {DBSCAN} SELECT image_id, point_id FROM clusters WHERE cluster_id = 0", P)
def _(t):
    return S.dbscan(t.points(), EPS, MIN_SAMPLES).where(F.col("cluster_id") == 0).select("image_id", "point_id")


BATCH = f"""ids AS (SELECT image_id FROM fx_points UNION SELECT image_id FROM fx_images),
field AS (SELECT image_id, condition, coalesce(2200 * pixel_size_nm, greatest(bw, 1)) AS w, coalesce(2200 * pixel_size_nm, greatest(bh, 1)) AS h FROM ids LEFT JOIN fx_images USING (image_id)
  LEFT JOIN (SELECT image_id, max(x_nm) - min(x_nm) AS bw, max(y_nm) - min(y_nm) AS bh FROM fx_points GROUP BY 1) USING (image_id)),
batch AS (SELECT image_id, condition, coalesce(s.n, 0) AS n, mean_nnd_nm / (0.5 * sqrt(w * h / s.n) + (0.0514::DOUBLE + 0.041::DOUBLE / sqrt(s.n)) * 2 * (w + h) / s.n) AS R,
  coalesce(n_clusters, 0) AS n_clusters, coalesce(n_noise, 0) AS n_noise, CASE WHEN coalesce(s.n, 0) < 2 THEN 'fewer than two points' END AS message FROM field
  LEFT JOIN (SELECT image_id, count(*) AS n, avg(nnd_nm) AS mean_nnd_nm FROM nn GROUP BY 1) s USING (image_id)
  LEFT JOIN (SELECT image_id, count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS n_clusters, count(*) FILTER (cluster_id = -1) AS n_noise FROM clusters GROUP BY 1) c USING (image_id))"""


@query("spatial_batch", f"WITH RECURSIVE {DBSCAN}, {NN}, {BATCH} SELECT * FROM batch", ("fx_points", "fx_images"), {6: "R"})
def _(t):
    return S.spatial_batch(t.points(), t.images(), EPS, MIN_SAMPLES).drop("p_value", "verdict")


@query("condition_summary", f"""WITH RECURSIVE {DBSCAN}, {NN}, {BATCH} SELECT condition, count(R) AS n_images, avg(R) AS mean_R,
CASE WHEN count(R) > 1 THEN stddev_samp(R) / sqrt(count(R)) ELSE 0.0 END AS se_R FROM batch GROUP BY 1""", ("fx_points", "fx_images"), {6: "mean_R se_R"})
def _(t):
    return S.condition_summary(S.spatial_batch(t.points(), t.images(), EPS, MIN_SAMPLES))
