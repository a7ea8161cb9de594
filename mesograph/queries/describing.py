"""Queries for descriptive tables."""

from pyspark.sql import functions as F

from mesograph.operators import annotations as A
from mesograph.operators import describe as D
from mesograph.queries.annotation import METRICS, RECT, sized
from mesograph.queries.registry import query

PI = "3.141592653589793"
M = ("fx_measurements",)
P = ("fx_particles",)
AB = ("fx_rects", "fx_images")


@query("describe_metric", f"""SELECT label AS "group", count(*) AS n, avg(e) AS mean, stddev_samp(e) AS std, quantile_cont(e, 0.5) AS median,
  round(quantile_cont(e, 0.75) - quantile_cont(e, 0.25), 4) AS iqr, min(e) AS min, max(e) AS max, quantile_cont(e, 0.25) AS q25, quantile_cont(e, 0.75) AS q75
FROM (SELECT label, round(ecd_nm, 4) AS e FROM (SELECT label, {METRICS} FROM ({RECT}))) GROUP BY 1 HAVING count(*) >= 3""", AB,
       {6: "mean std median min max q25 q75"})
def size_distribution(t):
    """The flagship: size distribution per label over all annotated images."""
    return D.describe_metric(A.rect_metrics(sized(t)), "label", "ecd_nm")


@query("measurement_stats", f"""SELECT label, metric, count(*) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.5) AS median
FROM (SELECT label, unnest(['area_nm2', 'ecd_nm', 'perimeter_nm', 'circularity', 'aspect_ratio', 'feret_nm', 'bbox_w_nm', 'bbox_h_nm']) AS metric,
  unnest([round(area_nm2, 4), round(ecd_nm, 4), round(perimeter_nm, 4), round(circularity, 4), round(aspect_ratio, 4), round(feret_nm, 4), round(bbox_w_nm, 4), round(bbox_h_nm, 4)]) AS v
  FROM (SELECT label, {METRICS} FROM ({RECT}))) GROUP BY 1, 2""", AB, {5: "mean std min max median"})
def _(t):
    return D.measurement_stats(A.rect_metrics(sized(t)), "label", A.SHAPE_METRICS)


@query("group_summary_ci", """SELECT label, count(*) AS n, avg(ecd_nm) AS mean, coalesce(stddev_samp(ecd_nm), 0) AS std, quantile_cont(ecd_nm, 0.25) AS q25, quantile_cont(ecd_nm, 0.5) AS median,
  quantile_cont(ecd_nm, 0.75) AS q75, coalesce(stddev_samp(ecd_nm), 0) / sqrt(count(*)) AS sem, quantile_cont(ecd_nm, 0.75) - quantile_cont(ecd_nm, 0.25) AS iqr
FROM fx_measurements GROUP BY 1""", M, {6: "mean std q25 median q75 sem iqr"})
def _(t):
    return D.group_summary_ci(t.measurements(), "label", "ecd_nm").drop("ci95_lo", "ci95_hi")


SUMMARY = """count(SA_nm2) AS n, count(v) AS n_valid, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, stddev_samp(v) / sqrt(count(v)) AS sem,
  stddev_samp(v) / avg(v) AS cv, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95
FROM (SELECT *, CASE WHEN SA_nm2 > 0 THEN SA_nm2 END AS v FROM fx_particles)"""
SIX = {6: "mean std min max sem cv p5 p25 median p75 p95"}


@query("summarize_column", f"SELECT {SUMMARY}", P, SIX)
def _(t):
    return D.summarize_column(t.particles(), "SA_nm2")


@query("per_method_summary", f"SELECT method_used, {SUMMARY} GROUP BY 1", P, SIX)
def _(t):
    return D.summarize_column(t.particles(), "SA_nm2", ["method_used"])


@query("method_report", "SELECT method_used, count(*) AS count, count(*) / sum(count(*)) OVER () AS fraction FROM fx_particles GROUP BY 1", P, {9: "fraction"})
def _(t):
    return D.value_report(t.particles(), "method_used")


@query("flag_report", """SELECT CASE WHEN flag_reason IS NULL OR flag_reason = '' THEN 'none' ELSE flag_reason END AS flag_reason, count(*) AS count,
  count(*) / sum(count(*)) OVER () AS fraction FROM fx_particles GROUP BY 1""", P, {9: "fraction"})
def _(t):
    return D.value_report(t.particles(), "flag_reason", "none")


@query("method_breakdown", "SELECT label, " + ", ".join(f"avg(CASE WHEN method_used = '{m}' THEN 1.0::DOUBLE ELSE 0 END) AS {m}" for m in D.METHODS)
       + " FROM fx_particles GROUP BY 1", P, {9: " ".join(D.METHODS)})
def _(t):
    return D.method_breakdown(t.particles(), "label")


@query("hollow_report", """SELECT count(*) FILTER (is_hollow) AS n_hollow, avg(CASE WHEN is_hollow THEN 1.0::DOUBLE ELSE 0 END) AS fraction_hollow,
  avg(shell_thickness_estimate_nm) FILTER (is_hollow) AS mean_shell_thickness_nm FROM fx_particles""", P, {9: "fraction_hollow mean_shell_thickness_nm"})
def _(t):
    return D.hollow_report(t.particles())


@query("specific_surface_area", """SELECT sum(v) / 5e6::DOUBLE AS specific_sa_nm_inv, sum(v) AS total_sa_nm2, count(*) AS n_particles, count(v) AS n_included,
  count(*) FILTER (SA_nm2 > 0) - count(v) AS n_excluded_flagged, avg(v) AS mean_sa_nm2, stddev_pop(v) AS std_sa_nm2, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.10) AS p10,
  quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median_sa_nm2, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.95) AS p95
FROM (SELECT *, CASE WHEN SA_nm2 > 0 AND NOT flagged THEN SA_nm2 END AS v FROM fx_particles)""", P,
       {6: "specific_sa_nm_inv total_sa_nm2 mean_sa_nm2 std_sa_nm2 p5 p10 p25 median_sa_nm2 p75 p90 p95"})
def _(t):
    return D.specific_surface_area(t.particles(), 5e6)


@query("histogram", """WITH s AS (SELECT min(feret_nm) AS lo, max(feret_nm) AS hi FROM fx_measurements),
b AS (SELECT label, CAST(least(floor((feret_nm - lo) / ((hi - lo) / 13)), 12) AS INT) AS bin, lo, (hi - lo) / 13 AS w FROM fx_measurements, s)
SELECT label, bin, count(*) AS count, lo + bin * w AS "left", lo + (bin + 1) * w AS "right", count(*) / (sum(count(*)) OVER (PARTITION BY label) * w) AS density FROM b GROUP BY label, bin, lo, w""",
       M, {6: "density"})
def _(t):
    return D.histogram(t.measurements(), "label", "feret_nm", 13, density=True)


@query("category_counts", """SELECT name AS category, count(*) AS n FROM fx_coco_annotations a JOIN fx_coco_categories c ON a.category_id = c.id
WHERE lower(name) NOT IN ('background', 'ignore') GROUP BY 1""", ("fx_coco_annotations", "fx_coco_categories"))
def _(t):
    return D.category_counts(A.join_categories(t.coco_annotations(), t.coco_categories()))


@query("average_ranks", """SELECT label, feret_nm, count(*) AS n, avg(r) AS rank FROM (SELECT label, feret_nm,
  rank() OVER (PARTITION BY label ORDER BY feret_nm) + (count(*) OVER (PARTITION BY label, feret_nm) - 1) / 2 AS r FROM fx_measurements) GROUP BY 1, 2""", M, {4: "rank"})
def _(t):
    return D.average_ranks(t.measurements(), "feret_nm", ["label"])


@query("ecdf_dkw", """SELECT label, ecd_nm, ecdf, greatest(ecdf - eps, 0) AS lo, least(ecdf + eps, 1) AS hi FROM (
SELECT DISTINCT label, ecd_nm, count(*) OVER (PARTITION BY label ORDER BY ecd_nm) / count(*) OVER (PARTITION BY label) AS ecdf,
  sqrt(ln(2 / 0.05::DOUBLE) / (2 * count(*) OVER (PARTITION BY label))) AS eps, count(*) OVER (PARTITION BY label) AS n FROM fx_measurements WHERE ecd_nm > 0) WHERE n >= 2""",
       M, {8: "ecdf lo hi"})
def _(t):
    return D.ecdf_dkw(t.measurements(), "label", "ecd_nm")


@query("box_stats", """WITH q AS (SELECT label, quantile_cont(ecd_nm, 0.25) AS q25, quantile_cont(ecd_nm, 0.5) AS median, quantile_cont(ecd_nm, 0.75) AS q75 FROM fx_measurements GROUP BY 1)
SELECT label, q25, median, q75, min(ecd_nm) FILTER (i) AS whisker_lo, max(ecd_nm) FILTER (i) AS whisker_hi, count(*) FILTER (NOT i) AS n_outliers
FROM (SELECT *, ecd_nm BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS i FROM fx_measurements JOIN q USING (label)) GROUP BY 1, 2, 3, 4""",
       M, {6: "q25 median q75 whisker_lo whisker_hi"})
def _(t):
    return D.box_stats(t.measurements(), "label", "ecd_nm")


@query("bar_mean_sd", "SELECT label, avg(ecd_nm) AS mean, stddev_samp(ecd_nm) AS std, count(ecd_nm) AS n FROM fx_measurements GROUP BY 1", M, {6: "mean std"})
def _(t):
    return D.bar_mean_sd(t.measurements(), "label", "ecd_nm")


@query("fit_lognormal", """SELECT label, count(*) AS n, avg(ln(ecd_nm)) AS mu, stddev_pop(ln(ecd_nm)) AS sigma, exp(avg(ln(ecd_nm)) + var_pop(ln(ecd_nm)) / 2) AS mean_nm2,
  exp(avg(ln(ecd_nm))) AS median_nm2, exp(avg(ln(ecd_nm)) - var_pop(ln(ecd_nm))) AS mode_nm2 FROM fx_measurements GROUP BY 1 HAVING count(*) >= 3""",
       M, {6: "mu sigma mean_nm2 median_nm2 mode_nm2"})
def _(t):
    return D.fit_lognormal(t.measurements(), "ecd_nm", ["label"]).drop("ks_statistic", "ks_pvalue")


@query("fit_normal", f"""WITH m AS (SELECT label, count(*) AS n, avg(ecd_nm) AS mean, stddev_pop(ecd_nm) AS std FROM fx_measurements GROUP BY 1 HAVING count(*) >= 3),
terms AS (SELECT k, (SELECT coalesce(sum(ln(2 * j + 1.0::DOUBLE)), 0) FROM range(0, 81) u(j) WHERE j <= k) AS d FROM range(0, 81) s(k)),
e AS (SELECT DISTINCT label, ecd_nm, n, mean, std, (ecd_nm - mean) / std AS z, count(*) OVER (PARTITION BY label ORDER BY ecd_nm) / n AS hi,
  (rank() OVER (PARTITION BY label ORDER BY ecd_nm) - 1) / n AS lo FROM fx_measurements JOIN m USING (label)),
c AS (SELECT label, ecd_nm, n, mean, std, lo, hi, 0.5 + sign(z) / sqrt(2 * {PI}) * exp(-z * z / 2) * sum(exp((2 * k + 1) * ln(abs(z) + 1e-300) - d)) AS cdf
  FROM e, terms GROUP BY label, ecd_nm, n, mean, std, lo, hi, z)
SELECT label, n, mean, std, max(greatest(hi - cdf, cdf - lo)) AS ks_statistic FROM c GROUP BY 1, 2, 3, 4""",
       M, {6: "mean std ks_statistic"})
def _(t):
    return D.fit_normal(t.measurements(), "ecd_nm", ["label"]).drop("ks_pvalue")


@query("kde_1d", f"""WITH s AS (SELECT min(feret_nm) AS lo, (max(feret_nm) - min(feret_nm)) / 399 AS step FROM fx_measurements),
h AS (SELECT label, count(*) AS n, stddev_samp(feret_nm) * pow(count(*), -0.2) AS h FROM fx_measurements GROUP BY 1)
SELECT label, CAST(i AS INT) AS i, lo + i * step AS x, sum(exp(-((lo + i * step - feret_nm) / h) * ((lo + i * step - feret_nm) / h) / 2) / (h * n * sqrt(2 * {PI}))) AS density
FROM fx_measurements JOIN h USING (label), s, range(0, 400) g(i) GROUP BY label, i, lo, step""", M, {8: "x density"})
def _(t):
    return D.kde_1d(t.measurements(), "label", "feret_nm", 400)


@query("correlate", """WITH r AS (SELECT ecd_nm, feret_nm, rank() OVER (ORDER BY ecd_nm) + (count(*) OVER (PARTITION BY ecd_nm) - 1) / 2 AS rx,
  rank() OVER (ORDER BY feret_nm) + (count(*) OVER (PARTITION BY feret_nm) - 1) / 2 AS ry FROM fx_measurements)
SELECT count(*) AS n, corr(ecd_nm, feret_nm) AS pearson_r, corr(rx, ry) AS spearman_rho,
CASE WHEN abs(corr(ecd_nm, feret_nm)) > 0.7 THEN 'strong' WHEN abs(corr(ecd_nm, feret_nm)) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM r""",
       M, {8: "pearson_r spearman_rho"})
def _(t):
    return D.correlate(t.measurements(), "ecd_nm", "feret_nm").drop("pearson_p", "spearman_p")


@query("nearest_point_lookup", """SELECT *, ((ecd_nm - 1000.3) / (SELECT max(ecd_nm) - min(ecd_nm) FROM fx_measurements)) ** 2 +
  ((feret_nm - 20.2) / (SELECT max(feret_nm) - min(feret_nm) FROM fx_measurements)) ** 2 AS distance FROM fx_measurements ORDER BY distance LIMIT 1""", M, {9: "distance"})
def _(t):
    return D.nearest_point_lookup(t.measurements(), "ecd_nm", "feret_nm", (1000.3, 20.2))


CONF = """cp AS (SELECT movie_id AS truth, CASE WHEN v > 0.05 THEN movie_id WHEN v > 0 THEN (movie_id + 1) % 10 ELSE 0 END AS predicted FROM fx_pixels),
cm AS (SELECT cls, count(*) FILTER (truth = cls AND predicted = cls) AS tp, count(*) FILTER (truth <> cls AND predicted = cls) AS fp,
  count(*) FILTER (truth = cls AND predicted <> cls) AS fn FROM cp, (SELECT DISTINCT movie_id AS cls FROM fx_pixels) GROUP BY 1)"""
RATES = "tp / (tp + fp + 1e-6::DOUBLE) AS precision, tp / (tp + fn + 1e-6::DOUBLE) AS recall, 2 * tp / (2 * tp + fp + fn + 1e-6::DOUBLE) AS f1, tp / (tp + fp + fn + 1e-6::DOUBLE) AS iou"


def confusion_pairs(t):
    m, v = F.col("movie_id"), F.col("v")
    return t.pixels().select(m.alias("truth"), F.when(v > 0.05, m).when(v > 0, (m + 1) % 10).otherwise(0).alias("predicted"))


@query("confusion_metrics", f"WITH {CONF} SELECT *, {RATES} FROM cm", ("fx_pixels",), {8: "precision recall f1 iou"})
def _(t):
    return D.confusion_metrics(confusion_pairs(t))


@query("foreground_means", f"WITH {CONF} SELECT avg(precision) AS mean_precision, avg(recall) AS mean_recall, avg(f1) AS mean_f1, avg(iou) AS mean_iou FROM (SELECT *, {RATES} FROM cm) WHERE cls > 0",
       ("fx_pixels",), {8: "mean_precision mean_recall mean_f1 mean_iou"})
def _(t):
    return D.foreground_means(D.confusion_metrics(confusion_pairs(t)))


@query("pixel_accuracy", f"WITH {CONF} SELECT 100.0::DOUBLE * avg(CASE WHEN truth = predicted THEN 1.0::DOUBLE ELSE 0 END) AS pixel_accuracy FROM cp", ("fx_pixels",), {8: "pixel_accuracy"})
def _(t):
    return D.pixel_accuracy(confusion_pairs(t))


@query("best_epoch", """WITH e AS (SELECT frame AS epoch, ascii(sequence_id) % 4 AS cls, avg(x_px) / 600 AS f1 FROM fx_detections GROUP BY 1, 2),
m AS (SELECT epoch, avg(f1) AS mean_f1 FROM e WHERE cls > 0 GROUP BY 1) SELECT e.epoch, cls, f1, mean_f1 FROM e JOIN (SELECT * FROM m ORDER BY mean_f1 DESC, epoch LIMIT 1) b ON e.epoch = b.epoch""",
       ("fx_detections",), {8: "f1 mean_f1"})
def _(t):
    metrics = t.detections().groupBy(F.col("frame").alias("epoch"), (F.ascii("sequence_id") % 4).alias("cls")).agg((F.avg("x_px") / 600).alias("f1"))
    return D.best_epoch(metrics)
