"""Queries for tests between groups.  SQL checks the statistics; tails that SQL cannot compute are left out there."""

from pyspark.sql import functions as F

from mesograph.operators import compare as C
from mesograph.queries.registry import query

M = ("fx_measurements",)
G = "g AS (SELECT label AS grp, count(*) AS n, avg(ecd_nm) AS mean, var_samp(ecd_nm) AS var FROM fx_measurements GROUP BY 1)"
RANKS = """r AS (SELECT label AS grp, rank() OVER (ORDER BY ecd_nm) + (count(*) OVER (PARTITION BY ecd_nm) - 1) / 2 AS rk, ecd_nm FROM fx_measurements),
ties AS (SELECT sum(c * c * c - c)::DOUBLE AS ties, sum(c)::BIGINT AS total FROM (SELECT count(*)::DOUBLE AS c FROM fx_measurements GROUP BY ecd_nm)),
s AS (SELECT grp, count(*) AS n, sum(rk) AS rank_sum, (SELECT ties FROM ties) AS ties, (SELECT total FROM ties) AS total FROM r GROUP BY 1)"""


@query("welch_t", f"""WITH {G} SELECT a.grp AS group_a, b.grp AS group_b, (a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n) AS t_statistic,
  (a.var / a.n + b.var / b.n) ** 2 / ((a.var / a.n) ** 2 / (a.n - 1) + (b.var / b.n) ** 2 / (b.n - 1)) AS dof FROM g a JOIN g b ON a.grp < b.grp""", M, {6: "t_statistic dof"})
def _(t):
    return C.welch_t(t.measurements(), "label", "ecd_nm").drop("p_value")


@query("cohens_d", f"""WITH {G} SELECT a.grp AS group_a, b.grp AS group_b, abs(a.mean - b.mean) / sqrt((a.var * (a.n - 1) + b.var * (b.n - 1)) / (a.n + b.n - 2)) AS effect_size
FROM g a JOIN g b ON a.grp < b.grp""", M, {8: "effect_size"})
def _(t):
    return C.cohens_d(t.measurements(), "label", "ecd_nm")


PAIR_RANKS = """p AS (SELECT a.label AS group_a, b.label AS group_b FROM (SELECT DISTINCT label FROM fx_measurements) a JOIN (SELECT DISTINCT label FROM fx_measurements) b ON a.label < b.label),
v AS (SELECT group_a, group_b, label, ecd_nm FROM p JOIN fx_measurements m ON m.label IN (group_a, group_b)),
k AS (SELECT *, rank() OVER (PARTITION BY group_a, group_b ORDER BY ecd_nm) + (count(*) OVER (PARTITION BY group_a, group_b, ecd_nm) - 1) / 2 AS rk,
  count(*) OVER (PARTITION BY group_a, group_b, ecd_nm) AS c FROM v),
u AS (SELECT group_a, group_b, count(*) FILTER (label = group_a) AS n_a, count(*) FILTER (label = group_b) AS n_b, sum(rk) FILTER (label = group_a) AS ra, sum(c * c - 1)::DOUBLE AS ties
FROM k GROUP BY 1, 2)"""


@query("mann_whitney", f"""WITH {PAIR_RANKS} SELECT group_a, group_b, n_a, n_b, ra - n_a * (n_a + 1) / 2 AS u_statistic, ties FROM u""", M, {4: "u_statistic ties"})
def _(t):
    return C.mann_whitney(t.measurements(), "label", "ecd_nm").drop("p_value", "p_kind")


@query("bonferroni_pairs", f"""WITH {PAIR_RANKS} SELECT group_a, group_b, ra - n_a * (n_a + 1) / 2 AS u_statistic FROM u""", M, {4: "u_statistic"})
def _(t):
    return C.bonferroni_pairs(t.measurements(), "label", "ecd_nm").drop("p_bonferroni", "significance")


@query("anova_oneway", f"""WITH {G}, t AS (SELECT count(*) AS k, sum(n)::BIGINT AS total, sum(n * mean) AS s, sum(n * mean * mean) AS ss, sum(var * (n - 1)) AS w FROM g)
SELECT k, total, k - 1 AS df_between, total - k AS df_within, ((ss - s * s / total) / (k - 1)) / (w / (total - k)) AS f_statistic FROM t""", M, {6: "f_statistic"})
def _(t):
    return C.anova_oneway(t.measurements(), "label", "ecd_nm").drop("p_value")


@query("tukey_hsd", f"""WITH {G}, t AS (SELECT sum(n)::BIGINT - count(*) AS dof, sum(var * (n - 1)) / (sum(n) - count(*)) AS mse FROM g)
SELECT a.grp AS group_a, b.grp AS group_b, abs(a.mean - b.mean) / sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)) AS q_statistic, dof FROM g a JOIN g b ON a.grp < b.grp, t""", M, {6: "q_statistic"})
def _(t):
    return C.tukey_hsd(t.measurements(), "label", "ecd_nm").drop("p_value", "significance")


@query("kruskal_wallis", f"""WITH {RANKS}, h AS (SELECT count(*) AS k, max(total) AS total, (12.0 / (max(total)::DOUBLE * (max(total) + 1)) * sum(rank_sum * rank_sum / n) - 3 * (max(total) + 1))
  / (1 - max(ties) / (max(total)::DOUBLE ** 3 - max(total))) AS h_statistic FROM s)
SELECT k, total, h_statistic, greatest(0, (h_statistic - k + 1) / greatest(total - k, 1)) AS eta_squared FROM h""", M, {6: "h_statistic eta_squared"})
def _(t):
    return C.kruskal_wallis(t.measurements(), "label", "ecd_nm").drop("p_value")


@query("eta_squared", f"""WITH {RANKS}, h AS (SELECT count(*) AS k, max(total) AS total, (12.0 / (max(total)::DOUBLE * (max(total) + 1)) * sum(rank_sum * rank_sum / n) - 3 * (max(total) + 1))
  / (1 - max(ties) / (max(total)::DOUBLE ** 3 - max(total))) AS h FROM s) SELECT greatest(0, (h - k + 1) / greatest(total - k, 1)) AS eta_squared FROM h""", M, {6: "eta_squared"})
def _(t):
    return C.kruskal_wallis(t.measurements(), "label", "ecd_nm").select("eta_squared")


@query("dunn_test", f"""WITH {RANKS} SELECT a.grp AS group_a, b.grp AS group_b, abs(a.rank_sum / a.n - b.rank_sum / b.n) /
  sqrt((a.total::DOUBLE * (a.total + 1) / 12 - a.ties / (12.0 * (a.total - 1))) * (1.0 / a.n + 1.0 / b.n)) AS z_statistic FROM s a JOIN s b ON a.grp < b.grp""", M, {6: "z_statistic"})
def _(t):
    return C.dunn_test(t.measurements(), "label", "ecd_nm").drop("p_raw")


@query("bh_fdr", """WITH p AS (SELECT particle_id, 1 / (1 + ecd_nm * feret_nm / 1000.0::DOUBLE) AS p_raw FROM fx_measurements),
k AS (SELECT *, p_raw * count(*) OVER () / row_number() OVER (ORDER BY p_raw, particle_id) AS s FROM p)
SELECT particle_id, p_raw, least(1.0, min(s) OVER (ORDER BY p_raw DESC, particle_id DESC ROWS UNBOUNDED PRECEDING)) AS p_fdr,
  least(1.0, min(s) OVER (ORDER BY p_raw DESC, particle_id DESC ROWS UNBOUNDED PRECEDING)) <= 0.05 AS significant FROM k""", M, {8: "p_raw p_fdr"})
def _(t):
    p = 1 / (1 + F.col("ecd_nm") * F.col("feret_nm") / 1000.0)
    return C.bh_fdr(t.measurements().select("particle_id", p.alias("p_raw")))


def spread(x: str, factor: int) -> str:
    """x times a factor modulo 2^64."""
    return f"CAST((CAST({x} AS UHUGEINT) * {factor}) % 18446744073709551616 AS UBIGINT)"


def folded(x: str, bits: int) -> str:
    return f"xor({x}, {x} >> {bits})"


PERMS = 10_000


@query("permutation_test", f"""WITH two AS (SELECT ('0x' || substr(md5(concat_ws(':', 0, particle_id)), 1, 13))::BIGINT AS base, label, ecd_nm AS v FROM fx_measurements WHERE label IN ('Brand#1', 'Brand#2')),
o AS (SELECT count(*) FILTER (label = 'Brand#1') AS n_a, count(*) FILTER (label = 'Brand#2') AS n_b, sum(v) AS s, abs(avg(v) FILTER (label = 'Brand#1') - avg(v) FILTER (label = 'Brand#2')) AS observed FROM two),
p AS (SELECT perm, {spread("perm + 1", C.SPREAD[0])} AS step FROM range(0, {PERMS}) t(perm)),
z0 AS (SELECT perm, v, CAST((CAST(base AS UHUGEINT) + step) % 18446744073709551616 AS UBIGINT) AS z FROM two, p),
z1 AS (SELECT perm, v, {spread(folded("z", 30), C.SPREAD[1])} AS z FROM z0),
z2 AS (SELECT perm, v, {spread(folded("z", 27), C.SPREAD[2])} AS z FROM z1),
d AS (SELECT perm, v, row_number() OVER (PARTITION BY perm ORDER BY {folded("z", 31)}, v) - 1 AS idx FROM z2),
g AS (SELECT perm, sum(v) FILTER (idx < n_a) AS sa FROM d, o GROUP BY 1)
SELECT observed, count(*) FILTER (abs(sa / n_a - (s - sa) / n_b) >= observed - 1e-9 * greatest(1.0, observed)) AS n_extreme,
  (count(*) FILTER (abs(sa / n_a - (s - sa) / n_b) >= observed - 1e-9 * greatest(1.0, observed)) + 1) / {PERMS + 1} AS p_value FROM g, o GROUP BY observed""", M, {6: "observed p_value"})
def _(t):
    return C.permutation_test(t.measurements(), "label", "ecd_nm", "particle_id", "Brand#1", "Brand#2", PERMS)


@query("normality_test", """WITH m AS (SELECT label AS "group", count(*)::DOUBLE AS n, skewness_pop AS g1, kurt AS g2 FROM (
  SELECT label, count(*) AS n, avg((ecd_nm - mu) ** 3) / pow(avg((ecd_nm - mu) ** 2), 1.5) AS skewness_pop, avg((ecd_nm - mu) ** 4) / avg((ecd_nm - mu) ** 2) ** 2 - 3 AS kurt
  FROM fx_measurements JOIN (SELECT label, avg(ecd_nm) AS mu FROM fx_measurements GROUP BY 1) USING (label) GROUP BY 1) GROUP BY ALL),
c AS (SELECT label AS "group", count(*)::DOUBLE AS n FROM fx_measurements GROUP BY 1),
a AS (SELECT m."group", c.n, g1 * sqrt((c.n + 1) * (c.n + 3) / (6 * (c.n - 2))) AS y, 3 * (c.n * c.n + 27 * c.n - 70) * (c.n + 1) * (c.n + 3) / ((c.n - 2) * (c.n + 5) * (c.n + 7) * (c.n + 9)) AS beta,
  (g2 + 3 - 3 * (c.n - 1) / (c.n + 1)) / sqrt(24 * c.n * (c.n - 2) * (c.n - 3) / ((c.n + 1) ** 2 * (c.n + 3) * (c.n + 5))) AS x,
  6 * (c.n * c.n - 5 * c.n + 2) / ((c.n + 7) * (c.n + 9)) * sqrt(6 * (c.n + 3) * (c.n + 5) / (c.n * (c.n - 2) * (c.n - 3))) AS b1 FROM m JOIN c ON m."group" = c."group"),
b AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS k FROM a),
z AS (SELECT "group", n, 1 / sqrt(0.5 * ln(w2)) * ln(y / sqrt(2 / (w2 - 1)) + sqrt(y * y / (2 / (w2 - 1)) + 1)) AS z1,
  (1 - 2 / (9 * k) - sign(1 + x * sqrt(2 / (k - 4))) * pow((1 - 2 / k) / abs(1 + x * sqrt(2 / (k - 4))), 1.0 / 3)) / sqrt(2 / (9 * k)) AS z2 FROM b)
SELECT "group", n::BIGINT AS n, z1 * z1 + z2 * z2 AS statistic, exp(-(z1 * z1 + z2 * z2) / 2) AS p_value FROM z""", M, {6: "statistic p_value"})
def _(t):
    """The large-sample branch for every group; the small-sample branch is `shapiro_wilk`."""
    return C.omnibus_normality(t.measurements(), "label", "ecd_nm")


@query("shapiro_wilk")
def _(t):
    return C.normality_test(t.measurements(), "label", "ecd_nm")


@query("compare_groups")
def _(t):
    return C.compare_groups(t.particles(), "label", "SA_nm2")["pairwise"]


@query("run_statistics")
def _(t):
    return C.run_statistics(t.measurements(), "label", "feret_nm")["comparison"]


@query("write_stats_summary_rows", """SELECT 'group_stats' AS row_type, label AS "group", count(*) AS n FROM fx_particles WHERE NOT flagged GROUP BY 2
UNION ALL SELECT 'pairwise', NULL, NULL FROM (SELECT DISTINCT label FROM fx_particles) a JOIN (SELECT DISTINCT label FROM fx_particles) b ON a.label < b.label
UNION ALL SELECT 'omnibus', NULL, NULL""", ("fx_particles",))
def _(t):
    return C.stats_summary(C.compare_groups(t.particles(), "label", "SA_nm2"), "label").select("row_type", "group", "n")


@query("condition_test", """WITH q AS (SELECT condition, pixel_size_nm * image_id AS r FROM fx_images),
r AS (SELECT condition, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2 AS rk FROM q),
s AS (SELECT condition, count(*) AS n, sum(rk) AS rs FROM r GROUP BY 1),
t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties, sum(c)::DOUBLE AS n FROM (SELECT count(*)::DOUBLE AS c FROM q GROUP BY r))
SELECT count(*) AS k, (12.0 / (max(t.n) * (max(t.n) + 1)) * sum(rs * rs / s.n) - 3 * (max(t.n) + 1)) / (1 - max(ties) / (max(t.n) ** 3 - max(t.n))) AS h_statistic FROM s, t""",
       ("fx_images",), {6: "h_statistic"})
def _(t):
    per_image = t.images().select("condition", (F.col("pixel_size_nm") * F.col("image_id")).alias("r"))
    return C.kruskal_wallis(per_image, "condition", "r").select("k", "h_statistic")
