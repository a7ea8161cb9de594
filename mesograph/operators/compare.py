"""Tests between groups.

All data-sized work is counting: equal values are collapsed, ranks come from `distinct_ranks`, and only sums per
group or per pair of groups reach the formulas.  Tail probabilities are worked out on those few rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesograph.functions.labels import stars
from mesograph.functions.special import (chi2_upper, f_upper, normal_two_sided, rowwise, studentized_range_upper, t_two_sided)
from mesograph.operators.describe import describe_metric, group_summary_ci
from mesograph.operators.ordering import average_rank, bucket_of, distinct_ranks, join_null_safe, usable, value_bounds
from mesograph.session import shuffle_width

SHAPIRO_LIMIT = 5000


def group_moments(df: DataFrame, group: str, value: str, min_n: int = 1) -> DataFrame:
    return (df.where(usable(value) & F.col(group).isNotNull()).groupBy(F.col(group).alias("grp"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")).where(F.col("n") >= min_n))


def group_pairs(moments: DataFrame) -> DataFrame:
    """Unordered pairs of the summary rows of groups."""
    a = moments.select(F.lit(0).alias("_t"), *[F.col(c).alias(f"{c}_a") for c in moments.columns])
    b = moments.select(F.lit(0).alias("_t"), *[F.col(c).alias(f"{c}_b") for c in moments.columns])
    return (a.join(b, "_t").where(F.col("grp_a") < F.col("grp_b")).drop("_t")
            .withColumnsRenamed({"grp_a": "group_a", "grp_b": "group_b"}))


def _cohens_d() -> Column:
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = (F.col("var_a") * (na - 1) + F.col("var_b") * (nb - 1)) / F.nullif(na + nb - 2, F.lit(0))
    return F.when((na >= 2) & (nb >= 2), F.when(pooled > 0, F.abs(F.col("mean_a") - F.col("mean_b")) / F.sqrt(F.when(pooled > 0, pooled))).otherwise(F.lit(0.0)))


def cohens_d(df: DataFrame, group: str, value: str) -> DataFrame:
    return group_pairs(group_moments(df, group, value)).select("group_a", "group_b", _cohens_d().alias("effect_size"))


def welch_t(df: DataFrame, group: str, value: str, min_n: int = 2) -> DataFrame:
    """Unequal-variance t of each pair of groups."""
    ea, eb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    out = group_pairs(group_moments(df, group, value, min_n)).withColumns({
        "t_statistic": (F.col("mean_a") - F.col("mean_b")) / F.sqrt(F.nullif(ea + eb, F.lit(0.0))),
        "dof": (ea + eb) * (ea + eb) / F.nullif(ea * ea / (F.col("n_a") - 1) + eb * eb / (F.col("n_b") - 1), F.lit(0.0))})
    return out.withColumn("p_value", rowwise(t_two_sided, F.col("t_statistic"), F.col("dof"))).select(
        "group_a", "group_b", "t_statistic", "dof", "p_value")


def _exact_u_tail(u: float, n1: float, n2: float) -> float:
    """Two-sided tail of U without ties: the low coefficients of the Gaussian binomial, by one shifted difference and one strided sum
    per member of the smaller group, so the larger one may be large."""
    n1, n2 = int(min(n1, n2)), int(max(n1, n2))
    low = n1 * n2 - int(round(max(u, n1 * n2 - u)))
    ways = np.zeros(low + 1)
    ways[0] = 1.0
    for i in range(1, n1 + 1):
        if n2 + i <= low:
            ways[n2 + i:] -= ways[:low + 1 - n2 - i].copy()
        ways = np.pad(ways, (0, -len(ways) % i)).reshape(-1, i).cumsum(axis=0).ravel()[:low + 1]
    return float(min(1.0, 2.0 * ways.sum() / math.comb(n1 + n2, n1)))


def _u_tail(u: float, n1: float, n2: float, ties: float) -> float:
    if min(n1, n2) <= 8 and ties == 0:
        return _exact_u_tail(u, n1, n2)
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1))))
    if sd == 0:
        return 1.0
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sd
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


def mann_whitney(df: DataFrame, group: str, value: str, min_n: int = 1) -> DataFrame:
    """U of the first group, tie term and two-sided p for each pair of groups.

    Every distinct (group, value) count is sent to the pairs its group is part of, and the pairs are ranked together.
    """
    clean = df.where(usable(value) & F.col(group).isNotNull()).select(F.col(group).alias("grp"), F.col(value).cast("double").alias("v"))
    sizes = group_moments(df, group, value, min_n).select("grp", "n")
    pairs = group_pairs(sizes)
    member = (pairs.select("group_a", "group_b", F.col("group_a").alias("grp"), F.lit(True).alias("first"))
              .unionByName(pairs.select("group_a", "group_b", F.col("group_b").alias("grp"), F.lit(False).alias("first"))))
    counts = clean.groupBy("grp", "v").agg(F.count(F.lit(1)).alias("c")).join(member, "grp")
    ranks = _weighted_ranks(counts, ["group_a", "group_b"])
    n1, n2 = F.col("n_a"), F.col("n_b")
    out = ranks.groupBy("group_a", "group_b").agg(
        F.sum(F.col("c_first") * average_rank()).alias("_r"), F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    out = out.join(pairs, ["group_a", "group_b"]).withColumn("u_statistic", F.col("_r") - n1 * (n1 + 1) / 2.0)
    kind = F.when((F.least(n1, n2) <= 8) & (F.col("ties") == 0), "exact").otherwise("asymptotic")
    return (out.withColumns({"p_value": rowwise(_u_tail, F.col("u_statistic"), n1, n2, F.col("ties")), "p_kind": kind})
            .select("group_a", "group_b", "n_a", "n_b", "u_statistic", "ties", "p_value", "p_kind"))


def _weighted_ranks(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranks of values counted as `c`, with the part of the count that belongs to the first group."""

    keys = list(keys)
    pooled = counts.groupBy(*keys, "v").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("first"), F.col("c"))), F.lit(0)).alias("c_first"))
    pooled = pooled.withColumn("_b", bucket_of(F.col("v"), value_bounds(counts, "v", shuffle_width(counts.sparkSession))))
    inner = Window.partitionBy(*keys, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = pooled.groupBy(*keys, "_b").agg(F.sum("n").alias("_t")).select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    return join_null_safe(pooled.withColumn("_in", F.coalesce(F.sum("n").over(inner), F.lit(0))), totals, [*keys, "_b"]).withColumn(
        "below", F.col("_in") + F.col("_off"))


def bonferroni_pairs(df: DataFrame, group: str, value: str, min_n: int = 3) -> DataFrame:
    """Rank test of each pair with p times the number of pairs; that follows from the number of groups."""
    pairs = mann_whitney(df, group, value, min_n)
    groups = group_moments(df, group, value, min_n).agg(F.count(F.lit(1)).alias("_g")).withColumn("_t", F.lit(0))  # one row
    total = F.col("_g") * (F.col("_g") - 1) / 2
    out = pairs.withColumn("_t", F.lit(0)).join(F.broadcast(groups), "_t").withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p_value") * total))
    return out.withColumn("significance", stars(F.col("p_bonferroni"))).select("group_a", "group_b", "u_statistic", "p_bonferroni", "significance")


def anova_oneway(df: DataFrame, group: str, value: str, min_n: int = 1) -> DataFrame:
    m = group_moments(df, group, value, min_n).withColumn("_t", F.lit(0))
    n, mean = F.col("n"), F.col("mean")
    # One row; the squares are taken around it, so a large common mean cancels nothing.
    grand = m.groupBy("_t").agg((F.sum(n * mean) / F.sum("n")).alias("grand"))
    total = m.join(F.broadcast(grand), "_t").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.sum(n * (mean - F.col("grand")) * (mean - F.col("grand"))).alias("between"),
                                                 F.sum(F.coalesce("var", F.lit(0.0)) * (n - 1)).alias("within"))
    between = F.col("between")
    out = total.withColumns({"df_between": F.col("k") - 1, "df_within": F.col("total") - F.col("k")})
    out = out.withColumn("f_statistic", (between / F.col("df_between")) / F.nullif(F.col("within") / F.col("df_within"), F.lit(0.0)))
    return out.withColumn("p_value", rowwise(f_upper, F.col("f_statistic"), F.col("df_between"), F.col("df_within"))).select(
        "k", "total", "df_between", "df_within", "f_statistic", "p_value")


def tukey_hsd(df: DataFrame, group: str, value: str, min_n: int = 2) -> DataFrame:
    """Studentised range of each pair on the pooled variance."""
    m = group_moments(df, group, value, min_n)
    pooled = m.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("_n"), F.sum(F.col("var") * (F.col("n") - 1)).alias("_ss")).withColumn("_t", F.lit(0))
    dof = F.col("_n") - F.col("k")
    out = group_pairs(m).withColumn("_t", F.lit(0)).join(pooled, "_t").withColumn("dof", dof)
    se = F.sqrt(F.col("_ss") / F.col("dof") / 2.0 * (1.0 / F.col("n_a") + 1.0 / F.col("n_b")))
    out = out.withColumn("q_statistic", F.abs(F.col("mean_a") - F.col("mean_b")) / F.nullif(se, F.lit(0.0)))
    p = rowwise(lambda q, k, d: studentized_range_upper(q, int(k), d), F.col("q_statistic"), F.col("k"), F.col("dof"))
    return out.withColumn("p_value", p).withColumn("significance", stars(F.col("p_value"))).select(
        "group_a", "group_b", "q_statistic", "dof", "p_value", "significance")


def rank_sums(df: DataFrame, group: str, value: str, min_n: int = 1) -> DataFrame:
    """Pooled rank sum of each group, with the pooled size and tie term on every row."""
    clean = df.where(usable(value) & F.col(group).isNotNull()).select(F.col(group).alias("grp"), F.col(value).cast("double").alias("v"))
    kept = clean.join(group_moments(df, group, value, min_n).select("grp"), "grp", "left_semi")
    ranks = distinct_ranks(kept, [], "v")
    ties = ranks.agg(F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"), F.max("total").alias("total"))
    per_group = kept.groupBy("grp", "v").agg(F.count(F.lit(1)).alias("c")).join(ranks.select("v", average_rank().alias("rank")), "v")
    sums = per_group.groupBy("grp").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("rank_sum"))
    return sums.withColumn("_t", F.lit(0)).join(ties.withColumn("_t", F.lit(0)), "_t").drop("_t")


def kruskal_wallis(df: DataFrame, group: str, value: str, min_n: int = 1) -> DataFrame:
    """H with tie correction and the eta-squared effect size."""
    r = rank_sums(df, group, value, min_n)
    n = F.col("total").cast("double")
    out = r.groupBy("total", "ties").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("_q"))
    raw = 12.0 / (n * (n + 1)) * F.col("_q") - 3.0 * (n + 1)
    h = raw / F.nullif(1.0 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    out = out.withColumn("h_statistic", h)
    eta = F.greatest(F.lit(0.0), (F.col("h_statistic") - F.col("k") + 1) / F.greatest(n - F.col("k"), F.lit(1.0)))
    return out.withColumns({"eta_squared": eta, "p_value": rowwise(chi2_upper, F.col("h_statistic"), F.col("k") - 1)}).select(
        "k", "total", "h_statistic", "eta_squared", "p_value")


def dunn_test(df: DataFrame, group: str, value: str, min_n: int = 2) -> DataFrame:
    """z of the mean rank difference of each pair on the tie-corrected variance."""
    r = rank_sums(df, group, value, min_n)
    n = F.col("total_a").cast("double")
    variance = (n * (n + 1) / 12.0 - F.col("ties_a") / F.greatest(12.0 * (n - 1), F.lit(1e-12))) * (1.0 / F.col("n_a") + 1.0 / F.col("n_b"))
    gap = F.abs(F.col("rank_sum_a") / F.col("n_a") - F.col("rank_sum_b") / F.col("n_b"))
    out = group_pairs(r).withColumn("z_statistic", F.when(variance > 0, gap / F.sqrt(F.when(variance > 0, variance))).otherwise(F.lit(0.0)))
    return out.withColumn("p_raw", normal_two_sided(F.col("z_statistic"))).select("group_a", "group_b", "z_statistic", "p_raw")


def bh_fdr(pairs: DataFrame, p: str = "p_raw", keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg step-up over the rows of a table of tests."""
    keys = list(keys)
    # Equal p share a value, so distinct ones suffice: rank them in buckets, take the lowest scaled p from there on inside the bucket,
    # and from the later buckets, of which there are few per key.
    ranks = distinct_ranks(pairs, keys, p).withColumn("_s", F.col(p) * F.col("total") / (F.col("below") + F.col("n")))
    ranks = ranks.withColumn("_b", bucket_of(F.col(p), value_bounds(pairs, p, shuffle_width(pairs.sparkSession))))
    inner = Window.partitionBy(*keys, "_b").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    later = ranks.groupBy(*keys, "_b").agg(F.min("_s").alias("_m")).select(*keys, "_b", F.min("_m").over(after).alias("_later"))
    best = join_null_safe(ranks.withColumn("_in", F.min("_s").over(inner)), later, [*keys, "_b"]).select(
        *keys, p, F.least(F.lit(1.0), F.col("_in"), F.coalesce("_later", F.lit(1.0))).alias("p_fdr"))
    out = join_null_safe(pairs.withColumn(p, F.col(p).cast("double")), best, [*keys, p], "left").select(*pairs.columns, "p_fdr")
    return out.withColumn("significant", F.col("p_fdr") <= alpha)


# The multipliers of the 64-bit finaliser that spreads a number over all bits (Steele, Lea and Flood, 2014).
SPREAD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
FINE_BUCKETS = 64
DRAWS_TOGETHER = 64


def permutation_draws(base: np.ndarray, perms: np.ndarray) -> np.ndarray:
    """Uniform 64-bit numbers of each row (by a number of its id) in each permutation."""
    z = base[:, None] + (perms[None, :].astype(np.uint64) + np.uint64(1)) * np.uint64(SPREAD[0])
    z = (z ^ (z >> np.uint64(30))) * np.uint64(SPREAD[1])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SPREAD[2])
    return z ^ (z >> np.uint64(31))


def permutation_test(df: DataFrame, group: str, value: str, id_col: str, a: str, b: str, n_perm: int = 10000, seed: int = 0) -> DataFrame:
    """Share of random relabellings whose mean difference is at least the observed one, (c + 1) / (n + 1).

    A relabelling gives the rows of the n_a lowest draws to the first group; a row's draw depends on its id alone.  A first pass counts and
    adds up, per relabelling, the values below, in and above 64 narrow buckets around the draw where the n_a-th row is to be expected; only rows of
    the bucket that has it, about a tenth of the root of the rows, are moved and ranked in a second pass.  The driver holds three numbers per relabelling.
    """
    two = df.where(F.col(group).isin(a, b) & usable(value)).select(F.col(id_col).alias("id"), F.col(group).alias("grp"), F.col(value).cast("double").alias("v"))
    seen = two.agg(F.count_if(F.col("grp") == a).alias("n_a"), F.count_if(F.col("grp") == b).alias("n_b"), F.sum("v").alias("s"),
                   F.avg(F.when(F.col("grp") == a, F.col("v"))).alias("m_a"), F.avg(F.when(F.col("grp") == b, F.col("v"))).alias("m_b")).first()
    n_a, n_b = seen["n_a"], seen["n_b"]
    if not n_a or not n_b:
        raise ValueError("a permutation test needs values in both groups")
    observed, share = abs(seen["m_a"] - seen["m_b"]), n_a / (n_a + n_b)
    reach = 6 * math.sqrt(share * (1 - share) / (n_a + n_b))
    low, high = max(0.0, share - reach), min(1.0, share + reach)
    base = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))), 1, 13), 16, 10).cast("bigint")
    rows = two.select(base.alias("base"), "v")

    def draws(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For some rows and relabellings: relabelling, row, draw and bucket, the first and last bucket being all that lies outside."""
        number, v = batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy()
        for first in range(0, len(v), 20_000):
            part = number[first:first + 20_000]
            for start in range(0, n_perm, DRAWS_TOGETHER):
                perms = np.arange(start, min(start + DRAWS_TOGETHER, n_perm))
                z = permutation_draws(part, perms)
                place = np.floor((z.astype(np.float64) * 2.0 ** -64 - low) * (FINE_BUCKETS / (high - low))).clip(-1, FINE_BUCKETS).astype(np.int64) + 1
                yield perms, v[first:first + 20_000], z, place

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = FINE_BUCKETS + 2
        n, s = np.zeros(n_perm * width, np.int64), np.zeros(n_perm * width)
        for batch in batches:
            for perms, v, _, place in draws(batch):
                at = ((perms - perms[0])[None, :] * width + place).ravel()
                span = slice(perms[0] * width, (perms[-1] + 1) * width)
                n[span] += np.bincount(at, minlength=len(perms) * width)
                s[span] += np.bincount(at, np.repeat(v, len(perms)), minlength=len(perms) * width)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met // width), pa.array(met % width), pa.array(n[met]), pa.array(s[met])], ["perm", "bucket", "n", "s"])

    counted = rows.mapInArrow(count, "perm bigint, bucket bigint, n bigint, s double").groupBy("perm", "bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    before = Window.partitionBy("perm").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    running = counted.withColumns({"_n": F.coalesce(F.sum("n").over(before), F.lit(0)), "_s": F.coalesce(F.sum("s").over(before), F.lit(0.0))})
    edge = running.where((F.col("_n") < n_a) & (F.col("_n") + F.col("n") >= n_a)).select("perm", "bucket", (n_a - F.col("_n")).alias("need"), F.col("_s").alias("below")).toPandas().sort_values("perm")
    chosen = edge["bucket"].to_numpy()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for perms, v, z, place in draws(batch):
                row, col = np.nonzero(place == chosen[perms][None, :])
                order = (z[row, col] ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(perms[col]), pa.array(order), pa.array(v[row])], ["perm", "z", "v"])

    limits = df.sparkSession.createDataFrame(edge[["perm", "need", "below"]])
    placed = rows.mapInArrow(pick, "perm bigint, z bigint, v double").withColumn("_k", F.row_number().over(Window.partitionBy("perm").orderBy("z", "v")))
    sums = placed.join(limits, "perm").where("_k <= need").groupBy("perm").agg((F.first("below") + F.sum("v")).alias("sa"))
    gap = F.abs(F.col("sa") / n_a - (F.lit(seen["s"]) - F.col("sa")) / n_b)
    hits = F.count_if(gap >= observed - 1e-9 * max(1.0, observed))
    return sums.agg(F.lit(observed).alias("observed"), hits.alias("n_extreme"), ((hits + 1) / F.lit(float(n_perm + 1))).alias("p_value"))


# ---- normality

def _omnibus_columns() -> dict[str, Column]:
    """D'Agostino's K squared from population skewness and excess kurtosis."""
    n, g1, g2 = F.col("n").cast("double"), F.col("skew"), F.col("kurt")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2.0 * (beta - 1)) - 1.0
    delta = 1.0 / F.sqrt(0.5 * F.log(w2))
    ratio = y / F.sqrt(2.0 / (w2 - 1))
    z1 = delta * F.log(ratio + F.sqrt(ratio * ratio + 1))
    mean_b2 = 3.0 * (n - 1) / (n + 1)
    var_b2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3.0 - mean_b2) / F.sqrt(var_b2)
    sqrt_b1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sqrt_b1 * (2.0 / sqrt_b1 + F.sqrt(1.0 + 4.0 / (sqrt_b1 * sqrt_b1)))
    denom = 1.0 + x * F.sqrt(2.0 / (a - 4.0))
    cube = F.signum(denom) * F.pow((1.0 - 2.0 / a) / F.abs(denom), F.lit(1.0 / 3.0))
    z2 = (1.0 - 2.0 / (9.0 * a) - cube) / F.sqrt(2.0 / (9.0 * a))
    return {"statistic": z1 * z1 + z2 * z2, "p_value": F.exp(-(z1 * z1 + z2 * z2) / 2.0)}


def omnibus_normality(df: DataFrame, group: str, value: str) -> DataFrame:
    flat = df.where(usable(value)).groupBy(F.col(group).alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt")).where(F.col("n") >= 8)
    return flat.withColumns(_omnibus_columns()).select("group", "n", "statistic", "p_value")


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and its p-value by Royston's 1995 approximation."""
    from statistics import NormalDist

    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3 or np.ptp(x) == 0:
        return float("nan"), float("nan")
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    if n == 3:
        weights = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        # Royston's polynomials for the outermost weights.
        outer = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0]
        second = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
        square = float(m @ m)
        unit = m / math.sqrt(square)
        u = 1.0 / math.sqrt(n)
        last = unit[-1] + np.polyval(outer, u)
        weights = m.copy()
        if n > 5:
            before = unit[-2] + np.polyval(second, u)
            phi = (square - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last ** 2 - 2 * before ** 2)
            weights /= math.sqrt(phi)
            weights[[0, 1, -2, -1]] = [-last, -before, before, last]
        else:
            phi = (square - 2 * m[-1] ** 2) / (1 - 2 * last ** 2)
            weights /= math.sqrt(phi)
            weights[[0, -1]] = [-last, last]
    w = min(1.0, float((weights @ x) ** 2 / np.sum((x - x.mean()) ** 2)))
    if n == 3:
        return w, max(0.0, min(1.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w >= 1.0:
        return w, 1.0
    # Royston's polynomials for mean and deviation of the transformed statistic.
    if n <= 11:
        gamma = 0.459 * n - 2.273
        y = -math.log(max(gamma - math.log(1.0 - w), 1e-300))
        mean = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, ln = math.log(1.0 - w), math.log(n)
        mean = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2.0))


def normality_test(df: DataFrame, group: str, value: str, limit: int = SHAPIRO_LIMIT, alpha: float = 0.05) -> DataFrame:
    """Shapiro-Wilk for groups of 3 to `limit` values, D'Agostino's K squared above; only small groups meet one task."""
    clean = df.where(usable(value) & F.col(group).isNotNull()).select(F.col(group).alias("group"), F.col(value).cast("double").alias("v"))
    sizes = clean.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    small = clean.join(sizes.where(F.col("n").between(3, limit)).select("group"), "group")
    kind = dict(clean.dtypes)["group"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(pdf["v"].to_numpy())
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "n": [len(pdf)], "test": ["shapiro_wilk"], "statistic": [w], "p_value": [p]})

    shapiro = small.groupBy("group").applyInPandas(one, f"group {kind}, n bigint, test string, statistic double, p_value double")
    large = omnibus_normality(clean, "group", "v").where(F.col("n") > limit).withColumn("test", F.lit("dagostino_pearson"))
    return shapiro.unionByName(large).withColumn("is_normal", F.col("p_value") > alpha)


# ---- whole comparisons

def compare_groups(df: DataFrame, group: str, value: str, include_flagged: bool = False, alpha: float = 0.05) -> dict[str, DataFrame | str]:
    """Rank tests between groups of at least two values: two groups get U, d and Welch's t, more get H, Dunn and FDR."""
    base = df if include_flagged or "flagged" not in df.columns else df.where(~F.col("flagged"))
    base = base.where(usable(value) & F.col(group).isNotNull())
    sizes = group_moments(base, group, value, 2)
    kept = base.join(sizes.select(F.col("grp").alias(group)), group, "left_semi")
    n_groups = sizes.count()
    result: dict[str, DataFrame | str] = {"group_stats": group_summary_ci(kept, group, value, alpha), "normality": normality_test(kept, group, value, SHAPIRO_LIMIT - 1)}
    if n_groups < 2:
        return {**result, "test_used": "none"}
    effect = cohens_d(kept, group, value)
    if n_groups == 2:
        u = mann_whitney(kept, group, value).select("group_a", "group_b", F.col("u_statistic").alias("statistic"), F.col("p_value").alias("p_raw"))
        pairwise = u.withColumns({"p_fdr": F.col("p_raw"), "significant": F.col("p_raw") < alpha}).join(effect, ["group_a", "group_b"])
        return {**result, "test_used": "mann_whitney", "pairwise": pairwise, "additional": welch_t(kept, group, value)}
    dunn = dunn_test(kept, group, value).withColumnRenamed("z_statistic", "statistic")
    return {**result, "test_used": "kruskal_wallis+dunn", "omnibus": kruskal_wallis(kept, group, value),
            "pairwise": bh_fdr(dunn, alpha=alpha).join(effect, ["group_a", "group_b"])}


def stats_summary(result: dict[str, DataFrame | str], group: str) -> DataFrame:
    """The tables of `compare_groups` as one long table with a `row_type`."""
    out = result["group_stats"].withColumnRenamed(group, "group").withColumn("row_type", F.lit("group_stats"))
    for kind in ("pairwise", "omnibus"):
        if kind in result:
            out = out.unionByName(result[kind].withColumn("row_type", F.lit(kind)), allowMissingColumns=True)
    return out


def run_statistics(df: DataFrame, group: str, value: str) -> dict[str, DataFrame | str | bool]:
    """Descriptive tables, normality and the test they call for, over groups of at least three values."""
    descriptive = describe_metric(df, group, value)
    names = [r["group"] for r in descriptive.select("group").limit(3).collect()]
    if not names:
        raise ValueError("statistics need at least three values per group")
    kept = df.join(descriptive.select(F.col("group").alias(group)), group, "left_semi")
    normality = normality_test(kept, group, value)
    all_normal = normality.where(~F.coalesce("is_normal", F.lit(False))).limit(1).count() == 0
    out: dict[str, DataFrame | str | bool] = {"descriptive": descriptive, "normality": normality, "all_normal": all_normal}
    if len(names) == 1:
        return {**out, "test": "none"}
    if len(names) == 2:
        test = welch_t if all_normal else mann_whitney
        return {**out, "test": "Welch t-test" if all_normal else "Mann-Whitney U", "comparison": test(kept, group, value)}
    comparison = anova_oneway(kept, group, value) if all_normal else kruskal_wallis(kept, group, value)
    out = {**out, "test": "One-way ANOVA" if all_normal else "Kruskal-Wallis", "comparison": comparison}
    if comparison.first()["p_value"] < 0.05:
        out["posthoc"] = tukey_hsd(kept, group, value) if all_normal else bonferroni_pairs(kept, group, value)
    return out
