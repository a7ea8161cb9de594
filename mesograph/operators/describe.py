"""Descriptive tables: group summaries, quantiles, histograms, reports, fits and correlations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesograph.functions.labels import is_trainable
from mesograph.functions.special import kolmogorov_upper, normal_cdf, rowwise, t_quantile, t_two_sided
from mesograph.operators.ordering import average_rank, distinct_ranks, join_null_safe, quantiles

METHODS = ["ellipsoid", "cauchy", "fourier", "fourier_spiky"]


def share(count: str) -> Column:
    return F.col(count) / F.sum(count).over(Window.partitionBy(F.lit(1)))


def describe_metric(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, sample deviation, quartiles and range of each group with at least three values."""
    ranks = distinct_ranks(df, [group], value)
    cuts = quantiles(df, [group], value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, ranks)
    flat = df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max")).where(F.col("n") >= 3)
    return (join_null_safe(flat, cuts, [group])
            .withColumn("iqr", F.round(F.col("q75") - F.col("q25"), 4))
            .select(F.col(group).alias("group"), "n", "mean", "std", "median", "iqr", "min", "max", "q25", "q75"))


def measurement_stats(df: DataFrame, label: str, metrics: Sequence[str]) -> DataFrame:
    """Mean, median, deviation and range per label and metric."""
    tall = df.unpivot([label], list(metrics), "metric", "value").where(F.col("value").isNotNull())
    middle = quantiles(tall, [label, "metric"], "value", {"median": 0.5})
    flat = tall.groupBy(label, "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return join_null_safe(flat, middle, [label, "metric"])


def group_summary_ci(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Group summary with standard error and t interval; a single value has a zero-width interval."""
    cuts = quantiles(df, [group], value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    flat = df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    out = join_null_safe(flat, cuts, [group]).withColumn("sem", F.col("std") / F.sqrt("n"))
    critical = rowwise(lambda n: t_quantile(1.0 - alpha / 2.0, n - 1) if n > 1 else 0.0, F.col("n"))
    half = F.col("_t") * F.col("sem")
    return (out.withColumn("_t", critical).withColumns({
        "iqr": F.col("q75") - F.col("q25"), "ci95_lo": F.col("mean") - half, "ci95_hi": F.col("mean") + half}).drop("_t"))


def summarize_column(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Row counts and statistics of the positive values, over everything or per key."""
    keys = list(keys)
    positive = F.when(F.col(value) > 0, F.col(value))
    flat = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.count(positive).alias("n_valid"), F.avg(positive).alias("mean"),
        F.stddev_samp(positive).alias("std"), F.min(positive).alias("min"), F.max(positive).alias("max"))
    flat = flat.withColumns({"sem": F.col("std") / F.sqrt("n_valid"),
                             "cv": F.when(F.col("mean") > 0, F.col("std") / F.nullif("mean", F.lit(0.0)))})
    cuts = quantiles(df.where(F.col(value) > 0), keys, value, {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    if keys:
        return join_null_safe(flat, cuts, keys, "left")
    return flat.withColumn("_one", F.lit(1)).join(cuts.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")


def value_report(df: DataFrame, column: str, empty: str | None = None) -> DataFrame:
    """Count and fraction of each value; null and blank become `empty` when given."""
    value = F.col(column) if empty is None else F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(empty))
    return df.groupBy(value.alias(column)).agg(F.count(F.lit(1)).alias("count")).withColumn("fraction", share("count"))


def method_breakdown(df: DataFrame, group: str) -> DataFrame:
    """Fraction of the rows of each group that used each of the four outline methods."""
    used = [F.avg(F.when(F.col("method_used") == m, 1.0).otherwise(0.0)).alias(m) for m in METHODS]
    return df.groupBy(group).agg(*used)


def hollow_report(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("is_hollow").alias("n_hollow"),
                  F.coalesce(F.avg(F.when(F.col("is_hollow"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("fraction_hollow"),
                  F.avg(F.when(F.col("is_hollow"), F.col("shell_thickness_estimate_nm"))).alias("mean_shell_thickness_nm"))


def specific_surface_area(df: DataFrame, sample_volume_nm3: float, include_flagged: bool = False) -> DataFrame:
    """Total surface per sample volume with the spread (population deviation) of the included particles."""
    grown = F.col("SA_nm2") > 0
    kept = grown if include_flagged else grown & ~F.col("flagged")
    sa = F.when(kept, F.col("SA_nm2"))
    usable = sample_volume_nm3 > 0
    totals = df.agg(F.count(F.lit(1)).alias("n_particles"), F.count(sa).alias("_n"),
                    (F.count_if(grown) - F.count(sa)).alias("n_excluded_flagged"), F.sum(sa).alias("_sum"),
                    F.avg(sa).alias("mean_sa_nm2"), F.stddev_pop(sa).alias("std_sa_nm2"))
    probs = {"p5": 0.05, "p10": 0.10, "p25": 0.25, "median_sa_nm2": 0.5, "p75": 0.75, "p90": 0.90, "p95": 0.95}
    cuts = quantiles(df.where(kept), [], "SA_nm2", probs)
    out = totals.withColumn("_one", F.lit(1)).join(cuts.withColumn("_one", F.lit(1)), "_one", "left")
    total = F.coalesce("_sum", F.lit(0.0)) if usable else F.lit(0.0)
    given = {c: F.col(c) if usable else F.lit(None).cast("double") for c in ("mean_sa_nm2", "std_sa_nm2", *probs)}
    return out.select((total / (sample_volume_nm3 if usable else 1.0)).alias("specific_sa_nm_inv"), total.alias("total_sa_nm2"),
                      "n_particles", (F.col("_n") if usable else F.lit(0)).alias("n_included"), "n_excluded_flagged",
                      *[c.alias(n) for n, c in given.items()])


def histogram(df: DataFrame, group: str, value: str, bins: int, density: bool = False) -> DataFrame:
    """Equal-width bins shared by all groups, the last one closed; a constant column falls into one bin."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, hi = span["lo"] or 0.0, span["hi"] or 0.0
    lo, hi = (lo, hi) if hi > lo else (lo - 0.5, hi + 0.5)
    width = (hi - lo) / bins
    index = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    out = df.where(F.col(value).isNotNull()).groupBy(group, index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    out = out.withColumns({"left": lo + F.col("bin") * width, "right": lo + (F.col("bin") + 1) * width})
    if density:
        out = out.withColumn("density", F.col("count") / (F.sum("count").over(Window.partitionBy(group)) * width))
    return out


def category_counts(annotations: DataFrame) -> DataFrame:
    """Annotations per category without background and ignore, most frequent first."""
    return (annotations.where(is_trainable(F.col("category"))).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "category"))


def average_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Tie-averaged rank of each distinct value within its key."""
    return distinct_ranks(df, keys, value).select(*keys, value, "n", average_rank().alias("rank"))


def ecdf_dkw(df: DataFrame, group: str, value: str, confidence: float = 0.95) -> DataFrame:
    """Step height at each distinct positive value with the Dvoretzky-Kiefer-Wolfowitz band."""
    steps = distinct_ranks(df.where(F.col(value) > 0), [group], value).where(F.col("total") >= 2)
    level = (F.col("below") + F.col("n")) / F.col("total")
    eps = F.sqrt(F.lit(math.log(2.0 / (1.0 - confidence))) / (2.0 * F.col("total")))
    return steps.select(group, value, level.alias("ecdf"), F.greatest(level - eps, F.lit(0.0)).alias("lo"), F.least(level + eps, F.lit(1.0)).alias("hi"))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, the farthest values within 1.5 IQR and the number of values beyond."""
    ranks = distinct_ranks(df, [group], value)
    cuts = quantiles(df, [group], value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, ranks)
    v = F.col(value)
    inside = v.between(F.col("q25") - 1.5 * (F.col("q75") - F.col("q25")), F.col("q75") + 1.5 * (F.col("q75") - F.col("q25")))
    return join_null_safe(ranks.select(group, value, "n"), cuts, [group]).groupBy(group, "q25", "median", "q75").agg(
        F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).cast("bigint").alias("n_outliers"))


def bar_mean_sd(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def _fit(df: DataFrame, value: str, keys: Sequence[str], log: bool) -> DataFrame:
    keys = list(keys)
    base = df.where(F.col(value) > 0) if log else df
    x = F.log(F.col(value)) if log else F.col(value)
    moments = base.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(x).alias("mu"), F.stddev_pop(x).alias("sigma")).where(F.col("n") >= 3)
    ranks = distinct_ranks(base, keys, value).withColumnRenamed("n", "_c")
    joined = (join_null_safe(ranks, moments, keys) if keys else
              ranks.withColumn("_one", F.lit(1)).join(moments.withColumn("_one", F.lit(1)), "_one").drop("_one"))
    model = normal_cdf((x - F.col("mu")) / F.nullif("sigma", F.lit(0.0)))
    gap = F.greatest((F.col("below") + F.col("_c")) / F.col("total") - model, model - F.col("below") / F.col("total"))
    out = joined.groupBy(*keys, "n", "mu", "sigma").agg(F.max(gap).alias("ks_statistic"))
    return out.withColumn("ks_pvalue", rowwise(kolmogorov_upper, F.col("ks_statistic"), F.col("n")))


def fit_lognormal(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Log-scale mean and population deviation, derived moments and the one-sample Kolmogorov distance."""
    mu, s2 = F.col("mu"), F.col("sigma") * F.col("sigma")
    return _fit(df, value, keys, True).withColumns({"mean_nm2": F.exp(mu + s2 / 2.0), "median_nm2": F.exp(mu), "mode_nm2": F.exp(mu - s2)})


def fit_normal(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return _fit(df, value, keys, False).withColumnsRenamed({"mu": "mean", "sigma": "std"})


def kde_1d(df: DataFrame, group: str, value: str, points: int = 300) -> DataFrame:
    """Gaussian density of each group on one grid over the pooled range; copies of a value are walked once."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, step = span["lo"] or 0.0, ((span["hi"] or 0.0) - (span["lo"] or 0.0)) / (points - 1)
    spread = df.groupBy(group).agg(F.count(value).alias("total"), F.stddev_samp(value).alias("sd")).where(
        (F.col("total") > 3) & (F.col("sd") > 1e-9))
    weights = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("w"))
    h = F.col("sd") * F.pow(F.col("total"), F.lit(-0.2))
    walked = join_null_safe(weights, spread.withColumn("h", h), [group]).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = lo + F.col("i") * step
    z = (x - F.col(value)) / F.col("h")
    return walked.groupBy(group, "i").agg(
        F.sum(F.col("w") * F.exp(-z * z / 2.0) / (F.col("h") * F.col("total") * math.sqrt(2.0 * math.pi))).alias("density")
    ).withColumn("x", x)


def correlate(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman coefficients with t-based p-values, from distinct pairs and their counts."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("w"))
    sub = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = distinct_ranks(sub, [], x).select(x, average_rank().alias("rx"))
    ry = distinct_ranks(sub, [], y).select(y, average_rank().alias("ry"))
    ranked = pairs.withColumns({x: F.col(x).cast("double"), y: F.col(y).cast("double")}).join(rx, x).join(ry, y)
    middle = ranked.agg(F.sum("w").alias("n"), *[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"m_{i}") for i, c in enumerate((x, y))]).first()
    n, mx, my = middle["n"] or 0, middle["m_0"] or 0.0, middle["m_1"] or 0.0
    if n < 3:
        raise ValueError("correlation needs at least three pairs")
    mid = (n + 1) / 2.0

    def moment(a: Column, b: Column) -> Column:
        return F.sum(F.col("w") * a * b)

    dx, dy, ex, ey = F.col(x) - mx, F.col(y) - my, F.col("rx") - mid, F.col("ry") - mid
    out = ranked.agg(F.sum("w").alias("n"), (moment(dx, dy) / F.sqrt(moment(dx, dx) * moment(dy, dy))).alias("pearson_r"),
                     (moment(ex, ey) / F.sqrt(moment(ex, ex) * moment(ey, ey))).alias("spearman_rho"))

    def p(r: float, size: float) -> float:
        return 0.0 if abs(r) >= 1.0 else t_two_sided(r * math.sqrt((size - 2) / (1.0 - r * r)), size - 2)

    strength = F.when(F.abs("pearson_r") > 0.7, "strong").when(F.abs("pearson_r") > 0.4, "moderate").otherwise("weak")
    return out.withColumns({"pearson_p": rowwise(p, F.col("pearson_r"), F.col("n")), "spearman_p": rowwise(p, F.col("spearman_rho"), F.col("n")),
                            "strength": strength})


def nearest_point_lookup(df: DataFrame, x: str, y: str, at: tuple[float, float], cutoff: float = 0.05) -> DataFrame:
    """The row nearest to a position after scaling both axes by their range, if it is near enough."""
    span = df.agg((F.max(x) - F.min(x)).alias("rx"), (F.max(y) - F.min(y)).alias("ry")).first()
    dx, dy = (F.col(x) - at[0]) / (span["rx"] or 1.0), (F.col(y) - at[1]) / (span["ry"] or 1.0)
    return df.withColumn("distance", dx * dx + dy * dy).orderBy("distance", *df.columns).limit(1).where(F.col("distance") < cutoff)


def confusion_metrics(pairs: DataFrame) -> DataFrame:
    """Per class precision, recall, F1 and IoU from (truth, predicted) rows, plus overall accuracy."""
    counts = pairs.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    both = counts.select(F.explode(F.array_distinct(F.array("truth", "predicted"))).alias("cls"), "truth", "predicted", "n")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    c, t, p = F.col("cls"), F.col("truth"), F.col("predicted")
    out = both.groupBy("cls").agg(total((t == c) & (p == c)).alias("tp"), total((t != c) & (p == c)).alias("fp"), total((t == c) & (p != c)).alias("fn"))
    eps = 1e-6
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": tp / (tp + fp + eps), "recall": tp / (tp + fn + eps),
                            "f1": 2 * tp / (2 * tp + fp + fn + eps), "iou": tp / (tp + fp + fn + eps)})


def pixel_accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg((100.0 * F.avg(F.when(F.col("truth") == F.col("predicted"), 1.0).otherwise(0.0))).alias("pixel_accuracy"))


def foreground_means(metrics: DataFrame) -> DataFrame:
    """Class means without class 0."""
    return metrics.where(F.col("cls") > 0).agg(*[F.avg(c).alias(f"mean_{c}") for c in ("precision", "recall", "f1", "iou")])


def best_epoch(metrics: DataFrame) -> DataFrame:
    """All class rows of the first epoch with the highest mean F1."""
    per_epoch = metrics.where(F.col("cls") > 0).groupBy("epoch").agg(F.avg("f1").alias("mean_f1"))
    best = per_epoch.orderBy(F.desc("mean_f1"), "epoch").limit(1)
    return metrics.join(best, "epoch")
