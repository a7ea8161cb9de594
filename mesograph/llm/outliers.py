"""Robust multivariate outliers of measured rows, and word statistics of annotation texts; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mesograph.llm.common import BLANKS, discard, stored

# Up to so many groups the estimates are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
SUBSET = 0.75
STEPS = 5
SYMBOLS = "#*$%&|<>"


def chi_square_share(x: float, freedom: int) -> float:
    """Chi-square distribution function by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    k = freedom / 2
    term = total = 1 / k
    while term > 1e-15 * total:
        k += 1
        term *= x / 2 / k
        total += term
    return total * math.exp(-x / 2 + freedom / 2 * math.log(x / 2) - math.lgamma(freedom / 2))


def chi_square_quantile(share: float, freedom: int) -> float:
    """Inverse of `chi_square_share` by bisection."""
    low, high = 0.0, 10.0 + 10 * freedom
    while chi_square_share(high, freedom) < share:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_share(middle, freedom) < share else (low, middle)
    return (low + high) / 2


def _whitening(moments: DataFrame, names: Sequence[str], floors: Sequence[float]) -> DataFrame:
    """From count, sums and cross sums per group to the mean and the inverse of the Cholesky factor of the covariance.

    The square of each floor is added to the variance, so a metric that most rows share can't make the covariance singular.
    """
    p = len(names)
    out = moments.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(p)})
    out = out.withColumns({f"c{i}_{j}": F.col(f"q{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") for i in range(p) for j in range(i + 1)})
    for j in range(p):
        square = F.greatest(F.col(f"c{j}_{j}"), F.lit(0.0)) + floors[j] ** 2 - sum((F.col(f"l{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(square, F.lit(floors[j] ** 2 * 1e-6))))
        out = out.withColumns({f"l{i}_{j}": (F.col(f"c{i}_{j}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}_{j}")
                               for i in range(j + 1, p)}) if j + 1 < p else out
    for j in range(p):
        out = out.withColumn(f"w{j}_{j}", 1 / F.col(f"l{j}_{j}"))
        for i in range(j + 1, p):
            out = out.withColumn(f"w{i}_{j}", -sum((F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}_{i}"))
    volume = sum((F.log(f"l{i}_{i}") for i in range(p)), F.lit(0.0)).alias("volume")
    return out.select("group", *[f"m{i}" for i in range(p)], *[f"w{i}_{j}" for i in range(p) for j in range(i + 1)], volume)


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance of x0.. from the mean of the row's group."""
    return sum((sum((F.col(f"w{i}_{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) ** 2 for i in range(p)), F.lit(0.0))


def _with(rows: DataFrame, groups: DataFrame, count: int) -> DataFrame:
    return rows.join(F.broadcast(groups) if count <= BROADCAST_GROUPS else groups, "group")


def covariance_estimates(rows: DataFrame, p: int, floors: Sequence[float], least: int) -> tuple[DataFrame, int]:
    """Minimum-covariance-determinant estimate per group of rows (group, x0..): centre and whitening, with the
    factor that makes squared distances right for a normal distribution; and the number of groups.

    The first subset holds the three quarters of a group that lie nearest to its medians in units of its median deviations; then
    concentration steps take mean and covariance of the subset and the three quarters nearest to them, which never raises the
    determinant; the step of least determinant stands.  Quantiles are mergeable sketches of 1/10000 of the rows, so a group of any
    size is added up in parts; only one row per group and task is shuffled.
    """
    names = [f"x{i}" for i in range(p)]
    sketch = 10_000
    sized = rows.groupBy("group").agg(F.count(F.lit(1)).alias("size"), *[F.percentile_approx(c, 0.5, sketch).alias(f"m{i}") for i, c in enumerate(names)]).where(F.col("size") >= least)
    centres = stored(sized, "centres")
    count = centres.count()
    spread = _with(rows, centres, count).groupBy("group").agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"m{i}")), 0.5, sketch).alias(f"d{i}") for i, c in enumerate(names)])
    start = centres.join(spread, "group").select(
        "group", *[f"m{i}" for i in range(p)],
        *[(1 / F.greatest(1.4826 * F.col(f"d{i}"), F.lit(floors[i])) if i == j else F.lit(0.0)).alias(f"w{i}_{j}") for i in range(p) for j in range(i + 1)],
        F.lit(math.inf).alias("volume"))
    taken = [c for c in start.columns if c != "group"]
    work: list[str] = []
    estimate, best = stored(start, "estimate", work), None
    for _ in range(STEPS):
        measured = _with(rows, estimate, count).select("group", *names, _distance(p).alias("d"))
        cut = stored(measured.groupBy("group").agg(F.percentile_approx("d", SUBSET, sketch).alias("cut")), "cut", work)
        inner = _with(measured, cut, count).where(F.col("d") <= F.col("cut"))
        moments = inner.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(p)],
                                             *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i in range(p) for j in range(i + 1)])
        estimate = stored(_whitening(moments, names, floors), "estimate", work)
        best = estimate if best is None else best.unionByName(estimate)
    found = best.groupBy("group").agg(F.min_by(F.struct(*taken), "volume").alias("e")).select("group", "e.*")
    # The covariance of the inner three quarters of a normal distribution is smaller than the whole by this factor.
    scaled = stored(found.withColumn("scale", F.lit(chi_square_share(chi_square_quantile(SUBSET, p), p + 2) / SUBSET)), "scaled")
    discard(work)
    return scaled, count


def robust_distances(measurements: DataFrame, metrics: Mapping[str, float], groups: Sequence[str] = ("label", "image"), least: int = 50,
                     usable: Column | None = None, coarser: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Add `distance`, the robust squared Mahalanobis distance of each measurement within its group (by default label and image).

    `metrics` maps metric columns to their floors (see covariance_estimates); they should be transformed to be roughly symmetric
    before.  Groups of fewer than `least` usable rows take the estimate of the first of the `coarser` groupings, each a part of
    the one before, in which they share a group of at least that many; with none they get a null distance, as do rows with a null
    or NaN metric and rows that are not `usable`.  Null group values form groups of their own.  All columns stay; repeated rows
    count as often as they occur; an empty table stays empty.
    """
    fits = F.lit(True) if usable is None else F.coalesce(usable, F.lit(False))
    for name in metrics:
        fits = fits & F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))
    inner = [f"_{c}" for c in measurements.columns]
    keys = [F.to_json(F.struct(*level)) if level else F.lit("{}") for level in (groups, *coarser)]
    levels = ["group", *[f"group{k}" for k in range(1, len(keys))]]
    table = measurements.select(*[F.col(c).alias(n) for c, n in zip(measurements.columns, inner)], *[key.alias(n) for key, n in zip(keys, levels)],
                                *[F.when(fits, F.col(name).cast("double")).alias(f"x{i}") for i, name in enumerate(metrics)])
    xs = [f"x{i}" for i in range(len(metrics))]
    rows = table.where("x0 IS NOT NULL")
    estimates, count = covariance_estimates(rows.select("group", *xs), len(metrics), list(metrics.values()), least)
    if coarser:
        estimates, count = _with_coarser(rows, estimates, count, levels, xs, list(metrics.values()), least)
    near = F.broadcast(estimates) if count <= BROADCAST_GROUPS else estimates
    return table.join(near, "group", "left").select(*[F.col(n).alias(c) for c, n in zip(measurements.columns, inner) if c != "distance"],
                                                    (_distance(len(metrics)) * F.col("scale")).alias("distance"))


def _with_coarser(rows: DataFrame, estimates: DataFrame, count: int, levels: Sequence[str], xs: Sequence[str], floors: Sequence[float],
                  least: int) -> tuple[DataFrame, int]:
    """The estimates and, for every group of `rows` without one, that of the first coarser level which has one; and their number."""
    columns, work = estimates.columns, []
    lacking = stored(rows.select(*levels).distinct().join(estimates.select("group"), "group", "left_anti"), "lacking", work)
    for level in levels[1:]:
        if not (missing := lacking.count()):
            break
        wanted = lacking.select(level).distinct()
        part = rows.join(F.broadcast(wanted) if missing <= BROADCAST_GROUPS else wanted, level, "left_semi")
        pooled, _ = covariance_estimates(part.select(F.col(level).alias("group"), *xs), len(xs), floors, least)
        estimates = estimates.unionByName(lacking.join(pooled.withColumnRenamed("group", level), level).select(*columns))
        count += missing
        lacking = stored(lacking.join(pooled.select(F.col("group").alias(level)), level, "left_anti"), "lacking", work)
    estimates = stored(estimates, "estimates")
    discard(work)
    return estimates, count


def label_statistics(annotations: DataFrame, text: str = "label") -> DataFrame:
    """Word statistics of text annotations, added as columns (long); null texts have none of anything.

    n_words: runs of anything but space and \\t-\\r; word_chars: code points in them; n_symbols: characters of #*$%&|<>; n_dup_lines: lines
    with a word that equal an earlier line; n_repeat_words: words inside three-word windows that occur twice or more in the text.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = annotations.withColumns({
        "_words": F.filter(F.split(whole, BLANKS), lambda w: w != ""), "_lines": lines,
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long")})
    counted = bare.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_runs": F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(
            F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>"))})
    return counted.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), _covered("_runs")).otherwise(F.lit(0).cast("long"))).drop(
        "_words", "_lines", "_runs")


def _covered(runs: str) -> Column:
    """Words covered by the three-word runs whose hash occurs more than once: sorted by hash, equal ones stand side by side."""
    sorted_ = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Beside the neighbours in that order: a run is repeated if one of them has its hash.
    edge = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(-1).alias("i")))
    before = F.concat(edge, F.slice(sorted_, F.lit(1), F.size(runs) - 1))
    after = F.concat(F.slice(sorted_, F.lit(2), F.size(runs) - 1), edge)
    trio = F.arrays_zip(sorted_.alias("here"), before.alias("before"), after.alias("after"))
    starts = F.sort_array(F.transform(F.filter(trio, lambda t: t["here"]["h"].eqNullSafe(t["before"]["h"]) | t["here"]["h"].eqNullSafe(t["after"]["h"])), lambda t: t["here"]["i"]))
    return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")), lambda acc, s: F.struct(
        (s + 3).alias("end"), (acc["hit"] + (s + 3) - F.greatest(acc["end"], s)).alias("hit")))["hit"]


METRICS = {"_length": 0.1, "_letters": 0.02, "_symbols": 0.1, "_repeats": 0.1, "_lines_again": 0.3}


def judge_labels(annotations: DataFrame, ann_id: str = "ann_id", text: str = "label", groups: Sequence[str] = ("language", "image"),
                 share: float = 0.99999, least: int = 50) -> DataFrame:
    """Quality of text annotations (ann_id, label, language, image) by their word statistics.

    One row per input row: ann_id, the statistics of `label_statistics`, base_failed (fewer than 50 words, or over half of the words
    repeated), distance and kept.  Texts that pass the base rules are compared within their group by five transformed statistics
    (log of the words, log of the mean word length, square roots of symbols and of repeated words per word, log of repeated lines);
    a text is kept unless its robust squared distance exceeds the chi-square quantile of `share`.  Groups of fewer than `least` such
    texts are measured by the estimate of all texts that share their first group columns (the language over all images), then by
    that of all texts; only in tables with fewer than `least` such texts are all of these kept.  Null and empty texts have no words
    and fail the base.  Other columns are not used.
    """
    named = annotations.select(F.col(ann_id).alias("id"), F.col(text).alias("text"), *[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)])
    counted = label_statistics(named, "text").drop("text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    words = F.greatest("n_words", F.lit(1))
    stats = stored(counted.withColumns({
        "base_failed": failed, "_length": F.log(words), "_letters": F.log(F.greatest("word_chars", F.lit(1)) / words), "_symbols": F.sqrt(F.col("n_symbols") / words),
        "_repeats": F.sqrt(F.col("n_repeat_words") / words), "_lines_again": F.log(1 + F.col("n_dup_lines"))}), "statistics")
    names = [f"g{i}" for i in range(len(groups))]
    measured = robust_distances(stats, METRICS, names, least, usable=~F.col("base_failed"), coarser=[names[:k] for k in reversed(range(len(names)))])
    limit = chi_square_quantile(share, len(METRICS))
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > limit, F.lit(False))
    return measured.select(F.col("id").alias(ann_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
