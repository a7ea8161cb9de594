"""Order statistics that never sort one group in one task.

A window over a whole group (or over no group at all) puts every row of it into a single task.  The helpers here
collapse equal values first, cut the value axis into as many buckets as there are shuffle partitions, do the
ordered work inside (group, bucket), and add the totals of the earlier buckets, of which there are only a few
per group.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesograph.session import shuffle_width


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on identifying columns, which are never null."""
    return left.join(right, list(keys), how)


def join_sorted(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """The same with both sides shuffled: for joins in rounds, where a broadcast side would pile up in the driver round after round."""
    return join_on(left, right.hint("merge"), keys, how)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi join on `keys`, keeping the left copy of each key."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def usable(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def value_bounds(df: DataFrame, value: str, buckets: int) -> list[float]:
    """At most `buckets - 1` ascending cut points that spread the distinct values evenly."""
    if buckets < 2:
        return []
    cuts = [i / buckets for i in range(1, buckets)]
    row = df.select(F.col(value).cast("double").alias("v")).distinct().agg(
        F.percentile_approx("v", cuts, 10000).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def bucket_of(value: Column, bounds: Sequence[float]) -> Column:
    """Number of cut points at or below `value`, searched in two steps so that thousands of cuts stay cheap."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    blocks = [list(bounds[i:i + step]) for i in range(0, len(bounds), step)]
    head = F.size(F.filter(F.lit([b[0] for b in blocks]), lambda b: b <= value))
    inside = F.size(F.filter(F.element_at(F.lit(blocks), F.greatest(head, F.lit(1))), lambda b: b <= value))
    return F.when(head == 0, F.lit(0)).otherwise((head - 1) * step + inside)


def distinct_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, distinct value): `n` copies, `below` rows under it and `total` rows in the key."""
    keys = list(keys)
    counts = (df.where(usable(value)).select(*keys, F.col(value).cast("double").alias(value))
              .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    bounds = value_bounds(df.where(usable(value)), value, shuffle_width(df.sparkSession))
    counts = counts.withColumn("_b", bucket_of(F.col(value), bounds))
    inner = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = (counts.groupBy(*keys, "_b").agg(F.sum("n").alias("t"))
              .select(*keys, "_b", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("_off"),
                      F.sum("t").over(Window.partitionBy(*keys)).alias("total")))
    ranked = counts.withColumn("_in", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    return (join_null_safe(ranked, totals, [*keys, "_b"])
            .select(*keys, value, "n", (F.col("_in") + F.col("_off")).alias("below"), "total"))


def average_rank() -> Column:
    """Tie-averaged 1-based rank of a `distinct_ranks` row."""
    return F.col("below") + (F.col("n") + 1) / F.lit(2.0)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
              ranks: DataFrame | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per key, one column per entry of `probs`."""
    keys = list(keys)
    r = distinct_ranks(df, keys, value) if ranks is None else ranks

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("below") <= index) & (index < F.col("below") + F.col("n")), F.col(value)))

    aggs = [F.max("total").alias("_t")]
    for name, p in probs.items():
        pos = (F.col("total") - 1) * F.lit(float(p))
        aggs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}")]
    out = r.groupBy(*keys).agg(*aggs)
    cols = []
    for name, p in probs.items():
        pos = (F.col("_t") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*keys, *cols)


def hash_uniform(*parts: Column | str | int) -> Column:
    """A uniform number in [0, 1) that depends on the parts alone, so a recomputed task draws it again."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2 ** 52))


MD5_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
MD5_ADDED = [np.uint32(int(2 ** 32 * abs(math.sin(i + 1)))) for i in range(64)]
MD5_TAKEN = [i for i in range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_block(state: list[np.ndarray], words: list[np.ndarray]) -> list[np.ndarray]:
    """MD5 states after one more block of 16 words, of many texts at once."""
    a, b, c, d = (v.copy() for v in state)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a), np.add(a, words[MD5_TAKEN[i]] + MD5_ADDED[i], out=a)
        np.left_shift(a, np.uint32(MD5_TURNS[i]), out=turned), np.right_shift(a, np.uint32(32 - MD5_TURNS[i]), out=a)
        np.bitwise_or(a, turned, out=a), np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [v + w for v, w in zip(state, (a, b, c, d))]


def hash_uniforms(head: str, count: int, tails: Sequence[bytes], least: int = 0) -> np.ndarray:
    """`hash_uniform` of the texts `head`, a number from `least` to `count` - 1 and a tail of one length, all together: a row per tail, a column per number."""
    out = np.empty((len(tails), count - least))
    first = least
    while first < count:
        digits = len(str(first))
        numbers = np.arange(first, min(count, 10 ** digits))
        begin = len(head.encode())
        size = begin + digits + len(tails[0])
        blocks = (size + 8) // 64 + 1
        rest = b"\x80" + bytes(64 * blocks - size - 9) + (8 * size).to_bytes(8, "little")
        fixed = np.frombuffer(b"".join(head.encode() + bytes(digits) + t + rest for t in tails), "<u4").reshape(len(tails), 16 * blocks)
        varied: dict[int, np.ndarray] = {}
        for k in range(digits):
            at = begin + k
            digit = (48 + numbers // 10 ** (digits - 1 - k) % 10).astype(np.uint32) << np.uint32(8 * (at % 4))
            varied[at // 4] = varied.get(at // 4, np.uint32(0)) | digit
        step = max(1, 8192 // len(numbers))
        for i in range(0, len(tails), step):
            words = [fixed[i:i + step, w, None] | varied[w] if w in varied else fixed[i:i + step, w, None] for w in range(16 * blocks)]
            state = [np.full((len(fixed[i:i + step]), len(numbers)), v, np.uint32) for v in MD5_START]
            for b in range(blocks):
                state = _md5_block(state, words[16 * b:16 * b + 16])
            high, low = (v.byteswap().astype(np.int64) for v in state[:2])
            out[i:i + step, first - least:first - least + len(numbers)] = ((high << 20) | (low >> 12)) / float(2 ** 52)
        first += len(numbers)
    return out


def indexed_by_bucket(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column | str],
                      out: str) -> DataFrame:
    """0-based position within `keys`, ordered by (bucket, order); `bucket` must ascend with `order`."""
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = (df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_t"))
              .select(*keys, bucket, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off")))
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    placed = df.withColumn("_in", F.row_number().over(inner) - 1)
    return join_null_safe(placed, totals, [*keys, bucket]).withColumn(out, F.col("_in") + F.col("_off")).drop("_in", "_off")


def shuffled_index(df: DataFrame, keys: Sequence[str], uniform: Column, tiebreak: Sequence[str],
                   out: str = "idx") -> DataFrame:
    """0-based position within `keys` in the order of a uniform number."""
    width = 4 * shuffle_width(df.sparkSession)
    work = df.withColumn("_u", uniform).withColumn("_ub", F.floor(F.col("_u") * width))
    return indexed_by_bucket(work, keys, "_ub", ["_u", *tiebreak], out).drop("_u", "_ub")


def ordered_index(df: DataFrame, keys: Sequence[str], order: str, tiebreak: Sequence[str] = (),
                  out: str = "idx") -> DataFrame:
    """0-based position within `keys` in the order of a numeric column with few copies (an id)."""
    bounds = value_bounds(df, order, shuffle_width(df.sparkSession))
    work = df.withColumn("_vb", bucket_of(F.col(order).cast("double"), bounds))
    return indexed_by_bucket(work, keys, "_vb", [order, *tiebreak], out).drop("_vb")


def previous_row(df: DataFrame, keys: Sequence[str], bucket: str, order: str, fields: Mapping[str, str]) -> DataFrame:
    """Add, for each `fields` entry new -> old, the value of the row before in (bucket, order); null on the first."""
    keys = list(keys)
    inner = Window.partitionBy(*keys, bucket).orderBy(order)
    held = F.struct(*[F.col(old).alias(new) for new, old in fields.items()])
    edges = (df.groupBy(*keys, bucket).agg(F.max_by(held, F.col(order)).alias("_last"))
             .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(bucket)))
             .drop("_last"))
    out = join_null_safe(df.withColumn("_prev", F.lag(held).over(inner)), edges, [*keys, bucket])
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    return out.withColumn("_p", prev).select(*df.columns, *[F.col(f"_p.{new}").alias(new) for new in fields])


def running_sum(df: DataFrame, keys: Sequence[str], bucket: str, order: str, value: str, out: str) -> DataFrame:
    """Inclusive running sum within `keys` in (bucket, order)."""
    keys = list(keys)
    inner = Window.partitionBy(*keys, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = (df.groupBy(*keys, bucket).agg(F.sum(value).alias("_t"))
              .select(*keys, bucket, F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_off")))
    work = df.withColumn("_in", F.sum(value).over(inner))
    return join_null_safe(work, totals, [*keys, bucket]).withColumn(out, F.col("_in") + F.col("_off")).drop("_in", "_off")
