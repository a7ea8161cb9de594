"""Reproducible shuffle of training tiles into shards by a keyed permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesograph.llm.common import own_name, stored
from mesograph.session import shuffle_width

ROUNDS = 6


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(rows: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Feistel permutation of 0..count-1: six rounds on the smallest even number of bits that holds `count`, and walking on
    along the cycle while the value lies outside.  The domain is under four times `count`, so a walk takes few steps."""
    half = max(1, ((max(count, 2) - 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    with np.errstate(over="ignore"):
        keys = _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (1 << 64) - 1))
        out = rows.astype(np.uint64)
        open_ = np.arange(len(out))
        while len(open_):
            x = out[open_]
            left, right = x >> bits, x & mask
            for key in keys:
                left, right = right, left ^ (_mixed(right ^ key) & mask)
            x = (left << bits) | right
            out[open_] = x
            open_ = open_[x >= np.uint64(count)]
    return out.astype(np.int64)


def numbered(df: DataFrame, order: list[str], row: str) -> tuple[DataFrame, int]:
    """Add the global row number from 0 in ascending `order` (nulls first), and give the number of rows.

    Rows are range partitioned and sorted, and written once, so that a recomputed task can't number them otherwise; only one
    count per partition reaches the driver.  Rows that are equal in every `order` column are spread over ranges too.
    """
    (at,) = own_name(df, "_at")
    tie = F.monotonically_increasing_id()
    wide = df.withColumn(at, tie)
    keys = [*order, at]
    sorted_ = wide.repartitionByRange(shuffle_width(df.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = stored(sorted_.withColumn(at, F.monotonically_increasing_id()), "rows")
    part = F.shiftright(F.col(at), 33)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for number, count in counts:
        starts.append((number, total))
        total += count
    first = df.sparkSession.createDataFrame(starts, "_part long, _first long")
    # One row per partition, so the broadcast is bounded by the number of partitions.
    out = (placed.join(F.broadcast(first), part == F.col("_part"))
           .withColumn(row, F.col("_first") + F.col(at).bitwiseAND((1 << 33) - 1)).drop("_part", "_first", at))
    return out, total


def shard_tiles(tiles: DataFrame, shards: int = 16, tile_id: str = "tile_id", content: str = "image", seed: int = 20240501) -> DataFrame:
    """Shard and slot of every exported training tile (tile_id, image), the image as text or bytes; law `rows`.

    Tiles get global row numbers in ascending order of id (then of content checksum and size); the number goes through a
    Feistel permutation p with cycle walking, shard = p mod shards and slot = p div shards.  So shard sizes differ by one at
    most, slots have no gaps, and anybody who knows the row number, the count and the seed computes the place of a tile.
    Equal contents are ordinary rows of their own: copies spread over the shards like any other tiles.

    Adds size (bytes of the content plus 1; null content counts 0 bytes), content_crc32 (unsigned; of no bytes for null), shard
    and slot (long); other columns are not kept.  Null ids come first.  Repeated rows get a place each; no rows give no rows.
    """
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    narrow = tiles.select(F.col(tile_id), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("content_crc32"))
    rows, count = numbered(narrow, [tile_id, "content_crc32", "size"], "_row")

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permuted(row.to_numpy(), count, seed))

    return (rows.withColumn("_place", place("_row"))
            .select(tile_id, "size", "content_crc32", (F.col("_place") % shards).cast("int").alias("shard"),
                    F.floor(F.col("_place") / shards).cast("long").alias("slot")))
