"""Connected components by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesograph.operators.ordering import join_on
from mesograph.session import cut_lineage


def contract_partitions(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace the links (keys, u, v) inside each partition by stars around the lowest node seen there."""
    keys = list(keys)

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if not frames:
            return
        link = pd.concat(frames, ignore_index=True)
        ends = pd.concat([link[[*keys, c]].rename(columns={c: "u"}) for c in ("u", "v")], ignore_index=True)
        nodes = ends.drop_duplicates().sort_values([*keys, "u"], ignore_index=True)
        code = ends.merge(nodes.assign(code=np.arange(len(nodes))), on=[*keys, "u"], how="left")["code"].to_numpy()
        a, b = code[:len(link)], code[len(link):]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            lower = label.copy()
            np.minimum.at(lower, label[a], low)
            np.minimum.at(lower, label[b], low)
            lower = lower[lower]
            if (lower == label).all():
                break
            label = lower
        out = nodes.assign(v=nodes["u"].to_numpy()[label])
        yield out[label != np.arange(len(nodes))][[*keys, "u", "v"]]

    return links.mapInPandas(contract, links.schema)


def connected_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), join: Callable[..., DataFrame] = join_on) -> DataFrame:
    """Label every node (keys, node) with the lowest node of its component; edges are (keys, src, dst).

    Links are first contracted where they lie, which settles most of them without a shuffle.  Every round then links each node to the lowest neighbour it can see, from both ends, until nothing changes.  The work
    tables are checkpointed to the shared folder, so a lost executor does not restart the iteration.  `join` may be `join_sorted`.
    """
    keys = list(keys)

    def pairs(high: str, low: str, df: DataFrame) -> DataFrame:
        return df.select(*keys, F.col(high).alias("u"), F.col(low).alias("v"))

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns))).first())

    high, low = F.greatest("src", "dst"), F.least("src", "dst")
    links = edges.where(F.col("src") != F.col("dst")).select(*keys, high.alias("u"), low.alias("v")).distinct()
    links = cut_lineage(contract_partitions(links, keys).distinct())
    before = state(links)
    while before[0]:
        around = links.unionByName(pairs("v", "u", links))
        lowest = around.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = join(around, lowest, [*keys, "u"]).where(F.col("v") > F.col("u")).select(
            *keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = join(large, floor, [*keys, "u"])
        moved = small.where(F.col("v") != F.col("m")).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut_lineage(moved.unionByName(floor.select(*keys, "u", F.col("m").alias("v"))).distinct())
        after = state(links)
        if after == before:
            break
        before = after
    roots = links.select(*keys, F.col("u").alias("node"), F.col("v").alias("component"))
    return join(nodes, roots, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))
