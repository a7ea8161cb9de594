"""Outlines of masks along pixel edges: rings in order, holes apart, so that a ring's area is its number of pixels.

Where a run has no pixel above it there is an edge to the right, where it has none below one to the left.  The ends of these edges, sorted
down each column, are pairwise the ends of the upright edges, which gives every edge its successor.  Rings are put in order by pointer
jumping: after k rounds an edge knows the lowest edge within 2^k steps and how far it is.

A mask moves as one row that holds its runs, and many are traced together as arrays; one whose box has more than WHOLE_PIXELS pixels is traced
by tables of edges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from mesograph.functions import geometry as G
from mesograph.operators.ordering import join_on
from mesograph.operators.spans import REGION, as_spans, bare_spans, packed_runs, unpacked_runs
from mesograph.session import cut_lineage

MIDDLE = 1 << 29
WHOLE_PIXELS = 1 << 22
PIXELS_TOGETHER = 1 << 22
VERTEX = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])


class Rasters:
    """Masks of about one size on rasters, one below another with a free line and column around each: pixel (y, x) of mask k is at [top[k] + y, x + 1 - left[k]]."""

    def __init__(self, mask: np.ndarray, y: np.ndarray, xa: np.ndarray, xb: np.ndarray, box: np.ndarray):
        y0, y1, x0, x1 = box
        self.left = x0
        heights = y1 - y0 + 3
        begin = np.cumsum(heights) - heights
        self.top = begin + 1 - y0
        self.owner = np.repeat(np.arange(len(y0)), heights)
        wide = int((x1 - x0).max(initial=0)) + 3
        marks = np.zeros((int(heights.sum()), wide + 1), np.int32)
        row = self.top[mask] + y
        np.add.at(marks, (row, xa - x0[mask] + 1), 1)
        np.add.at(marks, (row, xb - x0[mask] + 1), -1)
        self.on = np.cumsum(marks, axis=1)[:, :wide] > 0

    def pixels(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mask, y and x of each pixel that is set."""
        row, column = np.nonzero(self.on)
        mask = self.owner[row]
        return mask, row - self.top[mask], column - 1 + self.left[mask]

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Mask, line, row, x0 and x1 of the level edges, by mask, line, x0 and direction."""
        parts = []
        for step in (1, -1):
            bare = self.on & ~np.roll(self.on, step, axis=0)
            turn = np.diff(bare.ravel().astype(np.int8), prepend=0)  # the free columns keep runs of two lines apart
            (row, a), b = (np.divmod(np.flatnonzero(turn == sign), self.on.shape[1]) for sign in (1, -1))
            b = b[1]
            mask = self.owner[row]
            y, a, b = row - self.top[mask], a - 1 + self.left[mask], b - 1 + self.left[mask]
            parts.append((mask, y, y, a, b) if step == 1 else (mask, y + 1, y, b, a))
        mask, line, row, x0, x1 = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((x1 < x0, x0, line, mask))
        return mask[order], line[order], row[order], x0[order], x1[order]


def traced(rasters: Rasters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rings of many masks: mask, ring id and signed area of each, where its edges end, and x0 to x1 on which line for the edges, ring by ring."""
    mask, line, row, x0, x1 = rasters.edges()
    n = len(mask)
    edge, last = np.tile(np.arange(n), 2), np.repeat([False, True], n)
    # At a corner where two pixels touch, the upper pixel's edge comes first, which keeps the two apart.
    down = np.lexsort((row[edge], line[edge], np.r_[x0, x1], mask[edge]))
    pair, ends = edge[down].reshape(-1, 2), last[down].reshape(-1, 2)
    after = np.empty(n, np.int64)
    after[pair[ends]] = pair[~ends]
    jump, ring, steps = after.copy(), np.arange(n), np.zeros(n, np.int64)
    longest = int(np.bincount(mask).max(initial=1))
    for k in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        lower = ring[jump] < ring
        steps = np.where(lower, steps[jump] + (1 << k), steps)
        ring = np.minimum(ring, ring[jump])
        jump = jump[jump]
    order = np.lexsort((np.where(steps == 0, -n - 1, -steps), ring))
    firsts = np.flatnonzero(np.diff(ring[order], prepend=-1))
    area = np.add.reduceat((line * (x0 - x1))[order], firsts) if n else np.zeros(0, np.int64)
    lowest = order[firsts]
    name = (line[lowest] + MIDDLE) * (1 << 32) + (x0[lowest] + MIDDLE) * 2 + (x1[lowest] < x0[lowest])
    corners = np.stack([np.stack([x0[order], x1[order]], 1).ravel(), np.repeat(line[order], 2)]).astype(np.float64)
    return mask[lowest], name, area, np.r_[firsts[1:], n], corners[0], corners[1]


def traced_masks(masks: DataFrame, keys: Sequence[str], found: StructType, step: Callable, whole_pixels: int) -> tuple[DataFrame, DataFrame | None]:
    """What `step` tells of each mask of up to `whole_pixels` pixels of box (keys, found), and the runs of larger ones, if there are any.

    `step` is given the rasters of some masks and their runs (mask, y, xa, xb, box), and returns which mask each of its rows belongs to and the columns.
    """
    keys = list(keys)
    known = masks.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    packed = cut_lineage(packed_runs(known, keys))
    room = (F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1)
    schema = StructType([*[masks.schema[k] for k in keys], *found.fields])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            begin = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
            runs = lists.flatten().to_numpy().reshape(-1, 3)
            box = np.array([batch.column(len(keys) + 1 + i).to_numpy() for i in range(4)]).reshape(4, -1)
            size = (box[1] - box[0] + 3) * (box[3] - box[2] + 3)
            by_width = np.argsort(box[3] - box[2], kind="stable")
            for part in np.split(by_width, np.flatnonzero(np.diff(np.cumsum(size[by_width]) // PIXELS_TOGETHER)) + 1):
                if not len(part):
                    continue
                count = np.diff(begin)[part] // 3
                mask = np.repeat(np.arange(len(part)), count)
                at = np.arange(len(mask)) + np.repeat(begin[part] // 3 - np.cumsum(count) + count, count)
                y, xa, xb = runs[at].T
                own, columns = step(Rasters(mask, y, xa, xb, box[:, part]), mask, y, xa, xb, box[:, part])
                taken = pa.array(part[own])
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(taken) for i in range(len(keys))], *columns], schema.names)

    small = packed.where(room <= whole_pixels).select(*keys, "runs", "y0", "y1", "x0", "x1").mapInArrow(trace, schema)
    large = packed.where(room > whole_pixels)
    return small, None if large.isEmpty() else unpacked_runs(large, keys)


def edge_links(masks: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Level edges (keys, id, line, x0, x1) of masks, the mask to the right of the way from x0 to x1, with the id of the next edge around (next)."""
    keys = list(keys)
    own = as_spans(masks, keys).select(*keys, "y", "xa", "xb")
    tops = bare_spans(own, keys, 1).select(*keys, F.col("y").alias("line"), F.col("y").alias("row"), F.col("xa").alias("x0"), F.col("xb").alias("x1"))
    bottoms = bare_spans(own, keys, -1).select(*keys, (F.col("y") + 1).alias("line"), F.col("y").alias("row"), F.col("xb").alias("x0"), F.col("xa").alias("x1"))
    name = (F.col("line") + MIDDLE).cast("long") * (1 << 32) + (F.col("x0") + MIDDLE).cast("long") * 2 + (F.col("x1") < F.col("x0")).cast("int")
    edges = cut_lineage(tops.unionByName(bottoms).withColumn("id", name))
    ends = edges.select(*keys, "line", "row", "id", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(False).alias("last")), F.struct(F.col("x1").alias("x"), F.lit(True).alias("last")))).alias("e"))
    # At a corner where two pixels touch, the upper pixel's edge comes first, which keeps the two apart.
    down = Window.partitionBy(*keys, "e.x").orderBy("line", "row")
    paired = ends.select(*keys, "e.x", "e.last", "id", F.floor((F.row_number().over(down) - 1) / 2).alias("pair"))
    steps = paired.groupBy(*keys, "x", "pair").agg(F.max(F.when(F.col("last"), F.col("id"))).alias("id"), F.max(F.when(~F.col("last"), F.col("id"))).alias("next"))
    return join_on(edges.drop("row"), steps.select(*keys, "id", "next"), [*keys, "id"])


def mask_rings(masks: DataFrame, keys: Sequence[str] = REGION, whole_pixels: int = WHOLE_PIXELS) -> DataFrame:
    """Rings (keys, ring, hole, area, vertices) around the pixels of each mask: outer ones clockwise on screen, holes the other way.

    Coordinates are pixel edges: pixel (y, x) reaches from (x, y) to (x + 1, y + 1).  Parts that touch at a corner only are rings of their
    own.  The area of a mask is that of its outer rings less that of its holes.
    """
    found = StructType([StructField("ring", LongType()), StructField("hole", BooleanType()), StructField("area", LongType()), StructField("vertices", ArrayType(VERTEX))])

    def rings(rasters: Rasters, *_: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        mask, name, area, ends, x, y = traced(rasters)
        vertices = pa.ListArray.from_arrays(pa.array((np.r_[0, ends] * 2).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))
        return mask, [pa.array(name), pa.array(area < 0), pa.array(np.abs(area)), vertices]

    small, large = traced_masks(masks, keys, found, rings, whole_pixels)
    return small if large is None else small.unionByName(_rings_by_edges(large, keys))


def _rings_by_edges(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same by tables of edges.  Rows of a ring are gathered, nothing larger is."""
    keys = list(keys)
    linked = cut_lineage(edge_links(masks, keys))
    longest = linked.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    seen = linked.select(*keys, "id", F.col("next").alias("jump"), F.col("id").alias("ring"), F.lit(0).cast("long").alias("steps"))
    for k in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        ahead = seen.select(*keys, F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("ring").alias("_ring"), F.col("steps").alias("_steps"))
        lower = F.col("_ring") < F.col("ring")
        seen = cut_lineage(join_on(seen, ahead, [*keys, "jump"]).select(
            *keys, "id", F.col("_jump").alias("jump"), F.least("ring", "_ring").alias("ring"), F.when(lower, F.col("_steps") + (1 << k)).otherwise(F.col("steps")).alias("steps")))
    placed = join_on(linked, seen.select(*keys, "id", "ring", "steps"), [*keys, "id"])
    turn = F.when(F.col("steps") == 0, F.lit(-(1 << 62))).otherwise(-F.col("steps"))
    gathered = placed.groupBy(*keys, "ring").agg(F.sum(F.col("line").cast("long") * (F.col("x0") - F.col("x1"))).alias("_a"), F.array_sort(F.collect_list(F.struct(turn.alias("t"), "x0", "x1", "line"))).alias("_e"))
    corners = F.flatten(F.transform("_e", lambda e: F.array(*[G.point(e[c].cast("double"), e["line"].cast("double")) for c in ("x0", "x1")])))
    return gathered.select(*keys, "ring", (F.col("_a") < 0).alias("hole"), F.abs("_a").alias("area"), corners.alias("vertices"))


def mask_outlines(masks: DataFrame, keys: Sequence[str] = REGION, whole_pixels: int = WHOLE_PIXELS) -> DataFrame:
    """The largest outer ring (keys, vertices, outline_area) of each mask; of equal ones the first from the top."""
    keys = list(keys)
    outer = mask_rings(masks, keys, whole_pixels).where(~F.col("hole"))
    best = outer.groupBy(*keys).agg(F.max_by(F.struct("vertices", "area"), F.struct("area", -F.col("ring"))).alias("_b"))
    return best.select(*keys, "_b.vertices", F.col("_b.area").alias("outline_area"))
