"""Point patterns: radius counts, nearest neighbours, density clusters, Ripley functions, density surfaces.

Points are rows (image_id, point_id, label, x_nm, y_nm).  Equal coordinates are collapsed to one location with a
count first, so copies never meet each other.  Radius joins run on grid cells of the radius; cells that hold very
many locations are split on one side.  Counts within a radius and nearest neighbours are found tile by tile, a tile holding
about a thousand locations and those of a margin around it; what a tile can't tell goes by cells.  There nearest neighbours
descend a pyramid of cells, so a dense spot costs a few cells per point and not a cell full of points.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from mesograph.functions.labels import normalize_label
from mesograph.functions.special import normal_two_sided
from mesograph.operators.annotations import spatial_centroid
from mesograph.operators.graph import connected_components
from mesograph.operators.ordering import hash_uniform, hash_uniforms, join_on, join_sorted, ordered_index, quantiles
from mesograph.session import cut_lineage

HOT_CELL = 4096
CROWD = 256
BLOCK = 1024
TILE = 1024
WHOLE_KEY = 8192
TILE_ROWS = 65536
COUNTED_ROWS = 8192
PATTERN_POINTS = 200_000
PAIRS_TOGETHER = 2_000_000
FEW_PAIRS = 100_000


def extract_points(df: DataFrame, labels: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Centroids of outlines, circles and boxes in nanometres, with a cleaned label."""
    out = df.where(F.col("type").isin("roi", "circle", "rectangle")).withColumn("label", normalize_label(F.col("label")))
    if labels is not None:
        out = out.where(F.col("label").isin(list(labels)))
    px = F.col("pixel_size_nm")
    return (out.select("image_id", *keep, "label", (spatial_centroid("x") * px).alias("x_nm"), (spatial_centroid("y") * px).alias("y_nm"))
            .where(F.col("x_nm").isNotNull()))


def locations(points: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Distinct coordinates per key: `n` copies and the lowest point id as `loc`."""
    return points.groupBy(*keys, "x_nm", "y_nm").agg(F.count(F.lit(1)).alias("n"), F.min("point_id").alias("loc"))


def _cell(axis: str, side: float) -> Column:
    return F.floor(F.col(axis) / F.lit(float(side))).cast("bigint")


def _offsets(reach: int) -> Column:
    span = range(-reach, reach + 1)
    return F.explode(F.lit([[dx, dy] for dx in span for dy in span]))


def _dist2(ax: str, ay: str, bx: str, by: str) -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return dx * dx + dy * dy


def near_pairs(left: DataFrame, right: DataFrame, radius: float, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Rows of `left` (x_nm, y_nm, ...) with rows of `right` (bx, by, ...) at most `radius` apart.

    Cells are two radii wide and the left side is sent to those that its circle can reach, four on average.  Where a cell holds more than
    HOT_CELL right rows, that cell is cut into chunks that meet the left rows in different tasks; the list of such cells is shorter than the
    right side by that factor and is broadcast.  The two sides themselves are never: a plan's guess of their size is that of packed files.
    """
    keys = list(keys)
    side = 2.0 * radius

    def reached(axis: str) -> Column:
        far = F.lit(radius * (1 + 1e-9)) + F.abs(axis) * 1e-14
        return F.explode(F.sequence(F.floor((F.col(axis) - far) / side).cast("bigint"), F.floor((F.col(axis) + far) / side).cast("bigint")))

    asked = left.withColumn("_cx", reached("x_nm")).withColumn("_cy", reached("y_nm"))
    placed = right.withColumns({"_cx": _cell("bx", side), "_cy": _cell("by", side)})
    hot = F.broadcast(placed.groupBy(*keys, "_cx", "_cy").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_CELL)
                      .select(*keys, "_cx", "_cy", F.ceil(F.col("_n") / HOT_CELL).cast("int").alias("_k")))
    cell = [*keys, "_cx", "_cy"]
    asked = join_on(asked, hot, cell, "left").withColumn(
        "_s", F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1))).drop("_k")
    placed = join_on(placed, hot, cell, "left").withColumn(
        "_s", F.pmod(F.xxhash64("bx", "by"), F.coalesce("_k", F.lit(1))).cast("int")).drop("_k")
    both = join_on(asked, placed.hint("merge"), [*cell, "_s"])
    return both.withColumn("d2", _dist2("x_nm", "y_nm", "bx", "by")).where(F.col("d2") <= radius * radius).drop("_cx", "_cy", "_s")


def radius_neighbours(points: DataFrame, radius: float) -> DataFrame:
    """Neighbour lists as rows: each point with each other point within the radius."""
    left = points.select("image_id", "point_id", "x_nm", "y_nm")
    right = points.select("image_id", F.col("point_id").alias("neighbour_id"), F.col("x_nm").alias("bx"), F.col("y_nm").alias("by"))
    pairs = near_pairs(left, right, radius).where(F.col("point_id") != F.col("neighbour_id"))
    return pairs.select("image_id", "point_id", "neighbour_id", F.sqrt("d2").alias("distance_nm"))


def _count_in_crowd(asking: DataFrame, locs: DataFrame, radius: float, keys: Sequence[str]) -> DataFrame:
    """`asking` (keys, loc, x_nm, y_nm) with the copies of all `locs` within the radius as `near`.

    Quarter-radius cells that lie inside the circle whatever the two positions are count as a whole; only locations
    in the remaining cells are compared.  Rows grow some ninety times when they are sent to the cells around them, which a plan's guess of their size
    leaves out, so that these joins are never by broadcast.
    """
    keys = list(keys)
    side = radius / 4.0
    span = range(-5, 6)
    whole = [[dx, dy] for dx in span for dy in span if (abs(dx) + 1) ** 2 + (abs(dy) + 1) ** 2 < 16]
    reach = [[dx, dy] for dx in span for dy in span if [dx, dy] not in whole
             and max(abs(dx) - 1, 0) ** 2 + max(abs(dy) - 1, 0) ** 2 <= 16]
    gx, gy = _cell("x_nm", side), _cell("y_nm", side)
    cells = locs.groupBy(*keys, gx.alias("gx"), gy.alias("gy")).agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_m"))
    own = asking.withColumns({"gx": gx, "gy": gy})

    asked_cells = own.select(*keys, "gx", "gy").distinct().withColumn("_o", F.explode(F.lit(whole)))
    inside = (join_sorted(asked_cells.withColumns({"tx": F.col("gx") + F.get("_o", F.lit(0)), "ty": F.col("gy") + F.get("_o", F.lit(1))}),
                      cells.select(*keys, F.col("gx").alias("tx"), F.col("gy").alias("ty"), "_n"), [*keys, "tx", "ty"])
              .groupBy(*keys, "gx", "gy").agg(F.sum("_n").alias("_whole")))

    hot = cells.where(F.col("_m") > HOT_CELL).select(*keys, F.col("gx").alias("tx"), F.col("gy").alias("ty"),
                                                     F.ceil(F.col("_m") / HOT_CELL).cast("int").alias("_k"))
    target = [*keys, "tx", "ty"]
    asked = (own.withColumn("_o", F.explode(F.lit(reach)))
             .select(*keys, "loc", "x_nm", "y_nm", (F.col("gx") + F.get("_o", F.lit(0))).alias("tx"), (F.col("gy") + F.get("_o", F.lit(1))).alias("ty")))
    asked = join_on(asked, hot, target, "left").withColumn(
        "_s", F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1))).drop("_k")
    placed = locs.select(*keys, gx.alias("tx"), gy.alias("ty"), F.col("x_nm").alias("bx"), F.col("y_nm").alias("by"), "n")
    placed = join_on(placed, hot, target, "left").withColumn(
        "_s", F.pmod(F.xxhash64("bx", "by"), F.coalesce("_k", F.lit(1))).cast("int")).drop("_k")
    rim = (join_sorted(asked, placed, [*target, "_s"]).where(_dist2("x_nm", "y_nm", "bx", "by") <= radius * radius)
           .groupBy(*keys, "loc").agg(F.sum("n").alias("_rim")))
    out = join_sorted(join_sorted(own, inside, [*keys, "gx", "gy"], "left"), rim, [*keys, "loc"], "left")
    return (out.withColumn("near", F.coalesce("_whole", F.lit(0)) + F.coalesce("_rim", F.lit(0)))
            .drop("gx", "gy", "_whole", "_rim"))


def _count_within(asking: DataFrame, locs: DataFrame, radius: float, keys: Sequence[str]) -> DataFrame:
    """`asking` (keys, loc, x_nm, y_nm) with the copies of all locations within the radius, itself included, as `near`.

    Locations in ordinary cells are compared one by one; those in crowded cells are counted by `_count_in_crowd`.
    """
    keys = list(keys)
    cell = [*keys, "_gx", "_gy"]
    gx, gy = _cell("x_nm", radius), _cell("y_nm", radius)
    placed = locs.withColumns({"_gx": gx, "_gy": gy})
    crowded = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > CROWD).select(*cell)
    crowded = cut_lineage(crowded)
    ask = asking.select(*keys, "loc", "x_nm", "y_nm")
    if crowded.isEmpty():
        everyone = locs.select(*keys, F.col("x_nm").alias("bx"), F.col("y_nm").alias("by"), "n")
        counted = near_pairs(ask, everyone, radius, keys).groupBy(*keys, "loc").agg(F.sum("n").alias("near"))
        return join_sorted(asking, counted, [*keys, "loc"], "left").withColumn("near", F.coalesce("near", F.lit(0)))
    beside = (crowded.withColumn("_o", _offsets(1))
              .select(*keys, (F.col("_gx") + F.get("_o", F.lit(0))).alias("_gx"), (F.col("_gy") + F.get("_o", F.lit(1))).alias("_gy")).distinct())
    calm = join_on(placed, crowded, cell, "left_anti").select(*keys, F.col("x_nm").alias("bx"), F.col("y_nm").alias("by"), "n")
    plain = near_pairs(ask, calm, radius, keys).groupBy(*keys, "loc").agg(F.sum("n").alias("near"))
    dense = join_on(placed, crowded, cell, "left_semi").drop("_gx", "_gy")
    asked = join_on(ask.withColumns({"_gx": gx, "_gy": gy}), beside, cell, "left_semi").drop("_gx", "_gy")
    both = plain.unionByName(_count_in_crowd(asked, dense, radius, keys).select(*keys, "loc", "near"))
    total = both.groupBy(*keys, "loc").agg(F.sum("near").alias("near"))
    return join_sorted(asking, total, [*keys, "loc"], "left").withColumn("near", F.coalesce("near", F.lit(0)))


# ---- tiles

def _tiled(rows: DataFrame, side: Column, margin: Column) -> DataFrame:
    """Rows (x_nm, y_nm) sent to each tile (_tx, _ty) of width `side` that lies at most `margin` from them; `_own` marks the tile that they are in."""
    def reached(axis: str) -> Column:
        far = margin * (1 + 1e-9) + F.abs(axis) * 1e-14
        return F.explode(F.sequence(F.floor((F.col(axis) - far) / side).cast("bigint"), F.floor((F.col(axis) + far) / side).cast("bigint")))

    own = [F.floor(F.col(axis) / side).cast("bigint") == F.col(tile) for axis, tile in (("x_nm", "_tx"), ("y_nm", "_ty"))]
    return rows.withColumn("_tx", reached("x_nm")).withColumn("_ty", reached("y_nm")).withColumn("_own", own[0] & own[1])


def _by_tile(rows: DataFrame, keys: Sequence[str], most: int, answer: StructType, step: Callable) -> tuple[DataFrame, DataFrame]:
    """Rows that ask (`_asks`), with what `step` finds for them in their tile (keys, _tx, _ty), and those of tiles with more than `most` rows, unanswered.

    A tile's rows come together by one shuffle and a sort, and `step` sees whole tiles, one at a time: the rows as an Arrow batch, to the rows that
    ask and the columns of `answer` for them.  The list of tiles with too many rows is shorter than the rows by that factor and is broadcast.
    """
    tile = [*keys, "_tx", "_ty"]
    full = cut_lineage(rows.groupBy(*tile).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > most).select(*tile))
    held, crowded = rows, rows.where("_asks").limit(0)
    if not full.isEmpty():
        held = join_on(rows, F.broadcast(full), tile, "left_anti").select(*rows.columns)
        crowded = join_on(rows.where("_asks"), F.broadcast(full), tile, "left_semi").select(*rows.columns)
    schema = StructType([*rows.schema.fields, *answer.fields])
    names = rows.columns

    def answered(piece: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
        asking, found = step(piece)
        taken = piece.take(pa.array(asking))
        return pa.RecordBatch.from_arrays([*[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken.columns], *found], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.zeros(batch.num_rows, bool)
            fresh[0] = not rest or any(rest[-1].column(names.index(c))[-1] != batch.column(names.index(c))[0] for c in tile)
            for c in tile:
                column = batch.column(names.index(c))
                fresh[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(fresh)
            if len(starts):
                if rest or starts[0]:
                    yield answered(pa.Table.from_batches([*rest, batch.slice(0, starts[0])]).combine_chunks())
                done = [answered(batch.slice(a, b - a)) for a, b in zip(starts[:-1], starts[1:])]
                if done:
                    yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                rest = [batch.slice(starts[-1])]
            else:
                rest.append(batch)
        if rest:
            yield answered(pa.Table.from_batches(rest).combine_chunks())

    sorted_ = held.repartition(*[F.col(c) for c in tile]).sortWithinPartitions(*tile)
    return sorted_.mapInArrow(run, schema), crowded


def _floats(piece: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    return [piece.column(c).to_numpy(zero_copy_only=False) if isinstance(piece, pa.RecordBatch) else piece.column(c).to_numpy() for c in names]


def _counts_in_tile(radius: float) -> Callable:
    def step(piece: pa.RecordBatch | pa.Table) -> tuple:
        asks, x, y, n = _floats(piece, "_asks", "x_nm", "y_nm", "n")
        asking = np.flatnonzero(asks.astype(bool))
        near = np.zeros(len(asking), np.int64)
        across = np.argsort(x, kind="stable")
        sx, sy, sn = x[across], y[across], n[across]
        order = np.argsort(x[asking], kind="stable")
        far = radius * (1 + 1e-9) + (np.abs(sx).max(initial=0.0)) * 1e-14
        for at in range(0, len(order), CROWD):
            part = order[at:at + CROWD]
            ax, ay = x[asking[part]], y[asking[part]]
            low, high = np.searchsorted(sx, ax[0] - far), np.searchsorted(sx, ax[-1] + far, side="right")
            dx, dy = ax[:, None] - sx[low:high], ay[:, None] - sy[low:high]
            near[part] = (dx * dx + dy * dy <= radius * radius) @ sn[low:high]
        return asking, [pa.array(near)]

    return step


def local_density(points: DataFrame, radius: float) -> DataFrame:
    """Number of other points within the radius of each point.

    Tiles are eight radii wide, so that a location goes to one and a half of them.  Locations in tiles that hold more than COUNTED_ROWS are counted by cells.
    """
    keys = ["image_id"]
    locs = locations(points, keys).where("image_id IS NOT NULL AND x_nm IS NOT NULL AND y_nm IS NOT NULL")
    rows = _tiled(locs, F.lit(8.0 * radius), F.lit(float(radius))).withColumnRenamed("_own", "_asks")
    counted, crowded = _by_tile(rows, keys, COUNTED_ROWS, StructType([StructField("near", LongType())]), _counts_in_tile(float(radius)))
    counted, at = counted.select(*keys, "x_nm", "y_nm", "near"), [*keys, "x_nm", "y_nm"]
    asking = cut_lineage(crowded.select(*keys, "loc", "x_nm", "y_nm"))
    if not asking.isEmpty():
        counted = counted.unionByName(_count_within(asking, locs, radius, keys).select(*at, "near"))
    return join_sorted(points, counted, at).withColumn("n_neighbors", (F.col("near") - 1).cast("bigint")).drop("near")


# ---- nearest neighbour

def _pyramid_depth(n: int) -> int:
    return min(8, max(2, math.ceil(math.log(max(n, 2), 64)) + 2))


def _levels(df: DataFrame, keys: Sequence[str], base: float, depth: int, x: str, y: str) -> DataFrame:
    """One row per location and level; a cell of level l is base / 8^l wide."""
    finest = base / 8 ** depth
    work = df.withColumns({"_fx": F.floor(F.col(x) / finest).cast("bigint"), "_fy": F.floor(F.col(y) / finest).cast("bigint"),
                           "lv": F.explode(F.sequence(F.lit(0), F.lit(depth)))})
    step = (F.lit(3) * (F.lit(depth) - F.col("lv"))).cast("int")
    return work.withColumns({"cx": F.call_function("shiftright", F.col("_fx"), step), "cy": F.call_function("shiftright", F.col("_fy"), step)})


def nearest_by_pyramid(queries: DataFrame, targets: DataFrame, keys: Sequence[str] = ("image_id",), self_join: bool = False) -> DataFrame:
    """Exact distance from each query (keys, qid, x_nm, y_nm) to the nearest target (keys, loc, x_nm, y_nm).

    With `self_join` the queries are the targets and a location does not count as its own neighbour.  A query starts
    at the deepest cell known to hold a target and looks at the cells within the diagonal of that cell; every round
    replaces cells by their children and drops those farther than the best upper bound of the query.
    """
    keys = list(keys)
    far_out = F.max(F.greatest(F.abs("x_nm"), F.abs("y_nm"))).alias("m")
    span = targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), far_out).agg(F.max("n").alias("n"), F.max("m").alias("m")).first()
    reach = queries.agg(F.max(F.greatest(F.abs("x_nm"), F.abs("y_nm"))).alias("m")).first()
    base = 2.0 * max(span["m"] or 0.0, reach["m"] or 0.0, 1e-9)
    depth = _pyramid_depth(span["n"] or 0)
    finest = base / 8 ** depth
    leveled = _levels(targets, keys, base, depth, "x_nm", "y_nm")
    # The three minima belong to one location exactly where a cell holds one, which is where they are used.
    pyramid = (leveled.groupBy(*keys, "lv", "cx", "cy")
               .agg(F.count(F.lit(1)).alias("m"), F.min("loc").alias("loc"), F.min("x_nm").alias("x_nm"), F.min("y_nm").alias("y_nm"))
               .select(*keys, "lv", "cx", "cy", "m", F.struct("loc", "x_nm", "y_nm").alias("one")))
    pyramid = cut_lineage(pyramid)
    side = F.lit(base) / F.pow(F.lit(8.0), F.col("lv"))

    if self_join:
        alone = pyramid.where(F.col("m") == 1).groupBy(*keys, F.col("one.loc").alias("qid")).agg((F.min("lv") - 1).alias("start"))
        starts = join_on(queries, alone, [*keys, "qid"], "left").withColumn("start", F.coalesce("start", F.lit(depth)))
        starts = starts.where(F.col("start") >= 0)
    else:
        # Coarse cells are few but each meets many queries, so they are copied to 32 salts.
        cells = pyramid.select(*keys, "lv", "cx", "cy", F.explode(F.when(F.col("lv") <= 2, F.sequence(F.lit(0), F.lit(31)))
                                                                 .otherwise(F.array(F.lit(0)))).alias("_s"))
        asked = _levels(queries, keys, base, depth, "x_nm", "y_nm").withColumn(
            "_s", F.when(F.col("lv") <= 2, F.pmod(F.xxhash64("qid"), F.lit(32)).cast("int")).otherwise(F.lit(0)))
        held = join_on(asked, cells.withColumn("_hit", F.lit(True)), [*keys, "lv", "cx", "cy", "_s"], "left")
        starts = (held.groupBy(*keys, "qid").agg(F.max(F.when(F.col("_hit"), F.col("lv"))).alias("start"),
                                                 F.first("x_nm").alias("x_nm"), F.first("y_nm").alias("y_nm"))
                  .withColumn("start", F.coalesce("start", F.lit(-1))))
        # A query outside every occupied top-level cell looks at all of them; the field has at most four.
        starts = starts.withColumn("start", F.greatest("start", F.lit(0)))

    shift = (F.lit(3) * (F.lit(depth) - F.col("start"))).cast("int")
    frontier = (starts.withColumns({"lv": F.col("start"), "_o": _offsets(2),
                                    "_fx": F.floor(F.col("x_nm") / finest).cast("bigint"), "_fy": F.floor(F.col("y_nm") / finest).cast("bigint")})
                .select(*keys, "qid", F.col("x_nm").alias("qx"), F.col("y_nm").alias("qy"), "lv",
                        (F.call_function("shiftright", F.col("_fx"), shift) + F.get("_o", F.lit(0))).alias("cx"),
                        (F.call_function("shiftright", F.col("_fy"), shift) + F.get("_o", F.lit(1))).alias("cy")))
    cell = [*keys, "lv", "cx", "cy"]
    frontier = join_on(frontier, pyramid, cell)
    finer = pyramid.where(F.col("lv") > 0).select(
        *keys, (F.col("lv") - 1).alias("lv"), F.call_function("shiftright", F.col("cx"), F.lit(3)).alias("cx"),
        F.call_function("shiftright", F.col("cy"), F.lit(3)).alias("cy"), F.struct("lv", "cx", "cy", "m", "one").alias("kid"))
    last = pyramid.where(F.col("lv") == depth).select(*cell, F.struct("lv", "cx", "cy", "m", "one").alias("kid"))
    children = finer.unionByName(last)

    def pruned(df: DataFrame) -> DataFrame:
        single = F.col("m") == 1
        own = single & (F.col("one.loc") == F.col("qid")) if self_join else F.lit(False)
        exact = F.hypot(F.col("one.x_nm") - F.col("qx"), F.col("one.y_nm") - F.col("qy"))

        def near(c: str, q: str) -> Column:
            lo = F.col(c) * side
            return F.greatest(lo - F.col(q), F.col(q) - lo - side, F.lit(0.0))

        def far(c: str, q: str) -> Column:
            lo = F.col(c) * side
            return F.greatest(F.abs(F.col(q) - lo), F.abs(lo + side - F.col(q)))

        slack = 1.0 + 1e-9
        bounded = df.where(~own).withColumns({
            "_lo": F.when(single, exact).otherwise(F.hypot(near("cx", "qx"), near("cy", "qy")) / slack),
            "_hi": F.when(single, exact).otherwise(F.hypot(far("cx", "qx"), far("cy", "qy")) * slack)})
        best = F.min("_hi").over(Window.partitionBy(*keys, "qid"))
        return bounded.withColumn("_best", best).where(F.col("_lo") <= F.col("_best")).drop("_lo", "_hi", "_best")

    frontier = pruned(frontier)
    for _ in range(depth):
        stepped = join_on(frontier.drop("m", "one"), children, cell).select(*keys, "qid", "qx", "qy", "kid.*")
        frontier = pruned(stepped)
    exact = F.col("tx").isNotNull()
    finest_rows = targets.select(*keys, F.floor(F.col("x_nm") / finest).cast("bigint").alias("cx"),
                                 F.floor(F.col("y_nm") / finest).cast("bigint").alias("cy"), F.lit(depth).alias("lv"),
                                 F.col("loc").alias("tloc"), F.col("x_nm").alias("tx"), F.col("y_nm").alias("ty"))
    met = join_on(frontier, finest_rows, cell).where(exact)
    if self_join:
        met = met.where(F.col("tloc") != F.col("qid"))
    gap = F.hypot(F.col("tx") - F.col("qx"), F.col("ty") - F.col("qy"))
    return met.groupBy(*keys, "qid").agg(F.min(F.struct(gap.alias("d"), F.col("tloc"))).alias("_b")).select(
        *keys, "qid", F.col("_b.d").alias("distance_nm"), F.col("_b.tloc").alias("neighbour"))


def _best_in(ax: np.ndarray, ay: np.ndarray, own: np.ndarray, hx: np.ndarray, hy: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the places `h` of (hx, hy) to each (ax, ay) but the place `own`, the first of equals, and its squared distance."""
    best, least = np.full(len(ax), -1), np.full(len(ax), np.inf)
    if len(h):
        for i in range(0, len(ax), CROWD):
            dx, dy = ax[i:i + CROWD, None] - hx[h], ay[i:i + CROWD, None] - hy[h]
            d2 = dx * dx + dy * dy
            d2[own[i:i + CROWD, None] == h] = np.inf
            first = d2.argmin(axis=1)
            least[i:i + CROWD] = d2[np.arange(len(first)), first]
            best[i:i + CROWD] = h[first]
    return best, least


def _nearest_in(ax: np.ndarray, ay: np.ndarray, own: np.ndarray, hx: np.ndarray, hy: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for many places: halves with a margin around them first, then all places for those whose nearest one may be beyond it."""
    if len(h) <= CROWD or not len(ax):
        return _best_in(ax, ay, own, hx, hy, h)
    x, y = hx[h], hy[h]
    held, asked, place = (x, ax, x) if np.ptp(x) >= np.ptp(y) else (y, ay, y)
    middle = float(np.median(held))
    best, least, room = np.full(len(ax), -1), np.full(len(ax), np.inf), np.zeros(len(ax))
    for low in (True, False):
        a = np.flatnonzero((asked <= middle) if low else (asked > middle))
        half = place[place <= middle] if low else place[place > middle]
        margin = float(np.ptp(half)) / 8.0 if len(half) else 0.0
        inside = h[(place <= middle + margin) if low else (place >= middle - margin)]
        if len(inside) > 0.9 * len(h):
            return _best_in(ax, ay, own, hx, hy, h)
        best[a], least[a] = _nearest_in(ax[a], ay[a], own[a], hx, hy, inside)
        room[a] = margin + np.abs(asked[a] - middle)
    # Beyond the cut every place is farther than this.
    open_ = np.flatnonzero(~(least < (room * (1 - 1e-9)) ** 2))
    best[open_], least[open_] = _best_in(ax[open_], ay[open_], own[open_], hx, hy, h)
    return best, least


def _nearest_in_tile(id_: str) -> Callable:
    def step(piece: pa.RecordBatch | pa.Table) -> tuple:
        asks, holds, x, y, reach = _floats(piece, "_asks", "_holds", "x_nm", "y_nm", "_reach")
        ids = piece.column(id_)
        asking, h = np.flatnonzero(asks.astype(bool)), np.flatnonzero(holds.astype(bool))
        rank = pc.rank(ids, tiebreaker="first").to_numpy()
        h = h[np.argsort(rank[h], kind="stable")]  # the lowest id first, which decides between equal distances
        seen = np.zeros(len(asking), bool)
        best, gap = np.zeros(len(asking), np.int64), np.zeros(len(asking))
        if len(h) and len(asking) and np.isfinite(x).all() and np.isfinite(y).all():
            hx, hy = x[h], y[h]
            place = np.full(len(x), -1)
            place[h] = np.arange(len(h))
            best, least = _nearest_in(x[asking], y[asking], place[asking], hx, hy, np.arange(len(h)))
            seen = np.isfinite(least)
            best = np.where(seen, h[best], 0)
            gap = np.hypot(x[best] - x[asking], y[best] - y[asking])
            seen &= gap <= reach[asking]
        neighbour = ids.take(pa.array(np.where(seen, best, 0), mask=~seen))
        return asking, [pa.array(gap, mask=~seen), neighbour.combine_chunks() if isinstance(neighbour, pa.ChunkedArray) else neighbour]

    return step


def nearest(queries: DataFrame, targets: DataFrame, keys: Sequence[str] = ("image_id",), self_join: bool = False, asking: str = "true") -> DataFrame:
    """Queries (keys, qid, x_nm, y_nm, ...) with the exact distance to their nearest target (keys, loc, x_nm, y_nm) and its `neighbour` id.

    Tiles are sized per key to hold about TILE targets and come with those of a margin of an eighth around them.  A query is settled when its best
    distance is no longer than the margin and its tile is not crowded; every other query goes to `nearest_by_pyramid`.  A key with up to WHOLE_KEY
    targets and four times as many queries is one tile without a border.  With `self_join` the queries are the targets and only those that `asking`
    fits are answered.
    """
    keys = list(keys)
    w, h = F.max("x_nm") - F.min("x_nm"), F.max("y_nm") - F.min("y_nm")
    room = F.greatest(w, h / 1000.0, F.lit(1e-6)) * F.greatest(h, w / 1000.0, F.lit(1e-6))
    known = " AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, "x_nm", "y_nm"))
    sides = targets.where(known).groupBy(*keys).agg(F.sqrt(TILE * room / F.count(F.lit(1))).alias("_side"), F.count(F.lit(1)).alias("_among"))
    few = F.col("_among") <= WHOLE_KEY
    if not self_join:
        sides = join_on(sides, queries.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("_asking")), keys)
        few &= F.col("_asking") <= 4 * WHOLE_KEY
    endless = F.lit(float("inf"))
    sides = sides.select(*keys, "_among", F.when(few, endless).otherwise(F.col("_side")).alias("_side"), F.when(few, F.lit(0.0)).otherwise(F.col("_side") / 8.0).alias("_margin"),
                         F.when(few, endless).otherwise(F.col("_side") / 8.0).alias("_reach"))
    margin = F.col("_margin")
    asked = join_on(queries.where(known), sides, keys)
    if self_join:  # a lone target has no other
        rows = _tiled(asked, F.col("_side"), margin).withColumns({"_asks": F.col("_own") & F.expr(asking) & (F.col("_among") > 1), "_holds": F.lit(True)}).drop("_own")
    else:
        held = join_on(targets.where(known).select(*keys, F.col("loc").alias("qid"), "x_nm", "y_nm"), sides.drop("_reach"), keys)
        held = _tiled(held, F.col("_side"), margin).drop("_own").withColumns({"_asks": F.lit(False), "_holds": F.lit(True)})
        own = asked.withColumns({"_tx": F.floor(F.col("x_nm") / F.col("_side")).cast("bigint"), "_ty": F.floor(F.col("y_nm") / F.col("_side")).cast("bigint"),
                                 "_asks": F.lit(True), "_holds": F.lit(False)})
        rows = own.unionByName(held, allowMissingColumns=True)
    rows = rows.drop("_side", "_among", "_margin")
    answer = StructType([StructField("distance_nm", DoubleType()), StructField("neighbour", queries.schema["qid"].dataType)])
    told, crowded = _by_tile(rows, keys, TILE_ROWS, answer, _nearest_in_tile("qid"))
    given = queries.columns
    told = cut_lineage(told.select(*given, "distance_nm", "neighbour"))
    settled = told.where("distance_nm IS NOT NULL")
    rest = cut_lineage(told.where("distance_nm IS NULL").select(*given).unionByName(crowded.select(*given)))
    if rest.isEmpty():
        return settled
    among = join_on(targets, rest.select(*keys).distinct(), keys, "left_semi")
    far = nearest_by_pyramid(rest.select(*keys, "qid", "x_nm", "y_nm"), among, keys, self_join)
    return settled.unionByName(join_on(rest, far, [*keys, "qid"]).select(*settled.columns))


def _distances(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Locations (keys, x_nm, y_nm, n) of points with the distance to the nearest other point; copies are at distance zero, lone points give no row."""
    locs = locations(points, keys)
    found = nearest(locs.withColumnRenamed("loc", "qid"), locs, keys, self_join=True, asking="n = 1")
    at = [*keys, "x_nm", "y_nm", "n"]
    return found.select(*at, F.col("distance_nm").alias("nnd_nm")).unionByName(locs.where("n > 1").select(*at, F.lit(0.0).alias("nnd_nm")))


def nearest_neighbour_join(points: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Distance from each point to its nearest other point; copies are at distance zero, lone points give no row."""
    keys = list(keys)
    return join_on(points, _distances(points, keys).drop("n"), [*keys, "x_nm", "y_nm"])


def _cross_distances(points_a: DataFrame, points_b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Locations (keys, x_nm, y_nm, n) of A with the distance to the nearest point of B in the same key."""
    found = nearest(locations(points_a, keys).withColumnRenamed("loc", "qid"), locations(points_b, keys), keys)
    return found.select(*keys, "x_nm", "y_nm", "n", F.col("distance_nm").alias("cross_nnd_nm"))


def cross_nearest_join(points_a: DataFrame, points_b: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Distance from each point of A to the nearest point of B in the same key."""
    keys = list(keys)
    return join_on(points_a, _cross_distances(points_a, points_b, keys).drop("n"), [*keys, "x_nm", "y_nm"])


def _mean(found: DataFrame, keys: Sequence[str], distance: str, name: str) -> DataFrame:
    """Mean distance of the points of each key, from those of its locations."""
    return found.groupBy(*keys).agg((F.sum(F.col(distance) * F.col("n")) / F.sum("n")).alias(name))


def label_pairs(points: DataFrame, keys: Sequence[str] = ("image_id",)) -> tuple[DataFrame, DataFrame]:
    """The points as A and as B of every ordered pair of different labels of their key, with from_label and to_label as further keys."""
    keys = list(keys)
    labels = points.select(*keys, "label").distinct()
    a = join_on(points.withColumnRenamed("label", "from_label"), labels.withColumnRenamed("label", "to_label"), keys)
    b = join_on(points.withColumnRenamed("label", "to_label"), labels.withColumnRenamed("label", "from_label"), keys)
    return a.where("from_label <> to_label"), b.where("from_label <> to_label")


# ---- nearest-neighbour statistics

def _verdict(below: str, above: str, neither: str) -> Column:
    return F.when((F.col("p_value") < 0.05) & (F.col("R") < 1), below).when(
        (F.col("p_value") < 0.05) & (F.col("R") > 1), above).otherwise(neither)


def nnd_stats(points: DataFrame, fields: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Clark-Evans index per key of the points or the fields; `fields` gives width_nm and height_nm, and the expectation is edge corrected.

    A key with fewer than two points, or with no field or an empty one, has its count, nulls and a `message` that says why; others have none.
    """
    keys = list(keys)
    near = nearest_neighbour_join(points, keys)
    moments = near.groupBy(*keys).agg(F.avg("nnd_nm").alias("mean_nnd_nm"))
    medians = quantiles(near, keys, "nnd_nm", {"median_nnd_nm": 0.5})
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    everyone = join_on(counts, fields.select(*keys, "width_nm", "height_nm"), keys, "full").withColumn("n", F.coalesce("n", F.lit(0)))
    w, h, n = F.col("width_nm"), F.col("height_nm"), F.col("n")
    area = w * h
    message = F.when(n < 2, "fewer than two points").when(~F.coalesce(area > 0, F.lit(False)), "field without an area")
    told = everyone.withColumn("message", message).withColumns({c: F.when(F.col("message").isNull(), F.col(c)) for c in ("width_nm", "height_nm")})
    out = join_on(join_on(told, moments, keys, "left"), medians, keys, "left")
    out = out.withColumns({c: F.when(F.col("message").isNull(), F.col(c)) for c in ("mean_nnd_nm", "median_nnd_nm")})
    some = F.greatest(n, F.lit(1))
    expected = 0.5 * F.sqrt(area / some) + (0.0514 + 0.041 / F.sqrt(some)) * 2.0 * (w + h) / some
    out = out.withColumn("expected_nnd_nm", expected)
    out = out.withColumns({"R": F.col("mean_nnd_nm") / F.col("expected_nnd_nm"),
                           "z_score": (F.col("mean_nnd_nm") - F.col("expected_nnd_nm")) / (0.26136 / F.sqrt(some * some / area))})
    out = out.withColumn("p_value", normal_two_sided(F.col("z_score")))
    verdict = F.when(F.col("message").isNull(), _verdict("clustered", "regular", "random"))
    return out.withColumn("verdict", verdict).select(*keys, "n", "mean_nnd_nm", "median_nnd_nm", "expected_nnd_nm", "R", "z_score", "p_value", "verdict", "message")


def cross_nn_stats(points_a: DataFrame, points_b: DataFrame, fields: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Association of A with B per key against a uniform B of the same density."""
    keys = list(keys)
    near = cross_nearest_join(points_a, points_b, keys)
    a = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_a"), F.avg("cross_nnd_nm").alias("mean_cross_nnd_nm"))
    b = points_b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_b"))
    density = F.col("n_b") / (F.col("width_nm") * F.col("height_nm"))
    out = join_on(join_on(a, b, keys), fields, keys).withColumn("expected_nnd_nm", 0.5 / F.sqrt(density))
    out = out.withColumns({"R": F.col("mean_cross_nnd_nm") / F.col("expected_nnd_nm"),
                           "z_score": (F.col("mean_cross_nnd_nm") - F.col("expected_nnd_nm")) / (0.26136 / F.sqrt(F.col("n_a") * density))})
    out = out.withColumn("p_value", normal_two_sided(F.col("z_score")))
    return out.withColumn("verdict", _verdict("associated", "segregated", "independent")).drop("width_nm", "height_nm")


def csr_simulate(points: DataFrame, fields: DataFrame, n_sims: int, seed: int = 0, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """For every key `n_sims` uniform patterns with as many points as observed; the draw depends on ids alone."""
    keys = list(keys)
    ids = [F.col(k) for k in keys]
    drawn = join_on(points.select(*keys, "point_id"), fields, keys).withColumn("sim_id", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))))
    return drawn.select(*keys, "sim_id", "point_id",
                        (hash_uniform(seed, "x", F.col("sim_id"), *ids, F.col("point_id")) * F.col("width_nm")).alias("x_nm"),
                        (hash_uniform(seed, "y", F.col("sim_id"), *ids, F.col("point_id")) * F.col("height_nm")).alias("y_nm"))


def _pattern_rows(points: DataFrame, fields: DataFrame, n_sims: int, together: int, keys: Sequence[str]) -> DataFrame:
    """Points as `csr_simulate` draws them, once for every `together` patterns from `_sim` on: what their draws depend on is `_tail`, with the size of their field."""
    keys = list(keys)
    tail = F.concat(F.lit(":"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("point_id").cast("string")))
    drawn = join_on(points.select(*keys, "point_id"), fields.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("width_nm", "height_nm")]), keys)
    return drawn.where("width_nm IS NOT NULL AND height_nm IS NOT NULL").select(
        *keys, tail.alias("_tail"), "width_nm", "height_nm", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1), F.lit(together))).alias("_sim"))


def _patterns(rows: pd.DataFrame, n_sims: int, together: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The patterns (sim_id, x, y) of some `_pattern_rows` of one key, drawn as `csr_simulate` does."""
    first = int(rows["_sim"].iloc[0])
    last = min(n_sims, first + together)
    tails = [t.encode() for t in rows["_tail"]]
    size = np.array([len(t) for t in tails])
    drawn = {name: np.empty((len(tails), last - first)) for name in ("x", "y")}
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        for name, out in drawn.items():
            out[at] = hash_uniforms(f"{seed}:{name}:", last, [tails[i] for i in at], first)
    w, h = rows["width_nm"].to_numpy(), rows["height_nm"].to_numpy()
    for sim in range(first, last):
        yield sim, drawn["x"][:, sim - first] * w, drawn["y"][:, sim - first] * h


def nearest_gaps(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, same: bool = False) -> np.ndarray:
    """Distance from each (ax, ay) to the nearest (bx, by); with `same` these are the same points and none is its own neighbour.

    Where there are many pairs, cells hold two points on average; a point looks at the nine cells around it, and those whose nearest point may lie farther look at wider ones.
    """
    best = np.full(len(ax), np.inf)
    if len(bx) <= same:
        return best
    if len(ax) * len(bx) <= FEW_PAIRS:
        d2 = (ax[:, None] - bx) ** 2 + (ay[:, None] - by) ** 2
        if same:
            np.fill_diagonal(d2, np.inf)
        return np.sqrt(d2.min(axis=1))
    x0, y0, w, h = bx.min(), by.min(), np.ptp(bx), np.ptp(by)
    if w == 0 and h == 0:
        return np.hypot(ax - x0, ay - y0)
    side = math.sqrt(2.0 * max(w, h / 1000.0) * max(h, w / 1000.0) / len(bx))
    open_ = np.arange(len(ax))
    while len(open_):
        nx, ny = int(w / side) + 1, int(h / side) + 1
        cell = np.minimum(((bx - x0) / side).astype(np.int64), nx - 1) * ny + np.minimum(((by - y0) / side).astype(np.int64), ny - 1)
        order = np.argsort(cell, kind="stable")
        start = np.r_[0, np.cumsum(np.bincount(cell, minlength=nx * ny))]
        fx, fy = (ax[open_] - x0) / side, (ay[open_] - y0) / side
        cx, cy = np.clip(np.floor(fx), -2, nx + 1).astype(np.int64), np.clip(np.floor(fy), -2, ny + 1).astype(np.int64)
        low, high = np.clip(cy - 1, 0, ny), np.clip(cy + 2, 0, ny)
        for dx in (-1, 0, 1):
            column = cx + dx
            inside = (column >= 0) & (column < nx) & (low < high)
            line = np.clip(column, 0, nx - 1) * ny
            a = np.where(inside, start[np.minimum(line + low, nx * ny)], 0)
            many = np.where(inside, start[np.minimum(line + high, nx * ny)], 0) - a
            some = np.flatnonzero(many)
            for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(many[some]) // PAIRS_TOGETHER)) + 1):
                if not len(part):
                    continue
                size = many[part]
                begin = np.cumsum(size) - size
                of = np.repeat(open_[part], size)
                met = order[np.repeat(a[part] - begin, size) + np.arange(len(of))]
                d2 = (ax[of] - bx[met]) ** 2 + (ay[of] - by[met]) ** 2
                if same:
                    d2[of == met] = np.inf
                best[open_[part]] = np.minimum(best[open_[part]], np.minimum.reduceat(d2, begin))
        # Nothing beyond the nine cells is nearer than their border, if there is anything.
        room = side * np.minimum(np.minimum(fx - cx, cx + 1 - fx), np.minimum(fy - cy, cy + 1 - fy)) + side
        whole = (cx <= 1) & (cx >= nx - 2) & (cy <= 1) & (cy >= ny - 2)
        open_ = open_[~(whole | (np.sqrt(best[open_]) <= room * (1 - 1e-9)))]
        side *= 4.0
    return np.sqrt(best)


def _pattern_means(a: DataFrame | None, b: DataFrame, fields: DataFrame, n_sims: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """Mean nearest distance (keys, sim_id, simulated) of the patterns of `b`, or from the points `a` to them: some patterns of a key are drawn and measured in one task."""
    together = 16
    rows = _pattern_rows(b, fields, n_sims, together, keys)
    each = [*keys, "_sim"]
    schema = StructType([*[rows.schema[k] for k in keys], StructField("sim_id", IntegerType()), StructField("simulated", DoubleType())])

    def measured(drawn: pd.DataFrame, asking: pd.DataFrame | None = None) -> pd.DataFrame:
        found = []
        if len(drawn) and (asking is None or len(asking)):
            for sim, x, y in _patterns(drawn, n_sims, together, seed):
                gap = nearest_gaps(x, y, x, y, True) if asking is None else nearest_gaps(asking["x_nm"].to_numpy(), asking["y_nm"].to_numpy(), x, y)
                gap = gap[np.isfinite(gap)]
                if len(gap):
                    found.append((sim, float(gap.mean())))
        out = pd.DataFrame(found, columns=["sim_id", "simulated"])
        for i, k in enumerate(keys):
            out.insert(i, k, pd.Series([drawn[k].iloc[0]] * len(out), dtype=drawn[k].dtype) if len(out) else pd.Series([], dtype=drawn[k].dtype))
        return out

    if a is None:
        return rows.groupBy(*each).applyInPandas(lambda d: measured(d), schema)
    fixed = a.where("x_nm IS NOT NULL AND y_nm IS NOT NULL").select(
        *[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).cast("double").alias(c) for c in ("x_nm", "y_nm")], F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1), F.lit(together))).alias("_from"))
    return rows.groupBy(*each).cogroup(fixed.groupBy(*[f"_{k}" for k in keys], "_from")).applyInPandas(lambda d, q: measured(d, q), schema)


def _by_size(keys: Sequence[str], *tables: DataFrame) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The tables without keys that have more than PATTERN_POINTS rows in one of them, and with those alone, or nothing if there are none; the list is shorter
    than the rows by that factor and is broadcast."""
    keys = list(keys)
    large = [t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > PATTERN_POINTS).select(*keys) for t in tables]
    full = large[0] if len(large) == 1 else large[0].unionByName(large[1]).distinct()
    full = cut_lineage(full)
    if full.isEmpty():
        return list(tables), None
    return [join_on(t, F.broadcast(full), keys, "left_anti") for t in tables], [join_on(t, F.broadcast(full), keys, "left_semi") for t in tables]


def nnd_montecarlo_p(points: DataFrame, fields: DataFrame, n_sims: int, seed: int = 0, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Two-sided share of simulated means at least as extreme as the observed mean, in both usual forms.

    Patterns are drawn and measured in a task; those of keys with more than PATTERN_POINTS points are tables.
    """
    keys = list(keys)
    each = [*keys, "sim_id"]
    seen = _mean(_distances(points, keys), keys, "nnd_nm", "observed")
    (few,), many = _by_size(keys, points)
    means = _pattern_means(None, few, fields, n_sims, seed, keys)
    if many:
        means = means.unionByName(_mean(_distances(csr_simulate(many[0], fields, n_sims, seed, keys), each), each, "nnd_nm", "simulated"))
    return _empirical_p(join_on(means, seen, keys), keys, n_sims)


def cross_montecarlo_p(points_a: DataFrame, points_b: DataFrame, fields: DataFrame, n_sims: int, seed: int = 0,
                       keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """The same for A to B with B placed at random and A kept."""
    keys = list(keys)
    each = [*keys, "sim_id"]
    seen = _mean(_cross_distances(points_a, points_b, keys), keys, "cross_nnd_nm", "observed")
    (few_a, few_b), many = _by_size(keys, points_a, points_b)
    means = _pattern_means(few_a, few_b, fields, n_sims, seed, keys)
    if many:
        fixed = locations(many[0], keys).withColumnRenamed("loc", "qid").withColumn("sim_id", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))))
        drawn = locations(csr_simulate(many[1], fields, n_sims, seed, keys), each)
        means = means.unionByName(_mean(nearest(fixed, drawn, each).withColumnRenamed("distance_nm", "cross_nnd_nm"), each, "cross_nnd_nm", "simulated"))
    return _empirical_p(join_on(means, seen, keys), keys, n_sims)


def _empirical_p(means: DataFrame, keys: Sequence[str], n_sims: int) -> DataFrame:
    le, ge = F.count_if(F.col("simulated") <= F.col("observed")), F.count_if(F.col("simulated") >= F.col("observed"))
    low = F.least("n_le", "n_ge")
    return (means.groupBy(*keys).agg(F.max("observed").alias("observed"), le.alias("n_le"), ge.alias("n_ge"))
            .withColumns({"p_montecarlo": F.least(F.lit(1.0), 2.0 * low / F.lit(float(n_sims + 1))),
                          "p_montecarlo_plus": F.least(F.lit(1.0), 2.0 * (low + 1) / F.lit(float(n_sims + 1)))}))


# ---- density clusters

def dbscan(points: DataFrame, eps: float, min_samples: int = 3) -> DataFrame:
    """Density clusters per image: `cluster_id` from 0 in the order of the lowest core point id, -1 for noise.

    Cells of eps / 1.5 are small enough that all their points are within eps of each other.  A cell with min_samples
    points is all core without a comparison, so only points of thin cells are compared, and links are looked for
    between cells, not between points.
    """
    side = eps / 1.5
    key = ["image_id"]
    cell = ["image_id", "gx", "gy"]
    locs = locations(points).withColumns({"gx": _cell("x_nm", side), "gy": _cell("y_nm", side)})
    cells = locs.groupBy(*cell).agg(F.sum("n").alias("_n"))
    sized = join_on(locs, cells, cell)
    thin = sized.where(F.col("_n") < min_samples).drop("_n", "n")
    right = locs.select("image_id", F.col("x_nm").alias("bx"), F.col("y_nm").alias("by"), "n")
    counted = near_pairs(thin, right, eps).groupBy("image_id", "loc").agg(F.sum("n").alias("near"))
    sparse_core = counted.where(F.col("near") >= min_samples).select("image_id", "loc", F.lit(True).alias("core"))
    flagged = join_on(sized, sparse_core, ["image_id", "loc"], "left").withColumn(
        "core", (F.col("_n") >= min_samples) | F.coalesce("core", F.lit(False))).drop("_n")
    flagged = cut_lineage(flagged)
    core = flagged.where("core").drop("core")
    nodes = core.groupBy(*cell).agg(F.min("loc").alias("node"))

    links = _cell_links(core, cell, eps, side)
    a = nodes.select("image_id", "gx", "gy", F.col("node").alias("src"))
    b = nodes.select("image_id", F.col("gx").alias("hx"), F.col("gy").alias("hy"), F.col("node").alias("dst"))
    edges = join_on(join_on(links, a, cell), b, ["image_id", "hx", "hy"]).select("image_id", "src", "dst")
    labels = connected_components(nodes.select("image_id", "node"), edges, key)
    clusters = labels.groupBy("image_id", F.col("component").alias("first_core")).agg(F.count(F.lit(1)).alias("_c"))
    numbered = ordered_index(clusters, key, "first_core", out="cluster_id").drop("_c")
    of_cell = join_on(join_on(nodes, labels, ["image_id", "node"]).withColumnRenamed("component", "first_core"), numbered, ["image_id", "first_core"])
    core_ids = join_on(core, of_cell.select(*cell, "cluster_id"), cell).select("image_id", "x_nm", "y_nm", "cluster_id")
    border = near_pairs(flagged.where(~F.col("core")).select("image_id", "loc", "x_nm", "y_nm"),
                        core_ids.select("image_id", F.col("x_nm").alias("bx"), F.col("y_nm").alias("by"), "cluster_id"), eps)
    border_ids = border.groupBy("image_id", "x_nm", "y_nm").agg(F.min("cluster_id").alias("cluster_id"))
    found = core_ids.unionByName(border_ids)
    return (join_on(points, found, ["image_id", "x_nm", "y_nm"], "left")
            .withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)).cast("bigint")))


def _cell_links(core: DataFrame, cell: Sequence[str], eps: float, side: float) -> DataFrame:
    """Pairs of cells (gx, gy)-(hx, hy) that hold core points within eps of each other.

    Each cell is first reduced to the occupied squares of a 16x16 raster.  Squares whose farthest corners are within
    eps link their cells at once; only the cells left over compare points, and only in squares that come near enough.
    """
    fine = side / 16.0
    ahead = F.lit([[dx, dy] for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)])
    squares = core.withColumns({"sx": _cell("x_nm", fine), "sy": _cell("y_nm", fine)})
    occupied = squares.select(*cell, "sx", "sy").distinct()
    pairs = (occupied.withColumn("_o", F.explode(ahead))
             .withColumns({"hx": F.col("gx") + F.get("_o", F.lit(0)), "hy": F.col("gy") + F.get("_o", F.lit(1))}).drop("_o"))
    there = occupied.select("image_id", F.col("gx").alias("hx"), F.col("gy").alias("hy"), F.col("sx").alias("tx"), F.col("sy").alias("ty"))
    met = join_on(pairs, there, ["image_id", "hx", "hy"])
    dx, dy = F.abs(F.col("sx") - F.col("tx")), F.abs(F.col("sy") - F.col("ty"))
    reach = (eps / fine) ** 2
    farthest = (dx + 1) * (dx + 1) + (dy + 1) * (dy + 1)
    closest = F.greatest(dx - 1, F.lit(0)) * F.greatest(dx - 1, F.lit(0)) + F.greatest(dy - 1, F.lit(0)) * F.greatest(dy - 1, F.lit(0))
    link = [*cell, "hx", "hy"]
    sure = met.where(farthest <= reach * (1 - 1e-9)).select(*link).distinct()
    unsure = met.where((farthest > reach * (1 - 1e-9)) & (closest <= reach * (1 + 1e-9)))
    unsure = join_on(unsure, sure, link, "left_anti").select(*link, "sx", "sy", "tx", "ty")
    left = join_on(unsure, squares.select(*cell, "sx", "sy", F.col("x_nm").alias("ax"), F.col("y_nm").alias("ay")), [*cell, "sx", "sy"])
    right = squares.select("image_id", F.col("gx").alias("hx"), F.col("gy").alias("hy"), F.col("sx").alias("tx"), F.col("sy").alias("ty"),
                           F.col("x_nm").alias("bx"), F.col("y_nm").alias("by"))
    close = join_on(left, right, ["image_id", "hx", "hy", "tx", "ty"]).where(_dist2("ax", "ay", "bx", "by") <= eps * eps)
    return sure.unionByName(close.select(*link).distinct())


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("image_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))


def cluster_summary(clustered: DataFrame) -> DataFrame:
    sizes = cluster_sizes(clustered)
    noise = F.col("cluster_id") == -1
    return sizes.groupBy("image_id").agg(
        F.sum("n").alias("n_features"), F.count_if(~noise).alias("n_clusters"),
        F.coalesce(F.sum(F.when(noise, F.col("n"))), F.lit(0)).cast("bigint").alias("n_noise"))


# ---- Ripley

def _pair_counts(points: DataFrame, radii: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Ordered pairs of distinct points at most r apart, per key and radius index.

    Locations are packed into blocks of some BLOCK rows by cell and hash; a numpy step counts the distances of one
    pair of blocks, so pairs of points are never rows.
    """
    keys = list(keys)
    limit = float(max(radii))
    steps = np.array([float(r) ** 2 for r in radii])
    locs = locations(points, keys).withColumns({"gx": _cell("x_nm", limit), "gy": _cell("y_nm", limit)})
    cell = [*keys, "gx", "gy"]
    sizes = locs.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_k"))
    blocks = (join_on(locs, sizes, cell).withColumn("bid", F.pmod(F.xxhash64("x_nm", "y_nm"), F.col("_k")).cast("int"))
              .groupBy(*cell, "bid", "_k").agg(F.collect_list(F.struct("x_nm", "y_nm", "n")).alias("rows")))
    packed = blocks.select(*cell, "bid", *[F.col(f"rows.{c}").cast("array<double>").alias(c) for c in ("x_nm", "y_nm", "n")])
    ahead = F.lit([[0, 0], [0, 1], [1, -1], [1, 0], [1, 1]])
    left = (packed.withColumn("_o", F.explode(ahead))
            .select(*keys, "gx", "gy", "bid", (F.col("gx") + F.get("_o", F.lit(0))).alias("hx"), (F.col("gy") + F.get("_o", F.lit(1))).alias("hy"),
                    F.col("x_nm").alias("ax"), F.col("y_nm").alias("ay"), F.col("n").alias("an")))
    right = packed.select(*keys, F.col("gx").alias("hx"), F.col("gy").alias("hy"), F.col("bid").alias("cid"),
                          F.col("x_nm").alias("bx"), F.col("y_nm").alias("by"), F.col("n").alias("bn"))
    same_cell = (F.col("gx") == F.col("hx")) & (F.col("gy") == F.col("hy"))
    met = join_on(left, right, [*keys, "hx", "hy"]).where(~same_cell | (F.col("bid") <= F.col("cid")))
    met = met.withColumn("same", same_cell & (F.col("bid") == F.col("cid")))

    def count(ax: pd.Series, ay: pd.Series, an: pd.Series, bx: pd.Series, by: pd.Series, bn: pd.Series, same: pd.Series) -> pd.Series:
        out = []
        for xa, ya, na, xb, yb, nb, one in zip(ax, ay, an, bx, by, bn, same):
            found = _block_counts(xa, ya, na, xb, yb, nb, steps)
            out.append(found if one else 2.0 * found)
        return pd.Series(out)

    counter = F.pandas_udf(count, "array<double>")
    slots = met.select(*keys, F.posexplode(counter("ax", "ay", "an", "bx", "by", "bn", "same")).alias("r_idx", "c"))
    return slots.groupBy(*keys, "r_idx").agg(F.sum("c").alias("within"))


def _block_counts(xa: np.ndarray, ya: np.ndarray, na: np.ndarray | None, xb: np.ndarray, yb: np.ndarray, nb: np.ndarray | None, steps: np.ndarray) -> np.ndarray:
    """Pairs of two blocks (with their copies `na`, `nb`) at most the root of each step apart; only steps between their least and greatest distance are counted."""
    def span(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
        return max(b.min() - a.max(), a.min() - b.max(), 0.0), max(b.max() - a.min(), a.max() - b.min())

    (x0, x1), (y0, y1) = span(xa, xb), span(ya, yb)
    first = int(np.searchsorted(steps, (x0 * x0 + y0 * y0) * (1 - 1e-9)))
    last = int(np.searchsorted(steps, (x1 * x1 + y1 * y1) * (1 + 1e-9)))
    plain = na is None or ((na == 1).all() and (nb == 1).all())
    found = np.zeros(len(steps))
    found[last:] = len(xa) * len(xb) if plain else na.sum() * nb.sum()
    if first < last:
        d2, dy = np.subtract.outer(xa, xb), np.subtract.outer(ya, yb)
        d2 *= d2
        dy *= dy
        d2 += dy
        for i in range(first, last):
            found[i] = np.count_nonzero(d2 <= steps[i]) if plain else na @ ((d2 <= steps[i]) @ nb)
    return found


PATTERN_BLOCK = 256


def pattern_counts(x: np.ndarray, y: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Ordered pairs of points, each with itself included, at most the root of each step apart: blocks of points near each other, a pair of blocks at a time."""
    strips = max(1, math.isqrt(-(-len(x) // PATTERN_BLOCK)))
    parts = [strip[np.argsort(y[strip], kind="stable")] for strip in np.array_split(np.argsort(x, kind="stable"), strips) if len(strip)]
    blocks = [(x[part], y[part]) for strip in parts for part in np.array_split(strip, -(-len(strip) // PATTERN_BLOCK))]
    low, high = (np.array([[f(a), f(b)] for a, b in blocks]) for f in (np.min, np.max))
    held = [np.empty(PATTERN_BLOCK * PATTERN_BLOCK, kind) for kind in (float, float, bool)]
    found = np.zeros(len(steps))
    for i, (xa, ya) in enumerate(blocks):
        least = np.maximum(np.maximum(low[i:] - high[i], low[i] - high[i:]), 0.0)
        most = np.maximum(high[i:] - low[i], high[i] - low[i:])
        first = np.searchsorted(steps, (least ** 2).sum(axis=1) * (1 - 1e-9)).tolist()
        last = np.searchsorted(steps, (most ** 2).sum(axis=1) * (1 + 1e-9)).tolist()
        for j, (xb, yb) in enumerate(blocks[i:]):
            both = 2.0 if j else 1.0
            found[last[j]:] += both * len(xa) * len(xb)
            if first[j] < last[j]:
                d2, dy, near = (h[:len(xa) * len(xb)].reshape(len(xa), len(xb)) for h in held)
                np.subtract(xa[:, None], xb, out=d2), np.multiply(d2, d2, out=d2)
                np.subtract(ya[:, None], yb, out=dy), np.multiply(dy, dy, out=dy)
                np.add(d2, dy, out=d2)
                for k in range(first[j], last[j]):
                    found[k] += both * np.count_nonzero(np.less_equal(d2, steps[k], out=near))
    return found


def _pattern_pairs(points: DataFrame, fields: DataFrame, radii: Sequence[float], n_sims: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """What `_pair_counts` finds (keys, sim_id, r_idx, within) for the patterns of `csr_simulate`: some patterns of a key are drawn and counted in one task."""
    together = 4
    steps = np.array([float(r) ** 2 for r in radii])
    rows = _pattern_rows(points, fields, n_sims, together, keys)
    schema = StructType([*[rows.schema[k] for k in keys], StructField("sim_id", IntegerType()), StructField("r_idx", IntegerType()), StructField("within", DoubleType())])

    def counted(drawn: pd.DataFrame) -> pd.DataFrame:
        found = [(sim, pattern_counts(x, y, steps)) for sim, x, y in _patterns(drawn, n_sims, together, seed)]
        out = pd.DataFrame({"sim_id": np.repeat([s for s, _ in found], len(steps)), "r_idx": np.tile(np.arange(len(steps)), len(found)), "within": np.concatenate([c for _, c in found])})
        for i, k in enumerate(keys):
            out.insert(i, k, pd.Series([drawn[k].iloc[0]] * len(out), dtype=drawn[k].dtype))
        return out

    return rows.groupBy(*keys, "_sim").applyInPandas(counted, schema)


def ripley_l(points: DataFrame, fields: DataFrame, radii: Sequence[float], keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """L(r) - r without edge correction, one row per key and radius."""
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _ripley(_pair_counts(points, radii, keys), counts, fields, radii, keys)


def _ripley(within: DataFrame, counts: DataFrame, fields: DataFrame, radii: Sequence[float], keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    base = join_on(counts, fields, keys).where((F.col("n") >= 2) & (F.col("width_nm") * F.col("height_nm") > 0))
    within = join_on(within, base, keys)
    n, area = F.col("n"), F.col("width_nm") * F.col("height_nm")
    k = (F.col("within") - n) / (n * (n / area))
    radius = F.get(F.lit([float(r) for r in radii]), F.col("r_idx"))
    return within.select(*keys, radius.alias("radius_nm"), (F.sqrt(F.greatest(k, F.lit(0.0)) / math.pi) - radius).alias("l_minus_r"))


def ripley_envelope(points: DataFrame, fields: DataFrame, radii: Sequence[float], n_sims: int, seed: int = 0,
                    keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Observed L(r) - r with the 2.5 and 97.5 percentiles of simulated uniform patterns.

    Patterns are drawn and counted in a task; those of keys with more than PATTERN_POINTS points are tables.
    """
    keys = list(keys)
    sim_keys = [*keys, "sim_id"]
    sim_fields = fields.withColumn("sim_id", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))))
    (few,), many = _by_size(keys, points)
    counts = join_on(join_on(few.select(*keys), fields.select(*keys), keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), sim_fields.select(*sim_keys).distinct(), keys)
    simulated = _ripley(_pattern_pairs(few, fields, radii, n_sims, seed, keys), counts, sim_fields, radii, sim_keys)
    if many:
        simulated = simulated.unionByName(ripley_l(csr_simulate(many[0], fields, n_sims, seed, keys), sim_fields, radii, sim_keys))
    band = quantiles(simulated, [*keys, "radius_nm"], "l_minus_r", {"lo": 0.025, "hi": 0.975})
    return join_on(ripley_l(points, fields, radii, keys), band, [*keys, "radius_nm"])


# ---- density surface

def kde_grid(points: DataFrame, fields: DataFrame, n_grid: int = 200, bandwidth_nm: float | None = None,
             keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Gaussian density with the full covariance on an n_grid x n_grid raster of each field.

    Every task adds its locations to one raster per field, as arrays, and only lines of these sums are moved; no pair of location and
    raster cell is ever a row.  Sums are exact but for kernels under 3e-20 of their height.
    """
    keys = list(keys)
    moments = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.var_samp("x_nm").alias("sxx"), F.var_samp("y_nm").alias("syy"),
        F.covar_samp("x_nm", "y_nm").alias("sxy"), ((F.stddev_pop("x_nm") + F.stddev_pop("y_nm")) / 2.0).alias("spread"))
    n = F.col("total")
    factor = F.pow(n, F.lit(-1.0 / 6.0))
    if bandwidth_nm is not None and bandwidth_nm > 0:
        factor = F.when(F.col("spread") > 0, F.lit(float(bandwidth_nm)) / F.nullif("spread", F.lit(0.0))).otherwise(factor)
    f2 = factor * factor
    moments = moments.withColumn("det", (F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")) * f2 * f2).withColumns(
        {"sxx": F.col("sxx") * f2, "syy": F.col("syy") * f2, "sxy": F.col("sxy") * f2})
    usable = moments.where((n >= 2) & (F.col("det") > 0))
    base = join_on(join_on(locations(points, keys), usable, keys), fields, keys)
    base = base.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("x_nm", "y_nm", "n", "total", "sxx", "syy", "sxy", "det", "width_nm", "height_nm")])
    schema = StructType([*base.schema.fields[:len(keys)], StructField("gy", IntegerType()), StructField("line", ArrayType(DoubleType()))])

    def rasters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def lines() -> Iterator[pd.DataFrame]:
            for key, raster in held.items():
                yield pd.DataFrame({**{k: [v] * n_grid for k, v in zip(keys, key)}, "gy": np.arange(n_grid, dtype=np.int32), "line": list(raster)})[[*keys, "gy", "line"]]

        for batch in batches:
            for key, rows in batch.groupby(keys, sort=False):
                if key not in held:
                    if len(held) >= RASTERS_TOGETHER:
                        yield from lines()
                        held.clear()
                    held[key] = np.zeros((n_grid, n_grid))
                _add_kernels(held[key], rows)
        yield from lines()

    summed = (base.mapInPandas(rasters, schema).select(*keys, "gy", F.posexplode("line").alias("gx", "density"))
              .groupBy(*keys, "gy", "gx").agg(F.sum("density").alias("density")))
    return summed


RASTERS_TOGETHER = 64
# A kernel is left out where it is under exp(-45) = 3e-20 of its height.
LEAST_ENERGY = 45.0


def _add_kernels(raster: np.ndarray, rows: pd.DataFrame) -> None:
    """Add the kernels of some locations of one field to its raster, each within the box where it is not vanishing."""
    n = len(raster)
    sx, sy = rows["width_nm"].iloc[0] / (n - 1), rows["height_nm"].iloc[0] / (n - 1)
    sxx, syy, sxy, det, total = (float(rows[c].iloc[0]) for c in ("sxx", "syy", "sxy", "det", "total"))
    rx, ry = math.sqrt(2 * LEAST_ENERGY * sxx), math.sqrt(2 * LEAST_ENERGY * syy)
    scale = 1.0 / (2.0 * math.pi * math.sqrt(det) * total)
    for x, y, w in zip(rows["x_nm"].to_numpy(), rows["y_nm"].to_numpy(), rows["n"].to_numpy()):
        x0, x1 = max(0, math.ceil((x - rx) / sx)), min(n, math.floor((x + rx) / sx) + 1)
        y0, y1 = max(0, math.ceil((y - ry) / sy)), min(n, math.floor((y + ry) / sy) + 1)
        if x0 < x1 and y0 < y1:
            dx, dy = np.arange(x0, x1) * sx - x, np.arange(y0, y1) * sy - y
            energy = (syy * dx * dx)[None, :] - (2.0 * sxy * dy)[:, None] * dx[None, :] + (sxx * dy * dy)[:, None]
            raster[y0:y1, x0:x1] += (w * scale) * np.exp(energy * (-0.5 / det))


# ---- batch over images

def point_fields(points: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Field from the bounding box of the points, at least one nanometre each way."""
    def span(c: str) -> Column:
        return F.greatest(F.max(c) - F.min(c), F.lit(1.0))

    return points.groupBy(*keys).agg(span("x_nm").alias("width_nm"), span("y_nm").alias("height_nm"))


def spatial_batch(points: DataFrame, images: DataFrame, eps: float, min_samples: int = 3) -> DataFrame:
    """Per image with points or in `images`: condition, Clark-Evans R and cluster counts; the field comes from the image shape if known.

    Images that have no index keep their row with a `message`."""
    boxes = point_fields(points).select("image_id", F.col("width_nm").alias("_w"), F.col("height_nm").alias("_h"))
    shapes = images.select("image_id", "condition", (F.col("width") * F.col("pixel_size_nm")).alias("_iw"), (F.col("height") * F.col("pixel_size_nm")).alias("_ih"))
    both = boxes.join(shapes, "image_id", "full")
    fields = both.select("image_id", F.coalesce("_iw", "_w").alias("width_nm"), F.coalesce("_ih", "_h").alias("height_nm"))
    stats = nnd_stats(points, fields).select("image_id", "n", "R", "p_value", "verdict", "message")
    clusters = cluster_summary(dbscan(points, eps, min_samples))
    none = F.lit(0).cast("long")
    return (both.select("image_id", "condition").join(stats, "image_id", "left").join(clusters, "image_id", "left")
            .select("image_id", "condition", "n", "R", "p_value", F.coalesce("n_clusters", none).alias("n_clusters"), F.coalesce("n_noise", none).alias("n_noise"), "verdict", "message"))


def condition_summary(batch: DataFrame) -> DataFrame:
    n = F.count("R")
    return batch.groupBy("condition").agg(n.alias("n_images"), F.avg("R").alias("mean_R"),
                                          F.when(n > 1, F.stddev_samp("R") / F.sqrt(n)).otherwise(F.lit(0.0)).alias("se_R"))
