"""Masks of regions, as runs (image_id, region_id, y, xa, xb), in bands (image_id, region_id, band, n, runs) or as pixels (image_id, region_id, y, x).

Set operations work on bands (operators/spans.py), so that a mask moves as one row or a few; given pixels they give pixels back, otherwise runs.  Work that depends on an
order (greedy suppression, subtract-or-unite) goes in rounds: a round settles every mask whose rivals before it are settled, by joins and sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from mesograph.operators.graph import connected_components
from mesograph.operators.ordering import join_on
from mesograph.operators.pixels import roi_pixels
from mesograph.operators.spans import (BAND, Lines, as_spans, band_rows, by_band, column_spans, joined, known_group, outline_bands, outline_spans, ranked, span_area,
                                       span_pixels, union_spans)
from mesograph.session import cut_lineage

REGION = ["image_id", "region_id"]
PIXEL = ["image_id", "y", "x"]
MAX_REGIONS = 65535


def _like(masks: DataFrame, spans: DataFrame) -> DataFrame:
    """Runs in the form that `masks` came in."""
    return spans if "x" not in masks.columns else span_pixels(spans)


def _run_schema(masks: DataFrame, keys: Sequence[str], more: Sequence[str] = ()) -> StructType:
    return StructType([*[masks.schema[k] for k in keys], *[StructField(c, IntegerType()) for c in ("y", "xa", "xb")], *[masks.schema[c] for c in more]])


def rasterize_roi(rois: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Outlines to mask rows."""
    return roi_pixels(rois, keys)


def rasterize_spans(rois: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Outlines to runs."""
    return outline_spans(rois, keys)


def rasterize_bands(rois: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Outlines to the same runs, with those of a region and band of lines in one row."""
    return outline_bands(rois, keys)


def mask_area(masks: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    if "xa" in masks.columns:
        return span_area(masks, keys)
    if "band" in masks.columns:
        return masks.groupBy(*keys).agg(F.sum("n").alias("area"))
    return masks.groupBy(*keys).agg(F.count(F.lit(1)).alias("area"))


def filter_min_area(masks: DataFrame, min_area: int, keys: Sequence[str] = REGION) -> DataFrame:
    return join_on(masks, mask_area(masks, keys).where(F.col("area") >= min_area).select(*keys), keys, "left_semi")


def masks_by_area_desc(masks: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    return mask_area(masks, keys).orderBy(F.desc("area"), *keys)


def largest_region(masks: DataFrame, group: Sequence[str] = ("image_id",)) -> DataFrame:
    """Region with the most pixels of each group; the lowest id on a tie."""
    sized = mask_area(masks, [*group, "region_id"])
    first = F.min(F.struct((-F.col("area")).alias("a"), "region_id"))
    return sized.groupBy(*group).agg(first.alias("_b")).select(*group, F.col("_b.region_id").alias("region_id"), (-F.col("_b.a")).alias("area"))


def mask_bbox(masks: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Box as x, y, width, height and the mean pixel of each region."""
    if "xa" in masks.columns:
        n, last = F.col("xb") - F.col("xa"), F.col("xb") - 1
        area = F.sum(n)
        return masks.groupBy(*keys).agg(
            F.min("xa").cast("double").alias("bx"), F.min("y").cast("double").alias("by_"), (F.max(last) - F.min("xa")).cast("double").alias("bw"),
            (F.max("y") - F.min("y")).cast("double").alias("bh"), (F.sum((F.col("xa") + last).cast("long") * n) / 2 / area).alias("cx"),
            (F.sum(F.col("y").cast("long") * n) / area).alias("cy"), area.alias("area"))
    return masks.groupBy(*keys).agg(
        F.min("x").cast("double").alias("bx"), F.min("y").cast("double").alias("by_"), (F.max("x") - F.min("x")).cast("double").alias("bw"),
        (F.max("y") - F.min("y")).cast("double").alias("bh"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("area"))


def label_mask_paint(masks: DataFrame) -> DataFrame:
    """One region per pixel: the one drawn last.  More regions than a 16-bit mask can hold are an error."""
    rows = band_rows(masks, REGION)
    def paint(table: pa.Table, lines: Lines) -> Iterator[pa.RecordBatch]:
        rank = ranked(table.column("region_id"))[lines.row]
        a, b, run = _tops(lines, rank)
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != b[:-1]) | (rank[run[1:]] != rank[run[:-1]])
        first = np.flatnonzero(fresh)
        begin, runs = lines.runs(a[first], b[np.r_[first[1:] - 1, len(b) - 1]] if len(b) else b)
        yield _picked(table, ["image_id"], begin, runs, {"region_id": lines.row[run[first]]}, schema)

    schema = _run_schema(rows, ["image_id"], ["region_id"])
    painted = by_band(known_group(rows, ["image_id"]), ["image_id"], schema, paint)
    # Regions are counted only in images whose rows are more than that, which are at most one in MAX_REGIONS rows, so these lists are broadcast.
    full = cut_lineage(rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MAX_REGIONS).select("image_id"))
    if full.isEmpty():
        return _like(masks, painted)
    many = join_on(rows.select(*REGION), F.broadcast(full), ["image_id"], "left_semi").distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MAX_REGIONS)
    kind = dict(masks.dtypes)["region_id"]
    problem = F.raise_error(F.concat(F.lit("too many regions in image "), F.col("image_id").cast("string")))
    checked = join_on(painted, F.broadcast(many), ["image_id"], "left").withColumn(
        "region_id", F.when(F.col("_n").isNotNull(), problem.cast(kind)).otherwise(F.col("region_id"))).drop("_n")
    return _like(masks, checked)


def _tops(lines: Lines, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces that any run covers, from a to b, each with the run of the highest rank over it."""
    cuts, piece, run = lines.pieces()
    order = np.lexsort((rank[run], piece))
    piece, run = piece[order], run[order]
    last = np.ones(len(piece), bool)
    last[:-1] = piece[1:] != piece[:-1]
    return cuts[piece[last]], cuts[piece[last] + 1] if len(piece) else cuts[:0], run[last]


def _taken(table: pa.Table, name: str, at: np.ndarray) -> pa.Array:
    taken = table.column(name).take(pa.array(at, pa.int64()))
    return taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken


def _picked(table: pa.Table, keys: Sequence[str], begin: np.ndarray, columns: Sequence[pa.Array], others: dict[str, np.ndarray], schema: StructType) -> pa.RecordBatch:
    """Rows with the keys of the rows `begin`, the columns, and those of `others` from the rows given for each."""
    return pa.RecordBatch.from_arrays([*[_taken(table, k, begin) for k in keys], *columns, *[_taken(table, c, at) for c, at in others.items()]], schema.names)


def compound_union(masks: DataFrame, group: Sequence[str] = ("label", "image_id")) -> DataFrame:
    """What any mask of the group covers."""
    return _like(masks, union_spans(as_spans(masks, [*group, "region_id"]), group))


def _banded_sizes(rows: DataFrame, region: Sequence[str]) -> DataFrame:
    """Area of each region and the first and last of its bands."""
    return rows.groupBy(*region).agg(F.sum("n").alias("area"), F.min("band").alias("_b0"), F.max("band").alias("_b1"))


def compound_subtract_inner(masks: DataFrame, group: Sequence[str] = ("label", "image_id")) -> DataFrame:
    """What the largest mask of each group covers and no other mask of the group does."""
    group = list(group)
    region = [*group, "region_id"]
    rows = known_group(band_rows(masks, region), group)
    first = F.min(F.struct((-F.col("area")).alias("a"), "region_id", "_b0", "_b1")).alias("_t")
    top = _banded_sizes(rows, region).groupBy(*group).agg(first).select(*group, "_t.region_id", F.explode(F.sequence("_t._b0", "_t._b1")).alias("band"), F.lit(True).alias("_top"))
    schema = _run_schema(rows, group)

    def alone(table: pa.Table, lines: Lines) -> Iterator[pa.RecordBatch]:
        band = np.zeros(table.num_rows, np.int64)
        band[lines.turn] = 1
        code = np.cumsum(band) * (table.num_rows + 2) + ranked(table.column("region_id"))
        tops = code[np.flatnonzero(table.column("_top").is_valid().to_numpy())]
        inner = np.isin(code, tops)[lines.row]
        cuts, piece, run = lines.pieces()
        others = np.bincount(piece, ~inner[run], len(cuts))
        own = np.unique(piece[inner[run]])
        own = own[others[own] == 0]
        begin, runs = lines.runs(*joined(cuts[own], cuts[own + 1] if len(own) else cuts[:0]))
        yield _picked(table, group, begin, runs, {}, schema)

    return _like(masks, by_band(rows.unionByName(top, allowMissingColumns=True), group, schema, alone))


def compound_auto(masks: DataFrame, group: Sequence[str] = ("label", "image_id"), inside: float = 0.8) -> DataFrame:
    """By falling area (ties by id): a mask more than `inside` within the compound is cut out of it, any other is added.

    The last mask in that order over a pixel says whether the compound has it.  So what a mask finds of the compound is told by the masks right
    under it, pixel by pixel: their shared pixels are counted once, and masks are decided in rounds, as soon as those under them that are
    decided are enough to tell.  A round joins and adds up the open pairs only and is checkpointed.  Masks that share no pixel are added as they are:
    only the others are decided, and what is decided goes to the bands of each as a row without runs.
    """
    group = list(group)
    region = [*group, "region_id"]
    rows = known_group(band_rows(masks, region), region)
    regions = ArrayType(rows.schema["region_id"].dataType)
    stack_schema = StructType([*[rows.schema[k] for k in group], StructField("_stack", regions), StructField("_n", LongType())])

    def stacked(table: pa.Table, lines: Lines) -> Iterator[pa.RecordBatch]:
        """The regions over a pixel, where they are two or more, and how many pixels they share in a band."""
        rank = ranked(table.column("region_id"))[lines.row]
        cuts, piece, run = lines.pieces()
        order = np.lexsort((rank[run], piece))
        piece, run = piece[order], run[order]
        fresh = np.ones(len(piece), bool)
        fresh[1:] = (piece[1:] != piece[:-1]) | (rank[run[1:]] != rank[run[:-1]])
        piece, run = piece[fresh], run[fresh]
        many = np.bincount(piece, minlength=len(cuts))
        shared = many[piece] > 1
        piece, run = piece[shared], run[shared]
        found: dict[tuple, int] = {}
        starts = np.flatnonzero(np.diff(piece, prepend=-1))
        wide = (cuts[piece[starts] + 1] - cuts[piece[starts]]).tolist() if len(starts) else []
        band = (lines.a[run] // lines.width // BAND).tolist()
        names = rank[run].tolist()
        for i, (lo, hi) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(piece)])):
            key = (band[lo], *names[lo:hi])
            found[key] = found.get(key, 0) + wide[i]
        if found:
            row_of = np.zeros(int(rank.max()) + 1, np.int64)
            row_of[rank] = lines.row
            flat = _taken(table, "region_id", row_of[[r for key in found for r in key[1:]]])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(key) - 1 for key in found]]).astype(np.int32)), flat)
            yield _picked(table, group, lines.turn[[key[0] for key in found]], [lists, pa.array(list(found.values()), pa.int64())], {}, stack_schema)

    stacks = cut_lineage(by_band(rows, group, stack_schema, stacked).groupBy(*group, "_stack").agg(F.sum("_n").alias("_n")))
    meeting = stacks.select(*group, F.explode("_stack").alias("region_id")).distinct()
    sizes = cut_lineage(join_on(_banded_sizes(rows, region), meeting, region, "left_semi"))
    flat = stacks.select(*group, "_stack", "_n", F.explode("_stack").alias("region_id"))
    ordered = join_on(flat, sizes.select(*region, "area"), region).groupBy(*group, "_stack", "_n").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("_o"), "region_id"))).alias("_s"))
    over = ordered.select(*group, "_n", "_s", F.explode(F.sequence(F.lit(1), F.size("_s") - 1)).alias("_i")).select(
        *group, F.get("_s", F.col("_i"))["region_id"].alias("region_id"), (-F.get("_s", F.col("_i"))["_o"]).alias("area"), F.get("_s", F.col("_i") - 1)["region_id"].alias("_under"), "_n")
    open_ = cut_lineage(over.groupBy(*region, "area", "_under").agg(F.sum("_n").alias("_n")).withColumn("_found", F.lit(0).cast("long")))
    fresh = join_on(sizes.select(*region), open_.select(*region).distinct(), region, "left_anti").withColumn("added", F.lit(True))
    settled = [cut_lineage(fresh)]
    while not open_.isEmpty():
        known = settled[-1].select(*group, F.col("region_id").alias("_under"), F.col("added").alias("_added"))
        told = join_on(open_, known, [*group, "_under"], "left")
        sums = told.groupBy(*region, "area").agg(
            (F.first("_found") + F.sum(F.when(F.col("_added"), F.col("_n")).otherwise(0))).alias("_sure"),
            F.sum(F.when(F.col("_added").isNull(), F.col("_n")).otherwise(0)).alias("_open"))
        cut, added = F.col("_sure") / F.col("area") > inside, (F.col("_sure") + F.col("_open")) / F.col("area") <= inside
        judged = cut_lineage(sums.withColumn("added", F.when(cut, False).when(added, True)))
        settled.append(cut_lineage(judged.where("added IS NOT NULL").select(*region, "added")))
        left = judged.where("added IS NULL").select(*region, "_sure")
        open_ = cut_lineage(join_on(told.where("_added IS NULL").drop("_added", "_found"), left, region).withColumnRenamed("_sure", "_found").select(*open_.columns))
    decided = settled[0]
    for part in settled[1:]:
        decided = decided.unionByName(part)
    known = join_on(sizes, decided, region).select(*region, F.explode(F.sequence("_b0", "_b1")).alias("band"), F.col("area").alias("_area"), F.col("added").alias("_added"))
    schema = _run_schema(rows, group)

    def shown(table: pa.Table, lines: Lines) -> Iterator[pa.RecordBatch]:
        band = np.zeros(table.num_rows, np.int64)
        band[lines.turn] = 1
        rank = ranked(table.column("region_id"))
        code = np.cumsum(band) * (table.num_rows + 2) + rank
        told = np.flatnonzero(table.column("_added").is_valid().to_numpy())
        told = told[np.argsort(code[told], kind="stable")]
        at = np.searchsorted(code[told], code)
        if len(told):
            meets = code[told[np.minimum(at, len(told) - 1)]] == code
            of = told[np.minimum(at, len(told) - 1)]
            area = np.where(meets, table.column("_area").fill_null(0).to_numpy()[of], 0)
            added = ~meets | table.column("_added").fill_null(False).to_numpy(zero_copy_only=False)[of].astype(bool)
        else:
            area, added = np.zeros(table.num_rows, np.int64), np.ones(table.num_rows, bool)
        # The last by falling area and id; masks that nothing was told of meet nobody.
        place = np.empty(table.num_rows, np.int64)
        place[np.lexsort((rank, -area))] = np.arange(table.num_rows)
        a, b, run = _tops(lines, place[lines.row])
        kept = added[lines.row[run]]
        begin, runs = lines.runs(*joined(a[kept], b[kept]))
        yield _picked(table, group, begin, runs, {}, schema)

    return _like(masks, by_band(rows.unionByName(known, allowMissingColumns=True), group, schema, shown))


def _overlaps(rows: DataFrame, group: Sequence[str] = ("image_id",), region: str = "region_id") -> DataFrame:
    """Shared pixels (group, a, b, inter) of each pair of regions that share any, a before b; copies of a mask count as often as they come."""
    group = list(group)
    kind = rows.schema[region].dataType
    schema = StructType([*[rows.schema[k] for k in group], StructField("a", kind), StructField("b", kind), StructField("inter", LongType())])

    def meet(table: pa.Table, lines: Lines) -> Iterator[pa.RecordBatch]:
        rank = ranked(table.column(region))
        for first, second in lines.met():
            inter = np.minimum(lines.b[first], lines.b[second]) - np.maximum(lines.a[first], lines.a[second])
            i, j = lines.row[first], lines.row[second]
            i, j = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
            apart = rank[i] != rank[j]
            i, j, inter = i[apart], j[apart], inter[apart]
            code, back = np.unique(i * table.num_rows + j, return_inverse=True)
            i, j = code // table.num_rows, code % table.num_rows
            shared = pa.array(np.bincount(back, inter, len(code)).astype(np.int64))
            yield _picked(table, group, i, [_taken(table, region, i), _taken(table, region, j), shared], {}, schema)

    return by_band(known_group(rows, [*group, region]), group, schema, meet).groupBy(*group, "a", "b").agg(F.sum("inter").alias("inter"))


def mask_iou(masks: DataFrame) -> DataFrame:
    """Overlap ratio of each pair of masks of an image that share a pixel."""
    rows = band_rows(masks, REGION)
    shared = _overlaps(rows)
    area = mask_area(rows)
    na = area.select("image_id", F.col("region_id").alias("a"), F.col("area").alias("_na"))
    nb = area.select("image_id", F.col("region_id").alias("b"), F.col("area").alias("_nb"))
    out = join_on(join_on(shared, na, ["image_id", "a"]), nb, ["image_id", "b"])
    return out.select("image_id", "a", "b", (F.col("inter") / (F.col("_na") + F.col("_nb") - F.col("inter"))).alias("iou"))


def mask_nms(masks: DataFrame, scores: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Greedy suppression in falling score order (ties by id, null scores last): a mask goes when a kept one overlaps it too much.

    In a round, masks that no open rival beats stand, those they beat go, and what these had beaten is freed; only conflicts that are
    still open enter the next round, which is checkpointed.
    """
    ordered = scores.select("image_id", "region_id", F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))).alias("score"))
    pairs = mask_iou(masks).where(F.col("iou") > threshold).select("image_id", "a", "b")
    pairs = cut_lineage(pairs)
    ends = pairs.select("image_id", F.explode(F.array("a", "b")).alias("region_id")).distinct()
    scored = cut_lineage(join_on(ordered, ends, REGION, "left_semi"))
    for end in ("a", "b"):
        pairs = join_on(pairs, scored.select("image_id", F.col("region_id").alias(end), F.col("score").alias(f"_s{end}")), ["image_id", end])
    first = (F.col("_sa") > F.col("_sb")) | ((F.col("_sa") == F.col("_sb")) & (F.col("a") < F.col("b")))
    beats = cut_lineage(pairs.select("image_id", F.when(first, F.col("a")).otherwise(F.col("b")).alias("hi"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("lo")))
    gone = []
    while not beats.isEmpty():
        stand = join_on(beats.select("image_id", "hi").distinct(), beats.select("image_id", F.col("lo").alias("hi")).distinct(), ["image_id", "hi"], "left_anti")
        gone.append(cut_lineage(join_on(beats, stand, ["image_id", "hi"], "left_semi").select("image_id", F.col("lo").alias("region_id")).distinct()))
        out = gone[-1]
        left = join_on(beats, out.withColumnRenamed("region_id", "lo"), ["image_id", "lo"], "left_anti")
        beats = cut_lineage(join_on(left, out.withColumnRenamed("region_id", "hi"), ["image_id", "hi"], "left_anti"))
    kept = scores.select("image_id", "region_id")
    return join_on(kept, reduce(DataFrame.unionByName, gone), REGION, "left_anti") if gone else kept


def outside_all_masks(tiles: DataFrame, masks: DataFrame) -> DataFrame:
    """Pixels of each tile (image_id, height, width) that no mask covers."""
    grid = (tiles.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
            .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).select(*PIXEL))
    return join_on(grid, masks.select(*PIXEL), PIXEL, "left_anti")


def column_runs(masks: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Vertical runs (keys, x, y0, n) of each region."""
    return column_spans(as_spans(masks, keys), keys)


def rle_encode(masks: DataFrame, shape: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Column-major run lengths of each region, starting with a zero run; `shape` gives height and width per image.

    Vertical runs that meet at the bottom of one column and the top of the next are joined; a result row only gathers its runs.
    """
    keys = list(keys)
    runs = join_on(column_runs(masks, keys), shape.select("image_id", "height", "width"), ["image_id"])
    begin = F.col("x").cast("bigint") * F.col("height") + F.col("y0")
    placed = runs.select(*keys, "height", "width", begin.alias("s"), (begin + F.col("n")).alias("e"))
    order = Window.partitionBy(*keys).orderBy("s")
    before = F.coalesce(F.lag("e").over(order), F.lit(-1).cast("bigint"))
    fresh = placed.withColumn("_new", (F.col("s") != before).cast("int"))
    joined = (fresh.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy(*keys, "height", "width", "_run").agg(F.min("s").alias("s"), F.max("e").alias("e")))
    gaps = joined.withColumn("_gap", F.col("s") - F.coalesce(F.lag("e").over(order), F.lit(0).cast("bigint")))
    lists = gaps.groupBy(*keys, "height", "width").agg(F.max("e").alias("_end"), F.array_sort(F.collect_list(F.struct("s", "_gap", (F.col("e") - F.col("s")).alias("_n")))).alias("_r"))
    counts = F.flatten(F.transform("_r", lambda r: F.array(r["_gap"], r["_n"])))
    rest = F.col("height").cast("bigint") * F.col("width") - F.col("_end")
    return lists.select(*keys, "height", "width", F.when(rest > 0, F.concat(counts, F.array(rest))).otherwise(counts).alias("counts"))


def connected_regions(foreground: DataFrame, connectivity: int = 4, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Label the connected regions of foreground pixels (keys, y, x); `region_id` ascends with their first pixel.

    Pixels are joined into horizontal runs first, so only runs and their contacts enter the component search.
    """
    keys = list(keys)
    line = Window.partitionBy(*keys, "y").orderBy("x")
    fresh = F.coalesce(F.col("x") - F.lag("x").over(line) > 1, F.lit(True))
    start = F.last("_f", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    runs = (foreground.select(*keys, "y", "x").distinct().withColumn("_f", F.when(fresh, F.col("x"))).withColumn("_s", start)
            .select(*keys, "y", "x", (F.col("y").cast("bigint") * (1 << 31) + F.col("_s")).alias("node")))
    touch = [0] if connectivity == 4 else [-1, 0, 1]
    below = runs.select(*keys, (F.col("y") - 1).alias("y"), F.col("x").alias("_x"), F.explode(F.lit(touch)).alias("_o"), F.col("node").alias("dst")
                        ).select(*keys, "y", (F.col("_x") + F.col("_o")).alias("x"), "dst")
    edges = join_on(runs.withColumnRenamed("node", "src"), below, [*keys, "y", "x"]).select(*keys, "src", "dst").distinct()
    labels = connected_components(runs.select(*keys, "node").distinct(), edges, keys)
    return join_on(runs, labels, [*keys, "node"]).select(*keys, F.col("component").alias("region_id"), "y", "x")


def mask_to_regions(coloured: DataFrame, names: DataFrame, min_area: int = 9) -> DataFrame:
    """Coloured mask to labelled 8-connected regions; colours without a label are skipped."""
    labelled = coloured.join(names.where(F.trim("label") != ""), ["r", "g", "b"]).select("image_id", "label", "y", "x")
    return filter_min_area(connected_regions(labelled, 8, ["image_id", "label"]), min_area, ["image_id", "label", "region_id"])


def mask_colour_counts(coloured: DataFrame, dark: int = 15) -> DataFrame:
    """Pixels per colour, leaving out colours with all channels under `dark`."""
    bright = (F.col("r") >= dark) | (F.col("g") >= dark) | (F.col("b") >= dark)
    return coloured.where(bright).groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


def _semantic_spans(annotations: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Class per run (keys, y, xa, xb, class_index), the later annotation (`ann_order`) on top.

    Annotations carry `class_index` and either an outline of at least three vertices or a box bx, by_, bw, bh.
    """
    keys = list(keys)
    named = annotations.where(F.col("class_index") > 0)
    what = [*keys, "ann_order", "class_index"]
    drawn = outline_bands(named.where(F.size("vertices") >= 3), what)
    boxes = named.where(F.coalesce(F.size("vertices"), F.lit(0)) < 3)
    x0, y0, w, h = (F.col(c).cast("int") for c in ("bx", "by_", "bw", "bh"))
    corners = [F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x0 + w, y0), (x0 + w, y0 + h), (x0, y0 + h))]
    filled = outline_bands(boxes.where((w > 0) & (h > 0) & x0.isNotNull()).select(*what, F.array(*corners).alias("vertices")), what)
    rows = drawn.unionByName(filled).withColumn("class_index", F.when(F.col("ann_order").isNotNull(), F.col("class_index")))
    schema = _run_schema(rows, keys, ["class_index"])

    def paint(table: pa.Table, lines: Lines) -> Iterator[pa.RecordBatch]:
        rank = ranked(table.column("ann_order"))[lines.row]
        a, b, run = _tops(lines, rank)
        begin, runs = lines.runs(a, b)
        yield _picked(table, keys, begin, runs, {"class_index": lines.row[run]}, schema)

    return by_band(rows, keys, schema, paint)


def semantic_mask(annotations: DataFrame, keys: Sequence[str] = ("image_id",), as_runs: bool = False) -> DataFrame:
    """Class per pixel (keys, y, x, class_index), or per run with xa and xb in place of x."""
    found = _semantic_spans(annotations, keys)
    return found if as_runs else span_pixels(found).select(*keys, "y", "x", "class_index")
