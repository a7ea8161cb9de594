"""Masks as horizontal runs: rows (keys, y, xa, xb) that cover the pixels xa to xb - 1 of a line.

Outlines become runs in one vectorised step.  Runs are clipped at a grid of 64 columns, which gives joins a key and keeps
the cut points of a line's cell in the bits of one number; set operations cut the runs of a cell at each other's ends, so that
two pieces are the same or apart, and aggregate on the piece.  A pixel is never a row.

Where only bands of BAND lines have to meet, a mask moves as one row per band that holds its runs (`band_rows`), and the runs of many bands are
swept together in their task (`by_band`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from mesograph.operators.ordering import join_on

REGION = ["image_id", "region_id"]
CELL = 64
BAND = 64
CROSSINGS_TOGETHER = 1_000_000


def outline_runs(x: np.ndarray, y: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(outline, y, xa, xb) of outlines whose vertices end at `ends`, by the even-odd rule at pixel positions."""
    if not len(x):
        return (np.zeros(0, np.int64),) * 4
    size = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(len(ends)), size)
    after = np.arange(1, len(x) + 1)
    after[ends[size > 0] - 1] = (ends - size)[size > 0]
    x1, y1 = x[after], y[after]
    low, high = np.ceil(np.minimum(y, y1)), np.ceil(np.maximum(y, y1))
    lines = (high - low).astype(np.int64)
    edge = np.repeat(np.arange(len(x)), lines)
    line = low[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(lines) - lines, lines)
    at = x[edge] + (line - y[edge]) * (x1[edge] - x[edge]) / (y1[edge] - y[edge])
    order = np.lexsort((at, line, owner[edge]))
    at = np.ceil(at[order])
    xa, xb, first = at[0::2], at[1::2], order[0::2]  # an outline crosses each line an even number of times
    kept = xa < xb
    return owner[edge[first]][kept], line[first][kept], xa[kept], xb[kept]


def _outline_batches(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of outlines (keys, vertices) with (row, y, xa, xb) of the runs inside them, sorted."""
    for batch in batches:
        lists = batch.column(n_keys)
        ends = np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()
        corners = lists.flatten()
        x, y = (corners.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y"))
        good = np.isfinite(x) & np.isfinite(y)
        size = np.diff(ends, prepend=0)
        sums = np.r_[0, np.cumsum(good)]
        rows = np.flatnonzero(sums[ends] - sums[ends - size] == size)
        # Outlines of about so many crossings together.
        heights = np.r_[0.0, np.cumsum(np.nan_to_num(np.abs(np.diff(y, append=y[-1:]))))]
        cost = (heights[ends] - heights[ends - size] + size)[rows]
        for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(cost) // CROSSINGS_TOGETHER)) + 1):
            if not len(part):
                continue
            inside = np.concatenate([np.arange(ends[r] - size[r], ends[r]) for r in part]) if len(part) < len(rows) or len(rows) < len(size) else slice(None)
            owner, line, xa, xb = outline_runs(x[inside], y[inside], np.cumsum(size[part]))
            yield batch, part[owner], line, xa, xb


def outline_spans(rois: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Runs (keys, y, xa, xb) inside each outline (keys, vertices) by the even-odd rule.

    Outlines with fewer than three vertices, and those with a vertex that is null or not finite, cover nothing.
    """
    keys = list(keys)
    outlines = rois.select(*keys, "vertices").where(F.size("vertices") >= 3)
    schema = StructType([*[rois.schema[k] for k in keys], *[StructField(c, IntegerType()) for c in ("y", "xa", "xb")]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, line, xa, xb in _outline_batches(batches, len(keys)):
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(taken) for i in range(len(keys))], *[pa.array(c.astype(np.int32)) for c in (line, xa, xb)]], schema.names)

    return outlines.mapInArrow(scan, schema)


def pixel_spans(masks: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Runs of mask pixels (keys, y, x)."""
    keys = list(keys)
    line = Window.partitionBy(*keys, "y").orderBy("x")
    fresh = F.coalesce(F.col("x") - F.lag("x").over(line) > 1, F.lit(True))
    start = F.last("_f", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    marked = masks.select(*keys, "y", "x").distinct().withColumn("_f", F.when(fresh, F.col("x"))).withColumn("xa", start)
    return marked.groupBy(*keys, "y", "xa").agg((F.max("x") + 1).alias("xb"))


def as_spans(masks: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Masks given as runs, or as pixels."""
    return masks if "xa" in masks.columns else pixel_spans(masks, keys)


def span_pixels(spans: DataFrame) -> DataFrame:
    """Pixels (other columns, y, x) of runs."""
    rest = [c for c in spans.columns if c not in ("xa", "xb")]
    return spans.select(*rest, F.explode(F.sequence("xa", F.col("xb") - 1)).alias("x"))


def packed_runs(masks: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """One row per key with all runs of a mask, given as runs or as pixels: `runs` holds y, xa, xb of each, `y0` to `y1` and `x0` to `x1` are its box.

    Runs of a key that come in one batch are put together before they are moved, so a mask is moved as one row; pixels side by side become a run.
    Runs that come twice stay twice.
    """
    keys = list(keys)
    ends = ("xa", "xb") if "xa" in masks.columns else ("x", "x")
    rows = masks.select(*keys, *[F.col(c).cast("long").alias(f"_{i}") for i, c in enumerate(("y", *ends))]).where("_0 IS NOT NULL AND _1 IS NOT NULL AND _2 IS NOT NULL")
    if ends[0] == "x":
        rows = rows.withColumn("_2", F.col("_2") + 1)
    schema = StructType([*[masks.schema[k] for k in keys], StructField("_r", ArrayType(LongType()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [pc.dictionary_encode(batch.column(i), null_encoding="encode").indices.to_numpy(zero_copy_only=False) for i in range(len(keys))]
            y, xa, xb = (batch.column(len(keys) + i).to_numpy() for i in range(3))
            order = np.lexsort((xa, y, *codes[::-1]))
            y, xa, xb = y[order], xa[order], xb[order]
            fresh = np.zeros(batch.num_rows, bool)
            fresh[0] = True
            for code in codes:
                fresh[1:] |= code[order][1:] != code[order][:-1]
            begins = fresh.copy()
            begins[1:] |= (y[1:] != y[:-1]) | (xa[1:] != xb[:-1])
            begins = np.flatnonzero(begins)
            first = np.flatnonzero(fresh[begins])
            runs = np.column_stack([y[begins], xa[begins], xb[np.r_[begins[1:] - 1, len(y) - 1]]]).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(begins)].astype(np.int32) * 3), pa.array(runs))
            taken = pa.array(order[begins[first]])
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(taken) for i in range(len(keys))], lists], schema.names)

    whole = rows.mapInArrow(pack, schema).groupBy(*keys).agg(F.flatten(F.collect_list("_r")).alias("runs"))

    def part(i: int, best) -> Column:
        return best(F.filter("runs", lambda _, k: k % 3 == i))

    return whole.withColumns({"y0": part(0, F.array_min), "y1": part(0, F.array_max), "x0": part(1, F.array_min), "x1": part(2, F.array_max) - 1})


def unpacked_runs(packed: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Runs (keys, y, xa, xb) of masks packed by `packed_runs`, with those that overlap put together."""
    three = F.transform(F.sequence(F.lit(0), F.size("runs") - 1, F.lit(3)), lambda k: F.struct(*[F.get("runs", k + i).cast("int").alias(c) for i, c in enumerate(("y", "xa", "xb"))]))
    return union_spans(packed.select(*keys, F.explode(three).alias("_q")).select(*keys, "_q.*"), keys)


def unpacked_pixels(packed: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Pixels (keys, y, x) of masks packed by `packed_runs`."""
    three = F.transform(F.sequence(F.lit(0), F.size("runs") - 1, F.lit(3)), lambda k: F.struct(*[F.get("runs", k + i).alias(c) for i, c in enumerate(("y", "xa", "xb"))]))
    return span_pixels(packed.select(*keys, F.explode(three).alias("_q")).select(*keys, "_q.*"))


# ---- bands

def _in_bands(batch: pa.RecordBatch, n_keys: int, row: np.ndarray, y: np.ndarray, xa: np.ndarray, xb: np.ndarray, names: Sequence[str]) -> pa.RecordBatch:
    """Rows (keys, band, n, runs) of runs that are sorted by row and line; `runs` holds y, xa and length of the first run as 32-bit numbers, then differences."""
    y, xa, xb = (c.astype(np.int64) for c in (y, xa, xb))
    band = y // BAND
    fresh = np.ones(len(y), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (band[1:] != band[:-1])
    first = np.flatnonzero(fresh)
    told = np.column_stack([y, xa, xb - xa])
    steps = np.diff(told, axis=0, prepend=told[:1])
    steps[first] = told[first]
    ends = np.r_[first, len(y)].astype(np.int32) * 12
    held = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(steps.astype("<i4").tobytes())])
    area = np.add.reduceat(xb - xa, first) if len(first) else np.zeros(0, np.int64)
    taken = pa.array(row[first])
    return pa.RecordBatch.from_arrays([*[batch.column(i).take(taken) for i in range(n_keys)], pa.array(band[first].astype(np.int32)), pa.array(area), held], names)


def _band_schema(masks: DataFrame, keys: Sequence[str]) -> StructType:
    return StructType([*[masks.schema[k] for k in keys], StructField("band", IntegerType()), StructField("n", LongType()), StructField("runs", BinaryType())])


def outline_bands(rois: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """The runs of `outline_spans` as one row (keys, band, n, runs) per outline and band of BAND lines; `n` is the number of their pixels."""
    keys = list(keys)
    schema = _band_schema(rois, keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, *runs in _outline_batches(batches, len(keys)):
            yield _in_bands(batch, len(keys), *runs, schema.names)

    return rois.select(*keys, "vertices").where(F.size("vertices") >= 3).mapInArrow(scan, schema)


def band_rows(masks: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Masks given as runs, as pixels or in bands as rows (keys, band, n, runs).  Runs of a key that come in one batch are put together; those that come twice stay twice."""
    keys = list(keys)
    if "band" in masks.columns:
        return masks.select(*keys, "band", "n", "runs")
    schema = _band_schema(masks, keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [pc.dictionary_encode(batch.column(i), null_encoding="encode").indices.to_numpy(zero_copy_only=False) for i in range(len(keys))]
            y, xa, xb = (batch.column(len(keys) + i).to_numpy() for i in range(3))
            order = np.lexsort((xa, y, *codes[::-1]))
            fresh = np.ones(len(order), bool)
            fresh[1:] = False
            for code in codes:
                fresh[1:] |= code[order][1:] != code[order][:-1]
            row = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            yield _in_bands(batch, len(keys), row, y[order], xa[order], xb[order], schema.names)

    rows = as_spans(masks, keys).select(*keys, *[F.col(c).cast("int").alias(c) for c in ("y", "xa", "xb")])
    return rows.where("y IS NOT NULL AND xa IS NOT NULL AND xb IS NOT NULL").mapInArrow(pack, schema)


def _unbanded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, y, xa, xb) of the runs in a column `runs`."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] // 4
    told = np.frombuffer(column.buffers()[2] or b"", "<i4")[at[0]:at[-1]].reshape(-1, 3).astype(np.int64)
    size = np.diff(at) // 3
    sums = np.cumsum(told, axis=0)
    begins = (at[:-1] - at[0]) // 3
    before = np.vstack([np.zeros((1, 3), np.int64), sums])[begins]
    row = np.repeat(np.arange(len(size)), size)
    y, xa, length = (sums - before[row]).T
    return row, y, xa, xa + length


def band_spans(rows: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Runs (keys, y, xa, xb) of masks in bands."""
    keys = list(keys)
    schema = StructType([*[rows.schema[k] for k in keys], *[StructField(c, IntegerType()) for c in ("y", "xa", "xb")]])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, *runs = _unbanded(batch.column(len(keys)))
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(taken) for i in range(len(keys))], *[pa.array(c.astype(np.int32)) for c in runs]], schema.names)

    return rows.select(*keys, "runs").mapInArrow(unpack, schema)


class Lines:
    """The runs of some whole bands, laid out one line after the other on one axis: run i goes from `a[i]` to `b[i]` and is of row `row[i]`."""

    def __init__(self, table: pa.Table, turn: np.ndarray):
        self.band = table.column("band").to_numpy()[turn]
        group = np.zeros(table.num_rows, np.int64)
        group[turn] = 1
        group = np.cumsum(group) - 1
        self.turn = turn
        self.row, y, xa, xb = _unbanded(table.column("runs").combine_chunks() if table.column("runs").num_chunks != 1 else table.column("runs").chunk(0))
        kept = xa < xb
        self.row, y, xa, xb = self.row[kept], y[kept], xa[kept], xb[kept]
        self.low = int(xa.min(initial=0))
        self.width = int(xb.max(initial=0)) - self.low + 1
        line = group[self.row] * BAND + y - self.band[group[self.row]].astype(np.int64) * BAND
        self.a, self.b = line * self.width + xa - self.low, line * self.width + xb - self.low

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cut points of the axis, and for each run over a piece between two of them the piece and the run, piece after piece."""
        cuts = np.unique(np.concatenate([self.a, self.b]))
        low, high = np.searchsorted(cuts, self.a), np.searchsorted(cuts, self.b)
        run = np.repeat(np.arange(len(low)), high - low)
        piece = np.arange(len(run)) - np.repeat(np.cumsum(high - low) - (high - low) - low, high - low)
        order = np.argsort(piece, kind="stable")
        return cuts, piece[order], run[order]

    def met(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of runs that share a pixel, some millions at a time."""
        order = np.argsort(self.a, kind="stable")
        a, b = self.a[order], self.b[order]
        many = np.searchsorted(a, b) - np.arange(1, len(a) + 1)
        for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(many) // CROSSINGS_TOGETHER)) + 1):
            first = np.repeat(part, many[part])
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
            yield order[first], order[second]

    def runs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        """First row of the band, and y, xa, xb, of places on the axis."""
        line, x = a // self.width, a % self.width + self.low
        group = line // BAND
        return self.turn[group], [pa.array(c.astype(np.int32)) for c in (self.band[group].astype(np.int64) * BAND + line % BAND, x, x + b - a)]


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches that follow each other, sorted and apart, with those that touch made one."""
    fresh = np.ones(len(a), bool)
    fresh[1:] = a[1:] != b[:-1]
    return a[fresh], b[np.r_[np.flatnonzero(fresh)[1:] - 1, len(b) - 1]] if len(b) else b


def by_band(rows: DataFrame, group: Sequence[str], schema: StructType, step: Callable[[pa.Table, Lines], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What `step` makes of whole bands (group, band) of rows with `runs`, many bands at a time: a shuffle and a sort bring the rows of a band together.

    A row without runs may tell something about a region of its band.
    """
    keys = [*group, "band"]
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(pieces: list[pa.RecordBatch], turn: np.ndarray) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(pieces)
            yield from step(table, Lines(table, turn))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.zeros(batch.num_rows, bool)
            fresh[0] = not held or any(held[-1].column(names.index(k))[-1].as_py() != batch.column(names.index(k))[0].as_py() for k in keys)
            for k in keys:
                code = pc.dictionary_encode(batch.column(names.index(k)), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                fresh[1:] |= code[1:] != code[:-1]
            turn = np.flatnonzero(fresh)
            if not len(turn):
                held.append(batch)
                continue
            if held and turn[0] >= 0:
                yield from told([*held, batch.slice(0, turn[0])], np.zeros(1, np.int64))
            if len(turn) > 1:
                yield from told([batch.slice(turn[0], turn[-1] - turn[0])], turn[:-1] - turn[0])
            held = [batch.slice(turn[-1])]
        if held:
            yield from told(held, np.zeros(1, np.int64))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def known_group(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    return rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in group))


def ranked(ids: pa.ChunkedArray) -> np.ndarray:
    """Position of each id in the order of the ids, the same for the same id; null first."""
    return pc.rank(ids, tiebreaker="dense", null_placement="at_start").to_numpy().astype(np.int64)


def span_area(spans: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Pixels of each region, whose own runs don't overlap."""
    return spans.groupBy(*keys).agg(F.sum(F.col("xb") - F.col("xa")).alias("area"))


def celled(spans: DataFrame) -> DataFrame:
    """Runs clipped to cells of 64 columns, with the cell as column `cell`."""
    first, last = F.floor(F.col("xa") / CELL).cast("int"), F.floor((F.col("xb") - 1) / CELL).cast("int")
    cells = F.when(first == last, F.array(first)).otherwise(F.sequence(first, last))
    return spans.withColumn("cell", F.explode(cells)).withColumns(
        {"xa": F.greatest("xa", F.col("cell") * CELL), "xb": F.least("xb", (F.col("cell") + 1) * CELL)})


def layers(spans: DataFrame, group: Sequence[str]) -> DataFrame:
    """Runs cut where another run of the same group and line begins or ends: two pieces cover the same pixels or none in common.

    The cut points of a cell are bits of one number; a crowded cell costs its pieces, not its pairs.  Runs are moved once, to the task of their
    line, and what follows by group and line (unions, the top piece) finds them there.
    """
    group = list(group)
    clipped = celled(spans.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*group, "y"))).repartition(*group, "y"))
    base = F.col("cell") * CELL

    def bit(x):
        return F.when((x >= base) & (x < base + CELL), F.call_function("shiftleft", F.lit(1).cast("long"), (x - base).cast("int"))).otherwise(F.lit(0).cast("long"))

    def from_bit(x):  # bits at and above x, for x inside the cell
        return F.call_function("shiftleft", F.lit(-1).cast("long"), (x - base).cast("int"))

    cuts = F.bit_or(bit(F.col("xa")).bitwiseOR(bit(F.col("xb")))).over(Window.partitionBy(*group, "y", "cell"))
    below_end = F.when(F.col("xb") - base >= CELL, F.lit(-1).cast("long")).otherwise(F.bitwise_not(from_bit(F.col("xb"))))
    inner = F.col("_cuts").bitwiseAND(below_end).bitwiseAND(F.bitwise_not(bit(F.col("xa")))).bitwiseAND(from_bit(F.col("xa")))
    joined = clipped.withColumn("_cuts", cuts).withColumn("_inner", inner).drop("_cuts")
    # Most runs are not cut; the others look at each of their columns once.
    marks = F.expr(f"filter(sequence(xa, xb - 1), x -> x = xa OR getbit(_inner, x - cell * {CELL}) = 1)")
    starts = F.when(F.col("_inner") == 0, F.array("xa")).otherwise(marks)
    rest = [c for c in joined.columns if c not in ("xa", "xb", "_inner", "cell")]
    pieces = joined.withColumn("_s", starts).select(*rest, F.col("xb").alias("_end"), "_s", F.posexplode("_s").alias("_i", "xa"))
    return pieces.withColumn("xb", F.coalesce(F.get("_s", F.col("_i") + 1), F.col("_end"))).drop("_end", "_s", "_i")


def union_spans(spans: DataFrame, group: Sequence[str]) -> DataFrame:
    """Runs (group, y, xa, xb) of the pixels that any run of the group covers, as long as they go: a sweep along each line."""
    group = list(group)
    line = Window.partitionBy(*group, "y").orderBy("xa", "xb")
    reach = F.max("xb").over(line.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.select(*group, "y", "xa", "xb").withColumn("_new", F.coalesce((F.col("xa") > reach).cast("int"), F.lit(1)))
    numbered = fresh.withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "y", "_run").agg(F.min("xa").alias("xa"), F.max("xb").alias("xb")).drop("_run")


def overlap_areas(spans: DataFrame, group: Sequence[str] = ("image_id",), region: str = "region_id") -> DataFrame:
    """Shared pixels (group, a, b, inter) of each pair of regions that share any, a before b: runs joined by line and cell."""
    group = list(group)
    cells = celled(spans.select(*group, "y", "xa", "xb", region))
    a = cells.select(*group, "y", "cell", F.col(region).alias("a"), F.col("xa").alias("_a0"), F.col("xb").alias("_a1"))
    b = cells.select(*group, "y", "cell", F.col(region).alias("b"), F.col("xa").alias("_b0"), F.col("xb").alias("_b1"))
    met = join_on(a, b, [*group, "y", "cell"]).where((F.col("a") < F.col("b")) & (F.col("_a0") < F.col("_b1")) & (F.col("_b0") < F.col("_a1")))
    shared = F.least("_a1", "_b1") - F.greatest("_a0", "_b0")
    return met.groupBy(*group, "a", "b").agg(F.sum(shared).alias("inter"))


def bare_spans(spans: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """Runs of the pixels (keys, y, xa, xb) whose neighbour `step` lines before them is not in the same mask: 1 looks up, -1 down."""
    keys = list(keys)
    own = spans.select(*keys, "y", "xa", "xb")
    beside = own.withColumn("y", F.col("y") + step)
    pieces = layers(own.withColumn("_own", F.lit(True)).unionByName(beside.withColumn("_own", F.lit(False))), keys)
    return union_spans(pieces.groupBy(*keys, "y", "xa", "xb").agg(F.bool_and("_own").alias("_own")).where("_own"), keys)


def column_spans(spans: DataFrame, keys: Sequence[str] = REGION) -> DataFrame:
    """Vertical runs (keys, x, y0, n) of regions given as horizontal ones.

    A vertical run begins where the line above has no pixel and ends where the line below has none; only those ends become rows.
    """
    keys = list(keys)
    down = Window.partitionBy(*keys, "x").orderBy("y")
    begins = span_pixels(bare_spans(spans, keys, 1)).withColumn("_i", F.row_number().over(down)).withColumnRenamed("y", "y0")
    ends = span_pixels(bare_spans(spans, keys, -1)).withColumn("_i", F.row_number().over(down)).withColumnRenamed("y", "_y1")
    return join_on(begins, ends, [*keys, "x", "_i"]).select(*keys, "x", "y0", (F.col("_y1") - F.col("y0") + 1).cast("long").alias("n"))
