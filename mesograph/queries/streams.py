"""Queries over streams: tables derived from the given ones arrive in parts, each run works off what is there (`availableNow`) and goes on where the last one stopped."""

from pyspark.sql import functions as F

from mesograph.queries.annotation import AB, METRICS, RECT, sized
from mesograph.queries.registry import query
from mesograph.queries.tracking import APART, D, apart
from mesograph.session import scratch_path
from mesograph.streaming import live as V

PARTS = 5


def arriving(t, rows, part, build, name):
    """What the stream operator `build` writes when `rows` arrive in `PARTS` parts, in the order of the column expression `part`."""
    source, sink, marks = (scratch_path(t.spark, f"{name}-{kind}") for kind in ("in", "out", "marks"))
    numbered = rows.withColumn("_part", part)
    for k in range(PARTS):
        numbered.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(rows.schema).parquet(source)
        build(stream, sink).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return sink


def appended(operator):
    """A stream operator whose rows are appended to a table."""
    return lambda stream, sink: operator(stream).writeStream.format("parquet").option("path", sink).outputMode("append")


@query("stream_tracking", f"WITH {APART} SELECT sequence_id, CAST(frame AS BIGINT) AS frame, ann_idx, track_id FROM run JOIN num USING (sequence_id, user, part)", D)
def _(t):
    """Frames come cut over two parts; a closing row per sequence comes last."""
    found = apart(t).select("sequence_id", "frame", "ann_idx", "x_px", "y_px")
    last = found.groupBy("sequence_id").agg((F.max("frame") + 1).alias("frame")).select(
        "sequence_id", "frame", *[F.lit(None).cast(kind).alias(c) for c, kind in found.dtypes[2:]])
    half = F.floor((2 * F.col("frame") + F.pmod(F.xxhash64("ann_idx"), F.lit(2)) + 1) / 16)
    part = F.when(F.col("ann_idx").isNull(), PARTS - 1).otherwise(F.least(half, F.lit(PARTS - 1)))
    sink = arriving(t, found.unionByName(last), part, appended(lambda s: V.stream_tracking(s, 12.0)), "tracks")
    return t.spark.read.parquet(sink)


@query("stream_label_counts", "SELECT label, count(*) AS n FROM fx_rects GROUP BY 1", ("fx_rects",))
def _(t):
    """Every image arrives whole after a draft with half of its annotations; the drafts of every third image come late and change nothing."""
    rows = t.rects().select(F.col("image_id").alias("stem"), "label", "ann_id")
    draft = rows.where(F.pmod(F.xxhash64("ann_id"), F.lit(2)) == 0).withColumns({"changed": F.timestamp_seconds(F.lit(1000)), "_part": F.when(F.col("stem") % 3 == 0, 4).otherwise(F.col("stem") % 2)})
    whole = rows.withColumns({"changed": F.timestamp_seconds(F.lit(2000)), "_part": 2 + F.col("stem") % 2})
    both = draft.unionByName(whole).select(F.col("stem").cast("string").alias("stem"), "label", "changed", F.col("_part").alias("at"))
    sink = arriving(t, both, F.col("at"), appended(V.stream_label_counts), "labels")
    return t.spark.read.parquet(sink).groupBy("label").agg(F.sum("n").alias("n")).where("n <> 0")


@query("stream_measurements", f"SELECT CAST(image_id AS VARCHAR) AS stem, count(*) AS n, sum(area_nm2) AS area_nm2, sum(perimeter_nm) AS perimeter_nm FROM (SELECT image_id, {METRICS} FROM ({RECT})) GROUP BY 1",
       AB, {2: "area_nm2 perimeter_nm"})
def _(t):
    """Sidecars with half of an image's boxes first, then with all of them."""
    box = F.to_json(F.struct(F.lit("rectangle").alias("type"), "label", "x0", "y0", "x1", "y1"))
    rows = sized(t).select(F.col("image_id").cast("string").alias("stem"), "pixel_size_nm", "ann_id", box.alias("j"), F.explode(F.array(F.lit(0), F.lit(1))).alias("version"))
    rows = rows.where((F.col("version") == 1) | (F.pmod(F.xxhash64("ann_id"), F.lit(2)) == 0))
    texts = rows.groupBy("stem", "version", "pixel_size_nm").agg(F.array_join(F.collect_list("j"), ",").alias("l"))
    value = F.concat(F.lit('{"annotations": ['), "l", F.lit('], "pixel_size_nm": '), F.col("pixel_size_nm").cast("string"), F.lit("}"))
    sidecars = texts.select("stem", value.alias("value"), F.timestamp_seconds(1000 + F.col("version")).alias("changed"))
    target = scratch_path(t.spark, "measured")
    # The later version of every third image comes before the earlier one.
    part = F.when(F.col("stem").cast("long") % 3 == 0, 1 - F.unix_seconds("changed") % 2).otherwise(F.unix_seconds("changed") % 2) * 2
    arriving(t, sidecars, part, lambda s, sink: V.stream_measurements(s, target, f"{sink}-state"), "sidecars")
    return V.current_measurements(t.spark, target).groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.sum("area_nm2").alias("area_nm2"), F.sum("perimeter_nm").alias("perimeter_nm"))
