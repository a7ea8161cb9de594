"""Streams of newly arriving annotations: measurements, label counts and tracks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mesograph.functions.labels import file_name
from mesograph.operators.annotations import SHAPE_METRICS, measure_annotations
from mesograph.operators.tracking import link_frame
from mesograph.session import cut_lineage
from mesograph.sources.readers import parse_sidecars


def sidecar_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000, max_age: str = "36500d") -> DataFrame:
    """New sidecar files as rows (stem, value, changed); files with old dates are read too."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", max_age).text(folder, wholetext=True)
    return raw.select(F.regexp_replace(file_name(F.input_file_name()), r"(\.annotations)?\.json$", "").alias("stem"), "value",
                      F.col("_metadata.file_modification_time").alias("changed"))


def stream_measurements(sidecars: DataFrame, target: str, checkpoint: str, buckets: int = 64):
    """Measure arriving sidecars into a table dealt into buckets of the image name; the latest sidecar of an image replaces its rows.

    `changed` decides which one is the latest, in whatever order they arrive.  A sidecar without annotations leaves one row without
    an ann_idx, so that the image stays empty and an older file can't come back; `current_measurements` leaves these rows out.  Only
    buckets with images of the batch are rewritten, and a repeated batch leaves the same table.
    """
    def upsert(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        latest = cut_lineage(batch.groupBy("stem").agg(F.max_by("value", "changed").alias("value"), F.max("changed").alias("changed")))
        if latest.isEmpty():
            return
        rows = parse_sidecars(latest.select("stem", "value")).withColumn("pixel_size_nm", F.coalesce("pixel_size_nm", F.lit(1.0)))
        measured = measure_annotations(rows).select("stem", "ann_idx", "type", "label", *SHAPE_METRICS)
        arrived = latest.select("stem", "changed").join(measured, "stem", "left").withColumn("bucket", F.pmod(F.xxhash64("stem"), F.lit(buckets)).cast("int"))
        try:
            stored = spark.read.schema(arrived.schema).parquet(target)
        except AnalysisException:
            stored = arrived.limit(0)
        touched = arrived.select("bucket").distinct()
        known = stored.join(touched, "bucket", "left_semi").join(latest.select("stem", F.col("changed").alias("_new")), "stem", "left")
        stay = known.where(F.col("_new").isNull() | (F.col("changed") > F.col("_new")))
        fresh = arrived.join(stay.where(F.col("_new").isNotNull()).select("stem").distinct(), "stem", "left_anti")
        merged = cut_lineage(stay.select(*arrived.columns).unionByName(fresh))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    return sidecars.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def current_measurements(spark: SparkSession, target: str) -> DataFrame:
    """Measurements of the latest sidecar of every image."""
    return spark.read.parquet(target).where(F.col("ann_idx").isNotNull()).drop("bucket", "changed")


def current_label_counts(spark: SparkSession, target: str) -> DataFrame:
    """Annotations per label in the latest sidecars; an edited sidecar counts once."""
    return current_measurements(spark, target).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


class LabelCorrections(StatefulProcessor):
    """State of an image: the change time of its latest sidecar and how often that had each label."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "changed bigint")
        self.counts = handle.getMapState("counts", "label string", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        newest = int(arrived["at"].max())
        if self.latest.exists() and newest < self.latest.get()[0]:
            return
        # An older version that arrives late is passed over; one of the same time continues the same sidecar.
        goes_on = self.latest.exists() and newest == self.latest.get()[0]
        found = Counter(arrived.loc[(arrived["at"] == newest) & arrived["label"].notna(), "label"])
        before = {k[0]: v[0] for k, v in self.counts.iterator()} if self.counts.exists() else {}
        now = {k: before.get(k, 0) + found.get(k, 0) for k in {*before, *found}} if goes_on else dict(found)
        self.latest.update((newest,))
        self.counts.clear()
        for label, n in now.items():
            self.counts.updateValue((label,), (n,))
        moved = [(key[0], label, now.get(label, 0) - before.get(label, 0)) for label in sorted({*before, *now})]
        out = pd.DataFrame([m for m in moved if m[2]], columns=["stem", "label", "n"])
        if len(out):
            yield out

    def close(self) -> None:
        pass


def stream_label_counts(annotations: DataFrame) -> DataFrame:
    """Corrections (stem, label, n) to the number of annotations per label, from arriving annotations (stem, changed, label) of sidecars.

    Run it in append mode; the sum of n per label is the number in the latest version of each sidecar.  `changed` tells versions
    apart: annotations of a newer one take the place of the image's earlier ones, those of an older one change nothing.  A row without a label stands for
    a sidecar without annotations.  What is held per image is one number per label.
    """
    _with_rocksdb(annotations)
    rows = annotations.select("stem", "label", F.unix_micros(F.col("changed").cast("timestamp")).alias("at"))
    return rows.groupBy("stem").transformWithStateInPandas(LabelCorrections(), "stem string, label string, n bigint", "append", "none")


def _with_rocksdb(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FrameTracker(StatefulProcessor):
    """State of a sequence: its live track ends, the detections of frames that are still open, the next id and the last closed frame."""

    def __init__(self, kind: str, max_px: float, max_gap: int, timed: bool):
        self.kind, self.max_px, self.max_gap, self.timed = kind, max_px, max_gap, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "next_id bigint, closed bigint")
        self.ends = handle.getListState("ends", f"track bigint, frame bigint, ann_idx {self.kind}, x double, y double")
        self.open = handle.getListState("open", f"frame bigint, ann_idx {self.kind}, x double, y double, at bigint")

    def _held(self) -> tuple[int, int, list]:
        next_id, closed = self.counter.get() if self.counter.exists() else (0, NO_FRAME)
        return next_id, closed, list(self.open.get()) if self.open.exists() else []

    def _settle(self, key, detections: list, below: int, next_id: int, closed: int) -> Iterator[pd.DataFrame]:
        """Close all frames before `below` in order and keep the rest open."""
        due = sorted((d for d in detections if d[0] < below), key=lambda d: (d[0], d[1]))
        left = [d for d in detections if d[0] >= below]
        live = [tuple(e) for e in self.ends.get()] if due and self.ends.exists() else []
        out = []
        for frame, group in groupby(due, key=lambda d: d[0]):
            here = list(group)
            live = sorted((e for e in live if frame - e[1] <= self.max_gap + 1), key=lambda e: (e[1], e[2]))
            links = link_frame(np.array([e[3:5] for e in live]).reshape(-1, 2), np.array([d[2:4] for d in here]).reshape(-1, 2), self.max_px)
            taken = {b: live[a][0] for a, b in links}
            gone = {a for a, _ in links}
            live = [e for i, e in enumerate(live) if i not in gone]
            for i, (_, idx, x, y, _) in enumerate(here):
                track = taken.get(i, next_id)
                next_id += i not in taken
                live.append((track, frame, idx, x, y))
                out.append((key[0], frame, idx, track))
            closed = frame
        self.counter.update((next_id, max(closed, below - 1 if due else closed)))
        if due:
            self.ends.put(live)
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=TRACKED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        next_id, closed, detections = self._held()
        arrived = pd.concat(list(rows))
        late = arrived[(arrived["frame"] <= closed) & arrived["ann_idx"].notna()]
        if len(late):
            yield pd.DataFrame({"sequence_id": key[0], "frame": late["frame"], "ann_idx": late["ann_idx"], "track_id": pd.array([None] * len(late), "Int64")})
        fresh = arrived[arrived["frame"] > closed]
        newest = max([int(fresh["frame"].max()) if len(fresh) else closed, *(d[0] for d in detections)])
        whole = fresh[fresh["ann_idx"].notna()]
        detections += [(int(f), i, float(x), float(y), int(at)) for f, i, x, y, at in whole[["frame", "ann_idx", "x_px", "y_px", "at"]].itertuples(index=False)]
        if self.timed and len(whole):
            self.handle.registerTimer(int(whole["at"].max()) + 1)
        yield from self._settle(key, detections, newest, next_id, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        next_id, closed, detections = self._held()
        past = expiredTimerInfo.getExpiryTimeInMs()
        waiting = [d[0] for d in detections if d[4] >= past]
        below = min(waiting) if waiting else max([d[0] for d in detections], default=closed) + 1
        yield from self._settle(key, detections, below, next_id, closed)

    def close(self) -> None:
        pass


NO_FRAME = -(1 << 62)
TRACKED = ["sequence_id", "frame", "ann_idx", "track_id"]


def stream_tracking(detections: DataFrame, max_px: float, max_gap: int = 1, event_time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Track id of each arriving detection (sequence_id, frame, ann_idx, x_px, y_px), frame by frame.

    A frame stays open while it may still grow, over any number of micro-batches, and is assigned at once when it is closed: by a
    detection of a later frame of its sequence, or, with `event_time` and its `delay`, by the watermark.  A row without an ann_idx is no detection, but closes the frames before its own.
    A detection of a frame that is closed already comes out at once without a track_id; none is dropped but those behind the watermark.  A
    track leaves the state once it has been missing for more than `max_gap` frames; ids count the tracks of a sequence in order of creation.
    State: the track ends of the last frames and the detections of open frames.
    """
    _with_rocksdb(detections)
    kinds = dict(detections.dtypes)
    timed = event_time is not None
    rows = detections.withWatermark(event_time, delay) if timed else detections
    at = F.unix_millis(F.col(event_time)) if timed else F.lit(0).cast("bigint")
    rows = rows.select("sequence_id", F.col("frame").cast("bigint").alias("frame"), "ann_idx", F.col("x_px").cast("double").alias("x_px"), F.col("y_px").cast("double").alias("y_px"), at.alias("at"),
                       *([event_time] if timed else []))
    schema = f"sequence_id {kinds['sequence_id']}, frame bigint, ann_idx {kinds['ann_idx']}, track_id bigint"
    return rows.groupBy("sequence_id").transformWithStateInPandas(FrameTracker(kinds["ann_idx"], max_px, max_gap, timed), schema, "append", "eventTime" if timed else "none")
