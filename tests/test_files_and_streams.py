import datetime
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from mesograph.operators import tracking as T
from mesograph.sources import named_files as N
from mesograph.sources import readers as R
from mesograph.sources import writers as W
from mesograph.streaming import live as V

SQUARE = [[0, 0], [10, 0], [10, 10], [0, 10]]


def test_image_scan(spark, tmp_path):
    for name in ("b.TIF", "a.mrc", "notes.txt", "c.star"):
        (tmp_path / name).write_text("x")
    assert [r.name for r in R.scan_images(spark, str(tmp_path)).collect()] == ["a.mrc", "b.TIF"]
    assert R.drop_same_content(R.content_fingerprint(spark, str(tmp_path))).first().copies == 4


def test_sidecars_survive_bad_records(spark, tmp_path):
    good = {"type": "roi", "label": " A ", "vertices": SQUARE, "future": 1}
    (tmp_path / "one.annotations.json").write_text(json.dumps({"version": 3, "annotations": [good, {"type": "sketch"}, 5], "pixel_size_nm": 0.5, "exclude_zone": None}))
    (tmp_path / "two.annotations.json").write_text(json.dumps([{"type": "circle", "cx": 1, "cy": 2, "r": 3}, {"type": "roi", "vertices": "no"}]))
    rows = {(r.stem, r.type): r for r in R.read_sidecars(spark, str(tmp_path)).collect()}
    assert set(rows) == {("one", "roi"), ("two", "circle")}
    assert rows["one", "roi"].pixel_size_nm == 0.5 and len(rows["one", "roi"].vertices) == 4


def test_star_picks(spark, tmp_path):
    (tmp_path / "p.star").write_text("data_particles\nloop_\n_rlnCoordinateX #1\n_rlnCoordinateY #2\n_rlnClassNumber #3\n1024.5 2048.3 2\n10 20\nbad 5 1\n\ndata_other\nloop_\n_a\n1\n")
    assert [(r.x, r.y, r["class"]) for r in R.read_star_picks(spark, str(tmp_path)).collect()] == [(1024.5, 2048.3, 2), (10.0, 20.0, 1)]


def test_empty_manifest_has_default_categories(spark, tmp_path):
    (tmp_path / "annotations.json").write_text("{}")
    assert [r.name for r in R.read_coco(spark, str(tmp_path))["categories"].orderBy("id").collect()] == ["Foreground", "Background", "Ignore"]


def test_units_are_column_metadata(spark, tmp_path):
    df = W.with_units(spark.createDataFrame([(1.0, 2.0)], "area_nm2 double, ecd_nm double"))
    assert [f.metadata["unit"] for f in df.schema] == ["nm^2", "nm"]


def test_measurement_stream_replaces_an_image(spark, tmp_path):
    folder, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def put(name, n, age=0):
        (folder / name).write_text(json.dumps([{"type": "roi", "label": "a", "vertices": SQUARE}] * n))
        then = time.time() - age
        os.utime(folder / name, (then, then))

    def run():
        query = V.stream_measurements(V.sidecar_stream(spark, str(folder)), target, state, buckets=3).trigger(availableNow=True).start()
        query.awaitTermination()
        return {r.stem: r["count"] for r in V.current_measurements(spark, target).groupBy("stem").count().collect()}

    put("one.annotations.json", 3, 3600)
    put("two.annotations.json", 1, 3600)
    assert run() == {"one": 3, "two": 1}
    put("one.json", 2, 1800)
    assert run() == {"one": 2, "two": 1}
    put("two.json", 0)  # all its annotations were deleted
    assert run() == {"one": 2}
    put("new.json", 1, 90 * 86400)  # copied with its old date
    assert run() == {"one": 2, "new": 1}
    (folder / "one.annotations.json").unlink()
    put("one.annotations.json", 5, 7200)  # an older version arrives late
    assert run() == {"one": 2, "new": 1}
    assert [tuple(r) for r in V.current_label_counts(spark, target).collect()] == [("a", 3)]


def detections():
    import numpy as np

    rng = np.random.default_rng(2)
    start = rng.uniform(0, 300, (15, 2))
    return [("s", f, 100 * f + i, *map(float, p + rng.normal(0, 2, 2))) for f in range(6) for i, p in enumerate(start) if rng.uniform() > 0.15]


DETECTION = "sequence_id string, frame int, ann_idx int, x_px double, y_px double"


def run_stream(spark, tmp_path, chunks, schema, build, name):
    """Each chunk arrives as a file of its own; all that is there is worked off before the next comes."""
    for chunk in chunks:
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = (build(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / name))
                 .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_stream_tracking_of_cut_frames_equals_batch(spark, tmp_path):
    rows = detections()
    rows += [("t", f, f, 5.0 * f, 1.0) for f in (-3, -2, 0, 4)]
    want = {(r.sequence_id, r.ann_idx): r.track_id for r in T.track_annotations(spark.createDataFrame(rows, DETECTION), 15.0, min_frames=1).collect()}
    # Every frame is cut over three files; the next frame begins in the file of the last part.
    chunks = [[r for r in rows if (3 * r[1] + r[2] % 3) // 2 == k] for k in range(-6, 12)]
    chunks = [c for c in chunks if c] + [[("s", 99, None, None, None), ("t", 99, None, None, None)]]
    assert sum(map(len, chunks)) == len(rows) + 2
    got = run_stream(spark, tmp_path, chunks, DETECTION, lambda s: V.stream_tracking(s, 15.0), "tracks")
    assert len(got) == len(rows) and {(r.sequence_id, r.ann_idx): r.track_id for r in got} == want


def test_stream_tracking_tells_late_detections(spark, tmp_path):
    chunks = [[("s", 1, 1, 0.0, 0.0)], [("s", 2, 2, 1.0, 0.0), ("s", 2, 3, 50.0, 0.0)], [("s", 1, 4, 9.0, 9.0), ("s", 3, 5, 1.0, 1.0)], [("s", 9, None, None, None)]]
    got = {r.ann_idx: r.track_id for r in run_stream(spark, tmp_path, chunks, DETECTION, lambda s: V.stream_tracking(s, 5.0), "late")}
    assert got == {1: 0, 2: 0, 3: 1, 4: None, 5: 0}


def test_stream_tracking_closes_frames_by_the_watermark(spark, tmp_path):
    schema = DETECTION + ", seen timestamp"
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    chunks = [[("s", 1, 1, 0.0, 0.0, at(0))], [("s", 1, 2, 9.0, 0.0, at(1))], [("u", 7, 8, 0.0, 0.0, at(30))], [("u", 8, 9, 0.0, 0.0, at(50))]]
    got = run_stream(spark, tmp_path, chunks, schema, lambda s: V.stream_tracking(s, 5.0, event_time="seen", delay="5 minutes"), "timed")
    assert {(r.sequence_id, r.ann_idx): r.track_id for r in got} == {("s", 1): 0, ("s", 2): 1, ("u", 8): 0}


def test_link_frame_equals_the_dense_assignment():
    import numpy as np

    rng = np.random.default_rng(4)
    for n, m in ((0, 3), (1, 1), (30, 20), (60, 90)):
        a, b = rng.uniform(0, 60, (n, 2)), rng.uniform(0, 60, (m, 2))
        assert sorted(T.link_frame(a, b, 6.0)) == sorted(T.link_two_frames(a, b, 6.0))


def test_stream_label_counts_follow_edits(spark, tmp_path):
    schema = "stem string, changed timestamp, label string"
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    chunks = [[("i", at(1), "a"), ("i", at(1), "a"), ("i", at(1), "b"), ("j", at(1), "b")], [("i", at(3), "b")], [("i", at(2), "c"), ("j", at(4), None)], [("i", at(3), "b"), ("k", at(0), "a")]]
    rows = run_stream(spark, tmp_path, chunks, schema, V.stream_label_counts, "labels")
    total = {}
    for r in rows:
        total[r.label] = total.get(r.label, 0) + r.n
    assert {k: n for k, n in total.items() if n} == {"a": 1, "b": 2}


def test_named_files_are_whole_or_not_there(spark, tmp_path):
    folder = str(tmp_path / "named")
    rows = [(f"i{k % 40}", k, f"piece {k}") for k in range(2000)]
    table = spark.createDataFrame(rows, "image string, at int, text string").repartition(7)
    write = lambda df, name=F.concat("image", F.lit(".txt")): N.write_named_files(df, folder, name, F.col("image"), F.col("text"), ["at"], head="<", separator="|", tail=">")
    write(table)
    assert sorted(os.listdir(folder)) == sorted(f"i{k}.txt" for k in range(40)), "no other files, no folders"
    for k in range(40):
        with open(f"{folder}/i{k}.txt") as f:
            assert f.read() == "<" + "|".join(f"piece {n}" for n in range(k, 2000, 40)) + ">"
    write(table.where("image = 'i3'"), F.concat(F.lit("sub/"), "image"))
    assert os.listdir(folder) == ["sub"] and os.listdir(f"{folder}/sub") == ["i3"], "what was there is replaced"
    with pytest.raises(Exception, match="would both be written"):
        write(spark.createDataFrame([("a b", 1, "x"), ("a_b", 2, "y")], "image string, at int, text string"), N.file_safe(F.col("image")))
    assert os.listdir(folder) == ["sub"] and not [n for n in os.listdir(tmp_path) if "staging" in n], "a failed job leaves nothing"
    write(table.limit(0))
    assert os.listdir(folder) == []


def test_label_files_of_many_images(spark, tmp_path):
    texts = spark.createDataFrame([("train", k, f"0 {k}\n1 {k}") for k in range(300)] + [("val", 300, "")], "split string, image_id long, text string")
    W.write_yolo_labels(texts, str(tmp_path / "y"))
    assert sorted(os.listdir(tmp_path / "y")) == ["train", "val"] and len(os.listdir(tmp_path / "y" / "train")) == 300
    assert (tmp_path / "y" / "train" / "7.txt").read_text() == "0 7\n1 7" and (tmp_path / "y" / "val" / "300.txt").read_text() == ""
