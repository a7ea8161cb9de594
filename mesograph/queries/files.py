"""Queries that write derived files to the shared folder and read them back through the readers."""

from pyspark.sql import functions as F

from mesograph.functions import geometry as G
from mesograph.functions import labels as L
from mesograph.operators import annotations as A
from mesograph.operators import compare as C
from mesograph.operators import dataset as D
from mesograph.operators import spatial as S
from mesograph.operators import tracking as T
from mesograph.operators.ordering import ordered_index
from mesograph.queries.annotation import METRICS, RECT, box, sized
from mesograph.queries.dataset import AN, CA, IM, LINES, SPLIT, YOLO
from mesograph.queries.registry import query
from mesograph.queries.spatial import DBSCAN, EPS, MIN_SAMPLES, NN
from mesograph.queries.tracking import GIVEN, given
from mesograph.session import scratch_path
from mesograph.sources import readers as R
from mesograph.sources import writers as W

AB = ("fx_rects", "fx_images")


def records(t):
    """Annotation records as JSON: boxes, outlines, an unknown kind and a broken one, with an extra key each."""
    kind = F.when(F.col("label") == "A", "rectangle").when(F.col("label") == "N", "roi").otherwise("sketch")
    v = F.array(*[F.array(F.col(a), F.col(b)) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    good = F.to_json(F.struct(kind.alias("type"), F.col("label"), "x0", "y0", "x1", "y1", v.alias("vertices"), F.lit(1).alias("extra")))
    return sized(t).select("image_id", "label", "pixel_size_nm", "ann_id", F.when(F.col("x0") > 1950, F.lit('{"type": "roi", "vertices": [[1], "x"]}')).otherwise(good).alias("j"))


def sidecar_texts(t):
    """One sidecar per image: every third one is a bare list, the others are objects."""
    per = records(t).groupBy("image_id", "pixel_size_nm").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("l"))
    whole = F.concat(F.lit('{"version": 3, "annotations": '), F.col("l"), F.lit(', "pixel_size_nm": '), F.col("pixel_size_nm").cast("string"), F.lit(', "exclude_zone": [1, 2, 3, 4], "crop_region": null}'))
    return per.select(F.col("image_id"), F.when(F.col("image_id") % 3 == 0, F.col("l")).otherwise(whole).alias("value"))


KEPT = """kept AS (SELECT r.*, pixel_size_nm, CASE label WHEN 'A' THEN 'rectangle' ELSE 'roi' END AS kind FROM fx_rects r JOIN fx_images i ON r.image_id = i.image_id WHERE label <> 'R' AND x0 <= 1950)"""


@query("read_sidecars", f"""WITH {KEPT} SELECT image_id AS stem, kind AS type, label, count(*) AS n, sum((x1 - x0) * (y1 - y0)) AS area, CASE WHEN image_id % 3 <> 0 THEN max(pixel_size_nm) END AS pixel_size_nm FROM kept GROUP BY image_id, kind, label""",
       AB, {4: "area"})
def _(t):
    path = scratch_path(t.spark, "sidecars")
    sidecar_texts(t).select("value", F.col("image_id").alias("stem")).write.partitionBy("stem").text(path)
    rows = R.read_sidecars(t.spark, path)
    area = F.when(F.col("type") == "roi", G.shoelace(F.col("vertices"))).otherwise((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return rows.groupBy(F.col("stem").cast("bigint").alias("stem"), "type", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(area).alias("area"), F.max("pixel_size_nm").alias("pixel_size_nm"))


@query("read_annotations_json", f"WITH {KEPT} SELECT kind AS type, count(*) AS n FROM kept GROUP BY 1", AB)
def _(t):
    path = scratch_path(t.spark, "lists")
    records(t).groupBy("image_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).write.partitionBy("image_id").text(path)
    return R.read_annotations_json(t.spark, path).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("read_session", f"WITH {KEPT} SELECT '/data/im' || image_id || '.tif' AS image_path, count(*) AS n, CASE WHEN image_id % 3 <> 0 THEN max(pixel_size_nm) END AS pixel_size_nm FROM kept GROUP BY image_id", AB)
def _(t):
    """One session file per ten images, mixing both versions of the image entry."""
    path = scratch_path(t.spark, "sessions")
    entry = F.concat(F.lit('"/data/im'), F.col("image_id").cast("string"), F.lit('.tif": '), F.col("value"))
    body = sidecar_texts(t).groupBy(F.floor(F.col("image_id") / 10).alias("batch")).agg(F.array_join(F.collect_list(entry), ",").alias("b"))
    body.select("batch", F.concat(F.lit('{"version": 2, "images": {'), "b", F.lit("}}")).alias("value")).write.partitionBy("batch").text(path)
    return R.read_session(t.spark, path).groupBy("image_path").agg(F.count(F.lit(1)).alias("n"), F.max("pixel_size_nm").alias("pixel_size_nm"))


def small_files(t):
    """One small file per image."""
    path = scratch_path(t.spark, "images")
    body = F.concat(F.lit("content "), (F.col("image_id") % 7).cast("string"))
    t.images().select("image_id", body.alias("value")).repartition(8, "image_id").write.partitionBy("image_id").text(path)
    return path


@query("scan_images", "SELECT '.txt' AS ext, count(*) AS n, CAST(sum(length('content ' || (image_id % 7)) + 1) AS BIGINT) AS bytes FROM fx_images", ("fx_images",))
def _(t):
    found = R.scan_images(t.spark, small_files(t), [".TXT"])
    return found.groupBy("ext").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


@query("content_fingerprint", "SELECT md5('content ' || (image_id % 7) || chr(10)) AS fingerprint, count(*) AS copies FROM fx_images GROUP BY 1", ("fx_images",))
def _(t):
    return R.drop_same_content(R.content_fingerprint(t.spark, small_files(t))).select("fingerprint", "copies")


@query("folder_inventory", f"""WITH {KEPT} SELECT i.image_id AS stem, coalesce(n, 0) AS n_rois, coalesce(labels, '') AS labels, coalesce(px, 0.0) AS pixel_size_nm FROM fx_images i LEFT JOIN (
SELECT image_id, count(*) FILTER (kind = 'roi') AS n, CASE WHEN bool_or(kind = 'roi') THEN 'N' ELSE '' END AS labels, CASE WHEN image_id % 3 <> 0 THEN max(pixel_size_nm) END AS px FROM kept GROUP BY image_id) k USING (image_id)""", AB)
def _(t):
    listing = t.images().select(F.concat(F.lit("/data/"), F.col("image_id").cast("string"), F.lit(".tif")).alias("path"), F.col("image_id").cast("string").alias("stem"))
    rows = R.parse_sidecars(sidecar_texts(t).withColumn("stem", F.col("image_id").cast("string")))
    return A.folder_inventory(listing, rows).select(F.col("stem").cast("bigint").alias("stem"), "n_rois", "labels", "pixel_size_nm")


def all_regions(t):
    """Every region of every image, numbered within the image in the order of its key."""
    key = F.element_at(F.split("ann_id", "-"), 1).cast("bigint")
    numbered = ordered_index(box(t.rects()).withColumn("_key", key), ["image_id"], "_key", ["ann_id"], "region_id")
    return numbered.select("image_id", F.col("region_id").cast("int").alias("region_id"), F.when(F.col("label") == "A", " ").otherwise(F.col("label")).alias("label"),
                           F.lit("#00AAFF").alias("color"), "vertices", G.shoelace(F.col("vertices")).alias("area_nm2"))


@query("read_label_manifest", """SELECT image_id, CASE WHEN label = 'A' THEN 'region_' || k ELSE label END AS label, count(*) AS n, sum((x1 - x0) * (y1 - y0)) AS area FROM (
SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CAST(split_part(ann_id, '-', 1) AS BIGINT), ann_id) - 1 AS k FROM fx_rects) GROUP BY 1, 2""", ("fx_rects",), {4: "area"})
def _(t):
    path = scratch_path(t.spark, "manifests")
    W.write_label_manifest(all_regions(t), path)
    rows = R.read_label_manifest(t.spark, path)
    return rows.groupBy(F.col("image_id").cast("bigint").alias("image_id"), "label").agg(F.count(F.lit(1)).alias("n"), F.sum(G.shoelace(F.col("vertices"))).alias("area"))


@query("read_star_picks", "SELECT round(x_nm, 3) AS x, round(y_nm, 3) AS y, CAST(CASE WHEN point_id % 5 = 0 THEN 1 ELSE label::INT END AS INT) AS class FROM fx_points WHERE point_id % 11 <> 0", ("fx_points",))
def _(t):
    """One STAR file per image with comments, a coordinate-free block, rows without a class and unreadable rows."""
    path = scratch_path(t.spark, "star")
    k = F.col("point_id")
    x, y = F.round("x_nm", 3).cast("string"), F.round("y_nm", 3).cast("string")
    row = F.when(k % 11 == 0, F.concat(F.lit("bad "), y, F.lit(" 1"))).when(k % 5 == 0, F.concat_ws(" ", x, y)).otherwise(F.concat_ws(" ", x, y, "label"))
    head = "# picks\ndata_optics\nloop_\n_rlnVoltage #1\n300\n\ndata_particles\nloop_\n_RLNcoordinatex #1\n_rlnCoordinateY #2\n_rlnClassNumber #3\n"
    t.points().groupBy("image_id").agg(F.concat(F.lit(head), F.array_join(F.collect_list(row), "\n")).alias("value")).write.partitionBy("image_id").text(path)
    return R.read_star_picks(t.spark, path).drop("source")


@query("read_coco", """SELECT c.name AS category, count(*) AS n, sum(area) AS area FROM fx_coco_annotations a JOIN fx_coco_categories c ON c.id = category_id GROUP BY 1""", (AN, CA), {2: "area"})
def _(t):
    """Manifests in shards, one per thousand tiles."""
    path = scratch_path(t.spark, "coco")
    image = F.struct("id", "source_image_id", "width", "height")
    images = t.coco_images().groupBy(F.floor(F.col("id") / 1000).alias("shard")).agg(F.collect_list(image).alias("images"))
    ann = F.struct("image_id", "category_id", F.array("bx", "by_", "bw", "bh").alias("bbox"), "area")
    anns = t.coco_annotations().groupBy(F.floor(F.col("image_id") / 1000).alias("shard")).agg(F.collect_list(ann).alias("annotations"))
    both = images.join(anns, "shard", "full")
    both.select("shard", F.to_json(F.struct("images", "annotations")).alias("value")).write.partitionBy("shard").text(path)
    doc = R.read_coco(t.spark, path)
    return A.join_categories(doc["annotations"], t.coco_categories()).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))


@query("read_measurements_csv", f"""SELECT source, label, count(*) AS n, sum(round(area_nm2, 4)) AS area FROM (SELECT label, {METRICS} FROM ({RECT})), (VALUES ('first'), ('second')) s(source) GROUP BY 1, 2""", AB, {2: "area"})
def _(t):
    """`write_measurements`, read twice as two overlaid sources."""
    path = scratch_path(t.spark, "measurements")
    W.write_measurements(A.rect_metrics(sized(t)).withColumn("image", F.col("image_id").cast("string")), path)
    rows = R.read_measurements_csv(t.spark, {"first": path, "second": path})
    return rows.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("area_nm2").alias("area"))


@query("overlay_datasets", "SELECT 'a' AS source, particle_id, ecd_nm, NULL::DOUBLE AS SA_nm2 FROM fx_measurements UNION ALL SELECT 'b', particle_id, NULL, SA_nm2 FROM fx_particles", ("fx_measurements", "fx_particles"), {4: "SA_nm2"})
def _(t):
    return R.overlay_datasets({"a": t.measurements().select("particle_id", "ecd_nm"), "b": t.particles().select("particle_id", "SA_nm2")}).select("source", "particle_id", "ecd_nm", "SA_nm2")


@query("write_particles", "SELECT label, count(*) AS n, sum(SA_nm2) AS total FROM fx_particles GROUP BY 1", ("fx_particles",), {4: "total"})
def _(t):
    path = scratch_path(t.spark, "particles")
    W.write_particles(t.particles(), path, "json")
    return t.spark.read.schema("label string, SA_nm2 double").json(path).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("SA_nm2").alias("total"))


@query("write_tracks", f"WITH {GIVEN} SELECT sequence_id, count(*) AS n FROM st GROUP BY 1", ("fx_detections",))
def _(t):
    path = scratch_path(t.spark, "tracks")
    W.write_tracks(T.step_displacement(given(t)), path)
    return t.spark.read.option("header", True).csv(path).groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"))


@query("write_spatial_features", f"""WITH RECURSIVE {DBSCAN}, {NN} SELECT c.image_id, round(n.x_nm, 3) AS x_nm, round(n.y_nm, 3) AS y_nm, CASE WHEN cluster_id < 0 THEN 'isolated' ELSE cluster_id::VARCHAR END AS cluster_id,
  round(nnd_nm, 3) AS nearest_neighbor_nm FROM clusters c JOIN nn n USING (point_id)""", ("fx_points",))
def _(t):
    path = scratch_path(t.spark, "features")
    ids = ["image_id", "point_id"]
    full = (S.dbscan(t.points(), EPS, MIN_SAMPLES).join(S.local_density(t.points(), EPS).select(*ids, "n_neighbors"), ids)
            .join(S.nearest_neighbour_join(t.points()).select(*ids, "nnd_nm"), ids))
    W.write_spatial_features(full, path)
    return t.spark.read.option("header", True).schema("image_id bigint, label string, x_nm double, y_nm double, cluster_id string, n_neighbors bigint, nearest_neighbor_nm double").csv(path).drop("label", "n_neighbors")


@query("write_stats_summary", """SELECT 'group_stats' AS row_type, count(DISTINCT label) AS n FROM fx_particles UNION ALL SELECT 'pairwise', count(*) FROM (SELECT DISTINCT label FROM fx_particles) a JOIN (SELECT DISTINCT label FROM fx_particles) b ON a.label < b.label
UNION ALL SELECT 'omnibus', 1""", ("fx_particles",))
def _(t):
    path = scratch_path(t.spark, "stats")
    W.write_stats_summary(C.stats_summary(C.compare_groups(t.particles(), "label", "SA_nm2"), "label"), path)
    return t.spark.read.option("header", True).csv(path).groupBy("row_type").agg(F.count(F.lit(1)).alias("n"))


@query("write_coco_splits", f"WITH {SPLIT} SELECT split, count(*) AS n FROM fx_coco_annotations a JOIN fx_coco_images i ON i.id = a.image_id JOIN spl USING (source_image_id) GROUP BY 1", (IM, AN))
def _(t):
    path = scratch_path(t.spark, "splits")
    W.write_coco_splits(D.split_images(t.coco_images(), D.split_sources(t.coco_images())), t.coco_annotations(), path)
    return t.spark.read.schema("image_id bigint, split string").json(f"{path}/annotations").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("write_label_manifest", "SELECT image_id, count(*) AS n FROM fx_rects GROUP BY 1", ("fx_rects",))
def _(t):
    """Manifests of all regions as files, counted in the written texts."""
    path = scratch_path(t.spark, "manifests")
    W.write_label_manifest(all_regions(t), path)
    texts = R.whole_texts(t.spark, path)
    return texts.select(L.stem(F.col("path")).cast("bigint").alias("image_id"), F.size(F.from_json("value", "map<string,string>")).cast("bigint").alias("n"))


@query("write_archive", """SELECT regexp_replace(name, '[^A-Za-z0-9_.-]', '_', 'g') AS archive_name, count(*) AS n FROM fx_rects r JOIN fx_images i ON r.image_id = i.image_id GROUP BY 1""", AB)
def _(t):
    path = scratch_path(t.spark, "archive")
    measured = A.rect_metrics(sized(t)).select("image_id", "ann_id", *A.SHAPE_METRICS)
    W.write_archive(t.images(), t.rects().repartition("image_id"), measured.repartition("image_id"), path)
    return t.spark.read.parquet(f"{path}/measurements").groupBy("archive_name").agg(F.count(F.lit(1)).alias("n"))


@query("write_yolo_labels", f"WITH {SPLIT}, {YOLO}, {LINES} SELECT t.image_id, unnest(string_split(text, chr(10))) AS line FROM t WHERE text <> ''", (IM, AN))
def _(t):
    """One label file per image; all lines read back."""
    path = scratch_path(t.spark, "yolo")
    images = D.split_images(t.coco_images(), D.split_sources(t.coco_images())).withColumns({"width": F.lit(900), "height": F.lit(900)})
    W.write_yolo_labels(D.yolo_dataset(images, t.coco_annotations().withColumn("segmentation", F.lit(None).cast("array<double>")), t.coco_categories()), path)
    rows = t.spark.read.option("recursiveFileLookup", True).text(path)
    return rows.select(L.stem(F.input_file_name()).cast("bigint").alias("image_id"), F.col("value").alias("line"))

