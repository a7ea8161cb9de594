"""Queries over annotation rows: projections, filters, joins, shape measures and counts."""

from pyspark.sql import functions as F

from mesograph.functions import geometry as G
from mesograph.functions import hull as H
from mesograph.functions import labels as L
from mesograph.functions import units as U
from mesograph.operators import annotations as A
from mesograph.queries.registry import query

PI = "3.141592653589793"
W = "abs(x1 - x0) * pixel_size_nm"
HH = "abs(y1 - y0) * pixel_size_nm"
RECT = f"""SELECT r.*, i.pixel_size_nm, i.name, abs(x1 - x0) * i.pixel_size_nm AS w, abs(y1 - y0) * i.pixel_size_nm AS h
FROM fx_rects r JOIN fx_images i ON r.image_id = i.image_id"""
METRICS = f"""w * h AS area_nm2, 2 * sqrt(w * h / {PI}) AS ecd_nm, 2 * (w + h) AS perimeter_nm,
  least(4 * {PI} * w * h / (4 * (w + h) * (w + h)), 1.0) AS circularity, greatest(w, h) / least(w, h) AS aspect_ratio,
  sqrt(w * w + h * h) AS feret_nm, w AS bbox_w_nm, h AS bbox_h_nm"""
FOUR = {4: " ".join(A.SHAPE_METRICS)}
AB = ("fx_rects", "fx_images")


def sized(t):
    return t.rects().join(t.images().select("image_id", "pixel_size_nm"), "image_id")


def box(df):
    return df.withColumns({"type": F.lit("roi"), "vertices": G.box_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))})


def circles(df):
    return df.withColumns({"type": F.lit("circle"), "cx": (F.col("x0") + F.col("x1")) / 2.0,
                           "cy": (F.col("y0") + F.col("y1")) / 2.0, "r": (F.col("x1") - F.col("x0")) / 2.0})


@query("rect_metrics", f"SELECT image_id, ann_id, label, {METRICS} FROM ({RECT})", AB, FOUR)
def _(t):
    return A.rect_metrics(sized(t)).select("image_id", "ann_id", "label", *A.SHAPE_METRICS)


@query("circle_metrics", f"""SELECT image_id, ann_id, {PI} * r * r AS area_nm2, 2 * r AS ecd_nm, 2 * {PI} * r AS perimeter_nm,
  1.0::DOUBLE AS circularity, 1.0::DOUBLE AS aspect_ratio, 2 * r AS feret_nm, 2 * r AS bbox_w_nm, 2 * r AS bbox_h_nm
FROM (SELECT *, w / 2 AS r FROM ({RECT}))""", AB, FOUR)
def _(t):
    return A.circle_metrics(circles(sized(t))).select("image_id", "ann_id", *A.SHAPE_METRICS)


@query("polygon_metrics", f"SELECT ann_id, {METRICS} FROM ({RECT})", AB, FOUR)
def _(t):
    return A.polygon_metrics(box(sized(t))).select("ann_id", *A.SHAPE_METRICS)


@query("min_area_rect_aspect", f"""SELECT ann_id, greatest(w, h) / least(w, h) AS aspect_ratio, sqrt(w * w + h * h) AS feret_nm
FROM ({RECT})""", AB, {4: "aspect_ratio feret_nm"})
def _(t):
    """Outlines turned by 30 degrees: the oriented rectangle gives back the sides of the box."""
    c, s = 0.8660254037844387, 0.5
    turned = box(t.spread(sized(t))).withColumn("vertices", F.transform("vertices", lambda p: G.point(
        c * p["x"] - s * p["y"], s * p["x"] + c * p["y"])))
    return A.polygon_metrics(turned).select("ann_id", "aspect_ratio", "feret_nm")


@query("measure_annotations", f"""
SELECT ann_id, 'rectangle' AS type, {METRICS} FROM ({RECT})
UNION ALL SELECT ann_id, 'roi' AS type, {METRICS} FROM ({RECT})
UNION ALL SELECT ann_id, 'circle' AS type, {PI} * w * w / 4, w, {PI} * w, 1.0, 1.0, w, w, w FROM ({RECT})""", AB, FOUR)
def _(t):
    base = sized(t)
    mixed = base.unionByName(box(base), allowMissingColumns=True).unionByName(circles(base), allowMissingColumns=True)
    return A.measure_annotations(mixed).select("ann_id", "type", *A.SHAPE_METRICS)


@query("polygon_area_nm2", f"SELECT ann_id, w * h AS area_nm2 FROM ({RECT})", AB, {4: "area_nm2"})
def _(t):
    px = F.col("pixel_size_nm")
    return box(sized(t)).select("ann_id", (G.shoelace(F.col("vertices")) * px * px).alias("area_nm2"))


@query("fill_missing_area", f"""SELECT ann_id, CASE WHEN label = 'R' THEN 7.5 ELSE w * h END AS area_nm2 FROM ({RECT})""",
       AB, {4: "area_nm2"})
def _(t):
    stored = box(sized(t)).withColumn("area_nm2", F.when(F.col("label") == "R", 7.5).otherwise(0.0))
    return A.fill_missing_area(stored).select("ann_id", "area_nm2")


@query("polygon_edges", """SELECT ann_id, CAST(e.k AS INT) AS edge, CASE k WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x1 ELSE x0 END AS ax,
  CASE k WHEN 0 THEN y0 WHEN 1 THEN y0 WHEN 2 THEN y1 ELSE y1 END AS ay,
  CASE k WHEN 0 THEN x1 WHEN 1 THEN x1 WHEN 2 THEN x0 ELSE x0 END AS bx,
  CASE k WHEN 0 THEN y0 WHEN 1 THEN y1 WHEN 2 THEN y1 ELSE y0 END AS by_ FROM fx_rects, range(0, 4) e(k)""",
       ("fx_rects",), {4: "ax ay bx by_"})
def _(t):
    return box(t.rects()).select("ann_id", F.posexplode(G.edges(F.col("vertices"))).alias("edge", "e")).select(
        "ann_id", "edge", F.col("e.x0").alias("ax"), F.col("e.y0").alias("ay"), F.col("e.x1").alias("bx"), F.col("e.y1").alias("by_"))


@query("distance_nm", f"""SELECT ann_id, sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)) AS distance_px,
  sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)) * pixel_size_nm AS distance_nm FROM ({RECT})""", AB, {6: "distance_px distance_nm"})
def _(t):
    lines = sized(t).withColumns({"p1": G.point(F.col("x0"), F.col("y0")), "p2": G.point(F.col("x1"), F.col("y1"))})
    return lines.withColumns(A.distance_columns(F.col("pixel_size_nm"))).select("ann_id", "distance_px", "distance_nm")


@query("angle_deg", """SELECT ann_id, degrees(acos(greatest(-1, least(1, (y1-y0) / sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)))))) AS angle_deg
FROM fx_rects""", ("fx_rects",), {6: "angle_deg"})
def _(t):
    return t.rects().select("ann_id", G.angle_deg(G.point(F.col("x0"), F.col("y0")), G.point(F.col("x1"), F.col("y1")),
                                                  G.point(F.col("x1"), F.col("y0"))).alias("angle_deg"))


@query("centroid_vertex_mean", "SELECT ann_id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM fx_rects", ("fx_rects",), {6: "cx cy"})
def _(t):
    v = F.col("vertices")
    return box(t.rects()).select("ann_id", G.vertex_mean(v, "x").alias("cx"), G.vertex_mean(v, "y").alias("cy"))


@query("centroid_area", """SELECT ann_id, (2 * x0 + x1) / 3 AS cx, (y0 + 2 * y1) / 3 AS cy FROM fx_rects""",
       ("fx_rects",), {4: "cx cy"})
def _(t):
    """Triangles, where the area centroid is the corner mean in closed form."""
    v = F.col("vertices")
    corners = t.rects().withColumn("vertices", G.polygon(
        (F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1")), (F.col("x0"), F.col("y1"))))
    return corners.select("ann_id", G.area_centroid(v, "x").alias("cx"), G.area_centroid(v, "y").alias("cy"))


@query("extract_points", """SELECT r.image_id, ann_id, label, (x0 + x1) / 2 * pixel_size_nm AS x_nm, (y0 + y1) / 2 * pixel_size_nm AS y_nm
FROM fx_rects r JOIN fx_images i USING (image_id)""", AB, {5: "x_nm y_nm"})
def _(t):
    from mesograph.operators.spatial import extract_points

    return extract_points(box(sized(t)).withColumns({"cx": F.lit(None).cast("double"), "cy": F.lit(None).cast("double")}),
                          keep=["ann_id"])


@query("thin_path", """SELECT ann_id, CAST(2 + CASE WHEN sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)) >= 8 THEN 1 ELSE 0 END AS INT) AS kept FROM fx_rects""",
       ("fx_rects",))
def _(t):
    """Three points on the diagonal, the last one a pixel behind the middle one."""
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")
    path = F.array(G.point(x0, y0), G.point(x1, y1), G.point(x1 + 1, y1))
    return t.rects().select("ann_id", F.size(G.thin_path(path, F.lit(8.0))).alias("kept"))


@query("filter_by_type", "SELECT count(*) AS n FROM fx_rects", ("fx_rects",))
def _(t):
    return A.filter_by_type(t.rects(), ["rectangle"]).agg(F.count(F.lit(1)).alias("n"))


@query("filter_by_label", "SELECT ann_id, label FROM fx_rects WHERE label IN ('A', 'N')", ("fx_rects",))
def _(t):
    return A.filter_by_label(t.rects(), ["A", "N"]).select("ann_id", "label")


@query("normalize_label", """SELECT ann_id, CASE WHEN trim(lab) = '' OR lab IS NULL THEN 'Unlabelled' ELSE trim(lab) END AS label
FROM (SELECT ann_id, CASE label WHEN 'A' THEN '  ' WHEN 'N' THEN ' N ' END AS lab FROM fx_rects)""", ("fx_rects",))
def _(t):
    raw = F.when(F.col("label") == "A", "  ").when(F.col("label") == "N", " N ")
    return t.rects().select("ann_id", L.normalize_label(raw).alias("label"))


@query("rename_label", """SELECT CASE label WHEN 'R' THEN 'rejected' ELSE label END AS label, label = 'R' AS renamed, count(*) AS n
FROM fx_rects GROUP BY 1, 2""", ("fx_rects",))
def _(t):
    return A.rename_label(t.rects(), "R", "rejected").groupBy("label", "renamed").agg(F.count(F.lit(1)).alias("n"))


@query("filter_valid_polygon", "SELECT ann_id FROM fx_rects WHERE label <> 'A'", ("fx_rects",))
def _(t):
    v = F.col("vertices")
    return A.filter_valid_polygon(box(t.rects()).withColumn(
        "vertices", F.when(F.col("label") == "A", F.slice(v, 1, 2)).otherwise(v))).select("ann_id")


ZONES = "SELECT image_id, 400.0::DOUBLE AS zx0, 900.0::DOUBLE AS zx1, 300.0::DOUBLE AS zy0, 800.0::DOUBLE AS zy1 FROM fx_images WHERE image_id % 2 = 0"


@query("filter_exclude_zone", f"""SELECT ann_id FROM fx_rects r LEFT JOIN ({ZONES}) z USING (image_id)
WHERE NOT coalesce((x0 + x1) / 2 BETWEEN zx0 AND zx1 AND (y0 + y1) / 2 BETWEEN zy0 AND zy1, false)""", AB)
def _(t):
    zones = t.images().where(F.col("image_id") % 2 == 0).select(
        "image_id", F.lit(400.0).alias("zx0"), F.lit(900.0).alias("zx1"), F.lit(300.0).alias("zy0"), F.lit(800.0).alias("zy1"))
    return A.filter_exclude_zone(box(t.rects()), zones).select("ann_id")


@query("offset_vertices", "SELECT ann_id, x0 + image_id AS x, y0 + 5 AS y FROM fx_rects", ("fx_rects",), {6: "x y"})
def _(t):
    moved = A.offset_vertices(box(t.rects()).withColumns({"ox": F.col("image_id"), "oy": F.lit(5)}))
    first = F.get("vertices", F.lit(0))
    return moved.select("ann_id", first["x"].alias("x"), first["y"].alias("y"))


DETS = """SELECT ann_id, image_id, x0, y0, x1, y1, label AS cls_name, (x1 - x0) / 12 AS conf FROM fx_rects"""


def dets(t):
    return t.rects().drop("type").withColumnRenamed("label", "cls_name").withColumn("conf", (F.col("x1") - F.col("x0")) / 12)


@query("filter_detections", f"SELECT ann_id, cls_name FROM ({DETS}) WHERE conf >= 0.7 AND cls_name IN ('R', 'N')", ("fx_rects",))
def _(t):
    return A.filter_detections(dets(t), 0.7, ["R", "N"]).select("ann_id", "cls_name")


@query("detections_to_annotations", f"""SELECT ann_id, cls_name AS label, 'roi' AS type, CAST(4 AS INT) AS corners, x0 AS first_x, y1 AS last_y
FROM ({DETS})""", ("fx_rects",))
def _(t):
    return A.detections_to_annotations(dets(t), as_roi=True).select(
        "ann_id", "label", "type", F.size("vertices").alias("corners"), F.get("vertices", F.lit(0))["x"].alias("first_x"),
        F.get("vertices", F.lit(3))["y"].alias("last_y"))


@query("picks_to_annotations", f"""SELECT point_id, 32 * 0.5 * 2500 * sin(2 * {PI} / 32) AS area, x_nm AS cx, y_nm AS cy FROM fx_points""",
       ("fx_points",), {4: "area cx cy"})
def _(t):
    v = F.col("vertices")
    picks = t.points().select("point_id", F.col("x_nm").alias("x"), F.col("y_nm").alias("y"))
    return A.picks_to_annotations(picks).select("point_id", G.shoelace(v).alias("area"), G.vertex_mean(v, "x").alias("cx"),
                                                G.vertex_mean(v, "y").alias("cy"))


@query("filter_unflagged", "SELECT particle_id FROM fx_particles WHERE NOT flagged", ("fx_particles",))
def _(t):
    return A.filter_unflagged(t.particles()).select("particle_id")


@query("filter_positive", "SELECT particle_id FROM fx_particles WHERE SA_nm2 > 0", ("fx_particles",))
def _(t):
    return A.filter_positive(t.particles(), "SA_nm2").select("particle_id")


@query("group_key", """SELECT label || ' / ' || image_id AS grp, count(*) AS n FROM fx_rects GROUP BY 1""", ("fx_rects",))
def _(t):
    return t.rects().groupBy(L.group_key(F.col("label"), F.col("image_id").cast("string"), False).alias("grp")).agg(
        F.count(F.lit(1)).alias("n"))


@query("frame_range", "SELECT ann_idx, frame FROM fx_detections WHERE frame BETWEEN 4 AND 11", ("fx_detections",))
def _(t):
    return A.frame_range(t.detections(), 5, 12).select("ann_idx", "frame")


@query("attach_pixel_size", """
SELECT image_id, CASE WHEN image_id % 5 = 0 THEN 2.0 WHEN image_id % 3 = 0 THEN 0.75 WHEN image_id % 2 = 0 THEN 0.25 ELSE 1.0 END::DOUBLE AS pixel_size_nm,
  image_id % 5 = 0 OR image_id % 3 = 0 OR image_id % 2 = 0 AS calibrated FROM fx_images""", ("fx_images",))
def _(t):
    images = t.images().drop("pixel_size_nm")

    def every(k, size):
        return images.select("image_id", F.when(F.col("image_id") % k == 0, size).otherwise(0.0).alias("pixel_size_nm"))

    return A.attach_pixel_size(images, every(5, 2.0), every(3, 0.75), every(2, 0.25)).select("image_id", "pixel_size_nm", "calibrated")


@query("join_annotations_to_images", """SELECT i.image_id, count(ann_id) AS n FROM fx_images i LEFT JOIN fx_rects r
ON r.image_id = i.image_id GROUP BY 1""", AB)
def _(t):
    return A.join_annotations_to_images(t.images().select("image_id"), t.rects().select("image_id", "ann_id")).groupBy("image_id").agg(F.count("ann_id").alias("n"))


# Images and their Foreground annotations: some images have none.
SCANS = "marks AS (SELECT image_id, id AS ann_id FROM fx_coco_annotations WHERE category_id = 1), scans AS (SELECT id AS image_id FROM fx_coco_images)"
SC = ("fx_coco_images", "fx_coco_annotations")


def scans(t):
    return (t.coco_images().select(F.col("id").alias("image_id")),
            t.coco_annotations().where(F.col("category_id") == 1).select("image_id", F.col("id").alias("ann_id")))


@query("unannotated_images", f"""WITH {SCANS} SELECT image_id FROM scans WHERE image_id NOT IN (SELECT image_id FROM marks)""", SC)
def _(t):
    return A.unannotated_images(*scans(t)).select("image_id")


@query("join_categories", """SELECT coalesce(c.name, 'unknown') AS category, count(*) AS n FROM fx_coco_annotations a
LEFT JOIN (SELECT * FROM fx_coco_categories WHERE id < 4) c ON a.category_id = c.id GROUP BY 1""", ("fx_coco_annotations", "fx_coco_categories"))
def _(t):
    known = t.coco_categories().where(F.col("id") < 4)
    return A.join_categories(t.coco_annotations(), known).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("coco_subset", """SELECT id, image_id FROM fx_coco_annotations WHERE image_id IN (SELECT id FROM fx_coco_images WHERE source_image_id % 4 = 1)""",
       ("fx_coco_annotations", "fx_coco_images"))
def _(t):
    ids = t.coco_images().where(F.col("source_image_id") % 4 == 1).select(F.col("id").alias("image_id"))
    return A.coco_subset(t.coco_annotations(), ids).select("id", "image_id")


@query("export_queue_dedupe", """SELECT source_image_id || '_scan' AS stem, min(id) AS seq FROM fx_coco_images GROUP BY 1""", ("fx_coco_images",))
def _(t):
    queue = t.coco_images().select(F.concat(F.col("source_image_id").cast("string"), F.lit("_scan")).alias("stem"), F.col("id").alias("seq"))
    return A.export_queue_dedupe(queue)


@query("pair_all_labels", """WITH seen AS (SELECT DISTINCT image_id, label FROM fx_rects)
SELECT a.image_id, a.label AS label_a, b.label AS label_b FROM seen a JOIN seen b ON a.image_id = b.image_id AND a.label <> b.label""",
       ("fx_rects",))
def _(t):
    return A.label_pairs(t.rects(), ordered=True)


@query("label_counts", """SELECT image_id, label, count(*) AS n, CAST(grouping(image_id) AS INT) AS all_images, CAST(grouping(label) AS INT) AS all_labels
FROM fx_rects GROUP BY CUBE (image_id, label)""", ("fx_rects",))
def _(t):
    return A.label_counts(t.rects())


@query("dataset_overview", f"""WITH {SCANS} SELECT count(*) AS n_images, count(n) AS images_annotated, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_annotations
FROM scans LEFT JOIN (SELECT image_id, count(*) AS n FROM marks GROUP BY 1) USING (image_id)""", SC)
def _(t):
    return A.dataset_overview(*scans(t))


@query("calibration_report", """SELECT image_id, name, pixel_size_nm, pixel_size_nm <> 1.0 AS calibrated, coalesce(n, 0) AS n_annotations
FROM fx_images LEFT JOIN (SELECT image_id, count(*) AS n FROM fx_rects GROUP BY 1) USING (image_id)""", AB)
def _(t):
    return A.calibration_report(t.images().withColumn("calibrated", F.col("pixel_size_nm") != 1.0), t.rects())


@query("image_overview_topk", f"""WITH {SCANS} SELECT image_id, annotation_count FROM (
SELECT image_id, coalesce(n, 0) AS annotation_count, coalesce(n, 0) = 0 AND image_id % 9 <> 0 AND image_id <> 13 AS late
FROM scans LEFT JOIN (SELECT image_id, count(*) AS n FROM marks GROUP BY 1) USING (image_id))
ORDER BY late, image_id LIMIT 60""", SC)
def _(t):
    images, marks = scans(t)
    counts = marks.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    listed = images.join(counts, "image_id", "left").select(
        "image_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("annotation_count"), (F.col("image_id") % 9 == 0).alias("queued"),
        (F.col("image_id") == 13).alias("is_current"))
    return A.image_overview(listed).select("image_id", "annotation_count")


@query("condition_from_name", r"""SELECT image_id, CASE WHEN regexp_matches(name, '#0*(\d)\d?$') THEN regexp_extract(name, '#0*(\d)\d?$', 1) ELSE '(no match)' END AS condition
FROM fx_images""", ("fx_images",))
def _(t):
    return t.images().select("image_id", L.condition_from_name(F.col("name"), r"#0*(\d)\d?$").alias("condition"))


@query("safe_name", """SELECT image_id, CASE WHEN regexp_matches(c, '^[0-9]') THEN 'img_' || c WHEN c = '' THEN 'image' ELSE c END AS safe
FROM (SELECT image_id, regexp_replace(CASE image_id % 3 WHEN 0 THEN name WHEN 1 THEN image_id || ' scan.tif' ELSE '' END, '[^A-Za-z0-9_.-]', '_', 'g') AS c FROM fx_images)""",
       ("fx_images",))
def _(t):
    k = F.col("image_id")
    name = F.when(k % 3 == 0, F.col("name")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(" scan.tif"))).otherwise("")
    return t.images().select("image_id", L.safe_name(name).alias("safe"))


@query("stars", """SELECT particle_id, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars
FROM (SELECT particle_id, 0.08 / (feret_nm * feret_nm) AS p FROM fx_measurements)""", ("fx_measurements",))
def _(t):
    return t.measurements().select("particle_id", L.stars(0.08 / (F.col("feret_nm") * F.col("feret_nm"))).alias("stars"))


UNIT_CASE = "CASE particle_id % 6 WHEN 0 THEN ' nm' WHEN 1 THEN 'uM' WHEN 2 THEN 'Å' WHEN 3 THEN 'pico meter' WHEN 4 THEN 'furlong' ELSE 'm' END"


@query("unit_to_nm", f"""SELECT particle_id, CASE u WHEN ' nm' THEN 1.0 WHEN 'uM' THEN 1e3 WHEN 'Å' THEN 0.1 WHEN 'pico meter' THEN 1e-3
  WHEN 'm' THEN 1e9 ELSE 1.0 END * feret_nm AS header_nm,
  CASE u WHEN ' nm' THEN 1.0 WHEN 'uM' THEN 1e3 WHEN 'Å' THEN 0.1 WHEN 'pico meter' THEN 1e-3 WHEN 'm' THEN 1e9 END * feret_nm AS spacing_nm,
  CASE particle_id % 4 WHEN 2 THEN 25.4e6 / feret_nm WHEN 3 THEN 1e7 / feret_nm END AS resolution_nm, feret_nm * 0.1 AS voxel_nm
FROM (SELECT *, {UNIT_CASE} AS u FROM fx_measurements)""", ("fx_measurements",), {6: "header_nm spacing_nm resolution_nm voxel_nm"})
def _(t):
    k = F.col("particle_id") % 6
    unit = (F.when(k == 0, " nm").when(k == 1, "uM").when(k == 2, "Å").when(k == 3, "pico meter").when(k == 4, "furlong").otherwise("m"))
    size = F.col("feret_nm")
    return t.measurements().select(
        "particle_id", U.header_pixel_size(size, unit).alias("header_nm"), U.spacing_pixel_size(size, unit).alias("spacing_nm"),
        U.resolution_pixel_size(size, F.col("particle_id") % 4).alias("resolution_nm"), U.voxel_pixel_size(size).alias("voxel_nm"))


@query("calibrate_pixel_size", """SELECT particle_id, CASE WHEN feret_nm - 5 > 0 THEN 100.0 / (feret_nm - 5) END AS by_bar,
  feret_nm * 1000.0 AS by_value FROM fx_measurements""", ("fx_measurements",), {6: "by_bar by_value"})
def _(t):
    return t.measurements().select("particle_id", U.calibrate_by_bar(F.lit(100.0), F.col("feret_nm") - 5).alias("by_bar"),
                                   U.calibrate_by_value(F.col("feret_nm"), F.lit("µm")).alias("by_value"))


@query("normalise_voltage", "SELECT particle_id, CASE WHEN v > 1000 THEN v / 1000 ELSE v END AS kv FROM (SELECT particle_id, feret_nm * 40 AS v FROM fx_measurements)",
       ("fx_measurements",), {6: "kv"})
def _(t):
    return t.measurements().select("particle_id", U.normalise_voltage(F.col("feret_nm") * 40).alias("kv"))


@query("nice_scale", """SELECT particle_id, length_nm, CASE WHEN length_nm >= 1000 THEN printf('%.4g', length_nm / 1000) || ' µm'
  WHEN length_nm < 1 THEN printf('%.4g', length_nm * 1000) || ' pm' ELSE printf('%.4g', length_nm) || ' nm' END AS label
FROM (SELECT particle_id, (SELECT arg_min(m * mag, abs(m * mag - target)) FROM (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE)) o(m)) AS length_nm
  FROM (SELECT particle_id, target, pow(10.0, floor(log10(target))) AS mag
    FROM (SELECT particle_id, pow(10.0::DOUBLE, particle_id % 7 - 4) * (feret_nm + 0.25) * 0.15::DOUBLE AS target FROM fx_measurements)))""",
       ("fx_measurements",), {9: "length_nm"})
def _(t):
    size = F.pow(F.lit(10.0), F.col("particle_id") % 7 - 4)
    length = U.nice_scale(size, F.col("feret_nm") + 0.25)
    return t.measurements().select("particle_id", length.alias("length_nm"), U.format_scale(length).alias("label"))


@query("display_units", f"""SELECT ann_id, CASE WHEN w * 151.3719::DOUBLE < 1000 THEN printf('%.2f', w * 151.3719::DOUBLE) || ' nm' ELSE printf('%.3f', w * 151.3719::DOUBLE / 1000) || ' µm' END AS length_text
FROM ({RECT})""", AB)
def _(t):
    return sized(t).select("ann_id", U.display_length((F.col("x1") - F.col("x0")) * F.col("pixel_size_nm") * 151.3719).alias("length_text"))


@query("convex_hull_measures", "SELECT ann_id, (x1 - x0) * (y1 - y0) AS hull_area, CAST(0 AS INT) AS deep_defects FROM fx_rects",
       ("fx_rects",), {4: "hull_area"})
def _(t):
    hull = F.col("h")
    return box(t.spread(t.rects())).withColumn("h", H.hull_measures(F.col("vertices"))).select(
        "ann_id", hull["hull_area"].alias("hull_area"), hull["deep_defects"].alias("deep_defects"))
