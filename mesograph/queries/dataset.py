"""Queries over training manifests."""

from pyspark.sql import functions as F

from mesograph.functions.labels import DEFAULT_CATEGORIES
from mesograph.operators import dataset as D
from mesograph.operators import masks as K
from mesograph.operators import outlines as O
from mesograph.queries.mask import MP, foreground, runs
from mesograph.queries.registry import query
from mesograph.session import scratch_path
from mesograph.sources import writers as W

IM, AN, CA = "fx_coco_images", "fx_coco_annotations", "fx_coco_categories"
HASH = "('0x' || substr(md5(concat_ws(':', {parts})), 1, 13))::BIGINT"
SPLIT = f"""src AS (SELECT DISTINCT source_image_id FROM fx_coco_images), cnt AS (SELECT count(*) AS n FROM src),
nn AS (SELECT greatest(1, round_even(n * 0.1, 0))::BIGINT AS nt, greatest(1, round_even(n * 0.1, 0))::BIGINT AS nv FROM cnt),
spl AS (SELECT source_image_id, CASE WHEN i < nt THEN 'test' WHEN i < nt + nv THEN 'val' ELSE 'train' END AS split FROM (
  SELECT source_image_id, row_number() OVER (ORDER BY {HASH.format(parts="42, source_image_id")}, source_image_id) - 1 AS i FROM src), nn)"""
GRID = """g AS (SELECT CAST(o AS INT) AS o, CAST(row_number() OVER (ORDER BY o) - 1 AS INT) AS i FROM (SELECT unnest([0, 768, 1176]) AS o))"""


@query("tile_grid", f"WITH {GRID} SELECT image_id, a.i * 3 + b.i AS tile_idx, a.o AS y0, b.o AS x0 FROM fx_images, g a, g b", ("fx_images",))
def _(t):
    return D.tile_grid(t.images())


@query("headless_tiles", f"WITH {GRID} SELECT image_id, a.i * 3 + b.i AS tile_idx, count(*) * 8 AS n FROM fx_images, g a, g b GROUP BY 1, 2", ("fx_images",))
def _(t):
    return D.headless_tiles(t.images()).groupBy("image_id", "tile_idx").agg(F.count(F.lit(1)).alias("n"))


@query("roi_tile_join", f"WITH {MP}, {GRID} SELECT image_id, a.i * 3 + b.i AS tile_idx, count(*) AS n, CAST(sum(y - a.o) AS BIGINT) AS sum_y, count(DISTINCT region_id) AS n_regions FROM mp JOIN g a ON y >= a.o AND y < a.o + 1024 JOIN g b ON x >= b.o AND x < b.o + 1024 GROUP BY 1, 2",
       ("fx_rects",))
def _(t):
    pixels = F.col("xb") - F.col("xa")
    regions = D.roi_tile_join(runs(t), t.images()).groupBy("image_id", "tile_idx", "region_id").agg(F.sum(pixels).alias("n"), F.sum(F.col("y") * pixels).alias("sum_y"))
    return regions.groupBy("image_id", "tile_idx").agg(F.sum("n").alias("n"), F.sum("sum_y").alias("sum_y"), F.count("region_id").alias("n_regions"))


@query("boxes_to_tiles", f"WITH {GRID} SELECT image_id, a.i * 3 + b.i AS tile_idx, count(*) AS n FROM fx_rects JOIN g a ON y1 > a.o AND y0 < a.o + 1024 JOIN g b ON x1 > b.o AND x0 < b.o + 1024 GROUP BY 1, 2", ("fx_rects",))
def _(t):
    return D.boxes_to_tiles(t.rects(), t.images()).groupBy("image_id", "tile_idx").agg(F.count(F.lit(1)).alias("n"))


@query("tile_pixels", """WITH o AS (SELECT * FROM (VALUES (0, 0), (1, 3), (2, 4)) v(i, o))
SELECT image_id, CAST(a.i * 3 + b.i AS INT) AS tile_idx, CAST(y - a.o AS INT) AS y, CAST(x - b.o AS INT) AS x, v FROM fx_pixels JOIN o a ON y >= a.o AND y < a.o + 4 JOIN o b ON x >= b.o AND x < b.o + 4""", ("fx_pixels",))
def _(t):
    shape = t.raw("embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    return D.tile_pixels(t.pixels(), shape, 4, 0.25).select("image_id", "tile_idx", "y", "x", "v")


@query("reflect_padding", """SELECT image_id, CAST(py AS INT) AS y, CAST(px AS INT) AS x, v FROM fx_pixels, range(0, 11) a(py), range(0, 11) b(px)
WHERE y = CASE WHEN py < 8 THEN py ELSE 14 - py END AND x = CASE WHEN px < 8 THEN px ELSE 14 - px END""", ("fx_pixels",))
def _(t):
    shape = t.raw("embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    return D.tile_pixels(t.pixels(), shape, 11, 0.25).select("image_id", "y", "x", "v")


@query("skip_empty_tiles", f"""WITH {GRID}, few AS (SELECT * FROM fx_rects), hit AS (SELECT DISTINCT image_id, a.i * 3 + b.i AS tile_idx FROM few JOIN g a ON y1 > a.o AND y0 < a.o + 1024 JOIN g b ON x1 > b.o AND x0 < b.o + 1024)
SELECT image_id, a.i * 3 + b.i AS tile_idx FROM fx_images, g a, g b WHERE (image_id, a.i * 3 + b.i) IN (SELECT (image_id, tile_idx) FROM hit) OR image_id NOT IN (SELECT image_id FROM few)""".replace("(SELECT (image_id, tile_idx) FROM hit)", "(SELECT image_id, tile_idx FROM hit)"),
       ("fx_images", "fx_rects"))
def _(t):
    few = t.rects()
    return D.skip_empty_tiles(D.tile_grid(t.images()), D.boxes_to_tiles(few, t.images()), few).select("image_id", "tile_idx")


@query("augment_8", """SELECT image_id, aug, y, x, v FROM (SELECT image_id, v, unnest(['orig', 'rot90', 'rot180', 'rot270', 'fliplr', 'fliplr_rot90', 'fliplr_rot180', 'fliplr_rot270']) AS aug,
  unnest([y, 7 - x, 7 - y, x, y, x, 7 - y, 7 - x]) AS y, unnest([x, y, 7 - x, 7 - y, 7 - x, y, x, 7 - y]) AS x FROM fx_pixels)""", ("fx_pixels",))
def _(t):
    return D.augment_8(t.pixels(), F.lit(8), F.lit(8)).select("image_id", "aug", "y", "x", "v")


TURNED = """SELECT image_id, aug, y, x FROM (SELECT image_id, unnest(['orig', 'rot90', 'rot180', 'rot270', 'fliplr', 'fliplr_rot90', 'fliplr_rot180', 'fliplr_rot270']) AS aug,
  unnest([y, 7 - x, 7 - y, x, y, x, 7 - y, 7 - x]) AS y, unnest([x, y, 7 - x, 7 - y, 7 - x, y, x, 7 - y]) AS x FROM fx_pixels WHERE v > 0)"""
# Corners of pixel edges: where one pixel of four is set there is an outward corner, where three are an inward one, where two across are two outward ones.
CORNERS = """q AS (SELECT image_id, aug, y + dy AS y, x + dx AS x, sum(1 << (2 * dy + dx)) AS around FROM f, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dy, dx) GROUP BY ALL),
c AS (SELECT image_id, aug, sum(CASE WHEN around IN (1, 2, 4, 8) THEN 1 WHEN around IN (6, 9) THEN 2 ELSE 0 END) AS outward, sum(CASE WHEN around IN (7, 11, 13, 14) THEN 1 ELSE 0 END) AS inward FROM q GROUP BY 1, 2)"""
# Column-major run lengths of the 8 x 8 mask: sums of runs of equal pixels, from a run of zeros on.
RUNS = """g AS (SELECT t.image_id, t.aug, i, f.y IS NOT NULL AS on_ FROM (SELECT DISTINCT image_id, aug FROM f) t CROSS JOIN range(64) r(i)
  LEFT JOIN f ON f.image_id = t.image_id AND f.aug = t.aug AND f.y = i % 8 AND f.x = i // 8),
h AS (SELECT *, sum(CAST(on_ <> before AS INT)) OVER (PARTITION BY image_id, aug ORDER BY i) AS run FROM (SELECT *, lag(on_, 1, false) OVER (PARTITION BY image_id, aug ORDER BY i) AS before FROM g)),
rl AS (SELECT image_id, aug, CASE WHEN min(run) > 0 THEN '0,' ELSE '' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY run) AS counts FROM (SELECT image_id, aug, run, count(*) AS n FROM h GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("instance_stats", f"""WITH f AS ({TURNED}), {RUNS}
SELECT image_id, aug, min(x)::DOUBLE AS bx, min(y)::DOUBLE AS by_, (max(x) - min(x))::DOUBLE AS bw, (max(y) - min(y))::DOUBLE AS bh, avg(x) AS cx, avg(y) AS cy, count(*) AS area, any_value(counts) AS counts
FROM f JOIN rl USING (image_id, aug) GROUP BY 1, 2""", ("fx_pixels",), {2: "cx cy"})
def _(t):
    stats = D.instance_stats(turned(t), 8)
    return stats.withColumn("counts", F.array_join(F.col("counts").cast("array<string>"), ",")).drop("segmentation", "tile_idx", "region_id")


@query("mask_rings", f"""WITH f AS ({TURNED}), {CORNERS} SELECT image_id, aug, (SELECT count(*) FROM f WHERE f.image_id = c.image_id AND f.aug = c.aug) AS area, CAST(outward + inward AS BIGINT) AS corners,
  CAST((outward - inward) // 4 AS BIGINT) AS outer_less_holes FROM c""", ("fx_pixels",))
def _(t):
    """Areas, corners and Euler numbers of the rings around the foreground of every image in all orientations."""
    rings = O.mask_rings(turned(t), ["image_id", "aug"])
    sign = F.when(F.col("hole"), -1).otherwise(1)
    return rings.groupBy("image_id", "aug").agg(F.sum(sign * F.col("area")).alias("area"), F.sum(F.size("vertices")).alias("corners"), F.sum(sign).cast("long").alias("outer_less_holes"))


def turned(t):
    return D.augment_8(foreground(t).withColumns({"tile_idx": F.lit(0), "region_id": F.lit(1)}), F.lit(8), F.lit(8))


@query("negative_prompts", f"""SELECT image_id, y, x FROM fx_pixels WHERE NOT v > 0 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY {HASH.format(parts="0, image_id, y, x")}, y, x) <= 5""", ("fx_pixels",))
def _(t):
    shape = t.raw("embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    return D.negative_prompts(K.outside_all_masks(shape, foreground(t)), 5)


@query("coco_ids", """WITH l AS (SELECT lower(trim(s_name)) AS k, min(s_suppkey) AS f, arg_min(trim(s_name), s_suppkey) AS name FROM (SELECT CASE s_nationkey % 4 WHEN 0 THEN 'Foreground' WHEN 1 THEN 'rod' WHEN 2 THEN ' Cube ' ELSE 'N' || s_nationkey END AS s_name, s_suppkey FROM supplier) GROUP BY 1)
SELECT id, name FROM fx_coco_categories WHERE id < 4 UNION ALL SELECT CAST(3 + row_number() OVER (ORDER BY f) AS INT), name FROM l WHERE k NOT IN ('foreground', 'background', 'ignore')""", (CA,))
def _(t):
    k = F.col("s_nationkey") % 4
    label = F.when(k == 0, "Foreground").when(k == 1, "rod").when(k == 2, " Cube ").otherwise(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")))
    labels = t.raw("supplier").select(label.alias("label"), F.col("s_suppkey").alias("first_seen"))
    return D.category_ids(labels, t.spark.createDataFrame(DEFAULT_CATEGORIES, "id int, name string"))


@query("running_ids", "SELECT source_image_id, 100 + row_number() OVER (ORDER BY source_image_id) - 1 AS id FROM (SELECT DISTINCT source_image_id FROM fx_coco_images)", (IM,))
def _(t):
    return D.running_ids(t.coco_images().select("source_image_id").distinct(), "source_image_id", 100)


AUG = "list_position(['orig', 'rot90', 'rot180', 'rot270', 'fliplr', 'fliplr_rot90', 'fliplr_rot180', 'fliplr_rot270'], aug)"
BUILT = f"""f AS ({TURNED}), l AS (SELECT DISTINCT image_id, CASE WHEN movie_id % 2 = 0 THEN 'foreground' ELSE 'N' END AS label FROM fx_pixels),
n AS (SELECT image_id, aug, min(x)::DOUBLE AS bx, min(y)::DOUBLE AS by_, avg(x) AS cx, avg(y) AS cy, count(*) AS area FROM f GROUP BY 1, 2)"""


def labelled(t):
    return t.pixels().select("image_id", F.when(F.col("movie_id") % 2 == 0, "foreground").otherwise("N").alias("label")).distinct()


@query("coco_build", f"""WITH {BUILT} SELECT image_id AS source_image_id, aug, row_number() OVER (ORDER BY image_id, {AUG}) AS coco_image_id, 499 + row_number() OVER (ORDER BY image_id, {AUG}) AS id,
  CASE label WHEN 'N' THEN 4 ELSE 1 END AS category_id, bx, by_, cx, cy, area FROM n JOIN l USING (image_id)""", ("fx_pixels",), {2: "cx cy"})
def _(t):
    images, anns = D.coco_build(D.instance_stats(turned(t), 8).join(labelled(t), "image_id"), labelled(t).select("image_id"), t.coco_categories(), 1, 500)
    return images.select("coco_image_id", "source_image_id").join(anns, "coco_image_id").select("source_image_id", "aug", "coco_image_id", "id", "category_id", "bx", "by_", "cx", "cy", "area")


@query("coco_append", f"""WITH {BUILT}, s AS (SELECT image_id, row_number() OVER (ORDER BY image_id % 3 <> 0, image_id) AS source_id FROM (SELECT DISTINCT image_id FROM n)),
i AS (SELECT image_id, aug, row_number() OVER (ORDER BY image_id % 3 <> 0, image_id, {AUG}) AS id FROM n)
SELECT source_id, image_id, aug, i.id AS coco_image_id, i.id AS annotation_id, 1 AS local_id, CASE label WHEN 'N' THEN 4 ELSE 1 END AS category_id, cx, cy, bx, by_, 0 AS n_neg
FROM i JOIN n USING (image_id, aug) JOIN s USING (image_id) JOIN l USING (image_id)""", ("fx_pixels",), {2: "cx cy"})
def _(t):
    """Every third source first, then all sources, then all once more: sources that were there keep their ids."""
    stats = D.instance_stats(turned(t), 8).join(labelled(t), "image_id")
    sources = labelled(t).select("image_id")
    manifest = D.coco_append(None, stats.where("image_id % 3 = 0"), sources, t.coco_categories())
    for _ in range(2):
        manifest = D.coco_append(manifest, stats, sources, t.coco_categories())
    shots = manifest.images.select("image_id", "source_id", "aug", F.col("id").alias("coco_image_id"))
    point, box = F.col("point_prompt"), F.col("bbox_prompt")
    return shots.join(manifest.sources.select("source_id", "image_id"), ["image_id", "source_id"]).join(manifest.prompts.drop("image_id", "aug"), "coco_image_id").select(
        "source_id", "image_id", "aug", "coco_image_id", "annotation_id", "local_id", "category_id", point[0].alias("cx"), point[1].alias("cy"), box[0].alias("bx"), box[1].alias("by_"),
        F.size("neg_prompts").alias("n_neg"))


@query("split_sources", f"WITH {SPLIT} SELECT * FROM spl", (IM,))
def _(t):
    return D.split_sources(t.coco_images())


@query("auto_assign", f"""WITH q AS (SELECT 'stem' || image_id AS stem FROM fx_images), c AS (SELECT round_even(count(*) * 0.2, 0)::BIGINT AS nv, round_even(count(*) * 0.1, 0)::BIGINT AS nt FROM q)
SELECT stem, CASE WHEN i < nt THEN 'test' WHEN i < nt + nv THEN 'val' ELSE 'train' END AS split FROM (SELECT stem, row_number() OVER (ORDER BY {HASH.format(parts="42, stem")}, stem) - 1 AS i FROM q), c""", ("fx_images",))
def _(t):
    return D.auto_assign(t.images().select(F.concat(F.lit("stem"), F.col("image_id").cast("string")).alias("stem")), 0.2, 0.1)


@query("explicit_split_join", """SELECT image_id AS source_image_id, CASE WHEN image_id % 5 = 0 THEN 'test' WHEN image_id % 7 = 0 THEN 'val' WHEN image_id % 11 = 0 THEN 'train' END AS split FROM fx_images""", ("fx_images",))
def _(t):
    k = F.col("image_id")
    src = t.images().select(k.alias("source_image_id"), F.concat(F.lit("/data/im"), k.cast("string"), F.lit(".tif")).alias("source_file"))
    wish = F.when(k % 5 == 0, "Test").when(k % 7 == 0, "Validation").when(k % 11 == 0, "whatever")
    path = F.concat(F.when(k % 2 == 0, "/data/im").otherwise("im"), k.cast("string"), F.when(k % 2 == 0, ".tif").otherwise(".mrc"))
    wishes = t.images().select(path.alias("path"), wish.alias("split")).where(F.col("split").isNotNull())
    return D.explicit_split_join(src, wishes).select("source_image_id", "split")


@query("dataset_stats", """WITH p AS (SELECT i.id, source_image_id, count(a.image_id) AS n FROM fx_coco_images i LEFT JOIN fx_coco_annotations a ON a.image_id = i.id GROUP BY 1, 2)
SELECT count(DISTINCT source_image_id) AS n_source_images, count(*) AS n_tiles_augmented, CAST(sum(n) AS BIGINT) AS n_annotations, count(*) FILTER (n = 0) AS images_with_zero_annotations, round(avg(n), 2) AS mean_instances,
  min(n) AS min_instances, max(n) AS max_instances, (SELECT round(avg(area), 1) FROM fx_coco_annotations) AS mean_area_px, (SELECT round(min(area), 1) FROM fx_coco_annotations) AS min_area_px, (SELECT round(max(area), 1) FROM fx_coco_annotations) AS max_area_px FROM p""", (IM, AN))
def _(t):
    return D.dataset_stats(t.coco_images(), t.coco_annotations())


@query("class_by_split", f"""WITH {SPLIT}, im AS (SELECT * FROM fx_coco_images JOIN spl USING (source_image_id)),
r AS (SELECT c.name AS "row", split, count(*) AS n FROM fx_coco_annotations a JOIN im ON im.id = a.image_id JOIN fx_coco_categories c ON c.id = category_id WHERE lower(c.name) NOT IN ('background', 'ignore') GROUP BY 1, 2
UNION ALL SELECT 'tiles', split, count(*) FROM im GROUP BY 2 UNION ALL SELECT 'sources', split, count(DISTINCT source_image_id) FROM im GROUP BY 2)
SELECT "row", CAST(coalesce(sum(n) FILTER (split = 'train'), 0) AS BIGINT) AS train, CAST(coalesce(sum(n) FILTER (split = 'val'), 0) AS BIGINT) AS val, CAST(coalesce(sum(n) FILTER (split = 'test'), 0) AS BIGINT) AS test FROM r GROUP BY 1""", (IM, AN, CA))
def _(t):
    images = D.split_images(t.coco_images(), D.split_sources(t.coco_images()))
    return D.class_by_split(images, t.coco_annotations(), t.coco_categories())


@query("write_hub_rows", """WITH b AS (SELECT image_id, movie_id, string_agg(printf('%02x', CAST(floor(greatest(0, least(1, v)) * 255) AS INT)), '' ORDER BY y, x) AS image, count(*) FILTER (v > 0) AS area FROM fx_pixels GROUP BY 1, 2)
SELECT image_id, 'tile:' || image_id AS file_name, 8 AS width, 8 AS height, 0.0::DOUBLE AS pixel_size_nm, 0 AS tile_offset_y, 0 AS tile_offset_x, 'orig' AS aug, movie_id AS source_image_id,
  CASE WHEN movie_id % 2 = 0 THEN '{"gamma":' || (movie_id + 1) || ',"invert":false}' ELSE '{}' END AS contrast_params,
  CASE WHEN image_id % 3 = 0 THEN '[]' ELSE '[{"area":' || area || ',"label":"a"},{"area":' || (area + 1) || ',"label":"b"}]' END AS annotations,
  CASE WHEN image_id % 3 = 0 THEN 0 ELSE 2 END AS n_instances, image FROM b""", ("fx_pixels",))
def _(t):
    """Images with their bytes and contrast parameters, written and read back; every third has no annotation."""
    path = scratch_path(t.spark, "hub")
    pixels = t.pixels()
    images = pixels.select(F.col("image_id").alias("id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("movie_id").alias("source_image_id")).distinct()
    area = pixels.where("image_id % 3 <> 0").groupBy("image_id").agg(F.count_if(F.col("v") > 0).alias("area"))
    notes = area.select("image_id", F.explode(F.array(F.struct("area", F.lit("a").alias("label")), F.struct((F.col("area") + 1).alias("area"), F.lit("b").alias("label")))).alias("e")).select("image_id", "e.*")
    contrast = images.select("source_image_id").distinct().where("source_image_id % 2 = 0").select("source_image_id", (F.col("source_image_id") + 1).alias("gamma"), F.lit(False).alias("invert"))
    bytes_ = pixels.select("image_id", "y", "x", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "v")) * 255).alias("v"))
    W.write_hub_rows(D.hub_rows(images, notes, bytes_, contrast), path)
    return t.spark.read.parquet(path).withColumn("image", F.lower(F.hex("image")))


@query("class_index_map", "SELECT id, name, CAST(CASE id WHEN 4 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INT) AS class_index, 0 = 0 AS used FROM fx_coco_categories WHERE id IN (SELECT category_id FROM fx_coco_annotations)", (CA, AN))
def _(t):
    used = t.coco_categories().join(t.coco_annotations().select(F.col("category_id").alias("id")).distinct(), "id")
    return D.class_index_map(used, ["n"]).withColumn("used", F.lit(True))


YOLO = """y AS (SELECT a.id, image_id, CASE category_id WHEN 1 THEN 0 ELSE 1 END AS cls, greatest(0, least(1, bx / 900)) AS ax, greatest(0, least(1, by_ / 900)) AS ay, greatest(0, least(1, (bx + bw) / 900)) AS cx, greatest(0, least(1, (by_ + bh) / 900)) AS cy
FROM fx_coco_annotations a WHERE category_id <> 2), k AS (SELECT * FROM y WHERE (cx - ax) * (cy - ay) >= 1e-6)"""


def small_annotations(t):
    return t.coco_annotations().withColumns({"width": F.lit(900), "height": F.lit(900), "segmentation": F.lit(None).cast("array<double>")})


@query("yolo_normalise", f"WITH {YOLO} SELECT id, cls, ax, ay, cx, cy FROM k", (AN,), {9: "ax ay cx cy"})
def _(t):
    p = F.col("points")
    return D.yolo_normalise(small_annotations(t)).join(D.trainable_index(t.coco_categories()), "category_id").select(
        "id", "cls", p[0]["x"].alias("ax"), p[0]["y"].alias("ay"), p[2]["x"].alias("cx"), p[2]["y"].alias("cy"))


LINES = """t AS (SELECT image_id, string_agg(line, chr(10) ORDER BY line) AS text FROM (SELECT image_id, cls || ' ' || printf('%.6f', ax) || ' ' || printf('%.6f', ay) || ' ' || printf('%.6f', cx) || ' ' || printf('%.6f', ay) || ' ' || printf('%.6f', cx) || ' ' || printf('%.6f', cy) || ' ' || printf('%.6f', ax) || ' ' || printf('%.6f', cy) AS line FROM k) GROUP BY 1)"""


@query("yolo_dataset", f"WITH {SPLIT}, {YOLO}, {LINES} SELECT i.id AS image_id, split, coalesce(text, '') AS text FROM fx_coco_images i JOIN spl USING (source_image_id) LEFT JOIN t ON t.image_id = i.id", (IM, AN))
def _(t):
    images = D.split_images(t.coco_images(), D.split_sources(t.coco_images())).withColumns({"width": F.lit(900), "height": F.lit(900)})
    return D.yolo_dataset(images, t.coco_annotations().withColumn("segmentation", F.lit(None).cast("array<double>")), t.coco_categories()).select("image_id", "split", "text")


RAW = """raw AS (SELECT image_id, string_agg(CASE WHEN by_ > 800 THEN '0 0.1 0.2' ELSE concat_ws(' ', 0, printf('%.4f', bx / 950), '0.5', '0.5', '0.25', '0.75', printf('%.4f', by_ / 700)) END, chr(10)) AS text FROM fx_coco_annotations WHERE category_id <> 2 GROUP BY 1)"""


def raw_files(t):
    line = F.when(F.col("by_") > 800, "0 0.1 0.2").otherwise(F.concat_ws(" ", F.lit("0"), F.format_string("%.4f", F.col("bx") / 950), F.lit("0.5"), F.lit("0.5"), F.lit("0.25"), F.lit("0.75"), F.format_string("%.4f", F.col("by_") / 700)))
    texts = t.coco_annotations().where("category_id <> 2").groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return t.coco_images().select(F.col("id").alias("image_id")).join(texts, "image_id", "left").select(
        F.lit("train").alias("split"), F.col("image_id").alias("file"), F.coalesce("text", F.lit("")).alias("text"))


@query("label_validation", """WITH a AS (SELECT image_id, by_ > 800 AS poly, by_ <= 800 AND (round(bx / 950, 4) > 1 OR round(by_ / 700, 4) > 1) AS coords FROM fx_coco_annotations WHERE category_id <> 2)
SELECT (SELECT count(*) FROM fx_coco_images) AS n_files, count(*) FILTER (NOT poly) AS n_lines, count(*) FILTER (poly) AS n_bad_polygons, count(*) FILTER (coords) AS n_bad_coords,
  (SELECT count(*) FROM fx_coco_images WHERE id NOT IN (SELECT image_id FROM a)) AS n_empty FROM a""", (IM, AN))
def _(t):
    return D.label_validation(raw_files(t))


@query("first_issues", """WITH a AS (SELECT image_id AS file, CASE WHEN by_ > 800 THEN 'too few points' ELSE 'outside [0,1]' END AS issue FROM fx_coco_annotations WHERE category_id <> 2 AND (by_ > 800 OR round(bx / 950, 4) > 1 OR round(by_ / 700, 4) > 1))
SELECT (SELECT count(*) FROM (SELECT * FROM a LIMIT 20)) AS shown, greatest(0, count(*) - 20) AS n_more FROM a""", (AN,))
def _(t):
    return D.first_issues(raw_files(t)).groupBy("n_more").agg(F.count(F.lit(1)).alias("shown"))
