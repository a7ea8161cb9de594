"""Queries over sparse masks, drawn from the annotation boxes and from thresholded pixels."""

from pyspark.sql import functions as F

from mesograph.functions import geometry as G
from mesograph.operators import masks as K
from mesograph.queries.annotation import box
from mesograph.queries.registry import query

R = ("fx_rects",)
P = ("fx_pixels",)
MP = """mp AS (SELECT image_id, label, ann_id AS region_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (
  SELECT image_id, label, ann_id, y, unnest(range(ceil(x0)::BIGINT, ceil(x1)::BIGINT)) AS x FROM (SELECT *, unnest(range(ceil(y0)::BIGINT, ceil(y1)::BIGINT)) AS y FROM fx_rects)))"""


def outlines(t):
    return box(t.spread(t.rects())).withColumnRenamed("ann_id", "region_id")


def masks(t):
    return K.rasterize_roi(outlines(t), ["image_id", "label", "region_id"])


def runs(t):
    return K.rasterize_spans(outlines(t), ["image_id", "label", "region_id"])


def bands(t):
    return K.rasterize_bands(outlines(t), ["image_id", "label", "region_id"])


def covered():
    return F.sum(F.col("xb") - F.col("xa")).alias("n")


@query("rasterize_roi", f"WITH {MP} SELECT image_id, region_id, count(*) AS area, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(x) AS BIGINT) AS sum_x FROM mp GROUP BY 1, 2", R)
def _(t):
    return masks(t).groupBy("image_id", "region_id").agg(F.count(F.lit(1)).alias("area"), F.sum("y").alias("sum_y"), F.sum("x").alias("sum_x"))


@query("mask_bbox", f"""WITH {MP} SELECT image_id, region_id, min(x)::DOUBLE AS bx, min(y)::DOUBLE AS by_, (max(x) - min(x))::DOUBLE AS bw, (max(y) - min(y))::DOUBLE AS bh,
  avg(x) AS cx, avg(y) AS cy, count(*) AS area FROM mp GROUP BY 1, 2""", R, {6: "cx cy"})
def _(t):
    return K.mask_bbox(runs(t))


@query("filter_min_area", f"WITH {MP} SELECT image_id, region_id, count(*) AS area FROM mp GROUP BY 1, 2 HAVING count(*) >= 70", R)
def _(t):
    return K.mask_area(K.filter_min_area(runs(t), 70))


@query("masks_by_area_desc", f"WITH {MP} SELECT image_id, region_id, count(*) AS area FROM mp GROUP BY 1, 2", R)
def _(t):
    return K.masks_by_area_desc(runs(t))


@query("largest_region", f"""WITH {MP} SELECT image_id, region_id, area FROM (SELECT image_id, region_id, count(*) AS area FROM mp GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, region_id) = 1""", R)
def _(t):
    return K.largest_region(runs(t))


@query("label_mask_paint", f"""WITH {MP} SELECT image_id, region_id, count(*) AS n FROM (SELECT image_id, y, x, max(region_id) AS region_id FROM mp GROUP BY 1, 2, 3) GROUP BY 1, 2""", R)
def _(t):
    return K.label_mask_paint(bands(t)).groupBy("image_id", "region_id").agg(covered())


@query("compound_union", f"WITH {MP} SELECT label, image_id, count(*) AS n FROM (SELECT DISTINCT label, image_id, y, x FROM mp) GROUP BY 1, 2", R)
def _(t):
    return K.compound_union(runs(t)).groupBy("label", "image_id").agg(covered())


@query("compound_subtract_inner", f"""WITH {MP}, top AS (SELECT label, image_id, region_id FROM (SELECT label, image_id, region_id, count(*) AS area FROM mp GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY label, image_id ORDER BY area DESC, region_id) = 1)
SELECT label, image_id, count(*) AS n FROM (SELECT m.label, m.image_id, y, x FROM mp m GROUP BY ALL
HAVING bool_or((label, image_id, region_id) IN (FROM top)) AND NOT bool_or((label, image_id, region_id) NOT IN (FROM top))) GROUP BY 1, 2""".replace(
    "bool_or((label, image_id, region_id) IN (FROM top)) AND NOT bool_or((label, image_id, region_id) NOT IN (FROM top))",
    "bool_or(is_top) AND bool_and(is_top)").replace("FROM mp m GROUP BY ALL", "FROM (SELECT mp.*, top.region_id IS NOT NULL AS is_top FROM mp LEFT JOIN top USING (label, image_id, region_id)) m GROUP BY m.label, m.image_id, y, x"), R)
def _(t):
    return K.compound_subtract_inner(bands(t)).groupBy("label", "image_id").agg(covered())


@query("compound_auto", f"""WITH RECURSIVE {MP}, area AS (SELECT label, image_id, region_id, count(*) AS area FROM mp GROUP BY ALL),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY label, image_id ORDER BY area DESC, region_id) AS k FROM area),
over_ AS MATERIALIZED (SELECT label, image_id, k, lag(k) OVER w AS under_k, lead(k) OVER w IS NULL AS top FROM mp JOIN r USING (label, image_id, region_id)
  WINDOW w AS (PARTITION BY label, image_id, y, x ORDER BY k)),
e AS MATERIALIZED (SELECT label, image_id, k, list({{'u': under_k, 'n': n}}) AS found FROM (SELECT label, image_id, k, under_k, count(*) AS n FROM over_ WHERE under_k IS NOT NULL GROUP BY ALL) GROUP BY 1, 2, 3),
m AS MATERIALIZED (SELECT r.label, r.image_id, r.k, area, found FROM r LEFT JOIN e ON e.label = r.label AND e.image_id = r.image_id AND e.k = r.k),
f AS (SELECT label, image_id, CAST(0 AS BIGINT) AS k, CAST([] AS BOOLEAN[]) AS added FROM (SELECT DISTINCT label, image_id FROM r) UNION ALL
  SELECT f.label, f.image_id, m.k, list_append(added, coalesce(list_sum(list_transform(found, lambda q: CASE WHEN added[q.u] THEN q.n ELSE 0 END)), 0) / area <= 0.8)
  FROM f JOIN m ON m.label = f.label AND m.image_id = f.image_id AND m.k = f.k + 1),
last_ AS (SELECT label, image_id, arg_max(added, k) AS added FROM f GROUP BY 1, 2)
SELECT label, image_id, count(*) AS n FROM over_ JOIN last_ USING (label, image_id) WHERE top AND added[over_.k] GROUP BY 1, 2""", R)
def _(t):
    return K.compound_auto(bands(t)).groupBy("label", "image_id").agg(covered())


IOU = f"""{MP}, area AS (SELECT image_id, region_id, count(*) AS area FROM mp GROUP BY 1, 2),
iou AS (SELECT s.image_id, s.a, s.b, inter / (x.area + y.area - inter) AS iou FROM (
  SELECT a.image_id, a.region_id AS a, b.region_id AS b, count(*) AS inter FROM mp a JOIN mp b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x AND a.region_id < b.region_id GROUP BY 1, 2, 3) s
  JOIN area x ON x.image_id = s.image_id AND x.region_id = s.a JOIN area y ON y.image_id = s.image_id AND y.region_id = s.b)"""


@query("mask_iou", f"WITH {IOU} SELECT * FROM iou", R, {9: "iou"})
def _(t):
    return K.mask_iou(bands(t))


@query("mask_nms", f"""WITH RECURSIVE {IOU}, c AS MATERIALIZED (SELECT a, b FROM iou WHERE iou > 0.2 UNION ALL SELECT b, a FROM iou WHERE iou > 0.2),
s AS (SELECT ann_id, image_id, y1 - y0 AS score FROM fx_rects WHERE ann_id IN (SELECT a FROM c)),
better AS MATERIALIZED (SELECT c.a AS lo, c.b AS hi FROM c JOIN s x ON x.ann_id = c.a JOIN s y ON y.ann_id = c.b WHERE y.score > x.score OR (y.score = x.score AND y.ann_id < x.ann_id)),
d1 AS (SELECT ann_id FROM s WHERE ann_id NOT IN (SELECT lo FROM better)),
depth AS (SELECT ann_id, 0 AS d FROM d1 UNION SELECT b.lo, depth.d + 1 FROM depth JOIN better b ON b.hi = depth.ann_id WHERE depth.d < 40)
SELECT r.image_id, r.ann_id AS region_id FROM fx_rects r WHERE r.ann_id NOT IN (SELECT a FROM c)
UNION ALL SELECT s.image_id, s.ann_id FROM s WHERE ann_id IN (FROM d1)
UNION ALL SELECT s.image_id, s.ann_id FROM s WHERE ann_id NOT IN (FROM d1) AND NOT EXISTS (SELECT 1 FROM better b WHERE b.lo = s.ann_id AND b.hi IN (FROM d1))
  AND NOT EXISTS (SELECT 1 FROM better b WHERE b.lo = s.ann_id AND b.hi NOT IN (FROM d1) AND NOT EXISTS (SELECT 1 FROM better e WHERE e.lo = b.hi AND e.hi IN (FROM d1)))""", R)
def _(t):
    scores = t.rects().select("image_id", F.col("ann_id").alias("region_id"), (F.col("y1") - F.col("y0")).alias("score"))
    return K.mask_nms(bands(t), scores, 0.2)


FG = "fg AS (SELECT image_id, y, x FROM fx_pixels WHERE v > 0)"


def foreground(t):
    return t.pixels().where("v > 0").select("image_id", "y", "x")


@query("outside_all_masks", f"SELECT image_id, y, x FROM fx_pixels WHERE NOT v > 0", P)
def _(t):
    tiles = t.raw("embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    return K.outside_all_masks(tiles, foreground(t))


@query("rle_encode", """WITH f AS (SELECT image_id, x * 8 + y AS i, (v > 0) AS on_, (v > 0) <> lag(v > 0, 1, false) OVER (PARTITION BY image_id ORDER BY x * 8 + y) AS ch FROM fx_pixels),
g AS (SELECT image_id, i, on_, sum(CASE WHEN ch THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY i) AS run FROM f),
h AS (SELECT image_id, run, count(*) AS c, bool_or(on_) AS on_ FROM g GROUP BY 1, 2)
SELECT image_id, CASE WHEN min(run) > 0 THEN '0,' ELSE '' END || string_agg(c::VARCHAR, ',' ORDER BY run) AS counts FROM h GROUP BY 1 HAVING bool_or(on_)""", P)
def _(t):
    shape = t.raw("embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    rows = foreground(t).withColumn("region_id", F.lit(1))
    return K.rle_encode(rows, shape).select("image_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


def components_sql(near: str) -> str:
    return f"""{FG}, reach(image_id, ay, ax, y, x) AS (SELECT image_id, y, x, y, x FROM fg UNION
  SELECT r.image_id, ay, ax, f.y, f.x FROM reach r JOIN fg f ON f.image_id = r.image_id AND {near}),
comp AS (SELECT image_id, ay AS y, ax AS x, min(y * 8 + x) AS first_px FROM reach GROUP BY 1, 2, 3)"""


@query("connected_components", f"WITH RECURSIVE {components_sql('abs(f.y - r.y) + abs(f.x - r.x) = 1')} SELECT image_id, y, x, first_px FROM comp", P)
def _(t):
    return first_pixel(K.connected_regions(foreground(t), 4))


def first_pixel(regions):
    from mesograph.operators.ordering import join_on

    keys = [c for c in regions.columns if c not in ("y", "x")]
    first = regions.groupBy(*keys).agg(F.min(F.col("y") * 8 + F.col("x")).alias("first_px"))
    return join_on(regions, first, keys).drop("region_id")


COLOURS = "CASE WHEN v > 0.08 THEN 200 WHEN v > 0 THEN 90 ELSE 5 END"


def coloured(t):
    v = F.col("v")
    return t.pixels().select("image_id", "y", "x", F.when(v > 0.08, 200).when(v > 0, 90).otherwise(5).alias("r"), F.lit(10).alias("g"), F.lit(12).alias("b"))


@query("mask_colour_counts", f"SELECT {COLOURS} AS r, CAST(10 AS INT) AS g, CAST(12 AS INT) AS b, count(*) AS n FROM fx_pixels WHERE v > 0 GROUP BY 1", P)
def _(t):
    return K.mask_colour_counts(coloured(t))


@query("mask_to_regions", f"""WITH RECURSIVE {components_sql('abs(f.y - r.y) <= 1 AND abs(f.x - r.x) <= 1').replace('WHERE v > 0)', 'WHERE v > 0 AND v <= 0.08)')}
SELECT image_id, 'dim' AS label, y, x, first_px FROM comp JOIN (SELECT image_id, first_px FROM comp GROUP BY 1, 2 HAVING count(*) >= 9) USING (image_id, first_px)""", P)
def _(t):
    names = t.spark.createDataFrame([(90, 10, 12, "dim"), (200, 10, 12, " ")], "r int, g int, b int, label string")
    return first_pixel(K.mask_to_regions(coloured(t), names))


@query("semantic_mask", """WITH a AS (SELECT image_id, id, category_id, floor(bx)::BIGINT AS x0, floor(by_)::BIGINT AS y0, bw::BIGINT AS w, bh::BIGINT AS h FROM fx_coco_annotations WHERE category_id <> 2),
p AS (SELECT image_id, id, category_id, y, unnest(range(x0, x0 + w)) AS x FROM (SELECT *, unnest(range(y0, y0 + h)) AS y FROM a))
SELECT image_id, class_index, count(*) AS n FROM (SELECT image_id, y, x, CAST(arg_max(CASE category_id WHEN 1 THEN 1 ELSE 2 END, id) AS INT) AS class_index FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2""",
       ("fx_coco_annotations",))
def _(t):
    c = F.col("category_id")
    anns = t.spread(t.coco_annotations()).withColumns({"class_index": F.when(c == 1, 1).when(c == 4, 2).otherwise(0), "ann_order": F.col("id"),
                                                      "vertices": F.lit(None).cast("array<struct<x:double,y:double>>")})
    return K.semantic_mask(anns, as_runs=True).groupBy("image_id", "class_index").agg(covered())
