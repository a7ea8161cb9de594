"""Annotation rows: filters, joins, conversions, measurements and counts."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mesograph.functions import geometry as G
from mesograph.functions import hull as H
from mesograph.functions import labels as L

SHAPE_METRICS = ["area_nm2", "ecd_nm", "perimeter_nm", "circularity", "aspect_ratio", "feret_nm", "bbox_w_nm", "bbox_h_nm"]


# ---- filters and projections

def filter_by_type(df: DataFrame, types: Iterable[str] = tuple(L.AREA_TYPES)) -> DataFrame:
    return df.where(F.col("type").isin(list(types)))


def filter_by_label(df: DataFrame, labels: Sequence[str], empty_means_all: bool = True) -> DataFrame:
    if not labels and empty_means_all:
        return df
    return df.where(F.col("label").isin(list(labels)))


def rename_label(df: DataFrame, old: str, new: str) -> DataFrame:
    """Replace exact matches; `renamed` marks the rows that changed."""
    hit = F.col("label").eqNullSafe(F.lit(old))
    return df.withColumns({"renamed": hit, "label": F.when(hit, F.lit(new)).otherwise(F.col("label"))})


def filter_valid_polygon(df: DataFrame) -> DataFrame:
    return df.where(F.size("vertices") >= 3)


def filter_exclude_zone(df: DataFrame, zones: DataFrame) -> DataFrame:
    """Drop outlines whose vertex mean lies in the closed box zx0..zx1, zy0..zy1 of their image."""
    cx, cy = G.vertex_mean(F.col("vertices"), "x"), G.vertex_mean(F.col("vertices"), "y")
    inside = cx.between(F.col("zx0"), F.col("zx1")) & cy.between(F.col("zy0"), F.col("zy1"))
    return (df.join(zones, "image_id", "left").where(~F.coalesce(inside, F.lit(False)))
            .drop("zx0", "zx1", "zy0", "zy1"))


def offset_vertices(df: DataFrame, ox: str = "ox", oy: str = "oy") -> DataFrame:
    return df.withColumn("vertices", G.offset_vertices(F.col("vertices"), F.col(ox), F.col(oy)))


def filter_detections(df: DataFrame, min_conf: float, classes: Sequence[str] | None = None) -> DataFrame:
    out = df.where(F.col("conf") >= min_conf)
    return out.where(F.col("cls_name").isin(list(classes))) if classes else out


def detections_to_annotations(df: DataFrame, as_roi: bool) -> DataFrame:
    """A detected box as a rectangle, or as a four-corner outline."""
    box = G.box_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    if as_roi:
        return df.withColumns({"type": F.lit("roi"), "label": F.col("cls_name"), "vertices": box,
                               "area_nm2": F.lit(0.0)}).drop("x0", "y0", "x1", "y1")
    return df.withColumns({"type": F.lit("rectangle"), "label": F.col("cls_name")})


def picks_to_annotations(df: DataFrame, radius_px: float = 50.0, label: str = "Foreground") -> DataFrame:
    return df.withColumns({"type": F.lit("roi"), "label": F.lit(label), "area_nm2": F.lit(0.0),
                           "vertices": G.regular_polygon(F.col("x"), F.col("y"), F.lit(radius_px))})


def filter_unflagged(df: DataFrame, include_flagged: bool = False) -> DataFrame:
    return df if include_flagged else df.where(~F.col("flagged"))


def filter_positive(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value) > 0)


def frame_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Keep the 1-based inclusive range; an end of 0 keeps everything from the start on."""
    if end and start >= end:
        raise ValueError("frame range needs start < end")
    upper = F.lit(True) if not end else F.col("frame") <= end - 1
    return df.where((F.col("frame") >= start - 1) & upper)


# ---- joins

def attach_pixel_size(df: DataFrame, overrides: DataFrame, headers: DataFrame, sidecars: DataFrame) -> DataFrame:
    """First positive of manual override, image header and sidecar, else 1.0 marked as uncalibrated."""
    def positive(name: str) -> Column:
        return F.when(F.col(name) > 0, F.col(name))

    out = df
    for side, name in ((overrides, "_o"), (headers, "_h"), (sidecars, "_s")):
        out = out.join(side.select("image_id", F.col("pixel_size_nm").alias(name)), "image_id", "left")
    known = F.coalesce(positive("_o"), positive("_h"), positive("_s"))
    return out.withColumns({"calibrated": known.isNotNull(), "pixel_size_nm": F.coalesce(known, F.lit(1.0))}
                           ).drop("_o", "_h", "_s")


def join_annotations_to_images(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images with their annotations; an image without any stays with nulls."""
    return images.join(annotations, "image_id", "left")


def join_categories(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return (annotations.join(names, "category_id", "left")
            .withColumn("category", F.coalesce("category", F.lit("unknown"))))


def coco_subset(annotations: DataFrame, image_ids: DataFrame) -> DataFrame:
    return annotations.join(image_ids.select("image_id"), "image_id", "left_semi")


def unannotated_images(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return images.join(annotations.select("image_id"), "image_id", "left_anti")


def export_queue_dedupe(queue: DataFrame) -> DataFrame:
    """Keep the first queued row of each stem; an aggregate, so a stem queued over and over costs no sort."""
    first = queue.groupBy("stem").agg(F.min_by(F.struct(*[c for c in queue.columns if c != "stem"]), "seq").alias("_f"))
    return first.select("stem", "_f.*").select(*queue.columns)


def label_pairs(df: DataFrame, ordered: bool) -> DataFrame:
    """Pairs of the distinct labels of each image, both ways round or once."""
    seen = df.groupBy("image_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    pairs = (seen.select("image_id", F.explode("labels").alias("label_a"), "labels")
             .select("image_id", "label_a", F.explode("labels").alias("label_b")))
    return pairs.where(F.col("label_a") != F.col("label_b")) if ordered else pairs.where(F.col("label_a") < F.col("label_b"))


# ---- measurements

def rect_metric_columns(px: Column) -> dict[str, Column]:
    w, h = F.abs(F.col("x1") - F.col("x0")) * px, F.abs(F.col("y1") - F.col("y0")) * px
    area, perim = w * h, 2.0 * (w + h)
    return {"area_nm2": area, "ecd_nm": G.ecd(area), "perimeter_nm": perim, "circularity": G.circularity(area, perim),
            "aspect_ratio": G.aspect(w, h), "feret_nm": F.hypot(w, h), "bbox_w_nm": w, "bbox_h_nm": h}


def circle_metric_columns(px: Column) -> dict[str, Column]:
    r = F.col("r") * px
    return {"area_nm2": math.pi * r * r, "ecd_nm": 2.0 * r, "perimeter_nm": 2.0 * math.pi * r,
            "circularity": F.lit(1.0), "aspect_ratio": F.lit(1.0), "feret_nm": 2.0 * r, "bbox_w_nm": 2.0 * r,
            "bbox_h_nm": 2.0 * r}


def polygon_metric_columns(px: Column, oriented: bool = True) -> dict[str, Column]:
    """Outline measures; `oriented` takes aspect and Feret from the hull, else the bounding box is used."""
    v = F.col("vertices")
    area, perim = G.shoelace(v) * px * px, G.perimeter(v) * px
    w, h = G.extent(v, "x") * px, G.extent(v, "y") * px
    if oriented:
        hull = F.col("_hull")
        long_aspect, feret = G.aspect(hull["rect_long"], hull["rect_short"]), hull["feret"] * px
    else:
        long_aspect, feret = G.aspect(w, h), G.feret_pairs(v) * px
    return {"area_nm2": area, "ecd_nm": G.ecd(area), "perimeter_nm": perim, "circularity": G.circularity(area, perim),
            "aspect_ratio": long_aspect, "feret_nm": feret, "bbox_w_nm": w, "bbox_h_nm": h}


def _rounded(columns: dict[str, Column]) -> dict[str, Column]:
    return {name: F.round(c, 4) for name, c in columns.items()}


def rect_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns(_rounded(rect_metric_columns(F.col("pixel_size_nm"))))


def circle_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns(_rounded(circle_metric_columns(F.col("pixel_size_nm"))))


def polygon_metrics(df: DataFrame, oriented: bool = True) -> DataFrame:
    """Outlines under three vertices and images without a positive pixel size give no row."""
    work = df.where((F.size("vertices") >= 3) & (F.col("pixel_size_nm") > 0))
    if oriented:
        work = work.withColumn("_hull", H.hull_measures(F.col("vertices")))
    return work.withColumns(_rounded(polygon_metric_columns(F.col("pixel_size_nm"), oriented))).drop("_hull")


def measure_annotations(df: DataFrame) -> DataFrame:
    """Shape measures of outlines, circles and boxes in one pass over one wide annotation table; aspect and Feret diameter of outlines
    are those of the hull, as in `polygon_metrics`."""
    px = F.col("pixel_size_nm")
    kinds = {"roi": polygon_metric_columns(px), "circle": circle_metric_columns(px),
             "rectangle": rect_metric_columns(px)}
    out = df.where(F.col("type").isin(L.AREA_TYPES) & (px > 0)
                   & ((F.col("type") != "roi") | (F.size("vertices") >= 3)))
    outline = F.coalesce(F.when(F.col("type") == "roi", F.col("vertices")), F.array().cast(df.schema["vertices"].dataType))
    out = out.withColumn("_hull", H.hull_measures(outline))
    picked = {}
    for metric in SHAPE_METRICS:
        value = F.lit(None).cast("double")
        for kind, columns in kinds.items():
            value = F.when(F.col("type") == kind, columns[metric]).otherwise(value)
        picked[metric] = F.round(value, 4)
    return out.withColumns(picked).drop("_hull")


def distance_columns(px: Column) -> dict[str, Column]:
    pixels = F.hypot(F.col("p2.x") - F.col("p1.x"), F.col("p2.y") - F.col("p1.y"))
    return {"distance_px": pixels, "distance_nm": pixels * px}


def fill_missing_area(df: DataFrame) -> DataFrame:
    px = F.col("pixel_size_nm")
    return df.withColumn("area_nm2", F.when((F.col("type") == "roi") & (F.col("area_nm2") == 0),
                                            G.shoelace(F.col("vertices")) * px * px).otherwise(F.col("area_nm2")))


def tracking_centroid(axis: str) -> Column:
    """Vertex mean, circle centre, box centre or segment midpoint, by type."""
    kind = F.col("type")
    return (F.when(kind == "circle", F.col(f"c{axis}"))
            .when(kind == "rectangle", (F.col(f"{axis}0") + F.col(f"{axis}1")) / 2.0)
            .when((kind == "roi") & (F.size("vertices") > 0), G.vertex_mean(F.col("vertices"), axis))
            .when(kind.isin("arrow", "line", "distance"), (F.col(f"p1.{axis}") + F.col(f"p2.{axis}")) / 2.0))


def spatial_centroid(axis: str) -> Column:
    """Area centroid of outlines, centre of circles and boxes; null for everything else."""
    kind = F.col("type")
    return (F.when(kind == "circle", F.col(f"c{axis}"))
            .when(kind == "rectangle", (F.col(f"{axis}0") + F.col(f"{axis}1")) / 2.0)
            .when((kind == "roi") & (F.size("vertices") > 0), G.area_centroid(F.col("vertices"), axis)))


# ---- counts

def label_counts(df: DataFrame, group: str = "label") -> DataFrame:
    """Counts per image and label, per label, per image and overall in one pass; null marks the subtotal."""
    return (df.cube("image_id", group).agg(F.count(F.lit(1)).alias("n"),
                                           F.grouping("image_id").cast("int").alias("all_images"),
                                           F.grouping(group).cast("int").alias("all_labels")))


def dataset_overview(images: DataFrame, annotations: DataFrame) -> DataFrame:
    per_image = annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return (images.select("image_id").join(per_image, "image_id", "left")
            .agg(F.count(F.lit(1)).alias("n_images"), F.count("n").alias("images_annotated"),
                 F.coalesce(F.sum("n"), F.lit(0)).alias("total_annotations")))


def calibration_report(images: DataFrame, annotations: DataFrame) -> DataFrame:
    counts = annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_annotations"))
    return (images.join(counts, "image_id", "left")
            .select("image_id", "name", "pixel_size_nm", "calibrated",
                    F.coalesce("n_annotations", F.lit(0)).cast("bigint").alias("n_annotations")))


def image_overview(images: DataFrame, limit: int = 60) -> DataFrame:
    """At most `limit` images: all in order when they fit, else annotated, queued and current ones first."""
    keyed = images.withColumn("_late", ~((F.col("annotation_count") > 0) | F.col("queued") | F.col("is_current")))
    return keyed.orderBy("_late", "image_id").limit(limit).drop("_late")


def folder_inventory(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Image files with the outline count, the sorted labels and the pixel size found in their sidecars."""
    side = annotations.groupBy("stem").agg(
        F.count_if(F.col("type") == "roi").alias("n_rois"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("type") == "roi", F.nullif(F.col("label"), F.lit(""))))),
                     ", ").alias("labels"),
        F.max("pixel_size_nm").alias("pixel_size_nm"))
    return (images.join(side, "stem", "left")
            .select("path", "stem", F.coalesce("n_rois", F.lit(0)).cast("bigint").alias("n_rois"),
                    F.coalesce("labels", F.lit("")).alias("labels"),
                    F.coalesce("pixel_size_nm", F.lit(0.0)).alias("pixel_size_nm")))
