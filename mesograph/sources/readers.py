"""Readers: text formats become wide annotation rows through explicit schemas, record by record and tolerantly."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mesograph.functions import labels as L
from mesograph.functions.geometry import point
from mesograph.schemas import ANNOTATION_JSON, COCO_JSON, LABEL_ENTRY, MEASUREMENTS


def scan_images(spark: SparkSession, folder: str, extensions: Iterable[str] = tuple(L.IMAGE_EXTENSIONS)) -> DataFrame:
    """Image files of one folder by extension, in path order; file contents are not read."""
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(folder)
    listed = files.select("path", "length", L.file_name(F.col("path")).alias("name"), L.stem(F.col("path")).alias("stem"), L.extension(F.col("path")).alias("ext"))
    return listed.where(F.col("ext").isin([e.lower() for e in extensions])).orderBy("path")


def content_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """MD5 over all bytes of each file."""
    return spark.read.format("binaryFile").load(folder).select("path", F.md5("content").alias("fingerprint"))


def drop_same_content(fingerprints: DataFrame) -> DataFrame:
    """The first path of each distinct content."""
    return fingerprints.groupBy("fingerprint").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its path and text; partition folders such as stem=... become columns."""
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


# ---- annotations

def _corner(c: str) -> Column:
    pair = F.col(f"_r.{c}")
    return F.when(F.size(pair) >= 2, point(F.get(pair, F.lit(0)), F.get(pair, F.lit(1))))


def explode_annotations(df: DataFrame, json_list: str, keep: Iterable[str]) -> DataFrame:
    """One row per readable record of a JSON list column; unknown types and broken records are dropped, extra keys ignored."""
    keep = list(keep)
    records = df.select(*keep, F.posexplode(F.from_json(json_list, "array<string>")).alias("ann_idx", "_j"))
    parsed = records.withColumn("_r", F.from_json("_j", ANNOTATION_JSON)).where(F.col("_r.type").isin(L.ANNOTATION_TYPES))
    outline = F.transform(F.col("_r.vertices"), lambda v: point(F.get(v, F.lit(0)), F.get(v, F.lit(1))))
    # An outline that is there but is not a list of coordinate pairs makes its record broken.
    pairs = F.forall(F.col("_r.vertices"), lambda v: (F.size(v) == 2) & F.get(v, F.lit(0)).isNotNull() & F.get(v, F.lit(1)).isNotNull())
    whole = F.get_json_object("_j", "$.vertices").isNull() | F.coalesce(pairs, F.lit(False))
    flat = ["cx", "cy", "r", "x0", "y0", "x1", "y1", "x", "y", "nm", "distance_nm", "distance_px", "angle_deg", "calibrated", "color"]
    return parsed.where(whole).select(
        *keep, "ann_idx", F.col("_r.type").alias("type"), F.coalesce(F.col("_r.label"), F.lit("")).alias("label"), F.col("_r.text").alias("text"), _corner("p1").alias("p1"), _corner("p2").alias("p2"),
        _corner("vertex").alias("vertex"), outline.alias("vertices"), F.coalesce("_r.area_nm2", F.lit(0.0)).alias("area_nm2"), *[F.col(f"_r.{c}").alias(c) for c in flat])


def parse_sidecars(texts: DataFrame) -> DataFrame:
    """Sidecar texts (value and any keys): an object with annotations and image settings, or the older bare list."""
    keys = [c for c in texts.columns if c != "value"]
    bare = F.ltrim("value").startswith("[")
    box = F.from_json(F.get_json_object("value", "$.exclude_zone"), "array<double>")
    crop = F.from_json(F.get_json_object("value", "$.crop_region"), "array<double>")
    split = texts.select(*keys, F.when(bare, F.col("value")).otherwise(F.get_json_object("value", "$.annotations")).alias("_l"),
                         F.get_json_object("value", "$.pixel_size_nm").try_cast("double").alias("pixel_size_nm"), box.alias("exclude_zone"), crop.alias("crop_region"))
    return explode_annotations(split, "_l", [*keys, "pixel_size_nm", "exclude_zone", "crop_region"])


def read_sidecars(spark: SparkSession, path: str, suffix: str = ".annotations.json") -> DataFrame:
    """Sidecar files next to images; the stem is the file name without `suffix`, or a stem=... folder."""
    texts = whole_texts(spark, path)
    if "stem" not in texts.columns:
        name = F.ltrim(L.file_name(F.col("path")), F.lit("."))
        texts = texts.where(name.endswith(suffix)).withColumn("stem", F.substring(name, F.lit(1), F.length(name) - len(suffix)))
    return parse_sidecars(texts)


def read_annotations_json(spark: SparkSession, path: str) -> DataFrame:
    """Plain lists of annotations."""
    return explode_annotations(whole_texts(spark, path), "value", ["path"])


def read_session(spark: SparkSession, path: str) -> DataFrame:
    """Session files of version 1 (lists per image path) or 2 (objects per image path); others are an error."""
    texts = whole_texts(spark, path).select(F.from_json("value", "version INT, images MAP<STRING, STRING>").alias("s"))
    known = F.when(F.col("s.version").isin(1, 2), F.col("s.images")).otherwise(
        F.raise_error(F.concat(F.lit("unknown session version "), F.coalesce(F.col("s.version").cast("string"), F.lit("null")))).cast("map<string,string>"))
    return parse_sidecars(texts.select(F.explode(known).alias("image_path", "value")))


def read_label_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Label manifests {index: {label, color, vertices, area_nm2}}; one row per region.  The image is the file name before `.json`, or an image_id=... folder."""
    texts = whole_texts(spark, path)
    if "image_id" not in texts.columns:
        texts = texts.withColumn("image_id", L.stem(F.col("path")))
    keys = [c for c in texts.columns if c != "value"]
    rows = texts.select(*keys, F.explode(F.from_json("value", f"MAP<STRING, STRUCT<{LABEL_ENTRY.replace(' STRING', ': STRING').replace(' ARRAY', ': ARRAY').replace(' DOUBLE', ': DOUBLE')}>>")).alias("k", "e"))
    return rows.select(*keys, F.col("k").cast("int").alias("region_id"), "e.label", "e.color",
                       F.transform("e.vertices", lambda v: point(F.get(v, F.lit(0)), F.get(v, F.lit(1)))).alias("vertices"), "e.area_nm2")


def read_star_picks(spark: SparkSession, path: str, x_col: str = "_rlnCoordinateX", y_col: str = "_rlnCoordinateY", class_col: str = "_rlnClassNumber") -> DataFrame:
    """Particle picks of STAR files: every loop with both coordinate columns, short and unreadable rows left out."""
    wanted = [c.lower() for c in (x_col, y_col, class_col)]

    def picks(path: str, text: str) -> Iterator[tuple[str, float, float, int]]:
        columns: list[str] = []
        looping = False
        for line in map(str.strip, text.splitlines()):
            if not line or line.startswith("#"):
                continue
            if line.startswith("data_") or line == "loop_":
                columns, looping = [], line == "loop_"
            elif looping and line.startswith("_"):
                columns.append(line.split()[0].lower())
            elif looping and wanted[0] in columns and wanted[1] in columns:
                cells = dict(zip(columns, line.split()))
                try:
                    x, y = float(cells[wanted[0]]), float(cells[wanted[1]])
                except (KeyError, ValueError):
                    continue
                number = cells.get(wanted[2], "1")
                yield path, x, y, int(number) if number.lstrip("+-").isdigit() else 1

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, text in zip(batch["path"], batch["value"]):
                yield pd.DataFrame(list(picks(path, text)), columns=["source", "x", "y", "class"])

    return whole_texts(spark, path).select("path", "value").mapInPandas(parse, "source string, x double, y double, class int")


# ---- manifests and tables

def read_coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A training manifest as three tables; an empty one has the default categories."""
    doc = whole_texts(spark, path).select(F.from_json("value", COCO_JSON).alias("d"))
    out = {part: doc.select(F.explode(f"d.{part}").alias("e")).select("e.*") for part in ("images", "annotations", "categories")}
    if out["categories"].limit(1).count() == 0:
        out["categories"] = spark.createDataFrame(L.DEFAULT_CATEGORIES, "id int, name string")
    return out


def read_measurements_csv(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Measurement tables by source name, overlaid with a `source` column."""
    return overlay_datasets({name: spark.read.option("header", True).option("enforceSchema", False).schema(MEASUREMENTS).csv(path) for name, path in paths.items()})


def overlay_datasets(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, table in tables.items():
        tagged = table.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no measurement table given")
    return out
