"""Annotation-shaped views over the given tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "fx_images": """
SELECT s_suppkey AS image_id, s_name AS name, 'cond' || CAST(s_nationkey % 3 AS VARCHAR) AS condition,
  CAST(0.5 + 0.25 * (s_suppkey % 4) AS DOUBLE) AS pixel_size_nm, 2200 AS width, 2200 AS height FROM supplier""",
    "fx_rects": """
SELECT l_suppkey AS image_id, concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey,
    CAST(round(l_extendedprice * 100) AS BIGINT)) AS ann_id, 'rectangle' AS type, l_returnflag AS label,
  l_quantity * 40 AS x0, l_extendedprice / 50 AS y0, l_quantity * 40 + 5 + l_linenumber AS x1,
  l_extendedprice / 50 + 5 + l_tax * 100 AS y1 FROM lineitem""",
    "fx_points": """
SELECT CAST(vec_id % 4 AS BIGINT) AS image_id, vec_id AS point_id, CAST(label AS VARCHAR) AS label,
  (CAST(embedding[1] AS DOUBLE) + 1) * 1000 AS x_nm, (CAST(embedding[2] AS DOUBLE) + 1) * 1000 AS y_nm
FROM embeddings""",
    "fx_pixels": """
SELECT vec_id AS image_id, label AS movie_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x,
  CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)""",
    "fx_frames": """
SELECT image_id, movie_id, CAST(dense_rank() OVER (PARTITION BY movie_id ORDER BY image_id) - 1 AS INT) AS frame, y, x, v
FROM fx_pixels""",
    "fx_detections": """
SELECT event_type AS sequence_id, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INT) AS frame,
  event_id AS ann_idx, value AS x_px, CAST(user_id AS DOUBLE) AS y_px FROM events""",
    "fx_measurements": """
SELECT p_partkey AS particle_id, p_brand AS label, p_retailprice AS ecd_nm, CAST(p_size AS DOUBLE) AS feret_nm
FROM part""",
    "fx_particles": """
SELECT p_partkey AS particle_id, p_brand AS label, p_retailprice - 950 AS SA_nm2,
  p_size % 7 = 0 AS flagged, CASE WHEN p_size % 7 = 0 THEN 'aggregate' WHEN p_size % 5 = 0 THEN '' END AS flag_reason,
  p_size % 6 = 0 AS is_hollow, p_size / 10.0::DOUBLE AS shell_thickness_estimate_nm,
  CASE p_type WHEN 'ECONOMY' THEN 'ellipsoid' WHEN 'PROMO' THEN 'cauchy' WHEN 'STANDARD' THEN 'fourier'
    WHEN 'SMALL' THEN 'fourier_spiky' ELSE 'capsule' END AS method_used FROM part""",
    "fx_coco_images": """
SELECT o_orderkey AS id, o_custkey AS source_image_id, 1024 AS width, 1024 AS height FROM orders""",
    "fx_coco_annotations": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
  l_orderkey AS image_id, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 4 END AS category_id,
  l_quantity * 20 AS bx, l_extendedprice / 110 AS by_, CAST(10 + l_linenumber AS DOUBLE) AS bw, CAST(12 AS DOUBLE) AS bh,
  l_extendedprice AS area FROM lineitem""",
    "fx_coco_categories": """
SELECT * FROM (VALUES (1, 'Foreground'), (2, 'Background'), (3, 'Ignore'), (4, 'N')) c(id, name)""",
}

NEEDS = {"fx_frames": ("fx_pixels",)}


def with_views(names: Sequence[str], body: str) -> str:
    """Prefix `body` with the named views as common table expressions."""
    ordered: list[str] = []
    for name in names:
        for item in (*NEEDS.get(name, ()), name):
            if item not in ordered:
                ordered.append(item)
    if not ordered:
        return body
    views = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in ordered)
    if body.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body.lstrip()[15:]}"
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {views},\n{body.lstrip()[5:]}"
    return f"WITH {views}\n{body}"


class Tables:
    """The same views as DataFrames; nothing is read until a query uses it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """Split up small single-block tables before CPU-bound steps; wide scans are left as they are."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def images(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("image_id"), F.col("s_name").alias("name"),
            F.concat(F.lit("cond"), (F.col("s_nationkey") % 3).cast("string")).alias("condition"),
            (0.5 + 0.25 * (F.col("s_suppkey") % 4)).cast("double").alias("pixel_size_nm"),
            F.lit(2200).alias("width"), F.lit(2200).alias("height"))

    def _line_key(self):
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        return F.concat_ws("-", *[F.col(c).cast("string") for c in
                                  ("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")], cents.cast("string"))

    def rects(self) -> DataFrame:
        x0, y0 = F.col("l_quantity") * 40, F.col("l_extendedprice") / 50
        return self.raw("lineitem").select(
            F.col("l_suppkey").alias("image_id"), self._line_key().alias("ann_id"), F.lit("rectangle").alias("type"),
            F.col("l_returnflag").alias("label"), x0.alias("x0"), y0.alias("y0"),
            (x0 + 5 + F.col("l_linenumber")).alias("x1"), (y0 + 5 + F.col("l_tax") * 100).alias("y1"))

    def points(self) -> DataFrame:
        def axis(i: int):
            return (F.get("embedding", F.lit(i)).cast("double") + 1) * 1000

        return self.raw("embeddings").select(
            (F.col("vec_id") % 4).cast("bigint").alias("image_id"), F.col("vec_id").alias("point_id"),
            F.col("label").cast("string").alias("label"), axis(0).alias("x_nm"), axis(1).alias("y_nm"))

    def pixels(self) -> DataFrame:
        return (self.raw("embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("movie_id"),
                                              F.posexplode("embedding").alias("i", "e"))
                .select("image_id", "movie_id", F.floor(F.col("i") / 8).cast("int").alias("y"),
                        (F.col("i") % 8).cast("int").alias("x"), F.col("e").cast("double").alias("v")))

    def frames(self) -> DataFrame:
        """Pixels of each movie with the rank of the image inside the movie as the frame number."""
        from mesograph.operators.ordering import ordered_index

        shots = self.raw("embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("movie_id"))
        numbered = ordered_index(shots, ["movie_id"], "image_id", out="frame")
        return (self.pixels().drop("movie_id").join(numbered, "image_id")
                .select("image_id", "movie_id", F.col("frame").cast("int").alias("frame"), "y", "x", "v"))

    def detections(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_type").alias("sequence_id"),
            F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("int").alias("frame"),
            F.col("event_id").alias("ann_idx"), F.col("value").alias("x_px"), F.col("user_id").cast("double").alias("y_px"))

    def measurements(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("particle_id"), F.col("p_brand").alias("label"),
            F.col("p_retailprice").alias("ecd_nm"), F.col("p_size").cast("double").alias("feret_nm"))

    def particles(self) -> DataFrame:
        size = F.col("p_size")
        method = F.lit("capsule")
        for kind, name in (("ECONOMY", "ellipsoid"), ("PROMO", "cauchy"), ("STANDARD", "fourier"), ("SMALL", "fourier_spiky")):
            method = F.when(F.col("p_type") == kind, name).otherwise(method)
        return self.raw("part").select(
            F.col("p_partkey").alias("particle_id"), F.col("p_brand").alias("label"),
            (F.col("p_retailprice") - 950).alias("SA_nm2"), (size % 7 == 0).alias("flagged"),
            F.when(size % 7 == 0, "aggregate").when(size % 5 == 0, "").alias("flag_reason"),
            (size % 6 == 0).alias("is_hollow"), (size / F.lit(10.0)).alias("shell_thickness_estimate_nm"),
            method.alias("method_used"))

    def coco_images(self) -> DataFrame:
        return self.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_image_id"),
                                         F.lit(1024).alias("width"), F.lit(1024).alias("height"))

    def coco_annotations(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return self.raw("lineitem").select(
            self._line_key().alias("id"), F.col("l_orderkey").alias("image_id"),
            F.when(flag == "R", 1).when(flag == "A", 2).otherwise(4).alias("category_id"),
            (F.col("l_quantity") * 20).alias("bx"), (F.col("l_extendedprice") / 110).alias("by_"),
            (10 + F.col("l_linenumber")).cast("double").alias("bw"), F.lit(12.0).alias("bh"),
            F.col("l_extendedprice").alias("area"))

    def coco_categories(self) -> DataFrame:
        return self.spark.createDataFrame([(1, "Foreground"), (2, "Background"), (3, "Ignore"), (4, "N")],
                                          "id int, name string")
