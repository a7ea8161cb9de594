"""Whole analyses put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesograph.operators import annotations as A
from mesograph.operators import compare as C
from mesograph.operators import dataset as D
from mesograph.operators import describe as S
from mesograph.operators import spatial as P
from mesograph.operators import surface as U


def measurement_report(annotations: DataFrame, images: DataFrame) -> dict[str, DataFrame]:
    """Shape measures of all annotations and their statistics per label."""
    measured = A.measure_annotations(annotations.join(images.select("image_id", "pixel_size_nm"), "image_id"))
    return {"measurements": measured, "statistics": S.measurement_stats(measured, "label", A.SHAPE_METRICS)}


def surface_report(particles: DataFrame, method: str = "auto") -> dict[str, DataFrame | str]:
    """Surface area per particle and the comparison of the labels."""
    results = U.estimate_surface_area(particles, method)
    return {"particles": results, **C.compare_groups(results, "label", "SA_nm2")}


def spatial_report(points: DataFrame, images: DataFrame, eps: float, min_samples: int = 3) -> dict[str, DataFrame]:
    """Clustering of each image and of each condition."""
    batch = P.spatial_batch(points, images, eps, min_samples)
    return {"images": batch, "conditions": P.condition_summary(batch)}


def finalize_dataset(images: DataFrame, annotations: DataFrame, val_frac: float = 0.1, test_frac: float = 0.1, seed: int = 42,
                     explicit: DataFrame | None = None) -> dict[str, DataFrame]:
    """Leakage-free splits, their manifests and the statistics of the set."""
    split = D.split_images(images, D.split_sources(images, val_frac, test_frac, seed, explicit))
    placed = annotations.join(split.select(F.col("id").alias("image_id"), "split"), "image_id")
    return {"images": split, "annotations": placed, "stats": D.dataset_stats(images, annotations)}
