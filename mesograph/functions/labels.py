"""Text rules: labels, names, groups and significance marks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds by extension, category names left out of training, default categories.
IMAGE_EXTENSIONS = [".dm4", ".tif", ".tiff", ".mrc", ".mrcs", ".png", ".jpg", ".jpeg"]
SKIPPED_CATEGORIES = ["background", "ignore"]
DEFAULT_CATEGORIES = [(1, "Foreground"), (2, "Background"), (3, "Ignore")]
ANNOTATION_TYPES = ["arrow", "line", "circle", "rectangle", "text", "scalebar", "distance", "angle", "roi"]
AREA_TYPES = ["roi", "circle", "rectangle"]


def normalize_label(label: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(label), F.lit("")), F.lit("Unlabelled"))


def display_label(label: Column, text: Column) -> Column:
    """Label, else the text of a text annotation, else "unknown"."""
    return F.coalesce(F.nullif(label, F.lit("")), F.nullif(text, F.lit("")), F.lit("unknown"))


def group_key(label: Column, image: Column, across_images: bool) -> Column:
    return label if across_images else F.concat_ws(" / ", label, image)


def condition_from_name(name: Column, pattern: str | None) -> Column:
    """First capture group of the pattern, else its whole match; "all" without a usable pattern."""
    pattern = (pattern or "").strip()
    if not pattern:
        return F.lit("all")
    try:
        groups = re.compile(pattern).groups
    except re.error:
        return F.lit("all")
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1 if groups else 0)).otherwise(F.lit("(no match)"))


def safe_name(name: Column) -> Column:
    clean = F.regexp_replace(name, r"[^\w\-.]", "_")
    return (F.when(clean.rlike(r"^\d"), F.concat(F.lit("img_"), clean))
            .when(clean == "", F.lit("image")).otherwise(clean))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def is_trainable(name: Column) -> Column:
    return ~F.lower(name).isin(SKIPPED_CATEGORIES)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def one_of(values: Sequence[str], column: Column) -> Column:
    return column.isin(list(values))
