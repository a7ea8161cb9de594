"""Pixel-size and unit rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length units in nanometres, keyed by the cleaned unit text.
UNIT_TO_NM = {
    "nm": 1.0, "nanometer": 1.0, "nanometre": 1.0,
    "um": 1e3, "µm": 1e3, "micron": 1e3, "micrometer": 1e3,
    "pm": 1e-3, "picometer": 1e-3,
    "å": 0.1, "angstrom": 0.1, "a": 0.1,
    "m": 1e9,
}
NM_PER_INCH = 25.4e6
NM_PER_CM = 1e7


def unit_factor(unit: Column) -> Column:
    """Nanometres per unit; null when the unit is not known."""
    clean = F.replace(F.replace(F.lower(F.trim(unit)), F.lit("\x00"), F.lit("")), F.lit(" "), F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in UNIT_TO_NM.items() for x in pair])
    return F.try_element_at(table, clean)


def header_pixel_size(size: Column, unit: Column) -> Column:
    """Microscope header: unknown units count as nanometres; anything not positive is uncalibrated (null)."""
    nm = size * F.coalesce(unit_factor(unit), F.lit(1.0))
    return F.when(nm > 0, nm)


def spacing_pixel_size(spacing: Column, unit: Column) -> Column:
    """Image-processing metadata: unknown units stay uncalibrated (null)."""
    return F.when(spacing > 0, spacing * unit_factor(unit))


def resolution_pixel_size(pixels_per_unit: Column, resolution_unit: Column) -> Column:
    """TIFF resolution: unit 2 is per inch, 3 per centimetre, others carry no scale."""
    per = F.nullif(pixels_per_unit, F.lit(0.0))
    return F.when(resolution_unit == 2, NM_PER_INCH / per).when(resolution_unit == 3, NM_PER_CM / per)


def voxel_pixel_size(angstrom: Column) -> Column:
    return F.when(angstrom > 0, angstrom * 0.1)


def calibrate_by_bar(bar_length_nm: Column, bar_length_px: Column) -> Column:
    return F.when((bar_length_nm > 0) & (bar_length_px > 0), bar_length_nm / F.nullif(bar_length_px, F.lit(0.0)))


def calibrate_by_value(value: Column, unit: Column) -> Column:
    return F.when(value > 0, value * unit_factor(unit))


def normalise_voltage(voltage: Column) -> Column:
    return F.when(voltage > 1000, voltage / 1000.0).otherwise(voltage)


def nice_scale(pixel_size: Column, width: Column, fraction: float = 0.15) -> Column:
    """Round length nearest to `fraction` of the image width."""
    target = pixel_size * width * fraction
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(target, F.lit(1e-9)))))
    options = F.transform(F.lit([1.0, 2.0, 5.0, 10.0]), lambda m: F.struct(
        F.abs(magnitude * m - target).alias("gap"), (magnitude * m).alias("length")))
    return F.when(pixel_size <= 0, F.lit(100.0)).otherwise(F.array_min(options)["length"])


def _four_digits(value: Column) -> Column:
    """Four significant digits without trailing zeros; scientific from 10,000 up."""
    digits = F.greatest(F.lit(0), 3 - F.floor(F.log10(F.greatest(F.abs(value), F.lit(1e-300)))))
    scale = F.pow(F.lit(10.0), digits)
    plain = F.format_string("%.8f", F.rint(value * scale) / scale)
    tidy = F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", "")
    science = F.regexp_replace(F.regexp_replace(F.format_string("%.3e", value), r"0+e", "e"), r"\.e", "e")
    return F.when((F.abs(value) >= 9999.5) | ((value != 0) & (F.abs(value) < 1e-4)), science).otherwise(tidy)


def format_scale(length_nm: Column) -> Column:
    return (F.when(length_nm >= 1000, F.concat(_four_digits(length_nm / 1000.0), F.lit(" µm")))
            .when(length_nm < 1, F.concat(_four_digits(length_nm * 1000.0), F.lit(" pm")))
            .otherwise(F.concat(_four_digits(length_nm), F.lit(" nm"))))


def display_length(nm: Column) -> Column:
    return F.when(nm < 1000, F.concat(F.format_string("%.2f", nm), F.lit(" nm"))).otherwise(
        F.concat(F.format_string("%.3f", nm / 1000.0), F.lit(" µm")))


def display_area(nm2: Column) -> Column:
    return F.when(nm2 < 1e6, F.concat(F.format_string("%.0f", nm2), F.lit(" nm²"))).otherwise(
        F.concat(F.format_string("%.3f", nm2 / 1e6), F.lit(" µm²")))
