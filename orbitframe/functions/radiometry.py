"""Amplitude, power and decibels; polynomials, calibration, noise, and terrain factors as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floor of a detected amplitude, of residual power, and bounds of terrain factors.
AMPLITUDE_FLOOR, RESIDUAL_FLOOR, FACTOR_MIN, FACTOR_MAX, M_PER_DEGREE = 1e-6, 1e-12, 0.1, 10.0, 111_320.0


def valid(x: Column, nodata: float | None = None) -> Column:
    """The value, or null where it is null, not finite, not positive or nodata."""
    inf = F.lit(float("inf"))
    good = x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < inf)
    return F.when(good & (x != nodata) if nodata is not None else good, x)


def amplitude(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def amplitude_db(a: Column) -> Column:
    """20 log10, never below the amplitude floor."""
    return 20 * F.log10(F.greatest(a, F.lit(AMPLITUDE_FLOOR)))


def db(a: Column) -> Column:
    return 20 * F.log10(F.when(a > 0, a))


def power(a: Column, decibels: bool = False) -> Column:
    return F.pow(F.lit(10.0), a / 10) if decibels else a * a


def power_db(p: Column) -> Column:
    return 10 * F.log10(F.when(p > 0, p))


def polynomial(coefs: list[list[float]], x: Column, y: Column) -> Column:
    """Sum of c[i][j] x^i y^j by Horner's rule, written out as one expression."""
    out = F.lit(0.0)
    for line in reversed(coefs):
        inner = F.lit(0.0)
        for c in reversed(line):
            inner = inner * y + F.lit(float(c))
        out = out * x + inner
    return out


def image_metres(row: Column, col: Column, grid: dict) -> tuple[Column, Column]:
    """Metres from the scene centre of a pixel, from spacing, centre and first pixel."""
    return (row + grid.get("first_row", 0) - grid["scp_row"]) * grid["row_ss"], (col + grid.get("first_col", 0) - grid["scp_col"]) * grid["col_ss"]


def calibrated(a: Column, scale: Column, decibels: bool = False) -> Column:
    """Amplitude times the root of the scale, or dB plus 10 log10 of it; a scale that isn't positive fails the job."""
    bad = scale.isNull() | F.isnan(scale) | (scale <= 0) | (scale == float("inf"))
    checked = F.when(~bad, scale).otherwise(F.raise_error(F.lit("the radiometric scale isn't positive and finite")).cast("double"))
    return a + 10 * F.log10(checked) if decibels else a * F.sqrt(checked)


def denoised(p: Column, noise: Column) -> Column:
    """Power less noise, never below the floor; see floored() for how often that holds."""
    return F.greatest(p - noise, F.lit(RESIDUAL_FLOOR))


def floored(p: Column, noise: Column) -> Column:
    return F.avg(((p - noise) <= RESIDUAL_FLOOR).cast("double"))


def margin_db(median: Column, floor: Column) -> Column:
    return F.when((median > 0) & (floor > 0), 10 * F.log10(median / floor))


def look_vector(incidence_deg: Column, azimuth_deg: Column) -> tuple[Column, Column, Column]:
    t, a = F.radians(incidence_deg), F.radians(azimuth_deg)
    return F.sin(t) * F.sin(a), F.sin(t) * F.cos(a), F.cos(t)


def cos_incidence(normal: tuple[Column, Column, Column], look: tuple[Column, Column, Column]) -> Column:
    return normal[0] * look[0] + normal[1] * look[1] + normal[2] * look[2]


def _bounded(factor: Column) -> Column:
    return F.greatest(F.lit(FACTOR_MIN), F.least(F.lit(FACTOR_MAX), factor))


def _cosine(cos_local: Column, cos_ref: Column) -> Column:
    return F.greatest(F.lit(1e-3), F.least(F.lit(1.0), F.when(cos_local.isNull() | F.isnan(cos_local), cos_ref).otherwise(cos_local)))


def flatten_cosine(cos_local: Column, cos_ref: Column) -> Column:
    return _bounded(cos_ref / _cosine(cos_local, cos_ref))


def flatten_gamma(cos_local: Column, nz: Column, cos_ref: Column) -> Column:
    up = F.when(nz.isNull() | F.isnan(nz), F.lit(1.0)).otherwise(nz)
    return _bounded(cos_ref * up / _cosine(cos_local, cos_ref))


def range_incidence(normal: tuple[Column, Column, Column], incidence_deg: Column, azimuth_deg: Column) -> Column:
    a = F.radians(azimuth_deg)
    return F.radians(incidence_deg) - F.atan2(normal[0] * F.sin(a) + normal[1] * F.cos(a), normal[2])


def flatten_area(local: Column, sin_ref: Column) -> Column:
    s = F.sin(local)
    return _bounded(F.greatest(F.lit(1e-3), F.when(s.isNull() | F.isnan(s), sin_ref).otherwise(s)) / sin_ref)
