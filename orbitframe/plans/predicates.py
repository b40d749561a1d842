"""SearchSpec -> Column.  Whatever the scan can use is a plain comparison of a top-level column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matching
from ..functions.geometry import meets
from .spec import SearchSpec

BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def overlaps(box: tuple[float, float, float, float]) -> Column:
    """Inclusive on all sides; a row without a box never overlaps."""
    w, s, e, n = box
    return (F.col("min_lon") <= e) & (F.col("max_lon") >= w) & (F.col("min_lat") <= n) & (F.col("max_lat") >= s)


def conditions(spec: SearchSpec) -> list[Column]:
    """Conjuncts of a validated spec, but for a fuzzy area, which needs the site names."""
    day, out = F.col("acq_date"), []
    if spec.start is not None:
        out.append(day.isNull() | (day >= F.lit(spec.start)))  # undated acquisitions pass
    if spec.end is not None:
        out.append(day.isNull() | (day <= F.lit(spec.end)))
    if spec.area and not spec.fuzzy:
        out.append(matching.contains(F.col("task"), spec.area))
    if box := spec.box():
        hit = overlaps(box)
        out.append(hit)
    if spec.products:
        out.append(F.arrays_overlap("products", F.array(*map(F.lit, spec.products))))
    if spec.polarizations:
        out.append(F.arrays_overlap(F.transform("polarizations", F.upper), F.array(*map(F.lit, spec.polarizations))))
    if spec.min_incidence is not None:
        out.append(F.col("incidence") >= spec.min_incidence)
    if spec.max_incidence is not None:
        out.append(F.col("incidence") <= spec.max_incidence)
    if spec.max_resolution is not None:
        out.append((F.col("res_range") <= spec.max_resolution) & (F.col("res_azimuth") <= spec.max_resolution))
    if spec.ids:
        out.append(F.col("id").isin(*spec.ids))
    if spec.rings:
        out.append(meets(spec.rings, F.col("rings"), tuple(F.col(c) for c in BOX)))
    return out


def select(acq: DataFrame, spec: SearchSpec) -> DataFrame:
    """The rows that a validated spec wants.

    A fuzzy area is matched once for each distinct site name; the names that match meet the rows in a semi join.
    """
    found = conditions(spec)
    out = acq.where(reduce(lambda a, b: a & b, found)) if found else acq
    if spec.area and spec.fuzzy:
        names = acq.select("task").where("task is not null").distinct()
        out = out.join(names.where(matching.fuzzy(F.col("task"), spec.area)), "task", "left_semi")
    return out
