"""Rings of WGS84 points: parsing on the driver, exact intersection in vectorised Python, the rest as columns."""

from __future__ import annotations

import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError

Ring = list[tuple[float, float]]


def _ring(points: Any) -> Ring:
    out = []
    for p in points if isinstance(points, (list, tuple)) else ():
        if not isinstance(p, (list, tuple)) or len(p) < 2 or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in p[:2]):
            raise PlanError("a ring's positions are pairs of numbers")
        out.append((float(p[0]), float(p[1])))
    if len(out) < 3:
        raise PlanError("a ring has at least three positions")
    return out


def parse_geometry(value: Any) -> list[Ring]:
    """Exterior rings of a Polygon, MultiPolygon, Feature, FeatureCollection or GeometryCollection; holes are dropped, and an area without any ring is an error."""
    rings = _rings_of(value)
    if not rings:
        raise PlanError("the geometry has no polygon")
    return rings


def _rings_of(value: Any) -> list[Ring]:
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError as e:
            raise PlanError("the geometry isn't JSON") from e
    kind = value.get("type") if isinstance(value, dict) else None
    if kind == "Feature":
        return _rings_of(value.get("geometry"))
    if kind == "FeatureCollection":
        return [r for f in value.get("features") or [] for r in _rings_of(f)]
    if kind == "GeometryCollection":
        return [r for g in value.get("geometries") or [] for r in _rings_of(g)]
    if kind == "Polygon" and value.get("coordinates"):
        return [_ring(value["coordinates"][0])]
    if kind == "MultiPolygon" and value.get("coordinates"):
        return [_ring(p[0]) for p in value["coordinates"]]
    raise PlanError(f"unsupported geometry {kind!r}")


def to_geojson(rings: list[Ring]) -> dict:
    closed = [[[list(p) for p in (r if r[0] == r[-1] else [*r, r[0]])]] for r in rings]
    return {"type": "Polygon", "coordinates": closed[0]} if len(closed) == 1 else {"type": "MultiPolygon", "coordinates": closed}


def rings_bbox(rings: list[Ring]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    return min(xs), min(ys), max(xs), max(ys)


def bbox_ring(w: float, s: float, e: float, n: float) -> Ring:
    return [(w, s), (e, s), (e, n), (w, n)]


def _turn(a, b, c) -> int:
    v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (v > 0) - (v < 0)


def _between(a, b, p) -> bool:
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _cross(a, b, c, d) -> bool:
    """Whether two segments meet; touching and collinear overlap count."""
    t = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    if t[0] != t[1] and t[2] != t[3]:
        return True
    return any(turn == 0 and _between(p, q, r) for turn, p, q, r in zip(t, (a, a, c, c), (b, b, d, d), (c, d, a, b), strict=True))


def inside(p, ring: Ring) -> bool:
    out = False
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            out = not out
    return out


def rings_meet(one: list[Ring], other: list[Ring]) -> bool:
    for x in one:
        bx = rings_bbox([x])
        for y in other:
            by = rings_bbox([y])
            if bx[2] < by[0] or by[2] < bx[0] or bx[3] < by[1] or by[3] < bx[1]:
                continue
            edges_y = list(zip(y, y[1:] + y[:1], strict=True))
            if any(_cross(a, b, c, d) for a, b in zip(x, x[1:] + x[:1], strict=True) for c, d in edges_y) or inside(x[0], y) or inside(y[0], x):
                return True
    return False


def meets(query: list[Ring], rings: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """Whether a row's rings, or else its box, meet the query's; rows with neither don't.

    The caller ANDs the box test in front, so that the scan sees it and few rows reach Python.
    """

    @F.pandas_udf("boolean")
    def refine(r: pd.Series, w: pd.Series, s: pd.Series, e: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for rr, *b in zip(r, w, s, e, n, strict=True):
            own = [[(p["lon"], p["lat"]) for p in ring] for ring in rr] if rr is not None and len(rr) else [] if any(pd.isna(x) for x in b) else [bbox_ring(*b)]
            out.append(bool(own) and rings_meet(own, query))
        return pd.Series(out, dtype=bool)

    return refine(rings, *box)


def union_bbox(w: Column, s: Column, e: Column, n: Column) -> Column:
    return F.struct(F.min(w).alias("min_lon"), F.min(s).alias("min_lat"), F.max(e).alias("max_lon"), F.max(n).alias("max_lat"))


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.pmod(F.floor((lon + 180) / 6), F.lit(60)).cast("int") + 1
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone).cast("int")


def cell_area_m2(geographic: Column, xres: Column, yres: Column, unit: float = 1.0) -> Column:
    return F.when(~geographic, F.abs(xres * yres) * unit * unit)


MAX_LATITUDE = 85.05112878


def tile_fraction(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional web-mercator tile coordinates; latitudes are clamped."""
    n = float(2**zoom)
    rad = F.radians(F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat)))
    return (lon + 180.0) / 360.0 * n, (1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / F.lit(math.pi)) / 2.0 * n


def tile_bounds_3857(zoom: int, x: Column, y: Column) -> Column:
    half = 20037508.342789244
    side = 2 * half / 2**zoom
    return F.struct((x * side - half).alias("left"), (half - (y + 1) * side).alias("bottom"), ((x + 1) * side - half).alias("right"), (half - y * side).alias("top"))


def hilbert_id(zoom: int, x: Column, y: Column) -> Column:
    """The Hilbert number of a tile among all tiles of zooms 0 ... zoom, folded bit by bit within one expression."""
    if not 0 <= zoom <= 26:
        raise PlanError(f"zoom {zoom} is outside 0 ... 26")
    base = (4**zoom - 1) // 3
    state = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    for level in range(zoom - 1, -1, -1):
        s = 1 << level
        state = _hilbert_step(state, s)
    return F.lit(base) + state["d"]


def _hilbert_step(state: Column, s: int) -> Column:
    def step(v: Column) -> Column:
        rx, ry = v["x"].bitwiseAND(s) > 0, v["y"].bitwiseAND(s) > 0
        d = v["d"] + s * s * F.when(rx & ry, 2).when(rx, 3).when(ry, 1).otherwise(0)
        fx, fy = F.when(rx & ~ry, s - 1 - v["x"]).otherwise(v["x"]), F.when(rx & ~ry, s - 1 - v["y"]).otherwise(v["y"])
        return F.struct(F.when(ry, fx).otherwise(fy).alias("x"), F.when(ry, fy).otherwise(fx).alias("y"), d.alias("d"))

    # A one-element transform binds the state, so that it isn't written out anew for each use.
    return F.transform(F.array(state), step)[0]


def dem_tile_ids(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Names of the 1 degree elevation tiles that cover a box, south to north and west to east."""
    lats = F.sequence(F.floor(s).cast("int"), F.greatest(F.floor(s), F.ceil(n) - 1).cast("int"))
    lons = F.sequence(F.floor(w).cast("int"), F.greatest(F.floor(w), F.ceil(e) - 1).cast("int"))

    def name(lat: Column, lon: Column) -> Column:
        ns, ew = F.when(lat >= 0, "N").otherwise("S"), F.when(lon >= 0, "E").otherwise("W")
        return F.concat(F.lit("Copernicus_DSM_COG_10_"), ns, F.lpad(F.abs(lat).cast("string"), 2, "0"), F.lit("_00_"), ew, F.lpad(F.abs(lon).cast("string"), 3, "0"), F.lit("_00_DEM"))

    return F.flatten(F.transform(lats, lambda a: F.transform(lons, lambda o: name(a, o))))
