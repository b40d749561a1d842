"""Pixel windows from geography, and projection of pixels to the ground."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError
from .raster import decimate, window_for


@dataclass(frozen=True)
class Grid:
    """A north-up grid."""

    left: float
    top: float
    xres: float
    yres: float
    width: int
    height: int
    crs: str = "EPSG:4326"

    def window(self, bbox: tuple[float, float, float, float] | None) -> tuple[int, int, int, int]:
        """(first row, last row + 1, first column, last column + 1) of the pixels that a box touches."""
        if bbox is None:
            return 0, self.height, 0, self.width
        w, s, e, n = bbox
        c0, c1 = int(np.floor((w - self.left) / self.xres)), int(np.ceil((e - self.left) / self.xres))
        r0, r1 = int(np.floor((self.top - n) / self.yres)), int(np.ceil((self.top - s) / self.yres))
        r0, r1, c0, c1 = max(0, r0), min(self.height, r1), max(0, c0), min(self.width, c1)
        if r0 >= r1 or c0 >= c1:
            raise ValueError("the box doesn't overlap the scene")
        return r0, r1, c0, c1


def read_window(cells: DataFrame, grid: Grid, bbox=None, max_size: int | None = None, by: list[str] | None = None) -> DataFrame:
    """The cells of a box, numbered from its corner and averaged until neither side exceeds max_size; the range reaches the scan."""
    r0, r1, c0, c1 = grid.window(bbox)
    out = cells.where((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    out = out.withColumn("row", F.col("row") - r0).withColumn("col", F.col("col") - c0)
    factor = window_for(c1 - c0, r1 - r0, max_size) if max_size else 1
    return decimate(out, factor, by) if factor > 1 else out


def quicklook(cells: DataFrame, grid: Grid, max_size: int, by: list[str] | None = None) -> DataFrame:
    """The whole scene, decimated to sizes that are cut to whole numbers."""
    scale = max(1.0, max(grid.width, grid.height) / max_size)
    width, height = max(1, int(grid.width / scale)), max(1, int(grid.height / scale))
    row, col = F.floor(F.col("row") * height / grid.height), F.floor(F.col("col") * width / grid.width)
    return cells.groupBy(*(by or []), row.cast("int").alias("row"), col.cast("int").alias("col")).agg(F.avg("value").alias("value"))


Projector = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
Heights = Callable[[np.ndarray, np.ndarray], np.ndarray]


def control_points(scenes: DataFrame, project: Projector, heights: Heights | None = None, steps: int = 33, rounds: int = 8, tolerance: float = 1.0) -> DataFrame:
    """scene_id, row, col, lon, lat, height at steps x steps pixels of scenes(scene_id, rows, cols, height).

    project(row, col, height) gives longitudes and latitudes.  With heights(lon, lat) each point is projected again at the height
    found below it, until it moves less than the tolerance; where there is none, the scene's height stays.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for s in pdf.itertuples(index=False):
                axis = lambda n: np.unique(np.rint(np.linspace(0, n - 1, max(2, min(steps, n)))).astype(int)) if n > 1 else np.zeros(1, int)
                r, c = (x.ravel().astype(float) for x in np.meshgrid(axis(s.rows), axis(s.cols), indexing="ij"))
                h = np.full(len(r), float(s.height))
                lon, lat = project(r, c, h)
                for _ in range(rounds if heights else 0):
                    new = heights(lon, lat)
                    new = np.where(np.isfinite(new), new, float(s.height))
                    moved = np.abs(new - h).max() if len(h) else 0.0
                    h = new
                    lon, lat = project(r, c, h)
                    if moved < tolerance:
                        break
                yield pd.DataFrame({"scene_id": s.scene_id, "row": r.astype(int), "col": c.astype(int), "lon": lon, "lat": lat, "height": h})

    return scenes.select("scene_id", "rows", "cols", "height").mapInPandas(run, "scene_id string, row int, col int, lon double, lat double, height double")


def clip_window(points: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """The pixel window of each scene whose control-point cells overlap a box, with one cell around; scenes that don't are left out.

    points are control_points(); a cell is the rectangle between neighbouring points.
    """
    w, s, e, n = bbox
    rows = points.select("scene_id", "row").distinct().withColumn("_i", F.expr("dense_rank() over (partition by scene_id order by row)")).withColumn("_next", F.expr("lead(row) over (partition by scene_id order by row)"))
    cols = points.select("scene_id", "col").distinct().withColumn("_j", F.expr("dense_rank() over (partition by scene_id order by col)")).withColumn("_right", F.expr("lead(col) over (partition by scene_id order by col)"))
    p = points.join(rows, ["scene_id", "row"]).join(cols, ["scene_id", "col"])  # both are as small as the grids
    corner = F.explode(F.array(*[F.struct((F.col("_i") - a).alias("i"), (F.col("_j") - b).alias("j")) for a in (0, 1) for b in (0, 1)]))
    cells = p.select("scene_id", "lon", "lat", "row", "col", corner.alias("c")).groupBy("scene_id", "c.i", "c.j").agg(
        F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count(F.lit(1)).alias("k")
    )
    hit = cells.where((F.col("k") == 4) & (F.col("w") <= e) & (F.col("e") >= w) & (F.col("s") <= n) & (F.col("n") >= s))
    box = hit.groupBy("scene_id").agg(*[f(c).alias(c) for f, c in ((F.min, "r0"), (F.max, "r1"), (F.min, "c0"), (F.max, "c1"))], F.max(F.col("r1") - F.col("r0")).alias("dr"), F.max(F.col("c1") - F.col("c0")).alias("dc"))
    ends = points.groupBy("scene_id").agg(F.max("row").alias("mr"), F.max("col").alias("mc"))
    out = box.join(ends, "scene_id")
    return out.select("scene_id", F.greatest(F.lit(0), F.col("r0") - F.col("dr")).alias("row_from"), F.least("mr", F.col("r1") + F.col("dr")).alias("row_to"), F.greatest(F.lit(0), F.col("c0") - F.col("dc")).alias("col_from"), F.least("mc", F.col("c1") + F.col("dc")).alias("col_to"))


def warp(cells: DataFrame, affine: tuple[float, float, float, float, float, float], grid: Grid) -> DataFrame:
    """Nearest-pixel warp of a scene onto a grid by the inverse of lon = a + b col + c row, lat = d + e col + f row."""
    a, b, c, d, e, f = affine
    det = b * f - c * e
    if det == 0:
        raise PlanError("the transform can't be inverted")
    target = cells.sparkSession.range(grid.height * grid.width).select((F.col("id") / grid.width).cast("int").alias("row"), (F.col("id") % grid.width).cast("int").alias("col"))
    lon, lat = grid.left + (F.col("col") + 0.5) * grid.xres - a, grid.top - (F.col("row") + 0.5) * grid.yres - d
    src = target.withColumn("_c", F.floor((f * lon - c * lat) / det).cast("int")).withColumn("_r", F.floor((b * lat - e * lon) / det).cast("int"))
    return src.join(cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value"), ["_r", "_c"]).select("row", "col", "value")
