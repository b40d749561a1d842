"""Scene rasters in long form: looks, moving windows, speckle filters, stretches, composites, terrain, chips.

A moving window over a scene is a halo exchange: each cell is sent to the strips it touches, then rows and columns are
summed one after the other within strips, so that a group is a strip of a row, not the row of a scene.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.radiometry import M_PER_DEGREE, valid
from .quantiles import quantiles

# Side of a block for looks, least share of valid cells in it, default window, percentile of a noise floor.
BLOCK, MIN_VALID, WINDOW, NOISE_PERCENTILE = 16, 0.5, 5, 5.0
#: Cells of a strip in a moving window.
STRIP = 4_096


def block_looks(cells: DataFrame, by: list[str], block: int = BLOCK, shape: tuple[int, int] | None = None) -> DataFrame:
    """Mean squared over sample variance of power in each full block; blocks with too few valid cells go."""
    p = valid(F.col("value").cast("double"))
    rows = cells.withColumn("_p", p * p)
    if shape:
        rows = rows.where((F.col("row") < shape[0] // block * block) & (F.col("col") < shape[1] // block * block))
    out = rows.groupBy(*by, F.floor(F.col("row") / block).alias("block_row"), F.floor(F.col("col") / block).alias("block_col")).agg(F.count("_p").alias("n"), F.avg("_p").alias("m"), F.var_samp("_p").alias("v"))
    return out.where((F.col("n") >= max(4, int(MIN_VALID * block * block))) & (F.col("v") > 0) & (F.col("m") > 0)).withColumn("looks", F.col("m") * F.col("m") / F.col("v"))


def looks(cells: DataFrame, by: list[str], block: int = BLOCK, shape: tuple[int, int] | None = None) -> DataFrame:
    return block_looks(cells, by, block, shape).groupBy(*by).agg(F.median("looks").alias("looks"))


def _strips(df: DataFrame, axis: str, half: int, by: list[str]) -> tuple[DataFrame, Window]:
    home = F.floor(F.col(axis) / STRIP)
    touched = F.array_distinct(F.array(F.floor((F.col(axis) - half) / STRIP), home, F.floor((F.col(axis) + half) / STRIP)))
    spread = df.withColumn("_home", home).withColumn("_strip", F.explode(touched))
    return spread, Window.partitionBy(*by, "_strip").orderBy(axis).rangeBetween(-half, half)


def _filled(df: DataFrame, half: int, names: list[str], by: list[str]) -> DataFrame:
    """With ghosts, that count as nothing, in the holes of each column: sums along rows are needed there, too."""
    w = Window.partitionBy(*by, "col").orderBy("row")
    row, before, after = F.col("row"), F.lag("row").over(w), F.lead("row").over(w)
    down = F.least(row + half, F.coalesce(after - 1, row + half))
    up = F.greatest(row - half, F.coalesce(before + half + 1, row - half))
    span = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    places = F.concat(span(up, row - 1), F.array(row), span(row + 1, down))
    out = df.withColumn("_places", places).withColumn("_row", F.explode("_places")).withColumn("_ghost", F.col("_row") != row)
    out = out.withColumns({n: F.when(~F.col("_ghost"), F.col(n)) for n in names})
    return out.withColumn("row", F.col("_row")).drop("_places", "_row")


def box_sums(cells: DataFrame, window: int, columns: dict[str, Column], by: list[str]) -> DataFrame:
    """Sums of columns over a square window around each cell; clipped at edges, nulls count as nothing."""
    if window < 3 or window % 2 == 0:
        raise PlanError("a window is odd and 3 at least")
    half, names = window // 2, list(columns)
    out = _filled(cells.withColumns(columns), half, names, by)
    for axis, other in (("col", "row"), ("row", "col")):
        spread, w = _strips(out, axis, half, [*by, other])
        for n in names:
            spread = spread.withColumn(f"_{n}", F.sum(n).over(w))
        out = reduce(lambda d, n: d.withColumn(n, F.col(f"_{n}")).drop(f"_{n}"), names, spread.where("_strip = _home")).drop("_strip", "_home")
    return out.where(~F.col("_ghost")).drop("_ghost")


def box_filter(cells: DataFrame, window: int = WINDOW, by: list[str] | None = None) -> DataFrame:
    """The mean of the valid cells in the window, as filtered."""
    v = valid(F.col("value").cast("double"))
    out = box_sums(cells, window, {"s1": v, "n": v.isNotNull().cast("int")}, by or [])
    return out.withColumn("filtered", F.col("s1") / F.when(F.col("n") > 0, F.col("n"))).drop("s1", "n")


def lee_filter(cells: DataFrame, n_looks: float, window: int = WINDOW, by: list[str] | None = None) -> DataFrame:
    """Lee's adaptive filter of power, as filtered; invalid cells get the local mean's place only where the window has valid ones."""
    v = valid(F.col("value").cast("double"))
    L = max(1.0, float(n_looks))
    out = box_sums(cells.withColumn("_v", v), window, {"s1": v, "s2": v * v, "n": v.isNotNull().cast("int")}, by or [])
    m = F.col("s1") / F.when(F.col("n") > 0, F.col("n"))
    var = F.greatest(F.col("s2") / F.when(F.col("n") > 0, F.col("n")) - m * m, F.lit(0.0))
    weight = F.when(var > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (var - m * m / L) / (var * (1 + 1 / L))))).otherwise(0.0)
    return out.withColumn("filtered", F.coalesce(m + weight * (F.col("_v") - m), F.col("_v"))).drop("s1", "s2", "n", "_v")


def stretch(cells: DataFrame, by: list[str], low: float = 2, high: float = 98, column: str = "value") -> DataFrame:
    """0 ... 255 between two percentiles of the valid cells, as level; invalid ones are null."""
    v = valid(F.col(column).cast("double"))
    q = F.col("q")
    cut = quantiles(cells, by, v, [low / 100, high / 100]).select(*by, q[0].alias("_lo"), F.when(q[1] > q[0], q[1]).otherwise(q[0] + 1).alias("_hi"))
    out = cells.join(cut, by) if by else cells.join(F.broadcast(cut))  # one row
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))))
    return out.withColumn("level", (share * 255).cast("int")).drop("_lo", "_hi")


def composite(cells: DataFrame, passes: list[int]) -> DataFrame:
    """r, g, b, a of each cell from two passes (first, second, first) or three; transparent where any is invalid."""
    if len(passes) not in (2, 3):
        raise PlanError("a composite has two or three passes")
    bands = passes if len(passes) == 3 else [passes[0], passes[1], passes[0]]
    s = stretch(cells.where(F.col("pass_idx").isin(*passes)), ["pass_idx"])
    wide = s.groupBy("row", "col").agg(*[F.max(F.when(F.col("pass_idx") == p, F.col("level"))).alias(f"p{p}") for p in passes])
    every = reduce(lambda a, b: a & b, [F.col(f"p{p}").isNotNull() for p in passes])
    return wide.select("row", "col", *[F.coalesce(F.col(f"p{p}"), F.lit(0)).alias(n) for p, n in zip(bands, "rgb", strict=True)], F.when(every, 255).otherwise(0).alias("a"))


def decimate(cells: DataFrame, factor: int, by: list[str] | None = None) -> DataFrame:
    """Averages of factor x factor cells."""
    return cells.groupBy(*(by or []), F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.avg(valid(F.col("value").cast("double"))).alias("value"))


def window_for(width: int, height: int, max_size: int) -> int:
    return max(1, -(-max(width, height) // max_size))


def chips(cells: DataFrame, shape: tuple[int, int], size: int, stride: int | None = None, min_valid: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """Tiles that lie wholly within the scene: offsets, valid fraction, mean, and pixels in row-major order."""
    stride, by = stride or size, by or []
    last = [(n - size) // stride for n in shape]
    if min(last) < 0:
        last = [-1, -1]

    def starts(axis: str, most: int) -> Column:
        lo = F.greatest(F.lit(0), F.ceil((F.col(axis) - size + 1) / stride).cast("int"))
        hi = F.least(F.lit(most), F.floor(F.col(axis) / stride).cast("int"))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    spread = cells.withColumn("_r", F.explode(starts("row", last[0]))).withColumn("_c", F.explode(starts("col", last[1])))
    v = valid(F.col("value").cast("double"))
    pixels = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", v.alias("v")))), lambda x: x["v"])
    out = spread.groupBy(*by, (F.col("_r") * stride).alias("row_off"), (F.col("_c") * stride).alias("col_off")).agg((F.count(v) / F.lit(size * size)).alias("valid_fraction"), F.avg(v).alias("mean"), pixels.alias("pixels"))
    return out.where(F.col("valid_fraction") >= min_valid)


def gradient(dem: DataFrame, axis: str, other: str) -> Column:
    """Central differences along an axis, one-sided at its ends."""
    w = Window.partitionBy(other).orderBy(axis)
    before, after = F.lag("z").over(w), F.lead("z").over(w)
    return F.when(before.isNull(), after - F.col("z")).when(after.isNull(), F.col("z") - before).otherwise((after - before) / 2)


def terrain_normals(dem: DataFrame, x_res: float, y_res: float, top_lat: float) -> DataFrame:
    """Unit normals (nx east, ny north, nz up) of dem(row, col, z); holes are filled with the mean."""
    mean = dem.agg(F.coalesce(F.avg(F.when(~F.isnan("z"), F.col("z"))), F.lit(0.0)).alias("_m"))
    full = dem.join(F.broadcast(mean)).withColumn("z", F.when(F.col("z").isNull() | F.isnan("z"), F.col("_m")).otherwise(F.col("z"))).drop("_m")  # one row
    lat = F.greatest(F.lit(-89.9), F.least(F.lit(89.9), F.lit(top_lat) - F.col("row") * y_res))
    dx = F.greatest(F.lit(x_res * M_PER_DEGREE) * F.cos(F.radians(lat)), F.lit(1e-6))
    out = full.withColumn("_gr", gradient(full, "row", "col")).withColumn("_gc", gradient(full, "col", "row"))
    nx, ny = -F.col("_gc") / dx, F.col("_gr") / (y_res * M_PER_DEGREE)
    norm = F.sqrt(nx * nx + ny * ny + 1)
    return out.select("row", "col", "z", (nx / norm).alias("nx"), (ny / norm).alias("ny"), (1 / norm).alias("nz"))


def radar_area(facets: DataFrame, slant_bin: float, along_bin: float, max_cells: float = 64.0) -> DataFrame:
    """Facets(id, slant, along, area): the area splatted bilinearly into radar cells and read back, as radar_area."""
    span = facets.agg(F.min("slant").alias("s0"), F.max("slant").alias("s1"), F.min("along").alias("a0"), F.max("along").alias("a1"), F.count(F.lit(1)).alias("n"))
    cellsn = ((F.col("s1") - F.col("s0")) / slant_bin + 2) * ((F.col("a1") - F.col("a0")) / along_bin + 2)
    k = F.sqrt(F.greatest(cellsn / (max_cells * F.col("n")), F.lit(1.0)))
    put = facets.join(F.broadcast(span.withColumn("k", k)))  # one row
    s, a = (F.col("slant") - F.col("s0")) / (slant_bin * F.col("k")), (F.col("along") - F.col("a0")) / (along_bin * F.col("k"))
    put = put.withColumn("_s", s).withColumn("_a", a)
    fs, fa = F.col("_s") - F.floor("_s"), F.col("_a") - F.floor("_a")
    corners = F.array(*[F.struct((F.floor("_s") + i).alias("i"), (F.floor("_a") + j).alias("j"), ((fs if i else 1 - fs) * (fa if j else 1 - fa)).alias("w")) for i in (0, 1) for j in (0, 1)])
    spread = put.select("id", "area", F.explode(corners).alias("c")).select("id", F.col("c.i").alias("i"), F.col("c.j").alias("j"), F.col("c.w").alias("w"), "area")
    grid = spread.groupBy("i", "j").agg(F.sum(F.col("area") * F.col("w")).alias("g"))
    return spread.join(grid, ["i", "j"]).groupBy("id").agg(F.sum(F.col("g") * F.col("w")).alias("radar_area"))


def sample_heights(points: DataFrame, dem: DataFrame, left: float, top: float, dx: float, dy: float, geoid: DataFrame | None = None) -> DataFrame:
    """points(lon, lat) with height: the nearest cell of dem(row, col, z), and the geoid's undulation where it has one; outside null."""
    at = points.withColumn("row", F.floor((F.lit(top) - F.col("lat")) / dy).cast("int")).withColumn("col", F.floor((F.col("lon") - left) / dx).cast("int"))
    out = at.join(dem.select("row", "col", "z"), ["row", "col"], "left")
    if geoid is not None:
        out = out.join(geoid.select("row", "col", F.col("z").alias("_u")), ["row", "col"], "left")
        return out.withColumn("height", F.col("z") + F.coalesce(F.nanvl("_u", F.lit(0.0)), F.lit(0.0))).drop("_u", "z")
    return out.withColumnRenamed("z", "height")


def noise_floor(cells: DataFrame, by: list[str], percentile: float = NOISE_PERCENTILE) -> DataFrame:
    """floor, median and margin_db of the power of each scene."""
    v = valid(F.col("value").cast("double"))
    p = v * v
    out = quantiles(cells, by, p, [percentile / 100, 0.5]).select(*by, F.col("q")[0].alias("floor"), F.col("q")[1].alias("median"))
    return out.withColumn("margin_db", F.when((F.col("floor") > 0) & (F.col("median") > 0), 10 * F.log10(F.col("median") / F.col("floor"))))


def noise_profile(cells: DataFrame, rows: int, degree: int = 2, min_samples: int = 16, trim_db: float = 3.0, percentile: float = NOISE_PERCENTILE) -> DataFrame:
    """scene_id, row, noise_db: a polynomial through the dark end of each range line, refitted without lines far above it.

    The percentiles are aggregates; only a number for each line reaches the fit of a scene.
    """
    v = valid(F.col("value").cast("double"))
    lines = cells.groupBy("scene_id", "row").agg(F.percentile(v * v, F.lit(percentile / 100)).alias("p"), F.count(v).alias("n")).where(f"n >= {min_samples} and p > 0")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < degree + 1:
            return pd.DataFrame({"scene_id": [], "row": [], "noise_db": []})
        grid = np.linspace(-1, 1, rows) if rows > 1 else np.zeros(1)
        pdf = pdf.sort_values("row")
        x, y = grid[pdf["row"].to_numpy()], 10 * np.log10(pdf["p"].to_numpy())
        coefs = np.polyfit(x, y, degree)
        near = y - np.polyval(coefs, x) <= trim_db
        if not near.all() and near.sum() >= degree + 1:
            coefs = np.polyfit(x[near], y[near], degree)
        return pd.DataFrame({"scene_id": pdf["scene_id"].iloc[0], "row": np.arange(rows), "noise_db": np.polyval(coefs, grid)})

    return lines.groupBy("scene_id").applyInPandas(fit, "scene_id string, row int, noise_db double")


def compare_models(pixels: DataFrame) -> DataFrame:
    """bias, shape and residual of pixels(inferred_db, measured_db): the median difference, the spread around it, and the root mean square."""
    d = pixels.withColumn("_d", F.col("inferred_db") - F.col("measured_db"))
    bias = quantiles(d, [], F.col("_d"), [0.5]).select(F.col("q")[0].alias("bias_db"))
    return d.join(F.broadcast(bias)).agg(F.first("bias_db").alias("bias_db"), F.sqrt(F.avg(F.pow(F.col("_d") - F.col("bias_db"), 2))).alias("shape_db"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("residual_db"))  # one row
