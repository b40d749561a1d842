"""Looks, filters, stretches, composites, chips, terrain and radiometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import radiometry as rad
from ..operators import raster
from .adapters import cells, cells_sql

_R = lambda *names: [F.round(n, 6).alias(n) for n in names]


def _looks(spark, sf_dir):
    return raster.block_looks(cells(spark, sf_dir), ["pass_idx"], 8, (32, 32)).select("pass_idx", "block_row", "block_col", "n", F.round("looks", 6).alias("looks"))


def _looks_pass(spark, sf_dir):
    return raster.looks(cells(spark, sf_dir), ["pass_idx"], 8, (32, 32)).select("pass_idx", F.round("looks", 6).alias("looks"))


_LOOKS = f"""WITH {cells_sql()}, b AS (SELECT pass_idx, (row // 8)::BIGINT AS block_row, (col // 8)::BIGINT AS block_col, count(value) AS n, avg(value * value) AS m, var_samp(value * value) AS v FROM cells GROUP BY 1, 2, 3),
k AS (SELECT * FROM b WHERE n >= 32 AND v > 0 AND m > 0)"""
_BOX = """box AS (
  SELECT a.pass_idx, a.row, a.col, any_value(a.v) AS v, sum(b.v) AS s1, sum(b.v * b.v) AS s2, count(b.v) AS n FROM c a JOIN c b ON a.pass_idx = b.pass_idx AND b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY 1, 2, 3
)"""


def _box(spark, sf_dir):
    return raster.box_filter(cells(spark, sf_dir, True), 5, ["pass_idx"]).select("pass_idx", "row", "col", F.round(F.col("filtered") + 3e-7, 5).alias("filtered"))


def _lee(spark, sf_dir):
    return raster.lee_filter(cells(spark, sf_dir), 4, 5, ["pass_idx"]).select("pass_idx", "row", "col", F.round(F.col("filtered") + 3e-4, 2).alias("filtered"))


def _stretch(spark, sf_dir):
    return raster.stretch(cells(spark, sf_dir, True), ["pass_idx"]).select("pass_idx", "row", "col", "level")


_STRETCH = """v AS (SELECT pass_idx, row, col, CASE WHEN value > 0 THEN value END AS v FROM cells),
q AS (SELECT pass_idx, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM v GROUP BY pass_idx),
s AS (SELECT pass_idx, row, col, trunc(greatest(0, least(1, (v - lo) / (CASE WHEN hi > lo THEN hi ELSE lo + 1 END - lo))) * 255)::INT AS level FROM v JOIN q USING (pass_idx))"""


def _composite(spark, sf_dir):
    return raster.composite(cells(spark, sf_dir, True), [1, 4])


def _chips(spark, sf_dir):
    c = raster.chips(cells(spark, sf_dir, True), (32, 32), 12, 8, 0.9, ["pass_idx"])
    return c.select("pass_idx", "row_off", "col_off", *_R("valid_fraction", "mean"), F.size("pixels").alias("n_pixels"))


def _decimate(spark, sf_dir):
    return raster.decimate(cells(spark, sf_dir, True), 5, ["pass_idx"]).select("pass_idx", "row", "col", F.round("value", 6).alias("value"))


def _dem(spark, sf_dir):
    return cells(spark, sf_dir).where("pass_idx = 2").select("row", "col", (F.col("value") / 100).alias("z"))


def _normals(spark, sf_dir):
    return raster.terrain_normals(_dem(spark, sf_dir), 0.001, 0.001, 40.0).select("row", "col", *_R("nx", "ny", "nz"))


_NORMALS = f"""WITH {cells_sql()}, dem AS (SELECT row, col, value / 100 AS z FROM cells WHERE pass_idx = 2),
g AS (
  SELECT row, col, z, CASE WHEN lag(z) OVER r IS NULL THEN lead(z) OVER r - z WHEN lead(z) OVER r IS NULL THEN z - lag(z) OVER r ELSE (lead(z) OVER r - lag(z) OVER r) / 2 END AS gr,
    CASE WHEN lag(z) OVER c IS NULL THEN lead(z) OVER c - z WHEN lead(z) OVER c IS NULL THEN z - lag(z) OVER c ELSE (lead(z) OVER c - lag(z) OVER c) / 2 END AS gc
  FROM dem WINDOW r AS (PARTITION BY col ORDER BY row), c AS (PARTITION BY row ORDER BY col)
),
x AS (SELECT row, col, -gc / (0.001::DOUBLE * 111320 * cos(radians(40 - row * 0.001::DOUBLE))) AS nx, gr / (0.001::DOUBLE * 111320) AS ny FROM g),
u AS (SELECT row, col, nx / sqrt(nx * nx + ny * ny + 1) AS nx, ny / sqrt(nx * nx + ny * ny + 1) AS ny, 1 / sqrt(nx * nx + ny * ny + 1) AS nz FROM x)"""


def _flatten(spark, sf_dir):
    n = raster.terrain_normals(_dem(spark, sf_dir), 0.001, 0.001, 40.0)
    inc, az = F.lit(35.0), F.lit(80.0)
    cos = rad.cos_incidence((F.col("nx"), F.col("ny"), F.col("nz")), rad.look_vector(inc, az))
    ref = F.cos(F.radians(inc))
    local = rad.range_incidence((F.col("nx"), F.col("ny"), F.col("nz")), inc, az)
    return n.select("row", "col", F.round(rad.flatten_cosine(cos, ref), 6).alias("cosine"), F.round(rad.flatten_gamma(cos, F.col("nz"), ref), 6).alias("gamma"), F.round(rad.flatten_area(local, F.sin(F.radians(inc))), 6).alias("area"))


def _calibrated(spark, sf_dir):
    c = cells(spark, sf_dir).where("pass_idx = 1")
    x, y = rad.image_metres(F.col("row"), F.col("col"), {"scp_row": 16, "scp_col": 16, "row_ss": 0.5, "col_ss": 0.25})
    scale = rad.polynomial([[1.0, 0.01], [0.002, 0.0]], x, y)
    return c.select("row", "col", F.round(rad.calibrated(F.col("value"), scale), 6).alias("amplitude"), F.round(rad.calibrated(rad.db(F.col("value")), scale, True), 6).alias("db"))


def _denoised(spark, sf_dir):
    c = cells(spark, sf_dir)
    p = rad.power(F.col("value"))
    n = raster.noise_floor(c, ["pass_idx"], 30)
    d = c.join(n, "pass_idx")
    return d.groupBy("pass_idx").agg(F.round(F.first("margin_db"), 6).alias("margin_db"), F.round(rad.floored(p, F.col("floor")), 6).alias("floored"), F.round(F.avg(F.sqrt(rad.denoised(p, F.col("floor")))), 5).alias("mean"))


def _models(spark, sf_dir):
    c = cells(spark, sf_dir)
    wide = c.groupBy("row", "col").agg(F.max(F.when(F.col("pass_idx") == 1, rad.db(F.col("value")))).alias("inferred_db"), F.max(F.when(F.col("pass_idx") == 2, rad.db(F.col("value")))).alias("measured_db"))
    return raster.compare_models(wide).select(*_R("bias_db", "shape_db", "residual_db"))


def _profile(spark, sf_dir):
    c = cells(spark, sf_dir).withColumn("scene_id", F.col("pass_idx").cast("string"))
    return raster.noise_profile(c, 32, min_samples=8).select("scene_id", "row", F.round("noise_db", 6).alias("noise_db"))


def _radar(spark, sf_dir):
    d = cells(spark, sf_dir).where("pass_idx = 3").select((F.col("row") * 32 + F.col("col")).alias("id"), (F.col("row") * 1.7 + F.col("value") / 50000).alias("slant"), (F.col("col") * 1.1).alias("along"), F.lit(1.0).alias("area"))
    return raster.radar_area(d, 1.0, 1.0).select("id", F.round("radar_area", 6).alias("radar_area"))


_RADAR = f"""WITH {cells_sql()}, f AS (SELECT row * 32 + col AS id, row * 1.7::DOUBLE + value / 50000 AS slant, col * 1.1::DOUBLE AS along FROM cells WHERE pass_idx = 3),
m AS (SELECT min(slant) AS s0, max(slant) AS s1, min(along) AS a0, max(along) AS a1, count(*) AS n FROM f),
k AS (SELECT s0, a0, sqrt(greatest((s1 - s0 + 2) * (a1 - a0 + 2) / (64 * n), 1)) AS k FROM m),
p AS (SELECT id, (slant - s0) / k AS s, (along - a0) / k AS a FROM f, k),
c AS (SELECT id, floor(s) + i AS i, floor(a) + j AS j, (CASE WHEN i = 1 THEN s - floor(s) ELSE 1 - (s - floor(s)) END) * (CASE WHEN j = 1 THEN a - floor(a) ELSE 1 - (a - floor(a)) END) AS w
  FROM p, (VALUES (0), (1)) x(i), (VALUES (0), (1)) y(j)),
g AS (SELECT i, j, sum(w) AS g FROM c GROUP BY 1, 2)
SELECT id, round(sum(g * w), 6) AS radar_area FROM c JOIN g USING (i, j) GROUP BY id"""


def _heights(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 400 / 100.0).alias("lon"), (F.col("o_custkey") % 400 / 100.0).alias("lat"))
    h = raster.sample_heights(p, _dem(spark, sf_dir), 0.0, 3.2, 0.1, 0.1)
    return h.select("k", F.round(F.col("height") + 3e-8, 6).alias("height"))


REGISTERED = {
    "enl_blocks": (_looks, f"{_LOOKS} SELECT pass_idx, block_row, block_col, n, round(m * m / v, 6) AS looks FROM k"),
    "enl_by_pass": (_looks_pass, f"{_LOOKS} SELECT pass_idx, round(median(m * m / v), 6) AS looks FROM k GROUP BY pass_idx"),
    "box_filter_5": (_box, f"WITH {cells_sql(True)}, c AS (SELECT pass_idx, row, col, CASE WHEN value > 0 THEN value END AS v FROM cells), {_BOX} SELECT pass_idx, row, col, round(s1 / n + 3e-7, 5) AS filtered FROM box"),
    "lee_filter_5": (
        _lee,
        f"""WITH {cells_sql()}, c AS (SELECT pass_idx, row, col, value AS v FROM cells), {_BOX}, m AS (SELECT *, s1 / n AS m, greatest(s2 / n - (s1 / n) * (s1 / n), 0) AS var FROM box)
        SELECT pass_idx, row, col, round(m + CASE WHEN var > 0 THEN greatest(0, least(1, (var - m * m / 4) / (var * 1.25))) ELSE 0 END * (v - m) + 3e-4, 2) AS filtered FROM m""",
    ),
    "stretch_2_98": (_stretch, f"WITH {cells_sql(True)}, {_STRETCH} SELECT * FROM s"),
    "change_composite": (
        _composite,
        f"""WITH {cells_sql(True)}, {_STRETCH}, w AS (SELECT row, col, max(level) FILTER (pass_idx = 1) AS x, max(level) FILTER (pass_idx = 4) AS y FROM s WHERE pass_idx IN (1, 4) GROUP BY row, col)
        SELECT row, col, coalesce(x, 0) AS r, coalesce(y, 0) AS g, coalesce(x, 0) AS b, CASE WHEN x IS NULL OR y IS NULL THEN 0 ELSE 255 END AS a FROM w""",
    ),
    "chips_grid": (
        _chips,
        f"""WITH {cells_sql(True)}, o AS (SELECT r * 8 AS row_off, c * 8 AS col_off FROM range(0, 3) a(r), range(0, 3) b(c)),
        t AS (SELECT pass_idx, row_off::INT AS row_off, col_off::INT AS col_off, count(*) FILTER (value > 0) / 144 AS f, avg(value) FILTER (value > 0) AS m, count(*) AS n FROM cells, o WHERE row >= row_off AND row < row_off + 12 AND col >= col_off AND col < col_off + 12 GROUP BY 1, 2, 3)
        SELECT pass_idx, row_off, col_off, round(f, 6) AS valid_fraction, round(m, 6) AS mean, n::INT AS n_pixels FROM t WHERE f >= 0.9""",
    ),
    "decimate_5": (_decimate, f"WITH {cells_sql(True)} SELECT pass_idx, (row // 5)::INT AS row, (col // 5)::INT AS col, round(avg(value) FILTER (value > 0), 6) AS value FROM cells GROUP BY 1, 2, 3"),
    "terrain_normals": (_normals, f"{_NORMALS} SELECT row, col, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz FROM u"),
    "terrain_flattening": (
        _flatten,
        f"""{_NORMALS}, l AS (SELECT *, nx * sin(radians(35)) * sin(radians(80)) + ny * sin(radians(35)) * cos(radians(80)) + nz * cos(radians(35)) AS c, radians(35) - atan2(nx * sin(radians(80)) + ny * cos(radians(80)), nz) AS t FROM u)
        SELECT row, col, round(greatest(0.1, least(10, cos(radians(35)) / greatest(0.001, least(1, c)))), 6) AS cosine, round(greatest(0.1, least(10, cos(radians(35)) * nz / greatest(0.001, least(1, c)))), 6) AS gamma,
          round(greatest(0.1, least(10, greatest(0.001, sin(t)) / sin(radians(35)))), 6) AS area FROM l""",
    ),
    "calibrate_poly": (
        _calibrated,
        f"""WITH {cells_sql()}, s AS (SELECT row, col, value, 1 + 0.01::DOUBLE * (col - 16) * 0.25 + 0.002::DOUBLE * (row - 16) * 0.5 AS s FROM cells WHERE pass_idx = 1)
        SELECT row, col, round(value * sqrt(s), 6) AS amplitude, round(20 * log10(value) + 10 * log10(s), 6) AS db FROM s""",
    ),
    "subtract_noise": (
        _denoised,
        f"""WITH {cells_sql()}, n AS (SELECT pass_idx, quantile_cont(value * value, 0.3) AS f, median(value * value) AS m FROM cells GROUP BY 1)
        SELECT pass_idx, round(any_value(10 * log10(m / f)), 6) AS margin_db, round(avg((value * value - f <= 1e-12)::INT::DOUBLE), 6) AS floored, round(avg(sqrt(greatest(value * value - f, 1e-12))), 5) AS mean FROM cells JOIN n USING (pass_idx) GROUP BY pass_idx""",
    ),
    "noise_models": (
        _models,
        f"""WITH {cells_sql()}, w AS (SELECT 20 * log10(max(value) FILTER (pass_idx = 1)) - 20 * log10(max(value) FILTER (pass_idx = 2)) AS d FROM cells GROUP BY row, col), b AS (SELECT median(d) AS b FROM w)
        SELECT round(any_value(b), 6) AS bias_db, round(sqrt(avg((d - b) * (d - b))), 6) AS shape_db, round(sqrt(avg(d * d)), 6) AS residual_db FROM w, b""",
    ),
    "noise_profile": (_profile, None),
    "radar_area": (_radar, _RADAR),
    "dem_heights": (
        _heights,
        f"""WITH {cells_sql()}, dem AS (SELECT row, col, value / 100 AS z FROM cells WHERE pass_idx = 2), p AS (SELECT o_orderkey AS k, (o_orderkey % 400)::DOUBLE / 100 AS lon, (o_custkey % 400)::DOUBLE / 100 AS lat FROM orders)
        SELECT k, round(z + 3e-8, 6) AS height FROM p LEFT JOIN dem ON row = floor((3.2::DOUBLE - lat) / 0.1::DOUBLE) AND col = floor(lon / 0.1::DOUBLE)""",
    ),
}
