"""Cube statistics, change, blocks, intervals and composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.special import detection
from ..operators import cube, raster
from .adapters import cells, cells_sql

_R = lambda *names: [F.round(n, 6).alias(n) for n in names]
_CHANGE = ("mean_delta_db", "mean_abs_delta_db", "brightened_fraction", "dimmed_fraction", "changed_fraction")
_STEPS = """d AS (
  SELECT pass_idx, row, col, 20 * log10(v) - CASE WHEN lag(pass_idx) OVER w = pass_idx - 1 THEN 20 * log10(lag(v) OVER w) END AS delta
  FROM (SELECT pass_idx, row, col, CASE WHEN value > 0 THEN value END AS v FROM cells) WINDOW w AS (PARTITION BY row, col ORDER BY pass_idx)
)"""
_NET = """n AS (
  SELECT row, col, 20 * log10(max(value) FILTER (pass_idx = (SELECT max(pass_idx) FROM cells) AND value > 0)) - 20 * log10(max(value) FILTER (pass_idx = (SELECT min(pass_idx) FROM cells) AND value > 0)) AS delta
  FROM cells GROUP BY row, col
)"""


def _stats(t: float = 3.0, strict: bool = False) -> str:
    up, down = (f"delta > {t}", f"delta < -{t}") if strict else (f"delta >= {t}", f"delta <= -{t}")
    share = lambda c: f"round(avg(CASE WHEN delta IS NOT NULL THEN ({c})::INT::DOUBLE END), 6)"
    return f"count(delta) AS compared_cells, round(avg(delta), 6) AS mean_delta_db, round(avg(abs(delta)), 6) AS mean_abs_delta_db, {share(up)} AS brightened_fraction, {share(down)} AS dimmed_fraction, {share(f'{up} OR {down}')} AS changed_fraction"


def _distribution(spark, sf_dir):
    d = cube.distribution(cells(spark, sf_dir, True))
    return d.select("pass_idx", "valid_cells", *_R("valid_fraction", "mean", "median", "std", "p5", "p95"))


def _sketch(spark, sf_dir):
    return cube.sketch_quantiles(cells(spark, sf_dir, True), [0.05, 0.5, 0.95]).select("pass_idx", "q", F.round("value", 6).alias("value"))


def _steps(spark, sf_dir):
    return cube.change_steps(cells(spark, sf_dir, True)).select("pass_idx", "compared_cells", *_R(*_CHANGE))


def _area(spark, sf_dir):
    return cube.change_steps(cells(spark, sf_dir), 1.5, 2500.0).select("pass_idx", *_R("changed_fraction", "changed_area_km2"))


def _net(spark, sf_dir):
    return cube.change_net(cells(spark, sf_dir, True)).select("compared_cells", *_R(*_CHANGE))


def _blocks(spark, sf_dir):
    b = cube.blocks(cells(spark, sf_dir), (32, 32), 5)
    return b.select("block_row", "block_col", "compass", "compared_cells", *_R("mean_delta_db", "changed_fraction"), "peak_pass", F.round("peak_delta_db", 6).alias("peak_delta_db"))


def _slice_sql(i: str, length: int = 32, parts: int = 5) -> str:
    base, extra = divmod(length, parts)
    edge = extra * (base + 1)
    return f"(CASE WHEN {i} < {edge} THEN {i} // {base + 1} ELSE {extra} + ({i} - {edge}) // {base} END)::INT"


def _band_sql(i: str, low: str, high: str, n: int = 5) -> str:
    return f"CASE WHEN {i} / {n - 1}.0 < 1 / 3.0 THEN '{low}' WHEN {i} / {n - 1}.0 > 2 / 3.0 THEN '{high}' ELSE '' END"


_BLOCKS = f"""WITH {cells_sql()}, {_STEPS}, {_NET},
nb AS (SELECT {_slice_sql('row')} AS block_row, {_slice_sql('col')} AS block_col, {_stats()} FROM n WHERE delta IS NOT NULL GROUP BY 1, 2),
s AS (SELECT {_slice_sql('row')} AS block_row, {_slice_sql('col')} AS block_col, pass_idx, avg(delta) AS m FROM d WHERE delta IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY block_row, block_col ORDER BY abs(m) DESC, pass_idx) = 1)
SELECT block_row, block_col, coalesce(nullif({_band_sql('block_row', 'north', 'south')} || {_band_sql('block_col', 'west', 'east')}, ''), 'center') AS compass, compared_cells, mean_delta_db, changed_fraction,
  k.pass_idx AS peak_pass, round(k.m, 6) AS peak_delta_db
FROM nb FULL JOIN k USING (block_row, block_col)"""


def _text(spark, sf_dir):
    return cube.grid_text(cube.blocks(cells(spark, sf_dir), (32, 32), 4), 4)


def _best(spark, sf_dir):
    return cube.best_interval(cube.change_steps(cells(spark, sf_dir), 1.0), 0.2).select("index", F.round("changed_fraction", 6).alias("changed_fraction"), F.round("mean_delta_db", 6).alias("mean_delta_db"), "excess", "stands_clear")


def _pair(spark, sf_dir):
    c = cells(spark, sf_dir, True)
    return c.groupBy("row", "col").agg(F.max(F.when(F.col("pass_idx") == 1, F.col("value"))).alias("earlier"), F.max(F.when(F.col("pass_idx") == 4, F.col("value"))).alias("later"))


_PAIR = f"WITH {cells_sql(True)}, p AS (SELECT row, col, max(value) FILTER (pass_idx = 1) AS earlier, max(value) FILTER (pass_idx = 4) AS later FROM cells GROUP BY row, col), q AS (SELECT row, col, CASE WHEN earlier > 0 AND later > 0 THEN 20 * log10(later) - 20 * log10(earlier) END AS delta FROM p)"


def _two_band(spark, sf_dir):
    t = cube.two_band(_pair(spark, sf_dir), (32, 32), 5)
    return t.select("block_row", "block_col", "compared_cells", *_R(*_CHANGE, "valid_fraction"), "peak")


def _scene(spark, sf_dir):
    return cube.scene_change(_pair(spark, sf_dir)).select(*_R("mean_abs_delta_db", "changed_fraction"))


def _detection(spark, sf_dir):
    per_pass = raster.looks(cells(spark, sf_dir), ["pass_idx"], 16)
    return per_pass.agg(F.median("looks").alias("looks")).select(*detection(F.col("looks"), 3.0))


def _timescan(spark, sf_dir):
    return cube.timescan(cells(spark, sf_dir, True)).select("row", "col", *_R("mean", "max", "std"))


def _extent(how):
    def run(spark, sf_dir):
        c = cells(spark, sf_dir).groupBy("pass_idx").agg(F.min(F.col("value")).alias("left"), F.min(-F.col("value")).alias("bottom"), F.max("value").alias("right"), F.max(-F.col("value")).alias("top"))
        return cube.common_extent(c, how).select(*_R("left", "bottom", "right", "top"))

    return run


def _extent_sql(lo: str, hi: str) -> str:
    return f"WITH {cells_sql()}, b AS (SELECT min(value) AS l, min(-value) AS b, max(value) AS r, max(-value) AS t FROM cells GROUP BY pass_idx) SELECT round({lo}(l), 6) AS \"left\", round({lo}(b), 6) AS bottom, round({hi}(r), 6) AS \"right\", round({hi}(t), 6) AS top FROM b"


def _align(spark, sf_dir):
    c = cells(spark, sf_dir).select("pass_idx", (F.col("col") * 10.0 + F.col("pass_idx") * 3.0).alias("x"), (320.0 - F.col("row") * 10.0 - F.col("pass_idx") * 2.0).alias("y"), "value")
    a = cube.align(c, 20.0, 300.0, 20.0, 20.0, 10, 12)
    return a.select("pass_idx", "row", "col", F.round(F.col("value") + 3e-8, 6).alias("value"))


REGISTERED = {
    "cube_distribution": (
        _distribution,
        f"""WITH {cells_sql(True)}, v AS (SELECT pass_idx, CASE WHEN value > 0 THEN value END AS value FROM cells)
        SELECT pass_idx, count(value) AS valid_cells, round(count(value) / count(*), 6) AS valid_fraction, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std,
          round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.95), 6) AS p95 FROM v GROUP BY pass_idx""",
    ),
    "cube_sketch_quantiles": (
        _sketch,
        f"""WITH {cells_sql(True)}, b AS (SELECT pass_idx, floor(20 * log10(value) / 0.05::DOUBLE)::BIGINT AS bin, count(*) AS n FROM cells WHERE value > 0 GROUP BY 1, 2),
        r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY pass_idx ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen, sum(n) OVER (PARTITION BY pass_idx) AS total FROM b),
        q AS (SELECT *, unnest([0.05::DOUBLE, 0.5::DOUBLE, 0.95::DOUBLE]) AS q FROM r)
        SELECT pass_idx, q, round(pow(10, (bin + greatest(0, least(1, (q * (total - 1) - seen + 0.5) / n))) * 0.05::DOUBLE / 20), 6) AS value FROM q WHERE seen <= q * (total - 1) AND seen + n > q * (total - 1)""",
    ),
    "cube_change_steps": (_steps, f"WITH {cells_sql(True)}, {_STEPS} SELECT pass_idx, {_stats()} FROM d WHERE delta IS NOT NULL GROUP BY pass_idx"),
    "cube_change_area": (_area, f"WITH {cells_sql()}, {_STEPS} SELECT pass_idx, round(avg((abs(delta) >= 1.5)::INT::DOUBLE), 6) AS changed_fraction, round(sum((abs(delta) >= 1.5)::INT) * 2500 / 1e6, 6) AS changed_area_km2 FROM d WHERE delta IS NOT NULL GROUP BY pass_idx"),
    "cube_change_net": (_net, f"WITH {cells_sql(True)}, {_NET} SELECT {_stats()} FROM n WHERE delta IS NOT NULL"),
    "cube_blocks": (_blocks, _BLOCKS),
    "cube_grid_text": (
        _text,
        f"""WITH {cells_sql()}, {_NET}, b AS (SELECT {_slice_sql('row', 32, 4)} AS block_row, {_slice_sql('col', 32, 4)} AS block_col, avg(delta) AS m FROM n WHERE delta IS NOT NULL GROUP BY 1, 2)
        SELECT block_row, string_agg(CASE WHEN m IS NULL THEN '   . ' ELSE printf('%+5.1f', m) END, ' ' ORDER BY block_col) AS line FROM (SELECT x.i::INT AS block_row, y.i::INT AS block_col, m FROM range(0, 4) x(i) CROSS JOIN range(0, 4) y(i) LEFT JOIN b ON b.block_row = x.i AND b.block_col = y.i) GROUP BY block_row""",
    ),
    "best_interval": (
        _best,
        f"""WITH {cells_sql()}, {_STEPS}, s AS (SELECT pass_idx, avg((abs(delta) >= 1)::INT::DOUBLE) AS f, avg(delta) AS m FROM d WHERE delta IS NOT NULL GROUP BY pass_idx)
        SELECT pass_idx AS index, round(f, 6) AS changed_fraction, round(m, 6) AS mean_delta_db, round_even(f - 0.2::DOUBLE, 4) AS excess, f >= 0.25 AS stands_clear FROM s ORDER BY f - 0.2::DOUBLE DESC, f DESC, pass_idx LIMIT 1""",
    ),
    "two_band_strict": (
        _two_band,
        f"""{_PAIR}, b AS (SELECT {_slice_sql('row')} AS block_row, {_slice_sql('col')} AS block_col, {_stats(3.0, True)}, round(count(delta) / count(*), 6) AS valid_fraction, avg(abs(delta)) AS ma FROM q GROUP BY 1, 2)
        SELECT * EXCLUDE (ma), row_number() OVER (ORDER BY ma DESC, block_row, block_col) = 1 AS peak FROM b""",
    ),
    "scene_change": (_scene, f"{_PAIR} SELECT round(avg(abs(delta)), 6) AS mean_abs_delta_db, round(avg(CASE WHEN delta IS NOT NULL THEN (abs(delta) > 3)::INT::DOUBLE END), 6) AS changed_fraction FROM q"),
    "detection_floor": (_detection, None),
    "timescan": (
        _timescan,
        f"""WITH {cells_sql(True)}, t AS (SELECT row, col, avg(value) FILTER (value > 0) AS mean, max(value) FILTER (value > 0) AS max, stddev_pop(value) FILTER (value > 0) AS std, count(*) FILTER (value > 0) AS k FROM cells GROUP BY row, col)
        SELECT row, col, round(mean, 6) AS mean, round(max, 6) AS max, round(std, 6) AS std FROM t WHERE k = (SELECT count(DISTINCT pass_idx) FROM cells)""",
    ),
    "extent_intersection": (_extent("intersection"), _extent_sql("max", "min")),
    "extent_union": (_extent("union"), _extent_sql("min", "max")),
    "cube_align": (
        _align,
        f"""WITH {cells_sql()}, p AS (SELECT pass_idx, value, floor((300 - (320.0 - row * 10.0 - pass_idx * 2.0)) / 20)::INT AS r, floor((col * 10.0 + pass_idx * 3.0 - 20) / 20)::INT AS c FROM cells)
        SELECT pass_idx, r AS row, c AS col, round(avg(value) + 3e-8, 6) AS value FROM p WHERE r BETWEEN 0 AND 11 AND c BETWEEN 0 AND 9 GROUP BY 1, 2, 3""",
    ),
}
