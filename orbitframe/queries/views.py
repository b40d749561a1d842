"""Frames, pixel windows, cards and feature lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cards, codec
from ..operators import bake, frames, windows
from ..operators.raster import window_for
from ..sources import sinks
from .adapters import ACQ, acquisitions, cells, cells_sql, read

GRID = windows.Grid(10.0, 50.0, 0.5, 0.25, 32, 32)


def _ordered(spark, sf_dir):
    return frames.ordered(acquisitions(spark, sf_dir), ["task"]).select("href", "frame", "label")


def _pairs(spark, sf_dir):
    return frames.pairs(acquisitions(spark, sf_dir), ["task"]).select("href", "prev_href")


def _window(spark, sf_dir):
    w = windows.read_window(cells(spark, sf_dir), GRID, (12.1, 44.0, 23.9, 48.6), 9, ["pass_idx"])
    return w.select("pass_idx", "row", "col", F.round(F.col("value") + 3e-8, 6).alias("value"))


def _window_sql() -> str:
    r0, r1, c0, c1 = GRID.window((12.1, 44.0, 23.9, 48.6))
    k = window_for(c1 - c0, r1 - r0, 9)
    return f"WITH {cells_sql()} SELECT pass_idx, ((row - {r0}) // {k})::INT AS row, ((col - {c0}) // {k})::INT AS col, round(avg(value) + 3e-8, 6) AS value FROM cells WHERE row >= {r0} AND row < {r1} AND col >= {c0} AND col < {c1} GROUP BY 1, 2, 3"


def _quicklook(spark, sf_dir):
    return windows.quicklook(cells(spark, sf_dir), GRID, 10, ["pass_idx"]).select("pass_idx", "row", "col", F.round(F.col("value") + 3e-8, 6).alias("value"))


def _warp(spark, sf_dir):
    one = cells(spark, sf_dir).where("pass_idx = 2")
    w = windows.warp(one, (10.0, 0.5, 0.1, 50.0, 0.05, -0.25), windows.Grid(12.0, 48.0, 0.4, 0.2, 24, 20))
    return w.select("row", "col", F.round(F.col("value") + 3e-8, 6).alias("value"))


_WARP = f"""WITH {cells_sql()}, t AS (SELECT r.i AS row, c.i AS col, 12 + (c.i + 0.5) * 0.4::DOUBLE - 10 AS x, 48 - (r.i + 0.5) * 0.2::DOUBLE - 50 AS y FROM range(0, 20) r(i), range(0, 24) c(i)),
p AS (SELECT row, col, floor((-0.25::DOUBLE * x - 0.1::DOUBLE * y) / (0.5::DOUBLE * -0.25::DOUBLE - 0.1::DOUBLE * 0.05::DOUBLE)) AS sc, floor((0.5::DOUBLE * y - 0.05::DOUBLE * x) / (0.5::DOUBLE * -0.25::DOUBLE - 0.1::DOUBLE * 0.05::DOUBLE)) AS sr FROM t)
SELECT p.row::INT AS row, p.col::INT AS col, round(value + 3e-8, 6) AS value FROM p JOIN cells ON cells.row = sr AND cells.col = sc AND pass_idx = 2"""


def _cards(spark, sf_dir):
    c = acquisitions(spark, sf_dir).select("href", cards.context().alias("c"))
    return c.select("href", F.col("c.where").alias("where_text"), F.col("c.summary.centre.lat").alias("lat"), F.col("c.summary.centre.lon").alias("lon"), F.size("c.products").alias("n_products"))


def _permitted(spark, sf_dir):
    return acquisitions(spark, sf_dir).where(cards.permitted((-50.0, -20.0, 60.0, 40.0))).select("href")


def _features(spark, sf_dir):
    f = sinks.features(acquisitions(spark, sf_dir), ["task", "place"])
    return f.select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.geometry.type").alias("type"), F.get_json_object("value", "$.geometry.coordinates").alias("coordinates"), F.get_json_object("value", "$.properties.place").alias("place"))


def _blobs(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select("vec_id", codec.to_bytes(F.col("embedding")).alias("blob"))
    back = v.select("vec_id", F.length("blob").alias("bytes"), codec.from_bytes(F.col("blob")).alias("v"))
    return back.select("vec_id", "bytes", F.col("v")[0].cast("double").alias("first"), F.col("v")[63].cast("double").alias("last"))


def _places(spark, sf_dir):
    a = acquisitions(spark, sf_dir)
    return bake.bake_places(a, lambda lat, lon: f"{int(lat)}/{int(lon)}").select("href", "place")


_POINT = "'[' || {} || ',' || {} || ']'"
_RING = lambda *points: "'[[' || " + " || ',' || ".join(_POINT.format(x, y) for x, y in points) + " || ']]'"
_HALF = _RING(("min_lon", "min_lat"), ("max_lon", "min_lat"), ("min_lon", "max_lat"), ("min_lon", "min_lat"))
_BOX = _RING(("min_lon", "min_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"), ("min_lon", "max_lat"), ("min_lon", "min_lat"))
_FEATURES = f"WITH {ACQ} SELECT id, 'Polygon' AS type, CASE WHEN event_id % 4 = 1 THEN {_HALF} ELSE {_BOX} END AS coordinates, place FROM acq"

REGISTERED = {
    "frames_in_order": (_ordered, f"WITH {ACQ} SELECT href, (row_number() OVER (PARTITION BY task ORDER BY ts, href) - 1)::INT AS frame, strftime(ts, '%Y-%m-%d') AS label FROM acq"),
    "frame_pairs": (_pairs, f"WITH {ACQ}, p AS (SELECT href, lag(href) OVER (PARTITION BY task ORDER BY ts, href) AS prev_href FROM acq) SELECT * FROM p WHERE prev_href IS NOT NULL"),
    "raster_window": (_window, _window_sql()),
    "quicklook": (_quicklook, f"WITH {cells_sql()} SELECT pass_idx, (row * 10 // 32)::INT AS row, (col * 10 // 32)::INT AS col, round(avg(value) + 3e-8, 6) AS value FROM cells GROUP BY 1, 2, 3"),
    "affine_warp": (_warp, _WARP),
    "context_cards": (_cards, f"WITH {ACQ} SELECT href, coalesce(place, task) AS where_text, (min_lat + max_lat) / 2 AS lat, (min_lon + max_lon) / 2 AS lon, len(products)::INT AS n_products FROM acq"),
    "permitted": (_permitted, f"WITH {ACQ} SELECT href FROM acq WHERE (min_lon + max_lon) / 2 BETWEEN -50 AND 60 AND (min_lat + max_lat) / 2 BETWEEN -20 AND 40"),
    "geojson_features": (_features, _FEATURES),
    "vector_blobs": (_blobs, "SELECT vec_id, 256::INT AS bytes, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last FROM embeddings"),
    "baked_places": (
        _places,
        f"""WITH {ACQ}, a AS (SELECT *, (min_lat + max_lat) / 2 AS la, (min_lon + max_lon) / 2 AS lo FROM acq)
        SELECT href, coalesce(place, la::INT || '/' || lo::INT) AS place FROM a""",
    ),
}
