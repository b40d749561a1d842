"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(text: str) -> T.StructType:
    """A schema from DDL without a session."""
    out = T.StructType()
    kinds = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "date": T.DateType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(), "float": T.FloatType(), "binary": T.BinaryType()}
    for part in text.split(","):
        name, kind = part.split()
        depth = kind.count("[]")
        t: T.DataType = kinds[kind.replace("[]", "")]
        for _ in range(depth):
            t = T.ArrayType(t)
        out.add(name, t)
    return out


ASSET = _s("href string, type string, title string, description string")
POINT = _s("lon double, lat double")
RINGS = T.ArrayType(T.ArrayType(POINT))
BBOX = _s("min_lon double, min_lat double, max_lon double, max_lat double")

ACQUISITIONS = _s(
    "href string, id string, task string, ts timestamp, acq_date date, min_lon double, min_lat double, max_lon double, max_lat double, "
    "products string[], polarizations string[], incidence double, res_range double, res_azimuth double, platform string, product_type string, instrument_mode string"
).add("rings", RINGS).add("place", T.StringType()).add("assets", T.MapType(T.StringType(), ASSET)).add("doc", T.StringType())
CELLS = _s("scene_id string, row int, col int, value float")
CUBE_CELLS = _s("pass_idx int, item_id string, ts timestamp, row int, col int, value double")
GRID = _s("crs string, left double, bottom double, right double, top double, width int, height int, xres double, yres double")
SITE_COVERAGE = (
    _s("task string, label string, passes long, comparable_passes long, first date, last date, span_days long, comparable_span_days long, "
       "min_revisit_days double, median_revisit_days double, max_revisit_days double, comparable_min_revisit_days double, comparable_median_revisit_days double, comparable_max_revisit_days double")
    .add("bbox", BBOX)
)
for _name in ("products", "polarizations", "comparable_polarizations", "hrefs", "comparable_hrefs"):
    SITE_COVERAGE.add(_name, T.ArrayType(T.StringType()))
CHANGE = _s("compared_cells long, mean_delta_db double, mean_abs_delta_db double, brightened_fraction double, dimmed_fraction double, changed_fraction double, changed_area_km2 double")
PASS_STATS = _s("pass_idx int, valid_cells long, valid_fraction double, mean double, median double, std double, p5 double, p95 double")
DETECTION = _s("looks double, cell_sigma_db double, false_alarm_fraction double, false_alarm_target double, target_threshold_db double")
TASK_VECTORS = _s("task string, model string, dim int, vec float[]")
SCENE_VECTORS = _s("item_id string, href string, task string, datetime string, model string, dim int, vec float[]")
THUMBNAILS = _s("href string, id string, png binary, asset string, size int")
WATCH_RESULT = _s("watch string, checked_at timestamp, first_run boolean, new_count long, total_seen long, query string")
UPDATE_RESULT = _s("scanned long, added long, refreshed long, start date")
PREFLIGHT = _s("item_id string, href string, supported boolean, reason string, error string, error_scope string, capabilities string[], product_bytes long")
META = _s("key string, value string")

#: By the name under which a schema is published.
PUBLISHED = {
    "acquisitions": ACQUISITIONS, "cells": CELLS, "cube_cells": CUBE_CELLS, "grid": GRID, "site_coverage": SITE_COVERAGE, "change": CHANGE, "pass_stats": PASS_STATS, "detection": DETECTION,
    "task_vectors": TASK_VECTORS, "scene_vectors": SCENE_VECTORS, "thumbnails": THUMBNAILS, "watch_result": WATCH_RESULT, "update_result": UPDATE_RESULT, "preflight_result": PREFLIGHT, "meta": META,
}


def schema_names() -> list[str]:
    return sorted(PUBLISHED)


def load_schema(name: str) -> T.StructType:
    if name not in PUBLISHED:
        raise KeyError(f"no schema {name!r}; there are {', '.join(schema_names())}")
    return PUBLISHED[name]
