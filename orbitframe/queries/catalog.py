"""Catalog search, statistics and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search
from ..plans.spec import SearchSpec
from .adapters import ACQ, acquisitions

_OUT = ("href", "task", "acq_date")
_ORDER = "task IS NULL, task, acq_date NULLS FIRST, href"


def _found(**spec):
    return lambda spark, sf_dir: search.search(acquisitions(spark, sf_dir), SearchSpec(**spec)).select(*_OUT)


def _sql(where: str) -> str:
    return f"WITH {ACQ} SELECT href, task, acq_date FROM acq WHERE {where}"


def _page(spark, sf_dir):
    return search.page(acquisitions(spark, sf_dir), SearchSpec(area="1"), 40, 25).select(*_OUT, "has_next")


def _facets(spark, sf_dir):
    f = search.facets(acquisitions(spark, sf_dir))
    return f.select("first_date", "last_date", F.array_join("products", ",").alias("products"), F.array_join("polarizations", ",").alias("polarizations"))


def _grid(spark, sf_dir):
    g = search.site_grid(acquisitions(spark, sf_dir))
    return g.select("task", "cell_lat", "cell_lon", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.md5(F.array_join("hrefs", ",")).alias("hrefs_md5"))


def _spaced(spark, sf_dir):
    return search.evenly_spaced(acquisitions(spark, sf_dir), 5, ["task"], [F.col("ts"), F.col("href")]).select(*_OUT)


TRIANGLE = {"type": "Polygon", "coordinates": [[[-100, -60], [100, -60], [0, 70], [-100, -60]]]}



def _fuzzy(spark, sf_dir):
    """Sites named "Site n", by a name with a typo."""
    a = acquisitions(spark, sf_dir).withColumn("task", F.concat(F.lit("Site "), "task"))
    return search.search(a, SearchSpec(area="sitte 10", fuzzy=True)).select("href", F.substring("task", 6, 20).alias("task"), "acq_date")


def _polygon_sql() -> str:
    """Two convex shapes meet unless a line along an edge of one parts them: edges of the triangle, of the box, and the slope of a footprint."""
    t = TRIANGLE["coordinates"][0]
    corners = (("min_lon", "min_lat"), ("max_lon", "min_lat"), ("min_lon", "max_lat"), ("max_lon", "max_lat"))  # a footprint lacks the last
    parts = []
    for (ax, ay), (bx, by) in zip(t, t[1:], strict=False):
        beyond = [f"(({bx} - ({ax})) * ({y} - ({ay})) - ({by} - ({ay})) * ({x} - ({ax}))) < 0" for x, y in corners]
        parts.append(f"({' AND '.join(beyond[:3])} AND (event_id % 4 = 1 OR {beyond[3]}))")
    xs, ys = [p[0] for p in t], [p[1] for p in t]
    parts.append(f"NOT (min_lon <= {max(xs)} AND max_lon >= {min(xs)} AND min_lat <= {max(ys)} AND max_lat >= {min(ys)})")
    parts.append("(event_id % 4 = 1 AND " + " AND ".join(f"({x}) - max_lon + ({y}) - min_lat > 0" for x, y in t[:3]) + ")")
    return _sql(f"NOT ({' OR '.join(parts)})")


REGISTERED = {
    "search_date": (_found(start="2024-01-10", end="2024-01-12"), _sql("acq_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'")),
    "search_substring": (_found(area="12"), _sql("contains(lower(task), '12')")),
    "search_bbox": (_found(bbox=(-60, -30, 10, 45)), _sql("min_lon <= 10 AND max_lon >= -60 AND min_lat <= 45 AND max_lat >= -30")),
    "search_products": (_found(products="SICD,cphd"), _sql("list_has_any(products, ['SICD', 'CPHD'])")),
    "search_pol": (_found(polarizations=frozenset({"CLICK", "VIEW"})), _sql("upper(polarizations[1]) IN ('CLICK', 'VIEW')")),
    "search_incidence": (_found(min_incidence=20.0, max_incidence=30.0), _sql("incidence BETWEEN 20 AND 30")),
    "search_resolution": (_found(max_resolution=0.5), _sql("res_range <= 0.5 AND res_azimuth <= 0.5")),
    "search_ids": (_found(ids=("id3", "id77", "id500")), _sql("id IN ('id3', 'id77', 'id500')")),
    "search_combined": (_found(start="2024-01", area="7", bbox=(-180, -90, 180, 0), products="GEC", max_incidence=60.0), _sql("acq_date >= DATE '2024-01-01' AND contains(task, '7') AND min_lat <= 0 AND list_contains(products, 'GEC') AND incidence <= 60")),
    "search_max_per_task": (_found(max_per_task=3, products="GEC"), f"WITH {ACQ} SELECT href, task, acq_date FROM acq WHERE list_contains(products, 'GEC') QUALIFY row_number() OVER (PARTITION BY task ORDER BY acq_date NULLS FIRST, href) <= 3"),
    "search_limit": (_found(area="3", limit=17), f"WITH {ACQ} SELECT href, task, acq_date FROM acq WHERE contains(task, '3') ORDER BY {_ORDER} LIMIT 17"),
    "search_page": (_page, f"WITH {ACQ} SELECT href, task, acq_date, (SELECT count(*) FROM acq WHERE contains(task, '1')) > 65 AS has_next FROM acq WHERE contains(task, '1') ORDER BY {_ORDER} LIMIT 25 OFFSET 40"),
    "search_polygon": (_found(intersects=TRIANGLE), _polygon_sql()),
    # a token of "1", any digit and "0" is as similar to "10" as the limit of 0.8 asks: 2 * 2 / 5
    "search_fuzzy": (_fuzzy, _sql("contains(task, '10') OR regexp_full_match(task, '1.0')")),
    "lookup_id": (lambda s, d: search.get(acquisitions(s, d), "id42").select(*_OUT), _sql("id = 'id42'")),
    "resolve_items": (lambda s, d: search.in_request_order(acquisitions(s, d), ["id9", "id3", "id700"]).select(*_OUT), _sql("id IN ('id9', 'id3', 'id700')")),
    "catalog_stats": (
        lambda s, d: search.stats(acquisitions(s, d)),
        f"WITH {ACQ} SELECT count(*) AS items, min(acq_date) AS first_date, max(acq_date) AS last_date, count(DISTINCT task) AS tasks, count(place) AS placed, 0::BIGINT AS thumbnails FROM acq",
    ),
    "facets": (
        _facets,
        f"""WITH {ACQ} SELECT (SELECT min(acq_date) FROM acq) AS first_date, (SELECT max(acq_date) FROM acq) AS last_date,
        (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest(products) AS x FROM acq)) AS products,
        (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest(polarizations) AS x FROM acq)) AS polarizations""",
    ),
    "site_names": (lambda s, d: search.site_names(acquisitions(s, d)), f"WITH {ACQ} SELECT DISTINCT task FROM acq WHERE task != ''"),
    "site_grid": (
        _grid,
        f"""WITH {ACQ}, c AS (SELECT task, href, (min_lat + max_lat) / 2 AS lat, (min_lon + max_lon) / 2 AS lon FROM acq)
        SELECT task, round_even(lat / 0.1::DOUBLE, 0)::BIGINT AS cell_lat, round_even(lon / 0.1::DOUBLE, 0)::BIGINT AS cell_lon, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, md5(string_agg(href, ',' ORDER BY href)) AS hrefs_md5 FROM c GROUP BY 1, 2, 3""",
    ),
    "frames_evenly_spaced": (
        _spaced,
        f"""WITH {ACQ}, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts, href) - 1 AS i, count(*) OVER (PARTITION BY task) AS n FROM acq)
        SELECT href, task, acq_date FROM r WHERE n <= 5 OR list_contains(list_transform(range(0, 5), lambda x: round_even(x * (n - 1) / 4, 0)::INT), i::INT)""",
    ),
}
