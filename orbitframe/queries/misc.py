"""Upserts and merges, vectors, tiles, provenance, chip summaries, preflight, documents, watches and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import items, matching
from ..operators import catalog, provenance, search, tiles, vectors
from ..plans.spec import SearchSpec
from ..sources import products
from ..streaming import budget, refresh, watch
from .adapters import ACQ, acquisitions, read, scratch


def _upsert(spark, sf_dir):
    a = acquisitions(spark, sf_dir)
    old = a.where("event_id % 3 != 0").select("href", "task", "acq_date", "place", "incidence")
    new = a.where("event_id % 2 = 0").select("href", F.concat("task", F.lit("b")).alias("task"), "acq_date", F.lit(None).cast("string").alias("place"), (F.col("incidence") + 1).alias("incidence"))
    return catalog.upsert(old, new)


_UPSERT = f"""WITH {ACQ}, o AS (SELECT * FROM acq WHERE event_id % 3 != 0), n AS (SELECT * FROM acq WHERE event_id % 2 = 0)
SELECT coalesce(n.href, o.href) AS href, CASE WHEN n.href IS NOT NULL THEN n.task || 'b' ELSE o.task END AS task, coalesce(n.acq_date, o.acq_date) AS acq_date, o.place, CASE WHEN n.href IS NOT NULL THEN n.incidence + 1 ELSE o.incidence END AS incidence
FROM o FULL JOIN n ON o.href = n.href"""


def _thumbs(spark, sf_dir):
    a = acquisitions(spark, sf_dir)
    k = F.col("event_id")
    mine = a.select("href", F.when(k % 4 != 0, F.col("href").cast("binary")).alias("thumbnail"), F.when(k % 4 != 0, F.lit("GEC")).alias("thumb_asset"), F.when(k % 4 != 0, (k % 100).cast("int")).alias("thumb_size"))
    inc = a.where("event_id % 2 = 0").select("href", F.concat(F.lit("new "), "href").cast("binary").alias("png"), F.when(k % 6 == 0, "CSI").otherwise("GEC").alias("asset"), F.lit(50).alias("size"))
    m = catalog.merge_thumbnails(mine, inc)
    return m.select("href", F.md5("thumbnail").alias("digest"), "thumb_asset", "thumb_size")


_THUMBS = f"""WITH {ACQ}, m AS (SELECT href, event_id AS k, CASE WHEN event_id % 4 != 0 THEN href END AS t, CASE WHEN event_id % 4 != 0 THEN 'GEC' END AS a, CASE WHEN event_id % 4 != 0 THEN (event_id % 100)::INT END AS s FROM acq),
j AS (SELECT *, k % 2 = 0 AND (t IS NULL OR (50 > s AND (CASE WHEN k % 6 = 0 THEN 'CSI' ELSE 'GEC' END) IS NOT DISTINCT FROM a)) AS take FROM m)
SELECT href, md5(CASE WHEN take THEN 'new ' || href ELSE t END) AS digest, CASE WHEN take THEN CASE WHEN k % 6 = 0 THEN 'CSI' ELSE 'GEC' END ELSE a END AS thumb_asset, CASE WHEN take THEN 50 ELSE s END AS thumb_size FROM j"""


def _read_through(spark, sf_dir):
    a = acquisitions(spark, sf_dir).select("href", "task", "acq_date", "place", "event_id")
    stored = a.where("event_id % 4 != 0").withColumn("place", F.lit("stored")).drop("event_id")
    live = a.where("acq_date >= '2024-01-25'").withColumn("place", F.lit("live")).drop("event_id")
    return catalog.read_through(stored, live).orderBy(*search.catalog_order())


def _only_new(spark, sf_dir):
    a = acquisitions(spark, sf_dir)
    return catalog.only_new(a.select("task"), a.where("event_id < 400").select("task").distinct(), "task").select("task")


def _semi(spark, sf_dir):
    a = acquisitions(spark, sf_dir)
    return catalog.with_product(a, a.select("href", F.explode("products").alias("asset")), ["SICD", "CPHD"]).select("href")


def _topk(min_score=None):
    def run(spark, sf_dir):
        v = read(spark, sf_dir, "embeddings")
        q = v.where("vec_id = 0").select("embedding").first()[0]
        t = vectors.top_k(v, q, "vec_id", 10 if min_score is None else 1000, min_score, 0, "embedding")
        return t.select("vec_id", F.round("score", 6).alias("score"))

    return run


def _topk_sql(where: str, limit: int) -> str:
    return f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings WHERE vec_id != 0) WHERE {where} ORDER BY s DESC, vec_id LIMIT {limit}"


def _mercator(spark, sf_dir):
    a = acquisitions(spark, sf_dir)
    x, y = geo.tile_fraction(F.col("min_lon"), F.col("min_lat"), 8)
    return a.select("href", F.floor(x).cast("long").alias("x"), F.floor(y).cast("long").alias("y"))


def _hilbert(spark, sf_dir):
    return spark.range(1 << 12).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y")).select("x", "y", geo.hilbert_id(6, F.col("x"), F.col("y")).alias("tile_id"))


_HILBERT = """WITH RECURSIVE t AS (SELECT id % 64 AS x, id // 64 AS y FROM range(0, 4096) r(id)),
h AS (
  SELECT x, y, x AS hx, y AS hy, 32 AS s, 0::BIGINT AS d FROM t
  UNION ALL
  SELECT x, y, CASE WHEN ry THEN CASE WHEN rx AND NOT ry THEN s - 1 - hx ELSE hx END ELSE CASE WHEN rx THEN s - 1 - hy ELSE hy END END,
    CASE WHEN ry THEN hy ELSE CASE WHEN rx THEN s - 1 - hx ELSE hx END END, s // 2,
    d + s * s * CASE WHEN rx AND ry THEN 2 WHEN rx THEN 3 WHEN ry THEN 1 ELSE 0 END
  FROM (SELECT *, (hx & s) > 0 AS rx, (hy & s) > 0 AS ry FROM h WHERE s > 0)
)
SELECT x, y, (4096 - 1) // 3 + d AS tile_id FROM h WHERE s = 0"""


def _utm(spark, sf_dir):
    a = acquisitions(spark, sf_dir)
    return a.select("href", geo.utm_epsg((F.col("min_lon") + F.col("max_lon")) / 2, (F.col("min_lat") + F.col("max_lat")) / 2).alias("epsg"))


def _dem(spark, sf_dir):
    a = acquisitions(spark, sf_dir)
    return a.select("href", F.explode(geo.dem_tile_ids(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat"))).alias("tile"))


def _sources(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item_id"), F.col("l_shipdate").alias("ts"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("calibration"), F.when(F.col("l_returnflag") != "A", F.col("l_linestatus")).alias("speckle"))


def _groups(spark, sf_dir):
    g = provenance.groups(_sources(spark, sf_dir), ["calibration", "speckle"])
    return g.select("calibration", "speckle", "n", F.md5(F.array_join("item_ids", ",")).alias("items_md5"))


def _conflicts(spark, sf_dir):
    return provenance.conflicts(_sources(spark, sf_dir), ["calibration", "speckle"]).select("key", F.array_join("values", ",").alias("values"))


def _chips(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("item_id"), (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("seq"), F.col("l_returnflag").alias("noise_model"), (F.col("l_quantity") / 2).alias("margin_db"), "l_discount",
        F.col("l_discount").alias("floored"), (F.col("l_quantity") % 7).alias("before"), (F.col("l_quantity") % 11).alias("after"), F.col("l_quantity").alias("window_pixels"), F.col("l_extendedprice").alias("scene_pixels"),
    )


_CHIPS = """c AS (SELECT l_orderkey AS item_id, l_linenumber * 100000000 + l_partkey * 10000 + l_suppkey AS seq, l_returnflag AS m, l_quantity / 2 AS margin, l_discount AS fl, l_quantity % 7 AS before, l_quantity % 11 AS after, l_quantity AS w, l_extendedprice AS s FROM lineitem),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY seq) = 1)"""


def _noise(spark, sf_dir):
    n = provenance.noise_summary(_chips(spark, sf_dir))
    return n.select("items", F.array_join("models", ",").alias("models"), "low_margin", "min_margin_db", "max_floored")


def _speckle(spark, sf_dir):
    return provenance.speckle_summary(_chips(spark, sf_dir)).select("items", "low_gain", F.round("median_gain", 6).alias("median_gain"), F.round("min_gain", 6).alias("min_gain"))


def _clip(spark, sf_dir):
    return provenance.clip_summary(_chips(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("window_pixels", "scene_pixels", "ratio", "min_ratio", "max_ratio")])


def _preflight(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    p = o.select(
        k.alias("item_id"), F.when(k % 3 == 0, F.array(F.lit("sigma0"))).when(k % 3 == 1, F.array(F.lit("beta0"), F.lit("gamma0"))).otherwise(F.array().cast("array<string>")).alias("calibrations"),
        F.when(k % 2 == 0, "ABSOLUTE").alias("noise_level"), F.when(k % 5 != 0, F.lit(30.0)).alias("incidence"), F.lit(10.0).alias("azimuth"), F.when(k % 50 == 0, "short").alias("error"), F.when(k % 7 != 0, k * 10).alias("product_bytes"),
    )
    return products.preflight(p, calibration="gamma0", noise_subtract=True, rtc=True)


_PREFLIGHT = """v AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN 'unreadable: short' WHEN o_orderkey % 3 != 1 THEN 'no gamma0 calibration' WHEN o_orderkey % 2 != 0 THEN 'no absolute noise level' WHEN o_orderkey % 5 = 0 THEN 'no look geometry' END AS reason, o_orderkey % 50 = 0 AS bad, CASE WHEN o_orderkey % 7 != 0 THEN o_orderkey * 10 END AS b FROM orders)"""


def _documents(spark, sf_dir):
    """STAC documents made from events and read back."""
    a = acquisitions(spark, sf_dir)
    k = F.col("event_id")
    asset = lambda h, t: F.struct(h.alias("href"), F.lit(t).alias("type"), F.lit(None).cast("string").alias("title"), F.lit("made").alias("description"))
    assets = F.when(k % 3 == 0, F.create_map(F.lit("x_GEC.tif"), asset(F.lit("a.tif"), "image/tiff"), F.lit("x_CSI.tif"), asset(F.lit("b.tif"), "image/tiff"))).otherwise(F.create_map(F.lit("x_SICD.nitf"), asset(F.lit("c.nitf"), "application/nitf"), F.lit("x_METADATA.json"), asset(F.lit("m.json"), "application/json")))
    props = F.create_map(F.lit("datetime"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("view:incidence_angle"), F.col("incidence").cast("string"), F.lit("sar:polarizations"), F.concat(F.lit('["'), F.col("polarizations")[0], F.lit('"]')), F.lit("task_id"), F.when(k % 4 == 0, F.concat(F.lit("t "), "task")))
    href = F.when(k % 4 != 0, F.concat(F.lit("s3://b/sar-data/tasks/Site%20"), "task", F.lit("+x/2024-01-02-03/"), "id", F.lit(".stac.v2.json"))).otherwise(F.col("href"))
    doc = F.to_json(F.struct("id", F.array("min_lon", "min_lat", F.lit(0.0), "max_lon", "max_lat", F.lit(9.0)).alias("bbox"), props.alias("properties"), assets.alias("assets")))
    r = catalog.from_documents(a.select(doc.alias("doc"), href.alias("href")))
    return r.select("id", "task", "acq_date", "min_lon", "max_lat", F.array_join("products", ",").alias("products"), F.array_join("polarizations", ",").alias("polarizations"), "incidence", "description", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"))


_DOCUMENTS = f"""WITH {ACQ} SELECT id, CASE WHEN event_id % 4 != 0 THEN 'Site ' || task || '+x' ELSE 't ' || task END AS task, CASE WHEN event_id % 4 != 0 THEN DATE '2024-01-02' ELSE acq_date END AS acq_date, min_lon, max_lat,
CASE WHEN event_id % 3 = 0 THEN 'GEC,CSI' ELSE 'SICD' END AS products, polarizations[1] AS polarizations, incidence, CASE WHEN event_id % 3 = 0 THEN 'made' END AS description, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts_text FROM acq"""


def _keys(spark, sf_dir):
    a = acquisitions(spark, sf_dir)
    return a.select("href", matching.content_key(F.concat(F.lit("task="), "task"), F.concat(F.lit("href="), "href"), length=12).alias("key"))


def _slugs(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", matching.slug(F.col("text")).alias("slug"))


def _trimmed(spark, sf_dir):
    a = acquisitions(spark, sf_dir)
    return a.select("href", items.trimmed(F.col("min_lon") + F.col("value") / 1000).alias("lon"))


def _watch(spark, sf_dir):
    """The state of a watch after a first run over January 1-20 and a second over all: what the second reports."""
    a = acquisitions(spark, sf_dir)
    spec = SearchSpec(products="SICD")
    store = watch.WatchStore(spark, scratch(spark, "watch"))
    name = watch.watch_key(spec)
    watch.watch(search.search(a, SearchSpec(products="SICD", end="2024-01-20")), name, store)
    return watch.watch(search.search(a, spec), name, store)["new_items"].select("href")


def _refresh(spark, sf_dir):
    """A catalog that ends on January 20, refreshed from all: what is older than the overlap stays as it was."""
    a = acquisitions(spark, sf_dir).select("href", "task", "acq_date", "place", "incidence")
    stored = a.where("acq_date <= '2024-01-20'")
    live = a.withColumn("incidence", F.col("incidence") + 1)
    return refresh.refresh(stored, live, 7)[0].select("href", "task", "acq_date", "incidence")


def _live(spark, sf_dir):
    a = acquisitions(spark, sf_dir)
    stored = a.where("acq_date <= '2024-01-20' and event_id % 3 != 0").withColumn("place", F.lit("stored"))
    return refresh.search_live(stored, a.withColumn("place", F.lit("live")), SearchSpec(products="SICD"), 7).select("href", "acq_date", "place")


def _newest(spark, sf_dir):
    return catalog.newest_batch(acquisitions(spark, sf_dir), 25).select("href", "acq_date")


def _urls(spark, sf_dir):
    a = acquisitions(spark, sf_dir)
    own = F.when(F.col("event_id") % 2 == 0, "y.tif").otherwise("https://o/y.tif")
    return a.select("href", items.asset_url(own, F.concat(F.lit("https://h/d/"), "id", F.lit(".json")), F.concat("id", F.lit("_GEC.tif")), {"_GEC.tif": "-gec.tif"}).alias("url"))


def _areas(spark, sf_dir):
    a = acquisitions(spark, sf_dir)
    return a.select("href", geo.cell_area_m2(F.col("event_id") % 3 == 0, F.col("res_range"), -F.col("res_azimuth")).alias("area"))


def _budget(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("ts", F.col("user_id").alias("client"), F.col("event_id").alias("seq"))
    g = budget.granted(e, 100, 2)
    return g.groupBy("day").agg(F.count_if("granted").alias("granted"), F.count(F.lit(1)).alias("asked"))


def _daily(spark, sf_dir):
    return budget.daily_counts(read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("client")))


def _tiles(spark, sf_dir):
    return tiles.encode_tiles(acquisitions(spark, sf_dir), 7, "footprints", ["task", "incidence"]).select("zoom", "x", "y", "tile_id", "sha256")


def _tile_counts(spark, sf_dir):
    return tiles.tile_ids(acquisitions(spark, sf_dir), 7).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


_LAT = "least(85.05112878::DOUBLE, greatest(-85.05112878::DOUBLE, {lat}))"
_TY = "floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * 128)"
_TILE_COUNTS = f"""WITH {ACQ}, b AS (SELECT href, floor((min_lon + 180) / 360 * 128)::INT AS x0, least(127, floor((max_lon + 180) / 360 * 128))::INT AS x1, least(127, {_TY.format(lat=_LAT.format(lat='min_lat'))})::INT AS y1, greatest(0, {_TY.format(lat=_LAT.format(lat='max_lat'))})::INT AS y0 FROM acq),
e AS (SELECT href, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM b), f AS (SELECT href, x, unnest(range(y0, y1 + 1)) AS y FROM e) SELECT x::INT AS x, y::INT AS y, count(*) AS n FROM f GROUP BY 1, 2"""


def _fuzzy(spark, sf_dir):
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    q = names.orderBy("p_name").first()[0].split()[0][:-1]
    return names.where(matching.fuzzy(F.col("p_name"), q))


REGISTERED = {
    "upsert_latest": (_upsert, _UPSERT),
    "thumbs_merge": (_thumbs, _THUMBS),
    "readthrough_union": (_read_through, f"WITH {ACQ} SELECT href, task, acq_date, CASE WHEN event_id % 4 != 0 THEN 'stored' ELSE 'live' END AS place FROM acq WHERE event_id % 4 != 0 OR acq_date >= DATE '2024-01-25'"),
    "anti_new_only": (_only_new, f"WITH {ACQ} SELECT DISTINCT task FROM acq WHERE task NOT IN (SELECT task FROM acq WHERE event_id < 400)"),
    "semi_products": (_semi, f"WITH {ACQ} SELECT href FROM acq WHERE list_has_any(products, ['SICD', 'CPHD'])"),
    "cosine_topk": (_topk(), _topk_sql("true", 10)),
    "cosine_min_score": (_topk(0.2), _topk_sql("s >= 0.2", 1000)),
    "mercator_tiles": (_mercator, f"WITH {ACQ} SELECT href, floor((min_lon + 180) / 360 * 256)::BIGINT AS x, floor((1 - ln(tan(radians({_LAT.format(lat='min_lat')})) + 1 / cos(radians({_LAT.format(lat='min_lat')}))) / pi()) / 2 * 256)::BIGINT AS y FROM acq"),
    "hilbert_ids": (_hilbert, _HILBERT),
    "utm_zone": (_utm, f"WITH {ACQ} SELECT href, (CASE WHEN min_lat + 1 >= 0 THEN 32600 ELSE 32700 END + (floor((min_lon + 181) / 6)::INT % 60 + 60) % 60 + 1)::INT AS epsg FROM acq"),
    "dem_tiles": (
        _dem,
        f"""WITH {ACQ}, t AS (SELECT href, unnest(range(min_lat::INT, max_lat::INT)) AS la, min_lon, max_lon FROM acq), u AS (SELECT href, la, unnest(range(min_lon::INT, max_lon::INT)) AS lo FROM t)
        SELECT href, 'Copernicus_DSM_COG_10_' || CASE WHEN la >= 0 THEN 'N' ELSE 'S' END || lpad(abs(la)::VARCHAR, 2, '0') || '_00_' || CASE WHEN lo >= 0 THEN 'E' ELSE 'W' END || lpad(abs(lo)::VARCHAR, 3, '0') || '_00_DEM' AS tile FROM u""",
    ),
    "provenance_groups": (
        _groups,
        """WITH s AS (SELECT l_orderkey || '-' || l_linenumber AS item_id, l_shipdate AS ts, CASE WHEN l_returnflag != 'N' THEN l_returnflag END AS c, CASE WHEN l_returnflag != 'A' THEN l_linestatus END AS k FROM lineitem)
        SELECT coalesce(c, 'none') AS calibration, coalesce(k, 'none') AS speckle, count(*) AS n, md5(string_agg(item_id, ',' ORDER BY ts, item_id)) AS items_md5 FROM s GROUP BY 1, 2""",
    ),
    "provenance_conflicts": (
        _conflicts,
        """WITH s AS (SELECT coalesce(CASE WHEN l_returnflag != 'N' THEN l_returnflag END, 'none') AS c, coalesce(CASE WHEN l_returnflag != 'A' THEN l_linestatus END, 'none') AS k FROM lineitem),
        u AS (SELECT DISTINCT 'calibration' AS key, c AS v FROM s UNION SELECT DISTINCT 'speckle', k FROM s) SELECT key, string_agg(v, ',' ORDER BY v) AS "values" FROM u GROUP BY key HAVING count(*) > 1""",
    ),
    "chip_noise_summary": (_noise, f"WITH {_CHIPS} SELECT count(*) AS items, (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT m FROM f)) AS models, count(*) FILTER (margin < 6) AS low_margin, min(margin) AS min_margin_db, max(fl) AS max_floored FROM f"),
    "chip_speckle_summary": (
        _speckle,
        f"WITH {_CHIPS}, g AS (SELECT CASE WHEN before != 0 AND after != 0 THEN after / before END AS g FROM f), r AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM g WHERE g IS NOT NULL) SELECT (SELECT count(*) FROM g) AS items, (SELECT count(*) FROM g WHERE g < 1.5) AS low_gain, (SELECT round(g, 6) FROM r WHERE i = n // 2) AS median_gain, (SELECT round(min(g), 6) FROM g) AS min_gain",
    ),
    "chip_clip_summary": (_clip, f"WITH {_CHIPS} SELECT round(sum(w), 6) AS window_pixels, round(sum(s), 6) AS scene_pixels, round(sum(w) / sum(s), 6) AS ratio, round(min(w / s), 6) AS min_ratio, round(max(w / s), 6) AS max_ratio FROM c"),
    "preflight_verdicts": (lambda s, d: _preflight(s, d).select("item_id", "supported", "reason"), f"WITH {_PREFLIGHT} SELECT k AS item_id, reason IS NULL AS supported, reason FROM v"),
    "preflight_rollup": (lambda s, d: products.rollup(_preflight(s, d)), f"WITH {_PREFLIGHT} SELECT count(*) FILTER (reason IS NULL) AS supported, count(*) FILTER (reason IS NOT NULL AND NOT bad) AS refused, count(*) FILTER (bad) AS unreadable, sum(b)::BIGINT AS product_bytes, sum(b) FILTER (reason IS NOT NULL)::BIGINT AS bytes_avoided FROM v"),
    "stac_documents": (_documents, _DOCUMENTS),
    "content_keys": (_keys, f"WITH {ACQ} SELECT href, substr(sha256('[\"href=' || href || '\",\"task=' || task || '\"]'), 1, 12) AS key FROM acq"),
    "slugs": (_slugs, "WITH s AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM conversations) SELECT conv_id, turn, CASE WHEN coalesce(s, '') = '' THEN 'item' ELSE s END AS slug FROM s"),
    "trimmed_bounds": (_trimmed, f"WITH {ACQ} SELECT href, regexp_replace(printf('%.5f', min_lon + value / 1000), '\\.?0+$', '') AS lon FROM acq"),
    "watch_delta": (_watch, f"WITH {ACQ} SELECT href FROM acq WHERE list_contains(products, 'SICD') AND acq_date > DATE '2024-01-20'"),
    "daily_budget": (
        _budget,
        """WITH o AS (SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY ts::DATE, user_id ORDER BY ts, event_id) AS own FROM events), w AS (SELECT event_id, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS d FROM o WHERE own <= 2)
        SELECT day, count(*) FILTER (d <= 100) AS granted, count(*) AS asked FROM o LEFT JOIN w USING (event_id) GROUP BY day""",
    ),
    "daily_counts": (_daily, "SELECT ts::DATE AS day, user_id AS client, count(*) AS n FROM events GROUP BY 1, 2"),
    "tile_counts": (_tile_counts, _TILE_COUNTS),
    "vector_tiles": (_tiles, None),
    "refresh_overlap": (_refresh, f"WITH {ACQ} SELECT href, task, acq_date, CASE WHEN acq_date >= DATE '2024-01-13' THEN incidence + 1 ELSE incidence END AS incidence FROM acq"),
    "live_search": (_live, f"WITH {ACQ}, o AS (SELECT *, acq_date <= DATE '2024-01-20' AND event_id % 3 != 0 AS old FROM acq WHERE list_contains(products, 'SICD')) SELECT href, acq_date, CASE WHEN old THEN 'stored' ELSE 'live' END AS place FROM o WHERE old OR acq_date >= DATE '2024-01-13'"),
    "newest_batch": (_newest, f"WITH {ACQ} SELECT href, acq_date FROM acq ORDER BY acq_date DESC NULLS LAST, href LIMIT 25"),
    "asset_urls": (_urls, f"WITH {ACQ} SELECT href, CASE WHEN event_id % 2 = 0 THEN 'https://h/d/' || id || '-gec.tif' ELSE 'https://o/y.tif' END AS url FROM acq"),
    "cell_areas": (_areas, f"WITH {ACQ} SELECT href, CASE WHEN event_id % 3 != 0 THEN abs(res_range * res_azimuth) END AS area FROM acq"),
    "fuzzy_names": (_fuzzy, None),
}
