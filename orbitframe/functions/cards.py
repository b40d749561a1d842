"""Rows as cards and documents, and checks of what models reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each product is, in a few words.
EXPLANATIONS = {
    "GEC": "geocoded ellipsoid-corrected image, ready for maps",
    "CSI": "colourised sub-aperture image that shows motion",
    "SIDD": "derived image with display metadata",
    "SICD": "complex image in the sensor's own geometry",
    "CPHD": "phase history before image formation",
}


def centre() -> Column:
    """(lat, lon) of the box; null without one."""
    lat, lon = (F.col("min_lat") + F.col("max_lat")) / 2, (F.col("min_lon") + F.col("max_lon")) / 2
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def permitted(box: tuple[float, float, float, float]) -> Column:
    """Whether the centre lies in a box; a row without a box is refused."""
    c = centre()
    w, s, e, n = box
    return F.coalesce((c["lon"] >= w) & (c["lon"] <= e) & (c["lat"] >= s) & (c["lat"] <= n), F.lit(False))


def summary() -> Column:
    keys = ("id", "task", "place", "ts", "products", "polarizations", "incidence", "res_range", "res_azimuth", "href")
    return F.struct(*keys, centre().alias("centre"))


def context() -> Column:
    """The summary, where it is, and each product with its explanation."""
    told = F.create_map(*[F.lit(x) for pair in EXPLANATIONS.items() for x in pair])
    products = F.transform("products", lambda p: F.struct(p.alias("product"), F.try_element_at(told, p).alias("explanation")))
    return F.struct(summary().alias("summary"), F.coalesce("place", "task").alias("where"), products.alias("products"))


def to_stac(acq: DataFrame, collection: str, base_url: str) -> DataFrame:
    """A STAC feature for each row, as text: its collection, its links, and the place unless it has one."""
    base = base_url.rstrip("/")
    link = lambda rel, href: F.struct(F.lit(rel).alias("rel"), href.alias("href"))
    own = F.concat(F.lit(f"{base}/collections/{collection}/items/"), F.col("id"))
    links = F.array(link("self", own), link("collection", F.lit(f"{base}/collections/{collection}")), link("root", F.lit(base)))
    props = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), "task", "place", "polarizations", "incidence")
    bbox = F.when(F.col("min_lon").isNotNull(), F.array("min_lon", "min_lat", "max_lon", "max_lat"))
    return acq.select(F.to_json(F.struct(F.lit("Feature").alias("type"), "id", F.lit(collection).alias("collection"), bbox.alias("bbox"), props.alias("properties"), links.alias("links"))).alias("value"))


def replies(df: DataFrame, column: str = "reply") -> DataFrame:
    """df with ok, summary, observations and confidence from model replies: JSON in a fence or between the outermost braces.

    A reply without a summary isn't ok; lists keep texts only; an unknown confidence is null.
    """
    fenced = F.nullif(F.regexp_extract(column, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    body = F.coalesce(fenced, F.nullif(F.regexp_extract(column, r"(?s)(\{.*\})", 1), F.lit("")))
    d = F.from_json(body, "summary string, observations array<string>, confidence string")
    out = df.withColumn("_d", d)
    text = F.nullif(F.trim("_d.summary"), F.lit(""))
    level = F.lower("_d.confidence")
    return out.select(*df.columns, text.isNotNull().alias("ok"), text.alias("summary"), F.coalesce(F.filter("_d.observations", lambda x: F.trim(x) != ""), F.array().cast("array<string>")).alias("observations"), F.when(level.isin("low", "medium", "high"), level).alias("confidence"))
