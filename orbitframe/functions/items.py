"""STAC documents as columns: times, site keys, asset classes, products, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.spec import PRODUCTS

#: The parts of a document that become columns; the rest stays in `doc`.
DOC_SCHEMA = (
    "id string, description string, bbox array<double>, geometry struct<type:string,coordinates:string>, "
    "properties map<string,string>, links array<struct<rel:string,href:string>>, assets map<string,struct<href:string,type:string,title:string,description:string>>"
)


def when(datetime: Column, start: Column) -> Column:
    """RFC 3339 text as a timestamp; the start stands in for a missing time, bad text is null, no zone means UTC."""
    return F.try_to_timestamp(F.coalesce(F.nullif(datetime, F.lit("")), start))


def task_key(href: Column, fallback: Column) -> Column:
    """The decoded path part after /sar-data/tasks/, else a property, else null; a plus sign stays one."""
    part = F.nullif(F.regexp_extract(href, "/sar-data/tasks/([^/]+)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), F.nullif(fallback, F.lit("")))


def acquisition_date(href: Column, ts: Column) -> Column:
    """The date at the head of a directory of the path, if it is one, else that of the time."""
    return F.coalesce(F.try_to_date(F.nullif(F.regexp_extract(href, r"/(\d{4}-\d{2}-\d{2})-[^/]*/[^/]*$", 1), F.lit(""))), F.to_date(ts))


def classify(key: Column, href: Column, media: Column) -> Column:
    """The product of an asset, by the first rule that its name fits."""
    name = F.upper(F.concat_ws(" ", key, F.coalesce(href, F.lit(""))))
    tif = name.contains("TIF") | F.lower(F.coalesce(media, F.lit(""))).contains("geotiff")
    out = F.when(name.contains("CPHD"), "CPHD").when(name.contains("SICD"), "SICD").when(name.contains("SIDD"), "SIDD")
    return out.when(name.contains("CSI") & tif, "CSI").when(name.contains("METADATA"), "metadata").when(tif, "GEC")


def asset_map(assets: Column) -> Column:
    """Product -> key of its asset: the last one in the map's order, but a CSI key never displaces another."""
    entries = F.map_entries(assets)
    classed = F.filter(F.transform(entries, lambda e: F.struct(classify(e["key"], e["value"]["href"], e["value"]["type"]).alias("c"), e["key"].alias("k"))), lambda x: x["c"].isNotNull())

    def put(acc: Column, x: Column) -> Column:
        old = F.try_element_at(acc, x["c"])
        keep = old.isNotNull() & F.upper(x["k"]).contains("CSI") & ~F.upper(old).contains("CSI")
        rest = F.map_filter(acc, lambda k, _: k != x["c"])
        return F.when(keep, acc).otherwise(F.map_concat(rest, F.create_map(x["c"], x["k"])))

    return F.aggregate(classed, F.create_map().cast("map<string,string>"), put)


def products(mapped: Column) -> Column:
    """The products present, in their fixed order, without metadata."""
    return F.filter(F.array(*map(F.lit, PRODUCTS)), lambda p: F.array_contains(F.map_keys(mapped), p))


def box(bbox: Column, coordinates: Column) -> Column:
    """West, south, east and north of a bbox of four numbers, or of six, whose heights drop out; else the extent of a geometry's JSON."""
    pairs = F.regexp_extract_all(coordinates, F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*-?[0-9.eE+-]+"), F.lit(1))
    lats = F.regexp_extract_all(coordinates, F.lit(r"\[\s*-?[0-9.eE+-]+\s*,\s*(-?[0-9.eE+-]+)"), F.lit(1))
    x, y = (F.transform(p, lambda v: v.try_cast("double")) for p in (pairs, lats))
    half = F.floor(F.size(bbox) / 2).cast("int")
    given = F.struct(bbox[0].alias("min_lon"), bbox[1].alias("min_lat"), F.try_element_at(bbox, half + 1).alias("max_lon"), F.try_element_at(bbox, half + 2).alias("max_lat"))
    derived = F.struct(F.array_min(x).alias("min_lon"), F.array_min(y).alias("min_lat"), F.array_max(x).alias("max_lon"), F.array_max(y).alias("max_lat"))
    return F.when(F.size(bbox) >= 4, given).when(F.size(x) > 0, derived)


def rings(kind: Column, coordinates: Column) -> Column:
    """Exterior rings of a Polygon's or MultiPolygon's coordinates as JSON."""
    point = lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))
    poly = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return F.when(kind == "Polygon", F.array(F.transform(poly[0], point))).when(kind == "MultiPolygon", F.transform(multi, lambda r: F.transform(r[0], point)))


def first_text(*texts: Column) -> Column:
    """The first that isn't null or empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def asset_url(href: Column, sidecar: Column, key: Column, suffixes: dict[str, str], root: str | None = None, task_id: Column | None = None) -> Column:
    """An absolute href as it is, else the sibling of the sidecar under its name on disk, else derived from a task id, else as given.

    suffixes: suffixes of asset keys and the suffixes of the files they stand for; longer ones first.
    """
    absolute = lambda c: c.rlike("^https?://")
    name = derived = F.lit(None).cast("string")
    for have, disk in sorted(suffixes.items(), key=lambda x: len(x[0])):
        stem = F.substring(key, F.lit(1), F.length(key) - len(have))
        name = F.when(key.endswith(have), F.concat(stem, F.lit(disk))).otherwise(name)
        if root and task_id is not None:
            derived = F.when(key.endswith(have), F.concat(F.lit(root.rstrip("/") + "/"), task_id, F.lit("/"), stem, F.lit("/"), stem, F.lit(disk))).otherwise(derived)
    sibling = F.when(absolute(sidecar), F.concat(F.regexp_replace(sidecar, "[^/]*$", ""), name))
    return F.coalesce(F.when(absolute(href), href), sibling, derived, href)


def trimmed(x: Column, digits: int = 5) -> Column:
    """A number with so many decimals, without zeros at the end."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", x), r"\.?0+$", "")
