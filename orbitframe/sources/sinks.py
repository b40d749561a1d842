"""Writers: tables with a schema version, GeoJSON, Parquet with geometry, manifests, tiles and chips."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError, SchemaVersionError

VERSION = 4


def write_catalog(acq: DataFrame, path: str) -> None:
    """Partitioned by month, each file sorted by site and date for min/max pruning; a range exchange, so that a large month is several tasks' work."""
    out = acq.withColumn("acq_month", F.date_format("acq_date", "yyyy-MM"))
    out.repartitionByRange("acq_month", "task", "href").sortWithinPartitions("acq_month", "task", "acq_date").write.mode("overwrite").partitionBy("acq_month").parquet(f"{path}/items")
    write_meta(acq.sparkSession, path, {"version": str(VERSION)})


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Older versions lack columns, which read as null; newer ones are refused."""
    version = int(read_meta(spark, path).get("version", "0"))
    if version > VERSION:
        raise SchemaVersionError(f"the catalog has version {version}, this code knows {VERSION}", hint="Upgrade.")
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/items")


def write_meta(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    now = read_meta(spark, path) | values
    spark.createDataFrame(sorted(now.items()), "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict[str, str]:
    """A handful of pairs; none where nothing was written."""
    conf = spark._jsc.hadoopConfiguration()
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    if not p.getFileSystem(conf).exists(p):
        return {}
    return {r["key"]: r["value"] for r in spark.read.schema("key string, value string").json(f"{path}/meta").collect()}


def flat(coordinates: Column) -> Column:
    """Positions without heights."""
    return F.transform(coordinates, lambda ring: F.transform(ring, lambda p: F.slice(p, 1, 2)))


def features(acq: DataFrame, properties: list[str]) -> DataFrame:
    """A GeoJSON feature for each row, as text: its rings, or else its box, and properties without nulls."""
    w, s, e, n = (F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    box = F.array(*[F.array(x, y) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))])
    own = closed_rings(F.col("rings")) if "rings" in acq.columns else F.lit(None).cast("array<array<array<double>>>")
    polygon = F.when(F.size(own) == 1, own).when(w.isNotNull(), F.array(box))
    many = F.transform(own, lambda ring: F.array(ring))
    feature = lambda kind, coordinates: F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id"), F.when(coordinates.isNotNull(), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))).alias("geometry"), F.struct(*properties).alias("properties")))
    return acq.select(F.when(F.size(own) > 1, feature("MultiPolygon", many)).otherwise(feature("Polygon", polygon)).alias("value"))


def closed_rings(rings: Column) -> Column:
    """Rings of (lon, lat) structs as arrays of positions whose last is the first; null if there are none."""
    positions = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"])))
    closed = F.transform(positions, lambda ring: F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1))))
    return F.when(F.size(rings) > 0, closed)


def write_geojson_lines(acq: DataFrame, path: str, properties: list[str]) -> None:
    features(acq, properties).write.mode("overwrite").text(path)


def feature_collection(acq: DataFrame, properties: list[str], most: int = 10_000) -> str:
    """One document for a map, of at most so many features; more is an error, not a cut."""
    rows = features(acq, properties).limit(most + 1).collect()
    if len(rows) > most:
        raise PlanError(f"more than {most} features for one document", hint="Write GeoJSON lines.")
    b = acq.agg(F.min("min_lon"), F.min("min_lat"), F.max("max_lon"), F.max("max_lat")).first()
    out = {"type": "FeatureCollection", "features": [json.loads(r["value"]) for r in rows]}
    return json.dumps(out | {"bbox": list(b)} if b[0] is not None else out)


def _wkb(ring) -> bytes:
    points = [(float(x), float(y)) for x, y in ring]
    return struct.pack(f"<BIII{2 * len(points)}d", 1, 3, 1, len(points), *(v for p in points for v in p))


def wkb(rings: Column, w: Column, s: Column, e: Column, n: Column) -> Column:
    """A row's closed rings, or else its box, as a WKB polygon or multipolygon, in vectorised Python (no built-in packs doubles)."""
    @F.pandas_udf("binary")
    def pack(r: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for own, x0, y0, x1, y1 in zip(r, a, b, c, d, strict=True):
            if own is not None and len(own):
                parts = [_wkb(ring) for ring in own]
                out.append(parts[0] if len(parts) == 1 else struct.pack("<BII", 1, 6, len(parts)) + b"".join(parts))
            else:
                out.append(None if pd.isna(x0) or pd.isna(y0) or pd.isna(x1) or pd.isna(y1) else _wkb(((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))))
        return pd.Series(out, dtype=object)

    return pack(rings, w, s, e, n)


def write_geoparquet(acq: DataFrame, path: str) -> None:
    """Rows with geometry, as WKB; none left is an error."""
    own = closed_rings(F.col("rings")) if "rings" in acq.columns else F.lit(None).cast("array<array<array<double>>>")
    out = acq.where("min_lon is not null").withColumn("geometry", wkb(own, *[F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]))
    if out.limit(1).count() == 0:
        raise PlanError("no row has a geometry")
    out.write.mode("overwrite").parquet(path)


def promoted(df: DataFrame, scalar: str, array: str, name: str) -> DataFrame:
    """One list column of a property that came as a scalar in some rows and as a list in others."""
    return df.withColumn(name, F.coalesce(F.col(array), F.when(F.col(scalar).isNotNull(), F.array(scalar)))).drop(*{scalar, array} - {name})


def write_manifest(chips: DataFrame, path: str, skipped: DataFrame | None = None) -> None:
    """By the path's suffix: JSON lines, GeoJSON lines or Parquet; skipped rows beside it, if there are any."""
    kind = path.rsplit(".", 1)[-1]
    if kind == "jsonl":
        chips.write.mode("overwrite").json(path)
    elif kind == "geojson":
        write_geojson_lines(chips, path, [c for c in chips.columns if c not in ("id", "min_lon", "min_lat", "max_lon", "max_lat")])
    elif kind == "parquet":
        chips.write.mode("overwrite").parquet(path)
    else:
        raise PlanError(f"unknown manifest suffix {kind!r}")
    if skipped is not None and skipped.limit(1).count():
        skipped.write.mode("overwrite").json(path.rsplit(".", 1)[0] + ".skipped.jsonl")


def write_cube(cells: DataFrame, path: str) -> None:
    cells.repartitionByRange("pass_idx", "row", "col").sortWithinPartitions("pass_idx", "row", "col").write.mode("overwrite").partitionBy("pass_idx").parquet(path)


def write_chips(chips: DataFrame, path: str, by: str) -> None:
    chips.write.mode("overwrite").partitionBy(by).parquet(path)
