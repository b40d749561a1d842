"""Building and keeping the acquisition table: documents to rows, upserts, merges, new work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import items

#: Columns that an upsert must not lose when the new row has none.
KEPT = ("place", "thumbnail", "thumb_asset", "thumb_size")


def from_documents(docs: DataFrame, task_property: str = "task_id") -> DataFrame:
    """Acquisitions from docs(doc, href); the href falls back to the document's self link.  Bad JSON rows go."""
    p = F.from_json("doc", items.DOC_SCHEMA)
    rows = docs.withColumn("_d", p).where("_d is not null")
    props = F.col("_d.properties")
    get = lambda name: F.try_element_at(props, F.lit(name))
    own = F.filter(F.col("_d.links"), lambda x: x["rel"] == "self")
    rows = rows.withColumn("href", F.coalesce(F.nullif(F.col("href"), F.lit("")), F.try_element_at(own, F.lit(1))["href"]))
    rows = rows.withColumn("ts", items.when(get("datetime"), get("start_datetime"))).withColumn("_m", items.asset_map(F.col("_d.assets"))).withColumn("_b", items.box(F.col("_d.bbox"), F.col("_d.geometry.coordinates")))
    number = lambda name: get(name).try_cast("double")
    return rows.select(
        "href", F.col("_d.id").alias("id"), items.task_key(F.col("href"), get(task_property)).alias("task"), "ts", items.acquisition_date(F.col("href"), F.col("ts")).alias("acq_date"),
        *[F.col(f"_b.{c}").alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")],
        items.products(F.col("_m")).alias("products"), F.from_json(get("sar:polarizations"), "array<string>").alias("polarizations"),
        number("view:incidence_angle").alias("incidence"), number("sar:resolution_range").alias("res_range"), number("sar:resolution_azimuth").alias("res_azimuth"),
        get("platform").alias("platform"), get("sar:product_type").alias("product_type"), get("sar:instrument_mode").alias("instrument_mode"),
        items.rings(F.col("_d.geometry.type"), F.col("_d.geometry.coordinates")).alias("rings"), F.lit(None).cast("string").alias("place"), F.col("_d.assets").alias("assets"),
        items.first_text(F.col("_d.description"), get("description"), F.try_element_at(F.col("_d.assets"), F.try_element_at("_m", F.lit("GEC")))["description"]).alias("description"), "doc",
    )


def upsert(old: DataFrame, new: DataFrame, kept: tuple[str, ...] = KEPT) -> DataFrame:
    """old with the rows of new by href: new rows win, but for the kept columns where they have none.  Rows without href are skipped.

    One shuffle on href with map-side combination; of several new rows for one href, the last by `seq`, if new has that column.
    """
    seq = F.col("seq") if "seq" in new.columns else F.lit(0)
    cols = [c for c in old.columns]
    rank = lambda df, first: df.where("href is not null").select(F.struct(F.lit(first).alias("a"), (seq if first else F.lit(0)).cast("long").alias("b")).alias("_k"), *cols)
    both = rank(old, 0).unionByName(rank(new, 1))
    aggs = [(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_k"))) if c in kept else F.max_by(F.struct(F.col(c)), F.col("_k"))[c]).alias(c) for c in cols if c != "href"]
    return both.groupBy("href").agg(*aggs).select(*cols)


def merge_thumbnails(acq: DataFrame, incoming: DataFrame, overwrite: bool = False) -> DataFrame:
    """acq(href, thumbnail, thumb_asset, thumb_size) with incoming(href, png, asset, size): kept unless missing, or smaller for the same asset."""
    inc = incoming.select("href", F.struct("png", "asset", "size").alias("_i"))
    out = acq.join(inc, "href", "left")
    better = F.col("thumbnail").isNull() | ((F.col("_i.size") > F.col("thumb_size")) & F.col("_i.asset").eqNullSafe(F.col("thumb_asset")))
    take = F.col("_i").isNotNull() & (F.lit(overwrite) | better)
    new = {c: F.when(take, F.col(f"_i.{f}")).otherwise(F.col(c)) for c, f in (("thumbnail", "png"), ("thumb_asset", "asset"), ("thumb_size", "size"))}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in acq.columns])


def export_thumbnails(acq: DataFrame) -> DataFrame:
    return acq.where("thumbnail is not null").select("href", "id", F.col("thumbnail").alias("png"), F.col("thumb_asset").alias("asset"), F.col("thumb_size").alias("size"))


def only_new(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Each candidate key that isn't done yet, once."""
    return candidates.dropDuplicates([key]).join(done.select(key), key, "left_anti")


def read_through(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Both, each href once; the stored copy wins."""
    both = stored.withColumn("_s", F.lit(0)).unionByName(live.select(*stored.columns).withColumn("_s", F.lit(1)))
    w = Window.partitionBy("href").orderBy("_s")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_s")


def newest_batch(acq: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows without a thumbnail, newest first, undated last."""
    out = (acq.where("thumbnail is null") if "thumbnail" in acq.columns else acq).orderBy(F.col("acq_date").desc_nulls_last(), "href")
    return out.limit(limit) if limit is not None else out


def with_product(acq: DataFrame, assets: DataFrame, wanted: list[str]) -> DataFrame:
    """acq that have any wanted asset in assets(href, asset), as a semi join."""
    return acq.join(assets.where(F.col("asset").isin(*wanted)).select("href"), "href", "left_semi")
