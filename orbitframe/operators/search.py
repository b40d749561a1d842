"""Catalog search: filter, cap, order, page, and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.predicates import select
from ..plans.spec import SearchSpec


def catalog_order() -> list[Column]:
    """Sites first, then undated rows before dated ones."""
    return [F.col("task").isNull(), F.col("task").asc_nulls_first(), F.col("acq_date").asc_nulls_first(), F.col("href").asc()]


def capped(df: DataFrame, per_task: int | None) -> DataFrame:
    """The first rows of each site in catalog order; a row_number filter, which Spark cuts off in each partition already."""
    if per_task is None:
        return df
    w = Window.partitionBy("task").orderBy(F.col("acq_date").asc_nulls_first(), "href")
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_task).drop("_n")


def search(acq: DataFrame, spec: SearchSpec, validated: bool = False) -> DataFrame:
    spec = spec if validated else spec.validated()
    out = capped(select(acq, spec), spec.max_per_task).orderBy(*catalog_order())
    return out.limit(spec.limit) if spec.limit is not None else out


def page(acq: DataFrame, spec: SearchSpec, offset: int = 0, limit: int = 10) -> DataFrame:
    """One page, with has_next on its rows: one row more than the page is looked at.  The size is 1 ... 10,000."""
    size = max(1, min(int(limit), 10_000))
    rows = search(acq, spec).offset(max(0, offset)).limit(size + 1)
    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(*catalog_order())))  # size + 1 rows at most
    more = F.max("_n").over(Window.partitionBy()) > size
    return numbered.withColumn("has_next", more).where(F.col("_n") <= size).drop("_n")


def get(acq: DataFrame, item_id: str) -> DataFrame:
    """The acquisition with an id; of several, the first by href."""
    return acq.where(F.col("id") == item_id).orderBy("href").limit(1)


def in_request_order(acq: DataFrame, ids: list[str]) -> DataFrame:
    """Acquisitions in the order of a list of ids, first by href for each."""
    spark = acq.sparkSession
    wanted = spark.createDataFrame([(i, x) for i, x in enumerate(dict.fromkeys(ids))], "at int, id string")
    best = acq.join(F.broadcast(wanted), "id")  # the caller's own list
    w = Window.partitionBy("id").orderBy("href")
    return best.withColumn("_n", F.row_number().over(w)).where("_n = 1").orderBy("at").drop("_n", "at")


def stats(acq: DataFrame) -> DataFrame:
    thumb = F.count("thumbnail") if "thumbnail" in acq.columns else F.lit(0).cast("long")
    return acq.agg(
        F.count(F.lit(1)).alias("items"), F.min("acq_date").alias("first_date"), F.max("acq_date").alias("last_date"), F.count_distinct("task").alias("tasks"), F.count("place").alias("placed"), thumb.alias("thumbnails")
    )


def facets(acq: DataFrame) -> DataFrame:
    """Distinct products (sorted), polarizations (fixed order, then the rest) and the date range."""
    order = F.array(*[F.lit(p) for p in ("VV", "VH", "HH", "HV")])
    pols = F.array_sort(F.collect_set("pol"))
    ranked = F.concat(F.filter(order, lambda p: F.array_contains(pols, p)), F.array_except(pols, order))
    days = acq.agg(F.min("acq_date").alias("first_date"), F.max("acq_date").alias("last_date"))
    p = acq.select(F.explode("products").alias("product")).distinct().agg(F.array_sort(F.collect_set("product")).alias("products"))
    q = acq.select(F.explode("polarizations").alias("pol")).distinct().agg(ranked.alias("polarizations"))
    return days.crossJoin(p).crossJoin(q)  # one row each


def site_names(acq: DataFrame) -> DataFrame:
    return acq.select("task").where("task is not null and task != ''").distinct().orderBy("task")


def site_grid(acq: DataFrame, step: float = 0.1) -> DataFrame:
    """Acquisitions of one site whose centres fall in one cell: count, mean centre and hrefs; halves round to even."""
    lat, lon = (F.col("min_lat") + F.col("max_lat")) / 2, (F.col("min_lon") + F.col("max_lon")) / 2
    rows = acq.where(lat.isNotNull() & lon.isNotNull()).select("task", "href", lat.alias("lat"), lon.alias("lon"))
    keyed = rows.withColumn("cell_lat", F.bround(F.col("lat") / step).cast("long")).withColumn("cell_lon", F.bround(F.col("lon") / step).cast("long"))
    return keyed.groupBy("task", "cell_lat", "cell_lon").agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.array_sort(F.collect_list("href")).alias("hrefs"))


def evenly_spaced(df: DataFrame, n: int, partition: list[str], order: list[Column]) -> DataFrame:
    """Of each group in order, the rows at round(i * (N - 1) / (n - 1)), halves to even, each once."""
    w = Window.partitionBy(*partition)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    if n <= 1:
        return rows.where("_i = 0").drop("_i", "_n")
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(n - 1)).cast("int"))
    return rows.where((F.col("_n") <= n) | F.array_contains(at, F.col("_i"))).drop("_i", "_n")
