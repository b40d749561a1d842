"""The test tables as the engine's tables: deterministic arithmetic that both engines share.

acquisitions come from events, cube cells from lineitem; see the columns below.  Each fourth acquisition has a
footprint: the lower left half of its box.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k, u = F.col("event_id"), F.col("user_id")
    lon, lat = (u * 37 + k % 5) % 360 - 180, u * 17 % 170 - 85
    products = (
        F.when(k % 5 == 0, F.array(F.lit("GEC")))
        .when(k % 5 == 1, F.array(F.lit("GEC"), F.lit("CSI")))
        .when(k % 5 == 2, F.array(F.lit("GEC"), F.lit("SICD")))
        .when(k % 5 == 3, F.array(F.lit("SIDD")))
        .otherwise(F.array(F.lit("GEC"), F.lit("CSI"), F.lit("SICD"), F.lit("CPHD")))
    )
    return e.select(
        F.concat(F.lit("e/"), k.cast("string")).alias("href"),
        F.concat(F.lit("id"), k.cast("string")).alias("id"),
        u.cast("string").alias("task"),
        "ts",
        F.to_date("ts").alias("acq_date"),
        lon.cast("double").alias("min_lon"),
        lat.cast("double").alias("min_lat"),
        (lon + 2).cast("double").alias("max_lon"),
        (lat + 2).cast("double").alias("max_lat"),
        products.alias("products"),
        F.array("event_type").alias("polarizations"),
        F.get_json_object("props", "$.k").cast("double").alias("incidence"),
        (0.25 * (1 + k % 4)).cast("double").alias("res_range"),
        (0.25 * (1 + k % 3)).cast("double").alias("res_azimuth"),
        F.when(k % 7 != 0, F.concat(F.lit("place "), (u % 20).cast("string"))).alias("place"),
        F.when(k % 4 == 1, F.array(F.array(*[F.struct((lon + x).cast("double").alias("lon"), (lat + y).cast("double").alias("lat")) for x, y in ((0, 0), (2, 0), (0, 2))]))).alias("rings"),
        "value",
        "event_id",
    )


#: The same in DuckDB, to stand after WITH.
ACQ = """acq AS (
  SELECT 'e/' || event_id AS href, 'id' || event_id AS id, user_id::VARCHAR AS task, ts, ts::DATE AS acq_date,
    ((user_id * 37 + event_id % 5) % 360 - 180)::DOUBLE AS min_lon, (user_id * 17 % 170 - 85)::DOUBLE AS min_lat,
    ((user_id * 37 + event_id % 5) % 360 - 178)::DOUBLE AS max_lon, (user_id * 17 % 170 - 83)::DOUBLE AS max_lat,
    CASE event_id % 5 WHEN 0 THEN ['GEC'] WHEN 1 THEN ['GEC', 'CSI'] WHEN 2 THEN ['GEC', 'SICD'] WHEN 3 THEN ['SIDD'] ELSE ['GEC', 'CSI', 'SICD', 'CPHD'] END AS products,
    [event_type] AS polarizations, regexp_extract(props, '"k": *([0-9]+)', 1)::DOUBLE AS incidence,
    0.25::DOUBLE * (1 + event_id % 4) AS res_range, 0.25::DOUBLE * (1 + event_id % 3) AS res_azimuth,
    CASE WHEN event_id % 7 != 0 THEN 'place ' || (user_id % 20) END AS place, value, event_id
  FROM events
)"""


def cells(spark: SparkSession, sf_dir: str, nodata: bool = False) -> DataFrame:
    """pass_idx, row, col, value: mean price by year of shipping, supplier mod 32 and part mod 32."""
    li = read(spark, sf_dir, "lineitem")
    out = li.groupBy((F.year("l_shipdate") - 1995).alias("pass_idx"), (F.col("l_suppkey") % 32).cast("int").alias("row"), (F.col("l_partkey") % 32).cast("int").alias("col")).agg(F.avg("l_extendedprice").alias("value"))
    if nodata:
        out = out.withColumn("value", F.when((F.col("row") + F.col("col")) % 17 == 0, F.lit(0.0)).otherwise(F.col("value")))
    return out


def cells_sql(nodata: bool = False) -> str:
    value = "CASE WHEN (l_suppkey % 32 + l_partkey % 32) % 17 = 0 THEN 0 ELSE avg(l_extendedprice) END" if nodata else "avg(l_extendedprice)"
    return f"cells AS (SELECT (year(l_shipdate) - 1995)::INT AS pass_idx, (l_suppkey % 32)::INT AS row, (l_partkey % 32)::INT AS col, {value} AS value FROM lineitem GROUP BY year(l_shipdate), l_suppkey % 32, l_partkey % 32)"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or in a local session without one a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="scratch-")
    return f"{base}/{name}-{uuid.uuid4().hex}"
