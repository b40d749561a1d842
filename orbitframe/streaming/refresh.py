"""Keeping a catalog current: incremental refresh and read-through search."""

from __future__ import annotations

import time
import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError
from ..operators.catalog import read_through, upsert
from ..operators.search import search
from ..plans.spec import SearchSpec


def horizon(stored: DataFrame, overlap_days: int = 7, since: date | None = None) -> date | None:
    """The first day to look at again: the newest stored date less an overlap for late publication; None for an empty catalog."""
    if overlap_days < 0:
        raise PlanError("the overlap can't be negative")
    if since is not None:
        return since
    newest = stored.agg(F.max("acq_date").alias("d")).first()["d"]
    return None if newest is None else newest - timedelta(days=overlap_days)


def refresh(stored: DataFrame, live: DataFrame, overlap_days: int = 7, since: date | None = None) -> tuple[DataFrame, dict]:
    """(the new catalog, tallies): rows of live from the horizon on are upserted; undated ones always."""
    start = horizon(stored, overlap_days, since)
    delta = live if start is None else live.where(F.col("acq_date").isNull() | (F.col("acq_date") >= F.lit(start)))
    delta = delta.where("href is not null")
    known = stored.select("href", F.lit(1).alias("_known")).distinct()
    t = delta.select("href").distinct().join(known, "href", "left").agg(F.count(F.lit(1)).alias("n"), F.count("_known").alias("k")).first()
    return upsert(stored, delta.select(*stored.columns)), {"scanned": delta.count(), "added": t["n"] - t["k"], "refreshed": t["k"], "start": start}


def search_live(stored: DataFrame, live: DataFrame, spec: SearchSpec, overlap_days: int = 7) -> DataFrame:
    """A search over the catalog and what is newer than its horizon; the stored copy of a href wins, and caps come after."""
    start = horizon(stored, overlap_days)
    recent = live if start is None else live.where(F.col("acq_date").isNull() | (F.col("acq_date") >= F.lit(start)))
    return search(read_through(stored, recent), spec)


def refresh_stream(stream: DataFrame, target: str, checkpoint: str, columns: list[str]):
    """Appends each micro-batch to a log under target, which `current` reads as a catalog and `compact` folds.

    A batch costs its own rows, whatever the catalog's size.  Its folder is named by the query and the epoch that the
    checkpoint holds: a replay overwrites its own rows only, and a query with a new checkpoint adds to the log.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.select(*columns, F.lit(time.time_ns()).alias("logged_at")).write.mode("overwrite").parquet(f"{target}/log-{query}-{epoch}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _logs(spark: SparkSession, target: str) -> list[str]:
    """The folders of the log that were written to their end."""
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(p.toString() for p in paths if p.getName().startswith("log-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _folded(log: DataFrame) -> DataFrame:
    return upsert(log.where("false"), log.withColumn("seq", F.col("logged_at")))


def current(spark: SparkSession, target: str) -> DataFrame:
    """The catalog that the log makes: the last row of each href, with kept columns from the last row that has them."""
    if not (logs := _logs(spark, target)):
        raise PlanError(f"no catalog at {target}")
    return _folded(spark.read.parquet(*logs)).drop("logged_at")


def compact(spark: SparkSession, target: str) -> None:
    """Folds the log into one folder.  What was folded goes only when that is written, and folding rows twice changes nothing, so it may stop anywhere."""
    logs = _logs(spark, target)
    if len(logs) < 2:
        return
    _folded(spark.read.parquet(*logs)).write.parquet(f"{target}/log-{uuid.uuid4().hex}")
    for path in logs:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def late_tolerant(stream: DataFrame, column: str = "ts", days: int = 7) -> DataFrame:
    """Rows that come later than so many days after the newest are dropped by stateful operators downstream."""
    return stream.withWatermark(column, f"{days} days")
