"""What is new: a stateful distinct, in batch and as a stream."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import SearchSpec


def watch_key(spec: SearchSpec) -> str:
    """A name for a standing query: a digest of its parameters."""
    v = spec.validated()
    parts = {k: str(getattr(v, k)) for k in ("start", "end", "area", "fuzzy", "bbox", "products", "polarizations", "min_incidence", "max_incidence", "max_resolution", "rings")}
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:12]


class SearchSource(Protocol):
    """Whatever finds acquisitions for a spec."""

    def search(self, spec: SearchSpec) -> DataFrame: ...


class SeenKeys(Protocol):
    """Whatever remembers the keys of watches."""

    def seen(self, name: str, run: str | None = None) -> DataFrame: ...

    def remember(self, name: str, keys: DataFrame, run: str) -> None: ...


class WatchStore:
    """Seen keys by watch name, as Parquet that only grows: each run appends the keys that it saw first."""

    SCHEMA = "watch string, key string, run string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def seen(self, name: str, run: str | None = None) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], self.SCHEMA)
        out = self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("watch") == name)
        return out.where(F.col("run") == run) if run else out

    def remember(self, name: str, keys: DataFrame, run: str) -> None:
        keys.select(F.lit(name).alias("watch"), F.col("key").cast("string"), F.lit(run).alias("run")).write.mode("append").parquet(self.path)


def item_key() -> Column:
    return F.coalesce(F.nullif(F.col("href"), F.lit("")), F.col("id"))


def watch(found: DataFrame, name: str, store: SeenKeys, reset: bool = False) -> dict:
    """What a watch reports: items not seen before.  Keys are never forgotten, so one that comes back isn't new; reset reports all anew.

    The keys of a run are stored under its own number first; what is reported is read back by that number.  Of rows with
    one key the first by ts and href is reported.
    """
    order = F.struct(*[c for c in ("ts", "href", "id") if c in found.columns])
    first_row = found.withColumn("key", item_key()).where("key is not null").groupBy("key").agg(F.min_by(F.struct(*found.columns), order).alias("_row"))
    keyed = first_row.select("key", *[F.col("_row")[c].alias(c) for c in found.columns])
    seen, run = store.seen(name).select("key").distinct(), uuid.uuid4().hex
    first = seen.limit(1).count() == 0
    store.remember(name, keyed.select("key").join(seen, "key", "left_anti"), run)
    own = store.seen(name, run).select("key")
    new = keyed if reset else keyed.join(own, "key", "left_semi")
    total = store.seen(name).select("key").distinct().count()
    return {"watch": name, "checked_at": datetime.now(timezone.utc), "first_run": first, "new_count": new.count() if reset else own.count(), "total_seen": total, "new_items": new.drop("key")}


def run_watch(source: SearchSource, spec: SearchSpec, store: SeenKeys, reset: bool = False) -> dict:
    """A standing query against any source, named by its own parameters."""
    return watch(source.search(spec), watch_key(spec), store, reset)


def watch_stream(stream: DataFrame, name: str) -> DataFrame:
    """The same over a stream: state without a watermark, so that nothing is ever reported twice."""
    return stream.withColumn("watch", F.lit(name)).withColumn("key", item_key()).where("key is not null").dropDuplicates(["watch", "key"]).drop("watch", "key")


def start_watch(stream: DataFrame, name: str, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Runs over what is there now and ends; the checkpoint carries the state to the next run."""
    return watch_stream(stream, name).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
