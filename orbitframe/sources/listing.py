"""Object listings and sidecar documents as DataFrames.

A listing is a table of keys.  Spark's binaryFile source makes one from any file system it knows; a remote
store's paged LIST is parsed here and can be fed by any client.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CatalogError

SIDECAR = ".stac.v2.json"


def parse_listing(content: bytes) -> tuple[list[str], list[str], str | None]:
    """(sub-prefixes, keys, continuation token) of a ListObjectsV2 reply.  Document types and entities are refused."""
    if re.search(rb"<!\s*(DOCTYPE|ENTITY)", content, re.IGNORECASE):
        raise CatalogError("the listing declares a document type")
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        raise CatalogError("the listing isn't XML") from e
    local = lambda e: e.tag.rpartition("}")[2]
    every = {name: [e for e in root.iter() if local(e) == name] for name in ("CommonPrefixes", "Contents", "IsTruncated", "NextContinuationToken")}
    text = lambda e, name: next((c.text or "" for c in e if local(c) == name), "")
    more = bool(every["IsTruncated"]) and (every["IsTruncated"][0].text or "").strip().lower() == "true"
    token = every["NextContinuationToken"][0].text if more and every["NextContinuationToken"] else None
    return [text(e, "Prefix") for e in every["CommonPrefixes"]], [text(e, "Key") for e in every["Contents"]], token


def list_all(fetch: Callable[[str, str | None], bytes], prefix: str) -> Iterator[str]:
    """All keys under a prefix; fetch(prefix, token) returns a page.  It ends when a page isn't truncated or has no token."""
    token = None
    while True:
        _, keys, token = parse_listing(fetch(prefix, token))
        yield from keys
        if not token:
            return


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """key and size of the files under a path, by metadata alone: no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"))


def acquisition_dirs(keys: DataFrame, start=None, end=None) -> DataFrame:
    """task, acq_dir, acq_date, sidecar and files of keys(key), for directories that begin with a date.

    Dates are tested before anything of a directory is read.  Rows are grouped by directory: as many files as one acquisition has.
    """
    rows = keys.select("key", F.regexp_extract("key", r"sar-data/tasks/([^/]+)/", 1).alias("task"), F.regexp_extract("key", r"^(.*/)?(\d{4}-\d{2}-\d{2}-[^/]*)/[^/]*$", 2).alias("acq_dir"))
    rows = rows.where("acq_dir != ''").withColumn("acq_date", F.try_to_date(F.substring("acq_dir", 1, 10)))
    if start is not None:
        rows = rows.where(F.col("acq_date") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("acq_date") <= F.lit(end))
    side = F.col("key").endswith(SIDECAR)
    return rows.groupBy("task", "acq_dir", "acq_date").agg(F.min(F.when(side, F.col("key"))).alias("sidecar"), F.array_sort(F.collect_list(F.when(~side, F.col("key")))).alias("files"))


def fetch_sidecars(dirs: DataFrame, fetch: Callable[[str], str | None], partitions: int | None = None) -> DataFrame:
    """dirs with the sidecar's document as doc; a failed fetch gives null.  `partitions` bounds how many fetch at once."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(doc=[fetch(k) for k in pdf["sidecar"]])

    todo = dirs.where("sidecar is not null")
    todo = todo.repartition(partitions) if partitions else todo
    return todo.mapInPandas(run, "task string, acq_dir string, acq_date date, sidecar string, files array<string>, doc string")


def assemble(fetched: DataFrame) -> DataFrame:
    """task, acq_date, href, doc and assets (file name -> key) of fetched sidecars; those without files go."""
    named = F.transform("files", lambda k: F.struct(F.regexp_extract(k, "([^/]+)$", 1).alias("key"), k.alias("value")))
    return fetched.where("doc is not null and size(files) > 0").select("task", "acq_date", F.col("sidecar").alias("href"), "doc", F.map_from_entries(named).alias("assets"))
