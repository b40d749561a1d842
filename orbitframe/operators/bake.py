"""Injected renderers and geocoders over rows that lack their result, and progress of long jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def bake(rows: DataFrame, make: Callable, columns: list[str], out: str, kind: str, key: str = "href", skip_errors: bool = True) -> DataFrame:
    """key, out and error: make(*columns) of each row, on the executors.  Without skip_errors the first error fails the job."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made, errors = [], []
            for values in pdf[columns].itertuples(index=False, name=None):
                try:
                    made.append(make(*values))
                    errors.append(None)
                except Exception as e:
                    if not skip_errors:
                        raise
                    made.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: pdf[key], out: made, "error": errors})

    key_kind = dict(rows.dtypes)[key]
    return rows.select(*dict.fromkeys([key, *columns])).mapInPandas(run, f"{key} {key_kind}, {out} {kind}, error string")


def bake_places(acq: DataFrame, geocode: Callable[[float, float], str | None], step: float = 0.1) -> DataFrame:
    """acq with places for rows that have none: the geocoder is asked once for each cell of sites, not once a row."""
    lat, lon = (F.col("min_lat") + F.col("max_lat")) / 2, (F.col("min_lon") + F.col("max_lon")) / 2
    keyed = acq.withColumn("_a", F.bround(lat / step)).withColumn("_o", F.bround(lon / step))
    todo = keyed.where("place is null and _a is not null").groupBy("task", "_a", "_o").agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), F.min("href").alias("href"))
    got = bake(todo, geocode, ["lat", "lon"], "_p", "string").select("href", "_p")
    found = todo.join(got, "href").select(F.col("task").alias("_t"), F.col("_a").alias("_fa"), F.col("_o").alias("_fo"), "_p")
    out = keyed.join(found, F.col("task").eqNullSafe(F.col("_t")) & (F.col("_a") == F.col("_fa")) & (F.col("_o") == F.col("_fo")), "left")
    return out.select(*[F.coalesce("place", "_p").alias(c) if c == "place" else F.col(c) for c in acq.columns])


def observed(df: DataFrame, **counts) -> tuple[DataFrame, Observation]:
    """df with running figures: rows, and the given aggregates; read them from the observation once the job is through."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counts.items()]), seen
