"""Frames of a series: ordering, labels, first and last, pass to pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PlanError


def ordered(acq: DataFrame, by: list[str]) -> DataFrame:
    """frame (0, 1 ... in time, undated last) and label (the date, else the first 12 characters of the id) of each series."""
    if not by:
        raise PlanError("name the columns of a series; the whole catalog as one would be one task")
    w = Window.partitionBy(*by).orderBy(F.col("ts").isNull(), "ts", "href")
    return acq.withColumn("frame", F.row_number().over(w) - 1).withColumn("label", F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.substring("id", 1, 12)))


def _guard(acq: DataFrame, least: int, one_polarization: bool) -> None:
    """Raises on too few dated passes or mixed polarizations; one row comes back."""
    r = acq.where("ts is not null").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.concat_ws(",", "polarizations")).alias("k")).first()
    if r["n"] < least:
        raise PlanError(f"{r['n']} dated passes; {least} are needed")
    if one_polarization and r["k"] > 1:
        raise PlanError("the passes have different polarizations", hint="Filter by polarization, or rank by comparable passes.")


def change_frames(acq: DataFrame) -> DataFrame:
    """The oldest and the newest dated pass."""
    _guard(acq, 2, True)
    dated = acq.where("ts is not null")
    ends = dated.agg(F.min_by("href", F.struct("ts", "href")).alias("a"), F.max_by("href", F.struct("ts", "href")).alias("b"))
    return dated.join(F.broadcast(ends)).where("href in (a, b)").drop("a", "b").orderBy("ts", "href")  # one row


def timescan_frames(acq: DataFrame) -> DataFrame:
    """All dated passes, three at least."""
    _guard(acq, 3, True)
    return acq.where("ts is not null").orderBy("ts", "href")


def pairs(acq: DataFrame, by: list[str]) -> DataFrame:
    """Each dated pass with the one before it in its series, as prev_href and prev_ts."""
    w = Window.partitionBy(*by).orderBy("ts", "href")
    return acq.where("ts is not null").withColumn("prev_href", F.lag("href").over(w)).withColumn("prev_ts", F.lag("ts").over(w)).where("prev_href is not null")
