"""Daily budgets, counted in tumbling UTC days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def granted(requests: DataFrame, daily: int, per_client: int) -> DataFrame:
    """requests(ts, client, seq) with day and granted: the first of a client's day, and of those the first of the day.

    The client's quota is cut first; each client's day holds at most its quota of rows when the day's are ranked.
    """
    rows = requests.withColumn("day", F.to_date("ts"))
    own = Window.partitionBy("day", "client").orderBy("ts", "seq")
    ranked = rows.withColumn("_own", F.row_number().over(own))
    within = ranked.where(F.col("_own") <= per_client)
    day = Window.partitionBy("day").orderBy("ts", "seq")
    won = within.select("day", "client", "seq", F.row_number().over(day).alias("_day")).where(F.col("_day") <= daily).select("day", "client", "seq", F.lit(True).alias("granted"))
    return rows.join(won, ["day", "client", "seq"], "left").fillna({"granted": False})


def daily_counts(requests: DataFrame) -> DataFrame:
    """Counts by day and client over tumbling windows; works on streams with a watermark, too."""
    return requests.groupBy(F.window("ts", "1 day").alias("w"), "client").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "client", "n")
