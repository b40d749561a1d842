"""How sources were made: grouping, agreement, tags, and roll-ups of chip records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ProvenanceMismatch
from .quantiles import quantiles

# Margin that warns, gain that is low.
MARGIN_WARN_DB, GAIN_WARN = 6.0, 1.5


def groups(sources: DataFrame, keys: list[str]) -> DataFrame:
    """sources(item_id, ts, keys...) by their key values; absent ones are "none" if any key is set, else "(unrecorded)"."""
    any_set = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()
    filled = sources.withColumns({k: F.coalesce(F.col(k).cast("string"), F.when(any_set, "none").otherwise("(unrecorded)")) for k in keys})
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts", "item_id"))), lambda x: x["item_id"])
    return filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), ids.alias("item_ids")).orderBy(F.desc("n"), "first_seen", *keys)


def conflicts(sources: DataFrame, keys: list[str]) -> DataFrame:
    """key and its values, for each key that has more than one."""
    long = sources.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string"), F.lit("none")).alias("value")) for k in keys])).alias("x")).select("x.*")
    return long.distinct().groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("values")).where("size(values) > 1")


def shared(sources: DataFrame, keys: list[str]) -> dict[str, str]:
    """The value of each key that all sources share; raises on the first key that has several.  At most a row a key comes back."""
    row = sources.agg(*[F.struct(F.min(F.coalesce(F.col(k).cast("string"), F.lit("none"))).alias("a"), F.max(F.coalesce(F.col(k).cast("string"), F.lit("none"))).alias("b")).alias(k) for k in keys]).first()
    for k in keys:
        if row[k]["a"] != row[k]["b"]:
            raise ProvenanceMismatch(f"sources disagree on {k}: {row[k]['a']!r} and {row[k]['b']!r}")
    return {k: row[k]["a"] for k in keys}


def tags(values: dict[str, Column], prefix: str = "SAR_") -> Column:
    """A map of tags: names upper-cased after the prefix, absent values "none"."""
    pairs = [x for k, v in values.items() for x in (F.lit(prefix + k.upper()), F.coalesce(v.cast("string"), F.lit("none")))]
    return F.create_map(*pairs)


def untag(tagged: Column, prefix: str = "SAR_") -> Column:
    own = F.map_filter(tagged, lambda k, _: k.startswith(prefix))
    return F.transform_keys(own, lambda k, _: F.lower(F.substring(k, F.lit(len(prefix) + 1), F.length(k))))


def noise_summary(chips: DataFrame) -> DataFrame:
    """chips(item_id, seq, noise_model, margin_db, floored): of the first record of each item, counts, models and extremes."""
    first = chips.groupBy("item_id").agg(F.min_by(F.struct("noise_model", "margin_db", "floored"), "seq").alias("r")).select("r.*")
    return first.agg(F.count(F.lit(1)).alias("items"), F.array_sort(F.collect_set("noise_model")).alias("models"), F.count_if(F.col("margin_db") < MARGIN_WARN_DB).alias("low_margin"), F.min("margin_db").alias("min_margin_db"), F.max("floored").alias("max_floored"))


def speckle_summary(chips: DataFrame) -> DataFrame:
    """chips(item_id, seq, before, after): gains of the first record of each item; the median is the upper one."""
    first = chips.groupBy("item_id").agg(F.min_by(F.struct("before", "after"), "seq").alias("r"))
    gain = F.when((F.col("r.before") != 0) & (F.col("r.after") != 0), F.col("r.after") / F.col("r.before"))
    got = first.select(gain.alias("g"))
    counts = [F.count(F.lit(1)).alias("items"), F.count_if(F.col("g") < GAIN_WARN).alias("low_gain"), F.min("g").alias("min_gain")]
    return quantiles(got, [], F.col("g"), [0.5], counts, higher=True).select("items", "low_gain", F.col("q")[0].alias("median_gain"), "min_gain")


def clip_summary(chips: DataFrame) -> DataFrame:
    """chips(window_pixels, scene_pixels): sums, the ratio of the sums, and the extremes of the ratios."""
    r = F.col("window_pixels") / F.nullif(F.col("scene_pixels"), F.lit(0))
    return chips.agg(F.sum("window_pixels").alias("window_pixels"), F.sum("scene_pixels").alias("scene_pixels"), (F.sum("window_pixels") / F.nullif(F.sum("scene_pixels"), F.lit(0))).alias("ratio"), F.min(r).alias("min_ratio"), F.max(r).alias("max_ratio"))


def chip_rollup(chips: DataFrame) -> DataFrame:
    return chips.agg(F.count(F.lit(1)).alias("chips"), F.array_sort(F.collect_set("item_id")).alias("items"))
