"""Site ranking: passes, gaps, the comparable group, gates and five orders, as one plan.

Gaps need each pass's predecessor.  Passes are windowed by site and month, and the first of a month takes the last one
of an earlier month from the small table of months, so that no task holds a whole site, however often it is imaged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import union_bbox
from ..plans.predicates import select
from ..plans.spec import SearchSpec, SiteSpec

DAY_US = 86_400e6


def with_gaps(passes: DataFrame, by: list[str]) -> DataFrame:
    """passes(by, ts, href) with gap, the fractional days since the one before in the same group."""
    rows = passes.withColumn("_month", F.trunc(F.col("ts").cast("date"), "month"))
    within = F.lag("ts").over(Window.partitionBy(*by, "_month").orderBy("ts", "href"))
    months = rows.groupBy(*by, "_month").agg(F.max("ts").alias("_last"))
    months = months.withColumn("_before", F.lag("_last").over(Window.partitionBy(*by).orderBy("_month"))).drop("_last")
    joined = rows.withColumn("_within", within)
    keys = [joined[c].eqNullSafe(months[c]) for c in (*by, "_month")]
    out = joined.join(months, keys).drop(*[months[c] for c in (*by, "_month")])
    before = F.coalesce("_within", "_before")
    gap = F.expr("timestampdiff(MICROSECOND, _prev, ts)") / F.lit(DAY_US)
    return out.withColumn("_prev", before).withColumn("gap", gap).drop("_month", "_within", "_before", "_prev")


def comparable_groups(acq: DataFrame) -> DataFrame:
    """task and polarizations of each site's largest group of dated passes with one exact list; of equals, the first list."""
    counts = acq.where("ts is not null").groupBy("task", "polarizations").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("task").agg(F.min_by("polarizations", F.struct(-F.col("n"), "polarizations")).alias("comparable_polarizations"))


def figures(passes: DataFrame, by: list[str], prefix: str = "") -> DataFrame:
    """Passes, first and last day, whole elapsed days, and gap statistics of dated passes."""
    whole = F.when(F.count(F.lit(1)) >= 2, F.expr("timestampdiff(DAY, min(ts), max(ts))"))
    return with_gaps(passes, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias(f"{prefix}dated"),
        F.min("ts").alias(f"{prefix}first_ts"),
        F.max("ts").alias(f"{prefix}last_ts"),
        whole.cast("long").alias(f"{prefix}span_days"),
        F.min("gap").alias(f"{prefix}min_revisit_days"),
        F.median("gap").alias(f"{prefix}median_revisit_days"),
        F.max("gap").alias(f"{prefix}max_revisit_days"),
    )


def coverage(acq: DataFrame, lists: bool = True) -> DataFrame:
    """A row for each site; undated acquisitions count as passes but have no part in dates and gaps.

    The label is the first place in time order that isn't empty, else the site's name.  `lists` adds products, polarizations, hrefs.
    """
    named = acq.where("task is not null")
    dated = named.where("ts is not null")
    best = comparable_groups(named)
    same = dated.join(best, (dated["task"] == best["task"]) & dated["polarizations"].eqNullSafe(best["comparable_polarizations"]), "left_semi")
    when = F.struct(F.col("ts").isNull().alias("a"), F.col("ts").alias("b"), F.col("href").alias("c"))
    place = F.min_by(F.when(F.trim("place") != "", F.col("place")), F.when(F.trim("place") != "", when))
    box = union_bbox(*(F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")))
    listed = F.collect_list(F.struct(when.alias("k"), F.col("polarizations").alias("p")))
    # One list of a site's passes, in one aggregate, gives both its hrefs and the comparable ones.
    more = [F.flatten(F.collect_set("products")).alias("_products"), F.flatten(F.collect_set("polarizations")).alias("_polarizations"), listed.alias("_passes")] if lists else []
    base = named.groupBy("task").agg(F.count(F.lit(1)).alias("passes"), place.alias("place"), box.alias("bbox"), *more)
    all_of, own = figures(dated.select("task", "ts", "href"), ["task"]), figures(same.select("task", "ts", "href"), ["task"], "comparable_")
    out = base.join(all_of, "task", "left").join(own, "task", "left").join(best, "task", "left")
    if lists:
        some = lambda a: F.when(F.size(a) > 0, a)
        values = lambda a: some(F.array_sort(F.array_distinct(F.array_compact(a))))
        hrefs = lambda a: some(F.transform(a, lambda x: x["k"]["c"]))
        out = out.withColumn("_passes", F.array_sort("_passes")).withColumns({"products": values("_products"), "polarizations": values("_polarizations"), "hrefs": hrefs("_passes")})
        out = out.withColumn("comparable_hrefs", hrefs(F.filter("_passes", lambda x: ~x["k"]["a"] & x["p"].eqNullSafe(F.col("comparable_polarizations")))))
    return out.select(
        "task",
        F.coalesce("place", "task").alias("label"),
        "passes",
        F.coalesce("comparable_dated", F.lit(0)).cast("long").alias("comparable_passes"),
        F.to_date("first_ts").alias("first"),
        F.to_date("last_ts").alias("last"),
        "span_days",
        "comparable_span_days",
        *[f"{p}{k}_revisit_days" for p in ("", "comparable_") for k in ("min", "median", "max")],
        "bbox",
        "comparable_polarizations",
        *(["products", "polarizations", "hrefs", "comparable_hrefs"] if lists else []),
    )


def gates(spec: SiteSpec) -> list[Column]:
    own = "comparable_" if spec.rank_by == "comparable" else ""
    out = [F.col("comparable_passes" if own else "passes") >= spec.min_passes]
    for value, test in (
        (spec.active_since, lambda v: F.col("last") >= F.lit(v)),
        (spec.active_before, lambda v: F.col("last") <= F.lit(v)),
        (spec.first_since, lambda v: F.col("first") >= F.lit(v)),
        (spec.first_before, lambda v: F.col("first") <= F.lit(v)),
        (spec.max_revisit_days, lambda v: F.col(f"{own}max_revisit_days") <= v),
        (spec.median_revisit_days, lambda v: F.col(f"{own}median_revisit_days") <= v),
        (spec.min_span_days, lambda v: F.col(f"{own}span_days") >= v),
        (spec.max_span_days, lambda v: F.col(f"{own}span_days") <= v),
    ):
        if value is not None:
            out.append(test(value))
    return out


def rank_keys(rank_by: str) -> list[Column]:
    passes, task = F.desc("passes"), F.asc("task")
    first = {
        "passes": [],
        "comparable": [F.desc("comparable_passes")],
        "recency": [F.col("last").desc_nulls_last()],
        "span": [F.coalesce("span_days", F.lit(-1)).desc()],
        "cadence": [F.coalesce("median_revisit_days", F.lit(float("inf"))).asc()],
    }
    return [*first[rank_by], passes, task]


def rank_sites(acq: DataFrame, search: SearchSpec | None = None, spec: SiteSpec | None = None, lists: bool = False) -> DataFrame:
    """Sites that pass the gates, in order; undated acquisitions don't count as passes.  top <= 0 gives none, None all."""
    spec = (spec or SiteSpec()).validated()
    pool = acq.where("ts is not null and task is not null")
    if search is not None:
        pool = select(pool, search.validated())
    out = coverage(pool, lists)
    for gate in gates(spec):
        out = out.where(gate)
    out = out.orderBy(*rank_keys(spec.rank_by))
    return out if spec.top is None else out.limit(max(0, spec.top))
