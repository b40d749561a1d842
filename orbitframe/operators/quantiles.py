"""Exact quantiles of large groups without holding a group's values anywhere.

The built-in exact percentile keeps a counter for each distinct value of a group in one buffer; over continuous pixels that
is the whole scene.  Here a mergeable sketch brackets each quantile first, and only values within the brackets, a
fixed share of the group, are counted one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's ranks are off by a group's size over this at most.
ACCURACY = 10_000
#: Half the width of a bracket, in such errors.
SLACK = 3


def quantiles(rows: DataFrame, by: Sequence[str], value: Column, qs: Sequence[float], extra: Sequence[Column] = (), accuracy: int = ACCURACY, higher: bool = False) -> DataFrame:
    """by, the aggregates `extra`, and q: an array of the quantiles of value, linear between neighbours or, if `higher`, the upper neighbour.

    Nulls don't count; a group of nulls only keeps its row, with null quantiles, and NaN is the largest value.  Without
    `by` there is one row, even for no rows.  Groups of at most `accuracy` values are counted whole.  rows is read twice: for the sketch with `extra`, and for the counts.
    """
    by, v, n = list(by), F.col("_v"), F.col("_n")
    ends = [min(1.0, max(0.0, q + side * SLACK / accuracy)) for q in qs for side in (-1, 1)]
    x = value.cast("double")
    sketch = rows.groupBy(*by).agg(*extra, F.count(x).alias("_n"), F.min(x).alias("_min"), F.max(x).alias("_max"), F.percentile_approx(x, ends, accuracy).alias("_ends"))
    more = [c for c in sketch.columns if c not in {*by, "_n", "_min", "_max", "_ends"}]
    whole = n <= accuracy
    bounds = [F.when(whole, F.col("_max" if e % 2 else "_min")).otherwise(F.col("_ends")[e]).alias(f"_b{e}") for e in range(len(ends))]
    group = sketch.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.struct("_n", *more).alias("_group"), *bounds)
    values = rows.select(*by, x.alias("_v"))
    if by:
        at = values.join(group, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]))
    else:
        values = values.union(rows.sparkSession.range(1).select(F.lit(None).cast("double")))  # so that no rows give one
        at = values.join(F.broadcast(group))  # one row

    # Of each quantile: all values below its bracket are one entry (null), those within are entries of their own, those above go.
    def spot(k: int) -> Column:
        here = F.struct(F.lit(k).alias("i"), F.when(v >= F.col(f"_b{2 * k}"), v).alias("x"))
        return F.when(v.isNull() | (v <= F.col(f"_b{2 * k + 1}")) if k == 0 else v <= F.col(f"_b{2 * k + 1}"), here)

    spots = at.select(*by, "_group", "_v", F.explode(F.array(*[spot(k) for k in range(len(qs))])).alias("_s")).where("_s is not null")
    counts = spots.groupBy(*by, "_group", F.col("_s.i").alias("_i"), F.col("_s.x").alias("_x")).agg(F.count("_v").alias("_c"))
    ranked = counts.withColumn("_to", F.sum("_c").over(Window.partitionBy(*by, "_i").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))

    size = F.col("_group._n")
    place = lambda q: F.lit(float(q)) * (size - 1)
    found = lambda k, rank: F.max(F.when((F.col("_i") == k) & (F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_to")), F.col("_x")))
    picked = ranked.groupBy(*by, "_group").agg(*[found(k, side(place(q))).alias(f"_{name}{k}") for k, q in enumerate(qs) for name, side in (("lo", F.floor), ("hi", F.ceil))])

    def between(k: int, q: float) -> Column:
        lo, hi, h = F.col(f"_lo{k}"), F.col(f"_hi{k}"), place(q)
        missed = (size > 0) & (lo.isNull() | hi.isNull())
        return F.when(missed, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).when(lo == hi, lo).otherwise(hi if higher else (F.ceil(h) - h) * lo + (h - F.floor(h)) * hi)

    return picked.select(*by, *[F.col(f"_group.{c}").alias(c) for c in more], F.array(*[between(k, q) for k, q in enumerate(qs)]).alias("q"))
