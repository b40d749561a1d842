"""Statistics of co-registered cubes in long form: cells(pass_idx, row, col, value).

Partial aggregates carry all sums.  A pass's predecessor comes from a lag over each cell, whose group is as long as
the series has passes; nothing is windowed over a scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.radiometry import db, valid
from .quantiles import quantiles

# Change threshold, excess over the floor that stands clear, bin of the quantile sketch.
THRESHOLD_DB, CLEAR, BIN_DB = 3.0, 1.25, 0.05


def masked(cells: DataFrame, nodata: float | None = None) -> DataFrame:
    return cells.withColumn("value", valid(F.col("value").cast("double"), nodata))


def align(pixels: DataFrame, left: float, top: float, xres: float, yres: float, width: int, height: int) -> DataFrame:
    """Pixels(pass_idx, x, y, value) on one grid: the average of what falls in each cell; what is outside goes."""
    row, col = F.floor((F.lit(top) - F.col("y")) / yres).cast("int"), F.floor((F.col("x") - left) / xres).cast("int")
    put = pixels.withColumn("row", row).withColumn("col", col).where(f"row between 0 and {height - 1} and col between 0 and {width - 1}")
    return put.groupBy("pass_idx", "row", "col").agg(F.avg("value").alias("value"))


def common_extent(boxes: DataFrame, extent: str = "intersection") -> DataFrame:
    """left, bottom, right, top of boxes(left, bottom, right, top): what all share, or what any has."""
    if extent not in ("intersection", "union"):
        raise PlanError(f"unknown extent {extent!r}")
    lo, hi = (F.max, F.min) if extent == "intersection" else (F.min, F.max)
    return boxes.agg(lo("left").alias("left"), lo("bottom").alias("bottom"), hi("right").alias("right"), hi("top").alias("top"))


def distribution(cells: DataFrame) -> DataFrame:
    """Of each pass: valid cells and fraction, mean, population deviation, median, 5th and 95th percentile (exact, linear)."""
    v = F.col("value")
    moments = [F.count(v).alias("valid_cells"), (F.count(v) / F.count(F.lit(1))).alias("valid_fraction"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")]
    out = quantiles(masked(cells), ["pass_idx"], v, [0.05, 0.5, 0.95], moments)
    return out.select("pass_idx", "valid_cells", "valid_fraction", "mean", F.col("q")[1].alias("median"), "std", F.col("q")[0].alias("p5"), F.col("q")[2].alias("p95"))


def sketch_quantiles(cells: DataFrame, qs: list[float]) -> DataFrame:
    """Quantiles of each pass from a histogram of BIN_DB bins, linear within a bin, as amplitudes; one mergeable count for each bin."""
    bins = masked(cells).where("value is not null").groupBy("pass_idx", F.floor(db(F.col("value")) / BIN_DB).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("pass_idx")  # as many rows as there are bins: the dynamic range over BIN_DB
    run = bins.withColumn("seen", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))).withColumn("total", F.sum("n").over(w)).fillna({"seen": 0})
    out = None
    for q in qs:
        target = F.lit(q) * (F.col("total") - 1)
        inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (target - F.col("seen") + 0.5) / F.col("n")))
        level = (F.col("bin") + inside) * BIN_DB
        one = run.where((F.col("seen") <= target) & (F.col("seen") + F.col("n") > target)).select("pass_idx", F.lit(q).alias("q"), F.pow(F.lit(10.0), level / 20).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def change_of(delta: Column, threshold: float = THRESHOLD_DB, area_m2: float | None = None, strict: bool = False) -> list[Column]:
    """Aggregates of a dB difference; a change counts from the threshold on, or if strict beyond it."""
    up, down = (delta > threshold, delta < -threshold) if strict else (delta >= threshold, delta <= -threshold)
    share = lambda c: F.avg(c.cast("double"))
    area = F.sum(F.when(up | down, F.lit(area_m2 / 1e6)).otherwise(0.0)) if area_m2 else F.lit(None).cast("double")
    return [
        F.count(delta).alias("compared_cells"), F.avg(delta).alias("mean_delta_db"), F.avg(F.abs(delta)).alias("mean_abs_delta_db"),
        share(up).alias("brightened_fraction"), share(down).alias("dimmed_fraction"), share(up | down).alias("changed_fraction"), area.alias("changed_area_km2"),
    ]


def deltas(cells: DataFrame) -> DataFrame:
    """pass_idx, row, col, delta: dB against the pass before; null unless both are valid."""
    level = masked(cells).withColumn("_db", db(F.col("value")))
    w = Window.partitionBy("row", "col").orderBy("pass_idx")
    # A cell may lack a row for a pass: only the pass right before counts.
    before = F.when(F.lag("pass_idx").over(w) == F.col("pass_idx") - 1, F.lag("_db").over(w))
    return level.withColumn("delta", F.col("_db") - before).select("pass_idx", "row", "col", "delta")


def change_steps(cells: DataFrame, threshold: float = THRESHOLD_DB, area_m2: float | None = None) -> DataFrame:
    """A row for each pass with a comparison: its change against the one before."""
    d = deltas(cells).where("delta is not null")
    return d.groupBy("pass_idx").agg(*change_of(F.col("delta"), threshold, area_m2))


def net_deltas(cells: DataFrame) -> DataFrame:
    """row, col, delta between the first and the last pass of the cube."""
    level = masked(cells).withColumn("_db", db(F.col("value")))
    ends = cells.agg(F.min("pass_idx").alias("lo"), F.max("pass_idx").alias("hi"))
    both = level.join(F.broadcast(ends)).where("pass_idx in (lo, hi)")  # one row
    pair = both.groupBy("row", "col").agg(F.max(F.when(F.col("pass_idx") == F.col("lo"), F.col("_db"))).alias("a"), F.max(F.when(F.col("pass_idx") == F.col("hi"), F.col("_db"))).alias("b"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return pair.where("lo < hi and a is not null and b is not null").select("row", "col", (F.col("b") - F.col("a")).alias("delta"))


def change_net(cells: DataFrame, threshold: float = THRESHOLD_DB, area_m2: float | None = None) -> DataFrame:
    return net_deltas(cells).agg(*change_of(F.col("delta"), threshold, area_m2)).where("compared_cells > 0")


def block_index(i: Column, length: int, parts: int) -> Column:
    """Which of so many near-equal slices an index is in; the first slices take what is left over."""
    base, extra = divmod(length, parts)
    if base == 0:
        return i.cast("int")
    edge = extra * (base + 1)
    return F.when(i < edge, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - edge) / base)).cast("int")


def compass(row: Column, col: Column, rows: int, cols: int) -> Column:
    def band(i: Column, n: int, low: str, high: str) -> Column:
        t = i / (n - 1) if n > 1 else F.lit(0.5)
        return F.when(t < 1 / 3, low).when(t > 2 / 3, high).otherwise("")

    text = F.concat(band(row, rows, "north", "south"), band(col, cols, "west", "east"))
    return F.when(text == "", "center").otherwise(text)


def blocks(cells: DataFrame, shape: tuple[int, int], parts: int, threshold: float = THRESHOLD_DB, floor: float | None = None) -> DataFrame:
    """Net change, peak interval and place of each block; of equal peaks the first wins."""
    if parts < 1:
        raise PlanError("blocks must be 1 at least")
    at = lambda d: d.withColumn("block_row", block_index(F.col("row"), shape[0], parts)).withColumn("block_col", block_index(F.col("col"), shape[1], parts))
    net = at(net_deltas(cells)).groupBy("block_row", "block_col").agg(*change_of(F.col("delta"), threshold))
    steps = at(deltas(cells).where("delta is not null")).groupBy("block_row", "block_col", "pass_idx").agg(F.avg("delta").alias("mean"))
    peak = steps.groupBy("block_row", "block_col").agg(F.max_by(F.struct("pass_idx", "mean"), F.struct(F.abs("mean"), -F.col("pass_idx"))).alias("peak"))
    out = net.join(peak, ["block_row", "block_col"], "full").withColumn("compass", compass(F.col("block_row"), F.col("block_col"), parts, parts))
    out = out.select("block_row", "block_col", "compass", "compared_cells", "mean_delta_db", "changed_fraction", F.col("peak.pass_idx").alias("peak_pass"), F.col("peak.mean").alias("peak_delta_db"))
    return out.withColumn("stands_clear", F.col("changed_fraction") >= floor * CLEAR) if floor is not None else out


def grid_text(found: DataFrame, parts: int) -> DataFrame:
    """The blocks' mean changes as text, a line for each row of blocks."""
    spark = found.sparkSession
    every = spark.range(parts * parts).select((F.col("id") / parts).cast("int").alias("block_row"), (F.col("id") % parts).cast("int").alias("block_col"))
    cell = F.when(F.col("mean_delta_db").isNull(), "   . ").otherwise(F.format_string("%+5.1f", "mean_delta_db"))
    lines = every.join(found, ["block_row", "block_col"], "left").groupBy("block_row").agg(F.array_sort(F.collect_list(F.struct("block_col", cell.alias("t")))).alias("c"))
    return lines.select("block_row", F.array_join(F.transform("c", lambda x: x["t"]), " ").alias("line"))


def best_interval(steps: DataFrame, floor: float = 0.0) -> DataFrame:
    """The step that exceeds the floor most, then changes most, then is first; one row."""
    key = F.struct((F.col("changed_fraction") - floor).alias("e"), F.col("changed_fraction").alias("c"), (-F.col("pass_idx")).alias("i"))
    best = steps.agg(F.max_by(F.struct("pass_idx", "changed_fraction", "mean_delta_db"), key).alias("b")).where("b is not null")
    return best.select(
        F.col("b.pass_idx").alias("index"), F.col("b.changed_fraction").alias("changed_fraction"), F.col("b.mean_delta_db").alias("mean_delta_db"),
        F.bround(F.col("b.changed_fraction") - floor, 4).alias("excess"), (F.col("b.changed_fraction") >= floor * CLEAR).alias("stands_clear"),
    )


def two_band(pair: DataFrame, shape: tuple[int, int], parts: int = 6, threshold: float = THRESHOLD_DB) -> DataFrame:
    """Blocks of pair(row, col, earlier, later): the strict counts, and whether a block has the largest mean absolute change."""
    a, b = valid(F.col("earlier").cast("double")), valid(F.col("later").cast("double"))
    d = pair.withColumn("delta", db(b) - db(a)).withColumn("block_row", block_index(F.col("row"), shape[0], parts)).withColumn("block_col", block_index(F.col("col"), shape[1], parts))
    out = d.groupBy("block_row", "block_col").agg(*change_of(F.col("delta"), threshold, strict=True), (F.count("delta") / F.count(F.lit(1))).alias("valid_fraction"))
    top = out.agg(F.max_by(F.struct("block_row", "block_col"), F.struct("mean_abs_delta_db", -F.col("block_row"), -F.col("block_col"))).alias("p"))
    return out.join(F.broadcast(top)).withColumn("peak", (F.col("block_row") == F.col("p.block_row")) & (F.col("block_col") == F.col("p.block_col"))).drop("p", "changed_area_km2")  # one row


def scene_change(pair: DataFrame, threshold: float = THRESHOLD_DB) -> DataFrame:
    """Mean absolute change over the valid cells of the scene, and the share that changed beyond the threshold."""
    d = db(valid(F.col("later").cast("double"))) - db(valid(F.col("earlier").cast("double")))
    return pair.agg(F.avg(F.abs(d)).alias("mean_abs_delta_db"), F.coalesce(F.avg((F.abs(d) > threshold).cast("double")), F.lit(0.0)).alias("changed_fraction"))


def timescan(cells: DataFrame) -> DataFrame:
    """Mean, largest and population deviation over the passes of each cell; cells invalid in any pass go."""
    n = cells.agg(F.count_distinct("pass_idx").alias("n"))
    out = masked(cells).groupBy("row", "col").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.stddev_pop("value").alias("std"), F.count("value").alias("k"))
    return out.join(F.broadcast(n)).where("k = n").drop("k", "n")  # one row
