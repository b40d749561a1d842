"""Mixing sources to target weights by Poisson replication, on DataFrame operations alone.

Each source s has a target share w_s of `total` rows, so each of its n_s documents is wanted
total * w_s / n_s times.  A document's count is the Poisson distribution with that mean, inverted at a
uniform number made from md5(seed, id); the copies are then dealt out in a random total order.

Only the per-source counts are gathered (one partial aggregate).  The inverse distribution is a
sorted array on each source's row, so that documents meet it by an equi-join: the table is sent to all tasks
if its measured size allows, else a sort-merge join runs, whose hot sources AQE splits.  Nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: Production parameters of the query: relative weights; a source without an own one has the default.
WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 0.5}
SEED = "mix-1"
#: Largest table of distributions, in numbers of eight bytes, that is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_NUMBERS = 1_000_000


def uniform(seed: str, *parts: Column) -> Column:
    """A number within (0, 1) from the first 52 bits of md5."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def poisson_table(rate: Column) -> Column:
    """The distribution function at 0, 1, 2 ... as an array, as far as doubles tell it from 1.

    Terms are made from logarithms, so that large rates don't underflow.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.lit(0.0).alias("log_factorial"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log_factorial = acc["log_factorial"] + F.when(k > 0, F.log(F.greatest(k, F.lit(1)).cast("double"))).otherwise(0.0)
        total = acc["total"] + F.exp(k * F.log(rate) - rate - log_factorial)
        return F.struct(log_factorial.alias("log_factorial"), total.alias("total"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), last), start, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))


def mix(
    docs: DataFrame,
    weights: dict[str, float],
    default: float = 1.0,
    epochs: float = 1.0,
    seed: str = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """All columns of docs, each row repeated by its Poisson count, with mix_copy (1, 2 ...), mix_rate and mix_order.

    The expected number of rows is epochs * count(docs).  Weights are relative and are normalised
    over the sources that occur; a source of weight 0 goes.  A null source is a source of its own with
    the default weight.  Rows with the same id share their draw; null ids count as an empty id.  Texts
    aren't looked at.  An empty table gives an empty one.  Columns of docs that have one of the three
    new names are replaced; columns named _mix_... are left out.
    """
    if default < 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights can't be negative")
    docs = docs.drop("mix_copy", "mix_rate", "mix_order", *[c for c in docs.columns if c.startswith("_mix_")])
    key = F.col(source_col)
    weight = F.lit(float(default))
    for name, value in weights.items():
        weight = F.when(key == name, F.lit(float(value))).otherwise(weight)
    counts = docs.groupBy(key.alias("_mix_source")).agg(F.count(F.lit(1)).alias("_mix_n"))
    wanted = counts.select(F.col("_mix_source").alias(source_col), "_mix_n").withColumn("_mix_w", weight)
    total = wanted.agg(F.sum("_mix_n").alias("_mix_all"), F.sum("_mix_w").alias("_mix_sum"))
    rates = wanted.join(F.broadcast(total))  # one row: the totals
    rates = rates.select(
        F.col(source_col).alias("_mix_source"),
        F.when(F.col("_mix_sum") > 0, F.lit(float(epochs)) * F.col("_mix_all") * F.col("_mix_w") / F.col("_mix_sum") / F.col("_mix_n")).otherwise(F.lit(0.0)).alias("mix_rate"),
    ).withColumn("_mix_cdf", poisson_table(F.col("mix_rate")))
    rates = durable(rates)
    numbers = rates.agg(F.coalesce(F.sum(F.size("_mix_cdf") + 4), F.lit(0)).alias("n")).first()["n"]
    if numbers <= BROADCAST_NUMBERS:
        rates = F.broadcast(rates)
    draw = uniform(seed, F.col(id_col))
    met = docs.join(rates, key.eqNullSafe(F.col("_mix_source"))).withColumn("_mix_u", draw)
    counted = met.withColumn("_mix_k", F.size(F.filter("_mix_cdf", lambda c: c < F.col("_mix_u")))).where(F.col("_mix_k") > 0)
    copies = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_k")))).drop("_mix_source", "_mix_cdf", "_mix_u", "_mix_k")
    return copies.withColumn("mix_order", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col(id_col).cast("string"), F.col("mix_copy").cast("string"))))


def shuffled(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows in their random total order: a range exchange on a hash, even for the hottest source."""
    return mixed.orderBy("mix_order", id_col, "mix_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled(mix(table(spark, sf_dir, "documents"), WEIGHTS)).withColumn("mix_rate", F.round("mix_rate", 9))


def mix_sql(source: str, epochs: float = 1.0, default: float = 1.0) -> str:
    """DuckDB SQL for the rows of shuffled(mix(source))."""
    cases = " ".join(f"WHEN source = '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items())
    return f"""
WITH RECURSIVE docs AS (SELECT * FROM {source}),
counts AS (SELECT source, count(*) AS n, CASE {cases} ELSE {default}::DOUBLE END AS w FROM docs GROUP BY source),
rates AS (
  SELECT source, {epochs}::DOUBLE * (SELECT sum(n) FROM counts)::DOUBLE * w / (SELECT sum(w) FROM counts) / n AS mix_rate FROM counts
),
cdf AS (
  SELECT source, mix_rate, 0 AS k, 0::DOUBLE AS lf, exp(-mix_rate) AS total FROM rates WHERE mix_rate > 0
  UNION ALL
  SELECT source, mix_rate, k + 1, lf + ln((k + 1)::DOUBLE), total + exp((k + 1) * ln(mix_rate) - mix_rate - (lf + ln((k + 1)::DOUBLE)))
  FROM cdf WHERE k < ceil(mix_rate + 12 * sqrt(mix_rate) + 30)
),
tables AS (SELECT source, mix_rate, list(total ORDER BY k) AS totals FROM cdf GROUP BY ALL),
drawn AS (
  SELECT d.*, t.mix_rate,
    len(list_filter(t.totals, lambda c: c < ((('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496)) AS k
  FROM docs d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT * EXCLUDE (k, mix_copy) REPLACE (round(mix_rate, 9) AS mix_rate), mix_copy::INT AS mix_copy, md5(concat_ws(':', '{SEED}', 'order', doc_id::VARCHAR, mix_copy::VARCHAR)) AS mix_order
FROM (SELECT *, unnest(range(1, k + 1)) AS mix_copy FROM drawn WHERE k > 0)
"""


SQL = mix_sql("documents")
