"""Site ranking and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sites
from ..plans.spec import SearchSpec, SiteSpec
from .adapters import ACQ, acquisitions

_GAPS = """
p AS (SELECT *, date_diff('microsecond', lag(ts) OVER (PARTITION BY task ORDER BY ts, href), ts) / 86400e6 AS gap FROM acq),
g AS (SELECT task, polarizations, count(*) AS n FROM acq GROUP BY ALL),
best AS (SELECT task, polarizations FROM g QUALIFY row_number() OVER (PARTITION BY task ORDER BY n DESC, polarizations) = 1),
same AS (SELECT acq.*, date_diff('microsecond', lag(ts) OVER (PARTITION BY acq.task ORDER BY ts, href), ts) / 86400e6 AS gap FROM acq JOIN best USING (task, polarizations)),
a AS (
  SELECT task, count(*) AS passes, min(ts)::DATE AS first, max(ts)::DATE AS last, CASE WHEN count(*) > 1 THEN date_sub('day', min(ts), max(ts)) END AS span_days,
    min(gap) AS min_gap, median(gap) AS median_gap, max(gap) AS max_gap, arg_min(place, struct_pack(ts, href)) FILTER (place IS NOT NULL) AS place,
    min(min_lon) AS w, min(min_lat) AS s, max(max_lon) AS e, max(max_lat) AS n
  FROM p GROUP BY task
),
b AS (
  SELECT task, count(*) AS comparable_passes, CASE WHEN count(*) > 1 THEN date_sub('day', min(ts), max(ts)) END AS comparable_span_days,
    min(gap) AS c_min_gap, median(gap) AS c_median_gap, max(gap) AS c_max_gap, any_value(polarizations) AS pols FROM same GROUP BY task
),
cov AS (SELECT * FROM a JOIN b USING (task))
"""
_COLUMNS = "task, passes, comparable_passes, first, last, span_days, comparable_span_days, round(median_gap, 6) AS median_revisit_days, round(max_gap, 6) AS max_revisit_days"


def _sql(order: str, where: str = "passes >= 2", top: int = 20) -> str:
    return f"WITH {ACQ}, {_GAPS} SELECT {_COLUMNS} FROM cov WHERE {where} ORDER BY {order} LIMIT {top}"


def _ranked(**spec):
    def run(spark, sf_dir):
        out = sites.rank_sites(acquisitions(spark, sf_dir), None, SiteSpec(**spec))
        return out.select("task", "passes", "comparable_passes", "first", "last", "span_days", "comparable_span_days", F.round("median_revisit_days", 6).alias("median_revisit_days"), F.round("max_revisit_days", 6).alias("max_revisit_days"))

    return run


def _full(spark, sf_dir):
    c = sites.coverage(acquisitions(spark, sf_dir))
    joined = lambda x: F.array_join(x, ",")
    return c.select(
        "task", "label", "passes", "comparable_passes", "first", "last", "span_days", "comparable_span_days",
        *[F.round(f"{p}{k}_revisit_days", 6).alias(f"{p}{k}_revisit_days") for p in ("", "comparable_") for k in ("min", "median", "max")],
        F.col("bbox.min_lon").alias("w"), F.col("bbox.min_lat").alias("s"), F.col("bbox.max_lon").alias("e"), F.col("bbox.max_lat").alias("n"),
        joined("products").alias("products"), joined("polarizations").alias("polarizations"), joined("comparable_polarizations").alias("comparable_polarizations"),
        F.md5(joined("hrefs")).alias("hrefs_md5"), F.md5(joined("comparable_hrefs")).alias("comparable_hrefs_md5"),
    )


_FULL = f"""WITH {ACQ}, {_GAPS},
pr AS (SELECT task, string_agg(x, ',' ORDER BY x) AS products FROM (SELECT DISTINCT task, unnest(products) AS x FROM acq) GROUP BY task),
po AS (SELECT task, string_agg(x, ',' ORDER BY x) AS polarizations FROM (SELECT DISTINCT task, unnest(polarizations) AS x FROM acq) GROUP BY task),
h AS (SELECT task, md5(string_agg(href, ',' ORDER BY ts, href)) AS hrefs_md5 FROM acq GROUP BY task),
ch AS (SELECT task, md5(string_agg(href, ',' ORDER BY ts, href)) AS comparable_hrefs_md5 FROM same GROUP BY task)
SELECT task, coalesce(place, task) AS label, passes, comparable_passes, first, last, span_days, comparable_span_days,
  round(min_gap, 6) AS min_revisit_days, round(median_gap, 6) AS median_revisit_days, round(max_gap, 6) AS max_revisit_days,
  round(c_min_gap, 6) AS comparable_min_revisit_days, round(c_median_gap, 6) AS comparable_median_revisit_days, round(c_max_gap, 6) AS comparable_max_revisit_days,
  w, s, e, n, products, polarizations, array_to_string(pols, ',') AS comparable_polarizations, hrefs_md5, comparable_hrefs_md5
FROM cov JOIN pr USING (task) JOIN po USING (task) JOIN h USING (task) JOIN ch USING (task)"""


def _filtered(spark, sf_dir):
    out = sites.rank_sites(acquisitions(spark, sf_dir), SearchSpec(start="2024-01-10", products="GEC", min_incidence=20.0), SiteSpec(rank_by="span", top=15))
    return out.select("task", "passes", "comparable_passes", "span_days", "last")


REGISTERED = {
    "sites_by_passes": (_ranked(), _sql("passes DESC, task")),
    "sites_by_comparable": (_ranked(rank_by="comparable"), _sql("comparable_passes DESC, passes DESC, task", "comparable_passes >= 2")),
    "sites_by_recency": (_ranked(rank_by="recency"), _sql("last DESC, passes DESC, task")),
    "sites_by_span": (_ranked(rank_by="span"), _sql("coalesce(span_days, -1) DESC, passes DESC, task")),
    "sites_by_cadence": (_ranked(rank_by="cadence"), _sql("coalesce(median_gap, 'inf'::DOUBLE), passes DESC, task")),
    "sites_gate_active": (_ranked(active_since="2024-01-20", active_before="2024-01-29", top=None), _sql("task", "passes >= 2 AND last BETWEEN DATE '2024-01-20' AND DATE '2024-01-29'", 1_000_000)),
    "sites_gate_onset": (_ranked(first_since="2024-01-01", first_before="2024-01-02", top=None), _sql("task", "passes >= 2 AND first BETWEEN DATE '2024-01-01' AND DATE '2024-01-02'", 1_000_000)),
    "sites_gate_max_gap": (_ranked(max_revisit_days=2.0, top=None), _sql("task", "passes >= 2 AND max_gap <= 2", 1_000_000)),
    "sites_gate_max_gap_comparable": (_ranked(rank_by="comparable", max_revisit_days=6.0, top=None), _sql("task", "comparable_passes >= 2 AND c_max_gap <= 6", 1_000_000)),
    "sites_gate_median_gap": (_ranked(median_revisit_days=0.25, top=None), _sql("task", "passes >= 2 AND median_gap <= 0.25", 1_000_000)),
    "sites_span_window": (_ranked(min_span_days=27, max_span_days=28, top=None), _sql("task", "passes >= 2 AND span_days BETWEEN 27 AND 28", 1_000_000)),
    "site_coverage_full": (_full, _FULL),
    "sites_filtered": (
        _filtered,
        f"WITH {ACQ.replace('acq AS', 'every AS', 1)}, acq AS (SELECT * FROM every WHERE acq_date >= DATE '2024-01-10' AND list_contains(products, 'GEC') AND incidence >= 20), {_GAPS} "
        "SELECT task, passes, comparable_passes, span_days, last FROM cov WHERE passes >= 2 ORDER BY coalesce(span_days, -1) DESC, passes DESC, task LIMIT 15",
    ),
}
